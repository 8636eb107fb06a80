"""Texts of logs as typed values: numbers, time stamps, named groups of patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NO_NUMBER = r"(?i)^[+-]?(inf|infinity|nan)$"
#: RFC 3339, in a form that the cast to a time stamp takes.
RFC_3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: Formats of time stamps that are tried after a source's own one.
COMMON_FORMATS = ["%Y-%m-%dT%H:%M:%S%.fZ", "%Y-%m-%d %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z", "%Y/%m/%d %H:%M:%S"]
#: Directives of strptime and the letters that mean the same here.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss", "%z": "Z", "%y": "yy", "%j": "DDD", "%p": "a", "%I": "hh", "%%": "%"}


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coerce(text: str | Column, *, booleans: bool = False) -> Column:
    """A variant: a whole number, else a float, else (if asked for) true or false, else the text; null for null.

    Numbers beyond 64 bits are floats; infinities and what isn't a number have no JSON form and become null.
    """
    text = _col(text)
    whole = F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    real = F.when(text.rlike(FLOAT), text.try_cast("double"))
    out = F.when(whole.isNotNull(), whole.cast("variant")).when(real.isNotNull(), real.cast("variant")).when(text.rlike(NO_NUMBER), F.parse_json(F.lit("null")))
    if booleans:
        out = out.when(text.isin("true", "false"), text.try_cast("boolean").cast("variant"))
    return out.otherwise(text.cast("variant"))


#: How text of each common format looks: what doesn't is not handed to the parser, which fails slowly.
_LOOKS = {"%Y": r"\d{4}", "%m": r"\d{2}", "%d": r"\d{2}", "%H": r"\d{2}", "%M": r"\d{2}", "%S": r"\d{2}", "%b": "[A-Za-z]{3}", "%z": r"[+-]\d{2}:?\d{2}"}

#: A number as it would be written again: a whole one, or a short one with a point.
PLAIN_NUMBER = r"0|-?[1-9]\d{0,17}|(?:0|-?[1-9]\d{0,5})\.0|-?[1-9]\d{0,5}\.\d{0,7}[1-9]|-?0\.(?!000)\d{0,11}[1-9]"
_ANY_NUMBER = r'(?i)":"[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity|nan)"'


def coerce_json(json: str | Column, *, booleans: bool = False) -> Column:
    """A flat JSON object of texts with its values coerced as coerce() does.

    Quotes within texts are escaped there, so a quoted number behind a colon is a value. Most numbers only lose
    their quotes; objects with numbers in another form go through variants.
    """
    json = _col(json)
    bare = F.regexp_replace(json, F.lit(rf'":"({PLAIN_NUMBER}{"|true|false" if booleans else ""})"(?=[,}}])'), F.lit('":$1'))
    slow = F.to_json(F.transform_values(F.from_json(json, "map<string,string>"), lambda _, v: coerce(v, booleans=booleans)))
    return F.transform(F.array(bare), lambda x: F.when(x.rlike(_ANY_NUMBER), slow).otherwise(x))[0]


def in_utc(at: Column) -> Column:
    """A time stamp without zone that shows the instant in UTC, whatever the session's zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(at), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def rfc3339(text: str | Column) -> Column:
    """The instant of an RFC 3339 text in UTC; null for any other text."""
    text = _col(text)
    return F.when(text.rlike(RFC_3339), in_utc(F.upper(text).try_cast("timestamp")))


def java_format(format: str) -> str:
    """A strptime format as a pattern of to_timestamp(); '' if it has a directive without an equal."""
    out, at = "", 0
    for m in re.finditer(r"%\.f|%.|[A-Za-z]+|'", format):
        out += format[at : m.start()]
        token, at = m[0], m.end()
        if token == "%.f":
            out += "[.SSSSSSSSS][.SSSSSS][.SSS]"
        elif token[0] == "%":
            if token not in DIRECTIVES:
                return ""
            out += DIRECTIVES[token]
        else:
            out += "''" if token == "'" else f"'{token}'"
    return out + format[at:]


def by_format(text: Column, format: str) -> Column:
    """The instant in UTC by one strptime format; null where it doesn't fit or has a directive without an equal."""
    pattern, zoned = java_format(format), "%z" in format
    if not pattern:
        return F.lit(None).cast("timestamp_ntz")
    return in_utc(F.try_to_timestamp(text if zoned else F.concat(text, F.lit(" +0000")), F.lit(pattern if zoned else pattern + " Z")))


def timestamp(text: str | Column, format: str | None = None) -> Column:
    """The instant in UTC by the given format, then the common ones, then RFC 3339; without a zone it is UTC."""
    text = _col(text)
    found = [by_format(text, format)] if format else []
    for f in COMMON_FORMATS:
        if f == "%Y-%m-%dT%H:%M:%S%.fZ":
            found.append(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz")))
        else:
            found.append(F.when(text.rlike("^" + re.sub("%.", lambda m: _LOOKS[m[0]], f) + "$"), by_format(text, f)))
    return F.coalesce(*found, rfc3339(text))


def named_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with (?P<name>...) as one that regexp_extract() takes, and the number of each name's group.

    A point there stops at a line end only, so the pattern gets the flag for that.
    """
    names, number, at = {}, 0, 0
    out, inside = "", False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out, at = out + pattern[at : at + 2], at + 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        if c == "(" and not inside:
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:])
            if m:
                number += 1
                names[m[1]] = number
                out, at = out + "(", at + m.end()
                continue
            if pattern[at + 1 : at + 2] != "?":
                number += 1
        out, at = out + c, at + 1
    return "(?d)" + out, names


def ulid(at: Column | None = None, of: Column | None = None) -> Column:
    """An id of 26 characters in the order of time: ten of the milliseconds, sixteen at random, or by a hash of a text."""
    digits = lambda x, n: F.lpad(F.translate(x, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"), n, "0")
    millis = F.unix_millis(F.current_timestamp() if at is None else at).cast("string")
    random = F.sha2(F.uuid() if of is None else of, 256)
    return F.concat(digits(F.conv(millis, 10, 32), 10), *[digits(F.conv(F.substring(random, k, 10), 16, 32), 8) for k in (1, 11)])
