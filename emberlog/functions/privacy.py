"""Personal data in texts: found by its form and by what stands around it, and masked."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(NamedTuple):
    """What may be a value (find); what it is if it is one (whole) and what it has in it (holds); what mustn't end the text before it or begin the text behind it.

    Patterns have no groups that are counted, and mean the same in Java and in RE2. None: no such condition.
    """

    find: str
    whole: str | None = None
    holds: str | None = None
    before: str | None = None
    behind: str | None = None


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_GROUPS = f"{_HEX}(?::{_HEX}){{0,5}}"

#: What is looked for, in this order. A dotted number is read to its end, so parts of longer ones are no addresses, nor is what a
#: word for versions stands before. An address of eight groups, or of fewer with a ::, has a digit and isn't part of a name; national
#: phone numbers are those of ten digits in three groups, or with the area in brackets.
PERSONAL = {
    "email": Kind(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    "ip": Kind(r"[0-9]+(?:\.[0-9]+)+", rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z", before=r"(?i)(?:^|[^a-z])(?:v|ver|version|release|rev)[ .:=]{0,3}\z"),
    "ipv6": Kind(
        r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}",
        rf"^(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_GROUPS})?::(?:{_GROUPS})?)\z",
        holds="[0-9]",
        before=r"[0-9A-Za-z_:.]\z",
        behind="^[0-9A-Za-z_:]",
    ),
    "phone": Kind(
        r"\+[0-9][0-9 ().-]{6,}[0-9]|\([0-9]{2,5}\)[ ]?[0-9]{3}[-. ]?[0-9]{3,5}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}",
        before=r"[0-9_][-.]?\z",
        behind="^(?:[0-9A-Za-z_]|[-.][0-9])",
    ),
}


def mask(text: str | Column, how: str = "redact", *, kinds: tuple[str, ...] = tuple(PERSONAL), key: str = "") -> Column:
    """A text without its personal data; null for null.

    redact: [email]; hash: the first 16 digits of a SHA-256 of key and value; pseudonymize: the kind and six of those,
    so equal values stay equal and are told apart.
    """
    text = F.col(text) if isinstance(text, str) else text
    digest = lambda v: F.sha2(F.concat(F.lit(key), v), 256)
    for kind in kinds:
        shown = {
            "redact": lambda v, kind=kind: F.lit(f"[{kind}]"),
            "hash": lambda v: F.substring(digest(v), 1, 16),
            "pseudonymize": lambda v, kind=kind: F.concat(F.lit(f"{kind}-"), F.substring(digest(v), 1, 6)),
        }[how]
        if how == "redact" and PERSONAL[kind] == Kind(PERSONAL[kind].find):
            text = F.regexp_replace(text, PERSONAL[kind].find, f"[{kind}]")
        else:
            text = _replaced(text, PERSONAL[kind], shown)
    return text


def _with(value: Column, use) -> Column:
    """use(value), the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _replaced(text: Column, kind: Kind, shown) -> Column:
    """What stands between the finds stays, and each find that is a value is put back as it is shown."""

    def one(x: Column) -> Column:
        tests = [(x["v"], kind.whole, True), (x["v"], kind.holds, True), (x["before"], kind.before, False), (x["behind"], kind.behind, False)]
        is_value = F.lit(True)
        for part, pattern, wanted in tests:
            if pattern:
                is_value = is_value & (part.rlike(pattern) == F.lit(wanted))
        return F.concat(x["before"], F.when(is_value, shown(x["v"])).otherwise(x["v"]))

    def joined(finds: Column, between: Column) -> Column:
        # each find beside its neighbours, so that no find looks into the whole list
        beside = F.arrays_zip(finds.alias("v"), F.slice(between, F.lit(1), F.size(finds)).alias("before"), F.slice(between, F.lit(2), F.size(finds)).alias("behind"))
        return F.concat(F.array_join(F.transform(beside, one), ""), F.element_at(between, -1))

    cut = lambda t: F.struct(F.regexp_extract_all(t, F.lit(f"({kind.find})"), F.lit(1)).alias("finds"), F.split(t, kind.find, -1).alias("between"))
    # a text without finds is given back as it is
    return _with(text, lambda t: F.when(t.rlike(kind.find), _with(cut(t), lambda c: joined(c["finds"], c["between"]))).otherwise(t))
