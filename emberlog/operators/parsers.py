"""Lines of logs as entries.

Every format gives a struct (timestamp, level, message, fields) by column expressions, null for a line that
isn't of the format. Only logfmt with its free quoting is read by an Arrow function; its plain form, which
is nearly every line, has an expression too.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.functions import levels
from emberlog.functions.values import FLOAT, INTEGER, NO_NUMBER, by_format, coerce_json, in_utc, java_format, named_groups, rfc3339, timestamp, ulid
from emberlog.sources.packs import Pack, PackError, Source
from emberlog.sources.scratch import spread

#: The two forms of a syslog line. What repeats is possessive: a long line must not take the matcher's stack.
RFC_3164 = r"(?:<(?P<pri>\d+)>)?(?P<timestamp>\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(?P<hostname>\S+)\s+(?P<app>\S+?)(?:\[(?P<pid>\d+)\])?:\s*(?P<message>.*)"
RFC_5424 = r"<(?P<pri>\d+)>(?P<version>\d+)\s+(?P<timestamp>\S+)\s+(?P<hostname>\S+)\s+(?P<app>\S+)\s+(?P<procid>\S+)\s+(?P<msgid>\S+)\s+(?P<sd>(?:\[[^\]\n]*+\])++|-)\s*(?P<message>.*)"
PARSED = "struct<timestamp:timestamp_ntz,level:string,message:string,fields:string>"
#: What a line was read as: at, by its source's own format, or at_text; level or a syslog pri; fields as JSON, and how
#: their texts are coerced (0: as they are, 1: numbers, 2: numbers and booleans).
_GOT = {"at": "timestamp_ntz", "at_text": "string", "level": "string", "pri": "string", "message": "string", "fields": "string", "coerced": "int"}


def _got(**known: Column) -> Column:
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in _GOT.items()])


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x worked out once however often then uses it; null for null."""
    return F.transform(F.array(x), lambda v: F.when(v.isNotNull(), then(v)))[0]


def _parsed(got: Column) -> Column:
    """The parsed struct of what a line was read as: the same few expressions for all formats."""
    level = F.when(got["pri"].isNotNull() | got["level"].isNull(), F.when(got["pri"].isNotNull(), levels.level_of_priority(got["pri"]))).otherwise(levels.normalise(got["level"]))
    fields = F.when(got["coerced"] == 0, got["fields"]).when(got["coerced"] == 1, coerce_json(got["fields"])).otherwise(coerce_json(got["fields"], booleans=True))
    return F.struct(F.coalesce(got["at"], timestamp(got["at_text"])).alias("timestamp"), level.alias("level"), F.coalesce(got["message"], F.lit("")).alias("message"), fields.alias("fields"))


#: Stands between groups; a line that holds it is read group by group.
_BETWEEN = "\u0001"


def _groups(line: Column, pattern: str) -> Column:
    """The groups of a pattern where it first fits, as an array of texts; null where it doesn't fit.

    All groups come of one replacement of the whole line by them, not of one search for each.
    """
    java, names = named_groups(pattern)
    n = re.compile(pattern).groups
    body = java.removeprefix("(?d)")
    whole = F.regexp_replace(line, F.lit(f"(?d)(?s:^.*?)(?:{body})(?s:.*)$"), F.lit("".join(f"${i + 1}{_BETWEEN}" for i in range(n))))
    if not n:
        return F.when(line.rlike(java), F.expr("cast(array() as array<string>)"))
    parts = F.transform(F.array(F.split(whole, F.lit(_BETWEEN), F.lit(-1))), lambda p: F.when(F.size(p) == n + 1, p))[0]
    singly = F.when(line.rlike(java), F.array(*[F.regexp_extract(line, java, i + 1) for i in range(n)]))
    return F.when(F.contains(line, F.lit(_BETWEEN)), singly).otherwise(parts)


def _named(groups: Column, pattern: str) -> dict[str, Column]:
    """Each named group's text, null for an optional group that isn't there."""
    _, numbers = named_groups(pattern)
    # a group that takes no part and an empty one look alike: only groups that may be left out become null
    optional = {n for n in numbers if re.search(rf"\([^()]*(\([^()]*)*\(\?P<{n}>[^()]*\)[^()]*\)[?*]|\(\?P<{n}>[^()]*\)[?*]", pattern)}
    got = {n: groups[i - 1] for n, i in numbers.items()}
    return {n: F.when(g != "", g) if n in optional else g for n, g in got.items()}


def _last_of_each(entries: Column) -> Column:
    """Of entries (key, value) with equal keys the last one, in their order; keys are sorted, not compared with one another."""

    def last(all: Column) -> Column:
        by_key = F.array_sort(F.transform(all, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"))))
        final = lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1)["key"] != x["key"], F.lit(True)))
        return F.transform(F.array_sort(F.transform(_once(by_key, final), lambda x: x["i"])), lambda i: F.get(all, i))

    return _once(entries, last)


@dataclass
class Parser:
    """read: what a line was read as (_GOT); null where it isn't of the format. odd: lines that only Python reads, if any."""

    read: Callable[[Column], Column]
    odd: Callable[[Column], Column] | None = None
    read_odd: Callable[[Column], Column] | None = None

    def __call__(self, line: Column) -> Column:
        read = self.read(line) if self.odd is None else F.when(self.odd(line), self.read_odd(line)).otherwise(self.read(line))
        return _once(read, _parsed)


def regex_parser(pattern: str, *, timestamp_field: str = "timestamp", timestamp_format: str | None = None) -> Parser:
    """The first place where the pattern fits; all named groups become fields, those of time, level and message too."""

    def got(groups: Column, line: Column) -> Column:
        named = _named(groups, pattern)
        known = {"message": named.get("message", line), "fields": F.to_json(F.struct(*[v.alias(n) for n, v in named.items()])) if named else F.lit("{}"), "coerced": F.lit(1)}
        if timestamp_field in named:
            known["at_text"] = named[timestamp_field]
            if timestamp_format and java_format(timestamp_format):
                known["at"] = by_format(named[timestamp_field], timestamp_format)
        if "level" in named:
            known["level"] = named["level"]
        return _got(**known)

    return Parser(lambda line: _once(_groups(line, pattern), lambda g: got(g, line)))


#: Keys of a journal's export, for the message, severity (0 to 7) and microseconds since 1970; and keys that become fields.
JOURNAL = ("MESSAGE", "PRIORITY", "__REALTIME_TIMESTAMP")
JOURNAL_FIELDS = {"_SYSTEMD_UNIT": "unit", "_PID": "pid"}


def json_parser(*, timestamp_field: str = "timestamp", renamed: dict[str, str] | None = None, journal: bool = False) -> Parser:
    """A JSON object; time, level and message leave the fields, and a message that isn't empty comes back as one.

    With journal, the keys of a journal's export stand for message, level and time where those aren't given.

    Of a repeated key the last value counts; so it does where a renamed key meets another one, in the order of the
    keys in the line. A key that repeats deeper inside leaves that value as text.
    """

    def last(m: Column) -> Column:
        """Entries of a map of which each key's last one stays."""
        return F.when(F.size(m) == F.size(F.array_distinct(F.map_keys(m))), m).otherwise(F.map_from_entries(_last_of_each(F.map_entries(m))))

    def values(line: Column) -> Column:
        alike, plain = line.rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(line).isNotNull()
        texts = lambda m: F.transform_values(last(m), lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant")))
        again = F.coalesce(_once(F.from_json(line, "map<string,variant>"), last), _once(F.from_json(line, "map<string,string>"), texts))
        return F.when(alike & plain, F.from_json(line, "map<string,variant>")).when(alike & F.get_json_object(line, "$").isNotNull(), again)

    renamed = (renamed or {}) | (JOURNAL_FIELDS if journal else {})

    def got(m: Column) -> Column:
        text = lambda key: _once(F.try_element_at(m, F.lit(key)), lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))
        at, level, said, more = rfc3339(text(timestamp_field)), text("level"), text("message"), {}
        gone = [timestamp_field, "level", "message"]
        if journal:
            shown = lambda key: F.try_element_at(m, F.lit(key)).cast("string")
            micros = shown(JOURNAL[2]).try_cast("bigint")
            at = F.coalesce(at, F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
            more["pri"] = F.when(level.isNull(), shown(JOURNAL[1]))
            said, gone = F.coalesce(said, text(JOURNAL[0])), [*gone, *JOURNAL]
            m = F.transform_values(m, lambda k, v: F.when((k == "_PID") & v.cast("string").rlike(r"^\d+$"), v.cast("string").try_cast("bigint").cast("variant")).otherwise(v))
        rest = F.map_filter(m, lambda k, _: ~k.isin(gone))
        if renamed:
            names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair])
            entries = F.transform(F.map_entries(rest), lambda e: F.struct(F.coalesce(names[e["key"]], e["key"]).alias("key"), e["value"].alias("value")))
            rest = F.map_from_entries(_last_of_each(entries))
        return _once(
            F.coalesce(said, F.lit("")),
            lambda message: _got(
                **more, at=at, level=level, message=message, coerced=F.lit(0),
                fields=F.to_json(F.when(message != "", F.map_concat(F.map_filter(rest, lambda k, _: k != "message"), F.create_map(F.lit("message"), message.cast("variant")))).otherwise(rest)),
            ),
        )

    return Parser(lambda line: _once(values(line), got))


def syslog_parser(form: str = "auto") -> Parser:
    """RFC 5424, RFC 3164, or the first of them that fits. The older form has no year, so its time is left to arrival."""
    if form == "auto":
        new, old = syslog_parser("5424"), syslog_parser("3164")

        def either(line: Column) -> Column:
            # only a line with a priority and a version can be of the newer form
            return F.when(line.rlike(r"<\d+>\d+\s"), _first_of(new.read(line), old.read(line))).otherwise(old.read(line))

        return Parser(either)
    pattern = RFC_3164 if form == "3164" else RFC_5424

    def got(groups: Column) -> Column:
        named = _named(groups, pattern)
        fields = [named["hostname"].alias("hostname"), named["app"].alias("app")]
        if form == "3164":
            return _got(pri=F.coalesce(named["pri"], F.lit("")), message=named["message"], coerced=F.lit(0), fields=F.to_json(F.struct(*fields, named["pid"].try_cast("bigint").alias("pid"))))
        fields += [named["procid"].alias("procid"), named["msgid"].alias("msgid")]
        return _got(at=rfc3339(named["timestamp"]), pri=named["pri"], message=named["message"], coerced=F.lit(0), fields=F.to_json(F.struct(*fields)))

    return Parser(lambda line: _once(_groups(line, pattern), got))


#: A logfmt line without white space in keys and without quotes inside quoted values; possessive, so lines of any length pass.
PLAIN_LOGFMT = r'^\s*+[^\s="]++=(?:"[^"\\]*+"|[^\s"]*+)(?:\s++[^\s="]++=(?:"[^"\\]*+"|[^\s"]*+))*+\s*+$'
_PAIR = r'([^\s="]+)=("[^"\\]*"|[^\s"]*)'


_ANY_PAIR = re.compile(r'\s*([^=]*)(?:=|\Z)(?:"((?:[^"\\]|\\.)*)\\?(?:"|\Z)|(\S*))', re.S)


def logfmt_pairs(line: str) -> dict[str, str]:
    """Pairs of a logfmt line of any form; the last value of a key counts.

    A key is all up to the next equals sign, white space included; a line end without one is a key with an
    empty value. A quoted value ends at the next quote without a backslash before it, or with the line.
    """
    pairs, at = {}, 0
    while m := _ANY_PAIR.match(line, at):
        if not m[1] or m.end() == at:
            break
        at = m.end()
        pairs[m[1]] = re.sub(r"\\(.)", r"\1", m[2], flags=re.S) if m[2] is not None else m[3]
    return pairs


def _json_value(text: str) -> object:
    if re.fullmatch(INTEGER[1:-1], text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if re.fullmatch(FLOAT[1:-1], text):
        return float(text)
    if re.fullmatch(NO_NUMBER.removeprefix("(?i)")[1:-1], text, re.I):
        return None
    return {"true": True, "false": False}.get(text, text)


def _any_logfmt(lines: pd.Series, ts: pd.Series) -> pd.DataFrame:
    rows = []
    for line, ts_key in zip(lines, ts):
        pairs = logfmt_pairs(line) if line is not None else {}
        rest = {k: _json_value(v) for k, v in pairs.items() if k not in (ts_key, "level", "msg")}
        rows.append((pairs.get(ts_key), pairs.get("level"), pairs.get("msg"), json.dumps(rest, ensure_ascii=False, separators=(",", ":")), len(pairs)))
    return pd.DataFrame(rows, columns=["ts", "level", "msg", "fields", "n"])


def logfmt_parser(*, timestamp_field: str = "ts", exact: bool = False) -> Parser:
    """Pairs of key=value; without any, null. exact reads quoting of any kind too, in Python, else such lines are null.

    parse() and parse_with() hand Python the odd lines only; applied to a column, exact sends it all lines.
    """

    def pairs(x: Column) -> Column:
        bare = lambda v: F.when(F.startswith(v, F.lit('"')), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        # of a repeated key the last value counts
        last = _last_of_each(F.arrays_zip(x["k"].alias("key"), F.transform(x["v"], bare).alias("value")))
        return F.when(F.size(F.array_distinct(x["k"])) == F.size(x["k"]), F.map_from_arrays(x["k"], F.transform(x["v"], bare))).otherwise(F.map_from_entries(last))

    def got(m: Column) -> Column:
        value = lambda key: F.try_element_at(m, F.lit(key))
        rest = F.map_filter(m, lambda k, _: ~k.isin(timestamp_field, "level", "msg"))
        return _got(at=rfc3339(value(timestamp_field)), level=value("level"), message=value("msg"), fields=F.to_json(rest), coerced=F.lit(2))

    def read(line: Column) -> Column:
        found = F.struct(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2)).alias("v"))
        return F.when(line.rlike(PLAIN_LOGFMT), _once(_once(found, pairs), got))

    def read_odd(line: Column) -> Column:
        told = F.pandas_udf(_any_logfmt, "ts string, level string, msg string, fields string, n int")(line, F.lit(timestamp_field))
        return F.when(told["n"] > 0, _got(at=rfc3339(told["ts"]), level=told["level"], message=told["msg"], fields=told["fields"], coerced=F.lit(0)))

    return Parser(read, lambda line: ~line.rlike(PLAIN_LOGFMT), read_odd) if exact else Parser(read)


def parser_of(source: Source, *, exact_logfmt: bool = True) -> Parser:
    at = {"timestamp_field": source.timestamp_field} if source.timestamp_field else {}
    if source.format in ("regex", "grok"):
        return regex_parser(source.pattern, timestamp_format=source.timestamp_format, **at)
    if source.format == "json":
        return json_parser(**at, journal=source.paths == ["journalctl"])
    if source.format == "logfmt":
        return logfmt_parser(exact=exact_logfmt, **at)
    if source.format.startswith("syslog"):
        return syslog_parser({"syslog-3164": "3164", "syslog-5424": "5424"}.get(source.format, "auto"))
    raise PackError(f"format '{source.format}'")


def _with_parsed(lines: DataFrame, read: Column) -> DataFrame:
    """Adds parsed. A generator of one row keeps it worked out once, whatever uses it."""
    return lines.withColumn("parsed", F.explode(F.array(_once(read, _parsed))))


def parse_with(lines: DataFrame, parser: Parser, column: str = "content") -> DataFrame:
    """Adds parsed, by one parser."""
    line = F.col(column)
    plain = _with_parsed(lines, parser.read(line))
    if parser.odd is None:
        return plain
    odd = F.coalesce(parser.odd(line), F.lit(False))
    return _with_parsed(lines.where(~odd), parser.read(line)).unionByName(_with_parsed(lines.where(odd), parser.read_odd(line)))


def parse(lines: DataFrame, packs: dict[str, Pack]) -> DataFrame:
    """lines: content, pack, source and any other columns. Adds parsed; null where the source is unknown or a line doesn't fit.

    One choice by source reads a line into a form common to all; what makes entries of that is there once, however
    many packs there are. Lines that only Python can read (logfmt with free quoting) are a branch of their own.
    """
    read, strange, by_python = _readers(repr([(p.name, p.sources) for p in packs.values()]), tuple(packs.values()))
    if strange is None:
        return _with_parsed(lines, read)
    return _with_parsed(lines.where(~strange), read).unionByName(_with_parsed(lines.where(strange), by_python))


class _Known(dict):
    """The last few results by key: a stream parses batch after batch with the same packs, and their expressions take a while to make."""

    def get_or(self, key, make):
        key = (key, id(SparkContext._active_spark_context))
        if key not in self:
            while len(self) >= 8:
                self.pop(next(iter(self)))
            self[key] = make()
        return self[key]


_KNOWN = _Known()


def _readers(name: str, packs: tuple[Pack, ...]) -> tuple[Column, Column | None, Column | None]:
    """How lines are read, which of them only Python reads, and how. Sources that are read alike share an expression."""

    def make() -> tuple[Column, Column | None, Column | None]:
        line, odd, alike = F.col("content"), [], {}
        for pack in packs:
            for source in pack.sources:
                how = (source.format, source.pattern, source.timestamp_field, source.timestamp_format, source.paths == ["journalctl"])
                here = (F.col("pack") == pack.name) & (F.col("source") == source.name)
                alike[how] = (source, alike[how][1] | here) if how in alike else (source, here)
        read = F.when(F.lit(False), F.lit(None).cast(f"struct<{','.join(f'{n}:{t}' for n, t in _GOT.items())}>"))
        for source, here in alike.values():
            parser = parser_of(source)
            read = read.when(here, parser.read(line))
            if parser.odd is not None:
                odd.append((here & parser.odd(line), parser))
        if not odd:
            return read, None, None
        strange = F.coalesce(functools.reduce(lambda a, b: a | b, [here for here, _ in odd]), F.lit(False))
        by_python = F.when(F.lit(False), F.lit(None))
        for here, parser in odd:
            by_python = by_python.when(here, parser.read_odd(line))
        return read, strange, by_python

    return _KNOWN.get_or(name, make)


def _first_of(x: Column, rest: Column) -> Column:
    """x, or rest where it is null; x is worked out once."""
    return F.transform(F.array(x), lambda v: F.coalesce(v, rest))[0]


def parse_any_source(lines: DataFrame, pack: Pack) -> DataFrame:
    """lines: content. Adds source and parsed of the pack's first source that a line fits."""
    line, found = F.col("content"), None
    for source in reversed(pack.sources):
        parser = parser_of(source)
        here = _once(parser.read(line) if parser.odd is None else F.when(parser.odd(line), parser.read_odd(line)).otherwise(parser.read(line)), lambda got, name=source.name: F.struct(F.lit(name).alias("source"), got.alias("got")))
        found = here if found is None else _first_of(here, found)
    parsed = _once(found, lambda x: F.struct(x["source"].alias("source"), _once(x["got"], _parsed).alias("parsed")))
    got = lines.withColumn("__found", F.explode(F.array(parsed)))
    return got.withColumns({"source": F.col("__found.source"), "parsed": F.col("__found.parsed")}).drop("__found")


def entries(parsed: DataFrame, *, host: str = "localhost", now: Column | None = None, id: Column | None = None) -> DataFrame:
    """Entries of the lines that were parsed: time, level and id have defaults (now, info, a random id)."""
    p = F.col("parsed")
    at = F.coalesce(p["timestamp"], in_utc(F.current_timestamp()) if now is None else now)
    return parsed.where(p.isNotNull()).select(
        (ulid() if id is None else id).alias("id"),
        at.alias("timestamp"),
        "source",
        F.lit(host).alias("host"),
        F.coalesce(p["level"], F.lit("info")).alias("level"),
        p["message"].alias("message"),
        p["fields"].alias("fields"),
        F.col("content").alias("raw"),
        "pack",
    )


#: Lines, or bytes of a file, after which an entry of many lines is cut.
LONGEST = 1 << 20


def joined_lines(lines: DataFrame, start: str, *, file: str = "file_path", number: str = "line_no", block: int = 100_000, longest: int = LONGEST) -> DataFrame:
    """lines: content, a file and a line number (or offset). Lines that don't match start belong to the entry before them.

    A file's lines are looked at in blocks, so one long file is many tasks' work; what came before a block is
    one number for each block. Lines before a file's first start are an entry of their own, and an entry ends
    after longest numbers: lines that never match are no unbounded row.
    """
    in_block = Window.partitionBy(file, "__block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(file).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("__start", F.when(F.col("content").rlike(named_groups(start)[0]), F.col(number))).withColumn("__block", F.floor(F.col(number) / block))
    carried = marked.groupBy(file, "__block").agg(F.max("__start").alias("__last")).select(file, "__block", F.max("__last").over(before).alias("__carried"))
    rest = [c for c in lines.columns if c not in ("content", file, number)]
    ordered = F.array_sort(F.collect_list(F.struct(number, "content")))
    return (
        marked.join(carried, [file, "__block"])
        .withColumn("__group", F.coalesce(F.max("__start").over(in_block), "__carried", F.lit(-1)))
        .withColumn("__piece", F.floor((F.col(number) - F.greatest("__group", F.lit(0))) / longest))
        .groupBy(file, "__group", "__piece", *rest)
        .agg(F.min(number).alias(number), F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"))
        .drop("__group", "__piece")
    )


#: How long an entry of many lines stays open in a stream when no further line comes.
IDLE_MS = 2000
_OPEN = "began long, piece long, first long, last long, content string"


def joined_stream(lines: DataFrame, packs: dict[str, Pack], *, idle_ms: int = IDLE_MS, longest: int = LONGEST) -> DataFrame:
    """joined() for a stream: wherever its batches end, the entries are those that joined() makes of all lines at once.

    The entry that is open at the end of a batch is state of its file, at most longest bytes and one line of it; the next line that
    begins an entry lets it go, and so does a timer once no line has come for idle_ms. Lines after that are on their
    own. A file that begins anew (by offset) ends what was open. lines: as for joined().
    """
    starts = {(p.name, s.name): re.compile(s.multiline_start) for p in packs.values() for s in p.sources if s.multiline}
    if not starts:
        return lines
    names = ["content", "file_path", "offset", "pack", "source"]

    def join(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        file, pack, source = key
        held = state.getOption
        began, piece, first, last, parts = (*held[:4], [held[4]]) if held is not None else (-1, 0, -1, -1, [])
        whole = []
        if not state.hasTimedOut:
            start = starts[pack, source]
            rows = pd.concat(list(batches)).sort_values("offset", kind="stable")
            for content, at in zip(rows["content"], rows["offset"].astype("int64").tolist()):
                new, anew = start.search(content) is not None, at <= last
                began = at if new else -1 if anew or not parts else began
                mine = (at - max(began, 0)) // longest
                if parts and (new or anew or mine != piece):
                    whole.append(("\n".join(parts), file, first, pack, source))
                    parts = []
                if not parts:
                    first, piece = at, mine
                parts.append(content)
                last = at
        elif parts:
            whole.append(("\n".join(parts), file, first, pack, source))
            parts = []
        if parts:
            state.update((began, piece, first, last, "\n".join(parts)))
            state.setTimeoutDuration(idle_ms)
        else:
            state.remove()
        yield pd.DataFrame(whole, columns=names)

    several = F.coalesce(functools.reduce(lambda a, b: a | b, [(F.col("pack") == p) & (F.col("source") == s) for p, s in starts]), F.lit(False))
    kinds = "content string, file_path string, offset long, pack string, source string"
    joined = lines.where(several).select(*names).groupBy("file_path", "pack", "source").applyInPandasWithState(join, kinds, _OPEN, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return lines.where(~several).select(*names).unionByName(joined)


def joined(lines: DataFrame, packs: dict[str, Pack]) -> DataFrame:
    """lines: content, file_path, offset, pack, source. Those of sources with multi-line entries are joined, each by its own start."""
    several = [(p.name, s.name, s.multiline_start) for p in packs.values() for s in p.sources if s.multiline]
    here = lambda pack, source: F.coalesce((F.col("pack") == pack) & (F.col("source") == source), F.lit(False))
    out = lines.where(~functools.reduce(lambda a, b: a | b, [here(p, s) for p, s, _ in several], F.lit(False)))
    for pack, source, start in several:
        whole = joined_lines(lines.where(here(pack, source)), start, number="offset", block=1 << 24)
        out = out.unionByName(whole.select(*lines.columns))
    return out
