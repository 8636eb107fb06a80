"""Alerts of packs: count(condition) or avg(field), compared with a number, in windows of time."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.identifiers import field_texts
from emberlog.functions.values import FLOAT
from emberlog.operators.rules import Condition
from emberlog.sources.packs import Alert, Pack
from emberlog.sources.scratch import spread

_ALERT = re.compile(r"\s*(count|avg)\((.*)\)\s*(>=|<=|>|<|=)\s*([0-9.]+)\s+in\s+(\d+)([smhd])\s*", re.S)
_PART = re.compile(r"\s*(\w+)\s*(>=|<=|!=|=|>|<|contains)\s*('[^']*'|\S+)\s*", re.I)
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


@dataclass
class AlertRule:
    name: str
    aggregate: str
    conditions: list[Condition]
    by: list[str]
    value_of: str | None
    compare: str
    threshold: float
    window: str

    def fired(self, logs: DataFrame) -> DataFrame:
        """A row for each tumbling window (and group) in which the alert holds: alert, window_start, groups, value."""
        start = F.window("timestamp", self.window)["start"].alias("window_start")
        texts = field_texts("fields")
        text = lambda name: F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(texts, F.lit(name)), F.lit("}")), "$.v")
        groups = [text(g).alias(g) for g in self.by]
        kept = spread(logs)
        for c in self.conditions:
            kept = kept.where(_holds(c))
        number = F.when(text(self.value_of).rlike(FLOAT), text(self.value_of).try_cast("double")) if self.value_of else None
        value = F.count("*") if number is None else F.avg(number)
        out = kept.groupBy(start, *groups).agg(value.cast("double").alias("value"))
        test = {">": F.col("value") > self.threshold, ">=": F.col("value") >= self.threshold, "<": F.col("value") < self.threshold, "<=": F.col("value") <= self.threshold, "=": F.col("value") == self.threshold}[self.compare]
        return out.where(test).select(F.lit(self.name).alias("alert"), "window_start", *self.by, "value")


def _holds(c: Condition) -> Column:
    """The entry's own columns go before its fields of the same name."""
    if c.field in ("message", "level", "source", "pack", "host"):
        column = F.coalesce(c.field, F.lit(""))
        return {"contains": F.contains(column, F.lit(c.value)), "eq": F.lower(column) == c.value.lower(), "neq": F.lower(column) != c.value.lower()}[c.operator]
    return c.holds()


def parse_alert(name: str, text: str) -> AlertRule | None:
    """The alert that a condition states, or None. A condition f = same makes f a group."""
    m = _ALERT.fullmatch(text)
    if not m:
        return None
    conditions, by = [], []
    operators = {"=": "eq", "!=": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "contains": "contains"}
    for part in re.split(r"\s+AND\s+", m[2], flags=re.I) if m[1] == "count" else []:
        p = _PART.fullmatch(part)
        if not p:
            return None
        if p[2] == "=" and p[3] == "same":
            by.append(p[1])
        else:
            conditions.append(Condition(p[1], operators[p[2].lower()], p[3].strip("'")))
    return AlertRule(name, m[1], conditions, by, m[2].strip() if m[1] == "avg" else None, m[3], float(m[4]), f"{m[5]} {_UNITS[m[6]]}")


def with_cooldown(fired: DataFrame, seconds: int) -> DataFrame:
    """Firings that don't come within so many seconds of the last one kept of their alert and groups.

    A firing after a pause of that length is always kept, so what lies between pauses is decided by itself: its
    times in order, from kept one to kept one.
    """
    of = [c for c in fired.columns if c not in ("window_start", "value")]
    order, pause = Window.partitionBy(*of).orderBy("window_start"), F.make_dt_interval(secs=F.lit(seconds))
    before = F.lag("window_start").over(order)
    parts = fired.withColumn("__new", (before.isNull() | (F.col("window_start") >= before + pause)).cast("int")).withColumn("__part", F.sum("__new").over(order))
    rest = [c for c in fired.columns if c not in of]
    none = F.struct(F.lit(None).cast(fired.schema["window_start"].dataType).alias("last"), F.filter(F.col("__all"), lambda _: F.lit(False)).alias("kept"))

    def keep(acc: Column, x: Column) -> Column:
        due = acc["last"].isNull() | (x["window_start"] >= acc["last"] + pause)
        return F.when(due, F.struct(x["window_start"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    grouped = parts.groupBy(*of, "__part").agg(F.array_sort(F.collect_list(F.struct("window_start", *[c for c in rest if c != "window_start"]))).alias("__all"))
    return grouped.select(*of, F.explode(F.aggregate("__all", none, keep)["kept"]).alias("__f")).select(*of, "__f.*").select(*fired.columns)


def _rules(packs: dict[str, Pack]) -> list[tuple[Pack, Alert, AlertRule]]:
    stated = [(p, a, parse_alert(a.name, a.condition)) for p in packs.values() for a in p.alerts]
    return [(p, a, rule) for p, a, rule in stated if rule is not None]


def cooldown_seconds(alert: Alert) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", alert.cooldown or "")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] if m else 0


FIRED = "alert string, pack string, severity string, window_start timestamp_ntz, groups string, value double"


def fired_windows(logs: DataFrame, packs: dict[str, Pack]) -> DataFrame:
    """All windows in which the packs' alerts hold, whatever their cooldowns: columns as of_packs() gives them. For streams with a watermark too.

    The table is read once for each length of window: an entry becomes a row for each alert that it counts for.
    """
    by_length: dict[str, list] = {}
    for found in _rules(packs):
        by_length.setdefault(found[2].window, []).append(found)
    out = []
    logs = spread(logs)
    for length, rules in by_length.items():
        texts = field_texts("fields")
        text = lambda name: F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(texts, F.lit(name)), F.lit("}")), "$.v")  # noqa: B023, E731
        hits = []
        for i, (pack, _, rule) in enumerate(rules):
            here = functools.reduce(lambda a, b: a & b, [_holds(c) for c in rule.conditions], F.col("pack") == pack.name)
            groups = F.to_json(F.struct(*[text(g).alias(g) for g in rule.by])) if rule.by else F.lit("{}")
            number = F.when(text(rule.value_of).rlike(FLOAT), text(rule.value_of).try_cast("double")) if rule.value_of else F.lit(None).cast("double")
            hits.append(F.when(here, F.struct(F.lit(i).alias("rule"), groups.alias("groups"), number.alias("number"))))
        rows = logs.select("timestamp", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("timestamp", "h.*")
        sums = rows.groupBy(F.window("timestamp", length), "rule", "groups").agg(F.count("*").cast("double").alias("n"), F.avg("number").alias("mean"))
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)
        value = F.when(pick([rule.aggregate == "avg" for *_, rule in rules]), F.col("mean")).otherwise(F.col("n"))
        tests = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, "=": lambda v, t: v == t}
        holds = functools.reduce(lambda a, b: a | b, [(F.col("rule") == i) & tests[rule.compare](F.col("value"), rule.threshold) for i, (*_, rule) in enumerate(rules)])
        named = [pick([a.name for _, a, _ in rules]).alias("alert"), pick([p.name for p, *_ in rules]).alias("pack"), pick([a.severity for _, a, _ in rules]).alias("severity")]
        out.append(sums.withColumn("value", value).where(holds).select(*named, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "groups", "value"))
    return functools.reduce(DataFrame.unionByName, out) if out else logs.sparkSession.createDataFrame([], FIRED)


def cooled(fired: DataFrame, packs: dict[str, Pack], kept: DataFrame | None = None) -> DataFrame:
    """Of fired windows (of_packs()'s columns) those that their alerts' cooldowns let through, after those kept before (all of them earlier)."""
    out = []
    for seconds in sorted({cooldown_seconds(a) for _, a, _ in _rules(packs)}):
        names = [F.struct(F.lit(p.name), F.lit(a.name)) for p, a, _ in _rules(packs) if cooldown_seconds(a) == seconds]
        mine = lambda df: df.where(F.struct("pack", "alert").isin(names))  # noqa: B023, E731
        new = mine(fired)
        if not seconds:
            out.append(new)
            continue
        # the last one kept of each alert and groups goes before the new ones, is kept first, and leaves again
        new = new.withColumn("__before", F.lit(False))
        if kept is not None:
            last = mine(kept).groupBy("alert", "pack", "severity", "groups").agg(F.max("window_start").alias("window_start"), F.max_by("value", "window_start").alias("value"))
            new = new.unionByName(last.withColumn("__before", F.lit(True)))
        left = with_cooldown(new.withColumn("value", F.struct("value", "__before")).drop("__before"), seconds)
        out.append(left.where("NOT value.__before").withColumn("value", F.col("value.value")))
    return functools.reduce(DataFrame.unionByName, out) if out else fired


def of_packs(logs: DataFrame, packs: dict[str, Pack]) -> DataFrame:
    """All firings of the packs' alerts in a table: alert, pack, severity, window_start, groups (JSON), value; cooldowns kept.

    An alert looks at its own pack's entries. Conditions that state no alert are left out.
    """
    return cooled(fired_windows(logs, packs), packs)
