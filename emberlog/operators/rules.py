"""Correlation rules: WHEN pack.field op value WITHIN Ns CORRELATE pack."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.identifiers import field_text, field_texts
from emberlog.functions.values import FLOAT
from emberlog.sources.packs import Pack, PackError
from emberlog.sources.scratch import spread

#: Operators and the words that mean each.
OPERATORS = {"=": "eq", "==": "eq", "EQ": "eq", "!=": "neq", "NEQ": "neq", ">": "gt", "GT": "gt", ">=": "gte", "GTE": "gte", "<": "lt", "LT": "lt", "<=": "lte", "LTE": "lte", "CONTAINS": "contains"}
#: Parts into which a target's stretch of time is dealt where no fields are matched.
PARTS = 8
_RULE = re.compile(r"\s*WHEN\s+([^\s.]*)\.(\S*)\s+(\S+)\s+(\S+)\s+WITHIN\s+\+?(\d+)s*\s+CORRELATE\s+(\S+)(?:\s.*)?", re.I | re.S)


@dataclass
class Condition:
    field: str
    operator: str
    value: str

    def holds(self, fields: str | Column = "fields") -> Column:
        """Whether a JSON object's field compares so. A field that is missing, null or nested never does.

        Order is that of numbers if both are numbers, else of text; all else compares texts.
        """
        value = F.lit(self.value)
        plain = lambda shown: F.when(shown.rlike(r"^[\[{]|^null$"), F.lit(None)).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), shown, F.lit("}")), "$.v"))

        def holds(x: Column) -> Column:
            if self.operator in ("eq", "neq", "contains"):
                return {"eq": x == value, "neq": x != value, "contains": F.contains(x, value)}[self.operator]
            compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[self.operator]
            if not re.fullmatch(FLOAT[1:-1], self.value):
                return compare(x, value)
            return F.when(x.rlike(FLOAT), compare(x.try_cast("double"), F.lit(float(self.value)))).otherwise(compare(x, value))

        # the field is looked up once, and its text made once, however often these are used
        once = lambda x, then: F.transform(F.array(x), then)[0]
        return F.coalesce(once(field_text(fields, self.field), lambda shown: once(plain(shown), holds)), F.lit(False))


@dataclass
class Rule:
    name: str
    source_pack: str
    condition: Condition | None
    target_pack: str
    window_seconds: int
    target_condition: Condition | None = None
    match_fields: list[tuple[str, str]] = field(default_factory=list)

    def pairs(self, logs: DataFrame) -> DataFrame:
        """(rule, source_id, target_id): entries of both packs whose conditions hold, no further apart than the window.

        Both sides are spread by stretch of time as long as the window, and by the matched fields if there are any;
        without them, the target's entries of a stretch are dealt into PARTS, and the source's sent to all of these.
        """
        wide = max(1, self.window_seconds)
        at = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp")) / wide)
        texts = field_texts("fields")
        logs = spread(logs)
        s = logs.where(F.col("pack") == self.source_pack)
        if self.condition is not None:
            s = s.where(self.condition.holds())
        t = logs.where(F.col("pack") == self.target_pack)
        if self.target_condition is not None:
            t = t.where(self.target_condition.holds())
        parts = 1 if self.match_fields else PARTS
        s = s.select(F.col("id").alias("source_id"), F.col("timestamp").alias("s_at"), F.explode(F.array(*[F.struct((at + d).alias("stretch"), F.lit(p).alias("part")) for d in (-1, 0, 1) for p in range(parts)])).alias("to"), *[F.try_element_at(texts, F.lit(a)).alias(f"s{i}") for i, (a, _) in enumerate(self.match_fields)])
        t = t.select(F.col("id").alias("target_id"), F.col("timestamp").alias("t_at"), at.alias("t_stretch"), F.pmod(F.hash("id"), F.lit(parts)).alias("t_part"), *[F.try_element_at(texts, F.lit(b)).alias(f"t{i}") for i, (_, b) in enumerate(self.match_fields)])
        apart = F.make_dt_interval(secs=F.lit(self.window_seconds))
        on = (F.col("to.stretch") == F.col("t_stretch")) & (F.col("to.part") == F.col("t_part")) & F.col("t_at").between(F.col("s_at") - apart, F.col("s_at") + apart) & (F.col("source_id") != F.col("target_id"))
        for i in range(len(self.match_fields)):
            on = on & (F.col(f"s{i}") == F.col(f"t{i}"))
        return s.join(t, on).select(F.lit(self.name).alias("rule"), "source_id", "target_id")


def parse_rule(name: str, text: str) -> Rule | None:
    """The rule that a text states, or None. What follows the target pack is left out."""
    m = _RULE.fullmatch(text)
    operator = m and OPERATORS.get(m[3].upper())
    if not operator or int(m[5]) >= 1 << 32:
        return None
    return Rule(name, m[1], Condition(m[2], operator, m[4]), m[6], int(m[5]))


_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}


def of_pack(pack: Pack) -> list[Rule]:
    """The correlations of a pack's manifest as rules, for all its entries.

    A match field is a name of both sides, or a:b for a here and b there; timestamp stands for the window alone,
    which is a whole number of seconds, one at least.
    """
    out = []
    for c in pack.correlations:
        m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h)\s*", c.window)
        if not m:
            raise PackError(f"pack '{pack.name}': window '{c.window}'")
        pairs = [(a, b or a) for a, _, b in (f.partition(":") for f in c.match_fields) if a != "timestamp"]
        out.append(Rule(f"{pack.name}_{c.target_pack}", pack.name, None, c.target_pack, max(1, round(int(m[1]) * _SECONDS[m[2]])), match_fields=pairs))
    return out
