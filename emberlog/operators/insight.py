"""What is out of the ordinary in a table of entries: volumes beyond their past, errors of one form, and new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.levels import at_least
from emberlog.sources import scratch


def volumes(logs: DataFrame, window: str = "1 hour") -> DataFrame:
    """Entries by pack, source and tumbling window: pack, source, window_start, n."""
    return logs.groupBy("pack", "source", F.window("timestamp", window)["start"].alias("window_start")).agg(F.count("*").alias("n"))


def spikes(counted: DataFrame, *, past: int = 24, factor: float = 3.0, least: int = 3) -> DataFrame:
    """counted: as volumes() gives. Windows above factor times, or below 1 / factor of, the mean of the past ones.

    The past are the last windows with entries of the same pack and source, least of them at least. Adds usual (that
    mean) and kind (spike or drop).
    """
    before = Window.partitionBy("pack", "source").orderBy("window_start").rowsBetween(-past, -1)
    told = counted.withColumns({"usual": F.avg("n").over(before), "__seen": F.count("*").over(before)}).where(F.col("__seen") >= least)
    kind = F.when(F.col("n") > F.col("usual") * factor, "spike").when(F.col("n") * factor < F.col("usual"), "drop")
    return told.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("__seen")


def form(message: str | Column) -> Column:
    """A message without what differs from one occurrence to the next: addresses, long hexadecimal ids, numbers."""
    text = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
    text = F.regexp_replace(text, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<ip>")
    text = F.regexp_replace(text, r"[0-9a-f]{8,}", "<id>")
    return F.regexp_replace(text, r"[0-9]+", "<n>")


def error_groups(logs: DataFrame) -> DataFrame:
    """Errors of one form: pack, source, form, n, first_seen, last_seen, example (the least message)."""
    errors = logs.where(at_least("level", "error"))
    return errors.groupBy("pack", "source", form("message").alias("form")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("message").alias("example"))


# ------------------------------------------------------------------------------------------ templates of messages

#: What stands for a part of a message that differs, and what is taken for one at once: kind and pattern, in this order.
ANY = "<*>"
VARIES = [
    ("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("address", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b"),
    ("hexadecimal", r"\b(?:0x[0-9a-fA-F]+|(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,})\b"),
    ("number", r"[0-9]+(?:\.[0-9]+)?"),
]
#: Words of a message that count; positions that may be found to differ at once; how many values make a position of a short template one that differs.
MOST_WORDS, TOGETHER, SHORT, VALUES = 40, 2, 4, 3


def words_of(message: str | Column) -> Column:
    """The words of a message, of which what differs by its form is ANY; at most MOST_WORDS, the rest is one more word, ANY."""
    text = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
    for _, pattern in VARIES:
        text = F.regexp_replace(text, pattern, ANY)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > MOST_WORDS, F.concat(F.slice(words, 1, MOST_WORDS), F.array(F.lit(ANY)))).otherwise(words)


def templates(forms: DataFrame, group: list[str]) -> DataFrame:
    """forms: group columns and words (as words_of() gives), distinct. Adds template: words with ANY where messages of one kind differ.

    Templates of equal length and first word that agree but for one position, then but for TOGETHER positions, become one
    with ANY there, over and over until none does; at least half of the words stay. In templates of fewer than SHORT
    words a position needs VALUES values to differ. What a template becomes is the generalisation that most of the
    present ones share, of equal ones the least text, so the result doesn't depend on how rows lie.

    Each round is a count of keys and a join, over distinct templates only: messages are counted before.
    Joins are of sorted rows: files of repeated words are far smaller than the rows in them, so by their size Spark would broadcast too much.
    """
    now = scratch.written(forms.select(*group, "words", F.col("words").alias("template")))
    for together in range(1, TOGETHER + 1):
        before = None
        while True:
            present = now.select(*group, "template").distinct()
            n = present.count()
            if n == before:
                break
            before, old = n, now
            now = scratch.written(_generalised(now, scratch.written(present), group, together))
            scratch.drop(old)
    return now


def _generalised(now: DataFrame, present: DataFrame, group: list[str], together: int) -> DataFrame:
    places = F.sequence(F.lit(1), F.size("template") - 1)
    without = lambda gone: F.transform("template", lambda w, i: F.when(F.array_contains(gone, i), ANY).otherwise(w))
    sets = F.transform(places, lambda i: F.array(i)) if together == 1 else F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.array(i, j))))
    sets = F.when(F.size("template") > together, sets)
    keys = present.select(*group, "template", F.explode(F.array_distinct(F.transform(sets, without))).alias("key"))
    fixed = F.size(F.filter("key", lambda w: w != ANY))
    keys = keys.where(fixed * 2 >= F.size("key"))
    least = F.when(F.size("key") >= SHORT, 2).otherwise(VALUES)
    shared = keys.groupBy(*group, "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = keys.join(shared.hint("merge"), [*group, "key"]).groupBy(*group, "template").agg(F.min(F.struct((-F.col("n")).alias("n"), "key"))["key"].alias("key"))
    return now.join(best.hint("merge"), [*group, "template"], "left").select(*group, "words", F.coalesce("key", "template").alias("template"))


def clusters(logs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Entries by the template of their messages: group columns, template (text), n, first_seen, last_seen, example (the least message)."""
    group = ["pack", "source"] if group is None else group
    seen = logs.groupBy(*group, words_of("message").alias("words")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("message").alias("example"))
    seen = scratch.written(seen)
    named = seen.join(templates(seen.select(*group, "words"), group).hint("merge"), [*group, "words"])
    sums = named.groupBy(*group, "template").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("example").alias("example"))
    return sums.withColumn("template", F.array_join("template", " "))


def new_clusters(before: DataFrame, now: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Those of now's clusters of which before has no message: templates are found in both tables together."""
    group = ["pack", "source"] if group is None else group
    both = before.select(*group, "message", F.lit(None).cast("timestamp_ntz").alias("timestamp")).unionByName(now.select(*group, "message", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")))
    seen = both.groupBy(*group, words_of("message").alias("words")).agg(F.count("timestamp").alias("n"), F.count("*").alias("all"), F.min("timestamp").alias("first_seen"), F.min("message").alias("example"))
    seen = scratch.written(seen)
    named = seen.join(templates(seen.select(*group, "words"), group).hint("merge"), [*group, "words"])
    sums = named.groupBy(*group, "template").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.min("first_seen").alias("first_seen"), F.min("example").alias("example"))
    return sums.where(F.col("n") == F.col("all")).select(*group, F.array_join("template", " ").alias("template"), "n", "first_seen", "example")


# ------------------------------------------------------------------------------------------ hours out of the ordinary


def filled(counted: DataFrame, hours: int = 1) -> DataFrame:
    """counted: volumes() of so many hours. A row for each window from the table's first to its last, n = 0 where there are no entries."""
    ends = counted.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    every = counted.select("pack", "source").distinct().crossJoin(F.broadcast(ends)).select("pack", "source", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {int(hours)} HOURS"))).alias("window_start"))
    return every.join(counted, ["pack", "source", "window_start"], "left").select("pack", "source", "window_start", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def baseline(series: DataFrame, *, weekly: bool = True) -> DataFrame:
    """The quartiles of a filled() series by hour of the week (of the day, if not weekly): pack, source, slot, q1, median, q3, seen.

    The series is what is kept from run to run: a row an hour, to which new hours are added.
    """
    cuts = [F.percentile("n", F.lit(p)).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return series.groupBy("pack", "source", _slot(weekly).alias("slot")).agg(*cuts, F.count("*").alias("seen"))


def _slot(weekly: bool) -> Column:
    return F.weekday("window_start") * 24 + F.hour("window_start") if weekly else F.hour("window_start")


def anomalies(series: DataFrame, usual: DataFrame, *, weekly: bool = True, factor: float = 3.0, least_seen: int = 3) -> DataFrame:
    """The hours of a series that are out of the ordinary: pack, source, window_start, n, median, kind.

    spike and drop: beyond the quartiles by more than factor times their distance (one entry at least); silence: no entries
    where three quarters of such hours have some; unusual: entries where at least half of such hours have none, and too many for
    the quartiles. Slots that were seen fewer times than least_seen tell nothing.
    """
    told = series.withColumn("slot", _slot(weekly)).join(usual, ["pack", "source", "slot"]).where(F.col("seen") >= least_seen)
    wide = factor * F.greatest(F.col("q3") - F.col("q1"), F.lit(1.0))
    high, low = F.col("n") > F.col("q3") + wide, F.col("n") < F.col("q1") - wide
    kind = F.when((F.col("n") == 0) & (F.col("q1") >= 1), "silence").when(high & (F.col("median") == 0), "unusual").when(high, "spike").when(low, "drop")
    return told.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("pack", "source", "window_start", "n", "median", "kind")
