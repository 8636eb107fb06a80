"""Conversations whose turns are missing, doubled, cut off or of the wrong role, repaired at least cost.

A turn is one letter: the initial of its role (s, u, a; x for any other), in upper case if its text is cut off, or -
where the turn can't stay (blank, or said before). The letters of a conversation in order are its signature. What is
least to be done about a signature depends on nothing else, so each distinct one is solved once, by a recursion over
its suffixes that remembers each of them, and the edits are joined back to the turns they belong to.

Turns may be kept (0), given another role (REROLE), deleted (DELETE), and empty ones put in anywhere (INSERT); what is
cut off and stays costs CUT_OFF more. The result's roles are those of a system turn, if any, then user and assistant
in turn, or there are no turns at all. Of the cheapest audits, a letter an edit (D, I, K, R), the least in ASCII counts.

A conversation is read in chapters of CHAPTER turns at most. Where there are several, each chapter tells what it
costs to go from any state to any other; these small tables are chained backwards, to know what lies ahead, and
forwards, to know where each chapter begins. So no task sees more of a conversation than a chapter's letters, and a
row for each of its chapters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import BLANK, cut

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Turns in a chapter, and letters that one descent of the recursion goes.
CHAPTER, STRIDE = 1024, 256
#: States: nothing yet, after the system turn, after a user's, after an assistant's. Which role may come next, and what state follows.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE, NEXT_STATE = ("u", "u", "a", "u"), (USER, USER, ASSISTANT, USER)
FAR = 1 << 50
#: What lies ahead of the last turn: a conversation ends before its first turn or after an assistant's.
END = (0, 2 * INSERT, INSERT, 0)


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs ahead of each state where turns may be put in first; a third one in a row would lead back."""
    once = [min(c, INSERT + costs[NEXT_STATE[q]]) for q, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[NEXT_STATE[q]]) for q, c in enumerate(once))


def _moves(letter: str, state: int) -> dict[str, tuple[int, int]]:
    """What may be done about a turn: edit, its cost and the state after it."""
    out = {"D": (DELETE, state)}
    if letter != "-":
        cut_off = CUT_OFF if letter.isupper() else 0
        if letter.lower() == NEXT_ROLE[state]:
            out["K"] = (cut_off, NEXT_STATE[state])
        elif letter.lower() == "s" and state == START:
            out["K"] = (cut_off, SYSTEM)
        out["R"] = (REROLE + cut_off, NEXT_STATE[state])
    return out


@functools.lru_cache(maxsize=1 << 14)
def _ahead(rest: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost ahead of each state, with the letters of rest to come and costs after them."""
    if not rest:
        return after
    then = _ahead(rest[1:], after)
    return _with_inserts([min(cost + then[q] for cost, q in _moves(rest[0], state).values()) for state in range(4)])


def ahead(rest: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """_ahead() for any length: suffixes first, so no descent is deeper than STRIDE."""
    for k in range(len(rest) - STRIDE, 0, -STRIDE):
        _ahead(rest[k:], after)
    return tuple(min(c, FAR) for c in _ahead(rest, after))


def solve(letters: str, state: int = START, after: tuple[int, ...] = END, last: bool = True) -> tuple[int, str, list[str], int]:
    """Cost, audit, what becomes of each turn, and the state at the end.

    A turn becomes a text of one letter for each turn that stands there then: u or a for an empty one that was put
    in, . for itself, U or A for itself in another role.
    """
    ahead(letters, after)
    cost, audit, plan, put_in = 0, [], [], ""
    for i, letter in enumerate(letters):
        here, then = _ahead(letters[i:], after), _ahead(letters[i + 1 :], after)
        while True:
            can = {e: (c, c + then[q], q) for e, (c, q) in _moves(letter, state).items()} | {"I": (INSERT, INSERT + here[NEXT_STATE[state]], NEXT_STATE[state])}
            edit = min(e for e, (_, total, _) in can.items() if total == here[state])
            audit.append(edit)
            if edit == "I":
                put_in += NEXT_ROLE[state]
            elif edit != "D":
                put_in += "." if edit == "K" else NEXT_ROLE[state].upper()
            cost, state = cost + can[edit][0], can[edit][2]
            if edit != "I":
                break
        plan.append(put_in)
        put_in = ""
    while last and state in (SYSTEM, USER):
        put_in, cost, state = put_in + NEXT_ROLE[state], cost + INSERT, NEXT_STATE[state]
        audit.append("I")
    if put_in:
        plan[-1] += put_in
    return cost, "".join(audit), plan, state


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text; nulls of role and text are one blank) with faults by crc32 of ``conv_id:turn``.

    Of 20 rests, 0 drops a turn, 1 empties its text, 2 takes its full stops, 3 repeats it and 4 makes it a user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("__kind")).where("__kind != 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__kind") == 3, 2).otherwise(1))).alias("__n")
    return rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("__n")


def placed(turns: DataFrame) -> DataFrame:
    """Turns in order, written to the shared folder: conv (a struct, so that null is a conversation too), turn, role, text, at, cut_off, blank and first.

    at is a number that grows with conversation, turn (nulls first), role and text over the whole table: rows are
    sorted by range, so one conversation, or one turn number, may be many tasks' rows. Only rows that agree in all of
    these and in the text's first 32 characters are of one range for certain. first tells the first of equal role and text.
    """
    rows = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    last = F.regexp_extract("text", rf"([^{BLANK}])[{BLANK}]*\z", 1)
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return cut(rows.select("*", F.monotonically_increasing_id().alias("at"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut_off"), said.alias("said")))


def chapters(rows: DataFrame) -> DataFrame:
    """rows: placed(). For each chapter: conv, chapter, start (the first at), letters, initials (array), blank, duplicate, truncated (counts)."""
    firsts = rows.groupBy("conv", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut_off"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault") == 3, F.upper(known)).when(F.col("fault") > 0, "-").otherwise(known)
    marked = rows.select("conv", "role", "at", "blank", "cut_off").join(firsts, "at", "left").withColumn("fault", fault)
    in_order = F.array_sort(F.collect_list(F.struct("at", letter.alias("letter"), initial.alias("initial"))))
    return (
        marked.groupBy("conv", F.floor(F.col("at") / CHAPTER).alias("chapter"))
        .agg(F.min("at").alias("start"), in_order.alias("t"), *[F.count_if(F.col("fault") == k).alias(n) for k, n in enumerate(("blank", "duplicate", "truncated"), 1)])
        .select("conv", "chapter", "start", F.array_join("t.letter", "").alias("letters"), F.col("t.initial").alias("initials"), "blank", "duplicate", "truncated")
    )


_ENDS = "array<long>"


def _solved(signatures: DataFrame) -> DataFrame:
    """signatures: letters, state, after, last. Adds cost, audit and plan."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [solve(r.letters, int(r.state), tuple(int(x) for x in r.after), bool(r.last)) for r in b.itertuples()]
            yield b.assign(cost=[f[0] for f in found], audit=[f[1] for f in found], plan=[f[2] for f in found])

    return signatures.mapInPandas(work, f"letters string, state int, after {_ENDS}, last boolean, cost long, audit string, plan array<string>")


def _tables(signatures: DataFrame) -> DataFrame:
    """signatures: letters. Adds costs: from each state (of the first four, ...) to each state."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            to = lambda s: [ahead(s, tuple(0 if q == end else FAR for q in range(4))) for end in range(4)]
            yield b.assign(costs=[[int(columns[end][q]) for q in range(4) for end in range(4)] for columns in map(to, b.letters)])

    return signatures.mapInPandas(work, f"letters string, costs {_ENDS}")


def _backwards(costs: pd.Series) -> pd.Series:
    """For the chapters of a conversation: what lies ahead of each state after each of them, less the least of it."""

    def one(tables):
        after, out = list(END), []
        for table in reversed(list(tables)):
            least = min(after)
            out.append([min(a - least, FAR) for a in after])
            after = [min(int(table[4 * q + end]) + after[end] for end in range(4)) for q in range(4)]
        return out[::-1]

    return costs.map(one)


def _exits(signatures: DataFrame) -> DataFrame:
    """signatures: letters, after. Adds exits: the state at the end for each one at the start."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(exits=[[solve(r.letters, q, tuple(int(x) for x in r.after), False)[3] for q in range(4)] for r in b.itertuples()])

    return signatures.mapInPandas(work, f"letters string, after {_ENDS}, exits array<int>")


def _forwards(exits: pd.Series) -> pd.Series:
    """The state in which each chapter of a conversation begins."""

    def one(tables):
        state, out = START, []
        for table in tables:
            out.append(int(state))
            state = table[state]
        return out

    return exits.map(one)


def _chained(parts: DataFrame, column: str, fold, kind: str, name: str) -> DataFrame:
    """conv, chapter and what fold makes of a column over each conversation's chapters in order."""
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chapter", column))).alias("t"))
    made = whole.select("conv", F.col("t.chapter").alias("c"), F.pandas_udf(fold, f"array<{kind}>")(f"t.{column}").alias("m"))
    return made.select("conv", F.explode(F.arrays_zip("c", "m")).alias("x")).select("conv", F.col("x.c").alias("chapter"), F.col("x.m").alias(name))


def audited(parts: DataFrame) -> DataFrame:
    """parts: chapters(). Adds cost, audit and plan (an array of one text for each turn, see solve())."""
    ends = parts.groupBy("conv").agg(F.count("*").alias("n"), F.max("chapter").alias("final"))
    parts = cut(parts.join(ends, "conv").select("*", (F.col("chapter") == F.col("final")).alias("last")))
    alone = parts.where("n = 1").withColumns({"state": F.lit(START), "after": F.array(*map(F.lit, END)).cast(_ENDS)})
    long = parts.where("n > 1")
    long = long.join(_tables(long.select("letters").distinct()), "letters")
    long = parts.where("n > 1").join(_chained(long, "costs", _backwards, _ENDS, "after"), ["conv", "chapter"])
    going = long.join(_exits(long.select("letters", "after").distinct()), ["letters", "after"])
    long = cut(long.join(_chained(going, "exits", _forwards, "int", "state"), ["conv", "chapter"]))
    both = alone.unionByName(long.select(*alone.columns))
    keys = ["letters", "state", "after", "last"]
    return both.join(_solved(both.select(*keys).distinct()), keys).drop("n", "final", "after", "state")


def _lines(does: Column) -> Column:
    """What stands in the place of a turn: an array of edit, role and text."""

    def line(letter: Column) -> Column:
        own = letter.isin(".", "U", "A")
        role = F.when(letter == ".", F.col("role")).otherwise(F.when(F.lower(letter) == "u", "user").otherwise("assistant"))
        edit = F.when(letter == ".", "keep").when(own, "rerole").otherwise("insert")
        return F.struct(edit.alias("edit"), role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))

    return F.transform(F.filter(F.split(does, ""), lambda x: x != ""), line)


def _edited(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows with lines: what stands in their place."""
    does = told.select("start", F.posexplode("plan").alias("i", "does")).select((F.col("start") + F.col("i")).alias("at"), "does")
    return rows.select("conv", "turn", "role", "text", "at").join(does, "at").withColumn("lines", _lines(F.col("does")))


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (grows within a conversation), turn (null for what was put in), role, text, edit.

    turns: conv_id, turn, role, text. A null role or text is one blank, a null conv_id a conversation of its own, turns
    are ordered by turn (nulls first), role, text. A role that doesn't begin with s, u or a (an empty one neither) is
    never kept. An empty table gives no rows; other columns are left out.
    """
    rows = placed(turns)
    out = _edited(rows, audited(chapters(rows))).select("conv.conv_id", "at", "turn", F.posexplode("lines").alias("k", "line"))
    return out.select("conv_id", F.struct("at", "k").alias("place"), F.when(F.col("line.edit") != "insert", F.col("turn")).alias("turn"), "line.role", "line.text", "line.edit")


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of ids (conv_id; those of turns by default): its faults, the audit, a digest of the result.

    gaps (turn numbers that are missing), blank, duplicate, truncated (turns by their first fault), illegal (neighbours
    whose roles don't follow each other), cost, audit, repaired_sha256 (of role:text, a line each). A conversation
    without turns has zeros and empty texts. The digest is of one text, so a conversation's texts are one row here,
    put together by blocks; repaired() has no such row.
    """
    rows = placed(turns)
    told = cut(audited(chapters(rows)))
    over = Window.partitionBy("conv").orderBy("chapter")
    legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    pairs = F.zip_with(F.slice("initials", F.lit(1), F.size("initials") - 1), F.slice("initials", F.lit(2), F.size("initials")), lambda a, b: F.when(legal(a, b), 0).otherwise(1))
    before = F.lag(F.element_at("initials", -1)).over(over)
    illegal = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x) + F.when(before.isNotNull() & ~legal(before, F.col("initials")[0]), 1).otherwise(0)
    sums = told.withColumn("illegal", illegal).groupBy("conv").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.array_sort(F.collect_list(F.struct("chapter", "audit")))["audit"], "").alias("audit"),
    )
    wide = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv").agg(F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"))
    texts = _edited(rows, told).where(F.size("lines") > 0).select("conv", "at", F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("line"))
    joined = lambda df, by: df.groupBy(*by).agg(F.min("at").alias("at"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("line"))
    texts = joined(joined(texts, ["conv", F.floor(F.col("at") / 64).alias("block")]).drop("block"), ["conv"]).select("conv", "line")
    all_ids = (turns if ids is None else ids).select(F.struct("conv_id").alias("conv")).distinct()
    out = all_ids.join(gaps, "conv", "left").join(sums, "conv", "left").join(texts, "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv.conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("line", F.lit("")), 256).alias("repaired_sha256"))
