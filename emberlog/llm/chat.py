"""Chat formatting into budgeted windows, with DataFrame operations only.

A turn is written as ``<|start|>role`` newline ``text<|end|>`` newline. Prefix sums of turn tokens choose the
windows: a window takes turns as long as they fit into the budget, beside the conversation's system turn and the
last turns before it, as far as the history budget goes. So windows are cut between turns and none holds more
than the budget, unless a single turn does, which then stands alone but for the system turn. A system turn of
more than half the budget is a turn like others and isn't repeated. Only the new assistant turns of a window are
targets of the loss.

Prefix sums are taken in blocks of turns, and windows in chapters of bounded length, so a conversation of any
length is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import n_words

START, END = "<|start|>", "<|end|>"
#: Control strings of this and other public templates; a backslash after their first character disarms them in texts.
CONTROL_TAILS = r"(\||INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)"


def escape(text: str | Column) -> Column:
    """Double backslashes, then put one after the first character of each control string."""
    doubled = F.replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[]){CONTROL_TAILS}", r"$1\\$2")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    armed = F.regexp_replace(text, rf"([<\[])\\{CONTROL_TAILS}", "$1$2")
    return F.replace(armed, F.lit("\\\\"), F.lit("\\"))


def escape_line(text: str | Column) -> Column:
    """escape() for what must stay on one line: a line end is a single backslash and n."""
    return F.replace(escape(text), F.lit("\n"), F.lit("\\n"))


def unescape_line(text: Column) -> Column:
    """The inverse of escape_line(): other backslashes are doubled, so an odd one before n is a line end."""
    return unescape(F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


#: Numbers of turns in a block of prefix sums, windows in a chapter.
BLOCK, CHAPTER = 4096, 64


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv (a struct, so that null is a conversation too), role, text, k (tokens), i (from 1) and p (tokens before) of each turn."""
    turns = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"k": (n_words("text") + 1).cast("int"), "block": F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))})
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv", "block").agg(F.sum("k").alias("k"), F.count("*").alias("n"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("i0"))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        turns.withColumns({"i": F.row_number().over(order), "p": F.coalesce(F.sum("k").over(within), F.lit(0))})
        .join(blocks, ["conv", "block"])
        .select("conv", "role", "text", "k", (F.col("i") + F.col("i0")).alias("i"), (F.col("p") + F.col("p0")).alias("p"))
    )


def format_windows(turns: DataFrame, *, window_tokens: int = 512, history_tokens: int = 128) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns a row for each window.

    conv_id, window (the number of its first new turn, from 1), formatted, n_repeated (turns at its head that
    earlier windows hold as new), n_new, n_tokens (words of its turns, and one for each), loss (array of start and
    length, in code points of formatted, of the escaped target texts).

    Null roles and texts count as empty. Rows of one conversation and equal turn number keep the order of
    role, then text; a null conv_id is a conversation of its own; an empty table gives no windows. Other
    columns are left out.
    """
    budget, chapter = window_tokens, F.floor(F.col("p") / (CHAPTER * window_tokens))
    is_system = (F.col("i") == 1) & (F.col("role") == "system") & (F.col("k") * 2 <= budget)
    head, body = F.concat(F.lit(START), escape_line("role"), F.lit("\n")), escape("text")
    out = F.concat(head, body, F.lit(f"{END}\n"))
    turn = placed_turns(turns).select("conv", "i", "p", "k", "role", F.length(head).alias("head"), F.length(body).alias("body"), out.alias("out"), is_system.alias("is_system"), chapter.alias("chapter"))
    # a turn that windows of the next chapter may repeat is there too, as history only
    late = (F.col("k") <= history_tokens) & (F.floor((F.col("p") + history_tokens) / (CHAPTER * budget)) > F.col("chapter"))
    places = F.array_compact(F.array(F.struct("chapter", F.lit(True).alias("fresh")), F.when(late, F.struct((F.col("chapter") + 1).alias("chapter"), F.lit(False).alias("fresh")))))
    near = Window.partitionBy("conv", "chapter").orderBy("p").rangeBetween(-history_tokens, 0)
    rows = turn.withColumn("to", F.explode(places)).drop("chapter").select("*", "to.chapter", "to.fresh").drop("to")
    # of those, the ones that reach the chapter's first new turn within the history: they lie before it without a gap
    rows = rows.withColumn("begins", F.min(F.when(F.col("fresh"), F.col("p"))).over(Window.partitionBy("conv", "chapter"))).where(F.col("fresh") | (F.col("begins") - F.col("p") <= history_tokens))
    rows = rows.withColumns({"first": F.min(F.when(~F.col("is_system"), F.col("i"))).over(near), "from": F.min(F.when(~F.col("is_system"), F.col("p"))).over(near)})
    member = F.struct("i", "fresh", "k", F.coalesce(F.col("p") - F.col("from"), F.lit(0)).cast("int").alias("past"), F.coalesce("first", "i").alias("first"), "role", "head", "body", "out")
    chapters = rows.groupBy("conv", "chapter").agg(F.array_sort(F.collect_list(member)).alias("t"), F.bool_or("fresh").alias("fresh")).where("fresh")
    system = turn.where("is_system").select("conv", F.struct("i", F.lit(True).alias("fresh"), "k", F.lit(0).alias("past"), F.col("i").alias("first"), "role", "head", "body", "out").alias("sys"))
    chapters = chapters.join(system, "conv", "left")

    def take(acc: Column, x: Column) -> Column:
        kept = F.when(x["i"] == 1, 0).otherwise(F.coalesce(F.col("sys.k"), F.lit(0)))
        new = (acc["used"] == 0) | (acc["used"] + x["k"] > budget)
        past = F.when(kept + x["past"] + x["k"] <= budget, x["past"]).otherwise(0)
        start = F.struct(x["i"].alias("i"), F.when(past > 0, x["first"]).otherwise(x["i"]).alias("first"))
        used = F.when(new, kept + past).otherwise(acc["used"]) + x["k"]
        after = F.struct(used.alias("used"), F.when(new, F.concat(acc["starts"], F.array(start))).otherwise(acc["starts"]).alias("starts"))
        return F.when(x["fresh"], after).otherwise(acc)

    zero = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<i:bigint,first:bigint>>)").alias("starts"))
    at = lambda i: (i - F.col("t")[0]["i"] + 1).cast("int")

    def window(x: Column, n: Column) -> Column:
        stop = F.coalesce(F.try_element_at("starts", (n + 2).cast("int"))["i"], F.element_at("t", -1)["i"] + 1)
        kept = F.when((x["i"] > 1) & F.col("sys").isNotNull(), F.array("sys")).otherwise(F.slice(F.array("sys"), 1, 0))
        parts = F.concat(kept, F.slice("t", at(x["first"]), (stop - x["first"]).cast("int")))
        return F.struct(x["i"].alias("window"), (F.size(kept) + x["i"] - x["first"]).cast("int").alias("n_repeated"), (stop - x["i"]).cast("int").alias("n_new"), parts.alias("parts"))

    windows = (
        chapters.withColumn("starts", F.aggregate("t", zero, take)["starts"])
        .select("conv", F.explode(F.transform("starts", window)).alias("w"))
        .select("conv.conv_id", "w.*")
    )
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        target = (x["role"] == "assistant") & (acc["n"] >= F.col("n_repeated"))
        span = F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length")))
        return F.struct((acc["at"] + F.length(x["out"])).alias("at"), (acc["n"] + 1).alias("n"), F.when(target, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda x: x["out"]), "").alias("formatted"),
        "n_repeated",
        "n_new",
        F.aggregate("parts", F.lit(0), lambda n, x: n + x["k"]).alias("n_tokens"),
        F.aggregate("parts", none, add)["spans"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The inverse of format_windows(): conv_id, turns (array of role and text), targets (array of text), formatted_chars.

    Reads the formatted text alone: turns are what stands between the markers, without a window's repeated
    ones, and targets are the spans of the loss mask, unescaped.
    """
    chunks = F.split("formatted", "<\\|end\\|>\n")
    turns = F.transform(
        F.slice(chunks, F.lit(1), F.size(chunks) - 1),
        lambda c: F.struct(
            unescape_line(F.substring(F.substring_index(c, "\n", 1), F.lit(len(START) + 1), F.length(c))).alias("role"),
            unescape(F.substring(c, F.instr(c, F.lit("\n")) + 1, F.length(c))).alias("text"),
        ),
    )
    return (
        windows.select(
            "conv_id",
            "window",
            F.slice(turns, F.col("n_repeated") + 1, F.col("n_new")).alias("turns"),
            F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))).alias("targets"),
            F.length("formatted").alias("chars"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
        .select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.targets")).alias("targets"), "formatted_chars")
    )


def chat_report(turns: DataFrame) -> DataFrame:
    """What is read back from the windows of every conversation, as digests."""
    back = read_windows(format_windows(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
