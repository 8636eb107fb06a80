"""Fill-in-middle: texts cut at two line ends into prefix, middle and suffix, written in an order for training.

Equal texts are one row of an index: rows are dealt out by digest, and those of a digest are grouped by their content.
Each text's line ends, in code points, are worked out once and kept as an Elias-Fano list: the low bits of each number
packed, the high bits as gaps in unary, about two bits and the logarithm of the mean line for each line. The index
is joined back to the documents, each of which selects its two cuts from the list by its own seed.

The texts move once, for the index and for the output; documents are a few numbers until then. A text with more than COPIES rows is dealt into parts,
each with a copy of its index row, so no task has all rows of one text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import small_batches

MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of one text in a part, at least; and how many texts, at most, may be dealt into parts (their list is broadcast).
COPIES, MOST_HOT = 1000, 10_000
SAMPLE = 64


def elias_fano(ends: np.ndarray) -> dict:
    """A list of ascending numbers: n, low_bits, low, high, and ranks (ones before each SAMPLE-th byte of high)."""
    n = len(ends)
    if not n:
        return {"n": 0, "low_bits": 0, "low": b"", "high": b"", "ranks": []}
    low_bits = max(0, int(ends[-1] // n).bit_length() - 1)
    bits = ((ends[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
    high = np.zeros(int(ends[-1] >> low_bits) + n, dtype=np.uint8)
    high[(ends >> low_bits) + np.arange(n)] = 1
    packed = np.packbits(high)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))])
    return {"n": n, "low_bits": low_bits, "low": np.packbits(bits.ravel()).tobytes(), "high": packed.tobytes(), "ranks": ones[:-1:SAMPLE].astype(np.int64).tolist()}


def select(i: int, low_bits: int, low: bytes, high: bytes, ranks) -> int:
    """The i-th number (from 1) of a list; 0 for i = 0. Reads SAMPLE bytes of high, and the bits of one low part."""
    if i == 0:
        return 0
    block = int(np.searchsorted(np.asarray(ranks), i, "left")) - 1
    ones = np.unpackbits(np.frombuffer(high, np.uint8, offset=block * SAMPLE, count=min(SAMPLE, len(high) - block * SAMPLE)))
    at = block * SAMPLE * 8 + int(np.flatnonzero(ones)[i - 1 - ranks[block]])
    first = (i - 1) * low_bits
    got = np.unpackbits(np.frombuffer(low, np.uint8)[first // 8 : (first + low_bits + 7) // 8])[first % 8 : first % 8 + low_bits]
    return ((at - (i - 1)) << low_bits) + int((got.astype(np.int64) << np.arange(low_bits)).sum())


def line_ends(text: str) -> np.ndarray:
    """Where lines end, in code points; a last line without an end ends with the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    return np.append(ends, len(points)) if len(points) and (not len(ends) or ends[-1] != len(points)) else ends


_LIST = "n long, low_bits int, low binary, high binary, ranks array<long>"


def _index(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([elias_fano(line_ends(t)) for t in texts], columns=["n", "low_bits", "low", "high", "ranks"])


def _select(i: pd.Series, low_bits: pd.Series, low: pd.Series, high: pd.Series, ranks: pd.Series) -> pd.Series:
    return pd.Series([select(int(k), int(b), lo, hi, r) for k, b, lo, hi, r in zip(i, low_bits, low, high, ranks)], dtype="int64")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"), F.xxhash64(text).alias("twin"))


def _parts(keyed: DataFrame) -> DataFrame:
    """digest and parts of the texts with many copies: at most MOST_HOT rows, whatever the table."""
    copies = keyed.groupBy("digest").count()
    total = keyed.count()
    limit = max(COPIES, -(-total // MOST_HOT))
    return copies.where(F.col("count") > limit).select("digest", F.ceil(F.col("count") / limit).cast("int").alias("parts"))


def distinct_texts(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each distinct text (and part): digest, twin, part, text. Dealt out by digest and part, grouped by content."""
    dealt = _dealt(keyed, parts).select("digest", "twin", "part", "text")
    return dealt.repartition("digest", "part").dropDuplicates(["digest", "twin", "part", "text"])


def index(texts: DataFrame) -> DataFrame:
    """texts: distinct_texts(). The list of each one's line ends: digest, twin, part, ends."""
    return small_batches(texts).select("digest", "twin", "part", F.pandas_udf(_index, _LIST)("text").alias("ends"))


def _dealt(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.coalesce("parts", F.lit(1)).cast("long"))
    return keyed.join(F.broadcast(parts), "digest", "left").withColumn("part", F.coalesce(part, F.lit(0)).cast("int"))


def _joined(docs: DataFrame, other: DataFrame) -> DataFrame:
    """By digest and part, by which texts lie already, so that they don't move again; of a digest's texts the twin tells which."""
    both = docs.join(other.withColumnRenamed("twin", "__twin"), ["digest", "part"])
    return both.where(F.col("twin").bitwiseXOR(F.col("__twin")) == 0).drop("__twin")


def transformed(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """docs: doc_id, text. Adds n (lines), form, prefix_chars, middle_chars (code points) and output; doc_id and text first, other columns left out.

    Of h1 to h4, the first four groups of eight digits of the SHA-256 of ``seed:doc_id``, h1 and h2 choose the cuts, a
    text is transformed if h3 % 100 < rate, and in the form spm if h4 % 100 < spm, else psm. Texts that are empty or
    hold a mark stay plain; then the two lengths are null. A null text is an empty one. A null doc_id counts as an empty
    one in the seed; rows of one doc_id and text are cut alike.
    """
    keyed = _keyed(docs)
    parts = _parts(keyed.select("doc_id", "digest"))
    seeds = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(seeds, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    narrow = _dealt(keyed.select("doc_id", "digest", "twin"), parts).select("doc_id", "digest", "twin", "part", *[x.alias(f"h{k + 1}") for k, x in enumerate(h)])
    texts = distinct_texts(keyed, parts)
    found = _joined(narrow, index(texts))
    units = F.col("ends.n") + 1
    a, b = F.col("h1") % units, F.col("h2") % units
    where = lambda i: F.pandas_udf(_select, "long")(i, "ends.low_bits", "ends.low", "ends.high", "ends.ranks")
    cuts = found.select("doc_id", "digest", "twin", "part", "h3", "h4", F.col("ends.n").alias("n"), where(F.least(a, b)).alias("start"), where(F.greatest(a, b)).alias("end"))
    # the same exchange of texts as the index's: Spark reuses it
    rows = _joined(cuts, texts)
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), "start", "end")
    text, start, end = F.col("text"), F.col("start").cast("int"), F.col("end").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text))
    spm_text = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm_text = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    cut_here = F.col("form") != "plain"
    return rows.select(
        "doc_id", "text", "n", "form",
        F.when(cut_here, F.col("start")).alias("prefix_chars"), F.when(cut_here, F.col("end") - F.col("start")).alias("middle_chars"),
        F.when(F.col("form") == "spm", spm_text).when(F.col("form") == "psm", psm_text).otherwise(text).alias("output"),
    )


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of a form was made of: no part holds a mark, so each mark is where its part begins."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    behind = lambda x, mark: F.substring(x, F.instr(x, F.lit(mark)) + len(mark), F.length(x))
    until = lambda x, mark: F.substring_index(x, mark, 1)
    middle = behind(output, MIDDLE)
    psm = F.concat(until(behind(output, PREFIX), SUFFIX), middle, until(behind(output, SUFFIX), MIDDLE))
    spm = F.concat(until(behind(output, PREFIX), MIDDLE), middle, until(behind(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of what transformed() makes of each document, and of what is restored from it."""
    made = transformed(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
