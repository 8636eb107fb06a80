import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.llm import infill, queries

DOCS = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=700))
def test_lists_of_numbers_come_back(steps):
    ends = np.cumsum(np.array(steps, dtype=np.int64))
    kept = infill.elias_fano(ends)
    got = [infill.select(i, kept["low_bits"], kept["low"], kept["high"], kept["ranks"]) for i in range(kept["n"] + 1)]
    assert got == [0, *ends.tolist()]
    if steps:
        assert len(kept["low"]) + len(kept["high"]) <= len(steps) * (3 + np.log2(ends[-1] / len(steps) + 1)) / 8 + 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n\r é\U0001f600", max_size=60))
def test_line_ends_are_those_of_the_pattern(text):
    ends = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
    assert infill.line_ends(text).tolist() == ends


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(h[k] % (len(units) + 1) for k in (0, 1))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def rows_of_many_kinds():
    rng = random.Random(2)
    texts = ["", None, "\n", "a", "a\n", "\n\n\nb", "x<P>y", "<S", "P>\n<M", "é\U0001f600\nß\r\n", "<M>", "line\n" * 30_000, "no end " * 20_000]
    texts += ["".join(rng.choices(["word ", "\n", "<", ">", "<S", "M>", "ü"], k=rng.randint(1, 80))) for _ in range(120)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "of no id\nat all"), (None, None), (3, "a"), (3, "other\ntext\n")] + [(1000 + i, "a copy\nof many\nlines") for i in range(60)]


def test_all_texts_against_a_plain_version(spark, monkeypatch):
    """Copies are dealt into parts, columns clash, rows repeat; every output gives its text again."""
    monkeypatch.setattr(infill, "COPIES", 7)
    rows = rows_of_many_kinds()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("digest", "part", "n", "output")})
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    for rate, spm in ((100, 50), (40, 100), (0, 0)):
        made = infill.transformed(docs, rate=rate, spm=spm).withColumn("back", infill.restored("output", "form")).collect()
        got = sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made], key=key)
        assert got == sorted([(i, t or "", *plain(i, t, rate, spm)) for i, t in rows], key=key)
        assert all(r.back == r.text for r in made)
    assert infill.transformed(docs.where("false")).collect() == []


def test_each_text_is_indexed_once(spark):
    docs = spark.createDataFrame(rows_of_many_kinds(), DOCS)
    keyed = infill._keyed(docs)
    texts = infill.distinct_texts(keyed, infill._parts(keyed))
    kept = infill.index(texts).join(texts, "digest")
    assert kept.count() == keyed.select("text").distinct().count() == kept.select("text").distinct().count()


def test_the_query_on_a_whole_table(spark, sf):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (*(p := plain(d.doc_id, d.text))[:4], sha(p[4]), sha(d.text)) for d in docs}
    assert {r[0]: tuple(r)[1:] for r in queries.op13_fill_in_middle(spark, sf).collect()} == want
