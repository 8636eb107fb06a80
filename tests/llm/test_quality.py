import math
import re
import zlib

from pyspark.sql import functions as F

from emberlog.llm import quality

SF = "/root/testdata/sf0.1"


def statistics(text):
    """The statistics in plain Python."""
    import regex

    t = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    n, m = max(1, len(t)), max(1, len(words))
    of = lambda p: len(regex.findall(p, t))
    return [
        math.log1p(len(t)), math.log1p(len(words)), sum(map(len, words)) / m, of(r"\p{Lu}") / n, of("[0-9]") / n, of(r"[\x20\x09-\x0D]") / n, of(r"[^\p{L}\p{N}\x20\x09-\x0D]") / n,
        of(r"""[^\p{L}\p{N}\x20\x09-\x0D.,;:'"!?()-]""") / n, of("!") / n, of(r"\|") / n, of("[.?!]") / m, of(",") / m, of(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})") / m,
        sum(len(w) <= 2 for w in words) / m, len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m, math.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
    ]


def score(model, text):
    s = dict(zip(quality.NAMES, statistics(text)))
    return 1 / (1 + math.exp(-model.intercept - sum(w for rule, w in model.rules if all(low < s[c] <= high for c, (low, high) in rule.items()))))


def data(spark):
    good = [(i, f"Plain sentences, number {i}, of many different words that end. As {'they' if i % 2 else 'we'} should.", 1) for i in range(120)]
    bad = [(200 + i, "BUY!! NOW!! " * (3 + i % 5), 0) for i in range(40)]
    return spark.createDataFrame(good + bad, "doc_id long, text string, quality int")


def test_whole_table_against_a_plain_version_and_held_out_labels(spark):
    """The query's scores are those of its rules by hand; of held-out labels nearly all are told, at the contract's bound."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.fit(docs, labels.where(~held))
    rows = quality.quality_report(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(abs(score(model, texts[r.doc_id]) - r.score) < 1e-9 and r.predicted == (r.score >= 0.3) for r in rows)
    assert 3 <= len(model.rules) <= 150
    told = {r.doc_id: r.quality for r in labels.collect()}
    of = [(told[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in told]
    assert sum(a == b for a, b in of) / len(of) >= 0.97
    junk = [p for q, p in of if q == 0]
    assert junk.count(0) / len(junk) >= 0.85


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "É!!", "a a b b b", "x" * 100_000, "| | |", "ÀB Ab AB\nAB", "\U0001f600 123 (ok)"]
    got = quality.with_statistics(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "__s.*").collect()
    for r in got:
        assert [round(x, 9) for x in r[1:]] == [round(x, 9) for x in statistics(r.text)], r.text


def test_edges(spark):
    rows = data(spark)
    docs, labels = rows.drop("quality"), rows.select("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 0), (999, 0)], "doc_id long, quality int"))
    model = quality.fit(docs, labels)
    extra = spark.createDataFrame([(500, None), (501, ""), (None, "BUY!! " * 40_000), (3, "twice")], "doc_id long, text string")
    clash = docs.unionByName(extra).withColumns({"score": F.lit("old"), "upper": F.lit(1), "distinct": F.lit(2)})
    found = quality.predict(clash, model).collect()
    assert len(found) == 164 and all(0 <= r.score <= 1 and r.upper == 1 for r in found)
    assert all(r.predicted == (r.doc_id < 200) for r in found if r.doc_id is not None and r.doc_id not in (3, 500, 501))
    assert next(r for r in found if r.doc_id is None).predicted == 0
    assert quality.predict(docs.where("false"), model).collect() == []


def test_without_both_labels_the_share_is_the_score(spark):
    rows = data(spark)
    for labels, least, most in ((rows.where("false"), 0.5, 0.5), (rows.where("quality = 1"), 0.9, 1), (rows.where("quality = 0"), 0, 0.1)):
        model = quality.fit(rows.drop("quality"), labels.select("doc_id", "quality"))
        assert all(least <= r.score <= most for r in quality.predict(rows.drop("quality"), model).collect())
