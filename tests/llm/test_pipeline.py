"""Each stage against a plain version, on the stage's own input."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from emberlog.llm import sentencepiece, simhash, substring, toxicity

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
if pipeline is None:
    pytest.skip("the pipeline isn't here", allow_module_level=True)

STAGES = dict(pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(5000, None, "en", "a", 0), (5001, "", None, None, 0), (5002, "the same row", "en", "a", 12), (5002, "the same row", "en", "a", 12), (5003, "word " * 30_000, "en", "long", 150_000)]
    return table.unionByName(spark.createDataFrame(more, table.schema)).cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_order_and_columns(docs, spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mixing", "sentencepiece"]
    for name, stage in pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), sf)
        assert empty.columns == COLUMNS and empty.collect() == [], name


def test_toxicity_stage(docs, spark, sf):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted((tuple(r) for r in docs.collect() if model.score(r.text)[0] < 0.5), key=str)
    assert rows(STAGES["toxicity"](spark, docs, sf)) == want
    assert 0 < docs.count() - len(want) < 0.3 * docs.count()


def test_near_dedup_stage(docs, spark, sf):
    all_rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    fps = [simhash.fingerprint((r[1] or "").encode()) for r in all_rows]
    kept, component = [], list(range(len(all_rows)))
    for i in range(len(all_rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and component[i] != component[j]:
                old, new = component[i], component[j]
                component = [new if c == old else c for c in component]
    for c in set(component):
        kept.append(min((all_rows[i] for i in range(len(all_rows)) if component[i] == c), key=lambda r: (r[0], str(r))))
    assert rows(STAGES["simhash_near_dedup"](spark, docs, sf)) == sorted(kept, key=str)


def test_rows_without_an_id_or_with_a_shared_one_stay(spark, sf):
    """Four unlike texts, a near copy of one and a row that repeats, under null, shared and repeated ids."""
    unlike = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(4)]
    near = unlike[0].upper()
    given = [(None, unlike[0]), (7, near), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (7, unlike[3]), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(STAGES["simhash_near_dedup"](spark, df, sf))
    assert [r[:2] for r in got] == sorted([(7, near), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (None, None)], key=str)
    got = [r.text for r in STAGES["substring_dedup"](spark, df, sf).collect()]
    words = " ".join(t for t in got if t).lower().split()
    assert len(words) == len(set(words)) and set(words) >= {w for t in unlike for w in t.split()} and got.count(None) == 1


def test_substring_stage(docs, spark, sf):
    """By brute force: words that no two texts share in 50 successive ones stay, and no 50 words are left in two texts."""
    before, after = docs.collect(), STAGES["substring_dedup"](spark, docs, sf).collect()
    runs = lambda text, n: {tuple(w[i : i + n]) for w in [text.lower().split()] for i in range(len(w) - n + 1)}
    shared, alone = {}, []
    for r in {x.text: x for x in before if x.text}.values():
        for g in runs(r.text, 25):
            shared[g] = shared.get(g, 0) + 1
    kept = {}
    for r in after:
        kept.setdefault(r.doc_id, []).append(r.text)
    for r in before:
        if not r.text or not any(shared[g] > 1 for g in runs(r.text, 25)):
            alone.append(r)  # no two similar passages of 50 words without 25 that are equal
    copies = {r.text for r in alone if r.text and len(r.text.split()) >= 50}
    for r in alone:
        assert r.text in kept.get(r.doc_id, []) or (r.text in copies and sum(x.text == r.text for x in before) > 1)
    assert len(alone) > 50 and len(after) < len(before)
    left = {}
    for i, r in enumerate(after):
        for g in runs(r.text or "", 52):
            left.setdefault(g, set()).add(i)
    assert not [g for g, held in left.items() if len(held) > 1 and len(set(g)) > 20]
    assert all(r.n_chars == len(r.text or "") for r in after)


def test_substring_stage_compares_what_others_came_before(spark, sf):
    """A middle text is similar to two that are not alike: a passage stays where no similar text has a smaller key."""
    rows, threes = [], []
    for k in range(12):
        whole = [f"p{k}x{i}" for i in range(51)]
        around = lambda j: ([f"a{k}x{j}x{i}" for i in range(30)], [f"z{k}x{j}x{i}" for i in range(30)])  # noqa: E731, B023
        held = [whole[:12] + ["first"] + whole[13:], whole, whole[:38] + ["last"] + whole[39:]]
        threes.append([len(rows) + j for j in range(3)])
        rows += [(len(rows) + j, " ".join([*around(j)[0], *x, *around(j)[1]]), "en", "a", 0) for j, x in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: set(r.text.split()) for r in STAGES["substring_dedup"](spark, df, sf).collect()}
    key = {r.doc_id: r.tk for r in df.select("doc_id", substring.text_key(df).alias("tk")).collect()}
    for k, (f, m, z) in enumerate(threes):
        held = {i: sum(w.startswith(f"p{k}x") for w in left[i]) > 40 for i in (f, m, z)}
        assert held == {f: key[f] < key[m], m: key[m] < min(key[f], key[z]), z: key[z] < key[m]}, (k, held)


def test_mixing_stage(docs, spark, sf):
    got = STAGES["source_mixing"](spark, docs, sf).select("doc_id", F.size(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")).alias("n")).collect()
    sizes = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    total = sum(r.n for r in got)
    assert abs(total - 1.5 * sum(sizes[r.doc_id] for r in docs.collect())) <= 60
    assert all(r.n <= max(1, sizes[r.doc_id]) for r in got)


def test_last_stage_and_run(docs, spark, sf):
    pieces = sentencepiece.Pieces.load()
    got = STAGES["sentencepiece"](spark, docs, sf).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip and pieces.decode(r.pieces) == texts[r.doc_id] and (r.pieces is None or r.n_pieces == len(r.pieces)) for r in got)
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "n_pieces", "pieces", "round_trip"] and out.where("NOT round_trip").count() == 0 and out.count() > 100
