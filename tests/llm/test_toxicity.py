import math
import re

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import queries, toxicity


def test_held_out_labels_are_predicted(spark):
    """Fitted on three quarters of the labelled documents; of the rest most toxic ones are found and no clean ones."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("toxic").alias("said"))
    model = toxicity.fit(docs, labels.where("doc_id % 4 != 1").select("doc_id", F.col("said").alias("toxic")))
    got = toxicity.predict(docs.where("doc_id % 4 = 1"), model).join(labels, "doc_id").groupBy("said", "toxic").count().collect()
    n = {(r.said, r.toxic): r["count"] for r in got}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.005 * n[0, False]


def test_thresholds_share_the_weights_and_severity_is_expected():
    model = toxicity.OrdinalModel({"bad": 2.0, "bad*": 0.5, "worst": 3.0, "wors*": 0.0}, np.array([1.0, 2.5, 4.0]))
    p = model.score("Bad BAD words")
    assert np.allclose(p, 1 / (1 + np.exp(np.array([1.0, 2.5, 4.0]) - 2 * np.log(3))))
    assert (np.diff(p) < 0).all() and 0 <= p.sum() <= 3
    assert np.allclose(model.score(None), model.score("nothing known"))


def rows():
    clean = [(i, f"a quiet text number{i % 7} of plain words", 0) for i in range(60)]
    toxic = [(100 + i, " ".join(["you idiots are worthless"] * (1 + i % 3)) + f" number{i % 7}", 1) for i in range(30)]
    return clean + toxic


def test_fit_and_edges(spark):
    data = spark.createDataFrame(rows(), "doc_id long, text string, toxic int")
    docs, labels = data.drop("toxic"), data.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 0), (999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    extra = spark.createDataFrame([(500, None), (501, ""), (502, "you idiots " * 20_000), (None, "worthless idiots"), (503, "a quiet text of plain words " * 5000)], "doc_id long, text string")
    found = toxicity.predict(docs.unionByName(extra).withColumn("severity", F.lit("old")), model).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 95 and got[502].toxic and got[None].toxic and not got[503].toxic and not got[500].toxic and not got[501].toxic
    assert all(got[i].toxic == bool(y) for i, _, y in rows())
    assert got[102].severity > got[100].severity and all(0 <= r.severity <= 3 for r in found)


def test_without_labels_nothing_is_toxic(spark):
    data = spark.createDataFrame(rows(), "doc_id long, text string, toxic int")
    for labels in (data.where("false"), data.where("toxic = 1")):
        model = toxicity.fit(data.drop("toxic"), labels.select("doc_id", "toxic"))
        assert toxicity.predict(data.drop("toxic"), model).where("toxic").count() == 0
    assert toxicity.predict(data.drop("toxic").where("false"), model).collect() == []


def test_gradient_of_the_fit_reaches_an_optimum():
    """No small step in any direction makes the likelihood of the fitted rows better by more than a little."""
    rng = np.random.default_rng(0)
    x = rng.random((200, 4))
    grade = np.minimum(3, (x @ [4, 0, 0, 0] + rng.logistic(size=200) * 0.3).astype(int))
    sparse = toxicity.Sparse.of([[0, 1, 2, 3]] * 200, x.tolist(), 4)
    w, theta = toxicity.fit_ordinal(sparse, grade, 3)

    def loss(w, theta):
        s = x @ w
        up = np.concatenate([np.ones((200, 1)), 1 / (1 + np.exp(theta[None] - s[:, None])), np.zeros((200, 1))], axis=1)
        return -np.log(np.maximum(up[np.arange(200), grade] - up[np.arange(200), grade + 1], 1e-12)).mean() + 1e-4 / 2 * (w * w).sum()

    here = loss(w, theta)
    assert (np.diff(theta) > 0).all()
    for k in range(4):
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, theta) > here - 2e-3
    p = rng.normal(size=7) * 0.3
    value, gradient = toxicity.loss_and_gradient(p, sparse, grade, 3, 1e-4)
    assert np.isclose(value, loss(p[:4], np.cumsum([p[4], *np.exp(p[5:])])))
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        slope = (toxicity.loss_and_gradient(p + step, sparse, grade, 3, 1e-4)[0] - toxicity.loss_and_gradient(p - step, sparse, grade, 3, 1e-4)[0]) / 2e-6
        assert np.isclose(slope, gradient[k], atol=1e-6)


def test_query_equals_a_plain_version(spark, sf):
    """The whole query, scored again by one regular expression and one sum for each text, from the fit's weights."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        counts = {}
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            for t in [w] + [w[:k] + "*" for k in (4, 5) if len(w) >= k]:
                counts[t] = counts.get(t, 0) + 1
        s = sum(model.weights.get(t, 0.0) * math.log(1 + n) for t, n in counts.items())
        p = [1 / (1 + math.exp(theta - s)) for theta in model.theta]
        assert math.isclose(got[r.doc_id].severity, sum(p), abs_tol=1e-9) and math.isclose(got[r.doc_id].p_toxic, p[0], abs_tol=1e-9)
        assert got[r.doc_id].toxic == (p[0] >= 0.5)


def test_grades_are_thirds_by_scores_of_other_folds():
    rng = np.random.default_rng(3)
    toxic = np.arange(600) % 2 == 1
    harm = np.where(toxic, 1 + rng.random(600) * 3, rng.random(600) * 0.2)
    x = toxicity.Sparse.of([[0, 1]] * 600, np.stack([harm, rng.random(600)], 1).tolist(), 2)
    grade = toxicity.graded(x, toxic)
    assert set(grade[~toxic]) == {0} and np.bincount(grade[toxic], minlength=4)[1:].min() > 80
    means = [harm[grade == k].mean() for k in range(4)]
    assert all(a < b for a, b in zip(means, means[1:]))
    same = toxicity.Sparse.of([[0]] * 40, [[1.0 if i % 2 else 0.0] for i in range(40)], 1)
    assert len(set(toxicity.graded(same, np.arange(40) % 2 == 1)[1::2])) <= 3


def test_repeated_ids_bound_the_sample_and_empty_tables(spark):
    data = spark.createDataFrame(rows(), "doc_id long, text string, toxic int")
    many = data.drop("toxic").unionByName(spark.createDataFrame([(100, f"z{i} quiet") for i in range(500)] + [(101, None)], "doc_id long, text string"))
    labels = data.select("doc_id", "toxic")
    once, often = toxicity.fit(data.drop("toxic"), labels), toxicity.fit(many, labels)
    assert not any(w.startswith("z") for w in often.weights) and once.weights == often.weights
    model = toxicity.fit(data.drop("toxic").where("false"), labels)
    assert model.weights == {} and toxicity.predict(data.drop("toxic"), model).where("toxic").count() == 0
    assert toxicity.predict(data.drop("toxic"), toxicity.fit(data.drop("toxic"), labels.where("false"))).count() == 90
