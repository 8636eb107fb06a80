"""Quality of texts by a sparse ensemble of rules over statistics.

Statistics of a text (shares of kinds of characters, of distinct words and lines, lengths) are column expressions.
A random forest of shallow trees is grown on labelled documents; every path from a root to a node is a rule, a
conjunction of bounds of statistics. A logistic regression with an L1 penalty over the rules keeps those that count,
and they become one column expression: all documents are scored without Python and without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import BLANK, WORD, cut

#: Labelled documents of the fit, at most (those of the smallest hashes of their ids).
FIT_DOCS = 20_000
#: The forest, and the penalty of the rules' weights.
TREES, DEPTH, PENALTY, SEED = 24, 3, 5e-4, 17


def _statistics(text: Column, words: Column) -> dict[str, Column]:
    n, m = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.split(text, "\n")
    return {
        "log_chars": F.log1p(F.length(text)),
        "log_words": F.log1p(F.size(words)),
        "word_length": F.length(F.regexp_replace(text, f"[{BLANK}]", "")) / m,
        "upper": count(r"\p{Lu}") / n,
        "digit": count("[0-9]") / n,
        "blank": count(f"[{BLANK}]") / n,
        "mark": count(r"[^\p{L}\p{N}\s]") / n,
        "odd_mark": count(r"""[^\p{L}\p{N}\s.,;:'"!?()-]""") / n,
        "shout": count("!") / n,
        "bar": count(r"\|") / n,
        "stops": count("[.?!]") / m,
        "commas": count(",") / m,
        "capitals": count(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})") / m,
        "short": F.size(F.filter(words, lambda w: F.length(w) <= 2)) / m,
        "distinct": F.size(F.array_distinct(words)) / m,
        "again": F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) / m,
        "log_lines": F.log1p(F.size(lines)),
        "line_length": n / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


#: The statistics in the order of the trees' features.
NAMES = [
    "log_chars", "log_words", "word_length", "upper", "digit", "blank", "mark", "odd_mark", "shout", "bar", "stops", "commas", "capitals", "short", "distinct", "again", "log_lines", "line_length", "distinct_lines",
]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (text and any other columns) with a struct __s of statistics; null and empty texts have those of an empty one.

    A generator of one row keeps words and statistics worked out once, whatever uses them.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.withColumn("__w", F.explode(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))))
    told = _statistics(text, F.col("__w"))
    struct = F.struct(*[told[n].cast("double").alias(n) for n in NAMES])
    return words.withColumn("__s", F.explode(F.array(struct))).drop("__w")


#: A rule: statistic, and above which and up to which value it lies; all must hold.
Rule = dict[str, tuple[float, float]]


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, from the columns of __s."""
        total = reduce(lambda a, b: a + b, [F.when(holds(rule), weight).otherwise(0.0) for rule, weight in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, (low, high) in rule.items():
        if low > float("-inf"):
            out = out & (F.col(f"__s.{name}") > low)
        if high < float("inf"):
            out = out & (F.col(f"__s.{name}") <= high)
    return out


def paths(node, so_far: Rule | None = None) -> list[Rule]:
    """The rules of all nodes below a node of a tree; of two bounds of one statistic the tighter one counts."""
    if node.getClass().getSimpleName() != "InternalNode":
        return []
    split, out = node.split(), []
    name, at = NAMES[split.featureIndex()], split.threshold()
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high = (so_far or {}).get(name, (float("-inf"), float("inf")))
        rule = (so_far or {}) | {name: (low, min(high, at)) if left else (max(low, at), high)}
        out += [rule, *paths(child, rule)]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, most_docs: int = FIT_DOCS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1; null rows are left out, of repeated ids the greater one counts).

    At most most_docs labelled documents are read, so the fit's tables are bounded; of rows of one doc_id the least
    text that isn't null counts. Without both labels, the score is the share of ones among those there are (0.5 without any).
    """
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    told = with_statistics(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")))
    sample = cut(told.select("doc_id", "__s", F.when(F.col("quality") > 0, 1.0).otherwise(0.0).alias("label")).orderBy("doc_id"))
    seen = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    share = (seen.ones + 0.5) / (seen.n + 1)
    constant = math.log(share / (1 - share))
    if seen.ones in (0, seen.n):
        return RuleModel([], constant)
    parts = sample.sparkSession.sparkContext.defaultParallelism
    rows = sample.select("label", array_to_vector(F.array(*[F.col(f"__s.{n}") for n in NAMES])).alias("features")).coalesce(parts)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=10, featureSubsetStrategy="onethird", seed=SEED).fit(rows)
    every = {tuple(sorted(r.items())): r for tree in forest.trees for r in paths(tree._call_java("rootNode"))}
    rules = [every[k] for k in sorted(every)]
    if not rules:
        return RuleModel([], constant)
    flags = sample.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")).coalesce(parts)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(flags)
    weights = lasso.coefficients.toArray()
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights) if w], float(lasso.intercept))


def predict(docs: DataFrame, model: RuleModel, *, keep_at: float = 0.3) -> DataFrame:
    """All rows and columns of docs with score (0 to 1) and predicted (1 if score >= keep_at, else 0); columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = with_statistics(docs.select(*kept)).select(*kept, model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model that no held-out label was shown to.

    Held out are documents whose crc32 of the id as text leaves no rest by 5 (a null id: as an empty text).
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit(docs, labels.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
