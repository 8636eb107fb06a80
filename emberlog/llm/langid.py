"""Language identification by the mixture of languages that a text holds.

A language is a Markov model of letters: the chance of a letter after the two before it, word by word. A
text is a mixture of languages; expectation-maximisation finds the shares that make its words likeliest, and
languages leave the set as long as the penalised likelihood grows. A text whose best single language can't
be improved by any share of another (the slope of the likelihood says so) needs no iteration.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import small_batches

#: Documents of a language that the fit reads, about: those whose hash of doc_id is small enough.
FIT_DOCS = 4_000
#: Buckets of hashed letter triples and pairs, for each language and at most for all; values of lang that are learned,
#: the commonest ones (a model is broadcast, so it is bounded).
BUCKETS, ALL_BUCKETS, LANGUAGES = 1 << 16, 1 << 24, 4096
#: Pseudo-counts of a letter after a pair, and letters that may follow.
DELTA, FOLLOWERS = 0.1, 64
#: Weight of the penalty of a language, in halves of the logarithm of the number of words.
PENALTY = 2.0
UNDETERMINED = "und"
#: Characters of words, and words by languages, that a task remembers; rows of words by languages that are worked on at once.
REMEMBERED, CELLS, CHUNK = 4_000_000, 1 << 22, 1 << 21
_WORDS = re.compile(r"[^\W\d_]+")
_U = np.uint32


def triples(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word's letter triples and of their first two, and where each word begins.

    A word has two blanks in front and one behind, so a triple stands for a letter or for the word's end.
    """
    code = np.frombuffer(("  " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(_U)
    a, b, c = code[:-2], code[1:-1], code[2:]
    pair = a * _U(0x9E3779B1) ^ b * _U(0x85EBCA77)
    three = pair * _U(0xC2B2AE3D) ^ c * _U(0x27D4EB2F)
    real = ~((c == 32) & (b == 32))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    spread = lambda x: ((x ^ (x >> _U(15))) * _U(0x2C1B3C6D) >> _U(16)).astype(np.int64) & (buckets - 1)
    # the second blank before each word but the first stands for nothing
    first = np.concatenate([[0], ends[:-1]])
    return spread(three[real]), spread(pair[real] + _U(1)), first


@dataclass
class LanguageModel:
    """languages in order of code points; up and down: logarithms of the smoothed counts, by language and bucket."""

    languages: list[str]
    up: np.ndarray
    down: np.ndarray

    def word_likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (rows) under each language."""
        out = np.empty((len(words), len(self.languages)), dtype=np.float64)
        step = max(1, CHUNK // (16 * max(1, len(self.languages))))
        for s in range(0, len(words), step):
            three, pair, first = triples(words[s : s + step], self.up.shape[1])
            for k in range(len(self.languages)):
                out[s : s + step, k] = np.add.reduceat((self.up[k][three] - self.down[k][pair]).astype(np.float64), first)
        return out


def letters_of(text: str | None) -> Counter:
    """Counts of the words of a text: runs of letters, lower-cased."""
    counts = Counter(_WORDS.findall(text.lower())) if text else Counter()
    if not all(map(str.isalpha, counts)):  # figures that aren't decimal digits are no letters
        clean: Counter = Counter()
        for w, n in counts.items():
            for part in "".join(c if c.isalpha() else " " for c in w).split():
                clean[part] += n
        return clean
    return counts


def fit(docs: DataFrame, *, most_docs: int = FIT_DOCS) -> LanguageModel:
    """docs: doc_id, text, lang. Rows with a null text or lang are left out; without any, no language is known.

    Of each language about most_docs documents are read, all of them if it has fewer. With more than 256 languages
    each has fewer buckets; rows of values of lang beyond the commonest LANGUAGES teach nothing.
    """
    known = small_batches(docs).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sizes = {r.lang: r["count"] for r in common.collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.empty((0, BUCKETS)), np.empty((0, BUCKETS)))
    buckets = min(BUCKETS, 1 << (ALL_BUCKETS // len(languages)).bit_length() - 1)
    shares = docs.sparkSession.createDataFrame([(lang, i, min(1.0, most_docs / sizes[lang])) for i, lang in enumerate(languages)], "lang string, number int, share double")
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = np.zeros((len(languages), buckets)), np.zeros((len(languages), buckets))
        for b in batches:
            for text, k in zip(b.column(0), b.column(1).to_pylist()):
                words = letters_of(text.as_py())
                if words:
                    three, pair, first = triples(list(words), buckets)
                    times = np.repeat(np.fromiter(words.values(), np.float64, len(words)), np.diff(np.append(first, len(three))))
                    up[k] += np.bincount(three, times, minlength=buckets)
                    down[k] += np.bincount(pair, times, minlength=buckets)
        for which, table in enumerate((up, down)):
            k, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array((which * len(languages) + k) * buckets + at), pa.array(table[k, at].astype(np.int64))], names=["at", "n"])

    chosen = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("text", "number")
    found = chosen.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    # at most 2 * buckets rows for each language
    tables = np.zeros(2 * len(languages) * buckets)
    tables[found["at"].to_numpy(dtype=np.int64)] = found["n"]
    up, down = tables.reshape(2, len(languages), buckets)
    return LanguageModel(languages, np.log(up + DELTA).astype(np.float32), np.log(down + DELTA * FOLLOWERS).astype(np.float32))


def _shares(p: np.ndarray, n: np.ndarray, doc: np.ndarray, total: np.ndarray, on: np.ndarray, *, rounds: int = 40, still: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts at once: shares by text and language, and log-likelihoods.

    p: scaled likelihoods by row and language; n: the row's count; doc: its text, ascending; on: the texts' sets.
    Each text stops by itself, when none of its own shares moves any more, so the texts beside it change nothing.
    """
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    pi = on / on.sum(1, keepdims=True)
    moving = np.ones(len(pi), dtype=bool)
    for _ in range(rounds):
        r = p * pi[doc]
        r *= (n / np.maximum(r.sum(1), 1e-300))[:, None]
        new = np.where(moving[:, None], np.add.reduceat(r, first, axis=0) / total[:, None], pi)
        moving &= np.abs(new - pi).max(1) >= still
        pi = new
        if not moving.any():
            break
    like = np.add.reduceat(n * np.log(np.maximum((p * pi[doc]).sum(1), 1e-300)), first)
    return pi, like


def mixtures(like: np.ndarray, n: np.ndarray, doc: np.ndarray, *, penalty: float = PENALTY) -> np.ndarray:
    """Shares by text and language. like: log-likelihoods of words; n: their counts; doc: their texts, 0, 1, and so on."""
    top = like.max(1, keepdims=True)
    p = np.exp(np.maximum(like - top, -60))
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(n, first)
    single = np.add.reduceat((like - top) * n[:, None], first, axis=0)
    best = single.argmax(1)
    shares = np.zeros_like(single)
    shares[np.arange(len(best)), best] = 1
    # the slope of the likelihood towards each other language, at the best single one
    slope = np.add.reduceat(p / p[np.arange(len(p)), best[doc]][:, None] * n[:, None], first, axis=0) / total[:, None]
    mixed = np.flatnonzero(slope.max(1) > 1 + 1e-9)
    if not len(mixed):
        return shares
    number = np.full(len(best), -1)
    number[mixed] = np.arange(len(mixed))
    rows = np.flatnonzero(number[doc] >= 0)
    p, n, doc, total = p[rows], n[rows], number[doc[rows]], total[mixed]
    on = np.ones((len(mixed), like.shape[1]))
    cost = penalty / 2 * np.log(np.maximum(total, 2))
    pi, now = _shares(p, n, doc, total, on)
    now = now - cost * (on.sum(1) - 1)
    live = np.arange(len(mixed))
    while len(live):
        # drop the language of the smallest share and see whether the penalised likelihood falls
        live = live[on[live].sum(1) > 1]
        if not len(live):
            break
        place = np.full(len(mixed), -1)
        place[live] = np.arange(len(live))
        rows = np.flatnonzero(place[doc] >= 0)
        fewer = on[live].copy()
        fewer[np.arange(len(live)), np.where(fewer > 0, pi[live], np.inf).argmin(1)] = 0
        new, like_new = _shares(p[rows], n[rows], place[doc[rows]], total[live], fewer)
        like_new = like_new - cost[live] * (fewer.sum(1) - 1)
        better = like_new >= now[live]
        live, new, like_new, fewer = live[better], new[better], like_new[better], fewer[better]
        on[live], pi[live], now[live] = fewer, new, like_new
    shares[mixed] = pi * on
    return shares


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """All rows and columns of docs with lang_pred, score (its share of the words) and languages (all shares).

    Columns of docs of these names are replaced. A text that is null or without letters is und, with score 0
    and no languages, and so is any text if the model knows no language. Of equal shares the first language
    in order of code points is taken. The whole text counts.
    """

    @F.pandas_udf("lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        table, letters = np.empty((0, len(model.languages))), 0
        for texts in batches:
            out: list[tuple] = [(UNDETERMINED, 0.0, [])] * len(texts)
            held: list[tuple[int, Counter]] = []

            def settle() -> None:
                nonlocal table, letters
                new = list(dict.fromkeys(w for _, c in held for w in c if w not in known))
                letters += sum(map(len, new))
                if letters > REMEMBERED or (len(known) + len(new)) * len(model.languages) > CELLS:
                    known.clear()
                    table = table[:0]
                    new = list(dict.fromkeys(w for _, c in held for w in c))
                    letters = sum(map(len, new))
                if new:
                    known.update(zip(new, range(len(table), len(table) + len(new))))
                    table = np.concatenate([table, model.word_likelihoods(new)])
                sizes = [len(c) for _, c in held]
                at = np.fromiter((known[w] for _, c in held for w in c), np.int64, sum(sizes))
                n = np.fromiter((k for _, c in held for k in c.values()), np.float64, sum(sizes))
                for (i, _), s in zip(held, mixtures(table[at], n, np.repeat(np.arange(len(held)), sizes), penalty=penalty)):
                    k = int(s.argmax())
                    out[i] = (model.languages[k], min(1.0, float(s[k])), [{"lang": model.languages[j], "share": float(s[j])} for j in np.flatnonzero(s > 0)])
                held.clear()

            size = 0
            for i, t in enumerate(texts):
                if model.languages and (words := letters_of(t)):
                    held.append((i, words))
                    size += len(words) * len(model.languages)
                    if size > CHUNK // 4:
                        settle()
                        size = 0
            if held:
                settle()
            yield pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "languages": [x[2] for x in out]})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    return small_batches(docs).select(*kept, run(text).alias("__l")).select(*kept, "__l.lang_pred", "__l.score", "__l.languages")


def held_out(id: str | Column, *, parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text has this remainder; a null id counts as empty text."""
    id = F.col(id) if isinstance(id, str) else id
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % parts == part


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang. doc_id, held_out, lang_pred, score, languages; held-out rows teach nothing."""
    docs = docs.select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = fit(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "languages")
