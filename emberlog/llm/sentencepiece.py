"""SentencePiece encoding by a Viterbi search that distinct words share, and decoding.

A text is marked (a blank becomes a low line, one more goes in front) and cut before each run of marks; no
piece crosses such a cut. A task sorts the distinct words of a batch and walks them as a trie, depth first:
the best scores of all prefixes that a word shares with the word before are taken over, and only the rest
is searched. Characters that no piece covers become byte pieces.

The search wants logarithms of the pieces' likelihoods. A model of merges has only their order, so the likelihood of
the piece of rank r is taken to be in proportion to 1 / r (Zipf's law). Those who need the very ids of such a model, as
texts for one trained on them, take its merges instead of the search.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of the words that a task remembers between batches, about; beyond it starts anew.
REMEMBERED = 4_000_000
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """The vocabulary of a model: ids and scores by piece, ids of the 256 byte pieces, the bytes of each id."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_ids: list[int]
    unknown: int
    surface: list[bytes]
    #: The piece's place in the order of merges, from 1.
    rank: dict[str, int] = field(default_factory=dict)
    unknown_score: float = field(init=False)
    _suffixes: dict | None = field(init=False, default=None, repr=False)

    def __post_init__(self):
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes beyond a word")

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, surface, raw = {}, {}, [], [p.unk_id()] * 256
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            surface.append(b"" if p.is_control(i) else piece.replace(MARK, " ").encode())
            if p.is_byte(i):
                raw[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                ids[piece], scores[piece] = i, p.get_score(i)
        surface[p.unk_id()] = " ⁇ ".encode()
        return cls(ids, by_rank(scores), raw, p.unk_id(), surface, {piece: r for r, piece in enumerate(sorted(scores, key=lambda x: (-scores[x], ids[x])), 1)})

    def suffixes(self) -> dict:
        """Pieces from their last character on: a node has the next one before it by character, and its score by ''."""
        if self._suffixes is None:
            self._suffixes = {}
            for piece, score in self.scores.items():
                node = self._suffixes
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[""] = score
        return self._suffixes

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_suffixes": None}  # built where it is used

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each of the sorted words, four bytes each; each takes over the scores of its common prefix."""
        suffixes, unknown, lowest = self.suffixes(), self.unknown_score, -float("inf")
        best: list[float] = [0.0]
        back: list[int] = [0]
        before = ""
        for word in words:
            n = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                n += 1
            del best[n + 1 :], back[n + 1 :]
            for j in range(n + 1, len(word) + 1):
                top, at, i, node = lowest, j - 1, j, suffixes
                while i:
                    i -= 1
                    node = node.get(word[i])
                    if node is None:
                        break
                    # of equal scores the longer last piece is taken
                    if "" in node and best[i] + node[""] >= top:
                        top, at = best[i] + node[""], i
                if word[j - 1] not in self.ids and best[j - 1] + unknown > top:
                    top, at = best[j - 1] + unknown, j - 1
                best.append(top)
                back.append(at)
            before = word
            ids: list[int] = []
            j = len(word)
            while j:
                i = back[j]
                piece = self.ids.get(word[i:j])
                if piece is None:
                    ids += [self.bytes_ids[b] for b in reversed(word[i:j].encode("utf-8", "surrogatepass"))]
                else:
                    ids.append(piece)
                j = i
            yield word, array("i", reversed(ids)).tobytes()

    def merged(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each word by merges: of all neighbours that make a piece the first of rank is joined, leftmost first, until none does."""
        for word in words:
            parts: list[str | None] = list(word)
            after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
            heap: list[tuple[int, int, int]] = []

            def offer(i: int, j: int) -> None:
                if 0 <= i and j < len(parts) and (r := self.rank.get(parts[i] + parts[j])):  # noqa: B023
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[j])))  # noqa: B023

            for i in range(len(parts) - 1):
                offer(i, i + 1)
            while heap:
                _, i, size = heapq.heappop(heap)
                j = after[i]
                if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                    continue  # one of them was joined with another one since
                parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
                if after[j] < len(parts):
                    before[after[j]] = i
                offer(before[i], i)
                offer(i, after[i])
            ids = itertools.chain.from_iterable([self.ids[x]] if x in self.ids else [self.bytes_ids[b] for b in x.encode("utf-8", "surrogatepass")] for x in parts if x is not None)
            yield word, array("i", ids).tobytes()

    def words(self, text: str | None) -> list[str]:
        """Marked words; line ends stand alone, as no piece holds one."""
        return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int] | None) -> str | None:
        """Text of the ids without the blank in front; null for null."""
        if ids is None:
            return None
        out = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def by_rank(scores: dict[str, float]) -> dict[str, float]:
    """Logarithms of likelihoods in proportion to 1 / rank, the greatest score first; pieces of equal score by code points."""
    order = sorted(scores, key=lambda piece: (-scores[piece], piece))
    total = sum(1 / r for r in range(1, len(order) + 1))
    return {piece: -math.log(r * total) for r, piece in enumerate(order, 1)}


_WORDS = re.compile(rf"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


def encode(docs: DataFrame, pieces: Pieces, *, text: str = "text", into: str = "pieces", merges: bool = False) -> DataFrame:
    """All rows and columns of docs with an array of piece ids; empty for an empty text, null for null. By the search, or by the model's merges.

    A column named like the new one is replaced. Very long texts are whole; a word without any blank is
    searched in time proportional to its length.
    """
    kept = small_batches(docs).drop(into)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        held = 0
        for batch in batches:
            # some texts at a time, so that their words don't pile up
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                texts = [pieces.words(t) if t is not None else None for t in b.column(at).to_pylist()]
                new = set(itertools.chain.from_iterable(t for t in texts if t)).difference(known)
                held += sum(map(len, new))
                if held > REMEMBERED:
                    known, new = {}, set(itertools.chain.from_iterable(t for t in texts if t))
                    held = sum(map(len, new))
                known.update(pieces.merged(new) if merges else pieces.segment(sorted(new)))
                flat = [np.frombuffer(b"".join(map(known.__getitem__, t or ())), np.int32) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, into])

    schema = kept.select("*", F.lit(None).cast("array<int>").alias(into)).schema
    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, pieces: Pieces, *, column: str = "pieces", into: str = "decoded") -> DataFrame:
    """All rows and columns of docs with the text of the ids; null for null. A column named like the new one is replaced."""

    kept = small_batches(docs).drop(into)
    at = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(start, 256) for start in range(0, batch.num_rows, 256)):
                ids = b.column(at)
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                texts = [pieces.decode(flat[x:y].tolist()) if ok else None for x, y, ok in zip(ends, ends[1:], ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, into])

    return kept.mapInArrow(run, kept.select("*", F.lit(None).cast("string").alias(into)).schema)
