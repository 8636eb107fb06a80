"""URL rules by a sorted array of 64-bit digests.

The rules, sorted by their digests, are one Arrow file, which Spark hands to every executor and each Python worker
maps into memory. A url's candidates are the ends of its host and the heads of its path that are as long as some
rule's; the digests of a batch are looked up by one vectorised binary search for each pair of lengths, longest
first, and a hit counts only if the stored strings are equal. More rules than may be handed out are joined on the
candidates.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import ascii_lower, shared_copy

#: Bytes of rules that are handed to each executor at most.
MOST_BYTES = 32 << 20
RULES = "host string, path string, verdict string"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; then what follows up to ? # or the end."""
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode("utf-8", "surrogatepass"), 0)


class DigestArray:
    """A mapped file of rules: digests, hosts, paths and verdicts in order of the digests."""

    def __init__(self, path: str, digest: Callable[[str], int] = _digest):
        self.digest = digest
        table = pa.ipc.open_file(pa.memory_map(path)).read_all().combine_chunks()
        self.keys = table["key"].chunk(0).to_numpy() if table.num_rows else np.empty(0, np.uint64)
        self.hosts, self.paths, self.verdicts = table["host"], table["path"], table["verdict"]
        sizes = zip(pc.utf8_length(self.hosts).to_pylist(), pc.utf8_length(self.paths).to_pylist())
        self.lengths = sorted(set(sizes), key=lambda n: (-n[0] - n[1], -n[0]))

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], path: str, digest: Callable[[str], int] = _digest) -> None:
        """Of rules that repeat the last verdict in code point order counts; rules with a null are left out."""
        known = {(h, p): v for h, p, v in sorted(r for r in rules if None not in r)}
        order = sorted((digest(f"{h}\0{p}"), h, p, v) for (h, p), v in known.items())
        columns = list(zip(*order)) or [[], [], [], []]
        table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.uint64(), pa.large_string(), pa.large_string(), pa.large_string()))], names=["key", "host", "path", "verdict"])
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table)

    def match(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """The index of the longest rule that fits each url, or -1. Of equally long ones the longer host wins."""
        best = np.full(len(hosts), -1)
        host_size, path_size = (pc.utf8_length(x).to_numpy(zero_copy_only=False) for x in (hosts, paths))
        for n, m in self.lengths if len(self.keys) else ():
            at = np.flatnonzero((best < 0) & (path_size >= m) & (host_size >= n))
            ends = pc.utf8_slice_codeunits(hosts.take(pa.array(at)), -n - 1) if len(at) else pa.array([], pa.string())
            whole = np.array(pc.or_(pc.equal(pc.utf8_length(ends), n), pc.starts_with(ends, ".")).to_pylist(), dtype=bool)
            at = at[whole]
            if not len(at):
                continue
            names = pc.utf8_slice_codeunits(hosts.take(pa.array(at)), -n).to_pylist() if n else [""] * len(at)
            heads = pc.utf8_slice_codeunits(paths.take(pa.array(at)), 0, m).to_pylist() if m else [""] * len(at)
            wanted = np.fromiter((self.digest(f"{h}\0{p}") for h, p in zip(names, heads)), np.uint64, len(at))
            place = np.searchsorted(self.keys, wanted)
            for j in np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] == wanted):
                r = int(place[j])
                while r < len(self.keys) and self.keys[r] == wanted[j]:
                    if self.hosts[r].as_py() == names[j] and self.paths[r].as_py() == heads[j]:
                        best[at[j]] = r
                        break
                    r += 1
        return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, *, url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """All rows and columns of pages with host, path, rule (null if none fits) and verdict (default if none fits).

    rules: host, path, verdict. Columns of pages of the new names are replaced. A url that is null or has no :// has
    an empty host and path, which no rule of a host fits. A rule fits its host and all subdomains if the url's path
    starts with its own. An empty table gives an empty table, and urls may be of any length.
    """
    host, path = host_and_path(url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length(F.concat("host", "path", "verdict")) + 8), F.lit(0))).first()[0]
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()] if size <= most_bytes else rules
    else:
        rules = list(rules)
        if sum(8 + len(x.encode("utf-8", "surrogatepass")) for r in rules for x in r if x is not None) > most_bytes:
            rules = pages.sparkSession.createDataFrame(rules, RULES)
    if isinstance(rules, DataFrame):
        return _joined(parts, rules, default)
    name = f"rules-{uuid.uuid4().hex}.arrow"
    with tempfile.TemporaryDirectory() as folder:  # on its way to the shared folder, where executors fetch it
        DigestArray.write(rules, os.path.join(folder, name))
        pages.sparkSession.sparkContext.addFile(shared_copy(pages.sparkSession, os.path.join(folder, name)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DigestArray(SparkFiles.get(name))
        for b in batches:
            found = known.match(b.column("host"), b.column("path"))
            at = pa.array(found, mask=found < 0)
            rule = pc.binary_join_element_wise(known.hosts.take(at), known.paths.take(at), pa.scalar("", pa.large_string()))
            verdict = pc.fill_null(known.verdicts.take(at), pa.scalar(default, pa.large_string()))
            plain = [x.combine_chunks().cast(pa.string()) if isinstance(x, pa.ChunkedArray) else x.cast(pa.string()) for x in (rule, verdict)]
            yield pa.RecordBatch.from_arrays([*b.columns, *plain], names=[*b.schema.names, "rule", "verdict"])

    none = F.lit(None).cast("string")
    return parts.mapInArrow(look_up, parts.select("*", none.alias("rule"), none.alias("verdict")).schema)


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """judge() for any number of rules: each host and path once, with its candidates, joined with the rules."""
    rules = rules.dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = rules.select(F.length("host").alias("n"), F.length("path").alias("m")).distinct()
    # there are no more pairs of lengths than lengths of hosts times lengths of paths, however many the rules are
    lengths = lengths.groupBy("n").agg(F.array_sort(F.collect_list("m")).alias("ms")).agg(F.map_from_entries(F.collect_list(F.struct("n", "ms"))).alias("lengths"))
    # a url's own: of each end of its host as long as some rule's, the heads of its path
    ends = F.filter(F.map_keys("lengths"), lambda n: (n <= F.length("host")) & ((n == F.length("host")) | (F.substr(F.col("host"), F.length("host") - n, F.lit(1)) == ".")))
    heads = F.flatten(F.transform(ends, lambda n: F.transform(F.filter(F.col("lengths")[n], lambda m: m <= F.length("path")), lambda m: F.struct(F.when(n > 0, F.substr(F.col("host"), F.length("host") - n + 1, n)).otherwise("").alias("rule_host"), F.substr(F.col("path"), F.lit(1), m).alias("rule_path")))))
    urls = parts.select("host", "path").distinct().join(F.broadcast(lengths))  # one row
    candidates = urls.select("host", "path", F.explode(heads).alias("c")).select("host", "path", "c.*")
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("found"))
    size = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = candidates.join(named, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "found"), size).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(*parts.columns, F.col("best.rule").alias("rule"), F.coalesce("best.found", F.lit(default)).alias("verdict"))
