import random
import re

import numpy as np
import xxhash

from emberlog.llm import simhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def plain(text):
    """The fingerprint by the letter of its definition."""
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps):
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j, b in enumerate(ids[:i]):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " \t\n", "one", "one", "ONE", "a b", "É é A b c d e f", "x " * 300, "x " * 900]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = base[:]
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\n".join(copy))
    return out + [rng.choice(out) for _ in range(40)]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = list(enumerate(texts(), 100))
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    fps = {i: plain(t) for i, t in rows}
    ids = sorted(fps)
    want = plain_components(ids, [fps[i] for i in ids])
    assert {i: got[i].fingerprint for i in ids} == {i: f"{fps[i]:016x}" for i in ids}
    assert {i: got[i].component_id for i in ids} == want


def test_links_of_random_fingerprints_equal_brute_force(spark, monkeypatch):
    """Chains of near values and a hot group above the limit of a block; components as of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    from emberlog.llm.shared import components

    found = components(simhash.link(spark.createDataFrame(rows, "node long, fp long"))).collect()
    roots = {i: i for i in range(len(fps))} | {r.node: r.root for r in found}
    assert roots == plain_components(list(range(len(fps))), fps)


def test_thresholds_cover_all_pairs():
    rng = np.random.default_rng(0)
    x = (rng.random((500, 64)) < rng.random(64)).astype(float)
    plan = simhash.plan_groups(500, x.T @ x)
    assert sorted(b for g, _ in plan for b in g) == list(range(64))
    assert sum(t + 1 for _, t in plan) == 5


def test_empty_table_and_missing_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e", "x"), (4, "a b c d e", "y"), (4, "other words are here now", None)], "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 4), (4, 4), (4, 4)]
