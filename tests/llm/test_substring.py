import random

import numpy as np
import pytest

from emberlog.llm import substring


def words(rng, n, tag=""):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def fixture(seed=0):
    """Documents with planted passages; says of each pair that shares one."""
    rng = random.Random(seed)
    passage = [words(rng, 60, "p"), words(rng, 90, "q"), words(rng, 300, "r")]
    docs, shared = {}, {}
    for i in range(40):
        parts = [words(rng, rng.randint(0, 200), f"d{i}x")]
        if i % 4 == 1:
            k = rng.randrange(3)
            own = passage[k][:]
            if i % 8 == 5:
                own[len(own) // 2] = "edited"
            parts += [own, words(rng, rng.randint(0, 200), f"e{i}x")]
            shared.setdefault(k, []).append((i, len(parts[0]), len(parts[0]) + len(own)))
        docs[i] = " ".join(w.upper() if i % 5 == 0 else w for p in parts for w in p)
    return docs, shared


def overlap(a, b):
    return max(0, min(a[1], b[1]) - max(a[0], b[0])) / max(1, b[1] - b[0])


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, shared = fixture()
    rows = list(docs.items()) + [(200, None), (201, ""), (202, "few words"), (203, "few words"), (204, docs[2] if len(docs[2].split()) >= 50 else "z"), (205, docs[3]), (205, docs[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS similarity")
    found = substring.repeated_passages(df).collect()
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for k, members in shared.items():
        hit = [i for i, a, b in members if any(overlap(s, (a, b)) > 0.9 for s in spans.get(i, []))]
        assert len(hit) >= len(members) - 1, (k, members, hit)
    for i in docs:
        own = [(a, b) for m in shared.values() for j, a, b in m if j == i]
        for s in spans.get(i, []):
            assert own and overlap(own[0], s) > 0.8
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in found)
    assert not {200, 201, 202, 203} & set(spans)
    if len(docs[3].split()) >= 50:
        assert (0, len(docs[3].split())) in spans[205]


def test_frequent_signatures_dealt_into_parts_link_the_same_texts(spark, monkeypatch):
    """One passage in all documents: with parts or without, all but one document are found."""
    rng = random.Random(9)
    passage = words(rng, 80, "p")
    docs = [(i, " ".join(words(rng, rng.randint(0, 40), f"d{i}x") + passage + words(rng, rng.randint(0, 40), f"e{i}x"))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    hit = []
    for often in (10**9, 10):
        monkeypatch.setattr(substring, "FREQUENT", often)
        covered = {}
        for r in substring.repeated_passages(df).collect():
            covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        hit.append(covered)
    assert hit[0].keys() == hit[1].keys()
    for covered in hit:
        assert len(covered) == 149
        assert all(80 <= len(c) <= 90 for c in covered.values())


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_passages_with_edits_are_all_found(spark, edits):
    """An edited passage of 50, 95 or 150 words has a similarity of 0.8 at least; where its edits stand makes no difference."""
    rng = random.Random(20 + edits)
    docs, want = [], []
    for k in range(120):
        n = 50 + 45 * max(edits - 1, 0) + rng.choice((0, 5, 55))
        whole = words(rng, n, f"p{k}x")
        edited = whole[:]
        for j in range(edits):
            at = (j + 1) * n // (edits + 1) + rng.randrange(-5, 6)
            kind = rng.randrange(3)
            edited[at : at + (kind > 0)] = [f"edit{k}"] if kind < 2 else []
        if min(len(edited), len(whole)) < 50:
            edited = whole
        for x in (whole, edited):
            docs.append(words(rng, rng.randint(0, 60)) + x + words(rng, rng.randint(0, 60)))
        want.append((len(docs) - 2, len(docs) - 1))
    one = [substring.shingle_hashes(" ".join(d).encode()) for d in docs]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    found = {frozenset((r.doc_id, r.match_doc_id)) for r in substring.repeated_passages(df).collect()}
    assert found <= {frozenset(w) for w in want}
    missed = [w for w in want if frozenset(w) not in found]
    for a, b in missed:  # none of whose windows of 50 words are similar enough
        assert not any(plain_similar(one[a], one[b], n) for n in range(46, 60)), (a, b)
    assert len(missed) <= 12


def plain_similar(x, y, n):
    """Whether some n shingles of x and n or nearly n of y are similar by 0.8, by all pairs of places."""
    starts = np.flatnonzero(np.isin(x, y))
    for s in starts:
        a = set(x[s : s + n].tolist())
        if s + n > len(x):
            break
        for t in np.flatnonzero(np.isin(y, x)):
            for m in range(max(46, n - 5), n + 6):
                if t + m > len(y):
                    break
                b = set(y[t : t + m].tolist())
                if len(a & b) >= 0.8 * len(a | b):
                    return True
    return False


def test_whole_query_covers_what_repeats_by_brute_force(spark):
    """Of all texts that hold the same 50 words, all but one have them covered, at two sizes of the table; nothing else is found."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    twice = table.unionByName(table.selectExpr("doc_id + 100000 AS doc_id", "concat('again ', text, ' once') AS text"))
    for docs in (table, twice):
        rows = [r for r in docs.collect() if r.text]
        spans = {}
        for r in substring.repeated_passages(docs).collect():
            spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        holders, grams = {}, {}
        for r in rows:
            w = r.text.translate(LOWER).split()
            grams[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            for i in range(len(w) - 49):
                if not set(range(i + 1, i + 49)) <= spans.get(r.doc_id, set()):
                    holders.setdefault(tuple(w[i : i + 50]), set()).add(r.text)
                else:
                    holders.setdefault(tuple(w[i : i + 50]), set())
        assert all(len(h) <= 1 for h in holders.values())
        for r in substring.repeated_passages(docs).collect():
            assert len(grams[r.doc_id] & grams[r.match_doc_id]) >= 1 and r.end_word - r.start_word >= 50


LOWER = {i: i + 32 for i in range(65, 91)}


def test_texts_without_ids_are_texts_as_others(spark):
    rng = random.Random(31)
    passage = words(rng, 60)
    docs = [(None, " ".join(words(rng, 20) + passage)), (2, " ".join(words(rng, 30) + passage)), (None, " ".join(words(rng, 70)))]
    df = spark.createDataFrame([(*d, 7) for d in docs] + [(5, None, 7), (None, None, 7)], "doc_id long, text string, tk int")
    found = substring.repeated_passages(df).collect()
    assert len(found) == 1 and {found[0].doc_id, found[0].match_doc_id} == {None, 2}
    same = df.unionByName(df.where("doc_id IS NULL"))
    left = substring.without_passages(same).collect()
    assert sum(r.text is None for r in left) == 3
    assert sum(passage[0] in r.text.split() for r in left if r.text) == 1
    assert sum(r.text == docs[2][1] for r in left) == 1 and len([r for r in left if r.text]) == 3


def test_exact_compares_until_nothing_is_left(spark, monkeypatch):
    """Two texts share an edited passage, and all its unchanged runs are in texts of smaller keys that share nothing more."""
    rng = random.Random(8)
    docs, pairs = [], []
    for k in range(6):
        passage = words(rng, 51, f"p{k}x")
        edited = passage[:25] + ["edit"] + passage[26:]
        pairs.append((len(docs), len(docs) + 1))
        docs += [words(rng, 20) + passage + words(rng, 20), words(rng, 20) + edited + words(rng, 20)]
        docs += [words(rng, 20) + passage[a : a + 25] + words(rng, 20) for a in (0, 26) for _ in range(6)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    found = {frozenset((r.doc_id, r.match_doc_id)) for r in substring.repeated_passages(df, exact=True).collect()}
    assert found == {frozenset(p) for p in pairs}


def test_texts_that_hold_only_a_minimum_hide_no_passage(spark):
    """Two texts share 50 words; others hold five of them each, so that most firsts of a minimum share nothing more."""
    rng = random.Random(5)
    filler = lambda: words(rng, 40)
    docs, holders = [], []
    for k in range(30):
        passage = words(rng, 50, f"p{k}x")
        for _ in range(2):
            holders.append((k, len(docs)))
            docs.append(filler() + passage + filler())
        docs += [filler() + passage[i : i + 5] + filler() for i in range(46) for _ in range(8)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(5)
    found = substring.repeated_passages(df).collect()
    covered = {r.doc_id for r in found if overlap((r.start_word, r.end_word), (40, 90)) == 1}
    assert {k for k, i in holders if i in covered} == set(range(30))
    assert {r.doc_id for r in found} <= {i for _, i in holders}


def test_edits_side_by_side_and_insertions_split_no_passage(spark):
    """Similar as a whole, though neither side of the edit is a passage of its own."""
    rng = random.Random(6)
    docs, want = [], []
    for k in range(8):
        whole = words(rng, 100, f"p{k}x")
        edited = whole[:]
        edited[47] = edited[52] = f"edit{k}"
        for held in (whole, edited) if k % 2 else (edited, whole):
            docs.append(words(rng, 30) + held + words(rng, 30))
        want.append((len(docs) - 2, len(docs) - 1, 100))
    for k, n in ((8, 7), (9, 7), (10, 11), (11, 11)):
        whole = words(rng, 95, f"p{k}x")
        docs += [words(rng, 30) + whole + words(rng, 30), words(rng, 30) + whole[:47] + words(rng, n) + whole[47:] + words(rng, 30)]
        want.append((len(docs) - 2, len(docs) - 1, 95))
    one = [np.array(substring.shingle_hashes(" ".join(d).encode())) for d in docs]
    for a, b, n in want:
        x, y = substring._matched(one[b], one[a], 0)
        found = substring._verify(one[b], one[a], x, y, substring._repeats(one[b]))
        assert len(found) == 1 and found[0][1] - found[0][0] + substring.SHINGLE >= n, (a, b, found)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    spans = {r.doc_id: (r.start_word, r.end_word) for r in substring.repeated_passages(df).collect()}
    whole = sum(any(overlap(spans.get(i, (0, 0)), (30, 30 + n)) == 1 for i in (a, b)) for a, b, n in want)
    assert whole >= len(want) - 1, spans


def test_passages_leave_once_and_the_rest_stays(spark):
    docs, shared = fixture(1)
    df = spark.createDataFrame([(i, t, "s") for i, t in docs.items()], "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in substring.without_passages(df).collect()}
    for k, members in shared.items():
        marker = {0: "p", 1: "q", 2: "r"}[k]
        held = [i for i, *_ in members if sum(w.lower().startswith(marker) for w in kept.get(i, "").split()) > 40]
        assert len(held) == 1 if len(members) > 1 else True
    for i, t in docs.items():
        if not any(i == j for m in shared.values() for j, *_ in m):
            assert kept[i] == t


def test_repeated_words_and_lines(spark):
    """Texts of one word or one line again and again line up where they stand, however often each shingle comes."""
    rng = random.Random(3)
    line = " ".join(words(rng, 12))
    texts = ["same " * 200, "same " * 150 + " ".join(words(rng, 30)), "\n".join([line] * 20), "\n".join([line] * 20 + [" ".join(words(rng, 80))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hit = {r.doc_id for r in substring.repeated_passages(df).collect()} | {r.match_doc_id for r in substring.repeated_passages(df).collect()}
    assert hit == {0, 1, 2, 3}
    assert substring.repeated_passages(df.where("false")).collect() == []


def plain_windows(keys, width):
    """All maximal windows of at least width whose minimum is at c, from the definition."""
    n, out = len(keys), set()
    for c in range(n):
        a = c
        while a and keys[a - 1] > keys[c]:
            a -= 1
        b = c
        while b + 1 < n and keys[b + 1] > keys[c]:
            b += 1
        if b - a + 1 >= width:
            out.add((a, c, b))
    return out


def test_compact_windows_cover_every_passage_minimum():
    rng = np.random.default_rng(0)
    for n in (10, 46, 47, 200):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        width = 10
        a, c, b, node = substring.compact_windows(hashes, width)
        mask = np.uint64((1 << 24) - 1)
        keys = (substring._mix(hashes + np.uint64(substring._SEED)) & ~mask) | np.arange(n, dtype=np.uint64)
        whole = {x[1]: x for x in plain_windows(keys.tolist(), width)}
        for x, y, z in zip(a.tolist(), c.tolist(), b.tolist()):
            assert whole[y][0] <= x <= y <= z <= whole[y][2] and z - x + 1 >= width
        for s in range(n - width + 1):
            at = int(np.argmin(keys[s : s + width])) + s
            assert any(y == at and x <= s and s + width - 1 <= z for x, y, z in zip(a.tolist(), c.tolist(), b.tolist()))


def test_shingle_hashes_follow_words_only():
    same = [b"A b c d e f", b"a  b\tc\nd e f ", b"\x0b a b c d e f"]
    assert len({tuple(substring.shingle_hashes(t).tolist()) for t in same}) == 1 and len(substring.shingle_hashes(same[0])) == 2
    assert len(substring.shingle_hashes(b"a b c d")) == len(substring.shingle_hashes(b"")) == 0
    x, y = substring._matched(np.array([5, 7, 7, 9], np.uint64), np.array([7, 1, 7, 5, 7], np.uint64), -2)
    assert x.tolist() == [0, 1, 2] and y.tolist() == [3, 2, 4]


def test_texts_whose_keys_collide_are_told_apart(spark, monkeypatch):
    """A key of three bits: texts that share it without being equal have another one, and nothing is lost."""
    rng = random.Random(41)
    docs = [(i, " ".join(words(rng, 60, f"d{i}x"))) for i in range(4)]
    docs += [(10, docs[0][1] + " more"), (11, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    real = substring.F.xxhash64
    monkeypatch.setattr(substring.F, "xxhash64", lambda *c: substring.F.pmod(real(*c), substring.F.lit(2)) if c == ("text",) else real(*c))
    key = substring.text_key(df)
    assert df.select(key.alias("k")).distinct().count() == 5


def test_edited_passages_whose_halves_stand_in_other_texts(spark):
    """Twenty pairs share 51 words but for one in the middle, and each half stands in eight other texts: all pairs are found by default."""
    rng = random.Random(31)
    rows, want, n = [], set(), 0
    for i in range(20):
        left, right = words(rng, 25, f"l{i}"), words(rng, 25, f"r{i}")
        for half in [left] * 8 + [right] * 8:
            rows.append((n, " ".join([*words(rng, 40), *half, *words(rng, 40)])))
            n += 1
        pair = []
        for middle in ("first", "second"):
            rows.append((n, " ".join([*words(rng, 60), *left, middle, *right, *words(rng, 60)])))
            pair.append(n)
            n += 1
        want.add(frozenset(pair))
    rng.shuffle(rows)
    before = spark.catalog.listTables()
    found = {frozenset((r.doc_id, r.match_doc_id)) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= found, len(want & found)
    assert spark.catalog.listTables() == before


def test_signatures_of_similar_passages_agree_in_some_band():
    """At a similarity of just 0.8 (one word of 51 differs), over many random passages; different passages share none."""
    rng, missed = random.Random(9), 0
    for i in range(400):
        w = words(rng, 51, f"s{i}")
        k = 25 + rng.randint(-3, 3)
        a, b = (substring.shingle_hashes(" ".join([*words(rng, 20), *w[:k], m, *w[k + 1 :], *words(rng, 20)]).encode()) for m in ("one", "two"))
        sig = [set(substring.passage_signatures(h, np.arange(len(h) - substring.WIDTH + 1))[0].tolist()) for h in (a, b)]
        missed += not sig[0] & sig[1]
        other = substring.shingle_hashes(" ".join(words(rng, 90, f"o{i}")).encode())
        assert not sig[0] & set(substring.passage_signatures(other, np.arange(len(other) - substring.WIDTH + 1))[0].tolist())
    assert missed <= 2


def similar_pairs(texts):
    """Pairs of texts with some 46 shingles or nearly so that are similar by 0.8, by all pairs of texts."""
    one = [substring.shingle_hashes(t.encode()) for t in texts]
    near = [(a, b) for a in range(len(one)) for b in range(a) if len(np.intersect1d(one[a], one[b])) >= 37]
    return {frozenset(p) for p in near if any(plain_similar(one[p[0]], one[p[1]], n) for n in (46, 47))}


def test_no_pair_is_lost_to_texts_that_come_first(spark):
    """Of three texts the middle one is similar to both others, which are not alike; halves of the passage stand in texts without it. By default all are covered."""
    rng = random.Random(51)
    texts, threes = [], []
    for k in range(12):
        whole = words(rng, 51, f"p{k}x")
        first, last = whole[:], whole[:]
        first[12], last[38] = "first", "last"
        threes.append([len(texts) + i for i in range(3)])
        texts += [" ".join(words(rng, 30) + x + words(rng, 30)) for x in (first, whole, last)]
        texts += [" ".join(words(rng, 30) + whole[a : a + 25] + words(rng, 30)) for a in (0, 13, 26) for _ in range(3)]
    want = similar_pairs(texts)
    assert want == {frozenset((m, x)) for f, m, z in threes for x in (f, z)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = [frozenset((r.doc_id, r.match_doc_id)) for r in substring.repeated_passages(df).collect()]
    assert set(found) == want and len(found) == len(want)
    left = {r.doc_id: r.text.split() for r in substring.without_passages(df).collect()}
    held = [sum(w in left.get(i, []) for w in texts[i].split()[30:81]) for t in threes for i in t]
    assert sum(n == 51 for n in held) <= 24 and sum(n < 10 for n in held) >= 12


def test_other_places_of_the_first_text_are_compared(spark):
    """A text holds half of a passage, far from it the whole one; the other text has it edited, whichever text is first."""
    rng, texts = random.Random(52), []
    for k in range(12):
        whole = words(rng, 51, f"p{k}x")
        edited = whole[:25] + ["edit"] + whole[26:]
        texts += [" ".join(words(rng, 20) + whole[:25] + words(rng, 250) + whole[26:] + words(rng, 250) + whole + words(rng, 20)), " ".join(words(rng, 30) + edited + words(rng, 30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {frozenset((r.doc_id, r.match_doc_id)) for r in substring.repeated_passages(df).collect()}
    assert found == {frozenset((i, i + 1)) for i in range(0, 24, 2)}


def test_a_large_class_and_windows_alone_meet_in_parts(spark):
    """All windows of different classes meet once, however they are dealt; those of one class and of one text don't."""
    held = [(t, 1, t % 3, t >= 30, 0 if t < 30 else t, t < 30) for t in range(40)] + [(35, 1, 99, True, 35, False)]
    rows = [(t, s, at, alone, c, most, parts, list(range(131 if at == 99 else 60)), 0) for parts in (1, 4) for t, _, at, alone, c, most in held for s in (parts,)]
    schema = "tk long, sig long, at int, alone boolean, class long, most boolean, parts int, near array<int>, again int"
    windows = spark.createDataFrame(rows, schema)
    met = substring.meet_all(windows, windows).groupBy("lo", "at_lo", "hi", "at_hi").count().collect()
    want = {((a[0], a[2]), (b[0], b[2])) for a in held for b in held if a[0] < b[0] and a[4] != b[4]}
    assert {((r.lo, r.at_lo), (r.hi, r.at_hi)) for r in met} == want and {r["count"] for r in met} == {2}


def test_a_window_that_only_a_larger_text_shares_meets_the_smaller_ones(spark):
    """Texts 1 and 2 are each linked to 3 by one passage, so all are of one class and covered; whether 1 holds what 2 has is still to be seen."""
    rng = random.Random(61)
    passage = " ".join(words(rng, 60))
    texts = spark.createDataFrame([(k, passage) for k in (1, 2, 3)], "tk long, text string")
    places = spark.createDataFrame([(7, k, 20) for k in (1, 2, 3)], "sig long, tk long, at int")
    schema = "lo long, hi long, start long, end long, match_start long, match_end long, similarity double"
    found = spark.createDataFrame([(lo, 3, 0, 60, 0, 60, 1.0) for lo in (1, 2)], schema)
    near = substring._with_surroundings(substring._apart(places, found), texts)
    assert {(r.lo, r.hi) for r in substring.meet_all(near, near).collect()} == {(1, 2)}


def test_pairs_that_go_to_verification_are_those_that_can_hold_a_passage(spark):
    """Of windows that share eleven shingles or more: edited passages go, whatever length; runs of one word, lines and dense edits don't."""
    rng, rows = random.Random(62), []
    def pair(sig, x, y, at=60):
        rows.extend((2 * sig + k, sig, at, True, 2 * sig + k, False, 1, substring.shingle_hashes(" ".join(t).encode())) for k, t in enumerate((x, y)))
    around = lambda: words(rng, 60)
    for sig, (n, edits) in enumerate([(50, ()), (51, (25,)), (60, (26, 27)), (95, (40, 45)), (110, (30, 70))]):
        whole = words(rng, n)
        edited = [f"edit{i}" if i in edits else w for i, w in enumerate(whole)]
        pair(sig, [*around(), *whole, *around()], [*around(), *edited, *around()])
    line, dense = words(rng, 30), words(rng, 120)
    pair(10, [*around(), *line, *around()], [*around(), *line, *around()])
    pair(11, [*around(), *["the"] * 110, *around()], [*around(), *["the"] * 30, *around()])
    pair(12, [*around(), *dense, *around()], [*around(), *[f"edit{i}" if i > 20 and i % 9 == 0 else w for i, w in enumerate(dense)], *around()])
    table = [(*r[:-1], r[-1].astype(np.uint32).view(np.int32)[max(0, r[2] - substring.NEAR) : r[2] + substring.ARM + substring.NEAR].tolist()) for r in rows]
    windows = spark.createDataFrame(table, "tk long, sig long, at int, alone boolean, class long, most boolean, parts int, near array<int>")
    assert {(r.lo, r.hi) for r in substring.meet_all(windows, windows).collect()} == {(2 * s, 2 * s + 1) for s in range(5)}


def test_links_grow_with_the_windows_of_a_group_and_lose_nothing(spark):
    """Near copies, each with edits of its own, of classes of their own: one link covers a window, and all come into one class; pairs that hold no passage aren't linked."""
    rng, rows, n = random.Random(71), [], 150
    whole = words(rng, 140)
    for k in range(n):
        text = whole[:]
        for at in (20, 120) if k % 3 else (35, 105):
            text[at + rng.randrange(5)] = f"edit{k}"
        near = substring.shingle_hashes(" ".join(text).encode()).astype(np.uint32).view(np.int32)
        rows.append((k, 1, 60, True, k, False, 1, near[: 60 + substring.ARM + substring.NEAR].tolist()))
    for k in range(n, n + 40):  # the run alone
        text = words(rng, 55) + whole[55:80] + words(rng, 60)
        near = substring.shingle_hashes(" ".join(text).encode()).astype(np.uint32).view(np.int32)
        rows.append((k, 1, 60, True, k, False, 1, near.tolist()))
    windows = spark.createDataFrame(rows, "tk long, sig long, at int, alone boolean, class long, most boolean, parts int, near array<int>").repartition(3)
    met = [(r.lo, r.hi) for r in substring.meet_all(windows, windows, once=True).collect()]
    assert len(met) == n - 1 and {hi for _, hi in met} == set(range(1, n)) and all(lo < hi for lo, hi in met)
    every = {(r.lo, r.hi) for r in substring.meet_all(windows, windows).collect()}
    assert every == {(a, b) for b in range(n) for a in range(b)} and set(met) < every


def test_passages_between_dense_edits_are_found_wherever_a_text_is_split():
    """Edits all along, one stretch of 46 shingles or more with one edit: however far the edits beside it are."""
    rng = random.Random(72)
    for _ in range(40):
        whole = words(rng, 200)
        edited = whole[:]
        at = rng.randrange(60, 80)
        for k in [*range(5, at, 9), at + 25 + rng.randrange(-3, 4), *range(at + 53, 200, 9)]:
            edited[k] = "edit"
        hi, lo = (substring.shingle_hashes(" ".join(t).encode()) for t in (edited, whole))
        x, y = substring._matched(hi, lo, 0)
        found = substring._stretches(hi, lo, x, y)
        assert plain_similar(hi, lo, 46) == bool(found)
        for a, b, c, d, like in found:
            both = len(np.intersect1d(hi[a : b + 1], lo[c : d + 1]))
            assert min(b - a, d - c) >= 45 and like >= 0.8 and like == both / (b - a + d - c + 2 - both)
