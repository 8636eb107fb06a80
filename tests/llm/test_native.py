"""Source mixing, URL rules and chat windows: against SQL, and plain versions of what SQL doesn't show."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import chat, mixing, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, sf, oracle, rows_of, name):
    assert rows_of(queries.QUERIES[name](spark, sf)) == oracle(queries.ORACLES[name])


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Deal out by weight, cap, and deal what is over to those below their cap, until nothing is over."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = {s: left * w[s] / sum(w[x] for x in order if x not in full) for s in order if s not in full}
        over = [s for s in rest if rest[s] >= most * sizes[s]]
        if not over:
            return full | rest
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
        if len(full) == len(order):
            return full


def mix_rows(seed):
    rng = random.Random(seed)
    sources = [None, "a", "b", "Z", "é", "tiny", "none"]
    return [(i, rng.choices(sources, weights=[1, 30, 5, 3, 2, 0.3, 1])[0], None if rng.random() < 0.05 else rng.randint(0, 50)) for i in range(600)] + [(i, "none", 0) for i in range(3)]


def test_mixing_equals_a_plain_version(spark):
    for seed in range(2):
        rows = mix_rows(seed)
        df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("old"))
        got = mixing.mix(df).collect()
        sizes = {}
        for _, s, n in rows:
            sizes[s] = sizes.get(s, 0) + (n or 0)
        want = plain_targets(sizes)
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())


def test_repeated_texts_hold_the_words_taken(spark):
    rows = [(1, "one two  three", 3, 6), (2, "\na b c\td e ", 5, 7), (3, "x y", 2, 0), (4, "only", 1, 1)]
    got = mixing.repeat_taken(spark.createDataFrame(rows, "doc_id long, text string, size long, taken long")).select("doc_id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert {i: sorted(len(t.split()) for t in x) for i, x in by.items()} == {1: [3, 3], 2: [2, 5], 4: [1]}
    assert by[1] == ["one two  three"] * 2 and sorted(by[2]) == ["\na b", "\na b c\td e "]


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixing_report(empty).collect() == []
    same = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, None, None)], "doc_id long, text string, source string")
    got = mixing.mixing_report(same).collect()
    assert sorted((r.size, r.source_size) for r in got) == [(0, 0), (2, 6), (2, 6), (2, 6)] and sum(r.taken for r in got) == 9


def plain_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "org", "é.org", "a..com", ""]
    paths = ["", "/", "/x", "/x/y", "/xy", "//", "/é"]
    rules = {(h, p): rng.choice(["allow", "block"]) for h in hosts[:-1] for p in paths if rng.random() < 0.4}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/x?q", "http://a.com#f/x", "a://b://c/x", "http://A.com:80/x", "http://u\n.com/x\ny?z"]
    urls += [f"https://{rng.choice(['', 'w.', 'W.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/x', '#b', '/more'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.judge(df, rules).collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        found = plain_rule(host, path, rules)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((found[0] + found[1], found[2]) if found else (None, "allow")), r.url


def plain_rule(host, path, rules):
    """The longest rule by trying all of them."""
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)


def test_url_digests_may_collide(tmp_path):
    rules = [(f"h{i}.com", f"/{i}", "block" if i % 2 else "allow") for i in range(40)]
    few = lambda s: len(s) % 3
    url_filter.DigestArray.write(rules, str(tmp_path / "r"), few)
    index = url_filter.DigestArray(str(tmp_path / "r"), few)
    found = index.match(pa.array([f"w.h{i}.com" for i in range(41)]), pa.array([f"/{i}/x" for i in range(41)]))
    assert [index.hosts[int(r)].as_py() if r >= 0 else None for r in found] == [*[f"h{i}.com" for i in range(40)], None]
    url_filter.DigestArray.write([], str(tmp_path / "none"))
    assert url_filter.DigestArray(str(tmp_path / "none")).match(pa.array(["a.com"]), pa.array(["/"])).tolist() == [-1]


@pytest.mark.parametrize("way", ["handed out", "joined"])
def test_url_rules_equal_brute_force(spark, way):
    rng = random.Random(7)
    label = lambda: rng.choice(["a", "b", "bb", "é", "x-y", "com", "net"])
    hosts = lambda n: ".".join(label() for _ in range(rng.randint(0, n)))
    paths = lambda: "".join(rng.choice(["/", "a", "b", "é", "/en/"]) for _ in range(rng.randint(0, 5)))
    rules = list({(hosts(3), paths()): rng.choice(["block", "allow"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules if h]
    urls = [f"http://{hosts(5)}{'/' + paths() if rng.random() < 0.9 else ''}{rng.choice(['', '?q', '#f'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://" + "." * 50_000 + "com/en/", "http://a.com/" + "a" * 100_000, "http://" + "a." * 30_000 + "net"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string").repartition(3)
    got = url_filter.judge(df, rules, default="none", most_bytes=1 << 30 if way == "handed out" else 0).collect()
    assert len(got) == len(urls)
    for r in got:
        best = plain_rule(r.host, r.path, rules)
        assert (r.rule, r.verdict) == ((best[0] + best[1], best[2]) if best else (None, "none")), r
    assert url_filter.judge(df.where("false"), rules).collect() == []
    of_table = spark.createDataFrame(rules + [(None, "/", "block")], url_filter.RULES)
    again = {r.page_id: r.rule for r in url_filter.judge(df, of_table).collect()}
    assert again == {r.page_id: r.rule for r in got}
    assert {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<|start|>", "<|end|>", "<<SYS>>", "<\\s>", "\\", "\\\\", "<|end|>\n", "\n", "plain words here", "é 👍", "assistant"]


def test_chat_round_trip_and_windows(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool", None, "<|end|>"])
            text = None if rng.random() < 0.05 else " ".join(rng.choices(CONTROL, k=rng.randint(0, 20)))
            rows.append((conv, turn, role, text, "clash"))
    rows += [(99, 0, "user", "w " * 3000, "x"), (99, 1, "assistant", "a b", "x"), (None, 0, "user", "no id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, window_tokens=40, history_tokens=10)
    back = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(role, text) for _, role, text in own]
        assert back[conv].targets == [text for _, role, text in own if role == "assistant"]
    held_budget(windows.collect(), 40, 10)


def held_budget(windows, budget, history):
    """No window holds more than the budget, but for a single new turn that does; what it repeats fits too. Returns their tokens."""
    tokens = lambda s: len(s.split()) + 1
    sums = []
    for r in windows:
        parts = [tokens(chat_body(p)) for p in r.formatted.split("<|end|>\n")[:-1]]
        assert len(parts) == r.n_repeated + r.n_new and r.n_new >= 1 and sum(parts) == r.n_tokens
        system = r.n_repeated and r.formatted.startswith("<|start|>system\n")
        past = sum(parts[system : r.n_repeated])
        assert past <= history
        assert sum(parts) <= budget or (r.n_new == 1 and past == 0), (parts, r.n_repeated)
        sums.append(sum(parts))
    return sums


def test_turns_of_any_length_are_read_back_over_many_chapters(spark):
    """Turns of 1 to 1,000 tokens; conversations of 100,000 tokens; long turns between a border and short ones before it."""
    rng, rows = random.Random(21), []
    for conv in range(6):
        system = rng.choice((0, 1, 100, 300))
        lengths, total = [], 0
        while total < (100_000 if conv < 3 else 40_000):
            lengths.append(rng.choice((rng.randint(1, 1000), rng.randint(1, 130), rng.randint(1, 9))))
            total += lengths[-1]
        rows += [(conv, t, "system" if t == 0 and system else rng.choice(("user", "assistant", "assistant")), f"t{t} " + "w " * (n - 2) if n > 1 else "") for t, n in enumerate(lengths)]
    rows += [(7, t, ("user", "assistant")[t % 2], "a " * (n - 1)) for t, n in enumerate([100] * 326 + [68, 5, 200, 10, 20, 30, 40])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    back = {r.conv_id: r for r in chat.read_windows(chat.format_windows(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].targets == [text for role, text in own if role == "assistant"]
    held_budget(chat.format_windows(df).collect(), 512, 128)


def test_windows_are_full_and_hold_the_system_turn(spark):
    """A system turn of any length, turns of up to a tenth of the budget: 85 % of all windows but each conversation's last is used."""
    rng = random.Random(12)
    rows = []
    for conv, system in enumerate((0, 20, 150, 250, 300, 400, 2000)):
        rows.append((conv, 0, "system", "s " * system))
        rows += [(conv, t, rng.choice(["user", "assistant"]), "w " * rng.randint(0, 50)) for t in range(1, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for chapter in (64, 2):
        found = chat.format_windows(df).collect() if chapter == 64 else None
        if found is None:
            kept, chat.CHAPTER = chat.CHAPTER, chapter
            try:
                found = chat.format_windows(df).collect()
                back = {r.conv_id: r for r in chat.read_windows(chat.format_windows(df)).collect()}
            finally:
                chat.CHAPTER = kept
            for conv, r in back.items():
                assert [(t.role, t.text) for t in r.turns] == [(role, text) for c, _, role, text in rows if c == conv]
        held_budget(found, 512, 128)
        for conv, system in enumerate((0, 20, 150, 250, 300, 400, 2000)):
            own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.window)
            assert all(r.formatted.startswith("<|start|>system\n") == (system < 256 or r.window == 1) for r in own)
            if chapter == 64:
                middle = [r.n_tokens for r in own[1:-1]]
                assert sum(middle) >= 0.85 * 512 * len(middle), (system, middle[:5])
                assert any(r.n_repeated > (system < 256) for r in own)


def test_roles_with_line_ends_read_back(spark):
    rows = [(1, 0, "user\nnow", "a\nb"), (1, 1, "\\n", "\\n"), (1, 2, "x\\\n\\\\n\n", ""), (1, 3, "assistant\n", "not a target"), (1, 4, "\n<|end|>\n", "\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_windows(chat.format_windows(df)).first()
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for *_, r, t in rows] and back.targets == []


def chat_body(part):
    return part.split("\n", 1)[1]


def test_escaping_is_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["<", "\\", "|", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "|end|>", "a"], k=rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape("t").alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>"))


def test_chat_of_an_empty_table(spark):
    assert chat.chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("name", ["op5_source_mixing", "op9_chat_windows"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
