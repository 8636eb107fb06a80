import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import privacy
from emberlog.functions.identifiers import WEIGHTS, identifiers
from emberlog.operators import alerts, chains, correlate, incidents, insight, query, rules, search
from emberlog.sources import logs as log_table

SCHEMA = "id string, timestamp timestamp_ntz, source string, host string, level string, message string, fields string, raw string, pack string, seq long"
START = datetime(2026, 4, 9, 10)


def entry(seq, pack="nginx", source="access", level="info", message="", fields="{}", raw="", seconds=0.0):
    return (f"{seq:06d}", START + timedelta(seconds=seconds), source, "h", level, message, fields, raw, pack, seq)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(spark, fields="{}", raw="", message=""):
    return spark.createDataFrame([(fields, raw, message)], "fields string, raw string, message string").select(identifiers().alias("x")).first().x


def test_identifiers(spark):
    assert ids_of(spark, '{"client_ip":"10.0.0.1:80","Script":"/a.php","remote_user":"-","user_agent":"curl","trace_id_x":"t1","my_session":"s1","unit":"u","pid":12,"status":200,"host":"web"}') == sorted(["ip=10.0.0.1:80", "uri=/a.php", "user=curl", "request_id=t1", "session_id=s1", "unit=u", "pid=12"])
    assert ids_of(spark, '{"pid":"12","procid":7,"request_id":5,"user":"","path":["/x"],"url":null}') == ["pid=7"]
    assert ids_of(spark, raw="from 192.168.1.9 and 127.0.0.1", message="0.0.0.0 999.1.1.1 1.2.3.4.5") == ["ip=1.2.3.4", "ip=192.168.1.9", "ip=999.1.1.1"]
    assert ids_of(spark, message="X-Request-ID: abcdef12-34 session_id=A_b-12345678 trace-id=short") == ["request_id=abcdef12-34", "session_id=A_b-12345678"]
    assert ids_of(spark, fields="not json", message="") == [] and ids_of(spark, fields=None, raw=None, message=None) == []


def found(spark, rows, window=2, least=0.3, **more):
    return correlate.correlate(table(spark, rows), window_seconds=window, least=least, **more).collect()


def test_correlation_by_address(spark):
    got = found(spark, [entry(1, level="error", fields='{"client_ip":"10.0.0.1"}'), entry(2, "php-fpm", "error", "error", fields='{"client_ip":"10.0.0.1"}', seconds=0.5)])
    assert [(r.entry_ids, r.correlation_type, r.description) for r in got] == [(["000001", "000002"], "request_chain", "php-fpm/error <-> nginx/access via ip=10.0.0.1")]
    assert abs(got[0].confidence - 0.5 * 0.875 * 1.2 * 1.1) < 1e-9


def test_what_is_no_correlation(spark):
    ip = '{"client_ip":"10.0.0.1"}'
    assert found(spark, [entry(1, fields=ip), entry(2, fields=ip)]) == []
    assert found(spark, [entry(1, fields=ip), entry(2, "mysql", fields=ip, seconds=10)]) == []
    assert found(spark, [entry(1, fields='{"unit":"x"}'), entry(2, "mysql", fields='{"unit":"x"}')], least=0.0) == []
    assert len(found(spark, [entry(1, fields=ip), entry(2, "mysql", fields=ip, seconds=2)], least=0.0)) == 1
    assert found(spark, []) == []


def test_request_ids_and_the_default_threshold(spark):
    rows = [entry(1, fields='{"request_id":"r"}'), entry(2, "php-fpm", "error", fields='{"request_id":"r"}', seconds=1)]
    assert [r.correlation_type for r in found(spark, rows, least=0.7)] == ["request_chain"]
    assert found(spark, [entry(1, fields='{"client_ip":"1.1.1.1"}'), entry(2, "mysql", level="fatal", fields='{"client_ip":"1.1.1.1"}')], least=0.7) == []


def sequential(rows, window, least, cap):
    """One entry at a time against a buffer, as a program without Spark would do it."""
    buffer, out = [], {}
    for r, ids in rows:
        buffer = [b for b in buffer if b[0][1] >= r[1] - timedelta(seconds=window)]
        for b, b_ids in buffer if ids else []:
            shared = ids & b_ids
            if not shared or (b[8], b[2]) == (r[8], r[2]):
                continue
            score = sum(WEIGHTS[m.split("=")[0]] for m in shared) * (0.5 + 0.5 * (1 - abs((r[1] - b[1]).total_seconds()) / window))
            score *= (1.2 if b[8] != r[8] else 1) * (1.1 if {r[4], b[4]} & {"error", "fatal"} else 1)
            if min(1.0, score) >= least:
                out[b[0], r[0]] = min(1.0, score)
        buffer.append((r, ids))
        buffer = buffer[-cap:]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_correlation_equals_a_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0, 0.25, 0.5, 1])
        keys = {"client_ip": f"10.0.0.{rng.randrange(4)}", "uri": f"/{rng.randrange(5)}", "user": f"u{rng.randrange(6)}", "session": f"s{rng.randrange(9)}", "request_id": f"r{rng.randrange(20)}"}
        own = {k: v for k, v in keys.items() if rng.random() < 0.3}
        kinds = {"client_ip": "ip", "session": "session_id"}
        fields = "{" + ",".join(f'"{k}":"{v}"' for k, v in own.items()) + "}"
        rows.append((entry(i, rng.choice(["nginx", "mysql"]), rng.choice(["a", "b"]), rng.choice(["info", "error"]), fields=fields, seconds=at), {f"{kinds.get(k, k)}={v}" for k, v in own.items()}))
    want = sequential(rows, 5, 0.5, 20)
    got = {tuple(r.entry_ids): r.confidence for r in found(spark, [r for r, _ in rows], window=5, least=0.5 - 1e-12, newest=20)}
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_timeline(spark):
    logs = table(spark, [entry(1, fields='{"request_id":"r"}', message="a"), entry(2, "mysql", fields='{"request_id":"r"}', message="b")])
    assert [(r.place, r.message) for r in correlate.timeline(correlate.correlate(logs), logs).orderBy("place").collect()] == [(1, "a"), (2, "b")]


def holds(spark, fields, *condition):
    return spark.createDataFrame([(fields,)], "fields string").select(rules.Condition(*condition).holds().alias("x")).first().x


def test_conditions(spark):
    f = '{"status":502,"ok":true,"text":"abc","n":"10","nested":{"a":1},"none":null}'
    yes = [("status", "gte", "500"), ("status", "eq", "502"), ("status", "neq", "200"), ("ok", "eq", "true"), ("text", "contains", "b"), ("n", "gt", "9"), ("text", "gt", "ab"), ("text", "lte", "abc")]
    no = [("status", "lt", "502"), ("status", "eq", "502.0"), ("gone", "neq", "x"), ("nested", "neq", "x"), ("none", "neq", "x"), ("text", "contains", "B"), ("text", "gt", "b"), ("n", "lt", "9")]
    assert all(holds(spark, f, *c) is True for c in yes) and all(holds(spark, f, *c) is False for c in no)


def test_rule_pairs(spark):
    rule = rules.parse_rule("r", "WHEN nginx.status >= 500 WITHIN 2s CORRELATE php-fpm")
    logs = table(spark, [entry(1, fields='{"status":502}'), entry(2, fields='{"status":200}'), entry(3, "php-fpm", seconds=2), entry(4, "php-fpm", seconds=-2), entry(5, "php-fpm", seconds=2.001)])
    assert sorted(r.target_id for r in rule.pairs(logs).collect()) == ["000003", "000004"]


def chain(spark, rows, **more):
    df = table(spark, rows).withColumn("g", F.lit(1))
    return [r.asDict(recursive=True) for r in chains.detect(df, ["g"], order="seq", **more).collect()]


def test_known_chains(spark):
    [c] = chain(spark, [entry(1, "php-fpm", "error", "error", "timeout"), entry(2, "nginx", "error", "error", "got 502 from upstream", seconds=1), entry(3, message="fine")])
    assert (c["name"], c["severity"], c["root_cause"], [e["role"] for e in c["entries"]]) == ("502_chain", "error", "php-fpm/error: timeout", ["root_cause", "symptom"])
    [c] = chain(spark, [entry(1, "systemd", "journal", "fatal", "Out Of Memory: killed"), entry(2, "systemd", "journal", "info", "service restarted", seconds=1)])
    assert (c["name"], c["severity"]) == ("oom_chain", "fatal")
    [c] = chain(spark, [entry(1, "syslog", "auth", "warn", "Failed password for root")])
    assert (c["name"], [e["role"] for e in c["entries"]]) == ("auth_bruteforce", ["root_cause"])
    overload = [entry(1, "mysql", "error", "error", "Too many connections"), entry(2, "php-fpm", "error", "error", "x", seconds=1), entry(3, "nginx", "error", "error", "502", seconds=2)]
    assert chain(spark, overload)[0]["name"] == "502_chain" and chain(spark, overload, specific_first=True)[0]["name"] == "mysql_overload"


def test_generic_and_no_chains(spark):
    assert chain(spark, [entry(1, message="all is well")]) == [] and chain(spark, []) == []
    [c] = chain(spark, [entry(1, "a", level="error", message="x", seconds=1), entry(2, "b", level="info", seconds=2), entry(3, "c", level="fatal", seconds=3)])
    assert (c["name"], c["severity"], c["root_cause"], c["entries"]) == ("generic_chain", "fatal", None, None)
    rows = table(spark, [entry(1, "a", level="error", message="x", seconds=1), entry(2, "b", level="info", seconds=2), entry(3, "c", level="fatal", seconds=3)]).withColumn("g", F.lit(None).cast("int"))
    assert [(r.entry_id, r.role) for r in chains.members(rows, ["g"], order="seq").orderBy("entry_id").collect()] == [("000001", "root_cause"), ("000002", "intermediate"), ("000003", "symptom")]
    df = table(spark, [entry(1), entry(2)]).withColumns({"g": F.lit(1), "n": F.lit(2)})
    assert chains.detect(df, ["g"], correlations="n").first().name == "generic_chain"


def test_alerts(spark):
    a = alerts.parse_alert("x", "count(message contains 'Started' AND unit = same) > 3 in 5m")
    assert (a.by, a.threshold, a.window, [c.value for c in a.conditions]) == (["unit"], 3.0, "5 minutes", ["Started"])
    assert alerts.parse_alert("x", "sum(a) > 3 in 5m") is None and alerts.parse_alert("x", "count(a ~ b) > 3 in 5m") is None
    from emberlog.sources.packs import BUILT_IN

    assert all(alerts.parse_alert(x.name, x.condition) for p in BUILT_IN.values() for x in p.alerts)
    rows = [entry(i, message="Started it", fields=f'{{"unit":"u{i % 2}"}}', seconds=i) for i in range(9)]
    assert [(r.unit, r.value) for r in a.fired(table(spark, rows)).orderBy("unit").collect()] == [("u0", 5.0), ("u1", 4.0)]
    fired = spark.createDataFrame([("a", START + timedelta(minutes=m)) for m in (0, 1, 2, 20)], "alert string, window_start timestamp_ntz")
    assert sorted(r.window_start for r in alerts.with_cooldown(fired, 300).collect()) == [START, START + timedelta(minutes=20)]
    steady = spark.createDataFrame([("a", START + timedelta(minutes=m), u, 1.0 + m) for m in range(60) for u in ("u", None)] + [("b", START, "u", 9.0)], "alert string, window_start timestamp_ntz, unit string, value double")
    kept = alerts.with_cooldown(steady, 300)
    assert kept.columns == steady.columns and kept.where("alert = 'a' AND unit = 'u'").count() == kept.where("alert = 'a' AND unit IS NULL").count() == 12 and kept.count() == 25
    assert all(r.value == 1.0 + (r.window_start - START).seconds / 60 for r in kept.where("alert = 'a'").collect())


def test_table_of_entries(spark, tmp_path):
    path = f"{tmp_path}/logs"
    old = [entry(i, seconds=-86400 * 60) for i in (1, 2)] + [entry(3, seconds=-86400 * 30 - 5), entry(4, seconds=-86400 * 30), entry(5), entry(6, seconds=1)]
    assert log_table.append(table(spark, old).drop("seq"), path)
    more = table(spark, [entry(7, seconds=2)]).drop("seq")
    assert log_table.append(more, path, batch="s-1") and not log_table.append(more, path, batch="s-1")
    assert log_table.read(spark, path).count() == 7 and log_table.read(spark, path).columns == [*log_table.COLUMNS, "day"]
    assert query.table_bytes(spark, path).first().bytes > 0
    assert query.apply_retention(spark, path, 30, START) == 3
    assert sorted(r.id for r in log_table.read(spark, path).collect()) == ["000004", "000005", "000006", "000007"]
    assert query.apply_retention(spark, path, 30, START) == 0
    assert [r.id for r in query.tail(log_table.read(spark, path), 2).collect()] == ["000006", "000007"]
    folders = [str(p) for p in tmp_path.glob("logs/batch=*/at=*/day=*")]
    assert not any(f"day={(START - timedelta(days=60)).date()}" in f for f in folders) and len(log_table.marks(spark, path)) == 1


class Stopped(BaseException):
    pass


def test_writers_and_retention_in_any_order_stopped_at_any_step(spark, tmp_path, monkeypatch):
    """A list in memory and the table agree after every step: appends, repeated batches, retention, each also stopped in its middle."""
    rng, path, want = random.Random(4), f"{tmp_path}/logs", {}
    real = {name: getattr(log_table, name) for name in ("_commit", "mark")}
    n, days = 0, 30
    for step in range(24):
        now = START + timedelta(days=rng.randint(0, 3))
        kind = rng.choice(("append", "append", "again", "retain", "stopped append", "stopped retain", "during"))
        rows = [entry(n + i, seconds=-86400 * rng.randint(26, 36) + rng.randint(-5, 5)) for i in range(3)]
        n += 3
        fresh = {r[0]: r[1] for r in rows}
        frame = table(spark, rows).drop("seq")
        if kind == "append":
            assert log_table.append(frame, path, batch=f"b-{step}")
            want |= fresh
        elif kind == "again":
            assert log_table.append(frame, path, batch=f"b-{step}") and not log_table.append(frame, path, batch=f"b-{step}")
            want |= fresh
        elif kind == "stopped append":
            monkeypatch.setattr(log_table, "_commit", lambda *a: (_ for _ in ()).throw(Stopped))
            with pytest.raises(Stopped):
                log_table.append(frame, path, batch=f"b-{step}")
            monkeypatch.setattr(log_table, "_commit", real["_commit"])
            assert log_table.append(frame, path, batch=f"b-{step}")
            want |= fresh
        elif kind == "during" and want:
            # entries come between what retention counts and what it marks, all of them new enough
            late = table(spark, [entry(n, seconds=86400 * 5)]).drop("seq")

            def mark(*a, late=late, step=step):
                log_table.append(late, path, batch=f"late-{step}")
                real["mark"](*a)

            monkeypatch.setattr(log_table, "mark", mark)
            gone = query.apply_retention(spark, path, days, now)
            monkeypatch.setattr(log_table, "mark", real["mark"])
            left = {k: v for k, v in want.items() if v >= now - timedelta(days=days)}
            assert gone == len(want) - len(left)
            want = left
            if log_table.exists(spark, f"{path}/batch=late-{step}"):
                want[entry(n)[0]] = START + timedelta(days=5)
            n += 1
        elif want:
            if kind == "stopped retain":
                monkeypatch.setattr(log_table, "mark", lambda *a: (_ for _ in ()).throw(Stopped))
                try:
                    query.apply_retention(spark, path, days, now)
                except Stopped:
                    pass
                monkeypatch.setattr(log_table, "mark", real["mark"])
            left = {k: v for k, v in want.items() if v >= now - timedelta(days=days)}
            assert query.apply_retention(spark, path, days, now) == len(want) - len(left)
            want = left
        if want or log_table.exists(spark, path):
            assert {r.id: r.timestamp for r in log_table.read(spark, path).collect()} == want, (step, kind)


def test_search_takes_wildcards_and_cases(spark):
    logs = table(spark, [entry(1, message="Alpha_1"), entry(2, message="AlphaX1"), entry(3, message=None)])
    ids = lambda **q: sorted(r.id for r in query.LogQuery(**q).run(logs).collect())
    assert ids(search="a_1") == ["000001", "000002"] and ids(search="alpha") == [] and ids(search="A%1") == ["000001", "000002"]
    assert ids(level_min="garbage") == ["000001", "000002", "000003"] and ids(level_min="warn") == []
    s = query.stats(logs).first()
    assert (s.total, s.by_source[0].n) == (3, 3) and query.stats(logs.where("false")).first().total == 0


def test_masking(spark):
    texts = ["write to a.b@c.example or +49 (30) 123-456 from 10.0.0.1.", "no data", "", None, "x@y.de x@y.de", "1.2.3.4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = lambda how, **more: [r.m for r in df.select(privacy.mask("t", how, **more).alias("m")).collect()]
    assert shown("redact") == ["write to [email] or [phone] from [ip].", "no data", "", None, "[email] [email]", "[ip]"]
    assert shown("redact", kinds=("ip",))[4] == "x@y.de x@y.de"
    hashed, other = shown("hash", key="a"), shown("hash", key="b")
    a, b = hashed[4].split(" ")
    assert a == b and len(a) == 16 and a not in other[4] and hashed[1:4] == ["no data", "", None]
    assert shown("pseudonymize")[5] != shown("pseudonymize", key="k")[5] and shown("pseudonymize")[5].startswith("ip-") and shown("pseudonymize")[0].endswith(".") and "10.0.0.1" not in shown("pseudonymize")[0]


MASKED = [
    ("version 1.2.3.4 and v1.2.3.4, Release: 1.2.3.4", "version 1.2.3.4 and v1.2.3.4, Release: 1.2.3.4"),
    ("nov 10.0.0.1, conversion 10.0.0.1", "nov [ip], conversion [ip]"),
    ("10.0.0.1 10.0.0.2,10.0.0.3:8080 client=255.255.255.255", "[ip] [ip],[ip]:8080 client=[ip]"),
    ("256.1.1.1 1.2.3 1.2.3.4.5 1.2.3.4444", "256.1.1.1 1.2.3 1.2.3.4.5 1.2.3.4444"),
    ("from fe80::1 and ::1 and 2001:db8::8a2e:370:7334.", "from [ipv6] and [ipv6] and [ipv6]."),
    ("[2001:db8:0:0:0:0:0:1]:443", "[[ipv6]]:443"),
    ("std::vector a::b :: at 12:30:45 00:1b:44:11:3a:b7 1:2:3:4:5:6:7:8:9", "std::vector a::b :: at 12:30:45 00:1b:44:11:3a:b7 1:2:3:4:5:6:7:8:9"),
    ("call 555-123-4567 or (030) 123 4567 or 555.123.4567.", "call [phone] or [phone] or [phone]."),
    ("order 1555-123-4567, id-555-123-45678, 2024-01-03 10:00", "order 1555-123-4567, id-555-123-45678, 2024-01-03 10:00"),
    ("10.0.0.1\n", "[ip]\n"),
]


def test_masking_heeds_what_stands_around(spark):
    import duckdb

    from emberlog.plans import catalogue

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MASKED)], "doc_id int, t string")
    assert [r.m for r in df.orderBy("doc_id").select(privacy.mask("t").alias("m")).collect()] == [m for _, m in MASKED]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(MASKED)])
    assert [r[0] for r in db.sql(f"SELECT text FROM ({catalogue.ORACLES['mask_redact']}) ORDER BY doc_id").fetchall()] == [m for _, m in MASKED]


def test_masking_a_long_text(spark):
    """Time grows with the text, not with the square of its finds."""
    text = "10.0.0.1 and 1.2.3 " * 50_000
    [r] = spark.createDataFrame([(text,)], "t string").select(privacy.mask("t").alias("m")).collect()
    assert r.m == "[ip] and 1.2.3 " * 50_000


def test_spikes_and_forms_of_errors(spark):
    hours = [4, 5, 4, 5, 20, 4, 1]
    rows = [entry(100 * h + i, level="error", message=f"failed {i} at 10.0.0.{i} id deadbeef{i:02}", seconds=3600 * h + i) for h, n in enumerate(hours) for i in range(n)]
    logs = table(spark, rows)
    got = insight.spikes(insight.volumes(logs), least=3).orderBy("window_start").collect()
    assert [(r.kind, r.n, r.usual) for r in got] == [("spike", 20, 4.5), ("drop", 1, 7.0)]
    [g] = insight.error_groups(logs).collect()
    assert (g.form, g.n, g.first_seen) == ("failed <n> at <ip> id <id>", sum(hours), START)
    assert insight.error_groups(logs.where("false")).collect() == [] and insight.spikes(insight.volumes(logs.where("false"))).collect() == []


def test_templates_of_messages(spark):
    """Labelled messages of nine templates with names, hosts and paths in words: over 95 % are in a cluster of their own kind, however rows lie."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    kinds = [
        lambda: f"connect to {word()} failed", lambda: f"user {word()} logged in from {word()}", lambda: f"user {word()} logged out", lambda: f"disk /{word()}/{word()} is full at {rng.randint(1, 99)} %",
        lambda: f"timeout after {rng.random():.3f} s calling {word()} for request {rng.getrandbits(64):016x}", lambda: "out of memory", lambda: "restart requested", lambda: f"job {word()} of queue {word()} ended with code {rng.randint(0, 255)}",
        lambda: f"cache miss for key {word()}:{rng.randint(1, 10**6)} on 10.0.{rng.randint(0, 255)}.7",
    ]
    rows, label = [], {}
    for i in range(1500):
        kind = rng.randrange(len(kinds))
        rows.append(entry(i, message=kinds[kind](), level="error"))
        label[rows[-1][5]] = kind
    logs = table(spark, rows)
    forms = logs.select("pack", "message", insight.words_of("message").alias("words"))

    def named(n):
        told = forms.repartition(n).join(insight.templates(forms.repartition(n).select("pack", "words").distinct(), ["pack"]), ["pack", "words"])
        return {r.message: " ".join(r.template) for r in told.collect()}

    got = named(1)
    assert got == named(7)
    by_template = {}
    for m, t in got.items():
        by_template.setdefault(t, []).append(label[m])
    right = sum(max(x.count(k) for k in set(x)) for x in by_template.values())
    assert right == len(got) and len(by_template) == len(kinds), sorted(by_template)
    found = insight.clusters(logs).collect()
    assert len(found) == 9 and sum(r.n for r in found) == 1500
    assert {r.template for r in insight.clusters(table(spark, [entry(1, message="connect to alpha failed"), entry(2, message="connect to beta failed"), entry(3, message="DEADBEEF01 gone"), entry(4, message="0a1b2c3d4e gone"), entry(5, message=None)])).collect()} == {"connect to <*> failed", "<*> gone", ""}
    more = [entry(2000 + i, message=f"certificate of {word()} has expired") for i in range(5)] + [entry(3000 + i, message=kinds[0]()) for i in range(5)]
    assert [(r.template, r.n) for r in insight.new_clusters(logs, table(spark, more)).collect()] == [("certificate of <*> has expired", 5)]
    assert insight.clusters(logs.where("false")).collect() == []


def test_hours_out_of_the_ordinary(spark):
    """Ten weeks of hours: busy by day and silent by night; then a silence, a spike, a drop and entries at night are told."""
    rows, odd = [], {(20 * 24 + 12): 0, (21 * 24 + 13): 60, (22 * 24 + 14): 3, (23 * 24 + 2): 9}
    for h in range(70 * 24):
        usual = 20 + h % 3 if 8 <= h % 24 < 18 else 0
        rows += [("p", "s", datetime(2026, 3, 2) + timedelta(hours=h), odd.get(h, usual))] if odd.get(h, usual) else []
    counted = spark.createDataFrame(rows, "pack string, source string, window_start timestamp_ntz, n long")
    series = insight.filled(counted)
    assert series.count() == (max(r[2] for r in rows) - min(r[2] for r in rows)).total_seconds() / 3600 + 1
    told = {int((r.window_start - datetime(2026, 3, 2)).total_seconds() // 3600): r.kind for r in insight.anomalies(series, insight.baseline(series)).collect()}
    assert told == {20 * 24 + 12: "silence", 21 * 24 + 13: "spike", 22 * 24 + 14: "drop", 23 * 24 + 2: "unusual"}
    # a baseline that is kept tells the same of new hours
    kept = insight.baseline(series.where("window_start < '2026-03-22'"))
    later = {r.kind for r in insight.anomalies(series.where("window_start >= '2026-03-22' AND window_start < '2026-03-30'"), kept, least_seen=2).collect()}
    assert later == {"silence", "spike", "drop", "unusual"}
    assert insight.anomalies(series.where("false"), insight.baseline(series)).collect() == [] and insight.filled(counted.where("false")).collect() == []


def test_searches_leave_out_files_and_no_row(spark, tmp_path):
    """Random words in many files: the same rows as the scan for any pattern; a word of one file leaves most of the others out."""
    rng, path, texts = random.Random(3), f"{tmp_path}/logs", []
    for b in range(12):
        rows = [entry(100 * b + i, message=" ".join("".join(rng.choices("abcdefghij äß", k=rng.randint(1, 9))) for _ in range(4)) + f" only{b:02}x", seconds=86400 * (b % 3)) for i in range(20)] + [entry(100 * b + 99, message=None)]
        texts += [r[5] for r in rows if r[5]]
        log_table.append(table(spark, rows).drop("seq").coalesce(1), path, batch=f"b-{b}")
        if b == 9:
            assert search.update(spark, path) == 10 and search.update(spark, path) == 0
    whole = log_table.read(spark, path)
    skipped = {}
    for pattern in ("only03x", "only0_x", "ab", "%", "a%only11x", "nowhere", *rng.sample([t[3:12] for t in texts], 5), "a\\_b"):
        wanted = query.LogQuery(search=pattern, limit=1000)
        found, files, skipped[pattern] = search.table(spark, path, pattern)
        assert sorted(r.id for r in wanted.run(found).collect()) == sorted(r.id for r in wanted.run(whole).collect()), pattern
        assert sorted(r.id for r in search.run(spark, path, wanted).collect()) == sorted(r.id for r in wanted.run(whole).collect())
    # the entry without a message lies on the first day: in eight of the batches it is a file of its own, that has no bitmap
    assert files == 12 + 8 and skipped["only03x"] == 9 and skipped["nowhere"] == 10 and skipped["ab"] == skipped["%"] == 0 and skipped["a\\_b"] == 0
    query.apply_retention(spark, path, 30, START + timedelta(days=31))
    query.apply_retention(spark, path, 30, START + timedelta(days=31))
    assert search.run(spark, path, query.LogQuery(search="only02x")).count() == 20 and search.run(spark, path, query.LogQuery(search="only03x")).count() == 0


def test_incidents(spark):
    """Random correlations: the connected ones by search; chains of each; sessions against a walk in order."""
    rng = random.Random(7)
    pairs = [(f"{a:06d}", f"{b:06d}") for a, b in (rng.sample(range(80), 2) for _ in range(45))] + [("000090", "000090"), ("000091", None)]
    found = spark.createDataFrame([(list(p),) for p in pairs], "entry_ids array<string>")
    near = {}
    for a, b in pairs:
        if b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return min(seen)

    assert {r.entry_id: r.incident for r in incidents.connected(found).collect()} == {a: reach(a) for a in near}
    assert incidents.connected(found.where("false")).collect() == []
    logs = table(spark, [entry(i, pack=rng.choice(("nginx", "mysql")), level=rng.choice(("info", "error")), seconds=rng.randint(0, 5000)) for i in range(80)])
    made = incidents.of_correlations(logs, found.where("entry_ids[1] IS NOT NULL")).collect()
    assert {r.entry_id for r in made} <= set(near) and all(reach(r.entry_id) == r.incident for r in made)
    want, last = {}, {}
    for r in sorted(logs.collect(), key=lambda r: r.timestamp):
        if r.pack not in last or (r.timestamp - last[r.pack][1]).total_seconds() >= 300:
            last[r.pack] = (r.timestamp, r.timestamp)
        last[r.pack] = (last[r.pack][0], r.timestamp)
        n, e = want.get((r.pack, last[r.pack][0]), (0, 0))[:2]
        want[r.pack, last[r.pack][0]] = (n + 1, e + (r.level == "error"))
    assert {(r.pack, r.began): (r.n, r.errors) for r in incidents.sessions(logs, ["pack"]).collect()} == want
