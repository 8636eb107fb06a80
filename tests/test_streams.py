import dataclasses
import http.client
import json
import os
import random
import socket
import subprocess
import sys
import threading
import time
import urllib.request

from pyspark.sql import functions as F

from emberlog.config import Config
from emberlog.operators import alerts, parsers
from emberlog.sources import lines, packs, receivers
from emberlog.sources import logs as log_table
from emberlog.streaming import pipeline

LINE = '10.0.0.1 - u [09/Apr/2026:10:15:{:02d} +0000] "GET /{} HTTP/1.1" 200 1 "-" "-"'


def test_ingest_stores_each_line_once_over_restarts(spark, tmp_path):
    logs, out, marks = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/marks"
    logs.mkdir()
    for batch in range(3):
        (logs / f"{batch}.log").write_text("\n".join([LINE.format(i, batch) + "  " for i in range(5)] + ["", "not a line of this kind"]))
        stream = lines.read(spark, [f"{logs}/*.log"], "nginx", "access", stream=True)
        pipeline.ingest(stream, packs.BUILT_IN, out, marks, once=True).awaitTermination()
        assert log_table.read(spark, out).count() == 5 * (batch + 1)
    assert log_table.read(spark, out).select("day").distinct().count() == 1
    assert log_table.read(spark, out).select("id").distinct().count() == 15


def test_read_of_all_packs(spark, tmp_path):
    for path in ("var/log/nginx/access.log", "var/log/syslog"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("a line\n\n")
    own = {"nginx": packs.Pack("nginx", "1.0.0", sources=[packs.BUILT_IN["nginx"].source("access")]), "syslog": packs.Pack("syslog", "1.0.0", sources=[packs.BUILT_IN["syslog"].source("syslog")])}
    own["nginx"].sources[0].paths, own["syslog"].sources[0].paths = ["/var/log/nginx/access.log"], ["/var/log/syslog"]
    assert sorted((r.pack, r.source, r.content) for r in lines.read_packs(spark, own, str(tmp_path)).collect()) == [("nginx", "access", "a line"), ("syslog", "syslog", "a line")]


def test_offsets_of_growing_files(tmp_path):
    path = str(tmp_path / "a.log")
    reader = lines._GrowingReader(f"{tmp_path}/*.log")
    new = lambda a, b: [x for p in reader.partitions(a, b) for x, *_ in reader.read(p)]
    start = reader.initialOffset()
    assert reader.latestOffset() == start
    with open(path, "w") as f:
        f.write("one  \n\ntwo\nunfini")
    first = reader.latestOffset()
    assert new(start, first) == ["one", "two"]
    with open(path, "a") as f:
        f.write("shed\n")
    second = reader.latestOffset()
    assert new(first, second) == ["unfinished"] and new(second, second) == []
    with open(path, "w") as f:
        f.write("cut\n")
    assert new(second, reader.latestOffset()) == ["cut"]
    os.rename(path, f"{path}.1")
    with open(path, "w") as f:
        f.write("longer than the one before it was\n" * 3)
    assert len(new(second, reader.latestOffset())) == 3
    with open(path, "wb") as f:
        f.write(b"x" * 200_000 + b"\n" + b"y" * 200_000)
    assert json.loads(reader.latestOffset()["files"])[path][1] == 200_001


def test_growing_files_as_a_stream(spark, tmp_path):
    logs, out, marks = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/marks"
    logs.mkdir()
    for batch in range(2):
        with open(logs / "access.log", "a") as f:
            f.write("".join(LINE.format(i, batch) + "\n" for i in range(4)))
        pipeline.ingest(lines.grow(spark, f"{logs}/*.log", "nginx", "access"), packs.BUILT_IN, out, marks, once=True).awaitTermination()
    got = log_table.read(spark, out)
    assert got.count() == 8 and got.select(F.get_json_object("fields", "$.uri")).distinct().count() == 2


def test_long_files_are_many_stretches(tmp_path, monkeypatch):
    """Each line is read once, by the stretch in which it begins, wherever the borders are."""
    (tmp_path / "sub1").mkdir()
    path = tmp_path / "sub1" / "a.log"
    rng = random.Random(0)
    text = ["x" * rng.randint(1, 40) + str(i) for i in range(400)]
    path.write_text("\n".join(text) + "\n")
    for size in (1, 7, 64, 5000, 1 << 20):
        monkeypatch.setattr(lines, "STRETCH", size)
        reader = lines._GrownReader(f"{tmp_path}/sub*/*.log")
        parts = reader.partitions()
        got = [x for p in parts for x in reader.read(p)]
        assert [t for t, *_ in got] == text and len(parts) == -(-path.stat().st_size // size)
        assert all(path.read_bytes()[at:].decode().startswith(t) for t, _, at in got)


def test_live_tail(spark, sf, tmp_path):
    at, shown = f"{tmp_path}/entries", []
    log_table.from_events(spark, sf).drop("seq").limit(10).write.parquet(at)
    entries = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)
    pipeline.live_tail(entries, f"{tmp_path}/marks", shown.append, at_once=8, once=True).awaitTermination()
    told = [json.loads(x) for x in shown]
    assert told.pop(0) == {"skipped": 2}
    assert len(told) == 8 and told == sorted(told, key=lambda e: (e["timestamp"], e["id"])) and told[0]["host"].startswith("host-")


def service(tmp_path):
    """Two packs under a root, one with entries of many lines."""
    php = packs.Pack("php-fpm", "1.0.0", sources=[dataclasses.replace(packs.BUILT_IN["php-fpm"].source("error"), paths=["/var/log/php*/php*-fpm.log"])])
    nginx = packs.Pack("nginx", "1.0.0", sources=[dataclasses.replace(packs.BUILT_IN["nginx"].source("access"), paths=["/var/log/nginx/access.log"])])
    for d in ("nginx", "php8"):
        (tmp_path / "var/log" / d).mkdir(parents=True)
    return {"php-fpm": php, "nginx": nginx}, Config(data_dir=str(tmp_path / "data"), window_seconds=5, min_confidence=0.1, entry_idle_ms=300)


def test_service_follows_all_packs_and_correlates(spark, tmp_path):
    """Appended lines, stack traces as one entry, a restart in between, and correlations stored."""
    own, config = service(tmp_path)
    for batch in range(2):
        with open(tmp_path / "var/log/nginx/access.log", "a") as f:
            f.write(LINE.format(batch, batch) + "\nno such line\n")
        with open(tmp_path / "var/log/php8/php8-fpm.log", "a") as f:
            f.write(f"[2026-04-09 10:15:0{batch}] ERROR: failed for 10.0.0.1 ({batch})\n  at one\n  at two\n")
        first, *_ = pipeline.follow(spark, own, config, root=str(tmp_path), once=True)
        assert pipeline.counters(first) == {"lines": 3, "entries": 2, "dropped": 1, "window_size": 0}
    got = log_table.read(spark, config.logs)
    assert {(r.pack, r.n) for r in got.groupBy("pack").agg(F.count("*").alias("n")).collect()} == {("nginx", 2), ("php-fpm", 2)}
    assert {r.raw.count("\n") for r in got.where("pack = 'php-fpm'").collect()} == {2} and all(len(r.id) == 26 for r in got.collect())
    found = spark.read.parquet(config.correlations)
    assert found.count() >= 2 and found.where("description NOT LIKE '%ip=10.0.0.1%'").count() == 0


def test_receivers_write_what_comes(spark, tmp_path):
    spool = receivers.Spool(tmp_path / "spool", "syslog", most_bytes=100)
    servers = [make(spool, "127.0.0.1", 0) for make in (receivers.udp, receivers.tcp, receivers.http)]
    receivers.listen(servers)
    try:
        for i in range(5):
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                s.sendto(f"<34>Oct 11 22:14:15 web sshd[{i}]: udp\n\n".encode(), servers[0].server_address)
            with socket.create_connection(servers[1].server_address) as s:
                s.sendall(f"<34>Oct 11 22:14:15 web cron: tcp {i}\n\nlast {i}".encode())
            urllib.request.urlopen(f"http://127.0.0.1:{servers[2].server_address[1]}/v1/logs", b'{"message":"http"}\n{"message":"two"}').read()
        deadline = time.time() + 20
        read = lambda: lines.grow(spark, f"{tmp_path}/spool/syslog-*.log", "p", "s", stream=False)
        while read().count() < 25 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        for s in servers:
            s.shutdown()
            s.server_close()
    got = [r.content for r in read().collect()]
    assert len(got) == 25 and sum("udp" in x for x in got) == 5 and sum(x.startswith("last") for x in got) == 5 and sum("http" in x for x in got) == 5
    assert len(list((tmp_path / "spool").iterdir())) > 1


def posted(server, send: bytes) -> int:
    """The status of an answer to some bytes, after which the sender says no more."""
    with socket.create_connection(server.server_address) as s:
        s.sendall(send)
        s.shutdown(socket.SHUT_WR)
        return int(s.makefile("rb").readline().split()[1])


def test_bodies_in_chunks_and_without_length(tmp_path, monkeypatch):
    spool = receivers.Spool(tmp_path, "otlp", most_bytes=1000)
    server = receivers.http(spool, "127.0.0.1", 0)
    receivers.listen([server])
    kept = lambda: [x for f in sorted(tmp_path.iterdir()) for x in f.read_text().splitlines()]
    try:
        chunks = http.client.HTTPConnection(*server.server_address)
        chunks.request("POST", "/v1/logs", body=iter([b'{"a":', b'1}\n{"b"', b":2}"]), encode_chunked=True, headers={"Transfer-Encoding": "chunked"})
        assert chunks.getresponse().status == 200 and kept() == ['{"a":1}', '{"b":2}']
        head = b"POST / HTTP/1.1\r\n"
        assert posted(server, head + b"\r\n") == 411
        assert posted(server, head + b"Content-Length: 100\r\n\r\n{}") == 400
        assert posted(server, head + b"Content-Length: many\r\n\r\n{}") == 400
        assert posted(server, head + b"Content-Length: 5000\r\n\r\n{}") == 413
        assert posted(server, head + b"Transfer-Encoding: chunked\r\n\r\n5\r\nab") == 400
        assert posted(server, head + b"Transfer-Encoding: chunked\r\n\r\nffff\r\nab") == 413
        assert posted(server, head + b"Content-Length: 0\r\n\r\n") == 200 and len(kept()) == 2

        def full(_):
            raise OSError("no space")

        monkeypatch.setattr(spool, "_keep", full)
        assert [posted(server, head + b"Content-Length: 2\r\n\r\n{}") for _ in range(2)] == [503, 503]
    finally:
        server.shutdown()
        server.server_close()
        spool.close()


LISTENER = """
import sys
from emberlog.sources import receivers
server = receivers.http(receivers.Spool(sys.argv[1], "otlp"), "127.0.0.1", 0)
print(server.server_address[1], flush=True)
server.serve_forever()
"""


def test_listeners_that_are_killed_lose_no_line_that_was_acknowledged(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    running = [subprocess.Popen([sys.executable, "-c", LISTENER, str(tmp_path)], stdout=subprocess.PIPE, text=True, cwd=root) for _ in range(2)]
    ports, told = [int(p.stdout.readline()) for p in running], []

    def send(k: int) -> None:
        for i in range(300):
            line = f'{{"message":"{k}-{i}"}}'
            try:
                urllib.request.urlopen(f"http://127.0.0.1:{ports[k % 2]}/", line.encode(), timeout=10).read()
            except (OSError, http.client.HTTPException):
                return
            told.append(line)

    senders = [threading.Thread(target=send, args=(k,)) for k in range(8)]
    try:
        for t in senders:
            t.start()
        while len(told) < 400:
            time.sleep(0.01)
        running[0].kill()
        for t in senders:
            t.join(60)
    finally:
        for p in running:
            p.kill()
            p.wait()
            p.stdout.close()
    files = list(tmp_path.iterdir())
    whole = [x for f in files for x in f.read_text().split("\n")[:-1]]
    assert len(files) == 2 and set(told) <= set(whole) and len(whole) == len(set(whole)) and len(told) >= 1200
    # a listener that comes back goes on beside these files
    again = receivers.Spool(tmp_path, "otlp")
    again.add(b"one\ntwo")
    again.close()
    assert len(list(tmp_path.iterdir())) == 3


def test_spools_of_one_name_keep_their_files_apart(tmp_path):
    spools = [receivers.Spool(tmp_path, "syslog", most_bytes=200) for _ in range(3)]
    senders = [threading.Thread(target=lambda s=s, k=k: [s.add(f"{k}-{i}".encode(), wait=i % 7 == 0) for i in range(200)]) for k, s in enumerate(spools)]
    for t in senders:
        t.start()
    for t in senders:
        t.join()
    for s in spools:
        s.close()
    kept = [x for f in sorted(tmp_path.iterdir()) for x in f.read_text().splitlines()]
    assert sorted(kept) == sorted(f"{k}-{i}" for k in range(3) for i in range(200))
    for k in range(3):
        assert sorted(x for x in kept if x.startswith(f"{k}-")) == sorted(f"{k}-{i}" for i in range(200))


def test_table_of_bad_rows_is_decoded_with_defaults(spark):
    rows = [("01ARZ3NDEKTSV4RRFFQ69G5FAV", "2026-04-09T10:00:00Z", "s", None, "WARNING", None, '{"a":1}', "r", "p"), ("short", "no time", None, "h", "?", "m", "[1]", None, None), (None,) * 9]
    table = spark.createDataFrame(rows, "id string, timestamp string, source string, host string, level string, message string, fields string, raw string, pack string")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    got = log_table.decoded(table, now).collect()
    assert got[0][0] == rows[0][0] and (got[0].level, got[0].message, got[0].fields, got[0].host) == ("warn", "", '{"a":1}', "")
    assert all(len(r.id) == 26 and r.level == "info" and r.fields == "{}" and r.timestamp.year == 2026 and r.timestamp.month == 1 for r in got[1:])
    assert log_table.decoded(table.select("message", F.lit(7).alias("timestamp"))).count() == 3


def until(query, **how):
    deadline = time.time() + 30
    while query.isActive and not pipeline.idle(query, **how) and time.time() < deadline:
        time.sleep(0.1)


TRACE = ["an old end", "[2026-04-09 10:15:00] ERROR: one", "  at a", "", "  at b", "[2026-04-09 10:15:01] ERROR: two", "[2026-04-09 10:15:02] ERROR: three", "  at c", "  at d", "  at e"]


def test_entries_of_many_lines_are_the_same_wherever_batches_end(spark, tmp_path):
    """A file cut into two batches at several places, and into five, over a restart each time."""
    own = {"php-fpm": packs.BUILT_IN["php-fpm"]}
    (tmp_path / "whole.log").write_text("\n".join(TRACE) + "\n")
    want = sorted(r.content for r in parsers.joined(lines.grow(spark, f"{tmp_path}/whole.log", "php-fpm", "error", stream=False), own).collect())
    assert len(want) == 4 and want[2].count("\n") == 3 and want[0].count("\n") == 2
    for n, cuts in enumerate([(k,) for k in range(1, len(TRACE))] + [(1, 3, 4, 8)]):
        at, out, marks = tmp_path / f"in{n}", f"{tmp_path}/out{n}", f"{tmp_path}/marks{n}"
        at.mkdir()
        if n % 3 and len(cuts) == 1:
            continue  # the other cuts: below, by the function alone
        for a, b in zip((0, *cuts), (*cuts, len(TRACE))):
            with open(at / "php.log", "a") as f:
                f.write("".join(f"{x}\n" for x in TRACE[a:b]))
            stream = lines.grow(spark, f"{at}/php.log", "php-fpm", "error")
            query = pipeline.write(parsers.joined_stream(stream, own, idle_ms=10**8), out, marks, flush="0 seconds")
            until(query, with_state=True)
            assert sum(s.numRowsTotal for s in query.lastProgress.stateOperators) == 1
            query.stop()
        # then a timer lets the last one go
        query = pipeline.write(parsers.joined_stream(lines.grow(spark, f"{at}/php.log", "php-fpm", "error"), own, idle_ms=1), out, marks, flush="0 seconds")
        with open(at / "php.log", "a") as f:
            f.write("[2026-04-09 10:15:09] ERROR: last\n")
        until(query)
        query.stop()
        assert sorted(r.content for r in spark.read.parquet(out).collect()) == sorted([*want, "[2026-04-09 10:15:09] ERROR: last"]), cuts


class State:
    """A group's state, in memory."""

    held, timer, hasTimedOut = None, None, False

    getOption = property(lambda self: self.held)  # noqa: N815

    def update(self, value):
        self.held = value

    def remove(self):
        self.held = None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timer = ms


def test_joining_by_state_equals_the_batch_at_any_cuts(spark, monkeypatch):
    """Random files, cut at random: the function of the state against joined_lines(), long entries cut into pieces too."""
    import pandas as pd

    own, caught = {"php-fpm": packs.BUILT_IN["php-fpm"]}, []
    frame = spark.createDataFrame([], "content string, file_path string, offset long, pack string, source string")
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", lambda self, f, *a: caught.append(f) or frame)
    parsers.joined_stream(frame, own, longest=60)
    rng = random.Random(8)
    for _ in range(8):
        rows, at = [], 0
        for i in range(rng.randint(1, 60)):
            text = rng.choice(("[2026] ERROR: x", "  at y", "  at " + "z" * rng.randint(1, 30)))
            rows.append((text, "f", at, "php-fpm", "error"))
            at += len(text) + 1
        whole = parsers.joined_lines(spark.createDataFrame(rows, frame.schema), packs.BUILT_IN["php-fpm"].source("error").multiline_start, number="offset", longest=60)
        want = sorted((r.offset, r.content) for r in whole.collect())
        for cuts in [sorted(rng.sample(range(len(rows) + 1), min(len(rows), k))) for k in (0, 1, 3, 10)]:
            state, got = State(), []
            for a, b in zip([0, *cuts], [*cuts, len(rows)]):
                if a < b:
                    part = rng.sample(rows[a:b], b - a)
                    got += [tuple(x) for made in caught[0](("f", "php-fpm", "error"), iter([pd.DataFrame(part, columns=frame.columns)]), state) for x in made[["offset", "content"]].itertuples(index=False)]
            state.hasTimedOut = True
            got += [tuple(x) for made in caught[0](("f", "php-fpm", "error"), iter([]), state) for x in made[["offset", "content"]].itertuples(index=False)]
            assert sorted(got) == want and state.held is None


def test_a_backlog_is_read_in_bounded_batches_over_a_restart(spark, tmp_path):
    rng, sizes = random.Random(2), []
    for name in "abc":
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i} " + "x" * rng.randint(0, 90) + "\n" for i in range(2000)))
    want = {f"{name}{i}" for name in "abc" for i in range(2000)}

    def run(most):
        stream = lines.grow(spark, f"{tmp_path}/*.log", "p", "s", max_bytes=20_000, progress=f"{tmp_path}/progress/one.json")
        query = stream.writeStream.foreachBatch(lambda b, n: seen.append((n, [(r.file_path, r.offset, r.content) for r in b.collect()]))).option("checkpointLocation", f"{tmp_path}/marks").start()
        deadline = time.time() + 60
        while len(seen) < most and time.time() < deadline and query.isActive:
            time.sleep(0.05)
        query.stop()

    seen = []
    run(4)
    run(9)
    run(40)
    batches = {}
    for n, rows in seen:
        assert batches.setdefault(n, rows) == rows
    sizes = [sum(len(c) + 1 for *_, c in rows) for rows in batches.values()]
    assert max(sizes) <= 20_000 + 200 and len(sizes) >= 15
    got = [x for n in sorted(batches) for x in batches[n]]
    assert len(got) == len(want) and {c.split()[0] for *_, c in got} == want
    for name in "abc":
        own = [at for f, at, _ in got if f.endswith(f"{name}.log")]
        assert own == sorted(own)


def test_alerts_of_a_stream_are_those_of_the_table(spark, sf, tmp_path):
    """In order of time and with late ones within the watermark, in many batches, cooldowns across batches."""
    logs = log_table.from_events(spark, sf).select(*log_table.COLUMNS)
    mine = {
        "php-fpm": packs.Pack("php-fpm", "1.0.0", alerts=[packs.Alert("many", "count(status >= 500) > 0 in 1h", severity="critical", cooldown="5h"), packs.Alert("status", "avg(status) >= 502 in 6h"), packs.Alert("none", "states none")]),
        "nginx": packs.Pack("nginx", "1.0.0", alerts=[packs.Alert("same", "count(message contains 'view' AND remote_user = same) > 0 in 1h", cooldown="1d")]),
    }
    rows = sorted(logs.collect(), key=lambda r: r.timestamp)
    rng, path = random.Random(1), f"{tmp_path}/entries"
    late = [(r.timestamp.timestamp() + rng.uniform(0, 3000), r) for r in rows]
    rows = [r for _, r in sorted(late, key=lambda x: x[0])]
    size = -(-len(rows) // 6)
    end = rows[-1].asDict() | {"id": "end", "timestamp": rows[-1].timestamp.replace(year=2030), "pack": "other"}
    parts = [rows[k : k + size] for k in range(0, len(rows), size)] + [[tuple(end[c] for c in log_table.COLUMNS)]]
    for part in parts:
        log_table.append(spark.createDataFrame(part, logs.schema), path)
        pipeline.firings(log_table.read(spark, path, stream=True), mine, f"{tmp_path}/fired", f"{tmp_path}/marks", late="3600 seconds", once=True).awaitTermination()
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("alert", "pack", "severity", "window_start", "groups", "value").collect())
    got, want = key(pipeline.fired(spark, f"{tmp_path}/fired")), key(alerts.of_packs(log_table.read(spark, path), mine))
    assert got == want and len(want) > 20 and len({r[0] for r in want}) == 3


def test_the_service_fires_alerts_pairs_rules_and_retains(spark, tmp_path):
    own, config = service(tmp_path)
    own["nginx"].alerts, own["nginx"].correlations = [packs.Alert("hits", "count(status = 200) > 1 in 1m")], [packs.Correlation("php-fpm", ["timestamp"], "30s")]
    with open(tmp_path / "var/log/php8/php8-fpm.log", "a") as f:
        f.write("[2026-04-09 10:15:05] ERROR: failed\n  at one\n")
    with open(tmp_path / "var/log/nginx/access.log", "a") as f:
        f.write(LINE.format(1, 1) + "\n" + LINE.format(2, 1) + "\n")
    running = pipeline.follow(spark, own, config, root=str(tmp_path))
    paired = lambda: spark.read.schema("rule string, source_id string, target_id string").parquet(config.rule_pairs).count()

    def wait(done):
        deadline = time.time() + 45
        while time.time() < deadline and not done():
            time.sleep(0.3)

    try:
        wait(lambda: log_table.exists(spark, config.rule_pairs) and paired() == 2)
        assert paired() == 2
        with open(tmp_path / "var/log/nginx/access.log", "a") as f:
            f.write(LINE.format(1, 1).replace("2026", "2030") + "\n")
        wait(lambda: log_table.exists(spark, config.alerts) and pipeline.fired(spark, config.alerts).count())
        assert [(r.alert, r.value) for r in pipeline.fired(spark, config.alerts).collect()] == [("hits", 2.0)]
        assert log_table.read(spark, config.logs).where("raw LIKE '%at one'").count() == 1
        stopper = threading.Timer(6, running[0].stop)
        stopper.start()
        pipeline.serve(spark, dataclasses.replace(config, retention_days=30), running, every_seconds=1)
        assert log_table.read(spark, config.logs).select(F.year("timestamp")).distinct().collect() == [(2030,)]
    finally:
        for q in running:
            q.stop()
