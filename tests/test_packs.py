import json
from datetime import datetime, timedelta

import pytest

from emberlog.config import Config
from emberlog.operators import alerts, query, results, rules
from emberlog.sources import logs as log_table
from emberlog.sources import packs

GOOD = """
[pack]
name = "my-app"
version = "1.2.3"
description = "An application"
tags = ["web"]

[[sources]]
name = "main"
paths = ["/var/log/my-app/*.log"]
format = "regex"
pattern = '(?P<level>\\w+) (?P<message>.*)'

[[alerts]]
name = "many"
condition = "count(level = 'error') > 5 in 1m"
severity = "critical"

[[correlations]]
target_pack = "nginx"
match_fields = ["timestamp", "uri:script"]

[schema]
fields = [{ name = "level", type = "string", indexed = true }]
"""


def test_a_good_manifest():
    p = packs.parse(GOOD)
    assert (p.name, p.version, p.source("main").format, p.alerts[0].severity, p.correlations[0].window, p.fields[0]["name"]) == ("my-app", "1.2.3", "regex", "critical", "2s", "level")
    assert p.source("none") is None


@pytest.mark.parametrize(
    "old, new",
    [
        ('"my-app"', '""'), ('"my-app"', '"my app"'), ('"1.2.3"', '"1.2"'), ('"1.2.3"', '"a.b.c"'), ('"regex"', '"csv"'), ("pattern = '(?P<level>\\w+) (?P<message>.*)'", ""), ("(?P<level>\\w+)", "(?P<level>\\w+"),
        ('"main"', '""'), ('["/var/log/my-app/*.log"]', "[]"), ('format = "regex"', 'format = "regex"\nmultiline = true'), ('"critical"', '"high"'), ('"string"', '"datetime"'), ("[[sources]]", "[[others]]"), ("[pack]", "[pack"),
    ],
)
def test_manifests_that_are_refused(old, new):
    with pytest.raises(packs.PackError):
        packs.parse(GOOD.replace(old, new, 1))


def test_versions_may_have_a_suffix():
    assert packs.parse(GOOD.replace("1.2.3", "1.2.3-beta.1")).version == "1.2.3-beta.1"


def test_scan_leaves_out_what_is_broken(tmp_path):
    for name, text in (("a", GOOD), ("b", "broken ="), ("c", GOOD.replace("my-app", "other"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.toml").write_text(text)
    (tmp_path / "empty").mkdir()
    assert list(packs.scan(tmp_path)) == ["my-app", "other"]


def test_built_in_packs(spark):
    assert list(packs.BUILT_IN) == ["nginx", "php-fpm", "mysql", "systemd", "syslog"]
    index = packs.index(spark)
    assert index.count() == 10
    names = lambda words: sorted(r.name for r in packs.search(index, words).collect())
    assert names("DATABASE") == ["mysql", "postgresql", "redis"] and names("no such") == [] and names("docker") == ["docker"]


def test_config_round_trip(tmp_path):
    c = Config(data_dir=str(tmp_path), window_seconds=5, min_confidence=0.3)
    c.save(tmp_path / "c.toml")
    assert Config.load(tmp_path / "c.toml") == c and c.logs == f"{tmp_path}/logs"
    (tmp_path / "bad.toml").write_text("nothing = 1")
    with pytest.raises(ValueError):
        Config.load(tmp_path / "bad.toml")


def test_manifest_correlations_and_alerts_run(spark):
    """What a manifest declares becomes rules and firings over a table of entries."""
    start = datetime(2026, 4, 9, 10)
    at = lambda s: start + timedelta(seconds=s)
    rows = [(f"{i:026}", at(i), "access", "h", "info", "m", f'{{"uri":"/{i % 2}","status":500}}', "", "nginx") for i in range(12)]
    rows += [(f"{100 + i:026}", at(i + 1), "error", "h", "error", "m", f'{{"script":"/{i % 2}"}}', "", "php-fpm") for i in range(3)]
    logs = spark.createDataFrame(rows, log_table.SCHEMA.removesuffix(", day date"))
    [rule] = rules.of_pack(packs.BUILT_IN["nginx"])
    assert (rule.source_pack, rule.target_pack, rule.window_seconds, rule.match_fields, rule.condition) == ("nginx", "php-fpm", 2, [("uri", "script")], None)
    want = {(i, 100 + j) for i in range(12) for j in range(3) if i % 2 == j % 2 and abs(i - j - 1) <= 2}
    assert {(int(r.source_id), int(r.target_id)) for r in rule.pairs(logs).collect()} == want
    fired = alerts.of_packs(logs, packs.BUILT_IN).collect()
    assert [(r.alert, r.pack, r.severity, r.value, r.groups) for r in fired] == [("5xx_spike", "nginx", "critical", 12.0, "{}")]
    with pytest.raises(packs.PackError):
        rules.of_pack(packs.Pack("x", "1.0.0", correlations=[packs.Correlation("y", [], "soon")]))


def test_results_as_json(spark):
    logs = spark.createDataFrame([(f"{i:026}", datetime(2026, 4, 9, 10, i), "s", "h", "info", "m", "{}", "", "ab"[i % 2]) for i in range(5)], log_table.SCHEMA.removesuffix(", day date"))
    told = lambda df: json.loads(df.first().json)
    page = told(results.page(logs, query.LogQuery(pack="a", limit=2)))
    assert page["total"] == 5 and [int(e["id"]) for e in page["logs"]] == [4, 2]
    assert told(results.counts(logs)) == {"total": 5, "by_source": [{"source": "s", "cnt": 5}], "by_pack": [{"pack": "a", "cnt": 3}, {"pack": "b", "cnt": 2}]}
    assert told(results.counts(logs.where("false")))["by_pack"] == []
    assert told(results.statistics(logs, 9))["db_size_bytes"] == 9 and told(results.statistics(logs.where("false"), 0))["oldest_entry"] is None
    assert told(results.status(logs, 2048, "1", 3)) == {"status": "running", "version": "1", "logs_stored": 5, "storage_bytes": 2048, "storage": "2.00 KB", "correlation_window_size": 3}
