import os
import shutil
import subprocess
import sys

import pytest

from emberlog.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, sf, oracle, rows_of, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf)) == oracle(catalogue.ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 100


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest of the library works where the corpus operators aren't there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['emberlog.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(catalogue.QUERIES)), "False"]
    shutil.copytree(f"{root}/emberlog", tmp_path / "emberlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "emberlog/llm/__pycache__").mkdir(parents=True)  # what a deleted folder may leave behind
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(catalogue.QUERIES)), "False"]


def test_filters_reach_the_scan(spark, sf, tmp_path):
    from emberlog.operators.query import LogQuery
    from emberlog.sources import logs

    path = f"{tmp_path}/logs"
    logs.append(logs.from_events(spark, sf).drop("seq"), path)
    found = LogQuery(pack="mysql", level_min="warn", since="2024-01-03T00:00:00Z").run(logs.read(spark, path))
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "TakeOrderedAndProject" in plan and all(x in pushed for x in ("EqualTo(pack,mysql)", "In(level", "GreaterThanOrEqual(timestamp"))
    assert "day" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert found.count() > 0
