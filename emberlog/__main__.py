"""The command line: python -m emberlog --help."""

from __future__ import annotations

import argparse
import shutil
import threading
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import __version__
from emberlog.config import Config
from emberlog.functions import formats
from emberlog.operators import alerts, correlate, parsers, query, results, search
from emberlog.sources import lines, logs, packs, receivers
from emberlog.streaming import pipeline


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emberlog", description="Log analytics on Spark.")
    top.add_argument("--config", help="a TOML file of settings")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="parse files of one source into the table")
    ingest.add_argument("paths", nargs="+")
    ingest.add_argument("--follow", action="store_true", help="as a stream of what is appended, until stopped")
    start = commands.add_parser("start", help="follow the files of all packs, and correlate what comes, until stopped")
    start.add_argument("--root", default="", help="a folder that the packs' paths are under")
    start.add_argument("--once", action="store_true", help="end when all that is there is stored")
    start.add_argument("--listen", action="store_true", help="receive syslog (UDP and TCP) and JSON records (HTTP) as well")
    start.add_argument("--received", action="store_true", help="follow what listeners elsewhere (receive) write to the spool, too")
    commands.add_parser("receive", help="only receive, into the spool that it shares with a start elsewhere")
    commands.add_parser("init", help="make the folders, and the file of settings if it isn't there")
    commands.add_parser("status", help="what is stored, as JSON")
    commands.add_parser("counts", help="entries by source and pack, as JSON")
    commands.add_parser("alerts", help="when the packs' alerts fired")
    commands.add_parser("config", help="the settings")
    commands.add_parser("list", help="packs that are installed")
    for name, help_ in (("install", "a pack, from the folder of its manifest"), ("remove", "an installed pack"), ("info", "what a pack reads")):
        commands.add_parser(name, help=help_).add_argument("pack_name")
    tail = commands.add_parser("tail", help="the newest entries, oldest first")
    tail.add_argument("-n", type=int, default=20)
    ask = commands.add_parser("query", help="entries that fit, newest first; or any SQL over the view logs")
    ask.add_argument("--sql")
    for name in ("--level", "--search", "--since", "--until"):
        ask.add_argument(name)
    ask.add_argument("--limit", type=int, default=50)
    ask.add_argument("--offset", type=int, default=0)
    for command in (ingest, tail, ask):
        command.add_argument("--pack", required=command is ingest)
        command.add_argument("--source", required=command is ingest)
    commands.add_parser("stats", help="how many entries there are, and of which time")
    commands.add_parser("correlate", help="pairs of entries that share an identifier, most certain first")
    commands.add_parser("retain", help="delete entries that are too old")
    offered = commands.add_parser("packs", help="packs that can be had, or are installed")
    offered.add_argument("--words", default="")
    validate = commands.add_parser("validate", help="check a pack's manifest")
    validate.add_argument("manifest")
    return top


def _show(lines_of: DataFrame, column) -> None:
    for r in lines_of.select(column.alias("line")).toLocalIterator():
        print(r.line)


def _known(config: Config) -> dict[str, packs.Pack]:
    return packs.BUILT_IN | (packs.scan(config.packs) if Path(config.packs).is_dir() else {})


def _listening(config: Config) -> list[threading.Thread]:
    """Start the receivers."""
    syslog, otlp = receivers.Spool(config.spool, "syslog"), receivers.Spool(config.spool, "otlp")
    return receivers.listen([receivers.udp(syslog, port=config.syslog_port), receivers.tcp(syslog, port=config.syslog_port), receivers.http(otlp, port=config.otlp_port)])


def _received(config: Config) -> dict[str, packs.Pack]:
    """The packs of what receivers write."""
    of = lambda name, spool, format: packs.Pack(name, "1.0.0", sources=[packs.Source("network", [f"{config.spool}/{spool}-*.log"], format)])
    return {"syslog-network": of("syslog-network", "syslog", "syslog"), "otlp": of("otlp", "otlp", "json")}


def _without_spark(a: argparse.Namespace, config: Config) -> int:
    folder, known = Path(config.packs), _known(config)
    if a.command == "init":
        for path in (config.data_dir, config.packs, config.spool):
            Path(path).mkdir(parents=True, exist_ok=True)
        if a.config and not Path(a.config).exists():
            config.save(a.config)
        print(f"ready in {config.data_dir}")
    elif a.command == "receive":
        for thread in _listening(config):
            thread.join()
    elif a.command == "config":
        print("\n".join(f"{k} = {v!r}" for k, v in vars(config).items()))
    elif a.command == "list":
        for p in known.values():
            print(f"{p.name} {p.version}{'' if p.name in packs.BUILT_IN else ' (installed)'}: {len(p.sources)} sources, {len(p.alerts)} alerts")
    elif a.command == "install":
        try:
            pack = packs.parse((Path(a.pack_name) / "pack.toml").read_text())
        except (OSError, packs.PackError) as e:
            print(e)
            return 1
        shutil.copytree(a.pack_name, folder / pack.name, dirs_exist_ok=True)
        print(f"{pack.name} {pack.version} is installed")
    elif a.pack_name not in known:
        print(f"no pack '{a.pack_name}'")
        return 1
    elif a.command == "info":
        p = known[a.pack_name]
        print(f"{p.name} {p.version}: {p.description}", *(f"  {s.name} ({s.format}): {', '.join(s.paths)}" for s in p.sources), *(f"  alert {x.name}: {x.condition}" for x in p.alerts), sep="\n")
    elif not (folder / a.pack_name / "pack.toml").is_file():
        print(f"'{a.pack_name}' is built in")
        return 1
    else:
        shutil.rmtree(folder / a.pack_name)
        print(f"{a.pack_name} is removed")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    config = Config.load(a.config) if a.config and (a.command != "init" or Path(a.config).exists()) else Config()
    if a.command == "validate":
        try:
            print(f"{packs.parse(Path(a.manifest).read_text()).name} is valid")
        except packs.PackError as e:
            print(e)
            return 1
        return 0
    if a.command in ("init", "receive", "config", "install", "remove", "list", "info"):
        return _without_spark(a, config)
    spark = SparkSession.builder.appName("emberlog").getOrCreate()
    known = _known(config)
    if a.command == "packs":
        for r in packs.search(packs.index(spark), a.words).orderBy("name").collect():
            print(f"{r.name} {r.version}{' (installed)' if r.name in known else ''}: {r.description}")
    elif a.command == "ingest" and a.follow:
        found = reduce(DataFrame.unionByName, [lines.grow(spark, path, a.pack, a.source) for path in a.paths])
        pipeline.ingest(found, known, config.logs, f"{config.data_dir}/checkpoints/{a.pack}-{a.source}", flush=f"{config.flush_interval_ms} milliseconds").awaitTermination()
    elif a.command == "ingest":
        source = known[a.pack].source(a.source) if a.pack in known else None
        if source is not None and source.multiline:
            found = parsers.joined(reduce(DataFrame.unionByName, [lines.grow(spark, path, a.pack, a.source, stream=False) for path in a.paths]), known)
        else:
            found = lines.read(spark, a.paths, a.pack, a.source, files_per_batch=config.files_per_batch)
        logs.append(parsers.entries(parsers.parse(found, known)), config.logs)
    elif a.command == "start":
        if a.listen:
            _listening(config)
        if a.listen or a.received:
            known |= _received(config)
        running = pipeline.follow(spark, known, config, root=a.root, once=a.once)
        if not a.once:
            pipeline.serve(spark, config, running)
        for q in running:
            print(pipeline.counters(q))
    elif a.command == "retain":
        print(query.apply_retention(spark, config.logs, config.retention_days, datetime.now(timezone.utc)), "entries deleted")
    else:
        table = logs.read(spark, config.logs)
        if a.command == "query" and a.sql:
            query.sql(spark, table, a.sql).show(1000, truncate=False)
        elif a.command == "query":
            _show(search.run(spark, config.logs, query.LogQuery(a.source, a.pack, a.level, a.search, a.since, a.until, a.limit, a.offset)), formats.entry_line())
        elif a.command in ("status", "counts"):
            size = query.table_bytes(spark, config.logs).first().bytes
            told = results.counts(table) if a.command == "counts" else results.status(table, size, __version__, 0)
            print(told.first().json)
        elif a.command == "alerts":
            _show(alerts.of_packs(table, known).orderBy("window_start", "alert"), F.format_string("%s %s/%s %s %s %s", "window_start", "pack", "alert", "severity", "groups", "value"))
        elif a.command == "tail":
            _show(query.tail(table, a.n, source=a.source, pack=a.pack), formats.tail_line())
        elif a.command == "stats":
            size = query.table_bytes(spark, config.logs)
            r = query.stats(table).crossJoin(size).select("*", formats.human_number("total").alias("shown"), formats.human_bytes("bytes").alias("size")).first()  # two frames of one row
            print(f"{r.shown} entries, {r.size}, {r.oldest} to {r.newest}", *(f"  {s.source}: {s.n}" for s in r.by_source), sep="\n")
        else:
            found = correlate.correlate(table, window_seconds=config.window_seconds, least=config.min_confidence)
            _show(found.orderBy(F.desc("confidence"), "id").limit(1000), F.format_string("%.2f %s %s", "confidence", "correlation_type", "description"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
