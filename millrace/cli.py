"""Command line: run, connector check, connector run, source check, compact. Reports are JSON; errors exit with 1."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.text import file_uri
from .model import ContractError
from .operators.compaction import compact
from .operators.ledger import Ledger
from .operators.sink import CatalogSink, FileSink
from .sources import config as C
from .sources.jsonl import FileSource, Selection
from .streaming.connector import RunReport, run_session

# Workloads by name and the folders and modes of their batches.
WORKLOADS = {"append_only.orders_events": ("orders_events", "append_only"), "keyed_upsert.customer_state": ("customer_state", "keyed_upsert")}


def positive(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("must be greater than zero")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="ingest a reference workload")
    run.add_argument("--workload", required=True)
    run.add_argument("--destination-uri", required=True)
    run.add_argument("--data-dir", default="fixtures")
    run.add_argument("--sink", choices=("filesystem", "catalog"), default="filesystem")
    run.add_argument("--namespace", default="default")
    run.add_argument("--batch-limit", type=positive)
    run.add_argument("--ledger", default="ledger.sqlite")

    connector = commands.add_parser("connector", help="check or run a connector").add_subparsers(dest="action", required=True)
    for name in ("check", "run"):
        sub = connector.add_parser(name)
        sub.add_argument("--connector", required=True)
        if name == "run":
            sub.add_argument("--batch-limit", type=positive)
            sub.add_argument("--ledger", default="ledger.sqlite")
            sub.add_argument("--staging")

    source = commands.add_parser("source", help="check a source").add_subparsers(dest="action", required=True)
    check = source.add_parser("check")
    check.add_argument("--source", required=True)
    check.add_argument("--table", default="")

    small = commands.add_parser("compact", help="rewrite small files of a table")
    small.add_argument("--warehouse-uri", required=True)
    small.add_argument("--catalog-uri", default="")
    small.add_argument("--catalog", default="")
    small.add_argument("--namespace", required=True)
    small.add_argument("--table", required=True)
    small.add_argument("--table-mode", required=True)
    small.add_argument("--min-small-file-bytes", type=int, required=True)
    small.add_argument("--max-rewrite-files", type=positive, required=True)
    small.add_argument("--target-bytes", type=positive, default=256 << 20)
    return top


def run_workload(spark: SparkSession, a) -> RunReport:
    if a.workload not in WORKLOADS:
        raise ContractError(f"unknown workload: {a.workload}")
    folder, mode = WORKLOADS[a.workload]
    source = FileSource(spark, f"{a.data_dir.rstrip('/')}/{folder}")
    root = a.destination_uri if "://" in a.destination_uri else file_uri(str(Path(a.destination_uri).resolve()))
    sink = FileSink(spark, root) if a.sink == "filesystem" else CatalogSink(spark, root, a.namespace)
    ledger = Ledger(a.ledger)
    try:
        durable = ledger.last_durable_checkpoint(source.table_id)
        session = source.open_capture(Selection(source.table_id, folder, mode), durable[1] if durable else None)
        return run_session(session, sink, ledger, f"{root}/_staging", root, a.batch_limit)
    finally:
        ledger.close()


def run_connector(spark: SparkSession, path: str, ledger: Ledger, batch_limit: int | None = None, staging: str | None = None) -> RunReport:
    """A connector's tables one after the other; the limit holds for all of them together; each resumes by itself."""
    connector, root = C.load_connector(path), C.config_root(path)
    source, destination = C.named(root, "source", connector.source), C.named(root, "destination", connector.destination)
    name = C.catalog_name(connector, destination)
    catalog = C.named(root, "catalog", name) if name else None
    total = RunReport()
    for table in connector.tables:
        left = None if batch_limit is None else batch_limit - total.batches
        if left is not None and left <= 0:
            break
        reader = C.build_source(spark, source, root / C.FOLDERS["source"], table)
        sink, uri = C.build_sink(spark, destination, catalog, table)
        durable = ledger.last_durable_checkpoint(table.table_id)
        session = reader.open_capture(Selection(table.table_id, table.source_table, table.table_mode), durable[1] if durable else None)
        total.add(run_session(session, sink, ledger, staging or f"{uri}/_staging", uri, left))
    return total


def as_json(report) -> str:
    if isinstance(report, RunReport):
        report = {"batches_committed": report.batches, "files_written": report.files, "rows": report.rows, "last_checkpoint": report.last_checkpoint}
    return report if isinstance(report, str) else json.dumps(report, sort_keys=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "run":
            out = run_workload(spark, a)
        elif a.command == "connector" and a.action == "check":
            out = C.check_connector(spark, a.connector)
        elif a.command == "connector":
            ledger = Ledger(a.ledger)
            try:
                out = run_connector(spark, a.connector, ledger, a.batch_limit, a.staging)
            finally:
                ledger.close()
        elif a.command == "source":
            loaded = C.load("source", a.source)
            out = FileSource(spark, C.source_folder(loaded, Path(a.source).parent, a.table)).check()
        else:
            out = compact(spark, a.warehouse_uri, a.table_mode, a.min_small_file_bytes, a.max_rewrite_files, a.target_bytes, a.namespace).to_json()
    except (ContractError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(as_json(out))
    return 1 if isinstance(out, dict) and out.get("valid") is False else 0


if __name__ == "__main__":
    sys.exit(main())
