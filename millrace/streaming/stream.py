"""Continuous forms: a Structured Streaming query over a folder of batch files, and detection of changes that come late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import ContractError
from ..operators.ledger import Ledger
from ..operators.sink import Sink
from ..operators.writer import WriterConfig
from ..sources.jsonl import FileSource, Selection, decoded
from .connector import RunReport, commit_batch
from .gates import Coordinator


def start(
    spark: SparkSession, source: FileSource, selection: Selection, sink: Sink, ledger_path: str, staging: str, destination: str, checkpoint: str,
    trigger: dict | None = None, config: WriterConfig = WriterConfig(),
) -> tuple[StreamingQuery, RunReport]:
    """Ingest a folder's batch files as they come; returns the running query and a report that grows.

    A file stream hands files over by their times, not by their names, so each micro-batch is only a signal: the batches
    after the table's last durable checkpoint are committed in the order of their names. A micro-batch that runs again
    after a failure finds nothing left to do. A file that sorts before a committed one is a contract error.
    """
    report, gate, seen, bounds = RunReport(), Coordinator(), set(), {}

    def signal(files: DataFrame, _: int) -> None:
        names = {r["file"] for r in files.select("file").collect()}  # a row for each new file
        ledger = Ledger(ledger_path)
        try:
            durable = ledger.last_durable_checkpoint(selection.table_id)
            session = source.open_capture(selection, durable[1] if durable else None, bounds)
            bounds.update({b["file"]: b for b in session.bounds})  # files are read for their bounds once in a stream's life
            done = {b["file"].rsplit("/", 1)[-1] for b in session.bounds[: session.cursor]}
            late = {n.rsplit("/", 1)[-1] for n in names} & done - seen
            if late and seen:
                raise ContractError(f"files arrived after later ones were committed: {sorted(late)}")
            while (batch := session.poll_batch()) is not None:
                if gate.try_admit(selection.table_id):
                    raise ContractError("table budget exhausted")
                commit_batch(batch, selection.table_id, sink, ledger, staging, destination, report, gate, config=config)
                seen.add(batch.label)
            seen.update(done)
        finally:
            ledger.close()

    found = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "batch-*.jsonl").load(source.folder)
    signals = found.select(F.col("_metadata.file_path").alias("file"))
    writer = signals.writeStream.foreachBatch(signal).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start(), report


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded records of new files as a stream: (file, pos, decoded columns, error)."""
    text = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "batch-*.jsonl").load(folder)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    lines = lines.select("file", (F.col("pos") + 1).cast("long").alias("pos"), F.btrim("line", F.lit(" \t\r")).alias("line")).filter("line <> ''")
    return decoded(lines)


def late_changes(changes: DataFrame) -> DataFrame:
    """(key_json, ordering_value, newest): records below the newest ordering already seen of their key, across batches.

    ``changes`` is a stream with key_json, ordering_value, pos. State is one number for each key; it never expires,
    because a key's order holds for ever.
    """

    def late(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["file", "pos"])
        out = []
        for value in rows["ordering_value"]:
            value = int(value)
            if newest is not None and value < newest:
                out.append((key[0], value, newest))
            else:
                newest = value
        if newest is not None:
            state.update((newest,))
        yield pd.DataFrame(out, columns=["key_json", "ordering_value", "newest"])

    return changes.groupBy("key_json").applyInPandasWithState(
        late, "key_json string, ordering_value long, newest long", "newest long", "append", GroupStateTimeout.NoTimeout
    )

