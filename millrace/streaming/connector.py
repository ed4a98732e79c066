"""The ingestion loop: poll, admit, normalise, materialise, commit, link, acknowledge; and recovery of what was left open."""

from __future__ import annotations

import time
from collections import deque
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import takewhile

from pyspark.sql import DataFrame

from ..model import BatchManifest, ContractError
from ..operators.ledger import Ledger
from ..operators.normalize import Normalized, normalize_batch, normalize_group
from ..operators.sink import CommitRequest, Locator, Outcome, Sink
from ..operators.writer import WriterConfig, materialize, materialize_group, place_of
from ..sources.files import Files
from ..sources.jsonl import Batch, Group, Session, label_of
from .gates import Coordinator

#: Groups of batches that are read ahead of the one that is written; so many more are held, in memory or on executors' disks.
AHEAD = 1
#: Bytes of the files of a group's batches; a larger file is a group of its own.
GROUP_BYTES = 256 << 20


@dataclass
class RunReport:
    batches: int = 0
    files: int = 0
    rows: int = 0
    last_checkpoint: str | None = None
    commit_seconds: list[float] = field(default_factory=list)

    def add(self, other: "RunReport") -> None:
        self.batches += other.batches
        self.files += other.files
        self.rows += other.rows
        self.commit_seconds += other.commit_seconds


def run_session(
    session: Session, sink: Sink, ledger: Ledger, staging: str, destination: str, batch_limit: int | None = None, coordinator: Coordinator | None = None,
    actor: str = "millrace", config: WriterConfig = WriterConfig(),
) -> RunReport:
    """Commit a session's batches in order; each is acknowledged only after its commit is durable in the ledger.

    Batches are read, checked and written in groups, so that many small files don't take many small jobs. While a group is
    committed, the next AHEAD are read and checked already. A group's files are staged when its first batch is admitted, up
    to the first wrong batch, whose fault is told when its turn comes; nothing of a batch is registered or committed before
    it is admitted itself, and staged files of batches that never are go. The session is closed in any case; if closing fails
    too, both errors are told.
    """
    gate = coordinator or Coordinator()
    report = RunReport()
    table = session.selection.table_id
    error: BaseException | None = None
    reading: deque[Future] = deque()
    begun, group = 0, None
    with ThreadPoolExecutor(AHEAD) as beside:
        try:
            while batch_limit is None or report.batches < batch_limit:
                reason = gate.try_admit(table)
                if reason:
                    raise ContractError(reason)
                while len(reading) <= AHEAD and (batch_limit is None or begun < batch_limit):
                    polled = session.poll_group(GROUP_BYTES, None if batch_limit is None else batch_limit - begun)
                    if polled is None:
                        break
                    reading.append(beside.submit(check_group, polled, session))
                    begun += len(polled.bounds)
                if group is None or not group.waiting:
                    if not reading:
                        gate.release(table)
                        break
                    group = reading.popleft().result()
                write_next(group, session, table, sink, ledger, staging, destination, report, gate, actor, config)
        except BaseException as e:
            error = e
            raise
        finally:
            if group is not None:
                group.drop(table, staging)
            for left in reading:
                if not left.cancel() and left.exception() is None:
                    left.result().drop(table, staging)
            try:
                session.close()
            except Exception as closing:
                if error is None:
                    raise
                raise ContractError(f"{error}; closing failed too: {closing}") from error
    return report


@dataclass(frozen=True)
class Ready:
    """A batch that was read and checked; ``held`` is kept in memory until it is written."""

    label: str
    held: DataFrame
    normal: Normalized


@dataclass
class ReadyGroup:
    """Batches that were read and checked together; ``held`` is kept until they are written. ``normals`` has None for a wrong one."""

    bounds: list[dict]
    normals: list[Normalized | None]
    held: DataFrame | None
    reduced: DataFrame | None
    waiting: deque[int]
    alone: Ready | None = None
    manifests: dict[int, BatchManifest] = field(default_factory=dict)

    def write(self, table: str, ledger: Ledger, staging: str, config: WriterConfig) -> None:
        """Stage the next batch and those after it, up to a wrong one, or one that the ledger knows from an earlier run."""
        of = {k: (n, f"{table}.{label_of(self.bounds[k])}") for k in self.waiting if (n := self.normals[k]) is not None}
        first = self.waiting[0]
        good = takewhile(lambda k: k == first or k in of and ledger.batch_status(place_of(*of[k], staging)[0]) is None, self.waiting)
        self.manifests |= materialize_group(self.reduced, {k: of[k] for k in good}, staging, config)
        if not any(k in of and k not in self.manifests for k in self.waiting):
            self.held.unpersist()

    def drop(self, table: str, staging: str) -> None:
        """Let go what is held, and the staged files of batches that were not taken."""
        for held in (self.held, self.alone and self.alone.held):
            if held is not None:
                held.unpersist()
        for k in self.waiting:
            if k in self.manifests:
                Files(self.held.sparkSession).delete(place_of(self.normals[k], f"{table}.{label_of(self.bounds[k])}", staging)[1])


def check_group(group: Group, session: Session) -> ReadyGroup:
    """A group's batches decoded once, checked and reduced; a batch that stands alone as ever."""
    if len(group.bounds) == 1 or not group.table_mode:
        waiting = deque(range(len(group.bounds)))
        return ReadyGroup(group.bounds, [None] * len(waiting), None, None, waiting, check_batch(session.batch_of(group.bounds[0])) if len(waiting) == 1 else None)
    held = group.rows.persist()
    try:
        reduced, normals = normalize_group(held, group.bounds, group.table_mode == "keyed_upsert")
    except BaseException:
        held.unpersist()
        raise
    return ReadyGroup(group.bounds, normals, held, reduced, deque(range(len(normals))))


def write_next(
    group: ReadyGroup, session: Session, table: str, sink: Sink, ledger: Ledger, staging: str, destination: str, report: RunReport, gate: Coordinator, actor: str, config: WriterConfig
) -> None:
    """Write and commit a group's next batch, which is admitted."""
    place = group.waiting[0]
    if group.normals[place] is None:  # alone, or wrong: then reading it again tells why, by the line
        ready = group.alone or check_batch(session.batch_of(group.bounds[place]))
        group.alone = None
        group.waiting.popleft()
        write_batch(ready, table, sink, ledger, staging, destination, report, gate, actor, config, session.checkpoint)
        return
    if place not in group.manifests:
        group.write(table, ledger, staging, config)
    group.waiting.popleft()
    commit_manifest(group.manifests[place], table, sink, ledger, destination, report, gate, actor, session.checkpoint)


def check_batch(batch: Batch) -> Ready:
    """A batch decoded once, checked and reduced."""
    held = batch.rows.persist()
    try:
        keyed = batch.table_mode == "keyed_upsert" if batch.table_mode else None
        return Ready(batch.label, held, normalize_batch(held, batch.checkpoint_end, batch.checkpoint_start, keyed))
    except ContractError as broken:
        held.unpersist()
        raise ContractError(f"{batch.label}:{broken}") from broken


def commit_batch(
    batch: Batch, table: str, sink: Sink, ledger: Ledger, staging: str, destination: str, report: RunReport, gate: Coordinator, actor: str = "millrace",
    config: WriterConfig = WriterConfig(), acknowledge=None,
) -> None:
    """Check, write and commit one admitted batch, and acknowledge it once its commit is durable; counts go to ``report``."""
    write_batch(check_batch(batch), table, sink, ledger, staging, destination, report, gate, actor, config, acknowledge)


def write_batch(
    ready: Ready, table: str, sink: Sink, ledger: Ledger, staging: str, destination: str, report: RunReport, gate: Coordinator, actor: str = "millrace",
    config: WriterConfig = WriterConfig(), acknowledge=None,
) -> None:
    try:
        manifest = materialize(ready.normal, f"{table}.{ready.label}", staging, config)
    finally:
        ready.held.unpersist()
    commit_manifest(manifest, table, sink, ledger, destination, report, gate, actor, acknowledge)


def commit_manifest(
    manifest: BatchManifest, table: str, sink: Sink, ledger: Ledger, destination: str, report: RunReport, gate: Coordinator, actor: str = "millrace", acknowledge=None
) -> None:
    """Commit a batch whose files are staged, and acknowledge it once its commit is durable."""
    gate.record_materialized(table)
    ledger.register_batch(manifest)
    ledger.record_files(manifest.batch_id, manifest)
    began = time.monotonic()
    done = _earlier(sink, ledger, manifest.batch_id) or _attempt(sink, ledger, manifest, destination, actor, gate, table)
    report.commit_seconds.append(time.monotonic() - began)
    ledger.link_checkpoint_pending(manifest.batch_id, manifest.source_id, manifest.source_checkpoint_end, done.snapshot.snapshot_id)
    gate.record_committed(table)
    held = gate.checkpoint_decision(table)
    if held:
        raise ContractError(held)
    if acknowledge:
        acknowledge(manifest.source_id, manifest.source_checkpoint_end)
    ledger.mark_checkpoint_durable(manifest.batch_id, manifest.source_id, manifest.source_checkpoint_end, done.snapshot.snapshot_id)
    report.batches += 1
    report.files += len(manifest.file_set)
    report.rows += manifest.record_count
    report.last_checkpoint = manifest.source_checkpoint_end


def _earlier(sink: Sink, ledger: Ledger, batch_id: str) -> Outcome | None:
    """What the batch's last attempt committed, if a run that ended early left one; open attempts are settled first."""
    last = ledger.last_attempt(batch_id)
    if last is None or last["attempt_status"] not in ("started", "resolving", "unknown", "committed"):
        return None
    locator = Locator(last["destination"], last["idempotency_key"])
    if last["attempt_status"] == "committed":
        return sink.resolve_uncertain_commit(locator)[1]
    return settle(sink, ledger, last["attempt_id"], locator)


def _attempt(sink: Sink, ledger: Ledger, manifest: BatchManifest, destination: str, actor: str, gate: Coordinator, table: str) -> Outcome:
    key = f"{manifest.batch_id}:{ledger.next_attempt_no(manifest.batch_id)}"
    prepared = sink.prepare_commit(CommitRequest(manifest.batch_id, manifest.table_mode, destination, key, manifest))
    attempt = ledger.begin_commit(manifest.batch_id, prepared.request.destination, prepared.snapshot.snapshot_id, actor)
    if attempt["idempotency_key"] != key:
        raise ContractError("another writer began a commit of this batch")
    try:
        done = sink.commit(prepared)
    except OSError:
        # the commit may have happened; it is looked up before anything else is tried
        ledger.mark_attempt_resolving(attempt["attempt_id"])
        gate.record_unresolved(table)
        done = settle(sink, ledger, attempt["attempt_id"], Locator(prepared.request.destination, key))
        if done is None:
            raise
        return done
    ledger.resolve_commit(attempt["attempt_id"], "committed")
    return done


def settle(sink: Sink, ledger: Ledger, attempt_id: str, locator: Locator) -> Outcome | None:
    """Resolve an uncertain attempt by asking the sink; the outcome if it was committed."""
    verdict, done = sink.resolve_uncertain_commit(locator)
    ledger.resolve_commit(attempt_id, {"committed": "committed", "not_committed": "failed_retryable", "ambiguous": "ambiguous"}[verdict])
    return done


def recover(ledger: Ledger, sink: Sink) -> dict[str, str]:
    """Settle every open attempt of batches that ask for recovery -> batch status by batch.

    Retryable batches whose schema was checked again become ready for a retry; nothing is committed twice, because the
    last attempt is always settled before another is begun.
    """
    out = {}
    for batch_id in ledger.list_recovery_candidates():
        row = ledger.open_attempt(batch_id)
        if row:
            settle(sink, ledger, row["attempt_id"], Locator(row["destination"], row["idempotency_key"]))
        if ledger.batch_status(batch_id) == "schema_revalidating":
            ledger.mark_retry_ready(batch_id)
        out[batch_id] = ledger.batch_status(batch_id)
    return out
