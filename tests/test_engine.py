"""The ingestion engine end to end: sources, normalisation, ledger, sinks, recovery, compaction, configuration, commands."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import hashing, text
from millrace.model import COLUMNS, BatchManifest, ContractError, ManifestFile
from millrace.operators import normalize, reconcile, schema_policy, upsert
from millrace.operators import compaction
from millrace.operators.compaction import compact
from millrace.operators.ledger import Ledger
from millrace.operators.sink import CatalogSink, CommitRequest, FileSink, Locator, MemorySink
from millrace.operators.writer import WriterConfig, materialize
from millrace.sources import config as C
from millrace.sources import jsonl
from millrace.streaming import connector
from millrace.streaming.connector import recover, run_session, settle
from millrace.streaming.gates import Coordinator


def record(ordering, op="insert", key=None, after=None, **more):
    base = {"ordering_value": ordering, "op": op, "key": key or {}, "after": after, "before": None, "source_event_id": f"e-{ordering}", "source_checkpoint": f"cp-{ordering:04d}"}
    return base | {"schema_version": 1, "ingestion_ts": ordering, "source_metadata": {"b": 1, "a": "x"}} | more


@pytest.fixture()
def workload(tmp_path):
    root = tmp_path / "workload"
    batches = {
        "orders_events": [[record(i, after={"order_id": f"o-{i}", "status": "new"}) for i in pair] for pair in ((10, 11), (12, 13))],
        "customer_state": [
            [record(1, "upsert", {"tenant_id": "t", "customer_id": "c1"}, {"status": "active"}), record(2, "upsert", {"tenant_id": "t", "customer_id": "c2"}, {"status": "active"})],
            [record(3, "upsert", {"tenant_id": "t", "customer_id": "c1"}, {"status": "inactive"}), record(4, "delete", {"tenant_id": "t", "customer_id": "c2"})],
        ],
    }
    for table, files in batches.items():
        (root / table).mkdir(parents=True)
        for i, rows in enumerate(files, 1):
            (root / table / f"batch-{i:04d}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return root


def landed(spark, rows):
    """rows: (key, ordering, op) in arrival order."""
    data = [(f'{{"id":{k}}}', o, op, None if op == "delete" else "{}", i) for i, (k, o, op) in enumerate(rows)]
    df = spark.createDataFrame(data, "key_json string, ordering_value long, op string, after_json string, pos long")
    fixed = {"table_id": "t", "source_id": "s", "source_class": "database_cdc", "table_mode": "keyed_upsert", "ordering_field": "f", "source_checkpoint": "cp", "source_metadata_json": "{}"}
    for name, value in fixed.items():
        df = df.withColumn(name, F.lit(value))
    df = df.withColumns({"before_json": F.lit(None).cast("string"), "source_event_id": F.lit(None).cast("string"), "schema_version": F.lit(1), "ingestion_ts": F.expr("timestamp_ntz '2020-01-01'")})
    return df.select(*COLUMNS, "pos")


def manifest(batch_id="batch-1", created="5:000000000", files=2, content="c"):
    entries = tuple(ManifestFile(f"file:///x/{i}", "data", f"h{i}", 10, 1, created) for i in range(files))
    return BatchManifest(batch_id, "t", "append_only", "s", "file_or_object_drop", "cp-1", "cp-2", "f", 1, 2, 1, "fp", 2, {"insert": 2}, content, entries, created)


# ---- functions


@pytest.mark.parametrize("parts", [[""], ["a"], ["é", "b" * 500], ["", "", "x"]])
def test_hash_column_and_driver_forms_agree(spark, parts):
    df = spark.createDataFrame([tuple(parts)], ", ".join(f"p{i} string" for i in range(len(parts))))
    row = df.select(hashing.stable_hash(*map(F.col, df.columns)).alias("h"), hashing.stable_hash_array(F.array(*df.columns)).alias("a")).first()
    assert row["h"] == row["a"] == hashing.stable_hash_text(*parts)


def test_fnv_known_values():
    assert hashing.fnv1a64_bytes(b"") == "cbf29ce484222325"
    assert hashing.fnv1a64_bytes(b"a") == "af63dc4c8601ec8c"


def test_texts(spark):
    row = spark.createDataFrame([("a/b-1.x.jsonl", "", "x y/é")], "l string, e string, n string").select(
        text.batch_id(F.col("l"), F.lit("h")).alias("b"), text.batch_id(F.col("e"), F.lit("h")).alias("d"), text.sanitize_identifier(F.col("n")).alias("s"), text.sanitize_identifier(F.col("e")).alias("z")
    )
    assert tuple(row.first()) == ("b-1.x", "batch-h", "x_y__", "batch")
    assert text.sanitize_output_component("/a/../b c.d") == "b_c.d"
    assert text.file_uri_path("file:///x") == "/x"
    with pytest.raises(ValueError):
        text.file_uri_path("s3://x")


# ---- JSON source


@pytest.mark.parametrize("bad", ["{", "[1]", '{"op":"insert"} x', json.dumps(record(1, after={"a": 1.5})), json.dumps(record(1, after={"a": [1]})), json.dumps(record(1, op="merge", after={})),
                                 json.dumps(record(1, after={}, source_metadata={"k": True})), json.dumps(record(1, after={}, schema_version=2**31)), json.dumps(record(1, after={}) | {"ordering_value": True})])
def test_decode_rejects(bad):
    with pytest.raises(ValueError):
        jsonl.decode(bad)


def test_decode_coerces():
    row = jsonl.decode(json.dumps(record(1, after={"b": 1, "a": None}, source_event_id=7, key=[]) | {"ordering_value": "12", "ingestion_ts": "3"}))
    assert (row["ordering_value"], row["after_json"], row["source_event_id"], row["key_json"]) == (12, '{"a":null,"b":1}', "7", "{}")


def test_source_resume_and_acknowledgement(spark, workload):
    source = jsonl.FileSource(spark, f"file://{workload}/orders_events")
    assert source.check()["details"]["record_count"] == 4
    choice = jsonl.Selection("orders_events", "orders_events", "append_only")
    session = source.open_capture(choice, "cp-0011")
    batch = session.poll_batch()
    assert batch.label == "batch-0002.jsonl" and batch.checkpoint_end == "cp-0013"
    assert [r["ordering_value"] for r in batch.rows.orderBy("pos").collect()] == [12, 13]
    assert session.poll_batch() is None
    session.checkpoint("file.orders_events", "cp-0013")
    with pytest.raises(ContractError):
        session.checkpoint("file.orders_events", "cp-0011")
    for args in ((choice, "cp-9"), (jsonl.Selection("t", "other", "append_only"), None), (jsonl.Selection("t", "orders_events", "keyed_upsert"), None)):
        with pytest.raises(ContractError):
            source.open_capture(*args)
    assert jsonl.FileSource(spark, f"file://{workload}/missing").discover() == []


def test_a_group_of_batches_is_one_scan(spark, tmp_path):
    folder = tmp_path / "customer_state"
    folder.mkdir()
    for i in range(6):
        rows = [record(10 * i + k, "upsert", {"id": k}, {"v": i}) for k in range(3)]
        (folder / f"batch-{i} é+%.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    source, choice = jsonl.FileSource(spark, f"file://{folder}"), jsonl.Selection("customer_state", "customer_state", "keyed_upsert")
    group = source.open_capture(choice).poll_group()
    assert group.rows._jdf.queryExecution().analyzed().toString().count("Relation [value") == 1
    got = sorted((r["batch"], r["pos"], r["ordering_value"]) for r in group.rows.collect())
    assert [(b, o) for b, _, o in got] == [(i, 10 * i + k) for i in range(6) for k in range(3)]
    session, groups = source.open_capture(choice), []
    one = (folder / "batch-0 é+%.jsonl").stat().st_size
    while (group := session.poll_group(2 * one + 20, 3)) is not None:
        groups.append(len(group.bounds))
    assert groups == [2, 2, 2] and [b["records"] for b in session.bounds] == [3] * 6
    assert len(source.open_capture(choice).poll_group(1).bounds) == 1
    assert len(source.open_capture(choice, "cp-0042").poll_group().bounds) == 1



# ---- normalisation and upserts


def test_latest_wins_and_spans(spark):
    n = normalize.normalize_batch(landed(spark, [(1, 10, "upsert"), (2, 15, "upsert"), (1, 20, "delete"), (3, 25, "upsert")]), "cp")
    assert (n.ordering_min, n.ordering_max) == (10, 25)
    rows = {r["key_json"]: (r["op"], r["ordering_value"]) for r in n.rows.collect()}
    assert rows == {'{"id":1}': ("delete", 20), '{"id":2}': ("upsert", 15), '{"id":3}': ("upsert", 25)}
    deletes, appends = upsert.plan(n.rows, ["key_json"])
    assert (deletes.count(), appends.count()) == (3, 2)


def test_order_violation_and_interleaving(spark):
    with pytest.raises(ContractError, match="ordering violation"):
        normalize.normalize_batch(landed(spark, [(1, 20, "upsert"), (1, 10, "upsert")]), "cp")
    n = normalize.normalize_batch(landed(spark, [(1, 10, "upsert"), (2, 20, "upsert"), (1, 15, "upsert")]), "cp")
    assert sorted(r["ordering_value"] for r in n.rows.collect()) == [15, 20]


def test_empty_and_mixed_batches(spark):
    rows = landed(spark, [(1, 1, "upsert"), (2, 2, "upsert")])
    with pytest.raises(ContractError, match="empty"):
        normalize.normalize_batch(rows.limit(0), "cp")
    with pytest.raises(ContractError, match="ordering_field mismatch"):
        normalize.normalize_batch(rows.withColumn("ordering_field", F.when(F.col("pos") == 1, "g").otherwise("f")), "cp")


@pytest.mark.parametrize("seed", range(3))
def test_random_batches_against_a_plain_model(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), rng.randrange(12), rng.choice(["upsert", "delete"])) for _ in range(40)]
    last, latest, broken = {}, {}, 0
    for i, (k, o, op) in enumerate(rows):
        broken += k in last and o < last[k]
        last[k] = o
        if k not in latest or (o, i) > latest[k][:2]:
            latest[k] = (o, i, op)
    df = landed(spark, rows)
    assert normalize.ordering_violations(df, ["key_json"]).count() == broken
    got = {r["key_json"]: (r["ordering_value"], r["pos"], r["op"]) for r in normalize.latest_by_key(df, ["key_json"]).collect()}
    assert got == {f'{{"id":{k}}}': v for k, v in latest.items()}


# ---- writer and manifests


def test_materialize_sizes_and_replays(spark, tmp_path):
    batch = normalize.normalize_batch(landed(spark, [(i, i, "upsert") for i in range(30)]), "cp")
    first = materialize(batch, "batch-0001.jsonl", f"file://{tmp_path}/out", WriterConfig(file_bytes=1))
    assert first.batch_id == "batch-0001" and first.record_count == 30 and len(first.file_set) >= 2 and sum(f.record_count for f in first.file_set) == 30
    again = materialize(batch, "batch-0001.jsonl", f"file://{tmp_path}/out", WriterConfig(file_bytes=1))
    assert again.content_hash == first.content_hash and again.schema_fingerprint == first.schema_fingerprint
    assert sorted(f.content_hash for f in again.file_set) == sorted(f.content_hash for f in first.file_set)
    assert materialize(batch, None, f"file://{tmp_path}/out").batch_id == f"batch-{first.content_hash}"


def test_replay_identity_ignores_time_and_order():
    a, b = manifest(), manifest(created="9:000000000")
    flipped = BatchManifest(**{**a.__dict__, "file_set": a.file_set[::-1]})
    assert a.replay_identity() == b.replay_identity() == flipped.replay_identity()
    assert a.checksum() != b.checksum()


def test_schema_parts_of_every_kind_of_payload(spark):
    from millrace.operators.aggregate import fingerprint_parts

    rows = [('{"id":1}', '{"a":1,"b":{"c":2}}', None), ('{"id":"x"}', "5", "[1,2]"), ('{"id":1}', "{}", "null"), ("{}", '{"a":null,"b":true}', "not json"), ("7", '"s"', "[]")]
    df = spark.createDataFrame(rows, "key_json string, after_json string, before_json string").withColumn("t", F.lit(1))
    (row,) = fingerprint_parts(df, ["t"]).collect()
    want = {"key:id:number", "key:id:string", "after:a:number", "after:b:object", "after:scalar:number", "before:scalar:array", "before:scalar:null", "after:a:null", "after:b:bool", "after:scalar:string"}
    assert row["parts"] == sorted(want)


# ---- ledger


def test_ledger_path_of_a_batch(spark):
    ledger, m = Ledger(), manifest()
    ledger.register_batch(m)
    ledger.register_batch(manifest(content="other"))
    ledger.record_files("batch-1", m)
    assert ledger.batch_status("batch-1") == "files_written"
    with pytest.raises(ContractError):
        ledger.record_files("batch-2", m)
    attempt = ledger.begin_commit("batch-1", "d", "snap", "me")
    assert attempt["attempt_id"] == "batch-1-attempt-0001" and attempt["idempotency_key"] == "batch-1:1"
    ledger.resolve_commit(attempt["attempt_id"], "rejected")
    assert ledger.batch_status("batch-1") == "schema_revalidating" and ledger.list_recovery_candidates() == ["batch-1"]
    second = ledger.begin_commit("batch-1", "d", "snap", "me")
    assert second["attempt_no"] == 2
    ledger.resolve_commit(second["attempt_id"], "committed")
    ledger.link_checkpoint_pending("batch-1", "s", "cp-2", "snap")
    with pytest.raises(ContractError):
        ledger.mark_checkpoint_durable("batch-1", "s", "cp-3", "snap")
    ledger.mark_checkpoint_durable("batch-1", "s", "cp-2", "snap")
    with pytest.raises(ContractError):
        ledger.link_checkpoint_pending("batch-1", "s", "cp-2", "snap")
    assert ledger.last_durable_checkpoint("t") == ("s", "cp-2") and ledger.batch_status("batch-1") == "checkpointed"
    ledger.mark_quarantine("batch-1", "malformed_batch")
    assert len(ledger.list_orphan_candidates()) == 2
    ledger.record_cleanup("batch-1", "file:///x/0", "deleted")
    assert ledger.list_orphan_candidates() == [("batch-1", "file:///x/1")]
    frames = ledger.frames(spark)
    assert reconcile.recovery_candidates(frames["batches"].select("batch_id", "batch_status"), frames["attempts"].select("batch_id", "attempt_status")).count() == 1
    orphans = reconcile.orphan_candidates(frames["files"].select("batch_id", "file_uri"), frames["batches"], frames["cleanups"].select("batch_id", "file_uri"))
    assert [tuple(r) for r in orphans.collect()] == [("batch-1", "file:///x/1")]
    with pytest.raises(ContractError):
        ledger.record_cleanup("batch-1", "file:///unknown", "deleted")
    assert [w for sort, _, w in ledger.words("batch-1") if sort == "batch"] == [
        "registered", "files_written", "commit_started", "schema_revalidating", "commit_started", "committed", "checkpoint_pending", "checkpointed", "quarantined"
    ]
    assert [w for sort, _, w in ledger.words("batch-1") if sort == "link"] == ["pending", "durable"]
    links = reconcile.last_durable_checkpoints(frames["links"], frames["batches"]).collect()
    assert [tuple(r) for r in links] == [("t", "s", "cp-2")]


# ---- sinks


def test_commit_once_and_lost_acknowledgement():
    sink, ledger, m = MemorySink("lose_ack"), Ledger(), manifest()
    ledger.register_batch(m)
    prepared = sink.prepare_commit(CommitRequest("batch-1", "append_only", "d//", "batch-1:1", m))
    attempt = ledger.begin_commit("batch-1", "d", prepared.snapshot.snapshot_id, "me")
    with pytest.raises(OSError):
        sink.commit(prepared)
    ledger.mark_attempt_resolving(attempt["attempt_id"])
    assert ledger.batch_status("batch-1") == "commit_uncertain"
    assert settle(sink, ledger, attempt["attempt_id"], Locator("d", "batch-1:1")).snapshot == prepared.snapshot
    assert ledger.batch_status("batch-1") == "committed" and sink.commit(prepared).snapshot == prepared.snapshot
    with pytest.raises(ContractError, match="different manifest"):
        sink.commit(sink.prepare_commit(CommitRequest("batch-1", "append_only", "d", "batch-1:1", manifest(content="x"))))
    sink.commit(sink.prepare_commit(CommitRequest("batch-1", "append_only", "e", "batch-1:1", m)))
    with pytest.raises(ContractError, match="ambiguous"):
        sink.lookup_commit("batch-1:1")


def test_recovery_settles_open_attempts():
    ledger, sink = Ledger(), MemorySink("fail_commit")
    m = manifest()
    ledger.register_batch(m)
    attempt = ledger.begin_commit("batch-1", "d", "snap", "me")
    ledger.mark_attempt_resolving(attempt["attempt_id"])
    assert recover(ledger, sink) == {"batch-1": "retry_ready"}
    second = ledger.begin_commit("batch-1", "d", "snap", "me")
    ledger.force_attempt_status(second["attempt_id"], "unknown")
    assert recover(ledger, MemorySink("ambiguous")) == {"batch-1": "quarantined"}


def test_sinks_reject_what_they_cannot_take(spark, tmp_path):
    sink = FileSink(spark, f"file://{tmp_path}")
    keyed = BatchManifest(**{**manifest().__dict__, "table_mode": "keyed_upsert"})
    for request in (CommitRequest("batch-1", "keyed_upsert", "d", "k", keyed), CommitRequest("batch-2", "append_only", "d", "k", manifest()),
                    CommitRequest("batch-1", "append_only", " ", "k", manifest()), CommitRequest("batch-1", "append_only", "d", "", manifest())):
        with pytest.raises(ContractError):
            sink.prepare_commit(request)


# ---- the loop


def test_run_resume_compact(spark, workload, tmp_path):
    source = jsonl.FileSource(spark, f"file://{workload}/orders_events")
    root = f"file://{tmp_path}/lake"
    sink, ledger = CatalogSink(spark, root, "ns"), Ledger(str(tmp_path / "ledger.sqlite"))
    choice = jsonl.Selection("orders_events", "orders_events", "append_only")
    first = run_session(source.open_capture(choice), sink, ledger, f"{root}/_staging", root, 1)
    assert (first.batches, first.rows, first.last_checkpoint) == (1, 2, "cp-0011")
    resume = ledger.last_durable_checkpoint("orders_events")[1]
    second = run_session(source.open_capture(choice, resume), sink, ledger, f"{root}/_staging", root)
    assert (second.batches, second.last_checkpoint) == (1, "cp-0013")
    assert sink.namespace_exists() and len(sink.properties()) == 2
    report = compact(spark, root, "append_only", 1 << 20, 10, 1 << 20, "ns")
    assert (report.rewritten, report.added, report.rows) == (2, 1, 4)
    assert compact(spark, root, "append_only", 1 << 20, 10, 1 << 20).rewritten == 0
    back = spark.read.parquet(f"{root}/data/{report.snapshot_id}")
    assert [r["ordering_value"] for r in back.orderBy("ordering_value").collect()] == [10, 11, 12, 13]
    with pytest.raises(ContractError):
        compact(spark, root, "keyed_upsert", 1, 2, 1)


def test_keyed_run_and_final_state(spark, workload, tmp_path):
    source = jsonl.FileSource(spark, f"file://{workload}/customer_state")
    sink, ledger = MemorySink("lose_ack"), Ledger()
    report = run_session(source.open_capture(jsonl.Selection("customer_state", "customer_state", "keyed_upsert")), sink, ledger, f"file://{tmp_path}/staging", "mem")
    assert report.batches == 2
    state = None
    for outcome in sink.commits.values():
        batch = spark.read.parquet(*outcome.files)
        state = upsert.append_rows(batch) if state is None else upsert.merge(state, batch, ["key_json"])
    assert [(r["key_json"], r["after_json"]) for r in state.collect()] == [('{"customer_id":"c1","tenant_id":"t"}', '{"status":"inactive"}')]


def test_compaction_of_more_than_a_task_sorts_keeps_the_order_of_arrival(spark, tmp_path, monkeypatch):
    root, made = f"file://{tmp_path}/lake", []
    for k, n in enumerate((700, 0, 300)):
        spark.range(n).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(f"{k}é").alias("s"), F.array("id").alias("a")).coalesce(1).write.parquet(f"{root}/data/{k}")
        made += [str(p) for p in sorted((tmp_path / "lake/data" / str(k)).glob("*.parquet"))]
    (tmp_path / "lake/_snapshots").mkdir()
    (tmp_path / "lake/_snapshots/snapshot-1").write_text("snapshot_id=snapshot-1\n" + "".join(f"file=file://{x}\n" for x in made))
    monkeypatch.setattr(compaction, "SORT_BYTES", 10_000)
    report = compact(spark, root, "append_only", 1 << 40, 100, 1 << 40)
    left = [r["file_uri"] for r in compaction.current_files(spark, root).collect()]
    assert (report.rewritten, report.rows, report.added) == (len(made), 1000, len(left)) and len(left) >= 7
    assert max(spark.read.parquet(x).count() for x in left) <= 160
    rows = compaction.arrival_numbers(compaction.in_arrival_order(spark, left))
    got = [(r["_arrival"], r["x"], r["s"], r["a"]) for r in rows.orderBy("_arrival").collect()]
    assert got == [(i + 1, j * 7919 % 1000, f"{k}é", [j]) for i, (k, j) in enumerate([(0, j) for j in range(700)] + [(2, j) for j in range(300)])]


def many_files(folder, n):
    folder.mkdir()
    for i in range(n):
        rows = [record(10 * i + k, "delete" if k == 4 else "upsert", {"id": k % 3}, None if k == 4 else {"v": i}) for k in range(5)]
        (folder / f"batch-{i:03d}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    return folder


def told(ledger):
    return [(m.batch_id, m.record_count, m.op_counts, m.content_hash, m.schema_fingerprint, m.source_checkpoint_start, m.source_checkpoint_end, len(m.file_set)) for m in ledger.manifests()]


def test_many_small_files_are_read_and_written_in_groups(spark, tmp_path, monkeypatch):
    source = jsonl.FileSource(spark, f"file://{many_files(tmp_path / 'customer_state', 7)}")
    choice, scans, scan, found = jsonl.Selection("customer_state", "customer_state", "keyed_upsert"), [], jsonl.scan, []
    monkeypatch.setattr(jsonl, "scan", lambda spark, paths: scans.append(len(paths)) or scan(spark, paths))
    for size, most in ((connector.GROUP_BYTES, [7, 7]), (0, [7] + [1] * 14)):
        scans.clear()
        monkeypatch.setattr(connector, "GROUP_BYTES", size)
        sink, ledger = MemorySink("lose_ack"), Ledger()
        report = run_session(source.open_capture(choice), sink, ledger, f"file://{tmp_path}/staging-{size}", "mem")
        assert (report.batches, report.rows, report.files, report.last_checkpoint) == (7, 21, 7, "cp-0064") and len(sink.commits) == 7
        assert len(scans) <= len(most)
        files = [f for m in ledger.manifests() for f in m.file_set]
        rows = [[r["key_json"] for r in spark.read.parquet(f.file_uri).collect()] for f in files]
        assert rows == [[f'{{"id":{k}}}' for k in range(3)]] * 7
        assert [f.file_uri.rsplit("/", 2)[1] for f in files] == [f"customer_state.batch-{i:03d}" for i in range(7)]
        found.append(told(ledger))
    assert found[0] == found[1]


def test_a_wrong_batch_of_a_group_is_told_in_its_turn(spark, tmp_path):
    folder = many_files(tmp_path / "customer_state", 5)
    rows = [record(30 + k, "upsert", {"id": k}, {"v": 1}) for k in range(2)] + [record(33, "insert", {"id": 3}, {"v": 1})]
    (folder / "batch-003.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    ledger, staging = Ledger(), tmp_path / "staging"
    session = jsonl.FileSource(spark, f"file://{folder}").open_capture(jsonl.Selection("customer_state", "customer_state", "keyed_upsert"))
    with pytest.raises(ContractError, match="batch-003.jsonl:5: keyed_upsert requires upsert or delete operations"):
        run_session(session, MemorySink(), ledger, f"file://{staging}", "mem")
    assert [m.batch_id[-3:] for m in ledger.manifests()] == ["000", "001", "002"] and session.closed
    refusing, ledger = Coordinator(), Ledger()
    refusing.checkpoint_decision = lambda _: "held"  # the run ends at its first batch: staged files of the others go
    session = jsonl.FileSource(spark, f"file://{folder}").open_capture(jsonl.Selection("customer_state", "customer_state", "keyed_upsert"))
    with pytest.raises(ContractError, match="held"):
        run_session(session, MemorySink(), ledger, f"file://{staging}-2", "mem", coordinator=refusing)
    assert [p.name for p in (tmp_path / "staging-2/customer_state").iterdir()] == ["customer_state.batch-000"]


def test_run_that_ended_after_its_commit_does_not_commit_again(spark, workload, tmp_path):
    source = jsonl.FileSource(spark, f"file://{workload}/orders_events")
    choice = jsonl.Selection("orders_events", "orders_events", "append_only")
    sink, ledger = MemorySink(), Ledger()
    session = source.open_capture(choice)
    session.checkpoint = lambda *_: (_ for _ in ()).throw(RuntimeError("process ends"))
    with pytest.raises(RuntimeError):
        run_session(session, sink, ledger, f"file://{tmp_path}/staging", "mem", 1)
    assert ledger.last_durable_checkpoint("orders_events") is None and len(sink.commits) == 1
    report = run_session(source.open_capture(choice), sink, ledger, f"file://{tmp_path}/staging", "mem")
    assert report.batches == 2 and len(sink.commits) == 2


def test_gates():
    gate = Coordinator()
    assert gate.try_admit("a") is None and gate.try_admit("a") == "table budget exhausted" and gate.try_admit("b") is None
    assert gate.checkpoint_decision("a") == "batch in flight"
    gate.record_unresolved("a")
    assert gate.checkpoint_decision("a") == "unresolved commit"
    gate.set_external_depth(1)
    assert gate.try_admit("c") == "recovery queue saturated"
    gate.record_committed("a")
    assert gate.try_admit("c") is None and "a" not in gate.budgets
    assert Coordinator(0).recovery_limit == 1


def test_schema_policy_forms_agree(spark):
    plan = {r["change_id"]: r["decision"] for r in schema_policy.decisions(*schema_policy.example_changes(spark)).collect()}
    current = schema_policy.Schema(tuple(schema_policy.Column(*c) for c in schema_policy._CURRENT), ("id",))
    for name, (columns, keys) in schema_policy._CHANGES.items():
        after = schema_policy.Schema(tuple(schema_policy.Column(*c) for c in columns), keys)
        assert (schema_policy.evaluate(current, after) or "allow") == plan[name], name


# ---- configuration and commands


def write_config(tmp_path, workload, tables, destination='kind = "filesystem"\n[properties]\nroot_uri = "file://{0}/lake"\n'):
    root = tmp_path / "config"
    for folder in ("sources", "destinations", "connectors"):
        (root / folder).mkdir(parents=True, exist_ok=True)
    (root / "sources/s.toml").write_text(f'version = 1\nkind = "file"\n[properties]\nfixture_root = "{workload}"\n')
    (root / "destinations/d.toml").write_text("version = 1\n" + destination.format(tmp_path))
    body = 'version = 1\nsource = "s"\ndestination = "d"\n' + "".join(f"[[tables]]\n{t}\n" for t in tables)
    (root / "connectors/c.toml").write_text(body)
    return root / "connectors/c.toml"


ORDERS = 'source_schema = ""\nsource_table = "orders_events"\ndestination_namespace = "{0}"\ndestination_table = "orders"\ntable_mode = "append_only"'


def test_connector_check_and_run(spark, workload, tmp_path, capsys):
    path = write_config(tmp_path, workload, [ORDERS.format("left"), ORDERS.format("right")])
    assert C.check_connector(spark, path) == {"valid": True, "errors": [], "warnings": [], "table_count": 2}
    ledger = Ledger()
    total = cli.run_connector(spark, str(path), ledger, 3)
    assert total.batches == 3
    assert ledger.last_durable_checkpoint("left.orders")[1] == "cp-0013" and ledger.last_durable_checkpoint("right.orders")[1] == "cp-0011"
    bad = write_config(tmp_path, workload, ['source_table = "customer_state"\ndestination_namespace = ""\ndestination_table = ""\ntable_mode = "keyed_upsert"'])
    report = C.check_connector(spark, bad)
    assert not report["valid"] and len(report["errors"]) == 3 and len(report["warnings"]) == 1
    assert cli.main(["connector", "check", "--connector", str(bad)], spark) == 1
    assert cli.main(["source", "check", "--source", str(tmp_path / "config/sources/s.toml"), "--table", "orders_events"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["details"]["batch_count"] == 2


def test_run_command(spark, workload, tmp_path, capsys):
    args = ["run", "--workload", "append_only.orders_events", "--destination-uri", str(tmp_path / "out"), "--data-dir", f"file://{workload}", "--ledger", str(tmp_path / "l.sqlite")]
    assert cli.main(args, spark) == 0
    assert json.loads(capsys.readouterr().out)["batches_committed"] == 2
    assert cli.main(args, spark) == 0
    assert json.loads(capsys.readouterr().out)["batches_committed"] == 0
    assert cli.main(["run", "--workload", "x", "--destination-uri", "y"], spark) == 1


def test_env_and_versions(tmp_path):
    assert C.resolve_env({"a": "$X", "b": "$$X", "c": "x"}, {"X": "1"}) == {"a": "1", "b": "$X", "c": "x"}
    with pytest.raises(ContractError):
        C.resolve_env({"a": "$MISSING"}, {})
    (tmp_path / "x.toml").write_text("version = 2\n")
    with pytest.raises(ContractError, match="version"):
        C.load("source", tmp_path / "x.toml")
    with pytest.raises(ContractError):
        C.config_root(tmp_path / "x.toml")


def test_rest_catalogue_requests():
    from millrace.sources.rest import RestCatalog

    asked = []

    def answers(config):
        def send(method, url, headers, form):
            asked.append((method, url, headers.get("Authorization"), form))
            return {"access_token": "granted", "expires_in": 3600} if method == "POST" else config if "/config" in url else {"properties": {"a": "1"}}

        return send

    plain = RestCatalog("http://c/", "ware house", {}, answers({}))
    assert plain.prefix() == "ware house" and plain.headers() == {"Accept": "application/json"}
    assert asked == [("GET", "http://c/v1/config?warehouse=ware+house", None, None)]
    assert RestCatalog("http://c", "w", {}, answers({"defaults": {"prefix": "d"}, "overrides": {"prefix": "o"}})).prefix() == "d"
    assert RestCatalog("http://c", "w", {}, answers({"overrides": {"prefix": "o"}})).prefix() == "o"
    assert RestCatalog("http://c", "w", {"bearer_token": "t", "client_id": "x"}, answers({})).headers()["Authorization"] == "Bearer t"
    asked.clear()
    client = RestCatalog("http://c", "w", {"client_id": "i", "client_secret": "s"}, answers({"defaults": {"prefix": "p/q"}}))
    assert client.namespace_properties("n.m") == {"a": "1"}
    assert asked[0] == ("POST", "http://c/v1/oauth/tokens", None, {"grant_type": "client_credentials", "client_id": "i", "client_secret": "s", "scope": "PRINCIPAL_ROLE:ALL"})
    assert [a[:3] for a in asked[1:]] == [("GET", "http://c/v1/config?warehouse=w", "Bearer granted"), ("GET", "http://c/v1/p%2Fq/namespaces/n%1Fm", "Bearer granted")]
    with pytest.raises(ContractError, match="client_secret"):
        RestCatalog("http://c", "w", {"client_id": "i"}, answers({})).token()


# ---- streams


def test_stream_commits_files_in_name_order(spark, workload, tmp_path):
    from millrace.streaming import stream

    folder = workload / "orders_events"
    source = jsonl.FileSource(spark, f"file://{folder}")
    choice = jsonl.Selection("orders_events", "orders_events", "append_only")
    sink, path = MemorySink(), str(tmp_path / "ledger.sqlite")
    for expected in (2, 1):
        query, report = stream.start(spark, source, choice, sink, path, f"file://{tmp_path}/staging", "mem", f"file://{tmp_path}/checkpoint", {"availableNow": True})
        assert query.awaitTermination(120) and query.exception() is None
        assert report.batches == expected
        (folder / "batch-0003.jsonl").write_text(json.dumps(record(14, after={"a": 1})))
    ledger = Ledger(path)
    assert ledger.last_durable_checkpoint("orders_events")[1] == "cp-0014" and len(sink.commits) == 3


def test_late_changes_across_batches(spark, tmp_path):
    from millrace.streaming import stream

    folder = tmp_path / "late"
    folder.mkdir()
    for name, orderings in (("batch-0001.jsonl", (1, 5)), ("batch-0002.jsonl", (3, 7))):
        (folder / name).write_text("\n".join(json.dumps(record(o, "upsert", {"id": 1}, {"v": o})) for o in orderings))
    late = stream.late_changes(stream.change_stream(spark, f"file://{folder}").select("file", "pos", "key_json", "ordering_value"))
    query = late.writeStream.format("memory").queryName("late_rows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/late-cp").start()
    assert query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("late_rows").collect()] == [('{"id":1}', 3, 5)]


def test_record_constructors(spark):
    from millrace import contracts

    rows = contracts.build(spark, [contracts.upsert([("b", 1), ("a", "x")], {"z": 1, "y": 2}, 5), contracts.delete([("b", 1)], 6)])
    assert [(r["op"], r["key_json"], r["after_json"], r["pos"]) for r in rows.orderBy("pos").collect()] == [("upsert", '{"b":1,"a":"x"}', '{"y":2,"z":1}', 1), ("delete", '{"b":1}', None, 2)]
    for bad in (lambda: contracts.upsert([], {}, 1), lambda: contracts.upsert([("a", 1), ("a", 2)], {}, 1), lambda: contracts.upsert([(" ", 1)], {}, 1)):
        with pytest.raises(ContractError):
            bad()
    with pytest.raises(ContractError, match="append_only requires insert"):
        contracts.build(spark, [contracts.upsert([("a", 1)], {}, 1, table_mode="append_only")])
