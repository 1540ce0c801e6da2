"""Commits, retry state, enrichment and aggregates kept by deltas, over several batches, late rows and broken runs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from groundplan.sources.snapshots import Conflict, SnapshotTable
from groundplan.streaming import arrivals, enrichment, retries

START = datetime(2024, 5, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_are_whole_and_conflict(spark, tmp_path):
    make = lambda: SnapshotTable(spark, str(tmp_path / "t"), "k long, v string")
    table, other = make(), make()
    assert rows(table.read()) == [] and table.history() == []
    of = lambda *r: spark.createDataFrame(r, "k long, v string")
    assert table.append(of((1, "a"), (2, "b"))) == 0
    assert other.append(of((1, "c")), "w", [4]) == 1
    assert table.append(of((1, "twice")), "w", [4]) == 1 and table.append(of((1, "old")), "w", [3]) == 1  # batches that are in already
    assert rows(table.read()) == [(1, "a"), (1, "c"), (2, "b")] and rows(table.read(0)) == [(1, "a"), (2, "b")]
    assert rows(table.current(["k"], F.col("v"))) == [(1, "c"), (2, "b")]

    def meanwhile(df):
        other.append(of((3, "d")))
        return df.where("k = 1")

    with pytest.raises(Conflict):
        table.replace(meanwhile)
    assert len(rows(table.read())) == 4
    table.compact(["k"], F.col("v"))
    assert rows(table.read()) == [(1, "c"), (2, "b"), (3, "d")] and len(table.last()["folders"]) == 1 and table.last()["rows"] == 3
    assert table.has("w", [4]) and not table.has("w", [5])
    assert table.vacuum() >= 3 and rows(table.read()) == [(1, "c"), (2, "b"), (3, "d")]
    assert [e["operation"] for e in table.history()] == ["append", "append", "append", "compact"]


def test_an_append_while_a_compaction_runs_is_kept(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k long")
    table.append(spark.range(3).toDF("k"))
    written = table._written

    def slow(df):
        found = written(df)
        SnapshotTable(spark, str(tmp_path / "t"), "k long").append(spark.range(7, 9).toDF("k"))
        return found

    monkeypatch.setattr(table, "_written", slow)
    table.compact()
    assert [k for k, in rows(table.read())] == [0, 1, 2, 7, 8] and len(table.last()["folders"]) == 2
    monkeypatch.undo()
    stale = SnapshotTable(spark, str(tmp_path / "t"), "k long")
    monkeypatch.setattr(stale, "_written", lambda df: (table.compact(), written(df))[1])
    with pytest.raises(Conflict):
        stale.compact()


def attempts_by_hand(events, mark):
    """The last state of each upload, from a plain replay."""
    found = {}
    for upload in {e[0] for e in events}:
        tries = sorted({(at, number, outcome) for u, at, number, outcome in events if u == upload and at <= mark})
        due_at = completed = status = None
        due = 0
        for n, (at, _, outcome) in enumerate(tries, 1):
            due += due_at is not None and due_at < at
            status = {"completed": "completed", "needs_review": "needs_review", "permanent": "failed"}.get(outcome) or ("retrying" if n < 5 else "failed")
            due_at, completed = (at + timedelta(seconds=min(60 * 2 ** (n - 1), 21600)), None) if status == "retrying" else (None, at)
        if due_at is not None and due_at <= mark:
            due, due_at = due + 1, None
        if tries:
            found[upload] = (len(tries), status, tries[0][0], due_at, completed, due)
    return found


def attempts_of(spark, source, base, batches):
    """The table after these batches, each run by a query of its own over the same checkpoint."""
    table = SnapshotTable(spark, f"{base}/table", retries.STEPS)
    for batch in batches:
        spark.createDataFrame([(u, at, n, o, "e") for u, at, n, o in batch], "upload_id string, attempted_at timestamp, attempt_id long, outcome string, error string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("upload_id string, attempted_at timestamp, attempt_id long, outcome string, error string").parquet(source)
        arrivals.into_table(retries.attempts(stream, "2 hours"), table, "w", f"{base}/c").awaitTermination()
    return table


def test_attempts_in_any_order_and_split(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.PROVIDER)
    rng = random.Random(9)
    events = [(f"u{rng.randrange(12)}", START + timedelta(minutes=rng.randrange(0, 1500), milliseconds=n), n, rng.choice(["completed", "needs_review", "permanent", "slow", "slow", "slow"])) for n in range(120)]
    events.sort(key=lambda e: e[1])
    mark = events[-1][1] - timedelta(hours=2)
    want = attempts_by_hand(events, mark)
    late = [events[:50], events[45:90] + events[:10], events[90:]]  # repeated ones, and ones far behind the watermark
    for part in late:
        rng.shuffle(part)
    shuffled = sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.randrange(0, 60)))  # out of order, within the watermark
    for name, batches in (("one", [events]), ("three", late), ("mixed", [shuffled[:40], shuffled[40:80], shuffled[80:]])):
        table = attempts_of(spark, str(tmp_path / f"in-{name}"), str(tmp_path / name), batches)
        last = {r.upload_id: (r.attempts, r.status, r.started_at, r.next_attempt_at, r.completed_at, r.due) for r in table.current(["upload_id"], F.col("step")).collect()}
        assert last == want
        assert table.read().groupBy("upload_id", "step").count().where("count > 1").isEmpty()


def test_attempts_share_timers_and_end_at_the_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.PROVIDER)
    rng = random.Random(4)
    events = [(f"u{n % 20}", START + timedelta(seconds=7 * n, microseconds=n), n, rng.choice(["completed", "permanent", "slow", "slow"])) for n in range(1500)]
    mark = (events[-1][1] - timedelta(hours=2)).replace(microsecond=1000)  # watermarks are whole milliseconds
    events += [("at", mark, 5000, "slow"), ("below", mark - timedelta(microseconds=300), 5001, "completed"), ("above", mark + timedelta(microseconds=1), 5002, "slow"), ("due", mark - timedelta(seconds=60), 5003, "slow")]
    schema = "upload_id string, attempted_at timestamp, attempt_id long, outcome string, error string"
    spark.createDataFrame([*((*e, "e") for e in events), ("odd", mark, None, None, None), ("never", None, 1, "slow", "e"), ("odd", mark, 6000, "slow", "e")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = SnapshotTable(spark, str(tmp_path / "t"), retries.STEPS)
    query = arrivals.into_table(retries.attempts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "2 hours"), table, "w", str(tmp_path / "c"))
    query.awaitTermination()
    last = {r.upload_id: (r.attempts, r.status, r.started_at, r.next_attempt_at, r.completed_at, r.due) for r in table.current(["upload_id"], F.col("step")).collect()}
    assert last.pop("odd")[:2] == (2, "retrying") and table.current(["upload_id"], F.col("step")).where("upload_id = 'odd'").first().last_error is None
    assert last == attempts_by_hand(events, mark) and {"at", "below", "due"} < set(last) and last["due"][-1] == 1
    timers = sum(op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators)
    assert 0 < timers <= 2 * 25


def test_a_batch_of_many_commits_is_joined_once(spark, tmp_path, monkeypatch):
    joins, plain = [], enrichment.enriched
    monkeypatch.setattr(enrichment, "enriched", lambda *a: joins.append(1) or plain(*a))
    source, schema = str(tmp_path / "in"), "property_id long, postcode string, address string"
    spark.range(300).selectExpr("id AS property_id", "'AB1 2CD' AS postcode", "concat(id, ' High Street') AS address").coalesce(1).write.parquet(source)
    known = enrichment.references(spark.createDataFrame([("AB1 2CD", "7 high street", "11")], "postcode string, address string, uprn string"))
    table = SnapshotTable(spark, str(tmp_path / "t"), schema + ", " + enrichment.ADDED)
    enrichment.enrich(spark.readStream.schema(schema).parquet(source), known, table, "property_id", str(tmp_path / "c"), rows=10).awaitTermination()
    assert len(joins) == 1 and table.last()["version"] == 29 and table.last()["rows"] == 300
    assert [e["part"] for e in table.history()] == list(range(1, 31)) and max(b["rows"] - a["rows"] for a, b in zip(table.history(), table.history()[1:])) < 40
    assert sorted((r.property_id, r.uprn) for r in table.read().collect() if r.uprn) == [(7, "11")] and table.vacuum() == 0 and table.read().count() == 300


def test_enrichment_goes_on_where_it_broke(spark, tmp_path, monkeypatch):
    known = enrichment.references(spark.createDataFrame([("AB1 2CD", "1 High Street, Town", "11"), ("ab12cd", "1 high street town", "10"), ("AB1 2CD", "2 Low Road", None)], "postcode string, address string, uprn string"))
    source = str(tmp_path / "in")
    places = [("AB1 2CD", "1 High  Street, Town"), ("AB1 2CD", "2 Low Road"), (None, None), ("ab1 2cd", "1 HIGH STREET, TOWN")]
    schema = "property_id long, postcode string, address string"
    spark.createDataFrame([(k, *places[k % 4]) for k in range(100)], schema).coalesce(2).write.parquet(source)
    table = SnapshotTable(spark, str(tmp_path / "t"), schema + ", " + enrichment.ADDED)
    run = lambda: enrichment.enrich(spark.readStream.schema(schema).parquet(source), known, table, "property_id", str(tmp_path / "c"), rows=20)
    append, seen = SnapshotTable.append, []

    def failing(self, *args, **more):
        if len(seen) == 2:
            raise RuntimeError("killed half-way")
        seen.append(append(self, *args, **more))
        return seen[-1]

    monkeypatch.setattr(SnapshotTable, "append", failing)
    with pytest.raises(Exception, match="killed half-way"):
        run().awaitTermination()
    part = table.read().count()
    assert 0 < part < 100 and enrichment.progress(table) == {"commits": 2, "rows": part, "part": 2, "parts": 5}
    assert sum(r.n for r in enrichment.status(table).collect()) == part
    monkeypatch.undo()
    run().awaitTermination()
    found = {r.property_id: (r.uprn, r.enrichment_status) for r in table.read().collect()}
    assert table.read().count() == 100 and len(found) == 100
    assert found == {k: ("10", "enriched") if k % 4 in (0, 3) else (None, "failed") for k in range(100)}
    assert enrichment.progress(table)["part"] == 5 and table.last()["version"] == 4


def test_aggregates_are_kept_by_deltas(spark, tmp_path):
    source, table = str(tmp_path / "in"), SnapshotTable(spark, str(tmp_path / "t"), "k long, n long, last long")
    sums, highest = {"n": F.col("sign")}, {"last": F.col("v")}
    for batch in ([(1, 10, 1), (2, 20, 1)], [(2, 21, 1), (3, 30, 1), (1, 10, -1)], [(4, 40, 1)]):
        spark.createDataFrame(batch, "k long, v long, sign int").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v long, sign int").parquet(source)
        arrivals.maintained(stream, ["k"], sums, highest, table, "w", str(tmp_path / "c")).awaitTermination()
    want = [(1, 0, 10), (2, 2, 21), (3, 1, 30), (4, 1, 40)]
    assert rows(arrivals.totals(table.read(), ["k"], sums, highest)) == want
    assert table.last()["rows"] == 6  # a delta for each key of each batch, and no more
    arrivals.fold(table, ["k"], sums, highest)
    assert rows(table.read()) == want


def test_a_late_older_row_does_not_win(spark, tmp_path):
    source, table = str(tmp_path / "in"), SnapshotTable(spark, str(tmp_path / "t"), "user_id long, event_id long")
    for event in (100, 50):
        spark.createDataFrame([(1, event)], "user_id long, event_id long").write.mode("append").parquet(source)
        arrivals.into_table(spark.readStream.schema("user_id long, event_id long").parquet(source), table, "w", str(tmp_path / "c")).awaitTermination()
    assert rows(table.current(["user_id"], F.col("event_id"))) == [(1, 100)]
