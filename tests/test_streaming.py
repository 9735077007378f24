"""Live jobs give the rows of their batch form."""

import pytest
from pyspark.sql import functions as F

from repolens.plans.incremental import full_build
from repolens.sources import facts as fa
from repolens.operators import symbols
from repolens.streaming import index_stream, live, state

T = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    from checks.views import Tables

    return Tables(spark, T)


def events(spark):
    from checks.views import Tables

    rows = Tables(spark, T).events
    return rows.withColumn("ts", rows["ts"].cast("timestamp")).select("event_id", "repo_hash", "ts", "event", "layer", "node_id", "value")


def in_two_halves(spark, rows, folder, run):
    """Write shuffled rows in two parts and run the job after each: the second run starts from the checkpoint."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows
    for half in range(2):
        part = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).orderBy(F.xxhash64("event_id", F.lit(7))).repartition(3)
        part.write.mode("append").parquet(folder)
        run(live.read_events(spark, folder, rows.schema, files_per_trigger=2)).awaitTermination(170)


def test_latest_by_key(spark, tmp_path):
    folder, target, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    in_two_halves(spark, events(spark), folder, lambda s: live.run_latest(s, target, cp))
    got = {(r.repo_hash, r.layer, r.node_id, r.event, r.event_id) for r in live.newest_rows(spark, target, ["repo_hash", "layer", "node_id"]).collect()}
    assert got == {(r.repo_hash, r.layer, r.node_id, r.event, r.event_id) for r in state.fold_deltas(events(spark)).collect()}


def test_activity(spark, tmp_path, tables):
    from checks.state_checks import activity

    folder, target, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    in_two_halves(spark, activity(tables), folder, lambda s: live.run_activity(s, target, cp))
    got = {(r.repo_hash, r.activity_id): (r.query_type, r.task, r.status, r.first_id) for r in live.newest_rows(spark, target, ["repo_hash", "activity_id"]).collect()}
    want = {(r.repo_hash, r.activity_id): (r.query_type, r.task, r.status, r.first_seen.event_id) for r in state.fold_activity(activity(tables), keep=10**6).collect()}
    assert got == want


def test_runs(spark, tmp_path, tables):
    from checks.state_checks import RUN_EVENTS

    folder, target, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = tables.sql(RUN_EVENTS)
    in_two_halves(spark, rows, folder, lambda s: live.run_runs(s, target, cp))
    got = {(r.repo_hash, r.run_id, r.started_at, r.n_steps, r.status) for r in live.newest_rows(spark, target, ["repo_hash", "run_id"]).collect()}
    batch = state.fold_runs(rows.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("started_at", F.unix_micros("started_at"))
    assert got == {(r.repo_hash, r.run_id, r.started_at, r.n_steps, r.status) for r in batch.collect()}


def test_highlights_expire(spark, tmp_path, tables):
    from checks.state_checks import highlights

    folder, target, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = highlights(tables).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.parquet(folder)
    query = live.run_highlights(live.read_events(spark, folder, rows.schema), target, cp)
    query.awaitTermination(170)
    last = rows.agg(F.max("ts")).first()[0]
    as_of = F.lit(last) - F.expr("INTERVAL 10 SECONDS")
    feed = {r.event_id: r.state for r in live.newest_rows(spark, target, ["repo_hash", "event_id"]).collect()}
    want = {r.event_id for r in state.live_highlights(rows, as_of).collect()}
    assert len(feed) == rows.count() and "expired" in feed.values()
    assert {i for i, s in feed.items() if s == "live"} == want


def test_activity_highlights_read_new_names(spark, tmp_path):
    folder, nodes, target, cp = (str(tmp_path / n) for n in ("in", "nodes", "out", "cp"))
    schema = "repo_hash string, activity_id long, names array<string>"
    node = lambda label, i: spark.createDataFrame([("r", label, i)], "repo_hash string, label string, id string")
    node("a.f", "s1").write.mode("append").parquet(nodes)
    for activity_id in (1, 2):
        spark.createDataFrame([("r", activity_id, ["a.f", "a.g", "none"])], schema).write.mode("append").parquet(folder)
        live.run_activity_highlights(live.read_events(spark, folder, schema), nodes, target, cp).awaitTermination(170)
        node("a.g", "s2").write.mode("append").parquet(nodes)
    assert {(r.activity_id, r.id) for r in spark.read.parquet(target).collect()} == {(1, "s1"), (2, "s1"), (2, "s2")}


def test_bursts(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(folder)
    live.run_bursts(live.read_events(spark, folder), str(tmp_path / "out"), str(tmp_path / "cp"), "10 minutes").awaitTermination(120)
    changes = events(spark).where("event IN ('node_added', 'node_updated', 'edge_added')")
    want = {(r.repo_hash, r.layer, r.refresh_at, r.n) for r in state.refresh_bursts(changes, "10 minutes").collect()}
    got = {(r.repo_hash, r.layer, r.refresh_at, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # Sessions still open at the watermark of the last event stay in state.
    assert got <= want and len(want - got) <= 12


FILES = {
    "/w/a.py": "import b\n\ndef top(x):\n    return b.mid(x)\n",
    "/w/b.py": "from c import leaf\n\ndef mid(x):\n    return leaf(x)\n",
    "/w/c.py": "def leaf(x):\n    return check_password(x)\n\ndef check_password(x):\n    return x\n",
}
EDITS = [
    {
        "/w/b.py": "from c import leaf\n\ndef mid(x):\n    return other(x)\n\ndef other(x):\n    return leaf(x)\n", "/w/c.py": None,
        "/w/d.py": "from b import mid\n\nclass Box:\n    def run(self):\n        return mid(self)\n",
    },
    {"/w/c.py": FILES["/w/c.py"]},
]


def test_incremental_index_equals_a_full_build(spark, tmp_path):
    folder, root, cp = (str(tmp_path / n) for n in ("in", "index", "cp"))
    now: dict[str, str | None] = {}

    def rows(files, day):
        frame = spark.createDataFrame([("r", "/w", p, text) for p, text in files.items()], "repo_hash string, root string, file_path string, content string")
        return frame.selectExpr("repo_hash", "root", "file_path", f"timestamp '2024-01-0{day}' last_modified", "content")

    for day, files in enumerate([FILES, *EDITS], 1):
        now |= files
        rows(files, day).write.mode("append").parquet(folder)
        index_stream.run_incremental_index(spark, folder, root, cp).awaitTermination(170)
        parsed = fa.syntax_facts(rows({p: text for p, text in now.items() if text is not None}, 9))
        want = full_build(symbols.give_ids(symbols.raw_symbols(parsed)), symbols.raw_refs(parsed))
        got = index_stream.read_state(spark, root)
        for a, b in ((got.symbols, want.symbols), (got.refs, want.refs), (got.flows, want.flows)):
            columns = sorted(c for c in a.columns if c != "seq")
            assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))
        assert day > 1 or got.flows.count() == 2
