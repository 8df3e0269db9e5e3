import pytest
from pyspark.sql import functions as F

from tarnflow.sources.table import CommitConflict, SnapshotTable, merged


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/t")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string, w string, at int")


def rows(df):
    return sorted(((r.k, r.v, r.w, r["at"]) for r in df.collect()), key=str)


BASE = ((1, "a", "x", 0), (2, None, "x", 0), (3, "c", None, 0))
NEW = ((1, "a", "x", 9), (2, "b", "x", 9), (3, None, None, 9), (4, "d", "x", 9))


def test_upsert_touches_only_differences(spark, table):
    table.overwrite(frame(spark, *BASE).repartition(3, "k"))
    source = frame(spark, *NEW)
    assert table.merge_upsert(source, ["k"], ["v", "w"]) == {"inserted": 1, "updated": 2}
    want = sorted(((1, "a", "x", 0), *NEW[1:]), key=str)
    assert rows(table.read()) == want
    assert rows(merged(frame(spark, *BASE), source, ["k"], ["v", "w"])) == want
    before = table.versions()
    assert table.merge_upsert(source, ["k"], ["v", "w"]) == {"inserted": 0, "updated": 0}
    assert table.versions() == before
    with pytest.raises(ValueError, match="several rows"):
        table.merge_upsert(source.union(source), ["k"], ["v", "w"])
    assert rows(table.read(0)) == sorted(BASE, key=str)


def test_upsert_broadcasts_no_table(spark, table, monkeypatch):
    # By their compressed files both sides would be small enough.
    plans, write = [], table._write
    monkeypatch.setattr(table, "_write", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    base = spark.range(20_000).selectExpr("cast(id as int) k", "'v' v", "repeat('w', 100) w", "0 at")
    table.overwrite(base)
    source = base.selectExpr("case when k % 10 = 0 then k + 20000 else k end k", "if(k % 10 = 1, 'new', v) v", "w", "1 at")
    assert table.merge_upsert(source, ["k"], ["v", "w"]) == {"inserted": 2000, "updated": 2000}
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]
    assert table.read().groupBy("at").count().orderBy("at").collect() == [(0, 18_000), (1, 4000)]


def test_change_feed_and_history(spark, table):
    table.overwrite(frame(spark, *BASE), inputs=["raw"])
    table.merge_upsert(frame(spark, *NEW), ["k"], ["v", "w"])
    feed = {(r._change, r.k, r.v) for r in table.changes(0, 1, ["k"]).collect()}
    assert feed == {("insert", 4, "d"), ("update_before", 2, None), ("update_after", 2, "b"), ("update_before", 3, "c"), ("update_after", 3, None)}
    assert [(r.version, r.operation) for r in table.history().orderBy("version").collect()] == [(0, "overwrite"), (1, "merge")]


def test_insert_only_is_null_safe_and_first_wins(spark, table):
    table.overwrite(frame(spark, (1, "a", "x", 0), (None, "n", "x", 0)))
    source = frame(spark, (1, "z", "z", 1), (None, "m", "x", 1), (2, "b", "x", 1))
    assert table.merge_insert_only(source, ["k"]) == {"inserted": 1}
    assert table.merge_insert_only(source, ["k"]) == {"inserted": 0}
    assert rows(table.read()) == sorted([(1, "a", "x", 0), (None, "n", "x", 0), (2, "b", "x", 1)], key=str)


def test_constraints_hold_atomically(spark, table):
    table.overwrite(frame(spark, *BASE))
    with pytest.raises(ValueError, match="named"):
        table.add_constraint("named", "v is not null")
    table.add_constraint("keyed", "k > 0")
    for bad in ((0, "a", "a", 1), (None, "a", "a", 1)):
        with pytest.raises(Exception, match="keyed"):
            table.append(frame(spark, (7, "ok", "x", 1), bad))
    assert table.read().count() == 3
    table.append(frame(spark, (7, "ok", "x", 1)))
    assert table.read().count() == 4


def test_batches_append_once_and_schemas_merge(spark, table):
    table.append(frame(spark, *BASE), batch=("q", 0))
    assert table.append(frame(spark, *BASE), batch=("q", 0)) is None
    wide = frame(spark, (9, "i", "x", 1)).withColumn("extra", F.lit(5))
    with pytest.raises(ValueError, match="extra"):
        table.append(wide)
    table.append(wide, merge_schema=True, batch=("q", 1))
    assert sorted((r.k, r.extra or 0) for r in table.read().collect()) == [(1, 0), (2, 0), (3, 0), (9, 5)]


def test_compaction_keeps_rows_and_conflicts_are_refused(spark, table):
    table.overwrite(frame(spark, *BASE).repartition(3))
    stale = table._next("append")
    table.compact(1, cluster_by=["k"])
    assert len(table.entry().files) == 1 and rows(table.read()) == sorted(BASE, key=str)
    with pytest.raises(CommitConflict):
        table._commit(stale)


def test_metadata_survives_commits(spark, table):
    table.overwrite(frame(spark, *BASE))
    table.annotate("things", {"layer": "silver"}, {"v": {"pii": "name"}}, owner="me")
    table.overwrite(frame(spark, *BASE[:1]))
    e = table.entry()
    assert (e.comment, e.tags, e.column_tags, e.properties) == ("things", {"layer": "silver"}, {"v": {"pii": "name"}}, {"owner": "me"})


def test_a_snapshot_rewrites_touched_files_only(spark, tmp_path):
    from tarnflow.operators import temporal as T
    from tarnflow.plans import retail

    day = lambda x: F.lit(x).cast("date")
    t = SnapshotTable(spark, f"file://{tmp_path}/versions")
    first = spark.range(1000).select("id", F.lit("a").alias("v"), day("2025-01-01").alias("seq"))
    t.overwrite(T.scd2_initial(first, ["id"], ["v"], "seq"))
    t.compact(4, cluster_by=["id"])
    before = set(t.entry().files)
    assert len(before) == 4
    second = spark.range(1005).select("id", F.when(F.col("id") == 7, "b").otherwise("a").alias("v"), day("2025-01-08").alias("seq"))
    assert retail.apply_snapshot(t, second, ["id"], ["v"], "seq") == {"inserted": 5, "updated": 1}
    assert len(before - set(t.entry().files)) == 1
    assert t.read().count() == 1006 and t.read().where("is_current").count() == 1005 and t.read().select("version_id").distinct().count() == 1006
    version = t.entry().version
    assert retail.apply_snapshot(t, second.withColumn("seq", day("2025-01-15")), ["id"], ["v"], "seq") == {"inserted": 0, "updated": 0} and t.entry().version == version


def test_conflict_batches_and_vacuum(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.overwrite(spark.range(3))
    stale = t._next("append")
    t.append(spark.range(2), batch=("q", 0))
    with pytest.raises(CommitConflict):
        t._commit(stale)
    assert t.append(spark.range(2), batch=("q", 0)) is None and t.append(spark.range(2), batch=("q", 1)) is not None
    assert t.append(spark.range(2), batch=("other", 0)) is not None and t.read().count() == 9
    files = t.entry().files
    t._write(spark.range(5))
    assert len(t.vacuum()) == 1 and t.entry().files == files and t.read().count() == 9 and t.vacuum() == []
    t.merge_insert_only(spark.range(2), ["id"])
    assert t.vacuum() == []
