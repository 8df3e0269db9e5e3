import json

import pytest
from pyspark.sql import types as T

from tarnflow import streaming
from tarnflow.sources import files
from tarnflow.sources.table import SnapshotTable


def lines(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


class Source:
    def __init__(self, spark, root, fmt="json", **kw):
        self.spark, self.root, self.fmt, self.kw = spark, root, fmt, kw
        self.table = SnapshotTable(spark, f"file://{root}/table")

    def run(self):
        s = files.file_stream(self.spark, f"file://{self.root}/land", self.fmt, f"file://{self.root}/schema", **self.kw)
        return streaming.ingest(files.add_lineage(s.select("*", "_metadata")), self.table, f"file://{self.root}/checkpoint")


def test_each_file_once_nested_and_with_lineage(spark, tmp_path):
    s = Source(spark, tmp_path)
    lines(tmp_path / "land/day=1/a.json", {"id": 1}, {"id": 2})
    assert s.run() == 2 and s.run() == 0
    lines(tmp_path / "land/deep/er/b.json", {"id": 3}, '{"id": 4, "x')
    assert s.run() == 2
    got = s.table.read()
    assert got.where("_rescued_data is not null").count() == 1
    assert got.where("_source_file like '%.json' and _source_file_size > 0 and _ingestion_timestamp is not null").count() == 4


def test_new_columns_by_mode(spark, tmp_path):
    for mode in files.MODES:
        root = tmp_path / mode
        s = Source(spark, root, mode=mode)
        lines(root / "land/a.json", {"id": 1})
        s.run()
        lines(root / "land/b.json", {"id": 2, "code": "x"})
        if mode == "failOnNewColumns":
            with pytest.raises(files.SchemaChanged, match="code"):
                s.run()
            continue
        s.run()
        rows = {r.id: r.asDict() for r in s.table.read().collect()}
        assert rows.keys() == {1, 2}
        if mode == "addNewColumns":
            assert rows[1]["code"] is None and rows[2]["code"] == "x"
        else:
            assert "code" not in rows[2]
            assert (rows[2]["_rescued_data"] == '{"code":"x"}') == (mode == "rescue")


def test_hints_and_csv(spark, tmp_path):
    s = Source(spark, tmp_path, "csv", hints="price double, active boolean")
    (tmp_path / "land").mkdir()
    (tmp_path / "land/a.csv").write_text("id,price,active\n1,2,True\n2,3,False\n")
    s.run()
    assert {(r.id, r.price, r.active) for r in s.table.read().collect()} == {(1, 2.0, True), (2, 3.0, False)}


def test_stream_equals_batch_for_parquet(spark, tmp_path):
    spark.range(20).selectExpr("id", "map('a', cast(id as string)) as address").write.parquet(f"file://{tmp_path}/land/week_001")
    s = Source(spark, tmp_path, "parquet")
    s.run()
    batch = files.read_files(spark, f"file://{tmp_path}/land", "parquet")
    assert s.table.read().selectExpr("id", "address.a").exceptAll(batch.selectExpr("id", "address.a")).count() == 0
    assert s.table.read().count() == 20


def test_evolve_rejects_unknown_modes():
    with pytest.raises(ValueError):
        files.evolve(None, T.StructType(), "maybe")


def test_unknown_trigger(spark, tmp_path):
    df = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="trigger"):
        streaming.append_stream(df, SnapshotTable(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}/c", trigger="now")


def test_sinks_and_listing(spark, tmp_path):
    df = spark.range(3).selectExpr("id", "cast(id as string) s")
    files.write_csv(df, f"file://{tmp_path}/csv")
    files.write_jsonl(df, f"file://{tmp_path}/json")
    files.write_parquet_file(df, f"file://{tmp_path}/pq")
    assert files.read_files(spark, f"file://{tmp_path}/csv", "csv").count() == 3
    assert files.read_files(spark, f"file://{tmp_path}/json", "json").count() == 3
    assert files.list_files(spark, f"file://{tmp_path}/pq").where("path like '%.parquet'").count() == 1
    files.reset_source(spark, f"file://{tmp_path}/csv")
    assert not (tmp_path / "csv").exists()


def test_rescue_keeps_new_parquet_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    root = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{root}/in/a")
    files.pinned_schema(spark, f"{root}/in", "parquet", f"{root}/log")
    spark.range(3, 5).withColumn("more", F.when(F.col("id") == 4, "x")).write.parquet(f"{root}/in/b")
    stream = files.file_stream(spark, f"{root}/in", "parquet", f"{root}/log", mode="rescue")
    q = stream.writeStream.format("memory").queryName("rescued_parquet").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r[files.RESCUED]) for r in spark.table("rescued_parquet").collect()) == [(0, None), (1, None), (2, None), (3, None), (4, '{"more":"x"}')]


def test_a_day_lands_and_is_read_back(spark, tmp_path):
    from tarnflow.sources import generators

    root = f"file://{tmp_path}"
    made = generators.land_day(spark, root, 7, 40, 50)
    assert len(made) == 3 + 1 + 1 + 6 and len(generators.land_day(spark, root, 8, 40, 50)) == 3 + 1 + 6
    assert files.read_files(spark, f"{root}/orders", "json").where("order_id like 'ORD-7-%'").count() >= 120
    assert files.read_files(spark, f"{root}/products", "csv").count() == 2000
    assert files.read_files(spark, f"{root}/customers", "parquet").count() == 10_000
    assert files.read_files(spark, f"{root}/clickstream", "text").count() == 2 * 6 * 50
