"""SnapshotTable: a versioned table of Parquet files with a commit log.

A commit writes new files under a fresh name and then moves a complete log entry
to the next version's name, which fails if that is taken: readers see whole
versions, writers that lose a race fail, and old versions stay readable. A merge
rewrites only the files that hold rows it touches. All paths go through Hadoop's
file systems. The move must be atomic, as on HDFS; on a store where it is not
(plain object stores), a table may have one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


class CommitConflict(RuntimeError):
    """Another writer made the version first."""


@dataclass
class Entry:
    version: int
    operation: str
    schema: str
    files: list[str]
    metrics: dict[str, int] = field(default_factory=dict)
    constraints: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    column_tags: dict[str, dict[str, str]] = field(default_factory=dict)
    comment: str = ""
    inputs: list[str] = field(default_factory=list)
    batch: list[Any] | None = None
    batches: dict[str, int] = field(default_factory=dict)
    committed_at: float = 0.0


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Files -------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[str]:
        p = self._path(*parts)
        return [s.getPath().toString() for s in self._fs().listStatus(p)] if self._fs().exists(p) else []

    # Log ---------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(p.rpartition("/")[2][:-5]) for p in self._list("_log") if p.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def entry(self, version: int | None = None) -> Entry:
        version = self.versions()[-1] if version is None else version
        stream = self._fs().open(self._path("_log", f"{version:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Entry(**json.loads(text))

    def _commit(self, entry: Entry) -> Entry:
        entry.committed_at = time.time()
        jvm = self.spark.sparkContext._jvm
        final, draft = self._path("_log", f"{entry.version:010d}.json"), self._path("_log", f"{uuid.uuid4().hex}.draft")
        out = self._fs().create(draft, False)
        out.write(json.dumps(entry.__dict__).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise CommitConflict(f"version {entry.version} of {self.path} exists") from e
            raise
        return entry

    def _next(self, operation: str, **changes: Any) -> Entry:
        if not self.exists():
            return Entry(0, operation, "", [], **changes)
        last = self.entry()
        kept = {k: getattr(last, k) for k in ("schema", "files", "constraints", "properties", "tags", "column_tags", "comment", "batches")}
        return Entry(last.version + 1, operation, **(kept | changes))

    def history(self) -> DataFrame:
        """version, operation, metrics and inputs of every commit."""
        rows = [(e.version, e.operation, e.metrics, e.inputs) for e in map(self.entry, self.versions())]
        return self.spark.createDataFrame(rows, "version int, operation string, metrics map<string,bigint>, inputs array<string>")

    # Read --------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.entry(version))

    def _read(self, e: Entry, files: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(e.schema))
        files = e.files if files is None else files
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def changes(self, first: int, last: int, keys: list[str]) -> DataFrame:
        """Rows by key that differ between two versions: the keys, _change
        (insert, delete, update_before, update_after) and the row."""
        old, new = self.read(first), self.read(last)
        columns = new.columns
        row = lambda: F.struct(*columns)
        a = old.select(*keys, F.struct(*[F.col(c) if c in old.columns else F.lit(None).alias(c) for c in columns]).alias("_old"))
        b = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], row().alias("_new"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
        both = a.join(b, same, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
        entry = lambda kind, c: F.struct(F.lit(kind).alias("_change"), F.col(c).alias("r"))
        made = (
            F.when(F.col("_old").isNull(), F.array(entry("insert", "_new")))
            .when(F.col("_new").isNull(), F.array(entry("delete", "_old")))
            .otherwise(F.array(entry("update_before", "_old"), entry("update_after", "_new")))
        )
        return both.select(F.explode(made).alias("x")).select("x._change", "x.r.*")

    # Write -------------------------------------------------------------

    def _checked(self, df: DataFrame, constraints: dict[str, str]) -> DataFrame:
        """``df`` whose write fails, before any commit, on a row that does not
        meet a constraint (null is not met): no pass of its own."""
        for name, sql in constraints.items():
            broken = ~F.coalesce(F.expr(sql), F.lit(False))
            df = df.where(F.when(broken, F.raise_error(F.lit(f"CHECK constraint {name} violated: {sql}")).cast("boolean")).otherwise(F.lit(True)))
        return df

    def _write(self, df: DataFrame) -> list[str]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return [p for p in self._list(*name.split("/")) if p.endswith(".parquet")]

    @staticmethod
    def _clustered(df: DataFrame, columns: list[str] | None) -> DataFrame:
        """Rows range-partitioned and sorted, so that files have narrow bounds
        in these columns and scans skip them."""
        return df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df

    def overwrite(self, df: DataFrame, cluster_by: list[str] | None = None, inputs: list[str] | None = None, **metadata: Any) -> Entry:
        """Replace rows and schema; constraints stay and hold."""
        e = self._next("overwrite", inputs=inputs or [], **metadata)
        e.files = self._write(self._clustered(self._checked(df, e.constraints), cluster_by))
        e.schema = df.schema.json()
        return self._commit(e)

    def append(self, df: DataFrame, merge_schema: bool = False, batch: tuple[str, int] | None = None, inputs: list[str] | None = None) -> Entry | None:
        """Add rows. ``merge_schema`` adds new columns, null in old rows. A
        ``batch`` (query, number) that is committed already is skipped."""
        e = self._next("append", inputs=inputs or [], batch=list(batch) if batch else None)
        if batch is not None:
            # The newest entry has the last batch of every query.
            if e.batches.get(batch[0], -1) >= batch[1]:
                return None
            e.batches = e.batches | {batch[0]: batch[1]}
        if e.schema:
            schema = T.StructType.fromJson(json.loads(e.schema))
            new = [f for f in df.schema.fields if f.name not in schema.names]
            if new and not merge_schema:
                raise ValueError(f"columns {[f.name for f in new]} are not in the table")
            schema = T.StructType([*schema.fields, *[T.StructField(f.name, f.dataType, True) for f in new]])
            df = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
            e.schema = schema.json()
        else:
            e.schema = df.schema.json()
        e.files = [*e.files, *self._write(self._checked(df, e.constraints))]
        return self._commit(e)

    def _unique(self, source: DataFrame, keys: list[str]) -> None:
        if not source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
            raise ValueError(f"source has several rows for one of {keys}")

    def merge_upsert(self, source: DataFrame, keys: list[str], compare: list[str], audit: list[str] | None = None) -> dict[str, int]:
        """Replace rows whose ``compare`` columns differ (null-safely), insert
        new keys, keep the rest. Equal rows cause no write, whatever their other
        columns; without changes there is no commit. The source is computed once
        and stored, so that counts and rows are of one state of it."""
        source = stored(source, "merge-source")
        self._unique(source, keys)
        e = self._next("merge")
        target = self._read(e)
        old = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.struct(*compare).alias("_old"), F.col("_metadata.file_path").alias("_file"))
        # Never broadcast: files of a few MB may be hundreds in the driver's memory.
        old = old.hint("merge")
        match = F.lit(True)
        for k in keys:
            match = match & (F.col(k) == F.col(f"_t_{k}"))
        joined = source.join(old, match, "left")
        delta = joined.where(F.col("_file").isNull() | ~F.struct(*compare).eqNullSafe(F.col("_old"))).select(*source.columns, "_file")
        files, inserted, updated = [], 0, 0
        for r in delta.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each touched file
            if r._file is None:
                inserted = r.n
            else:
                files.append(r._file)
                updated += r.n
        metrics = {"inserted": inserted, "updated": updated}
        if not inserted and not updated:
            return metrics
        rows = delta.select(*target.columns)
        touched, rest = self._split(e.files, files)
        if touched:
            out = self._read(e, touched).join(rows.select(*keys).hint("merge"), keys, "left_anti").select(*target.columns).unionByName(rows)
        else:
            out = rows
        e.metrics, e.files = metrics, [*rest, *self._write(self._checked(out, e.constraints))]
        self._commit(e)
        return metrics

    def _split(self, files: list[str], touched: list[str]) -> tuple[list[str], list[str]]:
        names = {f.rpartition("/")[2] for f in touched}
        return [f for f in files if f.rpartition("/")[2] in names], [f for f in files if f.rpartition("/")[2] not in names]

    def read_files(self, files: list[str]) -> DataFrame:
        return self._read(self.entry(), files)

    def files_with(self, rows: DataFrame, wanted: DataFrame, keys: list[str]) -> list[str]:
        """Names of the files that hold those of ``rows`` (a read of this table)
        whose keys are in ``wanted``."""
        found = rows.select(*keys, F.col("_metadata.file_path").alias("_file")).join(wanted, keys, "left_semi").select("_file").distinct()
        touched, _ = self._split(self.entry().files, [r[0] for r in found.collect()])  # a row a file
        return touched

    def replace(self, touched: list[str], df: DataFrame, operation: str = "replace", inputs: list[str] | None = None, metrics: dict[str, int] | None = None) -> Entry:
        """The table with the rows of some of its files replaced by ``df``."""
        e = self._next(operation, inputs=inputs or [], metrics=metrics or {})
        _, rest = self._split(e.files, touched)
        e.files = [*rest, *self._write(self._checked(df, e.constraints))]
        return self._commit(e)

    def merge_insert_only(self, source: DataFrame, keys: list[str]) -> dict[str, int]:
        """Append rows whose keys (null-safely) the table lacks; never update."""
        e = self._next("insert")
        target = self._read(e).select(*[F.col(k).alias(f"_t_{k}") for k in keys])
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        new = source.join(target, match, "left_anti").select(*self._read(e).columns)
        files = self._write(self._checked(new, e.constraints))
        n = self._read(e, files).count() if files else 0
        if n:
            e.metrics, e.files = {"inserted": n}, [*e.files, *files]
            self._commit(e)
        elif files:
            self._fs().delete(self._path("data", files[0].split("/")[-2]), True)
        return {"inserted": n}

    def rows_in(self, files: list[str]) -> int:
        """Rows of some of the table's files, from their footers."""
        return self._read(self.entry(), files).count() if files else 0

    def vacuum(self) -> list[str]:
        """Delete written folders that no version names, as a failed or refused
        commit leaves them; their names. No writer may be at work."""
        named = {f.split("/")[-2] for v in self.versions() for f in self.entry(v).files}
        gone = [p.rpartition("/")[2] for p in self._list("data") if p.rpartition("/")[2] not in named]
        for name in gone:
            self._fs().delete(self._path("data", name), True)
        return gone

    def compact(self, files: int, cluster_by: list[str] | None = None) -> Entry:
        """The same rows in fewer files."""
        e = self._next("optimize")
        rows = self._read(e)
        rows = rows.repartitionByRange(files, *cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else rows.repartition(files)
        e.files = self._write(rows)
        return self._commit(e)

    # Metadata ----------------------------------------------------------

    def add_constraint(self, name: str, sql: str) -> Entry:
        """Rows that are there must meet it already."""
        if self.exists() and not self.read().where(~F.coalesce(F.expr(sql), F.lit(False))).isEmpty():
            raise ValueError(f"rows violate constraint {name}: {sql}")
        e = self._next("constraint")
        e.constraints = e.constraints | {name: sql}
        return self._commit(e)

    def annotate(self, comment: str | None = None, tags: dict[str, str] | None = None, column_tags: dict[str, dict[str, str]] | None = None, **properties: str) -> Entry:
        """Add tags, column tags and properties; a value of None removes one."""
        e = self._next("annotate")
        held = lambda old, new: {k: v for k, v in (old | new).items() if v is not None}
        e.comment = e.comment if comment is None else comment
        e.tags, e.properties = held(e.tags, tags or {}), held(e.properties, properties)
        e.column_tags = {c: held(e.column_tags.get(c, {}), (column_tags or {}).get(c, {})) for c in e.column_tags.keys() | (column_tags or {}).keys()}
        return self._commit(e)

    def create(self, schema: T.StructType | str, comment: str = "", column_comments: dict[str, str] | None = None) -> Entry | None:
        """An empty table of typed columns if there is none: those that are not
        nullable refuse nulls from then on; columns may have comments."""
        if self.exists():
            return None
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        e = self._next("create", comment=comment)
        e.constraints = {f"{f.name}_not_null": f"`{f.name}` is not null" for f in schema.fields if not f.nullable}
        e.column_tags = {c: {"comment": text} for c, text in (column_comments or {}).items()}
        e.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).json()
        return self._commit(e)

    def describe(self) -> DataFrame:
        """column, type, nullable and comment, in the table's order."""
        e = self.entry()
        rows = [
            (f.name, f.dataType.simpleString(), f"{f.name}_not_null" not in e.constraints, e.column_tags.get(f.name, {}).get("comment"))
            for f in T.StructType.fromJson(json.loads(e.schema)).fields
        ]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, comment string")

    def register(self, name: str, version: int | None = None) -> None:
        """The table, or a version of it, as a view that SQL can name."""
        self.read(version).createOrReplaceTempView(name)

    def drop(self) -> None:
        self._fs().delete(self._path(), True)


def merged(target: DataFrame, source: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """What ``merge_upsert`` leaves, as a plan over two DataFrames."""
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    t = target.select(F.struct("*").alias("t"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    s = source.select(F.struct("*").alias("s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    both = t.join(s, [f"_k{i}" for i in range(len(keys))], "full_outer")
    differs = ~F.struct(*[F.col(f"t.{c}") for c in compare]).eqNullSafe(F.struct(*[F.col(f"s.{c}") for c in compare]))
    row: Column = F.when(F.col("s").isNull() | (F.col("t").isNotNull() & ~differs), F.col("t")).otherwise(F.col("s"))
    return both.select(row.alias("r")).select("r.*")
