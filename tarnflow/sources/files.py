"""File sources and sinks, batch and streaming, with schema evolution, rescued
records and lineage columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED = "_rescued_data"
MODES = ("addNewColumns", "rescue", "failOnNewColumns", "none")


class SchemaChanged(RuntimeError):
    """New columns arrived under failOnNewColumns."""


def read_files(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Batch read, recursively; CSV with a header unless told otherwise."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet_file(df: DataFrame, path: str) -> None:
    """One file; for data known to be small."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and modification time of all files below, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class SchemaLog:
    """Versions of a source's schema, as JSON files under a location."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def versions(self) -> list[int]:
        p, fs = _hadoop(self.spark, self.location)
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self) -> T.StructType | None:
        versions = self.versions()
        if not versions:
            return None
        rows = self.spark.read.text(f"{self.location}/{versions[-1]:06d}.json", wholetext=True).collect()
        return T.StructType.fromJson(json.loads(rows[0][0]))

    def write(self, schema: T.StructType) -> None:
        number = (self.versions() or [-1])[-1] + 1
        p, fs = _hadoop(self.spark, f"{self.location}/{number:06d}.json")
        out = fs.create(p, False)
        out.write(schema.json().encode())
        out.close()

    def reset(self) -> None:
        p, fs = _hadoop(self.spark, self.location)
        fs.delete(p, True)


def evolve(known: T.StructType | None, found: T.StructType, mode: str, hints: str | None = None) -> T.StructType:
    """The schema to read with. Hints set types; a first schema is taken whole;
    later new columns are added, rescued, refused or ignored by the mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {MODES}")
    hinted = {f.name: f.dataType for f in T.StructType.fromDDL(hints).fields} if hints else {}
    found = T.StructType([T.StructField(f.name, hinted.get(f.name, f.dataType), True) for f in found.fields if f.name != RESCUED])
    if known is None:
        return found
    new = [f for f in found.fields if f.name not in known.names]
    if new and mode == "failOnNewColumns":
        raise SchemaChanged(f"new columns: {[f.name for f in new]}")
    return T.StructType([*known.fields, *new]) if mode == "addNewColumns" else known


def pinned_schema(spark: SparkSession, path: str, fmt: str, location: str, mode: str = "addNewColumns", hints: str | None = None, **options) -> T.StructType:
    """Infer over the files that are there, compare with the log, record."""
    log = SchemaLog(spark, location)
    known = log.read()
    schema = evolve(known, read_files(spark, path, fmt, **options).schema, mode, hints)
    if known is None or schema != known:
        log.write(schema)
    return schema


def file_stream(
    spark: SparkSession, path: str, fmt: str, location: str, mode: str = "addNewColumns", hints: str | None = None, extra_options: dict | None = None
) -> DataFrame:
    """Stream of the files under ``path``, each once per checkpoint, with the
    logged schema and a column of rescued data: malformed JSON and CSV records
    whole (a CSV record with more fields than the schema is one), and, in mode
    rescue, fields of JSON and Parquet records that the schema lacks."""
    options = dict(extra_options or {})
    schema = pinned_schema(spark, path, fmt, location, mode, hints, **options)
    if fmt == "json" and mode == "rescue":
        text = spark.readStream.option("recursiveFileLookup", "true").options(**options).text(path)
        return rescue_json(text, schema)
    with_rescue = T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
    reader = spark.readStream.format(fmt).option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RESCUED).schema(with_rescue)
        return reader.options(**options).load(path)
    # A format with types of its own has no malformed records, but may have more
    # columns than the log: in mode rescue their values are kept as JSON.
    found = read_files(spark, path, fmt, **({"mergeSchema": "true"} | options)).schema.fields if mode == "rescue" else []
    extra = [f for f in found if f.name not in schema.names]
    rows = reader.schema(T.StructType([*schema.fields, *extra])).options(**options).load(path)
    if not extra:
        return rows.withColumn(RESCUED, F.lit(None).cast("string"))
    names = [f.name for f in extra]
    held = F.coalesce(*[F.when(F.col(f"`{n}`").isNotNull(), True) for n in names])
    return rows.withColumn(RESCUED, F.when(held, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])))).drop(*names)


def rescue_json(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines (column value): the schema's fields, and in the rescue
    column what else a record has, as JSON, or a malformed line itself."""
    parsed = F.from_json("value", schema)
    whole = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    # Truncated lines parse to records without content.
    fields = F.json_object_keys("value")
    rest = F.map_filter(whole, lambda k, _: ~k.isin(*schema.names)) if schema.names else whole
    rescued = F.when(fields.isNull(), F.col("value")).when(F.size(F.map_keys(rest)) > 0, F.to_json(rest))
    return lines.select(parsed.alias("r"), rescued.alias(RESCUED), "_metadata").select("r.*", RESCUED, "_metadata")


def add_lineage(df: DataFrame) -> DataFrame:
    """Ingestion time and source file, its modification time and size."""
    return df.select(
        *[c for c in df.columns if c != "_metadata"],
        F.current_timestamp().alias("_ingestion_timestamp"), F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_modification_time").alias("_source_file_modified"), F.col("_metadata.file_size").alias("_source_file_size"),
    )


def file_counts(bronze: DataFrame) -> DataFrame:
    """Rows and first ingestion of each source file of an ingested table."""
    return bronze.groupBy("_source_file").agg(F.count(F.lit(1)).alias("rows"), F.min("_ingestion_timestamp").alias("first_ingested"))


def reset_source(spark: SparkSession, *locations: str) -> None:
    """Delete landing, checkpoint, schema or table locations."""
    for x in locations:
        p, fs = _hadoop(spark, x)
        fs.delete(p, True)
