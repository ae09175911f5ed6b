"""Landed upload bundles: manifests, logs, readings, file checks, sample files.

A bundle is one folder per upload below the landing root. Files are read by Spark straight
from there; what is wrong with a row is kept as a column, never dropped in silence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType, StringType

from wavecohort.functions.values import MAX_FILE_BYTES, allowed_name, allowed_size
from wavecohort.schemas import (
    DDL,
    FIELDS_DDL,
    MANIFEST_DDL,
    READING_WIRE_DDL,
    reconcile,
    schema_of,
)

CORRUPT = "_corrupt"


def _with_corrupt(ddl: str) -> StructType:
    schema = StructType.fromDDL(ddl)
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def bundle_of(path: Column, root: str | None = None) -> Column:
    """Upload id of a landed file: the name of its folder, or of the folder right below ``root``.

    The second also holds where a sample file is itself a folder of part files.
    """
    if root is None:
        return F.element_at(F.split(path, "/"), -2)
    below = root.split("://")[-1].split(":", 1)[-1].strip("/").rsplit("/", 1)[-1]
    return F.regexp_extract(path, f"/{re.escape(below)}/([^/]+)/", 1)


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per bundle manifest below ``root``; one that does not parse is kept in ``_corrupt``."""
    return parse_manifests(_landed(spark, root, "manifest.json", whole=True), "value")


def parse_manifests(lines: DataFrame, text: str) -> DataFrame:
    """Manifests held as text."""
    return _parsed(lines, text, MANIFEST_DDL)


def _parsed(lines: DataFrame, text: str, ddl: str) -> DataFrame:
    parsed = F.from_json(
        text, _with_corrupt(ddl), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return lines.withColumn("_m", parsed).select(*[c for c in lines.columns if c != text], "_m.*")


def _landed(spark: SparkSession, root: str, name: str, whole: bool = False) -> DataFrame:
    """``bundle, value``: the lines of one kind of file from all bundles; no such file gives no line."""
    if not _exists(spark, f"{root}/*/{name}"):
        return spark.createDataFrame([], "bundle string, value string")
    lines = spark.read.text(f"{root}/*/{name}", wholetext=whole)
    return lines.select(bundle_of(F.input_file_name(), root).alias("bundle"), "value")


def _exists(spark: SparkSession, pattern: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    named = _landed(spark, root, "segments.jsonl").where(F.trim("value") != "")
    return parse_lines(named, "value", "event string, segment_id bigint, ts double")


def read_notes(spark: SparkSession, root: str, kind: str = "jsonl") -> DataFrame:
    """Notes of the bundles, whole lines as JSON text (``jsonl``) or ``ts,note`` rows (``csv``).

    A quoted note may hold line breaks; a ``ts,note`` row is a header only where a file begins
    with it. A time that is no number is null and its line is kept in ``_corrupt``.
    """
    if kind == "csv":
        return _csv_notes(spark, root)
    raw = _landed(spark, root, f"notes.{kind}").where(F.trim("value") != "")
    at = F.get_json_object("value", "$.ts").try_cast("double")
    return raw.select("bundle", at.alias("ts"), F.col("value").alias("note"), F.when(at.isNull(), F.col("value")).alias(CORRUPT))


def _csv_notes(spark: SparkSession, root: str) -> DataFrame:
    schema = "ts string, note string"
    if not _exists(spark, f"{root}/*/notes.csv"):
        empty = spark.createDataFrame([], f"bundle string, {schema}")
    else:
        # With multiLine a file is read by one task from its start, so its first row has its least number.
        reader = spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
        rows = reader.csv(f"{root}/*/notes.csv").select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
        first = F.min("_at").over(Window.partitionBy("_file")) == F.col("_at")
        header = F.coalesce((F.col("ts") == "ts") & (F.col("note") == "note"), F.lit(False))
        kept = rows.withColumn("_header", first & header).where(~F.col("_header"))
        empty = kept.select(bundle_of(F.col("_file"), root).alias("bundle"), "ts", "note")
    time = F.trim("ts").try_cast("double")
    line = F.to_csv(F.struct("ts", "note"))
    return empty.select("bundle", time.alias("ts"), "note", F.when(time.isNull(), line).alias(CORRUPT))


def parse_lines(lines: DataFrame, text: str, ddl: str) -> DataFrame:
    """JSON lines held as text; a line that does not parse is kept in ``_corrupt``."""
    return _parsed(lines, text, ddl)


def read_readings(spark: SparkSession, path: str, uploader: Column, now: float) -> DataFrame:
    """Uploaded readings as rows of the readings table; lines that don't parse are left to ``corrupt_readings``."""
    return wire_readings(_reading_lines(spark, path).where(F.col(CORRUPT).isNull()).drop(CORRUPT), uploader, now)


def corrupt_readings(spark: SparkSession, path: str) -> DataFrame:
    """The uploaded lines that are no readings, as text."""
    return _reading_lines(spark, path).where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def _reading_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = parse_lines(lines.select("value", F.col("value").alias("_line")), "value", READING_WIRE_DDL)
    broken = F.col(CORRUPT).isNotNull() | F.col("id").isNull()
    return parsed.withColumn(CORRUPT, F.when(broken, F.col("_line"))).drop("_line")


def wire_readings(raw: DataFrame, uploader: Column, now: float) -> DataFrame:
    """Wire rows to table rows; fields an older client does not send take their defaults."""
    full = reconcile(raw, StructType.fromDDL(READING_WIRE_DDL))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    named = full.select(
        F.col("id").alias("reading_id"),
        F.col("ts").alias("taken_at"),
        "sys",
        "dia",
        "pulse",
        no("ihb"),
        no("mov"),
        "device",
        uploader.alias("uploader_phone_id"),
        F.lit(float(now)).alias("uploaded_at"),
        "phone_read_at",
        "clock_offset_s",
        "clock_offset_uncertainty_s",
        "clock_valid",
        no("clock_suspect"),
        "slot",
    )
    return named.select(*[f.name for f in schema_of("cuff_readings").fields])


def split_malformed_times(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings whose wall time parses, and the others."""
    fine = F.try_to_timestamp("taken_at").isNotNull()
    return readings.where(fine), readings.where(~fine)


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Landed files with upload, name, size and content; oversized files come without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = F.col("length") <= max_bytes
    facts = lambda df, content: df.select(
        bundle_of(F.col("path")).alias("upload"),
        file_name_of(F.col("path")).alias("name"),
        F.col("length").alias("bytes"),
        content.alias("content"),
    )
    # The size bound reaches the reader, which then never opens an oversized file.
    return facts(files.where(small), F.col("content")).unionByName(
        facts(files.where(~small), F.lit(None).cast("binary"))
    )


def check_files(files: DataFrame, declared: DataFrame | None = None, max_bytes: int = MAX_FILE_BYTES, missing: bool = True) -> DataFrame:
    """Verdict per staged file: its hash and whether name, size and declared hash are in order.

    ``files`` has upload, name and content, ``declared`` has upload, name and sha256;
    a file nobody declared a hash for is accepted as ``undeclared``. A declared file that
    is not there is ``missing``; file scans skip empty files, so those show up here too. With
    ``missing`` off, as for one batch of many, only files that are there have a verdict.
    """
    size = F.col("bytes") if "bytes" in files.columns else F.octet_length("content")
    facts = files.withColumn("bytes", size).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    if declared is not None:
        how = "full_outer" if missing else "left"
        facts = facts.join(declared.withColumnRenamed("sha256", "declared"), ["upload", "name"], how)
    elif "declared" not in facts.columns:
        facts = facts.withColumn("declared", F.lit(None).cast("string"))
    return facts.withColumn("verdict", file_verdict(max_bytes))


def file_verdict(max_bytes: int = MAX_FILE_BYTES) -> Column:
    return (
        F.when(~allowed_name(F.col("name")), "illegal_name")
        .when(F.col("bytes").isNull(), "missing")
        .when(F.col("bytes") == 0, "empty")
        .when(~allowed_size(F.col("bytes"), max_bytes), "too_large")
        .when(F.col("declared").isNull(), "undeclared")
        .when(F.col("declared") == F.col("sha256"), "ok")
        .otherwise("mismatch")
    )


def read_samples(spark: SparkSession, root: str, sensor: str, fmt: str = "parquet") -> DataFrame:
    """Sample files of one sensor from all bundles (``<bundle>/<sensor>.<ext>``), without session ids.

    A sensor without a layout of its own is read by ``read_any_samples``.
    """
    if sensor not in ("ppg", "acc", "gyro"):
        return read_any_samples(spark, root, sensor, fmt)
    schema = StructType([f for f in schema_of(sensor).fields if f.name != "session_id"])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if not _exists(spark, f"{root}/*/{sensor}.{fmt}"):
        return spark.createDataFrame([], schema).withColumn("bundle", F.lit(""))
    raw = reader.format(fmt).load(f"{root}/*/{sensor}.{fmt}")
    return raw.withColumn("bundle", bundle_of(F.input_file_name(), root))


def read_any_samples(spark: SparkSession, root: str, sensor: str, fmt: str = "parquet") -> DataFrame:
    """Samples of a sensor whose columns are not known, as ``bundle, sensor, timestamp_ns, fields``.

    ``fields`` holds the filled columns beside ``timestamp_ns`` in the order of their names, so files of different
    columns, or the same in another order, meet in one table and copies are equal. Files are Parquet, CSV with a
    header in each file (plain numbers and words, no quoted line breaks) or JSON lines. A time that is no whole
    number is null; a line that is no object, or a time alone, has no fields.
    """
    where = f"{root}/*/{sensor}.{fmt}"
    empty = spark.createDataFrame([], f"bundle string, sensor string, timestamp_ns bigint, fields {FIELDS_DDL}")
    if not _exists(spark, where):
        return empty
    bundle = bundle_of(F.input_file_name(), root).alias("bundle")
    if fmt == "parquet":
        raw = spark.read.option("mergeSchema", True).parquet(where)
        cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("text")) for c in raw.columns]
        pairs = raw.select(bundle, F.array(*cells).alias("cells"))
    elif fmt == "json":
        entries = F.map_entries(F.from_json("value", "map<string,string>"))
        cells = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text")))
        pairs = spark.read.text(where).where(F.trim("value") != "").select(bundle, cells.alias("cells"))
    elif fmt == "csv":
        lines = spark.read.text(where).select(
            bundle, F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"), F.trim("value").alias("value")
        ).where(F.col("value") != "")
        # The first line of a file is in its first block, before the others of that block.
        heads = lines.where(F.col("_from") == 0).groupBy("_file").agg(F.min_by(F.struct("value", "_at"), "_at").alias("_h"))
        told = lines.join(heads, "_file").where((F.col("_from") > 0) | (F.col("_at") != F.col("_h._at")))
        names, texts = F.split("_h.value", " *, *"), F.split("value", " *, *")
        cells = F.zip_with(names, texts, lambda n, t: F.struct(n.alias("name"), t.alias("text")))
        pairs = told.select("bundle", cells.alias("cells"))
    else:
        raise ValueError(f"no reader for {fmt!r}")
    filled = F.filter("cells", lambda c: c["name"].isNotNull() & c["text"].isNotNull() & (c["text"] != ""))
    time = F.get(F.filter(filled, lambda c: c["name"] == "timestamp_ns"), F.lit(0))["text"].try_cast("bigint")
    rest = F.filter(filled, lambda c: c["name"] != "timestamp_ns")
    fields = F.array_sort(F.transform(rest, lambda c: F.struct(c["name"].alias("name"), c["text"].try_cast("double").alias("value"), c["text"].alias("text"))))
    return empty.unionByName(pairs.select("bundle", F.lit(sensor).alias("sensor"), time.alias("timestamp_ns"), F.coalesce(fields, F.array().cast(FIELDS_DDL)).alias("fields")))


def field(name: str, fields: str = "fields") -> Column:
    """The number of a named field of a sample; null where it has none, or no number."""
    return F.get(F.filter(fields, lambda c: c["name"] == name), F.lit(0))["value"]


def sample_counts(counted: dict[str, DataFrame], key: str = "session_uuid") -> DataFrame:
    """Samples per recording and sensor as one map per recording; sensors are as many as tables given."""
    tagged = None
    for sensor, df in counted.items():
        one = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("sensor", F.lit(sensor))
        tagged = one if tagged is None else tagged.unionByName(one)
    pairs = [
        F.struct(F.lit(s).alias("key"), F.max(F.when(F.col("sensor") == s, F.col("n"))).alias("value"))
        for s in counted
    ]
    present = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return tagged.groupBy(key).agg(F.map_from_entries(present).alias("samples_per_sensor"))


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the store; one that was never written is empty, an older layout is filled up."""
    schema = schema_of(name)
    path = f"{root}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def load_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: load_table(spark, root, name) for name in DDL}


def one_recording(samples: DataFrame, session_id: int, time: str = "timestamp_ns") -> DataFrame:
    """Samples of one recording in time order; the equality reaches the scan."""
    return samples.where(F.col("session_id") == session_id).orderBy(time)


def write_samples(samples: DataFrame, path: str, buckets: int = 1024, mode: str = "append") -> None:
    """Samples partitioned by a bucket of the recording and by time within it.

    Range partitioning on (bucket, recording, time) sorts the files for row-group pruning
    and cuts a long recording over many files.
    """
    bucketed = samples.withColumn("session_bucket", F.pmod(F.xxhash64(F.col("session_id").cast("bigint")), F.lit(buckets)).cast("int"))
    (
        bucketed.repartitionByRange("session_bucket", "session_id", "timestamp_ns")
        .sortWithinPartitions("session_bucket", "session_id", "timestamp_ns")
        .write.mode(mode)
        .partitionBy("session_bucket")
        .parquet(path)
    )


def read_bucketed(spark: SparkSession, path: str, session_id: int, buckets: int = 1024) -> DataFrame:
    """One recording from bucketed samples: its partition folder, then its row groups."""
    bucket = F.pmod(F.xxhash64(F.lit(session_id).cast("bigint")), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("session_bucket") == bucket) & (F.col("session_id") == session_id))
