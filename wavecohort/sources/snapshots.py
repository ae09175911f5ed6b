"""Versioned tables and verified snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    fs, path = _path(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def publish(df: DataFrame, root: str, number: int | None = None) -> int:
    """Write ``df`` as the next (or a numbered) version; readers see it once its success marker is there."""
    if number is None:
        number = (versions(df.sparkSession, root) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{root}/version={number:08d}")
    return number


def current(spark: SparkSession, root: str, empty: DataFrame) -> DataFrame:
    """The newest complete version, or ``empty`` before the first."""
    done = versions(spark, root)
    return spark.read.schema(empty.schema).parquet(f"{root}/version={done[-1]:08d}") if done else empty


def snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """Export every table as Parquet below ``root``."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def verify_snapshot(spark: SparkSession, root: str, live: dict[str, DataFrame]) -> DataFrame:
    """Rows of each exported table beside the live count. An unreadable table fails the job."""
    exported = table_counts({name: spark.read.parquet(f"{root}/{name}") for name in live})
    return exported.join(
        table_counts(live).withColumnRenamed("row_count", "live_rows"), "table_name", "full_outer"
    ).withColumn("verified", F.col("row_count") == F.col("live_rows"))
