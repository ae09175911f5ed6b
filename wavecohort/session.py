"""Session settings and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every plan here relies on. The zone makes wall-clock arithmetic
#: explicit (zones are always arguments), the group-limit threshold lets a top-k per
#: group be cut on the map side before its shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.parquet.filterPushdown": "true",
    # A piece of a recording with its halo stays in plain memory while a window reads it.
    "spark.sql.windowExec.buffer.in.memory.threshold": "70000",
    # A task run again after a lost executor must give the rows it gave before; where the
    # order of its input made it differ, all its consumers run again.
    "spark.sql.shuffle.orderIndependentChecksum.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch": "true",
    # State beyond the heap, and timers.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Rows of one run that meet in a task are joined before they are dealt by their key.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

#: Stored (compressed) bytes that one shuffle partition should stand for.
PARTITION_BYTES = 64 * 1024 * 1024

_written: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def shuffle_partitions_for(input_bytes: int, at_least: int) -> int:
    """Shuffle partitions for an input size; adaptive execution merges what turns out small."""
    return max(at_least, -(-input_bytes // PARTITION_BYTES))


def prepare(spark: SparkSession, *inputs: str) -> SparkSession:
    """Apply the runtime settings; with ``inputs`` also size shuffles by what these paths hold."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if inputs:
        now = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = shuffle_partitions_for(sum(_size(spark, path) for path in inputs), now)
        if wanted > now:
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _size(spark: SparkSession, path: str) -> int:
    fs, at = _hadoop(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def input_partitions(spark: SparkSession, *inputs: str) -> int:
    """Partitions of ``PARTITION_BYTES`` for what these paths hold, at least one."""
    return shuffle_partitions_for(sum(_size(spark, path) for path in inputs), 1)


def data_files(spark: SparkSession, path: str) -> int:
    """Files right below a path that a scan reads."""
    fs, at = _hadoop(spark, path)
    names = [e.getPath().getName() for e in fs.listStatus(at)] if fs.exists(at) else []
    return sum(not n.startswith(("_", ".")) for n in names)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, visible to every executor.

    It is the one named by ``spark.checkpoint.dir``. Only a session whose one executor is the
    driver itself, as in tests, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="wavecohort-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def intermediate(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``drop_intermediates`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def intermediate_table(spark: SparkSession, name: str) -> str:
    """A new name of a table in the warehouse, which ``drop_intermediates`` drops."""
    table = f"{name}_{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table.

    Used where several branches must see the very same rows (range-partition
    ids and row positions are only stable once written) and to cut long lineage.
    A lost executor re-reads files instead of recomputing a sampled shuffle.
    """
    spark = df.sparkSession
    path = intermediate(spark, f"tables/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete what ``durable`` wrote for a large table that no later step reads."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        fs, at = _hadoop(table.sparkSession, folder)
        fs.delete(at, True)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables and folders of this application, once its results are stored."""
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    for path in _written.pop(spark.sparkContext.applicationId, []):
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)
