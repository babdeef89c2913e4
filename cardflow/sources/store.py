"""Tables in the shared folder: cut lineage, survive lost executors, reuse finished work."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: on a cluster a machine-local folder
    would be lost with the machine and invisible to the others.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(hadoop_path)


def materialize(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), schema: StructType | None = None
) -> DataFrame:
    """Write the frame as parquet in the shared folder and read it back, with the types of `schema` if one is given.

    Parquet keeps column pruning for the readers. The folder belongs to the innermost open `scratch` and
    goes when that closes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cardflow/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _own(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def fingerprint(spark: SparkSession, tables: Sequence[str]) -> str:
    """Names, sizes and times of all files of the parquet tables, and their schemas, as one digest.

    Reads no rows: what changes under a path changes the digest.
    """
    digest = hashlib.sha256()
    for table in tables:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found, files = system.listFiles(hadoop_path, True), []
        while found.hasNext():
            file = found.next()
            files.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
        schema = spark.read.parquet(table).schema.json()
        digest.update(json.dumps([table, sorted(files), schema]).encode())
    return digest.hexdigest()


def materialize_once(
    make: Callable[[], DataFrame], spark: SparkSession, name: str, parameters: dict, inputs: Sequence[str] = ()
) -> DataFrame:
    """As `materialize`, under a path keyed by `name`, `parameters` and the `fingerprint` of the `inputs`: a table
    finished earlier under the same key is read, and `make` is not called. Such tables stay."""
    text = json.dumps([parameters, fingerprint(spark, inputs)], sort_keys=True, default=str)
    path = f"{shared_folder(spark)}/cardflow/{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_scratches: list[list[tuple[str, str | None]]] = []


def _own(path: str, table: str | None = None) -> None:
    if _scratches:
        _scratches[-1].append((path, table))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops every folder and table written inside once the block ends, whether it fails or not.

    What is to outlive it must be written to its own place before.
    """
    _scratches.append([])
    try:
        yield
    finally:
        for path, table in _scratches.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


ROWS_PER_BUCKET = 1_000_000


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for tables derived from `rows` rows: the number of shuffle partitions, halved while
    the buckets stay whole, smaller than needed and enough for every core.

    The result divides the number of shuffle partitions, so a shuffle partition falls into one bucket
    and a task writes few files.
    """
    partitions = int(
        spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
        or spark.conf.get("spark.sql.shuffle.partitions"))
    needed = max(rows // ROWS_PER_BUCKET, spark.sparkContext.defaultParallelism)
    buckets = partitions
    while buckets % 2 == 0 and buckets // 2 >= needed:
        buckets //= 2
    return buckets


def materialize_by_key(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As `materialize`, bucketed by `key`: group-bys and joins on the key, or on the key and more
    columns, then need no shuffle.

    `df` should already be partitioned by the key, as after a window or group-by on it. Every key must
    fit one task.
    """
    spark = df.sparkSession
    table = f"cardflow_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_folder(spark)}/cardflow/{table}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    _own(path, table)
    return spark.table(table)
