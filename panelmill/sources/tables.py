"""Reading tables, dropping exact copies, and writing tables that outlive an executor."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []
_TABLES: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the input folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a `local` master (one machine); on any
    other master that would be a folder of one machine only, so it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset on {master}: set it to a folder that all executors share")
        if not _LOCAL_DIR:
            _LOCAL_DIR.append(tempfile.mkdtemp(prefix="panelmill-"))
            atexit.register(shutil.rmtree, _LOCAL_DIR[0], True)
        place = _LOCAL_DIR[0]
    return place.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def durable(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor loses nothing.

    replaces is a durable table that nothing needs once this one is written (the state of the
    round before); it is removed. The others stay until `release` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(_at_exit)
    _TABLES[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    old = getattr(replaces, "_durable_path", None)
    if old:
        _remove(spark, old)
        _TABLES.pop(old, None)
    return out


def release() -> int:
    """Remove all durable tables of this process; call it when the results that read them have been used. The number removed."""
    n = len(_TABLES)
    while _TABLES:
        path, spark = _TABLES.popitem()
        _remove(spark, path)
    return n


def _at_exit() -> None:
    try:
        release()
    except Exception as e:  # the session may be gone by now; the tables then stay
        logging.getLogger(__name__).warning("durable tables stay in the shared folder: %s", type(e).__name__)


def row_digest(df: DataFrame) -> list:
    """Two 64-bit hashes over all columns and their null pattern: equal for exact copies only.

    Spark's hash skips nulls, so the null pattern is hashed as well. Two different
    rows share both hashes with a chance of about 2**-128 a pair.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftleft(c.isNull().cast("bigint"), i % 63) for i, c in enumerate(cols)])
    return [F.xxhash64(*cols, nulls).alias("_d1"), F.xxhash64(F.lit(7), nulls, *reversed(cols)).alias("_d2")]


def exact_rows(df: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` (all if none) of df, each set of exact copies once.

    Rows are grouped by a 128-bit digest of *all* columns, so only the digest and the
    kept columns are shuffled, after a map-side combine. Extra columns take part in the
    comparison whatever their name; nulls and NaN compare as equal to themselves.
    An empty table stays empty.
    """
    keep = keep or tuple(df.columns)
    return (
        df.select(*[F.col(f"`{c}`") for c in keep], *row_digest(df))
        .groupBy("_d1", "_d2")
        .agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in keep])
        .drop("_d1", "_d2")
    )


def write_cells(df: DataFrame, path: str, by: list[str], overwrite: bool = True) -> None:
    """Partitioned Parquet sink, one folder a cell of `by`; a rerun replaces only the cells it brings.

    With overwrite=False cells that exist already are kept and only new ones are written.
    """
    spark = df.sparkSession
    if not overwrite:
        try:
            old = spark.read.parquet(path).select(*by).distinct()
            df = df.join(old, by, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
