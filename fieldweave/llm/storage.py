"""Where intermediate tables go, and how raw files are written and read through Spark alone.

On a cluster the driver and executors share only the folder named by
``spark.checkpoint.dir`` (any file system that Spark reaches).  Every table or file
that outlives a task is written there with Spark's own writers.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


#: Bytes of rows sent to a Python worker at once, where the session doesn't say otherwise.
BATCH_BYTES = "2m"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with small batches for Python workers unless it sets their size itself: memory outside the heap follows them."""
    if _BATCHES not in spark.conf.getAll and not spark.sparkContext.getConf().contains(_BATCHES):
        spark.conf.set(_BATCHES, BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; sets a local one where the session names none and runs on one machine (tests), else raises."""
    folder = prepared(spark).conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no column is called so, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no other call gets."""
    return f"{shared_folder(spark)}/fieldweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete the files of ``written`` tables, or of paths, that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "written_to", None)
        spark = SparkSession.getActiveSession()
        if path and spark:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_blobs(df: DataFrame, column: str, path: str, end: str = "\n", **options: str) -> None:
    """Write one binary column to raw files, each value followed by ``end``.

    Spark's text writer puts a string's bytes out unchanged, and a cast from binary
    keeps them, so this makes raw files on any file system that Spark reaches.
    """
    df.selectExpr(f"cast(`{column}` as string) as value").write.option("lineSep", end).options(**options).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content (binary) of each file under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def schema_with(fields: list[StructField], more: str) -> StructType:
    """Given fields, as nullable ones, followed by those of a DDL string."""
    return StructType([*[StructField(f.name, f.dataType, True) for f in fields], *StructType.fromDDL(more).fields])
