"""Reading: CSV, JSON lines, multi-file documents, catalogues, constant tables."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty


def scratch(spark: SparkSession, name: str) -> str:
    """A path for intermediate files that no other call gets, in the folder of ``spark.checkpoint.dir``; a local one only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="fieldweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/fieldweave/{name}-{uuid.uuid4().hex}"


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """At most n rows; reading stops there."""
    return df.limit(n)


def built(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, built and written first if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        build().write.parquet(path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | ty.StructType | None = None, *, strings: bool = False, types: bool = False, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header and quoted line breaks.

    Without a schema every column is a string, or of the type that all its cells fit (``types``,
    which reads the files once more); ``strings`` turns nulls into empty strings.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("inferSchema", types).option("escape", '"').option("sep", sep).option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns]) if strings else df


def need(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def documents(tables: list[tuple[DataFrame, str]], *, id_col: str = "id", text_col: str = "merged", cast: bool = False, base_names: bool = True) -> DataFrame:
    """id, text, source: the union of tables with where each came from (a base name without extension, or the whole path)."""
    out = None
    for df, path in tables:
        need(df, [id_col, text_col])
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] if base_names else path
        c = (lambda n: F.col(n).cast("string")) if cast else F.col
        part = df.select(c(id_col).alias("id"), c(text_col).alias("text"), F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def read_documents(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The documents of several CSV files; a file that isn't there is left out with a warning."""
    there = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            there.append(p)
        else:
            warnings.warn(f"no file {p}", stacklevel=2)
    if not there:
        raise ValueError("none of the files is there")
    return documents([(read_csv(spark, p), p) for p in there], **options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of the lines of text files.

    Lines are numbered within the blocks that files are read in; a sum over a file's blocks, few rows, does the rest.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy("file", "at").orderBy("n")))
    sizes = rows.groupBy("file", "at").agg(F.count("*").alias("size"))
    before = sizes.select("file", "at", F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inside.join(before, ["file", "at"]).select("file", (F.col("before") + F.col("inside")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, raw, error, line (from 1) of JSON lines; an unreadable line is an error row with its text.  Blank lines count but give no row."""
    rows = read_lines(spark, path).withColumn("record", F.try_parse_json("value"))
    get = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    bad = F.when(F.col("record").isNull(), F.concat(F.lit("unreadable line: "), "value"))
    return rows.where(F.trim("value") != "").select(get("id").alias("id"), get("raw").alias("raw"), F.coalesce(bad, get("error")).alias("error"), "line")


def fetch(ids: DataFrame, call: Callable[[str], str], *, key: str = "id", pause: float = 0.0, attempts: int = 1) -> DataFrame:
    """key, body, error: one request an entry through a callable, one after the other in each task with a pause between; a failed one keeps its error."""

    def run(batches):
        import time

        import pandas as pd

        for pdf in batches:
            bodies, errors = [], []
            for k in pdf[key]:
                body = error = None
                for _ in range(max(attempts, 1)):
                    try:
                        body, error = call(str(k)), None
                        break
                    except Exception as e:  # the entry's own failure, reported with it
                        error = f"{type(e).__name__}: {e}"
                    finally:
                        time.sleep(pause)
                bodies.append(body)
                errors.append(error)
            yield pd.DataFrame({key: pdf[key], "body": bodies, "error": errors})

    schema = ty.StructType([ids.schema[key], ty.StructField("body", ty.StringType()), ty.StructField("error", ty.StringType())])
    return ids.select(key).mapInPandas(run, schema)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """category name, category definition, allowed answers of a JSON category file (a few dozen entries)."""
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    entries = whole.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "e"))
    return entries.select(F.col("name").alias("category name"), F.try_variant_get("e", "$.definition", "string").alias("category definition"), F.try_variant_get("e", "$.raw_allowed", "string").alias("allowed answers"))


def constants(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """id, label, text of an inline table such as goals."""
    return spark.createDataFrame(rows, "id string, label string, text string")


def read_embeddings(spark: SparkSession, path: str, *, key: str = "id", vec: str = "embedding") -> DataFrame:
    """id (string), embedding (array of float) of a Parquet table; vectors go by key, never by position."""
    df = need(spark.read.parquet(path), [key, vec])
    out = df.select(F.col(key).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("embedding"))
    if out.isEmpty():
        raise ValueError("no vectors")
    return out


def read_sheet(spark: SparkSession, path: str, **options) -> DataFrame:
    """A spreadsheet (a few dozen rows), read on the driver; needs pandas' reader for its format."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str, **options))
