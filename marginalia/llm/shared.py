"""Helpers the operators of this subpackage share: the folder all executors see, column names, sources."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most.
ROWS = 500
#: A key counts as heavy from so small a part of all rows.
HEAVY = 1_000
#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one on a local master and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), "marginalia-checkpoints")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that their lineage ends there and lost executors cost no recomputing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # only what is there can be marked for removal
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/rows"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, of which later reads take the columns they need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_counted(rows: DataFrame, side: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined to a side that has one row for each key and in `n` how many rows have it; total is at least the number of rows.

    Both are read twice, so they should be written. Keys with over a HEAVY-th of the rows, of which there are fewer than HEAVY, are sent everywhere; so none is left whose rows fill one task.
    """
    heavy = side.where(F.col(n) * HEAVY > F.lit(total))
    light = side.where(F.col(n) * HEAVY <= F.lit(total))
    few = rows.join(F.broadcast(heavy), on)
    return few.unionByName(rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of ROWS at most: Spark's default of 10,000 holds as many whole texts, several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """For each working name one that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out
