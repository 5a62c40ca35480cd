"""Small helpers of the operators: tables, the shared folder, and row digests."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, a local one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, so that later jobs neither repeat the work nor need its executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, rows: int, each: int = 1 << 18, least: int = 8) -> DataFrame:
    """The rows in about rows / each partitions, if that is fewer than there are; no shuffle.

    For steps over far fewer rows than the shuffle they come from was planned for. Rows never all go to one task.
    """
    return df.coalesce(max(least, -(-rows // each)))


def done_with(*frames: DataFrame) -> None:
    """Deletes the files of these results of cut(); nothing may read them, or what was made lazily from them, later."""
    for df in frames:
        context = df.sparkSession.sparkContext
        where = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if where.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(where.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column name as a plain name, whatever dots or quotes it holds."""
    return "`" + name.replace("`", "``") + "`"


def plain(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, those with dots or quotes under other names, as mapInArrow takes none; toDF() names them back."""
    used = set(keep)
    free = (n for n in (f"_c{i}" for i in range(2 * len(keep))) if n not in used)
    return docs.select(*(F.col(quoted(c)).alias(next(free)) if "." in c or "`" in c else F.col(c) for c in keep))


def fold(column: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
