"""Incremental merge: new reviews join a clean base table that is bucketed and sorted by its key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.operators import cleaning as cl
from reviewloom.plans.stages import shared_folder

KEY = "review_key"


def key_digest(keys: list[str] = fv.DEDUPE_KEY) -> Column:
    """One digest of all key parts; null parts are parts like any other."""
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def clean_keyed(raw: DataFrame, keys: list[str] = fv.DEDUPE_KEY, min_len: int = fv.MIN_REVIEW_LEN) -> DataFrame:
    """``clean_reviews`` with the digest of each row's key, taken before personal data is masked."""
    rows = cl.deduplicated(cl.require_columns(raw), keys).withColumn(KEY, key_digest(keys))
    return cl.keep_long_enough(cl.mask_and_clean(cl.with_typed_columns(rows)), min_len)


def base_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The named folder, else the cluster's shared one; only a local session may go without and gets a temporary one."""
    folder = folder or shared_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder, or set spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="review-base-")
    return folder.rstrip("/")


def write_base(clean: DataFrame, name: str, buckets: int, folder: str | None = None) -> None:
    """Writes rows with a key as the table ``name``: a file per bucket, sorted by key. The folder is the caller's."""
    (clean.repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
     .option("path", f"{base_folder(clean.sparkSession, folder)}/base-{uuid.uuid4().hex}").mode("overwrite").saveAsTable(name))


def new_rows(base: DataFrame, new: DataFrame, keys: list[str] = fv.DEDUPE_KEY, min_len: int = fv.MIN_REVIEW_LEN) -> DataFrame:
    """The clean rows of a load whose keys the base does not have.

    Only the load is shuffled, into the base's buckets; of the base its key column is read. A key
    decides a row's text and so its length: what cleaning took out of the base it takes out of the
    load too, so joining the clean base loses nothing.
    """
    return clean_keyed(new, keys, min_len).join(base.select(KEY), KEY, "left_anti")


def merged(base: DataFrame, new: DataFrame, keys: list[str] = fv.DEDUPE_KEY) -> DataFrame:
    """Base and new rows, ``ingest_source`` 0 and 1: the rows of ``apply_new_reviews(.., "merge")`` on the raw tables."""
    number = lambda df, i: df.withColumn(cl.SRC, F.array(F.lit(i)))
    return number(base, 0).unionByName(number(new_rows(base, new, keys), 1))


def append(name: str, rows: DataFrame, buckets: int) -> None:
    """Adds rows from ``new_rows`` to the table: a further file in each bucket, the base's files stay as they are."""
    cols = rows.sparkSession.table(name).columns
    (rows.select(*cols).repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
     .mode("append").saveAsTable(name))
