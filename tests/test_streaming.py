from pyspark.sql import functions as F

from reviewloom.operators import aggregates as ag
from reviewloom.operators import cleaning as cl
from reviewloom.streaming import first_per_key, rating_windows


def run(spark, raw, step, tmp_path, mode):
    """The step's result over files that arrive one by one, in ingest order."""
    for part in range(3):
        raw.filter(F.col("ingest_seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{tmp_path.name.replace('-', '_')}"
    q = (step(cl.with_typed_columns(stream)).writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(200)
    return spark.table(name)


def test_windows_equal_the_batch_trend(spark, make_reviews, tmp_path):
    raw = make_reviews([("a", "s", [None, "1", "4"][i % 3], f"2026-01-{i % 9 + 1:02d}" if i % 5 else None, "t") for i in range(60)])
    got = run(spark, raw, rating_windows, tmp_path, "complete")
    want = ag.rating_trend(cl.with_typed_columns(raw))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 9


def test_first_per_key_equals_keep_first(spark, make_reviews, tmp_path):
    raw = make_reviews([(["a", None][i % 2], "s", "3", f"2026-01-{i % 5 + 1:02d}", f"text {i % 7}") for i in range(45)])
    got = run(spark, raw, first_per_key, tmp_path, "append")
    want = cl.keep_first(raw)
    key = lambda df: sorted(str(r) for r in df.select("app_name", "store", "review_text").collect())
    assert key(got) == key(want) and len(key(got)) == 14
