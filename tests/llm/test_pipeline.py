import re

from pyspark.sql import functions as F

import corpus_pipeline
from reviewloom.llm.catalog import ORACLE_SQL, QUERIES
from tests.llm.test_filters import words


def test_stages_decide_and_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    copies = docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 5000)
    leak = docs.where("doc_id = 9").withColumn("doc_id", F.lit(6000).cast("long")).withColumn("text", F.concat("text", F.lit(" " + bench[0]["text"] + " unlike before " * 30)))
    odd = spark.createDataFrame([(7000, None, None, None, None), (7001, "", "en", "s", 0), (7002, "12 34 !!", "en", "s", 8)], docs.schema)
    docs = docs.union(copies).union(leak).union(odd).withColumn("extra", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.select(*corpus_pipeline.COLUMNS).schema)
        assert after.columns == corpus_pipeline.COLUMNS
        kept[name] = {r["doc_id"] for r in after.collect()}
        docs = after
    assert not {7000, 7001, 7002} & kept["language"] and {5000, 6000} <= kept["language"]
    assert kept["toxicity"] <= kept["language"]
    assert not {5000, 5001, 5002, 5003, 5004} & kept["near_duplicates"] and 6000 in kept["near_duplicates"]
    grams = {tuple(w[i:i + min(10, len(w))]) for r in bench for w in [words(r["text"])] for i in range(max(1, len(w) - 9))}
    for r in docs.collect():
        w = words(r["text"])
        assert not any(tuple(w[i:i + 10]) in grams for i in range(len(w)))
    assert 6000 not in kept["decontamination"]
    pieces = corpus_pipeline.packed(spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == kept["decontamination"]


def test_stages_on_null_ids_repeated_rows_and_no_rows(spark, sf, odd_docs):
    for rows in (odd_docs.select(*[c for c in odd_docs.columns if c != "text"], "text"), odd_docs.limit(0)):
        n = rows.count()
        toxic = corpus_pipeline.not_toxic(spark, rows, sf).count()
        clean = corpus_pipeline.decontaminated(spark, rows, sf).count()
        pieces = corpus_pipeline.packed(spark, rows, sf).where("start = 0").count()
        assert (toxic, clean, pieces) == (n, n, n)


def test_run_and_registration(spark, sf):
    assert QUERIES["pipeline"](spark, sf).count() > 100
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
