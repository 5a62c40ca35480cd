"""Driver contract and every SQL-checked query at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_results import MODELS, canon
from reviewloom.functions.rules import IssueRules
from reviewloom.plans import catalog, stages
from reviewloom.plans.oracle import ORACLE_SQL
from reviewloom.streaming import tag_stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_without_models_has_sql():
    assert set(catalog.QUERIES) - set(ORACLE_SQL) == MODELS
    assert set(ORACLE_SQL) <= set(catalog.QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - MODELS))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    cur = sql.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    got = sorted(tuple(canon(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(canon(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_stream_gives_the_same_rows_as_a_batch(spark, make_reviews, tmp_path):
    rows = [("a", "s", "1", "2026-01-01", f"로그인 오류 010-1234-567{i} 짜증") for i in range(5)] + [("a", "s", "1", "d", " ")]
    raw = make_reviews(rows)
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    q = (tag_stream(stream, IssueRules()).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = tag_stream(raw, IssueRules())
    assert out.count() == 5
    assert out.select("ingest_seq", "clean_text", "severity").exceptAll(
        batch.select("ingest_seq", "clean_text", "severity")).count() == 0


def test_stage_table_goes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "shared_folder", lambda _: str(tmp_path))
    out = stages.materialize(spark.range(10), "x")
    assert out.count() == 10 and any(n.startswith("stage-x-") for n in os.listdir(tmp_path))


def test_without_a_shared_folder_the_stage_is_persisted(spark, monkeypatch):
    monkeypatch.setattr(stages, "shared_folder", lambda _: None)
    out = stages.materialize(spark.range(10), "x")
    assert out.storageLevel.useDisk
    out.unpersist()
