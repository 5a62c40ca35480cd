from pyspark.sql import functions as F

from reviewloom.operators import cleaning as cl
from reviewloom.operators import increments as inc
from reviewloom.operators import setops as so

BASE = [("a", "s", "5", "2026-01-01", "a good app, really"), ("a", "s", "5", "2026-01-02", "a good app, really"), ("b", "s", "1", "2026-01-03", "my mail is a@b.co now"),
        ("b", None, "2", "2026-01-04", "no store is named here"), ("c", "s", "2", "2026-01-04", "x"), ("c", "s", "2", "2026-01-04", "  "), (None, "s", "3", "2026-01-05", "no app is named here")]
NEW = [("a", "s", "4", "2026-02-01", "a good app, really"), ("a", "t", "4", "2026-02-01", "a good app, really"), ("b", None, "1", "2026-02-02", "no store is named here"),
       ("b", "s", "1", "2026-02-02", "my mail is c@d.co now"), ("c", "s", "1", "2026-02-03", "x"), ("d", "s", "3", "2026-02-04", "twice in the load"), ("d", "s", "2", "2026-02-05", "twice in the load"),
       (None, "s", "3", "2026-02-05", "no app is named here"), ("e", "s", None, None, None)]


def test_incremental_merge_equals_the_whole_one(spark, make_reviews, tmp_path):
    base, new = make_reviews(BASE), make_reviews(NEW)
    inc.write_base(inc.clean_keyed(base), "t_merge", 4, str(tmp_path))
    got = inc.merged(spark.table("t_merge"), new).drop(inc.KEY)
    want = so.apply_new_reviews(base, new, "merge")
    cols = [c for c in want.columns if c != cl.SRC]
    rows = lambda df: sorted((str(r) for r in df.select(F.col(cl.SRC)[0].alias("source_no"), *cols).collect()))
    assert rows(got) == rows(want)
    assert {r.source_no for r in got.select(F.col(cl.SRC)[0].alias("source_no")).collect()} == {0, 1}
    # Appending the new rows gives the table that a second load meets.
    fresh = inc.new_rows(spark.table("t_merge"), new).cache()
    n = fresh.count()
    inc.append("t_merge", fresh, 4)
    assert spark.table("t_merge").count() == got.count() and n > 0
    assert inc.new_rows(spark.table("t_merge"), new).count() == 0
    assert inc.new_rows(spark.table("t_merge"), base).count() == 0


def test_the_base_is_not_shuffled(spark, make_reviews, tmp_path):
    inc.write_base(inc.clean_keyed(make_reviews(BASE)), "t_plan", 4, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = inc.new_rows(spark.table("t_plan"), make_reviews(NEW))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[plan.index("SortMergeJoin"):]
    base = join[join.rindex("FileScan"):]
    assert "Bucketed: true" in base and "SelectedBucketsCount: 4 out of 4" in base
    # From the base's scan up to the join there is a sort at most; the exchanges before belong to the load.
    above = join[:join.rindex("FileScan")]
    assert "Exchange" in above and "Exchange" not in above[above.rindex("Sort "):]
    assert "ReadSchema: struct<review_key:string>" in base
