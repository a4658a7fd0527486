from pyspark.sql import functions as F

from lexmill.operators import sketches


def test_merged_sketches_are_near_exact_counts(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("term"), (F.col("id") % 11).alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("doc_id"))
    rows = rows.unionByName(spark.createDataFrame([(99, 1, None), (98, 1, 5)], rows.schema))
    days = sketches.document_frequency(rows, "day")
    exact = {r.term: r.n for r in rows.groupBy("term").agg(F.countDistinct("doc_id").alias("n")).collect()}
    merged = sketches.merge(days, "term")
    got = {r.term: r.n for r in sketches.estimate(merged).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 98} and all(abs(got[t] - exact[t]) <= 0.065 * exact[t] for t in got)
    # day by day, and the same days twice
    stored = days.where("day = 0").select("term", "sketch")
    for day in (*range(1, 11), 3, 4):
        stored = sketches.add(stored, days.where(F.col("day") == day), "term")
    later = {r.term: r.n for r in sketches.estimate(stored).collect()}
    assert all(abs(later[t] - got[t]) <= 0.01 * got[t] for t in got)
