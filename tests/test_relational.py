import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline.functions import pg
from wardline.operators import relational as rel, rowfilters
from wardline.sources.documents import page_rows
from wardline.functions import geo


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_page_index_reads_only_the_ranges_of_a_page(spark):
    df = spark.range(20_000).select(F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 5 ELSE id % 97 END").alias("k"), "id")
    order = [pg.desc("k"), pg.asc("id")]  # nulls first, and two keys that hold a third each
    index = rel.PageIndex(df, order, parts=20)
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    assert index.total == 20_000 and max(end - begin for _, begin, end in index.starts) < 4_000
    for offset in (0, 7, 999, 6_660, 13_333, 19_950, 20_000, 30_000, -5):
        page = index.page(100, offset)
        assert [tuple(r) for r in page.collect()] == whole[max(offset, 0) :][:100]
        assert len({f.split("/")[-2] for f in page.inputFiles()}) <= 2
    assert rel.PageIndex(df.limit(0), order, parts=3).page(10, 5).collect() == []
    with pytest.raises(ValueError):
        index.page(10_001, 0)
    with pytest.raises(ValueError):
        rel.PageIndex(df, [])


def test_large_key_lists_reach_the_scan_as_a_bloom_filter(spark, tmp_path):
    """Where the keys outgrow a broadcast, the fact rows are filtered before they are shuffled to the semi join."""
    spark.range(50_000).selectExpr("id % 5000 AS k", "id AS v", "id % 7 AS w").write.parquet(str(tmp_path / "facts"))
    spark.range(900).selectExpr("id * 5 AS k", "id % 3 AS kind").write.parquet(str(tmp_path / "keys"))
    narrow = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in narrow}
    try:
        for k, v in narrow.items():
            spark.conf.set(k, v)
        keys = spark.read.parquet(str(tmp_path / "keys")).filter("kind = 1")
        found = rowfilters.semi_join_keys(spark.read.parquet(str(tmp_path / "facts")), "k", keys.select("k"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in plan and "bloom_filter_agg" in plan
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "might_contain" in line)
        assert any("Exchange hashpartitioning(k" in line for line in lines[:at])  # below the shuffle
        assert found.count() == sum(1 for i in range(50_000) if i % 5000 % 5 == 0 and i % 5000 // 5 < 900 and i % 5000 // 5 % 3 == 1)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_filter_table(spark):
    df = spark.createDataFrame([(1, 20, "Rome"), (2, 25, "Milan"), (3, 30, "Rome")], "id int, temperature int, city string")
    assert ids(df.filter((F.col("temperature") > 22) & (F.col("city") == "Milan"))) == [2]


def test_complex_boolean(spark):
    df = spark.createDataFrame([(1, 10, "z"), (2, 20, "y"), (3, 30, "x")], "id int, a int, b string")
    assert ids(df.filter("(a >= 20 AND b = 'y') OR (a >= 30 AND b = 'x')")) == [2, 3]


def test_page(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    assert [r.id for r in rel.paginate(df, [pg.asc("id")], 2, 2).collect()] == [3, 4]
    metrics = rel.page_metrics(rel.paginate(df, [pg.asc("id")], 2, 4), df, 2, 4).first()
    assert (metrics["count"], metrics["total"]) == (1, 5)
    assert rel.page_metrics(df, None, 0, -3).first().asDict() == {"offset": 0, "limit": 100, "count": 5, "total": None}
    with pytest.raises(ValueError):
        rel.paginate(df, [], 2, 2)


@pytest.mark.parametrize(("asked", "got"), [(0, 100), (-5, 100), (7, 7), (10_000, 10_000)])
def test_page_size(asked, got):
    assert rel.page_size(asked) == got


def test_pages_above_the_maximum_are_refused(spark):
    with pytest.raises(ValueError):
        rel.page_size(20_000)
    assert rel.paginate(spark.range(20_000), [F.col("id").asc()], 15_000, maximum=50_000).count() == 15_000


def test_pages_by_key_join_up(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(23)], "a int, b int")
    page, got = rel.paginate(df, [F.col("a"), F.col("b")], 5).collect(), []
    while page:
        got += page
        page = rel.page_after(df, ["a", "b"], list(page[-1]), 5).collect()
    assert got == sorted(df.collect())
    with pytest.raises(ValueError):
        rel.page_after(df, ["a"], [])


def test_sample_bounds(spark):
    df = spark.range(1500)
    assert rel.sample_rows(df, [F.col("id").asc()]).count() == 100
    assert rel.sample_rows(df, [F.col("id").asc()], 1000).count() == 1000
    with pytest.raises(ValueError):
        rel.sample_rows(df, [F.col("id").asc()], 5000)
    assert rel.sample_rows(df, [F.col("id").asc()], -1).count() == 0


def test_zoned_literal_against_zoneless_column(spark):
    rows = [(1, dt.datetime(2025, 1, 1)), (2, dt.datetime(2025, 2, 1)), (3, dt.datetime(2024, 12, 1))]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    assert ids(df.filter(F.col("ts") >= pg.to_timestamp(F.lit("2025-01-01T00:00:00Z")))) == [1, 2]


@pytest.mark.parametrize(
    ("sub", "expected"),
    [([1, 2], [3]), ([1, None], []), ([], [None, 1, 2, 3]), ([9], [1, 2, 3])],
)
def test_not_in_null_rules(spark, sub, expected):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    keys = spark.createDataFrame([(k,) for k in sub], "k int")
    got = [r.id for r in rel.not_in(df, "id", keys, "k").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_distinct_on_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("b", 5, 3), ("b", 5, 4)], "k string, v int, id int")
    kept = rel.distinct_on(df, ["k"], [pg.desc("v"), pg.asc("id")])
    assert ids(kept) == [2, 3]


def test_in_tuples(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "n int, s string")
    wanted = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "x int, y string")
    assert sorted(tuple(r) for r in rel.in_tuples(df, ["n", "s"], wanted).collect()) == [(1, "b"), (2, "a")]


def test_range_join_brute_force(spark):
    values = [-7.5, -5.0, 0.0, 0.1, 4.9, 5.0, 12.3, 20.0]
    spans = [(0, -6.0, -4.0), (1, 0.0, 5.0), (2, 4.9, 4.9), (3, -100.0, 100.0), (4, 3.0, 1.0)]
    points = spark.createDataFrame([(v,) for v in values], "v double")
    intervals = spark.createDataFrame(spans, "i int, lo double, hi double")
    got = rel.range_join(points, intervals, F.col("v"), F.col("lo"), F.col("hi"), 2.5).select("v", "i").collect()
    expected = [(v, i) for v in values for i, lo, hi in spans if lo <= v <= hi]
    assert sorted((r.v, r.i) for r in got) == sorted(expected)


def test_postgres_scalars(spark):
    one = spark.range(1)
    row = one.select(
        pg.int_div(F.lit(-7), F.lit(2)).alias("q"),
        pg.double_to_int(F.lit(2.5)).alias("even"),
        pg.decimal_to_int(F.lit("2.5").cast("decimal(5,1)")).alias("away"),
        pg.substring(F.lit("hello"), 0, 2).alias("zero"),
        pg.substring(F.lit("hello"), -3, 2).alias("before"),
        pg.extract("dow", F.lit("2024-01-07").cast("date")).alias("sunday"),
        pg.extract("epoch", F.lit("1970-01-02T00:00:01").cast("timestamp_ntz")).alias("epoch"),
    ).first()
    assert tuple(row) == (-3, 2, 3, "h", "", 0, 86401.0)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one.select(pg.int_div(F.lit(1), F.col("id"))).collect()
    with pytest.raises(ValueError):
        pg.substring(F.lit("x"), 1, -1)


def test_array_agg_keeps_nulls_and_is_null_when_empty(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "k string, v int")
    assert sorted(df.agg(pg.array_agg("v").alias("v")).first().v, key=repr) == [1, None]
    assert df.filter("false").agg(pg.array_agg("v").alias("v")).first().v is None
    assert df.filter("v IS NULL").agg(pg.array_agg_distinct_sorted("v").alias("v")).first().v is None


def test_page_rows_render_geometry(spark):
    page = spark.createDataFrame([(1, 9.0, 45.0, None)], "id int, x double, y double, note string")
    shaped = page.select("id", geo.st_point(F.col("x"), F.col("y"), 4326).alias("geom"), "note")
    assert page_rows(shaped).first().item == '{"id":1,"geom":{"type":"Point","coordinates":[9,45]},"note":null}'


def test_range_join_with_intervals_of_any_length(spark):
    points = spark.createDataFrame([(float(v),) for v in (-3e6, -1.0, 0.0, 2.5, 7.0, 9e5, 2e9)], "v double")
    intervals = spark.createDataFrame([(0, -1e7, 1e7), (1, 0.0, 0.0), (2, 2.4, 2.6), (3, 0.0, 1e12), (4, 5.0, 1.0), (5, -1.0, 8.0)], "i int, lo double, hi double")
    got = rel.range_join(points, intervals, F.col("v"), F.col("lo"), F.col("hi"), 0.01).select("v", "i").collect()
    want = {(p.v, r.i) for p in points.collect() for r in intervals.collect() if r.lo <= p.v <= r.hi}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
