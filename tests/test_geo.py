import itertools
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import geo
from wardline.operators import relational as rel

SQUARE = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]]]}'
HOLED = (
    '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}'
)
L_SHAPE = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,4],[4,4],[4,10],[0,10],[0,0]]]}'


def point(x, y):
    return f'{{"type":"Point","coordinates":[{x},{y}]}}'


def line(*pts):
    return '{"type":"LineString","coordinates":[' + ",".join(f"[{x},{y}]" for x, y in pts) + "]}"


def box(x0, y0, x1, y1):
    return f'{{"type":"Polygon","coordinates":[[[{x0},{y0}],[{x1},{y0}],[{x1},{y1}],[{x0},{y1}],[{x0},{y0}]]]}}'


# (a, b, intersects, a within b, distance)
CASES = [
    (point(5, 5), SQUARE, True, True, 0.0),
    (point(0, 5), SQUARE, True, False, 0.0),
    (point(10, 10), SQUARE, True, False, 0.0),
    (point(13, 14), SQUARE, False, False, 5.0),
    (point(5, 5), HOLED, False, False, 1.0),
    (point(4, 5), HOLED, True, False, 0.0),
    (point(1, 1), point(1, 1), True, True, 0.0),
    (point(1, 1), point(4, 5), False, False, 5.0),
    (point(5, 0), line((0, 0), (10, 0)), True, True, 0.0),
    (point(0, 0), line((0, 0), (10, 0)), True, False, 0.0),
    (point(5, 3), line((0, 0), (10, 0)), False, False, 3.0),
    (line((1, 1), (9, 9)), SQUARE, True, True, 0.0),
    (line((0, 0), (10, 0)), SQUARE, True, False, 0.0),
    (line((-5, 5), (15, 5)), SQUARE, True, False, 0.0),
    (line((0, 5), (10, 5)), SQUARE, True, True, 0.0),
    (line((1, 5), (9, 5)), HOLED, True, False, 0.0),
    (line((12, 0), (12, 9)), SQUARE, False, False, 2.0),
    (line((0, 0), (5, 0)), line((0, 0), (10, 0)), True, True, 0.0),
    (line((0, 0), (0, 9)), line((-5, 5), (5, 5)), True, False, 0.0),
    (box(1, 1, 3, 3), SQUARE, True, True, 0.0),
    (box(0, 0, 10, 10), SQUARE, True, True, 0.0),
    (box(0, 0, 5, 5), SQUARE, True, True, 0.0),
    (box(8, 8, 12, 12), SQUARE, True, False, 0.0),
    (box(10, 10, 12, 12), SQUARE, True, False, 0.0),
    (box(3, 3, 7, 7), HOLED, True, False, 0.0),
    (box(4, 4, 6, 6), HOLED, True, False, 0.0),
    (box(1, 1, 3, 3), HOLED, True, True, 0.0),
    (box(1, 1, 8, 8), L_SHAPE, True, False, 0.0),
    (box(1, 1, 4, 4), L_SHAPE, True, True, 0.0),
    (SQUARE, box(2, 2, 3, 3), True, False, 0.0),
    (SQUARE, point(5, 5), True, False, 0.0),
    (box(20, 0, 22, 2), SQUARE, False, False, 10.0),
]


def test_predicates(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CASES)], "i int, a string, b string").select(
        "i", geo.st_geomfromgeojson(F.col("a")).alias("a"), geo.st_geomfromgeojson(F.col("b")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        "i",
        geo.st_intersects(a, b).alias("meet"),
        geo.st_intersects(b, a).alias("meet_back"),
        geo.st_within(a, b).alias("within"),
        geo.st_contains(b, a).alias("contains"),
        geo.st_distance(a, b).alias("d"),
    ).collect()
    for r in rows:
        _, _, meet, within, distance = CASES[r.i]
        assert (r.meet, r.meet_back, r.within, r.contains) == (meet, meet, within, within), CASES[r.i]
        assert r.d == pytest.approx(distance), CASES[r.i]


def test_sql_functions_agree(spark):
    geo.register(spark)
    spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CASES)], "i int, a string, b string").createOrReplaceTempView("cases")
    rows = spark.sql(
        """SELECT i, st_intersects(st_geomfromgeojson(a), st_geomfromgeojson(b)) AS meet,
                  st_within(st_geomfromgeojson(a), st_geomfromgeojson(b)) AS within FROM cases
           WHERE st_distance(st_geomfromgeojson(a), st_geomfromgeojson(b)) < 100"""
    ).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert (r.meet, r.within) == CASES[r.i][2:4]


def test_point_in_box_query(spark):
    df = spark.createDataFrame([(1, 9.0, 45.0), (2, 20.0, 10.0)], "id int, x double, y double")
    area = geo.st_geomfromgeojson(F.lit(box(8, 44, 10, 46)))
    hit = df.filter(geo.st_intersects(geo.st_point(F.col("x"), F.col("y"), 4326), area))
    assert [r.id for r in hit.collect()] == [1]


def test_nulls_and_bad_input(spark):
    df = spark.createDataFrame([(None,), ("{}",), ('{"type":"MultiPoint","coordinates":[]}',)], "j string")
    assert [r.g for r in df.select(geo.st_geomfromgeojson(F.col("j")).alias("g")).collect()] == [None] * 3
    with pytest.raises(ValueError):
        geo.st_transform(F.col("g"), 32632)
    unknown = df.limit(1).select(geo.st_transform(geo.st_point(F.lit(1), F.lit(2), 25832), 4326).alias("g"))
    with pytest.raises(Exception, match="unsupported reprojection"):
        unknown.collect()


def test_spatial_join_brute_force(spark):
    rng = random.Random(5)
    a = [(i, *(rng.uniform(-20, 20) for _ in range(2)), rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)]
    b = [(i, *(float(rng.randint(-20, 20)) for _ in range(2)), rng.randint(0, 8) + 0.0, rng.randint(0, 8) + 0.0) for i in range(60)]
    schema = "id int, x double, y double, w double, h double"

    def boxes(rows, name):
        c = F.col
        g = geo.st_makebox(c("x"), c("y"), c("x") + c("w"), c("y") + c("h"))
        return spark.createDataFrame(rows, schema).select(c("id").alias(f"{name}_id"), g.alias(f"{name}_g"))

    got = rel.spatial_join(boxes(a, "a"), boxes(b, "b"), "a_g", "b_g", cell=3.0)
    pairs = sorted((r.a_id, r.b_id) for r in got.collect())
    expected = sorted(
        (i, j)
        for (i, x, y, w, h), (j, p, q, v, k) in itertools.product(a, b)
        if x <= p + v and x + w >= p and y <= q + k and y + h >= q
    )
    assert pairs == expected and len(set(pairs)) == len(pairs)


def test_mixed_reference_systems_fail(spark):
    df = spark.range(1).select(geo.st_point(F.lit(1.0), F.lit(1.0), 4326).alias("a"), geo.st_point(F.lit(1.0), F.lit(1.0), 3857).alias("b"))
    for fn in (geo.st_intersects, geo.st_within, geo.st_contains, geo.st_distance):
        with pytest.raises(Exception, match="do not compare"):
            df.select(fn(F.col("a"), F.col("b"))).collect()


def test_spatial_join_with_geometries_of_any_size(spark):
    box = lambda i, x, y, s: (i, float(x), float(y), float(x + s), float(y + s))
    schema = "i int, x0 double, y0 double, x1 double, y1 double"
    made = lambda rows, name: spark.createDataFrame(rows, schema).select("i", geo.st_makebox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(name))
    left = [box(0, 0, 0, 1e6), box(1, 5, 5, 0.1), box(2, -3, -3, 3), box(3, 100, 100, 40)]
    right = [box(0, 5.05, 5.05, 0.1), box(1, 999_999, 3, 10), box(2, 0, 0, 5e5), box(3, 120, 120, 0.5)]
    got = rel.spatial_join(made(left, "a"), made(right, "b").withColumnRenamed("i", "j"), "a", "b", cell=0.25).select("i", "j").collect()
    touch = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    want = {(p[0], q[0]) for p in left for q in right if touch(p, q)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_spatial_totals_equal_the_grouped_join(spark):
    rng = random.Random(8)
    c = F.col
    spots = [(i, rng.choice((rng.uniform(-9, 9), float(rng.randint(-9, 9)))), float(rng.randint(-9, 9))) for i in range(400)]
    boxes = [(f"b{i % 50}", float(rng.randint(-9, 9)), rng.uniform(-9, 9), rng.choice((0.0, 0.3, 2.0, 30.0)), float(rng.randint(0, 5))) for i in range(60)]
    points = spark.createDataFrame([*spots, *spots[:50], (999, None, 1.0)], "i int, x double, y double").select("i", geo.st_point(c("x"), c("y"), 4326).alias("p"))
    areas = spark.createDataFrame(boxes, "k string, x double, y double, w double, h double").select(
        "k", geo.st_makebox(c("x"), c("y"), c("x") + c("w"), c("y") + c("h")).alias("g")
    )
    triangle = '{"type":"Polygon","coordinates":[[[-8,-8],[8,-8],[-8,8],[-8,-8]]]}'
    fold = '{"type":"Polygon","coordinates":[[[0,0],[5,0],[5,5],[5,0],[0,0]]]}'
    shapes = spark.createDataFrame([("t", triangle), ("f", fold)], "k string, j string").select("k", geo.st_geomfromgeojson(c("j")).alias("g"))
    areas = areas.unionByName(shapes)
    pairs = rel.spatial_join(points, areas, "p", "g", cell=1.5).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    got = rel.spatial_totals(points, areas, "p", "g", ["k"], "n", {"first": "i"}, cell=1.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) != []
    with pytest.raises(Exception, match="do not compare"):
        rel.spatial_totals(points.select("i", geo.st_setsrid(c("p"), 3857).alias("p")), areas, "p", "g", ["k"]).collect()


def test_spatial_totals_expand_no_pairs(spark):
    c = F.col
    points = spark.range(20_000).select(geo.st_point(c("id") % 100 / 10, c("id") / 2000, 4326).alias("p"))
    areas = spark.range(500).select("id", geo.st_makebox(c("id") * 0, c("id") * 0, c("id") * 0 + 9, c("id") * 0 + 9).alias("g"))
    got = rel.spatial_totals(points, areas, "p", "g", ["id"], "n", cell=5.0)
    assert {r.n for r in got.collect()} == {points.filter(geo.st_intersects(c("p"), geo.st_makebox(*map(F.lit, (0.0, 0.0, 9.0, 9.0))))).count()}
