"""Registered queries: scalar functions, dates, planar geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.functions import geo, pg
from wardline.plans.registry import Tables, query

# Triangle with corners (0,0), (200,0), (0,80), and a rectangle with a rectangular hole.
TRIANGLE = [[(0.0, 0.0), (200.0, 0.0), (0.0, 80.0), (0.0, 0.0)]]
HOLED = [
    [(10.0, 10.0), (110.0, 10.0), (110.0, 70.0), (10.0, 70.0), (10.0, 10.0)],
    [(30.0, 20.0), (60.0, 20.0), (60.0, 50.0), (30.0, 50.0), (30.0, 20.0)],
]


@query(
    "fn_string",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS len,
              trim('  ' || c_name || ' ') AS tr, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt,
              substring(c_name, 1, 4) AS first4, substring(c_name, 1, 1) AS from_zero, substring(c_name, 10) AS tail,
              replace(c_name, '#', '-') AS rp FROM customer""",
)
def fn_string(t: Tables) -> DataFrame:
    n = F.col("c_name")
    return t.customer.select(
        "c_custkey",
        F.lower(n).alias("lo"),
        F.upper("c_mktsegment").alias("up"),
        F.length(n).cast("bigint").alias("len"),
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"),
        F.ltrim(F.concat(F.lit("  "), n)).alias("lt"),
        F.rtrim(F.concat(n, F.lit("  "))).alias("rt"),
        pg.substring(n, 1, 4).alias("first4"),
        pg.substring(n, 0, 2).alias("from_zero"),
        pg.substring(n, 10).alias("tail"),
        F.replace(n, F.lit("#"), F.lit("-")).alias("rp"),
    )


@query(
    "fn_numeric",
    """SELECT c_custkey, abs(c_acctbal) AS ab, round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS rd,
              CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl FROM customer""",
)
def fn_numeric(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        F.abs(b).alias("ab"),
        F.round(b.cast("decimal(18,2)"), 1).alias("rd"),
        F.ceil(b).alias("ce"),
        F.floor(b).alias("fl"),
    )


@query(
    "fn_conditional",
    """SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS q, nullif(d.lang, 'en') AS other_lang
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fn_conditional(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce("quality", "toxic", F.lit(-1)).alias("q"),
        F.nullif("lang", F.lit("en")).alias("other_lang"),
    )


@query(
    "fn_now",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) <= current_date AS past, o_orderdate < current_timestamp AS before,
              now() = current_timestamp AS same, CAST(now() AS DATE) = current_date AS same_day FROM orders""",
)
def fn_now(t: Tables) -> DataFrame:
    # Clock readings differ between engines, so they are compared with the data and each other.
    moment = F.current_timestamp()
    return t.orders.select(
        "o_orderkey",
        (pg.date("o_orderdate") <= F.current_date()).alias("past"),
        (F.col("o_orderdate") < moment).alias("before"),
        (F.now() == moment).alias("same"),
        (F.now().cast("date") == F.current_date()).alias("same_day"),
    )


@query("fn_date", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def fn_date(t: Tables) -> DataFrame:
    return t.events.groupBy(pg.date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_date_trunc",
    """SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m,
              CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q FROM events""",
)
def fn_date_trunc(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", *[pg.date_trunc(unit, "ts").alias(unit[0]) for unit in ("hour", "month", "week", "quarter")]
    )


@query(
    "fn_extract",
    """SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS mo, extract(day FROM ts) AS d,
              extract(hour FROM ts) AS h, extract(dow FROM ts) AS dow, extract(isodow FROM ts) AS isodow,
              extract(doy FROM ts) AS doy, extract(epoch FROM ts) AS epoch FROM events""",
)
def fn_extract(t: Tables) -> DataFrame:
    names = {"y": "year", "mo": "month", "d": "day", "h": "hour", "dow": "dow", "isodow": "isodow", "doy": "doy"}
    return t.events.select(
        "event_id",
        *[pg.extract(part, "ts").cast("bigint").alias(alias) for alias, part in names.items()],
        pg.extract("epoch", "ts").alias("epoch"),
    )


@query(
    "interval_arith",
    """SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS plus3, o_orderdate - INTERVAL 2 MONTH AS minus2m,
              o_orderdate + INTERVAL 90 MINUTE AS later, CAST(o_orderdate AS DATE) + 7 AS next_week FROM orders
       WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 1 YEAR""",
)
def interval_arith(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.filter(d > F.expr("TIMESTAMP_NTZ '2001-08-01' - INTERVAL 1 YEAR")).select(
        "o_orderkey",
        (d + F.expr("INTERVAL 3 DAY")).alias("plus3"),
        (d - F.expr("INTERVAL 2 MONTH")).alias("minus2m"),
        (d + F.make_dt_interval(mins=F.lit(90))).alias("later"),
        F.date_add(d.cast("date"), 7).alias("next_week"),
    )


@query("to_timestamp_coerce", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 06:00:00' AND ts < DATE '2024-01-20'")
def to_timestamp_coerce(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.filter(
        (ts >= pg.to_timestamp(F.lit("2024-01-15T06:00:00Z"))) & (ts < pg.to_timestamp(F.lit("2024-01-20")))
    ).select("event_id", "ts")


# --- geometry -----------------------------------------------------------------------


def _points(t: Tables) -> DataFrame:
    return t.events.select("event_id", geo.st_point(F.col("value"), F.col("user_id") % 90, geo.WGS84).alias("g"))


@query("st_point", "SELECT event_id, value AS x, CAST(user_id % 90 AS DOUBLE) AS y, 4326 AS srid FROM events")
def st_point(t: Tables) -> DataFrame:
    g = F.col("g")
    return _points(t).select("event_id", geo.st_xmin(g).alias("x"), geo.st_ymin(g).alias("y"), g["srid"].alias("srid"))


@query("st_setsrid", "SELECT event_id, 3857 AS srid, value AS x FROM events")
def st_setsrid(t: Tables) -> DataFrame:
    g = geo.st_setsrid(F.col("g"), 3857)
    return _points(t).select("event_id", g["srid"].alias("srid"), geo.st_xmax(g).alias("x"))


@query(
    "st_geomfromgeojson",
    """SELECT s_suppkey, 'LineString' AS kind, CAST(s_nationkey AS DOUBLE) AS xmin, CAST(s_nationkey + 2.5 AS DOUBLE) AS xmax,
              least(s_acctbal, 0) AS ymin, greatest(s_acctbal, 0) AS ymax FROM supplier""",
)
def st_geomfromgeojson(t: Tables) -> DataFrame:
    text = F.format_string(
        '{"type": "LineString", "coordinates": [[%d, 0], [%d.5, %s]]}',
        F.col("s_nationkey"),
        F.col("s_nationkey") + 2,
        F.col("s_acctbal").cast("string"),
    )
    g = F.col("g")
    return t.supplier.select("s_suppkey", geo.st_geomfromgeojson(text).alias("g")).select(
        "s_suppkey",
        g["type"].alias("kind"),
        geo.st_xmin(g).alias("xmin"),
        geo.st_xmax(g).alias("xmax"),
        geo.st_ymin(g).alias("ymin"),
        geo.st_ymax(g).alias("ymax"),
    )


@query(
    "st_intersects",
    """SELECT event_id,
              (value >= 0 AND user_id % 90 >= 0 AND 80 * value + 200 * (user_id % 90) <= 16000) AS in_triangle,
              (value BETWEEN 10 AND 110 AND user_id % 90 BETWEEN 10 AND 70)
                AND NOT (value > 30 AND value < 60 AND user_id % 90 > 20 AND user_id % 90 < 50) AS in_holed FROM events""",
)
def st_intersects(t: Tables) -> DataFrame:
    g = F.col("g")
    return _points(t).select(
        "event_id",
        geo.st_intersects(g, geo.polygon(TRIANGLE)).alias("in_triangle"),
        geo.st_intersects(g, geo.polygon(HOLED)).alias("in_holed"),
    )


@query(
    "st_within",
    """SELECT event_id, (value > 0 AND user_id % 90 > 0 AND 80 * value + 200 * (user_id % 90) < 16000) AS in_triangle,
              (value > 10 AND value < 110 AND user_id % 90 > 10 AND user_id % 90 < 70)
                AND NOT (value BETWEEN 30 AND 60 AND user_id % 90 BETWEEN 20 AND 50) AS in_holed FROM events""",
)
def st_within(t: Tables) -> DataFrame:
    g = F.col("g")
    return _points(t).select(
        "event_id",
        geo.st_within(g, geo.polygon(TRIANGLE)).alias("in_triangle"),
        geo.st_within(g, geo.polygon(HOLED)).alias("in_holed"),
    )


@query(
    "st_contains",
    """WITH b AS (SELECT s_suppkey, CAST(s_nationkey * 3 AS DOUBLE) AS x, CAST(s_suppkey % 40 AS DOUBLE) AS y FROM supplier)
       SELECT s_suppkey, (x >= 10 AND x + 6 <= 110 AND y >= 10 AND y + 4 <= 70)
                AND NOT (x < 60 AND x + 6 > 30 AND y < 50 AND y + 4 > 20) AS contained FROM b""",
)
def st_contains(t: Tables) -> DataFrame:
    x, y = (F.col("s_nationkey") * 3).cast("double"), (F.col("s_suppkey") % 40).cast("double")
    boxes = t.supplier.select("s_suppkey", geo.st_makebox(x, y, x + 6, y + 4).alias("b"))
    return boxes.select("s_suppkey", geo.st_contains(geo.polygon(HOLED), F.col("b")).alias("contained"))


@query(
    "st_distance",
    """SELECT event_id, round(sqrt((value - 50) * (value - 50) + (user_id % 90 - 40) * (user_id % 90 - 40)), 6) AS to_point,
              round(sqrt(pow(greatest(100 - value, 0, value - 120), 2) + pow(greatest(20 - user_id % 90, 0, user_id % 90 - 30), 2)), 6) AS to_box
       FROM events""",
)
def st_distance(t: Tables) -> DataFrame:
    g = F.col("g")
    centre = geo.st_point(F.lit(50.0), F.lit(40.0), geo.WGS84)
    box = geo.st_makebox(F.lit(100.0), F.lit(20.0), F.lit(120.0), F.lit(30.0))
    return _points(t).select(
        "event_id",
        F.round(geo.st_distance(g, centre), 6).alias("to_point"),
        F.round(geo.st_distance(g, box), 6).alias("to_box"),
    )


@query(
    "st_transform",
    """SELECT event_id, round(radians(user_id) * 6378137.0, 3) AS x,
              round(ln(tan(pi() / 4 + radians(user_id % 80) / 2)) * 6378137.0, 3) AS y,
              CAST(user_id AS DOUBLE) AS back_x, CAST(user_id % 80 AS DOUBLE) AS back_y FROM events""",
)
def st_transform(t: Tables) -> DataFrame:
    lonlat = geo.st_point(F.col("user_id"), F.col("user_id") % 80, geo.WGS84)
    there = t.events.select("event_id", geo.st_transform(lonlat, geo.WEB_MERCATOR).alias("m"))
    back = there.withColumn("b", geo.st_transform(F.col("m"), geo.WGS84))
    m, b = F.col("m"), F.col("b")
    return back.select(
        "event_id",
        F.round(geo.st_xmin(m), 3).alias("x"),
        F.round(geo.st_ymin(m), 3).alias("y"),
        F.round(geo.st_xmin(b), 6).alias("back_x"),
        (F.round(geo.st_ymin(b), 6) + 0.0).alias("back_y"),
    )


@query(
    "st_bbox",
    """SELECT s_suppkey, s_acctbal AS xmin, CAST(s_nationkey AS DOUBLE) AS ymin, s_acctbal + 10 AS xmax,
              CAST(s_nationkey + 5 AS DOUBLE) AS ymax FROM supplier""",
)
def st_bbox(t: Tables) -> DataFrame:
    x, y = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    g = F.col("g")
    return t.supplier.select("s_suppkey", geo.st_makebox(x, y, x + 10, y + 5).alias("g")).select(
        "s_suppkey",
        geo.st_xmin(g).alias("xmin"),
        geo.st_ymin(g).alias("ymin"),
        geo.st_xmax(g).alias("xmax"),
        geo.st_ymax(g).alias("ymax"),
    )
