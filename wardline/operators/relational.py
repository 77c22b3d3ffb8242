"""Relational operators beyond the plain DataFrame API: paging, null-aware anti join, range and spatial joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.functions import geo
from wardline.session import shared_folder

# Page and sample bounds.
DEFAULT_LIMIT = 100
MAX_LIMIT = 10_000
DEFAULT_SAMPLE = 100
MAX_SAMPLE = 1000


def page_size(limit: int, maximum: int = MAX_LIMIT) -> int:
    """The asked size, or the default for none; above ``maximum`` is refused, as a shorter page would look complete."""
    if limit > maximum:
        raise ValueError(f"a page holds at most {maximum} rows, not {limit}")
    return limit if limit > 0 else DEFAULT_LIMIT


def paginate(
    df: DataFrame, order: Sequence[Column], limit: int = DEFAULT_LIMIT, offset: int = 0, maximum: int = MAX_LIMIT
) -> DataFrame:
    """One page. ``order`` must end in a unique key, otherwise pages are not stable.

    Rows up to the end of the page pass one task; for deep pages use ``page_after`` or a ``PageIndex``.
    """
    if not order:
        raise ValueError("paging needs an order")
    return df.orderBy(*order).offset(max(offset, 0)).limit(page_size(limit, maximum))


def page_after(
    df: DataFrame, keys: Sequence[str], last: Sequence[Any], limit: int = DEFAULT_LIMIT, maximum: int = MAX_LIMIT
) -> DataFrame:
    """The page after the row whose ``keys`` are ``last``, ascending: no row before it is sorted or carried along.

    ``keys`` are not null and end in a unique one.
    """
    if not keys or len(keys) != len(last):
        raise ValueError("a page needs keys and a value for each")
    after = F.lit(False)
    for name, value in reversed(list(zip(keys, last))):
        after = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & after)
    first = F.col(keys[0]) >= F.lit(last[0])  # this part reaches the scan
    return df.filter(first & after).orderBy(*keys).limit(page_size(limit, maximum))


class PageIndex:
    """Pages at any offset: the rows written once in order, in ``parts`` ranges whose rows are counted.

    A page reads the ranges it lies in and skips all others, so a deep page costs what the first one does. ``order`` must
    end in a unique key. What comes to the driver is one number per range.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], parts: int = 200) -> None:
        if not order:
            raise ValueError("paging needs an order")
        self.order, self.columns = list(order), df.columns
        self._part = "__part"
        folder = shared_folder(df.sparkSession, "pages")
        placed = df.repartitionByRange(parts, *order).withColumn(self._part, F.spark_partition_id())
        placed.write.partitionBy(self._part).parquet(folder)
        self._folder, self._reader = folder, df.sparkSession.read.schema(placed.schema).option("basePath", folder)
        self.rows = self._reader.parquet(folder)
        counts = {r[0]: r[1] for r in self.rows.groupBy(self._part).count().collect()}
        self.starts: list[tuple[int, int, int]] = []  # (range, its first row's place, the place after its last)
        self.total = 0
        for part in sorted(counts):
            self.starts.append((part, self.total, self.total + counts[part]))
            self.total += counts[part]

    def page(self, limit: int = DEFAULT_LIMIT, offset: int = 0, maximum: int = MAX_LIMIT) -> DataFrame:
        """The rows from ``offset`` on, as ``paginate`` gives them."""
        offset, size = max(offset, 0), page_size(limit, maximum)
        met = [(part, begin) for part, begin, end in self.starts if begin < offset + size and end > offset]
        if not met:
            return self.rows.limit(0).select(*self.columns)
        some = self._reader.parquet(*[f"{self._folder}/{self._part}={part}" for part, _ in met])
        return some.orderBy(*self.order).offset(offset - met[0][1]).limit(size).select(*self.columns)


def total_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows of the whole result."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_metrics(page: DataFrame, whole: DataFrame | None, limit: int, offset: int) -> DataFrame:
    """``offset, limit, count, total`` of a page; pass ``whole=None`` to skip the total."""
    total = F.lit(None).cast("bigint") if whole is None else total_count(whole).scalar()
    return page.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(max(offset, 0)).alias("offset"),
        F.lit(page_size(limit)).alias("limit"),
        "count",
        total.alias("total"),
    )


def sample_rows(
    df: DataFrame, order: Sequence[Column], limit: int | None = None, maximum: int = MAX_SAMPLE
) -> DataFrame:
    """Bounded, repeatable sample in key order; more than ``maximum`` rows are refused."""
    wanted = DEFAULT_SAMPLE if limit is None else max(0, limit)
    if wanted > maximum:
        raise ValueError(f"a sample holds at most {maximum} rows, not {wanted}")
    return df.orderBy(*order).limit(wanted)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``DISTINCT ON (keys) ... ORDER BY keys, order``: the first row of every key.

    Ranking to one is limited in every map task before the shuffle, so a hot key sends one
    row per task and not its whole group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def in_tuples(df: DataFrame, columns: Sequence[str], tuples: DataFrame) -> DataFrame:
    """``(a, b, ...) IN (rows of tuples)``; columns pair up by position."""
    right = tuples.toDF(*[f"__t{i}" for i in range(len(columns))])
    condition = None
    for i, name in enumerate(columns):
        part = df[name] == right[f"__t{i}"]
        condition = part if condition is None else condition & part
    return df.join(right, condition, "left_semi")


def not_in(df: DataFrame, column: str, sub: DataFrame, key: str) -> DataFrame:
    """``column NOT IN (SELECT key FROM sub)`` with SQL's null rules, as an equi anti join.

    A null in ``sub`` empties the result, an empty ``sub`` keeps everything, and a null
    ``column`` only survives an empty ``sub``. The two facts about ``sub`` are one-row
    scalar subqueries, so no nested-loop join is needed however large ``sub`` is.
    """
    keys = sub.select(F.col(key).alias("__key"))
    rows = sub.agg(F.count(F.lit(1))).scalar()
    nulls = sub.agg(F.count_if(F.col(key).isNull())).scalar()
    kept = df.join(keys, df[column] == keys["__key"], "left_anti")
    return kept.filter((rows == 0) | ((nulls == 0) & F.col(column).isNotNull()))


def range_join(
    points: DataFrame, intervals: DataFrame, value: Column, low: Column, high: Column, width: float
) -> DataFrame:
    """``value BETWEEN low AND high`` as an equi join on buckets of ``width``, 4 x ``width``, 16 x ``width``, ...

    An interval is listed under the two or three buckets it touches at the level of its length, whatever that is, and a
    point under one bucket of each level that occurs, so a matching pair meets exactly once.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest((high - low) / width, F.lit(1.0))))).cast("int")
    bucket = lambda v, at: F.floor(v / (F.lit(float(width)) * F.pow(F.lit(4.0), at)))
    listed = intervals.filter(low <= high).withColumn("__level", level)
    right = listed.withColumn("__bucket", F.explode(F.sequence(bucket(low, F.col("__level")), bucket(high, F.col("__level")))))
    levels = listed.agg(F.collect_set("__level")).scalar()  # a few: one for each power of four of the lengths
    left = points.withColumn("__level", F.explode(levels)).withColumn("__bucket", bucket(value, F.col("__level")))
    same = (left["__level"] == right["__level"]) & (left["__bucket"] == right["__bucket"])
    return left.join(right, same & (value >= low) & (value <= high)).drop("__bucket", "__level")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    left_geom: str,
    right_geom: str,
    predicate: Callable[[Column, Column], Column] = geo.st_intersects,
    cell: float = 1.0,
) -> DataFrame:
    """Join on a spatial predicate that implies touching bounding boxes.

    A geometry belongs to the first level whose cells (``cell``, 2 x ``cell``, 4 x ``cell``, ...) are no smaller than its
    bounding box, and is listed there and on the coarser levels that occur, under at most four cells each. Two geometries
    meet in an equi join on the level of the larger one; a pair sharing several cells there is kept only in the lowest, so no
    distinct pass is needed.
    """
    c = F.col
    size = lambda level: F.lit(float(cell)) * F.pow(F.lit(2.0), level)

    def boxed(df: DataFrame, geom: str, tag: str) -> DataFrame:
        g = F.col(geom)
        bounds = {
            f"__{tag}x0": geo.st_xmin(g),
            f"__{tag}y0": geo.st_ymin(g),
            f"__{tag}x1": geo.st_xmax(g),
            f"__{tag}y1": geo.st_ymax(g),
        }
        side = F.greatest(c(f"__{tag}x1") - c(f"__{tag}x0"), c(f"__{tag}y1") - c(f"__{tag}y0"))
        level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side / cell, F.lit(1.0))))).cast("int")
        return df.filter(g.isNotNull()).withColumns(bounds).withColumn(f"__{tag}own", level)

    def gridded(df: DataFrame, tag: str, levels: Column) -> DataFrame:
        cells = lambda axis: F.sequence(
            F.floor(c(f"__{tag}{axis}0") / size(c(f"__{tag}at"))), F.floor(c(f"__{tag}{axis}1") / size(c(f"__{tag}at")))
        )
        listed = df.withColumn(f"__{tag}at", F.explode(levels)).filter(c(f"__{tag}at") >= c(f"__{tag}own"))
        return listed.withColumn(f"__{tag}cx", F.explode(cells("x"))).withColumn(f"__{tag}cy", F.explode(cells("y")))

    a, b = boxed(left, left_geom, "l"), boxed(right, right_geom, "r")
    found = lambda df, tag: df.agg(F.collect_set(f"__{tag}own")).scalar()  # noqa: E731  a few: one for each power of two
    levels = F.array_union(found(a, "l"), found(b, "r"))
    a, b = gridded(a, "l", levels), gridded(b, "r", levels)
    lowest_shared = (c("__lcx") == F.floor(F.greatest("__lx0", "__rx0") / size(c("__lat")))) & (
        c("__lcy") == F.floor(F.greatest("__ly0", "__ry0") / size(c("__lat")))
    )
    boxes_touch = (
        (c("__lx0") <= c("__rx1")) & (c("__lx1") >= c("__rx0")) & (c("__ly0") <= c("__ry1")) & (c("__ly1") >= c("__ry0"))
    )
    same_cell = (c("__lat") == c("__rat")) & (c("__lcx") == c("__rcx")) & (c("__lcy") == c("__rcy"))
    at_larger = c("__lat") == F.greatest("__lown", "__rown")
    met = a.join(
        b, same_cell & at_larger & lowest_shared & boxes_touch & predicate(a[left_geom], b[right_geom])
    )
    helpers = [f"__{tag}{name}" for tag in "lr" for name in ("x0", "y0", "x1", "y1", "own", "at", "cx", "cy")]
    return met.drop(*helpers)


def spatial_totals(
    points: DataFrame,
    areas: DataFrame,
    point: str,
    area: str,
    by: Sequence[str],
    count: str = "points",
    least: Mapping[str, str] | None = None,
    cell: float = 1.0,
) -> DataFrame:
    """``spatial_join`` of points with areas (``geo.st_intersects``), grouped by the columns ``by`` of the areas, without its
    pairs: the number of points as ``count``, and the smallest value of columns of ``points`` under the names of ``least``.

    Points are totalled by place and by cells in a tree of levels, each with sides four times those below. An area begins
    with the few cells at the level of its size. Where a rectangle holds all places of a cell, the cell's totals count; other
    cells that it touches open into their parts, so only the smallest cells on its boundary compare places one by one.
    Other shapes compare all places of the smallest cells that they touch.
    """
    c, least = F.col, dict(least or {})
    finest = -2
    at = lambda v, level: F.floor(v / F.lit(float(cell) * 4.0**level))
    totals = [F.sum("__n").alias("__n"), *[F.min(f"__{name}").alias(f"__{name}") for name in least]]
    carried = ["__n", *[f"__{name}" for name in least]]

    p, a = c(point), c(area)
    checked = F.when(p.isNull() | (p["type"] == "Point"), p).otherwise(F.raise_error(F.lit("spatial_totals takes points on its left side")))
    placed = points.filter(p.isNotNull()).select(
        checked.alias("__p"), F.lit(1).cast("bigint").alias("__n"), *[c(source).alias(f"__{name}") for name, source in least.items()]
    )
    places = placed.groupBy(geo.st_xmin(c("__p")).alias("__px"), geo.st_ymin(c("__p")).alias("__py"), c("__p.srid").alias("__ps")).agg(*totals)

    def cells(level: int) -> DataFrame:
        bounds = [f(f"__p{axis}").alias(f"__p{axis}{i}") for axis in "xy" for i, f in enumerate((F.min, F.max))]
        key = (at(c("__px"), level).alias("__kx"), at(c("__py"), level).alias("__ky"), "__ps")
        return places.groupBy(*key).agg(*bounds, *totals)

    ring = a["rings"][0]
    straight = F.forall(
        F.arrays_zip(F.slice(ring, 1, 4).alias("u"), F.slice(ring, 2, 4).alias("v")),
        lambda e: (e["u"]["x"] == e["v"]["x"]) | (e["u"]["y"] == e["v"]["y"]),
    )
    simple = (a["type"] == "Polygon") & (F.size(a["rings"]) == 1)
    rectangle = F.when(simple, (F.size(ring) == 5) & (F.size(F.array_distinct(ring)) == 4) & straight).otherwise(False)
    boxes = areas.filter(a.isNotNull()).select(
        *by,
        rectangle.alias("__box"),
        a["srid"].alias("__as"),
        F.when(~rectangle, a).alias("__area"),  # a rectangle's bounds say it all
        *[f(a).alias(name) for f, name in zip((geo.st_xmin, geo.st_ymin, geo.st_xmax, geo.st_ymax), ("__x0", "__y0", "__x1", "__y1"))],
    )
    side = F.greatest(c("__x1") - c("__x0"), c("__y1") - c("__y0")) / cell
    boxes = boxes.withColumn("__own", F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(side, F.lit(1.0))))).cast("int"))
    boxes = boxes.withColumn("__os", F.lit(None).cast("int"))  # of an opened cell, the reference system of its points
    sought = [*by, "__box", "__as", "__area", "__x0", "__y0", "__x1", "__y1", "__os"]

    def listed(df: DataFrame, level: int, inner: bool) -> DataFrame:
        """The cells of ``level`` that the areas' bounds touch; ``inner``: those in the cell ``__cx``, ``__cy`` above."""
        for axis in "xy":
            low, high, outer = at(c(f"__{axis}0"), level), at(c(f"__{axis}1"), level), c(f"__c{axis}") * 4
            if inner:
                low, high = F.greatest(low, outer), F.least(high, outer + 3)
            steps = F.when(low <= high, F.sequence(low, high))
            df = df.withColumn(f"__n{axis}", F.explode(steps))
        return df.select(*sought, c("__nx").alias("__cx"), c("__ny").alias("__cy"))

    def same_system(test: Column) -> Column:
        wrong = F.concat(F.lit("geometries of SRID "), c("__ps"), F.lit(" and "), c("__as"), F.lit(" do not compare"))
        return F.when(test & (c("__ps") != c("__as")), F.raise_error(wrong).cast("boolean")).otherwise(test)

    top = boxes.agg(F.max("__own")).first()[0]  # the number of levels: a logarithm of the largest area
    within = c("__box")
    touched = F.lit(True)
    for axis in "xy":
        low, high = c(f"__{axis}0"), c(f"__{axis}1")
        within = within & (c(f"__p{axis}0") >= low) & (c(f"__p{axis}1") <= high)
        touched = touched & (c(f"__p{axis}0") <= high) & (c(f"__p{axis}1") >= low)
    same_cell = (c("__cx") == c("__kx")) & (c("__cy") == c("__ky")) & (c("__os").isNull() | (c("__os") == c("__ps")))
    parts, opened = [], None
    for level in range(0 if top is None else top, finest - 1, -1):
        begun = listed(boxes.filter(c("__own") == level), level, False) if level >= 0 else None
        below = None if opened is None else listed(opened, level, True)
        wanted = below if begun is None else begun if below is None else begun.unionByName(below)
        met = wanted.join(cells(level), same_cell & touched)
        parts.append(met.filter(same_system(within)).select(*by, *carried))
        opened = met.filter(~within).withColumn("__os", c("__ps")).select(*sought, "__cx", "__cy")
    spot = geo.st_point(c("__px"), c("__py")).withField("srid", c("__ps"))
    in_box = (c("__px") >= c("__x0")) & (c("__px") <= c("__x1")) & (c("__py") >= c("__y0")) & (c("__py") <= c("__y1"))
    hit = F.when(c("__box"), in_box).otherwise(in_box & geo.st_intersects(spot, c("__area").withField("srid", c("__ps"))))
    singly = places.withColumns({"__kx": at(c("__px"), finest), "__ky": at(c("__py"), finest)})
    parts.append(opened.join(singly, same_cell & in_box).filter(same_system(hit)).select(*by, *carried))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy(*by).agg(F.sum("__n").alias(count), *[F.min(f"__{name}").alias(name) for name in least])
