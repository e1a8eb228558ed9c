"""Joins, reductions and orders that several programs of a guide repository need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waylake.operators.spatial import haversine_km, within_distance
from waylake.session import cut


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``: a top-1 aggregation, which needs no sort of a key's rows."""
    names = rows.columns
    ranked = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    return rows.groupBy(*keys).agg(F.min(ranked).alias("m")).select("m.row.*")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, must_exist: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's columns, rows whose key it lacks); with ``must_exist`` the first holds only matches."""
    return rows.join(dimension, key, "inner" if must_exist else "left"), rows.join(dimension.select(key), key, "left_anti")


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column, n for each of ``values`` in their order, 0 where there is none."""
    counts = rows.agg(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(v).alias(column), F.count_if(F.col(column) == v).alias("n")) for i, v in enumerate(values))).alias("c"))
    return counts.select(F.inline("c"))


def pivot_counts(rows: DataFrame, row: str, column: str, row_values: list[str], column_values: list[str]) -> DataFrame:
    """One row for each of ``row_values`` with the count of every column value, zeros filled in."""
    counts = [F.struct(F.lit(r).alias(row), *(F.count_if((F.col(row) == r) & (F.col(column) == c)).alias(c) for c in column_values), F.count_if(F.col(row) == r).alias("total")) for r in row_values]
    return rows.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def nearest_k(points: DataFrame, targets: DataFrame, k: int, first_km: float = 20.0, growth: float = 4.0) -> DataFrame:
    """point_id, target_id, distance_km, rank: the k nearest targets of each point, exactly.

    Both are id, lon, lat; an id is not its own neighbour. A round looks within a radius by the cell join of
    ``within_distance``; points that found k there are done, the others go on with a larger radius, the last of
    which is half the earth's girth. Ties go by target id. Fewer than k targets give fewer rows.
    """
    rest, km, out = points.select("id", "lon", "lat").dropDuplicates(["id"]), first_km, None
    targets = targets.select("id", "lon", "lat").dropDuplicates(["id"])
    order = Window.partitionBy("point_id").orderBy("distance_km", "target_id")
    while True:
        last = km >= 20016.0
        met = within_distance(rest, targets, min(km, 20016.0)).where("point_id <> centre_id").withColumnRenamed("centre_id", "target_id")
        best = cut(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        done = best if last else best.join(best.where(F.col("rank") == k).select("point_id"), "point_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        if last:
            break
        rest = cut(rest.join(done.select(F.col("point_id").alias("id")).distinct(), "id", "left_anti"))
        if rest.isEmpty():
            break
        km *= growth
    return out.select("point_id", "target_id", "distance_km", "rank")


def nearest_to(targets: DataFrame, lon: float, lat: float, k: int, leave_out: str | None = None) -> DataFrame:
    """The k targets nearest to one place, ties by id: a top-k without sorting all."""
    found = targets if leave_out is None else targets.where(F.col("id") != leave_out)
    return found.withColumn("distance_km", haversine_km(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).orderBy("distance_km", "id").limit(k)


def in_viewport(points: DataFrame, west: float, south: float, east: float, north: float, pad: float = 0.0) -> DataFrame:
    """Points (id, lon, lat) in a box with ``pad`` degrees around; a box with west > east goes over the antimeridian."""
    lon = F.col("lon")
    wide = (lon >= west - pad) & (lon <= east + pad) if west <= east else (lon >= west - pad) | (lon <= east + pad)
    return points.where(wide & (F.col("lat") >= south - pad) & (F.col("lat") <= north + pad))


def search_first(rows: DataFrame, query: str, stages: list[list[str]], order: list[str]) -> DataFrame:
    """The first row, by stage and then by ``order``, whose joined columns of a stage hold the query, without case."""
    hit = None
    for i, columns in enumerate(stages):
        held = F.contains(F.lower(F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in columns))), F.lit(query.lower()))
        hit = F.when(held, F.lit(i)) if hit is None else hit.when(held, F.lit(i))
    return rows.withColumn("stage", hit).where("stage is not null").orderBy("stage", *order).limit(1)


def clusters(points: DataFrame, zoom: int, radius: int = 42, missing: Column | None = None) -> DataFrame:
    """Points (id, lon, lat) by grid cells of ``radius`` pixels at a zoom: cell, point_count, missing_count, centre."""
    from waylake.functions.geo import mercator_pixel

    x, y = mercator_pixel(F.col("lon"), F.col("lat"), zoom)
    cells = points.withColumn("cx", F.floor(x / radius)).withColumn("cy", F.floor(y / radius))
    gone = F.count_if(missing) if missing is not None else F.lit(0)
    return cells.groupBy("cx", "cy").agg(F.count("*").alias("point_count"), gone.alias("missing_count"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def expansion_zoom(points: DataFrame, zoom: int, radius: int = 42, highest: int = 7) -> DataFrame:
    """cx, cy, zoom: for each cell at ``zoom`` with several points the first zoom at which they fall apart."""
    from waylake.functions.geo import mercator_pixel

    x, y = mercator_pixel(F.col("lon"), F.col("lat"), zoom)
    cells = points.select(F.floor(x / radius).alias("cx"), F.floor(y / radius).alias("cy"), "lon", "lat")
    apart = []
    for z in range(zoom + 1, highest + 1):
        zx, zy = mercator_pixel(F.col("lon"), F.col("lat"), z)
        apart.append((z, F.floor(zx / radius), F.floor(zy / radius)))
    spread = cells.groupBy("cx", "cy").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{z}") for z, cx, cy in apart for n, f, c in (("a", F.min, cx), ("b", F.max, cx), ("c", F.min, cy), ("d", F.max, cy))))
    first = F.coalesce(*(F.when((F.col(f"a{z}") != F.col(f"b{z}")) | (F.col(f"c{z}") != F.col(f"d{z}")), F.lit(z)) for z, _, _ in apart), F.lit(highest + 1))
    return spread.where("n > 1").select("cx", "cy", first.alias("zoom"))


def ordered_groups(rows: DataFrame, group: str, item: Column, order: list[Column]) -> DataFrame:
    """group, n, first_item, last_item and the position of each group's first item: a directory's headings.

    Lists of unbounded groups are not collected; the items themselves are ``rows`` in ``order``.
    """
    key = F.struct(*order)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min_by(item, key).alias("first_item"), F.max_by(item, key).alias("last_item"))


def random_pick(rows: DataFrame, key: str, seed: int, scope: DataFrame | None = None, leave_out: str | None = None) -> DataFrame:
    """One row at random for a seed: from those in ``scope`` but ``leave_out``, or else from all others."""
    ranked = rows.withColumn("in_scope", F.lit(0))
    if scope is not None:
        ranked = rows.join(scope.select(key).distinct().withColumn("in_scope", F.lit(0)), key, "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(1)))
    if leave_out is not None:
        ranked = ranked.where(F.col(key) != leave_out)
    return ranked.orderBy("in_scope", F.xxhash64(F.lit(seed), key), key).limit(1).drop("in_scope")


def numeric_positions(ids: DataFrame, column: str) -> DataFrame:
    """``column``, position: strings of digits in numeric order, equal numbers in the order of the strings.

    A range-partitioned sort, of which each partition adds the number of rows before it; only one row for each
    partition is sent to the tasks.
    """
    digits = F.ltrim(F.col(column), F.lit("0"))
    rows = cut(ids.select(column).orderBy(F.length(digits), digits, column))
    # The id of a row is its partition in the upper bits and its place there in the lower 33.
    placed = rows.select(column, F.monotonically_increasing_id().alias("at")).select(column, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offset = ids.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return placed.join(F.broadcast(offset), "part").select(column, (F.col("before") + F.col("place") + 1).alias("position"))
