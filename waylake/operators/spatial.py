"""Points near other points, and the regions that contain a point.

Near: both sides meet in latitude bands cut into longitude cells at least as wide as the distance, by an
equi-join. Within: each boundary is cut into slabs between the longitudes of its vertices (trapezoidal
decomposition); a slab keeps its edges in order, and a point is placed by binary search among them. Both joins
spread every cell over ``salts`` tasks, so that a crowded cell is not one task's work.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
_DECIMAL = r"^-?[0-9]+(\.[0-9]+)?$"


def coordinate(c: Column, most: float) -> Column:
    """The trimmed text as degrees if it is a plain decimal within +-most, else null."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    v = F.when(t.rlike(_DECIMAL), t.try_cast("double"))
    return F.when(F.abs(v) <= most, v)


def located(rows: DataFrame, key: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """id, lon, lat of the rows that have a key and usable coordinates."""
    out = rows.select(F.col(key).alias("id"), coordinate(F.col(lon), 180.0).alias("lon"), coordinate(F.col(lat), 90.0).alias("lat"))
    return out.where("id is not null and lon is not null and lat is not null")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    h = F.least(F.lit(1.0), h)
    return 2 * F.lit(EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / step).cast("long")


def _cells_in(band: Column, step: float) -> Column:
    """Longitude cells of a band: as many as leave each wider than the distance at the band's edge nearest a pole."""
    edge = F.greatest(F.abs(band * step - 90.0), F.abs((band + 1) * step - 90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / step)).cast("long")


#: Rows of the larger side that a task of a spatial join should get of one cell.
PER_TASK = 50_000


def dealt(rows: DataFrame, others: DataFrame, keys: list[str], by: Column, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: cells with more than ``per_task`` rows are dealt to as many salts as that needs.

    ``others`` is repeated for each salt of its cell. Only crowded cells are sent to the tasks: at most one row for each
    ``per_task`` rows.
    """
    crowded = F.broadcast(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > per_task).select(*keys, F.ceil(F.col("_n") / per_task).alias("_salts")))
    one = F.coalesce("_salts", F.lit(1).cast("long"))
    salted = rows.join(crowded, keys, "left").withColumn("salt", F.pmod(F.xxhash64(by), one)).drop("_salts")
    repeated = others.join(crowded, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("_salts")
    return salted, repeated


def within_distance(points: DataFrame, centres: DataFrame, km: float, per_task: int = PER_TASK) -> DataFrame:
    """point_id, centre_id, distance_km of each point and centre (both id, lon, lat) at most ``km`` apart.

    All pairs that qualify come out, across the antimeridian and at the poles too; repeated rows give repeated
    pairs. Null coordinates match nothing; an empty side gives
    an empty result.
    """
    reach = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    step = 2 * reach  # a circle meets two bands, and in each two cells, on average
    p = points.select(F.col("id").alias("point_id"), F.col("lon").alias("plon"), F.col("lat").alias("plat"), _band(F.col("lat"), step).alias("band"))
    p = p.withColumn("n", _cells_in(F.col("band"), step))
    p = p.withColumn("cell", F.pmod(F.floor((F.col("plon") + 180.0) / 360.0 * F.col("n")), F.col("n")))
    c = centres.select(F.col("id").alias("centre_id"), F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    c = c.withColumn("band", F.explode(F.sequence(_band(F.greatest(F.col("clat") - reach, F.lit(-90.0)), step), _band(F.least(F.col("clat") + reach, F.lit(90.0)), step))))
    c = c.withColumn("n", _cells_in(F.col("band"), step))
    # How far the circle reaches in longitude; a circle that holds a pole has all longitudes.
    sideways = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(reach))) / F.cos(F.radians("clat"))))) * (1 + 1e-9)
    sideways = F.when(F.abs("clat") + reach >= 90.0, F.lit(180.0)).otherwise(sideways)
    first = F.floor((F.col("clon") - sideways + 180.0) / 360.0 * F.col("n"))
    last = F.least(F.floor((F.col("clon") + sideways + 180.0) / 360.0 * F.col("n")), first + F.col("n") - 1)
    c = c.withColumn("cell", F.explode(F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.col("n")))))
    p, c = dealt(p, c.drop("n"), ["band", "cell"], F.col("point_id"), per_task)
    met = p.join(c, ["band", "cell", "salt"])
    met = met.withColumn("distance_km", haversine_km(F.col("plon"), F.col("plat"), F.col("clon"), F.col("clat")))
    return met.where(F.col("distance_km") <= km).select("point_id", "centre_id", "distance_km")


def _polygons(boundary: str | None) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a GeoJSON Polygon or MultiPolygon as lists of rings; nothing for any other text."""
    try:
        shape = json.loads(boundary or "null")
        if not isinstance(shape, dict):
            return []
        if shape.get("type") == "Feature":
            shape = shape.get("geometry") or {}
        polygons = {"Polygon": [shape.get("coordinates")], "MultiPolygon": shape.get("coordinates")}.get(shape.get("type")) or []
        return [[[(float(x), float(y)) for x, y, *_ in ring] for ring in polygon] for polygon in polygons if polygon]
    except (ValueError, TypeError):
        return []


def trapezoid_slabs(rings: list[list[tuple[float, float]]], width: float) -> list[tuple[float, float, list[float], list[float]]]:
    """(x0, x1, y of each edge at x0, at x1), edges from below, of the slabs of one polygon with holes.

    Slabs also end at multiples of ``width`` and where edges cross, so that edges keep their order in each.
    """
    edges = []
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            if xa != xb:
                edges.append((xa, ya, xb, yb) if xa < xb else (xb, yb, xa, ya))
    if not edges:
        return []
    xs = {x for e in edges for x in (e[0], e[2])}
    low, high = min(xs), max(xs)
    xs |= {k * width for k in range(math.ceil(low / width), math.floor(high / width) + 1)}
    todo = list(zip(sorted(xs), sorted(xs)[1:]))[::-1]
    edges.sort()
    out = []

    def at(e: tuple, x: float) -> float:
        return e[1] if x == e[0] else e[3] if x == e[2] else e[1] + (e[3] - e[1]) * (x - e[0]) / (e[2] - e[0])

    # Edges are entered as the sweep reaches them and left behind when they end.
    alive: list[tuple] = []
    nxt = 0
    while todo:
        x0, x1 = todo.pop()
        while nxt < len(edges) and edges[nxt][0] <= x0:
            alive.append(edges[nxt])
            nxt += 1
        alive = [e for e in alive if e[2] > x0]
        spans = sorted((at(e, x0), at(e, x1)) for e in alive if e[2] >= x1)
        spans.sort(key=lambda s: s[0] + s[1])
        crossing = None
        for (a0, a1), (b0, b1) in zip(spans, spans[1:]):
            if (a0 - b0) * (a1 - b1) < -1e-18:
                x = x0 + (x1 - x0) * (b0 - a0) / ((b0 - a0) - (b1 - a1))
                if x0 < x < x1 and min(x - x0, x1 - x) > 1e-12:
                    crossing = x
                    break
        if crossing is not None:
            todo += [(crossing, x1), (x0, crossing)]
        elif spans:
            out.append((x0, x1, [s[0] for s in spans], [s[1] for s in spans]))
    return out


def region_slabs(regions: DataFrame, x_width: float = 0.25, y_width: float = 4.0) -> DataFrame:
    """bx, by, code, x0, x1, lo, hi: the slabs of all boundaries, given to the cells that they touch.

    A cell gets the pairs of edges (lower and upper side of a trapezoid) that reach into its band of latitude.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for code, boundary in zip(pdf["code"], pdf["boundary"]):
                for number, rings in enumerate(_polygons(boundary)):
                    for x0, x1, lo, hi in trapezoid_slabs(rings, x_width):
                        by: dict[int, tuple[list[float], list[float]]] = {}
                        for k in range(0, len(lo) - 1, 2):
                            for b in range(math.floor(min(lo[k], hi[k]) / y_width), math.floor(max(lo[k + 1], hi[k + 1]) / y_width) + 1):
                                one = by.setdefault(b, ([], []))
                                one[0].extend(lo[k : k + 2])
                                one[1].extend(hi[k : k + 2])
                        rows += [(math.floor((x0 + x1) / 2 / x_width), b, code, number, x0, x1, l, h) for b, (l, h) in by.items()]
            yield pd.DataFrame(rows, columns=["bx", "by", "code", "part", "x0", "x1", "lo", "hi"])

    return regions.select("code", "boundary").where("code is not null").mapInPandas(run, "bx bigint, by bigint, code string, part int, x0 double, x1 double, lo array<double>, hi array<double>")


def containing_regions(points: DataFrame, regions: DataFrame, x_width: float = 0.25, y_width: float = 4.0, per_task: int = PER_TASK) -> DataFrame:
    """point_id, code of each point (id, lon, lat) and region (code, boundary as GeoJSON) that contains it.

    Planar in longitude and latitude; holes are outside. A point on a left or lower side is inside, on a right or
    upper side outside. A boundary that is no polygon contains nothing; so does an empty table.
    """
    p = points.select(
        F.col("id").alias("point_id"), "lon", "lat",
        F.floor(F.col("lon") / x_width).cast("long").alias("bx"), F.floor(F.col("lat") / y_width).cast("long").alias("by"),
    )
    p, slabs = dealt(p, region_slabs(regions, x_width, y_width), ["bx", "by"], F.col("point_id"), per_task)
    met = p.join(slabs, ["bx", "by", "salt"]).where("lon >= x0 and lon < x1")
    # Binary search for the number of edges at or below the point: as many halvings as the edges need.
    share = (F.col("lon") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size("lo") + 1)).cast("int") + 1)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["l"] + acc["h"]) / 2).cast("int")
        y0, y1 = F.get("lo", mid), F.get("hi", mid)
        below = (y0 + (y1 - y0) * share) <= F.col("lat")
        open_ = acc["l"] < acc["h"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(acc["l"]).alias("l"), F.when(open_ & ~below, mid).otherwise(acc["h"]).alias("h"))

    below = F.aggregate(halvings, F.struct(F.lit(0).alias("l"), F.size("lo").alias("h")), halve, lambda acc: acc["l"])
    return met.where(below % 2 == 1).select("point_id", "code").distinct()
