"""Point-in-polygon join of dated contours with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import single_row


def crossings(x: Column, y: Column, rings: Column) -> Column:
    """How many edges of all rings a ray to the right of (x, y) meets. Rings hold structs (lon, lat)."""

    def hit(a: Column, b: Column) -> Column:
        straddles = (a["lat"] > y) != (b["lat"] > y)
        at = a["lon"] + (y - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return F.when(straddles & (x < at), 1).otherwise(0)

    def of_ring(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, nxt, hit), F.lit(0), lambda s, v: s + v)

    return F.aggregate(F.transform(rings, of_ring), F.lit(0), lambda s, v: s + v)


def contains(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule across every ring, so holes and disjoint parts both work."""
    return crossings(x, y, rings) % 2 == 1


def bounds(rings: str) -> dict[str, Column]:
    flat = F.flatten(F.col(rings))
    lon, lat = F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"])
    return {"x0": F.array_min(lon), "x1": F.array_max(lon), "y0": F.array_min(lat), "y1": F.array_max(lat)}


def point_in_polygon(
    points: DataFrame, polys: DataFrame, keys: list[str], contour: str, *, cell: float,
    probability: str = "probability", category: str = "category",
) -> DataFrame:
    """The most probable contour around each covered (issue, point); equals go to the first contour.

    points: point, lon, lat. polys: keys + `contour` (a name unique within the issue, in file order) +
    rings + probability + category, and x0, x1, y0, y1 where the decoder already knows the bounding box.

    Only the contours' names and boxes meet the points, by an equi-join on grid cells. A contour lies on
    the grid whose cells, `cell` wide or a power of two times that, are as wide as itself: on at most
    four cells, however large it is. A point lies on one cell of each grid. Rings are fetched by name for
    the pairs that are left.
    """
    box = {n: F.col(n) for n in ("x0", "x1", "y0", "y1")} if "x0" in polys.columns else bounds("rings")
    boxes = polys.select(*keys, contour, *[c.alias(f"_{n}") for n, c in box.items()])
    wide = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) / cell
    boxes = boxes.withColumn("_g", F.when(wide > 1, F.ceil(F.log2(wide))).otherwise(0).cast("int"))
    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("_g"))

    def cells(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))

    spread = boxes.withColumn("_cx", cells("_x0", "_x1")).withColumn("_cy", cells("_y0", "_y1"))
    top = boxes.agg(F.coalesce(F.max("_g"), F.lit(0)).alias("_top"))
    on = points.select("point", "lon", "lat").crossJoin(single_row(top)).withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    on = on.withColumn("_cx", F.floor(F.col("lon") / width)).withColumn("_cy", F.floor(F.col("lat") / width))
    near = spread.join(on, ["_g", "_cx", "_cy"]).filter(
        F.col("lon").between(F.col("_x0"), F.col("_x1")) & F.col("lat").between(F.col("_y0"), F.col("_y1"))
    ).select(*keys, contour, "point", "lon", "lat")
    rings = polys.select(*keys, contour, "rings", probability, category)
    inside = near.join(rings, [*keys, contour]).filter(contains(F.col("lon"), F.col("lat"), F.col("rings")))
    # the highest probability, and among equals the smallest name
    best = inside.groupBy(*keys, "point", probability).agg(F.min_by(category, contour).alias(category))
    return best.groupBy(*keys, "point").agg(F.max_by(category, probability).alias(category), F.max(probability).alias(probability))


def fill_normal(covered: DataFrame, asked: DataFrame, keys: list[str], category: str = "category") -> DataFrame:
    """The (issue, point) pairs that are asked for; one that no contour covers is Normal."""
    out = asked.join(covered, [*keys, "point"], "left")
    return out.withColumn("covered", F.col(category).isNotNull()).withColumn(category, F.coalesce(category, F.lit("Normal")))
