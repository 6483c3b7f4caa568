"""Unit conversion, arrival times, property tables and map tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_sig, tile_key


def convert_units(values: DataFrame, unit_factor: DataFrame) -> DataFrame:
    """(id, category, unit, value) in every unit of the category, through the base: (v * f + o - o2) / f2.

    unit_factor (category, unit, factor, offset) is a short reference table.
    """
    own = unit_factor.select("category", "unit", "factor", "offset")
    all_ = unit_factor.select("category", F.col("unit").alias("to_unit"), F.col("factor").alias("f2"), F.col("offset").alias("o2"))
    rows = values.where("value is not null").join(own, ["category", "unit"]).join(all_, "category")
    out = F.when(F.col("unit") == F.col("to_unit"), F.col("value")).otherwise((F.col("value") * F.col("factor") + F.col("offset") - F.col("o2")) / F.col("f2"))
    return rows.select("id", "category", "unit", "value", "to_unit", out.alias("converted"))


def conversion_formula(unit_factor: DataFrame) -> DataFrame:
    """(category, unit, to_unit, formula): `psi = bar × 14.50377`, `÷` for a factor below 1, offsets written out."""
    a = unit_factor.select("category", "unit", "factor", "offset")
    b = unit_factor.select("category", F.col("unit").alias("to_unit"), F.col("factor").alias("f2"), F.col("offset").alias("o2"))
    k, shift = F.col("factor") / F.col("f2"), (F.col("offset") - F.col("o2")) / F.col("f2")
    times = F.when(k == 1, "").when(k >= 1, F.concat(F.lit(" × "), format_sig(k))).otherwise(F.concat(F.lit(" ÷ "), format_sig(1 / k)))
    plus = F.when(F.abs(shift) < 1e-9, "").when(shift > 0, F.concat(F.lit(" + "), format_sig(shift))).otherwise(F.concat(F.lit(" − "), format_sig(-shift)))
    return a.join(b, "category").where("unit <> to_unit").select("category", "unit", "to_unit", F.concat("to_unit", F.lit(" = "), "unit", times, plus).alias("formula"))


def eta_band(voyages: DataFrame) -> DataFrame:
    """Twenty speeds from 0.9 below the entered one to 1.0 above, with time under way and arrival (UTC).

    Missing or non-positive distance or speed gives no rows; minutes are rounded half up.
    """
    ok = voyages.where("distance_nm > 0 and speed_kn > 0").withColumn("k", F.explode(F.sequence(F.lit(-9), F.lit(10))))
    rows = ok.withColumn("speed", F.round(F.col("speed_kn") + F.col("k") / 10, 1)).where("speed > 0")
    rows = rows.withColumn("minutes", F.floor(F.col("distance_nm") / F.col("speed") * 60 + 0.5).cast("int"))
    m = F.col("minutes")
    text = F.format_string("%dd %dh %dm", F.floor(m / 1440).cast("int"), F.floor(m % 1440 / 60).cast("int"), (m % 60).cast("int"))
    return rows.select("id", "speed", "minutes", F.expr("timestampadd(MINUTE, minutes, departure)").alias("arrival"), text.alias("under_way"), (F.col("k") == 0).alias("entered"))


def interp_lookup(points: DataFrame, table: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """Linear interpolation of each point (id, product, x) in a property table (product, x, ys…).

    Points outside a product's table get status `out of range` and no values. The axis of a product is cut into as many
    equal cells as it has intervals, and an interval stands under each cell that it touches, which is two rows an
    interval on average. Points and intervals meet by product and cell, so a point is tested against its own cell's
    alone, and a product of very many points is spread over its cells.
    """
    w = Window.partitionBy("product").orderBy("_x")
    t = table.select("product", F.col(x).cast("double").alias("_x"), *(F.col(y).alias(f"_{y}") for y in ys)).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    t = t.select("product", F.col("_x").alias("_lo"), F.lead("_x").over(w).alias("_hi"), F.lead("_x", 2).over(w).isNull().alias("_last"), *(F.col(f"_{y}") for y in ys), *(F.lead(f"_{y}").over(w).alias(f"_{y}2") for y in ys)).where("_hi > _lo or (_hi = _lo and _last)")
    axis = t.groupBy(F.col("product").alias("_axis")).agg(F.min("_lo").alias("_from"), F.max("_hi").alias("_to"), F.count("*").alias("_n"))

    def cell(at: str) -> Column:
        place = F.floor((F.col(at) - F.col("_from")) / (F.col("_to") - F.col("_from")) * F.col("_n"))
        return F.greatest(F.least(F.coalesce(F.nanvl(place.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("long"), F.col("_n") - 1), F.lit(0).cast("long"))

    placed = t.join(axis, F.col("product") == F.col("_axis"))
    placed = placed.withColumn("_cell", F.explode(F.sequence(cell("_lo"), cell("_hi")))).select(F.col("product").alias("_product"), F.col("_cell"), "_lo", "_hi", "_last", *(f"_{y}" for y in ys), *(f"_{y}2" for y in ys))
    own = points.join(axis, F.col("product") == F.col("_axis"), "left").withColumn("_at", cell(x))
    inside = (F.col(x) >= F.col("_lo")) & ((F.col(x) < F.col("_hi")) | (F.col("_last") & (F.col(x) == F.col("_hi"))))
    j = own.join(placed, (F.col("product") == F.col("_product")) & (F.col("_at") == F.col("_cell")) & inside, "left")
    part = F.when(F.col("_hi") > F.col("_lo"), (F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    status = F.when(F.col(x).isNull(), "no value").when(F.col("_lo").isNull(), "out of range").otherwise("ok")
    return j.select(*points.columns, *((F.col(f"_{y}") + part * (F.col(f"_{y}2") - F.col(f"_{y}"))).alias(y) for y in ys), status.alias("status"))


def boil_off(points: DataFrame) -> DataFrame:
    """Boil-off rate from heat over latent heat, and the heat that gives a rate; the missing one is filled in."""
    return points.withColumns({"rate": F.coalesce("rate", F.col("heat") / F.col("latent")), "heat": F.coalesce("heat", F.col("rate") * F.col("latent"))})


def flash_fraction(points: DataFrame) -> DataFrame:
    """Part of a liquid that flashes: (h_in - h_tank) / latent where the tank is below its vapour pressure, else 0."""
    flash = (F.col("h_in") - F.col("h_tank")) / F.col("latent")
    part = F.when(F.col("tank_pressure") < F.col("vapour_pressure"), F.greatest(flash, F.lit(0.0))).otherwise(0.0)
    return points.withColumn("flash", part).withColumn("flash_quantity", F.col("flash") * F.col("quantity"))


def tile_stats(points: DataFrame, size: float = 4) -> DataFrame:
    """Count and bounding box of the points of each tile."""
    return points.groupBy(tile_key(F.col("lon"), F.col("lat"), size).alias("tile")).agg(
        F.count("*").alias("n"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north")
    )


def outside_tile(points: DataFrame, size: float = 4) -> DataFrame:
    """Rows whose stated tile is not the one of their position."""
    return points.where(~F.col("tile").eqNullSafe(tile_key(F.col("lon"), F.col("lat"), size)))


def find_places(places: DataFrame, prefix: str) -> DataFrame:
    return places.where(F.lower("name").startswith(prefix.lower()))
