"""Queries over units, arrival times, property tables, tiles and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import quality, units
from .registry import query
from .views import view, with_views

# definitions of the units (fixed values)
FACTORS = """SELECT * FROM (VALUES ('length', 'm', 1.0, 0.0), ('length', 'ft', 0.3048, 0.0), ('length', 'in', 0.0254, 0.0), ('length', 'nm', 1852.0, 0.0),
('pressure', 'bar', 100000.0, 0.0), ('pressure', 'psi', 6894.757293168361, 0.0), ('pressure', 'kPa', 1000.0, 0.0),
('temperature', 'C', 1.0, 273.15), ('temperature', 'K', 1.0, 0.0), ('temperature', 'F', 0.5555555555555556, 255.3722222222222)) AS t(category, unit, factor, offset_)"""
VALUES = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'pressure' ELSE 'temperature' END AS category, CASE p_partkey % 3 WHEN 0 THEN 'ft' WHEN 1 THEN 'bar' ELSE 'F' END AS unit, CASE WHEN p_partkey % 10 <> 7 THEN p_retailprice END AS value FROM part"


def _factors(spark):
    return spark.sql(FACTORS).select("category", "unit", *(F.col(c).cast("double").alias(n) for c, n in (("factor", "factor"), ("offset_", "offset"))))


def _table(spark, sf, name):
    spark.read.parquet(f"{sf}/{name}.parquet").createOrReplaceTempView(name)


@query(f"""SELECT v.id, v.unit, b.unit AS to_unit, round(CASE WHEN v.unit = b.unit THEN value ELSE (value * CAST(a.factor AS DOUBLE) + CAST(a.offset_ AS DOUBLE) - CAST(b.offset_ AS DOUBLE)) / CAST(b.factor AS DOUBLE) END + 1e-8, 5) AS converted
FROM ({VALUES}) v JOIN ({FACTORS}) a ON a.category = v.category AND a.unit = v.unit JOIN ({FACTORS}) b ON b.category = v.category WHERE value IS NOT NULL""")
def q32_convert_units(spark, sf):
    _table(spark, sf, "part")
    out = units.convert_units(spark.sql(VALUES), _factors(spark))
    return out.select("id", "unit", "to_unit", F.round(F.col("converted") + 1e-8, 5).alias("converted"))


NUMBERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.001 WHEN 2 THEN 1000 ELSE -0.000001 END END AS x FROM orders"


@query(f"""WITH n AS (SELECT o_orderkey, x, CASE WHEN x = 0 THEN 0 ELSE greatest(0, 6 - CAST(floor(log10(abs(x))) AS INT)) END AS d FROM ({NUMBERS})),
t AS (SELECT o_orderkey, x, d, replace(CASE d WHEN 0 THEN format('{{:,.0f}}', x) WHEN 1 THEN format('{{:,.1f}}', x) WHEN 2 THEN format('{{:,.2f}}', x) WHEN 3 THEN format('{{:,.3f}}', x) WHEN 4 THEN format('{{:,.4f}}', x)
WHEN 5 THEN format('{{:,.5f}}', x) WHEN 6 THEN format('{{:,.6f}}', x) WHEN 7 THEN format('{{:,.7f}}', x) WHEN 8 THEN format('{{:,.8f}}', x) WHEN 9 THEN format('{{:,.9f}}', x) ELSE format('{{:,.10f}}', x) END, ',', ' ') AS s FROM n)
SELECT o_orderkey, CASE WHEN x = 0 THEN '0' WHEN contains(s, '.') THEN regexp_replace(s, '\\.?0+$', '') ELSE s END AS shown FROM t""")
def q81_format_sig(spark, sf):
    _table(spark, sf, "orders")
    return spark.sql(NUMBERS).select("o_orderkey", text.format_sig(F.col("x").cast("double")).alias("shown"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'psi = bar × 14.50377' WHEN 1 THEN 'm = in ÷ 39.37008' WHEN 2 THEN 'K = C + 273.15' ELSE 'F = C × 1.8 + 32' END AS formula FROM part""")
def q82_conversion_formula(spark, sf):
    formulas = units.conversion_formula(_factors(spark))
    pick = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'in' ELSE 'C' END"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'psi' WHEN 1 THEN 'm' WHEN 2 THEN 'K' ELSE 'F' END")
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", pick[0].alias("unit"), pick[1].alias("to_unit"))
    return parts.join(formulas, ["unit", "to_unit"]).select("p_partkey", "formula")


RAW = "text || ',' || chr(10) || ';' || chr(92)"


@query(f"""SELECT doc_id, CASE WHEN t = '' THEN '' ELSE list_reduce(list_transform(string_split(t, ''), lambda x: {{'s': x, 'n': strlen(x)}}),
  lambda a, x: {{'s': a.s || CASE WHEN a.n + x.n > 74 THEN chr(13) || chr(10) || ' ' ELSE '' END || x.s, 'n': CASE WHEN a.n + x.n > 74 THEN x.n ELSE a.n + x.n END}}).s END AS line
FROM (SELECT doc_id, replace(replace(replace(replace({RAW}, chr(92), chr(92) || chr(92)), ',', chr(92) || ','), ';', chr(92) || ';'), chr(10), chr(92) || 'n') AS t FROM documents)""")
def q83_ics_text(spark, sf):
    """The documents as calendar lines."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(RAW.replace("chr(", "char(")).alias("t"))
    return docs.select("doc_id", text.ics_fold(text.ics_escape(F.col("t"))).alias("line"))


BAND = """SELECT id, speed, minutes, departure + to_minutes(minutes) AS arrival, CAST(minutes // 1440 AS STRING) || 'd ' || CAST(minutes % 1440 // 60 AS STRING) || 'h ' || CAST(minutes % 60 AS STRING) || 'm' AS under_way, k = 0 AS entered
FROM (SELECT id, k, speed, departure, CAST(floor(distance_nm / speed * 60 + 0.5) AS INT) AS minutes FROM (SELECT v.id, k, departure, distance_nm, round(speed_kn + k / 10.0, 1) AS speed FROM voyages v, range(-9, 11) r(k) WHERE distance_nm > 0 AND speed_kn > 0) WHERE speed > 0)"""


@query(with_views(BAND, "voyages"))
def q60g_eta_band(spark, sf):
    return units.eta_band(view(spark, sf, "voyages"))


PROPS = "SELECT product, t, t * t / 10 + k AS pressure, 500 - t * 2 - k AS latent FROM (VALUES ('A', 0.0), ('B', 5.0)) p(product, k), (VALUES (0.0), (10.0), (20.0), (30.0), (45.0)) x(t)"
POINTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS product, CASE WHEN c_custkey % 11 <> 5 THEN c_custkey % 100 / 2.0 - 2 END AS t FROM customer"


def _doubles(df):
    return df.select(*(F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes))


def _looked_up(spark, sf):
    _table(spark, sf, "customer")
    return units.interp_lookup(_doubles(spark.sql(POINTS)), _doubles(spark.sql(PROPS)), "t", ["pressure", "latent"])


LOOKED = f"""SELECT p.id, p.product, p.t, lo.pressure + (p.t - lo.t) / (lo.t2 - lo.t) * (lo.p2 - lo.pressure) AS pressure, lo.latent + (p.t - lo.t) / (lo.t2 - lo.t) * (lo.l2 - lo.latent) AS latent,
CASE WHEN p.t IS NULL THEN 'no value' WHEN lo.t IS NULL THEN 'out of range' ELSE 'ok' END AS status FROM (SELECT id, product, CAST(t AS DOUBLE) AS t FROM ({POINTS})) p
LEFT JOIN (SELECT product, CAST(t AS DOUBLE) AS t, CAST(pressure AS DOUBLE) AS pressure, CAST(latent AS DOUBLE) AS latent, CAST(lead(t) OVER w AS DOUBLE) AS t2, CAST(lead(pressure) OVER w AS DOUBLE) AS p2, CAST(lead(latent) OVER w AS DOUBLE) AS l2 FROM ({PROPS}) WINDOW w AS (PARTITION BY product ORDER BY t)) lo
ON lo.product = p.product AND lo.t2 IS NOT NULL AND p.t >= lo.t AND (p.t < lo.t2 OR (p.t = lo.t2 AND lo.t2 = 45))"""


@query(f"SELECT id, product, round(pressure, 6) AS pressure, round(latent, 6) AS latent, status FROM ({LOOKED})")
def q34_interp_lookup(spark, sf):
    return _looked_up(spark, sf).select("id", "product", F.round("pressure", 6).alias("pressure"), F.round("latent", 6).alias("latent"), "status")


@query(f"""SELECT id, round(coalesce(rate, heat / latent), 8) AS rate, round(coalesce(heat, rate * latent), 6) AS heat FROM (SELECT *, CASE WHEN id % 2 = 0 THEN id * 3.0 END::DOUBLE AS heat, CASE WHEN id % 2 = 1 THEN id / 7.0 END::DOUBLE AS rate FROM ({LOOKED}) WHERE status = 'ok')""")
def q35_boil_off(spark, sf):
    rows = _looked_up(spark, sf).where("status = 'ok'").withColumns({"heat": F.when(F.col("id") % 2 == 0, F.col("id") * 3.0), "rate": F.when(F.col("id") % 2 == 1, F.col("id") / 7.0)})
    return units.boil_off(rows).select("id", F.round("rate", 8).alias("rate"), F.round("heat", 6).alias("heat"))


@query(f"""SELECT id, round(CASE WHEN id % 50 < pressure THEN greatest((t * 2 - id % 40) / latent, 0) ELSE 0 END, 8) AS flash, round(CASE WHEN id % 50 < pressure THEN greatest((t * 2 - id % 40) / latent, 0) ELSE 0 END * 100, 6) AS flash_quantity FROM ({LOOKED}) WHERE status = 'ok'""")
def q35_flash_fraction(spark, sf):
    rows = _looked_up(spark, sf).where("status = 'ok'").withColumns({
        "h_in": F.col("t") * 2, "h_tank": F.col("id") % 40, "tank_pressure": F.col("id") % 50, "vapour_pressure": F.col("pressure"), "quantity": F.lit(100.0),
    })
    return units.flash_fraction(rows).select("id", F.round("flash", 8).alias("flash"), F.round("flash_quantity", 6).alias("flash_quantity"))


TILE = "CAST(CAST(floor((lon + 180) / 4) AS INT) AS STRING) || '_' || CAST(CAST(floor((lat + 90) / 4) AS INT) AS STRING)"


@query(with_views(f"SELECT {TILE} AS tile, count(*) AS n, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM positions GROUP BY 1", "positions"))
def q86_tile_stats(spark, sf):
    return units.tile_stats(view(spark, sf, "positions"))


@query(with_views(f"SELECT id, 'x' || {TILE} AS tile FROM positions WHERE id % 9 = 0", "positions"))
def q86_outside_tile(spark, sf):
    own = text.tile_key(F.col("lon"), F.col("lat"))
    rows = view(spark, sf, "positions").withColumn("tile", F.when(F.col("id") % 9 == 0, F.concat(F.lit("x"), own)).otherwise(own))
    return units.outside_tile(rows).select("id", "tile")


DEG = "lpad(CAST(CAST(floor(round(abs({v}) * 60, 1) / 60) AS INT) AS STRING), {w}, '0') || '° ' || lpad(format('{{:.1f}}', round(abs({v}) * 60, 1) - CAST(floor(round(abs({v}) * 60, 1) / 60) AS INT) * 60), 4, '0') || ''' ' || CASE WHEN {v} < 0 THEN '{m}' ELSE '{p}' END"


@query(with_views(f"""SELECT id, {DEG.format(v='lat', w=2, p='N', m='S')} || ' ' || {DEG.format(v='lon', w=3, p='E', m='W')} AS position,
'UTC' || CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(off) // 60 AS STRING), 2, '0') || ':' || lpad(CAST(abs(off) % 60 AS STRING), 2, '0') AS offset_
FROM (SELECT *, id % 49 * 30 - 720 AS off FROM positions) WHERE lower(name) LIKE 'customer#0000%'""", "positions"))
def q87_places(spark, sf):
    found = units.find_places(view(spark, sf, "positions"), "Customer#0000")
    return found.select("id", text.format_position(F.col("lat"), F.col("lon")).alias("position"), text.format_offset(F.col("id") % 49 * 30 - 720).alias("offset_"))


@query("SELECT 'c' AS category, 'u' || CAST(p_partkey AS STRING) AS unit, CASE WHEN p_partkey % 10 = 1 THEN 'unknown' WHEN p_partkey % 10 = 2 THEN 'missing' ELSE 'differs' END AS problem FROM part WHERE p_partkey % 10 IN (1, 2, 3)")
def q88_check_factors(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("c").alias("category"), F.concat(F.lit("u"), "p_partkey").alias("unit"), F.col("p_retailprice").alias("factor"), (F.col("p_partkey") % 10).alias("k"))
    shifted = p.where("k <> 1").withColumn("factor", F.col("factor") * F.when(F.col("k") == 3, 1 + 1e-6).otherwise(1 + 1e-12))
    return quality.check_factors(p.where("k <> 2"), shifted).select("category", "unit", "problem")
