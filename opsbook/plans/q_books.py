"""Queries over calls, registers, media, cargo logs and instruments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import agenda, calls, logs, media, quality, register
from ..sources import files
from .registry import query
from .views import view, with_views

NAME = "CASE kind WHEN 'arrival' THEN 'Arrival' WHEN 'departure' THEN 'Departure' WHEN 'lastmin' THEN 'Last minute' ELSE 'Taking over' END"
CALL_DAY = "CASE WHEN kind = 'lastmin' AND arrival IS NOT NULL THEN CAST(arrival - 1 AS DATE) ELSE date END"
REMARKS = f"{NAME} || CASE WHEN arrival IS NOT NULL THEN ', arrival ' || strftime(arrival, '%d-%b-%Y') ELSE '' END"
EXPANDED = f"""SELECT c.book_id, c.id || '/' || CAST(l.seq AS STRING) AS id, c.id AS call_id, l.item || CASE WHEN port <> '' THEN ' — ' || port ELSE '' END AS job,
{CALL_DAY.replace('kind', 'c.kind')} AS due, {REMARKS.replace('kind', 'c.kind')} AS remarks, l.ra, l.ptw, l.seq FROM calls c JOIN checklist l ON l.kind = c.kind"""


def _jobs(spark, sf):
    """Checklist jobs of all calls, the even items done."""
    rows = calls.expand_calls(view(spark, sf, "calls"), view(spark, sf, "checklist"))
    done = F.split_part("id", F.lit("/"), F.lit(2)).cast("int") % 2 == 0
    return rows.withColumns({"done": done, "date_completed": F.when(done, F.col("due"))})


@query(with_views(f"SELECT book_id, id, call_id, job, due, remarks, ra, ptw FROM ({EXPANDED})", "calls", "checklist"))
def q23_expand_calls(spark, sf):
    return calls.expand_calls(view(spark, sf, "calls"), view(spark, sf, "checklist")).drop("done", "date_completed")


@query(with_views("""SELECT min(id) AS id, book_id, port, date, kind FROM (SELECT book_id, lower(port) AS port, date, kind, id FROM calls WHERE substr(id, 2)::INT % 3 <> 0
UNION ALL SELECT book_id, lower(port), date, kind, id || 'x' FROM calls) i
WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE substr(c.id, 2)::INT % 3 = 0 AND c.book_id = i.book_id AND lower(c.port) = i.port AND c.date = i.date AND c.kind = i.kind) GROUP BY book_id, port, date, kind""", "calls"))
def q24_accept_calls(spark, sf):
    own = view(spark, sf, "calls").withColumn("n", F.substring("id", 2, 9).cast("int"))
    again = own.withColumns({"id": F.concat("id", F.lit("x")), "port": F.upper("port")})
    return calls.accept_calls(own.where("n % 3 = 0"), own.where("n % 3 <> 0").unionByName(again)).select("id", "book_id", F.lower("port").alias("port"), "date", "kind")


@query(with_views(f"""SELECT book_id, id, CASE WHEN moved AND seq % 2 = 1 THEN CASE WHEN kind = 'lastmin' THEN new_arrival - 1 ELSE new_date END ELSE due END AS due,
CASE WHEN moved AND seq % 2 = 1 THEN {NAME} || ', arrival ' || strftime(new_arrival, '%d-%b-%Y') ELSE remarks END AS remarks FROM (
  SELECT e.*, c.kind, substr(c.id, 2)::INT % 2 = 0 AS moved, CAST(c.date + 5 AS DATE) AS new_date, CAST(c.date + 6 AS DATE) AS new_arrival FROM ({EXPANDED}) e JOIN calls c ON c.book_id = e.book_id AND c.id = e.call_id)""", "calls", "checklist"))
def q25_redate_calls(spark, sf):
    own = view(spark, sf, "calls")
    changes = own.where("cast(substring(id, 2, 9) as int) % 2 = 0").select("book_id", F.col("id").alias("call_id"), F.date_add("date", 5).alias("date"), F.date_add("date", 6).alias("arrival"))
    return calls.redate_calls(_jobs(spark, sf), own, changes).select("book_id", "id", "due", "remarks")


@query(with_views(f"SELECT book_id, id, call_id FROM ({EXPANDED}) WHERE NOT (substr(call_id, 2)::INT % 5 = 0 AND seq % 2 = 1)", "calls", "checklist"))
def q26_remove_calls(spark, sf):
    own = view(spark, sf, "calls")
    gone = own.where("cast(substring(id, 2, 9) as int) % 5 = 0").select("book_id", F.col("id").alias("call_id"))
    return calls.remove_calls(_jobs(spark, sf), own, gone)[0].select("book_id", "id", "call_id")


@query(with_views("SELECT book_id, id AS call_id, '4 of 8 done' AS progress FROM calls", "calls"))
def q39_call_progress(spark, sf):
    return calls.call_progress(_jobs(spark, sf), view(spark, sf, "calls"))


def _register(spark, sf):
    return view(spark, sf, "crew").where("cast(substring(id, 2, 9) as int) % 3 = 0").select("book_id", "id", "name", F.lit("ship").alias("kind"), "rank", F.lit("Old ship").alias("ship"), "dob")


REGISTER = """SELECT book_id, id, name, 'ship' AS kind, rank, CASE WHEN substr(id, 2)::INT % 3 = 0 THEN 'Old ship' ELSE ship END AS ship, dob FROM crew"""


@query(with_views(REGISTER, "crew"))
def q28_update_register(spark, sf):
    return register.update_register(_register(spark, sf), view(spark, sf, "crew"))


@query(with_views(f"""SELECT book_id, id, kind2 AS kind, CASE WHEN kind2 = 'ship' THEN rank END AS rank, CASE WHEN kind2 = 'ship' THEN ship END AS ship
FROM (SELECT *, CASE WHEN substr(id, 2)::INT % 7 = 0 THEN 'family' ELSE kind END AS kind2 FROM ({REGISTER}))""", "crew"))
def q28_refile(spark, sf):
    own = register.update_register(_register(spark, sf), view(spark, sf, "crew"))
    changes = own.where("cast(substring(id, 2, 9) as int) % 7 = 0").select("book_id", "id", F.lit("family").alias("kind"))
    return register.refile(own, changes).select("book_id", "id", "kind", "rank", "ship")


@query(with_views("""SELECT book_id, id, CASE WHEN k = 'ship' THEN coalesce(CASE rank WHEN 'BUILDING' THEN 'Bldg' WHEN 'MACHINERY' THEN 'Mach' END, rank) || ' ' || name || ' (' || ship || ')'
ELSE name || ' (' || upper(substr(k, 1, 1)) || substr(k, 2) || ')' END AS label FROM (SELECT *, CASE substr(id, 2)::INT % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'family' ELSE 'friend' END AS k FROM crew)""", "crew"))
def q15_birthday_label(spark, sf):
    kinds = F.expr("CASE cast(substring(id, 2, 9) as int) % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'family' ELSE 'friend' END")
    short = spark.createDataFrame([("BUILDING", "Bldg"), ("MACHINERY", "Mach")], "rank string, abbrev string")
    return register.birthday_label(view(spark, sf, "crew").withColumn("kind", kinds), short).select("book_id", "id", "label")


PASTED = "'Particulars of \"' || ship || '\"' || chr(10) || 'IMO: ' || id || chr(10) || 'stray line' || chr(10) || 'call sign - ' || name || chr(10)"


@query(with_views("""SELECT CAST(substr(id, 2) AS INT) AS book_id, ship AS ship_name, id AS "IMO", name AS "Call sign" FROM crew""", "crew"))
def q16_parse_particulars(spark, sf):
    pasted = view(spark, sf, "crew").select(F.substring("id", 2, 9).cast("int").alias("book_id"), F.expr(PASTED.replace("chr(10)", "char(10)")).alias("text"))
    return register.parse_particulars(pasted, ["IMO", "Call sign"])


@query(with_views("SELECT c.book_id, c.id, d.day FROM crew c JOIN (SELECT CAST(unnest(range(DATE '2024-02-27', DATE '2024-03-03', INTERVAL 1 DAY)) AS DATE) AS day) d ON strftime(c.dob, '%m-%d') = strftime(d.day, '%m-%d')", "crew"))
def q29_birthdays_on(spark, sf):
    days = spark.sql("SELECT explode(sequence(DATE'2024-02-27', DATE'2024-03-02')) AS day")
    return agenda.birthdays_on(view(spark, sf, "crew").withColumn("kind", F.lit("ship")), days, "ship").select("book_id", "id", "day")


@query(with_views("SELECT ref FROM media m WHERE stored < DATE '2001-07-25' AND NOT EXISTS (SELECT 1 FROM photo_refs p WHERE p.ref = m.ref)", "media", "photo_refs"))
def q30_orphan_media(spark, sf):
    used = {k: [] for k in media.USERS} | {"jobs": [view(spark, sf, "photo_refs")]}
    return media.orphan_media(view(spark, sf, "media"), used, dt.date(2001, 8, 1))


PICS = "SELECT o_orderkey AS id, o_orderkey % 4 AS n FROM orders"


@query(f"""SELECT id, pos, CASE WHEN pos % 2 = 0 THEN 'p:' || sha256('data:image/png;' || CAST(id % 50 AS STRING) || '-' || CAST(pos AS STRING)) ELSE 'p:old' || CAST(pos AS STRING) END AS ref
FROM (SELECT id, unnest(range(n)) AS pos FROM ({PICS}))""")
def q31_externalise_media(spark, sf):
    spark.read.parquet(f"{sf}/orders.parquet").createOrReplaceTempView("orders")
    rows = spark.sql(f"""SELECT id, transform(filter(sequence(0, 3), k -> k < n), k -> CASE WHEN k % 2 = 0 THEN concat('data:image/png;', id % 50, '-', k) ELSE concat('p:old', k) END) AS photos FROM ({PICS})""")
    return media.externalise_media(rows, ["id"], "photos")[0].select("id", F.posexplode("photos").alias("pos", "ref")).withColumn("pos", F.col("pos").cast("long"))


@query(with_views("SELECT book_id, date, hour, tank, field, max_by(value, seq) AS value FROM cargo_readings GROUP BY ALL", "cargo_readings"))
def q84_latest_reading(spark, sf):
    return logs.latest_reading(view(spark, sf, "cargo_readings"))


@query(with_views("""SELECT book_id, date, CAST(hour AS STRING) AS time, CAST(tank AS STRING) AS tank, CASE field WHEN 'purchase' THEN 'port' WHEN 'click' THEN 'stbd' END AS side,
CASE field WHEN 'purchase' THEN 'top' WHEN 'click' THEN 'mid' ELSE field END AS level, CAST(value AS STRING) AS value FROM (SELECT book_id, date, hour, tank, field, max_by(CAST(value * 100 AS BIGINT), seq) AS value FROM cargo_readings GROUP BY ALL)""", "cargo_readings"))
def q84_explode_tanks(spark, sf):
    name = F.expr("CASE field WHEN 'purchase' THEN 'portTop' WHEN 'click' THEN 'stbdMid' ELSE field END")
    rows = view(spark, sf, "cargo_readings").withColumn("value", F.round(F.col("value") * 100).cast("long").cast("string"))
    last = logs.latest_reading(rows).withColumns({"field": name, "time": F.col("hour").cast("string"), "tank": F.col("tank").cast("string")})
    per = last.groupBy("book_id", "date", "time", "tank").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    return logs.explode_tanks(per.groupBy("book_id", "date", "time").agg(F.map_from_entries(F.collect_list(F.struct("tank", "fields"))).alias("tanks")))


@query(with_views("""SELECT book_id, date, hour AS time, CASE WHEN bool_or(seq % 2 = 1) THEN max(CASE WHEN seq % 2 = 1 THEN seq END) ELSE max(seq) END AS entry
FROM cargo_readings GROUP BY book_id, date, hour""", "cargo_readings"))
def q84_upsert_cargo(spark, sf):
    rows = view(spark, sf, "cargo_readings").select("book_id", "date", F.col("hour").alias("time"), "seq")

    def latest(where):
        return rows.where(where).groupBy("book_id", "date", "time").agg(F.max("seq").alias("entry"))

    return logs.upsert_cargo(latest("seq % 2 = 0"), latest("seq % 2 = 1"))


def _instruments(spark, sf):
    """An instrument for each supplier: two procedures of n and 1 steps, n spares."""
    spark.read.parquet(f"{sf}/supplier.parquet").createOrReplaceTempView("supplier")
    return spark.sql("""SELECT concat('m', s_suppkey) AS id, concat('Model ', s_suppkey) AS model, concat('S', s_suppkey) AS serial,
      transform(sequence(1, cast(1 + s_suppkey % 3 AS int)), k -> named_struct('name', concat('part', k))) AS parts,
      array(named_struct('title', 'Set up [doc 1]', 'steps', transform(sequence(1, cast(1 + s_suppkey % 4 AS int)), k -> named_struct('text', concat('Step ', k, if(s_suppkey % 5 = 0 AND k = 1, '', ' [doc 1]'))))),
            named_struct('title', 'Check [doc 2]', 'steps', array(named_struct('text', 'Look [doc 2]')))) AS procedures FROM supplier""")


@query("SELECT 'Model ' || s_suppkey AS model, 'S' || s_suppkey AS serial, 2 AS procedures, 2 + s_suppkey % 4 AS steps, 1 + s_suppkey % 3 AS spares FROM supplier")
def q41_instrument_counts(spark, sf):
    return logs.instrument_counts(_instruments(spark, sf))


STEPS = """SELECT 'Model ' || s_suppkey AS model, 'S' || s_suppkey AS serial, 1 AS procedure_no, 'Set up [doc 1]' AS title, k AS step_no, 'Step ' || k || CASE WHEN s_suppkey % 5 = 0 AND k = 1 THEN '' ELSE ' [doc 1]' END AS text
FROM supplier, (VALUES (1), (2), (3), (4)) n(k) WHERE k <= 1 + s_suppkey % 4
UNION ALL SELECT 'Model ' || s_suppkey, 'S' || s_suppkey, 2, 'Check [doc 2]', 1, 'Look [doc 2]' FROM supplier"""


@query(STEPS)
def q85_explode_instruments(spark, sf):
    return logs.explode_instruments(_instruments(spark, sf))


@query("SELECT 'm' || s_suppkey AS id, 'Model ' || s_suppkey AS model, 'S' || s_suppkey AS serial FROM supplier UNION ALL SELECT 'm' || s_suppkey || '-copy', 'Model ' || s_suppkey || ' (copy)', '' FROM supplier WHERE s_suppkey % 4 = 0")
def q85_duplicate_instrument(spark, sf):
    own = _instruments(spark, sf)
    return logs.duplicate_instrument(own, own.where("cast(substring(id, 2, 9) as int) % 4 = 0").select("id")).select("id", "model", "serial")


@query("SELECT 'Model ' || s_suppkey AS model, 'cites nothing: Step 1' AS problem FROM supplier WHERE s_suppkey % 5 = 0")
def q90_check_instruments(spark, sf):
    return quality.check_instruments(_instruments(spark, sf))


@query("""SELECT 'Model ' || s_suppkey AS model, 'S' || s_suppkey AS serial, 1 + s_suppkey % 3 AS parts FROM supplier WHERE s_suppkey % 6 <> 5""")
def q3_instrument_documents(spark, sf):
    """Documents made of the instruments, some of another format and some rubbish, read as files would be."""
    own = _instruments(spark, sf)
    n = F.col("id").substr(2, 9).cast("int") % 6
    form = F.when(n == 5, "another").otherwise(files.INSTRUMENT_FORMAT)
    docs = own.select(F.to_json(F.struct(form.alias("format"), F.lit("1").alias("version"), F.lit("s").alias("source"), F.array(F.struct("model", "serial", "parts", "procedures")).alias("instruments"))).alias("value"))
    docs = docs.unionByName(own.where("id like 'm1%'").select(F.lit("{rubbish").alias("value")))
    return files.parse_instruments(docs).select("model", "serial", F.size("parts").alias("parts"))


@query("SELECT 'n' || c_custkey AS id, 'p' || (c_custkey % 3) AS page, 3 AS marks, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS outside FROM customer")
def q91_check_marks(spark, sf):
    spark.read.parquet(f"{sf}/customer.parquet").createOrReplaceTempView("customer")
    notes = spark.sql("""SELECT concat('n', c_custkey) AS id, map(concat('p', c_custkey % 3), array(named_struct('x', 0.5D, 'y', 0.2D), named_struct('x', 1.01D, 'y', -0.01D),
      named_struct('x', if(c_custkey % 7 = 0, 1.2D, 0.1D), 'y', 0.9D))) AS marks FROM customer""")
    return quality.check_marks(notes)


@query("""SELECT 'no note' AS problem, 'e' || p_partkey AS name FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'no entry', 'x' || p_partkey FROM part WHERE p_partkey % 10 = 1
UNION ALL SELECT DISTINCT 'no intro', 'c' || (p_partkey % 4) FROM part WHERE p_partkey % 4 = 3""")
def q89_check_notes_complete(spark, sf):
    spark.read.parquet(f"{sf}/part.parquet").createOrReplaceTempView("part")
    entries = spark.sql("SELECT concat('e', p_partkey) AS name, concat('c', p_partkey % 4) AS category FROM part")
    notes = spark.sql("SELECT concat('e', p_partkey) AS name FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT concat('x', p_partkey) FROM part WHERE p_partkey % 10 = 1")
    return quality.check_notes_complete(entries, notes, spark.sql("SELECT DISTINCT concat('c', p_partkey % 4) AS category FROM part WHERE p_partkey % 4 <> 3"))


@query(with_views("""SELECT t.book_id, t.n, last_backup FROM (SELECT book_id, count(*) + count(*) FILTER (WHERE weekly_report) AS n FROM jobs GROUP BY 1) t
LEFT JOIN (SELECT DISTINCT book_id, CAST(DATE '2024-01-31' - CAST(book_id AS INT) AS DATE) AS last_backup, book_id % 6 = 0 AS quiet FROM jobs WHERE book_id % 9 <> 0) b USING (book_id)
WHERE (last_backup IS NULL OR DATE '2024-01-31' - last_backup > 14) AND NOT coalesce(quiet, false)""", "jobs"))
def q17_backup_due(spark, sf):
    own = view(spark, sf, "jobs")
    lists = quality.list_counts({"jobs": own, "weekly": own.where("weekly_report")})
    today = dt.date(2024, 1, 31)
    backups = own.select("book_id").distinct().where("book_id % 9 <> 0").select(
        "book_id", F.date_sub(F.lit(today), F.col("book_id")).alias("last_backup"), F.when(F.col("book_id") % 6 == 0, F.date_sub(F.lit(today), 3)).otherwise(F.date_sub(F.lit(today), 8)).alias("snoozed")
    )
    return quality.backup_due(lists, backups, today)
