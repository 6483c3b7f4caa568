"""Queries over the ledger merge, backups and the streaming merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import files, store
from ..streaming import merge
from .registry import query
from .views import view, with_views

WIN = "SELECT * FROM (SELECT * FROM side_a UNION ALL SELECT * FROM side_b) QUALIFY row_number() OVER (PARTITION BY book_id, list, id ORDER BY upd DESC, ctr DESC, dev DESC) = 1"
TOMB = "SELECT * FROM tombs QUALIFY row_number() OVER (PARTITION BY book_id, id ORDER BY upd DESC, ctr DESC, dev DESC) = 1"
MERGED = f"""SELECT w.* FROM ({WIN}) w LEFT JOIN ({TOMB}) t ON t.book_id = w.book_id AND t.id = w.id
WHERE t.id IS NULL OR w.upd > t.upd OR (w.upd = t.upd AND (w.ctr > t.ctr OR (w.ctr = t.ctr AND w.dev > t.dev)))"""
SIDES = ("side_a", "side_b", "tombs")


def _sides(spark, sf):
    return [view(spark, sf, n) for n in SIDES]


@query(with_views(MERGED, *SIDES))
def q74_merge_ledgers(spark, sf):
    a, b, t = _sides(spark, sf)
    return ledger.merge_ledgers(a, b, tombs=t)


@query(with_views(f"SELECT book_id, count(*) AS live, sum(CASE WHEN dev = 'dA' THEN 1 ELSE 0 END) AS of_a FROM ({MERGED}) GROUP BY 1", *SIDES))
def q75_tombstones(spark, sf):
    a, b, t = _sides(spark, sf)
    return ledger.merge_ledgers(b, a, a, tombs=t).groupBy("book_id").agg(F.count("*").alias("live"), F.count_if(F.col("dev") == "dA").alias("of_a"))


KIDS = "SELECT CAST(book_id AS BIGINT) AS book_id, goal_id AS parent_id, id, date, amount + {add} AS amount, CAST(substr(id, 3) AS BIGINT) % {mod} AS upd, CAST(0 AS INT) AS ctr, '{dev}' AS dev FROM goal_payments"


@query(with_views(f"""SELECT book_id, id, count(child_id) AS n, round(coalesce(sum(amount), 0), 4) AS total, string_agg(child_id, ',' ORDER BY date, child_id) AS children FROM (
SELECT p.book_id, p.id, k.id AS child_id, k.amount, k.date FROM (SELECT DISTINCT book_id, goal_id AS id FROM goal_payments) p LEFT JOIN (
  SELECT * FROM (SELECT * FROM ({KIDS.format(add=0, mod=10, dev='dA')}) UNION ALL SELECT * FROM ({KIDS.format(add=1, mod=7, dev='dB')})) q
  WHERE NOT (CAST(substr(id, 3) AS BIGINT) % 5 = 0 AND upd <= 4) QUALIFY row_number() OVER (PARTITION BY book_id, parent_id, id ORDER BY upd DESC, ctr DESC, dev DESC) = 1) k ON k.book_id = p.book_id AND k.parent_id = p.id) GROUP BY 1, 2""", "goal_payments"))
def q76_merge_children(spark, sf):
    own = view(spark, sf, "goal_payments")
    own.createOrReplaceTempView("goal_payments")
    a, b = (spark.sql(KIDS.format(**k)) for k in ({"add": 0, "mod": 10, "dev": "dA"}, {"add": 1, "mod": 7, "dev": "dB"}))
    n = F.col("id").substr(3, 12).cast("long")
    tombs = own.where(n % 5 == 0).select(F.col("book_id").cast("long"), "id", F.lit(4).cast("long").alias("upd"), F.lit(9).alias("ctr"), F.lit("z").alias("dev"))
    parents = own.select(F.col("book_id").cast("long"), F.col("goal_id").alias("id")).distinct()
    out = ledger.merge_children(a, b, tombs=tombs, parents=parents, fields=["amount"])
    return out.select("book_id", "id", F.coalesce(F.size("children"), F.lit(0)).alias("n"), F.round(F.coalesce(F.expr("aggregate(children, 0D, (s, c) -> s + c.amount)"), F.lit(0.0)), 4).alias("total"), F.expr("array_join(transform(children, c -> c.child_id), ',')").alias("children"))


@query(with_views(f"""SELECT m.book_id, count(*) FILTER (WHERE a.id IS NULL AND t.id IS NULL) AS added, count(*) FILTER (WHERE a.id IS NOT NULL AND (a.upd, a.ctr, a.dev) <> (m.upd, m.ctr, m.dev)) AS updated,
count(*) FILTER (WHERE a.id IS NULL AND t.id IS NOT NULL) AS revived FROM ({MERGED}) m LEFT JOIN side_a a USING (book_id, list, id) LEFT JOIN (SELECT DISTINCT book_id, id FROM tombs) t ON t.book_id = m.book_id AND t.id = m.id GROUP BY 1""", *SIDES))
def q77_merge_report(spark, sf):
    a, b, t = _sides(spark, sf)
    return ledger.merge_report(a, b, ledger.merge_ledgers(a, b, tombs=t), t)


@query(with_views("SELECT a.book_id, a.list, a.id FROM side_a a JOIN side_b b USING (book_id, list, id) WHERE a.upd > 500 AND b.upd > 500", *SIDES))
def q77_edited_on_both(spark, sf):
    a, b, _ = _sides(spark, sf)
    return ledger.edited_on_both(a, b, a.select("book_id").distinct().withColumn("since", F.lit(500)))


@query(with_views("SELECT *, 'a' AS side FROM (SELECT id, amount FROM side_a EXCEPT ALL SELECT id, amount - 1 FROM side_b WHERE upd % 2 = 0) UNION ALL SELECT *, 'b' FROM (SELECT id, amount - 1 FROM side_b WHERE upd % 2 = 0 EXCEPT ALL SELECT id, amount FROM side_a)", *SIDES))
def q59_ledger_diff(spark, sf):
    a, b, _ = _sides(spark, sf)
    return ledger.ledger_diff(a.select("id", "amount"), b.where("upd % 2 = 0").select("id", (F.col("amount") - 1).alias("amount")))


IDS = "CASE o_orderkey % 6 WHEN 0 THEN 'mtihxds0' || lpad(CAST(o_orderkey % 99999 AS STRING), 5, '0') WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN 'zzzzzzzzzzzzz' WHEN 4 THEN NULL ELSE 'm0000000' || lpad(CAST(o_orderkey % 99999 AS STRING), 5, '0') END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1788256800000 WHEN 5 THEN 1724011610112 ELSE 0 END AS born FROM (SELECT o_orderkey, {IDS} AS id FROM orders)")
def q72_born_at(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ledger.born_at(F.expr(IDS)).alias("born"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey WHEN o_orderkey % 6 = 0 THEN 1788256800000 WHEN o_orderkey % 6 = 5 THEN 1724011610112 ELSE 0 END AS upd, 0 AS ctr, '' AS dev FROM orders")
def q73_ready_for_merge(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr(IDS).alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("upd"))
    return ledger.ready_for_merge(rows).select("o_orderkey", "upd", "ctr", "dev")


CLOCKS = "SELECT 'd' || CAST(c_custkey AS STRING) AS dev, c_custkey * 10 AS ms, CAST(c_custkey % 4 AS INT) AS c FROM customer"
SEEN = "SELECT 'd' || CAST(o_custkey AS STRING) AS dev, o_orderkey AS ms, CAST(o_orderkey % 8 AS INT) AS c FROM orders"


def _clocks(spark, sf):
    for t in ("customer", "orders"):
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(CLOCKS), spark.sql(SEEN)


@query(f"""SELECT dev, greatest(ms, s_ms, 6000) AS ms, CASE WHEN greatest(ms, s_ms, 6000) = ms AND ms = s_ms THEN greatest(c, s_c) + 1 WHEN greatest(ms, s_ms, 6000) = ms THEN c + 1 WHEN greatest(ms, s_ms, 6000) = s_ms THEN s_c + 1 ELSE 0 END AS c
FROM (SELECT k.dev, k.ms, k.c, coalesce(s.ms, -1) AS s_ms, s.c AS s_c FROM ({CLOCKS}) k LEFT JOIN (SELECT * FROM ({SEEN}) QUALIFY row_number() OVER (PARTITION BY dev ORDER BY ms DESC, c DESC) = 1) s USING (dev))""")
def q79_absorb_clock(spark, sf):
    return ledger.absorb_clock(*_clocks(spark, sf), 6000)


@query(f"SELECT dev, greatest(ms, 6000) AS ms, CAST(CASE WHEN ms >= 6000 THEN c + 1 ELSE 0 END + k AS INT) AS c FROM ({CLOCKS}), (VALUES (0), (1), (2)) n(k)")
def q79_next_stamps(spark, sf):
    return ledger.next_stamps(_clocks(spark, sf)[0], 3, 6000)


@query("SELECT c_custkey AS book_id, 'own' AS dev, greatest(c_custkey * 10, 7000) AS ms, CAST(CASE WHEN c_custkey * 10 > 7000 OR c_custkey * 10 = 7000 AND c_custkey % 4 > 2 THEN c_custkey % 4 ELSE 2 END AS INT) AS c FROM customer")
def q78_restore_settings(spark, sf):
    own = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("book_id"), F.lit("own").alias("dev"), (F.col("c_custkey") * 10).alias("ms"), (F.col("c_custkey") % 4).cast("int").alias("c"))
    return ledger.restore_settings(own, own.select("book_id", F.lit(7000).cast("long").alias("ms"), F.lit(2).alias("c")))


@query(with_views("SELECT book_id, id, CASE WHEN book_id % 3 = 0 THEN amount * 2 ELSE amount END AS amount FROM cash_items WHERE NOT (book_id % 3 = 0 AND list = 'fixed')", "cash_items"))
def q78_restore_lists(spark, sf):
    """A third of the books restored from a file that has their income, doubled."""
    own = view(spark, sf, "cash_items").select("book_id", "id", "list", "amount")
    file = own.where("list = 'income'").withColumn("amount", F.col("amount") * 2)
    return ledger.restore_lists({"items": own}, {"items": file}, own.where("book_id % 3 = 0"))["items"].select("book_id", "id", "amount")


LISTS = {"loans": "id string, principal double, rate double", "cash_items": "id string, name string, list string, amount double"}


def _lists(spark, sf):
    c = {"loans": ["book_id", "id", "principal", "rate"], "cash_items": ["book_id", "id", "name", "list", "amount"]}
    return {n: view(spark, sf, n).select(*cols) for n, cols in c.items()}


@query(with_views("SELECT book_id, id, round(principal, 4) AS principal, round(rate, 4) AS rate FROM loans", "loans"))
def q6_backup_round_trip(spark, sf):
    """Loans as one JSON document per book and back."""
    back = files.parse_backups(files.backup_documents(_lists(spark, sf)), {n: s.replace(" ", ": ").replace(",: ", ", ") for n, s in LISTS.items()})["loans"]
    return back.withColumns({c: F.round(c, 4) for c in ("principal", "rate")})


@query(with_views("SELECT book_id, id, name, list, round(amount, 4) AS amount FROM cash_items", "cash_items"))
def q2_read_backup(spark, sf):
    """Cash items out of the same documents."""
    back = files.parse_backups(files.backup_documents(_lists(spark, sf)), {n: s.replace(" ", ": ").replace(",: ", ", ") for n, s in LISTS.items()})["cash_items"]
    return back.withColumn("amount", F.round("amount", 4))


@query(with_views("SELECT book_id, 'cash_items' AS list, id, name FROM cash_items UNION ALL SELECT book_id, 'loans', id, NULL FROM loans", "loans", "cash_items"))
def q5_ledger_flat_rows(spark, sf):
    lists = _lists(spark, sf)
    lists["cash_items"] = lists["cash_items"].withColumnRenamed("list", "section")
    return files.ledger_flat_rows(lists).select("book_id", "list", "id", "name")


@query(with_views("SELECT book_id, id, 'jobs' AS tab FROM jobs WHERE book_id % 10 <> 3 UNION ALL SELECT book_id, id, 'birthdays' FROM crew", "jobs", "crew"))
def q9_sign_off(spark, sf):
    """What stays after some books are archived."""
    tables = {"jobs": view(spark, sf, "jobs"), "birthdays": view(spark, sf, "crew")}
    gone = tables["jobs"].select("book_id").distinct().where("book_id % 10 = 3")
    left = files.sign_off(tables, gone, store.new_folder(spark, "archive"))
    return left["jobs"].select("book_id", "id", F.lit("jobs").alias("tab")).unionByName(left["birthdays"].select("book_id", "id", F.lit("birthdays").alias("tab")))


@query(with_views(MERGED, *SIDES))
def q80_stream_merge(spark, sf):
    """The merge of q74 from a stream of all edits."""
    a, b, t = _sides(spark, sf)
    edits = a.withColumn("deleted", F.lit(False)).unionByName(b.withColumn("deleted", F.lit(False)))
    edits = edits.unionByName(t.select("book_id", F.lit("jobs").alias("list"), "id", "upd", "ctr", "dev", F.lit(None).cast("double").alias("amount"), F.lit(True).alias("deleted")))
    source, folder = store.new_folder(spark, "edits"), store.new_folder(spark, "ledger")
    edits.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 2).parquet(source)
    running = merge.stream_merge(stream, folder, store.new_folder(spark, "progress"))
    running.awaitTermination()
    return merge.live_records(merge.last_version(spark, folder))
