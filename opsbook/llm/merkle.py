"""Merkle dataset manifest: one tree for each source, one over the sources, and a proof for each row.

Levels are built bottom-up by Spark aggregates and stored as node rows that name their parent. A recursive query then
climbs from the leaves to the root: every step joins the node rows, appends the siblings there and folds them with what
the row has so far. The leaves of one run share all siblings above it, so a climbing row is a run of up to FANOUT
leaves, with a fold for each of them and one list of siblings.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import cut

FANOUT = 16
TOP = -1  # number of the tree over the sources
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

NODE = "tree long, level int, place long, hash string, before string, after string, up struct<tree: long, level: int, place: long>"
RESULT = ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT key.tree AS tree, key.level AS level, key.place AS place, tree AS of_tree, run, folds, unhex('') AS siblings, CAST(NULL AS STRING) AS subroot FROM {{base}}
  UNION ALL
  SELECT n.up.tree, n.up.level, n.up.place, c.of_tree, c.run, transform(c.folds, x -> sha2(concat(n.before, x, n.after), 256)),
         concat(c.siblings, unhex(concat(n.before, n.after))), CASE WHEN c.tree <> {TOP} AND n.up.tree = {TOP} THEN n.hash ELSE c.subroot END
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.place = n.place
)
SELECT of_tree AS tree, run, folds, lower(hex(siblings)) AS siblings, subroot FROM climb WHERE {{end}}
"""


def field(c: Column) -> Column:
    """A value in a leaf: its UTF-8 length, a colon and itself; null is a dash, which no length begins with."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def tampered(text: Column) -> Column:
    """The text with A-Z in lower case where 5 divides the checksum of doc_id; a null doc_id has none."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def deal(rows: DataFrame, tree: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows in order, spans): rows with their `part` and `row` in it, and for each tree and part (`first` row, rows
    `before` in other parts, `total` rows of the tree). Nulls come first.

    Rows are range-partitioned and numbered where they lie, and only one row a tree and part is summed up, so a
    tree that holds most rows is counted by all tasks. Equal rows are told apart by where they were read.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [tree, *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).drop("tie"), name)
    own = Window.partitionBy(tree)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    return dealt, spans.select(tree, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"))


def ranked(dealt: DataFrame, spans: DataFrame, tree: str) -> DataFrame:
    """Dealt rows with `place`, from 0 in each tree, and what their span has."""
    other = spans.select(F.col(tree).alias("_tree"), F.col("part").alias("_part"), *(c for c in spans.columns if c not in (tree, "part")))
    rows = dealt.join(other, (F.col("part") == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return rows.withColumn("place", F.col("row") - F.col("first") + F.col("before")).drop("_tree", "_part", "part", "row", "first", "before")


def _beside(at: Column, before: bool) -> Column:
    """The hashes of a run before or after one of its places, joined."""
    return F.array_join(F.slice("hashes", F.lit(1), at) if before else F.slice("hashes", at + 2, F.lit(FANOUT)), "")


def _key(tree: Column | int, level: int, place: Column) -> Column:
    tree = F.lit(tree) if isinstance(tree, int) else tree
    return F.struct(tree.cast("long").alias("tree"), F.lit(level).alias("level"), place.cast("long").alias("place"))


def climb_levels(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Node rows of a level (tree, place, total, key, hash) and of all above, with what stands beside each and its
    parent's key; and (tree, key, hash) of the roots.

    A tree leaves the loop when it has one node, so there are about log16 of the largest tree's rows rounds.
    """
    linked, roots = nodes.sparkSession.createDataFrame([], NODE), None
    while True:
        done = nodes.where("total = 1").select("tree", "key", "hash")
        roots = done if roots is None else roots.unionByName(done)
        rest = nodes.where("total > 1")
        if rest.isEmpty():
            return linked, roots
        run = F.sort_array(F.collect_list(F.struct("place", "key", "hash")))
        runs = rest.groupBy("tree", "total", F.expr(f"place DIV {FANOUT}").alias("up")).agg(run.alias("run"))
        runs = runs.select("tree", "total", F.col("up").alias("place"), _key(F.col("tree"), level + 1, F.col("up")).alias("key"), F.col("run.key").alias("keys"), F.col("run.hash").alias("hashes"))
        runs = cut(runs.withColumn("hash", F.sha2(F.array_join("hashes", ""), 256)), "merkle-level")
        members = runs.select("key", "hashes", F.posexplode("keys").alias("at", "own"))
        at = F.col("at")
        linked = linked.unionByName(members.select("own.*", F.col("hashes")[at].alias("hash"), _beside(at, True).alias("before"), _beside(at, False).alias("after"), F.col("key").alias("up")))
        nodes = runs.select("tree", "place", F.ceil(F.col("total") / FANOUT).cast("long").alias("total"), "key", "hash")
        level += 1


def climb(base: DataFrame, nodes: DataFrame, root: Row) -> DataFrame:
    """(tree, run, folds, siblings, subroot) of every run when it has come to the root; written once.

    Spark stops recursive queries at a number of rows; that limit is lifted while this one runs.
    """
    spark, had = base.sparkSession, base.sparkSession.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        sql = CLIMB.replace("{end}", f"tree = {root['key']['tree']} AND level = {root['key']['level']}")
        return cut(spark.sql(sql, base=base, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(ROW_LIMIT, had) if had is not None else spark.conf.unset(ROW_LIMIT)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs.

    Every row is a leaf, rows that repeat a doc_id or are equal in all too; leaves of one doc_id are in the order of
    their hashes. A null doc_id comes first and is never tampered with; rows without source are a source of their own,
    the first. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    leaves = cut(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(tampered(F.col("text"))).alias("changed")), "merkle-leaves")
    dealt, spans = deal(leaves, "source", ["doc_id", "leaf", "changed"], "merkle-dealt")
    spans = cut(spans, "merkle-spans")
    found = deal(spans.select("source").distinct().withColumn("all", F.lit(TOP)), "all", ["source"], "merkle-sources")
    sources = cut(ranked(*found, "all").select(F.col("source").alias("_source"), F.col("place").alias("tree"), F.col("total").alias("trees")), "merkle-trees")
    rows = ranked(dealt, spans.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "source")

    one = F.col("total") == 1
    run = F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "changed")))
    runs = rows.groupBy("tree", "total", F.expr(f"place DIV {FANOUT}").alias("run")).agg(run.alias("leaves"))
    runs = cut(runs.withColumn("hashes", F.col("leaves.leaf")), "merkle-runs")
    key, hash_ = _key(F.col("tree"), 1, F.col("run")), F.when(one, F.col("hashes")[0]).otherwise(F.sha2(F.array_join("hashes", ""), 256))
    nodes = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("total") / FANOUT).cast("long").alias("total"), key.alias("key"), hash_.alias("hash"))
    lower, subroots = climb_levels(nodes, 1)
    trees = sources.select("tree", "trees")
    upper, roots = climb_levels(subroots.join(trees, "tree").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("total"), "key", "hash"), 0)
    root = roots.first()  # the one row of the whole table; none if that is empty
    if root is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}" + RESULT)
    fold = F.transform("leaves", lambda x, i: F.sha2(F.concat(_beside(i, True), x["changed"], _beside(i, False)), 256))
    base = runs.select(key.alias("key"), "tree", "run", F.when(one, F.col("leaves.changed")).otherwise(fold).alias("folds"))
    top = climb(base, cut(lower.unionByName(upper), "merkle-nodes"), root)
    each = runs.join(top, ["tree", "run"]).withColumn("root", F.lit(root["hash"])).select("*", F.posexplode("leaves").alias("at", "own"))
    at = F.col("at")
    folded = F.col("folds")[at]
    return each.select(
        "own.doc_id", "own.leaf", F.coalesce("subroot", "root").alias("subroot"), "root", F.sha2(F.concat(_beside(at, True), _beside(at, False), "siblings"), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
