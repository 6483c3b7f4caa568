"""Merging copies of a ledger: the greatest stamp (upd, ctr, dev) of each id wins, deletes hold until a later edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["book_id", "list", "id"]
STAMP = ["upd", "ctr", "dev"]
DIGEST_BUCKETS = 64  # of a part of a ledger, whose digests are compared
FIRST_MS, LAST_MS = 946_684_800_000, 2_524_608_000_000  # 2000-01-01 and 2050-01-01


def stamp(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}upd").alias("upd"), F.col(f"{prefix}ctr").alias("ctr"), F.col(f"{prefix}dev").alias("dev"))


def born_at(id_: Column) -> Column:
    """Milliseconds in an id of 8 base-36 digits and 5 more characters; 0 for other ids and unlikely times."""
    ours = F.coalesce(id_.rlike("^[0-9a-z]{13}$"), F.lit(False))
    ms = F.when(ours, F.conv(F.substring(id_, 1, 8), 36, 10).cast("long"))
    return F.when(ms.between(FIRST_MS, LAST_MS), ms).otherwise(F.lit(0).cast("long"))


def ready_for_merge(records: DataFrame) -> DataFrame:
    """Records with a full stamp: edit time from the id where absent, counter 0, empty device."""
    have = records
    for c, kind in (("upd", "long"), ("ctr", "int"), ("dev", "string")):
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None).cast(kind))
    return have.withColumns({"upd": F.coalesce("upd", born_at(F.col("id"))), "ctr": F.coalesce("ctr", F.lit(0)), "dev": F.coalesce("dev", F.lit(""))})


def child_ids(records: DataFrame, col: str) -> DataFrame:
    """(book_id, list, parent_id, pos, id, child): nested entries as rows; one without id gets the hash of parent, place and content."""
    rows = records.select("book_id", "list", F.col("id").alias("parent_id"), F.posexplode(col).alias("pos", "child"))
    derived = F.sha2(F.concat_ws("|", "parent_id", F.col("pos").cast("string"), F.to_json("child")), 256)
    return rows.withColumn("id", F.coalesce(F.col("child.id"), derived))


def latest(records: DataFrame, key: list[str]) -> DataFrame:
    """The record of the greatest stamp of each key; equal stamps are decided by the record's JSON, which is made only there."""
    own = Window.partitionBy(*key)
    first = records.withColumn("_rank", F.rank().over(own.orderBy(*(F.desc(c) for c in STAMP)))).where("_rank = 1")
    whole = F.to_json(F.struct(*(c for c in records.columns if c not in key)))
    tied = first.withColumn("_tie", F.when(F.count("*").over(own) > 1, whole))
    return tied.withColumn("_place", F.row_number().over(own.orderBy(F.desc("_tie")))).where("_place = 1").select(records.columns)


def alive(records: DataFrame, tombs: DataFrame, key: list[str]) -> DataFrame:
    """Records whose stamp is greater than that of every tombstone of their key.

    Both are dealt out by the key once, and stay so for what follows by this key or a longer one.
    """
    dead = tombs.select(*key, *STAMP).withColumn("_dead", F.lit(True))
    both = records.withColumn("_dead", F.lit(False)).unionByName(dead, allowMissingColumns=True)
    last = F.max(F.when(F.col("_dead"), stamp())).over(Window.partitionBy(*key))
    return both.withColumn("_t", last).where(~F.col("_dead") & (F.col("_t").isNull() | (stamp() > F.col("_t")))).select(records.columns)


def merge_ledgers(*copies: DataFrame, tombs: DataFrame | None = None) -> DataFrame:
    """All copies (book_id, list, id, upd, ctr, dev, …) under tombstones (book_id, id, stamp), which have one shuffle together.

    What a tombstone covers goes first: if the greatest stamp of an id is covered, so are its others.
    """
    rows = copies[0]
    for c in copies[1:]:
        rows = rows.unionByName(c)
    return latest(rows if tombs is None else alive(rows, tombs, ["book_id", "id"]), KEY)


def merge_children(*copies: DataFrame, tombs: DataFrame, parents: DataFrame, fields: list[str]) -> DataFrame:
    """Nested entries (book_id, parent_id, id, date, stamp, …) merged as records of their own.

    Returns parents (book_id, id, …) with `children`, in date order; children of vanished parents go with them.
    """
    rows = copies[0]
    for c in copies[1:]:
        rows = rows.unionByName(c)
    live = latest(alive(rows, tombs, ["book_id", "id"]), ["book_id", "parent_id", "id"])
    grouped = live.groupBy("book_id", F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("date", F.col("id").alias("child_id"), *fields))).alias("children"))
    return parents.join(grouped, ["book_id", "id"], "left")


def merge_report(mine: DataFrame, theirs: DataFrame, merged: DataFrame, my_tombs: DataFrame) -> DataFrame:
    """(book_id, added, updated, revived): what the merge changed on my side."""
    m = merged.select(*KEY, stamp().alias("now"))
    own = mine.select(*KEY, stamp().alias("was"))
    dead = my_tombs.select("book_id", "id").distinct().withColumn("dead", F.lit(True))
    j = m.join(own, KEY, "left").join(dead, ["book_id", "id"], "left")
    new = F.col("was").isNull()
    return j.groupBy("book_id").agg(
        F.count_if(new & F.col("dead").isNull()).alias("added"), F.count_if(~new & (F.col("was") != F.col("now"))).alias("updated"), F.count_if(new & F.col("dead").isNotNull()).alias("revived")
    )


def edited_on_both(mine: DataFrame, theirs: DataFrame, last_sync: DataFrame) -> DataFrame:
    """(book_id, list, id): records that both sides changed, differently, since the last sync (book_id, since)."""
    j = mine.select(*KEY, stamp().alias("a")).join(theirs.select(*KEY, stamp().alias("b")), KEY).join(last_sync, "book_id")
    return j.where((F.col("a.upd") > F.col("since")) & (F.col("b.upd") > F.col("since")) & (F.col("a") != F.col("b"))).select(*KEY)


def ledger_digests(ledger: DataFrame, keys: list[str], bucket: str | None = None) -> DataFrame:
    """(keys…[, bucket], rows, sum, xor): the digest of each part of a ledger, and of each of DIGEST_BUCKETS buckets of a column in
    it. Sums are of hashes of whole rows, so the order of rows does not matter and repeated rows count."""
    row = F.xxhash64(F.to_json(F.struct(*ledger.columns), {"ignoreNullFields": "false"}))
    rows = ledger.withColumns({"_row": row, **({"bucket": F.pmod(F.xxhash64(bucket), F.lit(DIGEST_BUCKETS))} if bucket else {})})
    own = [*keys, *(["bucket"] if bucket else [])]
    return rows.groupBy(*own).agg(F.count("*").alias("rows"), F.sum(F.col("_row").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("_row")).alias("xor"))


def ledger_diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None, bucket: str | None = None) -> DataFrame:
    """Rows that only one of two ledgers has, with the side; repeated rows count.

    With keys, such as book_id and list, and a bucket column, such as id, digests of the parts are compared first; only rows of
    parts that differ are shuffled and compared themselves.
    """
    if keys:
        own = [*keys, *(["bucket"] if bucket else [])]
        x, y = (ledger_digests(side, keys, bucket).select(*(F.col(c).alias(f"{n}_{c}") for c in own), *(F.col(c).alias(f"{n}_{c}") for c in ("rows", "sum", "xor"))) for n, side in (("a", a), ("b", b)))
        met = x.join(y, [x[f"a_{c}"].eqNullSafe(y[f"b_{c}"]) for c in own], "full_outer")
        parts = met.where(~(F.struct("a_rows", "a_sum", "a_xor").eqNullSafe(F.struct("b_rows", "b_sum", "b_xor"))))
        parts = parts.select(*(F.when(F.col("a_rows").isNull(), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"_{c}") for c in own))

        def differing(side: DataFrame) -> DataFrame:
            place = {c: F.pmod(F.xxhash64(bucket), F.lit(DIGEST_BUCKETS)) if c == "bucket" and bucket else F.col(c) for c in own}
            rows = side.withColumns({f"__{c}": v for c, v in place.items()})
            return rows.join(parts, [rows[f"__{c}"].eqNullSafe(parts[f"_{c}"]) for c in own], "left_semi").select(side.columns)

        a, b = differing(a), differing(b)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def restore_settings(current: DataFrame, file: DataFrame) -> DataFrame:
    """Settings of a restored file with this device's id, and the later of both clocks (book_id, dev, ms, c)."""
    f = file.select("book_id", F.struct("ms", "c").alias("_f"))
    j = current.join(f, "book_id", "left").withColumn("_c", F.greatest(F.struct("ms", "c"), F.coalesce("_f", F.struct("ms", "c"))))
    return j.select("book_id", "dev", F.col("_c.ms").alias("ms"), F.col("_c.c").alias("c"))


def restore_lists(current: dict[str, DataFrame], file: dict[str, DataFrame], book_ids: DataFrame) -> dict[str, DataFrame]:
    """Every list with the restored books (book_id) replaced by what the file has of them; other books stay.

    A list that the file lacks becomes empty in those books: a restore is the file, not a merge with it.
    """
    books = book_ids.select("book_id").distinct()
    out = {}
    for name, own in current.items():
        rest = own.join(books, "book_id", "left_anti")
        out[name] = rest.unionByName(file[name].join(books, "book_id", "left_semi"), allowMissingColumns=True) if name in file else rest
    return out


# --- hybrid clocks ------------------------------------------------------------------------------------------


def absorb_clock(clocks: DataFrame, seen: DataFrame, now: int) -> DataFrame:
    """clocks ([book_id,] dev, ms, c) after seeing stamps of the same key: the latest time of own, seen and now, its counter
    and one more."""
    key = [c for c in ("book_id", "dev") if c in clocks.columns]
    top = seen.groupBy(*key).agg(F.max(F.struct("ms", "c")).alias("s"))
    j = clocks.join(top, key, "left")
    own, got, s_ms = F.col("ms"), F.col("s.c"), F.coalesce("s.ms", F.lit(-1))
    late = F.greatest(own, s_ms, F.lit(now))
    count = F.when((late == own) & (late == s_ms), F.greatest("c", got) + 1).when(late == own, F.col("c") + 1).when(late == s_ms, got + 1).otherwise(0)
    return j.select(*key, late.alias("ms"), count.alias("c"))


def next_stamps(clocks: DataFrame, n: int, now: int) -> DataFrame:
    """n stamps for each device; stamps of one millisecond count on."""
    late = F.greatest(F.col("ms"), F.lit(now))
    first = F.when(late == F.col("ms"), F.col("c") + 1).otherwise(0)
    return clocks.select(*(c for c in ("book_id", "dev") if c in clocks.columns), late.alias("ms"), F.explode(F.sequence(first, first + (n - 1))).alias("c"))
