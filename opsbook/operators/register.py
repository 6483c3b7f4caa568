"""Birthday register and ship's particulars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_register(birthdays: DataFrame, crew: DataFrame) -> DataFrame:
    """The register with crew of known birth date added; nobody is removed, and known people keep their old ship."""
    person = ["book_id", "name", "kind", "dob"]
    rows = crew.where("dob is not null").select("book_id", "id", "name", F.lit("ship").alias("kind"), "rank", "ship", "dob")
    once = rows.groupBy(person).agg(F.min_by(F.struct("id", "rank", "ship"), "id").alias("r")).select(*person, "r.*")
    new = once.join(birthdays.select(*person), person, "left_anti")
    return birthdays.unionByName(new.select(birthdays.columns))


def refile(birthdays: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (book_id, id, kind); family and friends have neither rank nor ship."""
    out = birthdays.join(changes.select("book_id", "id", F.col("kind").alias("_kind")), ["book_id", "id"], "left").withColumn("kind", F.coalesce("_kind", "kind"))
    own = F.col("kind") == "ship"
    return out.withColumns({"rank": F.when(own, F.col("rank")), "ship": F.when(own, F.col("ship"))}).select(birthdays.columns)


def birthday_label(df: DataFrame, rank_abbrev: DataFrame) -> DataFrame:
    """Ship: `<abbreviation> name (ship)`; others: `name (Family)`. A rank without abbreviation stands as it is."""
    named = df.join(rank_abbrev, "rank", "left")
    ship = F.concat(F.concat_ws(" ", F.coalesce("abbrev", "rank"), "name"), F.when(F.coalesce("ship", F.lit("")) != "", F.concat(F.lit(" ("), "ship", F.lit(")"))).otherwise(""))
    return named.withColumn("label", F.when(F.col("kind") == "ship", ship).otherwise(F.concat("name", F.lit(" ("), F.initcap("kind"), F.lit(")")))).drop("abbrev")


def parse_particulars(pasted: DataFrame, labels: list[str]) -> DataFrame:
    """(book_id, text) to one row per book: the quoted ship name, and the value after each known label of its line."""
    lines = pasted.select("book_id", "text", F.explode(F.split("text", r"\r?\n")).alias("line"))
    found = lines.select("book_id", F.coalesce(*(F.when(F.lower(F.trim("line")).startswith(x.lower()), x) for x in labels)).alias("label"), "line").where("label is not null")
    value = F.trim(F.regexp_replace(F.expr("substring(trim(line), length(label) + 1)"), r"^\s*[:\-]?\s*", ""))
    wide = found.withColumn("value", value).groupBy("book_id").pivot("label", labels).agg(F.first("value", ignorenulls=True))
    names = pasted.select("book_id", F.nullif(F.regexp_extract("text", '"([^"\n]+)"', 1), F.lit("")).alias("ship_name"))
    return names.join(wide, "book_id", "left")
