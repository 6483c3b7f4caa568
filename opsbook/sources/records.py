"""Records of quoted text sheets (CSV), read by splits.

A line of a sheet either ends a record or leaves a quoted field open, and which of the two depends on whether it began
inside one. So a line, and a run of lines, maps each of the two states to one. Splits of large files are mapped on their
own, their maps are composed file by file, and then every split knows in which state it begins. A record that begins in one
split and ends in another is put together from the pieces of both.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep

REST = r'[^"]*+(?:""[^"]*+)*+'  # of a quoted field
OPENS = re.compile(rf'(?:(?:"{REST}"[^,\r]*+|(?!")[^,\r]*+)[,\r])*+"{REST}\Z')
STAYS = re.compile(rf"{REST}\Z")
CLOSES = re.compile(rf'{REST}"[^,\r]*+(?:[,\r]|\Z)')
LAST = 1 << 40  # place of a record that is put together, after those that its split holds whole


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line, if one is before it or not.

    A quote opens a field only as its first character, two in a quoted field are one, and what follows the closing quote up
    to the next comma is text, as in Python's csv.
    """
    if '"' not in line:
        return inside
    if inside:
        if STAYS.match(line):
            return True
        line = line[CLOSES.match(line).end() :]
    return OPENS.match(line) is not None


def by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """((source, block), rows) of consecutive rows of one split; a split may come in several."""
    for b in batches:
        if len(b):
            change = (b["source"] != b["source"].shift()) | (b["block"] != b["block"].shift())
            for _, rows in b.groupby(change.cumsum(), sort=False):
                yield (rows["source"].iloc[0], int(rows["block"].iloc[0])), rows


def split_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, block, from_outside, from_inside, closes): whether the split ends inside a field from either state, and
    whether a line of it ends outside if it begins inside."""
    at, state = None, [False, True, False]
    for key, rows in by_split(batches):
        if key != at:
            if at:
                yield pd.DataFrame([(*at, *state)], columns=["source", "block", "from_outside", "from_inside", "closes"])
            at, state = key, [False, True, False]
        for line in rows["value"]:
            state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
            state[2] |= not state[1]
    if at:
        yield pd.DataFrame([(*at, *state)], columns=["source", "block", "from_outside", "from_inside", "closes"])


def compose(maps: DataFrame) -> DataFrame:
    """(source, block, opens, owner): how each split of a file begins, and the split in which the record open there began."""
    step = """aggregate(sort_array(collect_list(struct(block, from_outside, from_inside, closes))),
      named_struct('inside', false, 'owner', -1L, 'out', CAST(array() AS array<struct<block: bigint, opens: boolean, owner: bigint>>)),
      (s, m) -> named_struct('inside', IF(s.inside, m.from_inside, m.from_outside), 'owner', IF(s.inside AND NOT m.closes, s.owner, m.block),
                             'out', concat(s.out, array(named_struct('block', m.block, 'opens', s.inside, 'owner', s.owner)))), s -> s.out)"""
    return maps.groupBy("source").agg(F.expr(step).alias("s")).select("source", F.inline("s"))


def cells_of(text: str) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def parse_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(source, block, n, cells, owner, text): a split's whole records, and as text its pieces of records of several splits."""
    at, n, inside, head, held = None, 0, False, False, []

    def piece(owner: int) -> tuple:
        return (*at, None, None, owner, "\n".join(held))

    out: list[tuple] = []
    for key, rows in by_split(batches):
        if key != at:
            if held:
                out.append(piece(owner if head else at[1]))
            at, n, held = key, 0, []
            inside = head = bool(rows["opens"].iloc[0])
            owner = int(rows["owner"].iloc[0]) if head else -1
        done: list[str] = []
        for line in rows["value"]:
            inside = ends_inside(line, inside)
            held.append(line)
            if not inside:
                if head:
                    out.append(piece(owner))
                    head = False
                else:
                    done += held
                held = []
        for cells in cells_of("\n".join([*done, ""])):
            out.append((*at, n, cells, None, None))
            n += 1
        if out:
            yield pd.DataFrame(out, columns=["source", "block", "n", "cells", "owner", "text"])
            out = []
    if held:
        yield pd.DataFrame([piece(owner if head else at[1])], columns=["source", "block", "n", "cells", "owner", "text"])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, source, block, length, size): lines of the files at path in their order, with the split that each is from."""
    meta = {"source": "file_path", "block": "file_block_start", "length": "file_block_length", "size": "file_size"}
    return spark.read.option("lineSep", "\n").text(path).select("value", *(F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, n, cells) of every record of the sheets at path; (block, n) orders the records of a file.

    Blank lines are no records. A field left open at the end of a file ends there. Fields may hold line breaks, commas and
    doubled quotes, and records any number of fields, each file its own.
    """
    lines = lines_of(spark, path)
    parts = lines.where("length < size")
    maps = keep(parts.select("source", "block", "value").mapInPandas(split_maps, "source string, block long, from_outside boolean, from_inside boolean, closes boolean"), "split-maps")
    begun = lines.withColumns({"opens": F.lit(False), "owner": F.lit(-1).cast("long")})
    parsed = "source string, block long, n long, cells array<string>, owner long, text string"
    columns = ["source", "block", "opens", "owner", "value"]
    if maps.isEmpty():
        return begun.select(columns).mapInPandas(parse_splits, parsed).select("source", "block", "n", "cells")
    starts = keep(compose(maps), "split-starts")
    numbered = lines.withColumn("line", F.monotonically_increasing_id()).join(starts, ["source", "block"], "left")
    begun = numbered.withColumns({"opens": F.coalesce("opens", F.lit(False)), "owner": F.coalesce("owner", F.lit(-1))})
    begun = begun.sortWithinPartitions("source", "block", "line")
    whole = begun.select(columns).mapInPandas(parse_splits, parsed).where("text is null").select("source", "block", "n", "cells")
    pieces = begun.where("length < size").select(columns).mapInPandas(parse_splits, parsed).where("text is not null")
    texts = pieces.groupBy("source", F.col("owner").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))

    def divided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k, LAST + n, cells) for s, k, t in zip(b["source"], b["block"], b["text"]) for n, cells in enumerate(cells_of(t))]
            yield pd.DataFrame(rows, columns=["source", "block", "n", "cells"])

    return whole.unionByName(texts.mapInPandas(divided, "source string, block long, n long, cells array<string>"))


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """(source, names, cells) of every record but the first of each file, which holds the names."""
    rows = read_records(spark, path).withColumn("at", F.struct("block", "n"))
    heads = rows.groupBy("source").agg(F.min("at").alias("first"), F.min_by("cells", "at").alias("names"))
    heads = heads.withColumn("names", F.transform("names", lambda x: F.trim(F.replace(x, F.lit("﻿"), F.lit("")))))
    return rows.join(heads, "source").where("at > first").select("source", "names", "cells")
