"""JSON documents of large files, read by splits.

A file holds documents one after another, each over any number of lines. Where one ends depends on how deep the braces are
nested and on whether a text is open. Of a run of lines that is known only from where it begins, so a run maps
each of the two states, outside and inside a text, to one, with a change of depth and the least depth on the way.
Splits are mapped on their own, the maps are composed file by file, and then every split knows how it begins. A document
that begins in one split and ends in another is put together from the pieces of both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import by_split, lines_of
from .store import keep

TEXT = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+("|\Z|\\\Z)', re.DOTALL)  # the rest of a text, and its quote if that is here
MARK = re.compile(r'["{}\[\]]')
OPEN, CLOSE = "{[", "}]"


def scan(line: str, inside: bool, depth: int, floor: bool = True) -> tuple[bool, int, int, list[int]]:
    """(inside, depth) after the line, the least depth in it, and the places after braces at which depth 0 is reached.

    With floor, braces that close nothing count for nothing.

    A text does not span lines in JSON, but a run of lines that begins inside one is scanned as if it did, since that is
    what a map needs; a backslash takes the character after it along.
    """
    at, least, ends = 0, depth, []
    while True:
        if inside:
            m = TEXT.match(line, at)
            at = m.end()
            if m[1] != '"':
                return True, depth, least, ends
            inside = False
        m = MARK.search(line, at)
        if not m:
            return False, depth, least, ends
        at = m.end()
        if m[0] == '"':
            inside = True
        elif m[0] in OPEN:
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                ends.append(at)
            elif floor and depth < 0:
                depth = 0
            least = min(least, depth)


MAP = "source string, block long, text0 boolean, depth0 long, least0 long, text1 boolean, depth1 long, least1 long"


def split_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of MAP for each split: how it ends if it begins outside (0) or inside (1) a text, at depth 0."""
    at, state = None, []
    for key, rows in by_split(batches):
        if key != at:
            if at:
                yield pd.DataFrame([(*at, *state[0], *state[1])], columns=[c.split()[0] for c in MAP.split(", ")])
            at, state = key, [[False, 0, 0], [True, 0, 0]]
        for line in rows["value"]:
            for own in state:
                own[0], own[1], low, _ = scan(line, own[0], own[1], floor=False)
                own[2] = min(own[2], low)
    if at:
        yield pd.DataFrame([(*at, *state[0], *state[1])], columns=[c.split()[0] for c in MAP.split(", ")])


def compose(maps: DataFrame) -> DataFrame:
    """(source, block, inside, depth, owner): how each split begins, and the split in which the document open there began."""
    step = """aggregate(sort_array(collect_list(struct(block, text0, depth0, least0, text1, depth1, least1))),
      named_struct('inside', false, 'depth', 0L, 'owner', -1L, 'out', CAST(array() AS array<struct<block: bigint, inside: boolean, depth: bigint, owner: bigint>>)),
      (s, m) -> named_struct('inside', IF(s.inside, m.text1, m.text0), 'depth', s.depth + IF(s.inside, m.depth1, m.depth0) - least(0L, s.depth + IF(s.inside, m.least1, m.least0)),
        'owner', IF(s.depth > 0 AND s.depth + IF(s.inside, m.least1, m.least0) > 0, s.owner, m.block),
        'out', concat(s.out, array(named_struct('block', m.block, 'inside', s.inside, 'depth', s.depth, 'owner', s.owner)))), s -> s.out)"""
    return maps.groupBy("source").agg(F.expr(step).alias("s")).select("source", F.inline("s"))


PARSED = "source string, block long, owner long, whole boolean, text string"


def cut_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of PARSED: a split's whole documents, and its pieces of documents of several splits."""
    at, inside, depth, owner, held, head = None, False, 0, -1, [], False
    out: list[tuple] = []

    def piece() -> None:
        text = "\n".join(held)
        if text.strip():
            out.append((*at, owner if head else at[1], False, text))

    for key, rows in by_split(batches):
        if key != at:
            if at:
                piece()
            at, held = key, []
            inside, depth, owner = bool(rows["inside"].iloc[0]), int(rows["depth"].iloc[0]), int(rows["owner"].iloc[0])
            head = depth > 0
        for line in rows["value"]:
            inside, depth, _, ends = scan(line, inside, depth)
            begun = 0
            for e in ends:
                held.append(line[begun:e])
                if head:
                    piece()
                    head = False
                else:
                    out.append((*at, at[1], True, "\n".join(held)))
                held, begun = [], e
            if line[begun:].strip() or held:
                held.append(line[begun:])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])
            out = []
    if at:
        piece()
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, block, document): every JSON document of the files at path, over one line or many, several to a line too.

    What stands between documents is part of the next one, and what a file ends with is a document of its own, so that
    rubbish is handed on to whoever parses it.
    """
    lines = lines_of(spark, path)
    maps = keep(lines.where("length < size").select("source", "block", "value").mapInPandas(split_maps, MAP), "document-maps")
    columns = ["source", "block", "inside", "depth", "owner", "value"]
    if maps.isEmpty():
        begun = lines.withColumns({"inside": F.lit(False), "depth": F.lit(0).cast("long"), "owner": F.lit(-1).cast("long")})
        return begun.select(columns).mapInPandas(cut_documents, PARSED).select("source", "block", F.col("text").alias("document"))
    starts = keep(compose(maps), "document-starts")
    numbered = lines.withColumn("line", F.monotonically_increasing_id()).join(starts, ["source", "block"], "left")
    begun = numbered.withColumns({"inside": F.coalesce("inside", F.lit(False)), "depth": F.coalesce("depth", F.lit(0).cast("long")), "owner": F.coalesce("owner", F.lit(-1).cast("long"))})
    begun = begun.sortWithinPartitions("source", "block", "line")
    whole = begun.select(columns).mapInPandas(cut_documents, PARSED).where("whole").select("source", "block", F.col("text").alias("document"))
    pieces = begun.where("length < size").select(columns).mapInPandas(cut_documents, PARSED).where("not whole")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    return whole.unionByName(pieces.groupBy("source", F.col("owner").alias("block")).agg(text.alias("document")))
