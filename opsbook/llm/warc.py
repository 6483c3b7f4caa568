"""WARC records in ZIP archives: written with stored members, read by ranges through the ZIP directories.

An archive has one member data.warc.gz (each record a gzip member) and one member index.jsonl (a line per
record with its place in data.warc.gz). Both are stored, not deflated, so a record's place in the archive is the
member's place plus its own, and a reader needs the directories, the index and the records it wants.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, file_folder, open_store, write_file

ARCHIVE_BYTES = 16 << 20  # of payload, after which an archive is closed
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = "2024-01-01T00:00:00Z"
Read = Callable[[int, int], bytes]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, sha1: str) -> bytes:
    """A response with the payload, or a revisit with headers alone."""
    kind = "response" if refers_to is None else "revisit"
    name = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in uri or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {name}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    return ("\r\n".join([*head, f"Content-Length: {len(payload)}"]) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) < size:
        raise ValueError("truncated WARC record")
    return fields, rest[:size]


# --- ZIP directories ----------------------------------------------------------------------------------------


def members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """(first byte, length) of each stored member, from the central directory (ZIP64 too) and local headers."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("not a ZIP archive")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        end = read(place, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory end where its locator points")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        local, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + n
        if method == 0:
            head = read(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no local header where the directory points")
            a, b = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + a + b, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def archive_records(read: Read, size: int, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, by its index; records that lie together are read together."""
    found = members(read, size)
    first, length = found[INDEX]
    places = [json.loads(line) for line in read(first, length).decode().splitlines()]
    base = found[DATA][0]
    k = 0
    while k < len(places):
        end = k + 1
        while end < len(places) and places[end]["offset"] + places[end]["length"] - places[k]["offset"] <= chunk and places[end]["offset"] == places[end - 1]["offset"] + places[end - 1]["length"]:
            end += 1
        start = places[k]["offset"]
        data = read(base + start, places[end - 1]["offset"] + places[end - 1]["length"] - start)
        for p in places[k:end]:
            yield parse_record(gzip.decompress(data[p["offset"] - start : p["offset"] - start + p["length"]]))
        k = end


def build_archive(records: list[tuple[int | None, bytes]]) -> bytes:
    data, lines, at = [], [], 0
    for page_id, raw in records:
        packed = gzip.compress(raw, 3, mtime=0)
        data.append(packed)
        lines.append(json.dumps({"page_id": page_id, "offset": at, "length": len(packed)}))
        at += len(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipfile.ZipInfo(DATA), b"".join(data))
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines))
    return out.getvalue()


# --- pages --------------------------------------------------------------------------------------------------


def with_targets(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with __sha1 and __target: the largest page_id of equal payloads, null for that one itself.

    Payloads shorter than least_bytes are never revisits. The largest id is combined before the shuffle. Where
    repeated digests are many, the join moves each payload once, by digest, and adaptive execution splits a hot one.
    """
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    lead = keys.groupBy("sha1").agg(F.max("page_id").alias("lead"), F.count("*").alias("copies")).where("copies > 1 and lead is not null")
    return pages.withColumn("sha1", F.sha1("payload")).join(lead.select("sha1", "lead"), "sha1", "left").withColumn(
        "target", F.when(F.octet_length("payload") >= least_bytes, F.when(~F.col("lead").eqNullSafe(F.col("page_id")), F.col("lead")))
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every page as a record; returns the manifest (uri, bytes, records) of the archives that count."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pd.DataFrame:
            uri, data = f"{folder}/{task:06d}-{number:04d}-{uuid.uuid4().hex}.zip", build_archive(held)
            write_file(uri, [data])
            return pd.DataFrame({"uri": [uri], "bytes": [len(data)], "records": [len(held)]})

        for b in batches:
            for i, url, payload, target in zip(b["page_id"], b["url"], b["payload"], b["target"]):
                i, target = (None if pd.isna(x) else int(x) for x in (i, target))
                held.append((i, record(i, url, payload, target, digest(payload))))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    dealt = with_targets(own, least_bytes).select("page_id", "url", "payload", "target")
    return cut(dealt.mapInPandas(run, "uri string, bytes long, records long"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record, an archive to a task.

    A revisit's size and digest are those of the full payload, from its headers; a response's come from its
    payload, and its headers must agree.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def page(text: str) -> int | None:
            return int(text[10:-1]) if len(text) > 11 else None

        for b in batches:
            for uri, size in zip(b["uri"], b["bytes"]):
                store, path = open_store(uri)
                out = []
                with store.open_input_file(path) as f:
                    for head, payload in archive_records(lambda at, n, f=f: f.read_at(n, at), int(size)):
                        sha1, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response" and (digest(payload), len(payload)) != (sha1, n):
                            raise ValueError(f"damaged payload in {uri}")
                        out.append((page(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, sha1, head["WARC-Type"], page(head.get("WARC-Refers-To", "")), payload))
                frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each reads its share of the archives, one after another
    return manifest.select("uri", "bytes").repartition(tasks).mapInPandas(run, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and describe each record as read back.

    A null html is an empty payload. Among rows of equal payload the largest page_id is the response; rows that
    repeat that page_id are responses too. A null page_id is a revisit where its payload has an id. An empty table gives no
    rows.
    """
    made = write_archives(pages, file_folder(pages.sparkSession, "warc"), least_bytes)
    return read_archives(made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
