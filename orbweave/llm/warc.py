"""WARC: reading records, and resolving not-modified revisits.

A revisit record of the server-not-modified kind has headers of a 304 response and no body. It is resolved by
an as-of join: among the full responses with the same canonical URL, the latest one captured before it. If
their validators agree (entity tags by weak comparison where both have one, otherwise the last-modified
dates), the revisit stands for that response's body, with its headers updated by those that a 304 may carry
(``MERGED``).

The join sorts all captures by range of (canonical URL, time), so a URL with any share of all captures is
spread over tasks; each task carries the latest full response along its rows, and what a task can't know - the
latest response before its first row - is carried over from summaries, one row a task; the driver sees those without
headers.

Edge cases: records without a URL or date never match; of full responses captured at the same time the
greater record id counts as later; a response captured at the same time as a revisit isn't earlier; a revisit
without a validator in common with the response is ``unchecked`` and one whose validator differs is
``changed``, neither of them resolved; without an earlier response it is ``missing``; repeated rows are
resolved each; a response without a record id resolves revisits, ``matched`` is null then; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.store import Written, ready

#: Headers of a 304 response that replace the stored response's.
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=.*)?$"
CAPTURES = "record_id string, kind string, url string, at timestamp, status int, headers map<string,string>, payload binary"

_ROW = "record_id string, url string, at timestamp, outcome string, matched string, headers map<string,string>, task int, first boolean"


def canonical(url: Column) -> Column:
    """Host without ``www``, userinfo and default port, path without final slashes, and the sorted parameters that aren't for tracking."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    wanted = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise(F.lit("")))


def _tag(x: str | None) -> str | None:
    return x[2:] if x and x[:2] in ("W/", "w/") else x


def outcome(mine: dict[str, str], theirs: dict[str, str]) -> str:
    """``resolved``, ``changed`` or ``unchecked``, by the validators of a revisit and a full response."""
    for name in ("etag", "last-modified"):
        a, b = mine.get(name), theirs.get(name)
        if a and b:
            return "resolved" if (_tag(a) == _tag(b) if name == "etag" else a == b) else "changed"
    return "unchecked"


def merged(mine: dict[str, str], theirs: dict[str, str]) -> dict[str, str]:
    return theirs | {k: v for k, v in mine.items() if k in MERGED}


def _named(headers: list[tuple[str, str]] | None) -> dict[str, str]:
    return {k.lower(): v for k, v in headers or [] if v is not None}


def resolve(captures: DataFrame) -> DataFrame:
    """(record_id, url, at, outcome, matched, headers) of each revisit in ``captures`` (record_id, kind, url, at, headers).

    ``kind`` is ``response`` or ``revisit``; ``url`` comes back canonical; ``matched`` is the record id of the
    full response that the revisit was held against, ``headers`` are the merged ones if it is resolved.
    Bodies aren't carried along: join ``matched`` to the responses for them.
    """
    spark = captures.sparkSession
    ready(spark)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = ["record_id", "url", "at", "outcome", "matched", "headers", "task", "first"]
        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("at", pa.timestamp("us", "UTC")), ("outcome", pa.string()), ("matched", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("task", pa.int32()), ("first", pa.bool_())])
        url, first_url, response, any_row = None, None, None, False
        for b in batches:
            out = []
            for record, kind, here, at, headers in zip(*(b.column(c).to_pylist() for c in ("record_id", "kind", "url", "at", "headers")), strict=True):
                if not any_row:
                    first_url, any_row = here, True
                if here != url:
                    url, response = here, None
                if kind == "response":
                    response = (record, headers)
                    continue
                if response is None:
                    out.append((record, here, at, "missing", None, headers, task, here == first_url))
                else:
                    mine, theirs = _named(headers), _named(response[1])
                    said = outcome(mine, theirs)
                    out.append((record, here, at, said, response[0], list(merged(mine, theirs).items()) if said == "resolved" else None, task, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names=names)
        if any_row:  # the summary: whether there is a response that later tasks may need, last and first URL, and that response
            row = ("held" if response else None, url, None, first_url, response[0] if response else None, response[1] if response else None, task, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], names=names)

    rows = captures.filter(F.col("url").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin("response", "revisit"))
    rows = rows.select("record_id", "kind", canonical(F.col("url")).alias("url"), "at", "headers").withColumn("later", F.col("kind") == "response")
    order = ["url", "at", "later", "record_id"]
    walked = Written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(along, _ROW), "walked").df
    ends = walked.filter("first is null")
    over: list[tuple] = []
    url, holder = None, None
    for s in ends.select("task", "url", "outcome", "record_id").orderBy("task").collect():  # a row a task, without headers
        if holder is not None and s["outcome"] == url:
            over.append((s["task"], url, holder))
        if s["record_id"] is not None:
            holder = s["task"]
        elif s["url"] != url or s["outcome"] != url:
            holder = None
        url = s["url"]
    held = ends.select(F.col("task").alias("holder"), F.col("matched").alias("over"), F.col("headers").alias("theirs"))
    carried = spark.createDataFrame(over, "task int, url string, holder int").join(held, "holder").withColumn("hit", F.lit(True)).drop("holder")

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, heads = [], []
            for hit, mine, theirs in zip(*(b.column(c).to_pylist() for c in ("hit", "headers", "theirs")), strict=True):
                a, z = _named(mine), _named(theirs)
                said.append(outcome(a, z) if hit else "missing")
                heads.append(list(merged(a, z).items()) if said[-1] == "resolved" else None)
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("url"), b.column("at"), pa.array(said, pa.string()), b.column("over"), pa.array(heads, pa.map_(pa.string(), pa.string()))], names=["record_id", "url", "at", "outcome", "matched", "headers"])

    columns = ["record_id", "url", "at", "outcome", "matched", "headers"]
    done = walked.filter("first = false").select(*columns[:-1], F.when(F.col("outcome") == "resolved", F.col("headers")).alias("headers"))
    # only revisits before a task's first response of its first URL wait for other tasks
    waiting = walked.filter("first").select("record_id", "url", "at", "headers", "task").join(carried, ["task", "url"], "left")
    resolved = done.unionByName(waiting.mapInArrow(late, "record_id string, url string, at timestamp, outcome string, matched string, headers map<string,string>"))
    rest = captures.filter((F.col("url").isNull() | F.col("at").isNull()) & (F.col("kind") == "revisit"))
    return resolved.unionByName(rest.select("record_id", canonical(F.col("url")).alias("url"), "at", F.lit("missing").alias("outcome"), F.lit(None).cast("string").alias("matched"), F.lit(None).cast("map<string,string>").alias("headers")))


#: Bytes read from a file at a time.
CHUNK = 1 << 20


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """What a stream holds, piece by piece; gzip members, if it has them, decompressed."""
    data = stream.read(CHUNK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(CHUNK)
        return
    inflate = zlib.decompressobj(31)
    while data:
        while data:
            yield inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
        data = stream.read(CHUNK)
    yield inflate.flush()


def _head(data: bytes, at: int) -> tuple[list[tuple[str, str]], int]:
    end = data.find(b"\r\n\r\n", at)
    end = len(data) if end < 0 else end
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], end + 4


def parse(stream: BinaryIO) -> Iterator[dict]:
    """Captures in a WARC file: its response and not-modified revisit records. Holds one record at a time."""
    pieces, held, over = inflated(stream), bytearray(), False

    def more() -> bool:
        nonlocal over
        piece = next(pieces, None)
        over = piece is None
        held.extend(piece or b"")
        return not over

    while True:
        while (at := held.find(b"WARC/1.")) < 0 and more():
            del held[: max(0, len(held) - CHUNK - 6)]
        if at < 0:
            return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        head, body = _head(bytes(held[: end + 4] if end >= 0 else held), held.find(b"\r\n") + 2)
        h = {k.lower(): v for k, v in head}
        size = int(h.get("content-length", 0))
        while len(held) < body + size and more():
            pass
        block = bytes(held[body : body + size])
        del held[: body + size]
        kind = h.get("warc-type")
        if kind not in ("response", "revisit") or (kind == "revisit" and "server-not-modified" not in h.get("warc-profile", "")):
            continue
        http, start = _head(block, 0)
        status = block.split(b"\r\n", 1)[0].split(b" ")
        yield {"record_id": h.get("warc-record-id"), "kind": kind, "url": h.get("warc-target-uri", "").strip("<>") or None, "date": h.get("warc-date"), "status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "headers": [(k.lower(), v) for k, v in http[1:]], "payload": block[start:] if kind == "response" else None}


def read(spark: SparkSession, path: str) -> DataFrame:
    """``CAPTURES`` of the WARC files at ``path``, compressed or not.

    Spark lists the files; a task streams each of its own through Arrow's file systems and holds one record and a batch
    of 256 captures, or of 4 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path))
                store, name = fs.FileSystem.from_uri(uri)
                held: list[dict] = []
                size = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for r in parse(stream):
                        r["headers"] = list(dict(r["headers"]).items())
                        held.append(r)
                        size += len(r["payload"] or b"")
                        if len(held) == 256 or size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    ready(spark)
    files = spark.read.format("binaryFile").load(path).select("path")
    raw = files.mapInArrow(run, "record_id string, kind string, url string, date string, status int, headers map<string,string>, payload binary")
    return raw.select("record_id", "kind", "url", F.try_to_timestamp("date").alias("at"), "status", "headers", "payload")


def record(kind: str, record_id: str, url: str, date: str, status: str, headers: dict[str, str], payload: bytes = b"") -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + payload
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n" if kind == "revisit" else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n{profile}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"
