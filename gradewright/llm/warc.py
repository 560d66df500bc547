"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writer: one record a page; of equal payloads of REVISIT bytes or more, the page with the largest id is a response and
the others revisit it. A record is text (headers and HTML in UTF-8) and the writer's line separator is the CRLF CRLF
that ends a record, so the files are plain WARC; by default they are compressed whole with gzip, a standard codec of
the writer.

Reader: files come as lines, a plain file in byte ranges of Spark's own choice and a gzip file in one; no task holds
more than a record. A task looks for a header at every line and emits candidate -> successor offsets, of which all but
the last of its range are jumped over in place. A payload may hold the same bytes, so candidates prove nothing; pointer
jumping from offset 0 of each file, over the ranges, keeps those on the chain. The ranges are then read again from
their proven entries, and records that cross ranges are put together. A chain that does not end with its file is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_limit, materialize, new_path, skew_join, text_or_empty
from .exact_dedup import with_uid

REVISIT = 1000
#: Records a file at most, so that many tasks share the work; a reader's memory does not depend on it.
FILE_RECORDS = 4000
#: Byte ranges whose entries are broadcast at a time (some 200 bytes each); more are read in as many passes over their own files.
MAX_RANGES = 50_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = re.compile(rb"^WARC/1\.[01]\r\n", re.MULTILINE)
_FIELD = re.compile(rb"([^:\n]*):([^\n]*)\r\n")


def records(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> value, a record without its closing CRLF CRLF.

    A null html counts as empty and a null url as about:blank; a null page_id is read back as null. Of repeated rows one
    is the response. Payloads are equal where length and SHA-256 are. An empty table gives no record.
    """
    p = with_uid(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html")))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.col("bytes") >= REVISIT
    # small payloads are groups of their own
    p = p.withColumn("key", F.when(large, F.concat_ws(":", F.col("bytes").cast("string"), F.sha2("html", 256))).otherwise(F.concat(F.lit("-"), F.col("uid").cast("string"))))
    groups = p.groupBy("key").agg(F.max(F.struct("page_id", "uid")).alias("first"), F.count("*").alias("n"))
    p = skew_join(p, groups, ["key"], "n", hot_limit(pages.count()), "uid")
    # a page without id is no revisit, as in SQL; first.page_id is null only where all of the group are such pages
    response = (F.col("first.uid") == F.col("uid")) | F.col("page_id").isNull()
    http = F.when(response, F.concat(F.lit(HTTP), F.col("html"))).otherwise(F.lit(HTTP))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    kind = F.when(response, "response").otherwise("revisit")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", urn(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(~response, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.coalesce(F.col("first.page_id").cast("string"), F.lit("null")))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(http).cast("string")), F.lit("\r\n"))
    return p.select(F.concat(head, http).alias("value"))


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of `records` under path, FILE_RECORDS records a file at most; compression is a codec of the text writer, or none."""
    records(pages).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def header(content: bytes | bytearray, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """The fields of the header whose version line is at `at`, and its end (0: it goes on behind content); None where a line is no field."""
    fields: dict[bytes, bytes] = {}
    at = content.index(b"\n", at) + 1
    while True:
        if content.startswith(b"\r\n", at):
            return fields, at + 2
        m = _FIELD.match(content, at)
        if not m:
            return None if content.find(b"\n", at) >= 0 else (fields, 0)
        fields[m[1].strip().lower()] = m[2].strip()
        at = m.end()


def record_bytes(found: tuple[dict[bytes, bytes], int], start: int) -> int:
    """Bytes of a record with its closing CRLF CRLF; -1 without a length."""
    length = found[0].get(b"content-length", b"")
    return found[1] - start + int(length) + 4 if length.isdigit() else -1


def _number(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def parsed(record: bytes) -> tuple:
    """(type, page, refers to, payload bytes, payload digest) of a whole record."""
    fields, at = header(record, 0)
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    if kind == "response":
        start = record.find(b"\r\n\r\n", at, len(record) - 4)
        payload = memoryview(record)[start + 4 if start >= 0 else at : len(record) - 4]
        size, sha = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(fields[b"x-payload-length"]) if fields.get(b"x-payload-length", b"").isdigit() else 0
        sha = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:").lower()
    return kind, _number(fields.get(b"warc-record-id")), _number(fields.get(b"warc-refers-to")), size, sha


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """(the other columns, whole lines) for each run of lines of one byte range; a range's runs follow one another."""
    for b in batches:
        if not b.num_rows:
            continue
        file = b.column(0).dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (np.diff(b.column(1).to_numpy()) != 0), True]).tolist()
        for i, j in zip(cuts, cuts[1:]):
            yield {n: b.column(n)[i].as_py() for n in b.schema.names if n != "line"}, b"\n".join(b.column("line").slice(i, j - i).to_pylist()) + b"\n"


def last_of_chain(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """For each of the sorted, distinct offsets, where its chain leaves them: pointer jumping, in log2 steps."""
    n = len(offset)
    at = np.minimum(np.searchsorted(offset, successor), max(n - 1, 0))
    to = np.where(offset[at] == successor, at, np.arange(n)) if n else at
    for _ in range(max(1, n).bit_length()):
        to = to[to]
    return successor[to]


_EDGES = "file string, block long, at long, exit long, total long, head binary, open binary"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each byte range: its candidates and where their chains leave it (relative to its first line), and one row with
    its bytes, the fields before its first other line, and a header that goes on behind it."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("exit", pa.int64()), ("total", pa.int64()), ("head", pa.binary()), ("open", pa.binary())])
    key, at, head, rest, found = None, 0, b"", b"", []

    def done() -> pa.RecordBatch:
        offset, successor = np.array(found, np.int64).reshape(-1, 2).T
        n = len(offset)
        return pa.record_batch([pa.array([key[0]] * (n + 1)), pa.array([key[1]] * (n + 1), pa.int64()), pa.array([*offset.tolist(), None], pa.int64()), pa.array([*last_of_chain(offset, successor).tolist(), None], pa.int64()),
                                pa.array([None] * n + [at], pa.int64()), pa.array([None] * n + [head], pa.binary()), pa.array([None] * n + [rest], pa.binary())], schema=schema)

    for run, lines in _runs(batches):
        if (run["file"], run["block"]) != key:
            if key:
                yield done()
            key, at, head, rest, found, leading = (run["file"], run["block"]), 0, b"", b"", [], True
        if leading:
            stop = 0
            while (m := _FIELD.match(lines, stop)):
                stop = m.end()
            leading = stop == len(lines)
            head += lines[: stop if leading else lines.index(b"\n", stop) + 1]
        begin = at - len(rest)
        at += len(lines)
        lines, rest = rest + lines, b""
        for m in _MAGIC.finditer(lines):
            h = header(lines, m.start())
            if h and not h[1]:
                rest = lines[m.start():]
                break
            size = record_bytes(h, m.start()) if h else -1
            if size >= 0:
                found.append((begin + m.start(), begin + m.start() + size))
    if key:
        yield done()


_RANGES = "file string, block long, base long, total long, size long, at long, exit long"


def _ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """The byte ranges of one file in order: where each begins, the file's size, and the candidate whose header crosses the range's end."""
    rows = rows.sort_values("block", ignore_index=True)
    rows["base"] = rows["total"].cumsum() - rows["total"]
    rows["size"] = rows["total"].sum()
    rows["at"], rows["exit"] = pd.array([pd.NA] * len(rows), "Int64"), pd.array([pd.NA] * len(rows), "Int64")
    for i, text in enumerate(rows["open"]):
        if not text:
            continue
        h, k = None, i + 1
        while k < len(rows):
            text, k = text + rows["head"][k], k + 1
            h = header(text, 0)
            if h is None or h[1]:
                break
        size = record_bytes(h, 0) if h and h[1] else -1
        if size >= 0:
            start = int(rows["base"][i] + rows["total"][i] - len(rows["open"][i]))
            rows.loc[i, ["at", "exit"]] = [start, start + size]
    return rows[["file", "block", "base", "total", "size", "at", "exit"]]


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where its byte range begins), line, in the order of the files."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def entries(lines: DataFrame) -> DataFrame:
    """file, block, base, total, size, entry (the first proven record that begins in the range, or null), next (the first one at
    its begin or later, else size), after (the first one behind it, else size); a written table."""
    found = materialize(lines.mapInArrow(_edges, _EDGES), "warc-candidates")
    ranges = found.filter("total is not null").select("file", "block", "total", "head", "open")
    ranges = materialize(ranges.groupBy("file").applyInPandas(_ranges, _RANGES), "warc-ranges")  # a row a range, not a record
    inside = found.filter("at is not null").select("file", "block", "at", "exit").join(ranges.select("file", "block", "base"), ["file", "block"])
    nodes = inside.select("file", "block", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("exit")).alias("exit"))
    nodes = materialize(nodes.unionByName(ranges.filter("at is not null").select("file", "block", "at", "exit")), "warc-nodes")
    most = ranges.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = nodes.filter("at = 0").select("file", "at")
    jump = nodes.select("file", "at", "exit")
    # a chain passes at most two nodes a range: its entry and the record whose header crosses its end
    for _ in range((2 * most).bit_length() if most > 1 else 0):
        step = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = materialize(reached.unionByName(step).distinct(), "warc-reached")
        further = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("beyond"))
        jump = materialize(jump.join(further, ["file", "exit"], "left").select("file", "at", F.coalesce("beyond", "exit").alias("exit")), "warc-jumps")
    chain = nodes.join(reached, ["file", "at"])
    ends = ranges.groupBy("file").agg(F.max("size").alias("size")).join(chain.groupBy("file").agg(F.max("exit").alias("end")), "file", "left")
    bad = ends.filter("size > 0 and (end is null or end <> size)").orderBy("file").limit(5).collect()
    if bad:
        said = (f"{r.file}: records end at byte {r.end} of {r.size}" if r.end is not None else f"{r.file}: no record at its start" for r in bad)
        raise ValueError("; ".join(said))
    own = ranges.drop("at", "exit").join(chain.groupBy("file", "block").agg(F.min("at").alias("entry")), ["file", "block"], "left")
    w = Window.partitionBy("file").orderBy("block")  # a row a range
    later = lambda a: F.coalesce(F.first("entry", ignorenulls=True).over(w.rowsBetween(a, Window.unboundedFollowing)), F.col("size"))
    return materialize(own.withColumn("next", later(0)).withColumn("after", later(1)), "warc-entries")


_RECORD = "file string, offset long, successor long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"
_FIELDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("successor", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("part", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of each byte range, and as `part` the bytes of those that cross its ends, at their offset and with the record's successor."""

    def rows(some: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), _FIELDS)], schema=_FIELDS)

    key, at, held, run = None, 0, bytearray(), {}
    for now, lines in _runs(batches):
        if (now["file"], now["block"]) != key:
            if held:
                yield rows([(run["file"], at, run["after"], *(None,) * 5, bytes(held))])
            key, run, at, held = (now["file"], now["block"]), now, now["base"], bytearray()
        if run["entry"] is None or at < run["entry"]:
            lead = lines if run["entry"] is None else lines[: run["entry"] - at]
            yield rows([(run["file"], at, run["next"], *(None,) * 5, lead)])
            at += len(lead)
            lines = lines[len(lead):]
        held += lines
        out, start = [], 0
        while start < len(held):
            h = header(held, start)
            size = record_bytes(h, start) if h[1] else -1
            if size < 0 or start + size > len(held):
                break
            out.append((run["file"], at, at + size, *parsed(bytes(held[start : start + size])), None))
            at, start = at + size, start + size
        if out:
            del held[:start]
            yield rows(out)
    if held:
        yield rows([(run["file"], at, run["after"], *(None,) * 5, bytes(held))])


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("offset")
    record = b"".join(parts["part"])
    row = (parts["file"].iloc[0], int(parts["offset"].iloc[0]), int(parts["successor"].iloc[0]), *parsed(record))
    return pd.DataFrame([row], columns=_FIELDS.names[:-1]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path, plain or gzip (one member or many), of any writer: file, offset and
    successor in the uncompressed file, record_type, page_id and refers_to (null where an id is not of this writer),
    payload_bytes and payload_digest. Empty files and folders give none; a broken or cut archive is an error.
    """
    lines = lines_of(spark, path)
    found = entries(lines)
    ranges, files = found.agg(F.count("*"), F.countDistinct("file")).first()
    passes = -(-ranges // MAX_RANGES) or 1
    out = None
    for k in range(passes):
        mine = lambda d: d.filter(F.pmod(F.xxhash64("file"), F.lit(passes)) == k) if passes > 1 else d  # noqa: E731, B023
        own = F.broadcast(mine(found).select("file", "block", "base", "entry", "next", "after"))  # MAX_RANGES rows or so
        part = mine(lines).join(own, ["file", "block"]).select("file", "block", "base", "entry", "next", "after", "line").mapInArrow(_records, f"{_RECORD}, part binary")
        out = part if out is None else out.unionByName(part)
    if ranges == files:  # no record crosses a range
        return out.drop("part")
    out = materialize(out, "warc-records")
    crossing = out.filter("part is not null").groupBy("file", "successor").applyInPandas(lambda p: _joined(p), _RECORD)
    return out.filter("part is null").drop("part").unionByName(crossing)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP6 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, payload_digest, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT} AND page_id < top THEN top END AS refers_to
FROM g
"""
