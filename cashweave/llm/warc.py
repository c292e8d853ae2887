"""WARC archives with an index written first and read back by coalesced byte ranges.

Records are gzip members of their own, so each can be fetched by offset and length. Writing a
shard yields the index rows of its records; the index is a Parquet table beside the shards.
Reading takes index rows, sorts them by file and offset, joins near neighbours to one
range request and cuts the records out of it. Pages with equal payloads share one response
record; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashweave.llm.common import pick, read_ranges, write_once

#: Payloads below this many bytes are stored again instead of referred to.
REVISIT_BYTES = 0
#: Ranges up to this far apart are read together, up to so many bytes at once.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
#: Bytes of archives a reading task gets, and tasks at most (then each gets more).
TASK_BYTES, MOST_TASKS = 16 << 20, 100_000
#: Date written in every record, so that reruns give equal bytes.
WRITTEN = "2024-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL_SAFE = ":/?#[]@!$&'()*+,;=%-._~"

INDEX = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("record_type", T.StringType())])

RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("target_uri", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(urn: str | None):
    text = (urn or "")[len("<urn:page:"):-1]
    return int(text) if text else None


def record(page_id, url, payload: bytes | None, n_bytes: int, digest: str, refers_to) -> bytes:
    """One uncompressed record; without ``payload`` a revisit whose HTTP head still tells the length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    uri = urllib.parse.quote(url, safe=URL_SAFE) if url else _urn(page_id)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}",
            f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {WRITTEN}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    own = zlib.compressobj(1, zlib.DEFLATED, 31)
    return own.compress(data) + own.flush()


def parse(data: bytes) -> dict:
    """The fields of a record; a response's payload is digested anew and must match its head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": _id(fields["WARC-Record-ID"]), "target_uri": fields["WARC-Target-URI"], "record_type": kind,
            "refers_to": _id(fields.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least: int = REVISIT_BYTES) -> DataFrame:
    """Write one record for each page below ``path`` and return the stored index.

    Payloads are the pages' HTML in UTF-8, NULL as empty. Among equal payloads of ``least`` bytes or
    more the largest ``key`` is the response and the others revisit it; a NULL key is smaller than any
    and rows that repeat the largest key are responses all. A NULL URL becomes a URN of the key. An
    empty table writes an empty index; other columns are ignored. Digests are compared first, in
    narrow rows; HTML moves once, to the task that writes it.
    """
    spark = pages.sparkSession
    rows = pick(pages, key, url, html).select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(html, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    narrow = rows.select("page_id", "sha", F.octet_length("payload").alias("n")).distinct()
    latest = narrow.filter(F.col("n") >= least).groupBy("sha").agg(
        F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    revisits = narrow.join(latest, "sha").filter(
        F.coalesce(F.col("page_id") < F.col("response_id"), F.col("response_id").isNotNull())).select(
        F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "response_id")
    typed = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    typed = typed.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n"), "response_id",
                         F.when(F.col("_sha").isNull(), F.col("payload")).alias("payload"))

    def run(batches):
        name, out, at = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            found = []
            for page_id, link, sha, n, response_id, payload in zip(
                    *(batch.column(i).to_pylist() for i in range(6)), strict=True):
                digest = base64.b32encode(sha).decode()
                data = gzip_member(record(page_id, link, payload, n, digest, response_id))
                if out is None:
                    out = write_once(path, name)
                out.write(data)
                found.append((name, at, len(data), page_id, link, digest, "revisit" if payload is None else "response"))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], t) for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=INDEX.names)
        if out is not None:
            out.close()

    typed.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def coalesced(rows, gap: int = GAP_BYTES, most: int = RANGE_BYTES):
    """Group (file, offset, length) rows in file and offset order to ranges of near neighbours."""
    group, end = [], 0
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - end > gap or row[1] + row[2] - group[0][1] > most):
            yield group
            group = []
        group.append(row)
        end = row[1] + row[2]
    if group:
        yield group


def read_records(selected: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records that rows of an index (all of it, or a selection by URL, digest, ...) point to.

    Tasks are dealt by the bytes of archives they read, not by the size of the index.
    """
    schema = RECORD if payload else T.StructType(RECORD.fields[:-1])
    places = selected.select("file", "offset", "length")
    size = places.agg(F.sum("length")).first()[0] or 0
    rows = places.repartitionByRange(min(MOST_TASKS, 1 + size // TASK_BYTES), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        for batch in batches:
            for group in coalesced(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                start, end = group[0][1], group[-1][1] + group[-1][2]
                (raw,) = read_ranges(f"{path}/{group[0][0]}", [(start, end - start)])
                found = [parse(zlib.decompress(raw[o - start:o - start + n], 31)) for _, o, n in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[f.name] for x in found], {"long": pa.int64(), "string": pa.string()}.get(
                        f.dataType.typeName(), pa.binary())) for f in schema.fields], names=schema.names)

    return rows.mapInArrow(run, schema)
