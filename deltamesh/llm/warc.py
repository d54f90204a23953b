"""WARC archives: written with an index, read back through coalesced byte ranges.

Index first: every task writes one archive of gzip members, one per record, and returns for each
record its file, offset, length, URL and payload digest. The index is a Parquet table, so only
archives of tasks that were committed are ever read; what a lost or repeated task wrote is not in
it. Readers sort the selected index rows by file and offset, join ranges that touch or nearly
touch, fetch each range in one read and cut the records out of it.

A payload met before is written as a revisit of the record with the smallest page id. Which those
are is known before writing: digests are aggregated first (a payload shared by a third of all pages
is pre-aggregated), and the pages meet only the table of repeated digests. Archives go through
Arrow's file systems to the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltamesh.llm.common import cut, scratch

#: Ranges with at most this many bytes between them are read as one; a range starts anew after RANGE bytes.
GAP, RANGE = 1 << 16, 1 << 23
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """One record, uncompressed, and its payload's digest."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> dict:
    """A record's fields; a payload that isn't what its digest says is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")
    page = lambda x: None if x == "<urn:x-page:None>" else int(x[len("<urn:x-page:") : -1])
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None}


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives under root and return the index, itself written there."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("large", F.octet_length("html") >= min_bytes)
    firsts = keyed.where("large").groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first_id")
    firsts = cut(firsts, "warc-firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                where, base = fs.FileSystem.from_uri(root)
                where.create_dir(base, recursive=True)
                name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            rows = []
            html = batch.column("html").cast(pa.binary())
            ids, urls, firsts, large, repeated = (batch.column(c).to_pylist() for c in ("page_id", "url", "first_id", "large", "repeated"))
            for i in range(batch.num_rows):
                revisit = bool(repeated[i] and large[i] and ids[i] != firsts[i])
                raw, digest = record(ids[i], urls[i], html[i].as_py(), firsts[i], revisit, date)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                rows.append((name, at, len(member), urls[i], digest, ids[i], "revisit" if revisit else "response"))
                at += len(member)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
        if out is not None:
            out.close()

    joined = keyed.join(firsts.withColumn("repeated", F.lit(True)), "sha", "left")
    index = joined.select("page_id", "url", "html", "first_id", "large", F.coalesce("repeated", F.lit(False)).alias("repeated")).mapInArrow(run, INDEX)
    index.write.parquet(f"{root}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{root}/index")


def coalesced(selected: DataFrame) -> DataFrame:
    """Index rows as ranges (file, start, stop, records): sorted, joined across small gaps, cut at RANGE bytes."""
    by_offset = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by_offset)
    fresh = selected.select("file", "offset", "length").withColumn("fresh", F.when(gap.isNull() | (gap > GAP), 1).otherwise(0))
    runs = fresh.withColumn("run", F.sum("fresh").over(by_offset)).withColumn("part", F.floor(F.col("offset") / RANGE))
    return runs.groupBy("file", "run", "part").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).select("file", "start", "stop", "records")


def read_archives(selected: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    fields = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payload:
        del fields["payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{base}/{row['file']}") as f:
                    data = f.read_at(row["stop"] - row["start"], row["start"])
                found = []
                for r in row["records"]:
                    a = r["offset"] - row["start"]
                    found.append(parse_record(zlib.decompress(data[a : a + r["length"]], 31)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in fields.items()], list(fields))

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return coalesced(selected).mapInArrow(run, ", ".join(f"{k} {kinds[t]}" for k, t in fields.items()))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives of all pages.

    A null html is an empty payload, a null url an empty one. Of rows with equal payloads of at
    least min_bytes those with the smallest page id are responses (several, if rows share that
    id), the others revisit it; a null id counts as larger than any, and payloads known only from
    null ids are responses. An empty table gives no archive and no row.
    """
    root = scratch(pages.sparkSession, "warc")
    index = write_archives(pages, root, min_bytes)
    return read_archives(index, root, payload=False).drop("url")


#: The same by DuckDB; base32 is cut out of the hexadecimal digest, twenty bits at a time.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""
