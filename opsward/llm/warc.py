"""WARC records as a chunked record table.

``write_records`` turns pages into WARC/1.1 records and stores their bytes as rows
``(archive, record_key, chunk_no, last, data, prefix_digest)``: the bytes of a record, header and
payload, are cut at ``chunk_bytes``, so a payload of any size is streamed through as small rows. Each row
carries the SHA-256 of the payload up to its end, so a reader notices the first damaged chunk.
Concatenating ``data`` by (record_key, chunk_no) gives a plain WARC file.

``read_records`` parses the rows again. A record of one chunk is parsed where it lies; only the chunks of
oversized records are shuffled, by record, and hashed one after the other, so no task ever holds a record.

Defined cases: a null payload is empty; a null url leaves out WARC-Target-URI; a null page_id is written as
``null`` and read back as null, and
such a page revisits the smallest id of its payload like any other (without one it is a response); of repeated rows with the smallest page_id all are responses; an empty table
gives an empty archive; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK_BYTES = 65_536
MIN_REVISIT_BYTES = 100
URN = "<urn:opsward:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE = "archive int, record_key long, chunk_no int, last boolean, data binary, prefix_digest string"
PARSED = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "target_uri string, n_chunks int, intact boolean")
BATCH_BYTES = 2_000_000


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds payload (binary), its length and digest, record_type and refers_to. The first page of a digest
    comes from a map-side combined minimum, so a payload shared by a third of all pages is one group row."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = (p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
             .where("first_id is not null and n > 1").select("payload_digest", "first_id"))
    p = p.join(first, "payload_digest", "left")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.withColumns({"record_type": F.when(again, "revisit").otherwise("response"),
                          "refers_to": F.when(again, F.col("first_id"))}).drop("first_id")


def _header(page_id, url, n, digest, kind, refers) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {URN}{'null' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    lines.append(f"X-Payload-Bytes: {n}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {URN}{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else n}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def _writer(chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = TaskContext.get().partitionId()
        rows: list[tuple] = []
        held = ordinal = 0
        schema = pa.schema([("archive", pa.int32()), ("record_key", pa.int64()), ("chunk_no", pa.int32()),
                            ("last", pa.bool_()), ("data", pa.binary()), ("prefix_digest", pa.string())])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                page_id, url, n, digest, kind, refers = (c[i].as_py() for c in cols[:6])
                head = _header(page_id, url, n, digest, kind, refers)
                body = memoryview(cols[6][i].as_buffer()) if kind == "response" and n else memoryview(b"")
                total, seen = len(head) + len(body) + 4, hashlib.sha256()
                key = (archive << 40) + ordinal
                ordinal += 1
                for no, at in enumerate(range(0, total, chunk_bytes)):
                    part = body[max(0, at - len(head)): max(0, at + chunk_bytes - len(head))]
                    seen.update(part)
                    tail = b"\r\n\r\n"[max(0, at - total + 4):][: max(0, at + chunk_bytes - (total - 4) - max(0, at - total + 4))]
                    rows.append((archive, key, no, at + chunk_bytes >= total,
                                 head[at: at + chunk_bytes] + bytes(part) + tail, seen.copy().hexdigest()))
                    held += chunk_bytes
                    if held > BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()
    return write


def write_records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The stored chunk table (one task writes one archive)."""
    p = mark_revisits(pages).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                    F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))
    return stored(p.mapInArrow(_writer(chunk_bytes), TABLE), "warc")


def _page(value: str | None):
    inner = value[len(URN):-1] if value else "null"
    return None if inner == "null" else int(inner)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in record order -> one row per record."""
    out: list[tuple] = []
    head, fields, state = b"", None, None

    for b in batches:
        no, last, data, said = (b.column(b.schema.get_field_index(c)) for c in ("chunk_no", "last", "data", "prefix_digest"))
        for i in range(b.num_rows):
            if no[i].as_py() == 0:
                head, fields, state = b"", None, {"sha": hashlib.sha256(), "got": 0, "ok": True, "chunks": 0}
            part = data[i].as_py()
            state["chunks"] += 1
            if fields is None:
                head += part
                end = head.find(b"\r\n\r\n")
                if end >= 0:
                    text = head[:end].decode("utf-8", "surrogatepass").split("\r\n")
                    fields = dict(x.split(": ", 1) for x in text[1:])
                    state["left"] = int(fields["Content-Length"])
                    part = head[end + 4:]
            if fields is not None:
                body = part[: state["left"]]
                state["sha"].update(body)
                state["left"] -= len(body)
                state["got"] += len(body)
            state["ok"] &= state["sha"].hexdigest() == said[i].as_py()
            if last[i].as_py():
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                n, mine = int(fields["X-Payload-Bytes"]), state["sha"].hexdigest()
                if kind == "response":
                    ok, n, digest = state["ok"] and not state["left"] and n == state["got"] and digest == mine, state["got"], mine
                else:
                    ok = state["ok"]
                out.append((_page(fields["WARC-Record-ID"]), n, digest, kind, _page(fields.get("WARC-Refers-To")),
                            fields.get("WARC-Target-URI"), state["chunks"], ok))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PARSED_TYPES)], names=_PARSED_NAMES)
            out = []


_PARSED_NAMES = [x.split()[0] for x in PARSED.split(", ")]
_PARSED_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]


def read_records(table: DataFrame) -> DataFrame:
    """One row per record of a chunk table; ``intact`` tells whether every digest held."""
    whole = (F.col("chunk_no") == 0) & F.col("last")
    cols = ["record_key", "chunk_no", "last", "data", "prefix_digest"]
    small = table.where(whole).select(*cols).mapInArrow(_reader, PARSED)
    large = table.where(~whole).select(*cols).repartition("record_key").sortWithinPartitions("record_key", "chunk_no")
    return small.unionByName(large.mapInArrow(_reader, PARSED))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    from .common import read
    return read_records(write_records(read(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY html) AND min(page_id) OVER (PARTITION BY html) IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY html) THEN min(page_id) OVER (PARTITION BY html) END AS refers_to
FROM pages"""
