"""Corpus-wide line dedup with two Bloom filters.

A line's key is the line without white space at both ends, A-Z lower-cased. Every task adds the 64-bit hashes of its
keys, once per document, to two bit sets: ``once`` (the hash has been seen) and ``twice`` (it was in ``once``
already). Their segments meet by number: a bit that is in two tasks' ``once`` belongs to ``twice`` as well, so the
merged ``twice`` holds every key of two documents. It never misses one; what it holds by chance is removed below.

Only keys whose hash is in ``twice`` are suspects. Their 128-bit digests are counted per task before the shuffle and
confirmed by their document count; for ``keep="first"`` the smallest (doc_id, line number) comes along. Documents lose
the lines of confirmed keys in a second look at the texts, which are not shuffled while the confirmed keys take
at most ``held_bytes`` (they are then given to every task); beyond that suspects and texts are joined by document.

The bit sets are sized by the counted lines, up to ``MOST_BITS``: what goes through the driver and to the workers is
bounded. A corpus with more lines has more chance suspects, that is more digests in the shuffle, and the same result.

Defined cases: every row is a document of its own, repeated and null ids included; a null or empty text is one empty
line; keys shorter than ``least_chars`` code points are never dropped; texts are split whole, a very long one as a slice
of its own; an empty table gives no rows; only id and text are read, so extra columns of any name are left out. With ``keep="first"``
a key's lines stay at its smallest (doc_id, line number), null ids last, in each row of that id that has the key there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean, read, stored

MIN_DOCS = 10
LEAST_CHARS = 1
BITS_PER_LINE = 8
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 30
MOST_PROBES = 4
SEGMENT_BYTES = 4096
HELD_BYTES = 64 << 20
SLICE_BYTES = 4_000_000
BLANK = " \t\n\v\f\r"
DIGEST = 16
RESULT = "doc_id long, n_lines long, n_dropped long, text string"


class Slice:
    """The lines of some texts: distinct keys, the key number of each line, lines per text."""

    def __init__(self, texts: pa.Array, least_chars: int):
        lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        self.count = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.lines = pc.list_flatten(lists)
        coded = pc.dictionary_encode(pc.ascii_lower(pc.ascii_trim(self.lines, characters=BLANK)))
        self.codes = coded.indices.to_numpy().astype(np.int64)
        long_enough = pc.greater_equal(pc.utf8_length(coded.dictionary), least_chars).to_numpy(zero_copy_only=False)
        self.keys = [x if ok else None for x, ok in zip(coded.dictionary.cast(pa.binary()).to_pylist(), long_enough.tolist())]
        self.hashes = np.array([0 if k is None else xxhash.xxh3_64_intdigest(k) for k in self.keys], np.uint64)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.starts = np.cumsum(self.count) - self.count

    def counts(self) -> np.ndarray:
        """Documents of each key; 0 for keys that are too short."""
        pairs = np.unique(self.owner * len(self.keys) + self.codes)
        n = np.bincount(pairs % len(self.keys), minlength=len(self.keys))
        n[[k is None for k in self.keys]] = 0
        return n

    def digests(self, which: np.ndarray) -> list[bytes]:
        return [hashlib.blake2b(self.keys[i], digest_size=DIGEST).digest() for i in which.tolist()]


def _slices(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    for batch in batches:
        for rows in byte_slices(batch, SLICE_BYTES):
            yield rows, Slice(rows.column(rows.schema.get_field_index("text")), least_chars)


def places(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bits of each hash, a row each."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(probes, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def held(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of a row are set."""
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def put(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def shape(lines: int) -> tuple[int, int]:
    """Bits of a filter for so many lines, and probes for each."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_LINE * lines):
        bits *= 2
    return bits, int(np.clip(0.7 * bits / max(1, lines), 1, MOST_PROBES))


def twice_seen(docs: DataFrame, bits: int, probes: int, least_chars: int = LEAST_CHARS) -> np.ndarray:
    """The filter of keys seen in two documents or more."""
    def build(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for _, s in _slices(batches, least_chars):
            n = s.counts()
            at = places(s.hashes, bits, probes)
            put(twice, at[(n > 1) | (n > 0) & held(once, at)])
            put(once, at[n > 0])
        a, b = once.reshape(-1, SEGMENT_BYTES), twice.reshape(-1, SEGMENT_BYTES)
        codec = pa.Codec("zstd")
        used = np.flatnonzero(a.any(1))
        for i in range(0, len(used), 256):
            some = used[i: i + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *(pa.array([codec.compress(x[j].tobytes()).to_pybytes() for j in some], pa.binary()) for x in (a, b))],
                names=["segment", "once", "twice"])

    def merge(batches):
        codec, at, once, twice = pa.Codec("zstd"), None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "twice"])

        for b in batches:
            for segment, o, t in zip(*(c.to_pylist() for c in b.columns)):
                o, t = (np.frombuffer(codec.decompress(x, SEGMENT_BYTES), np.uint8) for x in (o, t))
                if segment == at:
                    twice |= t | (once & o)
                    once |= o
                else:
                    if at is not None:
                        yield out()
                    at, once, twice = segment, o.copy(), t.copy()
        if at is not None:
            yield out()

    parts = docs.select("text").mapInArrow(lean(build), "segment int, once binary, twice binary").repartition("segment")
    merged = parts.sortWithinPartitions("segment").mapInArrow(lean(merge), "segment int, twice binary")
    filter_ = np.zeros(bits // 8, np.uint8).reshape(-1, SEGMENT_BYTES)
    for r in merged.collect():
        filter_[r.segment] = np.frombuffer(r.twice, np.uint8)
    return filter_.ravel()


def _suspected(s: Slice, filter_: np.ndarray, bits: int, probes: int, n: np.ndarray | None = None) -> np.ndarray:
    """Numbers of a slice's keys that the filter holds."""
    ok = held(filter_, places(s.hashes, bits, probes))
    ok &= (np.array([k is not None for k in s.keys], bool) if n is None else n > 0)
    return np.flatnonzero(ok)


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS, least_chars: int = LEAST_CHARS, filter_=None) -> DataFrame:
    """(key, docs, doc_id, line): digests of keys in ``min_docs`` documents or more, with their first place."""
    bits, probes, shared = filter_

    def run(batches):
        f = shared.value
        for rows, s in _slices(batches, least_chars):
            n = s.counts()
            which = _suspected(s, f, bits, probes, n)
            if not len(which):
                continue
            # first place of each key: smallest id, nulls last, then the line number
            ids = rows.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            value = pc.fill_null(ids, 0).to_numpy()
            line = np.arange(len(s.codes)) - s.starts[s.owner]
            order = np.lexsort((line, value[s.owner], null[s.owner], s.codes))
            first = order[np.r_[True, np.diff(s.codes[order]) > 0]][which]  # every key number has a line
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.digests(which), pa.binary()), pa.array(n[which], pa.int64()), ids.take(pa.array(s.owner[first])), pa.array(line[first], pa.int64())],
                names=["key", "docs", "doc_id", "line"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "key binary, docs long, doc_id long, line long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")
    return (found.groupBy("key").agg(F.sum("docs").alias("docs"), F.min(place).alias("at")).where(F.col("docs") >= min_docs)
            .select("key", "docs", "at.doc_id", "at.line"))


class Lookup:
    """Digests in order, with the first place of each."""

    def __init__(self, keys: list[bytes], doc_ids: pa.Array, lines: np.ndarray):
        names = np.array([k + b"." for k in keys], f"S{DIGEST + 1}")  # numpy would cut zeros off the end
        order = np.argsort(names)
        self.keys, self.lines = names[order], lines[order]
        self.doc_ids = pc.fill_null(doc_ids, 0).to_numpy()[order]
        self.null = doc_ids.is_null().to_numpy(zero_copy_only=False)[order]

    @classmethod
    def of(cls, keys: DataFrame) -> Lookup:
        t = keys.select("key", "doc_id", "line").toArrow().combine_chunks()
        ids = t.column("doc_id")
        return cls(t.column("key").to_pylist(), ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, t.column("line").to_numpy())

    def find(self, digests: list[bytes]) -> np.ndarray:
        """The number of each digest, -1 where it is not there."""
        if not digests or not len(self.keys):
            return np.full(len(digests), -1)
        asked = np.array([k + b"." for k in digests], f"S{DIGEST + 1}")
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, at, -1)


def _rebuilt(rows: pa.RecordBatch, s: Slice, drop: np.ndarray) -> pa.RecordBatch:
    """The texts of a slice without the lines marked; a text that keeps all its lines is handed on as it is."""
    dropped = np.bincount(s.owner[drop], minlength=len(s.count))
    texts = pc.fill_null(rows.column(1), "")
    hit = np.flatnonzero(dropped)
    if len(hit):
        kept = s.count[hit] - dropped[hit]
        lines = pc.filter(s.lines, pa.array(~drop & (dropped > 0)[s.owner]))
        left = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), lines), "\n")
        texts = pc.replace_with_mask(texts, pa.array(dropped > 0), left)
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(s.count), pa.array(dropped, pa.int64()), texts],
                                      names=["doc_id", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, least_chars: int = LEAST_CHARS, keep: str = "none", held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per document: lines, lines dropped and the text that is left. Lines whose key is in ``min_docs`` documents go
    everywhere, or with ``keep="first"`` everywhere but at their first place."""
    spark = docs.sparkSession
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    if min_docs < 2:
        raise ValueError("a key must be in two documents to be a repeat")
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits, probes = shape(lines)
    shared = spark.sparkContext.broadcast(twice_seen(docs, bits, probes, least_chars))
    keys = stored(repeated_keys(docs, min_docs, least_chars, (bits, probes, shared)), "line-keys")
    first = keep == "first"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if keys.count() * (DIGEST + 17) > held_bytes:
        return _joined(slim, keys, least_chars, first, (bits, probes, shared))
    known = spark.sparkContext.broadcast(Lookup.of(keys))

    def run(batches):
        f, look = shared.value, known.value
        for rows, s in _slices(batches, least_chars):
            at = np.full(len(s.keys), -1)
            which = _suspected(s, f, bits, probes)
            at[which] = look.find(s.digests(which))
            at = at[s.codes]
            drop = at >= 0
            if first and drop.any():
                i = np.flatnonzero(drop)
                ids = rows.column(0)
                own, null = pc.fill_null(ids, 0).to_numpy()[s.owner[i]], ids.is_null().to_numpy(zero_copy_only=False)[s.owner[i]]
                drop[i] = ~((look.doc_ids[at[i]] == own) & (look.null[at[i]] == null) & (look.lines[at[i]] == i - s.starts[s.owner[i]]))
            yield _rebuilt(rows, s, drop)

    return slim.mapInArrow(lean(run), RESULT)


def _joined(docs: DataFrame, keys: DataFrame, least_chars: int, first: bool, filter_) -> DataFrame:
    """The same for more keys than every task may hold: suspects meet the confirmed keys by digest, and texts the numbers of
    their lines to drop by id and digest of the text (equal rows have equal suspects, so one of them stands for all)."""
    bits, probes, shared = filter_

    def suspects(batches):
        f = shared.value
        for rows, s in _slices(batches, least_chars):
            which = _suspected(s, f, bits, probes)
            number = np.full(len(s.keys), -1)
            number[which] = np.arange(len(which))
            i = np.flatnonzero(number[s.codes] >= 0)
            if len(i):
                owner = pa.array(s.owner[i])
                digests = pa.array(s.digests(which), pa.binary()).take(pa.array(number[s.codes[i]]))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(owner), rows.column(2).take(owner), digests, pa.array(i - s.starts[s.owner[i]], pa.int64())],
                                                 names=["doc_id", "of", "key", "line"])

    def rebuild(batches):
        for batch in batches:
            for rows in byte_slices(batch, SLICE_BYTES):
                s = Slice(rows.column(1), least_chars)
                gone = rows.column(2)
                size = pc.fill_null(pc.list_value_length(gone), 0).to_numpy().astype(np.int64)
                drop = np.zeros(len(s.codes), bool)
                drop[np.repeat(s.starts, size) + pc.list_flatten(gone).to_numpy()] = True
                yield _rebuilt(rows, s, drop)

    named = docs.withColumn("of", F.md5(F.coalesce("text", F.lit(""))))
    got = named.mapInArrow(lean(suspects), "doc_id long, of string, key binary, line long").distinct()
    met = got.join(keys.select("key", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line")), "key")
    if first:
        met = met.where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    gone = met.groupBy(F.col("doc_id").alias("in_doc"), F.col("of").alias("in_text")).agg(F.collect_list("line").alias("lines"))
    return (named.join(gone, F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("of") == F.col("in_text")), "left")
            .select("doc_id", "text", "lines").mapInArrow(lean(rebuild), RESULT))


def op11_linededup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key
GROUP BY doc_id
"""
