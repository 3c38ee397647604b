"""Token ids in binary blocks coded by a static range asymmetric numeral system (rANS).

``write_tokens`` encodes documents with a public tokenizer, counts all ids once for a shared static frequency
table, range-partitions the documents by id and codes each partition (a shard) as independent blocks; a table of
shards, one of frequencies and one of blocks are stored as Parquet below one folder. ``read_tokens`` needs
nothing but that folder.

A block interleaves many coder lanes (token i belongs to lane i mod lanes), so numpy advances all lanes in a
step. Checkpoints hold the lane states and the place in the stream every ``CHECK_STEPS`` steps; the reader
decodes the parts between them side by side. CRC-32 sums guard the block's payload and its ids.

Block payload, little-endian: magic ``RANB``, version, lanes, steps between checkpoints (u16 each), tokens (u32),
checkpoints (u32); per checkpoint its word offset (u32); per checkpoint and lane a state (u64); stream words
(u32 each); crc32 of all before (u32).

A document's pieces (more than one where it crosses blocks) are listed beside its block. Its checksum is the
exclusive-or of its pieces' checksums, each shifted by the bytes that follow it in the document, so pieces combine
in any order by a plain aggregate.

Defined cases: a null text is empty and holds the end id only; null ids sort first; rows with equal ids are
documents of their own, ordered by their ids' bytes; documents and texts of any length cross blocks; an empty
table gives empty files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsward.session import scratch_path

from .common import byte_slices, ragged_positions, read

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
PROB_BITS = 18
LANES = 1024
BLOCK_TOKENS = 262_144
CHECK_STEPS = 128
LOW = np.uint64(1 << 31)
CACHE_WORDS = 700_000
JOINED = 128
HEAD = struct.Struct("<4sHHHII")
BLOCKS = ("shard int, block int, n_tokens long, payload binary, doc_ids array<long>, doc_starts array<long>, "
          "before array<long>, here array<long>, after array<long>")
PIECES = "shard int, doc_start long, doc_id long, n long, crc long"


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once. Valid for vocabularies that drop
    white space and lower-case: white space bounds every piece, so a text's ids are those of its words in a row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65536
        self.stops = {p: self.tokenizer.encode(p, add_special_tokens=False).ids for p in (",", ".")}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.reset()

    def reset(self):
        self.words = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int32)
        self.len = np.zeros(0, np.int32)

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has. Words of letters go ``JOINED`` to a line, parted at the
        ids that end a word; a line where that leaves another number of words is encoded word by word."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        lines = [plain[i: i + JOINED] for i in range(0, len(plain), JOINED)]
        got = self.tokenizer.encode_batch_fast(["\n".join([words[i] for i in x]) for x in lines], add_special_tokens=False)
        alone = [i for i, w in enumerate(words) if not w.isalpha()]
        order, flat, lens = [], [], []
        for line, e in zip(lines, got):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(line):
                order += line
                flat.append(ids)
                lens.append(np.diff(np.r_[0, cut]))
            else:
                alone += line
        if alone:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
            order += alone
            flat.append(np.array([t for x in got for t in x], np.uint32))
            lens.append(np.array([len(x) for x in got], np.int64))
        if not order:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, n = np.concatenate(flat), np.concatenate(lens)
        back = np.argsort(np.array(order))
        return ids[ragged_positions((np.cumsum(n) - n)[back], n[back])], n[back]

    def _learn(self, new: list[str]) -> np.ndarray:
        """Adds words to the cache and gives their numbers. A full stop or comma after a letter is a piece of its own, so
        such a word is its stem's ids and the mark's."""
        base = len(self.at)
        stopped = [w for w in new if w[-1] in ",." and "a" <= w[-2:-1] <= "z"]
        marked = set(stopped)
        stems = list(dict.fromkeys(w[:-1] for w in stopped))
        known = dict(zip(stems, pc.index_in(pa.array(stems, pa.string()), value_set=self.words).to_pylist()))
        plain = list(dict.fromkeys([w for w in new if w not in marked] + [w for w, i in known.items() if i is None]))
        ids, lens = self._distinct(plain)
        self._append(ids, lens)
        number = {w: i for w, i in known.items() if i is not None}
        number.update(zip(plain, range(base, base + len(plain))))
        if stopped:
            stem = np.array([number[w[:-1]] for w in stopped])
            tail = [self.stops[w[-1]] for w in stopped]
            sizes = np.array([len(x) for x in tail])
            lens = self.len[stem] + sizes
            ids = np.zeros(int(lens.sum()), np.uint32)
            body = np.ones(len(ids), bool)
            mark = ragged_positions(np.cumsum(lens) - sizes, sizes)
            body[mark] = False
            ids[mark] = [t for x in tail for t in x]
            ids[body] = self.flat[ragged_positions(self.at[stem], self.len[stem])]
            number.update(zip(stopped, range(base + len(plain), base + len(plain) + len(stopped))))
            self._append(ids, lens)
        self.words = pa.concat_arrays([self.words, pa.array(plain + stopped, pa.string())])
        return np.array([number[w] for w in new], np.int64)

    def _append(self, ids, lens):
        self.at = np.concatenate([self.at, (len(self.flat) + np.cumsum(lens) - lens).astype(np.int32)])
        self.len = np.concatenate([self.len, lens.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array or a list) in a row, and how many each has."""
        if len(self.words) > CACHE_WORDS:
            self.reset()
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        # special tokens are case-sensitive; all else is lower-cased anyway
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        coded = pc.dictionary_encode(split.flatten())
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            words = coded.dictionary.take(pa.array(new)).to_pylist()
            if "" in words:
                new = np.delete(new, words.index(""))
                words.remove("")
            place[new] = self._learn(words)
        codes = place[coded.indices.to_numpy()] if len(owner) else np.zeros(0, np.int64)
        if len(codes) and codes.min() < 0:  # empty strings beside leading or trailing white space
            owner, codes = owner[codes >= 0], codes[codes >= 0]
        lens = self.len[codes]
        flat = self.flat[ragged_positions(self.at[codes], lens)]
        return flat, np.bincount(owner, lens, len(texts)).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file, made once a worker, with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, counts): the ids of every whole text with the end id, as little-endian integers of 4 bytes (2 if the
    vocabulary fits); each task ends with a row that has no ids but counts, pairs (id, times) of all that it wrote."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind, schema = "<u4" if enc.wide else "<u2", pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
        total = np.zeros(max(len(enc.ends), end_id + 1), np.int64)
        for batch in batches:
            for rows in byte_slices(batch, 5_000_000):
                ids, lens = enc.encode(rows.column(1))
                out = np.full(len(ids) + len(lens), end_id, kind)
                ends = np.cumsum(lens + 1)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                total += np.bincount(out, minlength=len(total))
                raw = out.tobytes()
                cuts = (np.r_[0, ends] * out.itemsize).tolist()
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                                                  pa.nulls(len(lens), pa.binary())], schema=schema)
        used = np.flatnonzero(total)
        pairs = np.stack([used, total[used]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])


def frequencies(counts: dict[int, int], bits: int = PROB_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, frequencies) that sum to 2**bits, each at least 1, near proportion to the counts."""
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in ids], np.float64)
    if not len(ids):
        return ids, ids.astype(np.uint64)
    room = (1 << bits) - len(ids)
    f = 1 + np.floor(n / n.sum() * room).astype(np.int64)
    f[int(n.argmax())] += (1 << bits) - int(f.sum())
    return ids, f.astype(np.uint64)


class Coder:
    """rANS with a shared table over the ids that occur."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        begin = np.cumsum(freq) - freq
        self.freq[ids], self.start[ids] = freq, begin
        # one look-up per id decoded: frequency, place inside the id's range and id, packed
        times = freq.astype(np.int64)
        inside = np.arange(int(times.sum())) - np.repeat(begin.astype(np.int64), times)
        self.entry = np.repeat(freq, times) << np.uint64(45) | inside.astype(np.uint64) << np.uint64(27) | np.repeat(ids, times).astype(np.uint64)
        self.pad = int(ids[int(freq.argmax())]) if len(ids) else 0

    def encode(self, tokens: np.ndarray) -> bytes:
        """The payload of one block."""
        lanes = LANES if len(tokens) >= 16 * LANES else 16
        steps = max(1, -(-len(tokens) // lanes))
        grid = np.full(steps * lanes, self.pad, np.int64)
        grid[: len(tokens)] = tokens
        grid = grid.reshape(steps, lanes)
        f, c = self.freq[grid], self.start[grid]
        top = f << np.uint64(63 - PROB_BITS)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        states, sizes = [], np.zeros(steps, np.int64)
        for t in range(steps - 1, -1, -1):
            full = x >= top[t]
            k = np.flatnonzero(full)
            out = x[k]
            sizes[t] = len(out)
            words.append(out.astype(np.uint32))
            x[k] = out >> np.uint64(32)
            q = x // f[t]
            x = (q << np.uint64(PROB_BITS)) + (x - q * f[t]) + c[t]
            if t % CHECK_STEPS == 0:
                states.append(x.copy())
        offsets = (np.cumsum(sizes) - sizes)[::CHECK_STEPS]
        body = (HEAD.pack(b"RANB", 1, lanes, CHECK_STEPS, len(tokens), len(states)) + offsets.astype("<u4").tobytes()
                + np.concatenate(states[::-1]).astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes())
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, payload: bytes) -> np.ndarray:
        """The ids of one block; the parts between its checkpoints are decoded side by side."""
        if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("damaged block: checksum differs")
        magic, version, lanes, every, n, checks = HEAD.unpack_from(payload)
        if magic != b"RANB" or version != 1:
            raise ValueError("no block of this format")
        at = HEAD.size
        ptr = np.frombuffer(payload, "<u4", checks, at).tolist()
        at += 4 * checks
        x = np.frombuffer(payload, "<u8", checks * lanes, at).astype(np.uint64).reshape(checks, lanes)
        at += 8 * checks * lanes
        words = np.frombuffer(payload[at:-4], "<u4").astype(np.uint64)
        steps = max(1, -(-n // lanes))
        out = np.zeros((checks, every, lanes), np.uint32)
        mask, bits, id_mask = np.uint64((1 << PROB_BITS) - 1), np.uint64(PROB_BITS), np.uint64((1 << 27) - 1)
        last = steps - (checks - 1) * every
        for t in range(min(every, steps)):
            live = checks if t < last else checks - 1
            if not live:
                break
            y = x[:live]
            e = self.entry[y & mask]
            out[:live, t] = e & id_mask
            y = (e >> np.uint64(45)) * (y >> bits) + (e >> np.uint64(27) & mask)
            need = y < LOW
            for i in range(live):  # lanes take the next words in lane order
                k = np.flatnonzero(need[i])
                y[i, k] = (y[i, k] << np.uint64(32)) | words[ptr[i]: ptr[i] + len(k)]
                ptr[i] += len(k)
            x[:live] = y
        return out.reshape(-1)[:n]


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        if v & 1:
            out ^= row
        v >>= 1
    return out


def shift_crc(crc: int, n: int) -> int:
    """The part that a piece with checksum ``crc`` has in the checksum of itself and ``n`` more bytes: crc times
    x**(8n) modulo the CRC-32 polynomial, by squaring."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        step = [_times(step, r) for r in step]
    while n:
        if n & 1:
            crc = _times(step, crc)
        n >>= 1
        if n:
            step = [_times(step, r) for r in step]
    return crc


def _encoder(coder_args, kind: str, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(*coder_args), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        count = block = position = 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())]
                           + [(x, pa.list_(pa.int64())) for x in ("doc_ids", "doc_starts", "before", "here", "after")])

        def flush():
            nonlocal held, docs, count, block
            tokens = np.concatenate(held).astype(np.int64)
            row = [[shard], [block], [len(tokens)], [coder.encode(tokens)]] + [[list(x)] for x in zip(*docs)]
            held, docs, count, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, schema.types)], schema=schema)

        for b in batches:
            ids = b.column(1)
            for i in range(b.num_rows):
                doc_id, tokens = b.column(0)[i].as_py(), np.frombuffer(ids[i].as_py(), kind)
                at = 0
                while at < len(tokens):
                    part = tokens[at: at + block_tokens - count]
                    held.append(part)
                    docs.append((doc_id, position, at, len(part), len(tokens) - at - len(part)))
                    at += len(part)
                    count += len(part)
                    if count == block_tokens:
                        yield flush()
                position += len(tokens)
        if count:
            yield flush()
    return run


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes blocks, frequencies and shards below ``out``. Texts are encoded once; the ids move once, to their range."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    kind = "<u4" if encoder(path).wide else "<u2"
    tokenize(docs, path, end_id).write.option("compression", "zstd").parquet(f"{out}/tokens")
    tokens = spark.read.schema("doc_id long, ids binary, counts binary").parquet(f"{out}/tokens")
    counts = tokens.select("counts").where("counts is not null").mapInArrow(_unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r.id: r.n for r in counts.collect()}  # at most one row per id of the vocabulary
    ids, freq = frequencies(counts)
    table = list(zip(ids.tolist(), freq.astype(np.int64).tolist()))
    spark.createDataFrame(table, "id int, freq int").coalesce(1).write.parquet(f"{out}/frequencies")
    (tokens.where("ids is not null").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(_encoder((ids, freq), kind, block_tokens), BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks"))
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    blocks.groupBy("shard").agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{out}/shards")


def _decoder(coder_args):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*coder_args)
        for b in batches:
            for i in range(b.num_rows):
                shard, _, n, payload, doc_ids, starts, _, here, after = (c[i].as_py() for c in b.columns)
                raw = coder.decode(payload).astype("<u4").tobytes()
                if len(raw) != 4 * n:
                    raise ValueError("block holds another number of ids")
                at, crcs = 0, []
                for y, z in zip(here, after):
                    crc = zlib.crc32(raw[at: at + 4 * y])
                    at += 4 * y
                    crcs.append(shift_crc(crc, 4 * z) if z else crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(crcs), pa.int32()), pa.array(starts, pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array(here, pa.int64()), pa.array(crcs, pa.int64())],
                    names=[x.split()[0] for x in PIECES.split(", ")])
    return run


def coder_of(spark: SparkSession, out: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.schema("id int, freq int").parquet(f"{out}/frequencies").collect()  # at most the vocabulary
    rows.sort()
    return np.array([r.id for r in rows], np.int64), np.array([r.freq for r in rows], np.uint64)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    pieces = blocks.mapInArrow(_decoder(coder_of(spark, out)), PIECES)
    docs = pieces.groupBy("shard", "doc_start", "doc_id").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    shards = spark.read.schema("shard int, blocks long, n_tokens long").parquet(f"{out}/shards")
    offsets, at = [], 0
    for r in sorted(shards.select("shard", "n_tokens").collect()):  # a row per shard
        offsets.append((r.shard, at))
        at += r.n_tokens
    offset = spark.createDataFrame(offsets, "shard int, offset long")
    return docs.join(offset, "shard").select(
        "doc_id", (F.col("offset") + F.col("doc_start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op2_rans(spark, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "rans")
    write_tokens(read(spark, sf_dir, "documents"), out)
    return read_tokens(spark, out)
