"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both tokenizers read the same bytes (a space and the text). Byte offsets where tokens of both end cut them into
groups; tokens whose byte ranges overlap are linked, and a pair of ids counts how many links of the corpus hold it.

An array names for each id of A the id of B with the same bytes. A group of one token each that follows it is counted
in a vector as long as A's vocabulary, one for each task, added up by id. Only the links of the other groups become
pair rows, counted per block of documents before they are shuffled. What goes back is again bounded by the
vocabularies for the identity pairs and for each B id's highest count; irregular pairs are answered per block by a join.

A text is cut at single spaces between two visible characters, where neither tokenizer merges across (for B that is
tested on its vocabulary when it is read; A splits there by its pattern). So each distinct piece of a text is encoded and
aligned once per worker, and a document is a row of piece numbers.

Defined cases: texts that are null or empty, or whose bytes one tokenizer does not give back, have no tokens: zeros and
an empty ``groups``; a null id stays null and rows with equal ids are documents of their own; texts are encoded whole, a very long one as
a block of its own; an empty table gives no rows; only id and text are read, so extra columns of any name are left out.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import byte_slices, lean, ragged_positions, read, stored

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BLOCK_BYTES = 3_000_000
LEARN_PIECES = 16_384
LONG_PIECE = 1000
LATIN_END = "\u0250"  # below it all versions of Unicode agree on what is a letter
CACHE_PIECES = 150_000
CACHE_CHARS = 8_000_000
LOW = 0xFFFFFFFF
SPACE = "▁"
BLOCKS = "block long, body binary, doc_ids array<long>, groups array<string>, pairs array<long>, times array<long>, vector array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of integers."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Strings:
    """Byte strings by number, in one array."""

    def __init__(self, items: list[bytes]):
        self.len = np.array([len(x) for x in items], np.int64)
        self.at = np.cumsum(self.len) - self.len
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.flat[ragged_positions(self.at[which], self.len[which])]


def visible(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


class Aligner:
    """Two vocabularies, the identity map between them, and a bounded cache of aligned pieces."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        named = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        named |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        bytes_a = [named.get(i, b"") for i in range(max(named) + 1)]
        # a vocabulary numbered in the order of its merges can be read as ranks, which many pieces in one call take
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        base = len(named) - len(spec["added_tokens"]) - len(merges)
        self.ranked = None
        if all(spec["model"]["vocab"].get(x + y) == base + i for i, (x, y) in enumerate(merges)):
            ranks = {x: i for i, x in enumerate(bytes_a[: base + len(merges)])}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("a piece of the second vocabulary goes on after a space, so texts cannot be cut at spaces")
        single = [self.b.is_byte(i) for i in range(len(names))]
        bytes_b = [bytes([int(n[1:-1], 16)]) if s else n.replace(SPACE, " ").encode() for n, s in zip(names, single)]
        # of two B ids with the same bytes the whole piece, not the single byte
        same = {x: i for s in (True, False) for i, x in enumerate(bytes_b) if single[i] == s and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.identity = np.array([same.get(x, -1) for x in bytes_a], np.int64)
        self.bytes_a, self.bytes_b = Strings(bytes_a), Strings(bytes_b)
        ids = range(max(len(bytes_a), len(bytes_b)))
        self.shown = Strings([b"%d%c" % (i, mark) for i in ids for mark in b",|;"])
        self.reset()

    def reset(self):
        self.code: dict[str, int] = {}
        self.chars = 0
        self.facts = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, identity links, other links; -1: bytes differ
        self.text, self.text_len = np.zeros(0, np.uint8), np.zeros(0, np.int64)
        self.same, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_a(self, new: list[str], want: Strings) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, and the piece that each belongs to. Pieces that may stand in a row without merging are read in one call."""
        rows = [i for i, x in enumerate(new) if self.ranked and len(x) < LONG_PIECE and x.isprintable() and visible(x[0]) and visible(x[-1]) and max(x) < LATIN_END]
        in_row = np.zeros(len(new), bool)
        in_row[rows] = True
        ids = np.array(self.ranked.encode_ordinary(" " + " ".join([new[i] for i in rows])) if rows else [], np.int64)
        of = np.searchsorted(np.cumsum(want.len[in_row]), np.cumsum(self.bytes_a.len[ids]))
        of = np.flatnonzero(in_row)[of]
        rest = np.flatnonzero(~in_row)
        got = [e.ids for e in self.a.encode_batch_fast([" " + new[i] for i in rest.tolist()], add_special_tokens=False)]
        ids = np.r_[ids, np.fromiter(chain.from_iterable(got), np.int64)]
        of = np.r_[of, np.repeat(rest, [len(x) for x in got])]
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def _learn(self, new: list[str]) -> None:
        """Aligns pieces and adds them to the cache."""
        want = Strings([b" " + x.encode() for x in new])
        got = self.b.encode(new, num_threads=1)
        of_b = (np.fromiter(chain.from_iterable(got), np.int64), np.repeat(np.arange(len(new)), [len(x) for x in got]))
        tokens, owner, right = [], [], np.ones(len(new), bool)
        for (ids, of), table in ((self._encode_a(new, want), self.bytes_a), (of_b, self.bytes_b)):
            size = np.bincount(of, table.len[ids], len(new)).astype(np.int64)
            right &= size == want.len
            fits = np.flatnonzero(size == want.len)
            keep = (size == want.len)[of]
            wrong = table.take(ids[keep]) != want.take(fits)
            right[np.repeat(fits, want.len[fits])[wrong]] = False
            tokens.append(ids)
            owner.append(of)
        a, b = (ids[right[of]] for ids, of in zip(tokens, owner))
        good = np.flatnonzero(right)
        end_a, end_b, end_piece = np.cumsum(self.bytes_a.len[a]), np.cumsum(self.bytes_b.len[b]), np.cumsum(want.len[good])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]][: len(ends)]]
        at_a, at_b, of = (np.searchsorted(x, ends) for x in (end_a, end_b, end_piece))
        closed = (end_a[at_a] == ends) & (end_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
        single = closed & np.r_[True, closed[:-1]][: len(ends)]
        link_a, link_b = a[at_a], b[at_b]
        same = single & (self.identity[link_a] == link_b)
        facts = np.full((len(new), 5), -1, np.int64)
        n = len(good)
        facts[good] = np.stack([np.bincount(x, minlength=n) for x in (
            np.searchsorted(end_piece, end_a), np.searchsorted(end_piece, end_b), of[closed], of[same], of[~same])], axis=1) if n else 0
        # groups as text: the A ids of a group, then its B ids
        cuts = ends[closed]
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
        order = np.zeros(len(a) + len(b), np.int64)
        order[place_a] = 3 * a + (end_a == cuts[group_a]) if len(a) else 0
        order[place_b] = 3 * b + 2 * (end_b == cuts[group_b]) if len(b) else 0
        in_piece = np.zeros(len(order), np.int64)
        in_piece[place_a], in_piece[place_b] = np.searchsorted(end_piece, end_a), np.searchsorted(end_piece, end_b)
        text_len = np.zeros(len(new), np.int64)
        text_len[good] = np.bincount(in_piece, self.shown.len[order], n).astype(np.int64) if n else 0
        self.facts = np.concatenate([self.facts, facts])
        self.text, self.text_len = np.concatenate([self.text, self.shown.take(order)]), np.r_[self.text_len, text_len]
        self.same = np.r_[self.same, link_a[same]]
        self.pairs = np.r_[self.pairs, link_a[~same] << 32 | link_b[~same]]

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cache numbers of the pieces of all texts (not null, not empty) in a row, and how many each text has."""
        if len(self.code) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self.reset()
        lists = pc.split_pattern(texts, " ")
        count = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        names, parts = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        opens = np.array([bool(x) and visible(x[0]) for x in names], bool)
        closes = np.array([bool(x) and visible(x[-1]) for x in names], bool)
        starts = np.cumsum(count) - count
        first = np.r_[True, closes[parts[:-1]] & opens[parts[1:]]][: len(parts)]
        first[starts] = True
        at = np.flatnonzero(first)
        run = np.diff(np.r_[at, len(parts)])
        alone, several = at[run == 1], np.flatnonzero(run > 1)
        new: list[str] = []

        def number(x: str) -> int:
            c = self.code.get(x)
            if c is None:
                c = self.code[x] = len(self.code)
                new.append(x)
            return c

        used = np.unique(parts[alone])
        table = np.full(len(names), -1)
        table[used] = [number(names[i]) for i in used.tolist()]
        out = table[parts[at]]
        out[several] = [number(" ".join(names[j] for j in parts[i: i + n].tolist())) for i, n in zip(at[several].tolist(), run[several].tolist())]
        if new:
            self.chars += sum(map(len, new))
            for i in range(0, len(new), LEARN_PIECES):
                self._learn(new[i: i + LEARN_PIECES])
        return out, sums(first, count)

    def block(self, texts: pa.Array) -> dict:
        """A block of documents: facts, piece numbers within the block, and the pieces' links."""
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        which = np.flatnonzero(full.to_numpy(zero_copy_only=False))
        codes, count = self.pieces(texts.filter(full)) if len(which) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        bad = sums(self.facts[codes, 0] < 0, count) > 0
        codes = codes[~np.repeat(bad, count)]
        which, count = which[~bad], count[~bad]
        facts = np.zeros((len(texts), 5), np.int64)
        facts[which] = np.stack([sums(self.facts[codes, i], count) for i in range(5)], axis=1)
        at = np.cumsum(self.text_len) - self.text_len
        raw = self.text[ragged_positions(at[codes], self.text_len[codes])].tobytes()
        ends = np.cumsum(sums(self.text_len[codes], count)).tolist()
        shown = np.full(len(texts), "", object)
        shown[which] = [raw[a: b - 1].decode() for a, b in zip([0] + ends[:-1], ends)]
        own, local = np.unique(codes, return_inverse=True)
        times = np.bincount(local, minlength=len(own))
        links = []
        for flat, column in ((self.same, 3), (self.pairs, 4)):
            size = np.maximum(self.facts[:, column], 0)
            links += [flat[ragged_positions((np.cumsum(size) - size)[own], size[own])], size[own]]
        pairs, of = np.unique(links[2], return_inverse=True)
        per = np.zeros(len(texts), np.int64)
        per[which] = count
        return {"n_a": facts[:, 0], "n_b": facts[:, 1], "n_groups": facts[:, 2], "n_links": facts[:, 3] + facts[:, 4], "pieces": local.astype(np.int32), "per": per,
                "same": links[0].astype(np.int32), "n_same": links[1].astype(np.int32), "of": of.astype(np.int32), "n_of": links[3].astype(np.int32),
                "pairs": pairs, "times": np.bincount(of, np.repeat(times, links[3]), len(pairs)).astype(np.int64),
                "vector": np.bincount(links[0], np.repeat(times, links[1]), len(self.identity)).astype(np.int64), "groups": shown}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, made once a worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def forget() -> None:
    """Empties the caches of a worker's aligners."""
    for a in _ALIGNERS.values():
        a.reset()


def _packed(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor().compress(out.getvalue())


def _lists(flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))


def _encoded(paths: tuple[str, str], digest: bool, block_bytes: int):
    body = ("n_a", "n_b", "n_groups", "n_links", "pieces", "per", "same", "n_same", "of", "n_of")
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, vector, number = aligner(*paths), None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in byte_slices(batch, block_bytes):
                got = al.block(rows.column(1))
                vector = got["vector"] if vector is None else vector + got["vector"]
                shown = [hashlib.sha256(x.encode()).hexdigest() if x and digest else x for x in got["groups"]]
                ends = pa.array([0, len(shown)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([_packed({k: got[k] for k in body})], pa.binary()), pa.ListArray.from_arrays(ends, rows.column(0)),
                     pa.ListArray.from_arrays(ends, pa.array(shown, pa.string())), _lists(got["pairs"]), _lists(got["times"]), pa.nulls(1, pa.list_(pa.int64()))], names=names)
                number += 1
        if vector is not None:
            lists = pa.nulls(1, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), lists, pa.nulls(1, pa.list_(pa.string())), lists, lists, _lists(vector)], names=names)

    return run


def _answered(total: np.ndarray, best: np.ndarray, to_b: np.ndarray, digest: bool):
    """Documents of blocks whose irregular pairs have their counts. total: the count of each identity pair, by A id; best: the
    highest count of each B id."""
    def run(batches):
        is_best = (total == best[to_b]) & (to_b >= 0)
        for batch in batches:
            for body, ids, groups, pairs, counts in zip(*(c.to_pylist() if i in (0, 4) else c for i, c in enumerate(batch.columns))):
                x = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body)))
                pair = pairs.values.to_numpy()
                count = np.zeros(len(pair), np.int64)
                if counts:
                    count[[c["i"] for c in counts]] = [c["n"] for c in counts]
                top = count == best[pair & LOW]
                of, same, pieces, per = x["of"], x["same"], x["pieces"], x["per"]
                n_best = sums(is_best[same], x["n_same"]) + sums(top[of], x["n_of"])
                count_sum = sums(total[same], x["n_same"]) + sums(count[of], x["n_of"])
                yield pa.RecordBatch.from_arrays(
                    [ids.values, *(pa.array(x[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(sums(n_best[pieces], per)),
                     pa.array(sums(count_sum[pieces], per)), groups.values], names=columns)

    columns = [x.split()[0] for x in RESULT.split(", ")]
    if not digest:
        columns[-1] = "groups"
    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False,
          block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), and the counted pairs (pair: A id * 2^32 + B id, n).
    ``groups`` reads ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is ``groups_sha256``, empty for a document without tokens."""
    spark = docs.sparkSession
    paths = (path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = stored(slim.mapInArrow(lean(_encoded(paths, digest, block_bytes), forget), BLOCKS), "align-blocks")
    al = aligner(*paths)
    to_b = al.identity
    # identity pairs: at most one for each A id
    found = blocks.where("vector is not null").select(F.posexplode("vector").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).collect()
    identity = spark.createDataFrame([(int(r.a << 32 | int(to_b[r.a])), r.n) for r in found], "pair long, n long")
    asked = blocks.where("block is not null")
    irregular = asked.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    totals = stored(irregular.unionByName(identity).groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    best = np.zeros(len(al.bytes_b.len) + 1, np.int64)
    for r in totals.groupBy(F.col("pair").bitwiseAND(LOW).alias("b")).agg(F.max("n").alias("n")).collect():  # one row for each B id
        best[r.b] = r.n
    total = np.zeros(len(to_b), np.int64)
    for r in totals.join(F.broadcast(identity.select("pair")), "pair", "left_semi").collect():  # at most one for each A id
        total[r.pair >> 32] = r.n
    answers = (asked.select("block", F.posexplode("pairs").alias("i", "pair")).join(totals, "pair")
               .groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("i", "n")).alias("counts")))
    rows = asked.join(answers, F.col("block") == F.col("of"), "left").select("body", "doc_ids", "groups", "pairs", "counts")
    schema = RESULT if digest else RESULT.replace("groups_sha256", "groups")
    return rows.mapInArrow(lean(_answered(total, best, to_b, digest)), schema), totals


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), digest=True)[0]
