"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The pieces of many texts that are not in the cache yet are laid out as one flat array of byte symbols with
their piece numbers. A round looks up every neighbouring pair by binary search over the sorted pair keys, takes
the lowest rank of each piece, merges all of its places (left to right where they overlap) and closes the gaps;
pieces without a mergeable pair leave the array. That is the order the merge list prescribes, since a merge
can only use symbols of lower rank.

The vocabulary file is named by ``path``, read on each worker and never copied. Special tokens inside a text
become their ids, as the reference library does by default; decoding gives their text back.

Defined cases: a null text is the empty text (no ids); one row per input row, repeated and null ids included;
texts are encoded whole, a very long one as a slice of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ragged_positions, read, text_slices

VOCABULARY = "byte_bpe_50k.json"
CACHE_PIECES = 200_000
NONE = np.iinfo(np.int64).max
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with a bounded cache of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.zeros(256, np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        texts = [b""] * size
        for token, i in vocab.items():
            texts[i] = bytes(chars[c] for c in token)
            if len(texts[i]) == 1:
                self.byte_ids[texts[i][0]] = i
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], np.arange(len(keys))[order], merged[order]
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.reset()

    def reset(self):
        """Empties the cache; special tokens are always in it."""
        self.cache: dict[str, int] = {}
        self.flat = np.array(list(self.special.values()), np.int64)
        self.at = np.arange(len(self.special))
        self.len = np.ones(len(self.special), np.int64)
        self.special_at = {s: i for i, s in enumerate(self.special)}

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of ids of each piece."""
        lens = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), lens)
        done_sym, done_word = [], []
        while len(sym):
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = np.where(word[1:] == word[:-1], sym[:-1] << 32 | sym[1:], -1)
            slot = np.searchsorted(self.keys, key)
            slot[slot == len(self.keys)] = 0
            rank = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < NONE, count)
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
            take = open_ & (rank == np.repeat(least, count))
            at = np.flatnonzero(take)
            if len(at):
                run = np.r_[True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])]
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(run, i, 0))) % 2 == 0]
                sym[at] = self.merged[slot[at]]
                open_[at + 1] = False
            sym, word = sym[open_], word[open_]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(pieces))

    def _pieces(self, text: str) -> list:
        if self.specials is None or not self.specials.search(text):
            return self.split.findall(text)
        out: list = []
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(("special", part))
            else:
                out += self.split.findall(part)
        return out

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.cache) > CACHE_PIECES:
            self.reset()
        cache, new, codes, n = self.cache, [], [], []
        base = len(self.at)
        for t in texts:
            pieces = self._pieces(t or "")
            n.append(len(pieces))
            for p in pieces:
                c = cache.get(p)
                if c is None:
                    if type(p) is tuple:
                        c = self.special_at[p[1]]
                    else:
                        c = cache[p] = base + len(new)
                        new.append(p.encode("utf-8", "surrogatepass"))
                codes.append(c)
        if new:
            ids, lens = self.merge(new)
            self.at = np.r_[self.at, len(self.flat) + np.cumsum(lens) - lens]
            self.len = np.r_[self.len, lens]
            self.flat = np.r_[self.flat, ids]
        codes = np.array(codes, np.int64)
        lens = self.len[codes] if len(codes) else codes
        ids = self.flat[ragged_positions(self.at[codes], lens)] if len(codes) else codes
        ends = np.r_[0, np.cumsum(lens)][np.cumsum(n)]
        return ids, np.diff(np.r_[0, ends])

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are no UTF-8 become replacement characters."""
        size = self.token_len[ids]
        raw = self.token_bytes[ragged_positions(self.token_at[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.cumsum(lens)].tolist()
        out = [raw[a:b] for a, b in zip([0] + ends[:-1], ends)]
        for i, x in enumerate(out):
            try:
                x.decode()
            except UnicodeDecodeError:
                out[i] = x.decode("utf-8", "replace").encode()
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, made once a worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def forget() -> None:
    """Empties the caches of a worker's codecs."""
    for c in _CODECS.values():
        c.reset()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text; one row per document with digests of both."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for rows, texts in text_slices(batch, 1_000_000):
                ids, lens = c.encode(texts)
                raw = ids.astype("<u4").tobytes()
                ends = (4 * np.cumsum(lens)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(lens, pa.int64()),
                     pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0] + ends[:-1], ends)], pa.string()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(ids, lens)], pa.string())],
                    names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run, forget), RESULT)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        c = codec(path)
        for batch in batches:
            for rows, texts in text_slices(batch, 1_000_000):
                ids, lens = c.encode(texts)
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lens)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([raw[a:b] for a, b in zip([0] + ends[:-1], ends)], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run, forget), "doc_id long, ids binary")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        c = codec(path)
        for batch in batches:
            parts = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            ids = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            texts = c.decode(ids, np.array([len(p) for p in parts], np.int64)) if parts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in texts], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
