"""Secret scan: base patterns plus a linear-chain conditional random field.

Tokens of a text are tagged O (outside), B (a secret begins) or I (inside). A token's emission is a sum of
learnt weights of its shape, of its neighbours' shapes (two before, one after) and of file features (shares of
digits and of symbols in the whole text); transitions tie the chain, and Viterbi finds the best tagging.

The field is fitted on the driver by AdaGrad on the exact log-likelihood (forward-backward) of windows from a
bounded sample of documents (``FIT_HITS`` that hold a base finding, ``FIT_PLAIN`` others, the first by a
hash), labelled by the base patterns. It then generalises by shape and context: secrets that no base
pattern names are found, and spans that overlap no base finding are added.

Decoding is exact and vectorised: emissions depend on token signatures only and are gathered from tables. A
token whose O score leads by more than any change of transitions could win back is O in every best path; only
the short runs between such tokens go through Viterbi, all runs of a slice side by side.

Defined cases: null or empty texts have no findings; one row per input row, repeated and null ids included;
texts are read whole, a very long one as a slice of its own; an empty table gives no rows, and a corpus
without any base finding a model that adds nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most, lean, ragged_positions, read, text_slices

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN = re.compile(r"[\w+/-]+(?:\.[\w+/-]+)*|[^\w\x20\x09-\x0D+/-]")
FIT_HITS, FIT_PLAIN = 1500, 1500
FIT_CHARS = 20_000
FIT_MIXED, FIT_WINDOWS = 4, 6  # a text's windows round mixed tokens that are no secrets, and all of its windows
SEEN = r"AKIA[A-Z0-9]{14}|(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{12}"
WINDOW = 12
ADDED_LEAST = 12
ROUNDS = 80
OFFSETS = (0, -1, -2, 1)
FILE_BUCKETS = 8
CACHE_WORDS = 120_000
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the base findings, in order."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """Character ranges that hold the secrets themselves, for labels."""
    got = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ASSIGN.search(text) else []
    return got + [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]


def features(token: str) -> tuple[str, ...]:
    """Shape features of a token."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return (f"sym:{token}",)
    case = "l" if token.islower() else "U" if token.isupper() else "T" if token.istitle() else "m"
    size = f"len{min(int(2 * math.log2(n + 1)), 14)}"
    low = token.lower()
    named = tuple(f"key:{k}" for k in KEYWORDS if k in low)
    if token.isalpha():
        return ("alpha", f"a-{case}", f"a-{size}", *named)
    digits = sum(c.isdigit() for c in token)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3 for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(token).values())
    return ("mixed", f"m-{case}", size, f"d{10 * digits // n}", f"turns{min(turns, 12)}", f"ent{int(2 * entropy)}",
            f"hex{int(all(c in '0123456789abcdef' for c in token))}", f"plain{int(token.isalnum())}",
            f"{size}-ent{int(2 * entropy)}", f"lead:{''.join('9' if c.isdigit() else c for c in token[:4])}" if n >= 12 else "short", *named)


def _file_bucket(text: str, tokens: int, mixed: int) -> int:
    """Bucket of a whole text: share of tokens with digits or symbols, and whether braces or semicolons occur."""
    share = mixed / max(1, tokens)
    return min(3, int(8 * share)) * 2 + int("{" in text or ";" in text)


class Field:
    """Weights of the field: one row per feature and offset, file buckets, transitions."""

    def __init__(self, names: list[str]):
        self.names = {x: i for i, x in enumerate(names)}
        self.w = np.zeros((len(OFFSETS), len(names), 3))
        self.file = np.zeros((FILE_BUCKETS, 3))
        self.t = np.zeros((3, 3))
        self.bias = np.zeros(3)

    def rows(self, feats: tuple[str, ...]) -> np.ndarray:
        """(offset, 3) contribution of a token to the emissions around it."""
        ids = [self.names[f] for f in feats if f in self.names]
        return self.w[:, ids].sum(1)


BAN = np.zeros((3, 3))
BAN[0, 2] = -1e9  # O before I


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _spread(places: list[int], most: int, text: str) -> list[int]:
    """At most so many of the places, chosen by a hash of text and place."""
    if len(places) <= most:
        return places
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return sorted(sorted(places, key=lambda i: (zlib.crc32(b"%d:%d" % (seed, i)), i))[:most])


def fit(samples: list[str], rounds: int = ROUNDS) -> Field:
    """Fits the field on windows of labelled texts."""
    sigs: dict[tuple, int] = {}
    wins, labels, files, masks = [], [], [], []
    length = 2 * WINDOW + 1
    for text in samples:
        marks = _secret_parts(text)
        toks, tags = [], []
        was = False
        for m in TOKEN.finditer(text):
            inside = any(a < m.end() and m.start() < b for a, b in marks) if marks else False
            tags.append(0 if not inside else 2 if was else 1)
            was = inside
            toks.append(sigs.setdefault(features(m[0]), len(sigs)))
        odd = [i for i, s in enumerate(toks) if tags[i] == 1]
        rev = list(sigs)
        odd += _spread([i for i, s in enumerate(toks) if not tags[i] and rev[s][0] == "mixed"], FIT_MIXED, text)
        if not odd and toks:
            odd = [len(toks) // 2]
        bucket = _file_bucket(text, len(toks), sum(rev[s][0] != "alpha" for s in toks))
        for i in _spread(odd, FIT_WINDOWS, text):
            lo = max(0, i - WINDOW)
            s, t = toks[lo: lo + length], tags[lo: lo + length]
            if t and t[0] == 2:
                t[0] = 1
            pad = length - len(s)
            wins.append(s + [-1] * pad)
            labels.append(t + [0] * pad)
            masks.append([1] * len(s) + [0] * pad)
            files.append(bucket)
    count = Counter(f for s in sigs for f in s)
    names = sorted(count)
    field = Field(names)
    if not wins or not any(1 in t for t in labels):
        return field
    m = np.zeros((len(sigs) + 1, len(names)))
    for s, i in sigs.items():
        m[i, [field.names[f] for f in s]] = 1
    win, y, mask, bucket = np.array(wins), np.array(labels), np.array(masks), np.array(files)
    win[win < 0] = len(sigs)
    n = len(win)
    shifted = []
    for o in OFFSETS:  # token at t + o contributes to the emission at t
        s = np.full_like(win, len(sigs))
        s[:, max(0, -o): length - max(0, o)] = win[:, max(0, o): length - max(0, -o)]
        shifted.append(s)
    onehot = np.eye(3)[y] * mask[..., None]
    grads = [np.full_like(x, 1e-6) for x in (field.w, field.file, field.t, field.bias)]
    params = [field.w, field.file, field.t, field.bias]
    for _ in range(rounds):
        em = field.bias + field.file[bucket][:, None, :] + sum((m @ field.w[k])[shifted[k]] for k in range(len(OFFSETS)))
        t = field.t + BAN
        fwd, bwd = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        fwd[0] = em[:, 0] + np.array([0, 0, -1e9])
        for k in range(1, length):
            new = _lse(fwd[k - 1][:, :, None] + t[None], 1) + em[:, k]
            fwd[k] = np.where(mask[:, k, None] > 0, new, fwd[k - 1])
        for k in range(length - 2, -1, -1):
            new = _lse(t[None] + (em[:, k + 1] + bwd[k + 1])[:, None, :], 2)
            bwd[k] = np.where(mask[:, k + 1, None] > 0, new, bwd[k + 1])
        z = _lse(fwd[-1], 1)
        p = np.exp(fwd + bwd - z[None, :, None]).transpose(1, 0, 2) * mask[..., None]
        gt = np.zeros((3, 3))
        for k in range(1, length):
            pair = np.exp(fwd[k - 1][:, :, None] + t[None] + (em[:, k] + bwd[k])[:, None, :] - z[:, None, None]) * mask[:, k, None, None]
            gt += pair.sum(0) - np.einsum("ni,nj->ij", onehot[:, k - 1] * mask[:, k, None], onehot[:, k])
        diff = p - onehot
        gw = np.zeros_like(field.w)
        for k in range(len(OFFSETS)):
            by_sig = np.zeros((len(sigs) + 1, 3))
            np.add.at(by_sig, shifted[k].ravel(), diff.reshape(-1, 3))
            gw[k] = m.T @ by_sig
        gf = np.zeros_like(field.file)
        np.add.at(gf, bucket, diff.sum(1))
        for x, g, acc, decay in zip(params, (gw, gf, gt, diff.sum((0, 1))), grads, (1e-1, 1e-1, 1e-2, 0)):
            g = g + decay * x
            acc += g * g
            x -= 0.4 * g / np.sqrt(acc)
    field.t += BAN
    return field


def viterbi(em: np.ndarray, t: np.ndarray, starts: np.ndarray, lens: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray) -> np.ndarray:
    """Best tags of the runs [starts, starts + lens) of ``em``. A run is preceded and followed by O, or by the end
    of its text; runs are worked through side by side, longest first."""
    tags = np.zeros(len(em), np.int8)
    order = np.argsort(-lens, kind="stable")
    starts, lens, doc_start, doc_end = starts[order], lens[order], doc_start[order], doc_end[order]
    begin = np.where(doc_start[:, None], np.array([0, 0, -1e9]), t[0])
    score = begin + em[starts]
    back = []
    steps = int(lens[0])
    alive = [int(np.searchsorted(-lens, -k, side="right")) for k in range(1, steps + 1)]  # runs with at least k tokens
    final = score.copy()
    for k in range(1, steps):
        a = alive[k]
        cand = score[:a, :, None] + t[None]
        back.append(cand.argmax(1).astype(np.int8))
        score = cand.max(1) + em[starts[:a] + k]
        final[:a] = score
    final = final + np.where(doc_end[:, None], 0, t[:, 0])
    state = final.argmax(1)
    for k in range(steps - 1, -1, -1):
        a = alive[k]
        tags[starts[:a] + k] = state[:a]
        if k:
            state[:a] = back[k - 1][np.arange(a), state[:a]]
    return tags


class Tagger:
    """Applies a field to slices of texts; keeps signature tables and a bounded cache of words."""

    def __init__(self, field: Field):
        self.field = field
        self.words: dict[bytes, int] = {}
        self.sigs: dict[tuple, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(OFFSETS), 3))
        self.mixed: list[bool] = []
        self.reset()
        self.lead = self._lead(field.t)

    @staticmethod
    def _lead(t: np.ndarray) -> float:
        """Most that any path can gain in transitions by having B or I at a token instead of O (then a following
        I becomes B)."""
        ok = t > -1e8
        before = max([0.0] + [t[a, s] - t[a, 0] for a in range(3) for s in (1, 2) if ok[a, s]])
        turn = max([0.0] + [t[2, c] - t[1, c] for c in range(3)])
        after = max([0.0] + [t[s, b] - t[0, 1 if b == 2 else b] + (turn if b == 2 else 0) for s in (1, 2) for b in range(3)])
        return float(before + after)

    def reset(self):
        self.words.clear()
        self.first: list[int] = [0]
        self.flat: list[int] = []

    def _sig(self, feats):
        i = self.sigs.get(feats)
        if i is None:
            i = self.sigs[feats] = len(self.rows)
            self.rows.append(self.field.rows(feats))
            self.mixed.append(feats[0] != "alpha")
        return i

    def _add(self, word: bytes) -> int:
        for token in TOKEN.findall(word.decode("utf-8", "surrogatepass")):
            self.flat.append(self._sig(features(token)))
        i = self.words[word] = len(self.first) - 1
        self.first.append(len(self.flat))
        return i

    def tags(self, texts: list) -> list[list[int]]:
        """Per text the numbers of its tokens tagged B or I, with the tag: [(token, tag)]."""
        if len(self.words) > CACHE_WORDS:
            self.reset()
        known, add = self.words, self._add
        codes, n_words = [], []
        for t in texts:
            w = (t or "").encode("utf-8", "surrogatepass").split()
            codes += [known[x] if x in known else add(x) for x in w]
            n_words.append(len(w))
        if not codes or not self.flat:
            return [[] for _ in texts]
        codes = np.array(codes, np.int64)
        first = np.array(self.first, np.int64)
        lens = first[codes + 1] - first[codes]
        sig = np.array(self.flat, np.int64)[ragged_positions(first[codes], lens)]
        per_doc = np.add.reduceat(np.r_[lens, 0], np.minimum(np.r_[0, np.cumsum(n_words)[:-1]], len(lens)))
        per_doc = np.where(np.array(n_words) > 0, per_doc, 0)
        doc = np.repeat(np.arange(len(texts)), per_doc)
        if len(self.table) != len(self.rows):
            self.table = np.array(self.rows)
            self.is_mixed = np.array(self.mixed)
        mixed = np.bincount(doc[self.is_mixed[sig]], minlength=len(texts))
        bucket = np.array([_file_bucket(t or "", int(n), int(m)) for t, n, m in zip(texts, per_doc, mixed)])
        em = self.field.bias + self.field.file[bucket][doc] + self.table[sig, 0]
        for k, o in enumerate(OFFSETS):
            if o:
                here = slice(max(0, -o), len(sig) - max(0, o))
                there = slice(max(0, o), len(sig) - max(0, -o))
                same = doc[here] == doc[there]
                em[here] += self.table[sig[there], k] * same[:, None]
        after = np.r_[np.maximum(0, em[1:, 2] - em[1:, 1]), 0]
        open_ = em[:, 0] - np.maximum(em[:, 1], em[:, 2]) <= self.lead + after
        if not open_.any():
            return [[] for _ in texts]
        idx = np.flatnonzero(open_)
        new = np.r_[True, (np.diff(idx) > 1) | (doc[idx[1:]] != doc[idx[:-1]])]
        starts = idx[new]
        lens = np.diff(np.r_[np.flatnonzero(new), len(idx)])
        edge = np.r_[-1, doc, -1]
        ds = edge[starts] != doc[starts]
        de = edge[starts + lens + 1] != doc[starts + lens - 1]
        tags = viterbi(em, self.field.t, starts, lens, ds, de)
        out = [[] for _ in texts]
        origin = np.cumsum(per_doc) - per_doc
        for i in np.flatnonzero(tags).tolist():
            out[doc[i]].append((i - int(origin[doc[i]]), int(tags[i])))
        return out

    def spans(self, texts: list) -> list[list[tuple[int, int, str]]]:
        """All findings per text: the base ones and those of the field that overlap none of them."""
        out = []
        for t, tagged in zip(texts, self.tags(texts)):
            if not t:
                out.append([])
                continue
            base = base_spans(t)
            if tagged:
                want = dict(tagged)
                cur = None
                added = []
                for i, m in enumerate(TOKEN.finditer(t)):
                    tag = want.get(i, 0)
                    if cur and tag == 2:
                        cur[1] = m.end()
                    else:
                        if cur:
                            added.append(cur)
                        cur = [m.start(), m.end()] if tag else None
                if cur:
                    added.append(cur)
                base = sorted(base + [(a, 3, b) for a, b in added if b - a >= ADDED_LEAST
                                      and not any(x < b and a < y for x, _, y in base)])
            out.append(base)
        return out


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit_sample(docs: DataFrame, hits: int = FIT_HITS, plain: int = FIT_PLAIN) -> list[str]:
    """The bounded sample: documents with a base finding, and others, first by a hash of id and text."""
    d = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    found = F.col("text").rlike(SEEN)
    n = d.agg(F.count(F.when(found, 1)).alias("hits"), F.count(F.lit(1)).alias("all")).first()
    top_hit, top_plain = at_most(hits, n.hits), at_most(plain, n["all"] - n.hits)
    # repeated rows share a hash and are one; a longer text gives FIT_CHARS characters round its first finding, or at a place by hash
    free = F.pmod(F.col("h"), F.greatest(F.length("text") - FIT_CHARS, F.lit(0)) + 1).cast("int") + 1
    start = F.when(F.col("hit"), F.greatest(F.regexp_instr("text", F.lit(SEEN)) - FIT_CHARS // 2, F.lit(1))).otherwise(free)
    got = (d.where(F.col("h") <= max(top_hit, top_plain)).withColumn("hit", found)
           .where(F.when(F.col("hit"), F.col("h") <= top_hit).otherwise(F.col("h") <= top_plain))
           .select("hit", "h", F.col("text").substr(start, F.lit(FIT_CHARS)).alias("text")).dropDuplicates(["h"]).collect())
    rows = sorted((not r.hit, r.h, r.text) for r in got)
    return [t for miss, _, t in rows if not miss][:hits] + [t for miss, _, t in rows if miss][:plain]


def fit_field(docs: DataFrame) -> Field:
    return fit(fit_sample(docs))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: counts of the base findings, their digest, all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            for rows, texts in text_slices(batch, 1_000_000):
                found = tagger.spans(texts)
                base = [[x for x in f if x[1] < 3] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0)] + [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(3)]
                    + [pa.array([hashlib.sha256(_shown(f).encode()).hexdigest() for f in base]), pa.array([_shown(f) for f in found])],
                    names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)


def redact(docs: DataFrame, field: Field, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding in the text replaced by ``mark`` (overlapping findings by one)."""
    def cover(text, spans):
        out, at = [], 0
        for a, _, b in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for rows, texts in text_slices(batch, 1_000_000):
                new = [cover(t, s) if s else t for t, s in zip(texts, tagger.spans(texts))]
                yield rows.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, fit_field(docs))
