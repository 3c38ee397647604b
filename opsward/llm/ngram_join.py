"""N-gram Jaccard join: documents that share at least 75 % of their five-word shingles, and their components.

The join is a sparse product of the document by n-gram incidence with itself, cut down by bounds that follow from
the sizes and computed in blocks:

1. One pass over the texts makes each document's set of 64-bit shingle hashes, its size and a 64-bit digest of the
   set. Documents with equal sets are one class, named by the digest, from here on; ids come back at the end.
2. Prefix bound: under any common order of the n-grams, two sets that reach the threshold meet among the first
   ``n - ceil(0.75 n) + 1`` of each. Only these columns of the incidence are shuffled, by n-gram, and multiplied
   there block by block: a small group gives its pairs at once, n-grams that meet no second document fall out, and
   large groups stay rows for step 4. The order puts rare n-grams first. Which are frequent is estimated from a
   hashed table of fixed size over a thirty-second of the documents; that estimate steers cost only, never the
   result.
3. Overlap counts are accumulated per pair. A pair needs ``3 / 7`` of both sizes in common; one that first meets at
   places p and q can have ``min(n - p, m - q)``, and one whose prefixes share c n-grams can have c and what lies
   behind the prefix. Other pairs are discarded before any set is looked at. Surviving pairs are verified exactly,
   in blocks of one document against its partners, again by accumulating overlaps over the block's incidence.
4. Pairs inside a component already found need no check. So star rounds over the large n-gram groups come first:
   every group offers a few pivots, every document is verified against the best of them, components are merged, until
   few pairs between different components are left or a round no longer helps. Then all pairs left between
   different components are checked. Large groups of near copies so cost rows in proportion to their documents,
   and no link between different components is ever left out.

Defined cases: null or empty texts have an empty set and are linked with nothing; a text of one to four words is one
shingle; rows without an id are classed like all, but link nothing and get a null component; rows that share an
id share a component, each text with its own links; an empty table gives no rows. Two different shingles share a hash
with probability 2**-64. A class is named by 64 bits of its set's digest, and 30 further bits and the size go with every
document: should one name stand for two sets, the job starts again with digests under another key.
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

from .common import byte_slices, components, lean, read, split_words, stored

SHINGLE = 5
SAMPLE_SHARE = 32
SKETCH_BITS = 21
FREQUENT = 8
PIVOTS = 6
MAX_ROUNDS = 2
PAIRS_PER_DOC = 16
LARGE_GROUP = 512
BLOCK_PARTNERS = 512
BLOCK_ROWS = 200_000
HELD_GROUP = 20_000
WIDE_BLOCK = 4096
SIGN_BITS = 1024
PAIRS_HELD = 200_000
BROADCAST_IDS = 200_000
COLD, SET, HOT, PAIR, MEETS = 0, 1, 2, 3, 4
CHECK = (1 << 30) - 1
FREQUENT_HELD = 1 << 60  # in np: the document holds frequent n-grams in its prefix
MET = "kind byte, token long, a long, b long, np long, mq long, lo long"
M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    distinct, codes, lens = split_words(pc.ascii_lower(texts))
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    h = word[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    starts = ends - lens
    full = h
    if len(h) >= SHINGLE:
        full = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            full = full * M + h[k: len(h) - SHINGLE + 1 + k]
        full = _mixed(full)
    out = []
    for a, n in zip(starts.tolist(), lens.tolist()):
        if n >= SHINGLE:
            s = np.sort(full[a: a + n - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for y in h[a: a + n]:
                    x = x * M + y
            out.append(_mixed(np.array([x + np.uint64(n)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest_of(s: np.ndarray, key: int = 0) -> tuple[int, int]:
    """The name of the class of documents with this set, and 30 further bits that tell sets of one name apart."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=12, key=key.to_bytes(4, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little") & CHECK


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1 if n else 0


def _level(sets: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _all_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in byte_slices(batch):
            sets = shingle_sets(rows.column(rows.schema.get_field_index("text")))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Per hash bucket the binary logarithm of the most documents of the sample that share an n-gram of it."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(SAMPLE_SHARE)) == 0)
    counts = sample.select("text").mapInArrow(lean(_all_hashes), "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    top = counts.groupBy(F.shiftrightunsigned("token", 64 - SKETCH_BITS).alias("bucket")).agg(F.max("count").alias("n"))
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in top.collect():  # at most a row per bucket
        sketch[r.bucket] = int(np.log2(r.n)) + 1
    return sketch


def _prefixes(sketch: np.ndarray, key: int = 0):
    """Rows (token, doc, np): a class's prefix n-grams with its size and their place, and for each document, by id, its
    class, with its size and check bits. The top bits of np are the kind. Copies inside a task emit their prefix once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows in byte_slices(batch):
                ids = rows.column(0).to_pylist()
                token, doc, place, masks = [], [], [], []
                for doc_id, s in zip(ids, shingle_sets(rows.column(1))):
                    n = len(s)
                    digest, check = digest_of(s, key)
                    token.append(np.array([digest], np.int64))
                    doc.append(doc_id)
                    place.append(np.array([SET << 61 | n << 30 | check], np.int64))
                    masks.append(1)
                    if not n or doc_id is None or digest in seen:
                        continue
                    seen.add(digest)
                    level = _level(s, sketch)
                    order = np.argsort(level, kind="stable")[: prefix_length(n)]
                    token.append(s[order].view(np.int64))
                    kind = np.where(level[order] > 0, HOT, COLD).astype(np.int64)
                    place.append(kind << 61 | n << 30 | np.arange(len(order)) | (FREQUENT_HELD if kind.any() else 0))
                    doc.append(digest)
                    masks.append(len(order))
                if not token:
                    continue
                take = pa.array(np.repeat(np.arange(len(masks)), masks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), pa.array(doc, pa.int64()).take(take), pa.array(np.concatenate(place))],
                    names=["token", "doc", "np"])
    return run


def _meeting(token, doc, n, p):
    """Pairs of rows of one n-gram that the size bounds leave: (a, b, n of a, n of b, whether the pair may meet here first).
    Rows are sorted by n-gram; every distance inside a group is one vectorised step."""
    out = []
    for d in range(1, len(token)):
        i = np.flatnonzero(token[d:] == token[:-d])
        if not len(i):
            break
        j = i + d
        ok = (doc[i] != doc[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        behind = np.minimum(n[i] - p[i], n[j] - p[j])
        need = 3 * (n[i] + n[j])
        ok = 7 * (np.minimum(p[i], p[j]) + behind) >= need
        i, j, first = i[ok], j[ok], (7 * behind >= need)[ok]
        swap = doc[i] > doc[j]
        x, y = np.where(swap, j, i), np.where(swap, i, j)
        out.append((doc[x], doc[y], n[x], n[y], first))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token -> the documents' digests, the rows of large groups, and the pairs that meet in small ones.
    Cold n-grams that only one row holds fall out. Holds back one group, and never more than a small one."""
    def batch(kind, token, a, b, np_, mq, lo):
        k = len(np_)
        cols = [np.full(k, kind, np.int8), token, a, b, np_, mq, lo]
        types = [pa.int8()] + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays([pa.nulls(k, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)],
                                          names=[x.split()[0] for x in MET.split(", ")])

    held, open_ = None, None  # rows of the last group so far; the large group that is passing through

    def groups(token, doc, place, last):
        """Small groups as pairs, large ones as rows; the last group is held back unless this is the end."""
        nonlocal held, open_
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        big = sizes >= LARGE_GROUP
        if open_ is not None and token[0] == open_:
            big[0] = True
        keep_back = 0
        if not last:
            if big[-1]:
                open_ = token[-1]
            else:
                open_, keep_back = None, sizes[-1]
        end = len(token) - keep_back
        held = (token[end:], doc[end:], place[end:]) if keep_back else None
        rows = np.repeat(big, sizes)[:end]
        if rows.any():
            yield batch(HOT, token[:end][rows], doc[:end][rows], None, place[:end][rows], None, None)
        small = ~rows & np.repeat(sizes > 1, sizes)[:end]
        if small.any():
            size = place[:end][small] >> 30 & (1 << 30) - 1
            marked = place[:end][small] & FREQUENT_HELD > 0
            if marked.any():
                ids, times = np.unique(doc[:end][small][marked], return_counts=True)
                yield batch(MEETS, None, ids, None, times, None, None)
            met = _meeting(token[:end][small], doc[:end][small], size, place[:end][small] & (1 << 30) - 1)
            if met:
                x, y, n, m, first = met
                yield batch(PAIR, None, x, y, n, m, first.astype(np.int64))

    for b in batches:
        kind = b.column(2).to_numpy() >> 61
        for k in (SET, HOT):
            part = b.filter(pa.array(kind == k)) if (kind == k).any() else None
            if part is not None:
                yield batch(k, part.column(0), part.column(1), None, part.column(2), None, None)
        cold = kind == COLD
        if cold.any():
            rows = b.filter(pa.array(cold))
            cols = [rows.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            yield from groups(*cols, False)
    if held is not None:
        yield from groups(*held, True)


def _sets(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(batch):
                sets = shingle_sets(rows.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(s, key)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["doc", "grams"])
    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (pivot row first, then its partners) -> the partners that reach the threshold, with the pivot."""
    key, pivots = None, []
    for batch in (small for whole in batches for small in byte_slices(whole, 4_000_000, "grams")):
        a, part, doc = (batch.column(i).to_numpy() for i in range(3))
        grams = batch.column(3)
        lens = pc.binary_length(grams).to_numpy() // 8
        cut = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(part) != 0)]) if len(a) else []
        found = []
        for lo, hi in zip(list(cut), [*cut[1:], len(a)]):
            if (a[lo], part[lo]) != key:
                key, pivots = (a[lo], part[lo]), []
            while lo < hi and batch.column(4)[int(lo)].as_py():
                pivots.append(np.frombuffer(grams[int(lo)].as_py(), np.uint64))
                lo += 1
            if lo == hi:
                continue
            flat = np.frombuffer(b"".join(grams.slice(lo, hi - lo).to_pylist()), np.uint64)
            owner = np.repeat(np.arange(hi - lo), lens[lo:hi])
            for p in pivots:
                if len(p):
                    at = np.searchsorted(p, flat)
                    at[at == len(p)] = 0
                    overlap = np.bincount(owner[p[at] == flat], minlength=hi - lo)
                    union = len(p) + lens[lo:hi] - overlap
                    found += [(int(a[lo]), int(d)) for d in doc[lo:hi][100 * overlap >= 75 * union]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Each partner's set goes to its pivot's block; a pivot with many
    partners has as many blocks as it needs."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_PARTNERS).cast("int").alias("blocks"))
    partners = (pairs.join(blocks, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
                .join(sets, F.col("b") == F.col("doc")).select("a", "part", F.col("b").alias("doc"), "grams", F.lit(False).alias("pivot")))
    pivots = (blocks.join(sets, F.col("a") == F.col("doc")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("a", "part", F.col("a").alias("doc"), "grams", F.lit(True).alias("pivot")))
    both = partners.union(pivots).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("pivot"))
    return both.mapInArrow(lean(_verified), "u long, v long")


def _possible(n, p, m, q):
    """The size bounds on a pair that meets at places p and q."""
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(n - p, m - q) >= 3 * (n + m))


def _enough(shared, n, m):
    """The prefix bound on a pair of sizes n and m whose prefixes share ``shared`` n-grams: of the set whose prefix ends
    first all other common n-grams lie behind its prefix."""
    behind = F.ceil(3 * F.greatest(n, m) / 4) - 1
    return 7 * (shared + behind) >= 3 * (n + m)


def _open(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows with their component c, of the n-grams that more than one component holds."""
    now = rows.withColumn("c", F.col("doc")) if comp is None else (
        rows.join(comp.withColumnRenamed("v", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component"))
    groups = now.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("token")
    return stored(now.join(groups, "token", "left_semi"), "join-open")


def _left(now: DataFrame) -> float:
    """Pairs between different components, over all n-grams."""
    size = now.groupBy("token", "c").count().groupBy("token").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    return float(size.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def _star(now: DataFrame, rnd: int) -> DataFrame:
    """For every document (b) of these rows the pivots (a) of its groups that share most n-grams with it."""
    x = now.alias("x")
    chosen = [F.min_by(F.struct("doc", "c", "n", "p"), F.xxhash64("doc", F.lit(PIVOTS * rnd + i))) for i in range(PIVOTS)]
    pivots = now.groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("z")).select("token", F.explode("z").alias("z")).alias("y")
    met = (x.join(pivots, (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("z.c"))
                  & _possible(F.col("x.n"), F.col("x.p"), F.col("z.n"), F.col("z.p")))
           .groupBy(F.col("x.doc").alias("b"), F.col("z.doc").alias("a")).agg(F.count("*").alias("shared")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("shared", "a")), asc=False), 1, PIVOTS)
    return met.groupBy("b").agg(best.alias("z")).select(F.explode("z.a").alias("a"), "b")


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of n-grams at a time, a row (block, doc, c, n, u, sign, tokens) for each document in it: the sparse product
    of its incidence with itself, row by row. A pair between two components is given with its overlap in the block, unless even all
    prefix n-grams that the two have outside the block would leave it below its size bound, or their signs differ in more
    bits than sets that reach the threshold can (each n-gram in only one of the sets turns one bit)."""
    def pairs(parts):
        ids, comp, size, spare = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(1, 5))
        sign = np.frombuffer(b"".join(x for p in parts for x in p.column(5).to_pylist()), np.uint64).reshape(len(ids), -1)
        token = np.concatenate([pc.list_flatten(p.column(6)).to_numpy() for p in parts])
        owner = np.repeat(np.arange(len(ids)), np.concatenate([pc.list_value_length(p.column(6)).to_numpy() for p in parts]))
        outside = np.minimum(size - -(-3 * size // 4) + 1, spare) - np.bincount(owner)
        _, column = np.unique(token, return_inverse=True)
        by_column = np.argsort(column, kind="stable")
        at = np.r_[0, np.cumsum(np.bincount(column))]
        postings = owner[by_column]
        by_row = np.argsort(owner, kind="stable")
        rows = np.r_[0, np.cumsum(np.bincount(owner))]
        out, held = [], 0

        def batch():
            a, b, n, m, shared = (np.concatenate(c).astype(np.int64) for c in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), n, m, shared)] + [pa.array(np.ones(len(a), bool))],
                                              names=["a", "b", "n", "m", "shared", "near"])

        for x in range(len(ids)):
            lists = [postings[at[k]: at[k + 1]] for k in column[by_row[rows[x]: rows[x + 1]]].tolist()]
            overlap = np.bincount(np.concatenate(lists), minlength=len(ids))
            overlap[: x + 1] = 0
            y = np.flatnonzero(overlap)
            y = y[(comp[y] != comp[x]) & (4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y]))]
            behind = -(-3 * np.maximum(size[x], size[y]) // 4) - 1
            y = y[7 * (overlap[y] + np.minimum(outside[x], outside[y]) + behind) >= 3 * (size[x] + size[y])]
            y = y[7 * np.bitwise_count(sign[x] ^ sign[y]).sum(1, dtype=np.int64) <= size[x] + size[y]]
            if len(y):
                out.append((np.full(len(y), ids[x]), ids[y], np.minimum(size[x], size[y]), np.maximum(size[x], size[y]), overlap[y]))
                held += len(y)
            if held > PAIRS_HELD:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    key, parts = None, []
    for batch in batches:
        block = batch.column(0).to_numpy()
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for lo, hi in zip(list(cut), [*cut[1:], len(block)]):
            if block[lo] != key:
                if parts:
                    yield from pairs(parts)
                key, parts = block[lo], []
            parts.append(batch.slice(int(lo), int(hi - lo)))
    if parts:
        yield from pairs(parts)


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, grams) -> (doc, sign): bit i tells whether an odd number of the set's hashes are i modulo the bits."""
    for whole in batches:
        for batch in byte_slices(whole, 4_000_000, "grams"):
            signs = [np.packbits((np.bincount((np.frombuffer(g, np.uint64) % np.uint64(SIGN_BITS)).astype(np.int64), minlength=SIGN_BITS) & 1).astype(np.uint8)).tobytes()
                     for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.binary())], names=["doc", "sign"])


def _every(now: DataFrame, meets: DataFrame, sets_of) -> DataFrame:
    """All pairs between two components that meet in these rows and that the bounds leave, with overlaps: blocks of
    n-grams that a task can hold are multiplied there; the documents of a still larger group are cut into blocks that meet
    two by two, so no task sees more than two of them. ``meets`` (doc, u) tells how many n-grams a document
    shares in small groups at most (where its rows are marked, f)."""
    keys = "a long, b long, n long, m long, shared long, near boolean"
    huge = now.groupBy("token").count().where(F.col("count") > HELD_GROUP).select("token", F.ceil(F.col("count") / WIDE_BLOCK).cast("int").alias("parts"))
    blocks = max(1, -(-now.count() // BLOCK_ROWS))
    # n-grams of a document that any other component can share
    spare = now.groupBy("doc").agg(F.count("*").alias("k"), F.max("f").alias("f")).join(meets, "doc", "left").select(
        "doc", F.when(F.col("f") > 0, F.col("k") + F.coalesce("u", F.lit(0))).otherwise(1 << 30).alias("spare"))
    signs = sets_of(now.select(F.col("doc").alias("needed"))).select("doc", "grams").mapInArrow(lean(_signs), "doc long, sign binary")
    held = (now.join(huge, "token", "left_anti").groupBy(F.pmod(F.xxhash64("token"), F.lit(blocks)).alias("block"), "doc")
            .agg(F.min("c").alias("c"), F.min("n").alias("n"), F.collect_list("token").alias("tokens"))
            .join(spare, "doc").join(signs, "doc").select("block", "doc", "c", "n", "spare", "sign", "tokens"))
    out = held.repartition("block").sortWithinPartitions("block").mapInArrow(lean(_product), keys)
    if huge.isEmpty():
        return out
    wide = now.join(huge, "token").withColumn("at", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = wide.withColumn("row", F.col("at")).withColumn("column", others).alias("x")
    y = wide.withColumn("row", others).withColumn("column", F.col("at")).alias("y")
    n, p, m, q = (F.col(c) for c in ("x.n", "x.p", "y.n", "y.p"))
    aligned = 7 * (F.least(p, q) + F.least(n - p, m - q)) >= 3 * (n + m)
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.column") == F.col("y.column")) & (F.col("x.c") < F.col("y.c")) & (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & aligned
    return out.union(x.join(y, meet).select(F.least("x.doc", "y.doc"), F.greatest("x.doc", "y.doc"), F.least(n, m), F.greatest(n, m),
                                            F.lit(1).cast("long"), _possible(n, p, m, q)))


def link(rows: DataFrame, met: DataFrame, meets: DataFrame, n_docs: int, sets_of) -> DataFrame | None:
    """Components (v, component) of the classes, from the rows (token, doc, n, p, f) of large groups and the pairs (a, b, n, m,
    near), a row per n-gram, that met in small ones; ``sets_of`` gives the sets of documents."""
    links, comp, before = None, None, None

    def add(pairs: DataFrame) -> DataFrame | None:
        nonlocal links
        pairs = stored(pairs, "join-pairs")
        if pairs.isEmpty():
            return comp
        new = stored(verify(pairs, sets_of(pairs.select(F.col("a").alias("needed")).union(pairs.select("b")))), "join-links")
        links = new if links is None else links.union(new)
        return components(links, "join-cc")

    now = _open(rows, comp)
    for rnd in range(MAX_ROUNDS):
        left = _left(now)
        if left <= PAIRS_PER_DOC * n_docs or before is not None and left > 0.6 * before:
            break
        before = left
        comp = add(_star(now, rnd))
        now = _open(now.drop("c"), comp)  # components only grow: a group that one holds stays closed
    pairs = (met.withColumn("shared", F.lit(1).cast("long")).unionByName(_every(now, meets, sets_of)).groupBy("a", "b")
             .agg(F.sum("shared").alias("shared"), F.max("near").alias("near"), F.min("n").alias("n"), F.min("m").alias("m"))
             .where(F.col("near") & _enough(F.col("shared"), F.col("n"), F.col("m"))).select("a", "b"))
    if comp is not None:
        label = comp.select(F.col("v"), F.col("component").alias("c"))
        pairs = (pairs.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left")
                 .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    return add(pairs)


def hinted(ids: DataFrame) -> DataFrame:
    """Stored ids, broadcast if their count allows it; else Spark chooses, and the texts are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def classes(docs: DataFrame, key: int = 0) -> tuple[DataFrame, DataFrame | None, int]:
    """(doc, n, class) of every row, the components of the classes, and the key under which digests name them."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = F.shiftright("np", 61)
    n, p = F.shiftright("np", 30).bitwiseAND((1 << 30) - 1), F.col("np").bitwiseAND((1 << 30) - 1)
    slot = F.when(kind == HOT, F.xxhash64("token", "doc")).when(kind == SET, F.xxhash64("doc")).otherwise(F.col("token"))
    met = stored(d.mapInArrow(lean(_prefixes(frequency_sketch(d), key)), "token long, doc long, np long")
                 .repartition(slot).sortWithinPartitions("token").mapInArrow(lean(_shared), MET), "join-prefix")
    named = met.where(F.col("kind") == SET)
    of = F.struct(n, p)
    if not named.groupBy("token").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low <> high").isEmpty():
        return classes(docs, key + 1)
    whole = named.select(F.col("a").alias("doc"), n.alias("n"), F.col("token").alias("class"))
    rows = (met.where(F.col("kind") == HOT).select("token", F.col("a").alias("doc"), n.alias("n"), p.alias("p"), F.col("np").bitwiseAND(FREQUENT_HELD).alias("f"))
            .groupBy("token", "doc").agg(F.min("n").alias("n"), F.min("p").alias("p"), F.max("f").alias("f")))
    # u: how many n-grams a class shares in small groups at most
    meets = met.where(F.col("kind") == MEETS).select(F.col("a").alias("doc"), F.col("np").alias("k")).groupBy("doc").agg(F.sum("k").alias("u"))
    meets = stored(meets, "join-meets")
    pairs = met.where(F.col("kind") == PAIR).select("a", "b", F.least("np", "mq").alias("n"), F.greatest("np", "mq").alias("m"), (F.col("lo") == 1).alias("near"))
    first = whole.where("n > 0").groupBy("class").agg(F.min("doc").alias("id"))

    def sets_of(ids: DataFrame) -> DataFrame:
        needed = stored(ids.distinct().join(first, F.col("needed") == F.col("class")).select("needed", "id"), "join-needed")
        texts = d.join(hinted(needed.select("id").distinct()), F.col("doc_id") == F.col("id"), "left_semi").select("text")
        sets = stored(texts.mapInArrow(lean(_sets(key)), "doc long, grams binary"), "join-sets", "none")
        return sets.join(hinted(needed.select("needed")), F.col("doc") == F.col("needed"), "left_semi")  # an id may have further texts

    return whole, link(stored(rows, "join-rows"), pairs, meets, whole.count(), sets_of), key


def classed(docs: DataFrame, name: str, key: int) -> DataFrame:
    """``docs`` with each row's class under ``key`` (null: no words) appended as ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(batch):
                of = [digest_of(s, key)[0] if len(s) else None for s in shingle_sets(rows.column(rows.schema.get_field_index("text")))]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(of, pa.int64())], names=[*rows.schema.names, name])

    return docs.mapInArrow(lean(run), docs.limit(0).withColumn(name, F.lit(None).cast("long")).schema)


def grouped(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, n, class, group) of every row, and the key of the classes; rows without an id or a word have no group."""
    whole, comp, key = classes(docs)
    whole = whole.withColumn("class", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("class")))
    if comp is None:
        return stored(whole.withColumn("group", F.col("class")), "join-groups"), key
    return stored(whole.join(comp.withColumnRenamed("v", "class"), "class", "left")
                  .select("doc", "n", "class", F.coalesce("component", "class").alias("group")), "join-groups"), key


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, _ = grouped(docs)
    at = rows.where("group is not null").groupBy("doc").agg(F.min("group").alias("group"), F.max("group").alias("other"))
    at = stored(at, "join-ids")
    if not at.where("group <> other").isEmpty():  # ids with several texts: their groups are one component
        several = rows.where("group is not null").select("doc", F.col("group").alias("v")).join(at.where("group <> other"), "doc")
        merged = stored(components(several.select(F.col("group").alias("u"), "v"), "join-merged"), "join-merge").toDF("group", "into")
        at = at.join(merged, "group", "left").select("doc", F.coalesce("into", "group").alias("group"))
    low = at.groupBy("group").agg(F.min("doc").alias("component"))
    named = at.join(low, "group").select("doc", "component")
    return rows.join(named, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                                                 F.coalesce("component", "doc").alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN z USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)"""
