"""Embedding near-duplicates by product quantisation.

Index: vectors are scaled to length 1 and equal ones folded into one class. Coarse centroids (spherical k-means)
and one codebook per subspace of the residuals are trained on a bounded sample (``SAMPLE_PER_LIST`` vectors a list,
the first by a hash); every class is then indexed: its list, its residual codes and the length of its
quantisation error. Lists longer than ``BLOCK_ROWS`` are cut into blocks by a hash of the id.

Search: every class is a query. It goes to its own list and to every list that can hold a partner, whatever the
direction of the partner's offset: from list i to list j if x . (c_i - c_j) <= sqrt(1 - t^2) |c_i - c_j| (else all
vectors within the threshold angle lie nearer to c_i) and if the angle to c_j is at most the list's largest plus the
threshold angle. In a block, table lookups give the asymmetric distance to each member; with the stored error lengths
as slack no partner in the block is lost. What is left is reranked by the exact cosine in double precision. Both ends
of a pair meet the rule, so only one goes to the other's list, by the order of the lists round a ring; a pair inside a
list is counted by the query with the smaller id.

Only link counts and spanning stars leave a task, so a group of copies or near copies costs rows in proportion to
its members. No pair is left out; on vectors spread evenly over many dimensions the rule keeps most lists, so the work
comes near to that of all pairs there (figures in the README).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
kept; vectors of different length never link (each length has an index of its own); equal vectors always link;
repeated rows are vectors of their own, linked as equal ones; rows without an id link with nothing and have a null
component and kept false; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _forest, at_most, components, read, stored

THRESHOLD = 0.95
SAMPLE_PER_LIST = 32
LEAST_LISTS, MOST_LISTS = 8, 4096
SUBSPACES = 8
CODEWORDS = 256
BLOCK_ROWS = 2048
PROBE_ROWS = 16384
SEED = 9
UNIT = "vec_id long, digest string, dim int, vec binary"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as little-endian doubles of length 1 with a digest of the given components."""
    import hashlib
    for b in batches:
        ids, dims, vecs, digests = [], [], [], []
        for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ok = bool(v) and None not in v
            a = np.array(v if ok else [0.0], np.float64)
            top = np.abs(a).max() if np.isfinite(a).all() else 0.0
            ids.append(vec_id)
            if top > 0 and vec_id is not None:
                u = a / top
                u /= np.sqrt(u @ u)
                dims.append(len(a))
                vecs.append(u.astype("<f8").tobytes())
                digests.append(hashlib.sha256((a + 0.0).astype("<f8").tobytes()).hexdigest())
            else:
                dims.append(None)
                vecs.append(None)
                digests.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(dims, pa.int32()),
                                          pa.array(vecs, pa.binary())], names=["vec_id", "digest", "dim", "vec"])


def _kmeans(x: np.ndarray, k: int, rng, spherical: bool, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(y @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))).argmax(1) for y in np.array_split(x, max(1, len(x) // 8192))])
        n = np.bincount(near, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        c[n > 0] = new[n > 0] / n[n > 0, None]
        if spherical:
            c /= np.maximum(1e-12, np.sqrt((c * c).sum(1, keepdims=True)))
    return c


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.centroids = _kmeans(sample, min(lists, len(sample)), rng, True)
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), subspaces) if len(p)]
        residual = sample - self.centroids[self.nearest(sample)]
        self.books = [_kmeans(residual[:, p], min(codewords, len(sample)), rng, False) for p in self.parts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T).argmax(1)

    def codes(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of the error they leave."""
        r = x - self.centroids[at]
        out = np.zeros((len(x), len(self.parts)), np.uint8)
        for j, (p, book) in enumerate(zip(self.parts, self.books)):
            out[:, j] = (r[:, p] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
            r[:, p] -= book[out[:, j]]
        return out, np.sqrt((r * r).sum(1))

    def probes(self, x: np.ndarray, threshold: float, own: np.ndarray | None = None, least_dot: np.ndarray | None = None) -> list[np.ndarray]:
        """All lists that can hold a partner of each query. ``own`` is the queries' list, ``least_dot`` the smallest
        cosine of a member with its centroid, per list."""
        dots = x @ self.centroids.T
        if own is None:
            own = dots.argmax(1)
        gap = np.take_along_axis(dots, own[:, None], 1) - dots
        apart = np.sqrt(np.maximum(0, 2 - 2 * (self.centroids[own] @ self.centroids.T)))
        near = gap <= np.sqrt(1 - threshold**2) * apart + 1e-7
        if least_dot is not None:
            widest = np.minimum(np.pi, np.arccos(np.clip(least_dot, -1, 1)) + np.arccos(threshold))
            near &= dots >= np.cos(widest) - 1e-7
        near[np.arange(len(x)), own] = True
        return [np.flatnonzero(row) for row in near]


def _asks(own: int, lists: np.ndarray, n: int) -> np.ndarray:
    """Of each two lists one asks the other: the one that reaches it in fewer steps round the ring of lists."""
    steps = (lists - own) % n
    return lists[(2 * steps < n) | ((2 * steps == n) & (own < lists))]


def _table(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _indexer(q: Quantiser):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _table(b.column(2))
                at = q.nearest(x)
                codes, err = q.codes(x, at)
                dot = np.einsum("ij,ij->i", x, q.centroids[at])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(err, pa.float64()), pa.array(dot, pa.float64())], names=["vec_id", "copies", "vec", "list", "codes", "err", "dot"])
    return run


def _prober(q: Quantiser, threshold: float, blocks: np.ndarray, least_dot: np.ndarray):
    """A row for each block that a query goes to; ``own`` tells that it is in the query's list."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                b = batch.slice(start, 1024)
                at = b.column(3).to_numpy()
                to = [_asks(i, p, len(blocks)) for i, p in zip(at, q.probes(_table(b.column(2)), threshold, at, least_dot))]
                rows = np.repeat(np.arange(len(to)), [int(blocks[p].sum()) for p in to])
                lists = np.concatenate([np.repeat(p, blocks[p]) for p in to])
                part = np.concatenate([np.arange(blocks[i]) for p in to for i in p])
                for s in range(0, len(rows), PROBE_ROWS):
                    some = slice(s, s + PROBE_ROWS)
                    take, n = pa.array(rows[some]), len(rows[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists[some], pa.int32()), pa.array(part[some], pa.int32()), pa.array(np.ones(n, bool)), b.column(0).take(take),
                         b.column(1).take(take), b.column(2).take(take), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()),
                         pa.array(lists[some] == at[rows[some]])],
                        names=["list", "block", "query", "vec_id", "copies", "vec", "codes", "err", "own"])
    return run


def _links(q: Quantiser, list_no: int, members: dict, ids: np.ndarray, x: np.ndarray, own: np.ndarray, threshold: float):
    """(query, member) places of the linked pairs of one block: table lookups, then exact cosines."""
    reach = np.sqrt(2 - 2 * threshold)
    shifted = x - q.centroids[list_no]
    dist = np.zeros((len(x), len(members["id"])))
    for j, (p, book) in enumerate(zip(q.parts, q.books)):
        s = shifted[:, p]
        lookup = (s * s).sum(1)[:, None] - 2 * (s @ book.T) + (book * book).sum(1)
        dist += lookup[:, members["codes"][:, j]]
    maybe = np.sqrt(np.maximum(dist, 0)) <= reach + members["err"] + 1e-9
    maybe &= np.where(own[:, None], ids[:, None] < members["id"], ids[:, None] != members["id"])
    a, b = np.nonzero(maybe)
    exact = np.einsum("ij,ij->i", x[a], members["x"][b])
    keep = exact >= threshold
    return a[keep], b[keep]


def _searcher(q: Quantiser, threshold: float):
    """Blocks of members (first) and queries, sorted -> link counts (v = -1) and, by spanning stars, edges (n = 0)."""
    def run(batches):
        def edges_and_counts():
            key, parts, members = None, [], None
            for batch in batches:
                lists, block, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                n = len(lists)
                if not n:
                    continue
                cut = np.flatnonzero(np.r_[True, (np.diff(lists) != 0) | (np.diff(block) != 0) | (query[1:] != query[:-1])])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), n]):
                    rows = batch.slice(a, b - a)
                    if (lists[a], block[a]) != key:
                        key, parts, members = (lists[a], block[a]), [], None
                    if not query[a]:
                        parts.append(rows)
                        continue
                    if members is None and parts:
                        cols = [np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (3, 4, 7)]
                        members = {"id": cols[0], "copies": cols[1], "err": cols[2], "x": np.concatenate([_table(p.column(5)) for p in parts]),
                                   "codes": np.frombuffer(b"".join(c for p in parts for c in p.column(6).to_pylist()), np.uint8).reshape(len(cols[0]), -1)}
                    if members is None:
                        continue
                    for s in range(0, rows.num_rows, 256):
                        part = rows.slice(s, 256)
                        ids, copies = part.column(3).to_numpy(), part.column(4).to_numpy()
                        i, j = _links(q, int(lists[a]), members, ids, _table(part.column(5)), part.column(8).to_numpy(zero_copy_only=False), threshold)
                        if len(i):
                            yield ids[i], members["id"][j], copies[i], members["copies"][j]

        held: list = []

        def counted():
            ids = np.concatenate([x for x, _ in held])
            n = np.concatenate([x for _, x in held])
            held.clear()
            names, at = np.unique(ids, return_inverse=True)
            return names, np.bincount(at, n, len(names)).astype(np.int64)

        def stars():
            for u, v, cu, cv in edges_and_counts():
                held.append((np.r_[u, v], np.r_[cv, cu]))
                if sum(len(x) for x, _ in held) > 1_000_000:
                    held.append(counted())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in _forest(stars()):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.zeros(b.num_rows, np.int64))], names=["u", "v", "n"])
        if held:
            ids, n = counted()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), -1)), pa.array(n)], names=["u", "v", "n"])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector (vec_id, embedding): n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                  .mapInArrow(_unit, UNIT), "pq-unit")
    classes = stored(rows.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("dim").alias("dim")), "pq-classes")
    found = None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        part = classes.where(F.col("dim") == r.dim).select("vec_id", "copies", "vec")
        place = F.xxhash64("vec", F.lit(SEED))
        lists = int(np.clip(np.sqrt(r.n), LEAST_LISTS, MOST_LISTS))
        wanted = SAMPLE_PER_LIST * lists
        sample = sorted((s.h, s.vec) for s in part.select("vec", place.alias("h")).where(F.col("h") <= at_most(wanted, r.n)).collect())[:wanted]
        q = Quantiser(np.array([np.frombuffer(v, "<f8") for _, v in sample]), lists)
        index = stored(part.mapInArrow(_indexer(q), "vec_id long, copies long, vec binary, list int, codes binary, err double, dot double"), "pq-index")
        sizes, least_dot = np.zeros(len(q.centroids), np.int64), np.ones(len(q.centroids))
        for x in index.groupBy("list").agg(F.count("*").alias("n"), F.min("dot").alias("dot")).collect():  # a row per list
            sizes[x.list], least_dot[x.list] = x.n, x.dot
        blocks = -(-sizes // BLOCK_ROWS)
        cut = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "list int, blocks int")
        block_of = F.pmod(F.xxhash64("vec_id"), F.greatest("blocks", F.lit(1))).cast("int")
        members = index.join(F.broadcast(cut), "list").select("list", block_of.alias("block"), F.lit(False).alias("query"), "vec_id", "copies", "vec", "codes", "err", F.lit(True).alias("own"))
        queries = index.select("vec_id", "copies", "vec", "list").mapInArrow(
            _prober(q, threshold, blocks, least_dot),
            "list int, block int, query boolean, vec_id long, copies long, vec binary, codes binary, err double, own boolean")
        both = members.union(queries).repartition("list", "block").sortWithinPartitions("list", "block", "query")
        got = stored(both.mapInArrow(_searcher(q, threshold), "u long, v long, n long"), "pq-links")
        found = got if found is None else found.union(got)
    if found is None:
        found = spark.createDataFrame([], "u long, v long, n long")
    joined = components(found.where("n = 0").select("u", "v"), "pq-cc").select(F.col("v").alias("vec_id"), "component")
    counts = found.where("n > 0").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n"))
    classes = (classes.select("digest", "vec_id", "copies").join(counts, "vec_id", "left").join(joined, "vec_id", "left")
               .select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    out = rows.select("vec_id", "digest").join(classes, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_pq(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


# Every pair, as the reference for a table of this size.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""
