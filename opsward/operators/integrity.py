"""Constraint integrity: validate, tag, divert, cascade, pending sets, FK closure, prefix resolution."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark import StorageLevel

from .lineage import durable


def fk_violations(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose (non-NULL) key has no parent; a NULL key passes (SQL semantics)."""
    p = parent.select(*[F.col(pk).alias(ck) for pk, ck in zip(parent_keys, child_keys)])
    non_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in child_keys])
    return child.where(non_null).join(p, child_keys, "left_anti")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once, with the count (aggregate + join back)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).where(F.col("dup_count") > 1)
    return df.join(dup, keys, "inner")


def check_violations(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the check is FALSE (UNKNOWN passes, as in SQL)."""
    return df.where(F.coalesce(~predicate, F.lit(False)))


def tag_violations(df: DataFrame, fk: list[tuple[str, DataFrame, list[str], list[str]]] | None = None,
                   unique: list[tuple[str, list[str]]] | None = None,
                   checks: list[tuple[str, Column]] | None = None) -> DataFrame:
    """One pass that adds ``_reasons`` (array of constraint names violated by the row)."""
    out = df
    flags = []
    for i, (name, parent, ck, pk) in enumerate(fk or []):
        m = f"_fk{i}"
        p = parent.select(*[F.col(a).alias(b) for a, b in zip(pk, ck)]).distinct().withColumn(m, F.lit(True))
        out = out.join(p, ck, "left")
        non_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ck])
        flags.append(F.when(non_null & F.col(m).isNull(), F.lit(name)))
    for i, (name, keys) in enumerate(unique or []):
        m = f"_uq{i}"
        d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(m)).where(F.col(m) > 1)
        out = out.join(d, keys, "left")
        flags.append(F.when(F.col(m).isNotNull(), F.lit(name)))
    for name, pred in checks or []:
        flags.append(F.when(F.coalesce(~pred, F.lit(False)), F.lit(name)))
    reasons = F.filter(F.array(*flags), lambda x: x.isNotNull())
    helper = [c for c in out.columns if c.startswith("_fk") or c.startswith("_uq")]
    return out.withColumn("_reasons", reasons).drop(*helper).select(*df.columns, "_reasons")


def divert(df_tagged: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, exception rows shaped like the source + n1_timestamp + n2_info)."""
    bad = F.size("_reasons") > 0
    good = df_tagged.where(~bad).drop("_reasons")
    exc = df_tagged.where(bad).select(*[c for c in df_tagged.columns if c != "_reasons"],
                                      as_of.alias("n1_timestamp"),
                                      F.array_join(F.array_sort("_reasons"), ",").alias("n2_info"))
    return good, exc


def divert_cascade(tables: dict[str, DataFrame], order: list[str],
                   edges: list[tuple[str, list[str], str, list[str]]],
                   own_checks: dict[str, Column]) -> dict[str, DataFrame]:
    """Exceptions flow from failing rows to all their descendants, whatever the shape of the foreign keys.

    ``edges``: (child, child_keys, parent, parent_keys). A row is diverted if it fails its own check or references
    a diverted parent row; ``order`` names the tables. Rounds run to the fixed point: each round joins only the
    parents diverted in the round before, so cycles and self-references end; each round is stored. A last pass
    names all reasons of every row, its own check first, then its parents in the order of the edges.
    """
    unknown = {t for c, _, p, _ in edges for t in (c, p)} - set(order)
    if unknown:
        raise ValueError(f"edges name tables that are not in the order: {sorted(unknown)}")
    fresh = {t: durable(tables[t].where(F.coalesce(~own_checks[t], F.lit(False))).withColumn("reason", F.lit("check")))
             for t in order if t in own_checks}
    out = dict(fresh)
    while fresh:
        nxt = {}
        for t in order:
            mine = [(i, e) for i, e in enumerate(edges) if e[0] == t and e[2] in fresh]
            if not mine:
                continue
            cur, reasons = tables[t], []
            for i, (_, ck, parent, pk) in mine:
                m = f"_p{i}"
                bad = fresh[parent].select(*[F.col(a).alias(b) for a, b in zip(pk, ck)]).distinct().withColumn(m, F.lit(True))
                cur = cur.join(bad, ck, "left")
                reasons.append(F.when(F.col(m).isNotNull(), F.lit(f"parent:{parent}")))
            hit = cur.withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), ",")).where(F.col("reason") != "")
            hit = hit.select(*tables[t].columns, "reason")
            if t in out:
                seen, cols = out[t].drop("reason"), tables[t].columns
                s = seen.select(*[F.col(c).alias(f"_s_{c}") for c in cols])
                same = reduce(lambda a, b: a & b, [hit[c].eqNullSafe(s[f"_s_{c}"]) for c in cols])
                hit = hit.join(s, same, "left_anti")
            hit = durable(hit)
            if not hit.isEmpty():
                nxt[t] = hit
        for t, hit in nxt.items():
            out[t] = out[t].unionByName(hit) if t in out else hit
        fresh = nxt
    result = {}
    for t in order:
        cur, reasons = tables[t], []
        if t in own_checks:
            reasons.append(F.when(F.coalesce(~own_checks[t], F.lit(False)), F.lit("check")))
        for i, (_, ck, parent, pk) in enumerate(e for e in edges if e[0] == t and e[2] in out):
            m = f"_p{i}"
            bad = out[parent].select(*[F.col(a).alias(b) for a, b in zip(pk, ck)]).distinct().withColumn(m, F.lit(True))
            cur = cur.join(bad, ck, "left")
            reasons.append(F.when(F.col(m).isNotNull(), F.lit(f"parent:{parent}")))
        reason = F.array_join(F.array_compact(F.array(*reasons)), ",") if reasons else F.lit("")
        result[t] = cur.withColumn("reason", reason).where(F.col("reason") != "").select(*tables[t].columns, "reason")
    return result


def pending_set(catalog: DataFrame, refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged tables ∪ flagged parents having flagged children; with ``limit`` the first ones by (schema, name).

    ``catalog``: tabschema, tabname, pending; ``refs``: tabschema, tabname (child),
    reftabschema, reftabname (parent).  The second branch is a subset of the first
    but is kept, as in the original statement; the order is made total by name.
    """
    flagged = catalog.where(F.col("pending")).select("tabschema", "tabname")
    flagged_children = refs.join(flagged, ["tabschema", "tabname"], "left_semi").select(
        F.col("reftabschema").alias("tabschema"), F.col("reftabname").alias("tabname"))
    parents = flagged.join(flagged_children, ["tabschema", "tabname"], "left_semi")
    out = flagged.unionByName(parents).distinct()
    return out if limit is None else out.orderBy("tabschema", "tabname").limit(limit)


def closure(spark: SparkSession, start: DataFrame, edges: DataFrame,
            node: str = "name", child: str = "child", parent: str = "parent",
            checkpoint_every: int = 4) -> DataFrame:
    """All nodes reachable from ``start`` along child->parent edges, with their BFS depth.

    Frontier iteration: each round joins only the new frontier with the (cached,
    pre-partitioned) edges and anti-joins what is already reached.  Frontiers are
    persisted; every ``checkpoint_every`` rounds (and at the end) the reached set
    is cut from its lineage with a durable checkpoint, so plans stay small and a
    lost executor recomputes at most a few rounds.  Only the frontier's
    emptiness reaches the driver.
    """
    # hash-partitioned once by the join key and cached: later rounds only shuffle the frontier
    e = (edges.select(F.col(child).alias("name"), F.col(parent).alias("next")).distinct()
         .repartition("name").persist(StorageLevel.MEMORY_AND_DISK))
    frontier = durable(start.select(F.col(node).alias("name")).distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    cached = []
    for r in count(1):  # every round reaches new nodes, so this ends
        nxt = (frontier.join(e, "name").select(F.col("next").alias("name")).distinct()
               .join(reached.select("name"), "name", "left_anti")
               .withColumn("depth", F.lit(r))).persist(StorageLevel.MEMORY_AND_DISK)
        cached.append(nxt)
        if nxt.isEmpty():
            break
        reached = reached.unionByName(nxt)
        frontier = nxt
        if r % checkpoint_every == 0:
            reached = durable(reached)
            frontier = reached.where(F.col("depth") == r)
    out = durable(reached)
    for c in cached:
        c.unpersist()
    e.unpersist()
    return out


def resolve_prefix(truncated: DataFrame, catalog: DataFrame, schema_col: str, name_col: str,
                   trunc_col: str) -> DataFrame:
    """Complete truncated names by prefix within their schema: 0 / 1 / many candidates.

    The prefix test is an equi-join on (schema, prefix): a catalog name is exploded only into prefixes of the
    lengths that its schema's truncated names have, at whatever width the names were cut.
    """
    t = truncated.select(F.col(schema_col).alias("_s"), F.col(trunc_col).alias("_p")).distinct()
    lengths = t.select("_s", F.length("_p").alias("_l")).distinct()
    name = F.col(name_col)
    cat = (catalog.select(F.col(schema_col).alias("_s"), name.alias("_name")).join(lengths, "_s")
           .where(F.length("_name") >= F.col("_l")).select("_s", F.substring(F.col("_name"), F.lit(1), F.col("_l")).alias("_p"), "_name"))
    # candidates counted per (schema, prefix) before the join: the join is then one-to-one
    cand = cat.groupBy("_s", "_p").agg(F.count("_name").alias("_n"), F.min("_name").alias("_first"))
    agg = t.join(cand, ["_s", "_p"], "left").select(
        "_s", "_p", F.coalesce(F.col("_n"), F.lit(0)).alias("n_matches"), "_first")
    return agg.select(
        F.col("_s").alias(schema_col), F.col("_p").alias(trunc_col), "n_matches",
        F.when(F.col("n_matches") == 0, "none").when(F.col("n_matches") == 1, "unique").otherwise("ambiguous").alias("resolution"),
        F.when(F.col("n_matches") == 1, F.col("_first")).alias("resolved"))


def export_exceptions(exceptions: DataFrame, path: str) -> str:
    """Exception rows as delimited files (header, ISO timestamps) on shared storage."""
    (exceptions.write.mode("overwrite").option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path
