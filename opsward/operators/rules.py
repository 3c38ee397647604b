"""Rule resolution by specificity (host -> instance -> database), as equi-joins on unique keys.

A rule has one of four shapes, ``(*,*,*)``, ``(h,*,*)``, ``(h,i,*)``, ``(h,i,d)``; rules of any other shape (``*:i:*``)
never match. Within a shape and key the last line wins, so the rules are first reduced to one line per key; a more
specific shape overrides a less specific one. Each shape is then one left join on a unique key: an entity never
meets more than four lines, however many lines a key has, and an entity without any rule stays, with defaults.
The three shapes with wildcards are small and end up broadcast by their measured size; only the database shape
is a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY = "*"


def _lines(rules: DataFrame, spec: int, match_cols: list[str], value_cols: list[str], names: DataFrame | None = None) -> DataFrame:
    """The last line per key of one shape: k0..k2 (its fixed parts), match columns, ``_r<spec>``. With ``names`` (the entities'
    k0..k2) a line stands for every name that its parts contain."""
    parts = ["host", "instance", "dbname"]
    shaped = rules
    for i, p in enumerate(parts):
        shaped = shaped.where(F.col(p) != ANY if i < spec else F.col(p) == ANY)
    if names is not None:
        shaped = _contained(shaped, spec, names)
    keys = [F.col(p if names is None else f"_k{i}").alias(f"_k{i}") for i, p in enumerate(parts[:spec])]
    best = F.max_by(F.struct("line_no", *value_cols), F.col("line_no")).alias(f"_r{spec}")
    return shaped.groupBy(*keys, *match_cols).agg(best)


def _contained(rules: DataFrame, spec: int, names: DataFrame) -> DataFrame:
    """A row for each rule and each name in its fixed parts: every part is cut into its pieces of the lengths that names have,
    and only pieces that are names go on. The work grows with the lines and their length, not with lines times names."""
    for i, p in enumerate(["host", "instance", "dbname"][:spec]):
        lengths = [r[0] for r in names.select(F.length(f"_k{i}").alias("n")).where("n > 0").distinct().collect()]  # few: names are short
        if not lengths:
            return rules.limit(0).withColumns({f"_k{j}": F.lit(None).cast("string") for j in range(i, spec)})
        pieces = F.flatten(F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: F.when(F.length(p) >= n, F.transform(
            F.sequence(F.lit(1), F.length(p) - n + 1), lambda at: F.substring(F.col(p), at, n))).otherwise(F.array().cast("array<string>"))))
        on = [f"_k{j}" for j in range(i + 1)]
        rules = rules.withColumn(f"_k{i}", F.explode(F.array_distinct(pieces))).join(names.select(*on).distinct(), on, "left_semi")
    return rules


def resolve(entities: DataFrame, rules: DataFrame, entity_cols: list[str], value_cols: list[str],
            match_cols: list[str] | None = None, host: str = "host", instance: str = "instance",
            dbname: str = "dbname", how: str = "last", defaults: dict[str, object] | None = None, match: str = "exact") -> DataFrame:
    """One row per entity (and per ``match_cols``, such as the check kind).

    ``rules`` carries ``host, instance, dbname, line_no`` (lower-cased, '*' = any), the ``match_cols`` and the
    ``value_cols``. ``how='last'`` gives line_no and values of the most specific last line; an entity that no rule
    matches has a null line_no and the ``defaults`` (null where there is none). ``how='concat'`` concatenates the
    levels' comma lists (exclusion lists; null if there is none). ``match='contains'`` lets a part of a rule stand for every
    name that it contains (``srv1,srv2`` for both, but ``nation12`` for ``nation1`` too).
    """
    match_cols = match_cols or []
    e = entities.select(*dict.fromkeys([*entity_cols, *match_cols]), F.lower(F.col(host)).alias("_k0"),
                        F.lower(F.col(instance)).alias("_k1"), F.lower(F.col(dbname)).alias("_k2"))
    if match not in ("exact", "contains"):
        raise ValueError(match)
    names = e.select("_k0", "_k1", "_k2").distinct() if match == "contains" else None
    for spec in range(4):
        lines, on = _lines(rules, spec, match_cols, value_cols, names), [*[f"_k{i}" for i in range(spec)], *match_cols]
        # without anything to match on there is one line for all
        e = e.join(lines, on, "left") if on else e.withColumn("_r0", lines.scalar())
    found = [F.col(f"_r{s}") for s in (3, 2, 1, 0)]
    if how == "last":
        r = F.coalesce(*found)
        values = [F.when(r.isNull(), F.lit(defaults[c])).otherwise(r[c]).alias(c) if defaults and c in defaults else r[c].alias(c)
                  for c in value_cols]
        return e.select(*entity_cols, *match_cols, r["line_no"].alias("line_no"), *values)
    if how == "concat":
        (col,) = value_cols
        lists = F.filter(F.array(*[c[col] for c in reversed(found)]), lambda x: x.isNotNull())
        return e.select(*entity_cols, *match_cols, F.when(F.size(lists) > 0, F.array_join(lists, ",")).alias(col))
    raise ValueError(how)
