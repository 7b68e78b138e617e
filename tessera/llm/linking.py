"""Groups from verified links, without listing all pairs of a group and without any
group, link or label list on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_hashes


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id that can be reached.
    Alternates large-star and small-star steps; a step is two aggregations and joins on slim
    rows, and its result is a table in the shared folder."""
    edges = cut_hashes(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        if state == seen or state[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = cut_hashes(small.distinct(), "edges")


#: All pairs of different components are compared once they are at most so many for each entry, or once a round
#: leaves more than this share of them.
FEW, LITTLE = 2, 0.7


def connect(entries: DataFrame, order: list[str], may: Callable[[str, str], str], verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, root) of the ids in ``entries`` (key, id, and columns that ``may`` needs; one row a
    key and id) that links join. A link is a pair that shares a key, for which ``may`` (a SQL
    condition on two aliases) holds, and that ``verify`` (pairs (a, b) to linked pairs) confirms.

    Every round holds the members of a key against one of them, which is linear in the group: in
    the first round against the first by ``order``, later against the first that isn't in the
    component of the least root. Once few pairs of different components are left, or rounds
    take few of them away, those are compared, each pair once: by ``across``, if given, from the
    rows of keys with several components to links (key, id, root, lo and the columns ``carried``), else
    in a join. No pair that could join two components is left out."""
    extra = [c for c in entries.columns if c not in ("key", "id")]
    first = F.min(F.struct(*order, *[c for c in ("id", "root", *extra) if c not in order])).alias("p")
    labelled = entries.withColumn("root", F.col("id"))
    kept = entries.columns if across is None else ["key", "id", *carried]
    compared, roots, rest, before, turn = None, None, None, math.inf, 0
    while True:
        mixed = labelled if turn == 0 else rest if across is None else entries.join(rest.select("key", "id", "root", "lo"), ["key", "id"])
        centre = mixed.where(F.lit(True) if turn == 0 else F.expr("root <> lo")).groupBy("key").agg(first).select("key", "p.*")
        star = (
            mixed.alias("l").join(centre.alias("r"), "key").where("l.root <> r.root").where(may("l", "r"))
            .select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
        )
        star = cut_hashes(star if compared is None else star.join(compared, ["a", "b"], "left_anti"), "star")
        links = cut_hashes(verify(star), "links")
        compared = star if compared is None else compared.union(star)
        roots = components(links if roots is None else links.union(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
        labelled = cut_hashes(entries.select(*kept).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "labelled")
        # keys of one component only are done with
        low = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "lo")
        rest = cut_hashes(labelled.join(low, "key"), "rest")
        parts = rest.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("q"))
        left = parts.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.lit(0.0))).first()[0]
        n = labelled.count()
        if left <= FEW * n or left > LITTLE * before:
            break
        before, turn = left, turn + 1
    if not left:
        return roots
    if across is None:
        meet = (F.col("l.key") == F.col("r.key")) & (F.col("l.root") < F.col("r.root")) & F.expr(may("l", "r"))
        pairs = (
            rest.alias("l").join(rest.alias("r"), meet)
            .select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
            .join(compared, ["a", "b"], "left_anti")
        )
        found = verify(cut_hashes(pairs, "across"))
    else:
        found = across(rest)
    more = cut_hashes(found, "links")
    return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
