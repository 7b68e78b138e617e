"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id, its text and its place among rows equal in both. For each source the words are summed by
source and the first 12 hash bits, the bucket in which the source's budget ends is
found, and only that bucket is refined by its next 12 bits; what is left of it is
settled by whole hashes. The result is one hash threshold a source: a filter, never a
sort of the documents, and nested (a larger budget keeps what a smaller one took).

A source with target t and size s takes every document floor(t / s) times, and one
more time those whose hash is at most the threshold; the threshold's last hash is taken
if more than half of it fits.

Cases: null text has size 0; null source is a source of its own, the last one; null id
counts as the empty text. Rows equal in id, source and text are numbered, so each has a
hash of its own and groups without ids or of one repeated id are split like any other. No rows, or only empty ones: every target is 0. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, global_index, id_text, split_words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: A target never exceeds this many times its source.
MOST = 2.0
STEP = 12


#: Equal rows that one row of the numbering stands for.
BLOCK = 10_000


def row_hash(doc_id: Column, digest: Column, occurrence: Column) -> Column:
    """The first 60 bits of the md5 of the id's text, the text's md5 and the place among equal rows."""
    own = F.concat_ws("/", id_text(doc_id), digest, occurrence.cast("string"))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def first_hash() -> Column:
    """The hash of a document (doc_id, text) as the first of its equal rows."""
    return row_hash(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), F.lit(0))


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size, weight) plus target. Sources whose share exceeds
    ``most`` times their size stop there and the rest is shared again until none is above;
    each round is one aggregate, so the driver holds three numbers."""
    level = 0.0
    while True:
        stopped = F.col("weight") * F.lit(level) > most * F.col("source_size")
        total, done, free = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(stopped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (share * total - most * done) / free if free else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(most * F.col("source_size"), F.col("weight") * F.lit(level)))


def boundary(rows: DataFrame, budget: DataFrame, shift: int) -> DataFrame:
    """For each source of ``budget`` (source, rest, lo, before) the bucket of its next hash
    bits in which ``rest`` ends: its first hash as lo, the words before it as before. A source
    whose bucket isn't among the rows drops out: all its rows fit."""
    sums = rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("g"))
    upto = F.sum("g").over(Window.partitionBy("source").orderBy("b"))
    b = budget.select(F.col("source").alias("_s"), "rest", F.col("before").alias("_before"))
    found = (
        sums.withColumn("upto", upto).join(b, F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("upto") + F.col("_before") > F.col("rest"))
        .groupBy("source").agg(F.min(F.struct("b", "upto", "g", "rest", "_before")).alias("m"))
    )
    return found.select("source", F.col("m.rest").alias("rest"), F.shiftleft("m.b", shift).alias("lo"), (F.col("m.upto") - F.col("m.g") + F.col("m._before")).alias("before"))


def _inside(rows: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
    e = edge.select(F.col("source").alias("_s"), F.col("lo").alias("_lo"))
    return rows.join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("h", shift) == F.shiftright("_lo", shift))).drop("_s", "_lo")


def bounds(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, top) from (source, size, h): a document is taken
    ``whole`` times, and once more if its hash is at most ``top``."""
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_index(per, F.col("source").asc_nulls_last(), name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    goal = targets(cut(ranked.withColumn("weight", weight), "sources"), share, most)
    goal = cut(
        goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets"
    )
    first = cut(boundary(slim, goal.select("source", "rest", F.lit(0).cast("long").alias("before")), 60 - STEP), "edge")
    second = cut(boundary(_inside(slim, first, 60 - STEP), first, 60 - 2 * STEP), "edge")
    left = _inside(slim, second, 60 - 2 * STEP).groupBy("source", "h").agg(F.sum("size").alias("g"))
    e = second.select(F.col("source").alias("_s"), "rest", "lo", "before")
    upto = F.sum("g").over(Window.partitionBy("source").orderBy("h"))
    last = (
        left.withColumn("upto", upto).join(e, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source", "lo").agg(F.max(F.when(2 * (F.col("upto") + F.col("before")) - F.col("g") <= 2 * F.col("rest"), F.col("h"))).alias("top"))
        .select(F.col("source").alias("_s"), F.coalesce("top", F.col("lo") - 1).alias("top"))
    )
    # without an edge everything fits, unless nothing is left to take
    top = F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce("top", F.lit((1 << 60) - 1)))
    return cut(goal.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", top.alias("top")), "bounds")


def sizes(docs: DataFrame, size: Column | None = None, numbered: bool = True) -> DataFrame:
    """(doc_id, source, size, h), as a table; ``size`` defaults to the words of the text. Equal rows are
    counted and numbered in blocks, without a window, so a group of any size stays spread; not
    ``numbered``, they share the hash of the first."""
    sized = F.size(split_words(F.col("text"))).cast("long") if size is None else size.cast("long")
    if not numbered:
        return cut(docs.select("doc_id", "source", sized.alias("size"), first_hash().alias("h")), "mix")
    each = docs.select("doc_id", "source", sized.alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("_t"))
    groups = each.groupBy("doc_id", "source", "size", "_t").agg(F.count("*").alias("_m"))
    blocks = groups.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(BLOCK).cast("long"))))
    alone = blocks.where(F.col("_m") <= BLOCK)
    many = blocks.where(F.col("_m") > BLOCK).repartition("doc_id", "_t", "_from")
    rows = alone.unionByName(many).withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + BLOCK, F.col("_m")) - 1)))
    return cut(rows.select("doc_id", "source", "size", row_hash(F.col("doc_id"), F.col("_t"), F.col("_k")).alias("h")), "mix")


def with_copies(rows: DataFrame, bound: DataFrame, h: Column) -> DataFrame:
    """``rows`` (with source) plus source_size, target and copies."""
    b = bound.withColumnRenamed("source", "_s")
    rows = rows.drop("source_size", "target", "copies", "whole", "top", "_s", "_h")
    joined = rows.withColumn("_h", h).join(b, F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("copies", F.col("whole") + (F.col("_h") <= F.col("top")).cast("long")).drop("_s", "_h", "whole", "top")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, size: Column | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of every document."""
    slim = sizes(docs, size)
    mixed = with_copies(slim, bounds(slim, weights, share, most), F.col("h"))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


WORDS_SQL = r"length(list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

#: The same mix from a sort: the level is the highest that any prefix of stopped sources gives.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL.format("text")} AS size,
                  ('0x' || substr(md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')),
                    CAST(row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS VARCHAR))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s),
c AS (SELECT k, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM r),
l AS (SELECT max((1.5::DOUBLE * total - 2.0::DOUBLE * done) / free) AS level FROM c),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target FROM s, l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
g AS (SELECT d.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND 2 * upto - own <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM g
"""
