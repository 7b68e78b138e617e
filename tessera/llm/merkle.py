"""A Merkle manifest of a dataset, labelled by nested intervals.

Every row is a leaf, hashed over its columns. The leaves of a group (a language) are ranked
by id; runs of two nodes become their parent until one is left, the group's subroot, and the
subroots make a last tree whose top is the root. A node carries the half-open interval of
the leaf ranks that it covers and those of its children, so

* the ancestors of a leaf are the nodes whose intervals contain its rank: a join of leaves
  with nodes, bucketed by ``LEVELS`` levels. Within such a bucket a node and all below it
  belong to one aligned block of 2**LEVELS entries, so the join meets on the block and its
  condition is the containment; what lies above the block is joined once a block;
* the siblings on the way are a parent's interval less the own interval: the children that
  end before the leaf, and those that begin after it.

A tree is built a bucket of levels at a time: one aggregate by block, some log64(rows) in
all, each 64 times smaller than the one before. Ranks come from a range partitioning and the
counts of its partitions; a group of any size, and equal rows, are spread over partitions.

Cases: a null column hashes as ``-``; a null language is a group of its own, the first; null
ids come first in their group and are never tampered with; rows of equal ids rank by leaf,
and equal rows are interchangeable; a null n_chars stays null when tampered with, so its
leaf stays too; texts may have any length; an empty table has no rows and no root. A lone
leaf is its group's subroot, a lone subroot the root. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bind, cut, own_columns

#: Levels that one round builds and one containment join attaches.
LEVELS = 6
#: Children of a node.
RUN = 2
#: The columns that a leaf is made of, in order.
HASHED = ("doc_id", "source", "lang", "n_chars", "text")

_KIDS = "array<struct<lo:bigint,hi:bigint,digest:string>>"
_NODES = f"array<struct<level:int,lo:bigint,hi:bigint,digest:string,kids:{_KIDS}>>"
_PATH = "array<struct<level:int,before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def measured(value: Column) -> Column:
    """A value as its byte count, a colon and itself; ``-`` for null. No two lists of values look the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return digest(*[measured(changed.get(c, F.col(c))) for c in HASHED])


def group_key(lang: Column) -> Column:
    """A key without nulls that sorts as the language does: null, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``part``, a group) plus rank, 0-based in the group by ``part, *order``, and n, the
    rows of the group. Range partitions are sorted each by itself; the rows of a group that
    lie in partitions before come from their counts."""
    placed = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_slice", F.shiftright("_at", 33)), "ranked")
    runs = placed.groupBy("part", "_slice").agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    mine = Window.partitionBy("part")
    before = F.coalesce(F.sum("_rows").over(mine.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(runs.select("part", "_slice", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(mine).alias("n")), "starts")
    return placed.join(starts, ["part", "_slice"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_slice", "_shift")


def entries_of(rows: DataFrame) -> DataFrame:
    """Ranked rows (with ``digest``) as the entries of the lowest level: each covers its own rank."""
    return rows.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1, "block": F.shiftright("rank", LEVELS)})


def _climbed(entries: Column, n: Column, base: int) -> Column:
    """The nodes over one block's entries, level by level, as ``all``, and the last level as ``now``."""

    def parent(kids: Column, level: Column) -> Column:
        return F.struct(
            (level + base).cast("int").alias("level"), F.element_at(kids, 1)["lo"].alias("lo"), F.element_at(kids, -1)["hi"].alias("hi"),
            F.sha2(F.array_join(kids["digest"], ""), 256).alias("digest"), F.transform(kids, lambda k: F.struct(k["lo"], k["hi"], k["digest"])).cast(_KIDS).alias("kids"),
        )

    def up(held: Column, level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(held["now"]) - 1) / RUN).cast("int"))
        nodes = F.transform(runs, lambda i: bind(F.slice(held["now"], i * RUN + 1, RUN), lambda kids: parent(kids, level))).cast(_NODES)
        both = bind(nodes, lambda new: F.struct(new.alias("now"), F.concat(held["all"], new).alias("all")))
        return F.when((F.size(held["now"]) > 1) | (n > 1 << LEVELS), both).otherwise(held)

    first = F.transform(entries, lambda e: F.struct(F.lit(base), e["lo"], e["hi"], e["digest"], F.array().cast(_KIDS))).cast(_NODES)
    start = F.struct(first.alias("now"), F.array().cast(_NODES).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, up)


def build(entries: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """For each bucket of levels, from the leaves on, its entries (part, n, rank, lo, hi, block, digest)
    and its blocks (part, n, block, now, all); then one entry a group, its top."""
    rounds, more = [], True
    while more:
        listed = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        blocks = entries.groupBy("part", "n", "block").agg(listed.alias("entries"))
        climbed = _climbed(F.col("entries"), F.col("n"), LEVELS * len(rounds))
        blocks = cut(blocks.select("part", "n", "block", climbed.alias("c")).select("part", "n", "block", "c.now", "c.all"), "blocks")
        rounds.append((entries, blocks))
        top = F.element_at("now", 1)
        above = blocks.select("part", F.ceil(F.col("n") / (1 << LEVELS)).cast("long").alias("n"), F.col("block").alias("rank"), top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"))
        entries = above.withColumn("block", F.shiftright("rank", LEVELS))
        more = (entries.agg(F.max("n")).first()[0] or 1) > 1
    return rounds, entries


def nodes(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Every inner node: (part, level, lo, hi, digest, kids), level 1 being the lowest."""
    each = [blocks.select("part", F.inline("all")) for _, blocks in rounds]
    out = each[0]
    for other in each[1:]:
        out = out.unionByName(other)
    return out


def attach(entries: DataFrame, blocks: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """(part, rank, *keep, path) and what ``above`` carries, for each entry: its own bucket's ancestors by
    containment, as the digests beside it, then the path of its block (above: part, rank, path, ...).
    All three joins and the aggregate are by block, so each side is shuffled once."""
    inner = blocks.select("part", "block", F.inline("all")).select(
        "part", "block", F.col("level").alias("_level"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"))
    e, i = entries.alias("e"), inner.alias("i")
    contained = (F.col("e.part") == F.col("i.part")) & (F.col("e.block") == F.col("i.block")) & (F.col("_lo") <= F.col("e.lo")) & (F.col("e.hi") <= F.col("_hi"))

    def beside(of) -> Column:
        return F.array_join(F.filter("_kids", of)["digest"], "")

    step = F.struct(F.col("_level").alias("level"), beside(lambda k: k["hi"] <= F.col("lo")).alias("before"), beside(lambda k: k["lo"] >= F.col("hi")).alias("after"))
    met = e.join(i, contained, "left").select("e.*", "_level", "_kids")
    own = met.groupBy("part", "block", "rank", *keep).agg(F.sort_array(F.collect_list(F.when(F.col("_level").isNotNull(), step))).cast(_PATH).alias("_own"))
    over = above.withColumnRenamed("rank", "block").withColumnRenamed("path", "_above")
    return own.join(over, ["part", "block"]).withColumn("path", F.concat("_own", "_above")).drop("block", "_own", "_above")


def paths(rounds: list[tuple[DataFrame, DataFrame]], above: DataFrame, keep: list[str]) -> DataFrame:
    """The paths of the lowest entries, from the top bucket of levels down."""
    for k, (entries, blocks) in reversed([*enumerate(rounds)]):
        above = attach(entries, blocks, above, keep) if k == 0 else cut(attach(entries, blocks, above, []), "paths")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its path give."""
    return F.aggregate(path, start, lambda at, s: digest(s["before"], at, s["after"]))


def proof(path: Column) -> Column:
    """Digest of all the digests beside a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def prove(docs: DataFrame, tampered: Column, **changed: Column) -> DataFrame:
    """(doc_id, part, rank, leaf, seen, subroot, root, path) of every row; ``seen`` is the leaf that a reader
    finds where ``tampered`` rows have their columns ``changed``."""
    rows = own_columns(docs, **{c: F.col(c) for c in HASHED})
    seen = F.when(tampered, leaf(**changed))
    leaves = rows.select("doc_id", group_key(F.col("lang")).alias("part"), leaf().alias("digest"), seen.alias("seen"), F.monotonically_increasing_id().alias("row"))
    rounds, subroots = build(entries_of(ranked(cut(leaves, "leaves"), "doc_id", "digest", "row").drop("row")))
    tops = ranked(subroots.select(F.lit("").alias("part"), F.col("part").alias("of"), "digest"), "of")
    top_rounds, root = build(entries_of(cut(tops, "tops")))
    over = root.select("part", "rank", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    top_paths = paths(top_rounds, over, ["of", "digest"])
    above = cut(top_paths.select(F.col("of").alias("part"), F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    told = paths(rounds, above, ["doc_id", "digest", "seen"])
    return told.select("doc_id", "part", "rank", F.col("digest").alias("leaf"), F.coalesce("seen", "digest").alias("seen"), "subroot", "root", "path")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = prove(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, n_chars=F.col("n_chars") + 1)
    out = told.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_PART = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in HASHED) + ")"
_CHANGED = "sha256(" + " || ".join(_PART.format("(n_chars + 1)" if c == "n_chars" else c) for c in HASHED) + ")"
_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT)), "
    f"lambda c, b: {_BITS}), 4294967295::UBIGINT)"
)

#: The same manifest by recursion, a level at a time, first over leaves and then over subroots; crc32 bit by bit.
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_CHANGED} ELSE {_LEAF} END AS seen FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT 0 AS level, lang, k, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT level + 1, lang, k // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY k)) FROM tree WHERE n > 1 GROUP BY level, lang, k // 2, n),
subroots AS (SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM tree WHERE n = 1),
high AS (
  SELECT 0 AS level, k, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, k // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY level, k // 2, n),
top AS (SELECT level AS height, digest AS root FROM high WHERE n = 1),
walk AS (
  SELECT a.doc_id, a.lang, a.k AS leaf_k, a.leaf, s.subroot, s.height, s.k AS sub_k, 0 AS step, '' AS beside, a.seen AS held FROM numbered a JOIN subroots s ON a.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf_k, w.leaf, w.subroot, w.height, w.sub_k, w.step + 1, w.beside || coalesce(t.digest, h.digest, ''),
         sha256(CASE WHEN own % 2 = 1 THEN coalesce(t.digest, h.digest, '') || w.held ELSE w.held || coalesce(t.digest, h.digest, '') END)
  FROM (SELECT walk.*, CASE WHEN step < walk.height THEN leaf_k >> step::BIGINT ELSE sub_k >> (step - walk.height)::BIGINT END AS own, top.height AS more FROM walk, top) w
  LEFT JOIN tree t ON w.step < w.height AND t.level = w.step AND t.lang IS NOT DISTINCT FROM w.lang AND t.k = xor(w.own, 1)
  LEFT JOIN high h ON w.step >= w.height AND h.level = w.step - w.height AND h.k = xor(w.own, 1)
  WHERE w.step < w.height + w.more)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, held AS folded_root, held = root AS verified
FROM walk, top WHERE step = walk.height + top.height
"""
