"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct five-word shingles. All signature coordinates
come from two permutations: the first scatters the shingles, the second, applied after
a circular shift by k steps, gives coordinate k. Documents with equal sets form one class
at once, so a group of exact copies costs one row from then on. Classes that share a
band are candidates. Candidates meet on the rarest shingles of their sets (a pair that
similar must share one of the first n - ceil(n * t) + 1 in any common order), with the
bounds on sizes and positions that the similarity implies, and each meeting pair is
confirmed by the exact intersection and union of the full sets.

The number of bands of five coordinates follows the threshold: two classes just as similar
miss each other in all bands with a chance below ``MISS``. Sets are told apart by a 128-bit hash of all their shingles; two that
agree in half of it only are an error.

Cases: a text of fewer than five words is one shingle, the whole sequence; one without
words, or null, has the empty set and is linked with nothing. A null id can be linked
but never names a component; if no member has an id the component is null, and such a
row is kept. Rows with the same id and text are one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL_CHUNK, Text, bitmap, chunks, cut, in_bitmap, join_on, list_array, mix64, signed, windows
from tessera.llm.linking import connect

SHINGLE = 5
BANDS, ROWS = 25, 5
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 85
_STEP = np.uint32(0x9E3779B1)


def shingle_sets(text: Text) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    h, first = text.word_hashes()
    values, starts = windows(h, first, SHINGLE)
    short = np.diff(first)
    out = [np.unique(values[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    for k in range(1, SHINGLE):
        for i in np.flatnonzero(short == k):
            out[i] = windows(h[first[i] : first[i] + k], np.array([0, k]), k, seed=1)[0]
    return out


def set_keys(values: np.ndarray) -> tuple[int, int]:
    """A name of 64 bits for a set, and 64 more that tell whether two sets share the name."""
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def band_count(percent: int) -> int:
    """Bands of ROWS coordinates with which a pair at the threshold is missed by less than MISS; BANDS at least."""
    shared = (percent / 100) ** ROWS
    return BANDS if shared >= 1 else max(BANDS, math.floor(math.log(MISS) / math.log1p(-shared)) + 1)


def signature(values: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the least pi(sigma(x) + k * step mod 2**32) over the set."""
    scattered = (values >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32) * _STEP
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(scattered), 2048):
        x = scattered[i : i + 2048, None] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(0), out=least)
    return least


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(-1, rows).astype(np.uint64)
    acc = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + parts[:, j])
    return acc


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(uid, doc_id, n_shingles, k, k2, bands): uid is a hash of id and text, k and k2 of the set (null if it is empty)."""

    size = band_count(percent) * ROWS

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                sets = shingle_sets(Text(part.column("text"), lower=True))
                keys, rows = [], []
                known: dict[tuple[int, int], np.ndarray] = {}
                for s in sets:
                    if not len(s):
                        keys.append((None, None))
                        rows.append(np.zeros(0, np.uint64))
                        continue
                    keys.append(k := set_keys(s))
                    if k not in known:
                        known[k] = bands(signature(s, size))
                    rows.append(known[k])
                k1, k2 = zip(*keys)
                sizes = np.array([len(r) for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                     list_array(signed(np.concatenate(rows)), np.concatenate([[0], np.cumsum(sizes)]))], names=["uid", "doc_id", "n_shingles", "k", "k2", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("uid"), "doc_id", "text")
    return keyed.mapInArrow(run, f"uid long, doc_id {kind}, n_shingles long, k long, k2 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(k, s) of the documents whose set hash is in the filter; once a task for equal sets."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                keys, rows = [], []
                for s in shingle_sets(Text(part.column("text"), lower=True)):
                    if len(s) and (k := set_keys(s)[0]) not in seen and in_bitmap(wanted, np.array([k]).view(np.uint64))[0]:
                        seen.add(k)
                        keys.append(k)
                        rows.append(s)
                if keys:
                    off = np.concatenate([[0], np.cumsum([len(s) for s in rows])])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), list_array(signed(np.concatenate(rows)), off)], names=["k", "s"])

    return docs.select("text").mapInArrow(run, "k long, s array<long>")


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, pos, n): the shared shingles in the prefix of each set, rarest first."""
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("x"))
    shared = each.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    ordered = each.join(shared, "x").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("o"))
    alone = F.col("n") - F.size("o")  # shingles of this set only come first
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1").cast("int") - alone
    return (
        ordered.where(length > 0).select("k", "n", alone.alias("alone"), F.posexplode(F.slice("o", F.lit(1), length)).alias("i", "e"))
        .select(F.col("e.x").alias("key"), F.col("k").alias("id"), (F.col("i") + F.col("alone")).alias("pos"), "n")
    )


def link_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, root) of the sets (k, s) that links at ``percent`` join."""
    entries = cut(_entries(sets, percent), "prefixes")
    sized = sets.select("k", "s")

    def may(a: str, b: str) -> str:
        # at the first shared shingle no more than the shorter rest can still be shared
        return (
            f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
            f"{100 + percent} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {percent} * ({a}.n + {b}.n)"
        )

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sized.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sized.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("c"), (F.size("sa") + F.size("sb")).alias("t"))
        return common.where(f"100 * c >= {percent} * (t - c)").select("a", "b")

    return connect(entries, ["pos", "id"], may, verify)


def _rooted(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signature table, and (k, least, first, root) of every set."""
    sig = cut(signatures(docs, percent), "signatures")
    each = sig.select("k", F.explode("bands").alias("band"))
    met = each.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("band")
    wanted = cut(each.join(met, "band", "left_semi").select("k").distinct(), "candidates")
    sets = cut(sets_of(docs, bitmap(wanted, "k")).join(wanted, "k", "left_semi").dropDuplicates(["k"]), "sets")
    roots = link_classes(sets, percent)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    # documents are of one class only if 128 bits of their sets agree
    one = F.when(F.min("k2") == F.max("k2"), F.count("*")).otherwise(F.raise_error(F.lit("two different shingle sets share a 64-bit name")).cast("long"))
    classes = sig.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"), F.min(place).alias("first"), one.alias("rows"))
    classes = classes.join(roots.withColumnRenamed("id", "k"), "k", "left")
    return sig, cut(classes.withColumn("root", F.coalesce("root", "k")), "classes")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    sig, classes = _rooted(docs, percent)
    total = sig.count()
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = cut(join_on(classes.select("k", "rows", "root"), roots, "root", "members", total).select("k", "rows", "component_id"), "named")
    out = join_on(sig.where("k is not null").select("doc_id", "n_shingles", "k"), named, "k", "rows", total).select("doc_id", "n_shingles", "component_id")
    # without a set a document is on its own
    out = out.unionByName(sig.where("k is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that with the least id. Rows without words all stay."""
    sig, classes = _rooted(docs, percent)
    stay = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    stay = cut(stay.union(sig.where("k is null").select("uid")).distinct(), "stay")
    worded = F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("uid"), worded.alias("worded"))
    once = keyed.join(stay, "uid", "left_semi")
    return once.where("worded").dropDuplicates(["uid"]).unionByName(once.where("not worded")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, compared by their whole sets.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = s.doc_id AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
