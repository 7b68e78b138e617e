"""Document fingerprints by Order MinHash.

The k-mers of a text are its runs of ``K`` words, each numbered by its occurrence, so that
repeats count. Every numbered k-mer has one hash. Coordinate j of the fingerprint orders
the k-mers by hash, cyclically from the j-th of ``COORDINATES`` equally spaced points,
takes the ``TUPLE`` = 2 minimal ones, puts them back into their text order and hashes the
pair. Moving words about changes pairs even where the set of k-mers stays, so agreement
follows edit distance and not only overlap. The likeness of two fingerprints is the share
of equal coordinates.

Everything is array expressions on one row: two sorts of long arrays, and binary searches.
A long holds 40 bits of hash above 24 bits of place; the place wraps after 2**24 words.

Cases: null is the empty text; without words all coordinates are equal; a text of fewer
than ``K`` words is one k-mer. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bind, cut, global_index, split_words

K = 2
COORDINATES = 64
PLACE = 24
#: Documents that one window partition holds on average, and quantiles that cut the ids.
NEAR, KNOTS = 2000, 64


def _first_of_run(s: Column, i: Column) -> Column:
    """Where the run of equal hashes that ends at i begins in the sorted array, by halving steps."""

    def step(at: Column, b: Column) -> Column:
        before = at - F.call_function("shiftleft", F.lit(1), b)
        return F.when((before >= 0) & (F.shiftright(F.get(s, before), PLACE) == F.shiftright(F.get(s, i), PLACE)), before).otherwise(at)

    return F.aggregate(F.sequence(F.lit(PLACE - 1), F.lit(0), F.lit(-1)), i, step)


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed, PLACE).bitwiseOR(place.cast("long").bitwiseAND((1 << PLACE) - 1))


def coordinates(text: Column) -> Column:
    """The fingerprint of a text as an array of 64 numbers below 2**16."""

    def kmers(w: Column) -> Column:
        pairs = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b")), F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(pairs, lambda z, i: _packed(F.xxhash64(z["a"], z["b"]), i))
        )

    def numbered(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            again = (i > 0) & (F.shiftright(F.get(s, i - 1), PLACE) == F.shiftright(x, PLACE))
            occurrence = F.when(again, i - _first_of_run(s, i)).otherwise(F.lit(0))
            return _packed(F.xxhash64(F.shiftright(x, PLACE), occurrence), x)

        return F.transform(s, one)

    def sketch(g: Column) -> Column:
        n = F.size(g)

        def pair(a: Column, b: Column) -> Column:
            place = (1 << PLACE) - 1
            first = a.bitwiseAND(place) <= b.bitwiseAND(place)
            x, y = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
            return F.xxhash64(F.shiftright(x, PLACE), F.shiftright(y, PLACE)).bitwiseAND(0xFFFF)

        def coordinate(j: Column) -> Column:
            point = F.call_function("shiftleft", j.cast("long") - COORDINATES // 2, F.lit(58))

            def step(lo: Column, b: Column) -> Column:
                upper = lo + F.call_function("shiftleft", F.lit(1), b)
                return F.when((upper <= n) & (F.get(g, upper - 1) < point), upper).otherwise(lo)

            levels = F.sequence(F.ceil(F.log2(n + 1)).cast("int"), F.lit(0), F.lit(-1))
            at = F.aggregate(levels, F.lit(0), step)
            return bind(at, lambda i: pair(F.get(g, F.pmod(i, n)), F.get(g, F.pmod(i + 1, n))))

        every = F.sequence(F.lit(0), F.lit(COORDINATES - 1))
        return F.when(n == 0, F.array_repeat(F.lit(0).cast("bigint"), COORDINATES)).otherwise(F.transform(every, coordinate))

    return bind(split_words(text), lambda w: bind(F.sort_array(kmers(w)), lambda s: bind(F.sort_array(numbered(s)), sketch)))


def fingerprint_text(c: Column) -> Column:
    """Four hexadecimal digits a coordinate."""
    return F.lower(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal coordinates."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(COORDINATES))


def with_next(docs: DataFrame, order: str, near: int = NEAR) -> tuple[DataFrame, Window]:
    """``docs`` dealt into buckets of neighbours by descending ``order`` (a long column without
    nulls), and the window in which lead() gives the next row. Each bucket also holds, marked
    _ghost, the first row of the next bucket (the last bucket: the very first row), so no
    bucket needs another. Buckets are equal steps between quantiles of ``order``."""
    n = docs.count()
    knots = docs.agg(F.percentile_approx(order, [i / KNOTS for i in range(KNOTS + 1)], 10_000).alias("q")).first()["q"] or [0]
    knots = sorted(set(knots))
    steps = max(1, n // (len(knots) * near))
    # the last quantile at or below the row's place, and how far the row is from there to the next
    table = F.array(*[F.lit(k) for k in [*knots, knots[-1]]])
    at = F.greatest(F.size(F.filter(F.slice(table, 1, len(knots)), lambda k: k <= F.col(order))), F.lit(1))
    low, high = (F.element_at(table, at + k).cast("double") for k in (0, 1))
    inside = F.floor((F.col(order).cast("double") - low) / F.greatest((high - low) / F.lit(float(steps)), F.lit(1.0)))
    of = at.cast("long") * (steps + 1) + F.least(F.greatest(inside, F.lit(0)), F.lit(steps))
    dealt = docs.withColumn("_bucket", of)
    heads = global_index(dealt.groupBy("_bucket").agg(F.max(order).alias("_head")), F.col("_bucket").desc(), name="_place")
    heads = cut(heads, "heads")
    count = heads.count()
    before = heads.select(F.pmod(F.col("_place") + 1, F.lit(max(count, 1))).alias("_place"), F.col("_bucket").alias("_to"))
    ghosts = cut(heads.join(before, "_place").select(F.col("_head").alias(order), "_to"), "ghosts")
    both = dealt.join(ghosts, order, "left").withColumn("_b", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("g"))))))
    return both.withColumns({"_bucket": F.col("_b.b"), "_ghost": F.col("_b.g")}).drop("_b", "_to"), Window.partitionBy("_bucket").orderBy("_ghost", F.desc(order), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited text, and their likeness to each other and
    to the next document's; null ids come last."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_order"))
    dealt, window = with_next(slim, "_order")
    # dealt first, so that each text is fingerprinted once, beside its neighbours
    placed = dealt.repartition("_bucket").select("doc_id", "text", "_order", "_bucket", "_ghost", coordinates(F.col("text")).alias("own"))
    led = placed.select("doc_id", "text", "own", "_ghost", F.lead("text").over(window).alias("after"), F.lead("own").over(window).alias("next_own")).where("not _ghost")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("after"), F.lit(1), half))
    told = led.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    both = told.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), coordinates(F.col("edited")).alias("changed"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
