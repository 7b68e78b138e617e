"""Quality rules: simple counts, and a log-likelihood ratio between two n-gram models.

Words and word pairs are hashed into ``BUCKETS`` features. One multinomial is fitted to
trusted target documents and one to the raw corpus; the target's counts are smoothed by
BUCKETS draws from the raw model, so that few labels pull no score down. A document's
score is the mean over its features of log(p_target / p_raw). A document of the target is
scored without its own counts (leave one out), like any document that the target doesn't
hold. Every document is judged by one threshold: ``SPREAD`` standard deviations below the
mean of the target documents' own scores. All of it is built-in expressions: one explode
with an aggregate to fit, one with two broadcast joins against tables of BUCKETS rows to
score, and the target's documents again for their own scores.

The target are documents labelled with quality 1: at most ``LABELLED`` of them, those with
the least hash of their id. The raw model covers all documents.

Cases: null, empty and blank texts have no words, fail the base rules and have score 0;
without labels all scores are 0; a null id counts as one. Repeated rows are judged each.
Repeated 3-word windows are found by a 64-bit hash; a text may have up to 2**PLACE words, which
a string cannot exceed.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind, cut, split_words, target_ids

BUCKETS = 1 << 16
#: A document is kept if its score is at most so many standard deviations below the mean of the target's.
SPREAD = 2.5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Bits that hold a word's place.
PLACE = 30


def repeated_words(h: Column, sorted_: Column) -> Column:
    """Words that lie in a window found twice or more: ``h`` are the window hashes in text order,
    ``sorted_`` their leading bits over their places, in order. Where neighbours have equal leading
    bits and different hashes, such a run may hold equal hashes apart from each other: those texts
    (few, and by chance) sort whole hashes with their places."""
    place = (1 << PLACE) - 1

    def lead(x: Column, y: Column) -> Column:
        return F.shiftright(x, PLACE) == F.shiftright(y, PLACE)

    def whole(x: Column) -> Column:
        return F.get(h, x.bitwiseAND(place).cast("int"))

    def twice(rows: Column, same) -> Column:
        return F.filter(rows, lambda x, i: F.coalesce(same(F.get(rows, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(rows, i + 1), x), F.lit(False)))

    def again(rows: Column) -> Column:
        """Places of repeated windows; ``rows`` are those with equal leading bits beside them."""
        mixed = F.size(F.filter(rows, lambda x, i: F.coalesce(lead(F.get(rows, i - 1), x) & (whole(F.get(rows, i - 1)) != whole(x)), F.lit(False)))) > 0
        pairs = F.sort_array(F.transform(rows, lambda x: F.struct(whole(x).alias("h"), x.bitwiseAND(place).alias("i"))))
        # the sort is bound: in the lambda it would be done again for each place
        exact = bind(pairs, lambda p: F.transform(twice(p, lambda x, y: x["h"] == y["h"]), lambda x: x["i"]))
        return F.when(mixed, exact).otherwise(F.transform(rows, lambda x: x.bitwiseAND(place)))

    covered = F.transform(bind(twice(sorted_, lead), again), lambda x: F.sequence(x, x + 2))
    return F.when(F.size(sorted_) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(covered)))).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """``docs`` (any slim columns, and text) plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed. Each array is a column of its own, so that it is computed once
    and the sort and the distinct run in generated code."""
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    symbols = F.regexp_replace(text, f"[^{SYMBOLS}]+", "")

    def again(x: Column) -> Column:
        return F.size(x) - F.size(F.array_distinct(x))

    # whether a line has a word only matters where some line is equal to another
    worded = bind(F.array_remove(F.split(text, "\n"), ""), lambda x: F.when(again(x) > 0, F.filter(x, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))))
    dup = F.coalesce(bind(worded, again), F.lit(0))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    none = F.array().cast("array<bigint>")
    step = docs.select(*keep, split_words(F.col("text")).alias("w"), F.length(symbols).cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"))
    step = step.select(
        *keep, "n_symbols", "n_dup_lines", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("w"),
    )
    inner = F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    step = step.select(*keep, *counts, F.transform(inner, lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("h"))
    packed = F.transform("h", lambda x, i: F.shiftleft(x, PLACE).bitwiseOR(i.cast("long")))
    step = step.select(*keep, *counts, "h", F.when(F.size(F.array_distinct("h")) < F.size("h"), packed).otherwise(none).alias("p"))
    step = step.select(*keep, *counts, "h", F.sort_array("p").alias("p"))
    step = step.select(*keep, *counts, repeated_words(F.col("h"), F.col("p")).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def features(rows: DataFrame, *keep: str) -> DataFrame:
    """One row a word: the feature of the word (u, below BUCKETS) and that of it with its successor
    (v, from BUCKETS on; null after the last)."""
    # the words are a column of their own, so that they are zipped in generated code
    worded = rows.select(*keep, split_words(F.col("text")).alias("w"))
    each = worded.select(*keep, F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("a", "b"))
    v = F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)) + BUCKETS
    return each.select(*keep, F.pmod(F.xxhash64("a"), F.lit(BUCKETS)).alias("u"), F.when(F.col("b").isNotNull(), v).alias("v"))


def counts(rows: DataFrame) -> DataFrame:
    """(f, raw, target, all_raw, all_target) of every feature, at most 2 * BUCKETS rows; ``rows`` has
    text and is_target. Totals are those of the feature's order, words or pairs."""
    each = (
        features(rows, "is_target").select("is_target", F.explode(F.array("u", "v")).alias("f")).where("f is not null").groupBy("f")
        .agg(F.count("*").alias("raw"), F.count_if("is_target").alias("target"))
    )
    each = cut(each.withColumn("o", F.col("f") >= BUCKETS), "features")
    totals = each.groupBy("o").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    return cut(each.join(F.broadcast(totals), "o").drop("o"), "counts")


def log_ratio(own: Column | int = 0, all_own: Column | int = 0) -> Column:
    """log(p_target / p_raw) of a row of counts, less a document's own counts in the target; 0 without a target."""
    raw = F.col("raw") / F.col("all_raw")
    p = F.ln((F.col("target") - own + BUCKETS * raw) / (F.col("all_target") - all_own + BUCKETS) / raw)
    return F.when(F.col("all_target") > 0, p).otherwise(0.0)


def ratio(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, score): the mean log-likelihood ratio of each text with a word; ``rows`` has uid, text.
    Rows of equal uid must have equal texts (the mean is then the same)."""
    model = model.select("f", log_ratio().alias("llr"))
    uni, bi = (model.where(side).select(F.col("f").alias(c), F.col("llr").alias(f"llr_{c}")) for side, c in ((F.col("f") < BUCKETS, "u"), (F.col("f") >= BUCKETS, "v")))
    each = features(rows, "uid").join(F.broadcast(uni), "u", "left").join(F.broadcast(bi), "v", "left")
    total, n = F.coalesce("llr_u", F.lit(0.0)) + F.coalesce("llr_v", F.lit(0.0)), F.count("*") + F.count("v")
    return each.groupBy("uid").agg((F.sum(total) / n).alias("score"))


def left_out(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, own_score) of the target's own documents, each without its own counts in the target."""
    each = features(rows, "uid").select("uid", F.explode(F.array("u", "v")).alias("f")).where("f is not null")
    own = each.groupBy("uid", "f").agg(F.count("*").alias("m")).withColumn("o", F.col("f") >= BUCKETS)
    all_own = own.groupBy("uid", "o").agg(F.sum("m").alias("all_m"))
    joined = own.join(all_own, ["uid", "o"]).join(F.broadcast(model), "f")
    return joined.groupBy("uid").agg((F.sum(F.col("m") * log_ratio(F.col("m"), F.col("all_m"))) / F.sum("m")).alias("own_score"))


def judge(docs: DataFrame, ids: DataFrame, spread: float = SPREAD) -> DataFrame:
    """(doc_id, the base counts, base_failed, score, threshold, kept) of every document."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    flagged = keyed.join(F.broadcast(ids.withColumn("_t", F.lit(True))), "doc_id", "left").withColumn("is_target", F.coalesce("_t", F.lit(False)))
    model = counts(flagged.select("text", "is_target"))
    own = cut(left_out(flagged.where("is_target").select("uid", "text"), model), "own")
    least = own.agg(F.coalesce(F.avg("own_score") - spread * F.stddev_pop("own_score"), F.lit(0.0)).alias("threshold"))
    scored = base(keyed).join(ratio(keyed, model), "uid", "left").join(own, "uid", "left").join(F.broadcast(least))
    scored = scored.withColumn("score", F.coalesce("own_score", "score", F.lit(0.0)))
    judged = scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))).drop("uid", "own_score")
    # written, since a filter on these columns would be pushed down and work the arrays out again for each mention
    return cut(judged, "judged")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), target_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
