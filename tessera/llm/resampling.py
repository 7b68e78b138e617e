"""Importance resampling: which documents to keep so that the corpus looks like a target.

Words and word pairs, lower-cased, are hashed into ``BUCKETS`` features. One multinomial
is fitted to the target texts and one to all texts (add-one smoothing); a document's log
importance weight is the sum over its features of log(p_target / p_raw). A document of the
target is weighed without its own counts in the target (leave one out). The sample is
the top k by weight plus Gumbel noise, which draws without replacement in proportion
to the weights. The noise comes from the document's id, so reruns agree. The k-th largest
value is found by counting values by their leading bits, 16 bits a round; only the round's
bucket is counted again, and nothing is sorted.

The target are the documents labelled with quality 1: at most ``LABELLED`` of them, those
with the least hash of their id. All other counts cover all documents.

Cases: null and empty texts have weight 0; no labels: all weights are 0 and the draw is
uniform; a null id counts as the empty text; ties at the k-th value are all kept.
Repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Text, chunks, cut, id_text, mix64, target_ids, to_arrow, windows

BUCKETS_LOG2 = 16
#: Share of the documents that is kept.
KEEP = 0.85


def _features(text: Text) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the features of all texts and where each text's begin (n + 1)."""
    h, first = text.word_hashes()
    pairs, starts = windows(h, first, 2)
    cut_ = np.uint64(64 - BUCKETS_LOG2)
    return [((mix64(h + np.uint64(1)) >> cut_).astype(np.int64), first), ((pairs >> cut_).astype(np.int64), starts)]


def fit(rows: DataFrame) -> dict[str, np.ndarray]:
    """Counts of every feature in all texts (raw) and in the target; ``rows`` has text and is_target."""

    def run(batches):
        raw, target = (np.zeros(1 << BUCKETS_LOG2, np.int64) for _ in range(2))
        for batch in batches:
            for part in chunks(batch, "text"):
                chosen = np.asarray(part.column("is_target").cast(pa.int8()))
                for f, starts in _features(Text(part.column("text"), lower=True)):
                    raw += np.bincount(f, minlength=len(raw))
                    target += np.bincount(f[np.repeat(chosen, np.diff(starts)) > 0], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"b": at, "raw": raw[at], "target": target[at]})

    sums = to_arrow(rows.select("text", "is_target").mapInArrow(run, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = (np.zeros(1 << BUCKETS_LOG2) for _ in range(2))
    if sums.num_rows:
        b = np.asarray(sums.column("b").combine_chunks())
        raw[b] = np.asarray(sums.column("raw").combine_chunks())
        target[b] = np.asarray(sums.column("target").combine_chunks())
    return {"raw": raw, "target": target}


def log_ratio(model: dict[str, np.ndarray]) -> np.ndarray:
    """log(p_target / p_raw) of every feature, both smoothed by one; 0 without a target."""
    raw, target = model["raw"] + 1, model["target"] + 1
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if model["target"].any() else np.zeros(len(raw))


def left_out(model: dict[str, np.ndarray], f: np.ndarray) -> float:
    """The log weight of a target document with the features ``f``, without its own counts in the target."""
    seen, m = np.unique(f, return_counts=True)
    raw, size = model["raw"] + 1, len(model["raw"])
    own = np.log((model["target"][seen] - m + 1) / (model["target"].sum() - len(f) + size)) - np.log(raw[seen] / raw.sum())
    return float((m * own).sum())


def weigh(rows: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` without text, plus log_weight, gumbel_key and its order-preserving bits; ``rows`` has
    text, is_target and _seed."""
    own = ("text", "_seed", "is_target")
    keep = [c for c in rows.columns if c not in own]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = log_ratio(shared.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                both = _features(Text(part.column("text"), lower=True))
                f, starts = np.concatenate([x for x, _ in both]), [s for _, s in both]
                shift = len(both[0][0])
                weight = sum(np.bincount(np.repeat(np.arange(part.num_rows), np.diff(s)), table[x], part.num_rows) for x, s in both)
                for i in np.flatnonzero(np.asarray(part.column("is_target").cast(pa.int8()))):
                    weight[i] = left_out(shared.value, np.concatenate([f[starts[0][i] : starts[0][i + 1]], f[shift + starts[1][i] : shift + starts[1][i + 1]]]))
                u = ((mix64(np.asarray(part.column("_seed")).view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
                key = weight - np.log(-np.log(u)) + 0.0
                bits = key.view(np.int64)
                bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(weight), pa.array(key), pa.array(bits)], names=[*keep, "log_weight", "gumbel_key", "bits"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.select(*keep, *own).mapInArrow(run, kinds + "log_weight double, gumbel_key double, bits long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column: four counts by 16 bits each, of at most 65,536
    rows a count. None if there are fewer than k rows."""
    prefix = None
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("b")).count().collect()
        for b, n in sorted(((r["b"], r["count"]) for r in counts), reverse=True):
            if n >= k:
                prefix = b
                break
            k -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, ids: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of every document. ``ids`` (doc_id): the target, of
    bounded size."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("_t", F.lit(True))), "doc_id", "left").select("doc_id", "text", F.coalesce("_t", F.lit(False)).alias("is_target"))
    model = fit(flagged.select("text", "is_target"))
    scored = cut(weigh(flagged.withColumn("_seed", F.xxhash64(id_text(F.col("doc_id")))), model), "weights")
    n = scored.count()
    least = kth_largest(scored, "bits", round(keep * n)) if round(keep * n) > 0 else None
    chosen = F.lit(keep > 0) if least is None else F.col("bits") >= least
    return scored.select("doc_id", "log_weight", "gumbel_key", chosen.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), target_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
