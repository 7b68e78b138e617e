"""Language identification with a language-bitmask n-gram filter.

Byte n-grams are counted by language over all training texts. Every n-gram that makes up
at least ``RATE`` of a language's n-grams is inserted for that language, whatever the other
languages hold, so at most 1 / RATE n-grams a language enter however large the corpus is.
The filter is a bit-sliced Bloom filter: a slot is a mask with one bit a language, an n-gram
sets its language's bit in ``HASHES`` slots, and the AND of an n-gram's slots is the set of
all languages that contain it, with some false positives and no false negatives. Each
language's popcount over a text's n-grams, less the hits that its fill gives by chance
(``fill ** HASHES`` of all n-grams), decides. ``score`` is the best language's share of all
corrected hits, ``coverage`` its share of the text's n-grams: low for what is no language.

Cases: null text, or a text without a letter, is ``und`` with score 0; a text with
letters but shorter than an n-gram, or of which no n-gram is known, gets the most
frequent training language with score 0; no training rows at all: ``und``. Null
languages don't train. Ties go to the first language by code point. Repeated rows
are counted and answered each. Very long texts are worked on in segments. Other columns of
the input are ignored. More than ``MOST`` languages are an error, as the filter is broadcast:
it has 2**slots_log2 words of 8 bytes for each 62 of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL_CHUNK, Tally, Text, chunks, cut, id_text, to_arrow

NGRAM = 4
HASHES = 2
SLOTS_LOG2 = 20
#: Least share of a language's n-grams that an n-gram needs to be inserted.
RATE = 1e-5
#: Languages in one mask word, and languages at most.
WORD, MOST = 62, 62 * 16
#: N-grams of a text worked on at once.
SEGMENT = 1 << 20
_ODD = (0x9E3779B1, 0x85EBCA77)


def _grams(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram that lies in one text as a number, and where each text's begin (n + 1)."""
    b = text.bytes
    m = max(len(b) - NGRAM + 1, 0)
    gram = np.zeros(m, np.uint32)
    for j in range(NGRAM):
        gram |= b[j : j + m].astype(np.uint32) << np.uint32(8 * j)
    counts = np.maximum(np.diff(text.off) - (NGRAM - 1), 0)
    inside = np.ones(m, bool)
    for j in range(1, NGRAM):  # the last n-grams of a text run over its end
        at = text.off[1:-1] - j
        inside[at[(at >= 0) & (at < m)]] = False
    starts = np.zeros(text.n + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    return gram[inside], starts


def _slots(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each hash the slot of every n-gram."""
    out = []
    for odd in _ODD[:HASHES]:
        x = gram * np.uint32(odd)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out.append(x >> np.uint32(32 - bits))
    return out


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang) that have both."""

    def count(batches):
        tally, names = Tally(), []
        place: dict[str, int] = {}

        def told(parts):
            for keys, n in parts:
                at = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array(names, pa.string()))
                yield pa.RecordBatch.from_arrays([at.dictionary_decode(), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                langs = part.column("lang").to_pylist()
                for x in langs:
                    if x not in place:
                        place[x] = len(names)
                        names.append(x)
                gram, starts = _grams(Text(part.column("text"), lower=True))
                code = np.array([place[x] for x in langs], np.uint64) << np.uint64(32)
                yield from told(tally.add(np.repeat(code, np.diff(starts)) | gram))
        yield from told(tally.rest())

    used = rows.where("text is not null and lang is not null").select("text", "lang")
    return used.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, slots_log2: int = SLOTS_LOG2, rate: float = RATE) -> dict:
    """Learn from all rows (text, lang)."""
    counts = cut(ngram_counts(rows), "langid")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST + 1).collect()}
    if len(totals) > MOST:
        raise ValueError(f"more than {MOST} languages")
    langs = sorted(totals, key=lambda x: x.encode())
    if not langs:
        return {"langs": [], "masks": np.zeros((1, 1), np.uint64), "fill": np.zeros(0), "prior": 0, "slots_log2": 0}
    place = counts.sparkSession.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(langs)], "lang string, i long, total double")
    held = counts.join(F.broadcast(place), "lang").where(F.col("n") >= rate * F.col("total")).select("i", "gram")

    def insert(batches):
        for batch in batches:
            gram, i = (np.asarray(batch.column(c)) for c in ("gram", "i"))
            for slot in _slots(gram.astype(np.uint32), slots_log2):
                yield pa.RecordBatch.from_pydict({"word": i // WORD, "slot": slot.astype(np.int64), "bit": np.int64(1) << (i % WORD)})

    masks = to_arrow(held.mapInArrow(insert, "word long, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")))
    table = np.zeros(((len(langs) - 1) // WORD + 1, 1 << slots_log2), np.uint64)
    if masks.num_rows:
        table[np.asarray(masks.column("word").combine_chunks()), np.asarray(masks.column("slot").combine_chunks())] = np.asarray(masks.column("mask").combine_chunks()).view(np.uint64)
    fill = np.array([((table[i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(langs))])
    return {"langs": langs, "masks": table, "fill": fill, "prior": max(range(len(langs)), key=lambda i: totals[langs[i]]), "slots_log2": slots_log2}


def popcounts(model: dict, gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text and language how many of the text's n-grams the filter holds for the language."""
    masks, n = model["masks"], len(model["langs"])
    found = np.zeros((len(starts) - 1, n), np.int64)
    for at in range(0, len(gram), SEGMENT):
        slots = _slots(gram[at : at + SEGMENT], model["slots_log2"])
        edges = np.clip(starts - at, 0, len(slots[0]))
        upto = np.zeros(len(slots[0]) + 1, np.int32)
        for w, row in enumerate(masks):
            hits = np.bitwise_and.reduce([row[s] for s in slots])
            for i in range(w * WORD, min(n, (w + 1) * WORD)):
                np.cumsum((hits >> np.uint64(i % WORD)) & np.uint64(1), out=upto[1:], dtype=np.int32)
                found[:, i] += upto[edges[1:]] - upto[edges[:-1]]
    return found


def _has_letter(text: Text, column: pa.Array) -> np.ndarray:
    b = text.bytes
    some = text.per_text((b >= 97) & (b <= 122)) > 0
    for i in np.flatnonzero(~some & (np.diff(text.off) > 0)):
        some[i] = any(c.isalpha() for c in column[i].as_py())
    return some


def told(spark, model: dict, text: Column) -> Column:
    """(lang_pred, score, coverage) of a text, as a struct. Only the text travels to Python."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, coverage double")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs = m["langs"]
        chance = np.minimum(m["fill"] ** HASHES, 0.999)
        out = []
        for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SMALL_CHUNK):
            text = Text(part.column("text"), lower=True)
            letters = _has_letter(text, part.column("text"))
            pred, score, coverage = np.full(text.n, -1), np.zeros(text.n), np.zeros(text.n)
            if langs:
                gram, starts = _grams(text)
                n = np.diff(starts)
                found = np.maximum((popcounts(m, gram, starts) - n[:, None] * chance) / (1 - chance), 0)
                best, all_ = found.argmax(1), found.sum(1)
                most = found[np.arange(text.n), best]
                pred = np.where(all_ > 0, best, m["prior"])
                score, coverage = most / np.maximum(all_, 1e-12), most / np.maximum(n, 1)
            known = letters & (pred >= 0)
            names = [langs[p] if ok else "und" for p, ok in zip(pred, known)]
            out.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, coverage, 0.0))], names=["lang_pred", "score", "coverage"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())]))

    return judge(text)


def predict(rows: DataFrame, model: dict, with_text: bool = False) -> DataFrame:
    """``rows`` (any columns, with text) plus lang_pred, score and coverage; the text itself only if
    asked for. No shuffle: each text is judged alone."""
    own = ("lang_pred", "score", "coverage")
    keep = [c for c in rows.columns if c not in own and (with_text or c != "text")]
    return rows.select(*keep, told(rows.sparkSession, model, F.col("text")).alias("_told")).select(*keep, *[F.col(f"_told.{c}") for c in own])


def split_and_fit(docs: DataFrame) -> dict:
    """A model learnt from the documents whose crc32(doc_id as text) mod 3 is not 1."""
    return fit(docs.where(F.crc32(id_text(F.col("doc_id"))) % 3 != 1).select("text", "lang"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = split_and_fit(docs)
    rows = docs.select("doc_id", (F.crc32(id_text(F.col("doc_id"))) % 3 == 1).alias("held_out"), "text")
    return cut(predict(rows, model), "languages")
