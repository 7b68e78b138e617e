"""Quality rules, resampling, language ID and the language model."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, language_model, quality_rules, resampling
from tessera.llm.common import Text
from tests.llm.conftest import sentence
from tests.llm.test_pairs import SPACE, lower, tokens


def test_base_counts(documents, edge_rows):
    rows = edge_rows + [(20, "a b c a b c\nx #1\nx #1\n\n \n<b>"), (21, ("spam eggs ham " * 40).strip()), (22, sentence(100, 7) + " " + sentence(30, 7))]
    docs = documents(rows).select(F.monotonically_increasing_id().alias("n"), "text")
    for r in docs.join(quality_rules.base(docs), "n").collect():
        w = [x for x in SPACE.split(r["text"] or "") if x]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if SPACE.sub("", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"] or ""), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want


def corpus():
    """Clean documents of one vocabulary, junk of another, and labels for some."""
    rng = np.random.default_rng(0)
    clean, junk = (np.array([f"{p}{i}" for i in range(300)]) for p in ("w", "zz"))
    docs = [(i, " ".join((clean if i % 4 else junk)[rng.integers(0, 300, 120)])) for i in range(200)]
    return docs, [(i, int(i % 4 > 0), 0) for i in range(100)]


@pytest.mark.parametrize("place", [30, 56, 60])
def test_repeats_are_exact_however_few_bits_lead(documents, monkeypatch, place):
    """With 64 - place leading bits most neighbours share them by chance."""
    monkeypatch.setattr(quality_rules, "PLACE", place)
    rng = random.Random(place)
    texts = [" ".join(f"w{rng.randint(0, 6 + 3 * k)}" for _ in range(10 * k)) for k in range(40)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.base(documents(list(enumerate(texts))).select("doc_id", "text")).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {x for x, n in Counter(windows).items() if n > 1}
        assert got[k] == len({i + j for i, x in enumerate(windows) if x in many for j in range(3)})


def test_quality_and_resampling_keep_the_clean(spark, documents):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ids = quality_rules.target_ids(table)
    assert {r["doc_id"] for r in quality_rules.judge(documents(docs), ids).collect() if r["kept"]} == {i for i, _ in docs if i % 4}
    got = resampling.resample(documents(docs), resampling.target_ids(table), keep=0.75).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, _ in docs if i % 4}
    again = resampling.resample(documents(docs, extra=False), resampling.target_ids(table), keep=0.75).collect()
    assert {r["doc_id"] for r in again if r["kept"]} == {r["doc_id"] for r in got if r["kept"]}


def test_ratio_equals_plain_python(spark, documents):
    docs, labels = corpus()
    ids = {i for i, q, _ in labels if q}
    judged = {r["doc_id"]: r for r in quality_rules.judge(documents(docs), quality_rules.target_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    hashes = spark.createDataFrame([(i, k, o, a, b) for i, t in docs for o in (1, 2) for k, (a, b) in enumerate(zip(t.split(), t.split()[1:] + [None])) if o == 1 or b is not None], "i long, k int, o int, a string, b string")
    bucket = F.when(F.col("o") == 1, F.pmod(F.xxhash64("a"), F.lit(quality_rules.BUCKETS))).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(quality_rules.BUCKETS)))
    seen = [(r["i"], r["o"], r["x"]) for r in hashes.select("i", "o", bucket.alias("x")).collect()]
    raw, good = Counter((o, x) for _, o, x in seen), Counter((o, x) for i, o, x in seen if i in ids)
    total = {o: (sum(v for (p, _), v in raw.items() if p == o), sum(v for (p, _), v in good.items() if p == o)) for o in (1, 2)}
    p = lambda o, x: raw[o, x] / total[o][0]
    score = {}
    for i, _ in docs:
        mine = [(o, x) for j, o, x in seen if j == i]
        own, all_own = (Counter(mine), Counter(o for o, _ in mine)) if i in ids else (Counter(), Counter())
        llr = [math.log((good[o, x] - own[o, x] + quality_rules.BUCKETS * p(o, x)) / (total[o][1] - all_own[o] + quality_rules.BUCKETS) / p(o, x)) for o, x in mine]
        score[i] = sum(llr) / len(llr)
    least = np.mean([score[i] for i in ids]) - quality_rules.SPREAD * np.std([score[i] for i in ids])
    assert ids and all(math.isclose(r["score"], score[i], rel_tol=1e-9) and math.isclose(r["threshold"], least, rel_tol=1e-9) and r["kept"] == (score[i] >= least) for i, r in judged.items())


def test_labelled_documents_are_judged_like_others(spark):
    """Kept rates of good documents that the target holds and of good ones that it doesn't differ by 10 points at most."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    used = quality_rules.target_ids(labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0))
    inside = {r["doc_id"] for r in used.collect()}
    for rows in (quality_rules.judge(docs, used).where("not base_failed").collect(), resampling.resample(docs, used).collect()):
        rate = [np.mean([r["kept"] for r in rows if r["doc_id"] in side]) for side in (inside, good - inside)]
        assert abs(rate[0] - rate[1]) < 0.1 and min(rate) > 0.8


def test_weights_and_draw_equal_plain_python(spark, documents):
    docs, labels = corpus()
    ids = {i for i, q, _ in labels if q}
    got = {r["doc_id"]: r for r in resampling.resample(documents(docs), resampling.target_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), keep=0.6).collect()}
    features = {i: [(o, x) for o, (f, _) in enumerate(resampling._features(Text(pa.array([t]), lower=True))) for x in f.tolist()] for i, t in docs}
    size = 1 << resampling.BUCKETS_LOG2
    raw, good = (Counter(x for i, f in features.items() if i in some for _, x in f) for some in (features, ids))
    n_raw, n_good = sum(raw.values()), sum(good.values())
    for i, f in features.items():
        own = Counter(x for _, x in f) if i in ids else Counter()
        weight = sum(math.log((good[x] - own[x] + 1) / (n_good - sum(own.values()) + size)) - math.log((raw[x] + 1) / (n_raw + size)) for _, x in f)
        assert math.isclose(got[i]["log_weight"], weight, rel_tol=1e-9, abs_tol=1e-9)
    noise = [r["gumbel_key"] - r["log_weight"] for r in got.values()]
    assert len(set(noise)) == len(noise) and abs(np.mean(noise) - 0.5772) < 0.4  # a standard Gumbel variable's mean
    least = sorted((r["gumbel_key"] for r in got.values()), reverse=True)[round(0.6 * len(got)) - 1]
    assert all(r["kept"] == (r["gumbel_key"] >= least) for r in got.values())


def test_scores_of_edges(spark, documents, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(edge_rows)
    judged = quality_rules.judge(df, quality_rules.target_ids(none)).collect()
    assert len(judged) == len(edge_rows) and all(r["score"] == 0 for r in judged)
    assert not any(r["kept"] for r in judged if r["doc_id"] in (1, 2, 3))
    drawn = resampling.resample(df, resampling.target_ids(none), keep=0.5).collect()
    assert len(drawn) == len(edge_rows) and all(r["log_weight"] == 0 for r in drawn)
    assert len(edge_rows) // 2 <= sum(r["kept"] for r in drawn) <= len(edge_rows) // 2 + 3
    empty = documents([])
    assert quality_rules.judge(empty, quality_rules.target_ids(none)).count() == resampling.resample(empty, resampling.target_ids(none)).count() == 0


def test_kth_largest(spark):
    x = [int(v) for v in np.random.default_rng(0).integers(-(2**62), 2**62, 500)] + [5] * 10
    df = spark.createDataFrame([(v,) for v in x], "x long")
    for k in (1, 7, 250, 510):
        assert resampling.kth_largest(df, "x", k) == sorted(x, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "x", 511) is None


# --- languages -------------------------------------------------------------------------------------


def speak(lang: str, n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    stems = {"en": ["the", "and", "tion", "with", "ing"], "de": ["der", "und", "sch", "ung", "keit"], "fr": ["le", "aux", "ée", "ment", "ç"]}[lang]
    return " ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(documents):
    langs = ("en", "de", "fr")
    docs = documents([(i, speak(langs[i % 3], 60, i), langs[i % 3], None) for i in range(150)])
    model = language_id.split_and_fit(docs)
    told = language_id.predict(docs.select("doc_id", "lang", "text"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in told)
    # neither the id, the language nor the source of a text matters for its prediction
    other = language_id.predict(docs.select((-F.col("doc_id")).alias("doc_id"), F.lit("xx").alias("lang"), "text"), model).collect()
    assert {-r["doc_id"]: (r["lang_pred"], r["score"]) for r in other} == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in told}


def test_filter_holds_every_ngram_of_each_language(documents):
    """Masks against plain sets: no false negative, few false positives; popcounts and the answer follow from them."""
    langs = ("en", "de", "fr")
    rows = [(i, speak(langs[i % 3], 40, i), langs[i % 3]) for i in range(60)]
    model = language_id.fit(documents([(*r, None) for r in rows]).select("text", "lang"))
    grams = {x: Counter() for x in langs}
    for _, t, x in rows:
        b = lower(t).encode()
        grams[x].update(b[k : k + 4] for k in range(len(b) - 3))
    held = {x: {g for g, n in c.items() if n >= language_id.RATE * sum(c.values())} for x, c in grams.items()}
    every = sorted(set().union(*held.values()))
    code = np.array([int.from_bytes(g, "little") for g in every], np.uint32)
    mask = np.bitwise_and.reduce([model["masks"][0][s] for s in language_id._slots(code, model["slots_log2"])])
    extra = 0
    for k, x in enumerate(model["langs"]):
        told = {g for g, m in zip(every, mask) if int(m) >> k & 1}
        assert held[x] <= told
        extra += len(told - held[x])
    assert extra < 0.01 * len(every)
    for r in language_id.predict(documents([(*r, None) for r in rows]).select("doc_id", "text"), model).collect():
        b = lower(rows[r["doc_id"]][1]).encode()
        mine = [b[k : k + 4] for k in range(len(b) - 3)]
        hits = {x: sum(g in held[x] for g in mine) for x in langs}
        assert r["lang_pred"] == max(sorted(hits), key=hits.get)
        assert math.isclose(r["score"], hits[r["lang_pred"]] / sum(hits.values()), abs_tol=0.02) and math.isclose(r["coverage"], hits[r["lang_pred"]] / len(mine), abs_tol=0.02)


def test_long_texts_are_counted_in_segments(monkeypatch):
    model = {"langs": ["a", "b"], "masks": np.random.default_rng(0).integers(0, 4, (1, 1 << 10)).astype(np.uint64), "slots_log2": 10}
    gram, starts = language_id._grams(Text(pa.array(["x" * 3, sentence(300, 1), "", sentence(50, 2)]), lower=True))
    whole = language_id.popcounts(model, gram, starts)
    monkeypatch.setattr(language_id, "SEGMENT", 100)
    assert (language_id.popcounts(model, gram, starts) == whole).all() and whole.sum() > 0


def test_language_edges(documents, edge_rows):
    docs = documents([(i, t, "en" if i and i % 2 else None, None) for i, t in edge_rows])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs.select("doc_id", "text"), language_id.split_and_fit(docs)).collect()}
    assert got[1] == got[2] == got[3] == got[12] == ("und", 0.0) and got[4][0] == "en"
    none = language_id.fit(documents([]).select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert language_id.predict(documents([]).select("doc_id", "text"), none).count() == 0


# --- language model ----------------------------------------------------------------------------


def test_model_equals_plain_python_where_it_can(documents, edge_rows):
    rng = np.random.default_rng(3)
    rows = edge_rows + [(100 + i, " ".join(f"W{x}" for x in rng.zipf(1.2, 80) % 500)) for i in range(60)]
    docs = documents(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2).select("text")
    vocabulary, params, counts = language_model.fit(train)
    got = language_model.score(docs.select("doc_id", F.length("text").alias("n"), "text"), vocabulary, params, counts).collect()
    assert len(got) == len(rows)
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.setdefault(i, []).append((len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}


def test_probabilities_add_up(documents):
    docs = documents([(i, sentence(60, i % 9)) for i in range(40)])
    vocabulary, params, _ = language_model.fit(docs.select("text"))
    scorer = language_model.Scorer(params, vocabulary.live)
    live = np.flatnonzero(vocabulary.live)
    for one, two in ((1, 1), (2, 1), (5, 3), (0, 7)):
        p = np.exp(scorer(live, np.full(len(live), one), np.full(len(live), two)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-4)


def test_score_equals_plain_python(documents):
    rng = np.random.default_rng(5)
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(f"w{x}x{x % 7}" for x in rng.zipf(1.1, 60) % 5000)) for i in range(50)]
    docs = documents(rows)
    train = {i: t for i, t in rows if i < 40}
    vocabulary, p, counts = language_model.fit(docs.where("doc_id < 40").select("text"))
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs.select("doc_id", "text"), vocabulary, p, counts).collect()}
    c = Counter(w for t in train.values() for w in tokens(t))

    def place(word):  # hash, class and tail of a word
        h = language_model.hashed(Text(pa.array([word]), lower=True))[0]
        return int(vocabulary.look(h)[0][0]), int(h[0]) & (language_model.TAILS - 1)

    where = {w: place(w) for _, t in rows for w in tokens(t)}
    tails = Counter()
    for w in c:
        if where[w][0] < language_model.TAILS:
            tails[where[w][1]] += c[w] + 1
    end = language_model.END
    for i, t in rows:
        one = two = end
        total = 0.0
        for w in [*tokens(t), None]:
            target = end if w is None else where[w][0]
            s = np.where(vocabulary.live, (p["r"][one] @ p["c1"] + p["r"][two] @ p["c2"]).astype(float) @ p["r"].T + p["b"], -np.inf)
            total += s[target] - s.max() - math.log(np.exp(s - s.max()).sum())
            if w is not None and target < language_model.TAILS:
                total += math.log((c[w] + 1) / (tails[target] + 1))
            one, two = target, one
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4)


def test_model_beats_its_base(documents):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):  # two languages: what came before tells a lot
        p = "ab"[i % 2]
        rows.append((i, " ".join(f"{p}{x}" for x in rng.zipf(1.3, 100) % 200)))
    docs = documents(rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    vocabulary, params, counts = language_model.fit(docs.where(~held).select("text"))
    got = language_model.score(docs.where(held).select("doc_id", "text"), vocabulary, params, counts).collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.95


def test_model_without_training(documents, edge_rows):
    vocabulary, params, counts = language_model.fit(documents([]).select("text"))
    got = language_model.score(documents(edge_rows).select("doc_id", "text"), vocabulary, params, counts).collect()
    assert len(got) == len(edge_rows) and all(r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lower("ÀB") == "Àb"


def test_a_long_text_is_sorted_once_where_leading_bits_clash(documents, monkeypatch):
    """The sort of whole hashes stood inside a lambda, which did it again for each place."""
    monkeypatch.setattr(quality_rules, "PLACE", 50)
    rng = random.Random(1)
    w = [f"w{rng.randint(0, 40)}" for _ in range(20_000)]
    began = time.monotonic()
    (row,) = quality_rules.base(documents([(1, " ".join(w))]).select("doc_id", "text")).collect()
    assert time.monotonic() - began < 20
    many = {x for x, n in Counter(zip(w, w[1:], w[2:])).items() if n > 1}
    assert row["n_repeat_words"] == len({i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if x in many for j in range(3)})
