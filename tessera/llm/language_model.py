"""Scoring text with a log-bilinear neural language model.

The model predicts classes, of which there are ``CLASSES``: the end of a text, the most
frequent words, one each, and ``TAILS`` classes of all other words by their last two bytes.
A word's probability is that of its class in its context times its add-one share of the
counts of its class (a class-factored softmax), so every word of the corpus has a place,
however many there are, and the whole is a distribution over all words and one "unseen" a
tail class. The vector of the next class is predicted from the vectors r of the last two by
one matrix a place, q = r[w-1] C1 + r[w-2] C2, and class w scores q . r[w] + b[w]. It is
trained with noise-contrastive estimation against the unigram distribution. A warm start
comes from a bounded sample (about ``WARM_DOCS`` different training texts, chosen by the
hash of the text, in one task); from it each task makes one pass over all its training
tokens, and the parameters are averaged, weighted by tokens: other file splits give slightly
other parameters, the same splits the same. For scoring, batched matrix products give the
scores of all classes after each context that occurs, and so normalised log-probabilities.

Counts cover all training documents. The ``COUNTED`` most frequent words travel to the
tasks as a table of fixed size; the counts of rarer ones are joined, one row for each
distinct word of a document. Words are told apart by 56 bits of hash and their ending's 8.

Cases: null text is the empty text: one end token. Without training documents N and V
are 0 and every word is unseen. A null id counts as the empty text. Repeated rows are
counted and scored each. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tally, Text, chunks, cut, id_text, mix64, signed, to_arrow

CLASSES, TAILS, DIM = 1536, 256, 32
COUNTED = 1 << 17
BATCH, NOISE = 2048, 64
#: AdaGrad's rate and the squares it starts from, for the warm start and for the pass over everything.
WARM, FULL = (0.1, 1e-7), (0.05, 1e-5)
#: Documents of the warm start, and tokens that it sees, going over a smaller sample again (8 times at most).
WARM_DOCS, WARM_TOKENS = 3000, 1_000_000
#: Classes 0 to TAILS - 1 are tails; then the end, then the frequent words.
END = TAILS
HEAD = CLASSES - TAILS - 1


def hashed(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word whose low byte is its tail class, and each text's first word (n + 1)."""
    s, e, first = text.words()
    last = text.bytes[e - 1].astype(np.uint64)
    before = np.where(e - s > 1, text.bytes[np.maximum(e - 2, 0)], 0).astype(np.uint64)
    ending = mix64(last << np.uint64(8) | before) & np.uint64(TAILS - 1)
    return text.hash_runs(s, e) & ~np.uint64(TAILS - 1) | ending, first




def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): the words of all training texts, by hash."""

    def run(batches):
        tally = Tally()

        def out(parts):
            for keys, n in parts:
                yield pa.RecordBatch.from_pydict({"h": signed(keys), "n": n})

        for batch in batches:
            for part in chunks(batch, "text"):
                yield from out(tally.add(hashed(Text(part.column("text"), lower=True))[0]))
        yield from out(tally.rest())

    return train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Classes and counts of the frequent words, by hash, and the totals of the tails."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, all_n: np.ndarray, all_v: np.ndarray) -> None:
        """``hashes``, ``counts``: the frequent words, most frequent first; ``all_n`` and ``all_v``: tokens
        and distinct words of each ending, of all words."""
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.classes = np.where(order < HEAD, order + END + 1, (self.hashes & np.uint64(TAILS - 1)).astype(np.int64))
        self.ends, self.n, self.v = ends, int(all_n.sum()) + ends, int(all_v.sum()) + (ends > 0)
        head, ending = counts[:HEAD], (hashes[:HEAD] & np.uint64(TAILS - 1)).astype(np.int64)
        tail_n = all_n - np.bincount(ending, head, TAILS).astype(np.int64)
        #: What a tail word's count is held against: the tokens and words of its class, and the unseen one.
        self.tail = tail_n + all_v - np.bincount(ending, minlength=TAILS) + 1
        per_class = np.zeros(CLASSES)
        per_class[END + 1 : END + 1 + len(head)] = head
        per_class[:TAILS], per_class[END] = tail_n + 1, ends + 1
        self.live = per_class > 0
        self.noise = per_class / per_class.sum()

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; count -1 where the table has none."""
        tails = (h & np.uint64(TAILS - 1)).astype(np.int64)
        if not len(self.hashes):
            return tails, np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.classes[at], tails), np.where(hit, self.counts[at], -1)

    def base(self, c):
        return np.log10((c + 1) / (self.n + self.v + 1))


def start(vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "r": rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32),
        "c1": np.eye(DIM, dtype=np.float32) * 0.5,
        "c2": np.eye(DIM, dtype=np.float32) * 0.5,
        "b": np.log(np.maximum(vocabulary.noise, 1e-12)).astype(np.float32),
    }


def sequences(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets and the two entries before each, texts one after the other, each closed by its end."""
    n = np.diff(first)
    out = np.full(len(classes) + len(n), END)
    out[np.arange(len(classes)) + np.repeat(np.arange(len(n)), n)] = classes
    one = np.concatenate([[END], out[:-1]])
    two = np.where(one == END, END, np.concatenate([[END, END], out[:-2]])[: len(out)])
    return out, one, two


def _scatter(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    index = index[order]
    at = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[at], np.add.reduceat(rows[order], at, axis=0)


class Trainer:
    """Noise-contrastive estimation with AdaGrad. A batch's targets share their noise words."""

    def __init__(self, params: dict[str, np.ndarray], noise: np.ndarray, seed: int, rate: float, squares: float) -> None:
        self.p = {k: v.copy() for k, v in params.items()}
        self.g = {k: np.full_like(v, squares) for k, v in params.items()}
        self.rate = rate
        self.cum, self.log_noise = np.cumsum(noise), np.log(np.maximum(noise, 1e-12)).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def _step(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        self.g[name][at] += grad * grad
        self.p[name][at] += self.rate * grad / np.sqrt(self.g[name][at])

    def batch(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        r, b, c1, c2 = self.p["r"], self.p["b"], self.p["c1"], self.p["c2"]
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
        r1, r2, rt, rn = r[one], r[two], r[target], r[noise]
        q = r1 @ c1 + r2 @ c2
        shift = np.float32(np.log(NOISE))
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, rt) + b[target] - shift - self.log_noise[target]))  # 1 - P(from data)
        down = -1 / (1 + np.exp(-(q @ rn.T + b[noise] - shift - self.log_noise[noise])))
        scale = np.float32(1 / len(target))
        up *= scale
        down *= scale
        dq = up[:, None] * rt + down @ rn
        index = np.concatenate([target, noise, one, two])
        at, grad = _scatter(index, np.concatenate([up[:, None] * q, down.T @ q, dq @ c1.T, dq @ c2.T]))
        self._step("c1", r1.T @ dq)
        self._step("c2", r2.T @ dq)
        self._step("r", grad, at)
        self._step("b", np.bincount(np.concatenate([target, noise]), np.concatenate([up, down.sum(0)]), len(b)).astype(np.float32))


def descend(texts: DataFrame, vocabulary: Vocabulary, begin: dict[str, np.ndarray], rate: float, squares: float, least: int = 0) -> dict[str, np.ndarray]:
    """Each task goes over its texts once from ``begin`` (again, 8 times at most, until it has seen
    ``least`` tokens); the result is the average by tokens. What comes back is one number a parameter."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, begin))

    def run(batches):
        v, params = shared.value
        trainer = Trainer(params, v.noise, 1 + (TaskContext.get().partitionId() if TaskContext.get() else 0), rate, squares)
        tokens, again = 0, []

        def learn(x):
            order = trainer.rng.permutation(len(x[0]))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                trainer.batch(*(a[some] for a in x))
            return len(order)

        for batch in batches:
            for part in chunks(batch, "text"):
                h, first = hashed(Text(part.column("text"), lower=True))
                x = sequences(v.look(h)[0], first)
                tokens += learn(x)
                if least:
                    again.append(x)
        once = tokens
        while once and tokens < min(least, 8 * once):
            tokens += sum(map(learn, again))
        if once:
            flat = np.concatenate([trainer.p[k].ravel() for k in sorted(params)]).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat)), "s": flat * once, "w": np.full(len(flat), float(once))})

    got = texts.select("text").mapInArrow(run, "i long, s double, w double").groupBy("i").agg((F.sum("s") / F.sum("w")).alias("v"))
    got = to_arrow(got).sort_by("i")
    if not got.num_rows:
        return begin
    flat, out, at = np.asarray(got.column("v").combine_chunks()), {}, 0
    for k in sorted(begin):
        out[k] = flat[at : at + begin[k].size].reshape(begin[k].shape).astype(np.float32)
        at += begin[k].size
    return out


def train(texts: DataFrame, vocabulary: Vocabulary, n: int) -> dict[str, np.ndarray]:
    """The parameters after the warm start and the pass over all ``n`` texts."""
    share = min(1.0, WARM_DOCS / max(n, 1))
    # each text once: copies of a chosen text, and texts that are null, would crowd the one task
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < round(share * (1 << 30))
    sample = texts.where("text is not null").where(chosen).dropDuplicates(["text"])
    warm = descend(sample.repartition(1), vocabulary, start(vocabulary), *WARM, least=WARM_TOKENS)
    return descend(texts, vocabulary, warm, *FULL)


_scorers: dict[str, "Scorer"] = {}


class Scorer:
    """Normalised log-probabilities; the normaliser of a context is worked out when it first occurs."""

    def __init__(self, params: dict[str, np.ndarray], live: np.ndarray) -> None:
        self.r, self.b = params["r"], np.where(live, params["b"], -np.inf).astype(np.float32)
        self.a1, self.a2 = self.r @ params["c1"], self.r @ params["c2"]
        self.log_z = np.full(CLASSES * CLASSES, np.nan, np.float32)

    def __call__(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        context = one * CLASSES + two
        new = np.unique(context[np.isnan(self.log_z[context])])
        for i in range(0, len(new), 2048):
            c = new[i : i + 2048]
            s = (self.a1[c // CLASSES] + self.a2[c % CLASSES]) @ self.r.T + self.b
            top = s.max(1)
            self.log_z[c] = top + np.log(np.exp(s - top[:, None]).sum(1))
        out = np.empty(len(target))
        for i in range(0, len(target), 65536):
            t, x, y = target[i : i + 65536], one[i : i + 65536], two[i : i + 65536]
            out[i : i + 65536] = np.einsum("ij,ij->i", self.a1[x] + self.a2[y], self.r[t]) + self.b[t]
        return out - self.log_z[context]


def score(docs: DataFrame, vocabulary: Vocabulary, params: dict[str, np.ndarray], counts: DataFrame) -> DataFrame:
    """``docs`` (text and slim columns) plus n_tokens, n_known, train_tokens, base_score, score."""
    keep = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, params))

    def run(batches):
        token, v, p = shared.value
        if token not in _scorers:
            _scorers.clear()
            _scorers[token] = Scorer(p, v.live)
        scorer = _scorers[token]
        for batch in batches:
            for part in chunks(batch, "text"):
                h, first = hashed(Text(part.column("text"), lower=True))
                n = np.diff(first)
                classes, c = v.look(h)
                doc = np.repeat(np.arange(len(n)), n)
                total = np.bincount(np.repeat(np.arange(len(n)), n + 1), scorer(*sequences(classes, first)), len(n)) / np.log(10)
                counted = c >= 0
                own = np.where(counted & (classes < TAILS), np.log10((np.maximum(c, 0) + 1) / v.tail[np.minimum(classes, TAILS - 1)]), 0)
                total += np.bincount(doc, own, len(n))
                base = np.bincount(doc, np.where(counted, v.base(np.maximum(c, 0)), 0), len(n)) + v.base(v.ends)
                known = np.bincount(doc, counted, len(n)).astype(np.int64) + (v.ends > 0)
                uid = np.asarray(part.column("_uid"))
                # a document's own row has a key that no word has by more than chance, and multiplicity 0
                rows = {"_uid": part.column("_uid"), "h": uid * np.int64(-7046029254386353131) + 12345, "m": np.zeros(len(n), np.int64), "n_tokens": n + 1, "known": known, "base": base, "score": total}
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(x) for x in rows.values()], names=[*keep, *rows])
                # one row for each distinct rarer word of a document
                rare = np.flatnonzero(~counted)
                if len(rare):
                    order = np.lexsort((h[rare], doc[rare]))
                    d, w = doc[rare][order], h[rare][order]
                    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
                    none = [pa.nulls(len(at), part.column(k).type) for k in keep]
                    m = np.diff(np.concatenate([at, [len(d)]]))
                    rows = {"_uid": uid[d[at]], "h": signed(w[at]), "m": m, "n_tokens": pa.nulls(len(at), pa.int64()), "known": pa.nulls(len(at), pa.int64()), "base": pa.nulls(len(at), pa.float64()), "score": pa.nulls(len(at), pa.float64())}
                    yield pa.RecordBatch.from_arrays(none + [x if isinstance(x, pa.Array) else pa.array(x) for x in rows.values()], names=[*keep, *rows])

    v = vocabulary
    scored = docs.withColumn("_uid", F.monotonically_increasing_id()).mapInArrow(run, f"{kinds}, _uid long, h long, m long, n_tokens long, known long, base double, score double")
    c = F.coalesce("c", F.lit(0))
    tail = F.element_at(F.array(*[F.lit(float(x)) for x in v.tail]), (F.col("h").bitwiseAND(TAILS - 1) + 1).cast("int"))
    out = (
        scored.join(counts, "h", "left").groupBy("_uid")
        .agg(
            *[F.max(k).alias(k) for k in keep], F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("known", F.when(c > 0, F.col("m")).otherwise(0))).cast("long").alias("n_known"),
            F.sum(F.coalesce("base", F.col("m") * F.log10((c + 1) / F.lit(float(v.n + v.v + 1))))).alias("base_score"),
            F.sum(F.coalesce("score", F.col("m") * F.log10((c + 1) / tail))).alias("score"),
        )
        .select(*keep, "n_tokens", "n_known", F.lit(v.n).cast("long").alias("train_tokens"), "base_score", "score")
    )
    return cut(out, "scores")


def fit(texts: DataFrame) -> tuple[Vocabulary, dict[str, np.ndarray], DataFrame]:
    """The vocabulary, the parameters and the table of all counts (h, c)."""
    counts = cut(word_counts(texts), "counts")
    all_n, all_v = np.zeros((2, TAILS), np.int64)
    for r in counts.groupBy(F.col("h").bitwiseAND(TAILS - 1).alias("t")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        all_n[r["t"]], all_v[r["t"]] = r["n"], r["v"]
    top = counts.orderBy(F.desc("c"), "h").limit(COUNTED).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    hashes = np.asarray(top.column("h").combine_chunks()).view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    freq = np.asarray(top.column("c").combine_chunks()) if top.num_rows else np.zeros(0, np.int64)
    n = texts.count()
    vocabulary = Vocabulary(hashes, freq, n, all_n, all_v)
    return vocabulary, train(texts, vocabulary, n), counts


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(id_text(F.col("doc_id"))) % 7 == 2
    vocabulary, params, counts = fit(docs.where(~held).select("text"))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), vocabulary, params, counts)
