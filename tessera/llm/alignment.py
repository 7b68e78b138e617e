"""Aligning the tokens of two tokenizers over the same bytes.

Both tokenizers cut a text into byte ranges. The ends that both share cut it into groups;
every token of A in a group is linked with every token of B in it. The ends of both are two
ascending lists, and the groups come from merging them along a *merge path*: diagonals of
the grid of A's ends by B's ends, ``WORK`` apart, each meet the path at one point, which a
binary search finds without merging what lies before. Between two diagonals lies a piece of
equal work that needs nothing from the others; all pieces step at the same time, as numpy
vectors, and emit which token ends next, hence which tokens overlap. Where an end of A and
the equal end of B fall into two pieces, the pieces are stitched: a piece's first end is
compared with the last one of the piece before.

Neither tokenizer merges over a space or line end that follows a character other than white
space (checked on B's vocabulary; a tokenizer that does gets whole texts). So texts are cut
there, each distinct unit is encoded and aligned once in a worker, and a text's groups
are those of its units, one after the other.

How many documents hold an id pair linked is a sum over a table (text, pairs, times). The
pairs of the most documents, ``HOT`` at most, are broadcast to it; all others, none of
which can be in many rows, are joined in a shuffle.

Cases: null and empty texts, and texts whose tokens don't give back the text, have no
tokens: zeros and the empty string. Null, repeated or clashing ids don't matter: every row
is a document. Groups of any length give their links by counts of distinct ids. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Text, cut, gathered, list_array
from tessera.llm.packing import _after_space

#: Ends that one piece of a merge path settles, and pieces that step together.
WORK, PIECES = 64, 1 << 14
#: Bytes of text handled at once, units encoded as one string, units and bytes that a worker remembers.
CHUNK, TOGETHER, REMEMBER, REMEMBER_BYTES = 4 << 20, 1 << 14, 1 << 19, 64 << 20
#: Groups of more links than this are counted by distinct ids; links listed at once.
WIDE, LISTED = 1 << 12, 1 << 21
#: Pairs that are broadcast at most.
HOT = 1 << 18
#: Bits of a B id in a pair.
B_BITS = 15

_tools: dict[tuple[str, str], Aligner] = {}


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first d of the merged list, for each diagonal d (equal ends: a's first)."""
    lo, hi = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.where(open_, mid, 0)
        more = open_ & (a[np.minimum(at, len(a) - 1)] <= b[np.clip(diagonals - 1 - at, 0, len(b) - 1)])
        lo = np.where(more, mid + 1, lo)
        hi = np.where(open_ & ~more, mid, hi)
    return lo


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the merged list of two ascending lists of ends: whether it is one of ``a``'s, and
    whether it closes a group, being one of ``b``'s equal to the end before it."""
    total = len(a) + len(b)
    of_a, closes = np.zeros(total, bool), np.zeros(total, bool)
    if not len(a) or not len(b):
        of_a[:] = len(a) > 0
        return of_a, closes
    far = np.int64(1) << np.int64(62)
    a_end, b_end = np.append(a, far), np.append(b, far)
    diagonals = np.arange(0, total, work)
    first, last = np.zeros(len(diagonals), np.int64), np.zeros(len(diagonals), np.int64)
    for p in range(0, len(diagonals), pieces):
        d = diagonals[p : p + pieces]
        i = crossings(a, b, d)
        j = d - i
        before = np.full(len(d), -1, np.int64)
        for t in range(min(work, total - int(d[0]))):
            if d[-1] + t >= total:  # only the last piece may be short
                d, i, j, before = d[:-1], i[:-1], j[:-1], before[:-1]
            x, y = a_end[i], b_end[j]
            take = x <= y
            end = np.where(take, x, y)
            of_a[d + t] = take
            closes[d + t] = end == before
            if t == 0:
                first[p : p + len(d)] = end
            last[p : p + len(d)] = end
            i, j, before = i + take, j + ~take, end
    # stitched: an end of a at the end of a piece, the equal one of b at the start of the next
    closes[diagonals[1:]] = last[:-1] == first[1:]
    return of_a, closes


def groups_of(of_a: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of each token of B, from 0."""
    group = np.cumsum(closes) - closes
    return group[of_a], group[~of_a]


def overlaps(a: np.ndarray, b: np.ndarray, of_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of A and B that share bytes, as (A's place, B's place, first byte, end), in order."""
    i, j = np.cumsum(of_a) - of_a, np.cumsum(~of_a) - ~of_a
    end = np.where(of_a, a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)])
    begin = np.concatenate([[0], end[:-1]])
    some = end > begin
    return i[some], j[some], begin[some], end[some]


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(weights, at)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (n[k] of them) for each k."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Aligner:
    """The two tokenizers, and what the units seen so far came to."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        byte_of = _byte_level()
        self.bytes_a = [bytes(byte_of.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.width_a, self.width_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.splits = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        # decimal ids with what follows them: a comma, or the end of A's or B's side of a group
        self.told = pa.array([f"{i}{x}" for x in ",|" for i in range(n_a)] + [f"{i}{x}" for x in ",;" for i in range(n_b)], pa.large_string())
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.n_a = self.n_b = self.n_groups = self.n_links = np.zeros(0, np.int64)
        self.valid = np.zeros(0, bool)
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts = pa.array([], pa.large_binary())

    # --- encoding -----------------------------------------------------------------------

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a unit that begins with a space or a line end (B puts a space before what it gets, unless that is empty)."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1) if text != " " else [self.b.piece_to_id("▁")]
        return np.array(a, np.int64), np.array(b if text[0] == " " else b[1:], np.int64)

    def _alone(self, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of one unit, or None if its tokens aren't its bytes."""
        a, b = self._ids(raw.decode())
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        return (a, b) if same else None

    def _encoded(self, units: list[bytes], plain: np.ndarray) -> tuple[list, np.ndarray]:
        """[(A's ids, B's ids)] and whether each unit has tokens. ``plain`` units may stand one after the other."""
        out: list = [None] * len(units)
        rest = np.flatnonzero(~plain).tolist()
        runs = np.flatnonzero(plain)
        for k in range(0, len(runs), TOGETHER):
            some = runs[k : k + TOGETHER].tolist()
            raw = b" x" + b"".join([units[i] for i in some])
            ids = self._ids(raw.decode())
            upto = np.cumsum([2] + [len(units[i]) for i in some])
            split = []
            for x, table, width in zip(ids, (self.bytes_a, self.bytes_b), (self.width_a, self.width_b)):
                ends = np.cumsum(width[x])
                at = np.searchsorted(ends, upto) + 1
                if b"".join(map(table.__getitem__, x.tolist())) != raw or at[-1] > len(ends) or not np.array_equal(ends[at - 1], upto):
                    break
                split.append(np.split(x, at[:-1])[1:])
            if len(split) == 2:
                for i, a, b in zip(some, *split):
                    out[i] = a, b
            else:
                rest += some
        for i in rest:
            out[i] = self._alone(units[i])
        none = np.zeros(0, np.int64)
        valid = np.array([x is not None for x in out], bool)
        return [x or (none, none) for x in out], valid

    # --- aligning -----------------------------------------------------------------------

    def _links(self, unit: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (unit, pair) keys and how often each is linked; unit, m, n: of each group."""
        first_a, first_b, size = np.cumsum(m) - m, np.cumsum(n) - n, m * n
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in np.flatnonzero(size > WIDE).tolist():
            x, cx = np.unique(a[first_a[g] : first_a[g] + m[g]], return_counts=True)
            y, cy = np.unique(b[first_b[g] : first_b[g] + n[g]], return_counts=True)
            keys.append((unit[g] << 32 | (x[:, None] << B_BITS | y[None, :])).ravel())
            times.append((cx[:, None] * cy[None, :]).ravel())
        few = np.flatnonzero((size > 0) & (size <= WIDE))
        upto = np.cumsum(size[few])
        for lo, hi in _slabs(upto, LISTED):
            g = few[lo:hi]
            k = _spread(np.zeros(len(g), np.int64), size[g])
            of = np.repeat(g, size[g])
            key, c = np.unique(unit[of] << 32 | (a[first_a[of] + k // n[of]] << B_BITS | b[first_b[of] + k % n[of]]), return_counts=True)
            keys.append(key)
            times.append(c)
        return _sums(np.concatenate(keys), np.concatenate(times))

    def _learn(self, new: pa.LargeStringArray) -> None:
        off = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1]
        raw = new.buffers()[2].to_pybytes()
        all_bytes = np.frombuffer(raw, np.uint8)
        units = [raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        odd = _holds(raw, "▁".encode(), off)
        ids, valid = self._encoded(units, ~(_space_end(all_bytes, off) | odd) & self.splits)
        n_a, n_b = (np.array([len(x[s]) for x in ids], np.int64) for s in (0, 1))
        a, b = (np.concatenate([x[s] for x in ids]) for s in (0, 1))
        of_a, closes = merge(np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b]))
        group_a, group_b = groups_of(of_a, closes)
        groups = int(closes.sum())
        m, n = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        unit = np.repeat(np.arange(len(units)), n_a)[np.cumsum(m) - m] if groups else np.zeros(0, np.int64)
        keys, times = self._links(unit, a, b, m, n)
        # the decimal text: A's ids of a group, then B's
        told = np.zeros(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        v_a, v_b = len(self.width_a), len(self.width_b)
        told[np.arange(len(a)) + (np.cumsum(n) - n)[group_a]] = a + v_a * last_a
        told[np.arange(len(b)) + np.cumsum(m)[group_b]] = 2 * v_a + b + v_b * last_b
        text = self.told.take(pa.array(told))
        at = np.frombuffer(text.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(n_a + n_b)])] if len(text) else np.zeros(len(units) + 1, np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(np.ascontiguousarray(at)), text.buffers()[2]])

        self.known = pa.concat_arrays([self.known, new])
        self.texts = pa.concat_arrays([self.texts, texts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(keys >> 32, minlength=len(units)))])
        for name, more in (("pairs", keys & 0xFFFFFFFF), ("times", times), ("n_a", n_a), ("n_b", n_b), ("valid", valid),
                           ("n_groups", np.bincount(unit, minlength=len(units))), ("n_links", np.bincount(unit, m * n, len(units)).astype(np.int64))):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def align(self, column: pa.Array, with_groups: bool = False) -> dict[str, pa.Array]:
        """What each text of a column comes to; its pairs (as A id << B_BITS | B id) and how often each is linked."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        some = np.asarray(pc.binary_length(column)) > 0
        text = Text(pc.if_else(pa.array(some), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column), lower=False)
        b, begins = text.bytes, np.zeros(len(text.bytes) + 1, bool)
        if self.splits:
            at = np.flatnonzero((b == 32) | (b == 10))
            at = at[at > 0]
            begins[at[~_after_space(b, at)]] = True
        begins[text.off[:-1][some]] = True
        off = np.append(np.flatnonzero(begins[:-1]), len(b)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(b)).dictionary_encode()
        names = units.dictionary.cast(pa.large_string())
        place = pc.index_in(names, value_set=self.known)
        new = names.filter(place.is_null())
        if len(new):
            if len(self.known) > REMEMBER or self.known.nbytes + self.texts.nbytes > REMEMBER_BYTES:
                self._forget()
                new = names
            self._learn(pa.concat_arrays([new]))
            place = pc.index_in(names, value_set=self.known)
        unit = np.asarray(place).astype(np.int64)[np.asarray(units.indices)]
        first = np.searchsorted(off[:-1], text.off)  # of each text, its first unit
        doc = np.repeat(np.arange(text.n), np.diff(first))
        bad = np.zeros(text.n, bool)
        bad[doc[~self.valid[unit]]] = True
        told = {c: np.bincount(doc, np.where(bad[doc], 0, getattr(self, c)[unit]), text.n).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        # distinct units of each text, then their pairs
        span = max(len(self.known), 1)
        keys, seen = np.unique((doc * span + unit)[~bad[doc]], return_counts=True)
        u, of = keys % span, keys // span
        n = self.first[u + 1] - self.first[u]
        at = _spread(self.first[u], n)
        keys, times = _sums(np.repeat(of << 32, n) | self.pairs[at], np.repeat(seen, n) * self.times[at])
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys >> 32, minlength=text.n))])
        groups = self.texts.take(pa.array(unit))
        data = groups.buffers()[2]
        upto = np.frombuffer(groups.buffers()[1], np.int64)[first] if len(groups) else np.zeros(text.n + 1, np.int64)
        view = memoryview(data) if data is not None else memoryview(b"")
        lines = [None if x or i == j else view[i : j - 1] for x, i, j in zip(bad.tolist(), upto[:-1].tolist(), upto[1:].tolist())]
        out = {c: pa.array(v) for c, v in told.items()}
        out["groups_sha256"] = pa.array(["" if x is None else hashlib.sha256(x).hexdigest() for x in lines], pa.string())
        out["pairs"] = list_array((keys & 0xFFFFFFFF).astype(np.int32), ends)
        out["times"] = list_array(times.astype(np.int64), ends)
        if with_groups:
            out["groups"] = pa.array(["" if x is None else bytes(x).decode() for x in lines], pa.string())
        return out


def _slabs(upto: np.ndarray, most: int):
    """Ranges of places whose sizes (given as running sums) come to about ``most``."""
    at, done = 0, 0
    while at < len(upto):
        to = max(int(np.searchsorted(upto, done + most, "right")), at + 1)
        yield at, to
        at, done = to, int(upto[to - 1])


def _space_end(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each run of bytes ends in white space."""
    return _after_space(b, off[1:])


def _holds(raw: bytes, part: bytes, off: np.ndarray) -> np.ndarray:
    """Which runs of ``raw`` hold a part."""
    out, at = np.zeros(len(off) - 1, bool), raw.find(part)
    while at >= 0:
        out[np.searchsorted(off, at, "right") - 1] = True
        at = raw.find(part, at + len(part))
    return out


def _byte_level() -> dict[str, int]:
    """Byte-level BPE writes a printable byte as itself and the others, in order, as characters from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _tools:
        _tools[path_a, path_b] = Aligner(path_a, path_b)
    return _tools[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, uid) of every row, as a table; with
    ``with_groups`` also the groups themselves, as text. uid names the row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        tool = aligner(path_a, path_b)
        for part in gathered(batches, "text", CHUNK):
            told = tool.align(part.column("text"), with_groups)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *told.values()], names=["doc_id", *told])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in longs)}, groups_sha256 string, pairs array<int>, times array<long>" + ", groups string" * with_groups
    return cut(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each pair is linked, and whether no pair of its A id is in more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    a_id = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("most"))  # one row for each id of A's vocabulary
    return cut(counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pairs")


def rated(aligned: DataFrame, hot_pairs: int = HOT) -> DataFrame:
    """(uid, n_best, count_sum) of the rows with links."""
    counts = pair_counts(aligned)
    bits = F.length(F.bin("docs"))
    sizes, least, held = counts.groupBy(bits.alias("bits")).count().collect(), 64, 0  # at most 64 rows
    for row in sorted(sizes, reverse=True):
        if held + row["count"] > hot_pairs:
            break
        least, held = row["bits"], held + row["count"]
    hot, cold = counts.where(bits >= least), counts.where(bits < least)
    links = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("uid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    known = links.join(F.broadcast(hot), "pair")
    others = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(cold, "pair")
    both = known.unionByName(others)
    return both.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    zero = F.lit(0).cast("long")
    told = aligned.drop("pairs", "times").join(rated(aligned), "uid", "left")
    return told.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
