"""Fuzzy line deduplication with SimHash.

A line's normal form is its words, A-Z in lower case and ASCII punctuation removed. Equal
normal forms are one class. The SimHash of a class consists of blocks of 64 bits: every
word is dealt to one block by its hash, and a block's bits are the majority vote of its own
distinct words. So one changed word touches two blocks at most, wherever in the line it is and
however words shift; d changed words leave a block untouched as long as 2 d is less than the
number of blocks (pigeonhole), and by chance often beyond. ``LEVELS`` gives the blocks by
the number of words; classes meet on equal blocks (short lines: on equal pairs of blocks)
in which two words or more voted, of some weight together (a word weighs its bytes less
two, eight at most), so that common short words alone bring nothing together. Lines with
fewer words than the first level meet on their words less one or two, and very short ones
on their characters less one. Scripts without spaces count each character as a word of
weight three, words over ``LONG`` bytes are taken in pieces.

Classes that meet are linked if the edit similarity of their normal forms, 1 - levenshtein
/ longer length, is at least ``SIMILARITY``. Of each connected group of lines the first
occurrence (by document id, then line) stays in its document; all other lines of the group
go.

Cases: lines without a word (after normalising) always stay; null text stays null with
0 lines; null ids come last in the order of occurrences. Rows with the same id and
text are one document: they get the same result. Lines are told apart by a 64-bit hash of
the normal form. Other columns, whatever their names, pass through ``dedup`` unread. An
empty table gives an empty one. Pairs whose changes touch every block are missed: README.md
has the measured recall.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SMALL_CHUNK, Text, bitmap, chunks, cut_hashes, from_signed, in_bitmap, join_on, looked_up, mix64, signed
from tessera.llm.linking import connect

SIMILARITY = 0.9
#: From so many words on, so many blocks, how many of them a key takes, and the weight of the words that it needs.
LEVELS = ((8, 6, 2, 6), (24, 7, 1, 10), (48, 12, 1, 12), (96, 16, 1, 12))
#: A line can have a partner of the level below it: up to this many times a level's first words it has keys of both.
OVERLAP = 1.08
#: Weight of the words that a key of shorter lines needs; bytes from which a word is taken in pieces of eight bytes; lines of so many characters meet on theirs less one.
LEAST, LONG, TINY = 6, 32, (9, 20)
#: Lines that a task remembers having handled; beyond, it begins anew (repeated rows fall together later).
SEEN = 1 << 20
#: Places for the blocks of the lines handled at once.
PLACES = 1 << 22
#: Lines are compared together in bands of up to so many 64-bit numbers; at least so many pairs for each number, at most so many at once.
BAND_WORDS, BAND_LEAST, BAND_PAIRS = 8, 32, 4096
#: Pairs, and characters of theirs, that are gathered before they are compared.
HELD, HELD_CHARS = 16384, 1 << 24
#: Members of a key, and bytes of their lines, in a slice of those that are held against each other.
SLICE, SLICE_BYTES = 512, 8 << 20
#: Rows for each task that compares: with few of them its bands aren't filled.
COMPARED = 8192
#: Keys are dealt by their first bits to so many bags; entries that a task gathers before it fills bags, or holds of one bag.
BAGS, FILL, EMPTY = 2048, 1 << 19, 1 << 20
#: Groups of bytes, 32 of them, whose counts bound the edits between two lines from below; eight counts a number.
_GROUP = np.where((np.arange(256) >= 97) & (np.arange(256) <= 122), np.arange(256) - 97, 26 + np.arange(256) % 6)
COUNTS = ("c0", "c1", "c2", "c3")
_DROP = np.zeros(256, bool)
_DROP[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: All bytes of a character but its first.
_INNER = (np.arange(256) & 0xC0) == 0x80
_SPREAD = np.array([int.from_bytes(bytes((x >> j) & 1 for j in range(8)), "little") for x in range(256)], np.uint64)
#: First bytes of characters of scripts that mostly don't put spaces between words.
_UNSPACED = np.zeros(256, bool)
_UNSPACED[[0xE0, *range(0xE3, 0xF8)]] = True


class Lines(Text):
    """The lines of a chunk of texts, normalised: like Text, with ``doc`` and ``no`` of each line."""

    def __init__(self, column: pa.Array) -> None:
        super().__init__(column, lower=True)
        newline = np.flatnonzero(self.bytes == 10) + 1
        begin = np.sort(np.concatenate([self.off[:-1], newline]))  # an empty text is one empty line
        # a newline that ends a text begins an empty last line there, before the next text's first line
        counts = np.ones(self.n, np.int64)
        np.add.at(counts, np.searchsorted(self.off, newline - 1, side="right") - 1, 1)
        self.doc = np.repeat(np.arange(self.n), counts)
        self.no = np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
        drop = looked_up(_DROP, self.bytes)
        self.bytes = self.bytes[~drop]
        edges = np.concatenate([begin, self.off[-1:]])
        self.off = edges - np.searchsorted(np.flatnonzero(drop), edges)
        self.n = len(begin)
        self.starts, self.ends, self.first = self.words()
        self.hashed = self.hash_runs(self.starts, self.ends)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, the hash of their words)."""
        count = np.diff(self.first)
        lines = np.flatnonzero(count)
        if not len(lines):
            return lines, np.zeros(0, np.uint64)
        begin, count = self.first[:-1][lines], count[lines]
        place = np.arange(self.first[-1], dtype=np.uint64) - np.repeat(begin, count).astype(np.uint64)
        return lines, mix64(np.add.reduceat(mix64(self.hashed + place * np.uint64(0x9E3779B97F4A7C15)), begin) + count.astype(np.uint64))

    def form(self, i: int) -> bytes:
        """The normal form of a line."""
        return b" ".join(self.bytes[self.off[i] : self.off[i + 1]].tobytes().split())

    def sizes(self) -> np.ndarray:
        """Characters of each normal form."""
        total = np.concatenate([[0], np.cumsum(self.ends - self.starts)])[self.first]
        inner = np.flatnonzero(looked_up(_INNER, self.bytes))
        return np.diff(total - np.searchsorted(inner, self.off)) + np.maximum(np.diff(self.first) - 1, 0)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and weights of what counts as a word when lines meet, and each line's first (n + 1)."""
        s, e, b = self.starts, self.ends, self.bytes
        lead = np.flatnonzero(b >= 0xE0)
        lead = lead[_UNSPACED[b[lead]]]
        unspaced = np.zeros(len(s), bool)
        unspaced[np.searchsorted(s, lead, side="right") - 1] = True
        far = np.flatnonzero((e - s > LONG) & ~unspaced)
        taken = unspaced | (e - s > LONG)
        if not taken.any():
            return self.hashed, np.clip(e - s - 2, 0, 8), self.first
        # such a character is a word of its own, so what follows it begins anew
        begin = np.unique(np.concatenate([s[taken], lead, lead + np.where(b[lead] >= 0xF0, 4, 3), *[np.arange(s[i], e[i], 8) for i in far]]))
        word = np.searchsorted(s, begin, side="right") - 1
        begin, word = (x[taken[word] & (begin < e[word])] for x in (begin, word))
        end = np.minimum(np.append(begin[1:], len(b)), e[word])
        every, upto = np.concatenate([s[~taken], begin]), np.concatenate([e[~taken], end])
        order = np.argsort(every, kind="stable")  # of two sorted runs
        weight = np.where(_UNSPACED[b[every]], 3, np.clip(upto - every - 2, 0, 8))
        return np.concatenate([self.hashed[~taken], self.hash_runs(begin, end)])[order], weight[order], np.searchsorted(every[order], self.off)

    def meeting(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``lines``, key) of what these lines meet others on."""
        h, weight, first = self.units()
        begin, n = first[:-1][lines], np.diff(first)[lines]
        index, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k, (least, blocks, take, weighty) in enumerate(LEVELS):
            above = LEVELS[k + 1][0] * OVERLAP if k + 1 < len(LEVELS) else np.inf
            some = np.flatnonzero((n >= least) & (n < above))
            for part in np.split(some, range(PLACES // blocks, len(some), PLACES // blocks)) if len(some) else []:
                sim, words, weights = simhash(h, weight, begin[part], n[part], blocks)
                for pick in combinations(range(blocks), take):
                    key = np.full(len(part), np.uint64(k * 4096))
                    for j in pick:
                        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sim[:, j] + np.uint64(j))
                    good = (sum(words[:, j] for j in pick) >= 2) & (sum(weights[:, j] for j in pick) >= weighty)
                    index.append(part[good])
                    keys.append(key[good])
        few = np.flatnonzero(n < LEVELS[0][0] * OVERLAP)
        size = self.sizes()[lines[few]]
        tiny = (size <= TINY[1]) | (n[few] == 1) & (size <= LONG)
        for i in few[tiny & (size >= TINY[0])].tolist():
            mine = less_one(self.form(lines[i]).decode())
            index.append(np.full(len(mine), i))
            keys.append(mix64(np.array(mine, np.uint64)))
        few = few[~tiny | (size >= TINY[1] - 1) & (n[few] > 1)]  # a line of 21 characters can have a partner of 19
        for m in np.unique(n[few]).tolist():
            some = few[n[few] == m]
            at = begin[some][:, None] + np.arange(m)
            words, weights = h[at], weight[at]
            for out in [(), *combinations(range(m), 1), *(combinations(range(m), 2) if m >= 5 else ())]:
                good = weights.sum(1) - weights[:, out].sum(1) >= (LEAST if out else 0)
                index.append(some[good])
                keys.append(mix64(words.sum(1) - words[:, out].sum(1) ^ np.uint64(0x5851F42D4C957F2D))[good])
        return np.concatenate(index), np.concatenate(keys)


def simhash(h: np.ndarray, weight: np.ndarray, begin: np.ndarray, n: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of ``n`` words each, whose hashes begin at ``begin`` in ``h``: the blocks of their
    SimHash, and how many distinct words of which weight voted in each."""
    at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
    words = h[at]
    place = np.repeat(np.arange(len(n)), n) * blocks + ((words >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    # a number has the place, 36 bits of the word and its weight; sorted, equal words are neighbours
    packed = place.astype(np.uint64) << np.uint64(40) | mix64(words) >> np.uint64(28) << np.uint64(4) | weight[at].astype(np.uint64)
    packed.sort()
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    place = (packed >> np.uint64(40)).astype(np.int64)
    votes = np.bincount(place, minlength=len(n) * blocks)
    weights = np.bincount(place, (packed & np.uint64(15)).astype(np.float64), len(n) * blocks)
    some = np.flatnonzero(votes)
    count = votes[some]
    at = np.cumsum(count) - count
    # byte-wise counters hold up to 255 words; larger blocks are summed in segments
    parts = (count + 254) // 255
    cuts = np.cumsum(parts) - parts
    starts = np.repeat(at, parts) + (np.arange(parts.sum()) - np.repeat(cuts, parts)) * 255
    octets = mix64(packed & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_SPREAD[octets[:, j]], starts) for j in range(8)], 1).view(np.uint8).reshape(-1, 64)
    if len(starts) > len(some):
        sums = np.add.reduceat(sums.astype(np.int32), cuts, axis=0)
        bits = 2 * sums > count[:, None]
    else:
        bits = sums > (count // 2).astype(np.uint8)[:, None]
    out = np.zeros(len(n) * blocks, np.uint64)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.reshape(-1, blocks), votes.reshape(-1, blocks), weights.reshape(-1, blocks)


def less_one(form: str) -> list[int]:
    """Hashes of a short text, and of it less each character."""
    texts = {form, *(form[:i] + form[i + 1 :] for i in range(len(form)))}
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in texts]


def _new(seen: set[int], h: list[int]) -> list[int]:
    if len(seen) > SEEN:
        seen.clear()
    return [i for i, k in enumerate(h) if not (k in seen or seen.add(k))]


def filled(keys: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(bag, its entries) of keys and ids: an entry is the 16 bytes of a key and an id."""
    bag = (keys >> np.uint64(53)).astype(np.uint16)
    order = np.argsort(bag, kind="stable")
    count = np.bincount(bag, minlength=BAGS)
    some = np.flatnonzero(count)
    ends = np.concatenate([[0], 16 * np.cumsum(count[some])]).astype(np.int32)
    entries = np.stack([keys[order], ids[order]], 1)
    return pa.array(some.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(entries)])


def read_lines(keyed: DataFrame) -> DataFrame:
    """Two kinds of rows from one pass over ``keyed`` (uid, doc_id, text): (uid, doc_id, no, h) of every
    line with a word, and (bag, entries) of the keys that lines meet on, once a task for equal lines.
    A line has some ten keys, so they travel many in a row."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        held, n, schema = [], 0, None

        def bags():
            bag, entries = filled(*(np.concatenate(side) for side in zip(*held)))
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(bag), t) for t in schema.types[:4]], bag, entries], schema=schema)

        for batch in batches:
            for part in chunks(batch, "text", SMALL_CHUNK):
                if schema is None:
                    ours = [("uid", pa.int64()), ("doc_id", part.schema.field("doc_id").type), ("no", pa.int64()), ("h", pa.int64()), ("bag", pa.int32()), ("entries", pa.binary())]
                    schema = pa.schema(ours)
                lines = Lines(part.column("text"))
                at, h = lines.keys()
                doc = pa.array(lines.doc[at])
                where = [part.column("uid").take(doc), part.column("doc_id").take(doc), pa.array(lines.no[at]), pa.array(signed(h))]
                yield pa.RecordBatch.from_arrays([*where, *[pa.nulls(len(at), t) for t in schema.types[4:]]], schema=schema)
                new = np.array(_new(seen, h.tolist()), np.int64)
                line, key = lines.meeting(at[new])
                if len(key):
                    held.append((key, h[new][line]))
                    n += len(key)
                if n >= FILL:
                    yield bags()
                    held, n = [], 0
        if held:
            yield bags()

    return keyed.select("uid", "doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, no long, h long, bag int, entries binary")


def shared_keys(bags: DataFrame) -> DataFrame:
    """(key, id) of the keys that several ids have, out of (bag, entries). What a task holds of a bag gives each
    row once, so only rows of bags that it had to empty in between are held against each other."""

    def met(held: list[np.ndarray], again: bool) -> tuple[pa.RecordBatch, np.ndarray]:
        """The rows of keys with several ids, each once; and one entry of each key, to which later ones are held."""
        x = np.concatenate(held)
        x = x[np.argsort(x[:, 0])]
        begin = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))
        several = np.minimum.reduceat(x[:, 1], begin) < np.maximum.reduceat(x[:, 1], begin)
        key, id_ = x[np.repeat(several, np.diff(np.append(begin, len(x))))].T
        order = np.lexsort((id_, key))
        key, id_ = key[order], id_[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])
        return pa.RecordBatch.from_pydict({"key": signed(key[new]), "id": signed(id_[new]), "again": np.full(new.sum(), again)}), x[begin]

    def run(batches):
        now, held, n, again = None, [], 0, False
        for batch in batches:
            bag = batch.column("bag").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(bag[1:] != bag[:-1]) + 1, [len(bag)]]) if len(bag) else []
            for i, j in zip(cuts, cuts[1:]):
                if held and bag[i] != now:
                    yield met(held, again)[0]
                    held, n, again = [], 0, False
                now = bag[i]
                for entries in batch.column("entries").slice(i, j - i).to_pylist():
                    held.append(np.frombuffer(entries, np.uint64).reshape(-1, 2))
                    n += len(held[-1])
                    if n >= 2 * EMPTY:
                        again = True
                        rows, left = met(held, again)
                        yield rows
                        held, n = [left], min(len(left), EMPTY)
        if held:
            yield met(held, again)[0]

    rows = cut_hashes(bags.repartition("bag").sortWithinPartitions("bag").mapInArrow(run, "key long, id long, again boolean"), "meeting")
    if rows.where("again").isEmpty():
        return rows.drop("again")
    return rows.where("not again").drop("again").unionByName(rows.where("again").drop("again").distinct())


def group_counts(forms: list[bytes]) -> np.ndarray:
    """How many characters of each line are of each group, at most 255, packed: four numbers a line.
    A character counts by its first byte, so an edit changes two counts by one at most."""
    b = np.frombuffer(b"".join(forms), np.uint8)
    row = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
    first = (b & 0xC0) != 0x80
    counts = np.bincount(row[first] * 32 + _GROUP[b[first]], minlength=32 * len(forms))
    return np.minimum(counts, 255).astype(np.uint8).view(np.int64).reshape(-1, 4)


def normal_forms(docs: DataFrame, wanted: np.ndarray, holders: np.ndarray) -> DataFrame:
    """(id, line, c0 to c3) of the lines whose hash is in the filter ``wanted``, out of the documents (uid, text)
    whose uid is in the filter ``holders``; once a task for equal lines."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            holding = batch.filter(pa.array(in_bitmap(holders, from_signed(batch.column("uid")))))
            for part in chunks(holding, "text", SMALL_CHUNK):
                lines = Lines(part.column("text"))
                at, h = lines.keys()
                hit = in_bitmap(wanted, h)
                at, h = at[hit], signed(h[hit])
                new = _new(seen, h.tolist())
                if new:
                    forms = [lines.form(i) for i in at[new]]
                    counts = np.ascontiguousarray(group_counts(forms).T)
                    yield pa.RecordBatch.from_pydict({"id": h[new], "line": pa.array([x.decode() for x in forms], pa.string()), **dict(zip(COUNTS, counts))})

    return docs.select("uid", "text").mapInArrow(run, "id long, line string, " + ", ".join(f"{c} long" for c in COUNTS))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def by_words(x: list[str], y: list[str], most: int) -> bool:
    """Whether at most ``most`` edits are seen to turn one text into the other word by word: where
    words differ, one is put for the other, or up to three are left out or added if that makes ends meet."""
    i = j = edits = 0
    m, n = len(x), len(y)
    while i < m and j < n:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        out = add = 1
        if not (i + 1 < m and j + 1 < n and x[i + 1] == y[j + 1]):
            for s in (1, 2, 3):
                if i + s < m and x[i + s] == y[j]:
                    out, add = s, 0
                    break
                if j + s < n and x[i] == y[j + s]:
                    out, add = 0, s
                    break
        if out and add:
            edits += max(len(x[i]), len(y[j]))
        else:
            edits += sum(len(w) + 1 for w in x[i : i + out]) + sum(len(w) + 1 for w in y[j : j + add])
        if edits > most:
            return False
        i, j = i + out, j + add
    return edits + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:]) <= most


def shorter(a: str, b: str, most: int) -> tuple[bool | None, str, str]:
    """Whether the Levenshtein distance is at most ``most`` where that is plain, else None; and
    both without what they share at either end, which doesn't change the distance."""
    if abs(len(a) - len(b)) > most:
        return False, a, b
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if max(len(a), len(b)) <= most or not a or not b:
        return max(len(a), len(b)) <= most, a, b
    return by_words(a.split(" "), b.split(" "), most) or None, a, b


def within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``: a column of the table is one number, bit by bit."""
    plain, a, b = shorter(a, b, most)
    if plain is not None:
        return plain
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where the column rises, where it falls
    for j, c in enumerate(b):
        eq = at.get(c, 0)
        x = eq | down
        y = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(y | up) & full, up & y
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return False
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(x | more)) & full, more & x & full
        if j % 32 == 31 and (i := j + 1 + len(a) - len(b)) > 0:
            # values on the diagonal that ends the table never fall
            upper = (1 << i) - 1
            if j + 1 + (up & upper).bit_count() - (down & upper).bit_count() > most:
                return False
    return score <= most


def near(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs have a Levenshtein distance of at most ``most``: ``within`` for many pairs at once.
    Pairs whose diagonal band fits a few 64-bit numbers are compared together, column by column
    of their tables; the few others, of very long lines or many different characters, one by one."""
    plain = [shorter(a, b, k) for a, b, k in zip(x, y, most.tolist())]
    out = np.array([p[0] is not False for p in plain], bool)
    open_ = np.array([p[0] is None for p in plain], bool)
    x, y = [p[1] for p in plain], [p[2] for p in plain]
    m, n = (np.array([len(t) for t in side], np.int64) for side in (x, y))
    words = (2 * most + 64) // 64
    for k in np.unique(words[open_]).tolist():
        same = np.flatnonzero(open_ & (words == k))
        same = same[np.argsort(-n[same], kind="stable")]
        for part in np.split(same, range(BAND_PAIRS, len(same), BAND_PAIRS)):
            a, b = [x[i] for i in part], [y[i] for i in part]
            got = _band(a, b, m[part], n[part], most[part], k) if k <= BAND_WORDS and len(part) >= k * BAND_LEAST else None
            out[part] = [within(p, q, e) for p, q, e in zip(a, b, most[part].tolist())] if got is None else got
    return out


def _band(x: list[str], y: list[str], m: np.ndarray, n: np.ndarray, most: np.ndarray, words: int) -> np.ndarray | None:
    """``near`` for pairs by falling length ``n`` of y, in a band of ``words`` numbers around the
    diagonal; None if their characters are too many for the table of where each stands in x."""
    reach = (64 * words - 1) // 2
    mine: dict[str, int] = {}
    of = np.array([mine.setdefault(t, len(mine)) for t in x])
    left, right = (np.frombuffer("".join(side).encode("utf-32-le"), np.uint32) for side in (mine, y))
    lut = np.zeros(0x110000, np.uint8)
    lut[left] = lut[right] = 1
    letters = np.flatnonzero(lut)
    if len(letters) > 200:
        return None
    lut[letters] = np.arange(len(letters)) + 1
    size = np.array([len(t) for t in mine], np.int64)
    # bit ``reach`` + i of a row is set where character i of x is the row's letter
    wide = 64 * ((reach + max(int(size.max()), int(n[0])) + 64 * words) // 64 + 2)
    place = np.zeros((len(size), wide), np.uint8)
    place[np.repeat(np.arange(len(size)), size), reach + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)] = lut[left]
    table = np.empty((wide // 64, len(size), len(letters)), np.uint64)
    for c in range(len(letters)):
        table[:, :, c] = np.packbits(place == c + 1, axis=1, bitorder="little").view(np.uint64).T
    table = table.reshape(wide // 64, -1)
    chars = np.zeros((int(n[0]), len(y)), np.int64)
    chars[np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(y)), n)] = lut[right] - 1
    chars += of * len(letters)

    # the end of the table lies on one diagonal, that is on one bit of the band, in every column
    end = m - n + reach
    word, bit = end // 64, np.uint64(1) << (end % 64).astype(np.uint64)
    score = np.maximum(m - n, 0)
    at = np.arange(len(y))
    ones, one, top = ~np.uint64(0), np.uint64(1), np.uint64(63)
    up = [np.full(len(y), ones if 64 * w >= reach else ones << np.uint64(reach - 64 * w) if 64 * (w + 1) > reach else np.uint64(0)) for w in range(words)]
    down = [np.zeros(len(y), np.uint64) for _ in range(words)]
    out = np.zeros(len(y), bool)
    for j in range(int(n[0])):
        stop = n[at] <= j
        if j % 32 == 0 or stop[-1]:
            out[at[stop]] = score[stop] <= most[at[stop]]
            go = ~stop & (score <= most[at])  # values on a diagonal never fall
            if not go.all():
                at, word, bit, score = at[go], word[go], bit[go], score[go]
                up, down = [v[go] for v in up], [v[go] for v in down]
                if not len(at):
                    return out
        row, first, shift = chars[j, at], j // 64, np.uint64(j % 64)
        carry, zero, rise, fall = None, [], [], []
        for w in range(words):
            eq = table[first + w][row] >> shift
            if shift:
                eq |= table[first + w + 1][row] << (np.uint64(64) - shift)
            masked = eq & up[w]
            total = masked + up[w]
            over = total < masked
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            d = (total ^ up[w]) | eq | down[w]
            zero.append(d)
            rise.append(down[w] | ~(d | up[w]))
            fall.append(d & up[w])
        hit = zero[0] if words == 1 else np.choose(word, zero)
        score = score + ((hit & bit) == 0)
        for w in range(words):  # the next column's band begins a row further down
            d = zero[w] >> one
            if w + 1 < words:
                d |= zero[w + 1] << top
            up[w] = fall[w] | ~(d | rise[w])
            down[w] = d & rise[w]
    out[at] = score <= most[at]
    return out


def allowed(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that keep lines of these lengths alike."""
    return ((1 - similarity) * np.maximum(x, y) + 1e-9).astype(np.int64)


def decided(pairs, similarity: float):
    """Links (a, b) out of pairs, which come as (a, b, lines of a, lines of b), gathered to be compared together."""

    def links():
        a, b = (np.concatenate([h[side] for h in held]) for side in (0, 1))
        x, y = ([t for h in held for t in h[side]] for side in (2, 3))
        ok = near(x, y, allowed(*(np.array([len(t) for t in side], np.int64) for side in (x, y)), similarity))
        return pa.RecordBatch.from_pydict({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})

    held, rows, chars = [], 0, 0
    for some in pairs:
        held.append(some)
        rows += len(some[2])
        chars += sum(map(len, some[2])) + sum(map(len, some[3]))
        if rows >= HELD or chars >= HELD_CHARS:
            yield links()
            held, rows, chars = [], 0, 0
    if held:
        yield links()


def linked_in_blocks(rest: DataFrame, similarity: float, rows: int | None = None) -> DataFrame:
    """Links (a, b) between rows (key, id, root, members of the key, bytes of its lines, lesser keys of the
    id, line and its counts) of one key and different roots. A key's members are dealt by hash to
    slices of a bounded size, and every two slices of a key, or one with itself, are a block: what is
    compared is never a row, and a large key's blocks go to many tasks: one for each COMPARED of the
    ``rows``, if their number is given, or as many as a shuffle has."""
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        tasks = min(tasks, rows // COMPARED + 1)
    slices = F.greatest(F.ceil(F.col("members") / SLICE), F.ceil(F.col("bytes") / SLICE_BYTES)).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("_of")).cast("int")
    dealt = (
        rest.withColumn("_of", slices).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "root", "less", "line", *COUNTS)
        .repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    )

    def pairs(block: pa.Table):
        """Those to compare in whole blocks, one after the other."""
        root, mine, i, j = (block.column(c).to_numpy() for c in ("root", "mine", "i", "j"))
        counts = np.stack([block.column(c).to_numpy() for c in COUNTS], 1).copy().view(np.uint8)
        new = _begins(block)
        number = np.cumsum(new)
        line, ids = block.column("line").to_pylist(), block.column("id").to_numpy()
        less = [frozenset(k) for k in block.column("less").to_pylist()]
        size = np.array([len(t) for t in line], np.int64)
        for d in range(1, len(line)):
            p = np.flatnonzero(number[d:] == number[:-d])
            if not len(p):
                break
            q = p + d
            keep = (root[p] != root[q]) & ((i[p] == j[p]) | (mine[p] != mine[q]))
            most = allowed(size[p], size[q], similarity)
            apart = np.abs(size[p] - size[q])
            keep &= apart <= most
            p, q, most, apart = p[keep], q[keep], most[keep], apart[keep]
            # an edit changes the length by one at most, and two counts by one each, or one if the length changes
            keep = apart + np.abs(counts[p].astype(np.int16) - counts[q]).sum(1) <= 2 * most
            p, q = p[keep], q[keep]
            keep = np.fromiter((less[k].isdisjoint(less[o]) for k, o in zip(p.tolist(), q.tolist())), bool, len(p))
            if keep.any():
                p, q = p[keep], q[keep]
                yield ids[p], ids[q], [line[k] for k in p], [line[k] for k in q]

    def whole(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            last = np.flatnonzero(_begins(table))
            if len(last) > 1:
                yield from pairs(table.slice(0, last[-1]))
                table = table.slice(last[-1])
            waiting = table
        if waiting is not None:
            yield from pairs(waiting)

    return dealt.mapInArrow(lambda batches: decided(whole(batches), similarity), "a long, b long")


def _begins(table: pa.Table) -> np.ndarray:
    """Where a row's key and slices are others than the row's before."""
    new = np.ones(len(table), bool)
    if len(table) > 1:
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return new


def link_lines(docs: DataFrame, met: DataFrame, wanted: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) of the line classes that links join: of those of ``wanted`` (id, and the uid of a document
    that holds the line), which share keys in ``met`` (key, id). The lines are read from these of ``docs``."""
    forms = normal_forms(docs, bitmap(wanted, "id"), bitmap(wanted, "uid"))
    lines = cut_hashes(forms.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "forms")
    entries = cut_hashes(met.join(lines.select("id", F.length("line").alias("n"), *COUNTS), "id"), "entries")

    def may(a: str, b: str) -> str:
        # an edit changes the length by one at most, and two counts by one each, or one if the length changes
        most = f"floor({1 - similarity}D * greatest({a}.n, {b}.n) + 1e-9)"
        # one after the other: written out, the 32 of them are a method that the JVM never compiles
        apart = [f"abs((shiftrightunsigned({a}.{c}, i) & 255) - (shiftrightunsigned({b}.{c}, i) & 255))" for c in COUNTS]
        apart = f"aggregate(array(0, 8, 16, 24, 32, 40, 48, 56), 0L, (s, i) -> s + {' + '.join(apart)})"
        return f"abs({a}.n - {b}.n) <= {most} and abs({a}.n - {b}.n) + {apart} <= 2 * {most}"

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")

        def run(batches):
            yield from decided(((b["a"].to_numpy(), b["b"].to_numpy(), b["x"].to_pylist(), b["y"].to_pylist()) for b in batches), similarity)

        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def across(rest: DataFrame) -> DataFrame:
        sized = rest.groupBy("key").agg(F.count("*").alias("members"), F.sum(4 * F.col("n")).alias("bytes"), F.count("*").alias("rows"))
        every = F.collect_set("key").over(Window.partitionBy("id"))  # a line has at most some fifty keys
        lesser = rest.withColumn("less", F.filter(every, lambda k: k < F.col("key")))
        rows = rest.count()
        return linked_in_blocks(join_on(lesser.join(lines.select("id", "line", *COUNTS), "id"), cut_hashes(sized, "sized"), "key", "rows", rows), similarity, rows)

    return connect(entries, ["id"], may, verify, across, ("n",))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with deduplicated text, and n_lines, n_dropped, n_left (lines with a word that stay)."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("uid"))
    slim = keyed.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    both = cut_hashes(read_lines(slim), "lines")  # the conditions on its rows are such that Parquet's pages aren't searched for nulls
    occ = both.where("coalesce(bag, -1) < 0").select("uid", "doc_id", "no", "h")
    total = occ.count()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "no")
    classes = occ.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    met = shared_keys(both.where("coalesce(bag, -1) >= 0").select("bag", "entries"))
    wanted = met.select(F.col("id").alias("h")).distinct().withColumn("met", F.lit(True))
    # all other lines occur once and meet no other
    classes = cut_hashes(classes.join(wanted, "h", "left").where("met or times > 1"), "classes")
    roots = link_lines(slim, met, classes.where("met").select(F.col("h").alias("id"), F.col("first.uid").alias("uid")), similarity)
    joined = classes.join(roots.withColumnRenamed("id", "h"), "h", "left")
    linked = cut_hashes(joined.where("root is not null or times > 1").select("h", "first", "times", F.coalesce("root", "h").alias("root")), "linked")
    stays = linked.groupBy("root").agg(F.min("first").alias("stay"), F.count("*").alias("members"))
    groups = join_on(linked.select("h", "times", "root"), stays, "root", "members", total).select("h", "times", F.col("stay.uid").alias("stay_uid"), F.col("stay.no").alias("stay_no"))
    marks = join_on(occ.select("uid", "no", "h"), cut_hashes(groups, "groups"), "h", "times", total).where("uid <> stay_uid or no <> stay_no")
    drops = marks.groupBy("uid").agg(F.collect_set("no").alias("drops"))
    none = F.array().cast("array<long>")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_lines").cast("long") - 1), F.coalesce("drops", none))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i.cast("int"))), "\n")
    out = keyed.join(drops.hint("shuffle_hash"), "uid", "left").withColumn("_lines", F.split(F.col("row.text"), "\n"))
    dropped = F.coalesce(F.size(F.coalesce("drops", none)), F.lit(0)).cast("long")
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    # a character that is neither white space nor ASCII punctuation makes a word
    worded = F.coalesce(F.size(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]"))), F.lit(0)).cast("long")
    return out.select(
        *[F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(text).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        n_lines.alias("n_lines"), dropped.alias("n_dropped"), (F.greatest(worded, F.lit(0).cast("long")) - dropped).alias("n_left"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
