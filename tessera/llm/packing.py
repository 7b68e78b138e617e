"""Packing token sequences by order-preserving dynamic programming.

The documents of a partition are one stream of tokens, in order. Windows of at most
``SEQUENCE`` tokens are cut from it at document ends, at sentence ends or, inside
sentences too long for a window, at fixed steps. A cut that truncates a document costs
extra, padding costs its length, and the cheapest set of cuts comes from

    f(j) = min over i with pos(j) - pos(i) <= SEQUENCE of f(i) + SEQUENCE - (pos(j) - pos(i)) + penalty(j)

in which the minimum of f(i) + pos(i) over the sliding range is kept by a monotone
queue, so each candidate enters and leaves once. The stream is solved in blocks; what a
block leaves open goes to the next. The rest at the end of a partition is cut into
sequences of powers of two, which need no padding.

Cases: null text is the empty text, which gives the end id alone; a text of any length
is split over as many windows as it needs; repeated rows are packed each. A partition
without rows gives none. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import Text, cut, gathered

SEQUENCE = 2048
END_ID = 1
#: Tokens of padding that a cut at a sentence end, or inside a sentence, is worth.
SENTENCE_CUT, FORCED_CUT = 4, 256
#: Largest gap between cut candidates; tokens solved at once; pieces a worker remembers.
GAP, BLOCK, REMEMBER = 1024, 1 << 19, 1 << 18
#: Bytes of text encoded at once, and pieces that the tokenizer gets as one string.
CHUNK, TOGETHER = 4 << 20, 1 << 15

_tools: dict[str, Encoder] = {}
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True


def _after_space(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space, in ASCII or not."""
    before = b[at - 1]
    out = _ASCII_SPACE[before]
    far = np.flatnonzero((before >= 0x80) & (at >= 2))
    c2, c1 = b[at[far] - 2], before[far]
    out[far] |= (c2 == 0xC2) & ((c1 == 0x85) | (c1 == 0xA0))
    far = far[at[far] >= 3]
    c3, c2, c1 = b[at[far] - 3], b[at[far] - 2], before[far]
    two = (c2 == 0x80) & ((c1 <= 0x8A) | (c1 == 0xA8) | (c1 == 0xA9) | (c1 == 0xAF)) | (c2 == 0x81) & (c1 == 0x9F)
    out[far] |= (c3 == 0xE1) & (c2 == 0x9A) & (c1 == 0x80) | (c3 == 0xE2) & two | (c3 == 0xE3) & (c2 == 0x80) & (c1 == 0x80)
    return out


class Encoder:
    """Token ids as little-endian bytes. Byte-level BPE never merges over the boundary before a
    space or line end that follows a non-space, so texts are encoded piece by piece: each
    distinct piece once, and at most about REMEMBER of them are remembered. The ids of added
    tokens never occur: their strings are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        size = self.tok.get_vocab_size()
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)  # a byte is one character there
        self.sentence_end = np.array([bool(re.search(r"[.!?\n]\W*$", self.tok.decode([i]))) for i in range(size)] + [True] * 16)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.first = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _forget_others(self, place: np.ndarray) -> None:
        """Remember only the pieces at these places."""
        n = np.diff(self.first)[place]
        first = np.concatenate([[0], np.cumsum(n)])
        self.ids = self.ids[np.repeat(self.first[:-1][place] - first[:-1], n) + np.arange(first[-1])]
        self.known, self.first = self.known.take(pa.array(place)), first

    def _learn(self, new: pa.StringArray) -> None:
        """Remember the ids of new pieces. Pieces between spaces on both sides go to the tokenizer
        as one string, and the widths of its tokens tell where each piece's ids begin."""
        off = np.frombuffer(new.buffers()[1], np.int32)[new.offset : new.offset + len(new) + 1].astype(np.int64)
        b = np.frombuffer(new.buffers()[2], np.uint8)
        alone = ~_ASCII_SPACE[b[off[:-1]]] | _after_space(b, off[1:])
        those, runs = new.filter(pa.array(alone)), new.filter(pa.array(~alone))
        parts = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(those.to_pylist(), add_special_tokens=False)]
        counts = [np.array([len(x) for x in parts], np.int64)]
        for k in range(0, len(runs), TOGETHER):
            some = runs[k : k + TOGETHER]
            off = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1].astype(np.int64)
            text = some.buffers()[2][off[0] : off[-1]].to_pybytes().decode()
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.width[ids])
            upto = off[1:] - off[0]
            at = np.searchsorted(ends, upto) + 1
            if not np.array_equal(ends[at - 1], upto):
                raise ValueError("a token reaches over a space")
            counts.append(np.diff(at, prepend=0))
            parts.append(ids)
        self.known = pa.concat_arrays([self.known, those, runs])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *parts])

    def _pieces(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of a buffer, one after the other, and how many each piece has."""
        pieces = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer((off - off[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(b[off[0] : off[-1]])))
        told = pieces.dictionary_encode()
        words = told.dictionary
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        if len(new):
            if len(self.known) > REMEMBER:
                self._forget_others(np.asarray(at.drop_null()).astype(np.int64))
            self._learn(new)
            at = pc.index_in(words, value_set=self.known)
        place = np.asarray(at).astype(np.int64)[np.asarray(told.indices)]
        n = np.diff(self.first)[place]
        begin = np.repeat((self.first[:-1][place] - np.cumsum(n) + n).astype(np.int32), n)
        begin += np.arange(len(begin), dtype=np.int32)
        return self.ids[begin], n

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        text = Text(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), lower=False)
        b, size = text.bytes, np.zeros(len(text.bytes) + 1, bool)
        at = np.flatnonzero((b == 32) | (b == 10))
        at = at[at > 0]
        size[at[~_after_space(b, at)]] = True
        size[text.off[:-1]] = True
        off = np.flatnonzero(size[:-1])
        out, upto = [], np.zeros(len(off) + 1, np.int64)
        # by groups of about CHUNK bytes, also inside a text
        group = np.searchsorted(off, np.arange(0, len(b), CHUNK)) if len(b) else []
        for i, j in zip(group, [*group[1:], len(off)]):
            if i < j:
                ids, n = self._pieces(b, np.append(off[i:j], off[j] if j < len(off) else len(b)))
                out.append(ids)
                upto[i + 1 : j + 1] = n
        np.cumsum(upto, out=upto)
        ids = np.concatenate(out).astype("<u4", copy=False) if out else np.zeros(0, "<u4")
        at = upto[np.searchsorted(off, text.off)]
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]


def encoder(path: str) -> Encoder:
    if path not in _tools:
        _tools[path] = Encoder(path)
    return _tools[path]


def best_cuts(pos: list[int], penalty: list[int], last: bool, sequence: int = SEQUENCE) -> list[int]:
    """Indices into ``pos`` (ascending, from 0, gaps of at most ``sequence``) of the cheapest
    cuts. Unless ``last``, they end at the cheapest candidate of the final window."""
    m = len(pos)
    key, came = [0] * m, [0] * m
    key[0] = pos[0]
    queue = deque([0])
    for j in range(1, m):
        p = pos[j]
        while pos[queue[0]] < p - sequence:
            queue.popleft()
        i = queue[0]
        came[j] = i
        k = key[i] + sequence + penalty[j]  # f(j) + pos(j)
        key[j] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    j = m - 1
    if not last:
        j = min((i for i in range(m - 1, 0, -1) if pos[i] > pos[-1] - sequence), key=lambda i: (key[i] - pos[i], -i), default=m - 1)
    cuts = []
    while j:
        cuts.append(j)
        j = came[j]
    return [0, *cuts[::-1]]


def _candidates(lengths: list[int], ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Cut candidates of a block: document ends (free), sentence ends, and steps where both are far apart."""
    doc = np.cumsum(lengths)
    at = np.unique(np.concatenate([[0], doc, ends]))
    gap = np.diff(at)
    extra = [np.arange(a + GAP, a + g, GAP) for a, g in zip(at[:-1][gap > GAP], gap[gap > GAP])]
    pen = np.where(np.isin(at, doc), 0, SENTENCE_CUT)
    if extra:
        more = np.concatenate(extra)
        at, pen = np.concatenate([at, more]), np.concatenate([pen, np.full(len(more), FORCED_CUT)])
        order = np.argsort(at, kind="stable")
        at, pen = at[order], pen[order]
    return at.tolist(), pen.tolist()


class Packer:
    """Packs one partition's stream; ``take`` gives rows as they are settled."""

    def __init__(self, sentence_end: np.ndarray) -> None:
        self.sentence_end = sentence_end
        self.docs: list[tuple] = []  # (doc_id, tokens of it, first token still open, open ids)
        self.open = 0
        self.sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        self.rows: list[tuple] = []
        self.offset = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        for a in range(0, n, BLOCK):
            self.docs.append((doc_id, n, a, ids[4 * a : 4 * (a + BLOCK)]))
            self.open += min(BLOCK, n - a)
            if self.open >= BLOCK:
                self.solve(False)

    def solve(self, last: bool) -> None:
        if not self.docs:
            return
        stream = b"".join(d[3] for d in self.docs)
        lengths = [len(d[3]) // 4 for d in self.docs]
        ends = np.flatnonzero(self.sentence_end[np.frombuffer(stream, "<u4")]) + 1
        pos, pen = _candidates(lengths, ends)
        cuts = [pos[i] for i in best_cuts(pos, pen, last)]
        if last:  # the last window is the partition's rest
            at, end = cuts[-2], cuts[-1]
            cuts.pop()
            while at < end:
                at += 1 << ((end - at).bit_length() - 1)
                cuts.append(at)
        d, begin = 0, 0  # the document at hand and where it begins in the stream
        for a, b in zip(cuts, cuts[1:]):
            while a < b:
                while begin + lengths[d] <= a:
                    begin += lengths[d]
                    d += 1
                e = min(b, begin + lengths[d])
                doc_id, n, first, _ = self.docs[d]
                self._emit(doc_id, first + a - begin, e - a, zlib.crc32(stream[4 * a : 4 * e]), n)
                a = e
            self.sequence += 1
            self.offset = 0
        stop, rest, begin = cuts[-1], [], 0
        for (doc_id, n, first, ids), length in zip(self.docs, lengths):
            if begin + length > stop:
                skip = max(0, stop - begin)
                rest.append((doc_id, n, first + skip, ids[4 * skip :]))
            begin += length
        self.docs, self.open = rest, len(stream) // 4 - stop

    def _emit(self, doc_id, start: int, length: int, crc: int, n: int) -> None:
        self.rows.append((doc_id, start, length, crc, n, self.sequence, self.offset))
        self.offset += length

    def take(self):
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents
    (doc_id, text). Each partition is packed by itself: no shuffle."""
    tail = np.array([end_id], "<u4").tobytes()
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def rows_of(packer: Packer, schema: pa.Schema):
        rows = packer.take()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches):
        enc = encoder(tokenizer)
        packer = Packer(enc.sentence_end)
        schema = None
        for part in gathered(batches, "text", CHUNK):
            if schema is None:
                schema = pa.schema([("doc_id", part.schema.field("doc_id").type)] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
            for doc_id, x in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text"))):
                packer.add(doc_id, x + tail)
            yield from rows_of(packer, schema)
        if schema is not None:
            packer.solve(True)
            yield from rows_of(packer, schema)

    out = f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut(docs.select("doc_id", "text").mapInArrow(run, out), "pieces")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
