"""Alignment against a plain computation from whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_chars():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, k = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            table[chr(256 + k)] = b
            k += 1
    return table


def plain(tools, text):
    """[(A ids, B ids)] by group, or [] where there are no tokens."""
    if not text:
        return []
    a, b = tools
    chars = byte_chars()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
        out.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return out


def brute(tools, rows):
    groups = [plain(tools, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, each in zip(rows, groups, links):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for (x, y), n in each.items() if docs[x, y] == most[x])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(each.values()), best, sum(n * docs[p] for p, n in each.items()), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


@pytest.mark.parametrize("work", [1, 2, 3, 64])
def test_merge_equals_a_plain_merge(work):
    rng = random.Random(work)
    for _ in range(200):
        top = rng.randint(1, 40)
        a, b = (np.array(sorted({*rng.sample(range(1, top + 1), rng.randint(0, top)), top})) for _ in range(2))
        of_a, closes = alignment.merge(a, b, work, pieces=rng.choice([1, 2, 1000]))
        want = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        assert of_a.tolist() == [s == 0 for _, s in want]
        assert closes.tolist() == [k > 0 and want[k - 1][0] == want[k][0] for k in range(len(want))]
        i, j, lo, hi = alignment.overlaps(a, b, of_a)
        starts_a, starts_b = [0, *a.tolist()], [0, *b.tolist()]
        pairs = {(x, y): (max(starts_a[x], starts_b[y]), min(a[x], b[y])) for x in range(len(a)) for y in range(len(b)) if max(starts_a[x], starts_b[y]) < min(a[x], b[y])}
        assert dict(zip(zip(i.tolist(), j.tolist()), zip(lo.tolist(), hi.tolist()))) == pairs


def test_pieces_are_of_equal_work():
    a, b = np.cumsum(np.full(100_000, 3)), np.cumsum(np.full(100, 3000))
    d = np.arange(0, len(a) + len(b), 64)
    i = alignment.crossings(a, b, d)
    assert (np.diff(i) + np.diff(d - i) == 64).all() and i[0] == 0


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   \n\t "), (5, "a▁b c"), (6, "a\0b \x01 c"), (7, "<s> x </s> <unk> <0x41> <|endoftext|>"), (8, "Ünïcode  Straße x\n\nÉtat !!! 12,5 　 ok"),
    (9, "A\r\nB\r\n\r\nC  "), (None, "one two"), (None, "one two"), (9, "\nlead\n trail \n"), (10, "é  x y  z"), (11, "語" * 50 + " 日本語のテキスト。改行\nなし 🎉🎊👩‍👩‍👧"),
    (12, "don't I'm we'll  x   y    z\t\tq"), (13, "0x1234567890abcdef" * 20), (14, "ab\x1cc d\x85e f\x0bg"), (15, "a�b "), (16, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9), (17, "  two  lead"),
]


def run(df, hot=alignment.HOT):
    aligned = alignment.align(df, A, B)
    told = aligned.drop("pairs", "times").join(alignment.rated(aligned, hot), "uid", "left").fillna(0, ["n_best", "count_sum"])
    return sorted(map(tuple, told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_odd_texts_equal_brute_force(spark, documents, tools, hot):
    assert run(documents(ODD), hot) == sorted(brute(tools, ODD), key=str)


def test_query_equals_brute_force(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, alignment.query(spark, sf_dir).collect()), key=str)
    assert got == sorted(brute(tools, [(r["doc_id"], r["text"]) for r in docs]), key=str)


def test_groups_read_back(spark, documents, tools):
    got = {r["doc_id"]: r["groups"] for r in alignment.align(documents(ODD[4:9]), A, B, with_groups=True).collect()}
    for i, t in ODD[4:9]:
        assert got[i] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(tools, t))


def test_wide_groups_count_by_distinct_ids(tools):
    tool = alignment.Aligner(A, B)
    rng = random.Random(3)
    a, b = np.array([rng.randrange(5) for _ in range(300)]), np.array([rng.randrange(7) for _ in range(200)])
    keys, times = tool._links(np.array([0]), a, b, np.array([300]), np.array([200]))
    want = Counter((x, y) for x in a.tolist() for y in b.tolist())
    assert {(int(k) >> alignment.B_BITS, int(k) & 0x7FFF): int(t) for k, t in zip(keys, times)} == want


def test_forgetting_changes_nothing(monkeypatch, tools):
    import pyarrow as pa

    texts = pa.array(["one two three", "four five", None, "one six two"])
    whole = alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(alignment, "REMEMBER", 1)
    tool = alignment.Aligner(A, B)
    parts = [tool.align(texts.slice(i, 1)) for i in range(4)]
    for c in whole:
        assert [x for p in parts for x in p[c].to_pylist()] == whole[c].to_pylist()


def test_empty_table(spark, documents):
    assert run(documents(ODD).where("doc_id < 0")) == []


def test_very_long_text(spark, documents, tools):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghé語") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = [(1, " ".join(rng.choice(words) for _ in range(300_000))), (2, "short one")]
    got = run(documents(rows))
    assert [r[0] for r in got] == [1, 2] and got[0][1] > 300_000
    part = " ".join(rows[0][1].split(" ")[:2000])
    assert run(documents([(1, part)]))[0] == tuple(brute(tools, [(1, part)])[0])


def test_one_space_at_the_end_keeps_the_tokens(spark, documents, tools):
    rows = [(1, "one "), (2, "one two "), (3, "one \n"), (4, "\n "), (5, "語 "), (6, "two x "), (7, "x\n "), (8, "one")]
    want = sorted(brute(tools, rows), key=str)
    assert run(documents(rows)) == want and all(r[1] for r in want)
