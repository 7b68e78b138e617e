"""The Merkle manifest against a plain computation of the same tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """All levels of a tree, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def beside(levels, k):
    """(left, right) siblings of place k, level by level."""
    out = []
    for level in levels[:-1]:
        out.append((level[k - 1], "") if k % 2 else ("", level[k + 1] if k + 1 < len(level) else ""))
        k //= 2
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = beside(trees[g], k) + beside(top, place)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf_of((*r[:3], r[3] + 1, r[4])) if bad and r[3] is not None else leaf
            for left, right in path:
                at = h(left, at, right)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in path]), at, at == top[-1][0]))
    return out


def got(spark, tmp_path, rows, extra=True):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in ("part", "rank", "digest", "lo", "hi", "block", "path", "seen", "row", "level") if extra else ():
        df = df.withColumn(c, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.query(spark, str(tmp_path))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_edges(spark, tmp_path):
    rows = [
        (1, "s", "en", 3, "abc"), (2, None, "en", None, None), (2, None, "en", None, None), (2, "t", "en", 0, ""), (None, "t", "en", 5, "é—x"), (None, "t", "en", 5, "é—x"), (13, "t", None, 2, "zz"),
        (14, "s", "", 1, "q"), (15, "s", "zz", 9, "lone"), (16, "s", "é", 1, "x" * 300_000), (7, "s", "de", None, "n"), (20, "s", "de", 4, "4:ab"), (21, "s", "de", 4, None),
    ]
    out = got(spark, tmp_path, rows)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2,), (64,), (65,), (1, 128, 129), (4200, 3)])
def test_sizes(spark, tmp_path, sizes):
    rows = [(i * 7 + g, "s", f"l{g}", i, f"text {i}") for g, n in enumerate(sizes) for i in range(n)]
    out = got(spark, tmp_path, rows, extra=False)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(rows), key=str)


def test_many_groups(spark, tmp_path):
    rows = [(i, "s", f"l{i % 90}", i, f"text {i}") for i in range(200)]
    assert sorted(map(tuple, got(spark, tmp_path, rows).collect()), key=str) == sorted(brute(rows), key=str)


def test_empty(spark, tmp_path):
    assert got(spark, tmp_path, []).collect() == []


def test_equal_rows_hold_most_of_the_table(spark, tmp_path):
    rows = [(5, "s", "en", 3, "abc")] * 300 + [(i, "s", "en", 1, "z") for i in range(100)]
    assert sorted(map(tuple, got(spark, tmp_path, rows).collect()), key=str) == sorted(brute(rows), key=str)


def test_intervals_nest(spark):
    rows = spark.createDataFrame([("=en", i, h(str(i))) for i in range(500)], "part string, id long, digest string")
    rounds, tops = merkle.build(merkle.entries_of(merkle.ranked(rows, "id")))
    nodes = merkle.nodes(rounds).collect()
    want = tree([h(str(i)) for i in range(500)])
    assert {(n["level"], n["lo"], n["hi"]): n["digest"] for n in nodes} == {(k, i << k, min((i + 1) << k, 500)): d for k, level in enumerate(want) if k for i, d in enumerate(level)}
    assert all(n["kids"][0]["lo"] == n["lo"] and n["kids"][-1]["hi"] == n["hi"] for n in nodes)
    assert [(t["lo"], t["hi"], t["digest"]) for t in tops.collect()] == [(0, 500, want[-1][0])]
