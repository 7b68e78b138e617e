from __future__ import annotations

import random

import pytest

#: Column names that the operators use themselves.
CLASHES = ("h", "k", "uid", "key", "id", "root", "size", "score", "kept", "row", "copies", "target", "_uid", "drops", "words", "lang_pred", "is_target", "_bucket", "digest", "own", "w")


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def sentence(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) or (id, text, lang, source), with extra columns whose names clash."""

    def make(rows, extra: bool = True):
        full = [tuple(r) + (None, None)[: 4 - len(r)] for r in rows]
        df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            for c in CLASHES:
                df = df.withColumn(c, F.lit("x"))
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, null ids, ties, repeated rows, odd spaces, and a very long text."""
    long = sentence(30_000, 1)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d"), (6, sentence(80, 2)), (7, sentence(80, 2)), (7, sentence(80, 2)), (None, sentence(60, 3)),
        (None, None), (8, long), (9, long + " tail"), (10, "Ünïcode  Straße x\n\nÉtat !!! 12,5 　 ok"), (11, "A\r\nB\r\n\r\nC  "), (12, "12345 !!! ..."),
    ]
