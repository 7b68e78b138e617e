"""MinHash documents and fuzzy lines against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import linking, line_dedup, minhash
from tessera.llm.common import SMALL_CHUNK, Text, bitmap, chunks
from tests.llm.conftest import sentence, words

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(s):
    return (s or "").translate({i: i + 32 for i in range(65, 91)})


def tokens(s):
    return [w for w in SPACE.split(lower(s)) if w]


def shingles(s):
    w = tokens(s)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def variants(seed: int, n: int, most: int) -> list[str]:
    rng = random.Random(seed)
    base = words(150, seed)
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(documents):
    texts = variants(1, 60, 6) + variants(2, 40, 3) + [sentence(100, s) for s in range(50, 80)] + ["x y", "X  y", "x y z", None, "", " "] + [variants(1, 1, 0)[0]] * 5
    got = {r["doc_id"]: r for r in minhash.components(documents(list(enumerate(texts)))).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]]
    want = groups(sets, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_components_edges(documents, edge_rows):
    got = minhash.components(documents(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[4] == [(1, 4, True)]
    assert by[7] == [(76, 6, False)] * 2 and by[9][0][1:] == (8, False) and by[8][0][2]
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert minhash.components(documents([])).count() == 0


def test_dedup_keeps_one_of_each(documents, edge_rows):
    df = documents(edge_rows)
    got = minhash.dedup(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 8, 10, 11, 12] and ids.count(None) == 2


def test_pipeline_drops_a_copy_of_similarity_082(spark, documents):
    import corpus_pipeline

    base = words(219, 5)
    texts = [" ".join(base), " ".join(base[:-21] + words(21, 6))]
    a, b = map(shingles, texts)
    assert 0.80 <= len(a & b) / len(a | b) < 0.83
    assert [r["doc_id"] for r in corpus_pipeline.drop_copies(spark, documents(list(enumerate(texts)), extra=False), "").collect()] == [0]


@pytest.mark.parametrize("percent", [30, 50, 70, 80, 85, 95, 100])
def test_bands_follow_the_threshold(percent):
    assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.band_count(percent) < 1e-6
    assert percent < 85 or minhash.band_count(percent) == 25


def test_signature_estimates_jaccard():
    a, b = (minhash.shingle_sets(Text(pa.array([t]), True))[0] for t in (sentence(400, 1), sentence(300, 1) + " " + sentence(100, 2)))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean() - j) < 0.06


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1060)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    got = {r["id"]: r["root"] for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for p in links for x in p if p[0] != p[1]}
    assert got == groups(ids, [p for p in links if p[0] != p[1]])
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- lines -----------------------------------------------------------------------------------------


def normal(line):
    return " ".join(tokens(re.sub(r"[!-/:-@\[-`{-~]", "", line)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    return line_dedup.within(a, b, int(0.1 * max(len(a), len(b)) + 1e-9))  # test_within_equals_the_table holds it to the table


def test_lines_equal_brute_force_by_edit_similarity(documents):
    rng = random.Random(4)
    pool = [sentence(40, s) for s in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2))):
                line[rng.randrange(len(line))] = rng.choice("xyz ,")
            lines.append("".join(line))
        docs.append((i, "\n".join(lines + rng.choice(([], [""], ["--"])))))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(documents(docs)).collect()}
    places = [(i, n, normal(x)) for i, t in docs for n, x in enumerate(t.split("\n"))]
    forms = sorted({f for _, _, f in places if f})
    links = [(a, b) for a, b in combinations(forms, 2) if abs(len(a) - len(b)) < 30 and alike(a, b)]
    assert links
    root, seen, want = groups(forms, links), set(), {}
    for i, t in docs:
        stay = []
        for x in t.split("\n"):
            f = normal(x)
            if not f or root[f] not in seen:
                stay.append(x)
            if f:
                seen.add(root[f])
        want[i] = "\n".join(stay)
    assert got == want


def test_lines_of_all_lengths_equal_brute_force(documents):
    rng = random.Random(9)
    forms = set()
    for n in (2, 3, 4, 6, 8, 10, 15, 20, 30, 60, 100):
        for s in range(3):
            line = words(n, 100 * n + s)
            forms.add(" ".join(line))
            for _ in range(4):
                changed = list(line)
                at = rng.randrange(n)
                changed[at] = rng.choice([changed[at] + "x", changed[at][1:] or "é", "".join(rng.sample(changed[at], len(changed[at])))])
                forms.add(" ".join(changed))
    forms = sorted({normal(f) for f in forms})
    links = [(a, b) for a, b in combinations(forms, 2) if line_dedup.within(a, b, int(0.1 * max(len(a), len(b)) + 1e-9))]
    rng.shuffle(forms)
    docs = list(enumerate(forms))
    root = groups(forms, links)
    first = {}
    for f in forms:
        first.setdefault(root[f], f)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(documents(docs)).collect()}
    assert got == {i: f if first[root[f]] == f else "" for i, f in docs}


def meeting_pairs(forms):
    """Pairs of different lines that share a key."""
    x = line_dedup.Lines(pa.array(forms))
    at, _ = x.keys()
    line, key = x.meeting(at)
    met = {}
    for i, k in zip(at[line].tolist(), key.tolist()):
        met.setdefault(k, set()).add(i)
    return {p for ids in met.values() for p in combinations(sorted(ids), 2)}


def test_recall_on_real_lines(spark, sf_dir):
    """All pairs of sf0.001's lines by edit similarity alone, against the pairs that meet."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    forms = sorted({normal(x) for t in texts for x in (t or "").split("\n")} - {""})
    letters = sorted({c for f in forms for c in f})
    count = np.array([[f.count(c) for c in letters] for f in forms])
    n = count.sum(1)
    true = set()
    for i in range(len(forms)):
        most = (0.1 * np.maximum(n[i], n[i + 1 :]) + 1e-9).astype(int)
        # an edit changes the length by one and the counts of letters by two at most
        may = (np.abs(n[i] - n[i + 1 :]) <= most) & (np.abs(count[i] - count[i + 1 :]).sum(1) <= 2 * most)
        true |= {(i, j) for j in (np.flatnonzero(may) + i + 1).tolist() if alike(forms[i], forms[j])}
    assert len(true) >= 30
    assert len(true & meeting_pairs(forms)) >= 0.9 * len(true)


CHANGES = {
    "a letter": lambda rng, w: w | {(i := rng.randrange(len(w))): w[i][:-1] + "z"},
    "a word": lambda rng, w: w | {rng.randrange(len(w)): "q" * 4},
    "a word more": lambda rng, w: w | {(i := rng.randrange(len(w))): w[i] + " nu"},
    "a word less": lambda rng, w: w | {rng.randrange(len(w)): ""},
    "two letters": lambda rng, w: w | {(i := rng.randrange(len(w))): w[i][:-1] + "z"} | {(j := rng.randrange(len(w))): "y" + w[j][1:]},
}


@pytest.mark.parametrize("change", sorted(CHANGES))
@pytest.mark.parametrize("n", [10, 20, 30, 50, 100, 200])
def test_recall_on_changed_lines(change, n):
    rng = random.Random(n)
    true = found = 0
    for s in range(120):
        w = dict(enumerate(words(n, 1000 * n + s)))
        a, b = (" ".join(" ".join(x.values()).split()) for x in (w, CHANGES[change](rng, w)))
        if a != b and alike(a, b):
            true += 1
            found += len(meeting_pairs([a, b]))
    # two changed words of ten can touch four of six blocks
    assert true >= 30 and found >= (0.75 if (n, change) == (10, "two letters") else 0.9) * true


def test_lines_without_spaces_meet():
    a = "".join(chr(0x4E00 + 37 * i % 2000) for i in range(60))
    assert meeting_pairs([a, a[:20] + "一一" + a[21:]])
    b = "".join(words(30, 1))  # one long word
    assert meeting_pairs([b, b[:-9] + "z" + b[-8:]])


def test_forms_and_sizes():
    texts = ["  Ab, c  d \n\n x", "", None, "é é\n--\nlast word \n", "\t\t\n a"]
    x = line_dedup.Lines(pa.array(texts))
    want = [normal(line) for t in texts for line in (t or "").split("\n")]
    assert [x.form(i).decode() for i in range(x.n)] == want
    assert x.sizes().tolist() == [len(w) for w in want]


def test_line_edges(documents, edge_rows):
    df = documents(edge_rows)
    got = line_dedup.dedup(df)
    assert got.columns[: len(df.columns)] == df.columns
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0
    assert by[2][0]["text"] == "" and by[3][0]["text"] == "   \n\t "
    assert all(r["text"] == "" and r["n_left"] == 0 and r["n_dropped"] == 1 for r in by[7]) and len(by[7]) == 2
    assert by[6][0]["n_left"] == 1 and by[10][0]["n_lines"] == 3
    assert line_dedup.dedup(documents([])).count() == 0


@pytest.mark.parametrize("texts", [["a\nb", "", None, "\n", "x\n"], ["", ""], [None], ["one line", "\n\ntwo\n"]])
def test_line_places(texts):
    x = line_dedup.Lines(pa.array(texts, pa.string()))
    want = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]
    raw = x.bytes.tobytes()
    got = [(int(d), int(n), raw[a:b].decode().rstrip("\n")) for d, n, a, b in zip(x.doc, x.no, x.off, x.off[1:])]
    assert got == want


def test_group_counts_bound_the_distance():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcdeé1 ü一") for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "é"])
        b = "".join(b) or "x"
        x, y = (line_dedup.group_counts([t.encode()]).view(np.uint8).astype(int) for t in (a, b))
        assert np.abs(x - y).sum() + abs(len(a) - len(b)) <= 2 * distance(a, b)


def test_within_equals_the_table():
    rng = random.Random(0)
    for _ in range(400):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        for most in (0, 1, 3, 8):
            assert line_dedup.within(a, b, most) == (distance(a, b) <= most)


def edited(rng, text, edits, letters="abcé "):
    out = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab", rng.choice(letters)])
    return "".join(out)


@pytest.mark.parametrize("size", [0, 5, 40, 330, 700, 2600])
def test_near_equals_one_by_one(size):
    """Bands of one to many numbers, texts of one length and of many, edits about the limit."""
    rng = random.Random(size)
    x = ["".join(rng.choice("abcdefghijé ") for _ in range(rng.randint(size // 2, size))) for _ in range(60)]
    x += x[:20]
    most = [rng.choice([0, 1, len(t) // 20, len(t) // 10]) for t in x]
    y = [edited(rng, t, max(0, k + rng.randint(-3, 3))) for t, k in zip(x, most)]
    want = [line_dedup.within(a, b, k) for a, b, k in zip(x, y, most)]
    assert size == 0 or {True, False} == set(want)
    assert line_dedup.near(x, y, np.array(most)).tolist() == want
    if size <= 40:
        assert want == [distance(a, b) <= k for a, b, k in zip(x, y, most)]
    few = line_dedup.near(x[:3], y[:3], np.array(most[:3])).tolist()
    assert few == want[:3]


def test_near_with_many_characters():
    rng = random.Random(1)
    x = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(30)]
    y = [edited(rng, t, rng.randint(3, 9)) for t in x]
    want = [line_dedup.within(a, b, 6) for a, b in zip(x, y)]
    assert {True, False} == set(want) and line_dedup.near(x, y, np.full(30, 6)).tolist() == want


@pytest.mark.parametrize("slice_", [512, 7])
def test_blocks_equal_all_pairs_of_a_key(spark, monkeypatch, slice_):
    """Every pair of one key and two roots once, whatever the slices, on the least key that both have."""
    monkeypatch.setattr(line_dedup, "SLICE", slice_)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(3)]
    lines = [edited(rng, rng.choice(base), rng.randint(0, 8)) for _ in range(90)]
    keys = [sorted(rng.sample(range(5), rng.randint(1, 3))) for _ in lines]
    counts = line_dedup.group_counts([t.encode() for t in lines]).tolist()
    rows = [
        (k, i, i % 40, sum(k in ks for ks in keys), 100, [o for o in keys[i] if o < k], t, *counts[i])
        for i, t in enumerate(lines) for k in keys[i]
    ]
    rest = spark.createDataFrame(rows, "key long, id long, root long, members long, bytes long, less array<long>, line string, c0 long, c1 long, c2 long, c3 long")
    got = sorted(tuple(r) for r in line_dedup.linked_in_blocks(rest, 0.9).collect())
    want = [(i, j) for i, j in combinations(range(90), 2) if i % 40 != j % 40 and set(keys[i]) & set(keys[j]) and alike(lines[i], lines[j])]
    assert got == want and len(want) > 50


def test_by_words_never_says_too_few():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.choice(["a", "bc", "def", "", "ghij"]) for _ in range(rng.randint(1, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice([[], ["xy"], ["a", "bc"]])
        b = b or ["z"]
        for most in (0, 2, 4, 9):
            assert not line_dedup.by_words(a, b, most) or distance(" ".join(a), " ".join(b)) <= most
    assert line_dedup.by_words("one two three four five".split(), "two three four six five".split(), 8)


def test_chunks_hold_all_rows_and_few_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 2000 + [None, "y" * 3_000_000, ""]})
    parts = list(chunks(batch, "text", SMALL_CHUNK))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(p.num_rows for p in parts[:4]) <= SMALL_CHUNK // 1000 and line_dedup.SMALL_CHUNK == minhash.SMALL_CHUNK == 1 << 19


@pytest.mark.parametrize("empty", [3, 1 << 20])
def test_keys_of_several_lines_are_found_in_bags(spark, monkeypatch, empty):
    """Whatever is held of a bag at once, and whether a key's ids come from one task or several."""
    monkeypatch.setattr(line_dedup, "EMPTY", empty)
    rng = np.random.default_rng(0)
    keys = np.concatenate([rng.integers(0, 300, 400), np.full(50, 7)]).astype(np.uint64) << np.uint64(48)
    ids = np.concatenate([rng.integers(0, 5, 400), np.arange(50)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = [(b, e) for i in range(0, 450, 150) for b, e in zip(*(x.to_pylist() for x in line_dedup.filled(keys[i : i + 150], ids[i : i + 150])))]
    got = line_dedup.shared_keys(spark.createDataFrame(rows, "bag int, entries binary").repartition(3)).collect()
    of: dict[int, set[int]] = {}
    for k, i in zip(keys.view(np.int64).tolist(), ids.view(np.int64).tolist()):
        of.setdefault(k, set()).add(i)
    assert sorted(tuple(r) for r in got) == sorted((k, i) for k, some in of.items() if len(some) > 1 for i in some)


def test_one_pass_gives_lines_and_keys(documents, monkeypatch):
    """Bags that are filled again and again hold the same keys as those filled once; equal lines give keys once a task."""
    df = documents([(i, f"{sentence(12, i % 7)}\n{sentence(30, i)}\n\n{sentence(3, i)}") for i in range(20)] + [(None, None), (30, "")])
    keyed = df.selectExpr("xxhash64(doc_id, text) uid", "doc_id", "text").coalesce(1)

    def entries():
        rows = line_dedup.read_lines(keyed).collect()
        assert sum(r["bag"] is None for r in rows) == 60 and {(r["doc_id"], r["no"]) for r in rows if r["bag"] is None} == {(i, k) for i in range(20) for k in (0, 1, 3)}
        both = [np.frombuffer(r["entries"], np.uint64).reshape(-1, 2) for r in rows if r["bag"] is not None]
        assert all((x[:, 0] >> np.uint64(53) == r["bag"]).all() for x, r in zip(both, [r for r in rows if r["bag"] is not None]))
        return sorted(map(tuple, np.concatenate(both).tolist()))

    once = entries()
    lines = line_dedup.Lines(pa.array([r["text"] for r in df.select("text").collect()], pa.string()))
    at, h = lines.keys()
    new = np.unique(h, return_index=True)[1]
    line, key = lines.meeting(at[new])
    assert once == sorted(zip(key.tolist(), h[new][line].tolist()))
    monkeypatch.setattr(line_dedup, "FILL", 10)
    monkeypatch.setattr(line_dedup, "SMALL_CHUNK", 200)
    assert entries() == once


def test_few_rows_are_compared_in_few_tasks(spark):
    """Bands of many pairs need tasks of many rows."""
    rest = spark.createDataFrame([], "key long, id long, root long, members long, bytes long, less array<long>, line string, c0 long, c1 long, c2 long, c3 long")
    plan = line_dedup.linked_in_blocks(rest, 0.9, 2 * line_dedup.COMPARED)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression .*, (\d+)", plan) == ["3"]


def test_keys_of_whole_bags_are_not_dealt_again(spark):
    """Bags that fit a task give each row once, so no shuffle has to tell rows apart."""
    keys = np.repeat(np.arange(40), 3).astype(np.uint64) << np.uint64(50)
    ids = np.tile(np.array([5, 5, 9]), 40).astype(np.uint64)
    bags = spark.createDataFrame(list(zip(*(x.to_pylist() for x in line_dedup.filled(keys, ids)))), "bag int, entries binary")
    got = line_dedup.shared_keys(bags)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, i) for k in set(keys.tolist()) for i in (5, 9))


def test_forms_are_read_from_the_documents_that_hold_them(spark):
    """Only the documents named are taken apart; of their lines, those whose hash is wanted."""
    texts = ["One line, here\nanother", "one LINE here\na third", None, "no more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string")
    lines = line_dedup.Lines(pa.array(["one line here", "a third", "another", "no more"]))
    h = lines.keys()[1].view(np.int64).tolist()

    def filter_of(values):
        return bitmap(spark.createDataFrame([(v,) for v in values], "v long"), "v")

    got = line_dedup.normal_forms(docs, filter_of(h), filter_of([1, 2])).collect()
    assert sorted((r["id"], r["line"]) for r in got) == sorted(zip(h[:2], ["one line here", "a third"]))
    got = line_dedup.normal_forms(docs, filter_of(h[1:]), filter_of([0, 1, 2])).collect()
    assert sorted((r["id"], r["line"]) for r in got) == sorted(zip(h[1:3], ["a third", "another"]))


def test_long_lines_within_equals_the_table():
    """Where the comparison of one pair stops early, on the diagonal that ends the table."""
    rng = random.Random(8)
    told = set()
    for _ in range(150):
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(60, 150)))
        b = edited(rng, a, rng.randint(0, 30))
        d = distance(a, b)
        for most in {0, 5, max(d - 1, 0), d, d + 1}:
            told.add(line_dedup.within(a, b, most))
            assert line_dedup.within(a, b, most) == (d <= most)
    assert told == {True, False}
