"""Fingerprints, WARC archives, mixing, packing, and the whole pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, mixing, packing, warc
from tests.llm.conftest import sentence
from tests.llm.test_pairs import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- fingerprints ------------------------------------------------------------------------------


def test_edited_texts(documents):
    texts = {i: t for i, t in enumerate([sentence(50, 1), "", None, "é" * 7, sentence(50, 1), "ab", sentence(9, 4)])}
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest() and got[i]["n_chars"] == len(own)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[4]["fingerprint"] != got[3]["fingerprint"]


def test_many_buckets_give_the_same_neighbours(documents):
    ids = random.Random(2).sample(range(-(10**12), 10**12), 60) + list(range(100, 160))
    docs = documents([(i, f"text {i}") for i in ids], extra=False).withColumn("_order", F.col("doc_id"))
    for near in (1, 7, 2000):
        dealt, window = fingerprints.with_next(docs, "_order", near)
        got = dict(dealt.select("doc_id", "_ghost", F.lead("doc_id").over(window).alias("after")).where("not _ghost").select("doc_id", "after").collect())
        order = sorted(ids, reverse=True)
        assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}




def test_likeness_follows_edits(documents):
    base = sentence(400, 1).split()
    half = base[:200] + sentence(200, 2).split()
    few = list(base)
    few[100] = "changed"
    moved = base[200:] + base[:200]
    docs = documents([(0, " ".join(base)), (1, " ".join(few)), (2, " ".join(half)), (3, sentence(400, 3)), (4, " ".join(moved)), (5, "  ".join(base))])
    c = {r["doc_id"]: r["c"] for r in docs.select("doc_id", fingerprints.coordinates(F.col("text")).alias("c")).collect()}
    like = lambda i: np.mean(np.array(c[0]) == np.array(c[i]))
    assert like(5) == 1 and like(1) > 0.9 > like(4) > 0.2 and 0.05 < like(2) < 0.6 and like(3) == 0
    assert like(4) < like(1)  # equal sets of k-mers but for one, in another order


def plain_fingerprint(text: str) -> list[int]:
    """Order MinHash by its definition."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def h(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x, seed=seed)
        return signed(seed)

    long, short = (lambda x: struct.pack("<q", x)), (lambda x: struct.pack("<i", x))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    kmers = [h(*w[i : i + 2]) for i in range(max(len(w) - 1, min(len(w), 1)))]
    keep = (1 << 40) - 1
    top = lambda x: signed((x & keep) << 24) >> 24
    first: dict[int, int] = {}
    own = []
    for place, x in enumerate(kmers):
        n = first.get(top(x), 0)
        first[top(x)] = n + 1
        own.append((top(h(long(top(x)), short(n))), place))
    if not own:
        return [0] * 64
    own.sort()
    out = []
    for j in range(64):
        at = sum(signed((v & keep) << 24) + p < (j - 32) << 58 for v, p in own)
        a, b = sorted((own[at % len(own)], own[(at + 1) % len(own)]), key=lambda x: x[1])
        out.append(h(long(a[0]), long(b[0])) & 0xFFFF)
    return out


def test_fingerprints_equal_the_definition(documents, edge_rows):
    rows = [(i, t) for i, (_, t) in enumerate(edge_rows) if t is None or len(t) < 5000] + [(50, "a b " * 40), (51, sentence(300, 8)), (52, "x")]
    texts = dict(rows)
    docs = documents(rows)
    for r in docs.select("doc_id", fingerprints.coordinates(F.col("text")).alias("c")).collect():
        assert r["c"] == plain_fingerprint(texts[r["doc_id"]] or "")
    order = sorted(texts, reverse=True)
    for r in fingerprints.fingerprints(docs).collect():
        own, after = (texts[i] or "" for i in (r["doc_id"], order[(order.index(r["doc_id"]) + 1) % len(order)]))
        half = len(own) // 2
        a, b, c = (plain_fingerprint(t) for t in (own, own[: len(own) - half] + after[:half], after))
        like = lambda x, y: sum(p == q for p, q in zip(x, y)) / 64
        assert r["fingerprint"] == "".join(f"{x:04x}" for x in a) and r["edited_fingerprint"] == "".join(f"{x:04x}" for x in b)
        assert r["near_edited"] == like(a, b) and r["near_next"] == like(a, c)


def test_occurrences_are_numbered(documents):
    docs = documents([(0, "a b " * 30), (1, "a b " * 60), (2, "a b " * 30)])
    c = {r["doc_id"]: tuple(r["c"]) for r in docs.select("doc_id", fingerprints.coordinates(F.col("text")).alias("c")).collect()}
    assert c[0] == c[2] != c[1]


def test_fingerprint_edges(documents, edge_rows):
    got = fingerprints.fingerprints(documents(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert fingerprints.fingerprints(documents([])).count() == 0
    one = fingerprints.fingerprints(documents([(1, "abcd")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1


# --- WARC ------------------------------------------------------------------------------------------


@pytest.fixture
def pages(spark):
    rows = [(i, f"https://www.Host{i % 4}.example.com:80/p/{i}?x=1#top", f"<html>é {i % 7}</html>") for i in range(60)]
    rows += [(100, None, None), (101, "http://a.b/", ""), (None, "http://a.b/", "x"), (None, "http://a.b/", "<html>é 1</html>"), (59, rows[59][1], rows[59][2]), (102, "not a url", "z" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit(1)).repartition(4), rows


def test_archives_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    df, rows = pages
    folder = str(tmp_path / "warc")
    top = warc.index(warc.write(df, folder), folder)
    keys = df.select(warc.url_key(F.col("url")).alias("key"))
    got = warc.read(warc.lookup(keys, top, folder), folder).collect()
    kept: dict[str, int] = {}
    for i, _, h in rows:
        if i is not None:
            kept[h or ""] = max(kept.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = h in kept and i != kept[h]
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", kept[h] if revisit else None, None if revisit else h))
    order = lambda rs: sorted(rs, key=str)
    assert order(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")) for r in got) == order(want)
    assert warc.lookup(spark.createDataFrame([("com,nowhere)/",), ("",)], "key string"), top, folder).count() == 0


def test_urls_with_control_characters(spark, tmp_path):
    urls = ["http://a.b/x\ty", "http://a.b/x\ny", "http://a.b/x\r\n\r\ny", "http://a.b/x\x01y", "http://a.b/\x00", "http://a.b/#f\nz", "http://a.b/x", "\n", "http://a\t.b/x\x7f"]
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(2)
    top = warc.index(warc.write(df, str(tmp_path)), str(tmp_path))
    got = warc.read(warc.lookup(df.select(warc.url_key(F.col("url")).alias("key")), top, str(tmp_path)), str(tmp_path)).collect()
    assert {r["page_id"]: (r["url"], r["payload"]) for r in got} == {i: (warc._uri(u), f"<p>{i}</p>") for i, u in enumerate(urls)} and len(got) == len(urls)


def test_url_keys(spark):
    urls = ["https://user@WWW.Example.com:8080/A/b?q#f", "http://example.com", "example.com/x", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").orderBy("i").select(warc.url_key(F.col("url"))).collect()]
    assert got == ["com,example,www)/a/b?q", "com,example)/", "com,example)/x", ")/", ")/"]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    top = warc.index(warc.write(none, str(tmp_path)), str(tmp_path))
    assert top == [] and warc.read(warc.lookup(none.select(F.lit("x").alias("key")), top, str(tmp_path)), str(tmp_path)).count() == 0


def test_damage_is_noticed():
    good = warc.record("response", {"WARC-Record-ID": "<urn:page:1>"}, b"abc")
    assert warc.parse(good)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(good[:-5])


# --- mixing ----------------------------------------------------------------------------------------


def plain_mix(rows):
    size = {k: len(tokens(t)) for k, (_, t, _) in enumerate(rows)}
    total = {}
    for k, (_, _, s) in enumerate(rows):
        total[s] = total.get(s, 0) + size[k]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            return size, total, target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over


def test_mix(documents, edge_rows):
    rng = random.Random(0)
    rows = [(i, sentence(rng.randint(1, 60), i), rng.choice(["hot"] * 5 + ["ä", "b", "c", "d", "Z", None])) for i in range(400)] + [(i, t, "hot") for i, t in edge_rows if i != 8 and i != 9] + [(9000, "", "nil")]
    docs = documents([(i, t, None, s) for i, t, s in rows])
    got = mixing.mix(docs).collect()
    size, total, target = plain_mix(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size.values())
    assert all(abs(taken[s] - target[s]) <= 80 for s in target)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(mixing.mix(docs.repartition(2)).collect()) == key(got)
    assert mixing.mix(documents([])).count() == 0


@pytest.mark.parametrize("block", [3, 10_000])
def test_mix_without_ids_and_with_copies(documents, monkeypatch, block):
    """Rows without ids, of one repeated id, and many equal rows: each source still meets its target
    within one document."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(None if i % 10 else i, None, sentence(10, i), "a") for i in range(300)]
    rows += [(None, None, "the same ten words in every row of this one", "b")] * 120
    rows += [(7, None, sentence(10, 1000 + i), "c") for i in range(150)]
    docs = documents([(i, t, lang, s) for i, lang, t, s in rows])
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    key = lambda rs: sorted((str(r["doc_id"]), r["source"], r["size"], r["taken"]) for r in rs)
    assert key(mixing.mix(docs.repartition(3)).collect()) == key(got)


# --- packing ---------------------------------------------------------------------------------------

GROWTH = """
import re, sys
import numpy as np, pyarrow as pa
from tessera.llm import packing
def status(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
enc, rng = packing.Encoder(sys.argv[1]), np.random.default_rng(0)
b = rng.integers(97, 123, 24 << 20, dtype=np.uint8)
b[::8] = 32
texts = [b[i : i + (1 << 17)].tobytes().decode() for i in range(0, len(b), 1 << 17)]
del b
batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 8]}) for i in range(0, len(texts), 8)]
before = status("VmRSS")
for part in packing.gathered(iter(batches), "text", packing.CHUNK):
    enc.encode(part.column("text"))
print(status("VmHWM") - before)
"""


def test_a_worker_stays_small_on_ever_new_words():
    """Two of them share an executor with a heap that earlier stages have filled."""
    got = subprocess.run([sys.executable, "-c", GROWTH, BPE], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert int(got.stdout) < 350



def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TRICKY = ["", " ", "a  b", " lead", "trail ", "x\n\ny", "x \n y", "tab\tx", "don't we'll", "a b　c", "\x1c \x1d", "<|endoftext|> x", "é" * 50, "a" * 3000, "1 2 33,4.5!?", "\r\n\r\n", "日本語 テキスト", "🙂 🙂🙂"]


def test_pieces_encode_as_the_whole():
    enc = packing.Encoder(BPE)
    texts = TRICKY + [" ".join(random.Random(i).choices(TRICKY, k=5)) for i in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == encode(texts)


def test_new_pieces_are_learned_together(monkeypatch):
    """Pieces between spaces get their ids from one string, without an array for each of them."""
    monkeypatch.setattr(packing, "TOGETHER", 64)
    enc = packing.Encoder(BPE)
    texts = [sentence(200, 5), "x", "", None, "one\n  two\u3000three \n", "<|endoftext|> x", sentence(40, 6) + "\n" + sentence(3, 5), " a"]
    want = [np.array(enc.tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    made = []
    split = np.split
    monkeypatch.setattr(packing.np, "split", lambda *a, **k: made.append(len(split(*a, **k))) or split(*a, **k))
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]
    assert sum(made) == 0 and len(enc.known) > 200 and len(enc.first) == len(enc.known) + 1 and enc.first[-1] == len(enc.ids)


def test_pieces_at_hand_are_not_learned_again(monkeypatch):
    """When too many pieces are remembered, those of the text at hand stay."""
    monkeypatch.setattr(packing, "REMEMBER", 50)
    enc = packing.Encoder(BPE)
    learned = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: learned.extend(new.to_pylist()) or learn(new))
    first, second = sentence(80, 5), "one two"
    enc.encode([first])
    assert enc.encode([second + " " + first]) == [np.array(enc.tok.encode(second + " " + first, add_special_tokens=False).ids, "<u4").tobytes()]
    assert learned.count(" " + first.split()[-1]) == 1 and len(learned) == len(enc.known) + 1  # the first word is another piece after a space
    enc.encode(["three four"])
    assert sorted(enc.known.to_pylist()) == [" four", "three"]


def test_packing_is_lossless(documents, edge_rows):
    rng = random.Random(1)
    rows = edge_rows + [(100 + i, ". ".join(sentence(rng.randint(3, 30), i * 50 + j) for j in range(rng.randint(1, 40)))) for i in range(60)]
    df = documents(rows)
    got = packing.pack(df, BPE).collect()
    ids = {}
    for (i, t), x in zip(rows, encode([t for _, t in rows])):
        ids.setdefault((i, len(x) + 1), []).append(np.array(x + [1], "<u4"))
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert set(pieces) == set(ids)
    for k, ps in pieces.items():
        x, copies = ids[k][0], len(ids[k])
        assert sum(p["length"] for p in ps) == copies * len(x)
        cover = np.zeros(len(x), int)
        for p in ps:
            cover[p["start"] : p["start"] + p["length"]] += 1
            assert any(zlib.crc32(y[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for y in ids[k])
        assert (cover == copies).all()
    pad = 0
    for ps in sequences.values():
        ps.sort(key=lambda r: r["offset"])
        at = 0
        for p in ps:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad < 0.05 * sum(r["length"] for r in got)
    assert packing.pack(documents([]), BPE).count() == 0


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        pos, pen = [0], [0]
        while len(pos) < 12:
            pos.append(pos[-1] + rng.randint(1, 9))
            pen.append(rng.choice((0, 2, 7)))
        cost, best = [0] + [10**9] * 11, None
        for j in range(1, 12):
            cost[j] = min(cost[i] + 12 - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= 12)
        cuts = packing.best_cuts(pos, pen, True, 12)
        assert cuts[0] == 0 and cuts[-1] == 11
        best = sum(12 - (pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:]))
        assert best == cost[11] and all(pos[b] - pos[a] <= 12 for a, b in zip(cuts, cuts[1:]))


def test_blocks_join_without_loss(documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    packer = packing.Packer(packing.encoder(BPE).sentence_end)
    want = {}
    for i in range(40):
        x = np.random.default_rng(i).integers(0, 50_000, int(np.random.default_rng(i).integers(1, 4000)))
        want[i] = x
        packer.add(i, x.astype("<u4").tobytes())
    packer.solve(True)
    seen = {}
    for doc, start, length, crc, n, sequence, offset in packer.take():
        assert zlib.crc32(want[doc][start : start + length].astype("<u4").tobytes()) == crc and n == len(want[doc]) and start == seen.get(doc, 0)
        seen[doc] = start + length
    assert seen == {i: len(x) for i, x in want.items()}


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    sizes = []
    for name, stage in P.STAGES[:-1]:
        after = P.cut(stage(spark, before, sf_dir), name)
        assert sorted(after.columns) == sorted(docs.columns)
        sizes.append(after.count())
        if name == "language_id":
            kept = after
        if name == "minhash":
            assert after.select("doc_id").distinct().count() == after.count()
        before = after
    assert kept.count() >= 0.95 * docs.count() and sizes[0] >= sizes[1] >= sizes[2] > 0
    # brute force for what the line stage must leave: no normal form twice
    from tests.llm.test_pairs import normal

    packed = P.STAGES[-1][1](spark, before, sf_dir).collect()
    assert sum(r["length"] for r in packed) == sum(len(x) + 1 for x in encode([r["text"] for r in before.collect()]))
    lines = P.STAGES[1][1](spark, kept, sf_dir).select("text").collect()
    forms = [f for r in lines for x in (r["text"] or "").split("\n") if (f := normal(x))]
    assert len(forms) == len(set(forms))


def test_pipeline_edges(spark, documents, edge_rows):
    import corpus_pipeline as P

    rows = [(i, t, "en" if i and i % 2 else None, "s" if i and i % 3 else None) for i, t in edge_rows]
    docs = documents(rows)
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, ""), name)
        if name == "minhash":
            assert sorted(docs.columns) == sorted(P.COLUMNS)
            kept = [r["doc_id"] for r in docs.collect()]
            assert not {1, 2, 3, 12} & set(kept) and len(kept) == len(set(kept)) and kept.count(7) == 0 and 6 in kept
    assert {r["doc_id"] for r in docs.collect()} <= set(kept) and docs.agg(F.min("length")).first()[0] > 0
    none = documents([])
    for name, stage in P.STAGES:
        none = P.cut(stage(spark, none, ""), name)
    assert none.count() == 0
