"""Base spans against the contract's patterns, the lexer on source and configuration."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    """The contract read plainly: all matches, and then those that fail go."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def told(text):
    return [(f["kind"], text[f["start"] : f["end"]]) for f in secrets.findings(text)]


def literals(text):
    return [t for k, t in told(text) if k == "literal"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A = 'kX9vQ2mLw8'\nB = A\npassword = B\n", ["kX9vQ2mLw8"]),
        ("password = A\nA = 'kX9vQ2mLw8'\n", ["kX9vQ2mLw8"]),
        ("db_passphrase = 'kX9v' + \"Q2mLw8\"\n", ["kX9v", "Q2mLw8"]),
        ("pass_phrase = ''\npwd = ('a')\n", []),
        ('{"client key": "Zx81-ppq-1144", "port": "Zx81-ppq-1145"}', ["Zx81-ppq-1144"]),
        ("db:\n  user: root7711xx\n  pwd: hunter2-xyz1\n", ["hunter2-xyz1"]),
        ("passphrase: correcthorse\n", ["correcthorse"]),
        ("his passphrase: correcthorse was long", []),
        ("pwd = os.getenv('DB_PWD_NAME_9')", []),
        ("pwd = SecretStr('ghT67_kkqw')", ["ghT67_kkqw"]),
        ("const dbPwd: string = `ghT67_kkqw`;", ["ghT67_kkqw"]),
        ("pwd := \"ghT67_kkqw\"\n:pwd => 'ghT67_kkqx'", ["ghT67_kkqw", "ghT67_kkqx"]),
        ("#define SIGNING_KEY \"jk3389sdfkj\"", ["jk3389sdfkj"]),
        ("<pwd>s3cr3tP4ss</pwd><user>s3cr3tP4sx</user>", ["s3cr3tP4ss"]),
        ("cfg['jwt'] = f'{part}-9912ab'\npart = 'qwer7788ty'", ["{part}-9912ab", "qwer7788ty"]),
        ("password_file = 'sdfkjh3287sdf'", []), ("pwd = '<your password here>'\npwd = 'changeme'\npwd = 'xxxxxxxx'\npwd = '${PWD_FROM_ENV}'", []),
        ("x = y\ny = x\npwd = x", []), ("pwd = pwd", []), ("a == 'kX9vQ2mLw8' and pwd == 'kX9vQ2mLw8'", []),
        ("base_a1 = 'kX9vQ2mLw8'\npwd = base_a1\njwt = base_a1", ["kX9vQ2mLw8"]),
        ("it's a secret=no\npwd='ü9vQ2mLw8é'", ["ü9vQ2mLw8é"]),
    ],
)
def test_lexing(text, want):
    assert literals(text) == want


def test_a_literal_in_a_base_span_is_told_once():
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    assert [k for k, _ in told(text)] == ["assign", "hex"]


def test_names_weigh_by_their_words():
    assert secrets.weight("dbPassword") == secrets.weight("DB_PASSWORD") == secrets.weight("cfg['db-password']") == 1
    assert secrets.weight("api_key") == secrets.weight("privateKey") == 1 > secrets.THRESHOLD > secrets.weight("key") > secrets.weight("primary_color") == 0
    assert secrets.weight("token_count") < secrets.THRESHOLD


def noise(rng):
    parts = ["password", "PassWord", "secret", "token", "api_key", "APIKEY", "pwd", "AKIA", "AKIAAKIA", "=", ":", " ", "  ", '"', "'", "\n", "abc", "Zz09_", "0123456789abcdef", "f" * 23, "ABCDEFGH12345678", "é", "ſecret", "toKen", "+", "(", ")", "<pwd>", "</pwd>", ">", ".", "-", "`", '"""', "\\", "=>", ":=", "#define ", "$x", "{x}"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_noise_base_equals_the_contract_and_no_candidate_is_passed_over():
    rng = random.Random(11)
    texts = [noise(rng) for _ in range(20_000)]
    column = pa.array(texts)
    maybe = pc.or_(pc.match_substring_regex(column, secrets._MAYBE_BASE), pc.match_substring_regex(column, secrets._MAYBE_NAME)).to_pylist()
    some = 0
    for t, m in zip(texts, maybe):
        found = secrets.findings(t)
        assert [(f["kind"], f["start"], f["end"]) for f in found if f["kind"] != "literal"] == base(t)
        assert m or not found
        some += any(f["kind"] == "literal" for f in found)
    assert some > 20


ROWS = [
    (1, None), (2, ""), (3, "plain words only"), (4, "é password: 'abcdef1' and é"), (4, "é password: 'abcdef1' and é"), (None, "AKIA" + "A1" * 8), (5, "x" * 300_000 + " pwd = 'kX9vQ2mLw8' " + "0a" * 20),
    (6, "token=abc secret=token:abcdefgh"), (7, "A1 = 'kX9vQ2mLw8'\npwd = A1"),
]


def brute(rows):
    out = []
    for i, t in rows:
        t = t or ""
        b = base(t)
        n = [sum(k == x for x, _, _ in b) for k in secrets.BASE]
        out.append((i, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_odd_rows(spark, documents, tmp_path):
    documents(ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.query(spark, str(tmp_path))
    rows = got.collect()
    assert sorted([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows], key=str) == brute(ROWS)
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert spans[1] == spans[2] == spans[3] == "" and spans[7] == "literal:6:16" and spans[5].startswith("literal:300008:300018,hex:")


def test_query_equals_the_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = secrets.query(spark, sf_dir).collect()
    got = sorted([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows], key=str)
    assert got == brute([(d["doc_id"], d["text"]) for d in docs])
    for r in rows:
        assert [x for x in r["spans"].split(",") if x and not x.startswith("literal")] == [f"{k}:{s}:{e}" for k, s, e in base(dict((d["doc_id"], d["text"]) for d in docs)[r["doc_id"]] or "")]


def test_empty_table(spark, documents):
    assert secrets.scan(documents(ROWS).where("doc_id < 0")).collect() == []


def test_time_is_linear_in_long_lines():
    import time

    parts = ["pwd = 'kX9vQ2mLw8' ", "a: b=", "pwd: abcdefgh ", "<pwd>", "`", '"""', "x->y", "secret "]
    for p in parts:
        begin = time.perf_counter()
        secrets.findings(p * (1_000_000 // len(p)))
        assert time.perf_counter() - begin < 20
