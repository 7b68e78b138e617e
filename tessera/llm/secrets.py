"""Secret scanning by assignment-aware lexing.

Three fixed patterns give the base spans. Beyond them, a text that names something
sensitive before an assignment sign is read as source code or configuration: every
``name = value``, ``name: value``, ``"name": value``, ``name := value``, ``name => value``,
``name: type = value``, ``#define name value`` and ``<name>value</name>`` becomes a pair of a
target name and the literals and names of its value, which may be joined by ``+`` or ``.``, stand
one after the other, interpolate names or be wrapped in a plain conversion.

Constants propagate from sensitive names backwards: the names in their values are sensitive
too, as much as the target, and so on; each name is visited once, the most sensitive first,
so the work is linear in the pairs. A literal scores its target's weight times its own
strength, which is the information in its characters; from ``THRESHOLD`` on it is a finding.
Placeholders and references to the environment have no strength, and a bare word
must look like a key or have its line for itself. A literal inside a base span is
reported by that span.

Cases: null and empty texts have no findings; texts are read whole, at any length; names are
resolved within a document; a name assigned several times stands for all its values;
repeated rows and null ids are scanned each. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, cut

KINDS = ("assign", "access", "hex", "literal")
BASE = KINDS[:3]
THRESHOLD = 0.5
#: Bits of information at which a literal is as strong as can be; characters that one has at least.
STRONG, LEAST = 24.0, 6
#: A bare value that isn't key-like counts if at most so many characters stand before it in its line.
TARGET = 200

# The base, as the contract has it.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a text with a base span has somewhere.
_MAYBE_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

# Words of sensitive names and their weights, words before "key" that make it sensitive, words
# at the end of a name that make it harmless, conversions that hand a literal on, and placeholders.
WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "secrets": 1.0, "token": 1.0, "tokens": 1.0, "credential": 1.0,
    "credentials": 1.0, "cred": 0.9, "creds": 0.9, "apikey": 1.0, "authkey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "bearer": 0.9, "jwt": 0.9, "auth": 0.7,
    "authorization": 0.8, "pin": 0.6, "otp": 0.6, "salt": 0.6, "signature": 0.5, "key": 0.4,
}
KEYS = {"access", "account", "api", "app", "application", "auth", "client", "consumer", "deploy", "encryption", "hmac", "license", "master", "private", "secret", "service", "shared", "signing", "ssh", "storage"}
HARMLESS = {
    "age", "class", "column", "count", "enabled", "endpoint", "error", "expires", "expiry", "field", "file", "filename", "format", "header", "hint", "host", "id", "index", "label", "length", "limit", "max",
    "message", "min", "mode", "name", "path", "pattern", "policy", "prefix", "prompt", "provider", "regex", "required", "size", "status", "text", "title", "ttl", "type", "uri", "url", "usage", "version",
}
WRAPPERS = {"b", "b64decode", "bytes", "decode", "encode", "frombase64string", "getbytes", "repr", "secret", "secretstr", "securestring", "str", "strdup", "string", "tobytes", "trim"}
_PLACEHOLDER = re.compile(
    r"(?i)(.)\1*|(?:change|replace|fill|insert|put|enter|todo|fixme|your|my)[-_ ]?.*(?:me|here|this|key|token|secret|password|value)|.*(?:example|placeholder|redacted|sample|dummy).*"
    r"|password\d{0,3}|passwd|secret|token|none|null|nil|true|false|undefined|default|empty|string|test(?:ing)?|\$[{(].*|\{\{.*|<.*>|%\(.*\)s|%[A-Z_]+%|\$[A-Za-z_]\w*"
)
_STEMS = "|".join(sorted({w.rstrip("s") if w not in ("pass",) else w for w in WORDS}))
#: What a line with a sensitive target has: a word of the name, and later a sign that assigns, or a definition.
_MAYBE_NAME = rf"(?i:(?:{_STEMS})[^\n=:>]*[=:>]|define[^\n]*(?:{_STEMS}))"

_NAME = r"[A-Za-z_$][\w$\-]*+(?:(?:\.|->|::)[A-Za-z_$][\w$\-]*+)*+"
_SUBSCRIPT = r"""(?:\[[ \t]*["']?[\w.\-]+["']?[ \t]*\])"""
_PAIR = re.compile(
    rf"""(?:\#[ \t]*define[ \t]+(?P<define>{_NAME})[ \t]+(?=["'\w]))
    | <(?P<tag>[A-Za-z_][\w.\-]*+)>(?=[^<\s])
    | (?:(?P<quote>["'])(?P<quoted>[A-Za-z_][\w .\-]{{0,127}})(?P=quote) | (?<![\w$\-.])(?P<name>{_NAME}{_SUBSCRIPT}*+))
      [ \t]*+(?: :=|=>|:[ \t]*+[A-Za-z_&][\w.&<>\[\]|]*+[ \t]*+=(?![=~>]) | =(?![=~>]) | :(?![:=/]) )[ \t]*+""",
    re.X,
)
_STRING = re.compile(r'''[rbfuRBFU]{0,2}(?:"""(?P<c>(?:\\.|[^\\])*?)"""|"(?P<d>(?:\\.|[^"\\\n])*+)"|'(?P<s>(?:\\.|[^'\\\n])*+)'|`(?P<t>(?:\\.|[^`\\])*+)`)''', re.S)
_CALL = re.compile(rf"(?:new[ \t]+)?({_NAME})\(\s*")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")
_WORD = re.compile(_NAME)
_JOIN = re.compile(r"[ \t]*+(?:(?P<sign>\+|\.(?=[ \t\"'])|\\(?=\n))\s*|(?P<next>\s*(?=[rbfuRBFU]{0,2}[\"'])))")
_LINE_END = re.compile(r"[ \t\r]*+(?:\n|\Z)")
_INSIDE = re.compile(r"(?:\$\{|#\{|\{)[ \t]*([A-Za-z_][\w.]*)[ \t]*\}|\$([A-Za-z_]\w*)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def weight(name: str) -> float:
    """How sensitive a target's name is, 0 to 1, from the words it is made of."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    best = 0.0
    for k, p in enumerate(parts):
        w = WORDS.get(p, 0.0)
        if p in ("key", "keys") and k and parts[k - 1] in KEYS:
            w = 1.0
        best = max(best, w)
    return best * 0.2 if parts and parts[-1] in HARMLESS else best


def strength(literal: str) -> float:
    """How much a literal looks like something secret, 0 to 1: its characters' information."""
    n = len(literal)
    if n < LEAST or _PLACEHOLDER.fullmatch(literal) or any(c.isspace() for c in literal):
        return 0.0
    bits = -sum(c * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / STRONG)


def _keyish(literal: str) -> bool:
    """Whether a bare word looks like a key rather than a word of prose."""
    return any(c.isdigit() for c in literal) or bool(re.search(r"[a-z][A-Z]|\w[^\w\s.,:;!?'\-]\w", literal))


class Pair:
    """A target, the literals of its value as (start, end, bare), and the names in it."""

    __slots__ = ("name", "pieces", "refs")

    def __init__(self, name: str) -> None:
        self.name, self.pieces, self.refs = name, [], []


def _value(text: str, at: int, pair: Pair) -> int:
    """Read the terms of a value; where it ends."""
    while True:
        if m := _STRING.match(text, at):
            start, end = m.span(m.lastgroup)
            inside = [x[0] or x[1] for x in _INSIDE.findall(text, start, end)]
            pair.refs += inside
            pair.pieces.append((start, end, False))
        elif m := _CALL.match(text, at):
            if re.split(r"\W", m[1])[-1].lower() not in WRAPPERS:
                return m.end()
            at = m.end()
            continue
        elif m := _BARE.match(text, at):
            if w := _WORD.fullmatch(text, m.start(), m.end()):
                pair.refs.append(w[0])
            pair.pieces.append((*m.span(), True))
        else:
            return at
        at = m.end()
        m = _JOIN.match(text, at)
        if not m or not (m["sign"] or (m.lastgroup == "next" and not pair.pieces[-1][2])):
            return at
        at = m.end()


def pairs(text: str) -> Iterator[Pair]:
    """The assignments of a text, in order."""
    at = 0
    while m := _PAIR.search(text, at):
        pair = Pair(m["define"] or m["tag"] or m["quoted"] or m["name"])
        if m["tag"]:
            close = text.find("<", m.end())
            at = len(text) if close < 0 else close
            if text.startswith(f"</{m['tag']}>", at):
                pair.pieces.append((m.end(), at, False))
                yield pair
            else:
                at = m.end()
            continue
        end = _value(text, m.end(), pair)
        yield pair
        # a bare value may itself be a target, as in a: b = "c"
        at = end if pair.pieces and not pair.pieces[0][2] else m.end()


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of the literals that score THRESHOLD or more, by place."""
    every = list(pairs(text))
    by_name = defaultdict(list)
    for p in every:
        by_name[p.name].append(p)
        if (last := re.split(r"[^\w$\-]+", p.name.rstrip("\"'] \t"))[-1]) != p.name:
            by_name[last].append(p)
    names = set(by_name)
    found: dict[tuple[int, int], tuple[float, str]] = {}
    seen: set[int] = set()
    for w, _, target in sorted(((weight(p.name), -k, p) for k, p in enumerate(every)), key=lambda x: x[:2], reverse=True):
        if w < THRESHOLD:
            break
        queue = [target]
        while queue:
            p = queue.pop()
            if id(p) in seen:
                continue
            seen.add(id(p))
            own = [(s, e, bare) for s, e, bare in p.pieces if not (bare and text[s:e] in names)]
            whole = "".join(text[s:e] for s, e, _ in own)
            score = w * strength(whole)
            if score >= THRESHOLD:
                for s, e, bare in own:
                    if e > s and (not bare or _keyish(text[s:e]) or _alone(text, s, e)):
                        found.setdefault((s, e), (score, target.name))
            for r in p.refs:
                # taken out: a name's values are visited once, for the most sensitive of its targets
                queue += by_name.pop(r, []) if r != p.name else []
    return [(s, e, name, score) for (s, e), (score, name) in sorted(found.items())]


def _alone(text: str, start: int, end: int) -> bool:
    """Whether a bare value ends its line, and its line holds only the target before it."""
    begin = text.rfind("\n", max(0, start - TARGET), start) + 1
    line = text[begin:start].strip()
    return (begin > 0 or start < TARGET) and bool(_LINE_END.match(text, end)) and len(line.split()) <= 2 and line[-1:] in ("=", ":")


def findings(text: str) -> list[dict]:
    """All spans of a text by start, then kind; base ones first as they are, literals that none of them covers."""
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "name": None, "score": None} for s, e, k in base]
    reach, at, k = -1, [], 0
    for s, e, name, score in literals(text):
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][1])
            k += 1
        if reach < e:
            at.append({"kind": "literal", "start": s, "end": e, "name": name, "score": score})
    return sorted(out + at, key=lambda x: (x["start"], KINDS.index(x["kind"])))


FINDING = "struct<kind:string,start:bigint,`end`:bigint,name:string,score:double>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, findings) of every row, as a table. Texts without any sign of a finding are told by two patterns over
    whole columns; the others are read one by one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                text = part.column("text")
                maybe = pc.fill_null(pc.or_(pc.match_substring_regex(text, _MAYBE_BASE), pc.match_substring_regex(text, _MAYBE_NAME)), False)
                told = [findings(t.as_py()) if m else [] for t, m in zip(text, maybe.to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(told, found_type)], names=["doc_id", "findings"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, findings array<{FINDING}>"), "findings")


def joined(found: Column) -> Column:
    """``kind:start:end`` of each finding, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    scanned = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = F.col("findings")

    def of(kind: str) -> Column:
        return F.filter(found, lambda f: f["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter(found, lambda f: f["kind"] != "literal")
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"))
