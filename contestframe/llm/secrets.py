"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query of trigrams that every match must contain. The documents
of an Arrow batch form one shard of the index: postings list, for each trigram that some rule asks for, the
documents that hold it. A rule's query intersects and unites postings; its candidates are verified by the
regex over their whole text. A rule without a mandatory trigram scans every document. Shards need no shuffle,
so the work grows with the text alone.

Defined results: a null or empty text has no spans; repeated rows and equal ids give one result each; spans
that several kinds share are all listed; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestframe.llm.texts import sparing

ANY = True  # the query that every text meets


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group that carries the value, and the least length of that group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"(?P<name>(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the same runs as [0-9a-f]+ of 24 or more
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("source_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES
_MOST = 64  # strings that a part of a regex may stand for before it counts as unknown


def _both(a, b):
    return b if a is ANY else a if b is ANY else ("and", a, b)


def _one_of(parts: list):
    if any(p is ANY for p in parts):
        return ANY
    out = parts[0]
    for p in parts[1:]:
        out = ("or", out, p)
    return out


def _of_strings(strings: set[str]):
    """Query of a part that stands for one of these strings: all trigrams of one of them."""
    parts = []
    for s in sorted(strings):
        q = ANY
        for i in range(len(s) - 2):
            q = _both(q, s[i : i + 3])
        parts.append(q)
    return _one_of(parts) if parts else ANY


def _piece(op, arg) -> tuple[set[str] | None, object]:
    """The strings that one parsed piece can stand for (None: unknown), and a query its matches meet."""
    if op is C.LITERAL and arg < 128:
        return {chr(arg).lower()}, ANY
    if op is C.IN and len(arg) <= 8 and all(o is C.LITERAL and a < 128 for o, a in arg):
        return {chr(a).lower() for _, a in arg}, ANY
    if op is C.SUBPATTERN:
        return _parts(arg[3])
    if op is C.BRANCH:
        each = [_parts(x) for x in arg[1]]
        if all(s is not None for s, _ in each):
            return set().union(*(s for s, _ in each)), ANY
        return None, _one_of([q if s is None else _of_strings(s) for s, q in each])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, query = _parts(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low:
            return None, query if strings is None else _of_strings(strings)
    return None, ANY


def _parts(items) -> tuple[set[str] | None, object]:
    """As _piece, for a sequence of pieces: known strings are joined, an unknown piece ends the run."""
    run, query, known = {""}, ANY, True
    for op, arg in items:
        strings, own = _piece(op, arg)
        if strings is not None and len(strings) * len(run) <= _MOST:
            run = {a + b for a in run for b in strings}
        else:
            query = _both(_both(query, _of_strings(run)), own if strings is None else _of_strings(strings))
            run, known = {""}, False
    return (run, ANY) if known else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str):
    """Boolean query of lower-case trigrams that every match of the pattern meets; True if there is none."""
    strings, query = _parts(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _leaves(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else _leaves(query[1]) | _leaves(query[2])


def _found(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(query, str):
        return postings[query]
    a, b = _found(query[1], postings), _found(query[2], postings)
    return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


def _code(tri: str) -> int:
    a, b, c = tri.encode()
    return a << 16 | b << 8 | c


def shard_index(texts: list[str], trigrams: list[str]) -> dict[str, np.ndarray]:
    """Postings of one shard: for each trigram, the sorted places in `texts` of those that hold it."""
    wanted = np.full(1 << 24, -1, np.int16)
    for n, tri in enumerate(trigrams):
        wanted[_code(tri)] = n
    found = {tri: [] for tri in trigrams}
    for place, text in enumerate(texts):
        raw = np.frombuffer(text.encode().lower(), np.uint8).astype(np.int32)
        if len(raw) < 3:
            continue
        hit = wanted[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
        for n in np.unique(hit[hit >= 0]):
            found[trigrams[n]].append(place)
    return {tri: np.array(places, np.int64) for tri, places in found.items()}


def _spans(text: str, rule: Rule, rx: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in rx.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with one more column, `spans`: array of (kind, start, end) in code points, end exclusive.

    Spans are leftmost and non-overlapping per kind, ordered by start and then by the order of the rules.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(_leaves, queries)))

    def scan(texts: pa.Array) -> pa.Array:
        whole = [t or "" for t in texts.to_pylist()]
        postings, spans = shard_index(whole, trigrams), [[] for _ in whole]
        for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            rx = re.compile(rule.pattern, re.ASCII)
            for place in range(len(whole)) if query is ANY else _found(query, postings):
                spans[place] += [(a, n, b) for a, b in _spans(whole[place], rule, rx)]
        rows = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(s)] for s in spans]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    found = F.arrow_udf(sparing(scan), "array<struct<kind:string,start:bigint,end:bigint>>")
    return docs.withColumn("spans", found(F.col(text)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows with every span of the text replaced by `mark`; overlapping spans become one. Null stays null."""
    known = tuple(docs.columns)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in known]).alias("row"), F.col(text).alias("body"))

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for body, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if not found:
                out.append(body)
                continue
            pieces, at = [], 0
            for s in found:
                if s["start"] >= at:
                    pieces += [body[at : s["start"]], mark]
                at = max(at, s["end"])
            out.append("".join(pieces) + body[at:])
        return pa.array(out, pa.string())

    done = find_secrets(packed, "body", rules).withColumn("body", F.arrow_udf(sparing(cut), "string")("body", "spans"))
    return done.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in known])
