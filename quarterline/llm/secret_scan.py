"""Secret scans through a trigram inverted index.

From every rule's regular expression a Boolean query over trigrams that any match must contain is
derived. The index is partitioned by documents: each shard (one Arrow batch) holds posting lists of
the trigrams that some rule asks for; the rules' queries are answered by intersecting and uniting
them, and only the candidates are verified with the expression itself. A rule without a mandatory
trigram scans every text of the shard. Nothing is shuffled and no shard sees another one.

Trigrams are taken from the UTF-8 bytes with A-Z in lower case, so that rules which ignore case
need no variants; a query can only be too wide by that, never too narrow.

Cases: a null or empty text has no spans; spans of a kind never overlap; equal texts give equal
spans; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import fresh, lowered, query, small_batches, table
from quarterline.llm.spans import Span, digest, ordered, without_overlap, written

#: Sets of literal strings larger than this are turned into a query at once.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Leftmost maximal runs of 32 or more are the matches of [0-9a-f]+ with 32 or more characters.
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"\b[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
KINDS = [r.kind for r in [*BASE_RULES, *MORE_RULES]]

# ---- from an expression to a Boolean trigram query --------------------------------------
# A query is None (no condition), a trigram, or ("and" | "or", frozenset of queries).


def both(a, b):
    if a is None or b is None or a == b:
        return b if a is None else a
    return ("and", frozenset([a, b]))


def either(queries: list):
    """None as soon as one alternative has no condition."""
    if not queries or any(q is None for q in queries):
        return None
    return queries[0] if len(set(queries)) == 1 else ("or", frozenset(queries))


def literal(s: str):
    """All trigrams of a literal string; None for one that is too short."""
    b = lowered(s)
    found = frozenset(b[i : i + 3] for i in range(len(b) - 2))
    return None if not found else next(iter(found)) if len(found) == 1 else ("and", found)


def strings_query(strings: set[str]):
    return either([literal(s) for s in sorted(strings)])


def trigram_query(pattern: str, flags: int = 0):
    """The Boolean query over trigrams that every text with a match satisfies."""
    parsed = re._parser.parse(pattern, flags)
    exact, condition = _walk(parsed, _folds(parsed.state.flags))
    return both(condition, strings_query(exact)) if exact is not None else condition


def _folds(flags: int) -> bool:
    """Does the expression ignore case beyond A-Z, so that one letter may match several?"""
    return bool(flags & re.IGNORECASE) and not flags & re.ASCII


def _letter(code: int, fold: bool) -> set[str] | None:
    """A character as it stands in a text with A-Z in lower case; None if others match it too.

    Where case beyond A-Z is ignored, letters outside ASCII have other forms, and i, k and s have
    some outside ASCII.
    """
    if fold and (code > 127 or chr(code) in "iIkKsS"):
        return None
    return {chr(code).lower() if code < 128 else chr(code)}


def _class(items, fold: bool) -> set[str] | None:
    """The characters of a small positive class, else None."""
    out: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            codes = [value]
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        found = [_letter(c, fold) for c in codes]
        if any(f is None for f in found):
            return None
        out.update(*found)
    return out if len(out) <= 8 else None


def _walk(items, fold: bool) -> tuple[set[str] | None, object]:
    """(all strings it matches, if few; condition that holds besides them)."""
    strings, condition, whole = {""}, None, True
    for op, value in items:
        name = str(op)
        exact, more = None, None
        if name == "LITERAL":
            exact = _letter(value, fold)
        elif name == "IN":
            exact = _class(value, fold)
        elif name == "AT":
            exact = {""}
        elif name == "SUBPATTERN":
            exact, more = _walk(value[-1], fold or _folds(value[1]))
        elif name == "BRANCH":
            parts = [_walk(x, fold) for x in value[1]]
            if all(e is not None and c is None for e, c in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                more = either([c if e is None else both(c, strings_query(e)) for e, c in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            e, c = _walk(inner, fold)
            if e is not None and c is None and high == 1:
                exact = e | ({""} if low == 0 else set())
            elif low >= 1:
                more = c if e is None else both(c, strings_query(e))
        if exact is not None and len(exact) * len(strings) <= MAX_STRINGS:
            strings = {a + b for a, b in product(strings, exact)}
            condition = both(condition, more)
        else:  # the run of known strings ends here
            condition = both(both(condition, strings_query(strings)), more)
            if exact is not None:
                condition = both(condition, strings_query(exact))
            strings, whole = {""}, False
    if whole:
        return strings, condition
    return None, both(condition, strings_query(strings))


def trigrams_of(q) -> set[bytes]:
    if q is None:
        return set()
    return {q} if isinstance(q, bytes) else set().union(*(trigrams_of(x) for x in q[1]))


# ---- one shard ---------------------------------------------------------------------------
_WANTED: dict[frozenset, np.ndarray] = {}


def _code(t: bytes) -> int:
    return t[0] | t[1] << 8 | t[2] << 16


def postings(texts: list[bytes], wanted: frozenset[bytes]) -> dict[int, np.ndarray]:
    """Trigram code to the ascending numbers of the shard's texts that contain it."""
    if wanted not in _WANTED:
        _WANTED.clear()
        mask = np.zeros(1 << 24, bool)
        mask[[_code(t) for t in wanted]] = True
        _WANTED[wanted] = mask
    mask, out = _WANTED[wanted], {}
    joined = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
    keys = []
    step = 1 << 22  # positions at a time
    for low in range(0, max(0, len(joined) - 2), step):
        part = joined[low : low + step + 2].astype(np.uint32)
        codes = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        at = np.flatnonzero(mask[codes])
        doc = np.searchsorted(starts, at + low, side="right") - 1
        keys.append(np.unique(codes[at].astype(np.int64) << 32 | doc))
    for key in np.unique(np.concatenate(keys)) if keys else ():
        out.setdefault(int(key) >> 32, []).append(int(key) & 0xFFFFFFFF)
    return {k: np.array(v) for k, v in out.items()}


def answer(q, index: dict[int, np.ndarray]) -> np.ndarray:
    """The texts of a shard that satisfy a query."""
    if isinstance(q, bytes):
        return index.get(_code(q), np.zeros(0, np.int64))
    lists = sorted((answer(x, index) for x in q[1]), key=len)
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if q[0] == "and" else np.union1d(out, x)
    return out


def scan_shard(texts: list[str], rules: list[Rule]) -> list[list[Span]]:
    """The spans of every text of a shard, by rule order."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = frozenset().union(*(trigrams_of(q) for q in queries))
    index = postings([lowered(t) for t in texts], wanted) if wanted else {}
    found: list[list[Span]] = [[] for _ in texts]
    for rule, q in zip(rules, queries):
        expression = rule.compiled()
        for i in range(len(texts)) if q is None else answer(q, index):
            for m in expression.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), m.end(), rule.kind))
    return found


_FOUND = T.StructType(
    [T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE_RULES]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def find_secrets(docs: DataFrame, text: str = "text", more: list[Rule] = MORE_RULES) -> tuple[DataFrame, str]:
    """``docs`` with one struct column (its name is returned): base counts, their digest, all spans.

    Spans of further rules are added where they overlap no base span.
    """
    small_batches(docs.sparkSession)
    base_kinds = [r.kind for r in BASE_RULES]
    kinds = [*base_kinds, *(r.kind for r in more)]

    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in scan_shard([x or "" for x in texts], [*BASE_RULES, *more]):
            base = ordered([s for s in spans if s[2] in base_kinds], kinds)
            extra = without_overlap([s for s in spans if s[2] not in base_kinds], base)
            count = [sum(s[2] == k for s in base) for k in base_kinds]
            rows.append((*count, digest(base), written(ordered([*base, *extra], kinds))))
        return pd.DataFrame(rows, columns=_FOUND.names)

    out = fresh(docs, "secrets")[0]
    return docs.withColumn(out, F.pandas_udf(find, _FOUND).asNondeterministic()(F.col(f"`{text}`"))), out


@query("op5_secret_scans")
def op5_secret_scans(spark, sf_dir):
    found, s = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"{s}.{c}").alias(c) for c in _FOUND.names])
