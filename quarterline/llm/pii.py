"""Personal data by weak supervision.

1. Candidate spans are found by broad patterns: the four base kinds, matches of their expressions
   that fail the kind's test, numbers with separators and runs of digits, written-out addresses
   ("name (at) host"), account numbers, names after a title or with a given name.
2. Labelers vote on each candidate for, against or not at all: written form, check digits, a
   gazetteer of given names and of places, words in front that announce personal data, words around that speak of
   something else (units, pages, streets), and the neighbouring characters.
3. Candidates with the same kind, votes and features are one row with a count (there are only so
   many combinations, whatever the corpus). Expectation-maximisation over these counts estimates each
   labeler's reliability, the chance that a vote of it is right, and each combination's probability.
   Base spans are known to be personal and failed base matches known not to be. They anchor the two
   classes, and no reliability falls under WORST, so that classes can't change places.
4. A logistic classifier over the features is fitted to these probabilities, every kind with equal
   weight, on combinations with a vote. It decides the spans among candidates that a labeler
   votes for.

Base spans always stay; the classifier adds spans that don't overlap them.

Cases: a null or empty text has no spans; a corpus without candidates has no model and adds none;
spans of one kind never overlap; repeated rows count as often as they occur; extra columns pass
through ``find_pii`` and ``redact`` untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import fresh, query, small_batches, table
from quarterline.llm.spans import digest, ordered, without_overlap, written

BASE_KINDS = ["email", "ip", "card", "phone"]
MORE_KINDS = ["address", "number", "account", "person"]
#: Bounds of a reliability.
WORST, BEST = 0.55, 0.99
KINDS = [*BASE_KINDS, *MORE_KINDS]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run that fails at its start fails at every later digit, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER = re.compile(r"(?<![\w.+@/-])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![\w@])")
_ADDRESS = re.compile(r"(?<![\w.])[\w.+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[\w-]{1,63}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[\w-]{2,63}){1,4}")
_ACCOUNT = re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")
_RUN = re.compile(r"(?<![\w.+@/-])[0-9]{7,19}(?![\w@])")
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Don", "Doña", "Monsieur", "Madame", "Mademoiselle"]
#: Given names that are frequent where the four languages are spoken.
GIVEN = set(
    """
    Adam Alan Alexander Alice Amanda Amy Andrea Andreas Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben
    Benjamin Bernard Brian Camille Carl Carlos Carmen Carol Caroline Catherine Charles Charlotte Chloé Christian
    Christina Christopher Clara Claire Claudia Cristina Daniel David Deborah Diego Dieter Donald Dorothy Edward Elena
    Elizabeth Emily Emma Eric Ernst Eva Fernando Francisco Frank François Franz Friedrich Fritz Gabriel George Gerhard
    Guillaume Hans Heinrich Helen Helga Henri Henry Ingrid Isabel Jacques James Jan Jane Javier Jean Jennifer Jessica
    Joan John Jonas Jorge José Joseph Juan Julia Julie Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Lena Linda
    Lisa Louis Louise Lucas Lucía Luis Lukas Manuel Marcel Margaret Maria María Marie Mark Markus Marta Martin Mary
    Matthew Maximilian Michael Michel Miguel Monika Nancy Nathalie Nicolas Olivia Pablo Patricia Paul Paula Pedro
    Peter Petra Philipp Philippe Pierre Rachel Rafael Raúl Rebecca René Richard Robert Rosa Ruth Sabine Samuel Sandra
    Sara Sarah Scott Sofia Sophie Stefan Stephen Steven Susan Susanne Teresa Thomas Ursula Víctor Werner William
    Wolfgang
    """.split()
)
_NAME = r"[A-ZÀ-Ý][a-zà-ÿ]{1,20}"
#: Last words of names that are not a person's.
PLACES = set(
    "street avenue road lane square park university college institute airport hospital museum company inc ltd corp gmbh ag straße "
    "platz allee universität rue place boulevard université calle plaza avenida universidad".split()
)
_PERSON = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?(?: {_NAME}){{1,3}}")
_TITLED = re.compile(rf"(?:{'|'.join(TITLES)})\.? ")
_CAPITALISED = re.compile(rf"(?<!\w){_NAME}(?: {_NAME})+")
_CONTEXT = re.compile(
    r"(?i)(?:phone|tel|call|fax|mobile|card|visa|ssn|social security|iban|account|e-?mail|contact|write to|"
    r"telefon|handy|konto|karte|téléphone|compte|carte|teléfono|cuenta|tarjeta|correo|signed|regards|sincerely|born|patient|"
    r"named?|name is|geboren|grüßen|signé|née?|firmado|atentamente|nacid[oa])\W{0,3}(?:\w{1,8}\W{1,3}){0,2}$"
)
_OTHER_BEFORE = re.compile(
    r"(?i)\b(?:pages?|chapter|section|version|order|invoice|article|figure|table|isbn|part|lot|serial|seite|kapitel|bestellung|"
    r"rechnung|chapitre|commande|facture|página|capítulo|pedido|factura|no|nr|id|ref)\W{0,3}$"
)
_OTHER_AFTER = re.compile(
    r"\W{0,2}(?:kg|km|cm|mm|mb|gb|usd|eur|euros?|dollars?|years?|jahre|ans|años|times|units|pages|points|"
    rf"{'|'.join(sorted(PLACES))})\b", re.I
)
_STRICT_NUMBER = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
_DATE = re.compile(r"(?:[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}|[0-9]+[./][0-9]+)")

LABELERS = ["pattern", "check", "gazetteer", "context", "other", "neighbours"]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs cost one look."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((start, floor, "email"))
        at = text.find("@", floor)
    return out


def base_matches(text: str) -> tuple[list, list]:
    """The spans of the four base kinds in a text, and the matches that fail their kind's test."""
    out, failed = emails(text), []
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        (out if ok else failed).append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19:
            (out if luhn(d) else failed).append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        ok = 9 <= len(_digits(m[0])) <= 15
        (out if ok else failed).append((m.start(), m.end(), "phone"))
    return ordered(out, BASE_KINDS), failed


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The four base kinds in a text."""
    return base_matches(text)[0]


def names(text: str) -> list[tuple[int, int, str]]:
    """Capitalised words from a given name on, at most two after it."""
    out = []
    for m in _CAPITALISED.finditer(text):
        at, parts = m.start(), m[0].split(" ")
        for i, part in enumerate(parts[:-1]):
            if part in GIVEN:
                out.append((at, at + len(" ".join(parts[i : i + 3])), "person"))
                break
            at += len(part) + 1
    return out


def more_candidates(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        out += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(text)]
    out += [(m.start(), m.end(), "number") for m in _NUMBER.finditer(text) if 7 <= len(_digits(m[0])) <= 19]
    out += [(m.start(), m.end(), "number") for m in _RUN.finditer(text)]
    out += [(m.start(), m.end(), "account") for m in _ACCOUNT.finditer(text)]
    if any(t in text for t in TITLES):
        out += [(m.start(), m.end(), "person") for m in _PERSON.finditer(text)]
    return out + names(text)


def votes_of(text: str, span: tuple[int, int, str]) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 no opinion. A base kind's own form has no vote."""
    start, end, kind = span
    s, d = text[start:end], _digits(text[start:end])
    pattern = 1 if kind == "address" else 0
    if kind == "number":
        pattern = 1 if _STRICT_NUMBER.fullmatch(s) else -1 if _DATE.fullmatch(s) or len(d) == len(s) < 12 else 0
    check = 0
    if kind == "number" and 12 <= len(d) <= 19:
        check = 1 if luhn(d) else -1
    if kind == "account":
        flat = s.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    gazetteer = 0
    if kind == "person":
        parts = s.split()
        gazetteer = -1 if parts[-1].lower() in PLACES else 1 if GIVEN & set(parts) else 0
        pattern = 1 if _TITLED.match(s) else 0
    other = -1 if _OTHER_AFTER.match(text, end, end + 20) or _OTHER_BEFORE.search(text[max(0, start - 20) : start]) else 0
    context = 1 if _CONTEXT.search(text[max(0, start - 40) : start]) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    odd = left.isalnum() or right.isalnum() or left in tuple("=#$€%") and left != "" or right in ("%", "€")
    return pattern, check, gazetteer, context, other, -1 if odd else 0


def features_of(text: str, span: tuple[int, int, str]) -> tuple[str, ...]:
    """Categories the classifier sees; each has few values."""
    start, end, kind = span
    s = text[start:end]
    n = len(_digits(s))
    seps = "".join(sorted({c for c in s if c in " -.()/"}))[:3]
    side = lambda c: "0" if not c else "w" if c.isalnum() else "s" if c.isspace() else "p"
    pattern, check, gazetteer, context, other, _ = votes_of(text, span)
    return (
        f"kind={kind}", f"{kind}:digits={min(n, 20)}", f"{kind}:seps={seps}", f"left={side(text[start - 1 : start])}",
        f"right={side(text[end : end + 1])}", f"context={context}", f"{kind}:check={check}",
        f"{kind}:strict={pattern}", f"known={gazetteer}", f"other={other}",
    )


def described(text: str | None) -> list[str]:
    """``kind|votes|features|known`` of every candidate; known is 1, 0 or -1 for not known."""
    if not text:
        return []
    base, failed = base_matches(text)
    more = without_overlap(more_candidates(text), base)
    out = []
    for known, spans in ((1, base), (0, failed), (-1, more)):
        for s in spans:
            features = " ".join(f.replace(" ", "_") for f in features_of(text, s))
            out.append(f"{s[2]}|{' '.join(map(str, votes_of(text, s)))}|{features}|{known}")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _described(texts: pd.Series) -> pd.Series:
    return pd.Series([described(x) for x in texts], dtype=object)


def estimate(votes: np.ndarray, weight: np.ndarray, kinds: np.ndarray, known: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote combinations.

    A labeler has one reliability, the chance that a vote it casts is right; a kind has its share of
    personal ones among the combinations that are voted on and not ``known`` (1, 0, or -1 for not
    known). Returns the probability of every combination and the reliabilities, which start at 0.8.
    """
    known = np.full(len(votes), -1) if known is None else known
    voted = votes != 0
    open_ = voted.any(axis=1) & (known < 0)
    right, prior, p = np.full(votes.shape[1], 0.8), np.full(kinds.max() + 1, 0.5), np.full(len(votes), 0.5)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior))[kinds] + votes @ np.log(right / (1 - right))
        p = np.where(known < 0, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), known)
        agrees = np.where(votes > 0, p[:, None], 1 - p[:, None]) * voted
        right = np.clip((weight @ agrees + 4 * 0.8) / (weight @ voted + 4), WORST, BEST)
        mass = weight * open_
        prior = np.clip((np.bincount(kinds, mass * p, len(prior)) + 1) / (np.bincount(kinds, mass, len(prior)) + 2), 0.05, 0.95)
    return p, right


def fit(rows: list[tuple[str, int]]) -> dict:
    """Reliabilities and classifier weights from ``(description, count)`` rows."""
    if not rows:
        return {"reliability": {}, "weights": {}, "bias": -10.0}
    rows = sorted(rows)
    parts = [r[0].split("|") for r in rows]
    weight = np.array([r[1] for r in rows], float)
    votes = np.array([[int(x) for x in p[1].split()] for p in parts])
    kinds = np.array([KINDS.index(p[0]) for p in parts])
    known = np.array([int(p[3]) for p in parts])
    p, right = estimate(votes, weight, kinds, known)
    used = np.flatnonzero(votes.any(axis=1) | (known >= 0))
    names_ = sorted({f for i in used for f in parts[i][2].split(" ")})
    at = {f: i for i, f in enumerate(names_)}
    x = np.zeros((len(used), len(names_) + 1))
    for i, row in enumerate(used):
        x[i, [at[f] for f in parts[row][2].split(" ")]] = 1
    x[:, -1] = 1
    p, share = p[used], weight[used]
    share = share / np.bincount(kinds[used], share, len(KINDS))[kinds[used]]
    share /= max(share.sum(), 1)
    w = np.zeros(len(names_) + 1)
    for _ in range(30):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (q - p)) + 1e-4 * w
        hess = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return {"reliability": dict(zip(LABELERS, right.tolist())), "weights": dict(zip(names_, w.tolist())), "bias": float(w[-1])}


def train(docs: DataFrame, text: str = "text") -> dict:
    """Fit over all documents; one row per combination of kind, votes and features comes back.

    Combinations are bounded by the labelers' votes and the features' few values, not by the corpus.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.explode(_described(F.col(f"`{text}`"))).alias("d"))
    return fit([(r.d, r.c) for r in found.groupBy("d").agg(F.count("*").alias("c")).collect()])


def classified(text: str, model: dict) -> tuple[list, list]:
    """Base spans, and all spans, of a text."""
    base = base_spans(text)
    weights, bias = model["weights"], model["bias"]

    def personal(s: tuple[int, int, str]) -> bool:
        if f"kind={s[2]}" not in weights or max(votes_of(text, s)) <= 0:
            return False
        return bias + sum(weights.get(f.replace(" ", "_"), 0.0) for f in features_of(text, s)) >= 0

    more = [s for s in without_overlap(more_candidates(text), base) if personal(s)]
    return base, ordered([*base, *more], KINDS)


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def find_pii(docs: DataFrame, model: dict | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column (its name is returned): counts, digest and all spans."""
    small_batches(docs.sparkSession)
    model = train(docs, text) if model is None else model

    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            base, spans = classified(x, model) if x else ([], [])
            count = dict.fromkeys(KINDS, 0)
            for s in spans:
                count[s[2]] += 1
            rows.append((*count.values(), digest(base), written(spans)))
        return pd.DataFrame(rows, columns=_FOUND.names)

    out = fresh(docs, "pii")[0]
    return docs.withColumn(out, F.pandas_udf(find, _FOUND).asNondeterministic()(F.col(f"`{text}`"))), out


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets.

    Where spans of several kinds overlap, the one that starts first (then the longest) is
    replaced and the remainder of the others with it. ``n_chars`` is counted anew.
    """
    small_batches(docs.sparkSession)
    model = train(docs) if model is None else model

    def clean(x: str | None) -> str | None:
        if not x:
            return x
        out, at = [], 0
        for start, end, kind in sorted(classified(x, model)[1], key=lambda s: (s[0], -s[1])):
            if start >= at:
                out += [x[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, x[at:]])

    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(x) for x in texts], dtype=object)

    new = fresh(docs, "masked")[0]
    done = docs.withColumn(new, F.pandas_udf(masked, T.StringType()).asNondeterministic()(F.col("text")))
    changed = {"text": F.col(new), "n_chars": F.length(new).cast("long")}
    return done.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


@query("op10_pii")
def op10_pii(spark, sf_dir):
    found, p = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"{p}.{c}").alias(c) for c in [f"n_{k}" for k in BASE_KINDS] + ["base_sha256", "spans"]])
