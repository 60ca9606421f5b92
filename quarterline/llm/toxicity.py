"""Toxicity of texts by a small convolutional network, written and trained in numpy.

Words (UTF-8, A-Z in lower case, punctuation at the ends removed) and their beginnings of PREFIXES
bytes are hashed into BUCKETS embeddings, whose sum stands for the word, so that unseen forms of a
stem are known too. Filters of several widths run over the words, each keeps its largest response over
the whole text, and a logistic layer turns the responses into a score. The score is scaled (Platt) on labelled documents
that the network did not see, and there each language gets the threshold with the best F1.

The network is fitted on the driver to a bounded sample: of the labelled documents the MAX_POSITIVE
and MAX_NEGATIVE with the smallest MD5 of their id. Every text is scored, whole, inside Spark tasks.

Cases: a null or empty text gets the score of a text without known words; a null language has the
overall threshold; labels that repeat count once (toxic if any is); without labelled documents of
both classes every score is their rate; empty tables give empty results; extra columns pass.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import fresh, kept, lowered, query, small_batches, table

BUCKETS = 1 << 17
PREFIXES = (5, 6, 7, 8, 9)
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
MAX_POSITIVE, MAX_NEGATIVE = 3000, 6000
#: Share of the sample that is kept from the network, for scaling and thresholds.
CALIBRATION = 0.25
#: Words in fewer sampled documents share the embedding of unknown words, which is fixed at zero.
MIN_DOCUMENTS = 4
#: A small sample is gone through more often than EPOCHS, up to MIN_STEPS steps.
EPOCHS, MIN_STEPS, BATCH, SEED = 6, 400, 64, 11
CUT = 0.3
_ENDS = b".,;:!?\"'()[]{}<>*#$%&|+-=/_"


class Hasher:
    """Texts to word numbers, and the embedding numbers of each word; remembers the words it has seen."""

    def __init__(self, remembered: int = 300_000):
        self.remembered = remembered
        self.clear()

    def clear(self) -> None:
        """Forget all words; number 0 is the unknown word."""
        self.seen: dict[bytes, int] = {}
        self.parts: list[tuple[int, ...]] = [(BUCKETS,) * (1 + len(PREFIXES))]
        self.shares: np.ndarray | None = None  # what a network made of the words so far

    def __call__(self, text: str | None) -> np.ndarray:
        found = lowered(text).split()
        seen, parts = self.seen, self.parts
        for w in set(found).difference(seen):
            core = w.strip(_ENDS)
            seen[w] = len(parts)
            parts.append(
                (xxhash.xxh64_intdigest(core) % BUCKETS, *[xxhash.xxh64_intdigest(core[:k], k) % BUCKETS if len(core) > k else BUCKETS for k in PREFIXES])
            )
        return np.fromiter(map(seen.__getitem__, found), np.int32, len(found))

    def embeddings(self, since: int = 0) -> np.ndarray:
        return np.array(self.parts[since:], np.int32).reshape(-1, 1 + len(PREFIXES))


@dataclass
class Network:
    """Embeddings (the last row, of no part, is zero), filters by width, and the logistic layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    shift: np.ndarray
    weight: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)
    overall: float = CUT
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def shares(self, hasher: Hasher) -> np.ndarray:
        """Every remembered word's share of the responses, by width and place in the window."""
        done = 0 if hasher.shares is None else len(hasher.shares)
        if done < len(hasher.parts):
            flat = np.concatenate([f[o] for f in self.filters for o in range(len(f))], axis=1)
            new = (self.embedding[hasher.embeddings(done)].sum(1) @ flat).astype(np.float32)
            hasher.shares = new if done == 0 else np.concatenate([hasher.shares, new])
        return hasher.shares


def laid_out(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with unknown words between them: numbers, begins, lengths (at least 1)."""
    gap = max(WIDTHS)
    sizes = np.array([max(1, len(t)) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + gap)])
    ids = np.zeros(begin[-1] + gap, np.int32)
    for t, b in zip(texts, begin):
        ids[b : b + len(t)] = t
    return ids, begin[:-1], sizes


def responses(shares: np.ndarray, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest response of every filter over every text."""
    n, out, at = len(ids) - max(WIDTHS), [], 0
    edges = np.stack([begin, begin + sizes], 1).ravel()
    words = shares[ids]
    for width in WIDTHS:
        r = words[:n, at : at + FILTERS].copy()
        for o in range(1, width):
            r += words[o : n + o, at + o * FILTERS : at + (o + 1) * FILTERS]
        at += width * FILTERS
        out.append(np.maximum.reduceat(np.concatenate([r, r[-1:]]), edges, axis=0)[::2])
    return np.concatenate(out, 1)


def raw_scores(net: Network, texts: Sequence[str | None], hasher: Hasher, words_at_once: int = 50_000) -> np.ndarray:
    """Log-odds of every text, before scaling; texts are taken together up to a number of words."""
    out, part, size = [], [], 0
    for i, text in enumerate(texts):
        part.append(hasher(text))
        size += len(part[-1])
        if size >= words_at_once or i == len(texts) - 1:
            out.append(np.maximum(responses(net.shares(hasher), *laid_out(part)) + net.shift, 0) @ net.weight + net.bias)
            part, size = [], 0
            if len(hasher.parts) > hasher.remembered:
                hasher.clear()
    return np.concatenate(out) if out else np.zeros(0)


def probabilities(net: Network, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.scale[0] * raw + net.scale[1], -30, 30)))


def fit_network(texts: list[np.ndarray], parts: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the logistic loss, classes weighted equally.

    Only the window with the largest response of a filter gets a gradient, so a step touches few
    embeddings. The first embedding dimension starts at the word's log-odds among the sampled documents.
    """
    rng = np.random.default_rng(seed)
    sets = [np.unique(parts[np.unique(t)]) for t in texts]
    sets = [s[s < BUCKETS] for s in sets]
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    in1, in0 = (np.bincount(np.concatenate([s for s, y in zip(sets, toxic) if y == c] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for c in (True, False))
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    known = in1 + in0 >= min(MIN_DOCUMENTS, max(2, n1 // 8))
    e = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    e[:-1, 0] = np.clip(odds, -1, 4) / 2
    e[:-1][~known] = 0
    e[-1] = 0
    f = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) / w for w in WIDTHS]
    for x in f:
        x[:, 0] = np.abs(x[:, 0]) + 0.3
    k = FILTERS * len(WIDTHS)
    dense = {"shift": np.full(k, -0.5, np.float32), "weight": np.full(k, 0.1, np.float32), "bias": np.full(1, -1.0, np.float32), **{f"f{i}": x for i, x in enumerate(f)}}
    moments = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in dense.items()}
    squares = np.full(BUCKETS + 1, 0.1, np.float32)
    share = np.where(toxic, 0.5 / n1, 0.5 / n0) * len(texts)
    step = 0
    for _ in range(max(epochs, -(-MIN_STEPS * BATCH // max(1, len(texts))))):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            ids, begin, sizes = laid_out([texts[i] for i in rows])
            n = len(ids) - max(WIDTHS)
            x = e[parts[ids]].sum(1)
            best = np.empty((len(rows), k), np.int64)
            top = np.empty((len(rows), k), np.float32)
            for j, w in enumerate(WIDTHS):
                r = sum(x[o : n + o] @ dense[f"f{j}"][o] for o in range(w))
                for d, (b, s) in enumerate(zip(begin, sizes)):
                    at = r[b : b + s].argmax(0)
                    best[d, j * FILTERS : (j + 1) * FILTERS] = b + at
                    top[d, j * FILTERS : (j + 1) * FILTERS] = r[b + at, np.arange(FILTERS)]
            active = np.maximum(top + dense["shift"], 0)
            p = 1 / (1 + np.exp(-np.clip(active @ dense["weight"] + dense["bias"], -30, 30)))
            g = ((p - toxic[rows]) * share[rows] / len(rows)).astype(np.float32)
            grad = {"weight": active.T @ g + 1e-4 * dense["weight"], "bias": g.sum(keepdims=True)}
            back = g[:, None] * dense["weight"] * (active > 0)
            grad["shift"] = back.sum(0)
            at_id, by = [], []
            for j, w in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                gf = np.empty_like(dense[f"f{j}"])
                for o in range(w):
                    words = best[:, cols] + o
                    gf[o] = np.einsum("df,dfk->kf", back[:, cols], x[words])
                    pull = (back[:, cols, None] * dense[f"f{j}"][o].T[None]).reshape(-1, DIM)
                    for part in parts[ids[words]].reshape(-1, parts.shape[1]).T:
                        at_id.append(part)
                        by.append(pull)
                grad[f"f{j}"] = gf + 1e-4 * dense[f"f{j}"]
            step += 1
            for name, gx in grad.items():
                m, v = moments[name]
                m += 0.1 * (gx - m)
                v += 0.001 * (gx * gx - v)
                dense[name] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            touched, where = np.unique(np.concatenate(at_id), return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, where, np.concatenate(by))
            squares[touched] += (total * total).mean(1)
            e[touched] -= 0.02 * total / np.sqrt(squares[touched])[:, None] * (np.append(known, False)[touched])[:, None]
    return Network(e, [dense[f"f{i}"] for i in range(len(WIDTHS))], dense["shift"], dense["weight"], float(dense["bias"][0]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1: halfway between two neighbouring scores."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal scores are cut together
    i = int(np.argmax(np.where(last, f1, -1)))
    low = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + low) / 2)


def calibrate(net: Network, raw: np.ndarray, toxic: np.ndarray, langs: list, weight: np.ndarray) -> None:
    """Platt scaling with the classes at their true weights, and thresholds per language."""
    y = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([(weight * (q - y) * raw).sum() + 1e-3 * (a - 1), (weight * (q - y)).sum()])
        v = weight * q * (1 - q)
        h = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -2, 2)
    net.scale = (max(a, 0.05), b)
    p = probabilities(net, raw)
    net.overall = best_threshold(p, toxic)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if toxic[own].sum() >= 5 and (~toxic[own]).sum() >= 5:
            net.thresholds[lang] = best_threshold(p[own], toxic[own])


def held_out_column(ident: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Network:
    """Fit and calibrate on the bounded sample of labelled documents that are not held out."""
    one = labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(ident).alias("of")).agg(F.max(label).alias("y"))
    one = one.where(~held_out_column("of")).join(docs.select(F.col(f"`{ident}`").alias("of")).distinct(), "of", "left_semi")
    order = F.md5(F.col("of").cast("string").cast("binary"))
    totals = {bool(r.y): r.c for r in one.groupBy(F.col("y") > 0).agg(F.count("*").alias("c")).withColumnRenamed("(y > 0)", "y").collect()}
    chosen = one.where("y > 0").orderBy(order, "of").limit(MAX_POSITIVE).unionByName(one.where("y <= 0").orderBy(order, "of").limit(MAX_NEGATIVE))
    slim = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("lang"))
    rows = slim.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "y", "lang", "t").collect()
    rows.sort(key=lambda r: (hashlib.md5(f"split{r.id}".encode()).digest(), r.t or ""))
    hasher = Hasher()
    texts = [hasher(r.t) for r in rows]
    toxic = np.array([r.y > 0 for r in rows], bool)
    if toxic.all() or not toxic.any():
        rate = float(toxic.mean()) if len(toxic) else 0.0
        zero = np.zeros((BUCKETS + 1, DIM), np.float32)
        k = FILTERS * len(WIDTHS)
        net = Network(zero, [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(k), np.zeros(k), 0.0)
        net.scale = (1.0, float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
        return net
    cut = int(len(rows) * CALIBRATION)
    if not 0 < toxic[:cut].sum() < cut or toxic[cut:].all() or not toxic[cut:].any():
        cut = 0  # too few to set any aside
    net = fit_network(texts[cut:], hasher.embeddings(), toxic[cut:])
    held = slice(0, cut) if cut else slice(0, len(rows))
    weight = np.where(toxic, totals[True] / toxic.sum(), totals[False] / (~toxic).sum())
    calibrate(net, raw_scores(net, [r.t for r in rows[held]], Hasher()), toxic[held], [r.lang for r in rows[held]], weight[held])
    return net


_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())])


def score(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang") -> tuple[DataFrame, str]:
    """``docs`` with one struct column (its name is returned).

    ``score`` depends on the text alone; ``threshold`` and ``flagged`` also on the language.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)

    def scores(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        n = model.value
        hasher = kept(("toxicity", n.name), Hasher)
        p = probabilities(n, raw_scores(n, list(texts), hasher))
        cuts = np.array([n.thresholds.get(x, n.overall) for x in langs], float)
        return pd.DataFrame({"score": p, "threshold": cuts, "flagged": p >= cuts})

    out = fresh(docs, "toxicity")[0]
    return docs.withColumn(out, F.pandas_udf(scores, _SCORED).asNondeterministic()(F.col(f"`{text}`"), F.col(f"`{lang}`"))), out


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs, table(spark, sf_dir, "labels"))
    scored, s = score(docs, net)
    return scored.select(
        "doc_id", held_out_column("doc_id").alias("held_out"), F.col(f"{s}.score").alias("score"),
        (F.col(f"{s}.score") >= CUT).cast("int").alias("predicted"), F.col(f"{s}.threshold").alias("threshold"), F.col(f"{s}.flagged").alias("flagged"),
    )
