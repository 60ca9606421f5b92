"""Language-model scores by online logistic context mixing.

A text is its tokens: words (A-Z in lower case) between ASCII white space, then one end. Its
probability is the product over tokens, each given the tokens before it in the text, from experts
that are mixed with weights refined online:

* the word's exact count in the training documents, and in those of each of the largest languages (a
  column of the training documents; a scored text has to show its language by its words);
* its spelling, byte by byte and bit by bit, up to a closing space. Several predictors look up a
  hashed context (the ORDERS bytes before it in the word and the bits of the byte so far) for how
  often a 0 and a 1 followed; their log-odds are added with weights that a gate selects (place in the
  byte and in the word), learned online; an adaptive map refines the sum by the byte's bits so far;
* the text itself so far: how often the word has occurred in it;
* the order of words: a word's code, CODE bits of its hash, bit by bit. Predictors look up the bits so
  far alone and with hashed contexts of the one and the two words before, which reach over any word
  of the text; their log-odds are added with weights that a gate selects (place in the code, how often
  the contexts were seen). Words of one code share its probability as the experts above say. How much
  of this and how much of the experts alone is taken is refined in each text.

Everything is learned from the training documents. Words and their counts are exact and grow with
the corpus. The spelling predictors count every distinct training word once, in hash tables of a
fixed size, summed over all partitions; their mixing weights are trained online on every distinct
word, with the word's own counts taken out, in each partition, and averaged. The word predictors
count every training token; their weights come from one Newton step over every training token, with
its own counts taken out. Both steps are sums, so that they don't depend on the splits of the read.
The tables of the word predictors have a fixed size: in a large corpus contexts share their slots.

The rows of a Spark partition form chunks of CHUNK_ROWS documents. The HEAD_WORDS words that most chunks
have are sent to the tasks with their counts and spelling probabilities. Each chunk asks for its
other words once, gets the same by a join, and is scored in one task together with its texts. Chunks must be the same in two reads of ``docs``: files read by Spark are, anything else is
written to the shared folder first. A word that the join didn't bring raises an error.

Cases: a null or empty text is one end; an id that is null counts as an empty id text; repeated rows
count as often as they occur; without training documents only the spelling and the text speak;
an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.llm.common import lowered, query, shared_path, small_batches, table
from quarterline.llm.ngram_join import word_hashes

END = b"\n"
CHUNK_ROWS = 1024
#: Words that are sent to the tasks; the rest is joined.
HEAD_WORDS = 1 << 17
ORDERS = (1, 2, 3, 5)
BITS = 19
SLOTS = 1 << BITS
BLOCK = 1 << 16
GATES = 64
BUCKETS = 24
DELTA = 0.4
RATE = 0.02
#: Languages with counts of their own; the last stands for all others.
GROUPS = 8
#: Start weights of the whole count and of the text's own words; spelling starts at the share of
#: words seen once (Good-Turing), the languages at their shares. The start counts for PRIOR_TOKENS.
WHOLE, REPEATED, PRIOR_TOKENS, STEP = 0.05, 0.03, 5.0, 16
#: Bits of a word's code, slots of each word order, start share of the word predictors in a text.
CODE, WORD_BITS, ORDERED = 10, 20, 0.5
#: The code's halves are predicted from a block of slots each, one for every leaf.
HALF = CODE // 2
LEAVES = 1 << HALF
#: Start weights of the code alone and of the orders; gates are by place in the code and by how often both contexts were seen.
WORD_START = (0.8, 0.2, 0.2)
WORD_GATES = CODE * 16
#: Tokens whose codes are scored at a time, in whole texts.
CODE_TOKENS = 1 << 14
_END_HASH = np.uint64(0xA0761D6478BD642F)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def tokens(text: str | None) -> list[bytes]:
    return [*lowered(text).split(), END]


# ---- the spelling model ------------------------------------------------------------------
class Spelled:
    """The bytes of many words, each closed by a space, with every order's context hash."""

    def __init__(self, words: list[bytes]):
        joined = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.byte = joined.astype(np.int64)
        self.place = np.arange(len(joined)) - np.repeat(self.starts, sizes)
        self.contexts, h = [], np.zeros(len(joined), np.uint64)
        for back in range(1, max(ORDERS) + 1):
            before = np.zeros(len(joined), np.uint64)
            before[back:] = joined[:-back] if back < len(joined) + 1 else 0
            before = np.where(self.place >= back, before + np.uint64(1), np.uint64(0))
            h = (h ^ before) * _M1 + np.uint64(back)
            if back in ORDERS:
                x = (h ^ (h >> np.uint64(29))) * _M2
                self.contexts.append(x ^ (x >> np.uint64(32)))

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each of the eight bits of all bytes: node, gate, the bit, and a slot per predictor."""
        for d in range(8):
            node = (1 << d) | (self.byte >> (8 - d))
            gate = d * 8 + np.minimum(self.place, 7)
            n = node.astype(np.uint64) * _M3
            slots = [(((c ^ n) * _M2) >> np.uint64(64 - BITS)).astype(np.int64) for c in self.contexts]
            yield node, gate, (self.byte >> (7 - d)) & 1, slots

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts) if len(self.starts) else np.zeros(0)


def bit_counts(words: list[bytes]) -> np.ndarray:
    """(predictor, slot, bit) counts of the words, each once."""
    out = np.zeros((len(ORDERS), SLOTS, 2), np.int64)
    add_counts(out, words)
    return out


def add_counts(out: np.ndarray, words: list[bytes]) -> None:
    """Add the words' (predictor, slot, bit) counts, each word once."""
    for _, _, bit, slots in Spelled(words).bits():
        for i, s in enumerate(slots):
            np.add.at(out[i].reshape(-1), s * 2 + bit, 1)


def odds_without(counts: np.ndarray, slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """(predictor, byte) log-odds for training: the word's own bit is not counted."""
    out = np.empty((len(ORDERS), len(bit)), np.float32)
    for i, s in enumerate(slots):
        flat = counts[i].reshape(-1)
        own, other = flat[s * 2 + bit].astype(np.float32), flat[s * 2 + 1 - bit].astype(np.float32)
        out[i] = np.log((np.maximum(own - 1, 0) + DELTA) / (other + DELTA))
    return out * np.where(bit == 1, 1, -1).astype(np.float32)


def odds_table(counts: np.ndarray) -> np.ndarray:
    """(predictor, slot) log-odds with everything counted."""
    n = counts.astype(np.float32) + np.float32(DELTA)
    return np.log(n[:, :, 1] / n[:, :, 0])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(((x + 12) * (BUCKETS / 24)).astype(np.int64), 0, BUCKETS - 1)


def start_weights() -> np.ndarray:
    return np.full((GATES, len(ORDERS)), 0.3, np.float32)


def learn(counts: np.ndarray, words: list[bytes], weights: np.ndarray, seen: np.ndarray) -> None:
    """One online step over known words: updates ``weights`` and the map's sums ``seen`` in place."""
    spelled = Spelled(words)
    for node, gate, bit, slots in spelled.bits():
        x = odds_without(counts, slots, bit)
        mix = np.clip(np.einsum("ik,ki->k", x, weights[gate]), -12, 12)
        error = bit - _squash(mix)
        n = np.bincount(gate, minlength=GATES)
        for i in range(len(ORDERS)):
            weights[:, i] += RATE * np.bincount(gate, error * x[i], GATES) / np.sqrt(np.maximum(n, 1))
        cell = node * BUCKETS + _bucket(mix)
        seen[:, 0] += np.bincount(cell, minlength=len(seen))
        seen[:, 1] += np.bincount(cell, bit, len(seen))


def spelling_scores(model: dict, words: list[bytes]) -> np.ndarray:
    """log10 probability of every word's spelling; those of all words sum to one."""
    spelled = Spelled(words)
    total = np.zeros(len(spelled.byte))
    for node, gate, bit, slots in spelled.bits():
        x = np.stack([t[s] for t, s in zip(model["odds"], slots)])
        mix = np.clip(np.einsum("ik,ki->k", x, model["weights"][gate]), -12, 12)
        p = _squash(mix)
        refined = model["map"][node * BUCKETS + _bucket(mix)]
        p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return spelled.per_word(total)


# ---- the order of words -------------------------------------------------------------------
def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per token; the end has one of its own."""
    out = np.full(len(words), _END_HASH)
    real = [i for i, w in enumerate(words) if w != END]
    out[real] = word_hashes(np.frombuffer(b" ".join([*(words[i] for i in real), b""]), np.uint8))[0]
    return out


def codes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CODE)).astype(np.int64)


def sequences(texts, bytes_at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of whole texts, one after another, and each token's place in its text."""
    part, size = [], 0

    def done():
        hashes, start = word_hashes(np.frombuffer(b" ".join([*part, b""]), np.uint8))
        cuts = np.searchsorted(start, np.cumsum([len(x) + 1 for x in part]))
        sizes = np.diff(cuts, prepend=0) + 1
        first = np.cumsum(sizes) - sizes
        return np.insert(hashes, cuts, _END_HASH), np.arange(sizes.sum()) - np.repeat(first, sizes)

    for x in texts:
        part.append(lowered(x))
        size += len(part[-1])
        if size >= bytes_at_once:
            yield done()
            part, size = [], 0
    if part:
        yield done()


def contexts_of(hashes: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one and the two words before each token. Contexts end at the text's start."""
    out, c = [], np.zeros(len(hashes), np.uint64)
    for back in (1, 2):
        before = np.zeros(len(hashes), np.uint64)
        before[back:] = hashes[:-back]
        c = (c ^ np.where(place >= back, before, np.uint64(back))) * _M1 + np.uint64(back)
        out.append(c ^ (c >> np.uint64(29)))
    return out


def halves(code: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """The code in two halves: bits before it, its value, and the first slot of a block of LEAVES for each order."""
    for before, shift in ((0, HALF), (HALF, 0)):
        known = ((code >> (CODE - before)) + (before << CODE)).astype(np.uint64) * _M3
        starts = [((((c ^ known) * _M2) >> np.uint64(64 - WORD_BITS + HALF)) << np.uint64(HALF)).astype(np.int64) for c in contexts]
        yield before, (code >> shift) & (LEAVES - 1), starts


def word_bits(hashes: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each bit of all tokens' codes: its place, node, the bit, and a slot per order."""
    code = codes_of(hashes)
    for before, value, starts in halves(code, contexts_of(hashes, place)):
        for d in range(HALF):
            at = (1 << d) | (value >> (HALF - d))
            yield before + d, (1 << before + d) | (code >> (CODE - before - d)), (value >> (HALF - 1 - d)) & 1, [s | at for s in starts]


def add_word_counts(out: np.ndarray, hashes: np.ndarray, place: np.ndarray) -> None:
    """Add the (order, leaf) counts of all tokens."""
    for _, value, starts in halves(codes_of(hashes), contexts_of(hashes, place)):
        for i, s in enumerate(starts):
            np.add.at(out[i], s | value, 1)


def node_counts(leaves: np.ndarray, bits: int) -> np.ndarray:
    """(node, bit) counts, from those of blocks of 2 ** bits leaves; node 0 of each block is empty."""
    level = leaves.reshape(-1, 1 << bits).astype(np.int64)
    out = np.zeros((len(level), 1 << bits, 2), np.int64)
    for d in range(bits - 1, -1, -1):
        pairs = level.reshape(len(level), -1, 2)
        out[:, 1 << d : 2 << d] = pairs
        level = pairs.sum(2)
    return out.reshape(-1, 2)


def _seen(n: np.ndarray) -> np.ndarray:
    """0 to 3: never, 1 to 3, 4 to 31 times, more often."""
    return (n > 0).astype(np.uint8) + (n > 3) + (n > 31)


def packed_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds in 512ths, four times, plus how often a slot was seen, in 16 bits."""
    odds = np.clip(np.log((counts[..., 1] + DELTA) / (counts[..., 0] + DELTA)), -12, 12)
    return (np.round(odds * 512).astype(np.int16) << 2) + _seen(counts.sum(-1)).astype(np.int16)


def odds_but_one(counts: np.ndarray) -> np.ndarray:
    """(order, 2 * slot + bit) packed odds when one such bit is not counted."""
    return np.stack([packed_odds(np.maximum(counts - own, 0)) for own in ([1, 0], [0, 1])], -1).reshape(*counts.shape[:-2], -1)


def word_inputs(nodes: np.ndarray, packed: np.ndarray, node: np.ndarray, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(predictor, token) log-odds and the gate within a place of the code."""
    x = np.empty((3, len(node)), np.float32)
    nodes.take(node, out=x[0], mode="clip")
    one, two = packed[0].take(at[0]), packed[1].take(at[1])
    np.multiply(one >> 2, np.float32(1 / 512), out=x[1])
    np.multiply(two >> 2, np.float32(1 / 512), out=x[2])
    return x, ((one & 3) << 2 | (two & 3)).astype(np.uint8)


def newton_sums(nodes: np.ndarray, packed: np.ndarray, hashes: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
    """Add the tokens' slopes and curvatures at the start weights to ``out[gate, 3 + 9]``; ``packed`` leaves out their own bits."""
    start = np.array(WORD_START, np.float32)
    for d, node, bit, slots in word_bits(hashes, place):
        x, gate = word_inputs(nodes, packed, node, [2 * s + bit for s in slots])
        by = np.argsort(gate, kind="stable")
        x, bit = x.take(by, 1), bit.take(by)
        p = 1 / (1 + np.exp(-np.clip(start @ x, -12, 12)))
        slope, bent = bit - p, x * (p * (1 - p))
        cuts = np.searchsorted(gate.take(by), np.arange(17))
        for g in range(16):
            low, high = cuts[g], cuts[g + 1]
            if low < high:
                out[d * 16 + g, :3] += x[:, low:high] @ slope[low:high]
                out[d * 16 + g, 3:] += (bent[:, low:high] @ x[:, low:high].T).ravel()


def newton_step(sums: np.ndarray) -> np.ndarray:
    """The gates' weights: one step from the start, held back by as much as ten tokens of curvature 1."""
    slope, bend = sums[:, :3], sums[:, 3:].reshape(-1, 3, 3) + 10 * np.eye(3)
    return np.clip(np.array(WORD_START) + np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -2, 2)


def code_scores(model: dict, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Probability of every token's code after the words before it; those of all codes sum to one."""
    total = np.ones(len(hashes))
    weights = np.ascontiguousarray(model["weights"].T, np.float32).reshape(3, CODE, 16)
    for d, node, bit, slots in word_bits(hashes, place):
        x, gate = word_inputs(model["nodes"], model["odds"], node, slots)
        gate = gate.astype(np.intp)
        for i in range(3):
            x[i] *= weights[i, d].take(gate)
        mix = np.clip(x[0] + x[1] + x[2], -12, 12)
        total *= 1 + np.exp(np.where(bit, -mix, mix))
    return 1 / total


# ---- one text ----------------------------------------------------------------------------
def earlier(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Share of a text's tokens so far that have the token's key; keys are apart between texts."""
    by = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[by][1:] != key[by][:-1]])
    run = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    own = np.empty(len(by))
    own[by] = run
    return own / np.maximum(place, 1)


def text_scores(ids: list[np.ndarray], experts: np.ndarray, prior: np.ndarray, hashes: np.ndarray | None = None, order: dict | None = None) -> np.ndarray:
    """log10 probability of each text, from its word numbers and ``experts[word, expert]``.

    With the words' ``hashes`` and the model ``order``, a word's probability is also taken as that of its
    code after the words before, times its part of the code by the experts.

    The last expert is the text so far. Texts go on side by side, first one token at a time, later up
    to STEP. After each step the weights are the mean of the experts' shares in all tokens so far and
    of the start weights ``prior``.
    """
    sizes = np.array([len(x) for x in ids], np.int64)
    out = np.zeros(len(ids))
    if not len(ids):
        return out
    longest = np.argsort(-sizes, kind="stable")
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate(ids)
    place = np.arange(len(flat)) - np.repeat(begin, sizes)
    text = np.repeat(np.arange(len(ids)), sizes)
    own = earlier(text * (len(experts) + 1) + flat, place)
    if order is not None:
        code = codes_of(hashes)[flat]
        after = np.empty(len(flat))
        low = 0
        for high in [*begin[1:][np.diff(begin[1:] // CODE_TOKENS, prepend=0) > 0], len(flat)]:
            after[low:high] = code_scores(order, hashes[flat[low:high]], place[low:high])
            low = high
        own_code, masses = earlier((text << CODE) + code, place), order["masses"]
        ordered = np.full(len(ids), ORDERED * PRIOR_TOKENS)
    shares = np.tile(prior * PRIOR_TOKENS, (len(ids), 1))
    alive, low, step = len(ids), 0, 1
    while low < sizes.max():
        while alive and sizes[longest[alive - 1]] <= low:
            alive -= 1
        rows = longest[:alive]
        at = begin[rows][:, None] + low + np.arange(step)
        real = low + np.arange(step) < sizes[rows][:, None]
        at = np.where(real, at, 0)
        weights = shares[rows] / (PRIOR_TOKENS + low)
        q = np.concatenate([experts[flat[at]], own[at][:, :, None]], 2) * weights[:, None, :]
        whole = q.sum(2)
        if order is not None:
            of_code = (masses[code[at]] @ weights[:, :-1, None])[:, :, 0] + own_code[at] * weights[:, -1:]
            gain = after[at] / np.maximum(of_code, 1e-300)
            part = (ordered[rows] / (PRIOR_TOKENS + low))[:, None]
            both = 1 - part + part * gain
            out[rows] += (np.log10(both) * real).sum(1)
            ordered[rows] += (part * gain / both * real).sum(1)
        out[rows] += (np.log10(np.maximum(whole, 1e-300)) * real).sum(1)
        shares[rows] += np.einsum("tse,ts->te", q, real / np.maximum(whole, 1e-300))
        low += step
        step = min(STEP, 2 * step) if low >= 8 else 1
    return out


# ---- Spark -------------------------------------------------------------------------------
def held_out_column(ident: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk its distinct words, once with ``ask``, with their training counts by group."""
    chunk, seen, learned = None, set(), {}

    def out():
        rows = [(w, g, c) for g, counts in learned.items() for w, c in counts.items()]
        asked, ask = set(), []
        for w, _, _ in rows:
            ask.append(w not in asked)
            asked.add(w)
        rest = list(seen - asked)
        words, groups, counts = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({
            "chunk": chunk, "word": [*words, *rest], "g": [*groups, *[0] * len(rest)], "c": [*counts, *[0] * len(rest)], "ask": ask + [True] * len(rest),
        })

    for rows in batches:
        for c, text, held, group in zip(rows["chunk"], rows["text"], rows["held_out"], rows["g"]):
            if c != chunk:
                if seen or learned:
                    yield out()
                chunk, seen, learned = c, set(), {}
            if held:
                seen.update(tokens(text))
            else:
                learned.setdefault(int(group), Counter()).update(tokens(text))
    if seen or learned:
        yield out()


def _batches(batches: Iterator[pd.DataFrame], rows: int = 4096) -> Iterator[pd.DataFrame]:
    for b in batches:
        for low in range(0, len(b), rows):
            yield b.iloc[low : low + rows]


def _summed(parts: DataFrame, fan_in: int = 64) -> DataFrame:
    """Sums of zlib-packed int64 blocks by block number, in two rounds."""

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in rows["c"]:
            total = total + np.frombuffer(zlib.decompress(x), "<i8")
        return pd.DataFrame({"b": [int(rows["b"].iloc[0])], "c": [zlib.compress(total.tobytes(), 1)]})

    parts = parts.withColumn("g", F.floor(F.spark_partition_id() / fan_in))
    return parts.groupBy("b", "g").applyInPandas(add, "b int, c binary").groupBy("b").applyInPandas(add, "b int, c binary")


def spelling_model(words: DataFrame) -> dict:
    """Fit the spelling predictors on the known words of ``word, c``.

    Every known word is counted, and trains the weights and the map once with its own bits taken out,
    so a corpus of copies trains them as well. To the driver come tables of a fixed size: the predictors' counts, the gates' weights, the map.
    """
    spark = words.sparkSession
    known = words.where("c > 0").select("word")
    per = 2 * SLOTS // BLOCK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(ORDERS), SLOTS, 2), np.int64)
        for b in _batches(batches):
            add_counts(total, [bytes(w) for w in b["word"]])
        flat = total.reshape(-1, BLOCK)
        yield pd.DataFrame({"b": range(len(flat)), "c": [zlib.compress(x.astype("<i8").tobytes(), 1) for x in flat]})

    counts = np.zeros((len(ORDERS) * per, BLOCK), np.int64)
    for r in _summed(known.mapInPandas(count, "b int, c binary")).toLocalIterator():
        counts[r.b] = np.frombuffer(zlib.decompress(bytes(r.c)), "<i8")
    counts = counts.reshape(len(ORDERS), SLOTS, 2)
    sent = spark.sparkContext.broadcast(counts)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, seen, n = start_weights(), np.zeros((256 * BUCKETS, 2)), 0
        for b in _batches(batches, 2048):
            learn(sent.value, [bytes(w) for w in b["word"]], weights, seen)
            n += len(b)
        cells = np.flatnonzero(seen[:, 0])
        at = np.concatenate([np.arange(weights.size), weights.size + cells])
        yield pd.DataFrame({"i": at, "a": np.concatenate([weights.ravel() * n, seen[cells, 1]]), "b": np.concatenate([np.full(weights.size, n), seen[cells, 0]])})

    weights, refined = start_weights().ravel(), np.repeat(_squash((np.arange(BUCKETS) + 0.5) * 24 / BUCKETS - 12)[None], 256, 0).ravel()
    trained = known.mapInPandas(train, "i long, a double, b double").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    for r in trained.where("b > 0").collect():
        if r.i < weights.size:
            weights[r.i] = r.a / r.b
        else:
            k = r.i - weights.size
            refined[k] = (r.a + 4 * refined[k]) / (r.b + 4)
    odds = spark.sparkContext.broadcast(odds_table(counts))
    return {"odds": odds, "weights": weights.reshape(GATES, -1), "map": refined}


def word_order_model(texts: DataFrame, by_code: np.ndarray) -> dict:
    """Fit the word predictors on all tokens of the training texts ``text``.

    ``by_code`` counts the training tokens of each code. To the driver come tables of a fixed size.
    """
    spark = texts.sparkSession
    per = (1 << WORD_BITS) // BLOCK
    nodes = node_counts(by_code, CODE)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << WORD_BITS), np.int64)
        for b in batches:
            for hashes, place in sequences(b["text"]):
                add_word_counts(total, hashes, place)
        flat = total.reshape(-1, BLOCK)
        yield pd.DataFrame({"b": range(len(flat)), "c": [zlib.compress(x.astype("<i8").tobytes(), 1) for x in flat]})

    counts = np.zeros((2 * per, BLOCK), np.int64)
    for r in _summed(texts.mapInPandas(count, "b int, c binary")).toLocalIterator():
        counts[r.b] = np.frombuffer(zlib.decompress(bytes(r.c)), "<i8")
    counts = np.stack([node_counts(x, HALF) for x in counts.reshape(2, -1)])
    alone = np.log((nodes[:, 1] + DELTA) / (nodes[:, 0] + DELTA)).astype(np.float32)
    sent = spark.sparkContext.broadcast((alone, odds_but_one(counts)))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((WORD_GATES, 12))
        for b in batches:
            for hashes, place in sequences(b["text"]):
                newton_sums(*sent.value, hashes, place, sums)
        yield pd.DataFrame({"i": range(sums.size), "a": sums.ravel()})

    sums = np.zeros(WORD_GATES * 12)
    for r in texts.mapInPandas(train, "i long, a double").groupBy("i").agg(F.sum("a").alias("a")).collect():
        sums[r.i] = r.a
    return {"nodes": alone, "odds": packed_odds(counts), "weights": newton_step(sums.reshape(WORD_GATES, 12))}


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str | None = "lang", held_out=None, from_files: bool = False) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``held_out`` is a column (default: crc32 of the id's text is divisible by 10); the model learns
    from the other documents. ``from_files`` says that ``docs`` is a plain read
    of Parquet files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    group = F.lit(0)
    held = F.coalesce(held_out_column(ident) if held_out is None else held_out, F.lit(False))
    if lang:
        named = F.coalesce(F.col(f"`{lang}`"), F.lit(""))
        top = docs.where(~held).groupBy(named.alias("l")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "l").limit(GROUPS - 1).collect()
        group = F.lit(GROUPS - 1)
        for i, r in enumerate(top):
            group = F.when(named == r.l, i).otherwise(group)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if from_files else []
    slim = docs.select(F.col(f"`{ident}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"), group.alias("g"), held.alias("held_out"), *place)
    if not from_files:
        copy_at = shared_path(spark, "lm-texts")
        slim.write.parquet(copy_at)
        slim = spark.read.parquet(copy_at).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # By place in the file, so that a read with other splits finds the same chunks.
    slim = slim.withColumn("chunk", F.xxhash64("file", F.floor(F.col("row") / CHUNK_ROWS))).drop("file", "row")

    rows_at, words_at = shared_path(spark, "lm-chunks"), shared_path(spark, "lm-words")
    read = slim.select("chunk", "text", "held_out", "g")
    read.mapInPandas(_counted, "chunk long, word binary, g int, c long, ask boolean").write.parquet(rows_at)
    rows = spark.read.parquet(rows_at)
    by_group = [F.coalesce(F.sum(F.when(F.col("g") == i, F.col("c"))), F.lit(0)).alias(f"c{i}") for i in range(GROUPS)]
    rows.groupBy("word").agg(F.sum("c").alias("c"), F.count_if("ask").alias("asks"), *by_group).write.parquet(words_at)
    words = spark.read.parquet(words_at)
    sums = [F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(GROUPS)]
    v, once, *sizes = words.agg(F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1)), *sums).first()
    n = sum(sizes)
    model = spelling_model(words.select("word", "c"))
    unseen = (once + 1) / (n + 2)
    prior = np.array([WHOLE, *[(1 - WHOLE) * x / max(n, 1) for x in sizes]]) * (1 - unseen - REPEATED * (1 - unseen))
    prior = np.concatenate([prior, [unseen, REPEATED * (1 - unseen)]])

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = {**model, "odds": model["odds"].value}
        for b in _batches(batches):
            found = [bytes(w) for w in b["word"]]
            yield b.assign(spelled=spelling_scores(local, found))

    names = [f"c{i}" for i in range(GROUPS)]

    def spelled(some: DataFrame) -> DataFrame:
        slim = some.select("word", *[F.least(F.col(c), F.lit(2**31 - 1)).cast("int").alias(c) for c in names])
        return slim.mapInPandas(spell, "word binary, " + "".join(f"{c} int, " for c in names) + "spelled double")

    head_at = shared_path(spark, "lm-head")
    words.orderBy(F.desc("asks"), "word").limit(HEAD_WORDS).drop("asks", "c").write.parquet(head_at)
    often = spark.read.parquet(head_at)
    got = spelled(often).toArrow()
    values = np.column_stack([got[c].to_numpy() for c in [*names, "spelled"]]).astype(np.float64)
    head_words = got["word"].to_pylist()
    head = spark.sparkContext.broadcast(({w: i for i, w in enumerate(head_words)}, values))

    rare = lambda x: x.join(F.broadcast(often.select("word")), "word", "left_anti")
    rare_at = shared_path(spark, "lm-rare")
    spelled(rare(words)).write.parquet(rare_at)
    rare_words = spark.read.parquet(rare_at)

    def by_code(found: list[bytes], values: np.ndarray) -> np.ndarray:
        """(code, expert) sums of the known words' counts and spelling probabilities."""
        known = values[:, :-1].sum(1) > 0
        code, parts = codes_of(hashes_of(found)), np.column_stack([values[:, :-1], 10.0 ** values[:, -1] * known])
        return np.column_stack([np.bincount(code, x, 1 << CODE) for x in parts.T]).astype(np.float64)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((by_code([bytes(w) for w in b["word"]], b[[*names, "spelled"]].to_numpy(np.float64)) for b in _batches(batches)), np.zeros((1 << CODE, GROUPS + 1)))
        yield pd.DataFrame({"code": range(1 << CODE), **dict(zip([*names, "spelled"], total.T))})

    codes = by_code(head_words, values)
    parts = rare_words.mapInPandas(coded, "code int, " + ", ".join(f"{c} double" for c in [*names, "spelled"]))
    for r in parts.groupBy("code").agg(*[F.sum(c) for c in [*names, "spelled"]]).collect():
        codes[r[0]] += r[1:]
    # The spelling's part of a code: known words one by one, all others in equal parts.
    spelled_codes = codes[:, -1] + max(1e-9, 1 - codes[:, -1].sum()) / (1 << CODE)
    code_counts = codes[:, :-1]
    fitted = word_order_model(slim.where(~F.col("held_out")).select("text"), code_counts.sum(1))
    masses = np.column_stack([code_counts.sum(1) / max(n, 1), code_counts / np.maximum(sizes, 1), spelled_codes])
    order = spark.sparkContext.broadcast({**fitted, "masses": masses})
    asked = rare(rows.where("ask").select("chunk", "word")).join(rare_words, "word").select("chunk", "word", *names, "spelled")

    def score_chunk(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        all_tokens = [tokens(t) for t in texts["text"]]
        distinct = list(set().union(*all_tokens))
        number = dict(zip(distinct, range(len(distinct))))
        in_head, head_values = head.value
        at = np.fromiter((in_head.get(w, -1) for w in distinct), np.int64, len(distinct))
        joined = {bytes(w): i for i, w in enumerate(found["word"])}
        values = np.empty((len(distinct), GROUPS + 1))
        values[at >= 0] = head_values[at[at >= 0]]
        others = np.flatnonzero(at < 0)
        values[others] = found[[*names, "spelled"]].to_numpy(np.float64)[[joined[distinct[i]] for i in others]]
        counts = values[:, :-1]
        c = counts.sum(1)
        experts = np.column_stack([c / max(n, 1), counts / np.maximum(sizes, 1), 10.0 ** values[:, -1]])
        ids = [np.fromiter((number[w] for w in t), np.int64, len(t)) for t in all_tokens]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        scores = text_scores(ids, experts, prior, hashes_of(distinct), order.value)
        size = [sum(map(len, t)) + len(t) for t in all_tokens]
        return pd.DataFrame({
            "id": texts["id"], "held_out": texts["held_out"], "n_tokens": [len(i) for i in ids],
            "n_known": [int((c[i] > 0).sum()) for i in ids], "train_tokens": n, "base_score": [float(base[i].sum()) for i in ids],
            "score": scores, "bits_per_byte": -scores * np.log2(10) / np.maximum(size, 1),
        })

    out = slim.select("id", "text", "held_out", "chunk").groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(
        score_chunk, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )
    kind = docs.schema[ident].dataType
    return out.select(F.col("id").cast(kind).alias(ident), *out.columns[1:])


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), from_files=True)
