"""Benchmark passages in documents, up to a bounded edit distance.

The CGK embedding walks over a sequence and writes one symbol per step; a hash of step and symbol
decides whether the walk moves on. Walks that share their random bits fall in step again after an
edit, so sequences at a small edit distance get embeddings at a small Hamming distance. Here the
symbols are lower-case words.

1. Items are sorted into window sizes (about two thirds of an item). An item's walks start at every
   offset that leaves a whole window; a document's walks start every half window. An occurrence of
   the item thus contains at least one document window whose start is one of the item's offsets.
2. Bit sampling: a repetition reads SAMPLED random places of the embedding, together a key; a walk
   is read by READS repetitions. ``repetitions`` gives how many reach the target recall in that one
   window with the share of its words edited that the distance bound allows of the characters.
3. Keys of items go into a Bloom filter of fixed size, which is sent to the tasks; document windows
   that pass it are joined with the items on the key, so any number of items works. A few items
   (counted) are sent to the tasks, and no window is shuffled.
4. Each candidate (document, item, place) is verified by the exact edit distance between the item
   and the best-fitting stretch of the text around the window.

Texts are compared as lower-case words (A-Z) with single spaces. A document has an item if the
distance is at most MAX_DISTANCE of the item's length.

Cases: null or empty texts and items have no words and match nothing; repeated documents or items
give one pair per id pair; ``decontaminate`` decides by text, so rows without an id work; empty
tables give empty results; extra columns pass through.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import fixed, fresh, lowered, query, small_batches, table
from quarterline.llm.ngram_join import mixed

#: Edit distance in characters that still counts as the item, as a share of its length.
MAX_DISTANCE = 0.2
#: The recall that the repetitions are chosen for.
RECALL = 0.95
SAMPLED = 5
#: Repetitions that read the same walk.
READS = 4
SEED = 29
FILTER_BITS = 1 << 24
FILTER_HASHES = 4
FILTER_BLOCKS = 64
#: Words that are walked together.
PIECE = 1 << 18
#: Candidates are verified together up to so many characters, and with masks of so many cells.
VERIFIED = 1 << 22
MASK_CELLS = 1 << 21
#: Item keys, and characters beside them, up to which they are sent to the tasks.
SENT_KEYS, SENT_CHARS = 500_000, 1 << 25


def window_sizes(up_to: int) -> list[int]:
    """1, 2, 3, 4, 6, 9, 13, ... words: each about half as large again as the one before."""
    out = [1, 2, 3]
    while out[-1] * 3 // 2 + 1 <= up_to:
        out.append(out[-1] + max(1, out[-1] // 2))
    return [w for w in out if w <= up_to]


def stride(size: int) -> int:
    return max(1, size // 2)


def window_size(n_words: int) -> int:
    """The largest size of which an item holds windows at a whole stride of offsets."""
    return max(w for w in window_sizes(max(1, n_words)) if w == 1 or w + stride(w) - 1 <= n_words)


def steps(size: int) -> int:
    """Length of the embedding: such walks move on three quarters of a window on average."""
    return max(1, size * 3 // 2)


def repetitions(size: int, recall: float = RECALL, edited: float = MAX_DISTANCE) -> int:
    """Repetitions needed for the recall.

    An edit separates two walks for about three steps. With e edits in the walked stretch, d = 3 e
    of the places differ, and a repetition misses all of them with (1 - d / steps) ** sampled. An
    occurrence is sure of one window only. Half as many again make up for walks that are shared and
    for edits that crowd in the window.
    """
    t = steps(size)
    differing = min(0.9 * t, 3 * edited * 0.75 * size)
    hit = min(0.99, (1 - differing / t) ** min(SAMPLED, t))
    return max(2, math.ceil(1.5 * math.log(1 - recall) / math.log(1 - hit)))


@lru_cache(None)
def sampled_places(size: int, repetition: int) -> list[int]:
    rng = random.Random(f"{SEED}:{size}:{repetition}")
    return sorted(rng.sample(range(steps(size)), min(SAMPLED, steps(size))))


@lru_cache(None)
def _odd(place: int) -> np.uint64:
    """The multiplier of the symbol at a place."""
    return mixed(np.array([place], np.uint64), SEED)[0] | np.uint64(1)


def walk_bits(symbols: np.ndarray, walk: int, step: int) -> np.ndarray:
    """Per symbol whether the walk moves on from it, for 64 steps from ``step``."""
    return mixed(symbols, 7919 * (walk + 1) + step)


def walk_keys(symbols: np.ndarray, starts: np.ndarray, size: int, walk: int, reads: Iterable[int], bits: np.ndarray) -> list[np.ndarray]:
    """The sampled keys of one walk from each start, for each repetition of ``reads``.

    ``symbols`` reach as far as the walks can go, and ``bits`` are those of the first 64 steps.
    """
    at = starts.astype(np.int64)
    places = [sampled_places(size, r) for r in reads]
    keys = [np.full(len(at), mixed(np.array([size * 1009 + r], np.uint64))[0], np.uint64) for r in reads]
    last = max(p[-1] for p in places)
    moves = np.empty(len(at), np.uint64)
    for j in range(last + 1):
        if j and j % 64 == 0:
            bits = walk_bits(symbols, walk, j)
        here = [k for k, p in zip(keys, places) if j in p]
        if here:
            part = symbols.take(at)
            part *= _odd(j)
            for k in here:
                k += part
        if j < last:
            bits.take(at, out=moves, mode="clip")
            moves >>= np.uint64(j % 64)
            moves &= np.uint64(1)
            at += moves.view(np.int64)
    return keys


def reads_of(walk: int, size: int, edited: float = MAX_DISTANCE) -> range:
    """The repetitions that read a walk; empty after the last walk."""
    return range(walk * READS, min((walk + 1) * READS, repetitions(size, edited=edited)))


def window_keys(symbols: np.ndarray, starts: np.ndarray, size: int, repetition: int) -> np.ndarray:
    """The sampled key of the walk from each start; ``symbols`` are word hashes with a spare end."""
    walk, s = repetition // READS, np.append(symbols, np.zeros(steps(size), np.uint64))
    return walk_keys(s, starts, size, walk, [repetition], walk_bits(s, walk, 0))[0]


class Symbols:
    """Word hashes; 0 is left for the places between texts. Hashing a word takes less than looking it up."""

    def __call__(self, found: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        out[out == 0] = 1
        return out


def fits(item: str, text: str) -> int:
    """Edit distance between the item and the stretch of ``text`` that fits it best.

    Bit-parallel: a column of the distance table is two integers.
    """
    if item in text:
        return 0
    m = len(item)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return best


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of numbers whose 64-bit blocks are the rows, the lowest first."""
    out = a + b
    if len(a) > 1:
        over = out < a
        for k in range(1, len(a)):
            carry = over[k - 1].astype(np.uint64)
            out[k] += carry
            over[k] |= out[k] < carry
    return out


def _doubled(a: np.ndarray) -> np.ndarray:
    out = a << np.uint64(1)
    if len(a) > 1:
        out[1:] |= a[:-1] >> np.uint64(63)
    return out


def _fits_blocks(items: list[str], of: np.ndarray, texts: list[str], blocks: int) -> np.ndarray:
    """``fits`` of items of so many 64-bit blocks; text i belongs to item ``of[i]``."""
    letters = np.unique(_code_points(items))
    if len(items) > 1 and len(items) * (len(letters) + 1) * blocks > MASK_CELLS:  # the masks would be large
        half, out = len(items) // 2, np.empty(len(texts), np.int64)
        for part, lo in ((of < half, 0), (of >= half, half)):
            at = np.flatnonzero(part)
            if len(at):
                mine = items[:half] if lo == 0 else items[half:]
                out[at] = _fits_blocks(mine, of[at] - lo, [texts[i] for i in at], blocks)
        return out
    width = len(letters) + 1  # the last column is for letters that no item has
    masks = np.zeros((blocks, len(items) * width), np.uint64)
    for i, x in enumerate(items):
        place = np.arange(len(x))
        cells = (place >> 6, i * width + np.searchsorted(letters, _code_points([x])))
        np.bitwise_or.at(masks, cells, np.uint64(1) << (place & 63).astype(np.uint64))

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    points = _code_points(texts)
    codes = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    codes = np.where(letters[codes] == points, codes, len(letters))
    begin = (np.cumsum(lengths) - lengths)[order]
    still = np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), side="right")
    m = np.fromiter(map(len, items), np.int64, len(items))[of[order]]
    row, top = of[order] * width, ((m - 1) & 63).astype(np.uint64)
    one = np.uint64(1)
    up, down = np.full((blocks, len(texts)), ~np.uint64(0)), np.zeros((blocks, len(texts)), np.uint64)
    score, best = m.copy(), m.copy()
    for j, ended in enumerate(still):
        n = len(texts) - int(ended)  # texts stand by length, so those that go on are the first
        if n < up.shape[1]:
            up, down = up[:, :n].copy(), down[:, :n].copy()
        eq = masks.take(row[:n] + codes.take(begin[:n] + j), axis=1)
        xv = eq | down
        xh = (_added(eq & up, up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score[:n] += ((ph[-1] >> top[:n]) & one).view(np.int64) - ((mh[-1] >> top[:n]) & one).view(np.int64)
        np.minimum(best[:n], score[:n], out=best[:n])
        ph, mh = _doubled(ph), _doubled(mh)
        up, down = mh | ~(xv | ph), ph & xv
    out = np.empty(len(texts), np.int64)
    out[order] = best
    return out


def fits_all(items: list[str], texts: list[str]) -> np.ndarray:
    """``fits`` of every pair, all pairs a character further at a time."""
    out = np.zeros(len(items), np.int64)
    by_blocks: dict[int, list[int]] = {}
    for i, (item, text) in enumerate(zip(items, texts)):
        if item not in text:
            by_blocks.setdefault((len(item) + 63) // 64, []).append(i)
    for blocks, at in by_blocks.items():
        number: dict[str, int] = {}
        of = np.array([number.setdefault(items[i], len(number)) for i in at])
        out[at] = _fits_blocks(list(number), of, [texts[i] for i in at], blocks)
    return out


# ---- items -------------------------------------------------------------------------------
_ITEM = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.IntegerType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
])


def item_rows(texts: pd.Series, edited: float = MAX_DISTANCE) -> pd.DataFrame:
    symbols, rows = Symbols(), []
    for x in texts:
        found = lowered(x).split()
        keys = []
        if found:
            size = window_size(len(found))
            s = np.append(symbols(found), np.uint64(0))
            starts = np.arange(len(found) - size + 1)
            keys = np.unique(np.concatenate([window_keys(s, starts, size, r) for r in range(repetitions(size, edited=edited))])).view(np.int64)
        rows.append((b" ".join(found).decode("utf-8", "surrogatepass"), window_size(len(found)) if found else 0, len(found), keys))
    return pd.DataFrame(rows, columns=_ITEM.names)


def filter_place(keys: np.ndarray, i: int) -> np.ndarray:
    """A key's i-th bit in the filter; the first is cheap, as nearly every window asks for it alone."""
    return ((keys >> np.uint64(40) if i == 0 else mixed(keys, 101 + i)) & np.uint64(FILTER_BITS - 1)).view(np.int64)


def filter_places(keys: np.ndarray) -> list[np.ndarray]:
    return [filter_place(keys, i) for i in range(FILTER_HASHES)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _places(keys: pd.Series) -> pd.Series:
    all_ = filter_places(keys.to_numpy(np.int64).view(np.uint64))
    return pd.Series(list(np.stack(all_, 1)) if len(keys) else [], dtype=object)


def key_filter(keys: DataFrame) -> np.ndarray:
    """The Bloom filter over a key column; FILTER_BITS bits come to the driver, however many keys."""
    places = keys.select(F.explode(_places("key")).alias("p")).distinct()
    each = FILTER_BITS // FILTER_BLOCKS
    blocks = places.groupBy(F.floor(F.col("p") / each).cast("int").alias("b")).agg(F.collect_list(F.col("p").cast("int")).alias("ps"))
    out = np.zeros(FILTER_BITS, bool)
    for r in blocks.toLocalIterator():
        out[r.ps] = True
    return np.packbits(out)


# ---- documents ---------------------------------------------------------------------------
_HIT = T.ArrayType(T.StructType([
    T.StructField("key", T.LongType()), T.StructField("at", T.LongType()), T.StructField("around", T.StringType()),
]))


def hits_of(texts: list[str | None], sizes: dict[int, int], bloom: np.ndarray, symbols: Symbols, edited: float = MAX_DISTANCE) -> list[list]:
    """Per text the windows whose key passes the filter, each with the words around it.

    ``sizes`` has the longest item of each window size. All texts of a batch are walked together, a
    PIECE of words at a time; between them stands a symbol that no word has.
    """
    found = [lowered(x).split() for x in texts]
    lengths = np.array([len(f) for f in found])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    out: list[list] = [[] for _ in texts]
    if not lengths.sum() or not sizes:
        return out
    far = 2 * max(sizes) + 2  # as far as any walk can go
    s = np.zeros(begin[-1] + 1 + far, np.uint64)
    for f, b in zip(found, begin):
        s[b : b + len(f)] = symbols(f)
    starts = {size: np.concatenate([np.arange(b, b + n, stride(size)) for b, n in zip(begin, lengths)]) for size in sizes}
    walks = max(-(-repetitions(size, edited=edited) // READS) for size in sizes)
    for head in range(0, int(begin[-1]), PIECE):
        view = s[head : head + PIECE + far]
        parts = {size: x[slice(*np.searchsorted(x, [head, head + PIECE]))] - head for size, x in starts.items()}
        for walk in range(walks):
            bits = walk_bits(view, walk, 0)
            for size, part in parts.items():
                reads = reads_of(walk, size, edited)
                if not len(part) or not len(reads):
                    continue
                for keys in walk_keys(view, part, size, walk, reads, bits):
                    ok = None
                    for i in range(FILTER_HASHES):
                        p = filter_place(keys if ok is None else keys[ok], i)
                        passed = np.flatnonzero((bloom.take(p >> 3) >> (7 - (p & 7)).astype(np.uint8)) & 1)
                        ok = passed if ok is None else ok[passed]
                    if not len(ok):
                        continue
                    first = part[ok] + head
                    of = np.searchsorted(begin, first, side="right") - 1
                    slack = sizes[size] + sizes[size] // 4 + 2
                    for key, d, at in zip(keys[ok].view(np.int64).tolist(), of.tolist(), (first - begin[of]).tolist()):
                        around = b" ".join(found[d][max(0, at - slack) : at + slack]).decode("utf-8", "surrogatepass")
                        out[d].append((key, at, around))
    return out


def find_items(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """``<ident>, <item_id>, distance, at`` and the text's digest: the pairs within the bound.

    ``distance`` is the least edit distance found, ``at`` the first word of the window that led to it.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def planned(texts: pd.Series) -> pd.DataFrame:
        return item_rows(texts, max_distance)

    made = items.select(F.col(f"`{item_id}`").alias("item"), F.pandas_udf(planned, _ITEM).asNondeterministic()(F.col(f"`{item_text}`")).alias("i"))
    made = fixed(made.select("item", "i.*").where("words > 0"))
    keys = made.select("item", F.col("text").alias("wanted"), F.explode("keys").alias("key"))
    sizes = {r["size"]: r["w"] for r in made.groupBy("size").agg(F.max("words").alias("w")).collect()}
    bloom = spark.sparkContext.broadcast(key_filter(keys.select("key")))

    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series(hits_of(list(texts), sizes, bloom.value, Symbols(), max_distance), dtype=object)

    slim = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("t"))
    hits = slim.select("id", F.sha1("t").alias("digest"), F.explode(F.pandas_udf(scan, _HIT).asNondeterministic()("t")).alias("h"))
    n, chars = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("wanted")), F.lit(0))).first()
    sent = n <= SENT_KEYS and chars <= SENT_CHARS
    pairs = hits.select("id", "digest", "h.*").join(F.broadcast(keys) if sent else keys, "key").select("id", "digest", "item", "at", "around", "wanted")
    same = ["id", "digest", "item", "at", "wanted"]
    if not sent:  # keys of one window are in different tasks; otherwise they stand beside one another
        pairs = pairs.dropDuplicates(same)

    def verified(rows: list[pd.DataFrame]) -> pd.DataFrame:
        all_ = pd.concat(rows, ignore_index=True).drop_duplicates(same)
        all_["distance"] = fits_all(all_["wanted"].tolist(), all_["around"].tolist())
        bound = np.floor(all_["wanted"].str.len() * max_distance)
        return all_.loc[all_["distance"] <= bound, ["id", "digest", "item", "at", "distance"]]

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, chars = [], 0
        for b in batches:
            waiting.append(b)
            chars += int(b["around"].str.len().sum())
            if chars >= VERIFIED:
                yield verified(waiting)
                waiting, chars = [], 0
        if waiting:
            yield verified(waiting)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    near = pairs.mapInPandas(distances, f"id {kinds['id']}, digest string, item {kinds['item']}, at long, distance long")
    best = near.groupBy("id", "digest", "item").agg(F.min(F.struct("distance", "at")).alias("b"))
    return best.select(F.col("id").alias(ident), F.col("item").alias(item_id), "b.distance", "b.at", "digest")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with their columns."""
    digest, of = fresh(docs, "digest", "of")
    found = find_items(docs, items, **options).select(F.col("digest").alias(of)).distinct()
    out = docs.withColumn(digest, F.sha1("text")).join(found, F.col(digest) == F.col(of), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    pairs = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min("at").alias("at"))
