"""Similarity join of documents on word shingles, with several global token orders.

A document's set is its distinct 4-word shingles (64-bit hashes). Two documents link when their
sets' Jaccard similarity is at least THRESHOLD percent.

1. Equal sets (by a 128-bit digest) become one class; all below works on one representative of each.
2. A count-min sketch of all shingles gives each a frequency class; its size is fixed, so it can
   be sent to every task. A token order sorts by frequency class, rare first, then by a hash; other
   hashes give other orders. Whatever the sketch says, an order is the same for all documents, so
   it decides only how much work there is.
3. If two sets link, their prefixes (the first n - ceil(t n) + 1 tokens) share a token under every
   order. The prefixes of the first order are joined on the token, with the length filter and the
   positional filter at the first shared token; the pairs must then differ little enough by a bitmap
   of one to two bits per token, then share tokens in the prefixes of all further orders; pairs that
   pass all of them are verified on the whole sets.
4. A large group of near copies would make a pair of any two. So within a token's group all are
   first compared with one leader, the set with the most frequent tokens (near the centre of such
   a group), and the links make components. Sets in another component than their leader get a new
   leader among themselves, for ROUNDS rounds. Only what is then left in different components is
   paired, all of it. A pair is left out only if both sets are in one component by other links, so
   no component is lost and nothing is capped; links inside a component are not counted.

Cases: a null or empty text has the empty set, links with nothing and is its own component; equal
texts, repeated rows and rows without an id share a class (its smallest id stands for it); a text
of one to three words has one shingle; an empty table gives an empty result; extra columns pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterline.llm.common import WORD, Scratch, fixed, fresh, query, small_batches, table
from quarterline.llm.graph import components

WIDTH = 4
THRESHOLD = 85
SLOTS = 1 << 20
BLOCKS = 64
#: Hash seeds of the token orders; the first finds pairs, the others filter them.
ORDERS = (1, 2, 3)
#: Rounds of leaders before the sets left over are paired.
ROUNDS = 3
#: Names of sets (a few numbers each) that may be broadcast.
MAX_BROADCAST = 1_000_000

_A = 0x9E3779B97F4A7C15
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64(_A * (seed + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: A 64-bit number per byte, and its place's multiplier, for hashing words without making objects.
_BYTE = mixed(np.arange(256, dtype=np.uint64), 12345)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(256)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of all words in an array of bytes, A-Z as a-z.

    A word's hash is a sum over its bytes of (byte's number) * (multiplier ** place), mixed.
    """
    inside = ~_IS_SPACE[joined]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, size)
    power = _POWERS[place & 255]
    if size.max() > 256:
        far = place > 255
        power[far] = mixed((place[far] >> 8).astype(np.uint64), 7) * power[far] | np.uint64(1)
    value = _BYTE[_LOWER[joined[at]]] * power
    return mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64)), start


def shingle_sets(texts, width: int = WIDTH, bytes_at_once: int = 1 << 15) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; short texts are hashed together."""
    part: list[bytes] = []
    size = 0

    def done():
        joined = np.frombuffer(b" ".join([*part, b""]), np.uint8)
        hashes, start = word_hashes(joined)
        cuts = np.searchsorted(start, np.cumsum([0, *[len(x) + 1 for x in part]]))
        whole = np.zeros(len(hashes), np.uint64)
        for i in range(width if len(hashes) >= width else 0):
            n = len(hashes) - width + 1
            whole[:n] = mixed(whole[:n] ^ hashes[i : i + n], width)
        for a, b in zip(cuts, cuts[1:]):
            if b - a >= width:
                s = np.sort(whole[a : b - width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:  # the whole sequence is one shingle
                one = np.zeros(min(1, b - a), np.uint64)
                for h in hashes[a:b]:
                    one = mixed(one ^ h, int(b - a))
                yield one

    for x in texts:
        raw = x.encode("utf-8", "surrogatepass") if x else b""
        part.append(raw)
        size += len(raw)
        if size >= bytes_at_once:
            yield from done()
            part, size = [], 0
    if part:
        yield from done()


def frequency_classes(docs: DataFrame, text: str = "text", width: int = WIDTH) -> np.ndarray:
    """One byte per slot: the binary logarithm of how many documents hold a shingle of the slot.

    All documents are counted; SLOTS bytes come to the driver, for any corpus.
    """
    each = SLOTS // BLOCKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for rows in batches:
            for s in shingle_sets(rows["t"], width):
                np.add.at(counts, slot_of(s), 1)
        yield pd.DataFrame({"b": range(BLOCKS), "c": [zlib.compress(counts[i * each : (i + 1) * each].astype("<i8").tobytes(), 1) for i in range(BLOCKS)]})

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in rows["c"]:
            total = total + np.frombuffer(zlib.decompress(x), "<i8")
        return pd.DataFrame({"b": [key[0]], "c": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    parts = docs.select(F.col(f"`{text}`").alias("t")).mapInPandas(count, "b int, c binary")
    parts = parts.withColumn("g", F.floor(F.spark_partition_id() / 256))
    parts = parts.groupBy("b", "g").applyInPandas(add, "b int, c binary").groupBy("b").applyInPandas(add, "b int, c binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in parts.collect():
        c = np.frombuffer(zlib.decompress(bytes(r.c)), "<i8")
        out[r.b * each : (r.b + 1) * each] = np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.uint8) + 1, 0)
    return out


def slot_of(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def prefix(s: np.ndarray, classes: np.ndarray, seed: int, threshold: int) -> np.ndarray:
    """The set's first tokens in the order of a seed."""
    p = prefix_length(len(s), threshold)
    rank = mixed(s, seed) >> np.uint64(8) | classes[slot_of(s)].astype(np.uint64) << np.uint64(56)
    first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[first[np.argsort(rank[first], kind="stable")]]


#: ``pack`` holds how common a set's tokens are (7 bits), its size and a token's place (28 bits each).
_SIGNED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("key", T.LongType()), T.StructField("more", T.LongType()),
    T.StructField("pack", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("odd", T.ArrayType(T.LongType())),
])
#: The prefixes in the further orders, by 16 bits of each token (shared tokens still meet), and the whole set.
_WHOLE = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("more", T.LongType()),
    T.StructField("prefixes", T.ArrayType(T.ArrayType(T.ShortType()))), T.StructField("tokens", T.ArrayType(T.LongType())),
])
PLACE_BITS = 28


def keys_of(s: np.ndarray) -> tuple[int, int]:
    """A set's name: both halves of a 128-bit digest of its sorted hashes, signed."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    halves = np.array([digest & 0xFFFFFFFFFFFFFFFF, digest >> 64], np.uint64).view(np.int64)
    return int(halves[0]), int(halves[1])


def odd_bits(s: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two of bits, one to two per token: which bits an odd number of tokens falls on.

    Two sets' bitmaps differ in no more bits than the sets in tokens. Half of a bitmap, each bit XOR the
    one half a length further, is the bitmap of half the length.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    at = ((s >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """A frame whose whole numbers stay whole beside nulls."""
    columns = list(zip(*rows)) or [()] * len(names)
    whole = {"n", "key", "more", "pack"}
    return pd.DataFrame({n: pd.array(c, "Int64") if n in whole else pd.Series(c, dtype=object) for n, c in zip(names, columns)})


def signer(classes, width: int, threshold: int):
    """Column function: size, name, commonness with size, first prefix and bitmap of a text's set."""

    def sign(texts: pd.Series) -> pd.DataFrame:
        rows, table_ = [], classes.value
        for s in shingle_sets(texts, width):
            if len(s):
                common = min(127, int(table_[slot_of(s)].mean() * 4))
                pack = common << 2 * PLACE_BITS | len(s) << PLACE_BITS
                rows.append((len(s), *keys_of(s), pack, prefix(s, table_, ORDERS[0], threshold).view(np.int64), odd_bits(s)))
            else:
                rows.append((0, None, None, None, None, None))
        return _framed(rows, _SIGNED.names)

    return F.pandas_udf(sign, _SIGNED).asNondeterministic()


def detailer(classes, width: int, threshold: int):
    """Column function: a text's name with its prefixes in the further orders and its whole set."""

    def short(x: np.ndarray) -> np.ndarray:
        return x.astype(np.uint16).view(np.int16)

    def detail(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for s in shingle_sets(texts, width):
            if len(s):
                rows.append((*keys_of(s), [short(prefix(s, classes.value, o, threshold)) for o in ORDERS[1:]], s.view(np.int64)))
            else:
                rows.append((None, None, [], []))
        return _framed(rows, _WHOLE.names)

    return F.pandas_udf(detail, _WHOLE).asNondeterministic()


def may_link(a: str, b: str, threshold: int):
    """Length and positional filter for two rows of one token, from their columns ``pack``."""
    low = (1 << PLACE_BITS) - 1
    na, nb = (F.shiftright(F.col(x), PLACE_BITS).bitwiseAND(low) for x in (a, b))
    pa, pb = (F.col(x).bitwiseAND(low) for x in (a, b))
    lengths = (100 * na >= threshold * nb) & (100 * nb >= threshold * na)
    rest = F.least(na - pa, nb - pb)  # common tokens at most, this one included
    return lengths & ((100 + threshold) * rest >= threshold * (na + nb))


def differing_bits(a: str, b: str):
    """In how many bits two columns of ``odd_bits`` differ; the longer is folded once if it is twice as long, else null."""
    x, y = (F.when(F.size(p) <= F.size(q), F.col(p)).otherwise(_half(p)) for p, q in ((a, b), (b, a)))
    differ = F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, c: n + c)
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)), differ)


def _half(odd: str):
    half = F.greatest(F.floor(F.size(odd) / 2).cast("int"), F.lit(1))
    return F.zip_with(F.slice(odd, F.lit(1), half), F.slice(odd, half + 1, half), lambda i, j: i.bitwiseXOR(j))


class Verifier:
    """Exact tests of candidate pairs ``u, v`` of class names."""

    def __init__(self, classes: DataFrame, once: DataFrame, slim: DataFrame, scratch: Scratch, sketch, width: int, threshold: int):
        self.classes, self.once, self.slim, self.scratch, self.threshold = classes, once, slim, scratch, threshold
        self.whole = detailer(sketch, width, threshold)

    def ends(self, pairs: DataFrame) -> DataFrame:
        """``name, left, right``: the classes in the pairs, and on which sides they stand."""
        ends = pairs.select(F.col("u").alias("name"), F.lit(True).alias("left")).unionByName(pairs.select(F.col("v").alias("name"), F.lit(False).alias("left")))
        return self.scratch.fixed(ends.groupBy("name").agg(F.max("left").alias("left"), F.max(~F.col("left")).alias("right")))

    def bitmaps(self, pairs: DataFrame) -> DataFrame:
        """One row per class in the pairs: size and bitmap, as signed. Up to MAX_BROADCAST classes they are looked up without a shuffle."""
        ends = self.ends(pairs)
        n = ends.count()
        found = self.once.join(F.broadcast(ends) if n <= MAX_BROADCAST else ends, "name").select("name", "left", "right", "n", "odd")
        found = self.scratch.fixed(found)
        return found if found.count() == n else self.scratch.fixed(found.dropDuplicates(["name"]))

    def details(self, pairs: DataFrame) -> DataFrame:
        """One row per class in the pairs, made anew from one of its texts.

        Up to MAX_BROADCAST classes the texts are looked up without a shuffle. Rows that repeat an id
        and text, or have none, are found by the text's digest and give one row.
        """
        needed = self.classes.join(self.ends(pairs), "name").select("name", "left", "right", "raw", F.col("more").alias("rest"), "rep")
        needed = self.scratch.fixed(needed)
        needed = F.broadcast(needed) if needed.count() <= MAX_BROADCAST else needed
        same_text = (F.col("digest") == F.col("rep.digest")) & F.col("id").eqNullSafe(F.col("rep.id"))
        found = self.slim.join(needed, same_text).select("name", "left", "right", "raw", "rest", self.whole("t").alias("d"))
        exact = found.where((F.col("d.key") == F.col("raw")) & (F.col("d.more") == F.col("rest")))
        detail = self.scratch.fixed(exact.select("name", "left", "right", "d.*").drop("key", "more"))
        return detail if detail.count() == needed.count() else self.scratch.fixed(detail.dropDuplicates(["name"]))

    def joined(self, pairs: DataFrame, detail: DataFrame) -> DataFrame:
        """The pairs with the details of both sides as ``a`` and ``b``."""
        packed = F.struct(*[c for c in detail.columns if c not in ("name", "left", "right")])
        side = lambda x, at, out: detail.where(at).select(F.col("name").alias(x), packed.alias(out))
        return pairs.join(side("u", "left", "a"), "u").join(side("v", "right", "b"), "v")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass a bound from the bitmaps, the filter of every further order, and the exact test.

        Sets differ in as many tokens as their bitmaps do in bits, or more, so that the bound drops no
        link. Texts are read, and whole sets made and moved, only for the pairs that pass it.
        """
        near = self.joined(pairs, self.bitmaps(pairs))
        most = (100 - self.threshold) * (F.col("a.n") + F.col("b.n"))
        differ = F.coalesce(differing_bits("a.odd", "b.odd"), F.lit(0))
        near = self.scratch.fixed(near.where((100 + self.threshold) * differ <= most).select("u", "v"))
        both = self.joined(near, self.details(near))
        for i in range(len(ORDERS) - 1):
            both = both.where(F.arrays_overlap(F.col("a.prefixes")[i], F.col("b.prefixes")[i]))
        shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
        enough = (100 + self.threshold) * shared >= self.threshold * (F.size("a.tokens") + F.size("b.tokens"))
        return self.scratch.fixed(both.where(enough).select("u", "v"))


def named_classes(signed: DataFrame) -> DataFrame:
    """``name, raw, more, rep, least, copied``: one row per distinct set.

    Sets are told apart by 128 bits. The name is the first half; where two sets share it (rare at any
    size), all but one are renamed by both halves. ``rep`` is a row of the class by id and text
    digest, ``least`` its smallest id, ``copied`` says that several rows have the set.
    """
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    classes = signed.where("n > 0").groupBy(F.col("key").alias("raw"), "more").agg(F.min(rep).alias("rep"), F.min("id").alias("least"), (F.count("*") > 1).alias("copied"))
    first = F.min("more").over(W.partitionBy("raw"))
    return classes.select(F.when(F.col("more") == first, F.col("raw")).otherwise(F.xxhash64("raw", "more")).alias("name"), "raw", "more", "rep", "least", "copied")


def representatives(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``name, n, pack, prefix, odd`` of one row per class (several, where id and text repeat).

    A row that alone has its set stands for itself under the set's own name. Up to MAX_BROADCAST other
    classes the rows are picked without moving any prefix.
    """
    side = classes.where(F.col("copied") | (F.col("name") != F.col("raw"))).select("name", "raw", F.col("more").alias("rest"), "rep")
    side = F.broadcast(side) if side.count() <= MAX_BROADCAST else side
    same_set = (F.col("key") == F.col("raw")) & (F.col("more") == F.col("rest"))
    same_row = (F.col("digest") == F.col("rep.digest")) & F.col("id").eqNullSafe(F.col("rep.id"))
    found = signed.where("n > 0").join(side, same_set, "left").where(F.col("name").isNull() | same_row)
    return found.select(F.coalesce("name", "key").alias("name"), "n", "pack", "prefix", "odd")


def star_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """``u, v``: in every token's group, each set that may link with the group's leader beside it.

    The leader is the set with the most frequent tokens, near the centre of a group of near copies.
    Sets known to be in the leader's component are left out.
    """
    apart = (F.col("name") != F.col("l.name")) & (F.col("root") != F.col("l.root"))
    found = rows.where(apart).where(may_link("pack", "l.pack", threshold))
    return found.select(F.least("l.name", "name").alias("u"), F.greatest("l.name", "name").alias("v")).distinct()


def with_leaders(rows: DataFrame) -> DataFrame:
    """Give each token's group a leader ``l``; groups of one component are done and go.

    Sets that were in an earlier leader's component are ``led``, and lead only when all others are too.
    """
    same_token = W.partitionBy("token")
    before = F.max(F.when(F.col("name") == F.col("l.name"), F.col("root"))).over(same_token)
    led = F.col("led") | F.coalesce(F.col("root") == F.col("before"), F.lit(False))
    rows = rows.withColumn("before", before).withColumn("led", led).drop("before", "l")
    rows = rows.withColumns({
        "l": F.max(F.struct((~F.col("led")).alias("free"), "pack", "name", "root")).over(same_token),
        "lo": F.min("root").over(same_token),
        "hi": F.max("root").over(same_token),
    })
    return rows.where("lo <> hi").drop("lo", "hi")


def rerooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the roots of the components that all links so far make."""
    roots = components(links)
    roots = F.broadcast(roots) if roots.count() <= MAX_BROADCAST else roots
    joined = rows.withColumnRenamed("root", "old").join(roots, F.col("name") == F.col("node"), "left")
    return joined.select("token", "name", "pack", F.coalesce("root", "name").alias("root"), "led", F.struct("l.name").alias("l"))


def similarity_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD):
    """``signed`` (id, n, key, more per row of ``docs``) and ``classes`` (raw, more, component_id, root).

    ``root`` names a component by a class, ``component_id`` is its smallest id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    slim = docs.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("t"))
    sketch = spark.sparkContext.broadcast(frequency_classes(slim, "t", width))
    slim = slim.withColumn("digest", F.xxhash64("t"))
    sign = signer(sketch, width, threshold)
    whole = scratch.fixed(slim.select("id", "digest", sign("t").alias("s")).select("id", "digest", "s.*"))
    signed = fixed(whole.select("id", "n", "key", "more"))
    classes = scratch.fixed(named_classes(whole))
    once = representatives(whole, classes)
    verifier = Verifier(classes, once, slim, scratch, sketch, width, threshold)

    rows = once.select("name", "pack", F.posexplode("prefix").alias("pos", "token"))
    rows = rows.select("token", "name", (F.col("pack") + F.col("pos")).alias("pack")).repartition("token")  # slim: the rest is the same in all rows
    rows = rows.withColumns({"root": F.col("name"), "led": F.lit(False), "l": F.struct(F.lit(None).cast("bigint").alias("name"))})
    groups = scratch.fixed(with_leaders(rows).dropDuplicates(["token", "name"]))  # rows that repeat an id and text

    links = tried = spark.createDataFrame([], "u bigint, v bigint")
    for _ in range(ROUNDS):
        pairs = scratch.fixed(star_pairs(groups, threshold).join(tried, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            break
        tried = tried.unionByName(pairs)
        links = links.unionByName(verifier.links(pairs))
        groups = scratch.fixed(with_leaders(rerooted(groups, links)))
    left, right = (groups.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("name", "pack", "root")]) for x in "ab")
    apart = (F.col("a_name") < F.col("b_name")) & (F.col("a_root") != F.col("b_root"))
    rest = left.join(right, "token").where(apart & may_link("a_pack", "b_pack", threshold))
    rest = rest.select(F.col("a_name").alias("u"), F.col("b_name").alias("v")).distinct()
    rest = scratch.fixed(rest.join(tried, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(verifier.links(rest))

    roots = components(links)
    named = classes.join(roots, F.col("name") == F.col("node"), "left").select("raw", "more", "least", F.coalesce("root", "name").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = fixed(named.join(least, "root").select("raw", "more", "component_id", "root"))
    scratch.clear()
    return signed, named


def link_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``<ident>, n_shingles, component_id`` of every document."""
    signed, classes = similarity_classes(docs, ident, text, width, threshold)
    joined = signed.join(classes.withColumnRenamed("raw", "key"), ["key", "more"], "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest id.

    Rows without words stay. If rows repeat the smallest id within a component, or all are without id,
    one of them stays.
    """
    _, classes = similarity_classes(docs, "doc_id", "text", width, threshold)
    key, raw, more, cid, root = fresh(docs, "key", "raw", "more", "cid", "root")
    name = F.pandas_udf(_keys(width), "key long, more long").asNondeterministic()
    keyed = docs.withColumn(key, name(F.col("text")))
    side = classes.select(F.col("raw").alias(raw), F.col("more").alias(more), F.col("component_id").alias(cid), F.col("root").alias(root))
    joined = keyed.join(side, (F.col(f"{key}.key") == F.col(raw)) & (F.col(f"{key}.more") == F.col(more)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = joined.where(F.col(f"{key}.key").isNotNull() & F.col("doc_id").eqNullSafe(F.col(cid))).dropDuplicates([root])
    return joined.where(F.col(f"{key}.key").isNull()).select(*columns).unionByName(kept.select(*columns))


def _keys(width: int):
    def keys(texts: pd.Series) -> pd.DataFrame:
        return _framed([keys_of(s) if len(s) else (None, None) for s in shingle_sets(texts, width)], ["key", "more"])

    return keys


def join_ctes(docs: str, width: int = WIDTH, threshold: int = THRESHOLD) -> str:
    """WITH RECURSIVE items up to ``linked`` (doc_id, n_shingles, component_id) over unique ids."""
    return f"""
j_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM {docs}),
j_sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS s FROM j_words),
j_class AS (SELECT s2 AS s, min(doc_id) AS rep, any_value(len(s2)) AS n FROM (SELECT doc_id, list_sort(s) AS s2 FROM j_sets WHERE len(s) > 0) GROUP BY s2),
j_tok AS (SELECT rep, n, unnest(s) AS t FROM j_class),
j_links AS (SELECT a.rep AS u, b.rep AS v FROM j_tok a JOIN j_tok b ON a.t = b.t AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING {100 + threshold} * count(*) >= {threshold} * (a.n + b.n)),
j_both AS (SELECT u, v FROM j_links UNION ALL SELECT v, u FROM j_links),
j_reach AS (SELECT rep AS node, rep AS r FROM j_class UNION SELECT b.v, j_reach.r FROM j_reach JOIN j_both b ON b.u = j_reach.node WHERE j_reach.r < b.v),
j_comp AS (SELECT node, min(r) AS component_id FROM j_reach GROUP BY node),
linked AS (SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
  FROM j_sets d LEFT JOIN j_class k ON len(d.s) > 0 AND list_sort(d.s) = k.s LEFT JOIN j_comp c ON c.node = k.rep)"""


@query("op7_ngram_join", f"WITH RECURSIVE {join_ctes('documents')} SELECT * FROM linked")
def op7_ngram_join(spark, sf_dir):
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
