"""Word segmentation of unspaced scripts by the cheapest path through a word lattice.

The dictionary is a table of words with frequencies; a word costs -ln(frequency / all), in whole
millionths, so that sums are exact. Up to MAX_WORDS words (they are counted) are sent to the tasks,
where every run of Han characters is segmented beside its text, so that no text is moved. A larger
dictionary never leaves the cluster; each distinct run is segmented once:

1. every substring of at most the longest word's length is looked up by a join; the hits are the
   lattice's edges;
2. no path is tied across a place that no edge crosses, so a run is cut there into blocks;
3. in each block the cheapest path is found from right to left in one fold, the longer word of
   equally cheap ones first.

Both ways give the same tokens. A character outside the dictionary is an edge as rare as a word seen once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.session import checkpoint

# ---- Fixed values: the pieces a text is cut into -----------------------------------------
HAN_RUN = r"\p{IsHan}+"
PIECES = rf"(?s){HAN_RUN}|[A-Za-z]+|[0-9]+|."

#: So many words are sent to the tasks; a larger dictionary is joined.
MAX_WORDS = 500_000
#: Runs of which a task remembers the words.
REMEMBERED = 200_000

_EDGE = "array<struct<at:int,len:int,cost:bigint>>"


def dictionary(words: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """``word, f``: one row per word, its largest frequency counts (1 at least)."""
    return words.where(F.length(word) > 0).groupBy(F.col(word).alias("word")).agg(
        F.greatest(F.lit(1.0), F.max(F.coalesce(F.col(freq).cast("double"), F.lit(1.0)))).alias("f")
    )


def dictionary_costs(listed: DataFrame) -> DataFrame:
    """``word, cost`` of a dictionary."""
    total = listed.agg(F.sum("f")).scalar()
    return listed.select("word", micro_cost(total, F.col("f")).alias("cost"))


def unknown_cost(total: Column) -> Column:
    """The cost of a character outside the dictionary."""
    return F.coalesce(micro_cost(total, F.lit(1.0)), F.lit(0)).cast("bigint")


def micro_cost(total: Column, freq: Column) -> Column:
    return F.round((F.ln(total) - F.ln(freq)) * 1_000_000).cast("bigint")


def lattice(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """``run, at, len, cost``: all dictionary words in the runs."""
    longest = costs.agg(F.max(F.length("word")).alias("m")).select(F.coalesce("m", F.lit(1))).scalar()
    n = F.length("run")
    starts = runs.select("run", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(longest, F.length("run") - F.col("at")))
    spans = starts.select("run", "at", F.explode(lengths).alias("len"))
    spans = spans.withColumn("word", F.substring("run", F.col("at") + 1, F.col("len")))
    return spans.join(costs, "word").select("run", "at", "len", "cost")


def blocks(edges: DataFrame) -> DataFrame:
    """``run, lo, hi, edges`` of the parts that longer words tie together; positions count from ``lo``."""
    along = W.partitionBy("run").orderBy("at", "len")
    reach = F.max(F.col("at") + F.col("len")).over(along.rowsBetween(W.unboundedPreceding, -1))
    cut = F.when(F.col("at") < reach, 0).otherwise(1)
    numbered = edges.withColumn("new", cut).withColumn("block", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    grouped = numbered.groupBy("run", "block").agg(
        F.min("at").alias("lo"), F.max(F.col("at") + F.col("len")).alias("hi"), F.collect_list(F.struct("at", "len", "cost")).alias("e")
    )
    shifted = F.transform("e", lambda x: F.struct((x["at"] - F.col("lo")).alias("at"), x["len"].alias("len"), x["cost"].alias("cost")))
    return grouped.where(F.col("hi") - F.col("lo") > 1).select("run", "lo", "hi", shifted.cast(_EDGE).alias("edges"))


def cheapest_words(size: Column, edges: Column, unknown: Column) -> Column:
    """Lengths of the words that start at each place of a block on the cheapest way to its end."""
    state = F.struct(
        F.array(F.lit(0).cast("bigint")).alias("best"), F.array().cast("array<int>").alias("len")
    )

    def step(s: Column, at: Column) -> Column:
        here = F.filter(edges, lambda x: x["at"] == at)
        single = F.struct(at.cast("int").alias("at"), F.lit(1).alias("len"), unknown.alias("cost"))
        here = F.when(F.exists(here, lambda x: x["len"] == 1), here).otherwise(F.concat(here, F.array(single)))
        ways = F.transform(here, lambda x: F.struct((x["cost"] + F.get(s["best"], x["len"] - 1)).alias("c"), (-x["len"]).alias("m")))
        pick = F.array_min(ways)
        return F.struct(F.concat(F.array(pick["c"]), s["best"]).alias("best"), F.concat(F.array(-pick["m"]), s["len"]).alias("len"))

    return F.aggregate(F.reverse(F.sequence(F.lit(0), size - 1)), state, step, lambda s: s["len"])


def path(lengths: Column) -> Column:
    """``at, len`` of the words met when every word is followed by the next."""
    state = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,len:int>>").alias("out"))

    def step(s: Column, at: Column) -> Column:
        size = F.get(lengths, at)
        word = F.array(F.struct(at.cast("int").alias("at"), size.cast("int").alias("len")))
        go = F.struct((at + size).cast("int").alias("next"), F.concat(s["out"], word).alias("out"))
        return F.when(at == s["next"], go).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.size(lengths) - 1), state, step, lambda s: s["out"])


def segment_runs(runs: DataFrame, listed: DataFrame) -> DataFrame:
    """``run, words`` for distinct runs; a run without a word of several characters is left out."""
    tied = blocks(lattice(runs, dictionary_costs(listed))).withColumn("u", unknown_cost(listed.agg(F.sum("f")).scalar()))
    best = tied.withColumn("len", cheapest_words(F.col("hi") - F.col("lo"), F.col("edges"), F.col("u")))
    found = best.select("run", F.transform(path(F.col("len")), lambda x: F.struct((x["at"] + F.col("lo")).alias("at"), x["len"].alias("len"))).alias("p"))
    long = found.select("run", F.filter("p", lambda x: x["len"] > 1).alias("p")).groupBy("run").agg(F.flatten(F.collect_list("p")).alias("p"))
    places = F.sequence(F.lit(0), F.length("run") - 1)
    inside = lambda i: F.exists("p", lambda x: (x["at"] <= i) & (i < x["at"] + x["len"]))
    alone = F.transform(F.filter(places, lambda i: ~inside(i)), lambda i: F.struct(i.alias("at"), F.lit(1).alias("len")))
    every = F.array_sort(F.concat("p", alone))
    return long.select("run", F.transform(every, lambda x: F.substring(F.col("run"), x["at"] + 1, x["len"])).alias("words"))


def run_words(run: str, costs: dict[str, int], longest: int, unknown: int) -> list[str]:
    """A run's words on the cheapest way, found from right to left; the longer one of equally cheap ones first."""
    n = len(run)
    best, size = [0] * (n + 1), [1] * n
    for at in range(n - 1, -1, -1):
        cheapest = costs.get(run[at], unknown) + best[at + 1]
        for k in range(2, min(longest, n - at) + 1):
            c = costs.get(run[at : at + k])
            if c is not None and c + best[at + k] <= cheapest:
                cheapest, size[at] = c + best[at + k], k
        best[at] = cheapest
    out, at = [], 0
    while at < n:
        out.append(run[at : at + size[at]])
        at += size[at]
    return out


def segmented(pieces: Column, listed: DataFrame) -> Column:
    """The tokens of an array of pieces, by a dictionary that is sent to the tasks."""
    found = dictionary_costs(listed).toArrow()
    unknown = listed.agg(unknown_cost(F.sum("f"))).first()[0]
    longest = max(pc.max(pc.utf8_length(found["word"])).as_py() or 1, 1)
    sent = listed.sparkSession.sparkContext.broadcast(dict(zip(found["word"].to_pylist(), found["cost"].to_pylist())))
    known: dict[str, list[str]] = {}

    def words(piece: str) -> list[str]:
        if len(piece) == 1 or piece[0].isascii():  # only runs of Han characters are longer otherwise
            return [piece]
        if piece not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[piece] = run_words(piece, sent.value, longest, unknown)
        return known[piece]

    def cut(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().dictionary_encode()  # every distinct piece of a batch once
        each = [words(p) for p in flat.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        of = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[of])])
        at = np.repeat((np.cumsum(sizes) - sizes)[of] - ends[:-1], sizes[of]) + np.arange(ends[-1])
        values = pa.array([w for p in each for w in p], pa.string()).take(pa.array(at))
        lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(lengths)])], pa.int32()), values)

    return F.arrow_udf(cut, "array<string>").asNondeterministic()(pieces)


def segment(df: DataFrame, words: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add the array of tokens: dictionary words, single characters, and runs of ASCII letters or digits.

    ``words`` has columns ``word, freq``. Equal texts have equal tokens; a NULL text has none.
    """
    listed = checkpoint(dictionary(words))
    if listed.count() <= MAX_WORDS:
        return df.withColumn(out, segmented(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0)), listed))
    key = F.md5(F.col(text))
    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))
    cut = df.where(F.length(text) > 0).select(key.alias("__k"), pieces.alias("p")).dropDuplicates(["__k"])
    cut = cut.select("__k", F.posexplode("p").alias("i", "piece"))
    runs = cut.where(F.length("piece") > 1).where(F.col("piece").rlike(HAN_RUN)).select(F.col("piece").alias("run")).distinct()
    known = segment_runs(runs, listed)
    plain = F.when(F.col("piece").rlike(HAN_RUN), F.split("piece", "")).otherwise(F.array("piece"))
    joined = cut.join(known, F.col("piece") == F.col("run"), "left").select("__k", "i", F.coalesce("words", plain).alias("w"))
    tokens = joined.groupBy("__k").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])).alias(out)
    )
    none = F.array().cast("array<string>")
    return df.withColumn("__k", key).join(tokens, "__k", "left").withColumn(out, F.coalesce(out, none)).drop("__k")
