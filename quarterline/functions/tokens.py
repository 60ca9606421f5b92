"""Word lists from text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.coerce import strip
from quarterline.session import checkpoint

#: So many of the most frequent words are sent to the tasks; the others' weights are joined by a shuffle.
HEAD_WORDS = 1_000_000

# ---- Fixed values: tokens the similarity operators ignore ---------------------------
NUMBER_TOKEN = r"^\p{Nd}+(\.\p{Nd}+)?$"
PUNCTUATION_TOKEN = r"^[^\p{L}\p{N}]+$"


def latin_tokens(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def collect_words(words: DataFrame, column: str = "word") -> list[str]:
    """A dictionary as a list on the driver, for ``segmenter``."""
    return [r[0] for r in words.select(column).where(F.col(column).isNotNull()).distinct().collect()]


def _folded(words: Sequence[str]) -> str:
    """A pattern for any of the words, common beginnings folded, longest match first."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [re.sub(r"[^\w]", r"\\\g<0>", ch) + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return f"{body}?" if "" in node else body

    return pattern(tree)


def segmenter(words: Sequence[str]):
    """Forward maximum matching over a word list, as a column function.

    At each position the longest listed word is taken, else a run of ASCII letters or
    digits, else one character.
    """
    known = sorted({w for w in words if w and len(w) > 1})
    pattern = "(?s)" + "|".join([*([_folded(known)] if known else []), "[A-Za-z]+", "[0-9]+", "."])

    def segment(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

    return segment


def keep_token(token: Column) -> Column:
    """Neither blank, number nor punctuation."""
    return _keep_stripped(strip(token))


def _keep_stripped(t: Column) -> Column:
    return (t != "") & ~t.rlike(NUMBER_TOKEN) & ~t.rlike(PUNCTUATION_TOKEN)


def explode_tokens(df: DataFrame, keep: Sequence[str], tokens: str = "tokens") -> DataFrame:
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def filter_tokens(tokens: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """Drop blanks, numbers, punctuation and stopwords from exploded tokens.

    Stopwords are counted: up to HEAD_WORDS are sent to the tasks, so that no token is moved; a longer
    list is joined by a shuffle.
    """
    out = tokens.withColumn("token", strip(F.col("token"))).where(_keep_stripped(F.col("token")))
    if stopwords is None:
        return out
    listed = stopwords.select(F.col("word").alias("token"))
    listed = F.broadcast(listed) if listed.limit(HEAD_WORDS + 1).count() <= HEAD_WORDS else listed
    return out.join(listed, "token", "left_anti")


def array_key(tokens: str) -> Column:
    """A digest of 16 bytes; equal token arrays have equal ones."""
    return F.unhex(F.md5(F.concat_ws("\u0001", F.size(tokens).cast("string"), F.col(tokens)).cast("binary")))


def token_sums(
    rows: DataFrame, weights: DataFrame, columns: Sequence[str], key: str, tokens: str, head: int = HEAD_WORDS
) -> DataFrame:
    """Per key the sums of its tokens' decimal weights ``columns``; rows of one key have the same tokens.

    ``weights`` has a row per ``token`` with its frequency ``n``. The ``head`` most frequent words are
    looked up where the rows are, so that a row's tokens become one sum before the shuffle; only
    tokens outside the head are moved to their weights. Copies of a key are summed
    like all rows and divided out, which is exact. Unknown tokens weigh nothing.
    """
    weights = weights.where(F.col("token").isNotNull())
    whole = weights.count() <= head
    top = weights if whole else checkpoint(weights.orderBy(F.desc("n"), "token").limit(head))
    each = rows.select(key, F.posexplode(tokens).alias("__pos", "token"))
    sums = [F.sum(c).cast("decimal(38,9)").alias(c) for c in columns]
    copies = F.count_if(F.col("__pos") == 0).alias("__copies")
    known = F.broadcast(top.select("token", *columns))
    total = each.join(known, "token", "left").groupBy(key).agg(*sums, copies)
    if not whole:
        rest = weights.join(F.broadcast(top.select("token")), "token", "left_anti").select("token", *columns)
        rare = each.join(F.broadcast(top.select("token")), "token", "left_anti").join(rest, "token")
        rare = rare.groupBy(key).agg(*sums).withColumn("__copies", F.lit(0).cast("bigint"))
        total = total.unionByName(rare).groupBy(key).agg(*sums, F.sum("__copies").alias("__copies"))
    # eight digits less than the most, so that adding a prior keeps all nine decimals
    return total.select(key, *[(F.col(c) / F.col("__copies")).cast("decimal(30,9)").alias(c) for c in columns])
