"""Lexicon scoring of tokenised sentences.

A sentence's tokens stay in one array, so negation, context and attenuation are looked up
by position inside the row. The listed tokens are found in hash sets within the row, or by a join
when the lexicon, whose size is counted, is too large to send to the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.coerce import strip
from quarterline.functions.text import add_once, contains_any, count_chars, let
from quarterline.profiles import DIGIT, ZH_COUNT, ZH_TONE, CountProfile, ToneProfile


def build_lexicon(sheets: DataFrame, profile: ToneProfile = ZH_TONE) -> DataFrame:
    """Rows ``sheet, sheet_order, row, word`` to one weight per word.

    The class comes from the sheet name; a later sheet or row overwrites an earlier one.
    """
    name = F.lower("sheet")
    weight = F.lit(None).cast("int")
    for marks, value in reversed(profile.sheet_classes):
        hit = F.lit(False)
        for m in marks:
            hit = hit | name.contains(m)
        weight = F.when(hit, F.lit(value)).otherwise(weight)
    word = strip(F.col("word"))
    return (
        sheets.select(word.alias("word"), weight.alias("weight"), "sheet_order", "row")
        .where((F.col("word") != "") & (F.lower("word") != profile.header_word))
        .where("weight IS NOT NULL")
        .groupBy("word")
        .agg(F.max_by("weight", F.struct("sheet_order", "row")).alias("weight"))
    )


def supplement_lexicon(
    lexicon: DataFrame, positive: Sequence[str] = ZH_TONE.extra_positive,
    negative: Sequence[str] = ZH_TONE.extra_negative,
) -> DataFrame:
    """Add words that are missing; words already present keep their weight."""
    rows = [(w, 1) for w in positive] + [(w, -1) for w in negative]
    extra = lexicon.sparkSession.createDataFrame(rows, "word string, weight int")
    missing = extra.join(lexicon, "word", "left_anti")
    return lexicon.select("word", "weight").unionByName(missing)


def digit_share(text: Column) -> Column:
    return count_chars(text, DIGIT) / F.length(text)


def valid_unit(text: Column, tokens: Column, max_share: float = ZH_TONE.max_digit_share) -> Column:
    """1 for a scorable sentence: not NULL, not mostly digits, at least one token."""
    heavy = (F.length(text) > 0) & (digit_share(text) > max_share)
    return F.when(text.isNull() | heavy | (F.size(tokens) == 0), 0).otherwise(1)


#: Lexicons of up to so many words and distinct weights go into the plan as sets.
MAX_WORDS, MAX_WEIGHTS = 100_000, 64


def one_weight(lexicon: DataFrame) -> DataFrame:
    """One weight per word; of a word listed with several, the largest holds. Words without one are left out."""
    weight = F.max(F.col("weight").cast("double")).alias("weight")
    return lexicon.groupBy("word").agg(weight).where(F.col("weight").isNotNull())


def weight_sets(lexicon: DataFrame) -> list[tuple[float, list[str]]] | None:
    """The words of each weight, or None if there are too many of either to send to the tasks."""
    words = one_weight(lexicon).where(F.col("word").isNotNull()).limit(MAX_WORDS + 1).collect()
    groups: dict[float, list[str]] = {}
    for r in words:
        groups.setdefault(r["weight"], []).append(r["word"])
    if len(words) > MAX_WORDS or len(groups) > MAX_WEIGHTS:
        return None
    return sorted(groups.items())


def with_hits(df: DataFrame, lexicon: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add ``hits``: an array of ``(pos, word, weight)`` for the listed tokens.

    Words of each weight are looked up in a hash set inside the row, without a shuffle. A lexicon
    too large for that (its size is counted) is joined: hits depend on the tokens alone, so each
    distinct token array is looked up once. Both ways give the same rows. A row without tokens
    (NULL) has no hits (NULL).
    """
    sets = weight_sets(lexicon)
    if sets is None:
        return with_joined_hits(df, lexicon, tokens)
    none = F.array().cast("array<struct<pos:int,word:string,weight:double>>")
    if not sets:
        return df.withColumn("hits", F.when(F.col(tokens).isNotNull(), none))

    def hit(word: Column, pos: Column) -> Column:
        weight = F.coalesce(*[F.when(word.isin(words), F.lit(w)) for w, words in sets])
        return F.struct(pos.cast("int").alias("pos"), word.alias("word"), weight.alias("weight"))

    found = F.filter(F.transform(F.col(tokens), hit), lambda x: x["weight"].isNotNull())
    return add_once(df, {"hits": found})


def with_joined_hits(df: DataFrame, lexicon: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``with_hits`` by a join, for lexicons of any size; rows find their hits by a digest of their tokens."""
    key = F.sha1(F.to_json(F.struct(tokens)))
    listed = (
        df.select(key.alias("__k"), tokens)
        .dropDuplicates(["__k"])
        .select("__k", F.posexplode(tokens).alias("pos", "word"))
        .join(one_weight(lexicon), "word")
        .groupBy("__k")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word", "weight"))).alias("__h"))
    )
    none = F.array().cast("array<struct<pos:int,word:string,weight:double>>")
    found = F.when(F.col(tokens).isNotNull(), F.coalesce("__h", none))
    return df.withColumn("__k", key).join(listed, "__k", "left").withColumn("hits", found).drop("__k", "__h")


def anchors(hits: str = "hits") -> Column:
    """The hits with ``prev``, the position of the listed token before, or -1."""
    before = lambda h, k: F.when(k > 0, F.get(h, k - 1)["pos"]).otherwise(F.lit(-1))
    return let(
        F.col(hits), lambda h: F.transform(h, lambda a, k: a.withField("prev", before(h, k)))
    )


def _window(tokens: Column, start: Column, stop: Column) -> Column:
    """Tokens at positions start (inclusive) to stop (exclusive), 0-based."""
    start = F.greatest(start, F.lit(0))
    return F.slice(tokens, start + 1, F.greatest(stop - start, F.lit(0)))


def topic_weight(anchor: Column, on_topic: Column, p: ToneProfile) -> Column:
    """In a price sentence listed rises count -1 and listed falls +1."""
    return (
        F.when(on_topic & anchor["word"].isin(*p.price_bad), F.lit(-1.0))
        .when(on_topic & anchor["word"].isin(*p.price_good), F.lit(1.0))
        .otherwise(anchor["weight"])
    )


def context_weight(anchor: Column, weight: Column, tokens: Column, p: ToneProfile) -> Column:
    """A positive rise word after a bad-context word (by substring) counts -1."""
    near = _window(tokens, anchor["pos"] - p.context_window, anchor["pos"])
    bad = F.exists(near, lambda w: contains_any(w, p.bad_context))
    return F.when((weight == 1) & anchor["word"].isin(*p.volume_up) & bad, F.lit(-1.0)).otherwise(weight)


def attenuated_weight(anchor: Column, weight: Column, tokens: Column, p: ToneProfile) -> Column:
    """A negative word near an improvement word keeps half its weight."""
    pos = anchor["pos"]
    near = F.concat(
        _window(tokens, pos + 1, pos + 1 + p.improve_window),
        _window(tokens, pos - p.improve_window, pos),
    )
    better = F.exists(near, lambda w: w.isin(*p.improvers))
    return F.when((weight < 0) & better, weight * p.attenuation).otherwise(weight)


def negation_count(anchor: Column, tokens: Column, p: ToneProfile) -> Column:
    """Negators between the previous anchor and this one, at most the window back."""
    start = F.greatest(anchor["prev"] + 1, anchor["pos"] - p.negation_window)
    return F.size(F.filter(_window(tokens, start, anchor["pos"]), lambda w: w.isin(*p.negators)))


def scored_anchors(p: ToneProfile, tokens: str = "tokens", anchors_col: str = "anchors") -> Column:
    """Anchors with each step's weight: ``topic, context, attenuated, negations, final``."""

    def score(a: Column, toks: Column, on_topic: Column) -> Column:
        def steps(topic: Column, context: Column, softened: Column, n: Column) -> Column:
            return F.struct(
                a["pos"].alias("pos"),
                a["word"].alias("word"),
                a["weight"].alias("weight"),
                topic.alias("topic"),
                context.alias("context"),
                softened.alias("attenuated"),
                n.alias("negations"),
                F.when(n % 2 == 1, -softened).otherwise(softened).alias("final"),
            )

        return let(
            topic_weight(a, on_topic, p),
            lambda topic: let(
                context_weight(a, topic, toks, p),
                lambda context: let(
                    attenuated_weight(a, context, toks, p),
                    lambda soft: let(
                        negation_count(a, toks, p), lambda n: steps(topic, context, soft, n)
                    ),
                ),
            ),
        )

    def sentence(x: Column) -> Column:
        topical = F.exists(x["toks"], lambda w: w.isin(*p.price_topic))
        return let(
            topical,
            lambda on: F.transform(x["hits"], lambda a: score(a, x["toks"], on)),
        )

    return let(F.struct(F.col(tokens).alias("toks"), F.col(anchors_col).alias("hits")), sentence)


def dict_tone(
    df: DataFrame, lexicon: DataFrame, profile: ToneProfile = ZH_TONE
) -> DataFrame:
    """Add ``scored`` (anchors with weights), ``dict_tone`` and ``is_valid_unit``."""
    df = with_hits(df, lexicon).withColumn("anchors", anchors())
    df = add_once(df.drop("hits"), {"scored": scored_anchors(profile)})
    total = F.aggregate("scored", F.lit(0.0), lambda acc, a: acc + a["final"])
    valid = valid_unit(F.col("text"), F.col("tokens"), profile.max_digit_share)
    tone = F.when((valid == 1) & (F.size("scored") > 0), total / F.size("tokens")).otherwise(0.0)
    return add_once(df.drop("anchors"), {"dict_tone": tone, "is_valid_unit": valid})


def pos_neg_net(
    df: DataFrame,
    positive: Sequence[str],
    negative: Sequence[str],
    profile: CountProfile = ZH_COUNT,
) -> DataFrame:
    """Add ``Pos``, ``Neg``, ``Neg_net`` and ``is_numeric`` from ``text`` and ``tokens``.

    A listed token right after a negator counts for the other side; each reversal phrase
    in the text adds one positive; shares are over tokens that are not stopwords.
    """
    paired = let(
        F.transform("tokens", strip),
        lambda ws: F.transform(
            ws, lambda w, i: F.struct(w.alias("w"), F.get(ws, i - 1).alias("before"))
        ),
    )
    counted = F.filter(
        paired, lambda x: (x["w"] != "") & ~x["w"].isin(*profile.stopwords)
    )
    df = add_once(df, {"__c": counted})

    def count_side(is_positive_side: bool) -> Column:
        def hit(x: Column) -> Column:
            negated = F.coalesce(x["before"].isin(*profile.negators), F.lit(False))
            up = x["w"].isin(list(positive))
            down = ~up & x["w"].isin(list(negative))  # on both lists: positive
            same, other = (up, down) if is_positive_side else (down, up)
            return (same & ~negated) | (other & negated)

        return F.size(F.filter("__c", hit))

    text = strip(F.col("text"))
    bonus = F.lit(0)
    for phrase in profile.reversal_phrases:
        bonus = bonus + F.when(text.contains(phrase), 1).otherwise(0)
    total = F.greatest(F.size("__c"), F.lit(1))
    pos = (count_side(True) + bonus) / total
    neg = count_side(False) / total
    empty = F.coalesce((text == "") | (F.size("tokens") == 0), F.lit(True))
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "Pos": F.when(empty, zero).otherwise(pos),
            "Neg": F.when(empty, zero).otherwise(neg),
            "is_numeric": F.when(
                ~empty & (count_chars(text, DIGIT) / F.length(text) > profile.numeric_share), 1
            ).otherwise(0),
        }
    )
    return df.withColumn("Neg_net", F.col("Neg") - F.col("Pos")).drop("__c")


def mean_by_period(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("year", "quarter")
) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def extreme_rows(df: DataFrame, column: str, ident: str, k: int = 3) -> DataFrame:
    """The k lowest and k highest rows; ties by id."""
    low = df.orderBy(column, ident).limit(k).withColumn("side", F.lit("lowest"))
    high = df.orderBy(F.desc(column), ident).limit(k).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def nonzero_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column) != 0).alias("nonzero"), F.count("*").alias("rows"))
