"""Paged documents to clean, numbered sentences.

Everything stays in long form (page, line, sentence rows). No report or section is ever
assembled into one string: a sentence that runs over lines or pages is put together from
its pieces, found through a running count of sentence ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.functions import text as tx
from quarterline.functions.ranks import ordered_offsets, running_last, running_sum
from quarterline.profiles import ZH, TextProfile
from quarterline.session import checkpoint

PAGE_CHUNK = 256


def _normal_lines(column: str = "text"):
    lines = F.transform(tx.lines_of(F.coalesce(F.col(column), F.lit(""))), tx.normalize_line)
    return F.filter(lines, lambda x: x != "")


def drop_toc_pages(pages: DataFrame, profile: TextProfile = ZH) -> DataFrame:
    return pages.where(~tx.is_toc_page(F.col("text"), profile))


def repeated_lines(pages: DataFrame, profile: TextProfile = ZH) -> DataFrame:
    """Header and footer lines per report: ``report_id, line, n``.

    Candidates are the first and last two lines of each page. With a share of one half at
    most eight lines per report can qualify.
    """
    lines = _normal_lines()
    last = F.slice(F.col("l"), F.greatest(F.size("l") - 1, F.lit(1)), 2)
    edges = F.when(F.size("l") > 0, F.concat(F.slice("l", 1, 2), last))
    counts = (
        pages.select("report_id", lines.alias("l"))
        .select("report_id", F.explode(edges).alias("line"))
        .where(F.length("line").between(2, 50) & ~F.col("line").rlike(profile.heading))
        .groupBy("report_id", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= profile.repeat_floor)
    )
    totals = pages.groupBy("report_id").agg(F.count("*").alias("pages"))
    needed = F.greatest(
        F.lit(profile.repeat_floor), F.floor(F.lit(profile.repeat_share) * F.col("pages"))
    )
    return (
        counts.join(totals.where(F.col("pages") > profile.min_pages), "report_id")
        .where(F.col("n") >= needed)
        .select("report_id", "line", "n")
    )


def clean_pages(pages: DataFrame, profile: TextProfile = ZH) -> DataFrame:
    """Pages with an array ``lines``: normalised, without headers, footers, page numbers,
    contents pages and pages that end up empty."""
    banned = (
        repeated_lines(pages, profile)
        .groupBy("report_id")
        .agg(F.collect_set("line").alias("banned"))
    )
    none = F.array().cast("array<string>")
    kept = F.filter(
        F.col("normal"),
        lambda x: ~F.array_contains(F.coalesce("banned", none), x) & ~tx.is_page_number(x),
    )
    body = drop_toc_pages(pages, profile).select(
        "report_id", "page_no", _normal_lines().alias("normal")
    )
    body = tx.add_once(body.join(banned, "report_id", "left"), {"lines": kept})
    return body.where(F.size("lines") > 0).select("report_id", "page_no", "lines")


def body_lines(clean: DataFrame) -> DataFrame:
    """One row per line in reading order: ``report_id, page_no, line_no, line``."""
    return clean.select(
        "report_id", "page_no", F.posexplode("lines").alias("line_no", "line")
    )


def section_lines(
    lines: DataFrame, profile: TextProfile = ZH, drop_line=tx.drop_section_line
) -> DataFrame:
    """Give every line its section and drop lines that are not prose.

    A part heading, wherever it stands in a line, starts a section that lasts to the next
    heading; a repeated heading continues its section under the first title. Lines before
    the first heading are dropped. A report without headings is one section ``S_all``,
    left uncleaned.
    """
    at = F.regexp_instr("line", F.lit(profile.heading))
    title = tx.normalize_line(F.expr("substring(line, at)"))
    key = F.coalesce(*[F.when(F.col("title").contains(k), F.lit(v)) for k, v in profile.section_keys])
    found = lines.withColumn("at", at).withColumn("title", F.when(F.col("at") > 0, title))
    found = found.withColumn("head", F.when(F.col("at") > 0, F.struct(key.alias("section"), "title")))
    # text before a heading in the same line still belongs to the section above
    found = running_last(
        found, ["report_id"], "page_no", F.col("head"), "above", ["line_no"], PAGE_CHUNK, False
    )
    before = F.when(F.col("at") > 0, F.expr("substring(line, 1, at - 1)")).otherwise(F.col("line"))
    heads = found.where("head IS NOT NULL")
    names = heads.groupBy("report_id", F.col("head.section").alias("section")).agg(
        F.min_by("title", F.struct("page_no", "line_no")).alias("section_title"),
        F.min(F.struct("page_no", "line_no")).alias("first"),
    )
    rank = F.row_number().over(W.partitionBy("report_id").orderBy("first"))
    names = names.withColumn("section_rank", rank).drop("first")
    headed = heads.select("report_id").distinct().withColumn("headed", F.lit(True))
    placed = found.select(
        "report_id", "page_no", "line_no", F.col("above.section").alias("section"), before.alias("raw")
    )
    placed = placed.join(headed, "report_id", "left").withColumn(
        "section", F.when(F.col("headed"), F.col("section")).otherwise(F.lit("S_all"))
    )
    line = tx.normalize_line(F.col("raw"))
    whole = F.col("section") == "S_all"
    placed = placed.where("section IS NOT NULL")
    placed = tx.add_once(placed, {"line": F.when(whole, F.col("raw")).otherwise(line)})
    placed = placed.where(whole | ~drop_line(F.col("line"), profile))
    return placed.join(names, ["report_id", "section"], "left").select(
        "report_id",
        "section",
        F.coalesce("section_title", "section").alias("section_title"),
        F.coalesce("section_rank", F.lit(1)).alias("section_rank"),
        "page_no",
        "line_no",
        "line",
    )


def split_sentences(
    lines: DataFrame, profile: TextProfile = ZH, postprocess: bool = True
) -> DataFrame:
    """Section lines to sentences: ``report_id, section, section_title, section_rank,
    sentence_no, text``. The mark stays with its sentence; lines join with one space."""
    marks = f"[{profile.sentence_end}]"
    section = ["report_id", "section", "section_title", "section_rank"]
    plain = F.regexp_replace(tx.flat(F.col("line")), " {2,}", " ")
    counted = running_sum(
        lines.withColumn("line", plain),
        section,
        "page_no",
        tx.count_of(F.col("line"), marks),
        "ends",
        ["line_no"],
        chunk=PAGE_CHUNK,
    )
    base = F.col("ends") - tx.count_of(F.col("line"), marks)
    parts = F.split("line", f"(?<={marks})")
    pieces = counted.select(
        *section, "page_no", "line_no", base.alias("base"), F.posexplode(parts).alias("i", "piece")
    ).where("piece <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "line_no", "i", "piece")))
    joined = F.array_join(F.transform("p", lambda x: x["piece"]), " ")
    whole = (
        pieces.groupBy(*section, (F.col("base") + F.col("i")).alias("sentence_no"))
        .agg(ordered.alias("p"))
        .withColumn("text", joined)
    )
    raw = F.col("joined")
    clean = tx.clean_sentence(raw) if postprocess else tx.strip(raw)
    cleaned = tx.add_once(whole.withColumnRenamed("text", "joined"), {"text": clean})
    return cleaned.where(F.length("text") >= profile.min_sentence).select(
        *section, "sentence_no", "text"
    )


def with_noise_reason(sentences: DataFrame, profile: TextProfile = ZH) -> DataFrame:
    return tx.add_once(sentences, {"reason": tx.noise_reason(F.col("text"), profile)})


def noise_report(sentences: DataFrame, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped counts per report, and the most frequent reasons per report."""
    counts = sentences.groupBy("report_id", "reason").agg(F.count("*").alias("n"))
    kept = F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0))
    dropped = F.sum(F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0))
    totals = counts.groupBy("report_id").agg(
        F.sum("n").alias("total"), kept.alias("kept"), dropped.alias("dropped")
    )
    order = W.partitionBy("report_id").orderBy(F.desc("n"), "reason")
    reasons = (
        counts.where("reason IS NOT NULL")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    return totals, reasons


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sd, min, quartiles and max of a column with one row per period."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.percentile(c, 0.25).alias("q25"),
        F.percentile(c, 0.50).alias("q50"),
        F.percentile(c, 0.75).alias("q75"),
        F.max(c).alias("max"),
    )


def number_sentences(
    sentences: DataFrame, order: str = "sentence_no", major: tuple[str, ...] = ("section_rank",)
) -> DataFrame:
    """Add ``sent_id_in_report`` (1-based in section and sentence order) and the global
    ``id`` (reports in order of their id)."""
    numbered = running_sum(
        sentences, ["report_id"], order, F.lit(1), "sent_id_in_report", major=major
    )
    sizes = sentences.groupBy("report_id").agg(F.count("*").alias("size"))
    offsets = ordered_offsets(sizes, "report_id", F.col("size"), "offset")
    return (
        numbered.join(offsets.select("report_id", "offset"), "report_id")
        .withColumn("id", F.col("offset") + F.col("sent_id_in_report"))
        .drop("offset")
    )


def report_sentences(pages: DataFrame, profile: TextProfile = ZH) -> DataFrame:
    """Pages to kept, numbered sentences.

    Each stage reads its input more than once (totals, then rows), so the costly ones are
    checkpointed in between.
    """
    lines = checkpoint(body_lines(clean_pages(pages, profile)))
    lines = checkpoint(section_lines(lines, profile))
    scored = with_noise_reason(split_sentences(lines, profile), profile)
    return number_sentences(checkpoint(scored.where("reason IS NULL").drop("reason")))
