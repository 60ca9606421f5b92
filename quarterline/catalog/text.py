"""Pages to sentences."""

from pyspark.sql import functions as F

from quarterline.catalog.base import (
    DIGITS, ND, NOT_SP, SENTENCES, SP, count_sql, lines_sql, normal_sql, query, r6, sentences,
    strip_sql, table, texts,
)
from quarterline.functions import text as tx
from quarterline.operators import textprep as tp
from quarterline.profiles import LATIN

# ---- reports: one per document source, one page per document ------------------------------
# Decorations put contents pages, headers, footers, page numbers and dot leaders into the text.
LEADERS = "\n".join(f"Item {i} ........ {i}" for i in range(1, 13))


def report_pages(spark, sf):
    i = F.col("doc_id")
    body = (
        F.when(i % 9 == 0, F.concat(F.lit("Contents\nPart One\n"), "text"))
        .when(i % 9 == 1, F.concat(F.lit(LEADERS + "\n"), "text"))
        .when(i % 9 == 2, F.concat(F.lit(LEADERS + "\nPart One Part Two Part Three\n"), "text"))
        .when(i % 9 == 3, F.concat(F.lit("..... 12 "), "text", F.lit(" ....... 7")))
        .when(i % 9 == 4, F.concat("text", F.lit("\nXIV\n "), i.cast("string"), F.lit(" \nPage 3")))
        .otherwise(F.col("text"))
    )
    headed = F.when(i % 5 != 0, F.concat(F.lit("Report "), "source", F.lit("\n"), body)).otherwise(body)
    return texts(spark, sf, "documents", "doc_id", "source", "text").select(
        F.col("source").alias("report_id"), i.alias("page_no"), headed.alias("text")
    )


_LEAD = LEADERS.replace("\n", "' || chr(10) || '")
PAGES = f"""
bodies AS (
  SELECT source, doc_id, CASE doc_id % 9
    WHEN 0 THEN 'Contents' || chr(10) || 'Part One' || chr(10) || text
    WHEN 1 THEN '{_LEAD}' || chr(10) || text
    WHEN 2 THEN '{_LEAD}' || chr(10) || 'Part One Part Two Part Three' || chr(10) || text
    WHEN 3 THEN '..... 12 ' || text || ' ....... 7'
    WHEN 4 THEN text || chr(10) || 'XIV' || chr(10) || ' ' || doc_id || ' ' || chr(10) || 'Page 3'
    ELSE text END AS body FROM documents),
pages_ AS (
  SELECT source AS report_id, doc_id AS page_no,
         CASE WHEN doc_id % 5 <> 0 THEN 'Report ' || source || chr(10) || body ELSE body END AS text
  FROM bodies)"""

_HEAD = "Part (?:One|Two|Three)"
TOC = rf"""
filled AS (
  SELECT *, substr(text, 1, 800) AS head,
         list_filter(list_transform({lines_sql('text')}, lambda x: {strip_sql('x')}), lambda x: x <> '') AS ls
  FROM pages_),
lead AS (
  SELECT *, len(list_filter(ls, lambda x: regexp_matches(x, '(\.{{4,}}|…{{2,}}){SP}*{ND}+{SP}*$'))) AS k FROM filled),
toc AS (
  SELECT report_id, page_no, text,
         ((contains(head, 'Contents') OR contains(head, 'CONTENTS')) AND regexp_matches(head, '{_HEAD}'))
         OR (len(ls) >= 12 AND ((k >= 8 AND k / greatest(len(ls), 1) >= 0.25)
             OR ({count_sql('head', _HEAD)} >= 3 AND k >= 4))) AS is_toc
  FROM lead)"""

NORMAL = f"""
normal AS (
  SELECT report_id, page_no, is_toc,
         list_filter(list_transform({lines_sql('text')}, lambda x: {normal_sql('x')}), lambda x: x <> '') AS ls
  FROM toc)"""

BANNED = f"""
edges AS (
  SELECT report_id, unnest(list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):len(ls)])) AS line FROM normal WHERE len(ls) > 0),
totals AS (SELECT report_id, count(*) AS n_pages FROM normal GROUP BY report_id),
banned AS (
  SELECT e.report_id, line, count(*) AS n FROM edges e JOIN totals t ON t.report_id = e.report_id
  WHERE n_pages > 3 AND length(line) BETWEEN 2 AND 50 AND NOT regexp_matches(line, '{_HEAD}')
  GROUP BY e.report_id, line, n_pages HAVING count(*) >= greatest(3, floor(0.5 * n_pages)))"""

CLEAN = rf"""
exploded AS (
  SELECT report_id, page_no, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM normal WHERE NOT is_toc),
kept AS (
  SELECT x.report_id, x.page_no, x.line, i FROM exploded x
  LEFT JOIN banned b ON b.report_id = x.report_id AND b.line = x.line
  WHERE b.line IS NULL AND NOT regexp_matches(x.line, '^(?:[IVX]{{1,8}}|{ND}{{1,4}})$')),
body AS (
  SELECT report_id, page_no, CAST(row_number() OVER (PARTITION BY report_id, page_no ORDER BY i) - 1 AS INTEGER) AS line_no, line
  FROM kept)"""


@query(
    "toc_page_filter",
    f"""WITH {PAGES}, {TOC}
SELECT report_id, page_no, is_toc,
       ((contains(substr(text, 1, 300), 'Contents') OR contains(substr(text, 1, 300), 'CONTENTS'))
        AND regexp_matches(substr(text, 1, 300), '{_HEAD}')) AS is_toc_simple FROM toc""",
)
def toc_page_filter(spark, sf):
    return report_pages(spark, sf).select(
        "report_id",
        "page_no",
        tx.is_toc_page(F.col("text"), LATIN).alias("is_toc"),
        tx.is_toc_page_simple(F.col("text"), LATIN).alias("is_toc_simple"),
    )


@query(
    "normalize_line",
    f"""WITH {PAGES},
l AS (SELECT page_no, unnest({lines_sql('text')}) AS raw, generate_subscripts({lines_sql('text')}, 1) - 1 AS line_no FROM pages_)
SELECT page_no, CAST(line_no AS INTEGER) AS line_no, {normal_sql('raw')} AS line FROM l""",
)
def normalize_line(spark, sf):
    pages = report_pages(spark, sf)
    lines = pages.select("page_no", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "raw"))
    return lines.select("page_no", "line_no", tx.normalize_line(F.col("raw")).alias("line"))


@query(
    "repeated_header_footer",
    f"WITH {PAGES}, {TOC}, {NORMAL}, {BANNED} SELECT report_id, line, n FROM banned",
)
def repeated_header_footer(spark, sf):
    return tp.repeated_lines(report_pages(spark, sf), LATIN)


@query(
    "clean_page_text",
    f"WITH {PAGES}, {TOC}, {NORMAL}, {BANNED}, {CLEAN} SELECT * FROM body",
)
def clean_page_text(spark, sf):
    return tp.body_lines(tp.clean_pages(report_pages(spark, sf), LATIN))


# ---- sectioned reports: one per conversation, one page per turn -----------------------------
PART = {"system": "One", "user": "Two", "assistant": "Three"}


def sectioned_lines(spark, sf):
    turns = table(spark, sf, "conversations")
    part = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in PART.items()])
    heading = F.concat(F.lit("Part "), part, F.lit(" of "), "role")
    t, c = F.col("turn"), F.col("conv_id")
    text = (
        F.when((c % 10 == 0) | (t % 4 == 3), F.col("text"))
        .when(t == 0, F.concat(F.lit("Opening words\n"), heading, F.lit("\n"), "text"))
        .when(t % 4 == 1, F.concat(F.lit("tail before "), heading, F.lit("\nTable 3\n"), "text"))
        .otherwise(F.concat(heading, F.lit("\n(a) short entry\nSource: none\n"), "text"))
    )
    parts = F.split(text, "\n")
    return turns.select(
        c.alias("report_id"), t.alias("page_no"), F.posexplode(parts).alias("line_no", "line")
    )


_STOP = "(contains(x, '.') OR contains(x, ':'))"
_CLAUSE = "(contains(x, '.') OR contains(x, ':') OR contains(x, ';'))"


def drop_line_sql(x: str) -> str:
    return rf"""({x} = '' OR regexp_matches({x}, '^(?:[IVX]{{1,8}}|{ND}{{1,4}})$') OR regexp_matches({x}, '^{_HEAD}')
   OR (regexp_matches({x}, '^[IVX]+\.') AND NOT {_CLAUSE.replace('x,', x + ',')})
   OR (regexp_matches({x}, '^\([a-z]\)') AND NOT {_CLAUSE.replace('x,', x + ',')} AND length({x}) <= 30)
   OR ({count_sql(x, '[.…]')} >= 6 AND NOT {_STOP.replace('x,', x + ',')})
   OR (regexp_matches({x}, '^(Table|Figure|Box){SP}*{ND}+') AND length({x}) <= 120)
   OR (regexp_matches({x}, '^(Source|Note){SP}*:') AND length({x}) <= 120)
   OR ((contains({x}, 'Table') OR contains({x}, 'Figure') OR contains({x}, 'Box')) AND NOT {_STOP.replace('x,', x + ',')} AND length({x}) <= 60))"""


SECTIONED = f"""
turns AS (
  SELECT conv_id, turn, text, 'Part ' || CASE role WHEN 'system' THEN 'One' WHEN 'user' THEN 'Two' ELSE 'Three' END || ' of ' || role AS heading
  FROM conversations),
texts AS (
  SELECT conv_id AS report_id, turn AS page_no, CASE
    WHEN conv_id % 10 = 0 OR turn % 4 = 3 THEN text
    WHEN turn = 0 THEN 'Opening words' || chr(10) || heading || chr(10) || text
    WHEN turn % 4 = 1 THEN 'tail before ' || heading || chr(10) || 'Table 3' || chr(10) || text
    ELSE heading || chr(10) || '(a) short entry' || chr(10) || 'Source: none' || chr(10) || text END AS text
  FROM turns),
slines AS (
  SELECT report_id, page_no, unnest(string_split(text, chr(10))) AS line,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM texts),
heads AS (
  SELECT *, regexp_extract(line, '{_HEAD}.*') AS head FROM slines),
titled AS (
  SELECT *, CASE WHEN head <> '' THEN {normal_sql('head')} END AS title,
         CASE WHEN contains(head, 'Part One') THEN 'S1' WHEN contains(head, 'Part Two') THEN 'S2'
              WHEN contains(head, 'Part Three') THEN 'S3' END AS key FROM heads),
placed AS (
  SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
         count(key) OVER (PARTITION BY report_id) AS headed,
         CASE WHEN head <> '' THEN substr(line, 1, length(line) - length(head)) ELSE line END AS raw FROM titled),
names AS (
  SELECT report_id, key, arg_min(title, page_no * 10000 + line_no) AS section_title, min(page_no * 10000 + line_no) AS first
  FROM titled WHERE key IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY first) AS section_rank FROM names),
cleaned AS (
  SELECT report_id, CASE WHEN headed > 0 THEN above ELSE 'S_all' END AS section, page_no, line_no,
         CASE WHEN headed > 0 THEN {normal_sql('raw')} ELSE raw END AS line FROM placed),
section_lines AS (
  SELECT c.report_id, section, coalesce(section_title, section) AS section_title,
         CAST(coalesce(section_rank, 1) AS INTEGER) AS section_rank, page_no, line_no, line
  FROM cleaned c LEFT JOIN ranked r ON r.report_id = c.report_id AND r.key = c.section
  WHERE section IS NOT NULL AND (section = 'S_all' OR NOT {drop_line_sql('line')}))"""


@query("split_sections", f"WITH {SECTIONED} SELECT * FROM section_lines")
def split_sections(spark, sf):
    return tp.section_lines(sectioned_lines(spark, sf), LATIN)


@query(
    "clean_section_lines",
    f"""WITH {PAGES},
l AS (SELECT page_no, unnest({lines_sql('text')}) AS raw, generate_subscripts({lines_sql('text')}, 1) - 1 AS line_no FROM pages_),
n AS (SELECT page_no, CAST(line_no AS INTEGER) AS line_no, {normal_sql('raw')} AS line FROM l)
SELECT page_no, line_no, line FROM n WHERE NOT {drop_line_sql('line')}""",
)
def clean_section_lines(spark, sf):
    pages = report_pages(spark, sf)
    lines = pages.select("page_no", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "raw"))
    clean = lines.select("page_no", "line_no", tx.normalize_line(F.col("raw")).alias("line"))
    return clean.where(~tx.drop_section_line(F.col("line"), LATIN))


def source_lines(spark, sf):
    """Every source is one section whose lines run over its documents."""
    parts = F.split("text", "\n")
    return texts(spark, sf, "documents", "doc_id", "source", "text").select(
        F.col("source").alias("report_id"),
        F.lit("S1").alias("section"),
        F.lit("S1").alias("section_title"),
        F.lit(1).alias("section_rank"),
        F.col("doc_id").alias("page_no"),
        F.posexplode(parts).alias("line_no", "line"),
    )


@query(
    "split_sentences",
    f"""
WITH whole AS (
  SELECT source AS report_id, regexp_replace(string_agg(text, ' ' ORDER BY doc_id), '{SP}+', ' ', 'g') AS t
  FROM documents GROUP BY source),
s AS (
  SELECT report_id, unnest(regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$')) AS raw,
         generate_subscripts(regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$'), 1) - 1 AS sentence_no FROM whole),
n AS (SELECT report_id, sentence_no, {normal_sql('raw')} AS text FROM s)
SELECT report_id, sentence_no, text FROM n WHERE length(text) >= 3""",
)
def split_sentences(spark, sf):
    out = tp.split_sentences(source_lines(spark, sf), LATIN)
    return out.select("report_id", "sentence_no", "text")


# ---- sentences carrying captions and references -----------------------------------------
def captioned(spark, sf):
    i = F.col("id")
    front = (
        F.when(i % 8 == 0, F.concat(F.lit("图 3 "), (1990 + i % 40).cast("string"), F.lit("年 ")))
        .when(i % 8 == 1, F.lit("IV 专栏 2 展望 "))
        .when(i % 8 == 2, F.lit("如 图 8 所示 (图 1) "))
        .when(i % 8 == 3, F.lit("见 图 8 参见表 3 "))
        .when(i % 8 == 4, F.lit("注 ： "))
        .when(i % 8 == 5, F.lit("表 7 "))
        .when(i % 8 == 6, F.lit("1 2 3 4 5 6 7 8 "))
        .otherwise(F.lit(""))
    )
    return sentences(spark, sf).select("id", F.concat(front, "text").alias("raw"))


CAPTIONED = (
    SENTENCES
    + """,
captioned AS (
  SELECT id, CASE id % 8 WHEN 0 THEN concat('图 3 ', 1990 + id % 40, '年 ') WHEN 1 THEN 'IV 专栏 2 展望 '
    WHEN 2 THEN '如 图 8 所示 (图 1) ' WHEN 3 THEN '见 图 8 参见表 3 ' WHEN 4 THEN '注 ： '
    WHEN 5 THEN '表 7 ' WHEN 6 THEN '1 2 3 4 5 6 7 8 ' ELSE '' END || text AS raw FROM sents)"""
)


@query(
    "strip_caption",
    rf"""WITH {CAPTIONED},
t AS (SELECT id, {strip_sql('raw')} AS s FROM captioned),
p AS (SELECT *, CASE WHEN regexp_matches(s, '(?:19|20){ND}{{2}}年') THEN strpos(s, regexp_extract(s, '(?:19|20){ND}{{2}}年')) ELSE 0 END AS y,
             CASE WHEN regexp_matches(s, '展望|未来|总体来看|综合来看|总的来看|下一阶段|下一步')
                  THEN strpos(s, regexp_extract(s, '展望|未来|总体来看|综合来看|总的来看|下一阶段|下一步')) ELSE 0 END AS b FROM t)
SELECT id, CASE WHEN regexp_matches(s, '^(图|表){SP}*{ND}+') AND y > 1 AND y <= 120 THEN {strip_sql('substr(s, y)')}
  WHEN regexp_matches(s, '^[IVX]{{1,4}}{SP}*专栏|^专栏') AND b > 1 AND b <= 160 THEN {strip_sql('substr(s, b)')}
  ELSE s END AS text FROM p""",
)
def strip_caption(spark, sf):
    return captioned(spark, sf).select("id", tx.strip_caption(F.col("raw")).alias("text"))


def _post_sql(e: str) -> str:
    rules = (
        (rf"[（(]{SP}*(图|表){SP}*{ND}+{SP}*[）)]", ""),
        (rf"如{SP}*图{SP}*{ND}+{SP}*所示", "如下图所示"),
        (rf"图{SP}*{ND}+{SP}*所示", "下图所示"),
        (rf"(参见|见){SP}*图{SP}*{ND}+", r"\1下图"),
        (rf"(参见|见){SP}*表{SP}*{ND}+", r"\1下表"),
        (rf"(^|[^图])图{SP}*{ND}+", r"\1下图"),
        (rf"(^|[^表])表{SP}*{ND}+", r"\1下表"),
    )
    e = strip_sql(e)
    for pattern, to in rules:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return e


@query(
    "postprocess_sentence",
    rf"""WITH {CAPTIONED},
t AS (SELECT id, {_post_sql('raw')} AS s FROM captioned)
SELECT id, CASE WHEN regexp_matches(s, '^(数据来源|资料来源|来源|注|说明){SP}*[：:]') THEN ''
  WHEN regexp_matches(s, '^(图|表){SP}*{ND}+') AND length(s) <= 160 THEN ''
  ELSE {strip_sql(f"regexp_replace(s, '{SP}+', ' ', 'g')")} END AS text FROM t""",
)
def postprocess_sentence(spark, sf):
    return captioned(spark, sf).select("id", tx.postprocess_sentence(F.col("raw")).alias("text"))


PROFILE = f"""
prof AS (
  SELECT id, s, length(s) AS n_chars, {count_sql('s', '[a-zA-Z]')} AS n_native, {count_sql('s', DIGITS)} AS n_digits,
         {count_sql('s', NOT_SP + '+')} AS n_tokens,
         {count_sql('s', ND + '+(?:[.]' + ND + '+)?')} AS n_numbers,
         {count_sql('s', ND + '+(?:[.]' + ND + '+)?%')} AS n_percents,
         {count_sql('s', '[a-zA-Z]')} / greatest(length(s), 1) AS native_ratio,
         {count_sql('s', DIGITS)} / greatest(length(s), 1) AS digit_ratio
  FROM t)"""


@query(
    "char_class_profile",
    f"""WITH {CAPTIONED}, t AS (SELECT id, {strip_sql('raw')} AS s FROM captioned), {PROFILE}
SELECT id, CAST(n_chars AS INTEGER) AS n_chars, CAST(n_native AS INTEGER) AS n_native, CAST(n_digits AS INTEGER) AS n_digits,
       CAST(n_tokens AS INTEGER) AS n_tokens, CAST(n_numbers AS INTEGER) AS n_numbers, CAST(n_percents AS INTEGER) AS n_percents,
       round(native_ratio, 6) AS native_ratio, round(digit_ratio, 6) AS digit_ratio FROM prof""",
)
def char_class_profile(spark, sf):
    rows = tx.add_once(captioned(spark, sf), {"f": tx.char_profile(F.col("raw"), LATIN.native)})
    ratios = {
        "native_ratio": tx.share(F.col("f"), "n_native"),
        "digit_ratio": tx.share(F.col("f"), "n_digits"),
    }
    return r6(rows.withColumns(ratios).select("id", "f.*", *ratios).drop("s"))


TABLE_LIKE = rf"""
CASE WHEN s = '' THEN true
  WHEN regexp_matches(s, '^(Table|Figure){SP}*{ND}+') OR regexp_matches(s, '^(Source|Note){SP}*:') THEN true
  WHEN regexp_matches(s, '^Unit{SP}*:') THEN true
  WHEN n_tokens <= 10 AND regexp_matches(s, '(the|of|and|de|la|der|que)') AND regexp_matches(s, '[,.;:]') THEN false
  WHEN NOT (native_ratio >= 0.65 AND n_tokens <= 8) AND (
       (n_percents >= 4 AND native_ratio < 0.6)
    OR (n_numbers >= 12 AND (digit_ratio >= 0.25 OR n_tokens >= 10) AND native_ratio < 0.6)
    OR (regexp_matches(s, '^{ND}') AND n_numbers >= 8 AND (n_tokens >= 10 OR native_ratio < 0.55) AND digit_ratio >= 0.15)
    OR (n_chars >= 70 AND native_ratio < 0.30 AND (digit_ratio > 0.15 OR n_numbers >= 8))
    OR (n_chars >= 60 AND native_ratio < 0.50 AND regexp_matches(s, '[|│┃┆┊┇—–\-_=]{{3,}}'))) THEN true
  WHEN n_tokens >= 14 AND NOT regexp_matches(s, '[.!?;]') AND (regexp_matches(s, 'total|unit|item') OR digit_ratio > 0.10 OR n_numbers >= 6) THEN true
  WHEN (contains(s, 'Source') OR contains(s, 'Note')) AND n_chars >= 25 AND native_ratio < 0.65 AND n_numbers >= 6 THEN true
  ELSE false END"""


@query(
    "table_like_filter",
    f"""WITH {CAPTIONED}, t AS (SELECT id, {strip_sql('raw')} AS s FROM captioned), {PROFILE}
SELECT id, {TABLE_LIKE} AS is_table FROM prof""",
)
def table_like_filter(spark, sf):
    return captioned(spark, sf).select("id", tx.is_table_like(F.col("raw"), LATIN).alias("is_table"))


REASON = rf"""
CASE WHEN s = '' THEN 'empty' WHEN contains(s, 'Contents') OR contains(s, 'CONTENTS') THEN 'toc'
  WHEN regexp_matches(s, '\.{{6,}}|…{{4,}}') AND NOT (contains(s, '.') OR contains(s, ':')) THEN 'dotleader'
  WHEN length(s) <= 2 THEN 'short'
  WHEN regexp_matches(s, '(?i)^(?:第{SP}*{ND}+{SP}*页|Page{SP}*{ND}+)$') THEN 'pageno'
  WHEN {TABLE_LIKE} THEN 'table' END"""

REASONS = f"""{CAPTIONED},
t AS (SELECT id, {normal_sql('raw')} AS s FROM captioned), {PROFILE},
reasons AS (SELECT p.id, report_id, year, quarter, {REASON} AS reason FROM prof p JOIN sents USING (id))"""


def with_reasons(spark, sf):
    keys = sentences(spark, sf).drop("text", "lang", "doc_id", "sent_no")
    rows = captioned(spark, sf).withColumnRenamed("raw", "text").join(keys, "id")
    return tp.with_noise_reason(rows, LATIN)


@query("noise_reason", f"WITH {REASONS} SELECT id, reason FROM reasons")
def noise_reason(spark, sf):
    raw = captioned(spark, sf).withColumnRenamed("raw", "text")
    return tp.with_noise_reason(raw, LATIN).select("id", "reason")


@query(
    "noise_simple",
    f"""WITH {CAPTIONED}, t AS (SELECT id, {strip_sql('raw')} AS s FROM captioned), {PROFILE}
SELECT id, (length(s) <= 2 OR contains(s, 'Contents') OR contains(s, 'CONTENTS') OR (n_native = 0 AND n_digits > 0)
  OR (n_native > 0 AND n_digits > 0 AND n_digits / greatest(n_digits + n_native, 1) > 0.7 AND length(s) < 30)) AS is_noise
FROM prof""",
)
def noise_simple(spark, sf):
    return captioned(spark, sf).select("id", tx.is_noise_simple(F.col("raw"), LATIN).alias("is_noise"))


@query(
    "noise_report",
    f"""WITH {REASONS},
counts AS (SELECT report_id, reason, count(*) AS n FROM reasons GROUP BY ALL),
totals AS (SELECT report_id, sum(n) AS total, sum(n) FILTER (WHERE reason IS NULL) AS kept, sum(n) FILTER (WHERE reason IS NOT NULL) AS dropped FROM counts GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, reason) AS rank FROM counts WHERE reason IS NOT NULL)
SELECT t.report_id, CAST(total AS BIGINT) AS total, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(dropped, 0) AS BIGINT) AS dropped,
       reason, n, CAST(rank AS INTEGER) AS rank
FROM totals t LEFT JOIN top ON top.report_id = t.report_id AND rank <= 8""",
)
def noise_report(spark, sf):
    totals, reasons = tp.noise_report(with_reasons(spark, sf))
    return totals.join(reasons, "report_id", "left")


@query(
    "describe_counts",
    f"""WITH {SENTENCES}, c AS (SELECT year, quarter, count(*) AS n FROM sents GROUP BY ALL)
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min,
       quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM c""",
)
def describe_counts(spark, sf):
    counts = sentences(spark, sf).groupBy("year", "quarter").agg(F.count("*").alias("n"))
    return r6(tp.describe(counts, "n"))


@query(
    "sentence_ids",
    f"""WITH {SENTENCES}, k AS (SELECT * FROM sents WHERE length(text) > 2),
n AS (SELECT id AS key, report_id, row_number() OVER (PARTITION BY report_id ORDER BY id) AS sent_id_in_report,
             row_number() OVER (ORDER BY report_id, id) AS id FROM k)
SELECT * FROM n""",
)
def sentence_ids(spark, sf):
    kept = sentences(spark, sf).where(F.length("text") > 2)
    kept = kept.select("report_id", F.col("id").alias("key"))
    return tp.number_sentences(kept, order="key", major=())
