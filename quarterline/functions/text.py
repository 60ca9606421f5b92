"""Column expressions over pages, lines and sentences.

All patterns are plain regular expressions evaluated in the JVM, over text whose white space
has been made plain spaces (``flat``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.coerce import strip
from quarterline.profiles import (
    BREAK_CHARS, CJK, DIGIT, LINE_BREAK, SPACE_CHARS, TextProfile,
)

D = r"\p{Nd}"

# ---- Fixed values: line clean-up, in the order they apply -----------------------------
# (pattern, replacement, strip afterwards)
LINE_RULES = (
    (rf"^(?:[.·•…]| ){{3,}} *{D}+ *", "", False),
    (rf"(\.{{3,}}|…{{2,}}) *{D}+ *$", "", True),
    (rf"(\.{{3,}}|…{{2,}}) *{D}+ +", " ", True),
    (r"(\.{3,}|…{2,})", "", False),
    (rf"(?i)(第 *{D}+ *页|Page *{D}+)", " ", True),
    (rf"^{D}{{1,3}} +(?={CJK}|[（(])", "", False),
    # spaces between two CJK characters, or between one and a digit
    (rf"({CJK}) +(?={CJK}|{D})|({D}) +(?={CJK})", "$1$2", False),
    (" {2,}", " ", True),
)

# ---- Fixed values: references to figures and tables, in the order they apply ---------
REFERENCE_RULES = (
    (rf"[（(] *(图|表) *{D}+ *[）)]", ""),
    (rf"如 *图 *{D}+ *所示", "如下图所示"),
    (rf"图 *{D}+ *所示", "下图所示"),
    (rf"(参见|见) *图 *{D}+", "$1下图"),
    (rf"(参见|见) *表 *{D}+", "$1下表"),
    (rf"(?<!图)图 *{D}+", "下图"),
    (rf"(?<!表)表 *{D}+", "下表"),
)
EMBEDDED_CAPTION = rf" (?:图|表) *{D}+ *[：:]"
NOTE_SENTENCE = rf"^(数据来源|资料来源|来源|注|说明) *[：:]"
CAPTION_START = rf"^(图|表) *{D}+"
YEAR_START = rf"(?:19|20){D}{{2}}年"
BOX_START = rf"^[IVX]{{1,4}} *专栏|^专栏"
BOX_LEADS = "展望|未来|总体来看|综合来看|总的来看|下一阶段|下一步"
SEPARATOR_RUN = r"[|│┃┆┊┇—–\-_=]{3,}"
PAGE_NUMBER = rf"^(?:[IVX]{{1,8}}|{D}{{1,4}})$"
PAGE_LABEL = rf"(?i)^(?:第 *{D}+ *页|Page *{D}+)$"
DOT_LEADER = rf"(\.{{4,}}|…{{2,}}) *{D}+ *$"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain Column used many times is copied into every place, also by filter pushdown;
    bound to a lambda variable it stays one evaluation.
    """
    return F.get(F.transform(F.array(value), body), 0)


def add_once(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The columns come out of a generator, which filters on them are not pushed through; a
    plain derived column would be computed again inside every such filter.
    """
    row = F.struct(*[c.alias(name) for name, c in fields.items()])
    return df.select("*", F.inline(F.array(row)))


def flat(col: Column) -> Column:
    """Every kind of white space becomes a plain space, one for one."""
    return F.translate(col, SPACE_CHARS, " " * len(SPACE_CHARS))


def lines_of(text: Column) -> Column:
    return F.split(F.translate(text, BREAK_CHARS, "\n" * len(BREAK_CHARS)), LINE_BREAK)


def contains_any(col: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | col.contains(w)
    return hit


def count_of(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def count_chars(col: Column, char_class: str) -> Column:
    """How many characters belong to a class written ``[...]``."""
    return F.length(F.regexp_replace(col, f"[^{char_class[1:-1]}]+", ""))


def normalize_line(col: Column) -> Column:
    """Remove dot leaders with page numbers, page labels and layout spaces."""
    out = strip(flat(col))
    for pattern, replacement, trim in LINE_RULES:
        out = F.regexp_replace(out, pattern, replacement)
        if trim:
            out = strip(out)
    return out


def is_page_number(col: Column) -> Column:
    return col.rlike(PAGE_NUMBER)


def is_toc_page(text: Column, profile: TextProfile, min_lines: int = 12) -> Column:
    """Contents page: a contents word with a part heading near the top, or, on a page with
    enough lines, many dot leaders, or some of them beside several headings."""

    def decide(x: Column) -> Column:
        n, leaders, head = F.size(x["filled"]), F.size(x["leaders"]), x["head"]
        titled = contains_any(head, profile.toc_words) & head.rlike(profile.heading)
        dotted = (leaders >= 8) & (leaders / F.greatest(n, F.lit(1)) >= 0.25)
        headed = (count_of(head, profile.heading) >= 3) & (leaders >= 4)
        return titled | ((n >= min_lines) & (dotted | headed))

    head = F.substring(text, 1, profile.toc_head_chars)
    filled = F.filter(F.transform(lines_of(text), lambda x: strip(flat(x))), lambda x: x != "")
    parts = let(
        filled,
        lambda ls: F.struct(
            head.alias("head"),
            ls.alias("filled"),
            F.filter(ls, lambda x: x.rlike(DOT_LEADER)).alias("leaders"),
        ),
    )
    return F.coalesce(let(parts, decide), F.lit(False))


def is_toc_page_simple(text: Column, profile: TextProfile, head_chars: int = 300) -> Column:
    """Older rule: contents word and part heading within the first characters."""
    head = F.substring(text, 1, head_chars)
    return F.coalesce(
        contains_any(head, profile.toc_words) & head.rlike(profile.heading), F.lit(False)
    )


def drop_section_line(line: Column, profile: TextProfile) -> Column:
    """Is this normalised line a heading, list entry, caption, note or page number?"""
    stop, colon, *more = profile.stop_marks

    def decide(x: Column) -> Column:
        no_clause = ~contains_any(x, (stop, colon, *more))
        no_stop = ~contains_any(x, (stop, colon))
        length = F.length(x)
        return (
            (x == "")
            | is_page_number(x)
            | x.rlike(f"^{profile.heading}")
            | (x.rlike(profile.list_heading) & no_clause)
            | (x.rlike(profile.bracket_heading) & no_clause & (length <= 30))
            | ((count_of(x, "[.…]") >= 6) & no_stop)
            | (x.rlike(profile.caption) & (length <= 120))
            | (x.rlike(profile.source_note) & (length <= 120))
            | (contains_any(x, profile.table_words) & no_stop & (length <= 60))
        )

    return let(line, decide)


def drop_section_line_simple(line: Column, profile: TextProfile) -> Column:
    """Older three-rule variant; works on stripped lines."""
    stop, colon = profile.stop_marks[0], profile.stop_marks[1]
    dotted = count_of(line, "[.…]") > 5
    return (
        (line == "")
        | line.rlike(f"^{profile.heading}")
        | (line.rlike("^[一二三四五六七八九十]、") & ~contains_any(line, (stop, colon)))
        | (contains_any(line, profile.table_words) & dotted & ~line.contains(stop))
    )


def _cut_from(text: Column, pattern: str, before: int) -> Column:
    """Text from the first match on, when it starts after the first and before the
    given character (0-based); otherwise the text itself."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when((at > 1) & (at <= before), strip(F.substring(text, at, F.length(text)))).otherwise(text)


def strip_caption(col: Column) -> Column:
    """Cut a caption glued to the front of a sentence where the prose clearly starts."""

    def cut(x: Column) -> Column:
        from_year, from_lead = _cut_from(x, YEAR_START, 120), _cut_from(x, BOX_LEADS, 160)
        captioned, boxed = x.rlike(CAPTION_START), x.rlike(BOX_START)
        return F.when(captioned, from_year).when(boxed, from_lead).otherwise(x)

    return let(strip(flat(col)), cut)


def postprocess_sentence(col: Column) -> Column:
    """Neutralise figure and table references; empty string for notes and captions."""
    text = strip(flat(col))
    for pattern, replacement in REFERENCE_RULES:
        text = F.regexp_replace(text, pattern, replacement)

    def before_caption(x: Column) -> Column:
        at = F.regexp_instr(x, F.lit(EMBEDDED_CAPTION))
        prefix = strip(F.substring(x, F.lit(1), F.greatest(at - 1, F.lit(0))))
        return F.when(at <= 0, x).when(F.length(prefix) < 12, F.lit("")).otherwise(prefix)

    def blank_notes(x: Column) -> Column:
        drop = x.rlike(NOTE_SENTENCE) | (x.rlike(CAPTION_START) & (F.length(x) <= 160))
        return F.when(drop, F.lit("")).otherwise(strip(F.regexp_replace(x, " {2,}", " ")))

    return let(let(text, before_caption), blank_notes)


def clean_sentence(col: Column) -> Column:
    """The three sentence steps in order."""
    return postprocess_sentence(strip_caption(normalize_line(col)))


def char_profile(col: Column, native: str = CJK) -> Column:
    """Struct of the stripped sentence ``s`` with its character and token counts."""

    def measure(s: Column) -> Column:
        return F.struct(
            s.alias("s"),
            F.length(s).alias("n_chars"),
            count_chars(s, native).alias("n_native"),
            count_chars(s, DIGIT).alias("n_digits"),
            count_of(s, "[^ ]+").alias("n_tokens"),
            count_of(s, rf"{D}+(?:\.{D}+)?").alias("n_numbers"),
            count_of(s, rf"{D}+(?:\.{D}+)?%").alias("n_percents"),
        )

    return let(strip(flat(col)), measure)


def share(profile: Column, count: str) -> Column:
    """A count of a character profile over its characters."""
    return profile[count] / F.greatest(profile["n_chars"], F.lit(1))


def is_table_like(col: Column, profile: TextProfile) -> Column:
    """Does a sentence look like a table row, axis, caption or source note?

    One ordered decision list; the first matching rule decides.
    """

    def decide(f: Column) -> Column:
        s, n, native, digit = f["s"], f["n_chars"], share(f, "n_native"), share(f, "n_digits")
        tokens, numbers, percents = f["n_tokens"], f["n_numbers"], f["n_percents"]
        prose_like = (native >= 0.65) & (tokens <= 8)
        dense = (
            ((percents >= 4) & (native < 0.6))
            | ((numbers >= 12) & ((digit >= 0.25) | (tokens >= 10)) & (native < 0.6))
            | (
                s.rlike(f"^{D}")
                & (numbers >= 8)
                & ((tokens >= 10) | (native < 0.55))
                & (digit >= 0.15)
            )
            | ((n >= 70) & (native < 0.30) & ((digit > 0.15) | (numbers >= 8)))
            | ((n >= 60) & (native < 0.50) & (count_of(s, SEPARATOR_RUN) >= 1))
        )
        header = (
            (tokens >= 14)
            & ~s.rlike(profile.end_marks)
            & (s.rlike(profile.header_words) | (digit > 0.10) | (numbers >= 6))
        )
        noted = (
            contains_any(s, profile.note_words) & (n >= 25) & (native < 0.65) & (numbers >= 6)
        )
        rules = (
            F.when(s == "", True)
            .when(s.rlike(profile.table_caption) | s.rlike(profile.source_note), True)
            .when(s.rlike(profile.unit_note), True)
            .when((tokens <= 10) & s.rlike(profile.narrative) & s.rlike(profile.clause_marks), False)
            .when(~prose_like & dense, True)
            .when(header | noted, True)
        )
        if profile.native_required:
            foreign = (f["n_digits"] > 0) | s.rlike("[a-zA-Z]")
            rules = rules.when((f["n_native"] == 0) & foreign, True)
        return rules.otherwise(False)

    return let(char_profile(col, profile.native), decide)


def noise_reason(col: Column, profile: TextProfile) -> Column:
    """Why a sentence is noise; NULL for a good one."""
    stop, colon = profile.stop_marks[0], profile.stop_marks[1]

    def decide(s: Column) -> Column:
        leaders = s.rlike(r"\.{6,}|…{4,}") & ~contains_any(s, (stop, colon))
        return (
            F.when(s == "", "empty")
            .when(contains_any(s, profile.toc_words), "toc")
            .when(leaders, "dotleader")
            .when(F.length(s) <= 2, "short")
            .when(s.rlike(PAGE_LABEL), "pageno")
            .when(is_table_like(s, profile), "table")
        )

    return let(normalize_line(col), decide)


def is_noise_simple(col: Column, profile: TextProfile) -> Column:
    """Older rule: contents word, at most two characters, or mostly digits."""

    def decide(x: Column) -> Column:
        s, native, digits = x["s"], x["native"], x["digits"]
        digit_heavy = (
            (native > 0)
            & (digits > 0)
            & (digits / F.greatest(digits + native, F.lit(1)) > 0.7)
            & (F.length(s) < 30)
        )
        return (
            (F.length(s) <= 2)
            | contains_any(s, profile.toc_words)
            | ((native == 0) & (digits > 0))
            | digit_heavy
        )

    def measure(s: Column) -> Column:
        return F.struct(
            s.alias("s"),
            count_chars(s, profile.native).alias("native"),
            count_chars(s, DIGIT).alias("digits"),
        )

    return let(let(strip(col), measure), decide)
