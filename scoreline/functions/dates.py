"""Date functions: date from free text (F6), year inference for ``d.m``
texts (F6b), the element-part date rule of extraction (E10), and the date
window test (F2).

``as_of`` (the reference point for "now") is always an explicit column so
results are repeatable; callers default it to ``current_date()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions.phases import SENTINEL_DATE
from scoreline.functions.text import collapse_ws, nonempty_extract, strip_ws, zfill2

# --- Fixed values: accepted whole-text date layouts, in the order tried:
#   d.m.Y  d/m/Y  Y-m-d  d MMMM Y  d MMM Y  MMMM d, Y  MMM d, Y  d.m.y  d/m/y
# Day and month take one or two digits.  The numeric layouts never match
# the same text as each other or as the named-month ones, so they are read
# with one pattern (ISO text is first rewritten to d.m.Y).
NAMED_MONTH_PATTERNS = ["d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
# Shape of the texts each named-month pattern can accept; a parse is only
# attempted on a text of that shape (a failed formatter parse is costly).
NAMED_MONTH_SHAPES = [r"^\d{1,2} [A-Za-z]+ \d{4}$", r"^\d{1,2} [A-Za-z]+ \d{4}$",
                      r"^[A-Za-z]+ \d{1,2}, \d{4}$", r"^[A-Za-z]+ \d{1,2}, \d{4}$"]
# Two-digit years 69-99 are 1900s, 00-68 are 2000s.
TWO_DIGIT_PIVOT = 69
ISO_WHOLE = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
NUMERIC_WHOLE = r"^(\d{1,2})([./])(\d{1,2})\2(\d{4}|\d{2})$"
# the commonest of them, without blanks around and with a year that a cast reads
NUMERIC_PLAIN = r"^(\d{1,2})([./])(\d{1,2})\2([1-9]\d{3})\z"
ISO_PLAIN = r"^\d{4}-\d{2}-\d{2}\z"
DAY_MONTH_YEAR_ANYWHERE = r"(\d{1,2})[./](\d{1,2})[./](\d{4})"
DAY_MONTH_NO_YEAR = r"(\d{1,2})\.(\d{1,2})(?!\.)"
PART_DATE = r"(\d{1,2})\.(\d{1,2})(?:\.(\d{4}))?"
# a dated part of ``p1|p2|...``, and its date alone
PART_WITH_DATE = r"(?:^|\|)[^|]*?(\d{1,2})\.(\d{1,2})(?:\.(\d{4}))?"
PART_WITH_DATE_CORE = r"(?:^|\|)[^|]*?(\d{1,2}\.\d{1,2}(?:\.\d{4})?)"
# -------------------------------------------------------------------------



def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    """Date from year/month/day (text or int); NULL when a part is missing
    or the parts are not a real date (no exception under ANSI mode).  The
    parse is only attempted when all three parts are present."""
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(),
                  F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"),
                                            d.cast("string")), "y-M-d"))


def iso_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text as a date, or NULL; a cast reads the plain form, at a
    fraction of a formatter's cost."""
    return F.when(text.rlike(ISO_PLAIN), text.try_cast("date")).otherwise(F.try_to_date(text, "yyyy-MM-dd"))


def _inferred_year(month: Column, as_of: Column) -> Column:
    return F.when(month.cast("int") > F.month(as_of), F.year(as_of) - 1).otherwise(F.year(as_of))


def infer_year_date(day: Column, month: Column, as_of: Column) -> Column:
    """A day and month without a year.  The year is ``as_of``'s, or the
    one before when the month lies ahead of ``as_of``'s month; if the date is
    then still after ``as_of`` it moves one more year back.  Impossible
    dates give NULL."""
    y0 = _inferred_year(month, as_of)
    first = date_from_parts(y0, month, day)
    return F.when(first > as_of, date_from_parts(y0 - 1, month, day)).otherwise(first)


def parse_date(text: Column, as_of: Column) -> Column:
    """a date from free text, or NULL.

    1. the whole (trimmed) text in one of the fixed layouts, in order;
    2. else the first ``d.m.yyyy`` / ``d/m/yyyy`` anywhere in the text;
    3. else the first ``d.m`` not followed by a dot, year by F6b.
    """
    s = strip_ws(text)
    plain = F.regexp_replace(text, NUMERIC_PLAIN, "$4-$3-$1")
    numeric = F.when(F.instr(s, "-") > 0, F.regexp_replace(s, ISO_WHOLE, "$3.$2.$1")).otherwise(s)
    yt = F.regexp_extract(numeric, NUMERIC_WHOLE, 4)
    y = F.when(F.char_length(yt) == 2,
               F.when(yt.cast("int") >= TWO_DIGIT_PIVOT, yt.cast("int") + 1900)
                .otherwise(yt.cast("int") + 2000)).otherwise(yt.cast("int"))
    whole = F.when(numeric.rlike(NUMERIC_WHOLE), date_from_parts(y, F.regexp_extract(numeric, NUMERIC_WHOLE, 3),
                                                                 F.regexp_extract(numeric, NUMERIC_WHOLE, 1)))
    collapsed = collapse_ws(s)   # a blank in a layout accepts any run of blanks
    named = [F.when(s.rlike("[A-Za-z]") & collapsed.rlike(shape), F.try_to_date(collapsed, p))
             for p, shape in zip(NAMED_MONTH_PATTERNS, NAMED_MONTH_SHAPES)]
    anywhere = date_from_parts(nonempty_extract(s, DAY_MONTH_YEAR_ANYWHERE, 3),
                               nonempty_extract(s, DAY_MONTH_YEAR_ANYWHERE, 2),
                               nonempty_extract(s, DAY_MONTH_YEAR_ANYWHERE, 1))
    no_year = infer_year_date(nonempty_extract(s, DAY_MONTH_NO_YEAR, 1),
                              nonempty_extract(s, DAY_MONTH_NO_YEAR, 2), as_of)
    return F.coalesce(F.when(plain != text, plain.try_cast("date")), whole, *named, anywhere, no_year)


def part_date_text(part: Column, as_of: Column) -> Column:
    """E10 rule 1 on one text part: ``d.m.yyyy`` gives ``yyyy-mm-dd`` as text
    (not validated); ``d.m`` gives the F6b date as text, or NULL when it is
    impossible (so the next part is tried).  When F6b moves the year back
    the date is not checked again, so the text keeps that form."""
    return date_core_text(F.regexp_extract(part, PART_DATE, 0), as_of)


def date_core_text(core: Column, as_of: Column) -> Column:
    """``core`` is a matched ``d.m`` or ``d.m.yyyy`` (or '' for none); the
    pattern is matched once and its pieces are taken apart by splitting."""
    bits = F.split(core, r"\.")
    d = F.element_at(bits, 1)
    m = F.try_element_at(bits, F.lit(2))
    y = F.try_element_at(bits, F.lit(3))
    y0 = _inferred_year(m, as_of)
    first = date_from_parts(y0, m, d)
    no_year = (F.when(first > as_of, (y0 - 1).cast("string"))
                .when(first.isNotNull(), y0.cast("string")))
    year_text = F.when(y.isNotNull(), y).otherwise(no_year)
    return F.when((core != "") & year_text.isNotNull(),
                  F.concat_ws("-", year_text, zfill2(m), zfill2(d)))


def text_date_with_year(text: Column) -> Column:
    """E10 rule 3: first ``d.m.yyyy`` or ``d/m/yyyy`` in the text, as
    ``yyyy-mm-dd`` text (not validated)."""
    part = lambda group: F.regexp_extract(text, DAY_MONTH_YEAR_ANYWHERE, group)
    marked = (F.instr(text, ".") > 0) | (F.instr(text, "/") > 0)     # a pattern is only run on texts holding its marks
    return F.when(marked & text.rlike(DAY_MONTH_YEAR_ANYWHERE), F.concat_ws("-", part(3), zfill2(part(2)), zfill2(part(1))))


def text_date_no_year(text: Column, as_of: Column) -> Column:
    """E10 rule 4: first ``d.m`` (no dot after) in the text, F6b year."""
    return F.when((F.instr(text, ".") > 0) & text.rlike(DAY_MONTH_NO_YEAR),
                  date_core_text(F.regexp_extract(text, DAY_MONTH_NO_YEAR, 0), as_of))


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def in_window(df: DataFrame, windows: DataFrame, competition: str, date_text_col: str,
              out_col: str = "in_window") -> DataFrame:
    """Is the match date inside its competition's window (inclusive)?

    ``windows``: competition, window_start, window_end and, from the parameter
    reader, window_malformed.  It is reduced to one row per competition, so a
    repeated one cannot repeat matches, and broadcast: a shuffle by competition
    would give each task all matches of one.  Missing or sentinel date: false; no window for the
    competition: true; a malformed window or a text that is no real date: false.
    """
    bad = F.col("window_malformed") if "window_malformed" in windows.columns else F.lit(False)
    w = windows.where(F.col("competition").isNotNull()).groupBy(F.col("competition").alias("_w_comp")).agg(
        F.min("window_start").alias("_w_lo"), F.max("window_end").alias("_w_hi"), F.max(bad).alias("_w_bad"))
    j = df.join(F.broadcast(w), F.col(competition) == F.col("_w_comp"), "left")
    dtxt = F.col(date_text_col).cast("string")
    d = iso_date(dtxt)
    has_window = F.col("_w_lo").isNotNull() & F.col("_w_hi").isNotNull()
    verdict = (F.when(dtxt.isNull() | (dtxt == "") | (dtxt == SENTINEL_DATE), F.lit(False))
                .when(F.coalesce("_w_bad", F.lit(False)), F.lit(False))
                .when(~has_window, F.lit(True))
                .when(d.isNull(), F.lit(False))
                .otherwise(d.between(F.col("_w_lo"), F.col("_w_hi"))))
    return j.withColumn(out_col, verdict).drop("_w_comp", "_w_lo", "_w_hi", "_w_bad")
