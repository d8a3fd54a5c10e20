"""Line-first cleaning and counting rules, in DataFrame functions alone.

Each line is judged by itself for punctuation, navigation and boilerplate; failing lines are removed, and a document
that loses too much of its text is rejected. Counts over the whole text form a base rule besides. Everything happens
within a document's row: there is no shuffle, so no source or group of copies can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACE, written

# Marks and phrases of the line rules.
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
CODE_MARKS = "[#*$%&<>{}\\[\\]\\\\^~=_@]"
SENTENCE_MARKS = "[.,;:!?…。！？]"
BOILERPLATE = (
    "all rights reserved", "copyright ©", "© ", "cookie policy", "use of cookies", "accept cookies", "privacy policy",
    "terms of use", "terms of service", "enable javascript", "subscribe to our", "sign up for", "click here", "back to top",
)

#: Share of a document's word characters that may go with its lines, in hundredths.
MOST_LOST = 50
#: A line of navigation has a separator for every so many characters; one of marks or shouting has more of them than that.
PER_SEPARATOR, PER_MARK, PER_SHOUT = 20, 10, 12
#: A line this long without any sentence mark is a list, not prose; boilerplate stands in lines up to BANNER.
LIST_CHARS, BANNER = 40, 240


def line_passes(line: Column) -> Column:
    """True for a line of prose, and for one without words."""
    chars, lower = F.char_length(line), F.lower(line)
    count = lambda marks: F.regexp_count(line, F.lit(marks))
    boilerplate = lower.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boilerplate = boilerplate | lower.contains(phrase)
    return F.when((chars <= BANNER) & boilerplate, F.lit(False)).otherwise(
        ~(
            (line.rlike(SEPARATORS) & (count(SEPARATORS) * PER_SEPARATOR >= chars))
            | (line.contains("!!") & (count("!") * PER_SHOUT > chars))
            | (line.rlike(CODE_MARKS) & (count(CODE_MARKS) * PER_MARK > chars))
            | (chars >= LIST_CHARS) & ~line.rlike(SENTENCE_MARKS)
        )
    )


def _repeated(words: Column, packed: Column) -> Column:
    """Words within a 3-word window that the text has twice or more. packed: sorted hash-and-place numbers of all windows.

    Windows whose 32-bit hashes meet are compared by their words, so the count is exact.
    """
    place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    head = lambda x: F.shiftright(x, 31)
    near = F.filter(packed, lambda x, k: F.coalesce(head(x) == head(F.get(packed, k - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get(packed, k + 1)), F.lit(False)))
    return F.sort_array(F.transform(near, lambda x: F.struct(*(F.get(words, place(x) + d).alias(f"w{d}") for d in range(3)), place(x).alias("at"))))


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), and cleaned (the text without the lines removed).

    A null or empty text has no words, fails the base rule and is not kept; its cleaned text is null or empty. Lines
    end at a line feed. Columns of docs by these names are replaced. Repeated rows are judged alike.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.withColumn("_text", F.col(text))
    out = out.withColumns({"_words": F.array_remove(F.split(body, f"[{SPACE}]+"), ""), "_lines": F.split(body, "\n")})
    words = F.col("_words")
    windows = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    out = out.withColumns({
        "_packed": F.sort_array(F.transform(windows, lambda x, i: F.shiftleft(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(i.cast("long")))),
        "_full": F.filter("_lines", lambda x: x.rlike(f"[^{SPACE}]")),
        "_passed": F.filter("_lines", line_passes),
    })
    out = out.withColumn("_near", _repeated(words, F.col("_packed")))
    near = F.col("_near")
    same = lambda x, y: F.coalesce((x.w0 == y.w0) & (x.w1 == y.w1) & (x.w2 == y.w2), F.lit(False))
    out = out.withColumns({
        "_places": F.sort_array(F.transform(F.filter(near, lambda x, k: same(x, F.get(near, k - 1)) | same(x, F.get(near, k + 1))), lambda x: x.at)),
        "_cleaned": F.array_join("_passed", "\n"),
    })
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_places", zero, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a.last)).alias("n")), lambda a: a.n)
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": covered,
        "_left": F.when(F.size("_passed") == F.size("_lines"), F.char_length(F.array_join(words, ""))).otherwise(F.char_length(F.regexp_replace("_cleaned", f"[{SPACE}]+", ""))),
        "cleaned": F.when(F.col("_text").isNotNull(), F.col("_cleaned")),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("_left") >= (100 - MOST_LOST) * F.col("word_chars")))
    return out.drop("_text", "_words", "_lines", "_packed", "_full", "_passed", "_near", "_places", "_cleaned", "_left")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, their text cleaned; the columns of docs.

    The verdicts are written first: a filter on them would be pushed below the arrays that they come from, and those
    computed anew for each of their elements.
    """
    judged = written(assess(docs).select(*(F.col("cleaned").alias("text") if c == "text" else F.col(c) for c in docs.columns), F.col("kept").alias("_kept")))
    return judged.where("_kept").drop("_kept")


_BANNERS = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
_N = "len(regexp_extract_all(l, '{}'))"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The same rules in DuckDB's SQL.
SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), c AS (
  SELECT *, len(ws) AS n_words, length(translate(body, {_BLANK}, '')) AS word_chars,
    len(regexp_extract_all(body, '{SYMBOLS}')) AS n_symbols,
    list_filter(ls, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS full_lines,
    length(translate(array_to_string(list_filter(ls, lambda l: NOT (
      (length(l) <= {BANNER} AND ({_BANNERS}))
      OR (regexp_matches(l, '{SEPARATORS}') AND {_N.format(SEPARATORS)} * {PER_SEPARATOR} >= length(l))
      OR (contains(l, '!!') AND {_N.format("!")} * {PER_SHOUT} > length(l)) OR {_N.format(CODE_MARKS)} * {PER_MARK} > length(l)
      OR (length(l) >= {LIST_CHARS} AND NOT regexp_matches(l, '{SENTENCE_MARKS}')))), chr(10)), {_BLANK}, '')) AS left_chars
  FROM d
), win AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, n_words - 1)) AS i FROM c)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n >= 2
), cov AS (
  SELECT rid, sum(least(3, i - before)) AS n FROM (SELECT rid, i, lag(i, 1, i - 3) OVER (PARTITION BY rid ORDER BY i) AS before FROM rep) GROUP BY rid
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AND 100 * left_chars >= {100 - MOST_LOST} * word_chars AS kept
FROM c LEFT JOIN cov USING (rid)
"""
