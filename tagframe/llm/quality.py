"""Quality rules: one table of thresholds, compiled into one projection.

A rule names a measure and the range in which a document passes. ``measures``
holds the measures as column expressions over one text: counts of words, word
characters, symbols, stop words, repeated lines and repeated windows of words.
No rule needs another row, so the plan is a scan and projections, no exchange.

Words in windows that occur twice or more are found without comparing all pairs:
windows get a 64-bit hash built from their words' hashes by doubling (1, 2, 4, 8
words); if all hashes of a text differ, nothing repeats; else the (hash,
position) pairs are sorted, equal neighbours give the repeated positions, and
the windows starting there are united. Two different windows of one text with
equal hashes (about n**2 / 2**65 for n words) would count as repeated.

Inputs: null text has no words and fails; repeated rows give repeated results; an
empty table gives no rows; other columns are ignored by score() and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.llm import common
from tagframe.llm.common import let

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\u000b\f\r"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    """
    the of and to a in is that it for was on with as by be this are at from
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als
    de la le et les des en un du une que pour est dans qui par sur pas au avec
    el y los se las del por con no su para al es lo como más pero sus
    """.split()
)

#: measure, least, most: a document passes if least <= measure <= most; None is no bound.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_words_percent", None, 30),
    ("mean_word_chars", 2.5, 12),
    ("symbols_per_word", None, 0.3),
    ("dup_lines_share", None, 0.4),
    ("stop_words_share", 0.04, None),
)

#: The first rules alone decide ``base_failed``.
BASE_RULES = ("n_words", "repeat_words_percent")


def shifted(values: Column, by: int, drop: int) -> Column:
    """values[by:], without the last ones so that len(values) - drop remain."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - drop, F.lit(0)))


def paired(values: Column, by: int) -> Column:
    """Hashes of (values[i], values[i + by])."""
    return F.zip_with(shifted(values, 0, by), shifted(values, by, by), lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column) -> Column:
    """A hash of each window of 8 words; empty with fewer words."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(let(one, lambda h: paired(h, 1)), lambda h: paired(h, 2)), lambda h: paired(h, 4))


def covered_words(hashes: Column, window: int) -> Column:
    """Words in windows whose hash occurs more than once."""

    def repeated(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.flatten(F.filter(F.zip_with(shifted(p, 0, 1), shifted(p, 1, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())),
        )

    def united(at: Column) -> Column:
        steps = F.zip_with(shifted(at, 0, 1), shifted(at, 1, 1), lambda a, b: F.least(b - a, F.lit(window)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(window), lambda s, x: s + x))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(let(hashes, lambda hs: F.sort_array(F.array_distinct(repeated(hs)))), united)
    )


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of each text, with the columns in keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = list(STOP_WORDS)
    cut = docs.select(
        *keep,
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(common.WORD_PATTERN), 0).alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0).alias("_lines"),
    )
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    cut = cut.withColumn("_hashes", F.when(F.size("_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(window_hashes(F.col("_words"))))
    return cut.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("_hashes"), WINDOW).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: (F.length(w) <= 6) & bare(w).isin(stop))).cast("long").alias("n_stop_words"),
    )


def ratios() -> dict[str, Column]:
    """The measures that rules may name; those per word or line are null without any."""
    words = F.nullif(F.col("n_words"), F.lit(0))
    return {
        "n_words": F.col("n_words"),
        "repeat_words_percent": 100 * F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_share": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "stop_words_share": F.col("n_stop_words") / words,
    }


def fails(rules: tuple[tuple[str, float | None, float | None], ...]) -> Column:
    """True if a rule of the table fails; a null measure passes."""
    named = ratios()
    failed = F.lit(False)
    for measure, least, most in rules:
        for bound, below in ((least, True), (most, False)):
            if bound is not None:
                broken = named[measure] < bound if below else named[measure] > bound
                failed = failed | F.coalesce(broken, F.lit(False))
    return failed


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document."""
    base = tuple(r for r in rules if r[0] in BASE_RULES)
    m = measures(docs, "doc_id")
    m = m.withColumn("base_failed", fails(base))
    m = m.withColumn("kept", ~(F.col("base_failed") | fails(rules)))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, unchanged."""
    m = measures(docs.withColumn("_row", F.struct(*docs.columns)), "_row")
    return m.where(~fails(rules)).select("_row.*")


SCORE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: length(x) <= 6 AND list_contains([{stop}], lower(rtrim(x, '.,;:!?')))))::BIGINT AS n_stop_words
  FROM d LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars::DOUBLE / n_words < 2.5 OR word_chars::DOUBLE / n_words > 12
            OR n_symbols::DOUBLE / n_words > 0.3 OR n_dup_lines::DOUBLE / n_lines > 0.4
            OR n_stop_words::DOUBLE / n_words < 0.04) AS kept,
       n_lines, n_stop_words
FROM b
""".replace("{stop}", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
