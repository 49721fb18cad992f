"""Quality rules: clean line by line, then reject documents that lose too much.

Built-in expressions only: one pass, no shuffle, no state beyond one document.

Every line is judged on its own.  A line fails as

* punctuation: many words without a single punctuation mark, or shouting (many
  exclamation marks), or symbols instead of prose;
* navigation: separators such as ``|`` between most of its words;
* boilerplate: a short line with a phrase of web page furniture.

Failing lines are removed.  A document is rejected when the removed lines hold
more than ``max_lost_pct`` of its characters, or when it fails a base rule: too few
words, or too many words inside 5-word windows that the text repeats.

Defined results: a null or blank text has no words and is rejected; lines
without a word are neither counted nor judged; a null id is passed through;
rows are independent, so repeated rows give repeated results; other columns
are never read.  Repeated windows are compared by 64-bit hashes inside one
document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import BLANKS, bind, documents, utf8, words_of

# The symbols counted, and what separates entries of a menu.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
MARKS = ".,;:!?…"
# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript",
    "forgot your password", "lorem ipsum", "privacy policy", "read more",
    "share this", "sign up", "skip to content", "terms of service", "terms of use",
    "use of cookies",
)
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules, in percent of a line's or a text's characters in words."""

    symbol_pct: int = 10
    exclaim_pct: int = 5
    separator_pct: int = 20          # separators per 100 words
    unpunctuated_words: int = 30     # from here on a line needs a punctuation mark
    boilerplate_words: int = 12      # longer lines are prose that mentions a phrase
    max_lost_pct: int = 30
    min_words: int = 10
    max_repeat_pct: int = 20


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _solid(text: Column) -> Column:
    """Code points outside blanks."""
    return F.length(F.translate(text, BLANKS, ""))


def _n_words(line: Column) -> Column:
    """Words of a line that has one; only lines with runs of blanks are split for it."""
    return bind(F.trim(F.translate(line, BLANKS, " " * len(BLANKS))), lambda x: F.when(
        F.contains(x, F.lit("  ")), F.size(words_of(x))).otherwise(_count(x, " ") + 1))


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the list."""
    hashes = F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(
                F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        # Overlapping windows share words: each start adds what the one before left.
        return F.aggregate(
            bind(by_hash, starts), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"),
                                  i.alias("at")),
            lambda a: a["n"])

    return bind(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def _verdict(line: Column, rules: LineRules) -> Column:
    """(characters, failed) of one line that has a word."""
    def judge(x: Column) -> Column:
        solid, low = x["solid"], F.lower(x["line"])
        phrases = F.lit(False)
        for phrase in BOILERPLATE:
            phrases = phrases | F.contains(low, F.lit(phrase))
        n_words = x["n_words"]
        failed = (
            (100 * x["symbols"] > rules.symbol_pct * solid)
            | (100 * _count(x["line"], "!") > rules.exclaim_pct * solid)
            | ((x["separators"] >= 2) & (100 * x["separators"] > rules.separator_pct * n_words))
            | ((n_words >= rules.unpunctuated_words) & (_count(x["line"], MARKS) == 0))
            | ((n_words <= rules.boilerplate_words) & phrases))
        return F.struct(solid.alias("chars"), failed.alias("failed"))

    return bind(F.struct(
        line.alias("line"), _solid(line).alias("solid"), _count(line, SYMBOLS).alias("symbols"),
        _count(line, SEPARATORS).alias("separators"),
        _n_words(line).alias("n_words")), judge)


def quality_rules(docs: DataFrame, rules: LineRules | None = None, text: str = "text") -> DataFrame:
    """Counts, verdict and cleaned text beside the columns of ``docs``.

    Adds ``n_words word_chars n_symbols n_dup_lines n_repeat_words lost_share
    base_failed kept clean_text``; columns of these names are replaced.
    """
    rules = rules or LineRules()
    body = utf8(text)
    lines = F.filter(F.split(body, "\n"), lambda x: _solid(x) > 0)
    base = bind(
        F.struct(words_of(body).alias("words"), lines.alias("lines"),
                 _solid(body).alias("word_chars")),
        lambda x: F.struct(
            F.size(x["words"]).cast("long").alias("n_words"),
            x["word_chars"].cast("long").alias("word_chars"),
            _count(body, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long")
            .alias("n_dup_lines"),
            repeat_words(x["words"]).cast("long").alias("n_repeat_words"),
            F.aggregate(
                F.transform(x["lines"], lambda y: _verdict(y, rules)), F.lit(0),
                lambda a, y: a + F.when(y["failed"], y["chars"]).otherwise(0)).alias("lost")))
    out = docs.withColumn("_rules", base)
    got = F.col("_rules")
    failed = ((got["n_words"] < rules.min_words)
              | (100 * got["n_repeat_words"] > rules.max_repeat_pct * got["n_words"]))
    clean = F.array_join(F.filter(F.split(body, "\n"), lambda y: ~bind(
        _verdict(y, rules), lambda v: v["failed"] & (v["chars"] > 0))), "\n")
    out = out.withColumns({
        **{c: got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                               "n_repeat_words")},
        "lost_share": F.when(got["word_chars"] > 0, got["lost"] / got["word_chars"])
        .otherwise(0.0),
        "base_failed": failed,
        "kept": ~failed & (100 * got["lost"] <= rules.max_lost_pct * got["word_chars"]),
        "clean_text": clean})
    return out.drop("_rules")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def _sql() -> str:
    """The same rules for DuckDB, with windows compared as strings."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    r = LineRules()
    phrases = " OR ".join(f"contains(lower(v.y), '{p}')" for p in BOILERPLATE)
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: length(translate(x, {blanks}, '')) > 0) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, t, w, lines, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
      lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])
      ELSE [] END AS g
  FROM base),
starts AS (
  SELECT doc_id, t, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM windows),
again AS (
  SELECT doc_id, t, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t, gram) AS c FROM starts)
  WHERE c > 1),
repeats AS (
  SELECT doc_id, t, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (
    SELECT doc_id, t, i, lead(i) OVER (PARTITION BY doc_id, t ORDER BY i) AS nxt FROM again)
  GROUP BY doc_id, t),
lost AS (
  SELECT doc_id, t, w, lines, coalesce(list_sum(list_transform(judged, lambda v: CASE WHEN
      100 * (length(v.y) - length(translate(v.y, '{SYMBOLS}', '')))
        > {r.symbol_pct} * length(translate(v.y, {blanks}, ''))
      OR 100 * (length(v.y) - length(replace(v.y, '!', '')))
        > {r.exclaim_pct} * length(translate(v.y, {blanks}, ''))
      OR (length(v.y) - length(translate(v.y, '{SEPARATORS}', '')) >= 2
        AND 100 * (length(v.y) - length(translate(v.y, '{SEPARATORS}', '')))
          > {r.separator_pct} * v.n)
      OR (v.n >= {r.unpunctuated_words} AND length(v.y) = length(translate(v.y, '{MARKS}', '')))
      OR (v.n <= {r.boilerplate_words} AND ({phrases}))
    THEN length(translate(v.y, {blanks}, '')) ELSE 0 END)), 0) AS lost
  FROM (SELECT *, list_transform(lines, lambda y: struct_pack(y := y, n := len(list_filter(
      string_split_regex(y, '[\x20\x09-\x0D]+'), lambda z: z <> '')))) AS judged FROM windows)),
counts AS (
  SELECT l.doc_id, len(l.w)::BIGINT AS n_words, length(translate(l.t, {blanks}, ''))::BIGINT AS word_chars,
    (length(l.t) - length(translate(l.t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, l.lost
  FROM lost l LEFT JOIN repeats r ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.t = r.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words)
    AND 100 * lost <= {r.max_lost_pct} * word_chars AS kept
FROM counts"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE = {"op10_quality_rules": _sql()}
