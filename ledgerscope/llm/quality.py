"""Quality rules, line first: judge every line, remove the failing ones, reject texts that lose too much.

All of it happens inside a row with built-in functions: no shuffle, no Python.

A line with a word fails when it is

* unpunctuated: at least ``Rules.line_words`` words and none of them ends a sentence,
* navigation: it holds two or more separators ``|`` or ``>`` and one for every ``Rules.words_per_separator``
  words at least,
* boilerplate: symbols ``# * $ % & < >`` for more than ``Rules.symbol_share`` of its words, the same word again and
  again (less than ``Rules.distinct_share`` of its words differ), or a short line with one of
  ``BOILERPLATE``.

A text is rejected when its failing lines hold more than ``Rules.lost_share`` of its word characters, or by the
base rules: fewer than ``Rules.least_words`` words, or more than ``Rules.repeat_percent`` per cent of the words in
5-word windows found twice or more.

Defined results: null text has no words and is rejected by the base rules, as is empty text; an empty
table gives an empty table. Rows are judged one by one, so repeated rows get equal verdicts. Windows
are compared by a 64-bit hash of the hashes of their words. Input columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import SPACE, WORD, let, strip_space, table, whole_text, without

#: Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies",
    "enable javascript", "licensed under", "released under the", "subscribe to our", "sign up for our", "powered by",
)

RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept",
    "clean_text",
)


@dataclass(frozen=True)
class Rules:
    line_words: int = 8
    words_per_separator: int = 5
    symbol_share: float = 0.3
    distinct_share: float = 0.34
    boilerplate_words: int = 20
    lost_share: float = 0.5
    least_words: int = 10
    repeat_percent: int = 20
    window: int = 5


def _squeezed_length(text: Column, kept_class: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace(text, f"[^{kept_class}]+", ""))


def repeated_words(words: Column, window: int = 5) -> Column:
    """The number of words inside windows that occur twice or more in the array."""

    def counted(hashes: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - window),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]),
        )
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(
            ordered,
            lambda o: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                o,
                                lambda x, k: F.struct(
                                    x["i"].alias("i"),
                                    (
                                        F.coalesce(F.get(o, k - 1)["g"] == x["g"], F.lit(False))
                                        | F.coalesce(F.get(o, k + 1)["g"] == x["g"], F.lit(False))
                                    ).alias("twice"),
                                ),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda starts: F.aggregate(
                    F.transform(
                        starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window)))
                    ),
                    F.lit(0),
                    lambda total, x: total + x,
                ),
            ),
        )

    enough = F.size(words) > window
    return F.when(enough, let(F.transform(words, lambda w: F.xxhash64(w)), counted)).otherwise(F.lit(0)).cast("long")


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether one of the line rules throws the line out; lines without a word stay."""
    words = F.split(F.regexp_replace(strip_space(line), r"[\x20\x09-\x0D]+", " "), " ", -1)

    def judged(w: Column) -> Column:
        n = F.size(w)
        separators = _squeezed_length(line, "|>")
        symbols = _squeezed_length(line, "#*$%&<>")
        unpunctuated = (n >= rules.line_words) & ~line.rlike(
            r"""[.!?:;…。！？]["')\]»”’]*(?:[\x20\x09-\x0D]|$)"""
        )
        navigation = (separators >= 2) & (separators * rules.words_per_separator >= n)
        stutter = (n >= rules.line_words) & (F.size(F.array_distinct(w)) < n * F.lit(rules.distinct_share))
        phrase = (n <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
        return unpunctuated | navigation | (symbols > n * F.lit(rules.symbol_share)) | stutter | phrase

    return (strip_space(line) != "") & let(words, judged)


def quality(docs: DataFrame, text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """All rows with the counts, ``base_failed``, ``lost_chars``, ``kept`` and ``clean_text``, the text without failing lines."""
    rules = rules or Rules()
    text = whole_text(text_col)
    judged = (
        without(docs, *RESULTS)
        .withColumns({"_q_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_q_lines": F.split(text, "\n", -1)})
        .withColumn("_q_good", F.filter("_q_lines", lambda line: ~line_fails(line, rules)))
        .withColumns(
            {
                "n_words": F.size("_q_words").cast("long"),
                "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
                "n_symbols": _squeezed_length(text, "#*$%&|<>").cast("long"),
                "n_dup_lines": let(
                    F.filter("_q_lines", lambda line: strip_space(line) != ""),
                    lambda x: F.size(x) - F.size(F.array_distinct(x)),
                ).cast("long"),
                "n_repeat_words": repeated_words(F.col("_q_words"), rules.window),
                "clean_text": F.array_join("_q_good", "\n"),
            }
        )
    )
    short = F.col("n_words") < rules.least_words
    repeats = 100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")
    lost = F.col("word_chars") - F.length(F.translate("clean_text", SPACE, ""))
    return (
        judged.withColumns({"base_failed": short | repeats, "lost_chars": lost.cast("long")})
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * F.lit(rules.lost_share)))
        .drop("_q_words", "_q_lines", "_q_good")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_WORD_CHARS = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, generate_series(0, 4) s(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS l FROM w),
lw AS (SELECT *, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lws FROM l),
ln AS (SELECT *, len(lws) AS n, length(regexp_replace(l, '[^|>]+', '', 'g')) AS sep,
  length(regexp_replace(l, '[^#*$%&<>]+', '', 'g')) AS sym FROM lw),
bad AS (SELECT doc_id, l, n > 0 AND (
    (n >= 8 AND NOT regexp_matches(l, '[.!?:;\x{{2026}}\x{{3002}}\x{{ff01}}\x{{ff1f}}]["'')\]\x{{bb}}\x{{201d}}\x{{2019}}]*([\x20\x09-\x0D]|$)'))
    OR (sep >= 2 AND sep * 5 >= n) OR sym > n * 0.3 OR (n >= 8 AND len(list_distinct(lws)) < n * 0.34)
    OR (n <= 20 AND regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))) AS fails FROM ln),
lost AS (SELECT doc_id, sum({_WORD_CHARS.format("l")}) FILTER (WHERE fails) AS lost,
  count(*) FILTER (WHERE trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') -
  count(DISTINCT l) FILTER (WHERE trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS n_dup_lines
  FROM bad GROUP BY doc_id),
c AS (SELECT doc_id, len(ws) AS n_words, {_WORD_CHARS.format("t")} AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w JOIN lost USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= word_chars * 0.5 AS kept FROM f
"""
