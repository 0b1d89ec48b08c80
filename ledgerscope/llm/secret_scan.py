"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Spark has no function that tells where a pattern matches. Each match is therefore set between
markers, the text is split there, and the lengths of the pieces give code point offsets. The marker
is a control character that no pattern matches; where a text has it, another stands in.

Base kinds ``assign``, ``access`` and ``hex`` keep a match if it (for ``assign``: the value) is long enough. The
kind ``entropy`` takes maximal runs of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters. The character
class of a run is the narrowest of hexadecimal, upper case with digits, and base 64 that holds it;
each class has its own threshold. A window of ``WINDOW`` characters slides along the run; when it moves
by one, two counts change and the sum of c * log2(c) over the counts is updated, in whole millionths of
a bit, so that every engine gets the same number. Windows at or above the threshold are joined into spans.

Allow list: runs without a digit or without a letter, UUIDs, runs whose parts between ``-_/+=`` are words or
numbers, and runs that say example, placeholder or dummy. Spans that overlap a base span are dropped.

Defined results: null text counts as empty and has no spans; the hash is then that of empty text.
Rows are scanned one by one, so repeated rows get equal results. Adjacent pieces of very long texts
are summed in blocks, so the work stays near linear in the number of matches. An empty table gives an
empty table. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import let, table, whole_text, without

#: The base patterns and least lengths, in the order of the kinds.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{24,}"  # the runs of HEX that are long enough, without stopping at the others
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Bits a window needs by class; 20 random draws give about 3.4, 3.9 and 4.1 bits.
THRESHOLDS = {"hex": 3.0, "upper": 3.4, "base64": 3.6}
RUN_CLASS = "A-Za-z0-9+/_=-"
RUN = f"[{RUN_CLASS}]{{{WINDOW},}}"
ALLOWED = (
    r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^([A-Z]?[a-z]*[0-9]*[-_/+=])*[A-Z]?[a-z]*[0-9]*$", r"[eE][xX][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|[dD][uU][mM][mM][yY]",
)
BLOCK = 256
RESULTS = ("spans",)

_MICRO = 1_000_000
#: c * log2(c) in millionths, for counts 0 to WINDOW.
_PLOGP = [0] + [round(c * math.log2(c) * _MICRO) for c in range(1, WINDOW + 1)]


def least_sum(bits: float) -> int:
    """The largest sum of c * log2(c) at which a window still has so many bits of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * _MICRO)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at every match: gaps at even places, matches at odd ones."""
    plain = F.translate(text, "\x01", "\x02")
    return F.split(F.regexp_replace(plain, f"(?:{pattern})", "\x01$0\x01"), "\x01", -1)


#: What a text must have for a kind to occur at all; quicker to see than a match.
NEEDED = {"assign": "[:=]", "access": "AKIA", "hex": LONG_HEX, "entropy": "[0-9]"}


def matches(text: Column, pattern: str, needed: str) -> Column:
    """All matches as (start, end, value), end exclusive, in code points. A text with a match matches ``needed``."""

    def located(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p))
        return let(
            lengths,
            lambda n: F.flatten(
                F.aggregate(
                    F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK)),
                    F.struct(F.lit(0).alias("at"), _no_spans("array<array<struct<start:int,end:int,value:string>>>").alias("out")),
                    lambda acc, i: _block(acc, i, parts, n),
                    lambda acc: acc["out"],
                )
            ),
        )

    return F.when(text.rlike(needed) & text.rlike(pattern), let(pieces(text, pattern), located)).otherwise(
        _no_spans("array<struct<start:int,end:int,value:string>>")
    )


def _no_spans(kind: str) -> Column:
    return F.array().cast(kind)


def _block(acc: Column, i: Column, parts: Column, lengths: Column) -> Column:
    """Add the matches of one block of pieces; blocks start at even places."""
    done = F.aggregate(
        F.sequence(i, F.least(i + (BLOCK - 1), F.size(parts) - 1)),
        F.struct(acc["at"].alias("at"), _no_spans("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda a, k: F.struct(
            (a["at"] + F.get(lengths, k)).alias("at"),
            F.when(
                k % 2 == 1,
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            a["at"].alias("start"), (a["at"] + F.get(lengths, k)).alias("end"), F.get(parts, k).alias("value")
                        )
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
    )
    return let(
        done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))
    )


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one base kind as (start, end, kind)."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": LONG_HEX}[kind]
    value = {"assign": lambda m: F.regexp_extract(m["value"], ASSIGN, 2)}.get(kind, lambda m: m["value"])
    good = F.filter(matches(text, pattern, NEEDED[kind]), lambda m: F.length(value(m)) >= LEAST[kind])
    return F.transform(good, lambda m: _span(m["start"], m["end"], kind))


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(
        start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")
    )


def entropy_spans(text: Column) -> Column:
    """The spans whose windows reach the threshold of their run's class, as (start, end, kind)."""
    # A run starts where no character of its class stands before; runs without a digit are allowed anyway.
    runs = F.filter(matches(text, f"(?<![{RUN_CLASS}]){RUN}", NEEDED["entropy"]), lambda m: ~_any(m["value"], ALLOWED))
    found = F.transform(
        runs,
        lambda m: F.transform(_busy(m["value"]), lambda s: _span(m["start"] + s["a"], m["start"] + s["b"], "entropy")),
    )
    return F.flatten(found)


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def _limit(run: Column) -> Column:
    return (
        F.when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(least_sum(THRESHOLDS["hex"])))
        .when(run.rlike("^[A-Z0-9]+$"), F.lit(least_sum(THRESHOLDS["upper"])))
        .otherwise(F.lit(least_sum(THRESHOLDS["base64"])))
    )


def _busy(run: Column) -> Column:
    """Joined windows of a run at or above its threshold, as (a, b) offsets within the run.

    The state holds a count for each character of the alphabet and the sum over all counts. A step
    counts the entering character up and the one that leaves the window down.
    """
    plogp = F.array(*[F.lit(x) for x in _PLOGP])
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def slid(code: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"),
            F.lit(0).alias("total"),
            _no_spans("array<struct<a:int,b:int>>").alias("out"),
        )

        def step(s: Column, i: Column) -> Column:
            come, gone = F.get(code, i), F.coalesce(F.get(code, i - WINDOW), F.lit(-1))
            counts = F.transform(
                s["n"],
                lambda n, k: n + F.when(k == come, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0),
            )
            up, down = F.get(s["n"], come), F.get(s["n"], gone)
            change = F.when(come == gone, F.lit(0)).otherwise(
                F.get(plogp, up + 1) - F.get(plogp, up)
                + F.coalesce(F.get(plogp, down - 1) - F.get(plogp, down), F.lit(0))
            )
            return let(
                s["total"] + change,
                lambda total: F.struct(
                    counts.alias("n"),
                    total.alias("total"),
                    F.when((i >= WINDOW - 1) & (total <= _limit(run)), joined(s["out"], i)).otherwise(s["out"]).alias("out"),
                ),
            )

        def joined(out: Column, i: Column) -> Column:
            last = F.get(out, F.size(out) - 1)
            touches = (F.size(out) > 0) & (last["b"] >= i - (WINDOW - 1))
            a = F.when(touches, last["a"]).otherwise(i - (WINDOW - 1))
            kept = F.when(touches, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
            return F.concat(kept, F.array(F.struct(a.alias("a"), (i + 1).alias("b"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda s: s["out"])

    return let(codes, slid)


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with ``spans``, an array of (start, rank, end, kind), by start, then in the order of the kinds."""
    text = whole_text(text_col)
    base = F.flatten(F.array(*[base_spans(text, k) for k in KINDS[:3]]))
    found = without(docs, *RESULTS).withColumns({"_ss_base": base, "_ss_high": entropy_spans(text)})
    added = F.filter(
        "_ss_high",
        lambda e: ~F.exists("_ss_base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])),
    )
    return found.withColumn("spans", F.sort_array(F.concat("_ss_base", added))).drop("_ss_base", "_ss_high")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS[:3]}
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return (
        scan_secrets(docs)
        .withColumns(counts | {"base_sha256": F.sha2(_listed(base).cast("binary"), 256), "listed": _listed(spans)})
        .select("doc_id", *counts, "base_sha256", F.col("listed").alias("spans"))
    )


def _pieces_sql(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"string_split(regexp_replace(translate(t, chr(1), chr(2)), '({quoted})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"


def _matches_sql(name: str, pattern: str) -> str:
    """Matches of a pattern with their places, from the lengths of the pieces."""
    return f"""{name} AS (SELECT doc_id, v, CAST(till - length(v) AS BIGINT) AS a, CAST(till AS BIGINT) AS b FROM (
  SELECT doc_id, v, k, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY k) AS till FROM (
    SELECT doc_id, unnest(ps) AS v, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, {_pieces_sql(pattern)} AS ps FROM d)))
  WHERE k % 2 = 0)"""


def _allowed_sql() -> str:
    return " OR ".join(f"regexp_matches(v, '{p}')" for p in ALLOWED)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_matches_sql("m_assign", ASSIGN)},
{_matches_sql("m_access", ACCESS)},
{_matches_sql("m_hex", HEX)},
{_matches_sql("m_run", RUN)},
base AS (SELECT doc_id, a, b, 0 AS rank, 'assign' AS kind FROM m_assign
    WHERE length(regexp_extract(v, '{ASSIGN.replace("'", "''")}', 2)) >= {LEAST["assign"]}
  UNION ALL SELECT doc_id, a, b, 1, 'access' FROM m_access WHERE length(v) >= {LEAST["access"]}
  UNION ALL SELECT doc_id, a, b, 2, 'hex' FROM m_hex WHERE length(v) >= {LEAST["hex"]}),
runs AS (SELECT doc_id, a, v, CASE WHEN regexp_matches(v, '^([0-9a-f]+|[0-9A-F]+)$') THEN {least_sum(THRESHOLDS["hex"])}
    WHEN regexp_matches(v, '^[A-Z0-9]+$') THEN {least_sum(THRESHOLDS["upper"])} ELSE {least_sum(THRESHOLDS["base64"])} END AS most
  FROM m_run WHERE NOT ({_allowed_sql()})),
windows AS (SELECT doc_id, a, most, i, substr(v, i + 1, {WINDOW}) AS w
  FROM (SELECT *, unnest(range(0, length(v) - {WINDOW - 1})) AS i FROM runs)),
chars AS (SELECT doc_id, a, most, i, unnest(string_split(w, '')) AS c FROM windows),
sums AS (SELECT doc_id, a, most, i, sum({list(_PLOGP)}[n + 1]) AS total FROM (
  SELECT doc_id, a, most, i, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
busy AS (SELECT doc_id, a, i, CASE WHEN i > lag(i) OVER w + {WINDOW} OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS starts
  FROM sums WHERE total <= most WINDOW w AS (PARTITION BY doc_id, a ORDER BY i)),
added AS (SELECT doc_id, min(run + i) AS a, max(run + i) + {WINDOW} AS b, 3 AS rank, 'entropy' AS kind FROM (
  SELECT doc_id, a AS run, i, sum(starts) OVER (PARTITION BY doc_id, a ORDER BY i) AS g FROM busy) GROUP BY doc_id, run, g),
spans AS (SELECT * FROM base UNION ALL
  SELECT * FROM added x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.a < x.b AND x.a < b.b)),
lists AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
  count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FILTER (WHERE rank < 3) AS base_list,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_list, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""
