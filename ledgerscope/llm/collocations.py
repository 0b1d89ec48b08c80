"""Phrase collocations: candidates from Misra-Gries summaries per hash partition, then an exact count.

First pass: every worker counts the hashes of all word sequences of up to ``words`` words in portions of ``PORTION`` words and
hands each hash partition its share, packed in arrays of four bytes a hash and one row a portion. One task a partition merges
them into a Misra-Gries summary: of more counters than the capacity holds, the largest one that has no place is
subtracted from all. What has been subtracted in sum bounds how much any counter is too low; it is kept under the threshold
by doubling the capacity whenever a cut would reach it, so the capacity ends above the partition's mass divided by the
threshold, and every sequence that occurs ``least`` times survives. Hashes that meet only add candidates.

Second pass: the survivors are counted as text, exactly. Up to ``SHIPPED`` of them (64 MB) go to the workers, which count only what
survived; more of them stay in their table, and a semi join on the hash sorts out what the workers count. Both give the same rows.

Parts of a frequent phrase are at least as frequent, so all counts that a score needs are among the exact ones. Scores and
shares are computed in decimals.

Defined results: null text counts as empty and a null language as ``und``. Repeated rows count as often as they are there. A text
without a word adds nothing; an empty table gives an empty table. Other columns are left out.
"""

from __future__ import annotations

import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import stored, table, whole_text

THRESHOLD, WORDS, TOP = 30, 4, 2000
#: A longer phrase takes the place of a shorter one at so many hundredths of its count.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: The characters that end a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: So many words are counted together.
PORTION = 1_000_000
#: A hash partition has about so many sequences at most, and a summary begins with so many counters.
MASS, COUNTERS = 1 << 28, 1 << 16
#: Counters are merged when so many wait.
WAITING = 1 << 21
#: So many surviving hashes are sent to the workers.
SHIPPED = 1 << 23

_TOKEN = re.compile(rb"[^\x20\x09]+")
_BREAK = b"\n"
_PLAIN = bytes.maketrans(
    string.ascii_uppercase.encode() + PIECE_ENDS.encode(), string.ascii_lowercase.encode() + _BREAK * len(PIECE_ENDS)
)
_SEED = 12
_COUNTED = "lang string, words int, phrase string, code long, n long"


class Portion:
    """The words of some texts as numbers, with a break between pieces."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {_BREAK: 0}
        self.langs: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.lang_parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        # UTF-8 has no letter A-Z or mark inside another character.
        tokens = _TOKEN.findall(text.translate(_PLAIN).replace(_BREAK, b" " + _BREAK + b" "))
        if not tokens:
            return
        tokens.append(_BREAK)
        number = self.number
        try:
            found = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
        except KeyError:
            for word in dict.fromkeys(tokens):
                number.setdefault(word, len(number))
            found = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(found)
        self.lang_parts.append(np.full(len(found), self.langs.setdefault(lang, len(self.langs)), np.int32))
        self.size += len(found)

    def close(self) -> None:
        """Puts the parts together; ``hashes`` and ``within`` use them."""
        self.words = np.concatenate(self.parts)
        self.lang = np.concatenate(self.lang_parts)
        digest = xxhash.xxh64_intdigest
        self.word_hash = np.fromiter((digest(w, _SEED) for w in self.number), np.uint64, len(self.number))
        self.lang_hash = np.fromiter((digest(x.encode(), _SEED + 1) for x in self.langs), np.uint64, len(self.langs))

    def sequences(self, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to ``words``: the places where sequences begin that no break divides, and their hashes."""
        at = np.flatnonzero(self.words)
        mixed = self.lang_hash[self.lang[at]]
        for n in range(1, words + 1):
            following = self.words[at + n - 1]  # a break ends every text
            inside = following != 0
            at, mixed = at[inside], mixed[inside]
            mixed = _mix(mixed ^ self.word_hash[following[inside]])
            yield n, at, mixed


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[Portion]:
    """Portions of the rows ``lang, text``, the text as bytes."""
    portion = Portion()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            portion.add(lang.as_py(), text.as_py())
            if portion.size >= PORTION:
                portion.close()
                yield portion
                portion = Portion()
    if portion.size:
        portion.close()
        yield portion


def _codes(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """The partition in the upper half, 32 more bits of the hash in the lower one."""
    parts = np.uint64(partitions)
    return ((hashes % parts) << np.uint64(32) | (hashes // parts) & np.uint64(0xFFFFFFFF)).view(np.int64)


class Summary:
    """A Misra-Gries summary that others can be merged into; no count is too low by ``threshold`` or more."""

    def __init__(self, threshold: int, counters: int = COUNTERS):
        self.threshold, self.capacity, self.cut = threshold, counters, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= max(WAITING, self.capacity):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        while len(self.keys) > self.capacity:
            place = len(self.keys) - self.capacity - 1
            over = int(np.partition(self.counts, place)[place])
            if self.cut + over >= self.threshold:
                self.capacity *= 2
                continue
            self.cut += over
            stay = self.counts > over
            self.keys, self.counts = self.keys[stay], self.counts[stay] - over

    def survivors(self) -> np.ndarray:
        """The keys that may have been there ``threshold`` times."""
        self.settle()
        return self.keys[self.counts + self.cut >= self.threshold]


def _packed_counts(docs: DataFrame, words: int, partitions: int) -> DataFrame:
    """A row for each portion and hash partition: sorted hashes, and their counts (one byte each where 255 suffice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches):
            codes = _codes(np.concatenate([h for _, _, h in portion.sequences(words)]), partitions)
            codes, counts = np.unique(codes, return_counts=True)
            part = codes >> 32
            bounds = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else [0]
            keys, more = codes.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
            large = counts.copy()
            large[counts < 255] = 0
            rows = {"part": [], "keys": [], "counts": [], "large": []}
            for a, b in itertools.pairwise(bounds):
                rows["part"].append(int(part[a]))
                rows["keys"].append(keys[a:b].tobytes())
                rows["counts"].append(more[a:b].tobytes())
                rows["large"].append(large[a:b][large[a:b] > 0].tobytes())
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    return docs.mapInArrow(run, "part long, keys binary, counts binary, large binary")


def _unpacked(keys: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(counts, np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(large, np.int64)
    return np.frombuffer(keys, np.uint32), values


def candidates(docs: DataFrame, threshold: int, words: int, partitions: int, counters: int = COUNTERS) -> DataFrame:
    """``code`` of every sequence of ``lang, text`` that occurs ``threshold`` times, and of some others."""
    packed = _packed_counts(docs, words, partitions).repartition("part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c for c in b.columns], strict=True))
        for part, group in itertools.groupby(rows, key=lambda r: r[0].as_py()):
            summary = Summary(threshold, counters)
            for _, *blobs in group:
                summary.merge(*_unpacked(*[x.as_py() for x in blobs]))
            codes = summary.survivors().astype(np.int64) + (part << 32)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], ["code"])

    return packed.mapInArrow(run, "code long")


def _counted(docs: DataFrame, words: int, partitions: int, kept) -> DataFrame:
    """Counts of whole sequences by portion, of those in ``kept`` or of all; ``words`` 0 counts all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_kept = None if kept is None else kept.value
        for portion in _portions(batches):
            names, langs = np.array([w.decode() for w in portion.number], object), np.array(list(portion.langs), object)
            total = np.bincount(portion.lang[portion.words != 0], minlength=len(langs))
            yield _rows(langs, 0, [""] * len(langs), np.full(len(langs), -1), total)
            for n, at, hashes in portion.sequences(words):
                codes = _codes(hashes, partitions)
                if codes_kept is not None:
                    if not len(codes_kept):
                        continue
                    place = np.minimum(np.searchsorted(codes_kept, codes), len(codes_kept) - 1)
                    stay = codes_kept[place] == codes
                    at, codes = at[stay], codes[stay]
                columns = {"lang": portion.lang[at], "code": codes}
                columns |= {f"w{k}": portion.words[at + k] for k in range(n)}
                same = pd.DataFrame(columns).groupby(list(columns), sort=False).size().reset_index(name="n")
                phrases = names[same["w0"].to_numpy()]
                for k in range(1, n):
                    phrases = phrases + " " + names[same[f"w{k}"].to_numpy()]
                for a in range(0, len(same), 65_536):  # short batches, whatever the portion holds
                    part = same.iloc[a : a + 65_536]
                    yield _rows(langs[part["lang"]], n, phrases[a : a + 65_536], part["code"], part["n"])

    return docs.mapInArrow(run, _COUNTED)


def _rows(lang, words: int, phrases, codes, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lang, pa.string()), pa.array(np.full(len(counts), words), pa.int32()), pa.array(phrases, pa.string()),
            pa.array(codes, pa.int64()), pa.array(counts, pa.int64()),
        ],
        ["lang", "words", "phrase", "code", "n"],
    )


def frequent_sequences(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    words: int = WORDS,
    counters: int = COUNTERS,
    shipped: int = SHIPPED,
) -> DataFrame:
    """``lang, words, phrase, n`` of all sequences that occur ``threshold`` times, written; ``words`` 0 is the sum of all words."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), whole_text(text_col).cast("binary").alias("text"))
    # Every second byte begins a word at most, and every word as many sequences as words are counted.
    mass = (texts.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0) * words
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = int(max(least, mass // MASS + 1))
    found = stored(candidates(texts, threshold, words, partitions, counters), "phrase-candidates")
    if found.limit(shipped + 1).count() <= shipped:
        codes = np.sort(found.toArrow()["code"].to_numpy())
        counted = _counted(texts, words, partitions, spark.sparkContext.broadcast(codes))
    else:
        counted = _counted(texts, words, partitions, None)
        counted = counted.where("words = 0").union(counted.where("words > 0").join(found, "code", "left_semi").select(counted.columns))
    counted = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(counted.where((F.col("n") >= threshold) | ((F.col("words") == 0) & (F.col("n") > 0))), "frequent-sequences")


def _part(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    words: int = WORDS,
    top: int = TOP,
    covered: int = COVERED,
    counters: int = COUNTERS,
    shipped: int = SHIPPED,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    counted = frequent_sequences(docs, lang_col, text_col, threshold, words, counters, shipped)
    sequences = counted.where("words > 0")
    phrases = sequences.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    size = F.col("words")

    # What a longer phrase covers: its sequences of two words or more.
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _part(F.col("phrase"), i, n)),
        )
    )
    longer = phrases.where(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("by"))
    most = longer.groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    open_ = phrases.join(most, ["lang", "phrase"], "left").where(
        F.col("by").isNull() | (_decimal("by") * 100 < _decimal("a") * covered)
    )

    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = open_.select("lang", "phrase", "words", "a", cut)
    side = F.explode(
        F.array(
            F.struct(F.lit("l").alias("side"), _part(F.col("phrase"), F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit("r").alias("side"), _part(F.col("phrase"), F.col("k") + 1, size - F.col("k")).alias("part")),
        )
    ).alias("s")
    parts = cuts.select("lang", "phrase", "a", "k", side).select("lang", "phrase", "a", "k", "s.*")
    known = sequences.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    found = parts.join(known, ["lang", "part"])
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("of_part")))
    both = found.groupBy("lang", "phrase", "a", "k").agg(of("l").alias("l"), of("r").alias("r"))
    both = both.withColumn("score", F.expr(f"cast(a AS decimal(20,0)) * {SCALE} div (cast(l AS decimal(20,0)) + r)"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    scored = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(generate_series(1, len(ws) - size + 1),
  lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(ws) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
inside AS (SELECT lang, phrase, max(by_) AS by_ FROM (
  SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, a AS by_
  FROM c, (VALUES (2), (3)) AS s(n), (VALUES (1), (2), (3)) AS o(i) WHERE n < size AND i + n - 1 <= size) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase)
  WHERE by_ IS NULL OR 100::HUGEINT * by_ < {COVERED}::HUGEINT * a),
cuts AS (SELECT kept.lang, kept.phrase, kept.a, k, x.a AS l, y.a AS r,
  ({SCALE}::HUGEINT * kept.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM kept, (VALUES (1), (2), (3)) AS s(k), f AS x, f AS y
  WHERE k < kept.size AND x.lang = kept.lang AND y.lang = kept.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  AND y.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= {TOP}
"""
