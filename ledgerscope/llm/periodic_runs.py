"""Periodic runs of words, found by internal pattern matching over dyadic blocks.

A run is a stretch of words with smallest period ``q``, at least ``REPEATS * q`` and ``LEAST`` words long, that no
neighbouring word extends. The words are sorted by prefix doubling: after round ``k`` words whose next ``2**k`` words agree
have equal ranks, and the blocks of that length that start at multiples of it are kept with their interval of the suffix
array. A run with period ``q`` contains such a block of more than ``q`` and at most ``2 * q`` words, and the block occurs
again at distance ``q`` on at least one side, as four periods leave room for it. Occurrences that close form a progression whose
step is the period, so the nearest one, the range successor or predecessor of the block's place in its interval, gives the
candidate. A wavelet tree over the suffix array answers these queries. Candidates are extended both ways by comparing ranks, longest
blocks first, and stay if they are long enough.

Texts are handled together, up to ``WORDS`` words at once, with different numbers for the words of different texts; a worker
holds one such portion, or one longer text. All work on a text happens where its row is; nothing is shuffled.

Defined results: null text counts as empty; a text without a word has no runs and the collapsed text is empty. Repeated rows
are handled each for itself. An empty table gives an empty table. Input columns named like a result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import WORD, table, without

LEAST, REPEATS = 6, 4
#: So many words are sorted together.
WORDS = 250_000
RESULTS = ("runs", "collapsed")

_WORD = re.compile(WORD)
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

#: Gives the words of a row as the runs are to be searched in, from its id and its words.
Rewrite = Callable[[int | None, list[str]], list[str]]


class Wavelet:
    """A wavelet tree, level by level, over a sequence of whole numbers; all queries take arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros = []  # per level: how many of the first i values go left
        for bit in reversed(range(self.bits)):
            left = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(left, dtype=np.int32))))
            values = np.concatenate((values[left], values[~left]))

    def smaller(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of ``[low, high)`` are smaller than ``bound``, which is one of the values."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b, right = zeros[low], zeros[high], (bound >> bit) & 1 == 1
            found += np.where(right, b - a, 0)
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        return found

    def ranked(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value of ``[low, high)`` that ``place`` others precede in ascending order."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            right = place >= b - a
            place = np.where(right, place - (b - a), place)
            value |= right.astype(np.int64) << bit
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        return value


class Blocks:
    """Ranks of all stretches of ``2**k`` symbols that occur more than once, and the suffix array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols, self.levels, self.sizes = symbols, [], []
        self.order = np.empty(n, np.int64)
        rank = np.zeros(n, np.int64)
        active, key = np.arange(n), symbols.astype(np.int64)
        step = 1
        while len(active):
            # Sorted within their groups; the rank of a group is where it begins in the suffix array.
            at = np.argsort(key, kind="stable")
            active, key, base = active[at], key[at], rank[active[at]]
            index = np.arange(len(active))
            fresh = np.concatenate(([True], base[1:] != base[:-1]))
            place = base + index - np.maximum.accumulate(np.where(fresh, index, 0))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(starts, len(active)))
            self.order[place] = active
            rank[active] = np.repeat(place[starts], size)
            again = np.repeat(size, size) > 1
            active, size = active[again], np.repeat(size, size)[again]
            at = np.argsort(active)
            active = active[at]
            if step > 1:
                self.levels.append((step, active, rank[active]))
                self.sizes.append(size[at])
            following = np.zeros(len(active), np.int64)
            inside = active + step < n
            following[inside] = rank[active[inside] + step] + 1
            key = rank[active] * (n + 1) + following
            step *= 2

    def equal(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the stretches of this level that begin at ``x`` and ``y`` are the same."""
        if level < 0:
            inside = (x >= 0) & (y < len(self.symbols))
            out = np.zeros(len(x), bool)
            out[inside] = self.symbols[x[inside]] == self.symbols[y[inside]]
            return out
        _, places, ranks = self.levels[level]
        if not len(places):
            return np.zeros(len(x), bool)
        i, j = (np.minimum(np.searchsorted(places, v), len(places) - 1) for v in (x, y))
        return (places[i] == x) & (places[j] == y) & (ranks[i] == ranks[j])

    def agree(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from ``x`` on (or before it) equal those from ``y`` on (before it); ``x < y``."""
        n = np.zeros(len(x), np.int64)
        for level in reversed(range(-1, len(self.levels))):
            step = 1 if level < 0 else self.levels[level][0]
            shift = n if forward else -n - step
            n += np.where(self.equal(level, x + shift, y + shift), step, 0)
        return n


def find_runs(symbols: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """All runs of a sequence of whole numbers as rows ``start, length, period``, by start, then period."""
    none = np.empty((0, 3), np.int64)
    blocks = Blocks(symbols)
    asked = [none]
    for (step, places, ranks), size in zip(blocks.levels, blocks.sizes, strict=True):
        if step > 2 * (len(symbols) // repeats):
            break
        aligned = places % step == 0
        asked.append(np.column_stack((places, ranks, size, np.full(len(places), step)))[aligned])
    if not sum(map(len, asked)):
        return none
    at, low, size, step = np.concatenate([a.reshape(-1, a.shape[1]) for a in asked[1:]]).T
    # Only places whose two-word block occurs again are ever asked for.
    repeated = np.zeros(len(symbols), bool)
    repeated[blocks.levels[0][1]] = True
    in_order = repeated[blocks.order]
    low = np.concatenate(([0], np.cumsum(in_order)))[low]
    high = low + size
    tree = Wavelet(blocks.order[in_order])
    before = tree.smaller(low, high, at)
    pairs = []
    for side in (1, -1):
        has = before + 1 < size if side > 0 else before > 0
        i = at[has]
        near = tree.ranked(low[has], high[has], before[has] + side)
        close = np.abs(near - i) < step[has]
        pairs.append(np.column_stack((np.minimum(i, near), np.abs(near - i)))[close])
    first, period = np.unique(np.concatenate(pairs), axis=0).T
    back = blocks.agree(first, first + period, forward=False)
    length = back + blocks.agree(first, first + period, forward=True) + period
    long = length >= np.maximum(least, repeats * period)
    found = np.column_stack((first - back, length, period))[long]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words without those that repeat an earlier period of a run."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _numbered(words: list[str]) -> tuple[np.ndarray, int]:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)


def _portions(batch: pa.RecordBatch, text: int, id_at: int, rewrite: Rewrite | None) -> Iterator[tuple[int, list[list[str]]]]:
    """The first row and the words of so many rows that they have about ``WORDS`` words."""
    start, texts, total = 0, [], 0
    ids = batch.column(id_at)
    for i, value in enumerate(batch.column(text)):
        words = _WORD.findall(value.as_py() or "")
        if rewrite is not None:
            words = rewrite(ids[i].as_py(), words)
        if texts and total + len(words) > WORDS:
            yield start, texts
            start, texts, total = i, [], 0
        texts.append(words)
        total += len(words)
    if texts:
        yield start, texts


def _answers(texts: list[list[str]], least: int, repeats: int) -> tuple[pa.Array, pa.Array]:
    symbols, used = [], 0
    for words in texts:
        own, n = _numbered(words)
        symbols.append(own + used)
        used += n
    ends = np.cumsum([0, *map(len, texts)])
    runs = find_runs(np.concatenate(symbols), least, repeats)
    cuts = np.searchsorted(runs[:, 0], ends)
    runs[:, 0] -= np.repeat(ends[:-1], np.diff(cuts))
    plain = [collapsed(words, runs[a:b]) for words, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]
    fields = pa.StructArray.from_arrays([pa.array(c) for c in runs.T.copy()], _RUN.fieldNames())
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), fields), pa.array(plain, pa.string())


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rewrite: Rewrite | None = None,
    least: int = LEAST,
    repeats: int = REPEATS,
) -> DataFrame:
    """All rows with ``runs`` (by start, then period; word numbers from 0) and ``collapsed``.

    ``rewrite`` may change the words of a row before the search; ``repeats`` must be 4 or more.
    """
    if repeats < 4:
        raise ValueError("runs of fewer than four periods may escape the blocks")
    docs = without(docs, *RESULTS)
    text, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    added = [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _portions(batch, text, id_at, rewrite):
                part = batch.slice(start, len(texts))
                names = [*part.schema.names, *RESULTS]
                yield pa.RecordBatch.from_arrays([*part.columns, *_answers(texts, least, repeats)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """In one document of ten, by the checksum of its id, the words repeat with a period from some place on."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _best(runs: Column) -> Column:
    """The run with the greatest length by period, of equal ones the first."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, rewrite=planted).withColumn("_best", _best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = {c: F.col(f"_best.{c}") for c in ("start", "length", "period")}
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[c.alias(name) for name, c in best.items()],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
