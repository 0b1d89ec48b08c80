"""Byte-pair encoding and decoding with a public word-end vocabulary.

A text is normalised (NFC, lower case by character), special tokens are cut out, and the rest is split into
pieces. A piece is a doubly linked list of symbols; its adjacent pairs wait in a priority queue by merge
rank, then by place. The best pair is merged, its neighbours form new pairs, and entries whose symbols have
changed since they were queued are skipped as stale. Decoding looks the tokens up and joins their strings.

The vocabulary is read on the driver, a file of fixed size, and broadcast. A worker keeps the tokens of up to
``CACHE`` words (``ENCODE_CACHE`` and no strings where nothing is decoded) and forgets the half used longest ago when that is full.

Defined results: null text counts as empty and has no tokens; decoded it is empty. Rows are encoded one by one, so
repeated rows get equal tokens; an empty table gives an empty table. Whole texts are encoded, whatever their
length. Input columns named like a result are replaced.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import table, whole_text, without

TOKENIZER = "word_bpe_49k.json"
CACHE, ENCODE_CACHE = 250_000, 150_000
ROWS_AT_ONCE = 128
RESULTS = ("n_tokens", "ids", "packed", "decoded")


def _byte_symbols() -> list[str]:
    """A printable character for every byte: itself if printable in Latin-1, else one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What encoding needs from a tokenizer file: tokens, merge ranks, special tokens, the pattern of pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    return {
        "ids": model["vocab"],
        "pairs": [tuple(pair) for pair in model["merges"]],
        "end": model["end_of_word_suffix"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "pattern": splits[0]["pattern"]["Regex"],
    }


def merge(symbols: list[int], ranks: list[dict[int, int]], merged: list[int]) -> list[int]:
    """Merge adjacent symbols by rank until no pair is left.

    ``ranks[a][b]`` is the rank of a pair and ``merged`` has the new symbol of a rank. A queue entry is the rank times
    ``step`` plus the place of the left symbol, so that equal ranks go from left to right.
    """
    n = step = len(symbols)
    pop, push = heapq.heappop, heapq.heappush
    queue, left = [], symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = ranks[left].get(right)
        if rank is not None:
            queue.append(rank * step + i - 1)
        left = right
    if not queue:
        return symbols
    heapq.heapify(queue)
    before, after = list(range(-1, n)), list(range(1, n + 1))
    while queue:
        rank, i = divmod(pop(queue), step)
        left, j = symbols[i], after[i]
        if left < 0 or j >= n or ranks[left].get(symbols[j]) != rank:
            continue  # stale: one of the two has been merged since
        symbols[i] = left = merged[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = ranks[left].get(symbols[k])
            if rank is not None:
                push(queue, rank * step + i)
        h = before[i]
        if h >= 0:
            rank = ranks[symbols[h]].get(left)
            if rank is not None:
                push(queue, rank * step + h)
    return [s for s in symbols if s >= 0]


def prepare(vocabulary: dict) -> dict:
    """The tables that encoding looks up, and room for what is known already."""
    ids, special, end = vocabulary["ids"], vocabulary["special"], vocabulary["end"]
    strings: list[str] = [""] * (max([*ids.values(), *special.values()]) + 1)
    for content, i in (ids | special).items():
        strings[i] = content
    nothing: dict[int, int] = {}  # most symbols begin no pair
    ranks = [nothing] * len(strings)
    merged = []
    for rank, (a, b) in enumerate(vocabulary["pairs"]):
        if ranks[ids[a]] is nothing:
            ranks[ids[a]] = {}
        ranks[ids[a]][ids[b]] = rank
        merged.append(ids[a + b])
    return {
        "inner": [ids[c] for c in _byte_symbols()], "last": [ids[c + end] for c in _byte_symbols()], "ranks": ranks,
        "merged": merged, "strings": strings, "special": special, "pattern": vocabulary["pattern"], "known": {},
    }


#: White space to Python, a symbol to the pattern.
_SEPARATORS = regex.compile("[\x1c-\x1f]").search


class Encoder:
    """Encodes and decodes texts. No piece reaches over white space, so whole words are looked up first.

    What is known of a word is remembered in two halves: when the newer one is full, the older one is forgotten, so frequent words stay.
    Without ``decodes`` the strings of the tokens are not made.
    """

    def __init__(self, tables: dict, cache: int = CACHE, decodes: bool = True) -> None:
        self.tables, self.cache, self.decodes = tables, cache, decodes
        self.known, self.older = tables["known"].setdefault(decodes, ({}, {}))
        self.split = regex.compile(tables["pattern"]).findall
        special = sorted(tables["special"], key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def _piece(self, piece: str) -> bytes:
        raw, t = piece.encode("utf-8", "surrogatepass"), self.tables
        symbols = [t["inner"][b] for b in raw]
        symbols[-1] = t["last"][raw[-1]]
        tokens = merge(symbols, t["ranks"], t["merged"])
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def word(self, word: str) -> tuple[bytes, str]:
        """The tokens of a stretch without white space, and their strings."""
        known, older = self.known, self.older
        if len(known) >= self.cache // 2:
            older.clear()
            older.update(known)
            known.clear()
        found = older.get(word)
        if found is not None:
            known[word] = found
            return found
        pieces = [word] if word.isalpha() else self.split(word)
        if len(pieces) == 1:
            packed = self._piece(pieces[0])
        else:
            packed = b"".join([(known.get(p) or self.word(p))[0] for p in pieces])
        known[word] = found = (packed, self.decode(_unpacked(packed).tolist()) if self.decodes else "")
        return found

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        special = self.tables["special"]
        cut = self.cut(text) if self.cut and any(s in text for s in special) else [text]
        known, word, out = self.known, self.word, []
        for part in cut:
            if part in special:
                out.append((struct.pack("<I", special[part]), part))
                continue
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            words = plain.split() if not _SEPARATORS(plain) else regex.split(r"\s+", plain)
            out.extend([known.get(w) or word(w) for w in words])
        return out

    def encode(self, text: str) -> bytes:
        """The tokens of a text as little-endian 32-bit integers."""
        return b"".join([packed for packed, _ in self.parts(text)])

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """The tokens, and what they decode to."""
        parts = self.parts(text)
        return b"".join([p for p, _ in parts]), " ".join([d for p, d in parts if p])

    def decode(self, ids: Iterable[int]) -> str:
        """The strings of the tokens, joined by spaces as the vocabulary has no decoder of its own."""
        strings = self.tables["strings"]
        return " ".join([strings[i] for i in ids if i < len(strings)])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")


def _token_lists(packed: list[bytes]) -> pa.Array:
    """Packed tokens as one array of lists, without an object per token."""
    ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
    values = np.frombuffer(b"".join(packed), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _coded(docs: DataFrame, text_col: str, path: str | None, decode: bool) -> DataFrame:
    """Rows through the encoder, few at a time, so that what a worker holds does not depend on Spark's batches."""
    docs = without(docs, *RESULTS)
    added = [T.StructField("n_tokens", T.LongType())] + (
        [T.StructField("packed", T.BinaryType()), T.StructField("decoded", T.StringType())]
        if decode
        else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    tables = docs.sparkSession.sparkContext.broadcast(
        prepare(load_vocabulary(path or public_tokenizers.path(TOKENIZER)))
    )
    place, rows_at_once = docs.columns.index(text_col), ROWS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker holds its copy of the broadcast over many tasks, and with it what it has encoded before.
        encoder = Encoder(tables.value, CACHE if decode else ENCODE_CACHE, decodes=decode)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                texts = [t or "" for t in part.column(place).to_pylist()]
                both = [encoder.encode_decode(t) for t in texts] if decode else [(encoder.encode(t), "") for t in texts]
                packed = [p for p, _ in both]
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                more = (
                    [pa.array(packed, pa.binary()), pa.array([d for _, d in both], pa.string())]
                    if decode
                    else [_token_lists(packed)]
                )
                names = [*part.schema.names, *[f.name for f in added]]
                yield pa.RecordBatch.from_arrays([*part.columns, counts, *more], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All rows with ``n_tokens`` and ``ids``."""
    return _coded(docs, text_col, path, decode=False)


def encode_decode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All rows with ``n_tokens``, ``packed`` (the ids as little-endian 32-bit integers) and ``decoded``."""
    return _coded(docs, text_col, path, decode=True)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
