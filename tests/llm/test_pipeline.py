"""The pipeline against a plain Python version."""

from __future__ import annotations

import re

import public_tokenizers
from test_mixing import plain_fill
from test_near_text import labels_of
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerscope.llm import mixing
from ledgerscope.llm.bpe import TOKENIZER
from ledgerscope.llm.quality import BOILERPLATE, Rules

SF_DIR = "/root/testdata/sf0.001"


def line_fails(line: str, rules: Rules) -> bool:
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    separators, symbols = len(re.findall(r"[|>]", line)), len(re.findall(r"[#*$%&<>]", line))
    return n > 0 and (
        (n >= rules.line_words and not re.search(r"""[.!?:;…。！？]["')\]»”’]*(?:[\x20\x09-\x0D]|$)""", line))
        or (separators >= 2 and separators * rules.words_per_separator >= n)
        or symbols > n * rules.symbol_share
        or (n >= rules.line_words and len(set(words)) < n * rules.distinct_share)
        or (n <= rules.boilerplate_words and any(p in line.lower() for p in BOILERPLATE))
    )


def cleaned(text: str) -> str | None:
    rules = Rules()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return None
    kept = "\n".join(x for x in text.split("\n") if not line_fails(x, rules))
    chars = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))
    return kept if chars(text) - chars(kept) <= rules.lost_share * chars(text) else None


def plain_pipeline(rows):
    docs = {r["doc_id"]: (t, r["lang"], r["source"]) for r in rows if (t := cleaned(r["text"] or "")) is not None}
    last = {}
    for i, (t, *_) in docs.items():
        last[t] = max(i, last.get(t, i))
    docs = {i: d for i, d in docs.items() if last[d[0]] == i}
    ids = sorted(docs)
    first = labels_of([docs[i][0] for i in ids])
    return {i: docs[i] for place, i in enumerate(ids) if first[place] == place}


def test_stages_agree(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = plain_pipeline(rows)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR)
    kept = docs.collect()
    assert {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in kept} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept)

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    library.no_truncation()
    library.no_padding()
    final = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert final == sorted(
        (i, library.encode(want[i][0], add_special_tokens=False).ids) for i, n in copies.items() for _ in range(n)
    )


def test_budgets_of_the_mix_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    used, budget, largest = {}, {}, {}
    for r in rows:
        leaf = (r["domain"], r["language"], r["origin"])
        used[leaf] = used.get(leaf, 0) + r["copies"] * r["n_tokens"]
        budget[leaf] = r["leaf_budget"]
        largest[leaf] = max(largest.get(leaf, 0), r["n_tokens"])
    assert all(budget[k] - largest[k] < used[k] <= budget[k] for k in used)
    assert plain_fill(10, {"a": (4, 1), "b": (20, 2)}) == {"a": 3, "b": 6}
