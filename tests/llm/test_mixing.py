"""Budgets against a plain recursive version, prefixes against sorting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from ledgerscope.llm.mixing import Plan, mix, mixed_documents

PLAN = Plan(
    domain={"d0": 3, "d1": 1}, language={"en": 5}, origin={"src0": 2, "src4": 7}, budget_percent=80, max_epochs=3, seed="t"
)


def plain_fill(budget: int, children: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Children have supply and weight."""
    open_, out, left = dict(children), {}, budget
    while True:
        weight = sum(w for _, w in open_.values())
        full = {c: s for c, (s, w) in open_.items() if s * weight <= left * w}
        if not full:
            break
        for c, s in full.items():
            out[c] = s
            left -= s
            del open_[c]
    weight = sum(w for _, w in open_.values())
    return out | {c: left * w // weight for c, (_, w) in open_.items()}


def plain_mix(rows):
    tokens, docs = defaultdict(int), []
    for i, text, lang, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        domain = f"d{int(re.search('[0-9]+$', source)[0]) % 4}"
        docs.append((i, domain, lang, source, n))
        tokens[domain, lang, source] += n
    supply = lambda p: sum(v for k, v in tokens.items() if k[: len(p)] == p) * PLAN.max_epochs
    names = lambda p: {k[len(p)] for k in tokens if k[: len(p)] == p}
    weights = (PLAN.domain, PLAN.language, PLAN.origin)
    budgets = {(): sum(tokens.values()) * PLAN.budget_percent // 100}
    for level in range(3):
        for p in [p for p in budgets if len(p) == level]:
            children = {c: (supply((*p, c)), weights[level].get(c, 1)) for c in names(p)}
            budgets |= {(*p, c): b for c, b in plain_fill(budgets[p], children).items()}
    out, run = {}, defaultdict(int)
    order = sorted(docs, key=lambda d: (int(hashlib.md5(f"t:{d[0]}".encode()).hexdigest()[:13], 16), d[0]))
    for i, *leaf, n in order:
        leaf = tuple(leaf)
        run[leaf] += n
        total, budget = tokens[leaf], budgets[leaf]
        out[i] = (budget // total if total else 0) + (run[leaf] <= (budget % total if total else 0))
    return out, budgets


def rows(n: int, seed: int):
    rng = random.Random(seed)
    return [
        (i, "w " * rng.randint(0, 30), rng.choice(["en", "de"]), "src0" if rng.random() < 0.4 else f"src{rng.randint(1, 9)}")
        for i in range(n)
    ]


def test_mix_agrees_with_plain_version(spark):
    data = rows(500, 1)
    want, budgets = plain_mix(data)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for per_slice in (1_000_000, 25):
        got = mix(docs, PLAN, rows_per_slice=per_slice).collect()
        assert {r["doc_id"]: r["copies"] for r in got} == want
        assert {(r["domain"], r["language"], r["origin"]): r["leaf_budget"] for r in got} == {
            k: v for k, v in budgets.items() if len(k) == 3
        }
    mixed = mixed_documents(docs, PLAN)
    assert mixed.columns == docs.columns and mixed.count() == sum(want.values())


def test_shortage_goes_to_siblings_first():
    assert plain_fill(90, {"a": (10, 1), "b": (1000, 1), "c": (1000, 1)}) == {"a": 10, "b": 40, "c": 40}
