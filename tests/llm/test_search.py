"""Ranked search against a plain Python ranking."""

import math
import random
import re
from collections import Counter

import pytest

from acctrisk.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    number, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * number + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * number) // max(length, 1)
            score = sum(weight[t] * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, score int, term string")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in search.search(d, q, k).collect()), key=str)


def test_random_texts_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 3)
    random.seed(3)
    words = [f"w{int(random.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties
    items = [(j, " ".join(random.choices(words, k=random.choice((1, 3, 12, 40))))) for j in range(25)] + [(99, docs[7][1])]
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_PAIRS", 2)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 1)
    docs = [(i, f"apple tree{i % 3} number {i}") for i in range(20)]
    items = [(1, "apple tree1"), (2, "tree2 7 none"), (3, "apple")]
    assert found(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    long = "Needle " + "hay " * 200_000 + "x" * 200_000
    docs = [(1, None), (2, ""), (3, " .,! "), (None, "Needle É 日本"), (None, "Needle"), (5, "needle"), (5, "needle"), (6, long), (7, "É é")]
    items = [(1, "NEEDLE"), (1, "hay É"), (2, None), (3, ""), (None, "日本"), (4, "nothing"), (5, "x" * 200_000)]
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert found(spark, docs, items) == []
