"""Ranked search against scores worked out term by term in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from posegrid.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = terms(text), []
        for doc_id, tf, n in held:
            m = 100 - 75 + ((75 * n * count) // total)
            scores.append((sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if tf[t]), doc_id))
        best = sorted(((s, d) for s, d in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, d, s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out, key=str)


def corpus(rng):
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÉCOLE", "The", "THE", "a1b2"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 60))) for _ in range(150)]
    texts += [texts[3]] * 25 + [None, "", " .,;- ", "rare, once-only: term_here", "w1 " * 30_000 + "needle", "日本語 テキスト の the-THE"]
    return texts


@pytest.mark.parametrize(("block", "cells", "pairs"), [(1 << 22, 1 << 21, 200_000), (700, 50, 20)])
def test_search(spark, documents, block, cells, pairs):
    rng = random.Random(5)
    texts = corpus(rng)
    ids = [*range(len(texts) - 2), None, 7]
    asked = [(0, texts[3]), (1, "needle the THE The"), (2, None), (3, ""), (4, "no such words"), (5, "w1 w1 w1 w2"), (6, "École straße ÉCOLE 日本語"), (None, "rare TERM here"), (8, " ".join(texts[:4])), (5, "w1 w1 w1 w2")]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in asked], "item_id long, text string, term string, rank int")
    index = ranked_search.build(documents(texts, ids).repartition(5), block)
    got = ranked_search.search(index, items, 10, pairs, cells)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([*zip(ids, texts, strict=True)], asked, 10)


def test_floor_holds_every_best_document(spark, documents):
    """Upper bounds are no less, and lower bounds no more, than exact scores."""
    rng = random.Random(9)
    texts = corpus(rng)
    index = ranked_search.build(documents(texts).coalesce(1))
    rows = ranked_search.item_weights(index, spark.createDataFrame([(0, texts[0]), (1, "w1 w1 needle w59 w58")], "item_id long, text string")).collect()
    items = ranked_search.Items(rows)
    for block in ranked_search.Block.read(iter(index.blocks.toArrow().combine_chunks().to_batches())):
        places, m = items.places(block), ranked_search.lengths(block.n, index.documents, index.terms)
        for low, lower, upper in items.bounds(block, places):
            for i in range(len(lower)):
                exact = items.rescore(block, places, m, low + i, np.arange(block.size))
                assert (lower[i] <= exact).all() and (exact <= upper[i]).all()
                assert ((lower[i] > 0.9 * exact) | (exact == 0) | (m > 1000)).all()


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build(documents(["x"]).filter("doc_id < 0")), items).collect() == []
    index = ranked_search.build(documents(["w1 w1", None, ". ."]))
    assert (index.documents, index.terms) == (1, 2)
    assert ranked_search.search(index, items.filter("item_id < 0")).collect() == []


def test_very_long_counts():
    n = np.array([1, 10**9, 5], np.int64)
    assert ranked_search.lengths(n, 10**11, 10**14).tolist() == [25 + 75 * int(x) * 10**11 // 10**14 for x in n]
