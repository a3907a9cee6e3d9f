import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from skirmish.llm import ranked

from .helpers import SCHEMA, awkward, clashing, frame

ITEMS = "item_id long, text string"


def plain_terms(text):
    out = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in out]


def brute(rows, items, k=20):
    """Every document against every item."""
    docs = [(d, Counter(plain_terms(t))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    total, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for d, c in docs:
            m = 100 - 25 + (25 * c.total() * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, float("inf") if d is None else d))
        out += [(item, i + 1, None if d == float("inf") else d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(n=700, seed=1):
    """Documents that copy pieces of items, of each other, and many ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 30)))) for i in range(60)]
    rows = []
    for i in range(n):
        text = rng.choices(words, weights, k=rng.randint(0, 60))
        if rng.random() < 0.3:
            text += rng.choice(items)[1].split()
        rows.append((i, ", ".join(text).upper() if i % 5 == 0 else " ".join(text), "en", "s", 0))
    rows += [(n + i, rows[3][1], "en", "s", 0) for i in range(50)]
    return rows, items


def test_matches_brute_force(spark):
    rows, items = corpus()
    want = brute([r[:2] for r in rows], items)
    docs = clashing(frame(spark, rows)).withColumn("score", F.lit("x")).repartition(5)
    asked = spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit("y"))
    assert got(ranked.rank_documents(docs, asked)) == want
    # In several blocks of items, and with other numbers of places.
    assert got(ranked.rank_documents(docs, asked, block_items=25)) == want
    assert got(ranked.rank_documents(docs, asked, k=3, block_terms=400)) == brute([r[:2] for r in rows], items, 3)


def test_awkward_rows(spark):
    rows = awkward() + [(3, "one two", None, None, None), (None, "one two", None, None, None), (None, "two", None, None, None)]
    items = [(1, "one two"), (2, None), (3, " -- "), (4, "ONE one line"), (1, "Wort ä Straße"), (5, "zz9"), (5, "zz9"), (None, "la la"), (7, "x" * 5000), (8, "a b c d e")]
    assert got(ranked.rank_documents(frame(spark, rows), spark.createDataFrame(items, ITEMS))) == brute([r[:2] for r in rows], [i for i in items if i[1]])
    none = spark.createDataFrame([], ITEMS)
    assert ranked.rank_documents(frame(spark, rows), none).count() == 0
    assert ranked.rank_documents(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, ITEMS)).count() == 0


def _arrays(rng, docs, width):
    at = np.repeat(np.arange(docs), 12)
    term = np.concatenate([np.sort(rng.choice(width, 12, False)) for _ in range(docs)])
    return at, term, rng.integers(1, 1000, len(at))


def test_the_trees_leave_pairs_out_and_lose_none():
    rng = np.random.default_rng(3)
    weights = np.zeros((64, 400), np.int64)
    for i in range(64):
        weights[i, rng.choice(400, 6, False)] = rng.integers(1, 9000, 6)
    tree = ranked.item_tree(weights)
    assert sorted(i for m, a, _ in tree.nodes if a < 0 for i in m) == list(range(64))
    best, plain, scored = ranked.Best(64, 20), ranked.Best(64, 20), 0
    for b in range(6):
        docs = np.arange(b * 2000, b * 2000 + 2000)
        at, term, s = _arrays(rng, 2000, 400)
        if b > 2:
            s = s // 40 + 1  # nothing of these can be among the best
        scored += ranked.search_batch(tree, best, docs, at, term, s, np.ones(400, np.int64))
        dense = np.zeros((2000, 400), np.int64)
        dense[at, term] = s
        for i, x in enumerate(weights @ dense.T):
            plain.add(i, x[x > 0], docs[x > 0])
    for i in range(64):
        assert best.scores[i].tolist() == plain.scores[i].tolist() and best.docs[i].tolist() == plain.docs[i].tolist()
    assert scored < 0.6 * 6 * 2000 * 64


def test_whole_numbers_where_doubles_are_not_exact():
    weights = np.array([[2**40, 2**40 + 1], [1, 0]], np.int64)
    best = ranked.Best(2, 5)
    ranked.search_batch(ranked.item_tree(weights), best, np.array([7, 8]), np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2**20, 2**20 - 1, 2**20]), np.ones(2, np.int64))
    assert best.scores[0].tolist() == [2**60 + (2**40 + 1) * (2**20 - 1), (2**40 + 1) * 2**20] and best.docs[1].tolist() == [7]
