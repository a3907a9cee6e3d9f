import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skirmish.llm import spelling

from .helpers import SCHEMA, awkward, clashing, frame


def plain_words(rows):
    """Words of the corpus, run by run."""
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            out[low] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """One letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    neighbours = {w: [o for o in words if abs(len(o) - len(w)) < 2 and near(w, o)] for w in words}
    form = {}
    for w, others in neighbours.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(neighbours[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(n=150, seed=4):
    """Words of few letters, many of them near each other, in chains of forms."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abß") for _ in range(rng.randint(4, 12))) for _ in range(80)]
    for w in list(pool):
        for _ in range(4):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcÀ")
            pool.append(rng.choice((w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :])))
    weights = [1 / (i % 37 + 1) for i in range(len(pool))]
    return [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(pool, weights, k=rng.randint(0, 120))), "en", "s", 0) for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(plain_words([r[:2] for r in rows]))
    assert len(want) > 150 and sum(w[4] for w in want) > 500 and max(sum(1 for x in want if x[2] == w[0]) for w in want) > 3
    docs = clashing(frame(spark, rows)).withColumn("word", F.lit("x"))
    assert got(spelling.group_variants(docs)) == want
    # Lists cut into blocks, chunks that end within a list, long words apart, a frequent gram split early.
    for name, value in (("CHUNK_WORDS", 50), ("LONG_WORD", 8), ("FREQUENT", 3)):
        monkeypatch.setattr(spelling, name, value)
    monkeypatch.setattr(spelling.in_blocks, "__defaults__", (4,))
    monkeypatch.setattr(spelling.gram_dictionary, "__defaults__", (100_000, 200_000))
    assert got(spelling.group_variants(docs.repartition(5))) == want


def test_awkward_rows(spark):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(20_000))
    odd = [long, long[:9000] + long[9001:], long[:-1] + "z", long[1:] + "y", "tion" * 50, "tion" * 49 + "tio"]
    rows = awkward() + [(3, "hello hello hello hallo", None, None, None), (None, "hallo hallo, HALLO", None, None, None)] * 2
    rows += [(5000 + i, " ".join([w] * 4), None, None, None) for i, w in enumerate(odd)]
    assert got(spelling.group_variants(frame(spark, rows))) == brute(plain_words([r[:2] for r in rows]))
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("frequent", (False, True))
def test_near_words_meet_in_a_list(frequent):
    """Whatever the dictionary: the bound leaves a gram, and near words share a list."""
    rng = random.Random(7)
    for round in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(5, 16)))
        i, c = rng.randrange(len(word) + 1), rng.choice("abc")
        other = rng.choice((word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]))
        grams = {w[p : p + q] for w in (word, other) for q in range(2, 7) for p in range(len(w) - q + 1)}
        dictionary = {g: rng.randint(1, 9) for g in sorted(grams) if len(g) == 2 or frequent or rng.random() < 0.5}
        for w in (word, other):
            for shorter in (len(w), len(w) - 1):
                if shorter >= 5:
                    q = spelling.longest_gram(shorter)
                    told = spelling.decompose(w, dictionary, q)
                    assert spelling.affected(told, len(w), q) < len(told)
        if near(word, other):
            assert {k for _, k, _ in spelling.list_keys(word, dictionary)} & {k for _, k, _ in spelling.list_keys(other, dictionary)}
