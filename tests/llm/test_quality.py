import math
import random
import re
from collections import Counter

import xxhash

from skirmish.llm import quality

from .helpers import SCHEMA, awkward, clashing, frame


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def more_rows():
    rng = random.Random(11)
    rows = awkward()
    for _ in range(60):
        words = [rng.choice("a b c d e ff # *x $%   \U0001f600\U0001f600".split(" ")) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", " \x0b"]) for w in words)
        rows.append((len(rows), text * rng.choice([1, 1, 2]), "en", "s", 0))
    rows.append((len(rows), "la " * 20_000, "en", "s", 0))
    rows.append((len(rows), "same line here\n" * 50 + "\n \n\n", "en", "s", 0))
    return rows


def test_base_measures(spark):
    rows = more_rows()
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in quality.base_measures(clashing(frame(spark, rows))).collect()}
    for doc, text, *_ in rows:
        assert got[doc] == brute(text), repr(text)[:200]


def plain_hash(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def plain_cells(words):
    """Buckets of the words and of the pairs of neighbours; signed remainders as in Spark."""
    h = [plain_hash(w) for w in words]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42))
    return [signed(x) % quality.BUCKETS for x in h], [signed(pair(a, b)) % quality.BUCKETS for a, b in zip(h, h[1:])]


def test_scores_against_a_plain_computation(spark):
    """With the real buckets, where n-grams collide."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{rng.randrange(3000)}" for _ in range(120)), "en", "s", 0) for i in range(120)]
    rows += [(7, "bad1 bad2 bad3 bad4 bad5 bad6 bad7 bad8 bad9 bad10 bad11", "en", "s", 0), (None, rows[1][1], None, None, None), (None, rows[2][1], None, None, None)]
    docs = frame(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(1, 120, 2)], "doc_id long")
    raw, target = (Counter(), Counter()), (Counter(), Counter())
    for i, text, *_ in rows:
        for k, cells in enumerate(plain_cells(text.split())):
            raw[k].update(cells)
            if i is not None and i % 2:
                target[k].update(cells)
    assert len(raw[0]) < len({w for r in rows for w in r[1].split()})  # collisions
    b = quality.BUCKETS
    ratio = lambda k, c: math.log(((target[k][c] + 1) / (sum(target[k].values()) + b)) / ((raw[k][c] + 1) / (sum(raw[k].values()) + b)))

    def score(text):
        cells = plain_cells(text.split())
        return sum(ratio(k, c) for k in (0, 1) for c in cells[k]) / sum(map(len, cells))

    want = sorted((str(i), round(score(t), 6)) for i, t, *_ in rows)
    out = quality.judge(docs, trusted).collect()
    assert sorted((str(r["doc_id"]), round(r["llr"], 6)) for r in out) == want
    assert {r["llr"] > 0 for r in out if r["doc_id"] == 7} == {True, False}


def test_without_trusted_documents_the_base_rules_decide(spark):
    rows = more_rows()
    none = spark.createDataFrame([], "doc_id long")
    for r in quality.judge(frame(spark, rows), none).collect():
        assert r["llr"] == 0 and r["kept"] == (not r["base_failed"])


def test_empty_repeated_and_missing_ids(spark):
    none = spark.createDataFrame([(1,), (None,)], "doc_id long")
    assert quality.judge(spark.createDataFrame([], SCHEMA), none).count() == 0
    rows = [(1, "a b c d e f g h i j k", None, None, None)] * 2 + [(None, "z " * 30, None, None, None), (None, None, None, None, None)]
    assert quality.judge(frame(spark, rows), none).count() == 4
