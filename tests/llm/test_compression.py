import random
import zlib

import numpy as np

from skirmish.llm import compression

from .helpers import SCHEMA, awkward, clashing, frame

LABELS = "doc_id long, quality int, toxic int"
STEMS = "the and ing tion er wh sh on ea re nd".split()


def texts(n=600, seed=2):
    """Prose, and of every third document junk: menus, symbols, capitals."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(STEMS) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 90))]
        good = i % 3 > 0
        text = " ".join(words) if good else [" | ".join(words), " ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words)][i // 3 % 3]
        rows.append((i, text, "xx", f"s{i % 2}", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_held_out_rows_are_told_apart(spark):
    rows, labels = texts()
    told = spark.createDataFrame(labels, LABELS)
    docs = clashing(frame(spark, rows))
    got = compression.score_texts(docs, compression.train(docs, told)).collect()
    truth = dict((d, q) for d, q, _ in labels)
    assert [r["held_out"] for r in got] == [held(r["doc_id"]) for r in got] and len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    far = [r for r in got if r["held_out"]]
    good, bad = [r["score"] for r in far if truth[r["doc_id"]]], [r["score"] for r in far if not truth[r["doc_id"]]]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in far]) > 0.9
    # Held-out labels, sources and ids don't matter.
    turned = spark.createDataFrame([(d, 1 - q if held(d) else q, 0) for d, q, _ in labels], LABELS)
    from pyspark.sql import functions as F

    again = compression.score_texts(docs, compression.train(docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit("z")), turned)).collect()
    assert sorted((r["doc_id"], r["score"]) for r in again) == sorted((r["doc_id"], r["score"]) for r in got)


def test_against_a_plain_version(spark):
    import xxhash

    rows, labels = texts(150, 5)
    docs, told = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = compression.train(docs, told, sample=30, dictionary=4096)
    of = {r["key"]: r for r in compression.chosen_labels(told, 30).collect()}
    text, quality = {r[0]: r[1] for r in rows}, {d: q for d, q, _ in labels}
    for label, got in ((0, model.bad), (1, model.good)):
        assert sum(quality[d] == label for d in of) == 30 and all(not held(d) for d in of)
        best = {}
        for d, r in of.items():
            if quality[d] == label and not r["curve"]:
                data = text[d].encode()
                parts = sorted({(xxhash.xxh3_64_intdigest(p) >> 1, p) for p in (data[i : i + 128] for i in range(0, len(data), 128))})
                for rank, key in enumerate(parts):
                    best[key] = min(rank, best.get(key, rank))
        assert got == b"".join(p for _, (_, p) in sorted((rank, key) for key, rank in best.items())[:32])[:4096]
    sizes = [compression.compressor(d) for d in (model.bad, model.good)]
    for r in compression.score_texts(docs, model).collect():
        data = text[r["doc_id"]].encode()
        b, g = (sum(len(c.compress(data[i : i + 512])) for i in range(0, len(data), 512)) for c in sizes)
        assert r["difference"] == (b - g) / max(b, g)
        assert abs(r["score"] - 1 / (1 + np.exp(-model.intercept - model.slope * r["difference"]))) < 1e-12


def test_curve_finds_the_shares():
    x = np.repeat([-1.0, 0.0, 1.0], 1000)
    share = 1 / (1 + np.exp(-(0.5 + 2 * x)))
    y = np.tile(np.arange(1000) / 1000, 3) < share
    a, b = compression.fit_curve(x, y.astype(float), np.ones(len(x)))
    assert abs(a - 0.5) < 0.02 and abs(b - 2) < 0.03
    assert compression.fit_curve(x, 1 - y, np.ones(len(x)))[1] == 0


def test_awkward_rows(spark):
    rows, labels = texts(120)
    told = spark.createDataFrame(labels + [(1, 0, 0), (None, 1, 0), (2, None, None)], LABELS)
    model = compression.train(frame(spark, rows), told)
    odd = awkward() + [(None, "the and", None, None, None), (3, "ing", None, None, None), (3, "ing", None, None, None)]
    got = compression.score_texts(clashing(frame(spark, odd)), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r, o in zip(got, odd) if not o[1]}
    assert len(empty) == 1 and [r["difference"] for r, o in zip(got, odd) if not o[1]] == [0.0, 0.0]
    assert compression.score_texts(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_without_both_labels(spark):
    docs = frame(spark, texts(60)[0])
    none = compression.train(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in compression.score_texts(docs, none).collect()} == {0.5}
    one = compression.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS))
    assert {r["predicted"] for r in compression.score_texts(docs, one).collect()} == {1}
