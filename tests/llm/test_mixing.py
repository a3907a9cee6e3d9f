import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skirmish.llm import mixing

from .helpers import SCHEMA, awkward, clashing, frame


def targets(sizes):
    """By the words of the contract: reshare the excess until none is above."""
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return {**capped, **share}
        capped |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 3}, {f"s{i}": (i * 37) % 101 + 1 for i in range(23)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_awkward_rows(spark):
    rows = awkward()
    df = clashing(frame(spark, rows)).drop("size")
    got = mixing.Mix(df, block_words=8).taken().collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    per = defaultdict(int)
    for d, s in source.items():
        per[s] += size[d]
    want, taken = targets(per), defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == per[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(8, 0.02 * t)
    again = mixing.Mix(df.repartition(7), block_words=8).taken().collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_shards_are_disjoint_equal_and_mixed(spark):
    rows = [(i, "w " * (50 + i % 90), "en", f"s{i % 4}", 0) for i in range(400)]
    mix = mixing.Mix(frame(spark, rows), block_words=8, shard_words=4000)
    draws = mix.shuffled().collect()
    assert len({(d["doc_id"], d["block"], d["epoch"]) for d in draws}) == len(draws)
    shards = Counter(d["shard"] for d in draws)
    assert len(shards) == 1 << mix.levels and max(shards.values()) - min(shards.values()) <= mix.levels + 1
    for s, n in shards.items():
        assert sorted(d["position"] for d in draws if d["shard"] == s) == list(range(n))
    whole = Counter(d["doc_id"] % 4 for d in draws)
    for s, n in shards.items():
        part = Counter(d["doc_id"] % 4 for d in draws if d["shard"] == s)
        assert all(abs(part[k] / n - whole[k] / len(draws)) < 0.12 for k in whole)


def test_the_tree_decides(spark, monkeypatch):
    rows = [(i, "w " * (50 + i % 90), "en", f"s{i % 4}", 0) for i in range(200)]
    docs = frame(spark, rows)

    def drawn():
        return sorted(map(tuple, mixing.Mix(docs, block_words=8, shard_words=4000).draws.select("doc_id", "block", "epoch", "shard").collect()))

    whole, tree = drawn(), mixing.splitting_tree
    leaves = tree(spark.createDataFrame([(0, 1000), (1, 37), (2, 0)], "source_id int, quota long"), 3, 5).collect()
    for source, quota in ((0, 1000), (1, 37)):
        own = sorted((r["start"], r["quota"]) for r in leaves if r["source_id"] == source)
        assert sum(q for _, q in own) == quota and all(a + q == b for (a, q), (b, _) in zip(own, own[1:]))
    sums = Counter()
    for r in leaves:
        sums[r["shard"]] += r["quota"]
    assert sorted(sums) == list(range(8)) and max(sums.values()) - min(sums.values()) <= 3
    # Other splits move blocks to other shards; a shard without quotas draws nothing.
    monkeypatch.setattr(mixing, "splitting_tree", lambda s, levels, seed: tree(s, levels, seed + 1))
    other = drawn()
    assert other != whole and [r[:3] for r in other] == [r[:3] for r in whole]
    monkeypatch.setattr(mixing, "splitting_tree", lambda s, levels, seed: tree(s, levels, seed).where("shard <> 1"))
    assert drawn() == [r for r in whole if r[3] != 1]


def test_texts_of_one_doc_id(spark):
    rows = [(1, f"a{i} b{i} c{i} d{i}", "en", "x", 5) for i in range(12)] + [(None, f"n{i} m{i}", "en", "x", 5) for i in range(6)] + [(2, "same text here", "en", "y", 3)] * 4
    df = frame(spark, rows)
    first = sorted(map(tuple, mixing.mix_documents(df, block_words=1).collect()), key=str)
    for again in (df.repartition(5), df.orderBy("text"), df.orderBy(df.text.desc())):
        assert sorted(map(tuple, mixing.mix_documents(again, block_words=1).collect()), key=str) == first
    taken = mixing.Mix(df, block_words=1).taken()
    assert taken.count() == len(rows) and taken.where("taken > 2 * size").count() == 0
    assert sum(len(r[1].split()) for r in first) == sum(r["taken"] for r in taken.collect())


def test_hypergeometric_moments(spark):
    from pyspark.sql import functions as F

    for total, good, drawn in ((40, 15, 20), (3, 1, 1), (5, 5, 3), (100_000_000, 30_000_000, 50_000_000)):
        x = mixing._hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(drawn).cast("long"), F.col("id"))
        r = spark.range(4000).select(x.alias("x")).agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
        mean = good * drawn / total
        var = drawn * good / total * (1 - good / total) * (total - drawn) / max(1, total - 1)
        assert abs(r[0] - mean) <= 5 * (var / 4000) ** 0.5 + 1e-9
        assert abs(r[1] - var) <= 0.12 * var + 1e-9
        assert max(0, drawn - (total - good)) <= r[2] and r[3] <= min(good, drawn)


def test_mixed_texts_follow_the_draws(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20 + i)) + ("\n" if i % 2 else ""), "en", f"s{i % 3}", 9) for i in range(30)]
    df = frame(spark, rows)
    out = mixing.mix_documents(df, block_words=7)
    assert out.columns == df.columns
    taken = defaultdict(int)
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(rows[r["doc_id"]][1].split())
        taken[r["doc_id"]] += len(r["text"].split())
    want = {r["doc_id"]: r["taken"] for r in mixing.Mix(df, block_words=7).taken().collect() if r["taken"]}
    assert taken == want


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.Mix(empty).taken().count() == 0 and mixing.mix_documents(empty).count() == 0
    rows = [(1, "a b c", None, "x", 5)] * 3 + [(None, "d e", None, None, None)]
    got = mixing.Mix(frame(spark, rows), block_words=1).taken().collect()
    assert len(got) == 4 and all(r["taken"] <= 2 * r["size"] for r in got)


def test_large_draws_are_exact_too(spark):
    """Chi-square of draws with a spread of 50 against the distribution itself."""
    import numpy as np

    total, good, drawn, times = 40_000, 20_000, 20_000, 3000
    got = np.array([r[0] for r in spark.range(times).select(mixing._hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(drawn).cast("long"), F.col("id"))).collect()])
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = np.arange(9_500, 10_500)
    mass = np.exp([choose(good, int(k)) + choose(total - good, drawn - int(k)) - choose(total, drawn) for k in at])
    cuts = at[np.searchsorted(np.cumsum(mass), np.arange(1, 10) / 10)]
    expected = times * np.diff(np.r_[0, np.cumsum(mass)[np.searchsorted(at, cuts)], 1])
    seen = np.diff(np.r_[0, [(got <= c).sum() for c in cuts], times])
    assert abs(mass.sum() - 1) < 1e-6 and ((seen - expected) ** 2 / expected).sum() < 30
