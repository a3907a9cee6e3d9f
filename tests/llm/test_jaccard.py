import re

import pytest

from skirmish.llm import jaccard

from .helpers import SCHEMA, awkward, clashing, frame


def brute(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for doc, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = word.findall(low)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_awkward_rows_match_all_pairs(spark):
    rows = awkward()
    assert got(jaccard.link_documents(clashing(frame(spark, rows)))) == brute(rows)


@pytest.mark.parametrize("stars", [0, 1, 6])
def test_generated_groups_match_all_pairs(spark, stars, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "MAX_STARS", stars)
    rng = random.Random(stars)
    words = [f"w{i}" for i in range(300)]
    rows = []
    passage = [rng.choice(words) for _ in range(40)]
    for g in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[: rng.randrange(len(w))] + passage
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    members = frame(spark, rows)
    found = jaccard.link_documents(members)
    assert got(found) == brute(rows)


def test_open_pairs_are_compared_after_the_stars(spark, monkeypatch):
    original = jaccard.class_links
    monkeypatch.setattr(jaccard, "class_links", lambda members: original(members, max_stars=0))
    rows = awkward()
    assert got(jaccard.link_documents(frame(spark, rows))) == brute(rows)


def test_many_fragments_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", 500)
    monkeypatch.setattr(jaccard, "FLUSH_GRAMS", 700)
    rows = awkward()
    assert got(jaccard.link_documents(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("blocks", [3, 2048])
def test_hot_grams_texts_and_levels_give_the_same(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "FRAGMENT_GRAMS", 500)
    monkeypatch.setattr(jaccard, "FLUSH_GRAMS", 700)
    monkeypatch.setattr(jaccard, "LEVEL", 4)
    monkeypatch.setattr(jaccard, "HOT_LOCAL", 2)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 4)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", blocks)
    rows = awkward()
    rows += [(len(rows) + i, rows[0][1] if i % 2 else rows[0][1] + f" more words of number {i}", "en", "s", 0) for i in range(40)]
    # The same passage in texts that don't link.
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(len(rows) + i, passage + "".join(f" own{i}x{j}" for j in range(5 + i % 9)), "en", "s", 0) for i in range(30)]
    docs = frame(spark, rows)
    assert len(jaccard.hot_grams(jaccard.document_sets(docs))[0]) > 20
    monkeypatch.setattr(jaccard, "MAX_STARS", 0 if blocks == 3 else 2)
    assert got(jaccard.link_documents(docs.repartition(3))) == brute(rows)


def test_empty_and_repeated_and_missing_ids(spark):
    assert jaccard.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d e f", "en", "s", 1)] * 2 + [(None, "a b c d e f", "en", "s", 1), (3, None, None, None, None)]
    out = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.link_documents(frame(spark, rows)).collect())
    assert out == [("3", 0, "3"), ("7", 2, "7"), ("7", 2, "7"), ("None", 2, "None")]


def test_keep_one_keeps_the_least_of_each_group(spark):
    rows = awkward()
    want = sorted(d for d, (_, root) in brute(rows).items() if d == root)
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {r["node"]: r["root"] for r in jaccard.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def link_numbers(rows):
    """doc_id: (links to other sets, links to other rows), by all pairs."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for doc, text, *_ in rows:
        w = word.findall(text.lower())
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    meet = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    distinct = set(sets.values())
    return {d: (sum(meet(s, o) for o in distinct if o != s), sum(meet(s, o) for e, o in sets.items() if e != d)) for d, s in sets.items()}


@pytest.mark.parametrize("grams, members", [(500_000, 2048), (300, 2048), (500_000, 3)])
def test_every_link_within_a_component_counts(spark, monkeypatch, grams, members):
    """Dense groups, in which stars leave most pairs untested, and copies."""
    import random

    monkeypatch.setattr(jaccard, "COUNT_GRAMS", grams)
    monkeypatch.setattr(jaccard, "COUNT_MEMBERS", members)
    rng = random.Random(3)
    rows = []
    for _ in range(5):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(500)}"
            rows += [(len(rows) + i, " ".join(w), "en", "s", 0) for i in range(rng.randint(1, 3))]
    out = jaccard.link_documents(frame(spark, rows).repartition(3)).collect()
    want = link_numbers(rows)
    assert {r["doc_id"]: (r["class_links"], r["doc_links"]) for r in out} == want
    assert max(n for n, _ in want.values()) > 5
