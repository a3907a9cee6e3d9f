import random
from collections import defaultdict

from skirmish.llm import substring

from .helpers import SCHEMA, awkward, clashing, frame


def brute(rows, least):
    owners, pieces = defaultdict(set), {}
    for doc, text, *_ in rows:
        if doc is None or not text:
            continue
        data, a, pieces[doc] = text.encode(), 0, []
        for b in substring.cuts(data).tolist():
            pieces[doc].append((a, b, data[a:b]))
            owners[data[a:b]].add(doc)
            a = b
    out = set()
    for doc, parts in pieces.items():
        run = []
        for p in [*parts, None]:
            if p and len(owners[p[2]]) > 1:
                run.append(p)
            elif run:
                if run[-1][1] - run[0][0] >= least:
                    out.add((doc, run[0][0], run[-1][1], len(run), min(min(owners[x[2]]) for x in run)))
                run = []
    return out


def rows_with_passages():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(55))
    rows = [r for r in awkward()]
    planted = set()
    for i in range(40):
        w = [word() for _ in range(120)]
        if i % 2:
            w.insert(rng.randrange(120), passage)
            planted.add(len(rows))
        rows.append((len(rows), " ".join(w), "en", "s", 0))
    return rows, planted, set(range(len(awkward()), len(rows))) - planted


def test_matches_brute_force_and_finds_passages(spark):
    rows, planted, clean = rows_with_passages()
    got = {(r["doc_id"], r["start"], r["end"], r["n_chunks"], r["first_doc_id"]) for r in substring.repeated_spans(clashing(frame(spark, rows))).collect()}
    assert got == brute(rows, substring.LEAST_SPAN)
    ids = {g[0] for g in got}
    assert planted <= ids and not clean & ids


def test_without_hot_digests_the_result_is_the_same(spark, monkeypatch):
    rows, *_ = rows_with_passages()
    monkeypatch.setattr(substring, "HOT_SHARE", 1)
    got = {(r["doc_id"], r["start"], r["end"], r["n_chunks"], r["first_doc_id"]) for r in substring.repeated_spans(frame(spark, rows)).collect()}
    assert got == brute(rows, substring.LEAST_SPAN)


def test_cuts_resist_shifts():
    rng = random.Random(4)
    data = bytes(rng.randrange(97, 120) for _ in range(6000))
    old = set(substring.cuts(data).tolist())
    new = {c - 5 for c in substring.cuts(b"12345" + data).tolist()}
    assert len(old - new) <= 3


def test_empty_repeated_and_missing_ids(spark):
    assert substring.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(str(i * i) for i in range(200))
    rows = [(1, text, None, None, None)] * 2 + [(None, text, None, None, None)]
    assert substring.repeated_spans(frame(spark, rows)).count() == 0
    assert {r["doc_id"] for r in substring.repeated_spans(frame(spark, [*rows, (2, text, None, None, None)])).collect()} == {1, 2}
