import random
from collections import defaultdict

from skirmish.llm import queries, substring

from .helpers import SCHEMA, clashing, frame
from .test_substring import rows_with_passages


def chunked(data):
    ends = substring.cuts(data).tolist()
    return list(zip([0, *ends], ends))


def collected(df):
    return [(r["doc_id"], r["start"], r["end"], r["n_chunks"], r["first_doc_id"], r["is_first"]) for r in df.collect()]


def check(rows, got):
    """The first place of a repeated chunk stays whole, every other one goes,
    and what goes occurs in an earlier document or place."""
    data = {d: t.encode() for d, t, *_ in rows if d is not None and t}
    owners, first = defaultdict(set), {}
    for doc in sorted(data):
        for a, b in chunked(data[doc]):
            owners[data[doc][a:b]].add(doc)
            first.setdefault(data[doc][a:b], (doc, a))
    gone = {d: set() for d in data}
    for doc, a, b, _, _, is_first in got:
        if not is_first:
            gone[doc] |= set(range(a, b))
    for doc in data:
        for a, b in chunked(data[doc]):
            chunk = data[doc][a:b]
            if len(owners[chunk]) > 1:
                lost = len(gone[doc] & set(range(a, b)))
                assert lost == (0 if first[chunk] == (doc, a) else b - a)
    return data, gone


def test_first_places_stay_and_the_others_go(spark, monkeypatch):
    rows, *_ = rows_with_passages()
    for share, sent in ((substring.HOT_SHARE, substring.BROADCAST_BYTES), (substring.HOT_SHARE, -1), (1, 0)):
        monkeypatch.setattr(substring, "HOT_SHARE", share)
        monkeypatch.setattr(substring, "BROADCAST_BYTES", sent)
        check(rows, collected(substring.decided_spans(clashing(frame(spark, rows)), least=1)))


def test_spans_reach_the_ends_of_passages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (40, 60, 90)]
    # The first document holds a piece of every passage, later ones all of it.
    rows = [(0, " ".join("#" + p[len(p) // 2 : len(p) // 2 + 70] + "#" for p in passages), "en", "s", 0)]
    places = {}
    for i in range(1, 25):
        before, after = (chr(0x41 + i) + " ".join(word().upper() for _ in range(40)) + chr(0x41 + i) for _ in range(2))
        rows.append((i, before + passages[i % 3] + after, "en", "s", 0))
        places[i] = (len(before), len(before) + len(passages[i % 3]))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = collected(queries.op8_substring(spark, str(tmp_path)))
    data, _ = check(rows, collected(substring.decided_spans(frame(spark, rows), least=1)))
    first, whole = {}, 0
    for doc in range(25):
        for a, b in chunked(data[doc]):
            first.setdefault(data[doc][a:b], (doc, a))
    for i in range(4, 25):
        (a, b), = [g[1:3] for g in got if g[0] == i and not g[5]]
        kept = [(x, y) for x, y in chunked(data[i]) if first[data[i][x:y]] == (i, x) and sum(data[i][x:y] in d for d in data.values()) > 1]
        assert a == places[i][0] or a in {y for _, y in kept}
        assert b == places[i][1] or b in {x for x, _ in kept}
        whole += (a, b) == places[i]
    assert whole > 15
    # First holders of a passage keep what the piece in document 0 doesn't hold.
    assert all(any(g[0] == i and g[5] for g in got) for i in (1, 2, 3))


def test_empty_repeated_and_missing_ids(spark):
    assert substring.decided_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(str(i * i) for i in range(200))
    rows = [(1, text, None, None, None)] * 2 + [(None, text, None, None, None)]
    assert substring.decided_spans(frame(spark, rows)).count() == 0
    got = collected(substring.decided_spans(frame(spark, [*rows, (2, text, None, None, None)])))
    assert {(d, a, b, f) for d, a, b, _, _, f in got if not f} == {(2, 0, len(text), False)} and {g[0] for g in got} == {1, 2}
