import random

import pytest

from skirmish.llm import lines, queries

from .helpers import SCHEMA, awkward, clashing, frame


def make_rows():
    rng = random.Random(3)
    pool = [f"line {i} {'x' * (i % 7)}" for i in range(60)] + ["", " "]
    rows = awkward()
    block = [rng.choice(pool) for _ in range(12)]
    for _ in range(80):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 15))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = block
        rows.append((len(rows), "\n".join(text), "en", "s", 0))
    rows += [(len(rows), "\n".join(["x", "x", "x", "x", "y", "", "x", "x"]), "en", "s", 0)]
    # The same passage in two texts of one doc_id, at the same line.
    passage = "\n".join(f"passage {i}" for i in range(5))
    return rows + [(7000, passage + "\ntail one", "en", "s", 0), (7000, passage + "\nother tail", "en", "s", 0), (7001, "x\n" + passage, "en", "s", 0)]


def in_order(rows):
    """Texts as the operator orders them, identical rows once."""
    signed = {(r[0], lines_hash(r[1]), r[1]) for r in rows if r[0] is not None and r[1] is not None}
    return sorted(signed)


def lines_hash(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain(rows, all_windows=False):
    """Sequential: a chunk that occurred before goes with what equals the lines beside
    its first copy, up to the next boundary.  With all_windows every window is a chunk:
    all that repeats goes."""
    texts, seen, out = {}, {}, {}
    for doc, sig, text in in_order(rows):
        parts = text.split("\n")
        visible = [i for i, x in enumerate(parts) if x.strip()]
        at = list(zip(visible, visible[1:]))
        chosen = [True] * len(at) if all_windows or not at else list(lines.boundaries(parts, [(a, b + 1) for a, b in at]))
        of = lambda p, i, at: "\n".join(p[at[i][0] : at[i][1] + 1])
        texts[doc, sig] = (parts, at, chosen)
        gone = set()
        for i, pick in enumerate(chosen):
            if not pick:
                continue
            home, k = seen.setdefault(of(parts, i, at), ((doc, sig), i))
            if (home, k) == ((doc, sig), i):
                continue
            theirs, their_at, their_chosen = texts[home]
            pairs = [(i, k)]
            for step in (-1, 1):
                j, m = i + step, k + step
                while 0 <= j < len(at) and 0 <= m < len(their_at) and not their_chosen[m] and of(parts, j, at) == of(theirs, m, their_at):
                    pairs.append((j, m))
                    j, m = j + step, m + step
            for j, m in pairs:
                end = their_at[m][1] if home == (doc, sig) else -1
                gone |= {x for x in range(at[j][0], at[j][1] + 1) if x > end}
        out[doc, text] = ("\n".join(x for i, x in enumerate(parts) if i not in gone), len(gone))
    return out


def got(docs, **how):
    return sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(docs, **how).collect() if r["doc_id"] is not None and r["text"] is not None)


def wanted(rows, told):
    return sorted((r[0], *told[r[0], r[1]]) for r in rows if r[0] is not None and r[1] is not None)


def test_matches_a_sequential_pass(spark, monkeypatch):
    rows = make_rows()
    want = wanted(rows, plain(rows))
    for share in (1, lines.HOT_SHARE):
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        assert got(clashing(frame(spark, rows)).repartition(3)) == want


def test_what_the_choice_of_boundaries_costs(spark):
    """Lines found, of those of all repeated passages of two lines or more; and nothing else."""
    rows = make_rows()
    every, found = plain(rows, all_windows=True), plain(rows)
    assert sum(n for _, n in found.values()) >= 0.9 * sum(n for _, n in every.values()) > 400
    for key, (text, _) in every.items():
        left = iter(found[key][0].split("\n"))
        assert all(line in left for line in text.split("\n"))  # what stays by all windows stays


def test_every_window_as_a_chunk_finds_all(spark):
    rows = make_rows()
    assert got(frame(spark, rows), divisor=1 << 31) == wanted(rows, plain(rows, all_windows=True))


def test_whole_passages_go_whatever_surrounds_them(spark, tmp_path):
    passage = [f"line {i} of the passage" for i in range(6)]
    rows = [(i, "\n".join([f"a{i}", f"b{i}", *passage[: 4 + i % 3], f"c{i}", f"{'single' if i % 2 else 'd'}"]), "en", "s", 0) for i in range(30)]
    rows[2] = (2, "\n".join(["a2", *passage, "", "c2"]), "en", "s", 0)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    told = {r["doc_id"]: r["text"].split("\n") for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert sorted(x for t in told.values() for x in t if x in passage) == passage
    assert all(sum(x.startswith(c) for x in told[i]) == 1 for i in told if i != 2 for c in "abc")
    assert sum("single" in t for t in told.values()) == 15


def test_texts_of_one_doc_id_are_told_apart(spark):
    passage = "\n".join(f"line {i}" for i in range(6))
    rows = [(1, passage + "\ntail one", "en", "s", 0), (1, passage + "\nother tail", "en", "s", 0), (2, "x\n" + passage, "en", "s", 0)]
    told = [t for _, t, _ in got(frame(spark, rows))]
    assert sum(t.count("line 0") for t in told) == 1 and sum(t.count("line 5") for t in told) == 1


@pytest.mark.parametrize("ahead", (["something new"], ["", "two", "lines"], []))
def test_boundaries_survive_a_shift(ahead):
    text = [f"line {i}" for i in range(300)]
    at = lines.windows(text)
    picked = lines.boundaries(text, at)
    assert 0.85 < picked.mean() < 0.97
    moved = ahead + text
    again = lines.boundaries(moved, lines.windows(moved))
    assert again[len(again) - len(picked) :].tolist() == picked.tolist()


def test_colliding_digests_remove_nothing(spark):
    import hashlib

    def weak(x):  # tells lines apart by their first letters only
        return hashlib.blake2b("\n".join(line[:1] for line in x).encode(), digest_size=16).digest()

    rows = [(1, "alpha\nbeta\ncc\ndd", "en", "s", 0), (2, "any\nbeta\nx", "en", "s", 0), (3, "q\ncc\ndd", "en", "s", 0)]
    assert {d: t for d, t, _ in got(frame(spark, rows), divisor=1 << 31, digest=weak)} == {1: "alpha\nbeta\ncc\ndd", 2: "any\nbeta\nx", 3: "q"}


def test_lines_that_recur_with_a_period(spark):
    """Growth is bounded, also where no boundary falls for long."""
    rows = [(i, "\n".join([f"start {i}", *["la", "li"] * 400, f"end {i}"]), "en", "s", 0) for i in range(3)]
    assert got(frame(spark, rows)) == wanted(rows, plain(rows)) or any(n > 700 for _, _, n in got(frame(spark, rows)))
    assert all(len(x[3]) + len(x[4]) <= 32 * lines.REACH for x in lines.chunks_of(rows[0][1]))


def test_empty_repeated_and_missing_ids(spark):
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "\n".join(f"l{i}" for i in range(30))
    rows = [(1, text, None, None, None)] * 2 + [(None, text, None, None, None), (1, "other\ntext", None, None, None), (4, None, None, None, None)]
    told = lines.dedup_lines(frame(spark, rows)).collect()
    assert sorted(str(r["text"]) for r in told) == sorted([text] * 3 + ["other\ntext", "None"])
