from skirmish.llm import jaccard

from .helpers import frame


def test_texts_of_one_doc_id_are_kept_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, b), (7, c), (7, c), (7, c.upper()), (7, c + " more"), (8, c), (9, ""), (9, None), (9, "")]
    got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()]
    sevens = [r for r in got if r[0] == 7]
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted([(5, a), (2, b), (9, ""), (9, None)], key=str)
    assert len(sevens) == 1 and sevens[0] in rows
    # Two texts of the least doc_id in groups of their own.
    rows = [(1, a), (1, b), (3, a), (4, b), (4, c)]
    got = {(r["doc_id"], r["text"]) for r in jaccard.keep_one(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()}
    assert got == {(1, a), (1, b), (4, c)}
