"""Small documents tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(25)]
    rows = []

    def add(text, lang="en", source="s1"):
        rows.append((len(rows), text, lang, source, None if text is None else len(text)))

    for i, text in enumerate(base):
        add(text, source=f"s{i % 3}")
    for i in range(12):  # near copies of one text: a word changed here and there
        w = base[0].split(" ")
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        add(" ".join(w), source="s0")
    for i in range(6):
        add(base[1])  # exact copies
    add(base[2].upper())  # equal but for case
    add(None, None, None)
    add("")
    add(" \n\t ")
    add("one two")
    add("one two")
    add("a b c d e")
    add("ein Wort ä ö ü \U0001f600 straße " * 40, "de", None)
    add(" ".join(rng.choice(words) for _ in range(30_000)))  # very long
    add("la la la la la la la la la la la la")
    add("x" * 5000)
    add("line one\nline two here\nline three\nline four\nline five\nline six", source="s2")
    add("new start\nline one\nline two here\nline three\nline four\nline five\nline six", source="s2")
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for c in ("n", "size", "words", "class", "rank", "cell", "node", "blob", "bucket", "shard"):
        df = df.withColumn(c, F.lit("x"))
    return df
