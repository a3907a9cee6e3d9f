from pyspark.sql import functions as F

from skirmish.llm import substring


def test_hot_digests_go_beside_every_piece(spark):
    """One digest that 500 pieces share, one that two share and one of a single piece."""
    rows = [(i, 0, 4, 1, 1, 7) for i in range(500)] + [(i, 4, 4, 2, 2, 7) for i in range(2)] + [(9, 8, 4, 3, 3, 7)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length int, high long, low long, sig long")
    shared = pieces.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sig", "start")).alias("kept")).where("n > 1")
    got = substring._hot_join(pieces, shared.select("high", "low", "kept"), shared.where("n > 100").select("high", "low"))
    want = pieces.join(shared.drop("n"), ["high", "low"]).select(*pieces.columns, "kept")
    assert got.count() == 502 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "Join LeftOuter" in got._jdf.queryExecution().optimizedPlan().toString()
