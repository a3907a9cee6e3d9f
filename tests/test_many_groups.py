import itertools

from pyspark.sql import functions as F

from skirmish.operators import reports, rules


def test_many_small_groups_share_a_pass(spark):
    """An apply, a release and an apply in each of 20,000 fights."""
    rows = spark.range(60_000).selectExpr("'log' as source_id", "id div 3 as encounter_id", "id as seq", "id * 2 as ts", "'P' || id % 3 div 3 as victim", "'stunned' as ability", "if(id % 3 = 1, 'released', 'applied') as damage_type")
    got = rules.status_pairing(rows)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    closed = got.groupBy((F.col("seq") % 3).alias("place"), "duration_s").count().orderBy("place").collect()
    assert [tuple(r) for r in closed] == [(0, 2, 20_000), (2, None, 20_000)]


def test_a_missing_key_is_a_group(spark):
    rows = spark.createDataFrame([("log", 1, 1, 5, None, "stunned", "applied"), ("log", 1, 2, 8, None, "any", "released"), ("log", 1, 3, 9, "P", "dazed", "applied")], "source_id string, encounter_id long, seq long, ts long, victim string, ability string, damage_type string")
    assert sorted((r["seq"], r["victim"], r["duration_s"]) for r in rules.status_pairing(rows).collect()) == [(1, None, 3), (3, "P", None)]


def test_halves_go_to_even_whatever_the_order(spark):
    """Together 12339 / 54 = 228.5."""
    values = [1940 / 18, 9061 / 18, 1338 / 18]
    rows = [(g, v) for g, order in enumerate(itertools.permutations(values)) for v in order]
    got = reports.metric_columns(spark.createDataFrame(rows, "g int, v double").coalesce(1), ("g",), "v")
    assert {r["average"] for r in got.collect()} == {228.0}
