from pyspark.sql import functions as F

from skirmish.operators import rules, sessions, stats
from skirmish.plans import registry
from skirmish.sources import adapter

DIR = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_log(spark, monkeypatch):
    """The same fights and buckets, dealt to as many tasks as the rows need."""
    one = sessions.segment(adapter.swings(spark, DIR))
    want = stats.ability_stats_all(stats.bucket_fanout(one)).collect()
    rows = adapter.swings(spark, DIR).count()
    monkeypatch.setattr(sessions, "TASK_ROWS", rows // 10)
    many = sessions.segment(adapter.swings(spark, DIR))
    assert many.rdd.getNumPartitions() >= 10
    assert sorted(map(str, stats.ability_stats_all(stats.bucket_fanout(many)).collect())) == sorted(map(str, want))


def test_fan_out_reads_the_actions_once(spark):
    fanned = stats.bucket_fanout(sessions.segment(adapter.swings(spark, DIR)))
    assert "Union" not in fanned._jdf.queryExecution().optimizedPlan().toString()
    assert fanned.where(F.col("bucket").isNull()).isEmpty()


def test_parts_are_dealt_too(spark, monkeypatch):
    """The windows over parts of a log, and machines over stretches of it."""
    rows = adapter.swings(spark, DIR)
    hits = rows.where("category in (1, 2)").select("source_id", "seq", "ts", "attacker", "ability", "victim")
    ran = lambda df: sorted(map(str, df.collect()))
    island, uses = sessions.islands(rows, part_rows=50).select("seq", "island"), rules.ability_frequency(hits)
    want = ran(island), ran(uses)
    monkeypatch.setattr(sessions, "TASK_ROWS", rows.count() // 10)
    island, uses = sessions.islands(rows, part_rows=50).select("seq", "island"), rules.ability_frequency(hits)
    for df, times in ((island, 1), (uses, 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= times
    assert (ran(island), ran(uses)) == want


def test_shuffles_of_a_query_begin_with_enough_partitions(spark, monkeypatch):
    rows, own = adapter.swings(spark, DIR).count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda: registry.sized(lambda s, d: adapter.swings(s, d).groupBy("ability").count())(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert f", {own})" in dealt()
    monkeypatch.setattr(sessions, "TASK_ROWS", rows // 10)
    assert f", {-(-rows // (rows // 10))})" in dealt()
    monkeypatch.undo()
    assert f", {own})" in dealt() and int(spark.conf.get("spark.sql.shuffle.partitions")) == own


def test_bytes_of_a_task_are_bounded_while_events_are_many(spark, monkeypatch):
    own = {key: spark.conf.get(key) for key in registry.TASK_BYTES}
    now = lambda: {key: registry._bytes(spark.conf.get(key)) for key in own}
    query = registry.sized(lambda s, d: now())
    assert query(spark, DIR) == {key: registry._bytes(x) for key, x in own.items()}
    monkeypatch.setattr(sessions, "TASK_ROWS", adapter.swings(spark, DIR).count() // 10)
    assert query(spark, DIR) == query(spark, DIR) == registry.TASK_BYTES
    monkeypatch.undo()
    query(spark, DIR)
    assert {key: spark.conf.get(key) for key in own} == own
    assert [registry._bytes(x) for x in ("134217728b", "64MB", "16m", "1g", "7")] == [134217728, 64 << 20, 16 << 20, 1 << 30, 7]
