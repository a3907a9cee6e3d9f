"""Streams against the batch."""

from pyspark.sql import functions as F

from skirmish.functions import grammar
from skirmish.operators import allies, reports, sessions, stats
from skirmish.sources import adapter, files
from skirmish.streaming import live

from .test_machines import SCHEMA, actions

SF = "/root/testdata/sf0.001"


def run(stream, name, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return stream.sparkSession.table(name)


def test_meters_are_those_of_the_batch(spark, tmp_path):
    rows = actions(5, 300)
    s = spark.createDataFrame(rows, SCHEMA)
    # After every line of each log; the last meter of a fight is the batch's.
    last, every = {}, set()
    for source in sorted({r[0] for r in rows}):
        fight = {}
        for r in (r for r in rows if r[0] == source):
            hostile = r[5] in (1, 2) and r[9] != "Killing" and r[8].upper() != r[11].upper()
            fight = live.measure(fight, [(r[3], r[4], hostile, r[5], r[8], r[11], r[10])])
            told = [(source, t[0], *t[2:5], *(round(x, 6) for x in t[5:])) for t in live.meter_rows(fight, r[1])]
            every |= set(told)
            if fight.get("open"):
                last[source, fight["encounter_id"]] = told
    kept = sessions.segment(s)
    kept = allies.mark(kept, allies.resolve_allies(kept, stats.ally_edges(kept)))
    batch = reports.mini_parse(stats.combatant_stats(kept), sessions.encounter_window(kept)).collect()
    want = {(r["source_id"], r["encounter_id"], r["rank"], r["combatant"], r["damage"], round(r["rate"], 6), round(r["of_top"], 6), round(r["raid_rate"], 6)) for r in batch}
    assert want and {t for told in last.values() for t in told} == want
    for i in range(3):
        s.where(f"seq div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(live.stream_mini_parse(stream), "meter", "update", tmp_path).collect()
    assert got and {(r["source_id"], r["encounter_id"], r["rank"], r["combatant"], r["damage"], round(r["rate"], 6), round(r["of_top"], 6), round(r["raid_rate"], 6)) for r in got} <= every


def test_meter_by_example():
    rows = [(1, 10, True, 1, "Me", "Troll", 90), (2, 11, False, 3, "Ann", "Me", 50), (3, 12, True, 1, "Ann", "Troll", 30), (4, 12, True, 1, "Troll", "Me", 500)]
    fight = live.measure({}, rows)
    assert live.meter_rows(fight, "me") == [(1, True, 1, "Me", 90, 45.0, 1.0, 60.0), (1, True, 2, "Ann", 30, 15.0, 1 / 3, 60.0)]
    assert live.meter_rows(fight, "Nobody") == []
    fight = live.measure(fight, [(5, 30, False, 0, None, None, None)])
    assert [r[1] for r in live.meter_rows(fight, "Me")] == [False, False]  # over, and still shown
    fight = live.measure(fight, [(6, 40, True, 1, "Me", "Rat", 7)])
    assert [r[:5] for r in live.meter_rows(fight, "Me")] == [(6, True, 1, "Me", 7)]


def test_chunks_of_a_log_are_one_source(spark, tmp_path):
    (tmp_path / "in" / "north").mkdir(parents=True)
    line = lambda i: f"({1000 + i})[x] Me hits Troll for {i + 1} crushing damage."
    for n, part in enumerate((range(5), range(5, 9), range(20, 24))):
        (tmp_path / "in" / "north" / f"eq2log_Me.{n:03d}.txt").write_text("\n".join(map(line, part)) + "\n")
    lines = files.stream_log_text(spark, str(tmp_path / "in"))
    got = run(lines, "chunks", "append", tmp_path).collect()
    assert len({r["source_id"] for r in got}) == 1 and {(r["owner"], r["server"]) for r in got} == {("Me", "north")}
    assert [r["ts"] for r in sorted(got, key=lambda r: r["seq"])] == [1000 + i for i in (*range(9), *range(20, 24))]
    # The lines feed the live jobs.
    parsed = grammar.parse(files.stream_log_text(spark, str(tmp_path / "in")))
    closed = run(live.stream_encounters(parsed.withColumn("category", F.coalesce("category", F.lit(0)))), "fights", "append", tmp_path).collect()
    assert [(r["start_ts"], r["end_ts"], r["actions"]) for r in closed] == [(1000, 1008, 9)]


def test_live_rules_on_a_stream(spark, tmp_path):
    lines = grammar.parse_header(adapter.lines(spark, SF)).select("source_id", "seq", "ts", "message", F.lit("Keep").alias("zone"), F.when(F.col("seq") % 2 == 0, F.col("ts") * 1000 + 60_000).alias("observed_ms"))
    lines.write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([("hit", "hits", " hits ", None, True)], "rule string, regex string, literal string, zone string, enabled boolean")
    got = run(live.stream_rules(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), rules), "rules", "append", tmp_path)
    want = lines.where("observed_ms is null and message like '% hits %'").count()
    assert got.count() == want > 0
