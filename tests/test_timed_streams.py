"""Streams with timers: what the batch gives, for any cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from skirmish.operators import chat, rules, sessions, timers
from skirmish.streaming import live

from .test_machines import SCHEMA, actions
from .test_timers import DEFS, SWINGS, fight


def land(df, path, cuts):
    """df as files that a stream reads one by one; cuts(row number) names the file."""
    rows = df.collect()
    for i in sorted({cuts(n) for n in range(len(rows))}):
        part = [r for n, r in enumerate(rows) if cuts(n) == i]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


def end(spark, path, n, ts=1_000_000):
    """A clock that stands still for n batches and then jumps far beyond the last line."""
    return land(spark.createDataFrame([(i,) for i in range(n)] + [(ts,)], "ts long"), f"{path}/clock", lambda i: i)


@pytest.mark.parametrize("seed", (1, 2))
def test_encounters_are_those_of_the_batch(spark, tmp_path, seed):
    rows = [(*r[:3], r[3], r[4] + 20 * (r[3] // 50), *r[5:]) for r in actions(seed, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    rng = random.Random(seed)
    size = rng.choice((70, 110))
    got = run(live.stream_encounters(land(df, f"{tmp_path}/in", lambda n: n // size), clock=end(spark, tmp_path, 300 // size + 1)), f"enc{seed}", tmp_path).collect()
    hostile = sessions.segment(df).groupBy("source_id", "encounter_id").agg(F.count("*").alias("actions"), F.min_by("ts", F.when(F.col("hostile"), F.col("seq"))).alias("start_ts"), F.max_by("ts", F.when(F.col("hostile"), F.col("seq"))).alias("end_ts"))
    want = sorted((r["source_id"], r["encounter_id"], r["start_ts"], r["end_ts"], r["actions"]) for r in hostile.collect())
    assert sorted(map(tuple, got)) == want and len(want) > 5


def test_the_last_fight_of_a_quiet_log_is_told_once(spark, tmp_path):
    row = lambda source, seq, ts: (source, "Me", "Z", seq, ts, 1, False, "None", "Me", "Slash", 5, "a rat", "x", None)
    rows = [row("a", 1, 1000), row("a", 2, 1003), row("b", 3, 1100), row("b", 4, 1104), row("a", 5, 1005), row("b", 6, 1200), row("b", 7, 1300)]
    df = spark.createDataFrame(rows, SCHEMA)
    # Log b goes on; a line of log a that comes after its fight was told is late and changes nothing.
    got = run(live.stream_encounters(land(df, f"{tmp_path}/in", lambda n: (0, 0, 1, 1, 3, 2, 4)[n])), "quiet", tmp_path).collect()
    told = sorted(map(tuple, got))
    assert told[:2] == [("a", 1, 1000, 1003, 2), ("b", 3, 1100, 1104, 2)] and ("b", 6, 1200, 1200, 1) in told
    assert len([t for t in told if t[0] == "a"]) == 1


def applied(seed, n=300):
    rng, ts, rows = random.Random(seed), 1000, []
    for seq in range(n):
        ts += rng.choice((0, 0, 1, 1, 2, 5))
        rows.append((rng.choice("abc"), seq, ts - rng.choice((0, 0, 1)), rng.choice(("Ann", "Bob", "Cid", "Dot", "a rat", "ann")), rng.choice(("stunned", "stupified", "feared", "odd"))))
    return rows


@pytest.mark.parametrize("cut", (60, 110))
def test_callouts_over_all_logs(spark, tmp_path, cut):
    df = spark.createDataFrame(applied(cut), "source_id string, seq long, ts long, victim string, ability string")
    want = sorted(map(tuple, rules.status_callouts(df).collect()))
    got = run(live.stream_callouts(land(df, f"{tmp_path}/in", lambda n: n // cut), late="20 seconds", clock=end(spark, tmp_path, 300 // cut + 1)), f"calls{cut}", tmp_path)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_waves_by_example(spark):
    say = lambda rows: sorted(map(tuple, rules.status_callouts(spark.createDataFrame([(s, i, t, v, a) for i, (s, t, v, a) in enumerate(rows)], "source_id string, seq long, ts long, victim string, ability string")).collect()))
    # Three victims that three logs tell of; a victim told twice is one; two words are one effect.
    assert say([("a", 10, "Ann", "stunned"), ("b", 10, "Ann", "stunned"), ("b", 11, "Bob", "stupified"), ("c", 12, "Cid", "stunned")]) == [("stun", 12.9, 3)]
    assert say([("a", 10, "Ann", "stunned"), ("b", 11, "Bob", "stunned"), ("c", 15, "Cid", "stunned")]) == []
    assert say([("a", 10, "Ann", "feared"), ("a", 10, "a rat", "feared"), ("a", 10, "Big Rat", "feared"), ("a", 10, "Bob", "stunned")]) == []


@pytest.mark.parametrize("cut", (50, 135))
def test_announcements_once_for_all_logs(spark, tmp_path, cut):
    rng = random.Random(cut)
    rows = [(rng.choice("abc"), i, 1000 + i // 3 + rng.choice((0, 1)), rng.choice(("r1", "r2")), rng.choice(("x", "y"))) for i in range(270)]
    df = spark.createDataFrame(rows, "source_id string, seq long, ts long, rule string, message string")
    want = sorted(map(tuple, rules.cross_source_dedupe(df).collect()))
    got = run(live.stream_dedupe(land(df, f"{tmp_path}/in", lambda n: n // cut), late="5 seconds", clock=end(spark, tmp_path, 270 // cut + 1)), f"once{cut}", tmp_path)
    assert sorted(map(tuple, got.collect())) == want and 20 < len(want) < 200


def test_shared_rules_on_a_stream(spark, tmp_path):
    share = lambda who, r: rf'\aPC -1 {who}:{who}\/a says, "<Trigger R="{r}" C="Boss" Z="Lair" />"'
    rows = [(s, i, 1000 + 3 * i + d, share("Ann", f"x{i % 4}")) for i in range(40) for s, d in (("a", 0), ("b", 1))]
    df = spark.createDataFrame(rows, "source_id string, seq long, ts long, message string")
    known = spark.createDataFrame([("lair", "boss", "x3")], "zone string, category string, regex string")
    want = sorted(map(tuple, chat.shared_rule_feed(chat.chat_rule_shares(df), known).collect()))
    got = run(live.stream_shared_rules(land(df, f"{tmp_path}/in", lambda n: n // 30), known, clock=end(spark, tmp_path, 3)), "shares", tmp_path)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 30


@pytest.mark.parametrize("seed,cut", ((1, 60), (5, 150)))
def test_timer_events_on_a_stream(spark, tmp_path, seed, cut):
    df = spark.createDataFrame(fight(seed, 300), SWINGS)
    defs = spark.createDataFrame(DEFS, timers.DEFINITION)
    steps = timers.timer_steps(df, defs).orderBy("seq", "step")
    want = sorted(map(tuple, timers.timer_events(timers.recast_timers(df, defs)).collect()))
    got = run(live.stream_timer_events(land(steps, f"{tmp_path}/in", lambda n: n // cut), late="1 hour", clock=end(spark, tmp_path, 300 // cut + 1)), f"events{seed}", tmp_path)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_events_are_told_when_they_are_due():
    """Between two steps, by time alone; a death moves what wasn't told."""
    from .test_timers import SWIPE, step

    machine, held = live.Events({SWIPE.lower(): (0.5, 30)}), {}
    row = lambda **k: [getattr(step(**k), c, 0) for c in machine.columns]
    assert [e[3:] for e in machine.rows(("a",), held, [row(ts=0, debuff=SWIPE.lower(), attacker="ann", victim="dragon"), row(ts=5, name="fire")])] == []
    assert [e[3:] for e in machine.time(("a",), held, 6)] == [("start", 5)]
    assert machine.due(held) == 32 and machine.time(("a",), held, 31) == []  # 45 s: the warning would come at 40, the debuff ends at 30
    machine.rows(("a",), held, [row(ts=35, death=True, victim="ann")])  # 30 of 45 s are spent, the other 15 shrink to 10
    assert [e[3:] for e in machine.time(("a",), held, 46)] == [("warning", 35), ("expiry", 45)]
    assert [e[3:] for e in machine.time(("a",), held, 60)] == [("removal", 60)] and held == {}


def test_a_board_shows_the_length_in_force(spark):
    hit = lambda seq, ts, who, what, whom, amount=5, category=1, kind="x": ("a", "Ann", "Lair", seq, ts, category, who, what, amount, whom, kind, None)
    swipe, dead = ("Traumatic Swipe", "Killing")
    df = spark.createDataFrame([hit(1, 100, "Ann", swipe, "Dragon"), hit(2, 105, "Dragon", "Frost", "Bob"), hit(3, 115, "Rat", dead, "Ann", -10)], SWINGS)
    defs = spark.createDataFrame([(1, "Frost", "General", "", True, 20, 5, -5, False, False, False, True, True, False)], timers.DEFINITION)
    bars = timers.recast_timers(df, defs)
    # 20 s become 30; at 115 ten are spent, and of the other 20 a third goes.
    at = spark.createDataFrame([("a", t) for t in (104, 105, 114, 115, 127, 133)], "source_id string, at_ts long")
    board = sorted((r["at_ts"], r["length_s"], r["left_s"]) for r in timers.timer_board(bars, at).collect())
    assert board == [(105, 30, 30), (114, 30, 21), (115, 23, 13), (127, 23, 1)]
    assert [tuple(x) for x in bars.first()["lengths"]] == [(105, 30), (115, 23)]


def test_uploads_survive_a_restart(spark, tmp_path):
    ids = [["p1", "p2", "p1"], ["p2", "p3"], ["p4", "p1", "p5"], ["p5", "p6"]]
    df = spark.createDataFrame([(e, i) for i, part in enumerate(ids) for e in part], "encid string, part long")
    stream = land(df, f"{tmp_path}/in", lambda n: df_part[n]) if (df_part := [i for i, part in enumerate(ids) for _ in part]) else None
    ledger, sent, fail = f"{tmp_path}/ledger", [], {2}

    def send(rows, batch_id):
        got = sorted(r["encid"] for r in rows.collect())
        if batch_id in fail:
            fail.remove(batch_id)
            raise RuntimeError("killed")
        sent.append((batch_id, got))

    for _ in range(2):
        query = live.stream_uploads(stream, ledger, f"{tmp_path}/cp", send).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert "killed" in str(e)
    assert sent == [(0, ["p1", "p2"]), (1, ["p3"]), (2, ["p4", "p5"]), (3, ["p6"])]
    assert sorted(r["encid"] for r in spark.read.parquet(ledger).collect()) == [f"p{i}" for i in range(1, 7)]
    # A batch that runs again after later ones writes what it wrote before.
    live.upload_batch(spark.createDataFrame([("p4", 2), ("p1", 2), ("p5", 2)], df.schema), 2, ledger)
    assert sorted(r["encid"] for r in spark.read.parquet(ledger).collect()) == [f"p{i}" for i in range(1, 7)]
