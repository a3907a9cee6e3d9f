"""Timers and chat: worked examples, stretches against a whole replay, stream against batch."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from skirmish.operators import chat, timers
from skirmish.streaming import live

DEFS = [
    (1, "Fire", "General", "", True, 30, 10, -15, False, False, False, True, True, False),
    (2, "Fire", "Dragon", "", True, 40, 10, -15, False, False, False, True, True, False),
    (3, "Fire", "Dragon", "Lair", True, 50, 10, -15, False, False, True, True, False, True),
    (4, "Frost", "General", "", True, 20, 5, -5, True, False, False, False, True, False),
    (5, "Self", "General", "", True, 20, 5, -5, False, True, False, True, True, False),
    (6, "Off", "General", "", False, 20, 5, -5, False, False, False, True, True, False),
]
SWINGS = "source_id string, owner string, zone string, seq long, ts long, category int, attacker string, ability string, amount long, victim string, damage_type string, extra string"
SWIPE = "Traumatic Swipe"


def step(ts, name=None, attacker="dragon", victim="bob", debuff=None, cured=None, death=False, duration=30, **more):
    row = {"ts": ts, "name": name, "attacker": attacker, "victim": victim, "debuff": debuff, "cured": cured, "death": death, "own": False, "category": "", "zone": "", "duration_s": duration, "warning_s": 10, "remove_s": -15, "absolute": False, "restrict_me": False, "modable": True, "panel1": True, "panel2": False}
    return SimpleNamespace(**(row | more))


def bars(*steps):
    """(start, planned, length, warned, expired, gone, replaced) of each bar."""
    out = timers.advance({}, steps, flush=True)[1]
    return [(b[3], *b[5:11]) for b in sorted(out, key=lambda b: b[3])]


def test_one_bar_a_cast():
    assert bars(step(0, "fire"), step(5, "fire"), step(16, "fire"), step(27, "fire")) == [(0, 30, 30, 20, 30, 45, False)]
    # Silence of 12 s makes a new cast, which takes the place of the bar.
    assert bars(step(0, "fire"), step(12, "fire")) == [(0, 30, 30, None, None, 12, True), (12, 30, 30, 32, 42, 57, False)]
    # A bar that has run out doesn't absorb.
    assert [b[0] for b in bars(step(0, "tick", duration=6), step(6, "tick", duration=6))] == [0, 6]
    assert [b[0] for b in bars(step(0, "frost", absolute=True), step(20, "frost", absolute=True), step(31, "frost", absolute=True))] == [0, 31]
    assert bars(step(0, "self", restrict_me=True)) == [] and len(bars(step(0, "self", restrict_me=True, own=True))) == 1


def test_debuffs_stretch():
    swipe = step(0, debuff="traumatic swipe", attacker="ann", victim="dragon")
    assert bars(swipe, step(5, "fire"))[0][:3] == (5, 45, 45)
    assert bars(swipe, step(5, "fire", modable=False))[0][:3] == (5, 30, 30)
    assert bars(swipe, step(30, "fire"))[0][:3] == (30, 30, 30)
    assert bars(swipe, step(5, "fire"), step(6, cured="traumatic swipe", victim="dragon"))[0][:3] == (5, 45, 30)
    assert bars(swipe, step(5, "fire"), step(7, cured="traumatic swipe", victim="dragon"))[0][:3] == (5, 45, 45)
    assert bars(swipe, step(5, "fire"), step(7, death=True, victim="dragon"))[0][:3] == (5, 45, 30)
    # The death of who debuffed: 15 of 45 s are spent, the other 30 shrink to 20.
    assert bars(swipe, step(5, "fire"), step(20, death=True, victim="ann"))[0][:3] == (5, 45, 35)
    # A debuff falls with the death of its caster before the timer starts.
    assert bars(swipe, step(4, death=True, victim="ann"), step(5, "fire"))[0][:3] == (5, 30, 30)


def test_choice(spark):
    rows = [(1, "fire", "Dragon", "Bob", "Lair", None, None), (2, "Fire", "Dragon", "Bob", None, None, None), (3, "FIRE", "Rat", "Bob", "Lair", None, None), (4, "Off", "Rat", "Bob", "", None, None), (5, "Fire", "None", "None", "", "Lair", "dragon"), (6, "Fire", "None", "None", "", "Cave", "x"), (7, None, None, None, None, None, None)]
    notices = spark.createDataFrame(rows, "seq long, timer string, attacker string, victim string, zone string, rule_zone string, rule_category string")
    got = {r["seq"]: (r["chosen"]["ord"] if r["chosen"] else None, r["tier"]) for r in timers.choose_timers(notices, spark.createDataFrame(DEFS, timers.DEFINITION)).collect()}
    assert got == {1: (3, 5), 2: (3, 4), 3: (2, 0), 4: (None, None), 5: (3, 6), 6: (2, 0), 7: (None, None)}  # the last of a tier
    assert timers.choose_timers(notices, spark.createDataFrame([], timers.DEFINITION)).where("chosen is not null").count() == 0


def fight(seed, n=400):
    rng, rows, ts = random.Random(seed), [], {"a": 100, "b": 100}
    for seq in range(n):
        s = rng.choice("ab")
        ts[s] += rng.choice([0, 1, 2, 4, 9, 15]) if rng.random() > 0.03 else 200
        kind = rng.choice(["Fire", "Frost", "Self", "Other", SWIPE, "cure", "death"])
        who, whom = rng.sample(["Dragon", "Rat", "Ann", "Bob"], 2)
        rows.append((s, "Ann", rng.choice(["Lair", "Cave"]), seq, ts[s], 20 if kind == "cure" else 1, who, "Killing" if kind == "death" else kind, -10 if kind == "death" else 5, whom, SWIPE if kind == "cure" else "x", None))
    return rows


def flat(bar):
    """A bar as a value: its lengths as tuples."""
    return (*bar[:-1], tuple(tuple(x) for x in bar[-1]))


def test_stretches_and_stream_equal_a_whole_replay(spark, tmp_path):
    defs = spark.createDataFrame(DEFS, timers.DEFINITION)
    df = spark.createDataFrame(fight(1), SWINGS)
    steps = timers.timer_steps(df, defs)
    rows, want = steps.toPandas().sort_values(["seq", "step"]), set()
    for source, part in rows.groupby("source_id"):
        want |= {flat((source, *b)) for b in timers.advance({}, part.itertuples(index=False), flush=True)[1]}
    got = timers.recast_timers(df, defs)
    assert len(want) > 50 and {flat(r) for r in got.collect()} == want
    assert any(b[6] != b[5] for b in want) and any(b[7] != b[6] for b in want)
    for i in range(4):
        steps.where(f"seq div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.stream_recast_timers(stream).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    told = {flat(r) for r in spark.table("bars").collect()}
    assert told <= want and len(want) - len(told) <= 8  # what still runs isn't emitted


def test_board_and_events(spark):
    df = spark.createDataFrame([("a", "Ann", "Lair", 1, 100, 1, "Dragon", "Fire", 5, "Bob", "x", None), ("a", "Ann", "Lair", 2, 105, 1, "Rat", "Frost", 5, "Bob", "x", None)], SWINGS)
    got = timers.recast_timers(df, spark.createDataFrame(DEFS, timers.DEFINITION))
    at = spark.createDataFrame([("a", 110), ("a", 155), ("a", 99)], "source_id string, at_ts long")
    assert sorted((r["at_ts"], r["timer"], r["left_s"]) for r in timers.timer_board(got, at).collect()) == [(110, "Frost", 15)]
    assert sorted((r["at_ts"], r["timer"], r["left_s"]) for r in timers.timer_board(got, at, panel=2).collect()) == [(110, "Fire", 40), (155, "Fire", -5)]
    assert sorted((r["ts"], r["event"]) for r in timers.timer_events(got).where("timer_key like '%frost'").collect()) == [(105, "start"), (120, "warning"), (125, "expiry"), (130, "removal")]


def test_chat(spark):
    say = lambda who, rule: rf'\aPC -1 {who}:{who}\/a says, "{rule}"'
    rows = [say("Ann", '<Trigger R="x+" C="Boss" Z="Lair" />'), 'You say, "<Trigger Regex="y" Category="Sea" />"', r'\aNPC 5 Rat:Rat\/a says, "<Trigger R="z" />"', say("Bob", "<Trigger oops"), say("Bob", "<Trigger C='none' />"), "plain", None]
    df = spark.createDataFrame([("a", i, 10 + i, m) for i, m in enumerate(rows)], "source_id string, seq long, ts long, message string")
    shares = chat.chat_rule_shares(df)
    assert sorted((r["seq"], r["sharer"], r["is_self"], r["regex"], r["category"], r["zone"]) for r in shares.collect()) == [(0, "Ann", False, "x+", "Boss", "Lair"), (1, "You", True, "y", "Sea", "")]
    twice = shares.unionByName(shares.withColumn("source_id", F.lit("b"))).unionByName(shares.withColumn("ts", F.col("ts") + 10))
    none = spark.createDataFrame([], "zone string, category string, regex string")
    assert sorted((r["source_id"], r["ts"]) for r in chat.shared_rule_feed(twice, none).collect()) == [("a", 10), ("a", 20)]
    assert chat.shared_rule_feed(twice, spark.createDataFrame([("lair", "boss", "x+")], none.schema)).count() == 0
    wins = spark.createDataFrame([(["Sage", "Seer"], "it is done")], "speakers array<string>, phrase string")
    said = [r"\aNPC 1 Seer:Seer\/a says, 'it is done'", r"\aNPC 1 Rat:Rat\/a says, 'it is done'", r"it is done \aNPC 1 Seer:Seer\/a says, 'no'", r"\aNPC 1 it is done:Seer\/a says, 'no'", r"\aNPC 1 Seer:Seer\/a says, 'it is done'" + "!" * 600]
    lines = spark.createDataFrame([(i, m) for i, m in enumerate(said)], "seq int, message string")
    assert [r["seq"] for r in chat.scripted_win_lines(lines, wins).collect()] == [0]
