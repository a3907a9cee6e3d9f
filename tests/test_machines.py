"""State machines and walks against sequential versions and worked examples."""

import random

from pyspark.sql import functions as F

from skirmish.functions import grammar, scalars
from skirmish.operators import allies, correlate, rules, sessions
from skirmish.sources import files
from skirmish.streaming import live

NAMES = ("P1", "P2", "P3", "a mob 1", "a mob 2")


def actions(seed, n=400, sources=3):
    rng, rows, ts = random.Random(seed), [], [100] * sources
    for seq in range(n):
        s = rng.randrange(sources)
        ts[s] += rng.choice([0, 0, 1, 2, 3, 5, 7, 12, -4])
        rows.append((f"log{s}", f"P{s + 1}", "Z", seq, ts[s], rng.choice([0, 1, 1, 2, 3, 20]), False, "None", rng.choice(NAMES), rng.choice(["Auto-Attack", "Killing", "Skill"]), rng.choice([-10, -1, 0, 50]), rng.choice(NAMES), "x", None))
    return rows


SCHEMA = "source_id string, owner string, zone string, seq long, ts long, category int, critical boolean, special string, attacker string, ability string, amount long, victim string, damage_type string, extra string"


def hostile(r):
    return r[5] in (1, 2) and r[9] != "Killing" and r[8].upper() != r[11].upper()


def replay(rows):
    """Encounter of each kept action, one line after the other."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: r[3]):
        enc, last = state.get(r[0], (None, 0))
        if enc is not None and r[4] - last > 6:
            enc = None
        if hostile(r):
            enc = r[3] if enc is None else enc
            last = r[4]
        state[r[0]] = (enc, last)
        if enc is not None and (r[5] != 0):
            out[r[3]] = enc
    return out


def test_segments_equal_a_sequential_replay(spark):
    for seed in range(4):
        rows = actions(seed)
        for part in (100_000, 23):
            got = sessions.segment(spark.createDataFrame(rows, SCHEMA), part_rows=part).collect()
            assert {r["seq"]: r["encounter_id"] for r in got} == replay(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = [r for r in actions(9, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i in range(3):
        df.where(f"seq div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.stream_encounters(stream).writeStream.format("memory").queryName("enc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["source_id"], r["encounter_id"], r["actions"]) for r in spark.table("enc").collect()}
    kept = sessions.segment(df).groupBy("source_id", "encounter_id").count().collect()
    batch = {(r["source_id"], r["encounter_id"], r["count"]) for r in kept}
    assert got <= batch and len(batch) - len(got) <= 3  # what is still open isn't emitted


def test_owner_walk():
    around = {"ME": {"BOSS": -3, "ANN": 2}, "BOSS": {"ME": -3, "ADD": 2}, "ANN": {"ME": 2}, "ADD": {"BOSS": 2}}
    assert allies.walk("ME", around) == {"ME", "ANN"}
    assert allies.walk("ME", {}) == {"ME"}


def test_absent_owner_has_no_allies(spark):
    rows = [("l", "P9", "Z", 1, 1, 1, False, "None", "P1", "Auto-Attack", 5, "a mob 1", "x", None)]
    kept = sessions.segment(spark.createDataFrame(rows, SCHEMA))
    from skirmish.operators import stats

    assert allies.resolve_allies(kept, stats.ally_edges(kept)).count() == 0


def test_islands_replay_like_the_whole(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        start = rng.randrange(3000)
        rows.append((f"s{rng.randrange(3)}", i, "Z", start, start + rng.randrange(40), rng.sample("ABCDEF", 2)))
    df = spark.createDataFrame(rows, "source_id string, encounter_id long, zone string, start_ts long, end_ts long, names array<string>")
    got = {}
    for r in correlate.correlate_fights(df).collect():
        got.setdefault(r["fight_id"], set()).add(r["encounter_id"])
    order = sorted(rows, key=lambda r: (r[4], r[0], r[1]))
    want = {}
    for r, n in zip(order, correlate.join_fights([(r[0], r[3], r[4], r[5]) for r in order])):
        want.setdefault(n, set()).add(r[1])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_machines_by_example():
    assert rules.accept_spaced([0, 1, 2, 3, 6], 2)[0] == [True, False, True, False, True]
    assert rules.callouts([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (10, "a"), (11, "b"), (12, "c"), (16, "a"), (17, "b"), (18, "c")]) == [(2.9, 3), (18.9, 3)]
    assert rules.uses([(0, "a"), (1, "b"), (1, "a"), (9, "b")]) == [0, 1, 9]
    rows = [(1, 0, "x", True), (2, 1, "y", True), (3, 2, "any", False), (4, 3, "X", False), (5, 4, "x", False), (6, 5, "x", False), (7, 5, "x", True), (8, 9, "z", True)]
    # A release of the same second closes an apply that the log tells after it.
    assert rules.pair_status(rows) == [(1, 0, "x", 3), (2, 1, "y", 1), (7, 5, "x", 0), (8, 9, "z", None)]
    # A wave that has ebbed when it would be told isn't told, and the next one isn't muted.
    ebb = [(0, "a"), (3.9, "b"), (4, "c"), (6, "d"), (7, "e"), (7.5, "f")]
    assert rules.callouts(ebb) == [(6.9, 3)]
    # One victim again and again is one victim; all that count at the telling are told.
    assert rules.callouts([(0, "a"), (1, "A"), (2, "b"), (3, "c"), (3.5, "d")]) == [(3.9, 4)]


LINES = [
    ("YOUR Smite hits a rat for a critical of 1,500 divine damage.", (2, True, "None", "Me", "Smite", 1500, "a rat", "divine", None)),
    ("YOU hit a rat for 100 crushing damage.", (1, False, "None", "Me", "Auto-Attack", 100, "a rat", "crushing", None)),
    ("Bob's Fire Bolt hits a rat for 140.6K heat damage.", (2, False, "None", "Bob", "Fire Bolt", 140600, "a rat", "heat", None)),
    ("James' Song hits a rat for 10 mental damage.", (2, False, "None", "James", "Song", 10, "a rat", "mental", None)),
    ("Bob's hammer multi attacks a rat for 20 crushing damage.", (1, False, "Multi Attack", "Bob", "hammer", 20, "a rat", "crushing", None)),
    ("Bob's pet is hit by Acid Spray for 447 poison damage.", (2, False, "None", "Unknown", "Acid Spray", 447, "Bob's pet", "poison", None)),
    ("Bob hits a rat for 1,234.5 heat damage.", (1, False, "None", "Bob", "Auto-Attack", 1234, "a rat", "heat", None)),
    ("a rat tries to bite YOU, but YOU riposte.", (1, False, "None", "a rat", "Auto-Attack", -4, "Me", "avoided", None)),
    ("a rat tries to bite Bob with Barrage, but Bob parries.", (2, False, "None", "a rat", "Barrage", -3, "Bob", "avoided", None)),
    ("a rat tries to bite Bob, but Ann blocks.", (1, False, "None", "a rat", "Auto-Attack", -5, "Bob", "avoided", "by=Ann")),
    ("YOU try to pierce a rat but miss.", (1, False, "None", "Me", "Auto-Attack", -1, "a rat", "avoided", None)),
    ("YOUR Smite hits a rat but fails to inflict any damage.", (2, False, "None", "Me", "Smite", 0, "a rat", "none", None)),
    ("Ann's Mend heals Bob for 50 hit points.", (3, False, "None", "Ann", "Mend", 50, "Bob", "heal", None)),
    ("Ann's Shield absorbs 30 points of damage from being done to YOURSELF. (12 points remaining)", (3, False, "None", "Ann", "Shield", 30, "Me", "Ward (Absorb)", "remaining=12")),
    ("Bob is stunned!", (30, False, "None", "Unknown", "stunned", 0, "Bob", "applied", None)),
    ("Bob is no longer stunned.", (30, False, "None", "Unknown", "stunned", 0, "Bob", "released", None)),
    ("Bob regains their wits.", (30, False, "None", "Unknown", "any", 0, "Bob", "released", None)),
    ("Ann silences Bob's actions.", (30, False, "None", "Ann", "silenced", 0, "Bob", "applied", None)),
    ("You have killed a rat.", (1, False, "None", "Me", "Killing", -10, "a rat", "death", None)),
    ("Me dies.", (1, False, "None", "Unknown", "Killing", -10, "Me", "death", "pet-death")),
    ("a rat has been slain by Bob!", (1, False, "None", "Bob", "Killing", -10, "a rat", "death", None)),
]


def test_line_shapes(spark):
    rows = [("Me", m) for m, _ in LINES] + [("Me", m) for m in ("Bob's fire sputters and dies.", "hello there", "You have entered Old Keep 2.", "This instance will expire in 3 days 23 hours.", "This instance will expire in 2 weeks.")]
    got = {r["message"]: r for r in grammar.parse(spark.createDataFrame(rows, "owner string, message string")).collect()}
    for message, want in LINES:
        r = got[message]
        assert tuple(r[c] for c in ("category", "critical", "special", "attacker", "ability", "amount", "victim", "damage_type", "extra")) == want, message
    assert got["Bob's fire sputters and dies."]["family"] is None and got["hello there"]["family"] is None
    assert got["You have entered Old Keep 2."]["zone_entered"] == "Old Keep 2"
    assert got["This instance will expire in 3 days 23 hours."]["lockout_s"] == (3 * 24 + 23) * 3600
    assert got["This instance will expire in 2 weeks."]["lockout_s"] is None


def test_log_files(spark, tmp_path):
    for server, owner in (("north", "Ann"), ("logs", "Bob")):
        (tmp_path / server).mkdir()
        lines = [f"({1000 + i})[Mon Jan 01 00:00:00 2024] line {i}" for i in range(50)] + ["broken", "(5)[x] " + "y" * 20_000]
        (tmp_path / server / f"eq2log_{owner}.txt").write_text("\n".join(lines) + "\n")
    got = files.read_log_text(spark, str(tmp_path)).collect()
    assert {(r["owner"], r["server"]) for r in got} == {("Ann", "north"), ("Bob", "")}
    for owner in ("Ann", "Bob"):
        rows = sorted((r["seq"], r["message"]) for r in got if r["owner"] == owner)
        assert rows == [(i + 1, f"line {i}") for i in range(50)]
    df = files.read_log_text(spark, str(tmp_path))
    near = files.read_log_window(df, 1020, 10, 10, 3).where("owner = 'Ann'").collect()
    assert sorted(r["ts"] for r in near) == [1017, 1018, 1019, 1020, 1021, 1022]


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<Config><Triggers><Trigger R="x+" C="Boss" T="T" TN="t1" /><Trigger Regex="y" Active="False" Zone="Keep" /><Trigger C="none" /></Triggers></Config>')
    got = sorted(map(tuple, files.read_rule_xml(spark, str(tmp_path / "a.xml")).select("regex", "category", "starts_timer", "timer_name", "zone", "enabled").collect()))
    assert got == [("x+", "Boss", True, "t1", "", True)]


def test_scalars(spark):
    df = spark.createDataFrame([("by=YOU", "you"), ("by=Ann", "Bob"), ("by=Bob's hammer", "Bob"), (None, "Bob")], "extra string, victim string")
    assert [r[0] for r in df.select(scalars.avoid_actor(F.col("extra"), F.col("victim"))).collect()] == ["self", "Ann", "(weapon)", "self"]
    zone = spark.createDataFrame([("Keep 2", " Fire Bolt VII "), ("Keep", "Mix")], "z string, a string")
    assert [tuple(r) for r in zone.select(scalars.strip_instance_no(F.col("z")), scalars.normalize_ability(F.col("a"))).collect()] == [("Keep", "fire bolt"), ("Keep", "mix")]
