"""Names in two spellings, avoidance, correlation by components, many rules: worked
examples and plain versions."""

import random
import time

import pytest

from skirmish.operators import allies, classify, correlate, reports, rules, sessions, stats

SWINGS = "source_id string, owner string, zone string, seq long, ts long, category int, critical boolean, special string, attacker string, ability string, amount long, victim string, damage_type string, extra string, amount_text string"


def swing(seq, attacker, victim, amount, category=1, ability="Auto-Attack", ts=None, extra=None, text=None, kind="crushing"):
    return ("log", "Bob", "Keep", seq, 1000 + seq if ts is None else ts, category, False, "None", attacker, ability, amount, victim, kind, extra, text)


def fight(spark, rows):
    kept = sessions.segment(spark.createDataFrame(rows, SWINGS))
    return allies.mark(kept, allies.resolve_allies(kept, stats.ally_edges(kept)))


def test_one_combatant_for_a_name_in_two_spellings(spark):
    rows = [swing(1, "Bob", "a rat", 100), swing(2, "A rat", "Bob", 20), swing(3, "Bob", "a rat", 400), swing(4, "bob", "A RAT", 0, ability="Slash", category=2), swing(5, "Bob", "A rat", -10, ability="Killing", kind="death")]
    kept = fight(spark, rows)
    table = stats.combatant_stats(kept)
    got = {r["combatant"]: r for r in table.collect()}
    assert set(got) == {"Bob", "a rat"}  # the first spelling
    assert (got["a rat"]["damage_taken"], got["a rat"]["damage"], got["a rat"]["deaths"], got["Bob"]["kills"]) == (500, 20, 1, 1)
    total = stats.fight_totals(table).first()
    assert (total["n_combatants"], total["title"], total["success"], total["damage"]) == (2, "a rat", 1, 500)
    fan = stats.ability_stats(stats.bucket_fanout(kept)).where("combatant = 'a rat' and bucket = 'Incoming Damage'")
    assert {r["ability"] for r in fan.collect()} == {"Auto-Attack", "Slash", "Killing"}
    assert {(r["src"], r["dst"]) for r in stats.ally_edges(kept).collect()} == {("Bob", "a rat"), ("a rat", "Bob")}
    deaths = reports.death_report(kept).collect()
    assert {r["combatant"] for r in deaths} == {"a rat"} and len(deaths) == 2


def test_spellings_hold_for_their_fight(spark):
    rows = [swing(1, "A Rat", "Bob", 5), swing(2, "Bob", "a rat", 5), swing(3, "bob", "BOB", 7, ability="Leech", category=2), swing(50, "bob", "a rat", 5), swing(51, "a rat", "Bob", 5)]
    got = [(r["seq"], r["attacker"], r["victim"]) for r in sessions.segment(spark.createDataFrame(rows, SWINGS)).orderBy("seq").collect()]
    assert got == [(1, "A Rat", "Bob"), (2, "Bob", "A Rat"), (3, "Bob", "Bob"), (50, "bob", "a rat"), (51, "a rat", "bob")]
    # Damage to oneself tells of its victim only.
    own = [swing(1, "BOB", "bob", 7, ability="Leech", category=2), swing(2, "Bob", "a rat", 5)]
    assert [r["attacker"] for r in sessions.segment(spark.createDataFrame([swing(0, "a rat", "Ann", 1), *own], SWINGS)).orderBy("seq").collect()] == ["a rat", "bob", "bob"]


def attacked(spark):
    """Ten attacks of a rat on Bob: landed 100 (auto) and 300 (skill), one warded, one
    stoneskin each, and the rest turned aside in several ways, one by Ann."""
    bite = dict(ability="Bite", category=2)
    rows = [
        swing(1, "Bob", "a rat", 50), swing(2, "a rat", "Bob", 100), swing(3, "a rat", "Bob", 300, **bite),
        swing(4, "Ann", "Bob", 40, category=3, ability="Ward", kind="Ward (Absorb)"), swing(5, "a rat", "Bob", 0, ts=1004, kind="none"), swing(6, "a rat", "Bob", 0, **bite, kind="none"),
        swing(7, "a rat", "Bob", -9, text="Dodge"), swing(8, "a rat", "Bob", -9, text="Counter", **bite), swing(9, "a rat", "Bob", -4), swing(10, "a rat", "Bob", -5, extra="by=Ann"), swing(11, "a rat", "Bob", -5, extra="by=Ann", **bite),
    ]
    kept = fight(spark, rows)
    return kept, reports.ward_pairing(kept, kept["damage_type"] == "Ward (Absorb)")


def test_avoidance_by_example(spark):
    kept, paired = attacked(spark)
    got = {r["combatant"]: r.asDict() for r in reports.avoidance_report(kept, paired).collect()}
    bob = got["Bob"]
    assert {k: bob[k] for k in ("attempts", "landed", "warded", "warded_total", "stoneskin", "block", "riposte", "dodge", "counter", "miss", "avoided")} == {"attempts": 9, "landed": 2, "warded": 1, "warded_total": 40, "stoneskin": 1, "block": 2, "riposte": 1, "dodge": 1, "counter": 1, "miss": 0, "avoided": 6}
    assert bob["est_avoided"] == 3 * 100 + 3 * 300 and bob["avoided_share"] == 6 / 9
    assert {k: v for k, v in got["TOTAL"].items() if k != "combatant"} == {k: v for k, v in bob.items() if k != "combatant"}
    actors = {(r["kind"], r["actor"]): r for r in reports.avoidance_by_actor(kept, paired, sessions.encounter_window(kept)).collect()}
    assert {k: r["n"] for k, r in actors.items()} == {("landed", "-"): 2, ("warded", "-"): 1, ("stoneskin", "-"): 1, ("dodge", "self"): 1, ("counter", "self"): 1, ("riposte", "self"): 1, ("block", "Ann"): 2, ("avoided", "-"): 6}
    assert actors["block", "Ann"]["estimate"] == 400 and actors["warded", "-"]["estimate"] == 40 and actors["landed", "-"]["estimate"] is None
    assert actors["avoided", "-"]["of_avoids"] == 1 and actors["avoided", "-"]["effective_hps"] == 1200 / max(1, sessions.encounter_window(kept).first()["duration_s"])


def test_an_attack_is_worth_the_other_kind_where_none_landed(spark):
    rows = [swing(1, "Bob", "a rat", 50), swing(2, "a rat", "Bob", -1), swing(3, "a rat", "Bob", 70, ability="Bite", category=2), swing(4, "a rat", "Ann", -1), swing(5, "Ann", "Bob", 5, category=3, ability="Mend", kind="heal")]
    kept = fight(spark, rows)
    got = {r["combatant"]: r for r in reports.avoidance_report(kept, reports.ward_pairing(kept, kept["damage_type"] == "Ward (Absorb)")).collect()}
    assert got["Bob"]["est_avoided"] == 70 and got["Ann"]["est_avoided"] == 0 and got["TOTAL"]["attempts"] == 3


def test_raid_damage_without_a_granter_stays(spark):
    raid = spark.createDataFrame([("l", 1, "Chime", 100), ("l", 1, "Bell", 51), ("l", 1, "Odd", 7), ("l", 2, "Bell", 9)], "source_id string, encounter_id long, ability string, damage long")
    grant = spark.createDataFrame([("chime", ["Dirge"]), ("bell", ["Templar", "Fury"])], "ability string, granted_by array<string>")
    here = spark.createDataFrame([("l", 1, "Ann", "templar"), ("l", 1, "Cid", "Fury"), ("l", 1, "Bob", "Monk")], "source_id string, encounter_id long, combatant string, class string")
    got = sorted((r["encounter_id"], r["ability"], r["granter"], r["granters"], r["credit"], r["estimated"]) for r in classify.raid_buff_credit(raid, grant, here).collect() if r["granter"])
    assert got == [(1, "Bell", "Ann", 2, 25, True), (1, "Bell", "Cid", 2, 25, True)]
    lost = sorted((r["encounter_id"], r["ability"], r["damage"], r["granters"], r["credit"]) for r in classify.raid_buff_credit(raid, grant, here).collect() if not r["granter"])
    assert lost == [(1, "Chime", 100, 0, None), (1, "Odd", 7, 0, None), (2, "Bell", 9, 0, None)]


SEEN = "source_id string, encounter_id long, zone string, start_ts long, end_ts long, names array<string>"


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_components_replay_like_the_whole(spark, seed):
    """Also where a fight reaches its witness through another member's window."""
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(4)}", i, rng.choice(("Z", "z", "Y")), start, start + rng.randrange(50), rng.sample("ABCDEFGH", rng.choice((0, 1, 1, 2)))) for i, start in enumerate(rng.randrange(2500) for _ in range(150))]
    df = spark.createDataFrame(rows, SEEN)
    want = set()
    for zone in ("z", "y"):
        order = sorted((r for r in rows if r[2].lower() == zone), key=lambda r: (r[4], r[0], r[1]))
        groups = {}
        for r, n in zip(order, correlate.join_fights([(r[0], r[3], r[4], r[5]) for r in order])):
            groups.setdefault(n, set()).add(r[1])
        want |= {frozenset(g) for g in groups.values()}
    got = {}
    for r in correlate.correlate_fights(df).collect():
        got.setdefault(r["fight_id"], set()).add(r["encounter_id"])
    assert {frozenset(g) for g in got.values()} == want and any(len(g) > 2 for g in want)


def test_a_busy_zone_is_no_single_group(spark):
    rows = [(f"s{i % 2}", i, "Z", 10 * (i // 2), 10 * (i // 2) + 20, [f"mob {i // 2}"]) for i in range(120)]
    found = correlate.components(spark.createDataFrame(rows, SEEN)).groupBy("component").count().collect()
    assert len(found) == 60 and {r["count"] for r in found} == {2}
    chain = [("a", 0, "Z", 0, 10, ["x"]), ("b", 1, "Z", 20, 60, ["x", "y"]), ("c", 2, "Z", 85, 90, ["y"]), ("d", 3, "Z", 95, 99, ["x"]), ("e", 4, "Z", 300, 310, ["x"])]
    told = {r["encounter_id"]: r["component"] for r in correlate.components(spark.createDataFrame(chain, SEEN)).collect()}
    assert told[0] == told[1] == told[2] == told[3] != told[4]  # d meets x only through the window of c


def lines(spark, messages):
    return spark.createDataFrame([("log", i, 1000 + i, "Keep", "Bob", m) for i, m in enumerate(messages)], "source_id string, seq long, ts long, zone string, owner string, message string")


RULES = "rule string, regex string, literal string, zone string, enabled boolean, sound_type int, sound_data string, cooldown_s double"


def test_thousands_of_rules_read_the_lines_once(spark):
    table = [(f"r{i}", rf"^(?<attacker>\w+) says word{i}\b", None, None, True, 3, f"${{attacker}} {i}", 2.0) for i in range(20_000)] + [("any", r"\d{3}", None, None, True, 0, None, None)]
    found = rules.match_rules(lines(spark, ["Ann says word7", "Bob says word19999 now", "word7", "Cid says word77 123", "nothing"]), spark.createDataFrame(table[:-2] + table[-1:] + [table[-2]], RULES).limit(20_000))
    got = sorted((r["seq"], r["rule"], r["attacker"], r["text"]) for r in found.collect())
    assert [g for g in got if g[1] != "any" and g[1] != "r19999"] == [(0, "r7", "Ann", "Ann 7"), (3, "r77", "Cid", "Cid 77")]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    with pytest.raises(ValueError):
        rules.match_rules(lines(spark, []), spark.createDataFrame(table, RULES))


def test_a_catastrophic_pattern_ends(spark):
    table = [("bad", r"^(a+)+$", None, None, True, 0, None, None), ("good", "a{5}", None, None, True, 0, None, None)]
    start = time.time()
    got = rules.match_rules(lines(spark, ["a" * 60 + "!"] * 50).coalesce(1), spark.createDataFrame(table, RULES)).collect()
    assert {r["rule"] for r in got} == {"good"} and len(got) == 50 and time.time() - start < 60


def test_literals_that_a_pattern_needs():
    needed = rules.required_literal
    assert needed(r"^(\w+) has killed (.+?)\.$") == " has killed "
    assert needed(r"hits? for") == " for" and needed(r"ab+cd") == "ab" and needed(r"abc*d+x") in ("ab", "d")
    assert needed("a|b") == needed("(?i)abc") == needed(r"[abc]+") == needed(r"\d{3}") == needed("") == ""
    assert needed("x{2}yz") == "yz" and needed(r"is a \(test\)") == "is a (test)" and needed("(one|two) three") == " three"
    rng = random.Random(5)
    import re

    parts = ["ab", "c", "d?", "e*", "[fg]", "(h|i)", r"\d", "j+", "k{2}", ".", r"\."]
    for _ in range(500):
        pattern = "".join(rng.choice(parts) for _ in range(5))
        text = "".join(rng.choice("abcdefghij1k.") for _ in range(40)) + "abckk.1"
        if re.search(pattern, text):
            assert needed(pattern) in text


def test_rules_for_the_owner_zone_and_text(spark):
    table = [("mine", r"heals (?<YOU>\w+)", None, "keep", True, 3, "$$ $1 ${YOU} $2", 5.0), ("named", r"(?'victim'\w+) (falls|dies)", " ", "Sea", True, 3, "x", 1.0), ("off", "heals", None, None, False, 0, None, None)]
    got = rules.match_rules(lines(spark, ["Ann heals Bob", "Ann heals Cid", "Rat dies"]), spark.createDataFrame(table, RULES)).collect()
    assert [(r["seq"], r["rule"], r["text"], r["cooldown_s"]) for r in got] == [(0, "mine", "$ Bob Bob $2", 5.0)]
