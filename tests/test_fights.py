"""From log lines to reports, with worked examples of the rules."""

import json

from pyspark.sql import functions as F

from skirmish.functions import grammar
from skirmish.operators import allies, archive, classify, mining, reports, rules, sessions, stats
from skirmish.plans import road
from skirmish.sources import files

SWING = "source_id string, owner string, zone string, seq long, ts long, category int, critical boolean, special string, attacker string, ability string, amount long, victim string, damage_type string, extra string"

LOG = """(1000)[x] You have entered Old Keep 2.
(1003)[x] This instance will expire in 1 days 2 hours.
(1010)[x] YOUR Smite hits Old Troll for a critical of 1,500 divine damage.
(1011)[x] Ann's Mend heals YOU for 50 hit points.
(1011)[x] Old Troll hits YOU for 300 crushing damage.
(1012)[x] Old Troll tries to crush YOU, but YOU riposte.
(1013)[x] Bob's Fire Bolt hits Old Troll for 2.5K heat damage.
(1014)[x] Old Troll's Roar hits Bob but fails to inflict any damage.
(1015)[x] Bob has killed Old Troll.
(1016)[x] Ann's Mend heals Bob for 10 hit points.
(1018)[x] somebody says something
(1030)[x] Bob hits a rat for 20 crushing damage.
(1031)[x] a rat hits YOU for 5 piercing damage.
(1040)[x] Me has killed a rat.
(1050)[x] a late line"""


def swing(seq, ts, attacker, victim, category=1, ability="Auto-Attack", amount=10, owner="Me", critical=False, damage_type="crushing", extra=None, special="None", source="a", zone="Z"):
    return (source, owner, zone, seq, ts, category, critical, special, attacker, ability, amount, victim, damage_type, extra)


def kept_of(spark, rows, walk=False, ally=("Me", "Ann", "Bob")):
    kept = sessions.segment(spark.createDataFrame(rows, SWING))
    if walk:
        return allies.mark(kept, allies.resolve_allies(kept, stats.ally_edges(kept)))
    return allies.mark_by(kept, lambda name: name.isin(*ally))


def test_golden_log(spark, tmp_path):
    (tmp_path / "north").mkdir()
    (tmp_path / "north" / "eq2log_Me.txt").write_text(LOG + "\n")
    kept = road.encounters(files.read_log_text(spark, str(tmp_path)))
    s = stats.combatant_stats(kept)
    fights = stats.fight_totals(s).orderBy("start_ts").collect()
    first, second = fights
    assert (first["title"], first["zone"], first["start_ts"], first["end_ts"], first["duration_s"]) == ("Old Troll", "Old Keep 2", 1010, 1015, 5)
    assert (first["damage"], first["healed"], first["kills"], first["deaths"], first["success"]) == (4000, 60, 1, 0, 1)
    assert (second["title"], second["start_ts"], second["end_ts"], second["success"]) == ("a rat", 1030, 1030, 2)
    by = {(r["encounter_id"], r["combatant"]): r for r in s.collect()}
    mine = by[(first["encounter_id"], "Me")]
    assert (mine["ally"], mine["damage"], mine["damage_taken"], mine["heals_taken"], mine["crits"]) == (True, 1500, 300, 50, 1)
    troll = by[(first["encounter_id"], "Old Troll")]
    assert (troll["ally"], troll["deaths"], troll["hits"], troll["avoids"], troll["swings"]) == (False, 1, 2, 1, 3)
    where = {r["encounter_id"]: (r["zone"], r["instance_expiry"]) for r in sessions.encounter_instance(kept).collect()}
    assert set(where.values()) == {("Old Keep 2", 1003 + 26 * 3600)}
    rates = {(r["encounter_id"], r["combatant"]): r for r in reports.rates(s, stats.fight_totals(s)).collect()}
    assert (rates[(first["encounter_id"], "Me")]["up_enc_dps"], rates[(first["encounter_id"], "Old Troll")]["to_hit"]) == (300.0, 66.67)


def test_zone_and_lockout_are_carried(spark):
    told = ["You have entered A.", "This instance will expire in 1 hours.", "x", "You have entered B.", "x", "This instance will expire in 2 hours.", "You have entered B.", "x"]
    stamps = [100, 105, 120, 130, 131, 141, 150, 151]
    lines = spark.createDataFrame([("a", "Me", i, t, m) for i, (t, m) in enumerate(zip(stamps, told))], "source_id string, owner string, seq long, ts long, message string")
    seeds = spark.createDataFrame([("a", "Seed", 7)], "source_id string, zone string, instance_expiry long")
    for part in (100_000, 2):
        got = [(r["zone"], r["instance_expiry"]) for r in sessions.carry_zones(grammar.parse(lines), seeds, part).orderBy("seq").collect()]
        # The second lockout comes more than 10 s after its zone, the last zone has none.
        assert got == [("A", None), ("A", 3705), ("A", 3705), ("B", None), ("B", None), ("B", None), ("B", None), ("B", None)]
    late = sessions.carry_zones(grammar.parse(lines.where("seq = 2")), seeds).first()
    assert (late["zone"], late["instance_expiry"]) == ("Seed", 7)


def test_a_run_splits_at_another_instance(spark):
    known = [None, 10_000, 13_600, None, 15_401, 30_000, None]
    rows = [("a", i, "Keep" if i % 2 else "keep", 100 * i, x) for i, x in enumerate(known)]
    df = spark.createDataFrame(rows, "source_id string, encounter_id long, zone string, start_ts long, instance_expiry long")
    got = {r["encounter_id"]: (r["run"], r["instance"]) for r in sessions.instance_runs(sessions.zone_runs(df)).collect()}

    def plain():
        out, n, first = [], 0, None
        for x in known:
            if first is not None and x is not None and abs(x - first) > 90 * 60:
                n, first = n + 1, None
            first = x if first is None else first
            out.append(n)
        return out

    assert got == {i: (1, n) for i, n in enumerate(plain())} and max(n for _, n in got.values()) == 2


def test_zero_hits_count_as_the_least(spark):
    kept = kept_of(spark, [swing(1, 1, "Me", "Rat", amount=0), swing(2, 2, "Me", "Rat", amount=40), swing(3, 3, "Me", "Rat", ability="Killing", amount=-10, damage_type="death")])
    rows = {(r["bucket"], r["ability"]): r for r in stats.ability_stats_all(stats.bucket_fanout(kept)).where("combatant = 'Me'").collect()}
    assert (rows[("Outgoing Damage", "Auto-Attack")]["min_hit"], rows[("Outgoing Damage", "Auto-Attack")]["hits"]) == (0, 2)
    assert (rows[("Outgoing Damage", "Killing")]["swings"], rows[("Outgoing Damage", "All")]["swings"]) == (1, 2)


def test_personal_window_and_deaths(spark):
    rows = [swing(1, 10, "Ann", "Rat"), swing(2, 12, "Ann", "Me", 3, "Mend", 5, damage_type="heal"), swing(3, 14, "Rat", "Me", ability="Killing", amount=-10, extra="pet-death"), swing(4, 15, "Rat", "Bob", ability="Slay", amount=-10), swing(5, 16, "Me", "Rat")]
    s = {r["combatant"]: r for r in stats.combatant_stats(kept_of(spark, rows)).collect()}
    assert (s["Ann"]["first_ts"], s["Ann"]["last_ts"], s["Ann"]["damage_ts"]) == (10, 12, 10)
    assert (s["Me"]["deaths"], s["Me"]["pet_deaths"], s["Bob"]["deaths"], s["Rat"]["kills"]) == (0, 1, 1, 1)


def test_title_and_outcome(spark):
    # An add dies, the one the fight was about doesn't: no win.
    rows = [swing(1, 10, "Me", "Troll", amount=900), swing(2, 11, "Me", "a rat", amount=50), swing(3, 12, "Me", "a rat", ability="Killing", amount=-10)]
    got = stats.fight_totals(stats.combatant_stats(kept_of(spark, rows))).first()
    assert (got["title"], got["score"], got["success"]) == ("Troll", 900, 2)
    # Damage per death decides, the first seen on ties; without an ally there is neither.
    rows = [swing(1, 10, "Me", "Troll", amount=90), swing(2, 11, "Me", "Imp", amount=180), swing(3, 12, "Me", "Imp", ability="Killing", amount=-10), swing(4, 13, "Me", "Imp", ability="Killing", amount=-10)]
    assert stats.fight_totals(stats.combatant_stats(kept_of(spark, rows))).first()["title"] == "Troll"
    none = stats.fight_totals(stats.combatant_stats(kept_of(spark, rows, ally=()))).first()
    assert (none["title"], none["success"], none["damage"]) == (None, 0, 0)
    fights = stats.fight_totals(stats.combatant_stats(kept_of(spark, rows, ally=())))
    assert stats.with_scripted_wins(fights, fights).first()["success"] == 1


def test_who_is_who(spark):
    maps = spark.createDataFrame([("spells", "smite", ["Templar"]), ("spells", "mend", ["Templar"]), ("spells", "bolt", ["Wizard"])], "layer string, ability string, classes array<string>")
    rows = [
        swing(1, 10, "Me", "Troll", 2, "Smite IV"), swing(2, 10, "Me", "Ann", 3, "Mend"), swing(3, 11, "Ann", "Troll", 2, "Bolt", 70), swing(4, 11, "Me's hawk", "Troll"), swing(5, 11, "Me", "Me's hawk", 3, "Mend"),
        swing(6, 12, "Unknown", "Me", 2, "Stench"), swing(7, 12, "Me", "Gibab", 3, "Mend"), swing(8, 12, "Gibab", "Troll"), swing(9, 12, "Watcher", "Me", 30, "stunned", 0, damage_type="applied"), swing(10, 13, "Me", "Bob", 3, "Mend"), swing(11, 13, "Bob", "Troll"),
    ]
    kept = kept_of(spark, rows, ally=("Me", "Ann", "Bob", "Me's hawk", "Gibab"))
    got = {r["combatant"]: (r["kind"], r["class"], r["mapped"], r["owner_name"]) for r in classify.classify_combatants(stats.combatant_stats(kept), classify.detect_classes(kept, maps)).collect()}
    assert got == {
        "Me": ("player", "Templar", 2, None), "Ann": ("player", None, 1, None), "Bob": ("pet", None, 0, None), "Troll": ("enemy", None, 0, None), "Me's hawk": ("pet", None, 0, "Me"),
        "Gibab": ("pet", None, 0, None), "Unknown": ("system", None, 0, None), "Watcher": ("bystander", None, 0, None),
    }


def test_group_is_filled_and_cut(spark):
    schema = "source_id string, encounter_id long, combatant string, confirmed boolean, total int, worth long"
    seven = [("a", 1, f"P{i}", i < 4, 7, 100 - i) for i in range(7)]
    got = {r["combatant"]: r["player"] for r in classify.bucket_fill(spark.createDataFrame(seven, schema)).collect()}
    assert got == {f"P{i}": i < 6 for i in range(7)}
    eight = [("a", 1, f"P{i}", True, 8, 5) for i in range(8)]  # ties fall by name
    got = {r["combatant"]: r["player"] for r in classify.bucket_fill(spark.createDataFrame(eight, schema)).collect()}
    assert got == {f"P{i}": i >= 2 for i in range(8)}


def test_rules_name_groups_and_fill_texts(spark):
    table = spark.createDataFrame([
        ("r1", r"^(?<attacker>.+) smashes (?<who_1>\w+) (hard|soft)", None, None, True, 3, "$1: ${who_1} by ${attacker}, $2 $$", 2.0),
        ("r2", r"^(?<YOU>\w+) is targeted", " targeted", "keep", True, 1, "", None),
    ], "rule string, regex string, literal string, zone string, enabled boolean, sound_type int, sound_data string, cooldown_s double")
    said = ["A troll smashes Ann hard", "Me is targeted", "Ann is targeted", "nothing"]
    lines = spark.createDataFrame([("a", "Me", i, 100 + i, "Old Keep 2", m) for i, m in enumerate(said)], "source_id string, owner string, seq long, ts long, zone string, message string")
    got = sorted((r["seq"], r["rule"], r["attacker"], r["victim"], r["text"], r["cooldown_s"]) for r in rules.match_rules(lines, table).collect())
    # Plain groups count before named ones.
    assert got == [(0, "r1", "A troll", "None", "hard: Ann by A troll, A troll $", 2.0), (1, "r2", "None", "None", None, 1.0)]
    assert rules.match_rules(lines.withColumn("zone", F.lit("Sea")), table).count() == 1
    assert rules.match_rules(lines, table.where("not enabled")).count() == 0


def test_abilities_mined_by_example(spark):
    # Casts at 0, 45 and 90; a debuff on the caster from 50 to 80 makes the second gap 45 - 30 + 30 / 1.5.
    hits = []
    for t in (0, 45, 90):
        hits += [swing(1000 + t * 10 + i, 1000 + t, "Troll", v, 2, "Stench", 100 if i else 0, damage_type="poison") for i, v in enumerate(("Me", "Ann"))]
        hits += [swing(1005 + t * 10, 1001 + t, "Troll", "Me", 2, "Stench", 100, damage_type="disease")]
    filler = [swing(100 + 10 * t, 1000 + t, "Me", "Troll") for t in range(0, 100, 5)]
    touch = [swing(1501, 1050, "Me", "Troll", 2, "Swipe")]
    status = [swing(1009 + t * 10, 1002 + t, "Unknown", "Ann", 30, "stunned", 0, damage_type="applied") for t in (0, 45, 90)]
    rows = sorted(hits + filler + touch + status, key=lambda r: (r[4], r[3]))
    rows = [(*r[:3], i, *r[4:]) for i, r in enumerate(rows)]
    kept = kept_of(spark, rows)
    fights = stats.fight_totals(stats.combatant_stats(kept))
    assert fights.count() == 1
    applies = kept.where("category = 30").select("source_id", "encounter_id", "victim", "seq", "ts", F.col("ability").alias("effect"), F.lit(6).cast("long").alias("duration_s"))
    got = mining.mine_abilities(mining.mob_hits(kept, fights), fights, mining.debuff_windows(kept.where("ability = 'Swipe'")), applies).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["attacker"], r["ability"], r["casts"], r["fights"], r["volleys"], r["hits"], r["damage"]) == ("Troll", "Stench", 3, 1, 3, 9, 600)
    assert (r["median_s"], r["least_s"], r["base_s"], round(r["coverage"], 3)) == (45, 45, 45.0, round(30 / 90, 3))
    assert (r["melee"], r["detriment"], r["inferred"], r["types"], r["effect"], r["effect_s"]) == (False, False, False, "disease, poison", "stunned", 6)
    timer = mining.mined_to_timers(spark.createDataFrame(got)).first()
    assert (timer["name"], timer["category"], timer["duration_s"], timer["warning_s"], timer["restrict_category"]) == ("Stench", "Troll", 45, 10, True)


def test_anonymous_blows_are_the_titles(spark):
    kept = kept_of(spark, [swing(1, 10, "Me", "Troll", amount=90), swing(2, 11, "Unknown", "Me", 2, "Stench")])
    fights = stats.fight_totals(stats.combatant_stats(kept))
    assert [(r["attacker"], r["inferred"]) for r in mining.mob_hits(kept, fights).collect()] == [("Troll", True)]
    nameless = fights.withColumn("title", F.lit(None).cast("string"))
    assert mining.mob_hits(kept, nameless).count() == 0


def test_archive_keeps_the_fuller_version(spark, tmp_path):
    rows = [swing(1, 10, "Me", "Troll", amount=90), swing(2, 11, "Me", "Troll", amount=10), swing(3, 40, "Me", "Rat")]
    path = str(tmp_path / "archive")

    def write(rows):
        kept = kept_of(spark, rows)
        s = stats.combatant_stats(kept)
        archive.write_archive(path, stats.fight_totals(s), s.drop("opening"), kept)
        e, c, w = archive.read_archive(spark, path)
        return sorted((r["encounter_id"], r["damage"], r["n_swings"]) for r in e.collect()), c.count(), w.count()

    assert write(rows[:1]) == ([(1, 90, 1)], 2, 1)
    assert write(rows) == ([(1, 100, 2), (3, 10, 1)], 4, 3)
    assert write(rows[:1]) == ([(1, 100, 2), (3, 10, 1)], 4, 3)


def test_payload_document(spark, tmp_path):
    rows = [swing(1, 100, "Me", "Troll", amount=91, critical=True), swing(2, 103, "Me", "Troll", 2, "Smite", 10, damage_type="divine"), swing(3, 103, "Me", "Troll", ability="Killing", amount=-10)]
    kept = kept_of(spark, rows)
    s = stats.combatant_stats(kept)
    docs = archive.payloads(kept, stats.bucket_fanout(kept), stats.fight_totals(s), s, "North")
    archive.write_payloads(docs, str(tmp_path / "out"))
    archive.write_payloads(docs, str(tmp_path / "out"))
    written = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(written) == 1
    doc = written[0]
    assert (doc["logger_name"], doc["logger_server"]) == ("Me", "North") and len(doc["encounter"]["encid"]) == 8
    assert {k: doc["encounter"][k] for k in ("title", "starttime", "endtime", "duration", "damage", "kills", "deaths", "success")} == {"title": "Troll", "starttime": "1970-01-01T00:01:40Z", "endtime": "1970-01-01T00:01:43Z", "duration": 3, "damage": 101, "kills": 1, "deaths": 0, "success": 1}
    me, troll = doc["combatants"]
    assert (me["name"], me["ally"], me["encdps"], me["tohit"], me["crithits"]) == ("Me", "T", 33.67, 100.0, 1)
    # Who only suffers is clamped to the fight's start.
    assert (troll["name"], troll["ally"], troll["starttime"], troll["endtime"], troll["deaths"]) == ("Troll", "F", "1970-01-01T00:01:40Z", "1970-01-01T00:01:40Z", 1)
    assert [(d["type"], d["damage"], d["median"]) for d in doc["damage_types"]] == [("Auto-Attack (Out)", 91, 91), ("Outgoing Damage", 101, 91), ("Skill/Ability (Out)", 10, 10)]
    assert [(d["type"], d["swingtype"], d["swings"]) for d in doc["attack_types"]] == [("Auto-Attack", 1, 1), ("Smite", 2, 1), ("Killing", 1, 1)]


def test_death_report_takes_the_whole_second(spark):
    rows = [swing(i, 10 + i // 3, "Troll", "Me", amount=i + 1) for i in range(9)] + [swing(9, 12, "Troll", "Me", ability="Killing", amount=-10), swing(10, 12, "Troll", "Me", amount=77), swing(11, 13, "Troll", "Me", amount=99)]
    got = sorted((r["back"], r["amount"]) for r in reports.death_report(kept_of(spark, rows)).collect())
    assert got == [(1, 77), (2, 9), (3, 8), (4, 7), (5, 6), (6, 5)]


def test_dimension_and_rule_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    maps = files.read_class_map(spark, put("m.json", '{"spells": {"smite": ["Templar"]}, "effects": {"glow": ["Bard", "Dirge"]}}'))
    assert sorted(map(str, maps.collect())) == ["Row(layer='effects', ability='glow', classes=['Bard', 'Dirge'])", "Row(layer='spells', ability='smite', classes=['Templar'])"]
    shipped = put("o.json", '{"overrides": [{"ability": "Glow IV", "source": "Item"}, {"ability": "", "source": "item"}, {"ability": "Maul", "classes": ["Conjuror"], "source": "class", "pet": true}, {"ability": "Song", "grantedBy": ["Bard"]}, {"ability": "Odd", "source": "none"}]}')
    user = put("u.json", '{"overrides": [{"ability": "glow", "source": "raid"}, {"ability": "glow", "source": "class"}]}')
    got = sorted((r["ability"], r["rank"], r["source"], r["pet"], r["granted_by"]) for r in files.read_overrides(spark, shipped, user).collect())
    assert got == [("glow", -2, "class", False, None), ("glow", -1, "raid", False, None), ("glow", 0, "item", False, None), ("maul", 2, "class", True, None), ("song", 3, None, False, ["Bard"])]
    assert [tuple(r) for r in files.read_scripted_wins(spark, put("w.json", '{"rules": [{"speakers": ["Sage"], "phrase": "done"}, {"speakers": [], "phrase": "x"}]}')).collect()] == [(["Sage"], "done")]
    pack = put("p.json", '{"zones": [{"zone": "Z", "encounters": [{"mob": "Mob", "triggers": [{"regex": "a", "active": true, "cooldown_seconds": 9999}, {"regex": ""}], "spell_timers": [{"name": "T", "checked": true, "timer_duration_s": 40, "restrict_category": true}, {"name": ""}]}]}]}')
    assert [(r["zone"], r["category"], r["regex"], r["enabled"], r["cooldown_s"]) for r in files.read_rule_pack(spark, pack).collect()] == [("Z", "Mob", "a", True, 3600.0)]
    assert [(r["name"], r["category"], r["duration_s"], r["restrict_category"], r["modable"]) for r in files.read_pack_timers(spark, pack).collect()] == [("T", "Mob", 40, True, False)]
    xml = put("x.xml", '<C><Trigger R="a" C="B" /><Trigger R="a" /><Spell N="Stench" C="Troll" T="45" RC="T" M="F" /><Spell Name="Roar" Category="Troll" Checked="False" Timer="x" /><Spell Name="Odd" /></C>')
    assert sorted((r["name"], r["duration_s"], r["restrict_category"], r["modable"], r["enabled"], r["remove_s"]) for r in files.read_timer_xml(spark, xml).collect()) == [("Roar", 30, False, True, False, -15), ("Stench", 45, True, False, True, -15)]
    assert sorted(map(tuple, files.bad_rows(spark, xml).select("kind", "all_rows", "bad_rows").collect())) == [("timer", 3, 1), ("trigger", 2, 1)]
