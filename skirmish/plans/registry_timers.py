"""Queries on timers, chat, names and what the other modules leave over."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar, scalars
from ..operators import archive, chat, classify, mining, reports, rules, sessions, stats, timers
from ..sources import adapter, files
from ..streaming import live
from . import sql
from .registry import kept, on_kept, on_stored, on_swings, register
from .registry_more import _matches

# Invented definitions for the adapter's abilities (timers.DEFINITION).
TIMERS = (
    (1, "Skill 1", "General", "", True, 5, 2, -3, False, False, False, True, True, False),
    (2, "Skill 1", "a mob 0|a mob 1", "", True, 6, 2, -3, False, False, False, True, True, False),
    (3, "Skill 1", "a mob 1", "Zone 2", True, 7, 2, -3, False, False, False, False, False, True),
    (4, "Skill 2", "a mob 1", "Zone 1", True, 8, 3, -3, False, False, True, True, True, True),
    (5, "Skill 2", "General", "zone 3", True, 4, 1, 0, True, False, False, True, True, False),
    (6, "Skill 3", "General", "", True, 5, 2, -3, False, True, False, True, True, False),
    (7, "Skill 3", "a mob 0", "", False, 9, 2, -3, False, False, False, True, True, False),
)
DEBUFFS = {"skill 4": (0.5, 10), "effect 1": (0.25, 10)}
ASKING = (("big hit", True, "Skill 1", "", "General"), ("block", True, "Skill 2", "Zone 9", "Boss"))
_DEFS = ", df(ord, name, category, zone, restrict) as (values " + ", ".join(f"({t[0]},'{t[1]}','{t[2]}','{t[3]}',{str(t[10]).lower()})" for t in TIMERS if t[4]) + ")"
_TIER = "case when restrict and not c then null when restrict then 4+z::int else 2*c::int+z::int end"


def definitions(spark):
    return spark.createDataFrame(list(TIMERS), timers.DEFINITION)


def requests(spark, d):
    matches = _matches(spark, d).join(adapter.swings(spark, d).select("source_id", "seq", "zone"), ["source_id", "seq"])
    return timers.linked_requests(matches, spark.createDataFrame(list(ASKING), "rule string, starts_timer boolean, timer_name string, zone string, category string"))


def bars(spark, d):
    return timers.recast_timers(kept(spark, d), definitions(spark), requests(spark, d), DEBUFFS)


def _chosen(notices, spark):
    return timers.choose_timers(notices, definitions(spark)).where("chosen is not null").select("source_id", "seq", "timer", F.col("chosen.ord").alias("definition"), "tier")


def _notices(k):
    none = F.lit(None).cast("string")
    return k.where("amount <> -10").select("source_id", "seq", F.col("ability").alias("timer"), "attacker", "victim", "zone", none.alias("rule_zone"), none.alias("rule_category"))


_ACTIONS = ", nt as (select source_id, seq, ability as timer, lower(attacker) as a, lower(victim) as v, lower(zone) as zn from k where amount<>-10)"
_RANKED = ", tc as (select nt.*, ord as definition, list_has_any(string_split(lower(category),'|'), [a, v, zn]) as c, zone<>'' and lower(zone)=zn as z, restrict from nt join df on lower(name)=lower(timer))"
register("timer_choice", lambda spark, d: _chosen(_notices(kept(spark, d)), spark), sql.KEPT + _DEFS + _ACTIONS + _RANKED, f"select source_id, seq, timer, definition, {_TIER} as tier from tc where {_TIER} is not null qualify row_number() over (partition by source_id, seq order by {_TIER} desc, definition desc)=1")
# "big hit" names a filed timer exactly; "block" doesn't, and only the unrestricted one without category or zone is left.
register("linked_timers", lambda spark, d: _chosen(requests(spark, d), spark), sql.SWINGS, "select source_id, seq, 'Skill 1' as timer, 1 as definition, 6 as tier from s where category in (1,2) and amount>=10000 union all select source_id, seq, 'Skill 2', 5, 0 from s where amount=-5 and zone='Zone 1'")
register("recast_timers", bars)
register("timer_mods", lambda spark, d: timers.timer_mods(bars(spark, d)))
register("timer_events", lambda spark, d: timers.timer_events(bars(spark, d)))
register("timer_board", lambda spark, d: timers.timer_board(bars(spark, d), adapter.swings(spark, d).select("source_id", F.col("ts").alias("at_ts")).distinct()))


# --- chat -------------------------------------------------------------------
def chatter(spark, d):
    """Cures told as shared rules, plain lines as speech of two characters."""
    s = adapter.swings(spark, d)
    share = F.concat(F.lit(r"\aPC -1 "), "attacker", F.lit(":"), "attacker", F.lit(r'\/a says to the group, "<Trigger R="'), "ability", F.lit('" C="'), "victim", F.lit('" T="T" TN="'), "ability", F.lit('" />"'))
    speech = F.concat(F.lit(r"\aNPC 7 Sage "), (F.col("seq") % 2).cast("string"), F.lit(":Sage "), (F.col("seq") % 2).cast("string"), F.lit(r'\/a says, "door '), F.col("seq").cast("string"), F.lit(' opens"'))
    return s.where("category in (0, 20)").withColumn("message", F.when(F.col("category") == 20, share).otherwise(speech))


def win_lines(spark, d):
    return chat.scripted_win_lines(chatter(spark, d), spark.createDataFrame([(["Sage 1", "Oracle"], " opens")], "speakers array<string>, phrase string"))


register("chat_rule_shares", lambda spark, d: chat.chat_rule_shares(chatter(spark, d)).select("source_id", "seq", "is_self", "sharer", "regex", "category", "timer_name"), sql.SWINGS, "select source_id, seq, false as is_self, attacker as sharer, ability as regex, victim as category, ability as timer_name from s where category=20")
register("shared_rule_feed", lambda spark, d: chat.shared_rule_feed(chat.chat_rule_shares(chatter(spark, d)), spark.createDataFrame([("", "P1", "Skill 4")], "zone string, category string, regex string")))
register("scripted_win_lines", lambda spark, d: win_lines(spark, d).select("source_id", "seq"), sql.SWINGS, "select source_id, seq from s where category=0 and seq%2=1")
register("scripted_win_flag", lambda spark, d: chat.scripted_win_flag(adapter.swings(spark, d), win_lines(spark, d)), sql.KEPT, "select distinct source_id, encounter_id from h5 where category=0 and seq%2=1 and not ended")

# --- predicates and names -----------------------------------------------------
on_swings("is_self_damage", lambda s: s.groupBy("attacker").agg(stats.count_if(scalars.is_self_damage()).alias("n")), "select attacker, count(*) filter (category in (1,2) and upper(attacker)=upper(victim)) as n from s group by 1")
on_kept("is_boss_title", lambda k: reports.fights(k).select("source_id", "encounter_id", scalars.is_boss_title(F.when(F.col("encounter_id") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("The "), "title"))).alias("boss")), sql.TITLED, "select source_id, encounter_id, encounter_id%2=1 and title is not null as boss from fights")
on_swings("is_pet_name", lambda s: s.select("attacker").distinct().select("attacker", classify.is_pet_name(F.col("attacker")).alias("pet")), "select distinct attacker, contains(attacker, ' ') as pet from s")
on_swings("pet_owner", lambda s: s.groupBy(classify.pet_owner(F.concat("attacker", F.when(F.col("seq") % 3 == 0, "'s hawk").when(F.col("seq") % 3 == 1, "' warder").otherwise(""))).alias("owner_name")).agg(F.count("*").alias("n")), "select case when seq%3<2 then attacker end as owner_name, count(*) as n from s group by 1")
on_swings("strip_instance_no", lambda s: s.groupBy(scalars.strip_instance_no(F.col("zone")).alias("zone")).agg(F.count("*").alias("n")), "select regexp_replace(zone, ' [0-9]+$', '') as zone, count(*) as n from s group by 1")
on_swings("avoid_actor", lambda s: s.where("damage_type = 'avoided'").groupBy("victim", scalars.avoid_actor(F.when(F.col("seq") % 3 == 1, F.concat(F.lit("by="), "attacker")).when(F.col("seq") % 3 == 2, F.concat(F.lit("by="), "victim", F.lit("'s hammer"))), F.col("victim")).alias("actor")).agg(F.count("*").alias("n")), "select victim, case when seq%3=1 and upper(attacker)<>upper(victim) then attacker when seq%3=2 then '(weapon)' else 'self' end as actor, count(*) as n from s where damage_type='avoided' group by 1,2")
on_swings("parse_amount", lambda s: s.where("amount > 0").select("seq", grammar.parse_amount(scalars.grouped(F.col("amount"))).alias("plain"), grammar.parse_amount(F.concat((F.col("amount") / 10).cast("decimal(20,1)").cast("string"), F.lit("K"))).alias("thousands")), "select seq, amount as plain, amount*100 as thousands from s where amount>0")
on_swings("normalize_special", lambda s: s.groupBy(grammar.normalize_special(F.when(F.col("special") == "Multi Attack", F.when(F.col("seq") % 2 == 0, "double attacks").otherwise("multi attacks")).when(F.col("special") == "Flurry", "flurries").when(F.col("special") == "AoE Attack", "aoe attacks").otherwise("hits")).alias("special")).agg(F.count("*").alias("n")), "select special, count(*) as n from s group by 1")
on_swings("resolve_you", lambda s: s.groupBy(grammar.resolve_you(F.when(F.col("attacker") == F.col("owner"), F.when(F.col("seq") % 2 == 0, "YOU").otherwise("yourself")).otherwise(F.col("attacker")), F.col("owner")).alias("attacker")).agg(F.count("*").alias("n")), "select attacker, count(*) as n from s group by 1")

on_swings("canonical_control", lambda s: s.where("category = 30").groupBy(scalars.canonical_control(F.when(F.col("seq") % 2 == 0, F.col("ability")).otherwise("dazzled")).alias("effect")).agg(F.count("*").alias("n")), "select case when seq%2=0 then 'stun' else 'mez' end as effect, count(*) as n from s where category=30 group by 1")
on_swings("callout_word", lambda s: s.where("category = 30").groupBy(scalars.callout_word(F.when(F.col("seq") % 2 == 0, scalars.canonical_control(F.col("ability"))).otherwise("other")).alias("word")).agg(F.count("*").alias("n")), "select case when seq%2=0 then 'stunned' else 'other' end as word, count(*) as n from s where category=30 group by 1")
on_swings("impossible_school", lambda s: s.where("category = 1").groupBy("attacker", "damage_type").agg(stats.count_if(scalars.impossible_school(F.when(F.col("seq") % 2 == 0, "Templar").otherwise("wizard"), F.col("damage_type"))).alias("n")), "select attacker, damage_type, count(*) filter (damage_type='slashing' or (damage_type='piercing' and seq%2=0)) as n from s where category=1 group by 1,2")
on_swings("archetype_of", lambda s: s.groupBy(scalars.archetype_of(F.element_at(F.array(*map(F.lit, ("Guardian", "templar", "Ranger", "Wizard", "Nobody"))), (F.col("seq") % 5 + 1).cast("int"))).alias("archetype")).agg(F.count("*").alias("n")), "select ['Fighter','Priest','Scout','Mage',null][seq%5+1] as archetype, count(*) as n from s group by 1")


def told(spark, d, message):
    return grammar.parse(adapter.swings(spark, d).withColumn("message", message).select("source_id", "owner", "seq", "ts", "message"))


def ward_line():
    text = F.concat("attacker", F.lit("'s "), "ability", F.lit(" absorbs "), F.col("amount").cast("string"), F.lit(" points of damage from being done to "), "victim", F.lit(". ("), F.col("seq").cast("string"), F.lit(" points remaining)"))
    return F.when(F.col("category") == 3, text).otherwise("quiet")


def travel_line():
    """Every hundredth line enters a zone, some later lines tell a lockout."""
    return F.when(F.col("seq") % 100 == 0, F.concat(F.lit("You have entered "), "zone", F.lit("."))).when(F.col("seq") % 200 == 3, F.concat(F.lit("This instance will expire in "), (F.col("seq") % 7 + 1).cast("string"), F.lit(" days 5 hours."))).otherwise("nothing happens")


register("parse_ward", lambda spark, d: told(spark, d, ward_line()).where("family = 'ward'").select("seq", "attacker", "ability", "amount", "victim", "damage_type", "extra"), sql.SWINGS, "select seq, attacker, ability, amount, victim, 'Ward (Absorb)' as damage_type, 'remaining=' || seq as extra from s where category=3")
register("parse_zone", lambda spark, d: told(spark, d, travel_line()).where("family = 'zone'").select("source_id", "seq", "zone_entered"), sql.SWINGS, "select source_id, seq, zone as zone_entered from s where seq%100=0")
register("parse_lockout", lambda spark, d: told(spark, d, travel_line()).where("family = 'lockout'").select("source_id", "seq", "lockout_s"), sql.SWINGS, "select source_id, seq, ((seq%7+1)*86400+5*3600)::bigint as lockout_s from s where seq%200=3")
# Seeds before the last fight of each log, and what holds during the fights after travel.
def travels(spark, d):
    return told(spark, d, travel_line())


def _last_start(k):
    return k.groupBy("source_id").agg(F.max("encounter_id").alias("before_seq"))


_TRAVEL = ", tv as (select source_id, seq, ts, zone from s where seq%100=0), lo as (select source_id, seq, ts, ts+((seq%7+1)*86400+5*3600)::bigint as expiry from s where seq%200=3)"
register("zone_seed", lambda spark, d: files.zone_seed(travels(spark, d), _last_start(kept(spark, d))), sql.KEPT + _TRAVEL, "select tv.source_id, arg_max(tv.zone, tv.seq) as zone, arg_max_null(lo.expiry, tv.seq) as instance_expiry from tv join (select source_id, max(encounter_id) as b from k group by 1) using (source_id) left join lo on lo.source_id=tv.source_id and lo.seq=tv.seq+3 where tv.seq<b group by 1")


def carried(spark, d):
    """The adapter's actions, their zone and instance from the lines of travel."""
    lines = sessions.carry_zones(travels(spark, d), part_rows=1000).select("source_id", "seq", "zone", "instance_expiry")
    return sessions.segment(adapter.swings(spark, d).drop("zone").join(lines, ["source_id", "seq"]))


_CARRIED = ", zc as (select *, max(case when seq%100=0 then seq end) over (partition by source_id order by seq) as zseq from s), zd as (select zc.source_id, zc.seq, coalesce(z.zone,'') as zone, (select arg_max(lo.expiry, lo.seq) from lo where lo.source_id=zc.source_id and lo.seq>zc.zseq and lo.seq<=zc.seq and lo.ts-z.ts between 0 and 10) as instance_expiry from zc left join s z on z.source_id=zc.source_id and z.seq=zc.zseq)"
_FIRST = ", fz as (select k.source_id, encounter_id, zd.zone, instance_expiry, ts as start_ts from k join zd on zd.source_id=k.source_id and zd.seq=k.seq where k.seq=encounter_id)"
register("carry_zones", lambda spark, d: sessions.carry_zones(travels(spark, d), part_rows=1000).select("source_id", "seq", "zone", "instance_expiry"), sql.SWINGS + _TRAVEL + _CARRIED, "select source_id, seq, zone, instance_expiry from zd")
register("encounter_instance", lambda spark, d: sessions.encounter_instance(carried(spark, d)), sql.KEPT + _TRAVEL + _CARRIED + _FIRST, "select source_id, encounter_id, zone, instance_expiry from fz")


def _instance_runs(spark, d):
    k = carried(spark, d)
    starts = k.groupBy("source_id", "encounter_id").agg(F.min_by("ts", "seq").alias("start_ts"))
    return sessions.instance_runs(sessions.zone_runs(sessions.encounter_instance(k).join(starts, ["source_id", "encounter_id"]))).select("source_id", "encounter_id", "zone", "run", "instance")


register("instance_runs", _instance_runs)
register("read_log_window", lambda spark, d: files.read_log_window(told(spark, d, travel_line()), 1_700_000_500, 300, 200, 5).select("source_id", "seq"), sql.SWINGS, "select source_id, seq from (select source_id, seq, row_number() over (partition by source_id, ts>=1700000500 order by case when ts>=1700000500 then seq else -seq end) as r from s where ts between 1700000200 and 1700000700) where r<=5")


# --- rule sets of the adapter's abilities --------------------------------------
def _pack(s):
    return s.select(F.concat("attacker", F.lit("/"), "ability").alias("rule"), (F.length("ability") % 2 == 0).alias("enabled")).distinct()


_SETS = ", pk as (select distinct attacker || '/' || ability as rule, length(ability)%2=0 as enabled from s)"
on_swings("merge_rule_sets", lambda s: rules.merge_rule_sets(_pack(s), _pack(s.where("category = 1")), _pack(s.where("category in (0, 1, 3)")).select("rule", F.col("rule").startswith("P1/").alias("disabled"), F.col("rule").startswith("P2/").alias("enabled_override"))), "select rule, from_pack, not coalesce(ov and starts_with(rule,'P1/'), false) and (from_pack or coalesce(ov and starts_with(rule,'P2/'), false) or enabled) as enabled from (select distinct attacker || '/' || ability as rule, length(ability)%2=0 as enabled, attacker || '/' || ability not in (select attacker || '/' || ability from s where category=1) as from_pack, attacker || '/' || ability in (select attacker || '/' || ability from s where category in (0,1,3)) as ov from s)")
on_swings("ensure_linked_timers", lambda s: rules.ensure_linked_timers(s.select(F.col("ability").alias("timer_name"), (F.col("category") > 1).alias("starts_timer")), s.where("category = 1").select(F.col("ability").alias("name"), F.lit("General").alias("category"), F.lit(20).alias("duration_s")).distinct()), "select distinct ability as name, 'General' as category, 20::bigint as duration_s from s where category=1 union all select distinct ability, '', 30::bigint from s where category>1 and ability not in (select ability from s where category=1)")

# --- reports and archive -------------------------------------------------------
on_stored("find_encounter", lambda k: archive.find_encounter(reports.fights(k).join(k.select("source_id", "encounter_id", "owner").distinct(), ["source_id", "encounter_id"]), k.select("source_id", "encounter_id", "owner").distinct().join(reports.fights(k), ["source_id", "encounter_id"]).where("encounter_id % 2 = 0").select("source_id", "owner", "start_ts", "end_ts", "title")).select("source_id", "encounter_id"), sql.TITLED, "select source_id, encounter_id from fights f where exists (select 1 from fights g where g.encounter_id%2=0 and g.source_id=f.source_id and g.start_ts=f.start_ts and g.end_ts=f.end_ts and g.title is not distinct from f.title)")
on_stored("idempotent_upload", lambda k: live.idempotent_upload(reports.fights(k).select(F.concat("source_id", F.lit("/"), F.expr("encounter_id div 100")).alias("encid")), reports.fights(k).where("encounter_id % 3 = 0").select(F.concat("source_id", F.lit("/"), F.expr("encounter_id div 100")).alias("encid"))), sql.TITLED, "select distinct source_id || '/' || (encounter_id//100) as encid from fights where source_id || '/' || (encounter_id//100) not in (select source_id || '/' || (encounter_id//100) from fights where encounter_id%3=0)")
on_stored("infer_caster", lambda k: mining.infer_caster(k.where("category in (1, 2)").withColumn("attacker", F.when(F.col("seq") % 5 == 0, "Unknown").otherwise(F.col("attacker"))), reports.fights(k)).groupBy("source_id", "encounter_id", F.col("attacker").alias("caster"), "inferred").agg(F.count("*").alias("n")), sql.TITLED, "select source_id, encounter_id, case when seq%5=0 then coalesce(title,'Unknown') else attacker end as caster, seq%5=0 and title is not null as inferred, count(*)::bigint as n from k join fights using (source_id, encounter_id) where category in (1,2) group by 1,2,3,4")


# --- from a swing back to its line --------------------------------------------------
def _focus(spark, d):
    lines = adapter.lines(spark, d)
    wanted = adapter.swings(spark, d).where("category in (1, 2, 3) and amount > 0").select("source_id", "seq", "ts", "amount", "ability")
    return files.swing_log_focus(wanted, grammar.parse_header(lines).select("source_id", "seq", "ts", "raw"))


register("swing_log_focus", _focus, sql.SWINGS, "select source_id, seq, seq as line_seq from s where category in (1,2,3) and amount>0")


# --- dimension files, written out and read --------------------------------------------
def _folder(spark):
    import uuid

    return f"{files.shared_folder(spark)}/dims-{uuid.uuid4().hex}"


def _class_file(spark, d):
    """A map of the adapter's abilities to classes, as a file."""
    pairs = adapter.swings(spark, d).where("category in (1, 2)").select("ability", F.concat(F.lit("Class "), (F.length("attacker") % 3).cast("string")).alias("c"))
    listed = pairs.groupBy("ability").agg(F.sort_array(F.collect_set("c")).alias("classes"))
    one = listed.groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ability", "classes")))).alias("spells"))
    path = _folder(spark)
    one.withColumn("effects", F.map_filter("spells", lambda k, v: F.size(v) > 1)).coalesce(1).write.json(path)
    return files.read_class_map(spark, path)


def _override_file(spark, d):
    rows = adapter.swings(spark, d).where("category = 2").groupBy("ability").agg(F.count("*").alias("n"))
    entry = F.struct(F.concat("ability", F.lit(" IV")).alias("ability"), F.when(F.col("n") % 2 == 0, F.array(F.lit("Wizard"))).alias("classes"), F.when(F.length("ability") > 0, "Item").alias("source"), F.lit("a note").alias("note"), F.array(F.lit("Bard")).alias("grantedBy"), F.lit(True).alias("pet"))
    path = _folder(spark)
    rows.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("overrides")).coalesce(1).write.json(path)
    return files.read_overrides(spark, path).withColumns({"classes": F.array_join("classes", ","), "granted_by": F.array_join("granted_by", ",")})


register("read_dims", lambda spark, d: _class_file(spark, d).withColumn("classes", F.array_join("classes", ",")), sql.SWINGS + ", am as (select ability, string_agg(distinct 'Class ' || (length(attacker)%3), ',' order by 'Class ' || (length(attacker)%3)) as classes from s where category in (1,2) group by 1)", "select 'spells' as layer, ability, classes from am union all select 'effects', ability, classes from am where contains(classes, ',')")
register("read_overrides", _override_file, sql.SWINGS, "select lower(ability) as ability, (row_number() over (order by ability || ' IV')-1)::int as rank, case when count(*)%2=0 then 'Wizard' end as classes, 'item' as source, count(*)%2=0 as pet, 'Bard' as granted_by from s where category=2 group by ability")
