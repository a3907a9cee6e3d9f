"""Queries over the adapter, each with its plain SQL where there is one."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grammar, scalars
from ..operators import allies, reports, sessions, stats
from ..sources import adapter
from ..sources.files import stored
from . import sql

#: How many partitions a shuffle has before adaptive execution puts small ones together.
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: What a task reads of files, and of a shuffle whose small partitions are put together.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}
#: The session's own settings while those of TASK_BYTES hold.
_OWN_BYTES: dict[str, str] = {}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def ally(name):
    """The adapter's rule: everyone but the mobs."""
    return ~F.lower(name).startswith("a mob")


def enemy(name):
    return F.lower(name).startswith("a mob")


def kept(spark, sf_dir):
    return allies.mark_by(sessions.segment(adapter.swings(spark, sf_dir)), ally)


window = sessions.encounter_window
combatants = stats.combatant_stats


def _bytes(text: str) -> int:
    """A size as Spark's settings have it: 134217728, 16m, 64MB."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def sized(run):
    """A query whose shuffles begin with as many partitions as its events need: adaptive
    execution puts small ones together but divides none, so with a fixed number what a
    task sorts or groups would grow with the log.  Then a task's bytes are bounded too
    (TASK_BYTES), as what is read or put together at once would grow up to 128 and 64 MB.
    The session's own number stays; its bytes come back with a query of few events."""

    def query(spark, sf_dir):
        tasks = -(-adapter.events(spark, sf_dir).count() // sessions.TASK_ROWS)
        if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(FIRST_PARTITIONS, str(tasks))
            for key, most in TASK_BYTES.items():
                if key not in _OWN_BYTES and _bytes(spark.conf.get(key)) > most:
                    _OWN_BYTES[key] = spark.conf.get(key)
                    spark.conf.set(key, f"{most}b")
        else:
            spark.conf.unset(FIRST_PARTITIONS)
            while _OWN_BYTES:
                spark.conf.set(*_OWN_BYTES.popitem())
        return run(spark, sf_dir)

    return query


def register(name, run, prefix=None, body=None):
    QUERIES[name] = sized(run)
    if body:
        ORACLES[name] = sql.query(prefix, body)


def on_swings(name, run, body):
    register(name, lambda spark, d: run(adapter.swings(spark, d)), sql.SWINGS, body)


def on_kept(name, run, prefix, body):
    register(name, lambda spark, d: run(kept(spark, d)), prefix, body)


def on_stored(name, run, prefix, body):
    """For what reads the actions more than once: they are cut into fights once."""
    register(name, lambda spark, d: run(stored(kept(spark, d))), prefix, body)


# --- scalar functions and predicates ---------------------------------------
on_swings("amount_class", lambda s: s.groupBy(scalars.amount_class(F.col("amount")).alias("amount_class")).agg(F.count("*").alias("n"), F.sum("amount").alias("total")),
    "select case when amount>0 then 'damage' when amount=0 then 'none' when amount=-1 then 'miss' when amount=-2 then 'resist' when amount=-3 then 'parry' when amount=-4 then 'riposte' when amount=-5 then 'block' when amount=-10 then 'death' else 'unknown' end as amount_class, count(*) as n, sum(amount)::bigint as total from s group by 1")
on_swings("is_hostile", lambda s: s.select("seq", scalars.is_hostile().alias("hostile"), scalars.is_self_damage().alias("self_damage")),
    "select seq, (category in (1,2) and ability<>'Killing' and upper(attacker)<>upper(victim)) as hostile, (category in (1,2) and upper(attacker)=upper(victim)) as self_damage from s")
on_swings("looks_like_player", lambda s: s.groupBy(F.col("attacker").alias("name")).agg(F.max(scalars.looks_like_player(F.col("attacker"))).alias("player"), F.max(scalars.is_boss_title(F.col("attacker"))).alias("boss")),
    "select attacker as name, max(position(' ' in attacker)=0) as player, max(not starts_with(lower(attacker),'a ')) as boss from s group by 1")
on_swings("normalize_ability", lambda s: s.select(scalars.normalize_ability(F.concat(F.lit(" "), "ability", F.lit(" IV "))).alias("ability"), scalars.strip_instance_no(F.col("zone")).alias("zone")).groupBy("ability", "zone").agg(F.count("*").alias("n")),
    "select lower(ability) as ability, 'Zone' as zone, count(*) as n from s group by 1")
on_swings("contains_amount", lambda s: s.where("amount > 0").groupBy("category").agg(F.sum(scalars.contains_amount(F.concat(F.lit("for "), scalars.grouped(F.col("amount")), F.lit(" damage")), F.col("amount")).cast("int")).alias("shown"), F.sum(scalars.contains_amount(F.lit("no number here"), F.col("amount")).cast("int")).alias("hidden")),
    "select category, count(*) as shown, 0::bigint as hidden from s where amount>0 group by 1")
on_swings("is_live", lambda s: s.select("seq", scalars.is_live(F.col("ts"), F.when(F.col("seq") % 3 > 0, F.col("ts") * 1000 + F.col("seq") % 40 * 1000)).alias("live")),
    "select seq, (seq%3=0 or seq%40<30) as live from s")
on_swings("compare_amount", lambda s: s.select("seq", F.row_number().over(Window.partitionBy("source_id", "zone", "victim").orderBy(scalars.clamp_amount(F.col("amount")), "seq")).cast("long").alias("place")),
    "select seq, row_number() over (partition by source_id, zone, victim order by amount, seq) as place from s")


# --- grammar: swings written out as log lines, read back ---------------------
def parsed(spark, sf_dir):
    return grammar.parse(grammar.parse_header(adapter.lines(spark, sf_dir)))


PARSED = ("source_id", "seq", "ts", "category", "critical", "special", "attacker", "ability", "amount", "victim", "damage_type")
_COLS = "source_id, seq, ts, category, critical, special, attacker, ability, amount, victim, damage_type"
register("parse_header", lambda spark, d: grammar.parse_header(adapter.lines(spark, d)).select("source_id", "seq", "ts", F.expr("message like 'A door creaks %'").alias("noise")), sql.SWINGS, "select source_id, seq, ts, category in (0,10) as noise from s")
for _name, _family, _where in (
    ("parse_damage", "damage", "category in (1,2) and damage_type not in ('avoided','death','none')"),
    ("parse_no_damage", "none", "damage_type='none'"),
    ("parse_avoid", "avoid", "damage_type='avoided'"),
    ("parse_heal", "heal", "category=3"),
    ("parse_power", "power", "category=13"),
    ("parse_threat", "threat", "category=16"),
    ("parse_cure", "cure", "category=20"),
    ("parse_death", "death", "damage_type='death'"),
):
    register(_name, lambda spark, d, f=_family: parsed(spark, d).where(F.col("family") == f).select(*PARSED), sql.SWINGS, f"select {_COLS if _family != 'none' else _COLS.replace('critical', 'false as critical')} from s where {_where}")
register("parse_status", lambda spark, d: parsed(spark, d).where("family in ('applied', 'released')").select("source_id", "seq", "ts", "category", "attacker", "ability", "victim", "damage_type"), sql.SWINGS, "select source_id, seq, ts, category, 'Unknown' as attacker, ability, victim, damage_type from s where category=30")
register("mark_pet_death", lambda spark, d: parsed(spark, d).where("family = 'death'").select("source_id", "seq", "victim", F.coalesce(F.col("extra") == "pet-death", F.lit(False)).alias("pet")), sql.SWINGS, "select source_id, seq, victim, victim=owner as pet from s where damage_type='death'")
register("grammar_coverage", lambda spark, d: grammar.grammar_coverage(parsed(spark, d)), sql.SWINGS, "select 'A door creaks N times.' as template, count(*) as n_lines from s where category in (0,10)")

# --- sessions ---------------------------------------------------------------
on_kept("segment_encounters", lambda k: k.select("source_id", "seq", "encounter_id", "time_sorter", "hostile"), sql.KEPT, "select source_id, seq, encounter_id, time_sorter, hostile from k")
on_kept("encounter_zone", sessions.encounter_zone, sql.TITLED, "select source_id, encounter_id, zone from z")
# The adapter's zones change between fights only; here they change every 7 lines too.
_moving = lambda k: k.withColumn("zone", F.concat(F.lit("Zone "), F.expr("seq div 7 % 3").cast("string")))
on_stored("zone_asof", lambda k: (lambda m: m.join(sessions.encounter_zone(m).withColumnRenamed("zone", "fight_zone"), ["source_id", "encounter_id"]).where("zone <> fight_zone").select("source_id", "seq", "zone", "fight_zone"))(_moving(k)), sql.KEPT + ", mv as (select source_id, encounter_id, seq, 'Zone ' || ((seq//7)%3) as zone from k), mz as (select source_id, encounter_id, arg_min(zone, seq) as fight_zone from mv group by all)", "select source_id, seq, zone, fight_zone from mv join mz using (source_id, encounter_id) where zone<>fight_zone")
on_kept("encounter_window", window, sql.WINDOW, "select * from w")
on_kept("zone_runs", lambda k: sessions.zone_runs(reports.fights(k)).select("source_id", "encounter_id", "zone", "run"), sql.TITLED, "select source_id, encounter_id, zone, sum(ch) over (partition by source_id order by start_ts, encounter_id)::bigint as run from (select *, (zone is distinct from lag(zone) over (partition by source_id order by start_ts, encounter_id))::int as ch from fights)")
on_kept("day_sections", lambda k: sessions.day_sections(sessions.zone_runs(reports.fights(k))), sql.TITLED, "select source_id, run, zone, count(*) as fights, strftime(make_timestamp(max(start_ts)*1000000), '%Y-%m-%d') as day from (select *, sum(ch) over (partition by source_id order by start_ts, encounter_id)::bigint as run from (select *, (zone is distinct from lag(zone) over (partition by source_id order by start_ts, encounter_id))::int as ch from fights)) group by 1,2,3")
on_kept("discard_scraps", lambda k: reports.fights(k).where("title is not null").select("source_id", "encounter_id", "title"), sql.TITLED, "select source_id, encounter_id, title from fights where title is not null")

# --- rollups ----------------------------------------------------------------
_STATS = "coalesce(sum(amount) filter (amount>0),0)::bigint as damage, count(*) filter (amount<>-10 or ability='Killing') as swings, count(*) filter (amount>=0) as hits, count(*) filter (critical and amount>=0) as crits, count(*) filter (amount=-1) as misses, count(*) filter (amount<-1 and amount<>-10) as avoids, count(*) filter (amount=-10) as deaths, coalesce(min(amount) filter (amount>=0),0)::bigint as min_hit, coalesce(max(amount) filter (amount>0),0)::bigint as max_hit, min(ts) as first_ts, max(ts) as last_ts"
_ALL = "fa as (select * exclude (ability), unnest([ability, 'All']) as ability from f)"
on_kept("bucket_fanout", lambda k: stats.bucket_fanout(k).groupBy("source_id", "encounter_id", "combatant", "direction", "bucket").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs")), sql.FANNED, "select source_id, encounter_id, combatant, direction, bucket, count(*) as n, sum(seq)::bigint as seqs from f group by 1,2,3,4,5")
on_kept("ability_stats", lambda k: stats.ability_stats(stats.bucket_fanout(k)), sql.FANNED, f"select source_id, encounter_id, combatant, bucket, ability, {_STATS} from f group by 1,2,3,4,5")
on_kept("ability_stats_all", lambda k: stats.ability_stats_all(stats.bucket_fanout(k)), sql.FANNED + ", " + _ALL, f"select source_id, encounter_id, combatant, bucket, ability, {_STATS} from fa group by 1,2,3,4,5")
on_kept("upper_median", lambda k: stats.upper_median(stats.bucket_fanout(k), ("source_id", "encounter_id", "combatant", "bucket")), sql.FANNED, "select source_id, encounter_id, combatant, bucket, list_sort(list(amount))[count(*)//2+1] as median from f where amount>=0 group by 1,2,3,4")
on_kept("combatant_stats", lambda k: combatants(k).drop("opening"), sql.COMBATANTS, "select * from c")
on_kept("deaths", lambda k: stats.death_counts(combatants(k)), sql.COMBATANTS, "select source_id, encounter_id, combatant, deaths, pet_deaths from c where deaths+pet_deaths>0")
register("pet_deaths", lambda spark, d: parsed(spark, d).where("family='death'").groupBy("source_id", F.col("victim").alias("combatant")).agg(stats.count_if(F.coalesce(F.col("extra") == "pet-death", F.lit(False))).alias("pet_deaths")), sql.SWINGS, "select source_id, victim as combatant, count(*) filter (victim=owner) as pet_deaths from s where damage_type='death' group by 1,2")
on_kept("kills", lambda k: stats.kill_counts(combatants(k)), sql.COMBATANTS, "select source_id, encounter_id, combatant, kills from c where kills>0")
on_kept("autoattack_by_school", stats.autoattack_by_school, sql.KEPT, "select source_id, encounter_id, attacker as combatant, lower(damage_type) as school, sum(amount)::bigint as damage, count(*) as hits from k where category=1 and ability='Auto-Attack' and amount>0 group by 1,2,3,4")
on_kept("ally_edges", stats.ally_edges, sql.KEPT, "select source_id, encounter_id, src, dst, sum(v)::bigint as value from (select source_id, encounter_id, attacker as src, victim as dst, case when category in (3,13) then 1 else -1 end as v from k where upper(attacker)<>upper(victim) and category not in (20,30) union all select source_id, encounter_id, victim, attacker, case when category in (3,13) then 1 else -1 end from k where upper(attacker)<>upper(victim) and category not in (20,30)) group by 1,2,3,4")
on_kept("encounter_title", lambda k: reports.fights(k).where("title is not null").select("source_id", "encounter_id", "title", "score"), sql.TITLED, "select source_id, encounter_id, title, score from t")
on_kept("success_level", lambda k: reports.fights(k).select("source_id", "encounter_id", "success"), sql.TITLED, "select source_id, encounter_id, success from fights")
on_kept("encounter_totals", lambda k: reports.fights(k).select("source_id", "encounter_id", "damage", "healed", "kills", "deaths", scalars.per_second(F.col("damage"), F.col("duration_s")).alias("enc_dps")), sql.TITLED, "select source_id, encounter_id, damage, healed, kills, deaths, damage::double/greatest(duration_s,1)::double as enc_dps from fights")
# Two places, halves to the even side, in whole numbers.
_TWO = "(case when {s}>0 then ((100*{n})//({s}) + case when 2*((100*{n})%({s}))>({s}) or (2*((100*{n})%({s}))=({s}) and ((100*{n})//({s}))%2=1) then 1 else 0 end)::double/100 else 0.0 end)"
_OWN = "coalesce(last_ts-first_ts,0)"
on_stored("dps_family", lambda k: reports.rates(combatants(k), window(k)), sql.COMBATANTS, f"select source_id, encounter_id, combatant, damage, healed, {_OWN} as personal_s, damage::double/greatest(duration_s,1)::double as enc_dps, damage::double/greatest({_OWN},1)::double as dps, healed::double/greatest(duration_s,1)::double as enc_hps, {_TWO.format(n='damage', s='duration_s')} as up_enc_dps, {_TWO.format(n='damage', s=_OWN)} as up_dps, {_TWO.format(n='healed', s='duration_s')} as up_enc_hps, {_TWO.format(n='100*hits', s='swings')} as to_hit from c join w using (source_id, encounter_id)")
_SLOTTED = ", sl as (select source_id, encounter_id, start_ts, slot_s, greatest(1,duration_s)//slot_s+1 as n from (select *, greatest(2, least(30, ceil(greatest(1,duration_s)/60.0)))::bigint as slot_s from w)), hh as (select f.source_id, f.encounter_id, {by}, (ts-start_ts)//slot_s as slot, slot_s, n, amount from f join sl using (source_id, encounter_id) where amount>0 {x}), hs as (select source_id, encounter_id, {by}, slot, sum(amount)::bigint as total from hh where slot between 0 and n-1 group by all), g as (select distinct source_id, encounter_id, {by}, slot_s, unnest(range(0, n)) as slot from hh where slot between 0 and n-1) select source_id, encounter_id, {by}, slot, coalesce(total,0)::bigint as total, coalesce(total,0)::double/slot_s::double as rate from g left join hs using (source_id, encounter_id, {by}, slot)"
_FANNED_WINDOW = sql.FANNED + sql.WINDOW[len(sql.KEPT):]


def _series(name, run, by, where):
    body = _SLOTTED.format(by=by, x=where)
    at = body.index(" select source_id, encounter_id, " + by + ", slot, coalesce")
    on_stored(name, run, _FANNED_WINDOW + body[:at], body[at:])


_series("activity_series", lambda k: stats.activity_series(stats.bucket_fanout(k).where(F.col("bucket").isin(*stats.ACTIVE)), window(k)), "combatant, bucket", "and bucket in (" + ", ".join(f"'{b}'" for b in stats.ACTIVE) + ")")
_series("heat_series", lambda k: stats.activity_series(stats.bucket_fanout(k).where("bucket = 'All Outgoing (Ref)' and ability = 'Skill 1'"), window(k), ("combatant",)), "combatant", "and bucket='All Outgoing (Ref)' and ability='Skill 1'")

# --- drills and reports -------------------------------------------------------
_ORDER = "[" + ", ".join(f"'{b}'" for b in reports.BUCKET_ORDER) + "]"
on_kept("drill_buckets", lambda k: reports.drill_buckets(stats.bucket_fanout(k)), sql.FANNED, f"select *, case when sum(total) over (partition by source_id, encounter_id, bucket)>0 then total::double/(sum(total) over (partition by source_id, encounter_id, bucket))::double else 0.0 end as share, list_position({_ORDER}, bucket)::bigint as place from (select source_id, encounter_id, combatant, bucket, any_value(direction) as direction, coalesce(sum(amount) filter (amount>0),0)::bigint as total, count(*) as swings from f group by 1,2,3,4)")
_DRILL = "count(*) filter (amount<>-10) as swings, count(*) filter (amount>=0) as hits, count(*) filter (critical and amount>=0) as crits, coalesce(max(amount) filter (amount>0),0)::bigint as max_hit, coalesce(sum(amount) filter (amount>0),0)::bigint as total"
_SHARE = "case when sum(total) over ({w})>0 then total::double/(sum(total) over ({w}))::double else 0.0 end as share"
on_stored("drill_abilities", lambda k: reports.drill_abilities(stats.bucket_fanout(k), window(k), "Outgoing Damage"), _FANNED_WINDOW + ", " + _ALL, f"select * exclude (duration_s), case when max(total) filter (ability='All') over p>0 then total::double/(max(total) filter (ability='All') over p)::double else 0.0 end as share, total::double/greatest(1,duration_s)::double as dps from (select source_id, encounter_id, combatant, ability, {_DRILL.replace('amount<>-10)', 'amount<>-10 or ability=' + chr(39) + 'Killing' + chr(39) + ')')}, coalesce(array_to_string(list_sort(list(distinct damage_type) filter (damage_type not in ('','avoided','death','none','heal'))), ','),'') as types from fa where bucket='Outgoing Damage' group by 1,2,3,4) join (select source_id, encounter_id, duration_s from w) using (source_id, encounter_id) window p as (partition by source_id, encounter_id, combatant)")
on_stored("breakdown_by_other", lambda k: reports.breakdown_by_other(stats.bucket_fanout(k), window(k), "Outgoing Damage"), _FANNED_WINDOW, f"select source_id, encounter_id, combatant, other, swings, hits, crits, max_hit, total, total::double/greatest(duration_s,1)::double as enc_dps, {_SHARE.format(w='partition by source_id, encounter_id, combatant')} from (select source_id, encounter_id, combatant, other, {_DRILL} from f where bucket='Outgoing Damage' group by 1,2,3,4) join w using (source_id, encounter_id)")
on_kept("combatant_breakdown", lambda k: reports.combatant_breakdown(stats.bucket_fanout(k)), sql.FANNED, f"select *, {_SHARE.format(w='partition by combatant')} from (select combatant, ability, sum(amount)::bigint as total, count(*) as hits from (select ability, amount, min(combatant) over (partition by upper(combatant)) as combatant from f where bucket='Outgoing Damage' and amount>0) group by 1,2)")
on_kept("auto_attack_groups", reports.auto_attack_groups, sql.KEPT, "select source_id, encounter_id, combatant, kind, count(*) as swings, count(*) filter (amount>=0) as hits, coalesce(sum(amount) filter (amount>0),0)::bigint as total from (select source_id, encounter_id, attacker as combatant, amount, unnest(['All', case when special='None' then 'Normal' else special end]) as kind from k where category=1 and ability='Auto-Attack') group by 1,2,3,4")
on_kept("drill_swings", lambda k: k.where("ability = 'Skill 2' and category = 2").select("source_id", "encounter_id", "time_sorter", "ts", "attacker", "victim", "amount", "critical"), sql.KEPT, "select source_id, encounter_id, time_sorter, ts, attacker, victim, amount, critical from k where ability='Skill 2' and category=2")
_RATE = "case when {b}>0 then {a}::double/{b}::double else 0.0 end as {n}"
on_kept("special_report", reports.special_report, sql.KEPT, f"select *, {_RATE.format(a='multi', b='swings', n='multi_rate')}, {_RATE.format(a='flurry', b='swings', n='flurry_rate')}, {_RATE.format(a='crits', b='hits', n='crit_rate')} from (select source_id, encounter_id, combatant, count(*) as swings, count(*) filter (special='None') as normal, count(*) filter (special='Multi Attack') as multi, count(*) filter (special='Flurry') as flurry, count(*) filter (special='AoE Attack') as aoe, count(*) filter (amount>=0) as hits, count(*) filter (amount>=0 and critical) as crits from (select *, unnest([attacker, 'TOTAL']) as combatant from k where category=1 and ability<>'Killing' and a_ally and not selfd) group by 1,2,3)")
on_kept("top_slices", lambda k: reports.top_slices(combatants(k), ("source_id", "encounter_id"), "combatant", "damage", 3), sql.COMBATANTS, "select source_id, encounter_id, slice, sum(damage)::bigint as damage from (select *, case when row_number() over (partition by source_id, encounter_id order by damage desc, combatant)<=3 then combatant else 'Other' end as slice from c) group by 1,2,3")
on_kept("metric_bars", lambda k: reports.metric_bars(combatants(k), "damage"), sql.COMBATANTS, "select source_id, encounter_id, combatant, damage, case when sum(damage) over p>0 then damage::double/(sum(damage) over p)::double else 0.0 end as of_total, case when max(damage) over p>0 then damage::double/(max(damage) over p)::double else 0.0 end as of_top from c window p as (partition by source_id, encounter_id)")
on_stored("mini_parse", lambda k: reports.mini_parse(combatants(k), window(k)), sql.COMBATANTS, "select source_id, encounter_id, rank, combatant, damage, damage::double/greatest(duration_s,1)::double as rate, of_top, raid_rate from (select c.*, duration_s, row_number() over (partition by source_id, encounter_id order by damage desc, combatant) as rank, damage::double/(max(damage) over (partition by source_id, encounter_id))::double as of_top, (sum(damage) over (partition by source_id, encounter_id))::double/greatest(duration_s,1)::double as raid_rate from c join w using (source_id, encounter_id) where combatant not ilike 'a mob%' and damage>0) where rank<=6")
on_kept("zone_summary", lambda k: reports.zone_summary(combatants(k)), sql.TITLED, "select source_id, encounter_id, zone, title, fights.damage, d.deaths, d.kills, fights.damage::double/greatest(1, max(fights.damage) over (partition by source_id, zone))::double as bar from fights join (select source_id, encounter_id, coalesce(sum(deaths) filter (ally),0)::bigint as deaths, coalesce(sum(deaths) filter (not ally),0)::bigint as kills from c group by 1,2) d using (source_id, encounter_id)")
on_stored("death_report", reports.death_report, sql.KEPT, "select * exclude (sq) from (select d.source_id, d.encounter_id, d.victim as combatant, d.attacker as killer, d.ts as death_ts, d.seq as death_seq, row_number() over (partition by d.source_id, d.seq order by i.ts desc, i.time_sorter desc) as back, i.attacker, i.ability, i.amount, d.ts-i.ts as before_s, i.seq as sq from k d join k i on d.source_id=i.source_id and d.encounter_id=i.encounter_id and d.victim=i.victim and i.ts<=d.ts where d.amount=-10 and d.extra is distinct from 'pet-death' and i.amount<>0 and i.amount<>-10) where back<=6")
on_stored("death_timeline", lambda k: reports.death_timeline(k, window(k)), sql.WINDOW, "select source_id, encounter_id, at_s, sum(n) over (partition by source_id, encounter_id order by at_s)::bigint as deaths from (select source_id, encounter_id, least(greatest(0, ts-start_ts), greatest(1,duration_s)) as at_s, count(*) as n from k join w using (source_id, encounter_id) where amount=-10 and extra is distinct from 'pet-death' group by 1,2,3)")
on_stored("rollup_timeline", lambda k: reports.rollup_timeline(k, reports.fights(k)), sql.TITLED, "select source_id, zone, at_s, sum(n) over (partition by source_id, zone order by at_s)::bigint as deaths from (select k.source_id, x.zone, (x.off + least(greatest(0, ts-x.start_ts), x.duration_s))::bigint as at_s, count(*) as n from k join (select *, coalesce(sum(duration_s) over (partition by source_id, zone order by start_ts, encounter_id rows between unbounded preceding and 1 preceding),0) as off from fights) x on x.source_id=k.source_id and x.encounter_id=k.encounter_id where amount=-10 and extra is distinct from 'pet-death' group by 1,2,3)")
_WARDS = ", zh as (select * from k where category in (1,2) and amount=0), ab as (select * from k where category=3), nr as (select a.source_id, a.seq as aseq, a.amount as absorbed, z.seq as hit_seq, row_number() over (partition by a.source_id, a.seq order by z.time_sorter) as r from ab a join zh z on a.source_id=z.source_id and a.encounter_id=z.encounter_id and a.victim=z.victim and z.time_sorter-a.time_sorter between 1 and 6 and abs(z.ts-a.ts)<=3), wp as (select zh.source_id, zh.encounter_id, zh.seq as hit_seq, zh.victim as combatant, coalesce(sum(absorbed),0)::bigint as absorbed, count(absorbed) as wards, case when sum(absorbed)>0 then 'warded' else 'stoneskin' end as verdict from zh left join (select * from nr where r=1) n on n.source_id=zh.source_id and n.hit_seq=zh.seq group by 1,2,3,4)"
_absorb = lambda: F.col("category") == 3  # noqa: E731  the adapter has no wards of its own: its heals stand in, within 3 seconds
on_stored("ward_pairing", lambda k: reports.ward_pairing(k, _absorb(), seconds=3), sql.KEPT + _WARDS, "select * from wp")
_CHOSEN = ", ch as (select source_id, arg_max(encounter_id, (start_ts, encounter_id)) as encounter_id from fights where title is not null group by source_id, lower(title), lower(zone)), pr as (select * from (select a.source_id, a.encounter_id as a, b.encounter_id as b, row_number() over (partition by a.source_id, a.encounter_id order by b.start_ts desc, b.encounter_id desc) as rank from fights a join ch on ch.source_id=a.source_id and ch.encounter_id=a.encounter_id join fights b on b.source_id=a.source_id and lower(b.title)=lower(a.title) and lower(b.zone)=lower(a.zone) and b.encounter_id<>a.encounter_id and 4*b.duration_s>=a.duration_s and (a.success in (0,2) or b.success in (0,2) or a.success=b.success)) where rank<=10)"
_comparable = lambda f: reports.comparable_fights(f, reports.latest_fights(f))
on_stored("comparable_fights", lambda k: _comparable(reports.fights(k)), sql.TITLED + _CHOSEN, "select * from pr")


def _compare(k):
    s = combatants(k)
    f = stats.fight_totals(s)
    return reports.compare_fights(_comparable(f).where("rank = 1"), s, f)


on_stored("compare_fights", _compare, sql.TITLED + _CHOSEN + ", sd as (select source_id, encounter_id, combatant, c.damage::double/greatest(1,duration_s)::double as dps, c.healed::double/greatest(1,duration_s)::double as hps, c.deaths from c join w using (source_id, encounter_id) where ally and (c.damage>0 or c.healed>0)), one as (select pr.source_id, a, b, combatant, dps, hps, deaths from pr join sd on sd.source_id=pr.source_id and sd.encounter_id=a where rank=1), two as (select pr.source_id, a, b, combatant, dps, hps, deaths from pr join sd on sd.source_id=pr.source_id and sd.encounter_id=b where rank=1)", "select source_id, a, b, combatant, one.dps as dps_a, two.dps as dps_b, one.hps as hps_a, two.hps as hps_b, one.deaths as deaths_a, two.deaths as deaths_b, one.dps-two.dps as delta, case when two.dps>0 then (one.dps-two.dps)/two.dps end as delta_share from one full outer join two using (source_id, a, b, combatant)")
on_kept("fights_table", reports.fights, sql.TITLED, "select * from fights")
on_kept("lookup_combatant", lambda k: (lambda s: reports.lookup_combatant(s, stats.fight_totals(s), "p1"))(combatants(k)), sql.TITLED, "select source_id, encounter_id, title, zone, start_ts, success, c.damage, c.healed, c.damage_taken, c.deaths, c.damage::double/greatest(duration_s,1)::double as enc_dps, c.healed::double/greatest(duration_s,1)::double as enc_hps from c join fights using (source_id, encounter_id) where combatant='P1' and (c.damage>0 or c.healed>0 or damage_taken>0)")
on_kept("success_ingredients", lambda k: (lambda s: reports.success_ingredients(s, stats.fight_totals(s), 20))(combatants(k)), sql.TITLED, "select source_id, encounter_id, title, duration_s, fights.damage, success, n.allies, n.deathless, coalesce(title_deaths,0) as title_deaths from fights left join (select source_id, encounter_id, title_deaths from t) using (source_id, encounter_id) join (select source_id, encounter_id, count(*) filter (ally) as allies, count(*) filter (ally and deaths=0) as deathless from c group by 1,2) n using (source_id, encounter_id) where duration_s>=20 order by fights.damage desc, source_id, encounter_id limit 8")
