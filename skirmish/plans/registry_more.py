"""Further queries: mining, correlation, archive, rules and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar, scalars
from ..operators import allies, archive, classify, correlate, mining, reports, rules, sessions, stats
from ..sources import adapter, files
from ..sources.files import shared_folder, stored
from . import sql
from .registry import _TWO, ally, enemy, kept, on_kept, on_stored, on_swings, register

# --- mining -----------------------------------------------------------------
# The adapter names every attacker, so nothing is inferred here.
_HITS = ", mh0 as (select k.* exclude (zone), fights.zone from k join fights using (source_id, encounter_id) where category in (1,2) and not a_ally and ability not in ('Killing','Auto-Attack','')), mh as (select * replace (min(attacker) over (partition by upper(attacker)) as attacker) from mh0), v1 as (select *, (lag(ts) over p is null or ts-lag(ts) over p>2)::int as nv from mh window p as (partition by source_id, encounter_id, attacker, ability order by ts, seq)), v2 as (select *, sum(nv) over (partition by source_id, encounter_id, attacker, ability order by ts, seq)::bigint as volley from v1), v3 as (select source_id, encounter_id, attacker, ability, volley, min(ts) as volley_ts, count(*) as hits, count(distinct victim) as targets, coalesce(sum(amount) filter (amount>0),0)::bigint as damage from v2 group by 1,2,3,4,5), v4 as (select *, (lag(volley_ts) over p is null or volley_ts-lag(volley_ts) over p>12)::int as nc from v3 window p as (partition by source_id, encounter_id, attacker, ability order by volley_ts)), vo as (select * exclude (nc), sum(nc) over (partition by source_id, encounter_id, attacker, ability order by volley_ts)::bigint as \"cast\" from v4), ca as (select source_id, encounter_id, attacker, ability, \"cast\", min(volley_ts) as cast_ts, count(*) as volleys, sum(hits)::bigint as hits, max(targets) as targets, sum(damage)::bigint as damage from vo group by 1,2,3,4,5)"


def mob_hits(k):
    return mining.mob_hits(k, reports.fights(k))


def casts(k):
    return mining.casts(mining.cast_volleys(mob_hits(k)))


def debuffs(k):
    return mining.debuff_windows(k.where("ability = 'Skill 1' and category = 2"))


def applies(k):
    """Statuses as given: every other blow of a mob stuns, the others daze, with
    durations."""
    given = k.where("category in (1, 2) and attacker ilike 'a mob%'")
    return given.select("source_id", "encounter_id", "victim", "seq", "ts", F.when(F.col("seq") % 2 == 0, "stunned").otherwise("dazed").alias("effect"), F.when(F.col("seq") % 4 > 0, (F.col("seq") % 9) * 10).alias("duration_s"))


def mined(k):
    return mining.mine_abilities(mob_hits(k), reports.fights(k), debuffs(k), applies(k))


_GAPS = ", gp as (select *, cast_ts-lag(cast_ts) over (partition by source_id, encounter_id, attacker, ability order by cast_ts) as gap from ca), iv as (select attacker, ability, count(*) as gaps, list_sort(list(gap))[count(*)//2+1] as median_s, min(gap) as least_s from gp where gap is not null group by 1,2)"
_DEBUFF = ", to1 as (select *, max(ts+30) over (partition by source_id, encounter_id, victim order by ts, seq rows between unbounded preceding and 1 preceding) as reach from k where ability='Skill 1' and category=2), to2 as (select *, sum((reach is null or ts>reach)::int) over (partition by source_id, encounter_id, victim order by ts, seq)::bigint as run from to1), dw as (select source_id, encounter_id, victim, run, min(ts) as from_ts, max(ts)+30 as to_ts, 0.5::double as fraction from to2 group by 1,2,3,4)"
_COVER = ", gg as (select source_id, encounter_id, attacker, ability, lag(cast_ts) over (partition by source_id, encounter_id, attacker, ability order by cast_ts) as prev_ts, cast_ts from ca), cv as (select gg.source_id, gg.encounter_id, attacker, ability, prev_ts, cast_ts, cast_ts-prev_ts as gap, coalesce(sum(least(cast_ts,to_ts)-greatest(prev_ts,from_ts)) filter (from_ts is not null),0)::bigint as covered_s from gg left join dw on dw.source_id=gg.source_id and dw.encounter_id=gg.encounter_id and upper(dw.victim)=upper(gg.attacker) and from_ts<cast_ts and to_ts>prev_ts where prev_ts is not null group by 1,2,3,4,5,6), cb as (select *, (gap-covered_s)::double+covered_s::double/1.5::double as base_s from cv)"
_EFFECT = ", ap as (select source_id, encounter_id, victim, seq as aseq, ts as ats, case when seq%2=0 then 'stunned' else 'dazed' end as effect, case when seq%4>0 then (seq%9)*10 end as duration_s from k where category in (1,2) and not a_ally), att as (select zone, attacker, ability, effect, duration_s from (select mh.zone, mh.attacker, mh.ability, effect, duration_s, row_number() over (partition by mh.source_id, mh.seq order by aseq) as r from mh join ap on ap.source_id=mh.source_id and ap.encounter_id=mh.encounter_id and ap.victim=mh.victim and ats-ts between 0 and 2) where r=1), ec as (select zone, attacker, ability, effect, count(*) as n from att group by 1,2,3,4), cz as (select zone, attacker, ability, count(*) as casts from ca join fights using (source_id, encounter_id) group by 1,2,3), de as (select zone, attacker, ability, effect, effect_s from (select ec.*, row_number() over (partition by zone, attacker, ability order by n desc, effect) as r from ec) join cz using (zone, attacker, ability) left join (select zone, attacker, ability, effect, list_sort(list(duration_s))[count(*)//2+1] as effect_s from att where duration_s>0 and duration_s<120 group by 1,2,3,4) using (zone, attacker, ability, effect) where r=1 and n>=greatest(2, casts//4))"
_MINED = _DEBUFF + _COVER + _EFFECT + """, sm as (select zone, attacker, ability, count(distinct (source_id, encounter_id)) as fights, count(*) as casts, sum(volleys)::bigint as volleys, sum(hits)::bigint as hits, sum(ca.damage)::bigint as damage from ca join fights using (source_id, encounter_id) group by 1,2,3),
hz as (select zone, attacker, ability, count(*) as n, count(*) filter (amount<=0) as zero, bool_and(category=1) as melee from mh group by 1,2,3),
iz as (select zone, attacker, ability, list_sort(list(gap))[count(*)//2+1] as median_s, min(gap) as least_s, list_sort(list(base_s))[count(*)//2+1] as base_s, sum(covered_s)::double/sum(gap)::double as coverage from cb join fights using (source_id, encounter_id) group by 1,2,3),
ty as (select zone, attacker, ability, string_agg(t, ', ' order by n desc, t) as types from (select *, sum(n) over (partition by zone, attacker, ability) as alln from (select zone, attacker, ability, lower(damage_type) as t, count(*) as n from mh where amount>0 and damage_type not in ('','none','avoided') group by 1,2,3,4)) where 10*n>=alln group by 1,2,3),
mi as (select sm.*, median_s, least_s, base_s, coalesce(coverage,0.0) as coverage, hits::double/volleys::double as avg_targets, volleys::double/sm.casts::double as ticks, melee, 10*zero>=9*n as detriment, false as inferred, coalesce(types,'') as types, effect, effect_s from sm join hz using (zone, attacker, ability) left join iz using (zone, attacker, ability) left join ty using (zone, attacker, ability) left join de using (zone, attacker, ability))"""
on_stored("cast_volleys", lambda k: mining.cast_volleys(mob_hits(k)), sql.TITLED + _HITS, "select * from vo")
on_stored("cast_intervals", lambda k: mining.cast_intervals(casts(k)), sql.TITLED + _HITS + _GAPS, "select * from iv")
on_kept("debuff_windows", debuffs, sql.KEPT + _DEBUFF, "select * from dw")
on_stored("debuff_coverage", lambda k: mining.covered_intervals(casts(k), debuffs(k)), sql.TITLED + _HITS + _DEBUFF + _COVER, "select * from cb")
on_stored("dominant_effect", lambda k: (lambda h, z: mining.dominant_effect(mining.status_attributions(h, applies(k)).join(z, ["source_id", "encounter_id"]), mining.casts(mining.cast_volleys(h)).join(z, ["source_id", "encounter_id"]).groupBy("zone", "attacker", "ability").agg(F.count("*").alias("casts"))))(mob_hits(k), reports.fights(k).select("source_id", "encounter_id", "zone")), sql.TITLED + _HITS + _EFFECT, "select * from de")
on_stored("mine_abilities", mined, sql.TITLED + _HITS + _MINED, "select * from mi")
on_stored("mined_top", lambda k: mining.mined_top(mined(k), 3).select("zone", "attacker", "ability", "detriment", "rank", "casts", "damage"), sql.TITLED + _HITS + _MINED, "select * from (select zone, attacker, ability, detriment, row_number() over (partition by zone, attacker, detriment order by case when detriment then casts else damage end desc, ability) as rank, casts, damage from mi) where rank<=3")
on_stored("mined_to_timers", lambda k: mining.mined_to_timers(mined(k)), sql.TITLED + _HITS + _MINED, "select ability as name, attacker as category, zone, greatest(5, d) as duration_s, least(10, greatest(3, d//4)) as warning_s, not inferred as restrict_category, true as only_master, types as damage_type from (select *, case when coalesce(base_s, median_s, 30)-floor(coalesce(base_s, median_s, 30))=0.5 then 2*round(coalesce(base_s, median_s, 30)/2) else round(coalesce(base_s, median_s, 30)) end::bigint as d from mi)")
#: Invented: which classes know the adapter's abilities.
CLASS_MAP = (("Skill 0", ["Wizard"]), ("Skill 1", ["Wizard", "Warlock"]), ("Skill 2", ["Templar"]), ("Skill 3", ["Templar", "Warden"]), ("Skill 4", ["Guardian"]), ("Skill 5", ["Guardian", "Wizard"]))
_CLASSES = """, cm(ability, class) as (values ('Skill 0','Wizard'),('Skill 1','Wizard'),('Skill 1','Warlock'),('Skill 2','Templar'),('Skill 3','Templar'),('Skill 3','Warden'),('Skill 4','Guardian'),('Skill 5','Guardian'),('Skill 5','Wizard')),
us as (select distinct source_id, encounter_id, attacker as combatant, ability from k where not selfd and ability not in ('Auto-Attack','Killing')), vt as (select us.*, class from us join cm using (ability)),
vc as (select source_id, encounter_id, combatant, class, count(*) as votes, row_number() over (partition by source_id, encounter_id, combatant order by count(*) desc, class) as r from vt group by 1,2,3,4),
dt as (select source_id, encounter_id, combatant, case when votes>=2 then class end as class, votes, mapped from vc join (select source_id, encounter_id, combatant, count(distinct ability) as mapped from vt group by 1,2,3) using (source_id, encounter_id, combatant) where r=1)"""


def class_map(spark):
    """(layer, ability, classes), the ability normalised."""
    return files.class_map_rows(spark.createDataFrame([(dict(CLASS_MAP), {})], "spells map<string,array<string>>, effects map<string,array<string>>")).withColumn("ability", scalars.normalize_ability(F.col("ability")))


def detected(spark, k):
    return classify.detect_classes(k, class_map(spark))


register("class_votes", lambda spark, d: detected(spark, kept(spark, d)).select("*", (F.col("votes").cast("double") / F.col("mapped").cast("double")).alias("confidence")), sql.KEPT + _CLASSES, "select *, votes::double/mapped::double as confidence from dt")


def _by_archetype(spark, d):
    k = stored(kept(spark, d))
    return reports.share_by_archetype(stats.combatant_stats(k).select("source_id", "encounter_id", "combatant", F.col("damage").alias("total")), detected(spark, k).select("source_id", "encounter_id", "combatant", "class"))


_ARCHETYPE = "case class when 'Wizard' then 'Mage' when 'Warlock' then 'Mage' when 'Templar' then 'Priest' when 'Warden' then 'Priest' when 'Guardian' then 'Fighter' end"
register("share_by_archetype", _by_archetype, sql.COMBATANTS + _CLASSES, f"select *, case when sum(total) over (partition by source_id, encounter_id)>0 then total::double/(sum(total) over (partition by source_id, encounter_id))::double else 0.0 end as share from (select source_id, encounter_id, coalesce({_ARCHETYPE}, 'Other') as archetype, sum(damage)::bigint as total from c left join (select source_id, encounter_id, combatant, class from dt) using (source_id, encounter_id, combatant) group by 1,2,3)")

# --- allies (order-exact walk: no SQL) and what builds on it ------------------
on_stored("resolve_allies", lambda k: allies.resolve_allies(k, stats.ally_edges(k)), None, None)


on_stored("walked_fights", lambda k: reports.fights(allies.mark(k.drop("a_ally", "v_ally"), allies.resolve_allies(k, stats.ally_edges(k)))), None, None)


# --- the same fights seen by two logs ------------------------------------------
def mirrored(spark, sf_dir):
    """The adapter's logs and a second log of each, with gaps, a second late."""
    s = adapter.swings(spark, sf_dir)
    copy = s.where("seq % 7 <> 0").withColumns({"source_id": F.concat("source_id", F.lit("-m")), "owner": F.concat(F.lit("P"), ((F.col("seq") % 3 + 1) % 8).cast("string")), "ts": F.col("ts") + 1})
    return stored(allies.mark_by(sessions.segment(s.unionByName(copy)), ally))


def seen(k):
    return correlate.witnesses(k, reports.fights(k))


_S2 = "s2 as (select * from s union all select source_id || '-m', 'P' || ((seq%3+1)%8), zone, seq, ts+1, category, critical, special, attacker, ability, amount, victim, damage_type, extra, amount_text from s where seq%7<>0)"
_MIRROR = sql.TITLED.replace("h0 as (select *, (category", _S2 + ",\nh0 as (select *, (category").replace("as hostile from s)", "as hostile from s2)")
register("correlate_pairs", lambda spark, d: correlate.correlate_pairs(seen(mirrored(spark, d))), _MIRROR + ", ow as (select distinct owner from s2), wn as (select distinct source_id, encounter_id, upper(name) as name from nm where upper(name) not in (select upper(owner) from ow))", "select distinct x.source_id as source_a, x.encounter_id as a, y.source_id as source_b, y.encounter_id as b from fights x join fights y on lower(x.zone)=lower(y.zone) and x.source_id<y.source_id and x.end_ts>=y.start_ts-30 and y.end_ts>=x.start_ts-30 where exists (select 1 from wn p join wn q on p.name=q.name where p.source_id=x.source_id and p.encounter_id=x.encounter_id and q.source_id=y.source_id and q.encounter_id=y.encounter_id)")
register("correlate_fights", lambda spark, d: correlate.correlate_fights(seen(mirrored(spark, d))))


def paired(k):
    """Members as given: a fight and the one of the second log that starts with it."""
    log = F.regexp_replace("source_id", "-m$", "")
    return reports.fights(k).select("source_id", "encounter_id", F.concat(log, F.lit("/"), F.expr("encounter_id div 100").cast("string")).alias("fight_id"))


_PAIRED = ", mb as (select source_id, encounter_id, regexp_replace(source_id, '-m$', '') || '/' || (encounter_id//100) as fight_id from fights), mc as (select * exclude (r) from (select fight_id, combatant, source_id as from_source, damage, healed, damage_taken, row_number() over (partition by fight_id, upper(combatant) order by (combatant=owner)::int desc, case when combatant=owner then 0 else -observed end, source_id, encounter_id) as r from c join mb using (source_id, encounter_id) join (select distinct source_id, owner from k) using (source_id)) where r=1)"
_LONGEST = ", pm as (select * from (select fight_id, source_id, encounter_id, title, zone, success, row_number() over (partition by fight_id order by duration_s desc, end_ts, source_id desc, encounter_id desc) as r from fights join mb using (source_id, encounter_id)) where r=1)"


def _merge_combatants(k):
    return correlate.merge_combatants(paired(k), stats.combatant_stats(k), k.select("source_id", "owner").distinct())


def _given_allies(k):
    return stats.combatant_stats(k).where("ally").select("source_id", "encounter_id", F.upper("combatant").alias("ally"))


def _merged_fight(k):
    scripted = reports.fights(k).where("encounter_id % 5 = 0").select("source_id", "encounter_id")
    known = reports.fights(k).withColumn("instance_expiry", F.when(F.col("encounter_id") % 3 == 0, F.col("start_ts") + 1000))
    return correlate.merged_fight(paired(k), known, _merge_combatants(k), allies.merged_ally_keys(_given_allies(k), paired(k)), scripted)


def on_mirror(name, run, prefix, body):
    register(name, lambda spark, d: run(mirrored(spark, d)), prefix, body)


on_mirror("merge_combatants", _merge_combatants, _MIRROR + _PAIRED, "select * from mc")
on_mirror("merged_fight", _merged_fight, _MIRROR + _PAIRED + _LONGEST, "select fight_id, pm.source_id as primary_source, pm.encounter_id as primary_encounter, pm.title, pm.zone, g.start_ts, g.end_ts, logs, case when won then 1 else pm.success end as success, g.instance_expiry, coalesce(dm.damage,0)::bigint as damage from pm join (select fight_id, min(start_ts) as start_ts, max(end_ts) as end_ts, count(*) as logs, bool_or(encounter_id%5=0) as won, arg_min(start_ts+1000, (end_ts, source_id)) filter (encounter_id%3=0) as instance_expiry from fights join mb using (source_id, encounter_id) group by 1) g using (fight_id) left join (select fight_id, sum(damage)::bigint as damage from mc where combatant not ilike 'a mob%' group by 1) dm using (fight_id)")
on_mirror("merged_ally_keys", lambda k: allies.merged_ally_keys(_given_allies(k), paired(k)), _MIRROR + _PAIRED, "select distinct fight_id, upper(combatant) as ally from c join mb using (source_id, encounter_id) where ally")
on_mirror("collapse_mirrors", lambda k: archive.collapse_mirrors(reports.fights(k), correlate.merged_fight(paired(k), reports.fights(k))).select("source_id", "encounter_id", "title", "duration_s"), _MIRROR + _PAIRED + _LONGEST, "select source_id, encounter_id, title, duration_s from fights where (source_id, encounter_id) in (select (source_id, encounter_id) from pm)")


# --- archive ------------------------------------------------------------------
def archived(k):
    return reports.fights(k)


def new_archive(spark):
    import uuid

    return f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"


def _round_trip(spark, d):
    """Two writes: some fights first, short of a swing, then all of them."""
    k, path = stored(kept(spark, d)), new_archive(spark)
    early = k.where("encounter_id % 3 = 0 and time_sorter > 1")
    archive.write_archive(path, archived(early), stats.combatant_stats(early).drop("opening"), early)
    archive.write_archive(path, archived(k), stats.combatant_stats(k).drop("opening"), k)
    return archive.read_archive(spark, path)


def _restored(spark, d):
    """Fights from archived swings alone; the archived wins stay wins."""
    encounters, _, swings = _round_trip(spark, d)
    held = encounters.withColumn("success", F.when(F.col("encounter_id") % 4 == 0, 1).otherwise(F.col("success")))
    zoned = allies.mark_by(swings.drop("a_ally", "v_ally"), ally)
    return stats.with_scripted_wins(reports.fights(zoned), held.where("success = 1"))


register("write_archive", lambda spark, d: _round_trip(spark, d)[0].select("source_id", "encounter_id", "zone", "title", "damage", "success", "n_swings"), sql.TITLED, "select source_id, encounter_id, zone, title, damage, success, n_swings from fights join (select source_id, encounter_id, count(*) as n_swings from k group by 1,2) using (source_id, encounter_id)")
register("load_swings", lambda spark, d: _round_trip(spark, d)[2].select("source_id", "encounter_id", "time_sorter", "attacker", "victim", "amount"), sql.KEPT, "select source_id, encounter_id, time_sorter, attacker, victim, amount from k")
register("load_combatants", lambda spark, d: _round_trip(spark, d)[1].select("source_id", "encounter_id", "combatant", "damage", "damage_taken"), sql.COMBATANTS, "select source_id, encounter_id, combatant, damage, damage_taken from c")
register("restore_encounter", _restored, sql.TITLED, "select * replace (case when encounter_id%4=0 then 1 else success end as success) from fights")
on_stored("unique_swings", lambda k: k.where(~scalars.is_self_damage()).select("source_id", "encounter_id", "seq").union(k.where(scalars.is_self_damage()).select("source_id", "encounter_id", "seq")).groupBy("source_id", "encounter_id").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("unique_n")), sql.KEPT, "select source_id, encounter_id, count(*) as n, count(distinct seq) as unique_n from k group by 1,2")


def versions(k, copies=1):
    """Archive rows with ids; every third fight was archived twice."""
    counts = k.groupBy("source_id", "encounter_id").agg(F.count("*").alias("n_swings"), F.first("owner").alias("owner"))
    f = archived(k).join(counts, ["source_id", "encounter_id"]).select(F.col("encounter_id").alias("id"), "source_id", "owner", "start_ts", "end_ts", "title", "zone", "n_swings")
    again = f.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("n_swings", F.col("n_swings") + F.col("id") % 2)
    return f, again


_VERSIONS = sql.TITLED + ", f1 as (select encounter_id as id, source_id, owner, start_ts, end_ts, title, zone, n_swings from fights join (select source_id, encounter_id, count(*) as n_swings, any_value(owner) as owner from k group by 1,2) using (source_id, encounter_id)), f2 as (select id+1000000 as id, source_id, owner, start_ts, end_ts, title, zone, n_swings+(id+1000000)%2 as n_swings from f1 where id%3=0)"
on_stored("dedupe_encounters", lambda k: archive.dedupe_encounters(versions(k)[0].unionByName(versions(k)[1])), _VERSIONS, "select id, source_id, owner, start_ts, end_ts, title, zone, n_swings from f1 qualify row_number() over (partition by source_id, owner, start_ts, end_ts, title order by id)=1")
on_stored("upsert_encounter", lambda k: archive.upsert_encounters(*versions(k)).select("id", "source_id", "n_swings"), _VERSIONS, "select coalesce(case when f2.n_swings>f1.n_swings then f2.id end, f1.id) as id, f1.source_id, greatest(f1.n_swings, coalesce(f2.n_swings,0)) as n_swings from f1 left join f2 on f2.id=f1.id+1000000")
on_kept("prune_trash", lambda k: archive.prune_trash(archived(k), 1_700_000_400).select("source_id", "encounter_id", "title"), sql.TITLED, "select source_id, encounter_id, title from fights where coalesce(length(title)>0 and not starts_with(lower(title),'a ') and not starts_with(lower(title),'an '), false) or start_ts>=1700000400")
on_stored("delete_encounter", lambda k: archive.delete_encounters(stats.combatant_stats(k), archived(k).where("zone = 'Zone 0'")).select("source_id", "encounter_id", "combatant"), sql.TITLED, "select source_id, encounter_id, combatant from c join fights using (source_id, encounter_id) where zone<>'Zone 0'")
on_kept("archived_zones", lambda k: archive.archived_zones(archived(k).withColumn("title", F.concat(F.lit("Lord "), "title"))), sql.TITLED, "select distinct zone from fights where title is not null")
on_kept("search_archive", lambda k: archive.search_archive(archived(k), text="MOB 1", zone="Zone 1", since=1_700_000_300, limit=20).select("source_id", "encounter_id", "title", "start_ts"), sql.TITLED, "select source_id, encounter_id, title, start_ts from fights where (contains(lower(title),'mob 1') or contains(lower(zone),'mob 1')) and zone='Zone 1' and start_ts>=1700000300 order by start_ts desc, source_id, encounter_id limit 20")
on_kept("recent_restore", lambda k: archive.recent_restore(archived(k).where("title is not null"), 1_700_000_000, 1_700_000_200).select("source_id", "encounter_id"), sql.TITLED, "select source_id, encounter_id from fights where title is not null and start_ts>=1700000200 order by start_ts desc, source_id, encounter_id limit 150")
on_stored("mining_feed", lambda k: k.join(archived(k).where("zone = 'Zone 2' and title is not null").select("source_id", "encounter_id", "title"), ["source_id", "encounter_id"]).groupBy("source_id", "encounter_id", "title").agg(F.count("*").alias("n_swings"), F.array_join(F.array_sort(F.collect_set(F.when(enemy(F.col("attacker")), F.col("attacker")))), ",").alias("enemies")), sql.TITLED, "select source_id, encounter_id, title, count(*) as n_swings, coalesce(array_to_string(list_sort(list(distinct attacker) filter (not a_ally)), ','),'') as enemies from k join fights using (source_id, encounter_id) where fights.zone='Zone 2' and title is not null group by 1,2,3")


def documents(k):
    s = stats.combatant_stats(k)
    return archive.payloads(k, stats.bucket_fanout(k), stats.fight_totals(s), s, "server")


def _written(spark, d):
    """Written twice, the second time to no effect, and read back."""
    docs, path = stored(documents(stored(kept(spark, d)))), new_archive(spark)
    for _ in range(2):
        archive.write_payloads(docs, path)
    return spark.read.schema(docs.drop("source_id", "encounter_id").schema).json(path)


_HEAD = ", hd as (select fights.*, owner, left(sha256(concat_ws('|', owner, zone, title, start_ts, n_combatants)), 8) as encid from fights join (select source_id, encounter_id, any_value(owner) as owner from k group by 1,2) using (source_id, encounter_id) where title is not null)"
_UTC = "strftime(make_timestamp(({t})*1000000), '%Y-%m-%dT%H:%M:%SZ')"
_FIG = "coalesce(sum(amount) filter (amount>0),0)::bigint as damage, coalesce(list_sort(list(amount) filter (amount>=0))[count(*) filter (amount>=0)//2+1],0)::bigint as median, coalesce(min(amount) filter (amount>=0),0)::bigint as minhit, coalesce(max(amount) filter (amount>0),0)::bigint as maxhit, count(*) filter (amount>=0) as hits, count(*) filter (critical and amount>=0) as crithits, count(*) filter (amount<-1 and amount<>-10) as blocked, count(*) filter (amount=-1) as misses"
_PAYLOAD = sql.TITLED + sql.FANNED[len(sql.KEPT):] + _HEAD
register("write_payload", lambda spark, d: _written(spark, d).select("logger_name", "logger_server", "encounter.*", F.size("combatants").alias("n_combatants"), F.size("damage_types").alias("n_damage_types"), F.size("attack_types").alias("n_attack_types")), _PAYLOAD, f"select owner as logger_name, 'server' as logger_server, encid, title, zone, {_UTC.format(t='start_ts')} as starttime, {_UTC.format(t='end_ts')} as endtime, duration_s as duration, damage, case when duration_s>0 then damage::double/duration_s::double else 0.0 end as encdps, kills, deaths, success, n_combatants::int as n_combatants, (select count(distinct (combatant, bucket)) from f where f.source_id=hd.source_id and f.encounter_id=hd.encounter_id and direction='out' and bucket<>'All Outgoing (Ref)')::int as n_damage_types, (select count(distinct (combatant, ability)) from f where f.source_id=hd.source_id and f.encounter_id=hd.encounter_id and bucket='All Outgoing (Ref)')::int as n_attack_types from hd")
_OWN = "coalesce(last_ts-first_ts,0)"
on_stored("payload_combatants", lambda k: documents(k).select("encounter.encid", F.posexplode("combatants").alias("place", "c")).select("encid", F.col("place").cast("long").alias("place"), "c.*"), _PAYLOAD, f"select encid, row_number() over (partition by c.source_id, c.encounter_id order by c.damage desc, first_seen)-1 as place, combatant as name, case when ally then 'T' else 'F' end as ally, {_UTC.format(t='coalesce(first_ts,start_ts)')} as starttime, {_UTC.format(t='coalesce(last_ts,first_ts,start_ts)')} as endtime, {_OWN} as duration, c.damage, c.kills, c.healed, crit_heals as critheals, heals, cures as curedispels, drained as powerdrain, replenished as powerreplenish, {_TWO.format(n='c.damage', s=_OWN)} as dps, {_TWO.format(n='c.damage', s='duration_s')} as encdps, {_TWO.format(n='c.healed', s='duration_s')} as enchps, hits, crits as crithits, avoids as blocked, misses, swings, heals_taken as healstaken, damage_taken as damagetaken, c.deaths, {_TWO.format(n='100*hits', s='swings')} as tohit from c join hd on hd.source_id=c.source_id and hd.encounter_id=c.encounter_id")
on_stored("payload_damage_types", lambda k: documents(k).select("encounter.encid", F.explode("damage_types").alias("c")).select("encid", "c.*"), _PAYLOAD, f"select encid, combatant, type, {_UTC.format(t='first_ts')} as starttime, {_UTC.format(t='last_ts')} as endtime, x.damage, {_TWO.format(n='x.damage', s='duration_s')} as encdps, median, minhit, maxhit, hits, crithits, blocked, misses, swings from (select source_id, encounter_id, combatant, bucket as type, min(ts) as first_ts, max(ts) as last_ts, {_FIG}, count(*) filter (amount<>-10) as swings from f where direction='out' and bucket<>'All Outgoing (Ref)' group by 1,2,3,4) x join hd using (source_id, encounter_id)")
on_stored("payload_attack_types", lambda k: documents(k).select("encounter.encid", F.explode("attack_types").alias("c")).select("encid", "c.*"), _PAYLOAD, f"select encid, attacker, type, swingtype, x.damage, {_TWO.format(n='x.damage', s='duration_s')} as encdps, median, minhit, maxhit, hits, crithits, blocked, misses, swings from (select source_id, encounter_id, combatant as attacker, ability as type, arg_min(category, seq) as swingtype, {_FIG}, count(*) filter (amount<>-10 or ability='Killing') as swings from f where bucket='All Outgoing (Ref)' group by 1,2,3,4) x join hd using (source_id, encounter_id)")

# --- rules ----------------------------------------------------------------------
RULES = (
    ("big hit", r"^(?<attacker>.+?)(?:'s .+?)? (?:hits|multi attacks|flurries|aoe attacks) (?<victim>.+?) for (a critical of )?\d{5,} \w+ damage", " damage.", None, True, 3, "$1${victim} by ${attacker}", 5.0),
    ("block", "but .*blocks", "blocks", "zone 1", True, 1, "", 20.0),
    ("mine", r"^(?<YOU>\w+)'s Skill 2 heals ", " heals ", None, True, 0, "", 1.0),
    ("off", ".*", None, None, False, 1, "", 1.0),
)
_RULE = "rule string, regex string, literal string, zone string, enabled boolean, sound_type int, sound_data string, cooldown_s double"


def rule_table(spark):
    return spark.createDataFrame(list(RULES), _RULE)


def rule_lines(spark, d):
    lines = grammar.parse_header(adapter.lines(spark, d)).select("source_id", "seq", "ts", "message")
    return lines.join(adapter.swings(spark, d).select("source_id", "seq", "zone", "owner"), ["source_id", "seq"])


def _matches(spark, d):
    return rules.match_rules(rule_lines(spark, d), rule_table(spark))


_MATCH = ", ma as (select source_id, seq, ts, 'big hit' as rule, attacker, victim, case when critical then 'a critical of ' else '' end || victim || ' by ' || attacker as text, 5 as cd from s where category in (1,2) and amount>=10000 union all select source_id, seq, ts, 'block', 'None', 'None', null, 20 from s where amount=-5 and zone='Zone 1' union all select source_id, seq, ts, 'mine', 'None', 'None', null, 1 from s where category=3 and ability='Skill 2' and attacker=owner)"
register("match_rules", lambda spark, d: _matches(spark, d).select("source_id", "seq", "rule", "attacker", "victim", "text"), sql.SWINGS + _MATCH, "select source_id, seq, rule, attacker, victim, text from ma")
# The next match that may fire is the first at least a cooldown later.
_FIRES = ", nx as (select a.*, (select min(b.seq) from ma b where b.source_id=a.source_id and b.rule=a.rule and b.seq>a.seq and b.ts>=a.ts+a.cd) as nseq from ma a), fi(source_id, rule, seq, nseq) as (select source_id, rule, seq, nseq from nx where seq=(select min(seq) from ma b where b.source_id=nx.source_id and b.rule=nx.rule) union all select nx.source_id, nx.rule, nx.seq, nx.nseq from fi join nx on nx.source_id=fi.source_id and nx.rule=fi.rule and nx.seq=fi.nseq)"
register("rate_limit", lambda spark, d: rules.rate_limit(_matches(spark, d)).select("source_id", "seq", "rule", "fires"), sql.SWINGS + _MATCH + _FIRES, "select source_id, seq, rule, (source_id, rule, seq) in (select (source_id, rule, seq) from fi) as fires from ma")


def _said(spark, d):
    """Matches of several logs with texts that recur."""
    return rules.rate_limit(_matches(spark, d)).where("fires").withColumn("message", F.concat(F.lit("says "), (F.col("seq") % 2).cast("string")))


_SAID = ", sa as (select source_id, seq, ts, rule, 'says ' || (seq%2) as message from ma where (source_id, rule, seq) in (select (source_id, rule, seq) from fi)), so as (select *, row_number() over (partition by rule, message order by ts, source_id, seq) as n from sa), sn as (select a.*, (select min(b.n) from so b where b.rule=a.rule and b.message=a.message and b.n>a.n and b.ts>=a.ts+2) as nn from so a), sf(rule, message, n, nn) as (select rule, message, n, nn from sn where n=1 union all select sn.rule, sn.message, sn.n, sn.nn from sf join sn on sn.rule=sf.rule and sn.message=sf.message and sn.n=sf.nn)"
register("cross_source_dedupe", lambda spark, d: rules.cross_source_dedupe(_said(spark, d)), sql.SWINGS + _MATCH + _FIRES + _SAID, "select source_id, seq, ts, rule, message from so where (rule, message, n) in (select (rule, message, n) from sf)")


def blows(k):
    """Blows of mobs on players as the statuses that they bring."""
    return k.where("category in (1, 2) and attacker ilike 'a mob%' and amount >= 0").withColumn("ability", F.when(F.col("seq") % 2 == 0, "stunned").otherwise("stupified"))


def statuses(k):
    """Blows as applies, heals as releases, by name or of any kind."""
    heals = k.where("category = 3").withColumn("ability", F.when(F.col("seq") % 2 == 0, "any").otherwise("stunned"))
    return blows(k).withColumn("damage_type", F.lit("applied")).unionByName(heals.withColumn("damage_type", F.lit("released")))


on_swings("status_callouts", lambda s: rules.status_callouts(blows(s)), None)
on_kept("ability_frequency", lambda k: rules.ability_frequency(k.where("category in (1, 2) and ability <> 'Killing'")), None, None)
on_stored("status_pairing", lambda k: rules.status_pairing(statuses(k)), None, None)
_TIMERS = (("Skill 1", "a mob 0| a mob 1", "Zone 1", 20), ("Skill 2", "a mob 1", "zone 2", 40))
register("missing_timers", lambda spark, d: rules.missing_timers(mined(stored(kept(spark, d))).select("zone", "attacker", "ability", "casts"), spark.createDataFrame(list(_TIMERS), "name string, category string, zone string, duration_s int")), sql.TITLED + _HITS + _MINED, "select zone, attacker, ability, casts from mi where not (ability='Skill 1' and zone='Zone 1' or (ability='Skill 2' and lower(attacker)='a mob 1' and zone='Zone 2'))")
