"""Queries on where damage comes from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, reports, stats
from ..sources.files import stored
from . import sql
from .registry import _WARDS, _absorb, combatants, kept, on_kept, register, window
from .registry_more import _CLASSES, class_map, detected

# Invented dimensions for the adapter's abilities, in both notations.
OVERRIDES = (("skill 4", 1, ["Templar"], "item", None, None), ("skill 5", 1, ["Wizard"], None, True, ["Guardian", "Templar"]))
_OVER = "ability string, rank int, classes array<string>, source string, pet boolean, granted_by array<string>"
#: Blows of an impossible school that make padding; the adapter's fights are short.
PADDED = 2
_TAG = _CLASSES + """, bc as (select source_id, encounter_id, combatant, class from dt where class is not null),
us2 as (select source_id, encounter_id, attacker as combatant, ability, sum(amount)::bigint as damage from k where category in (1,2) and amount>0 group by 1,2,3,4),
tg as (select us2.*, class, case when ability='Skill 4' and class='Templar' then 'item' when ability='Skill 5' and class is not null then 'pet' when ability='Auto-Attack' then 'system'
 when ability not in (select ability from cm) then 'item' when exists (select 1 from cm where cm.ability=us2.ability and cm.class=bc.class) then 'class' else 'raid' end as source from us2 left join bc using (source_id, encounter_id, combatant)),
gr(ability, class) as (values ('Skill 0','wizard'),('Skill 1','wizard'),('Skill 1','warlock'),('Skill 2','templar'),('Skill 3','templar'),('Skill 3','warden'),('Skill 4','guardian'),('Skill 5','guardian'),('Skill 5','templar')),
pd as (select source_id, encounter_id, combatant, sum(damage)::bigint as damage from (select source_id, encounter_id, attacker as combatant, lower(damage_type) as school, sum(amount)::bigint as damage, count(*) as hits from k where category=1 and ability='Auto-Attack' and amount>0 group by 1,2,3,4) join bc using (source_id, encounter_id, combatant) where hits>=2 and (school='slashing' and class in ('Wizard','Warlock','Templar') or school='piercing' and class='Templar') group by 1,2,3)"""


def dims(spark):
    maps = class_map(spark)
    return maps, spark.createDataFrame(list(OVERRIDES), _OVER), spark.createDataFrame([("auto-attack",)], "ability string")


def classes_of(spark, k):
    return detected(spark, k).where("class is not null").select("source_id", "encounter_id", "combatant", "class")


def sourced(spark, k):
    maps, over, system = dims(spark)
    used = k.where("category in (1, 2) and amount > 0").groupBy("source_id", "encounter_id", F.col("attacker").alias("combatant"), "ability").agg(F.sum("amount").cast("long").alias("damage"))
    return classify.classify_source(used.join(classes_of(spark, k), ["source_id", "encounter_id", "combatant"], "left"), maps, over, system)


def tagged(spark, sf_dir):
    return sourced(spark, stored(kept(spark, sf_dir)))


def padded(spark, k):
    return classify.padded_attacks(k, classes_of(spark, k), PADDED)


def on_sources(name, run, body, prefix=None):
    register(name, lambda spark, d: run(spark, stored(kept(spark, d))), prefix or sql.KEPT + _TAG, body)


register("classify_source", lambda spark, d: tagged(spark, d).select("source_id", "encounter_id", "combatant", "ability", "damage", "source"), sql.KEPT + _TAG, "select source_id, encounter_id, combatant, ability, damage, source from tg")
on_sources("sources_report", lambda spark, k: classify.sources_report(sourced(spark, k), padded(spark, k)), "select source_id, encounter_id, combatant, " + ", ".join(f"coalesce(sum(damage) filter (source='{s}'),0)::bigint as \"{s}\"" for s in ("class", "raid", "item", "pet", "system")) + ", sum(damage)::bigint as total, max(class) is null as undetected from (select source_id, encounter_id, combatant, class, source, damage from tg union all select source_id, encounter_id, combatant, null, unnest(['system','pet']), unnest([-damage, damage]) from pd) group by 1,2,3")
register("top_sources", lambda spark, d: classify.top_sources(tagged(spark, d), 2), sql.KEPT + _TAG, "select * from (select source_id, encounter_id, source, ability, sum(damage)::bigint as damage, row_number() over (partition by source_id, encounter_id, source order by sum(damage) desc, ability) as rank from tg group by 1,2,3,4) where rank<=2")
register("combatant_sources", lambda spark, d: classify.combatant_sources(tagged(spark, d)), sql.KEPT + _TAG, "select combatant, source, ability, damage, damage::double/(sum(damage) filter (ability='All') over (partition by combatant))::double as share from (select combatant, source, coalesce(ability,'All') as ability, sum(damage)::bigint as damage from tg group by grouping sets ((combatant, source, ability),(combatant, source)))")


def _credit(spark, k):
    maps, over, _ = dims(spark)
    raid = sourced(spark, k).where("source = 'raid'").groupBy("source_id", "encounter_id", "ability").agg(F.sum("damage").cast("long").alias("damage"))
    present = k.where("a_ally").select("source_id", "encounter_id", F.col("attacker").alias("combatant")).distinct().join(classes_of(spark, k), ["source_id", "encounter_id", "combatant"])
    return classify.raid_buff_credit(raid, classify.granting_classes(maps, over), present)


_GRANTED = ", rd as (select source_id, encounter_id, ability, sum(damage)::bigint as damage from tg where source='raid' group by 1,2,3), pc as (select distinct k.source_id, k.encounter_id, attacker as combatant, lower(class) as class from k join bc on bc.combatant=k.attacker and bc.source_id=k.source_id and bc.encounter_id=k.encounter_id where a_ally), gd as (select rd.*, pc.combatant from rd join gr using (ability) join pc on pc.source_id=rd.source_id and pc.encounter_id=rd.encounter_id and pc.class=gr.class)"
on_sources("raid_buff_credit", _credit, "select source_id, encounter_id, ability, damage, combatant as granter, granters, damage//granters as credit, granters>1 as estimated from (select *, count(*) over (partition by source_id, encounter_id, ability) as granters from gd) union all select source_id, encounter_id, ability, damage, null, 0, null, false from rd where (source_id, encounter_id, ability) not in (select (source_id, encounter_id, ability) from gd)", sql.KEPT + _TAG + _GRANTED)


def _drill(spark, k):
    tags = sourced(spark, k).select("source_id", "encounter_id", "combatant", "ability", "source")
    return reports.drill_abilities(stats.bucket_fanout(k), window(k), "Outgoing Damage", tags)


register("drill_sources", lambda spark, d: _drill(spark, stored(kept(spark, d))).select("source_id", "encounter_id", "combatant", "ability", "total", "source"), sql.KEPT + _TAG, "select source_id, encounter_id, combatant, ability, total, source from (select source_id, encounter_id, combatant, ability, coalesce(sum(amount) filter (amount>0),0)::bigint as total from (select source_id, encounter_id, attacker as combatant, unnest([ability, 'All']) as ability, amount from k where category in (1,2) and not selfd) group by all) left join (select source_id, encounter_id, combatant, ability, source from tg) using (source_id, encounter_id, combatant, ability)")
register("granting_classes", lambda spark, d: tagged(spark, d).select(F.lower("ability").alias("ability")).distinct().join(classify.granting_classes(*dims(spark)[:2]), "ability").select("ability", F.array_join(F.array_sort("granted_by"), ",").alias("granted_by")), sql.KEPT + _TAG, "select lower(ability) as ability, case ability when 'Skill 5' then 'Guardian,Templar' else string_agg(class, ',' order by class) end as granted_by from cm where ability in (select ability from us2) group by ability")
on_sources("padding_alarm", lambda spark, k: classify.padding_alarm(sourced(spark, k), padded(spark, k)), "select source_id, encounter_id, combatant, sum(damage)::bigint as damage, 'pet ability' as reason from tg where source='pet' group by 1,2,3 union all select source_id, encounter_id, combatant, damage, 'impossible school' from pd")

# --- who is who ------------------------------------------------------------------
_TAGS = _CLASSES + """, tt as (select c.*, duration_s, class, coalesce(mapped,0) as mapped, case when combatant='Unknown' then 'system' when not ally then case when linked then 'enemy' else 'bystander' end when combatant like '% %' then 'pet' end as fixed, count(*) filter (ally) over (partition by source_id, encounter_id) as total,
  case when max(damage_ts) over (partition by source_id, encounter_id) > min(first_ts) over (partition by source_id, encounter_id) then c.damage+c.healed else 0 end as worth from c join w using (source_id, encounter_id) left join (select source_id, encounter_id, combatant, class, mapped from dt) using (source_id, encounter_id, combatant)),
bf as (select source_id, encounter_id, combatant, confirmed, case when cap is null then confirmed when confirmed then not (dn<=sure-cap) else up<=cap-sure end as player from (select *, row_number() over (partition by source_id, encounter_id, confirmed order by worth desc, combatant) as up, row_number() over (partition by source_id, encounter_id, confirmed order by worth, combatant) as dn, case when total<=6 then null when total<=10 then 6 else 24 end as cap, sum(confirmed::int) over (partition by source_id, encounter_id) as sure from (select *, mapped>0 as confirmed from tt where fixed is null))),
tags as (select source_id, encounter_id, combatant, coalesce(fixed, case when player then 'player' else 'pet' end) as kind, class, mapped, null::varchar as owner_name from tt left join bf using (source_id, encounter_id, combatant))"""


def tags_of(spark, k):
    return classify.classify_combatants(combatants(k), detected(spark, k))


def on_tags(name, run, body, prefix=""):
    # Tags and what they go with read the actions several times.
    register(name, lambda spark, d: run(spark, stored(kept(spark, d))), sql.TITLED + _TAGS + prefix, body)


on_tags("classify_combatants", tags_of, "select * from tags")
on_tags("bucket_fill", lambda spark, k: tags_of(spark, k).where("kind = 'player' or (kind = 'pet' and combatant not like '% %')").select("source_id", "encounter_id", "combatant", (F.col("mapped") > 0).alias("confirmed"), (F.col("kind") == "player").alias("player")), "select * from bf")
on_tags("enemy_keys", lambda spark, k: tags_of(spark, k).where("kind = 'enemy'").select("source_id", "encounter_id", "combatant"), "select source_id, encounter_id, combatant from tags where kind='enemy'")
on_tags("combatant_grid", lambda spark, k: reports.combatant_grid(combatants(k), window(k), tags_of(spark, k)), "select source_id, encounter_id, combatant, case kind when 'enemy' then 'enemy' when 'pet' then 'pet' else 'ally' end as side, class, owner_name, coalesce(last_ts-first_ts,0) as personal_s, damage, healed, damage_taken, deaths, damage::double/greatest(1,duration_s)::double as enc_dps, healed::double/greatest(1,duration_s)::double as enc_hps from c join w using (source_id, encounter_id) join tags using (source_id, encounter_id, combatant) where kind not in ('system','bystander') and (damage>0 or healed>0 or damage_taken>0)")
_EXPORT = """, ex as (select source_id, encounter_id, combatant as Name, coalesce(class,'') as Class, coalesce(last_ts-first_ts,0) as Time, damage as Damage, case when sum(damage) over p>0 then damage::double/(sum(damage) over p)::double else 0.0 end as Percent, damage::double/greatest(1,duration_s)::double as Dps, healed::double/greatest(1,duration_s)::double as Hps, healed as Heals, crit_heals as CritHeals, cures as Cures, drained as PowerDrain, replenished as PowerRep, swings as Swings, hits as Hits, crits as Crits, misses as Misses, avoids as Avoids, case when swings>0 then hits::double/swings::double else 0.0 end as ToHit, case when hits>0 then crits::double/hits::double else 0.0 end as CritPct, damage_taken as Taken, heals_taken as HealsTaken, deaths as Deaths
  from c join w using (source_id, encounter_id) join tags using (source_id, encounter_id, combatant) where kind='player' and (damage>0 or healed>0 or damage_taken>0) window p as (partition by source_id, encounter_id))"""
on_tags("ranked_export", lambda spark, k: reports.ranked_export(combatants(k), window(k), tags_of(spark, k), reports.EXPORT_COLUMNS, "CritPct"), "select *, row_number() over (partition by source_id, encounter_id order by CritPct desc, Name) as rank from ex", _EXPORT)
on_tags("archetype_filter", lambda spark, k: reports.ranked_export(combatants(k), window(k), tags_of(spark, k), ("Class", "Damage", "Percent"), "Class", ("Mage", "Priest")), "select source_id, encounter_id, Name, Class, Damage, Percent, row_number() over (partition by source_id, encounter_id order by lower(Class), Damage desc, Name) as rank from ex where Class in ('Wizard','Warlock','Templar','Warden')", _EXPORT)


def _rollup(spark, k):
    s = combatants(k)
    return reports.rollup_fights(stats.fight_totals(s), s, tags_of(spark, k))


on_tags("rollup_fights", _rollup, "select source_id, zone, combatant, damage, healed, damage_taken, deaths, personal_s, present, tag.kind as kind, tag.class as class, seconds, fights, damage::double/greatest(seconds,1)::double as enc_dps, healed::double/greatest(seconds,1)::double as enc_hps from (select source_id, zone, min(combatant) as combatant, sum(c.damage)::bigint as damage, sum(c.healed)::bigint as healed, sum(damage_taken)::bigint as damage_taken, sum(c.deaths)::bigint as deaths, sum(coalesce(last_ts-first_ts,0))::bigint as personal_s, count(*) as present, arg_max({'kind': kind, 'class': class}, (mapped, -encounter_id)) as tag from c join fights using (source_id, encounter_id) join tags using (source_id, encounter_id, combatant) where kind not in ('system','bystander') and (c.damage>0 or c.healed>0 or damage_taken>0) group by source_id, zone, upper(combatant)) join (select source_id, zone, sum(duration_s)::bigint as seconds, count(*) as fights from fights group by 1,2) using (source_id, zone)")


def _enemies(spark, k):
    return tags_of(spark, k).where("kind = 'enemy'")


_kinds = "case when amount>0 then 'landed' when amount=0 then coalesce(verdict,'stoneskin') when amount=-1 then 'miss' when amount=-2 then 'resist' when amount=-3 then 'parry' when amount=-4 then 'riposte' when amount=-5 then 'block' when amount_text='Counter' then 'counter' else 'dodge' end"
_TRIED = _WARDS + f", tr as (select k.*, victim as combatant, {_kinds} as kind, coalesce(absorbed,0) as absorbed, category=1 as auto from k join tags on tags.source_id=k.source_id and tags.encounter_id=k.encounter_id and tags.combatant=k.attacker and tags.kind='enemy' left join wp on wp.source_id=k.source_id and wp.hit_seq=k.seq where category in (1,2) and ability<>'Killing'), av as (select source_id, encounter_id, combatant, count(*) as attempts, count(*) filter (kind not in ('landed','warded')) as avoided, coalesce(sum(amount) filter (auto and amount>0),0)::double as ad, (count(*) filter (auto and amount>0))::double as ah, coalesce(sum(amount) filter (not auto and amount>0),0)::double as sd, (count(*) filter (not auto and amount>0))::double as sh from tr group by 1,2,3), me as (select *, case when ah>0 then ad/ah when sh>0 then sd/sh else 0.0 end as ma, case when sh>0 then sd/sh when ah>0 then ad/ah else 0.0 end as ms from av)"
_AVOIDED = ("landed", "warded", "stoneskin", *reports.AVOIDS)
_COUNTS = ("attempts", *_AVOIDED, "avoided", "warded_total", "est_avoided")
_OFF = "tr.kind not in ('landed','warded')"
_EACH = f", ev as (select source_id, encounter_id, combatant, any_value(attempts) as attempts, {', '.join(f"count(*) filter (tr.kind='{k}') as {k}" for k in _AVOIDED)}, any_value(avoided) as avoided, coalesce(sum(absorbed) filter (tr.kind='warded'),0)::bigint as warded_total, floor((count(*) filter (auto and {_OFF}))::double*any_value(ma) + (count(*) filter (not auto and {_OFF}))::double*any_value(ms))::bigint as est_avoided from tr join me using (source_id, encounter_id, combatant) group by 1,2,3), et as (select * from ev union all select * replace ('TOTAL' as combatant) from ev)"
_SUMS = ", ".join(f"sum({k})::bigint as {k}" for k in _COUNTS)
on_tags("avoidance_report", lambda spark, k: reports.avoidance_report(k, reports.ward_pairing(k, _absorb(), seconds=3), _enemies(spark, k)), f"select *, landed::double/attempts::double as landed_share, avoided::double/attempts::double as avoided_share from (select source_id, encounter_id, combatant, {_SUMS} from et group by 1,2,3)", _TRIED + _EACH)
on_tags("avoidance_by_actor", lambda spark, k: reports.avoidance_by_actor(k, reports.ward_pairing(k, _absorb(), seconds=3), window(k), _enemies(spark, k)), "select source_id, encounter_id, combatant, kind, actor, n, n::double/attempts::double as of_swings, case when kind not in ('landed','warded') then n::double/greatest(avoided,1)::double end as of_avoids, case when kind='warded' then w when kind<>'landed' then floor(a::double*ma + s::double*ms)::bigint end as estimate, case when kind='avoided' then floor(a::double*ma + s::double*ms)/greatest(duration_s,1)::double end as effective_hps from (select source_id, encounter_id, combatant, kind, case when kind in ('landed','warded','stoneskin','avoided') then '-' else 'self' end as actor, count(*) as n, count(*) filter (auto) as a, count(*) filter (not auto) as s, sum(absorbed)::bigint as w from (select tr.* exclude (kind), unnest(case when kind in ('landed','warded') then [kind] else [kind, 'avoided'] end) as kind from tr) group by 1,2,3,4,5) join me using (source_id, encounter_id, combatant) join w using (source_id, encounter_id)", _TRIED)
on_kept("fight_metric_columns", lambda k: (lambda s: reports.fight_metric_columns(s, stats.fight_totals(s)))(combatants(k)), sql.TITLED, "select kind, source_id, zone, encounter_id, label, value, case when abs(av-floor(av)-0.5)<1e-12 then 2*round(av/2) else round(av) end as average from (select *, (sum(value) over (partition by kind, source_id, case when kind='fight' then zone end, case when kind='ally' then encounter_id end))/(count(*) over (partition by kind, source_id, case when kind='fight' then zone end, case when kind='ally' then encounter_id end))::double as av from (select 'fight' as kind, source_id, zone, encounter_id, coalesce(title,'') as label, damage::double/greatest(1,duration_s)::double as value from fights union all select 'ally', c.source_id, zone, c.encounter_id, combatant, c.damage::double/greatest(1,duration_s)::double from c join fights using (source_id, encounter_id) where ally and c.damage>0))")
