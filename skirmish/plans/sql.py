"""The plain-SQL side of the queries: common table expressions that the oracle
statements start with."""

#: The adapter from `events` to swings.
SWINGS = r"""
e as (select event_id, user_id, event_type, cast(round(value*100) as bigint) as amt, cast(regexp_extract(props,'\d+') as int) as k from events),
s as (select 'log-' || (event_id % 3) as source_id, 'P' || (event_id % 3) as owner, 'Zone ' || ((event_id // 200) % 4) as zone, event_id as seq,
 1700000000 + event_id + 30*(event_id // 40) as ts,
 case when event_type='signup' then case k%6 when 1 then 10 when 2 then 13 when 3 then 16 when 4 then 20 when 5 then 30 else 0 end
      when event_type='click' then 1 when event_type='view' then 2 when event_type='purchase' then 3 else 1 end as category,
 (k % 4 = 0 and event_type in ('click','view','purchase')) as critical,
 case when event_type='click' and k%5=1 then 'Multi Attack' when event_type='click' and k%5=2 then 'Flurry' when event_type='click' and k%5=3 then 'AoE Attack' else 'None' end as special,
 case when event_type<>'purchase' and user_id%3=0 then case when k%3=1 then 'A mob ' else 'a mob ' end || (user_id % 2) else 'P' || (user_id % 8) end as attacker,
 case when event_type='click' then 'Auto-Attack' when event_type='error' and k%10=0 then 'Killing' when event_type='error' then 'Auto-Attack' when event_type='signup' and k%6=5 then 'stunned' else 'Skill ' || (k % 6) end as ability,
 case when event_type='error' and k%10=0 then -10 when event_type='error' and k%7=3 then -9 when event_type='error' then -1-(k%5) when event_type='view' and k%11=0 then 0 when event_type='signup' and k%6 in (0,4,5) then 0 else amt end as amount,
 case when event_type='purchase' then 'P' || ((user_id+k) % 8) when user_id%3=0 then 'P' || ((user_id+k) % 8) else 'a mob ' || (k % 2) end as victim,
 case when event_type='purchase' then 'heal' when event_type='error' and k%10=0 then 'death' when event_type='error' then 'avoided' when event_type='view' and k%11=0 then 'none'
      when event_type='signup' then case k%6 when 1 then 'power' when 2 then 'power' when 3 then 'threat' when 4 then 'Effect ' || (k%3) when 5 then 'applied' else '' end
      else ['crushing','slashing','piercing','heat','cold','magic'][1 + k%6] end as damage_type,
 case when event_type='error' and k%10=0 and (case when user_id%3=0 then 'P' || ((user_id+k) % 8) else '' end) = 'P' || (event_id % 3) then 'pet-death' end as extra,
 case when event_type='error' and k%10<>0 and k%7=3 then case when k%2=0 then 'Dodge' else 'Counter' end end as amount_text from e)"""

#: Actions within encounters, from running aggregates over each whole source; a name has
#: its first spelling of the fight.
KEPT = SWINGS + """,
h0 as (select *, (category in (1,2) and ability<>'Killing' and upper(attacker)<>upper(victim)) as hostile from s),
h1 as (select *, sum(hostile::int) over (partition by source_id order by seq) as hg from h0),
h2 as (select *, first(ts) over (partition by source_id, hg order by seq) as hts, max(ts) over (partition by source_id, hg order by seq) as rmax from h1),
h3 as (select *, lag(rmax) over (partition by source_id order by seq) as prmax, lag(hts) over (partition by source_id order by seq) as phts from h2),
h4 as (select *, (hg=0 or rmax-hts>6) as ended, (hostile and (hg=1 or greatest(prmax,ts)-phts>6)) as opens from h3),
h5 as (select *, max(case when opens then seq end) over (partition by source_id order by seq) as encounter_id from h4),
h6 as (select *, category in (1,2) and upper(attacker)=upper(victim) as selfd from h5 where hostile or (category<>0 and not ended)),
sp as (select source_id, encounter_id, upper(name) as key, arg_min(name, pos) as name from (select source_id, encounter_id, attacker as name, 2*seq as pos from h6 where not selfd union all select source_id, encounter_id, victim, 2*seq+1 from h6) group by 1,2,3),
k as (select h6.* exclude (attacker, victim, selfd), sa.name as attacker, sv.name as victim, row_number() over (partition by h6.source_id, h6.encounter_id order by seq) as time_sorter, sa.name not ilike 'a mob%' as a_ally, sv.name not ilike 'a mob%' as v_ally, selfd
 from h6 join sp sa on sa.source_id=h6.source_id and sa.encounter_id=h6.encounter_id and sa.key=upper(attacker) join sp sv on sv.source_id=h6.source_id and sv.encounter_id=h6.encounter_id and sv.key=upper(victim))"""

WINDOW = KEPT + """,
w0 as (select source_id, encounter_id, min(case when not selfd then ts end) as start_ts,
 case when max((a_ally or v_ally)::int)=1 then max(case when category in (1,2) and not selfd and a_ally then ts end) else max(case when category in (1,2) and not selfd then ts end) end as e from k group by all),
w as (select source_id, encounter_id, start_ts, greatest(start_ts, coalesce(e, start_ts)) as end_ts, greatest(start_ts, coalesce(e, start_ts)) - start_ts as duration_s from w0)"""

FANNED = KEPT + """,
f as (select k.*, attacker as combatant, victim as other, 'out' as direction, unnest(case category when 1 then ['Outgoing Damage','Auto-Attack (Out)','All Outgoing (Ref)'] when 2 then ['Outgoing Damage','Skill/Ability (Out)','All Outgoing (Ref)']
  when 3 then ['Healed (Out)','All Outgoing (Ref)'] when 10 then ['Power Drain (Out)','All Outgoing (Ref)'] when 13 then ['Power Replenish (Out)','All Outgoing (Ref)'] when 16 then ['Threat (Out)','All Outgoing (Ref)'] when 20 then ['Cure/Dispel (Out)','All Outgoing (Ref)'] else ['All Outgoing (Ref)'] end) as bucket from k where not selfd
 union all select k.*, victim, attacker, 'in', unnest(case when category in (1,2) then ['Incoming Damage','All Incoming (Ref)'] when category=3 then ['Healed (Inc)','All Incoming (Ref)'] when category=10 then ['Power Drain (Inc)','All Incoming (Ref)'] when category=13 then ['Power Replenish (Inc)','All Incoming (Ref)']
  when category=16 then ['Threat (Inc)','All Incoming (Ref)'] when category=20 then ['Cure/Dispel (Inc)','All Incoming (Ref)'] else ['All Incoming (Ref)'] end) from k)"""

COMBATANTS = WINDOW + """,
side as (select *, attacker as combatant, victim as other, not selfd as o, false as i, a_ally as al, seq*2 as pos from k union all select *, victim, attacker, false, true, v_ally, seq*2+1 from k),
c0 as (select source_id, encounter_id, combatant, bool_or(al) as ally,
 coalesce(sum(amount) filter (o and category in (1,2) and amount>0),0)::bigint as damage, coalesce(sum(amount) filter (o and category=3 and amount>0),0)::bigint as healed,
 coalesce(sum(amount) filter (i and category in (1,2) and amount>0),0)::bigint as damage_taken, coalesce(sum(amount) filter (i and category=3 and amount>0),0)::bigint as heals_taken,
 coalesce(sum(amount) filter (o and category=10 and amount>0),0)::bigint as drained, coalesce(sum(amount) filter (o and category=13 and amount>0),0)::bigint as replenished,
 count(*) filter (o and category=20 and amount<>-10) as cures, count(*) as observed, min(ts) filter (o) as first_ts, max(ts) filter (o) as last_ts, max(ts) filter (o and category in (1,2)) as damage_ts,
 count(*) filter (o and category in (1,2) and amount<>-10) as swings, count(*) filter (o and category in (1,2) and amount>=0) as hits, count(*) filter (o and category in (1,2) and amount>=0 and critical) as crits,
 count(*) filter (o and category in (1,2) and amount=-1) as misses, count(*) filter (o and category in (1,2) and amount<-1 and amount<>-10) as avoids,
 count(*) filter (o and category=3 and amount<>-10) as heals, count(*) filter (o and category=3 and amount>=0 and critical) as crit_heals,
 count(*) filter (i and ability='Killing') as killed, count(*) filter (i and ability='Killing' and extra='pet-death') as pet_deaths, count(*) filter (i and amount=-10) as dead,
 count(*) filter (o and amount=-10 and extra is distinct from 'pet-death' and (al or other not like '% %')) as kills,
 bool_or(category in (1,2,3,10,13,16) and upper(combatant)<>upper(other)) as linked, min(pos) as first_seen
 from side where o or i group by all),
c as (select * exclude (killed, dead), case when killed>0 then killed-pet_deaths else dead end as deaths from c0)"""

TITLED = COMBATANTS + """,
al as (select source_id, encounter_id, bool_or(ally) as has_ally, coalesce(bool_or(ally and deaths=0 and combatant not like '% %'), false) as sv, count(*) as n_combatants,
  coalesce(sum(damage) filter (ally),0)::bigint as damage, coalesce(sum(healed) filter (ally),0)::bigint as healed, coalesce(sum(kills) filter (ally),0)::bigint as kills, coalesce(sum(deaths) filter (ally and combatant not like '% %'),0)::bigint as deaths from c group by 1,2),
t as (select source_id, encounter_id, combatant as title, score, died as title_deaths from (select source_id, encounter_id, combatant, deaths as died, damage_taken // greatest(deaths,1) as score, row_number() over (partition by source_id, encounter_id order by damage_taken // greatest(deaths,1) desc, first_seen) as r
  from c where not ally) join al using (source_id, encounter_id) where r=1 and has_ally),
z as (select source_id, encounter_id, arg_min(zone, seq) as zone from k group by all),
nm as (select source_id, encounter_id, combatant as name from c),
fights as (select w.*, t.title, t.score, z.zone, case when not has_ally or t.title is null then 0 when title_deaths>0 and sv then 1 when title_deaths>0 or sv then 2 else 3 end as success, n_combatants, damage, healed, kills, deaths
  from w left join t using (source_id, encounter_id) join z using (source_id, encounter_id) join al using (source_id, encounter_id))"""


def query(prefix: str, body: str) -> str:
    return f"with {'recursive ' if ' union all select nx.' in prefix or ' union all select sn.' in prefix else ''}{prefix.strip()}\n{body}"
