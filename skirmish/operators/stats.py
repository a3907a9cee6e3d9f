"""Rollups of the actions of an encounter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_self_damage, looks_like_player

FIGHT = ("source_id", "encounter_id")
#: Buckets that an action's category feeds, outgoing and incoming,
#: and the sign of an action between two combatants.
OUT = {1: ("Outgoing Damage", "Auto-Attack (Out)"), 2: ("Outgoing Damage", "Skill/Ability (Out)"), 3: ("Healed (Out)",), 10: ("Power Drain (Out)",), 13: ("Power Replenish (Out)",), 16: ("Threat (Out)",), 20: ("Cure/Dispel (Out)",), 30: ()}
IN = {1: ("Incoming Damage",), 2: ("Incoming Damage",), 3: ("Healed (Inc)",), 10: ("Power Drain (Inc)",), 13: ("Power Replenish (Inc)",), 16: ("Threat (Inc)",), 20: ("Cure/Dispel (Inc)",), 30: ()}
OUT_REF, IN_REF = "All Outgoing (Ref)", "All Incoming (Ref)"
POLARITY = {1: -1, 2: -1, 3: 1, 10: -1, 13: 1, 16: -1, 20: 0, 30: 0}


def _sides(table: dict[int, tuple[str, ...]], ref: str, combatant: str, other: str, direction: str, counts: Column) -> Column:
    """A struct for each bucket that an action feeds on one side."""
    pairs = [F.lit(x) if not isinstance(x, tuple) else F.array(*[F.lit(b) for b in x]) for k, names in table.items() for x in (k, (*names, ref))]
    fed = F.when(counts, F.create_map(*pairs)[F.col("category")])
    told = F.transform(fed, lambda b: F.struct(F.col(combatant).alias("combatant"), F.col(other).alias("other"), F.lit(direction).alias("direction"), b.alias("bucket")))
    return F.coalesce(told, F.array().cast("array<struct<combatant:string,other:string,direction:string,bucket:string>>"))


def bucket_fanout(kept: DataFrame) -> DataFrame:
    """A row for each (combatant, bucket) that an action counts in, from one pass over
    the actions.  Damage to oneself counts as taken only."""
    out = _sides(OUT, OUT_REF, "attacker", "victim", "out", ~is_self_damage())
    into = _sides(IN, IN_REF, "victim", "attacker", "in", F.lit(True))
    return kept.withColumn("_side", F.explode(F.concat(out, into))).select(*kept.columns, "_side.*")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def sum_if(condition: Column, value="amount") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value)).otherwise(0)), F.lit(0)).cast("long")


def stat_columns() -> dict[str, Column]:
    a, death = F.col("amount"), F.col("amount") == -10
    return {
        "damage": sum_if(a > 0),
        "swings": count_if(~death | (F.col("ability") == "Killing")),
        "hits": count_if(a >= 0),
        "crits": count_if(F.col("critical") & (a >= 0)),
        "misses": count_if(a == -1),
        "avoids": count_if((a < -1) & ~death),
        "deaths": count_if(death),
        "min_hit": F.coalesce(F.min(F.when(a >= 0, a)), F.lit(0)).cast("long"),
        "max_hit": F.coalesce(F.max(F.when(a > 0, a)), F.lit(0)).cast("long"),
        "first_ts": F.min("ts"),
        "last_ts": F.max("ts"),
    }


def ability_stats(fanned: DataFrame) -> DataFrame:
    return fanned.groupBy(*FIGHT, "combatant", "bucket", "ability").agg(*[c.alias(k) for k, c in stat_columns().items()])


def ability_stats_all(fanned: DataFrame) -> DataFrame:
    """The same with a row "All" for each bucket, in one pass.  Deaths are swings
    in the row of "Killing" alone."""
    keys = [F.col(c) for c in (*FIGHT, "combatant", "bucket")]
    sets = fanned.withColumn("ability", F.explode(F.array("ability", F.lit("All"))))
    return sets.groupBy(*keys, "ability").agg(*[c.alias(k) for k, c in stat_columns().items()])


def upper_median(fanned: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The element in the middle (the upper one of two) of amounts >= 0."""
    hits = fanned.where("amount >= 0")
    w = Window.partitionBy(*by)
    ranked = hits.withColumn("_r", F.row_number().over(w.orderBy("amount", "seq"))).withColumn("_n", F.count("*").over(w))
    return ranked.where("_r = _n div 2 + 1").select(*by, F.col("amount").alias("median"))


def _pet_death() -> Column:
    return F.coalesce(F.col("extra") == "pet-death", F.lit(False))


def combatant_stats(kept: DataFrame) -> DataFrame:
    """Everyone in a fight, with all that is counted of a combatant, in one
    aggregation.  kept: actions with a_ally and v_ally (see allies)."""
    cat, a = F.col("category"), F.col("amount")
    act = F.struct(F.col("attacker").alias("combatant"), F.col("victim").alias("other"), F.col("a_ally").alias("ally"), (F.col("seq") * 2).alias("at"), (~is_self_damage()).alias("out"), F.lit(False).alias("into"))
    bear = F.struct(F.col("victim").alias("combatant"), F.col("attacker").alias("other"), F.col("v_ally").alias("ally"), (F.col("seq") * 2 + 1).alias("at"), F.lit(False).alias("out"), F.lit(True).alias("into"))
    sides = kept.select(*FIGHT, "seq", "zone", "ts", "category", "ability", "amount", "critical", "extra", F.explode(F.array(act, bear)).alias("side"))
    s = sides.select("*", "side.*").where("out or into")
    out, into, real = F.col("out"), F.col("into"), a > 0
    hit, death, killing = out & cat.isin(1, 2), a == -10, F.col("ability") == "Killing"
    sign = F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])[cat]
    linked = (F.coalesce(sign, F.lit(0)) != 0) & (F.col("combatant") != "Unknown") & (F.col("other") != "Unknown") & (F.upper("combatant") != F.upper("other"))
    credited = out & death & ~_pet_death() & (F.col("ally") | looks_like_player(F.col("other")))
    rows = s.groupBy(*FIGHT, "combatant").agg(
        F.max("ally").alias("ally"),
        sum_if(hit & real).alias("damage"), sum_if(out & (cat == 3) & real).alias("healed"),
        sum_if(into & cat.isin(1, 2) & real).alias("damage_taken"), sum_if(into & (cat == 3) & real).alias("heals_taken"),
        sum_if(out & (cat == 10) & real).alias("drained"), sum_if(out & (cat == 13) & real).alias("replenished"),
        count_if(out & (cat == 20) & ~death).alias("cures"), count_if(F.lit(True)).alias("observed"),
        F.min(F.when(out, F.col("ts"))).alias("first_ts"), F.max(F.when(out, F.col("ts"))).alias("last_ts"), F.max(F.when(hit, F.col("ts"))).alias("damage_ts"),
        count_if(hit & ~death).alias("swings"), count_if(hit & (a >= 0)).alias("hits"), count_if(hit & (a >= 0) & F.col("critical")).alias("crits"), count_if(hit & (a == -1)).alias("misses"), count_if(hit & (a < -1) & ~death).alias("avoids"),
        count_if(out & (cat == 3) & ~death).alias("heals"), count_if(out & (cat == 3) & (a >= 0) & F.col("critical")).alias("crit_heals"),
        count_if(into & killing).alias("_killed"), count_if(into & killing & _pet_death()).alias("pet_deaths"), count_if(into & death).alias("_dead"), count_if(credited).alias("kills"),
        F.max(linked).alias("linked"), F.min("at").alias("first_seen"), F.min(F.struct("seq", "zone")).alias("opening"),
    )
    # Deaths are the kills told of a combatant, those of pets under its name apart; without any, death-coded actions.
    return rows.withColumn("deaths", F.when(F.col("_killed") > 0, F.col("_killed") - F.col("pet_deaths")).otherwise(F.col("_dead"))).drop("_killed", "_dead")


def death_counts(stats: DataFrame) -> DataFrame:
    """Deaths of each combatant; those of pets under an owner's name apart."""
    return stats.where("deaths + pet_deaths > 0").select(*FIGHT, "combatant", "deaths", "pet_deaths")


def kill_counts(stats: DataFrame) -> DataFrame:
    """Kills of each combatant; those of a non-ally only of players, none of pets."""
    return stats.where("kills > 0").select(*FIGHT, "combatant", "kills")


def autoattack_by_school(kept: DataFrame) -> DataFrame:
    landed = kept.where((F.col("category") == 1) & (F.col("ability") == "Auto-Attack") & (F.col("amount") > 0))
    return landed.groupBy(*FIGHT, F.col("attacker").alias("combatant"), F.lower("damage_type").alias("school")).agg(F.sum("amount").alias("damage"), F.count("*").alias("hits"))


def ally_edges(kept: DataFrame) -> DataFrame:
    """The signed sum of what passed between two combatants, once from either
    side; cures and control count for nothing."""
    sign = F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])[F.col("category")]
    real = (F.upper("attacker") != F.upper("victim")) & (F.col("attacker") != "Unknown") & (F.col("victim") != "Unknown") & (sign != 0)
    a, v = F.col("attacker"), F.col("victim")
    sides = kept.where(real).select(*FIGHT, sign.alias("sign"), F.explode(F.array(F.struct(a.alias("src"), v.alias("dst")), F.struct(v.alias("src"), a.alias("dst")))).alias("e"))
    return sides.groupBy(*FIGHT, "e.src", "e.dst").agg(F.sum("sign").cast("long").alias("value"))


def fight_totals(stats: DataFrame) -> DataFrame:
    """One row an encounter, from the rows of its combatants: window, zone, title
    (the non-ally that took the most damage per death, first seen on ties; none
    without an ally), outcome by deaths (1 won, 2 drawn, 3 lost, 0 without an ally
    or an enemy) and what its allies did."""
    ally = F.col("ally")
    player = ally & looks_like_player(F.col("combatant"))
    score = F.expr("damage_taken div greatest(deaths, 1)")
    enemy = F.max_by(F.struct(F.col("combatant").alias("title"), score.alias("score"), "deaths"), F.when(~ally, F.struct(score.alias("s"), (-F.col("first_seen")).alias("f"))))
    f = stats.groupBy(*FIGHT).agg(
        F.min("first_ts").alias("start_ts"), F.max(F.when(ally, F.col("damage_ts"))).alias("_allied_ts"), F.max("damage_ts").alias("_any_ts"), F.max(ally).alias("has_ally"), enemy.alias("_enemy"),
        F.max(player & (F.col("deaths") == 0)).alias("_survivor"), F.min("opening").alias("_opening"), F.count("*").alias("n_combatants"),
        sum_if(ally, "damage").alias("damage"), sum_if(ally, "healed").alias("healed"), sum_if(ally, "kills").alias("kills"), sum_if(player, "deaths").alias("deaths"),
    )
    end = F.when(F.col("has_ally"), F.col("_allied_ts")).otherwise(F.col("_any_ts"))
    named = F.when(F.col("has_ally"), F.col("_enemy"))
    won = named["deaths"] > 0
    level = F.when(~F.col("has_ally") | named.isNull(), 0).when(won & F.col("_survivor"), 1).when(won | F.col("_survivor"), 2).otherwise(3)
    return f.select(*FIGHT, "start_ts", F.greatest("start_ts", F.coalesce(end, "start_ts")).alias("end_ts"), named["title"].alias("title"), named["score"].alias("score"), F.col("_opening.zone").alias("zone"), level.alias("success"), "n_combatants", "damage", "healed", "kills", "deaths").withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))


def with_scripted_wins(fights: DataFrame, scripted: DataFrame) -> DataFrame:
    """Fights in which a scripted win was told (see chat) count as won."""
    told = scripted.select(*FIGHT, F.lit(True).alias("_scripted")).distinct()
    return fights.join(told, list(FIGHT), "left").withColumn("success", F.when(F.col("_scripted"), 1).otherwise(F.col("success"))).drop("_scripted")


def share_of(df: DataFrame, value: str, by: tuple[str, ...], name: str = "share") -> DataFrame:
    """A value's part in the total of its group."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(name, F.when(total > 0, F.col(value).cast("double") / total.cast("double")).otherwise(0.0))


#: The buckets whose activity is drawn over time.
ACTIVE = ("Auto-Attack (Out)", "Skill/Ability (Out)", "Healed (Out)", "Power Drain (Out)", "Power Replenish (Out)", "Cure/Dispel (Out)", "Threat (Out)")


def activity_series(fanned: DataFrame, window: DataFrame, by: tuple[str, ...] = ("combatant", "bucket")) -> DataFrame:
    """What was done per slot of a fight and key, zero-filled: slot seconds are a
    sixtieth of the fight, 2 to 30; what lies outside the fight's slots is left out."""
    seconds = F.greatest(F.lit(1), F.col("duration_s"))
    slots = window.withColumn("slot_s", F.greatest(F.lit(2), F.least(F.lit(30), F.ceil(seconds / 60)))).withColumn("n", F.expr("greatest(1, duration_s) div slot_s + 1")).select(*FIGHT, "start_ts", "slot_s", "n")
    hits = fanned.where("amount > 0").join(slots, list(FIGHT)).withColumn("slot", F.expr("(ts - start_ts) div slot_s")).where("slot between 0 and n - 1")
    sums = hits.groupBy(*FIGHT, *by, "slot").agg(F.sum("amount").cast("long").alias("total"))
    grid = hits.groupBy(*FIGHT, *by).agg(F.first("slot_s").alias("slot_s"), F.first("n").alias("n")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    total = F.coalesce("total", F.lit(0))
    return grid.join(sums, [*FIGHT, *by, "slot"], "left").select(*FIGHT, *by, "slot", total.alias("total"), (total.cast("double") / F.col("slot_s").cast("double")).alias("rate"))
