"""Reports over the actions of encounters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import archetype_of, avoid_actor, avoid_kind, per_second, rounded_percent, rounded_rate
from .stats import FIGHT, combatant_stats, count_if, fight_totals, share_of, sum_if

#: The order in which buckets are listed, and what is no damage type.
BUCKET_ORDER = (
    "Auto-Attack (Out)", "Skill/Ability (Out)", "Outgoing Damage", "Healed (Out)", "Power Drain (Out)", "Power Replenish (Out)", "Cure/Dispel (Out)", "Threat (Out)", "All Outgoing (Ref)",
    "Incoming Damage", "Healed (Inc)", "Power Drain (Inc)", "Power Replenish (Inc)", "Cure/Dispel (Inc)", "Threat (Inc)", "All Incoming (Ref)",
)
NO_TYPES = ("", "avoided", "death", "none", "heal")


def fights(kept: DataFrame) -> DataFrame:
    """One row an encounter: window, title, zone, outcome and what allies did."""
    return fight_totals(combatant_stats(kept))


def personal_s():
    """Seconds from a combatant's first outgoing action to the last."""
    return F.coalesce(F.col("last_ts") - F.col("first_ts"), F.lit(0))


def rates(stats: DataFrame, window: DataFrame) -> DataFrame:
    """Rates over the fight and over the combatant's own active time: as shown
    (a second at least), and as uploaded (two places, 0 without time)."""
    s = stats.join(window.select(*FIGHT, "duration_s"), list(FIGHT)).withColumn("personal_s", personal_s())
    d, h, n, own = F.col("damage"), F.col("healed"), F.col("duration_s"), F.col("personal_s")
    return s.select(
        *FIGHT, "combatant", "damage", "healed", "personal_s", per_second(d, n).alias("enc_dps"), per_second(d, own).alias("dps"), per_second(h, n).alias("enc_hps"),
        rounded_rate(d, n).alias("up_enc_dps"), rounded_rate(d, own).alias("up_dps"), rounded_rate(h, n).alias("up_enc_hps"), rounded_percent(F.col("hits"), F.col("swings")).alias("to_hit"),
    )


def drill_buckets(fanned: DataFrame) -> DataFrame:
    """Every combatant's buckets in their order, with the part in the fight's total."""
    rows = fanned.groupBy(*FIGHT, "combatant", "bucket").agg(F.first("direction").alias("direction"), sum_if(F.col("amount") > 0).alias("total"), F.count("*").alias("swings"))
    place = F.array_position(F.array(*map(F.lit, BUCKET_ORDER)), F.col("bucket")).cast("long")
    return share_of(rows, "total", (*FIGHT, "bucket")).withColumn("place", place)


def drill_abilities(fanned: DataFrame, window: DataFrame, bucket: str, sources: DataFrame | None = None) -> DataFrame:
    """The abilities of a bucket under a headline "All", with rate, types and, by
    sources(fight, combatant, ability, source), where they come from."""
    a = F.col("amount")
    rows = fanned.where(F.col("bucket") == bucket).withColumn("_type", F.when(~F.col("damage_type").isin(*NO_TYPES), F.col("damage_type"))).withColumn("ability", F.explode(F.array("ability", F.lit("All"))))
    out = rows.groupBy(*FIGHT, "combatant", "ability").agg(count_if((a != -10) | (F.col("ability") == "Killing")).alias("swings"), count_if(a >= 0).alias("hits"), count_if(F.col("critical") & (a >= 0)).alias("crits"), F.coalesce(F.max(F.when(a > 0, a)), F.lit(0)).alias("max_hit"), sum_if(a > 0).alias("total"), F.array_join(F.array_sort(F.collect_set("_type")), ",").alias("types"))
    whole = F.max(F.when(F.col("ability") == "All", F.col("total"))).over(Window.partitionBy(*FIGHT, "combatant"))
    out = out.withColumn("share", F.when(whole > 0, F.col("total").cast("double") / whole.cast("double")).otherwise(0.0))
    out = out.join(window.select(*FIGHT, "duration_s"), list(FIGHT)).withColumn("dps", per_second(F.col("total"), F.col("duration_s"))).drop("duration_s")
    if sources is None:
        return out
    return out.join(sources.select(*FIGHT, "combatant", "ability", "source"), [*FIGHT, "combatant", "ability"], "left")


def breakdown_by_other(fanned: DataFrame, window: DataFrame, bucket: str) -> DataFrame:
    a = F.col("amount")
    rows = fanned.where(F.col("bucket") == bucket).groupBy(*FIGHT, "combatant", "other").agg(count_if(a != -10).alias("swings"), count_if(a >= 0).alias("hits"), count_if(F.col("critical") & (a >= 0)).alias("crits"), F.coalesce(F.max(F.when(a > 0, a)), F.lit(0)).alias("max_hit"), sum_if(a > 0).alias("total"))
    rows = rows.join(window.select(*FIGHT, "duration_s"), list(FIGHT)).withColumn("enc_dps", per_second(F.col("total"), F.col("duration_s"))).drop("duration_s")
    return share_of(rows, "total", (*FIGHT, "combatant"))


def share_by_archetype(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(fight, combatant, total) summed by archetype; classes(fight, combatant,
    class)."""
    named = rows.join(classes, [*FIGHT, "combatant"], "left").withColumn("archetype", F.coalesce(archetype_of(F.col("class")), F.lit("Other")))
    return share_of(named.groupBy(*FIGHT, "archetype").agg(F.sum("total").cast("long").alias("total")), "total", FIGHT)


def combatant_breakdown(fanned: DataFrame) -> DataFrame:
    """Damage by ability of each combatant over all fights, under the least spelling of
    its name."""
    told = fanned.where("bucket = 'Outgoing Damage' and amount > 0").groupBy("combatant", "ability").agg(F.sum("amount").cast("long").alias("total"), F.count("*").alias("hits"))
    named = told.withColumn("combatant", F.min("combatant").over(Window.partitionBy(F.upper("combatant"))))
    rows = named.groupBy("combatant", "ability").agg(F.sum("total").cast("long").alias("total"), F.sum("hits").cast("long").alias("hits"))
    return share_of(rows, "total", ("combatant",))


def auto_attack_groups(kept: DataFrame) -> DataFrame:
    """Auto-attack by kind, with a row for all."""
    auto = kept.where("category = 1 and ability = 'Auto-Attack'").withColumn("kind", F.explode(F.array(F.lit("All"), F.when(F.col("special") == "None", "Normal").otherwise(F.col("special")))))
    a = F.col("amount")
    return auto.groupBy(*FIGHT, F.col("attacker").alias("combatant"), "kind").agg(F.count("*").alias("swings"), count_if(a >= 0).alias("hits"), sum_if(a > 0).alias("total"))


def special_report(kept: DataFrame) -> DataFrame:
    """How the auto-attacks of each ally of a fight are made up, and a row "TOTAL"."""
    auto = kept.where("category = 1 and ability <> 'Killing' and a_ally and upper(attacker) <> upper(victim)")
    s, a = F.col("special"), F.col("amount")
    extra = ("Multi Attack", "Flurry", "AoE Attack")
    rows = auto.withColumn("combatant", F.explode(F.array("attacker", F.lit("TOTAL")))).groupBy(*FIGHT, "combatant").agg(F.count("*").alias("swings"), count_if(~s.isin(*extra)).alias("normal"), count_if(s == extra[0]).alias("multi"), count_if(s == extra[1]).alias("flurry"), count_if(s == extra[2]).alias("aoe"), count_if(a >= 0).alias("hits"), count_if((a >= 0) & F.col("critical")).alias("crits"))
    part = lambda c, of: F.when(F.col(of) > 0, F.col(c).cast("double") / F.col(of).cast("double")).otherwise(0.0)
    return rows.withColumns({"multi_rate": part("multi", "swings"), "flurry_rate": part("flurry", "swings"), "crit_rate": part("crits", "hits")})


def top_slices(rows: DataFrame, by: tuple[str, ...], name: str, value: str, n: int = 11) -> DataFrame:
    """The n largest of each group and "Other" for the rest."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), name))
    sliced = rows.withColumn("slice", F.when(rank <= n, F.col(name)).otherwise("Other"))
    return sliced.groupBy(*by, "slice").agg(F.sum(value).cast("long").alias(value))


def metric_bars(stats: DataFrame, metric: str) -> DataFrame:
    """Each combatant's part of the total and of the top row."""
    w = Window.partitionBy(*FIGHT)
    m = F.col(metric)
    total, top = F.sum(m).over(w), F.max(m).over(w)
    of = lambda d: F.when(d > 0, m.cast("double") / d.cast("double")).otherwise(0.0)
    return stats.select(*FIGHT, "combatant", m, of(total).alias("of_total"), of(top).alias("of_top"))


def mini_parse(stats: DataFrame, window: DataFrame, metric: str = "damage", n: int = 6) -> DataFrame:
    """The n best allies of each fight by a metric: the feature is a top list."""
    rows = stats.where(F.col("ally") & (F.col(metric) > 0)).join(window.select(*FIGHT, "duration_s"), list(FIGHT))
    w = Window.partitionBy(*FIGHT)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc(metric), "combatant")).cast("long")).withColumn("of_top", F.col(metric).cast("double") / F.max(metric).over(w).cast("double")).withColumn("raid_rate", per_second(F.sum(metric).over(w), F.col("duration_s")))
    return rows.where(F.col("rank") <= n).select(*FIGHT, "rank", "combatant", metric, per_second(F.col(metric), F.col("duration_s")).alias("rate"), "of_top", "raid_rate")


def zone_summary(stats: DataFrame) -> DataFrame:
    """A row a fight: allied damage and deaths, deaths of others as kills, and the
    part of the zone's biggest fight."""
    ally = F.col("ally")
    sides = stats.groupBy(*FIGHT).agg(sum_if(ally, "deaths").alias("deaths"), sum_if(~ally, "deaths").alias("kills"))
    rows = fight_totals(stats).drop("deaths", "kills").join(sides, list(FIGHT))
    top = F.greatest(F.lit(1), F.max("damage").over(Window.partitionBy("source_id", "zone")))
    return rows.select(*FIGHT, "zone", "title", "damage", "deaths", "kills", (F.col("damage").cast("double") / top.cast("double")).alias("bar"))


def _named_deaths(kept: DataFrame) -> DataFrame:
    """Deaths but for those of pets under their owner's name."""
    return kept.where("amount = -10 and not coalesce(extra = 'pet-death', false)")


def death_report(kept: DataFrame, last: int = 6) -> DataFrame:
    """For each death the last incoming actions with an amount up to its second:
    the feature is a short list.  Actions are numbered once per victim and fight,
    and a death reads the numbers before its own count."""
    victim = [*FIGHT, "victim"]
    by_time = Window.partitionBy(*victim).orderBy("ts", "time_sorter")
    lead = kept.where("amount <> 0 and amount <> -10").select(*victim, "ts", "attacker", "ability", "amount", F.row_number().over(by_time).cast("long").alias("nth"))
    told = _named_deaths(kept).select(*victim, "seq", "ts", "attacker").withColumn("_death", F.lit(1))
    both = kept.where("amount <> 0 and amount <> -10").select(*victim, "seq", "ts", "attacker").withColumn("_death", F.lit(0)).unionByName(told)
    # The frame takes in all of the death's second.
    upto = Window.partitionBy(*victim).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    deaths = both.withColumn("_n", F.sum(1 - F.col("_death")).over(upto)).where("_death = 1 and _n > 0")
    wanted = deaths.select(*victim, F.col("seq").alias("death_seq"), F.col("ts").alias("death_ts"), F.col("attacker").alias("killer"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(last), F.col("_n")))).alias("back"), "_n").withColumn("nth", F.col("_n") - F.col("back") + 1)
    return wanted.join(lead, [*victim, "nth"]).select(*FIGHT, F.col("victim").alias("combatant"), "killer", "death_ts", "death_seq", "back", "attacker", "ability", "amount", (F.col("death_ts") - F.col("ts")).alias("before_s"))


def death_timeline(kept: DataFrame, window: DataFrame) -> DataFrame:
    """Deaths so far, by second of the fight."""
    at = F.least(F.greatest(F.lit(0), F.col("ts") - F.col("start_ts")), F.greatest(F.lit(1), F.col("duration_s")))
    per = _named_deaths(kept).join(window.select(*FIGHT, "start_ts", "duration_s"), list(FIGHT)).groupBy(*FIGHT, at.alias("at_s")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*FIGHT).orderBy("at_s")
    return per.select(*FIGHT, "at_s", F.sum("n").over(run).alias("deaths"))


def rollup_timeline(kept: DataFrame, fight_rows: DataFrame) -> DataFrame:
    """Deaths so far over all fights of a source's zone, on the axis of their
    fighting time: the fights before add their seconds."""
    before = Window.partitionBy("source_id", "zone").orderBy("start_ts", "encounter_id").rowsBetween(Window.unboundedPreceding, -1)
    axis = fight_rows.select(*FIGHT, "zone", "start_ts", "duration_s", F.coalesce(F.sum("duration_s").over(before), F.lit(0)).alias("offset_s"))
    at = F.col("offset_s") + F.least(F.greatest(F.lit(0), F.col("ts") - F.col("start_ts")), F.col("duration_s"))
    per = _named_deaths(kept).drop("zone").join(axis, list(FIGHT)).groupBy("source_id", "zone", at.alias("at_s")).agg(F.count("*").alias("n"))
    return per.select("source_id", "zone", "at_s", F.sum("n").over(Window.partitionBy("source_id", "zone").orderBy("at_s")).alias("deaths"))


def ward_pairing(kept: DataFrame, is_absorb, gap: int = 6, seconds: int = 1) -> DataFrame:
    """Each absorb goes to the first zero hit on its victim within `gap` actions
    and a second; a zero hit without an absorb was turned by stoneskin.  Places
    meet in slots of `gap`: a hit lies in the slot of its absorb or the next."""
    slot = lambda c: F.expr(f"{c} div {int(gap)}")
    zero = kept.where("category in (1, 2) and amount = 0").select(*FIGHT, F.col("victim").alias("combatant"), F.col("time_sorter").alias("z"), F.col("ts").alias("z_ts"), F.col("seq").alias("hit_seq"))
    absorbs = kept.where(is_absorb).select(*FIGHT, F.col("victim").alias("combatant"), F.col("time_sorter").alias("a"), F.col("ts").alias("a_ts"), F.col("amount").alias("absorbed")).withColumn("slot", F.explode(F.array(slot("a"), slot("a") + 1)))
    near = absorbs.join(zero.withColumn("slot", slot("z")), [*FIGHT, "combatant", "slot"]).where((F.col("z") - F.col("a")).between(1, gap) & (F.abs(F.col("z_ts") - F.col("a_ts")) <= seconds))
    first = F.row_number().over(Window.partitionBy(*FIGHT, "combatant", "a").orderBy("z"))
    claimed = near.withColumn("_r", first).where("_r = 1").groupBy("source_id", "hit_seq").agg(F.sum("absorbed").cast("long").alias("absorbed"), F.count("*").alias("wards"))
    return zero.join(claimed, ["source_id", "hit_seq"], "left").select(*FIGHT, "hit_seq", "combatant", F.coalesce("absorbed", F.lit(0)).alias("absorbed"), F.coalesce("wards", F.lit(0)).alias("wards"), F.when(F.col("absorbed") > 0, "warded").otherwise("stoneskin").alias("verdict"))


def attacks_of(kept: DataFrame, enemies: DataFrame | None) -> DataFrame:
    """Attack attempts by the enemies of each fight, enemies(fight, combatant); by
    all who are no allies where none are given."""
    tried = kept.where("category in (1, 2) and ability <> 'Killing'")
    if enemies is None:
        return tried.where("not a_ally")
    return tried.join(enemies.select(*FIGHT, F.col("combatant").alias("attacker")), [*FIGHT, "attacker"], "left_semi")


#: The ways in which an attack is turned aside, in the order of the report.
AVOIDS = ("block", "parry", "riposte", "miss", "dodge", "resist", "counter")


def _tried(kept: DataFrame, paired: DataFrame, enemies: DataFrame | None) -> DataFrame:
    """Attacks with kind: landed, warded, stoneskin or how they were turned aside; and
    absorbed, what wards took of them."""
    text = F.col("amount_text") if "amount_text" in kept.columns else F.lit(None).cast("string")
    verdicts = paired.select("source_id", F.col("hit_seq").alias("seq"), "verdict", "absorbed")
    attacks = attacks_of(kept, enemies).join(verdicts, ["source_id", "seq"], "left")
    kind = F.when(F.col("amount") > 0, "landed").when(F.col("amount") == 0, F.coalesce("verdict", F.lit("stoneskin"))).otherwise(avoid_kind(F.col("amount"), text))
    return attacks.withColumn("combatant", F.col("victim")).withColumn("kind", kind)


def _worth() -> dict:
    """Sums that tell what a turned attack is worth: the average landed hit of its kind,
    auto or skill; the other kind's where none landed."""
    auto, hit = F.col("category") == 1, F.col("amount") > 0
    return {"_ad": sum_if(auto & hit), "_ah": count_if(auto & hit), "_sd": sum_if(~auto & hit), "_sh": count_if(~auto & hit)}


def _estimate(autos, skills):
    mean = lambda d, h: F.col(d).cast("double") / F.col(h).cast("double")
    auto = F.when(F.col("_ah") > 0, mean("_ad", "_ah")).when(F.col("_sh") > 0, mean("_sd", "_sh")).otherwise(0.0)
    skill = F.when(F.col("_sh") > 0, mean("_sd", "_sh")).otherwise(auto)
    return autos.cast("double") * auto + skills.cast("double") * skill


def avoidance_report(kept: DataFrame, paired: DataFrame, enemies: DataFrame | None = None) -> DataFrame:
    """What became of the enemies' attacks on each combatant, and in a row TOTAL on all
    of a fight.  Avoided is what neither landed nor was warded, stoneskin included; it is
    worth est_avoided, in whole points."""
    auto, kind = F.col("category") == 1, F.col("kind")
    avoided = ~kind.isin("landed", "warded")
    rows = _tried(kept, paired, enemies).groupBy(*FIGHT, "combatant").agg(
        F.count("*").alias("attempts"), *[count_if(kind == k).alias(k) for k in ("landed", "warded", "stoneskin", *AVOIDS)], count_if(avoided).alias("avoided"),
        sum_if(kind == "warded", "absorbed").alias("warded_total"), count_if(auto & avoided).alias("_aa"), count_if(~auto & avoided).alias("_sa"), *[c.alias(n) for n, c in _worth().items()],
    )
    counts = ("attempts", "landed", "warded", "stoneskin", *AVOIDS, "avoided", "warded_total", "est_avoided")
    each = rows.withColumn("est_avoided", F.floor(_estimate(F.col("_aa"), F.col("_sa"))).cast("long")).select(*FIGHT, "combatant", *counts)
    both = each.withColumn("combatant", F.explode(F.array("combatant", F.lit("TOTAL"))))
    summed = both.groupBy(*FIGHT, "combatant").agg(*[F.sum(c).cast("long").alias(c) for c in counts])
    share = lambda c: F.col(c).cast("double") / F.col("attempts").cast("double")
    return summed.withColumns({"landed_share": share("landed"), "avoided_share": share("avoided")})


def latest_fights(fight_rows: DataFrame) -> DataFrame:
    """The newest fight of each title and zone in a source: the ones to compare."""
    newest = F.max_by(F.col("encounter_id"), F.struct("start_ts", "encounter_id"))
    return fight_rows.where("title is not null").groupBy("source_id", F.lower("title").alias("t"), F.lower("zone").alias("z")).agg(newest.alias("encounter_id")).select(*FIGHT)


def comparable_fights(fight_rows: DataFrame, chosen: DataFrame, n: int = 10) -> DataFrame:
    """For each chosen fight (FIGHT) the newest n others of its source with the same
    title and zone, an outcome that fits and at least a quarter of its length:
    (source_id, a, b, rank).  A win doesn't go with a loss; the rest fits anything."""
    keys = ["source_id", "_t", "_z"]
    rows = fight_rows.where("title is not null").select("source_id", "encounter_id", F.lower("title").alias("_t"), F.lower("zone").alias("_z"), "start_ts", "duration_s", "success")
    a = rows.join(chosen.select(*FIGHT), list(FIGHT), "left_semi").select(*keys, F.col("encounter_id").alias("a"), F.col("duration_s").alias("a_s"), F.col("success").alias("a_success"))
    b = rows.withColumnRenamed("encounter_id", "b")
    fits = F.col("success").isin(0, 2) | F.col("a_success").isin(0, 2) | (F.col("success") == F.col("a_success"))
    found = a.join(b, keys).where((F.col("a") != F.col("b")) & fits & (4 * F.col("duration_s") >= F.col("a_s")))
    rank = F.row_number().over(Window.partitionBy("source_id", "a").orderBy(F.desc("start_ts"), F.desc("b"))).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select("source_id", "a", "b", "rank")


def compare_fights(pairs: DataFrame, stats: DataFrame, window: DataFrame) -> DataFrame:
    """pairs(source_id, a, b): per ally that did something, rates and deaths in
    both fights and what has changed; null on the side where it was absent."""
    active = stats.where("ally and (damage > 0 or healed > 0)").join(window.select(*FIGHT, "duration_s"), list(FIGHT))
    side = active.select(*FIGHT, "combatant", per_second(F.col("damage"), F.col("duration_s")).alias("dps"), per_second(F.col("healed"), F.col("duration_s")).alias("hps"), "deaths")
    one = pairs.select("source_id", "a", "b").join(side.withColumnsRenamed({"encounter_id": "a", "dps": "dps_a", "hps": "hps_a", "deaths": "deaths_a"}), ["source_id", "a"])
    two = pairs.select("source_id", "a", "b").join(side.withColumnsRenamed({"encounter_id": "b", "dps": "dps_b", "hps": "hps_b", "deaths": "deaths_b"}), ["source_id", "b"])
    both = one.join(two, ["source_id", "a", "b", "combatant"], "full_outer")
    delta = F.col("dps_a") - F.col("dps_b")
    return both.select("source_id", "a", "b", "combatant", "dps_a", "dps_b", "hps_a", "hps_b", "deaths_a", "deaths_b", delta.alias("delta"), F.when(F.col("dps_b") > 0, delta / F.col("dps_b")).alias("delta_share"))


def rollup_fights(fight_rows: DataFrame, stats: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """A zone's fights as one: sums per combatant over the sum of seconds, and by
    tags(fight, combatant, kind, class, mapped) the tag of the fight that tells most
    about the class."""
    seconds = fight_rows.groupBy("source_id", "zone").agg(F.sum("duration_s").alias("seconds"), F.count("*").alias("fights"))
    rows = stats.join(fight_rows.select(*FIGHT, "zone"), list(FIGHT)).where("damage > 0 or healed > 0 or damage_taken > 0").withColumn("_own", personal_s())
    best = []
    if tags is not None:
        rows = rows.join(tags.select(*FIGHT, "combatant", "kind", "class", "mapped"), [*FIGHT, "combatant"]).where("kind not in ('system', 'bystander')")
        best = [F.max_by(F.struct("kind", "class"), F.struct("mapped", (-F.col("encounter_id")).alias("first"))).alias("_tag")]
    sums = rows.groupBy("source_id", "zone", F.upper("combatant").alias("_key")).agg(F.min("combatant").alias("combatant"), *[F.sum(c).cast("long").alias(c) for c in ("damage", "healed", "damage_taken", "deaths")], F.sum("_own").cast("long").alias("personal_s"), F.count("*").alias("present"), *best).drop("_key")
    out = sums.join(seconds, ["source_id", "zone"]).withColumn("enc_dps", per_second(F.col("damage"), F.col("seconds"))).withColumn("enc_hps", per_second(F.col("healed"), F.col("seconds")))
    return out if tags is None else out.select("*", "_tag.kind", "_tag.class").drop("_tag")


#: What a table for export can hold, and what it can be sorted by.
EXPORT_COLUMNS = ("Class", "Time", "Damage", "Percent", "Dps", "Hps", "Heals", "CritHeals", "Cures", "PowerDrain", "PowerRep", "Swings", "Hits", "Crits", "Misses", "Avoids", "ToHit", "CritPct", "Taken", "HealsTaken", "Deaths")
DEFAULT_COLUMNS = ("Class", "Dps", "Hps", "Percent", "Deaths")


def archetype_filter(rows: DataFrame, archetypes=None, column: str = "Class") -> DataFrame:
    """Rows whose class is of one of the archetypes; all rows, those of unknown
    classes too, where none or all four are named."""
    if not archetypes or len(set(archetypes)) >= 4:
        return rows
    return rows.where(F.coalesce(archetype_of(F.col(column)).isin(*archetypes), F.lit(False)))


def ranked_export(stats: DataFrame, window: DataFrame, tags: DataFrame, columns=DEFAULT_COLUMNS, sort: str = "Damage", archetypes=None) -> DataFrame:
    """The players of each fight in order of a column (names and classes up,
    numbers down): any columns of EXPORT_COLUMNS, filtered by archetype after the
    shares are taken.  tags(fight, combatant, kind, class)."""
    players = tags.where("kind = 'player'").select(*FIGHT, "combatant", F.coalesce("class", F.lit("")).alias("Class"))
    rows = stats.where("damage > 0 or healed > 0 or damage_taken > 0").join(players, [*FIGHT, "combatant"]).join(window.select(*FIGHT, "duration_s"), list(FIGHT))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(0.0)
    total = F.sum("damage").over(Window.partitionBy(*FIGHT))
    values = {
        "Time": personal_s(), "Damage": F.col("damage"), "Percent": F.when(total > 0, F.col("damage").cast("double") / total.cast("double")).otherwise(0.0), "Dps": per_second(F.col("damage"), F.col("duration_s")), "Hps": per_second(F.col("healed"), F.col("duration_s")),
        "Heals": F.col("healed"), "CritHeals": F.col("crit_heals"), "Cures": F.col("cures"), "PowerDrain": F.col("drained"), "PowerRep": F.col("replenished"), "Swings": F.col("swings"), "Hits": F.col("hits"), "Crits": F.col("crits"), "Misses": F.col("misses"), "Avoids": F.col("avoids"),
        "ToHit": part("hits", "swings"), "CritPct": part("crits", "hits"), "Taken": F.col("damage_taken"), "HealsTaken": F.col("heals_taken"), "Deaths": F.col("deaths"),
    }
    wanted = [c for c in EXPORT_COLUMNS if c in columns]
    by = {"Name": [F.lower("Name")], "Class": [F.lower("Class"), F.desc("Damage"), "Name"]}.get(sort, [F.desc(sort if sort in values else "Damage"), "Name"])
    named = rows.select(*FIGHT, F.col("combatant").alias("Name"), "Class", *[v.alias(f"_{k}") for k, v in values.items()]).withColumnsRenamed({f"_{k}": k for k in values})
    kept_rows = archetype_filter(named, archetypes)
    rank = F.row_number().over(Window.partitionBy(*FIGHT).orderBy(*by)).cast("long")
    return kept_rows.withColumn("rank", rank).select(*FIGHT, "rank", "Name", *wanted)


def combatant_grid(stats: DataFrame, window: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of a fight in three groups, allies, pets and enemies, without System,
    bystanders and those that did and suffered nothing."""
    group = F.when(F.col("kind") == "enemy", "enemy").when(F.col("kind") == "pet", "pet").otherwise("ally")
    rows = stats.where("damage > 0 or healed > 0 or damage_taken > 0").join(tags.where("kind not in ('system', 'bystander')"), [*FIGHT, "combatant"]).join(window.select(*FIGHT, "duration_s"), list(FIGHT))
    return rows.select(*FIGHT, "combatant", group.alias("side"), "class", "owner_name", personal_s().alias("personal_s"), "damage", "healed", "damage_taken", "deaths", per_second(F.col("damage"), F.col("duration_s")).alias("enc_dps"), per_second(F.col("healed"), F.col("duration_s")).alias("enc_hps"))


def metric_columns(rows: DataFrame, by: tuple[str, ...], metric: str) -> DataFrame:
    """The columns of a chart: each row's metric beside the average of its group,
    to the nearest whole number (halves to the even one)."""
    w = Window.partitionBy(*by)
    mean = F.sum(metric).over(w).cast("double") / F.count("*").over(w).cast("double")
    # A sum of quotients lies beside the half by a few last bits, by the order of its rows.
    half = F.abs(F.col("average") - F.floor("average") - 0.5) < F.greatest(F.lit(1e-12), F.abs("average") * 1e-14)
    return rows.withColumn("average", mean).withColumn("average", F.when(half, 2 * F.round(F.col("average") / 2)).otherwise(F.round("average")))


def fight_metric_columns(stats: DataFrame, fight_rows: DataFrame) -> DataFrame:
    """Two charts: allied rates of the fights of a zone (kind "fight"), and those of
    the allies of each fight (kind "ally", only where above 0)."""
    raid = metric_columns(fight_rows.select("source_id", "zone", "encounter_id", F.coalesce("title", F.lit("")).alias("label"), per_second(F.col("damage"), F.col("duration_s")).alias("value")), ("source_id", "zone"), "value")
    one = stats.where("ally and damage > 0").join(fight_rows.select(*FIGHT, "zone", "duration_s"), list(FIGHT)).select("source_id", "zone", "encounter_id", F.col("combatant").alias("label"), per_second(F.col("damage"), F.col("duration_s")).alias("value"))
    own = metric_columns(one, FIGHT, "value")
    columns = ("source_id", "zone", "encounter_id", "label", "value", "average")
    return raid.select(F.lit("fight").alias("kind"), *columns).unionByName(own.select(F.lit("ally").alias("kind"), *columns))


def avoidance_by_actor(kept: DataFrame, paired: DataFrame, window: DataFrame, enemies: DataFrame | None = None) -> DataFrame:
    """What became of the attacks on each combatant, by kind and by who turned them
    aside (landed, warded and stoneskin have no actor), with a row "avoided" of all that
    did neither land nor was warded.  estimate: what wards took, or what was avoided is
    worth, in whole points; effective_hps: the latter by the fight's seconds, in the row
    of all."""
    tried = _tried(kept, paired, enemies)
    auto, turned = F.col("category") == 1, ~F.col("kind").isin("landed", "warded")
    actor = F.when(F.col("kind").isin("landed", "warded", "stoneskin"), "-").otherwise(avoid_actor(F.col("extra"), F.col("victim")))
    rows = tried.withColumn("actor", actor).select(*FIGHT, "combatant", "category", "amount", "absorbed", F.explode(F.when(turned, F.array(F.struct("kind", "actor"), F.struct(F.lit("avoided").alias("kind"), F.lit("-").alias("actor")))).otherwise(F.array(F.struct("kind", "actor")))).alias("k"))
    counted = rows.groupBy(*FIGHT, "combatant", "k.kind", "k.actor").agg(F.count("*").alias("n"), count_if(auto).alias("_a"), count_if(~auto).alias("_s"), sum_if(F.lit(True), "absorbed").alias("_w"), *[c.alias(n) for n, c in _worth().items()])
    w = Window.partitionBy(*FIGHT, "combatant")
    kind = F.col("kind")
    avoided = F.coalesce(F.max(F.when(kind == "avoided", F.col("n"))).over(w), F.lit(0))
    attempts = F.sum(F.when(kind != "avoided", F.col("n"))).over(w)
    # Only rows of landed hits have these sums; each combatant has one such row at most.
    known = counted.withColumns({c: F.coalesce(F.max(F.when(kind == "landed", F.col(c))).over(w), F.lit(0)) for c in ("_ad", "_ah", "_sd", "_sh")}).withColumns({"attempts": attempts, "_avoided": avoided})
    worth = F.floor(_estimate(F.col("_a"), F.col("_s"))).cast("long")
    out = known.join(window.select(*FIGHT, "duration_s"), list(FIGHT))
    return out.select(
        *FIGHT, "combatant", "kind", "actor", "n", (F.col("n").cast("double") / F.col("attempts").cast("double")).alias("of_swings"),
        F.when(~kind.isin("landed", "warded"), F.col("n").cast("double") / F.greatest(F.col("_avoided"), F.lit(1)).cast("double")).alias("of_avoids"),
        F.when(kind == "warded", F.col("_w")).when(kind != "landed", worth).alias("estimate"), F.when(kind == "avoided", per_second(worth, F.col("duration_s"))).alias("effective_hps"),
    )


def lookup_combatant(stats: DataFrame, fight_rows: DataFrame, name: str) -> DataFrame:
    """Every fight in which a combatant did or suffered something, newest first."""
    own = stats.where((F.upper("combatant") == name.upper()) & F.expr("damage > 0 or healed > 0 or damage_taken > 0"))
    rows = own.drop("ally").join(fight_rows.select(*FIGHT, "title", "zone", "start_ts", "duration_s", "success"), list(FIGHT))
    return rows.select(*FIGHT, "title", "zone", "start_ts", "success", "damage", "healed", "damage_taken", "deaths", per_second(F.col("damage"), F.col("duration_s")).alias("enc_dps"), per_second(F.col("healed"), F.col("duration_s")).alias("enc_hps")).orderBy(F.desc("start_ts"), *FIGHT)


def success_ingredients(stats: DataFrame, fight_rows: DataFrame, least_s: int = 120, n: int = 8) -> DataFrame:
    """What the outcome follows from, for the n long fights of most damage: the
    feature is a short list."""
    sides = stats.groupBy(*FIGHT).agg(count_if(F.col("ally")).alias("allies"), count_if(F.col("ally") & (F.col("deaths") == 0)).alias("deathless"))
    title = stats.select(*FIGHT, F.col("combatant").alias("title"), F.col("deaths").alias("title_deaths"))
    rows = fight_rows.where(F.col("duration_s") >= least_s).join(sides, list(FIGHT)).join(title, [*FIGHT, "title"], "left")
    return rows.orderBy(F.desc("damage"), *FIGHT).limit(n).select(*FIGHT, "title", "duration_s", "damage", "success", "allies", "deathless", F.coalesce("title_deaths", F.lit(0)).alias("title_deaths"))
