"""What a boss does: casts, intervals, debuffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

VOLLEY_GAP, CAST_GAP = 2, 12
KEY = ("source_id", "encounter_id", "attacker", "ability")
MOB = ("zone", "attacker", "ability")


def mob_hits(kept: DataFrame, fights: DataFrame) -> DataFrame:
    """What enemies did to others by name of an ability, marked inferred where the
    log named nobody and the fight's title stands in; without a title such hits
    are left out.  Auto-attacks and kills are no abilities to time.  A mob has one
    spelling over all fights."""
    acts = kept.where("category in (1, 2) and not a_ally and ability not in ('Killing', 'Auto-Attack', '')")
    return one_name(stored(infer_caster(acts, fights).where("attacker <> 'Unknown'")))


#: Up to this many names in several spellings they are broadcast.
BROADCAST_NAMES = 100_000


def one_name(rows: DataFrame, name: str = "attacker") -> DataFrame:
    """rows with the least spelling of each name, whatever fight it comes from; only
    names that have several are looked up."""
    several = stored(rows.groupBy(F.upper(name).alias("_key")).agg(F.min(name).alias("_least"), F.max(name).alias("_most")).where("_least <> _most").drop("_most"))
    few = F.broadcast(several) if several.count() <= BROADCAST_NAMES else several
    return rows.join(few, F.upper(name) == F.col("_key"), "left").withColumn(name, F.coalesce("_least", name)).drop("_key", "_least")


def cast_volleys(hits: DataFrame) -> DataFrame:
    """Hits of a mob's ability in volleys (a hit more than 2 s after the one
    before starts one) and casts (a volley more than 12 s after the one before)."""
    order = Window.partitionBy(*KEY).orderBy("ts", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    new = (F.lag("ts").over(order).isNull() | (F.col("ts") - F.lag("ts").over(order) > VOLLEY_GAP)).cast("int")
    v = hits.withColumn("_n", new).withColumn("volley", F.sum("_n").over(upto))
    volleys = v.groupBy(*KEY, "volley").agg(F.min("ts").alias("volley_ts"), F.count("*").alias("hits"), F.countDistinct("victim").alias("targets"), F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).cast("long").alias("damage"))
    by_start = Window.partitionBy(*KEY).orderBy("volley_ts")
    cast = (F.lag("volley_ts").over(by_start).isNull() | (F.col("volley_ts") - F.lag("volley_ts").over(by_start) > CAST_GAP)).cast("int")
    return volleys.withColumn("_c", cast).withColumn("cast", F.sum("_c").over(by_start.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def casts(volleys: DataFrame) -> DataFrame:
    return volleys.groupBy(*KEY, "cast").agg(F.min("volley_ts").alias("cast_ts"), F.count("*").alias("volleys"), F.sum("hits").alias("hits"), F.max("targets").alias("targets"), F.sum("damage").alias("damage"))


def upper_median_of(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """The upper median of a column by key, from the counts of its values: no
    group holds more rows than it has different values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    place = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w))
    return place.where("_upto >= _all div 2 + 1").groupBy(*by).agg(F.min(value).alias("median"), F.first("_all").alias("n"))


def cast_gaps(cast_rows: DataFrame) -> DataFrame:
    """Gaps between casts within a fight: (..., prev_ts, cast_ts, gap)."""
    prev = F.lag("cast_ts").over(Window.partitionBy(*KEY).orderBy("cast_ts"))
    return cast_rows.withColumn("prev_ts", prev).where("prev_ts is not null").withColumn("gap", F.col("cast_ts") - F.col("prev_ts"))


def cast_intervals(cast_rows: DataFrame) -> DataFrame:
    """Per mob and ability the upper median and the least of the gaps."""
    gaps = cast_gaps(cast_rows)
    by = ("attacker", "ability")
    return upper_median_of(gaps, by, "gap").join(gaps.groupBy(*by).agg(F.min("gap").alias("least_s")), list(by)).select(*by, F.col("n").alias("gaps"), F.col("median").alias("median_s"), "least_s")


def status_attributions(hits: DataFrame, applies: DataFrame) -> DataFrame:
    """The status that a hit brought: of applies(fight, victim, seq, ts, effect,
    duration_s) the first in the log within two seconds after it.  Hits meet them
    by second."""
    near = hits.select(*KEY, "victim", F.col("seq").alias("hit_seq"), F.explode(F.sequence(F.col("ts"), F.col("ts") + VOLLEY_GAP)).alias("ts"))
    found = near.join(applies.select("source_id", "encounter_id", "victim", "ts", "seq", "effect", "duration_s"), ["source_id", "encounter_id", "victim", "ts"])
    first = F.min_by(F.struct("effect", "duration_s"), "seq")
    return found.groupBy(*KEY, "hit_seq").agg(first.alias("_a")).select(*KEY, "hit_seq", "_a.effect", "_a.duration_s")


def dominant_effect(attributed: DataFrame, cast_counts: DataFrame) -> DataFrame:
    """attributed(zone, attacker, ability, effect, duration_s), cast_counts(zone,
    attacker, ability, casts): the most frequent effect of an ability, if it came
    with 2 hits and a quarter of the casts at least, and the upper median of its
    durations between 0 and 120 s (both left out).  Ties go by name."""
    counts = attributed.groupBy(*MOB, "effect").agg(F.count("*").alias("n"))
    best = counts.groupBy(*MOB).agg(F.min(F.struct((-F.col("n")).alias("m"), "effect")).alias("_b")).select(*MOB, F.col("_b.effect").alias("effect"), (-F.col("_b.m")).alias("n"))
    kept_ = best.join(cast_counts.select(*MOB, "casts"), list(MOB)).where("n >= greatest(2, casts div 4)").select(*MOB, "effect")
    lasting = attributed.where("duration_s > 0 and duration_s < 120").join(kept_, [*MOB, "effect"])
    return kept_.join(upper_median_of(lasting, MOB, "duration_s").select(*MOB, F.col("median").alias("effect_s")), list(MOB), "left")


def type_labels(hits: DataFrame) -> DataFrame:
    """The damage types of a tenth of an ability's typed hits and more, the most
    frequent first."""
    typed = hits.where("amount > 0 and damage_type not in ('', 'none', 'avoided')").groupBy(*MOB, F.lower("damage_type").alias("t")).agg(F.count("*").alias("n"))
    share = typed.withColumn("_all", F.sum("n").over(Window.partitionBy(*MOB))).where("10 * n >= _all")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "t")))
    return share.groupBy(*MOB).agg(listed.alias("_t")).select(*MOB, F.array_join(F.col("_t.t"), ", ").alias("types"))


def mine_abilities(hits: DataFrame, zones: DataFrame, debuffs: DataFrame, applies: DataFrame | None = None) -> DataFrame:
    """Everything about a mob's ability in a zone: fights, casts, raw and base
    intervals, how long debuffs covered them, damage, targets a volley, volleys a
    cast, whether it is melee, a detriment (nine tenths of its hits without damage)
    or inferred (half its hits), its damage types and the effect that comes with it.
    hits: of mob_hits; zones(fight, zone); debuffs: of debuff_windows."""
    of_zone = lambda rows: rows.join(zones, ["source_id", "encounter_id"])
    hits = stored(hits.drop("zone"))
    zones = stored(zones.select("source_id", "encounter_id", "zone"))
    cast_rows = stored(casts(cast_volleys(hits)))
    # A fight's ability counts as inferred as a whole.
    some = hits.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum((F.col("amount") <= 0).cast("int")).alias("zero"), F.min((F.col("category") == 1).cast("int")).alias("melee"), F.max("inferred").alias("inferred"))
    told = of_zone(some).groupBy(*MOB).agg(F.sum("n").alias("_hits"), F.sum("zero").alias("_zero"), F.min("melee").alias("_melee"), F.sum(F.when(F.col("inferred"), F.col("n")).otherwise(0)).alias("_inferred"))
    sums = of_zone(cast_rows).groupBy(*MOB).agg(F.countDistinct("source_id", "encounter_id").alias("fights"), F.count("*").alias("casts"), F.sum("volleys").cast("long").alias("volleys"), F.sum("hits").cast("long").alias("hits"), F.sum("damage").cast("long").alias("damage"))
    covered = stored(of_zone(covered_intervals(cast_rows, debuffs)))
    raw = upper_median_of(covered, MOB, "gap").select(*MOB, F.col("median").alias("median_s"))
    base = upper_median_of(covered, MOB, "base_s").select(*MOB, F.col("median").alias("base_s"))
    least = covered.groupBy(*MOB).agg(F.min("gap").alias("least_s"), F.sum("covered_s").alias("_covered"), F.sum("gap").alias("_time"))
    out = sums.join(told, list(MOB)).join(raw, list(MOB), "left").join(base, list(MOB), "left").join(least, list(MOB), "left").join(type_labels(of_zone(hits)), list(MOB), "left")
    part = lambda a, b: F.col(a).cast("double") / F.col(b).cast("double")
    out = out.select(
        *MOB, "fights", "casts", "volleys", "hits", "damage", "median_s", "least_s", "base_s", F.when(F.col("_time") > 0, part("_covered", "_time")).otherwise(0.0).alias("coverage"),
        part("hits", "volleys").alias("avg_targets"), part("volleys", "casts").alias("ticks"), (F.col("_melee") == 1).alias("melee"), (10 * F.col("_zero") >= 9 * F.col("_hits")).alias("detriment"), (2 * F.col("_inferred") >= F.col("_hits")).alias("inferred"), F.coalesce("types", F.lit("")).alias("types"),
    )
    if applies is None:
        return out
    return out.join(dominant_effect(of_zone(status_attributions(hits, applies)), sums), list(MOB), "left")


def mined_top(mined: DataFrame, n: int = 10) -> DataFrame:
    """Two top lists of each mob: its n abilities of most damage, and its n most
    frequent detriments."""
    best = F.when(F.col("detriment"), F.col("casts")).otherwise(F.col("damage"))
    rank = F.row_number().over(Window.partitionBy("zone", "attacker", "detriment").orderBy(F.desc(best), "ability")).cast("long")
    return mined.withColumn("rank", rank).where(F.col("rank") <= n)


def mined_to_timers(mined: DataFrame) -> DataFrame:
    """Timer definitions from base intervals (else raw ones, else 30 s; halves to the
    even side): at least 5 s, a warning at a quarter, 3 to 10 s.  Filed by zone and
    mob, and bound to the mob unless its name was inferred."""
    whole = F.bround(F.coalesce("base_s", F.col("median_s").cast("double"), F.lit(30.0)), 0).cast("long")
    rows = mined.withColumn("_d", whole)
    return rows.select(F.col("ability").alias("name"), F.col("attacker").alias("category"), "zone", F.greatest(F.lit(5), F.col("_d")).alias("duration_s"), F.least(F.lit(10), F.greatest(F.lit(3), F.expr("_d div 4"))).alias("warning_s"), (~F.col("inferred")).alias("restrict_category"), F.lit(True).alias("only_master"), F.col("types").alias("damage_type"))


def debuff_windows(touches: DataFrame, lasts: int = 30, fraction: float = 0.5) -> DataFrame:
    """touches(key columns, victim, ts): stretches in which a debuff of `lasts`
    seconds holds on a victim and slows by `fraction`; touching ones merge."""
    by = ("source_id", "encounter_id", "victim")
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    reach = F.max(F.col("ts") + lasts).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("ts") > reach)).cast("int")
    runs = touches.withColumn("_n", new).withColumn("run", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("ts").alias("from_ts"), (F.max("ts") + lasts).alias("to_ts")).withColumn("fraction", F.lit(fraction))


def covered_intervals(cast_rows: DataFrame, windows: DataFrame) -> DataFrame:
    """For each gap between casts, how many seconds a debuff on the caster covered,
    and its length without the debuff's slowing.  Windows of a victim don't
    overlap, so seconds add up."""
    gaps = cast_gaps(cast_rows).select(*KEY, "prev_ts", "cast_ts", "gap")
    w = windows.select("source_id", "encounter_id", F.upper("victim").alias("_key"), "from_ts", "to_ts", "fraction")
    hit = gaps.withColumn("_key", F.upper("attacker")).join(w, ["source_id", "encounter_id", "_key"]).where("from_ts < cast_ts and to_ts > prev_ts")
    over = hit.groupBy(*KEY, "prev_ts", "cast_ts").agg(F.sum(F.least("cast_ts", "to_ts") - F.greatest("prev_ts", "from_ts")).cast("long").alias("covered_s"), F.max("fraction").alias("fraction"))
    covered, slow = F.coalesce("covered_s", F.lit(0)), F.coalesce("fraction", F.lit(0.5))
    base = (F.col("gap") - covered).cast("double") + covered.cast("double") / (1 + slow)
    return gaps.join(over, [*KEY, "prev_ts", "cast_ts"], "left").select(*KEY, "prev_ts", "cast_ts", "gap", covered.alias("covered_s"), base.alias("base_s"))


def class_votes(used: DataFrame, class_map: DataFrame) -> DataFrame:
    """used(combatant, ability): each distinct ability votes for its classes;
    the winner needs two votes, ties go by name."""
    votes = used.distinct().join(class_map, "ability").select("combatant", "ability", F.explode("classes").alias("class"))
    mapped = votes.groupBy("combatant").agg(F.countDistinct("ability").alias("mapped"))
    counts = votes.groupBy("combatant", "class").agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("combatant").orderBy(F.desc("votes"), "class"))
    return counts.withColumn("_r", best).where("_r = 1 and votes >= 2").join(mapped, "combatant").select("combatant", "class", "votes", (F.col("votes").cast("double") / F.col("mapped").cast("double")).alias("confidence"))


def infer_caster(hits: DataFrame, fights: DataFrame) -> DataFrame:
    """Hits of an unknown attacker count as the title's of their fight, marked inferred."""
    unknown = (F.col("attacker") == "Unknown") & F.col("title").isNotNull()
    named = hits.join(fights.select("source_id", "encounter_id", "title"), ["source_id", "encounter_id"], "left")
    return named.withColumns({"inferred": unknown, "attacker": F.when(unknown, F.col("title")).otherwise(F.col("attacker"))}).drop("title")
