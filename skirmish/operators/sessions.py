"""Encounters: sessions of hostile actions within a source.

A hostile action opens an encounter; any line ends it whose stamp lies more
than `idle` seconds after the last hostile one.  Lines count in file order,
stamps may run backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_hostile, is_self_damage

IDLE = 6
#: Rows of a source that a window handles before parts are stitched together.
PART_ROWS = 100_000
#: Rows that a task of a machine or a window sorts; with those of `segment` they take some
#: 4 KB each.
TASK_ROWS = 150_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as so many rows need, so that a task's memory
    doesn't grow with the log; as it is where the session's partitions do."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _beside(rows: DataFrame, few: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Joins on equal keys, null with null."""
    named = few.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)})
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return rows.join(named, on).drop(*[f"_k{i}" for i in range(len(keys))])


def islands(swings: DataFrame, idle=IDLE, part_rows: int = PART_ROWS, keys: tuple[str, ...] = ("source_id",), order: tuple[str, ...] = ("seq",), until: str = "ts", rows: int | None = None) -> DataFrame:
    """Adds island: the seq of the last line at or before this one that comes
    more than `idle` after every earlier line of its source.  No encounter
    crosses an island, so one giant log is worked on in parallel.  Windows run
    over parts of a source; only a row a part runs over the whole source.
    Other keys and orders do for other machines with a bounded memory; rows
    without a key keep to themselves, as in a group.  Rows that last name the
    column of their end in `until`.  idle may be a column that is constant by key.
    rows: how many there are, if that is known; parts are dealt to as many tasks as
    they need."""
    s = swings.withColumn("_part", F.expr(f"{order[0]} div {int(part_rows)}"))
    by_part = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    by_source = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = s.groupBy(*keys, "_part").agg(F.max(until).alias("_top")).select(*keys, "_part", F.max("_top").over(by_source).alias("_earlier"))
    s = dealt(_beside(s, tops, (*keys, "_part")), swings.count() if rows is None else rows, *keys, "_part")
    latest = F.greatest(F.max(until).over(before), F.col("_earlier"))
    s = s.withColumn("_cut", F.when(latest.isNull() | (F.col("ts") - latest > idle), F.col(order[0])))
    carried = s.groupBy(*keys, "_part").agg(F.max("_cut").alias("_c")).select(*keys, "_part", F.max("_c").over(by_source).alias("_carried"))
    within = F.max("_cut").over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    return _beside(s.withColumn("_own", within), carried, (*keys, "_part")).withColumn("island", F.coalesce("_own", "_carried")).drop("_part", "_earlier", "_cut", "_own", "_carried")


def segment(swings: DataFrame, idle: int = IDLE, part_rows: int = PART_ROWS) -> DataFrame:
    """The actions within encounters, with encounter_id (the seq of the first
    hostile action) and time_sorter (the place in the encounter).  Names that differ in
    case only are one combatant, under the first spelling of the fight.  Where the
    session's number of partitions would give a task more than TASK_ROWS, islands and
    fights are dealt to more of them."""
    rows = swings.count()
    s = dealt(islands(swings, idle, part_rows, rows=rows).withColumn("hostile", is_hostile()), rows, "source_id", "island")
    order = Window.partitionBy("source_id", "island").orderBy("seq")
    s = s.withColumn("_hg", F.sum(F.col("hostile").cast("int")).over(order))
    run = Window.partitionBy("source_id", "island", "_hg").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_hts", F.first("ts").over(run)).withColumn("_top", F.max("ts").over(run))
    ended = (F.col("_hg") == 0) | (F.col("_top") - F.col("_hts") > idle)
    opens = F.col("hostile") & ((F.col("_hg") == 1) | (F.greatest(F.lag("_top").over(order), F.col("ts")) - F.lag("_hts").over(order) > idle))
    s = s.withColumn("_open", F.when(opens, F.col("seq")))
    s = s.withColumn("encounter_id", F.last("_open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Fights lie within islands: windows keyed by both leave the rows where they are.
    fight = ("source_id", "island", "encounter_id")
    kept = one_spelling(s.where(F.col("hostile") | ((F.col("category") != 0) & ~ended)), fight)
    place = F.row_number().over(Window.partitionBy(*fight).orderBy("seq"))
    out = kept.withColumn("time_sorter", place.cast("long")).drop("island", "_hg", "_hts", "_top", "_open")
    # Dealt by fight once more, what is grouped by fight next stays in as many tasks.
    return dealt(out, rows, "source_id", "encounter_id")


def one_spelling(kept: DataFrame, fight: tuple[str, ...] = ("source_id", "encounter_id")) -> DataFrame:
    """kept with attacker and victim in the spelling in which a fight first has them.
    Damage to oneself makes its victim known only.  Each fight's first spellings are
    gathered once (a value a name) beside its rows, which don't move if they are
    partitioned by some of the columns of `fight`."""
    a, v = F.upper("attacker"), F.upper("victim")
    own = F.coalesce(is_self_damage(), F.lit(False))
    named = kept.withColumns({"_ak": a, "_vk": v})
    first = lambda key, when: F.min(F.when(when, F.col("seq"))).over(Window.partitionBy(*fight, key))
    named = named.withColumn("_a1", ~own & (F.col("seq") == first("_ak", ~own))).withColumn("_v1", F.col("seq") == first("_vk", F.lit(True)))
    told = lambda flag, key, at, name: F.collect_list(F.when(F.col(flag), F.struct(F.col(key).alias("k"), (F.col("seq") * 2 + at).alias("at"), F.col(name).alias("name")))).over(Window.partitionBy(*fight))
    known = F.concat(told("_a1", "_ak", 0, "attacker"), told("_v1", "_vk", 1, "victim"))
    pick = lambda key, name: F.coalesce(F.array_min(F.transform(F.filter("_known", lambda n: n["k"] == F.col(key)), lambda n: F.struct(n["at"].alias("at"), n["name"].alias("name"))))["name"], F.col(name))
    spelled = named.withColumn("_known", known).withColumns({"attacker": pick("_ak", "attacker"), "victim": pick("_vk", "victim")})
    return spelled.drop("_ak", "_vk", "_a1", "_v1", "_known")


def encounter_zone(kept: DataFrame) -> DataFrame:
    """The zone a fight started in."""
    return kept.groupBy("source_id", "encounter_id").agg(F.min_by("zone", "seq").alias("zone"))


def encounter_window(kept: DataFrame) -> DataFrame:
    """start: first outgoing action; end: last damage of an ally (of anyone if no
    ally takes part), a kill included; never before the start.  kept: actions with
    a_ally and v_ally."""
    own = F.col("category").isin(1, 2) & (F.upper("attacker") == F.upper("victim"))
    damage = F.col("category").isin(1, 2) & ~own
    ally_end = F.max(F.when(damage & F.col("a_ally"), F.col("ts")))
    end = F.when(F.max(F.col("a_ally") | F.col("v_ally")), ally_end).otherwise(F.max(F.when(damage, F.col("ts"))))
    start = F.min(F.when(~own, F.col("ts")))
    return kept.groupBy("source_id", "encounter_id").agg(start.alias("start_ts"), F.greatest(start, F.coalesce(end, start)).alias("end_ts")).withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))


EXPIRY_GAP_S = 90 * 60


def zone_runs(fights: DataFrame) -> DataFrame:
    """fights(source_id, encounter_id, zone, start_ts): adds run, counting the
    stretches of one zone in a source's history."""
    order = Window.partitionBy("source_id").orderBy("start_ts", "encounter_id")
    change = (~F.lower("zone").eqNullSafe(F.lower(F.lag("zone").over(order)))).cast("int")
    return fights.withColumn("_c", change).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def instance_runs(runs: DataFrame) -> DataFrame:
    """runs with instance_expiry: a run is split where another instance of the zone
    begins; adds instance, its number in the run.  Only stretches of one expiry
    (as told, they differ by an hour) go through the fold, in order."""
    order = Window.partitionBy("source_id", "run").orderBy("start_ts", "encounter_id")
    # The expiry in force: that of the fight, else of the one before.
    r = runs.withColumn("_known", F.last("instance_expiry", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = (F.lag(F.lit(1)).over(order).isNull() | ~F.col("_known").eqNullSafe(F.lag("_known").over(order))).cast("int")
    r = r.withColumn("_new", new).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = r.where("_new = 1").groupBy("source_id", "run").agg(F.sort_array(F.collect_list(F.struct("_stretch", "_known"))).alias("_s"))

    def fold(acc, x):
        other = (F.abs(x["_known"] - acc["known"]) > EXPIRY_GAP_S) & x["_known"].isNotNull() & acc["known"].isNotNull()
        n = acc["n"] + F.coalesce(other, F.lit(False)).cast("int")
        known = F.when(F.coalesce(other, F.lit(False)), x["_known"]).otherwise(F.coalesce(acc["known"], x["_known"]))
        return F.struct(n.alias("n"), known.alias("known"), F.concat(acc["out"], F.array(F.struct(x["_stretch"].alias("_stretch"), n.alias("instance")))).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("known"), F.array().cast("array<struct<_stretch:bigint,instance:int>>").alias("out"))
    told = stretches.select("source_id", "run", F.explode(F.aggregate("_s", start, fold, lambda acc: acc["out"])).alias("_t")).select("source_id", "run", "_t.*")
    return r.join(told, ["source_id", "run", "_stretch"]).drop("_known", "_new", "_stretch")


def day_sections(runs: DataFrame) -> DataFrame:
    """Each run with the day of its latest fight."""
    return runs.groupBy("source_id", "run", "zone").agg(F.count("*").alias("fights"), F.to_date(F.timestamp_seconds(F.max("start_ts"))).cast("string").alias("day"))


LOCKOUT_WITHIN_S = 10


def carry_zones(parsed: DataFrame, seeds: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """parsed lines with the zone and the instance's expiry in force at each: the
    last zone entered at or before it, and the end of the lockout told up to 10 s
    after that entry.  seeds(source_id, zone, instance_expiry): what held before
    the first line.  Windows run over parts of a source; only a row a part runs
    over the whole source."""
    s = parsed.withColumn("_part", F.expr(f"seq div {int(part_rows)}"))
    entry = F.when(F.col("zone_entered").isNotNull(), F.struct("seq", "ts", F.col("zone_entered").alias("zone")))
    last = _carried(s, entry, ("source_id",))
    # A lockout counts for the entry before it; the last one that counts holds until the next entry.
    in_time = F.col("lockout_s").isNotNull() & (F.col("ts") - F.col("_entry.ts")).between(0, LOCKOUT_WITHIN_S)
    told = F.when(in_time, F.struct("seq", F.col("_entry.seq").alias("of"), (F.col("ts") + F.col("lockout_s")).alias("expiry")))
    out = _carried(last.withColumnRenamed("_last", "_entry"), told, ("source_id",))
    expiry = F.when(F.col("_last.of") == F.col("_entry.seq"), F.col("_last.expiry"))
    zone = F.col("_entry.zone")
    if seeds is not None:
        seed = seeds.select(F.col("source_id").alias("_s"), F.col("zone").alias("_zone0"), F.col("instance_expiry").alias("_expiry0"))
        out = out.join(seed, F.col("source_id") == F.col("_s"), "left")
        expiry = F.when(F.col("_entry").isNull(), F.col("_expiry0")).otherwise(expiry)
        zone = F.coalesce(zone, "_zone0")
    return out.withColumns({"zone": F.coalesce(zone, F.lit("")), "instance_expiry": expiry}).drop("_part", "_entry", "_last", "_s", "_zone0", "_expiry0")


def _carried(s: DataFrame, value, keys: tuple[str, ...]) -> DataFrame:
    """Adds _last: the last value (a struct that starts with seq) at or before a row."""
    s = s.withColumn("_value", value)
    by_part = Window.partitionBy(*keys, "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    by_source = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = s.groupBy(*keys, "_part").agg(F.max("_value").alias("_top")).select(*keys, "_part", F.max("_top").over(by_source).alias("_before"))
    rows = _beside(s.withColumn("_own", F.max("_value").over(by_part)), tops, (*keys, "_part"))
    return rows.withColumn("_last", F.coalesce("_own", "_before")).drop("_value", "_own", "_before")


def encounter_instance(kept: DataFrame) -> DataFrame:
    """The zone and the instance's expiry at the start of each fight."""
    return kept.groupBy("source_id", "encounter_id").agg(F.min(F.struct("seq", "zone", "instance_expiry")).alias("o")).select("source_id", "encounter_id", "o.zone", "o.instance_expiry")
