"""The archive: encounters, combatants and swings as Parquet, and its upkeep.

Every change is a rewrite of rows, expressed as a filter or an anti join."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_boss_title, rounded_percent, rounded_rate
from ..sources.files import stored
from .stats import OUT_REF, stat_columns

IDENTITY = ("source_id", "owner", "start_ts", "end_ts", "title")
KEY = ("source_id", "encounter_id")
TABLES = ("encounters", "combatants", "swings")


def _stored_at(spark: SparkSession, path: str) -> tuple[DataFrame, ...] | None:
    try:
        return tuple(spark.read.parquet(f"{path}/{t}") for t in TABLES)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_archive(path: str, fights: DataFrame, combatants: DataFrame, swings: DataFrame) -> None:
    """Add fights with their combatants and swings to the archive, by zone.  A fight
    is a unit: one that is there stays, unless it now has more swings; then it is
    added again and the older rows are passed over when read."""
    counts = swings.groupBy(*KEY).agg(F.count("*").alias("n_swings"))
    new = fights.join(counts, list(KEY))
    old = _stored_at(fights.sparkSession, path)
    if old is not None:
        had = old[0].groupBy(*KEY).agg(F.max("n_swings").alias("_had"))
        new = new.join(had, list(KEY), "left").where("_had is null or n_swings > _had").drop("_had")
    new = stored(new)
    unit = new.select(*KEY, "zone", "n_swings")
    # The encounters come last: what was written of a unit before counts only with them.
    swings.drop("zone").join(unit, list(KEY)).write.mode("append").partitionBy("zone").parquet(f"{path}/swings")
    combatants.join(unit, list(KEY)).write.mode("append").partitionBy("zone").parquet(f"{path}/combatants")
    new.write.mode("append").partitionBy("zone").parquet(f"{path}/encounters")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(encounters, combatants, swings), of each fight the fullest version."""
    encounters, combatants, swings = _stored_at(spark, path)
    best = encounters.groupBy(*KEY).agg(F.max("n_swings").alias("n_swings"))
    full = lambda t: t.join(best, [*KEY, "n_swings"], "left_semi").drop("n_swings")
    return encounters.join(best, [*KEY, "n_swings"], "left_semi"), full(combatants), full(swings)


def dedupe_encounters(encounters: DataFrame, id_column: str = "id") -> DataFrame:
    """The oldest row of each identity."""
    w = Window.partitionBy(*IDENTITY).orderBy(id_column)
    return encounters.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def find_encounter(encounters: DataFrame, identities: DataFrame) -> DataFrame:
    """The encounters of these identities; a missing title equals a missing one."""
    wanted = identities.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY]).distinct()
    return encounters.join(wanted, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY], "left_semi")


def upsert_encounters(held: DataFrame, new: DataFrame) -> DataFrame:
    """A fight parsed again replaces the old row only with more swings."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*IDENTITY).orderBy(F.desc("n_swings"), "_new")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def prune_trash(encounters: DataFrame, cutoff_ts: int) -> DataFrame:
    return encounters.where(is_boss_title(F.col("title")) | (F.col("start_ts") >= cutoff_ts))


def delete_encounters(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select(*KEY), list(KEY), "left_anti")


def collapse_mirrors(encounters: DataFrame, merged: DataFrame) -> DataFrame:
    """Of merged fights only the primary log's encounter."""
    return encounters.join(merged.select(F.col("primary_source").alias("source_id"), F.col("primary_encounter").alias("encounter_id")), list(KEY), "left_semi")


def archived_zones(encounters: DataFrame) -> DataFrame:
    return encounters.where(is_boss_title(F.col("title"))).groupBy(F.lower("zone").alias("key")).agg(F.min("zone").alias("zone")).select("zone")


def search_archive(encounters: DataFrame, text: str | None = None, zone: str | None = None, since: int | None = None, bosses: bool = False, limit: int | None = None) -> DataFrame:
    """Newest first; the limit is the caller's page."""
    out = encounters
    if text:
        out = out.where(F.lower("title").contains(text.lower()) | F.lower("zone").contains(text.lower()))
    if zone:
        out = out.where(F.col("zone") == zone)
    if since is not None:
        out = out.where(F.col("start_ts") >= since)
    if bosses:
        out = out.where(is_boss_title(F.col("title")))
    out = out.orderBy(F.desc("start_ts"), *KEY)
    return out.limit(limit) if limit else out


def recent_restore(encounters: DataFrame, boss_since: int, trash_since: int, cap: int = 150) -> DataFrame:
    """What a session starts with: recent bosses and trash, capped by design."""
    boss = is_boss_title(F.col("title"))
    pick = lambda rows: rows.orderBy(F.desc("start_ts"), *KEY).limit(cap)
    return pick(pick(encounters.where(boss & (F.col("start_ts") >= boss_since))).unionByName(pick(encounters.where(~boss & (F.col("start_ts") >= trash_since)))))


def payload_id():
    """Eight hex digits that name an upload."""
    return F.substring(F.sha2(F.concat_ws("|", "owner", "zone", "title", "start_ts", "n_combatants"), 256), 1, 8)


def _utc(ts):
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payload_combatants(stats: DataFrame, fights: DataFrame) -> DataFrame:
    """The combatants of each upload, those of most damage first."""
    own = F.coalesce(F.col("last_ts") - F.col("first_ts"), F.lit(0))
    # Who only suffers has no time of its own: the fight's start stands in.
    start = F.coalesce("first_ts", "fight_ts")
    s = stats.join(fights.select(*KEY, F.col("start_ts").alias("fight_ts"), "duration_s"), list(KEY))
    d, h, n = F.col("damage"), F.col("healed"), F.col("duration_s")
    whole = ("damage", "kills", "healed")
    return s.select(
        *KEY, F.struct((-d).alias("rank"), F.col("first_seen").alias("seen")).alias("_seen"), F.col("combatant").alias("name"), F.when(F.col("ally"), "T").otherwise("F").alias("ally"), _utc(start).alias("starttime"), _utc(F.coalesce("last_ts", start)).alias("endtime"), own.alias("duration"),
        *whole, F.col("crit_heals").alias("critheals"), "heals", F.col("cures").alias("curedispels"), F.col("drained").alias("powerdrain"), F.col("replenished").alias("powerreplenish"),
        rounded_rate(d, own).alias("dps"), rounded_rate(d, n).alias("encdps"), rounded_rate(h, n).alias("enchps"), "hits", F.col("crits").alias("crithits"), F.col("avoids").alias("blocked"), "misses", "swings", F.col("heals_taken").alias("healstaken"), F.col("damage_taken").alias("damagetaken"), "deaths", rounded_percent(F.col("hits"), F.col("swings")).alias("tohit"),
    )


_FIGURES = ("damage", "encdps", "median", "minhit", "maxhit", "hits", "crithits", "blocked", "misses", "swings")


def payload_figures(fanned: DataFrame, fights: DataFrame) -> DataFrame:
    """A row for each outgoing bucket of a combatant (ability All), and in the bucket of
    everything outgoing one for each ability, so that every action counts once there.
    The upper median comes from counts of values, which tasks combine before they
    send anything."""
    sides = fanned.where("direction = 'out'").withColumn("ability", F.when(F.col("bucket") == OUT_REF, F.col("ability")).otherwise("All"))
    median = F.expr("percentile_disc(0.5) within group (order by case when amount >= 0 then amount end desc)").cast("long")
    out = sides.groupBy(*KEY, "combatant", "bucket", "ability").agg(*[x.alias(k) for k, x in stat_columns().items()], F.coalesce(median, F.lit(0).cast("long")).alias("median"), F.min(F.struct("seq", "category"))["category"].alias("swingtype"), F.min("seq").alias("_seen"))
    out = out.join(fights.select(*KEY, "duration_s"), list(KEY))
    return out.withColumns({"encdps": rounded_rate(F.col("damage"), F.col("duration_s")), "starttime": _utc("first_ts"), "endtime": _utc("last_ts")}).withColumnsRenamed({"min_hit": "minhit", "max_hit": "maxhit", "crits": "crithits", "avoids": "blocked"})


def _typed(figures: DataFrame) -> DataFrame:
    """Both lists of each fight, damage types and attack types, in one grouping."""
    damage = F.struct("_seen", "combatant", F.col("bucket").alias("type"), "starttime", "endtime", *_FIGURES)
    attack = F.struct("_seen", F.col("combatant").alias("attacker"), F.col("ability").alias("type"), "swingtype", *_FIGURES)
    whole = F.col("bucket") == OUT_REF
    bare = lambda rows: F.transform(F.sort_array(rows), lambda x: x.dropFields("_seen"))
    lists = figures.groupBy(*KEY).agg(F.collect_list(F.when(~whole, damage)).alias("d"), F.collect_list(F.when(whole, attack)).alias("a"))
    none = lambda rows: F.when(F.size(rows) > 0, rows)
    return lists.select(*KEY, none(bare("d")).alias("damage_types"), none(bare("a")).alias("attack_types"))


def payloads(kept: DataFrame, fanned: DataFrame, fights: DataFrame, stats: DataFrame, server: str = "") -> DataFrame:
    """One upload document for each titled fight: logger, encounter, combatants,
    damage types and attack types."""
    titled = fights.where("title is not null")
    owners = kept.groupBy(*KEY).agg(F.first("owner").alias("owner"))
    head = titled.join(owners, list(KEY))
    n = F.col("duration_s")
    rate = F.when(n > 0, F.col("damage").cast("double") / n.cast("double")).otherwise(0.0)
    encounter = F.struct(payload_id().alias("encid"), "title", F.nullif("zone", F.lit("")).alias("zone"), _utc("start_ts").alias("starttime"), _utc("end_ts").alias("endtime"), n.alias("duration"), "damage", rate.alias("encdps"), "kills", "deaths", "success")
    parts = [_listed(payload_combatants(stats, titled), "combatants"), _typed(payload_figures(fanned, titled))]
    out = head.select(*KEY, F.col("owner").alias("logger_name"), F.lit(server).alias("logger_server"), encounter.alias("encounter"))
    for part in parts:
        out = out.join(part, list(KEY), "left")
    return out


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """The rows of each fight as one array, as they first appear in it."""
    fields = [c for c in rows.columns if c not in (*KEY, "_seen")]
    listed = F.sort_array(F.collect_list(F.struct("_seen", *fields)))
    return rows.groupBy(*KEY).agg(F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias(name))


def write_payloads(documents: DataFrame, path: str) -> None:
    """One JSON document a line; ids that are there already aren't written again."""
    old = None
    try:
        old = documents.sparkSession.read.schema("encounter struct<encid:string>").json(path).select("encounter.encid").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = documents if old is None else documents.join(old, documents["encounter.encid"] == old["encid"], "left_anti")
    new.drop(*KEY).write.mode("append").json(path)
