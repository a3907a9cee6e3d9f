"""The same fight in several logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .ordered import in_order
from .sessions import dealt, islands

TOLERANCE = 30


def witnesses(kept: DataFrame, fights: DataFrame) -> DataFrame:
    """fights with `names`: their combatants but for log owners and Unknown."""
    owners = kept.select(F.upper("owner").alias("name")).distinct()
    names = kept.select("source_id", "encounter_id", F.explode(F.array(F.upper("attacker"), F.upper("victim"))).alias("name")).distinct().where("name <> 'UNKNOWN'").join(owners, "name", "left_anti")
    gathered = names.groupBy("source_id", "encounter_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return fights.join(gathered, ["source_id", "encounter_id"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def correlate_pairs(seen: DataFrame, tolerance: int = TOLERANCE, slot: int = 600) -> DataFrame:
    """Pairs of encounters of different logs in one zone whose windows lie
    within the tolerance and that share a witness.  Windows meet in time slots,
    so the join has equality keys."""
    low, high = F.expr(f"(start_ts - {tolerance}) div {slot}"), F.expr(f"(end_ts + {tolerance}) div {slot}")
    rows = seen.select(F.lower("zone").alias("zone"), "source_id", "encounter_id", "start_ts", "end_ts", F.explode("names").alias("name")).withColumn("slot", F.explode(F.sequence(low, high)))
    a = rows.select("zone", "slot", "name", F.col("source_id").alias("source_a"), F.col("encounter_id").alias("a"), F.col("start_ts").alias("sa"), F.col("end_ts").alias("ea"))
    b = rows.select("zone", "slot", "name", F.col("source_id").alias("source_b"), F.col("encounter_id").alias("b"), F.col("start_ts").alias("sb"), F.col("end_ts").alias("eb"))
    near = a.join(b, ["zone", "slot", "name"]).where(f"source_a < source_b and ea >= sb - {tolerance} and eb >= sa - {tolerance}")
    return near.select("source_a", "a", "source_b", "b").distinct()


def join_fights(rows: list[tuple], tolerance: int = TOLERANCE) -> list[int]:
    """rows (source, start, end, names) in closing order -> the number of the
    fight each joins: the newest that has no encounter of its source yet, whose
    window (widened by its members) is near, and that shares a witness."""
    open_fights: list[dict] = []
    out = []
    for source, start, end, names in rows:
        names = set(names)
        for fight in reversed(open_fights):
            near = end >= fight["start"] - tolerance and start <= fight["end"] + tolerance
            if near and source not in fight["sources"] and names & fight["names"]:
                break
        else:
            fight = {"n": len(open_fights), "start": start, "end": end, "sources": set(), "names": set()}
            open_fights.append(fight)
        fight["start"], fight["end"] = min(fight["start"], start), max(fight["end"], end)
        fight["sources"].add(source)
        fight["names"] |= names
        out.append(fight["n"])
    return out


def components(seen: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(source_id, encounter_id, component): encounters that may end up in one fight.

    In a zone, those that share a witness and follow each other within the tolerance
    are together; a component counts as one encounter with the window and the witnesses
    of all its members, until nothing more comes together.  So whatever a fight can
    grow to, in window and witnesses, lies in one component.  Each round is a window
    over the encounters of a witness in parts, and a hop over labels; no pairs are
    made, however common a witness is."""
    key = F.concat("source_id", F.lit("/"), F.col("encounter_id").cast("string"))
    rows = stored(seen.select("source_id", "encounter_id", key.alias("component"), F.lower("zone").alias("zone"), "start_ts", "end_ts", "names"))
    members = rows.select("source_id", "encounter_id", "component")
    nodes = rows.select("component", "zone", F.col("start_ts").alias("ts"), "end_ts", F.explode("names").alias("name"))
    while True:
        count = nodes.count()
        near = islands(nodes, tolerance, keys=("zone", "name"), order=("ts", "component"), until="end_ts", rows=count)
        least = F.min("component").over(Window.partitionBy("zone", "name", "island"))
        labels = stored(dealt(near, count, "zone", "name", "island").withColumn("_to", least).groupBy("component").agg(F.min("_to").alias("to")))
        if labels.where("to <> component").isEmpty():
            return members
        # Twice along the labels, so that chains shrink faster.
        for _ in range(2):
            labels = labels.join(labels.select(F.col("component").alias("to"), F.col("to").alias("_next")), "to").select("component", F.col("_next").alias("to"))
        labels = stored(labels)
        members = stored(members.join(labels, "component", "left").select("source_id", "encounter_id", F.coalesce("to", "component").alias("component")))
        moved = dealt(nodes.join(labels, "component").drop("component").withColumnRenamed("to", "component"), count, "component")
        whole = Window.partitionBy("component")
        nodes = stored(moved.withColumns({"ts": F.min("ts").over(whole), "end_ts": F.max("end_ts").over(whole)}).select("component", "zone", "ts", "end_ts", "name").distinct())


def correlate_fights(seen: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(source_id, encounter_id, fight_id).  What may end up together (see components)
    is replayed in closing order; other fights of a zone, however busy, aren't in the
    way."""
    rows = stored(seen.select("source_id", "encounter_id", "start_ts", "end_ts", "names"))
    found = rows.join(components(seen, tolerance), ["source_id", "encounter_id"])

    def replay(rows):
        joined = join_fights([(r.source_id, r.start_ts, r.end_ts, r.names) for r in rows], tolerance)
        ids: dict[int, str] = {}
        for r, n in zip(rows, joined):
            ids.setdefault(n, f"{r.source_id}/{r.encounter_id}")
        return [(r.source_id, r.encounter_id, ids[n]) for r, n in zip(rows, joined)]

    return in_order(found, ("component",), ("end_ts", "source_id", "encounter_id"), replay, "source_id string, encounter_id long, fight_id string", rows.count())


def merge_combatants(members: DataFrame, stats: DataFrame, owners: DataFrame) -> DataFrame:
    """Of each combatant of a merged fight the figures of one log: the own one,
    else the log that observed most, else the first to join."""
    rows = stats.join(members, ["source_id", "encounter_id"]).join(owners, "source_id")
    own = F.upper("combatant") == F.upper("owner")
    best = Window.partitionBy("fight_id", F.upper("combatant")).orderBy(F.desc(own.cast("int")), F.when(own, 0).otherwise(-F.col("observed")), "source_id", "encounter_id")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("fight_id", "combatant", F.col("source_id").alias("from_source"), "damage", "healed", "damage_taken")


def merged_fight(members: DataFrame, fights: DataFrame, combatants: DataFrame | None = None, allies: DataFrame | None = None, scripted: DataFrame | None = None) -> DataFrame:
    """A row a merged fight: title, zone and outcome of the longest member (a win if
    any log saw a scripted one), the widest window, the first expiry that a log
    knows, and the damage of the merged combatants(fight_id, combatant, damage) among
    the merged allies(fight_id, ally)."""
    rows = fights.join(members, ["source_id", "encounter_id"])
    if "instance_expiry" not in rows.columns:
        rows = rows.withColumn("instance_expiry", F.lit(None).cast("long"))
    key = ["source_id", "encounter_id"]
    told = rows.withColumn("_won", F.lit(False)) if scripted is None else rows.join(scripted.select(*key, F.lit(True).alias("_won")).distinct(), key, "left").withColumn("_won", F.coalesce("_won", F.lit(False)))
    longest = F.max_by(F.struct("source_id", "encounter_id", "title", "zone", "success"), F.struct("duration_s", (-F.col("end_ts")).alias("e"), "source_id", "encounter_id"))
    known = F.min(F.when(F.col("instance_expiry").isNotNull(), F.struct("end_ts", "source_id", "instance_expiry")))
    out = told.groupBy("fight_id").agg(longest.alias("p"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("logs"), F.max("_won").alias("_won"), known.alias("_k"))
    out = out.select("fight_id", F.col("p.source_id").alias("primary_source"), F.col("p.encounter_id").alias("primary_encounter"), "p.title", "p.zone", "start_ts", "end_ts", "logs", F.when(F.col("_won"), 1).otherwise(F.col("p.success")).alias("success"), F.col("_k.instance_expiry").alias("instance_expiry"))
    if combatants is None:
        return out
    friends = allies.select("fight_id", F.upper("ally").alias("_key"))
    damage = combatants.withColumn("_key", F.upper("combatant")).join(friends, ["fight_id", "_key"], "left_semi").groupBy("fight_id").agg(F.sum("damage").cast("long").alias("damage"))
    return out.join(damage, "fight_id", "left").withColumn("damage", F.coalesce("damage", F.lit(0)))
