"""Friend or foe, from the signed graph of who acts on whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from .ordered import in_order


def walk(owner: str, around: dict[str, dict[str, int]]) -> set[str]:
    """around[a][b]: the signed sum of what passed between a and b, seen from a.

    The owner starts at 0.  Pass after pass, everyone known so far adds the sums
    with their neighbours to the neighbours' standing (takes them off if their
    own isn't positive), in order of discovery and of name, until a pass finds
    nobody new.  Allies stand on the owner's side of 0."""
    standing = {owner: 0}
    known = 0
    while known < len(standing):
        known = len(standing)
        for name in tuple(standing):
            for other, value in sorted(around.get(name, {}).items()):
                toward = value if standing[name] > 0 else -value
                standing[other] = standing.get(other, 0) + toward
    side = -1 if standing[owner] < 0 else 1
    return {name for name, value in standing.items() if value * side > 0} | {owner}


def resolve_allies(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """The allied combatants (in upper case) of each encounter in which the
    log's owner acts or suffers; without the owner there are none.  A group is
    the summed edges of one encounter, at most a few hundred names squared."""
    owner = F.upper("owner")
    present = kept.where((F.upper("attacker") == owner) | (F.upper("victim") == owner)).select("source_id", "encounter_id", owner.alias("owner")).distinct()
    keyed = stored(present.join(edges, ["source_id", "encounter_id"], "left"))

    def group(rows):
        around: dict[str, dict[str, int]] = {}
        for r in rows:
            if None not in (r.src, r.dst, r.value):
                near = around.setdefault(r.src.upper(), {})
                near[r.dst.upper()] = near.get(r.dst.upper(), 0) + r.value
        return [(rows[0].source_id, rows[0].encounter_id, name) for name in sorted(walk(rows[0].owner, around))]

    return in_order(keyed, ("source_id", "encounter_id"), ("src", "dst"), group, "source_id string, encounter_id long, ally string", keyed.count())


def merged_ally_keys(allies: DataFrame, members: DataFrame) -> DataFrame:
    """The allies of a merged fight: those of any of its logs."""
    return allies.join(members, ["source_id", "encounter_id"]).select("fight_id", F.upper("ally").alias("ally")).distinct()


def mark_by(kept: DataFrame, rule) -> DataFrame:
    """kept with a_ally and v_ally by a rule on the name."""
    return kept.withColumns({"a_ally": rule(F.col("attacker")), "v_ally": rule(F.col("victim"))})


def mark(kept: DataFrame, allies: DataFrame) -> DataFrame:
    """kept with a_ally and v_ally by a table of each fight's allies, as
    resolve_allies gives it; a fight's allies are at most a few hundred names."""
    sets = allies.groupBy("source_id", "encounter_id").agg(F.collect_set(F.upper("ally")).alias("_allies"))
    told = lambda side: F.coalesce(F.array_contains("_allies", F.upper(side)), F.lit(False))
    return kept.join(sets, ["source_id", "encounter_id"], "left").withColumns({"a_ally": told("attacker"), "v_ally": told("victim")}).drop("_allies")
