"""The way from log lines to fights: parsed lines, their zones, encounters, allies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grammar
from ..operators import allies, sessions, stats
from ..sources import adapter
from ..sources.files import stored
from . import sql
from .registry import ally, register


def actions(lines: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """lines(source_id, owner, seq, ts, message) as swings: parsed, with the zone and
    instance in force.  Lines that tell no action stay, with category 0: they end
    fights."""
    carried = sessions.carry_zones(grammar.parse(lines), seeds)
    return carried.withColumn("category", F.coalesce("category", F.lit(0))).drop("zone_entered", "lockout_s", "message", "family")


def encounters(lines: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The actions within encounters, with a_ally and v_ally from the walk over who
    acted on whom."""
    kept = stored(sessions.segment(actions(lines, seeds)))
    return allies.mark(kept, allies.resolve_allies(kept, stats.ally_edges(kept)))


# --- the adapter's lines, with a line of travel after every hundredth ----------------
def _lines(spark, sf_dir):
    lines = adapter.lines(spark, sf_dir).withColumn("seq", F.col("seq") * 10)
    moves = adapter.swings(spark, sf_dir).where("seq % 100 = 0").select("source_id", "owner", (F.col("seq") * 10 + 1).alias("seq"), F.concat(F.lit("("), F.col("ts").cast("string"), F.lit(")[x] You have entered "), "zone", F.lit(".")).alias("raw"))
    return grammar.parse_header(lines.unionByName(moves)).drop("raw")


def _fights(spark, sf_dir):
    from ..operators import reports

    return reports.fights(allies.mark_by(sessions.segment(actions(_lines(spark, sf_dir))), ally))


# What the text doesn't tell: drains, who stunned, whether a blow without damage was critical.
_TOLD = sql.TITLED.replace("\n h0 as", "\nh0 as").replace("h0 as (select *, (category", """sz as (select *, max(case when seq%100=0 then seq end) over (partition by source_id order by seq rows between unbounded preceding and 1 preceding) as zs from s),
st as (select a.* exclude (zs) replace (a.seq*10 as seq, coalesce(b.zone, '') as zone, case when a.category=10 then 0 else a.category end as category, case when a.category=30 then 'Unknown' else a.attacker end as attacker, a.critical and a.damage_type<>'none' as critical) from sz a left join s b on b.source_id=a.source_id and b.seq=a.zs),
h0 as (select *, (category""").replace("as hostile from s)", "as hostile from st)")
register("line_fights", _fights, _TOLD, "select * from fights")
