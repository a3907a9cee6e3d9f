"""Recast timers: which definition an action starts, and the bars that follow.

The choice of a definition looks at one action only and is a join.  Bars of a
source depend on each other (debuffs of their caster, deaths), so they run
through `advance`, which batch and streaming jobs share.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_stretches
from .rules import BROADCAST_RULES

DEFINITION = "ord long, name string, category string, zone string, enabled boolean, duration_s int, warning_s int, remove_s int, absolute boolean, restrict_me boolean, restrict_category boolean, modable boolean, panel1 boolean, panel2 boolean"
BARS = "source_id string, timer_key string, timer string, caster string, start_ts long, base_s long, planned_s long, length_s long, warned_ts long, expired_ts long, gone_ts long, replaced boolean, panel1 boolean, panel2 boolean, lengths array<struct<from_ts:bigint,length_s:bigint>>"

#: Debuffs that stretch their victim's recasts (share, seconds).
DEBUFFS = {"traumatic swipe": (0.5, 30)}
#: Hits this close to the last one belong to the same cast; a
#: dispel or the caster's death this soon after the start takes the stretch back.
SAME_CAST, DISPEL_GRACE, DEATH_GRACE = 12, 1, 2
TAKEN = ("name", "category", "zone", "duration_s", "warning_s", "remove_s", "absolute", "restrict_me", "modable", "panel1", "panel2")


def choose_timers(notices: DataFrame, definitions: DataFrame) -> DataFrame:
    """notices(timer, attacker, victim, zone, rule_zone, rule_category, ...) with
    the definition of that name that fits best, as a struct `chosen` (null if
    none does) and its `tier`: 6 filed exactly like the rule that asks, 5 and 4
    restricted to its category (with or without the zone), 3 to 0 others by
    category and zone.  The last of a tier wins."""
    fields = F.struct("ord", "restrict_category", *TAKEN)
    named = definitions.where("enabled").groupBy(F.lower("name").alias("_name")).agg(F.collect_list(fields).alias("_defs"))
    if definitions.count() <= BROADCAST_RULES:
        named = F.broadcast(named)
    around = F.array(F.lower("attacker"), F.lower("victim"), F.lower("zone"))

    def graded(d):
        filed = F.transform(F.split(F.lower(d["category"]), r"\|"), lambda c: F.trim(c))
        category = F.coalesce(F.exists(filed, lambda c: (c != "") & F.array_contains(F.array_compact(around), c)), F.lit(False))
        zone = F.coalesce((d["zone"] != "") & (F.lower(d["zone"]) == F.lower("zone")), F.lit(False))
        asked = (F.coalesce("rule_zone", F.lit("")) != "") | (F.coalesce("rule_category", F.lit("")) != "")
        exact = asked & (F.lower(d["zone"]) == F.lower(F.coalesce("rule_zone", F.lit("")))) & F.array_contains(filed, F.lower(F.coalesce("rule_category", F.lit(""))))
        loose = F.when(~d["restrict_category"], 2 * category.cast("int") + zone.cast("int")).when(category, 4 + zone.cast("int"))
        return F.struct(F.when(exact, 6).otherwise(loose).alias("tier"), d["ord"].alias("ord"), d.alias("d"))

    best = F.array_max(F.filter(F.transform("_defs", graded), lambda g: g["tier"].isNotNull()))
    # Through a generator the grades are computed once, however many fields are read.
    joined = notices.join(named, F.lower("timer") == F.col("_name"), "left").withColumn("_best", F.explode(F.array(best)))
    return joined.withColumns({"tier": F.col("_best.tier"), "chosen": F.col("_best.d")}).drop("_name", "_defs", "_best")


def linked_requests(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """matches(source_id, seq, ts, rule, zone) of rules(rule, starts_timer,
    timer_name, zone, category): the timers they ask for."""
    asking = rules.where("starts_timer").select("rule", F.col("timer_name").alias("timer"), F.col("zone").alias("rule_zone"), F.col("category").alias("rule_category"))
    asking = F.broadcast(asking) if rules.count() <= BROADCAST_RULES else asking
    nobody = F.lit("None")
    return matches.join(asking, "rule").select("source_id", "seq", "ts", "zone", "timer", "rule_zone", "rule_category", nobody.alias("attacker"), nobody.alias("victim"))


def timer_steps(swings: DataFrame, definitions: DataFrame, requests: DataFrame | None = None, debuffs: dict = DEBUFFS) -> DataFrame:
    """What moves timers, in the order of (seq, step): timers to start, debuffs,
    cures of debuffs and deaths.  A rule's request precedes the action of its line."""
    known = lambda c: F.lower(c).isin(*debuffs) if debuffs else F.lit(False)
    none = F.lit(None).cast("string")
    dead = F.col("amount") == -10
    base = swings.select(
        "source_id", "seq", F.lit(1).alias("step"), "ts", "zone", "attacker", "victim", F.when(~dead, F.col("ability")).alias("timer"), none.alias("rule_zone"), none.alias("rule_category"),
        ((F.col("attacker") == F.col("owner")) | (F.col("victim") == F.col("owner"))).alias("own"),
        F.when(~dead & known(F.col("ability")), F.lower("ability")).alias("debuff"),
        F.when((F.col("category") == 20) & known(F.col("damage_type")), F.lower("damage_type")).alias("cured"),
        (dead & (F.coalesce("extra", F.lit("")) != "pet-death")).alias("death"),
    )
    if requests is not None:
        asked = requests.select("source_id", "seq", F.lit(0).alias("step"), "ts", "zone", "attacker", "victim", "timer", "rule_zone", "rule_category", F.lit(True).alias("own"), none.alias("debuff"), none.alias("cured"), F.lit(False).alias("death"))
        base = base.unionByName(asked)
    steps = choose_timers(base, definitions).where("chosen is not null or debuff is not null or cured is not null or death")
    return steps.select("source_id", "seq", "step", "ts", F.lower("attacker").alias("attacker"), F.lower("victim").alias("victim"), "own", "debuff", "cured", "death", *[F.col(f"chosen.{c}").alias(c) for c in TAKEN])


def _closed(bar: dict, until: float | None = None) -> tuple:
    """The bar as a row; `until` is when another took its place."""
    end = bar["start"] + bar["length"]
    warned = bar["warned"] if bar["warned"] is not None else max(bar["changed"], end - bar["warning"])
    expired, gone = max(bar["changed"], end), max(bar["changed"], end - bar["remove"])
    replaced = until is not None and until < gone
    if replaced:
        gone, warned, expired = until, warned if warned <= until else None, expired if expired <= until else None
    return (bar["key"], bar["name"], bar["caster"], bar["start"], bar["base"], bar["planned"], bar["length"], warned, expired, gone, replaced, bar["panel1"], bar["panel2"], [tuple(x) for x in bar["lengths"]])


def _resize(bar: dict, length: int, ts: int) -> None:
    due = bar["start"] + bar["length"] - bar["warning"]
    if bar["warned"] is None and due <= ts:
        bar["warned"] = max(due, bar["changed"])
    bar["length"], bar["changed"] = length, ts
    bar["lengths"] = [x for x in bar["lengths"] if x[0] < ts] + [[ts, length]]


def _take_back(bars: dict, owner: str, ts: int, grace: int) -> None:
    for bar in bars.values():
        if bar["mods"] and bar["attacker"] == owner and bar["length"] != bar["base"] and ts - bar["start"] <= grace:
            _resize(bar, bar["base"], ts)
            bar["mods"] = []


def _start(bars: dict, held: dict, row, out: list) -> None:
    if row.restrict_me and not row.own:
        return
    key = "|".join((row.zone or "", row.category or "", row.name)).lower()
    old = bars.get(key)
    if old and row.ts < old["start"] + old["length"]:
        if row.ts - old["last"] < SAME_CAST:
            old["last"] = row.ts
            return
        if row.absolute:
            return
    mods = []
    if row.modable:
        mine = held.get(row.attacker, {})
        for name in [n for n, (_, until, _) in mine.items() if until <= row.ts]:
            del mine[name]
        if not mine:
            held.pop(row.attacker, None)
        mods = [[applier, share] for share, _, applier in mine.values()]
    length = max(0, round(row.duration_s * (1 + sum(share for _, share in mods))))
    caster = row.attacker
    if old:
        out.append(_closed(old, row.ts))
        caster = old["caster"] if old["start"] + old["length"] - old["remove"] > row.ts else caster
    bars[key] = {"key": key, "name": row.name, "caster": caster, "attacker": row.attacker, "start": int(row.ts), "base": int(row.duration_s), "planned": length, "length": length, "lengths": [[int(row.ts), length]], "mods": mods, "warning": int(row.warning_s), "remove": int(row.remove_s), "last": int(row.ts), "changed": int(row.ts), "warned": None, "panel1": bool(row.panel1), "panel2": bool(row.panel2)}


def _die(bars: dict, held: dict, name: str, ts: int) -> None:
    """A death ends the debuffs on the dead and those the dead had cast; bars
    stretched by the latter shrink for the time that is left."""
    if held.pop(name, None) is not None:
        _take_back(bars, name, ts, DEATH_GRACE)
    for owner in list(held):
        held[owner] = {n: m for n, m in held[owner].items() if m[2] != name}
        if not held[owner]:
            del held[owner]
    for bar in bars.values():
        stay = [m for m in bar["mods"] if m[0] != name]
        spent, left = ts - bar["start"], bar["start"] + bar["length"] - ts
        if len(stay) < len(bar["mods"]) and spent >= 0 and left > 0:
            ratio = (1 + sum(m[1] for m in stay)) / (1 + sum(m[1] for m in bar["mods"]))
            _resize(bar, max(bar["base"], round(spent + left * ratio)), ts)
            bar["mods"] = stay


def advance(state: dict, rows, debuffs: dict = DEBUFFS, flush: bool = False) -> tuple[dict, list[tuple]]:
    """One source's steps in order -> the new state (plain values: running bars,
    debuffs by victim) and the bars that are over; with flush, all of them."""
    bars, held = state.setdefault("bars", {}), state.setdefault("held", {})
    out, latest = [], None
    for row in rows:
        latest = row.ts if latest is None else max(latest, row.ts)
        if row.death:
            _die(bars, held, row.victim, int(row.ts))
            continue
        if isinstance(row.name, str):
            _start(bars, held, row, out)
        if isinstance(row.debuff, str):
            share, seconds = debuffs[row.debuff]
            held.setdefault(row.victim, {})[row.debuff] = [share, int(row.ts) + seconds, row.attacker]
        if isinstance(row.cured, str):
            mine = held.get(row.victim, {})
            mine.pop(row.cured, None)
            if not mine:
                held.pop(row.victim, None)
            _take_back(bars, row.victim, int(row.ts), DISPEL_GRACE)
    for key in list(bars):
        if flush or (latest is not None and bars[key]["start"] + bars[key]["length"] - bars[key]["remove"] < latest):
            out.append(_closed(bars.pop(key)))
    for owner in list(held):
        if latest is not None and all(until < latest - DEATH_GRACE for _, until, _ in held[owner].values()):
            del held[owner]
    return state, out


def frame(source_id, bars: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in BARS.split(", ")]
    return pd.DataFrame([(source_id, *b) for b in bars], columns=names, dtype=object)


def recast_timers(swings: DataFrame, definitions: DataFrame, requests: DataFrame | None = None, debuffs: dict = DEBUFFS) -> DataFrame:
    """The bars of each source.  Steps further apart than any bar or debuff
    lasts don't know of each other: a group is a stretch between such pauses."""
    steps = timer_steps(swings, definitions, requests, debuffs)
    most = 1 + sum(share for share, _ in debuffs.values())
    lasts = definitions.agg(F.max(F.ceil(F.col("duration_s") * most) + F.greatest(-F.col("remove_s"), F.lit(0)))).first()[0]
    idle = int(max([lasts or 0, SAME_CAST, *[s for _, s in debuffs.values()]])) + DEATH_GRACE

    def group(rows):
        return [(rows[0].source_id, *bar) for bar in advance({}, rows, debuffs, flush=True)[1]]

    return in_stretches(steps, idle, ("source_id",), ("seq", "step"), group, BARS)


def timer_mods(bars: DataFrame) -> DataFrame:
    """Bars that a debuff stretched: by how much per cent at the start and in the end."""
    percent = lambda c: F.bround(100.0 * (F.col(c) - F.col("base_s")) / F.col("base_s"), 0).cast("long")
    return bars.where("base_s > 0 and planned_s <> base_s").select("source_id", "timer_key", "caster", "start_ts", "base_s", "planned_s", "length_s", percent("planned_s").alias("stretch_pct"), percent("length_s").alias("left_pct"))


def timer_events(bars: DataFrame) -> DataFrame:
    """Start, warning, expiry and removal of each bar, in event time."""
    told = F.array(*[F.struct(F.lit(kind).alias("event"), F.col(c).alias("ts")) for kind, c in (("start", "start_ts"), ("warning", "warned_ts"), ("expiry", "expired_ts"))], F.struct(F.lit("removal").alias("event"), F.when(~F.col("replaced"), F.col("gone_ts")).alias("ts")))
    return bars.select("source_id", "timer_key", "start_ts", F.explode(told).alias("t")).select("source_id", "timer_key", "start_ts", "t.event", "t.ts").where("ts is not null")


def bar_lengths(bars: DataFrame) -> DataFrame:
    """A row for each length a bar had: from_ts to until_ts (exclusive), when another
    took its place or the bar was gone."""
    n = F.size("lengths")
    each = bars.select("source_id", "timer_key", "timer", "caster", "start_ts", "gone_ts", "panel1", "panel2", n.alias("_n"), "lengths", F.posexplode("lengths").alias("_i", "_l"))
    until = F.when(F.col("_i") + 1 < F.col("_n"), F.least(F.element_at("lengths", F.least(F.col("_i") + 2, F.col("_n")))["from_ts"], "gone_ts")).otherwise(F.col("gone_ts"))
    return each.select("source_id", "timer_key", "timer", "caster", "start_ts", "panel1", "panel2", F.col("_l.from_ts").alias("from_ts"), until.alias("until_ts"), F.col("_l.length_s").alias("length_s")).where("from_ts < until_ts")


def timer_board(bars: DataFrame, moments: DataFrame, panel: int = 1) -> DataFrame:
    """moments(source_id, at_ts): the bars of a panel that stand at each, the soonest
    first (rank), with the length in force at that moment.  Both sides meet by minute,
    so that a long log is no single join key."""
    left = F.col("start_ts") + F.col("length_s") - F.col("at_ts")
    minutes = F.explode(F.sequence(F.expr("from_ts div 60"), F.expr("until_ts div 60")))
    spread = bar_lengths(bars.where(F.col(f"panel{panel}"))).withColumn("_minute", minutes)
    standing = spread.join(moments.withColumn("_minute", F.expr("at_ts div 60")), ["source_id", "_minute"]).where("from_ts <= at_ts and at_ts < until_ts")
    order = Window.partitionBy("source_id", "at_ts").orderBy("left_s", "timer_key")
    return standing.select("source_id", "at_ts", "timer_key", "timer", "caster", left.alias("left_s"), "length_s").withColumn("rank", F.row_number().over(order))


#: What a bar tells, and when: the places of the stamps in a closed bar.
TOLD = (("start", 3), ("warning", 7), ("expiry", 8), ("removal", 9))


def due_events(state: dict, until: float) -> list[tuple]:
    """Events of running bars up to `until` that weren't told yet: (timer_key, start_ts,
    event, ts).  A stretched bar's wait as long as a cure or a death may take the
    stretch back."""
    out = []
    for bar in state.get("bars", {}).values():
        closed = _closed(bar)
        for event, at in TOLD:
            safe = max(closed[at], bar["start"] + DEATH_GRACE) if bar["mods"] and event != "start" else closed[at]
            if safe <= until and event not in bar.setdefault("told", []):
                bar["told"].append(event)
                out.append((bar["key"], bar["start"], event, closed[at]))
    return out


def next_event(state: dict) -> float | None:
    """When the next event of a running bar is due."""
    out = []
    for bar in state.get("bars", {}).values():
        closed = _closed(bar)
        out += [max(closed[at], bar["start"] + DEATH_GRACE) if bar["mods"] and event != "start" else closed[at] for event, at in TOLD if event not in bar.get("told", [])]
    return min(out, default=None)


def events_of(closed: list[tuple], told: dict) -> list[tuple]:
    """What bars that are over tell beyond told ((key, start) to events)."""
    out = []
    for b in closed:
        for event, at in TOLD:
            stamp = b[at] if event != "removal" or not b[10] else None
            if stamp is not None and event not in told.get((b[0], b[3]), ()):
                out.append((b[0], b[3], event, stamp))
    return out
