"""Live jobs on Structured Streaming, sharing their machines with the batch."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_hostile
from ..operators import chat, timers
from ..operators.allies import walk
from ..operators.rules import Waves, accept_spaced, control_hits, match_rules
from ..operators.sessions import IDLE
from ..operators.stats import POLARITY
from .timed import LATE, Machine
from .timed import timed as _timed

ENCOUNTER = "source_id string, encounter_id long, start_ts long, end_ts long, actions long"


def _gathered(batches, *order: str) -> pd.DataFrame | None:
    """The rows of a step in order; none if there are none."""
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values(list(order)) if parts else None


def advance(state: tuple, rows, idle: int = IDLE) -> tuple[tuple, list[tuple]]:
    """One source's rows (seq, ts, hostile, action) in order -> the new state
    (open, encounter_id, start, last hostile, actions) and closed encounters."""
    is_open, enc, start, last, n = state
    closed = []
    for seq, ts, hostile, action in rows:
        if is_open and ts - last > idle:
            closed.append((enc, start, last, n))
            is_open = False
        if hostile:
            if not is_open:
                is_open, enc, start, n = True, seq, ts, 0
            last = ts
        if is_open and (action or hostile):
            n += 1
    return (is_open, enc, start, last, n), closed


class Encounters(Machine):
    """One log's open encounter.  It ends with a line more than `idle` after its last
    hostile one, or when event time has passed that moment, so that no such line can
    belong to it any more."""

    columns = ("seq", "ts", "hostile", "action")
    order = ("seq",)

    def __init__(self, idle: int = IDLE):
        self.idle = idle

    def rows(self, key, held, rows):
        now, closed = advance(tuple(held.get("fight", (False, 0, 0, 0, 0))), rows, self.idle)
        held["fight"] = list(now)
        return [(key[0], *c) for c in closed]

    def time(self, key, held, until):
        is_open, enc, start, last, n = held.get("fight", (False, 0, 0, 0, 0))
        if not is_open or until < last + self.idle:
            return []
        held.pop("fight")
        return [(key[0], enc, start, last, n)]

    def due(self, held):
        is_open, _, _, last, _ = held.get("fight", (False, 0, 0, 0, 0))
        return last + self.idle if is_open else None


def stream_encounters(swings: DataFrame, idle: int = IDLE, late: str = LATE, clock: DataFrame | None = None) -> DataFrame:
    """Encounters of a stream of swings, each told once: when a later line of its log
    closes it, or when event time has passed the moment up to which it could go on."""
    rows = swings.select("source_id", "seq", "ts", is_hostile().alias("hostile"), (F.col("category") != 0).alias("action"))
    return _timed(rows, ("source_id",), Encounters(idle), ENCOUNTER, late, clock)


class Callouts(Machine):
    """Waves of one effect over all logs."""

    columns = ("ts", "source_id", "seq", "victim")
    order = ("ts", "source_id", "seq")
    waits = True

    def __init__(self, waves: Waves):
        self.waves = waves

    def rows(self, key, held, rows):
        return [(key[0], float(at), n) for at, n in self.waves.step(held, [(r[0], r[3]) for r in rows], float("-inf"))]

    def time(self, key, held, until):
        out = [(key[0], float(at), n) for at, n in self.waves.step(held, [], until)]
        if (self.due(held) or 0) <= until:
            held.clear()  # no victim counts any more, and nothing keeps others quiet
        return out

    def due(self, held):
        return self.waves.due(held)


def stream_callouts(applied: DataFrame, waves: Waves = Waves(), late: str = LATE, clock: DataFrame | None = None) -> DataFrame:
    """Waves of control effects over all logs, as rules.status_callouts tells them."""
    return _timed(control_hits(applied), ("effect",), Callouts(waves), "effect string, at_ts double, victims long", late, clock)


class Once(Machine):
    """What several logs tell within some seconds, told once."""

    columns = ("ts", "source_id", "seq")
    order = ("ts", "source_id", "seq")
    waits = True

    def __init__(self, within_s: float):
        self.within_s = within_s

    def rows(self, key, held, rows):
        ok, held["last"] = accept_spaced([r[0] for r in rows], self.within_s, held.get("last"))
        return [(source, seq, ts, *key) for (ts, source, seq), good in zip(rows, ok) if good]

    def time(self, key, held, until):
        if "last" in held and held["last"] + self.within_s <= until:
            held.clear()
        return []

    def due(self, held):
        return held["last"] + self.within_s if "last" in held else None


def stream_dedupe(fired: DataFrame, within_s: float = 2.0, late: str = LATE, clock: DataFrame | None = None) -> DataFrame:
    """The same rule and text from several logs announces once, as
    rules.cross_source_dedupe has it.  State per rule and text: the last announcement,
    for within_s, and the rows that event time hasn't passed yet."""
    return _timed(fired.select("source_id", "seq", "ts", "rule", "message"), ("rule", "message"), Once(within_s), "source_id string, seq long, ts long, rule string, message string", late, clock)


def stream_shared_rules(lines: DataFrame, rules: DataFrame, within_s: float = 10.0, late: str = LATE, clock: DataFrame | None = None) -> DataFrame:
    """Rules that others share in chat, as chat.shared_rule_feed tells them."""
    return stream_dedupe(chat.new_shares(chat.chat_rule_shares(lines), rules), within_s, late, clock)


class Events(Machine):
    """Running bars of one log: each tells its warning, expiry and removal when event
    time reaches them, whatever a debuff, a cure or a death made of them by then."""

    columns = ("seq", "step", "ts", "attacker", "victim", "own", "debuff", "cured", "death", *timers.TAKEN)
    order = ("seq", "step")

    def __init__(self, debuffs: dict):
        self.debuffs = debuffs

    def rows(self, key, held, rows):
        told = {(k, b["start"]): b.get("told", []) for k, b in held.get("bars", {}).items()}
        _, over = timers.advance(held, [SimpleNamespace(**dict(zip(self.columns, r))) for r in rows], self.debuffs)
        return [(key[0], *e) for e in timers.events_of(over, told) + timers.due_events(held, float("-inf"))]

    def time(self, key, held, until):
        out = timers.due_events(held, until)
        gone = [k for k, b in held.get("bars", {}).items() if "removal" in b.get("told", ())]
        for k in gone:
            del held["bars"][k]
        for owner in [o for o, d in held.get("held", {}).items() if all(end + timers.DEATH_GRACE <= until for _, end, _ in d.values())]:
            del held["held"][owner]
        if not held.get("bars") and not held.get("held"):
            held.clear()
        return [(key[0], *e) for e in out]

    def due(self, held):
        ends = [end + timers.DEATH_GRACE for d in held.get("held", {}).values() for _, end, _ in d.values()]
        after = timers.next_event(held)
        return min([*([] if after is None else [after]), *ends], default=None)


def stream_timer_events(steps: DataFrame, debuffs: dict = timers.DEBUFFS, late: str = LATE, clock: DataFrame | None = None) -> DataFrame:
    """Start, warning, expiry and removal of the bars of a stream of timers.timer_steps,
    as timers.timer_events computes them."""
    return _timed(steps, ("source_id",), Events(debuffs), "source_id string, timer_key string, start_ts long, event string, ts long", late, clock)


def stream_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule matches of live lines: less than 30 s old, or without an arrival stamp."""
    live = F.col("observed_ms").isNull() | (F.col("observed_ms") - F.col("ts") * 1000 < 30_000)
    return match_rules(lines.where(live), rules)


def stream_rate_limit(matches: DataFrame, cooldown_s: float = 1.0) -> DataFrame:
    """Matches that may announce, per source and rule."""

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        pdf = _gathered(batches, "seq")
        if pdf is None:
            return
        ok, last = accept_spaced(pdf["ts"], cooldown_s, last)
        state.update((float(last),))
        yield pdf[ok][["source_id", "seq", "ts", "rule"]]

    return matches.groupBy("source_id", "rule").applyInPandasWithState(step, "source_id string, seq long, ts long, rule string", "last double", "append", "NoTimeout")


def stream_recast_timers(steps: DataFrame, debuffs: dict = timers.DEBUFFS) -> DataFrame:
    """Bars of a stream of timers.timer_steps, emitted when they are over.
    State per source: its running bars and debuffs, as JSON."""

    def step(key, batches, state):
        held = json.loads(state.get[0]) if state.exists else {}
        pdf = _gathered(batches, "seq", "step")
        if pdf is None:
            return
        held, over = timers.advance(held, pdf.itertuples(index=False), debuffs)
        state.update((json.dumps(held),))
        yield timers.frame(key[0], over)

    return steps.groupBy("source_id").applyInPandasWithState(step, timers.BARS, "held string", "append", "NoTimeout")


METER = "source_id string, encounter_id long, open boolean, rank long, combatant string, damage long, rate double, of_top double, raid_rate double"


def measure(fight: dict, rows, idle: int = IDLE) -> dict:
    """One source's actions in order (seq, ts, hostile, category, attacker, victim,
    amount) added to its fight: what each name dealt, when it last did, and who
    acted on whom.  A new fight forgets the one before."""
    for seq, ts, hostile, category, attacker, victim, amount in rows:
        if fight.get("open") and ts - fight["last"] > idle:
            fight["open"] = False
        if hostile:
            if not fight.get("open"):
                fight = {"open": True, "encounter_id": int(seq), "start": None, "dealt": {}, "until": {}, "names": {}, "edges": {}}
            fight["last"] = int(ts)
        if not fight.get("open") or not category:
            continue
        a, v = attacker.upper(), victim.upper()
        fight["names"].setdefault(a, attacker)
        fight["names"].setdefault(v, victim)
        if a == v and category in (1, 2):
            continue
        fight["start"] = int(ts) if fight["start"] is None else min(fight["start"], int(ts))
        if category in (1, 2):
            fight["dealt"][a] = fight["dealt"].get(a, 0) + max(0, int(amount))
            fight["until"][a] = max(fight["until"].get(a, int(ts)), int(ts))
        sign = POLARITY.get(category, 0)
        if sign and a != v and "UNKNOWN" not in (a, v):
            for x, y in ((a, v), (v, a)):
                near = fight["edges"].setdefault(x, {})
                near[y] = near.get(y, 0) + sign
    return fight


def meter_rows(fight: dict, owner: str, n: int = 6) -> list[tuple]:
    """(encounter_id, open, rank, combatant, damage, rate, of_top, raid_rate) of the
    n best allies: the feature is a top list."""
    if owner.upper() not in fight.get("names", {}):
        return []
    friends = walk(owner.upper(), fight["edges"])
    ends = [t for name, t in fight["until"].items() if name in friends]
    seconds = max(1, max(ends, default=fight["start"]) - fight["start"])
    dealt = sorted(((-d, fight["names"][x]) for x, d in fight["dealt"].items() if x in friends and d > 0))
    total, top = -sum(d for d, _ in dealt), -dealt[0][0] if dealt else 0
    return [(fight["encounter_id"], fight["open"], i, name, -d, -d / seconds, -d / top, total / seconds) for i, (d, name) in enumerate(dealt[:n], 1)]


def stream_mini_parse(swings: DataFrame, n: int = 6, idle: int = IDLE) -> DataFrame:
    """The meter of each log's open fight, else of its last one, after every batch
    that brings lines of the log (output mode update): the best allies by damage.
    State per source: one fight's sums, as JSON; logs don't wait for each other."""
    rows = swings.select("source_id", "owner", "seq", "ts", is_hostile().alias("hostile"), "category", "attacker", "victim", "amount")

    def step(key, batches, state):
        fight = json.loads(state.get[0]) if state.exists else {}
        pdf = _gathered(batches, "seq")
        if pdf is None:
            return
        fight = measure(fight, pdf[["seq", "ts", "hostile", "category", "attacker", "victim", "amount"]].itertuples(index=False), idle)
        state.update((json.dumps(fight),))
        told = meter_rows(fight, pdf["owner"].iloc[0], n)
        yield pd.DataFrame([(key[0], *r) for r in told], columns=[c.split()[0] for c in METER.split(", ")], dtype=object)

    return rows.groupBy("source_id").applyInPandasWithState(step, METER, "held string", "update", "NoTimeout")


def idempotent_upload(payloads: DataFrame, seen: DataFrame) -> DataFrame:
    """Payloads whose id was not uploaded before, each id once."""
    return payloads.join(seen.select("encid"), "encid", "left_anti").dropDuplicates(["encid"])


#: Up to this many ids of a batch are broadcast to the ledger's scan.
BROADCAST_IDS = 100_000


def upload_batch(payloads: DataFrame, batch_id: int, ledger: str, send=None) -> None:
    """One batch for foreachBatch.  Its new payloads become the folder batch=<id> of the
    ledger, which is both what was uploaded and the list of its ids; a batch that runs
    again reads only the batches before it and writes the same folder anew, so no
    payload is there twice and none is lost, wherever the job was ended.  send(frame,
    batch_id), if given, gets the written rows, and must take a batch id twice."""
    spark = payloads.sparkSession
    kept = payloads.persist()
    try:
        before = _ledger(spark, ledger, batch_id)
        if before is None:
            new = kept.dropDuplicates(["encid"])
        else:
            ids = kept.select("encid").distinct()
            # Only the ledger's ids are read, and of them those of this batch go on.
            seen = before.select("encid").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "encid", "left_semi")
            new = idempotent_upload(kept, seen)
        new.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
    finally:
        kept.unpersist()
    if send is not None:
        send(spark.read.schema(payloads.schema).parquet(f"{ledger}/batch={batch_id}"), batch_id)


def _ledger(spark, ledger: str, batch_id: int) -> DataFrame | None:
    """The ids of the batches before batch_id; None if there are none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where) or not list(files.listStatus(where)):
        return None
    return spark.read.schema("encid string, batch long").parquet(ledger).where(F.col("batch") < batch_id)


def stream_uploads(payloads: DataFrame, ledger: str, checkpoint: str, send=None):
    """A writer that uploads a stream of payloads (with encid), each id once over the
    job's whole life, restarts included; call start() on it."""
    return payloads.writeStream.foreachBatch(lambda df, batch_id: upload_batch(df, batch_id, ledger, send)).option("checkpointLocation", checkpoint)
