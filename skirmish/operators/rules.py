"""Regex rules on lines, and the state machines behind alerts.

Rules are a small dimension; the machines are plain functions over rows in
order, used per key by both batch and streaming jobs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_control
from .ordered import in_order, in_stretches

#: Rules are typed or imported by people and go with every task; more are refused.
MOST_RULES = 20_000
#: Up to this many definitions of timers or rules are broadcast.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Pattern:
    """A rule's pattern with its named groups as plain ones: they are written in two
    ways, and templates number plain groups before named ones."""

    text: str
    names: dict[str, int]  # number of each named group in text
    numbers: list[int]  # text's number of $0, $1, ...: plain groups count before named ones

    @staticmethod
    def of(regex: str) -> Pattern:
        out, names, plain, named, n, i, in_class = [], {}, [], [], 0, 0, False
        while i < len(regex):
            c = regex[i]
            step = 1
            if c == "\\":
                step = 2
            elif in_class:
                in_class = c != "]"
            elif c == "[":
                in_class = True
                step = 2 if regex[i + 1 : i + 2] == "]" else 3 if regex[i + 1 : i + 3] == "^]" else 1
            elif c == "(":
                found = re.match(r"\(\?(?:<([A-Za-z_]\w*)>|'([A-Za-z_]\w*)')", regex[i:])
                if found:
                    n += 1
                    names[found[1] or found[2]] = n
                    named.append(n)
                    out.append("(")
                    i += len(found[0])
                    continue
                if regex[i + 1 : i + 2] != "?":
                    n += 1
                    plain.append(n)
            out.append(regex[i : i + step])
            i += step
        return Pattern("".join(out), names, [0, *plain, *named])


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds, outside
    groups and classes; empty if there is none to be sure of."""
    if "(?i" in pattern or "(?x" in pattern:
        return ""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, step, plain = pattern[i], 1, ""
        if c == "\\":
            after = pattern[i + 1 : i + 2]
            step, plain = 2, "" if after.isalnum() or after in ("", "_") else after
            if after in ("p", "P", "x", "u", "k", "c", "N", "g", "Q", "E") or after.isdigit():
                return ""  # longer escapes: not worth reading
        elif c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            end = end + 1 if pattern[end : end + 1] == "]" else end
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            step = end + 1 - i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return ""
        elif c not in "^$.*+?{}|":
            plain = c
        if pattern[i + step : i + step + 1] in ("*", "?", "{"):
            plain = ""
        if c in "*+?":
            plain = ""
        elif c == "{":
            step = max(1, pattern.find("}", i) + 1 - i)
        if plain and not depth:
            run += plain
            if pattern[i + step : i + step + 1] == "+":
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
        i += step
    return max([*runs, run], key=len)


class _Rules:
    """Rules compiled as they are needed, found by their literals."""

    def __init__(self, held: list[dict], budget_s: float):
        self.held, self.budget_s, self.off = held, budget_s, set()
        self.compiled: dict[int, tuple[Pattern, object]] = {}
        needed = {n: [x for x in (r.get("literal"), required_literal(r["regex"])) if x] for n, r in enumerate(held)}
        self.always = [n for n, x in needed.items() if not x]
        by_literal: dict[str, list[int]] = {}
        for n, literals in needed.items():
            if literals:
                by_literal.setdefault(max(literals, key=len), []).append(n)
        self.index = _literal_index(by_literal)

    def rule(self, n: int) -> tuple[Pattern, object]:
        if n not in self.compiled:
            import regex

            p = Pattern.of(self.held[n]["regex"])
            self.compiled[n] = p, regex.compile(p.text)
        return self.compiled[n]

    def hits(self, message: str, zone: str, owner: str | None):
        """(rule, attacker, victim, text, cooldown) of the rules that a line matches."""
        for n in sorted({*self.always, *self.index(message)} - self.off):
            r = self.held[n]
            if r.get("literal") and r["literal"] not in message or r.get("zone") and r["zone"].lower() not in zone:
                continue
            p, compiled = self.rule(n)
            try:
                m = compiled.search(message, timeout=self.budget_s)
            except TimeoutError:
                self.off.add(n)  # it would stall every line from here on
                continue
            if not m:
                continue
            group = lambda i: m[i] or ""
            if "YOU" in p.names and owner != "" and (you := group(p.names["YOU"])) and (owner is None or owner.lower() not in you.lower()):
                continue
            name = lambda g: (group(p.names[g]) if g in p.names else "") or "None"
            told = _expanded(r["sound_data"], p, group) if r.get("sound_data") and r.get("sound_type") == 3 else None
            yield r["rule"], name("attacker"), name("victim"), told, float(r["cooldown_s"]) if r.get("cooldown_s") is not None else 1.0


def _literal_index(by_literal: dict[str, list[int]]):
    """A function from a line to the rules whose literal it holds; the line is read
    once for all of them."""
    if not by_literal:
        return lambda message: ()
    try:
        import ahocorasick
    except ImportError:
        return lambda message: [n for literal, rules in by_literal.items() if literal in message for n in rules]
    found = ahocorasick.Automaton()
    for literal, rules in by_literal.items():
        found.add_word(literal, rules)
    found.make_automaton()
    return lambda message: [n for _, rules in found.iter(message) for n in rules]


def _expanded(template: str, pattern: Pattern, group) -> str:
    """A template's text: $1, ${1} and ${name} stand for groups, $$ for a dollar."""
    parts = []
    for text, one, braced in re.findall(r"([^$]+|\$\$|\$(?![\d{]))|\$(\d+)|\$\{(\w+)\}", template):
        ref = one or braced
        if not ref:
            parts.append("$" if text == "$$" else text)
            continue
        at = pattern.names.get(ref, pattern.numbers[int(ref)] if ref.isdigit() and int(ref) < len(pattern.numbers) else None)
        parts.append((f"${{{braced}}}" if braced else f"${one}") if at is None else group(at))
    return "".join(parts)


#: Seconds that a pattern may take for one line.
BUDGET_S = 0.1
MATCHES = "source_id string, seq long, ts long, message string, rule string, attacker string, victim string, text string, cooldown_s double"


def match_rules(lines: DataFrame, rules: DataFrame, budget_s: float = BUDGET_S) -> DataFrame:
    """lines(source_id, seq, ts, zone, message, owner) x rules(rule, regex, literal,
    zone, enabled; sound_type, sound_data, cooldown_s as far as given): every match
    in the rule's zone, with attacker and victim (groups of these names, else
    "None"), the sound's text with its groups filled in, and the cooldown.  A group
    named YOU must hold the log's owner.

    Lines are read once, whatever the number of rules: an automaton over the rules'
    literals (given, or what the pattern can't match without) tells which patterns a
    line may match, and only those run.  A pattern that takes longer than budget_s for
    a line is switched off for the rest of the task, as it would stall every line."""
    held = [r.asDict() for r in rules.where("enabled").limit(MOST_RULES + 1).collect()]
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = [c.split()[0] for c in MATCHES.split(", ")]
    owner = F.col("owner") if "owner" in lines.columns else F.lit("")

    def run(batches):
        known = _Rules(held, budget_s)
        for batch in batches:
            out = [[] for _ in names]
            for source, seq, ts, message, zone, who in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for hit in known.hits(message, zone, who):
                    for column, x in zip(out, (source, seq, ts, message, *hit), strict=True):
                        column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    told = lines.where("message is not null").select("source_id", F.col("seq").cast("long"), F.col("ts").cast("long"), "message", F.lower(F.coalesce("zone", F.lit(""))).alias("zone"), owner.cast("string").alias("owner"))
    return told.mapInArrow(run, MATCHES)


def merge_rule_sets(pack: DataFrame, user: DataFrame, overrides: DataFrame) -> DataFrame:
    """The user's rules and the pack's others; overrides(rule, disabled,
    enabled_override) switch them."""
    every = user.withColumn("from_pack", F.lit(False)).unionByName(pack.join(user.select("rule"), "rule", "left_anti").withColumn("from_pack", F.lit(True)))
    on = ~F.coalesce("disabled", F.lit(False)) & (F.col("from_pack") | F.coalesce("enabled_override", F.lit(False)) | F.col("enabled"))
    return every.join(overrides, "rule", "left").withColumn("enabled", on).drop("disabled", "enabled_override")


def missing_timers(mined: DataFrame, timers: DataFrame) -> DataFrame:
    """Mined abilities without a definition of their name for their mob and zone;
    a definition's category may list several mobs."""
    defined = timers.select(F.lower("name").alias("_name"), F.explode(F.split("category", r"\|")).alias("_mob"), F.lower(F.coalesce("zone", F.lit(""))).alias("_zone"))
    defined = defined.select("_name", F.lower(F.trim("_mob")).alias("_mob"), "_zone").distinct()
    same = (F.lower("ability") == F.col("_name")) & (F.lower("attacker") == F.col("_mob")) & (F.lower("zone") == F.col("_zone"))
    return mined.join(defined, same, "left_anti")


def ensure_linked_timers(rules: DataFrame, timers: DataFrame) -> DataFrame:
    """timers plus a default of 30 s for each timer that a rule starts and
    nothing defines."""
    wanted = rules.where("starts_timer").select(F.col("timer_name").alias("name")).distinct()
    new = wanted.join(timers.select("name"), "name", "left_anti").select("name", F.lit("").alias("category"), F.lit(30).cast("long").alias("duration_s"))
    return timers.select("name", "category", F.col("duration_s").cast("long").alias("duration_s")).unionByName(new)


def accept_spaced(stamps, least: float, last: float | None = None) -> tuple[list[bool], float | None]:
    """True for each stamp at least `least` after the last accepted one."""
    out = []
    for t in stamps:
        ok = last is None or t - last >= least
        out.append(ok)
        if ok:
            last = t
    return out, last


def rate_limit(matches: DataFrame, cooldown_s: float | None = None) -> DataFrame:
    """Every match, with fires: whether its rule may announce again, by the rule's
    own cooldown_s or the one given.  After a pause beyond the cooldown the past
    doesn't matter: a group is a stretch between pauses."""

    def group(rows):
        fires = accept_spaced([r.ts for r in rows], rows[0].cooldown_s)[0]
        return [(r.source_id, r.seq, r.ts, r.rule, r.message, f) for r, f in zip(rows, fires)]

    cooldown = F.col("cooldown_s") if cooldown_s is None else F.lit(float(cooldown_s))
    rows = matches.select("source_id", "seq", "ts", "rule", "message", cooldown.alias("cooldown_s"))
    return in_stretches(rows, F.col("cooldown_s"), ("source_id", "rule"), ("seq",), group, "source_id string, seq long, ts long, rule string, message string, fires boolean")


def cross_source_dedupe(fired: DataFrame, within_s: float = 2.0) -> DataFrame:
    """The same rule and text from several logs announces once."""

    def group(rows):
        fires = accept_spaced([r.ts for r in rows], within_s)[0]
        return [(r.source_id, r.seq, r.ts, r.rule, r.message) for r, f in zip(rows, fires) if f]

    rows = fired.select("source_id", "seq", "ts", "rule", "message")
    return in_stretches(rows, within_s, ("rule", "message"), ("ts", "source_id", "seq"), group, "source_id string, seq long, ts long, rule string, message string")


@dataclass(frozen=True)
class Waves:
    """When mass effects are told: `least` different victims within `within` seconds
    make a wave; after `hold` it is told, if enough victims are still within the window
    then.  A wave that has ebbed away isn't told and costs nothing; one that is told
    keeps others quiet for `cooldown`."""

    least: int = 3
    within: float = 4.0
    hold: float = 0.9
    cooldown: float = 12.0

    def step(self, state: dict, rows, until: float | None) -> list[tuple]:
        """Rows (ts, victim) of one effect in order, then all time up to `until` (None:
        for good) -> (ts, victims) of the alerts.  state: plain values, kept between
        calls."""
        recent, out = state.setdefault("recent", {}), []

        def prune(now):
            for v in [v for v, at in recent.items() if now - at > self.within]:
                del recent[v]

        def tell():
            now = state.pop("pending") + self.hold
            prune(now)
            if len(recent) >= self.least:
                state["last"] = now
                out.append((now, len(recent)))

        for ts, victim in rows:
            if "pending" in state and ts >= state["pending"] + self.hold:
                tell()
            recent[victim.lower()] = ts
            prune(ts)
            if "last" in state and ts - state["last"] < self.cooldown:
                continue
            if "pending" not in state and len(recent) >= self.least:
                state["pending"] = ts
        if "pending" in state and (until is None or until >= state["pending"] + self.hold):
            tell()
        return out

    def due(self, state: dict) -> float | None:
        """When something happens without another row: a wave is told, or, later, the
        state is of no use."""
        if "pending" in state:
            return state["pending"] + self.hold
        ends = [at + self.within for at in state.get("recent", {}).values()] + ([state["last"] + self.cooldown] if "last" in state else [])
        return max(ends, default=None)


def callouts(rows, least: int = 3, within: float = 4.0, hold: float = 0.9, cooldown: float = 12.0):
    """rows (ts, victim) of one effect in order -> (ts, victims) of the alerts."""
    return Waves(least, within, hold, cooldown).step({}, rows, None)


def control_hits(applied: DataFrame) -> DataFrame:
    """applied(source_id, seq, ts, victim, ability) -> (source_id, seq, ts, victim,
    effect): control effects on players (one word, capitalised), by the effect behind
    the status word."""
    player = (F.length("victim") > 1) & ~F.col("victim").contains(" ") & F.substring("victim", 1, 1).rlike(r"^\p{Lu}")
    return applied.withColumn("effect", canonical_control(F.col("ability"))).where(F.col("effect").isNotNull() & player).select("source_id", "seq", "ts", "victim", "effect")


def status_callouts(applied: DataFrame, waves: Waves = Waves()) -> DataFrame:
    """Waves of a control effect over the players of all logs: (effect, at_ts, victims).
    A victim that several logs tell of is one."""

    def group(rows):
        return [(rows[0].effect, float(t), n) for t, n in waves.step({}, [(r.ts, r.victim) for r in rows], None)]

    return in_stretches(control_hits(applied), max(waves.within, waves.cooldown) + waves.hold, ("effect",), ("ts", "source_id", "seq"), group, "effect string, at_ts double, victims long")


def uses(rows, same_use: float = 2.0):
    """rows (ts, victim) of an ability in order -> the stamps of its uses: a new
    one starts with a victim hit already or more than same_use after its start."""
    starts, hit = [], set()
    for ts, victim in rows:
        if not starts or ts - starts[-1] > same_use or victim in hit:
            starts.append(ts)
            hit = set()
        hit.add(victim)
    return starts


def ability_frequency(hits: DataFrame, longest: int = 300) -> DataFrame:
    """The mean gap between uses of an ability; gaps up to 300 s count, so
    stretches between longer ones are summed apart."""

    def group(rows):
        starts = uses([(r.ts, r.victim) for r in rows])
        gaps = [b - a for a, b in zip(starts, starts[1:]) if 0 < b - a <= longest]
        return [(*rows[0][:3], len(starts), len(gaps), sum(gaps))]

    rows = hits.select("source_id", "seq", "ts", "attacker", "ability", "victim")
    parts = in_stretches(rows, longest, ("source_id", "attacker", "ability"), ("seq",), group, "source_id string, attacker string, ability string, uses long, gaps long, gap_s long")
    mean = F.when(F.sum("gaps") > 0, F.sum("gap_s") / F.sum("gaps")).otherwise(0.0)
    return parts.groupBy("source_id", "attacker", "ability").agg(F.sum("uses").alias("uses"), mean.alias("mean_gap_s"))


def pair_status(rows):
    """rows (seq, ts, effect, applied) on one victim in the log's order -> (seq, ts,
    effect, seconds) of every apply: each release, in order, closes the latest open
    apply of its name (`any`: of any name) with a stamp at or before its own."""
    applies = [[seq, ts, effect, None] for seq, ts, effect, applied in rows if applied]
    for _, ts, effect, applied in rows:
        if applied:
            continue
        for a in reversed(applies):
            if a[3] is None and a[1] <= ts and effect.lower() in ("any", a[2].lower()):
                a[3] = ts - a[1]
                break
    return [tuple(a) for a in applies]


def status_pairing(status: DataFrame) -> DataFrame:
    """status(source_id, encounter_id, seq, ts, victim, ability, damage_type) ->
    every apply with its seconds, null if nothing released it."""

    def group(rows):
        found = pair_status([(r.seq, r.ts, r.ability, r.damage_type == "applied") for r in rows])
        return [(*rows[0][:3], *f) for f in found]

    rows = status.select("source_id", "encounter_id", "seq", "ts", "victim", "ability", "damage_type")
    return in_order(rows, ("source_id", "encounter_id", "victim"), ("seq",), group, "source_id string, encounter_id long, victim string, seq long, ts long, effect string, duration_s long")
