"""Log lines to typed actions, with native column expressions.

A line is first tested by cheap literals, then by the family's patterns in
order; the groups of the one that fits are taken out by a single replacement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import same

HEADER = r"^\((\d+)\)\[[^\]]*\] (.*)$"
MAX_LINE = 16 * 1024
_SEP = "\x01"

# The shapes of the lines.
VERBS = "(hits|hit|multi attacks|double attacks|flurries|aoe attacks)"
AMOUNT = r"([\d,]+(?:\.\d+)?[KMB]?)"
CRIT = "(a critical of )?"
TAIL = f"(.+?) for {CRIT}{AMOUNT} (\\w+) damage\\.$"
OUTCOMES = "misses|parries|ripostes|blocks|resists|dodges|counters|block|resist|riposte|parry|dodge|counter"
WARD = rf"absorbs {AMOUNT} points? of damage from being done to (.+?)\.(?: \({AMOUNT} points? remaining\))?$"
EFFECTS = "stunned|mesmerized|stupified|confused|unnerved|dazzled|gloomy|afraid|feared|disoriented|seared|dazed|rooted|snared"


@dataclass(frozen=True)
class Shape:
    family: str
    guard: str  # SQL over `message`
    pattern: str
    groups: tuple[str, ...]
    fixed: tuple[tuple[str, str], ...] = ()


def _shape(family, guard, pattern, groups, **fixed):
    return Shape(family, guard, "(?dU)" + pattern, tuple(groups.split()), tuple(fixed.items()))


_D = "endswith(message, ' damage.') and not endswith(message, ' but fails to inflict any damage.')"
_N = "endswith(message, ' but fails to inflict any damage.')"
_GONE = "contains(message, ' is no longer ')"
SHAPES = (
    _shape("none", _N, r"^YOUR (.+?) hits (.+?) but fails to inflict any damage\.$", "ability victim", attacker="YOU"),
    _shape("none", _N, r"^(.+?)'s? (.+?) hits (.+?) but fails to inflict any damage\.$", "attacker ability victim"),
    _shape("none", _N, r"^(.+?) hits (.+?) but fails to inflict any damage\.$", "attacker victim", ability="Auto-Attack"),
    _shape("damage", _D, rf"^YOUR (.+?) {VERBS} {TAIL}", "ability verb victim crit amount school", attacker="YOU"),
    _shape("damage", _D, rf"^YOU {VERBS} {TAIL}", "verb victim crit amount school", attacker="YOU", ability="Auto-Attack"),
    _shape("damage", _D + " and contains(message, ' is hit by ')", rf"^(.+?) is hit by (.+?) for {CRIT}{AMOUNT} (\w+) damage\.$", "victim ability crit amount school", attacker="Unknown"),
    _shape("damage", _D, rf"^(.+?)'s? (.+?) {VERBS} {TAIL}", "attacker ability verb victim crit amount school"),
    _shape("damage", _D, rf"^(.+?) {VERBS} {TAIL}", "attacker verb victim crit amount school", ability="Auto-Attack"),
    _shape("avoid", "contains(message, ' tries to ')", rf"^(.+?) tries to (\w+) (.+?), but (?:(.+?) )?({OUTCOMES})\.$", "attacker verb victim actor outcome"),
    _shape("heal", "contains(message, ' heals ')", rf"^YOUR (.+?) heals (.+?) for {CRIT}{AMOUNT} hit points?\.$", "ability victim crit amount", attacker="YOU"),
    _shape("heal", "contains(message, ' heals ')", rf"^(.+?)'s? (.+?) heals (.+?) for {CRIT}{AMOUNT} hit points?\.$", "attacker ability victim crit amount"),
    _shape("avoid", "startswith(message, 'YOU try to ')", rf"^YOU try to (\w+) (.+?),? but (?:(.+?) )?(miss|{OUTCOMES})\.$", "verb victim actor outcome", attacker="YOU"),
    _shape("ward", "contains(message, ' absorbs ')", rf"^YOUR (.+?) {WARD}", "ability amount victim remaining", attacker="YOU"),
    _shape("ward", "contains(message, ' absorbs ')", rf"^(.+?)'s? (.+?) {WARD}", "attacker ability amount victim remaining"),
    _shape("power", "contains(message, ' refreshes ')", rf"^YOUR (.+?) refreshes (.+?) for {AMOUNT} (?:mana|power) points?\.$", "ability victim amount", attacker="YOU"),
    _shape("power", "contains(message, ' refreshes ')", rf"^(.+?)'s? (.+?) refreshes (.+?) for {AMOUNT} (?:mana|power) points?\.$", "attacker ability victim amount"),
    _shape("threat", "contains(message, ' hate with ')", rf"^YOUR (.+?) (increases|reduces) YOUR hate with (.+?) for {AMOUNT} threat\.$", "ability direction victim amount", attacker="YOU"),
    _shape("threat", "contains(message, ' hate with ')", rf"^(.+?)'s? (.+?) (increases|reduces) (?:THEIR|YOUR) hate with (.+?) for {AMOUNT} threat\.$", "attacker ability direction victim amount"),
    _shape("cure", "contains(message, ' relieves ')", r"^YOUR (.+?) relieves (.+?) from (.+?)\.$", "ability effect victim", attacker="YOU"),
    _shape("cure", "contains(message, ' relieves ')", r"^(.+?)'s? (.+?) relieves (.+?) from (.+?)\.$", "attacker ability effect victim"),
    _shape("applied", "endswith(message, '!')", rf"^(.+?) is (?:totally )?({EFFECTS})(?: by .+?)?!$", "victim effect"),
    _shape("applied", "endswith(message, '!')", r"^(.+?) is briefly frozen in place!$", "victim", effect="frozen"),
    _shape("applied", "endswith(message, '!')", r"^(.+?) looks terrified!$", "victim", effect="terrified"),
    _shape("applied", "endswith(message, '!')", r"^(.+?) is consumed by gloom!$", "victim", effect="gloomy"),
    _shape("released", _GONE, r"^(.+?) is no longer ([a-z]+)\.$", "victim effect"),
    _shape("released", _GONE, r"^(.+?) is no longer affected by (.+?)\.$", "victim effect"),
    _shape("applied", "contains(message, ' silences ')", r"^(.+?) silences (.+?)'s actions\.$", "attacker victim", effect="silenced"),
    _shape("released", "(contains(message, ' regains ') or endswith(message, ' returns to normal.')) and not startswith(message, 'Your ')", r"^(.+?) (?:regains (?:[Tt]heir wits|[Hh]is composure|[Hh]er composure|[Ii]ts composure|[Tt]heir composure)|returns to normal)\.$", "victim", effect="any"),
    _shape("released", "contains(message, ' no longer appears ')", r"^(.+?) no longer appears ([a-z]+)\.$", "victim effect"),
    _shape("released", "contains(message, ' fades from ')", r"^The (.+?) fades from (.+?)\.$", "effect victim"),
    _shape("death", "startswith(message, 'You have killed ')", r"^You have killed (.+?)\.$", "victim", attacker="YOU"),
    _shape("death", "startswith(message, 'Alas, ')", r"^Alas, (.+?) has died(?: from pain and suffering)?\.$", "victim", attacker="Unknown"),
    _shape("death", "contains(message, ' has been slain by ')", r"^(.+?) has been slain by (.+?)!$", "victim attacker"),
    _shape("death", "contains(message, ' has killed ')", r"^(.+?) has killed (.+?)\.$", "attacker victim"),
    _shape("death", "endswith(message, ' dies.') and not endswith(message, ' sputters and dies.')", r"^(.+?) dies\.$", "victim", attacker="Unknown"),
    _shape("death", "endswith(message, ' has been banished!')", r"^(.+?)(?:'s)? has been banished!$", "victim", attacker="Unknown"),
    _shape("zone", "startswith(message, 'You have entered ')", r"^You have entered (.+?)\.$", "zone"),
    _shape("lockout", "startswith(message, 'This instance will expire in ')", r"^This instance will expire in (.*?)[. ]*$", "body"),
)
FIELDS = ("attacker", "ability", "verb", "victim", "crit", "amount", "school", "actor", "outcome", "remaining", "direction", "effect", "zone", "body")
# A line that reads "... sputters and dies." ends the search, so shapes after "dies" don't see it.
_STOP = "endswith(message, ' sputters and dies.')"


def parse_header(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ts and message; drops malformed and overlong lines."""
    parts = F.split(F.regexp_replace(raw, "(?d)" + HEADER, f"$1{_SEP}$2"), _SEP, 2)
    fits = F.col(raw).rlike("(?d)" + HEADER) & (F.length(raw) <= MAX_LINE)
    return lines.where(fits).withColumn("_h", parts).withColumns({"ts": F.expr("try_cast(_h[0] as bigint)"), "message": F.col("_h")[1]}).drop("_h").where("ts is not null")


def parse_amount(text: Column) -> Column:
    """1,234 or 140.6K or 2M as a whole number, halves to the even side."""
    unit = F.when(text.endswith("K"), 1_000).when(text.endswith("M"), 1_000_000).when(text.endswith("B"), 1_000_000_000).otherwise(1)
    return F.bround(F.regexp_replace(text, "[,KMB]", "").cast("decimal(24,4)") * unit.cast("decimal(10,0)"), 0).cast("long")


def normalize_special(verb: Column) -> Column:
    return F.when(verb.isin("multi attacks", "double attacks"), "Multi Attack").when(verb == "flurries", "Flurry").when(verb == "aoe attacks", "AoE Attack").otherwise("None")


def lockout_seconds(body: Column) -> Column:
    """"3 days 23 hours" in seconds; null for anything else."""
    parts = F.filter(F.split(body, " "), lambda x: x != "")
    unit = lambda x: F.when(F.rtrim(x, F.lit("s")) == "day", 86400).when(F.rtrim(x, F.lit("s")) == "hour", 3600).when(F.rtrim(x, F.lit("s")) == "minute", 60)
    numbers = F.filter(parts, lambda x, i: i % 2 == 0)
    units = F.filter(parts, lambda x, i: i % 2 == 1)
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: F.when(n.rlike("^[0-9]{1,9}$"), n).cast("long") * unit(u)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when((F.size(parts) > 0) & (F.size(parts) <= 6) & (F.size(parts) % 2 == 0) & (total > 0), total)


def parse(lines: DataFrame) -> DataFrame:
    """lines(message, owner, ...) -> the same with family and the fields of a
    swing, a zone or a lockout; family is null where nothing fits."""
    # One replacement takes out the family and every field, in the order of FIELDS, whatever the shape.
    def layout(s):
        return _SEP.join([s.family, *(f"${s.groups.index(f) + 1}" if f in s.groups else dict(s.fixed).get(f, "") for f in FIELDS)])

    cases = " ".join(f"when ({s.guard}) and message rlike {_quoted(s.pattern)} then regexp_replace(message, {_quoted(s.pattern)}, {_quoted(layout(s))})" for s in SHAPES)
    taken = F.expr(f"case when {_STOP} and not contains(message, ' has killed ') then null {cases} end")
    # Through a generator the fields are plain values to the optimizer: it evaluates
    # the patterns once, and doesn't copy them into every use and predicate.
    named = lines.withColumn("_g", F.explode(F.array(F.split(taken, _SEP, -1))))
    raw = named.select("*", F.col("_g")[0].alias("family"), *[F.when(F.col("_g")[i] != "", F.col("_g")[i]).alias(f"_{f}") for i, f in enumerate(FIELDS, 1)])
    return _typed(raw).drop("_g", *[f"_{f}" for f in FIELDS])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def resolve_you(name: Column, owner: Column) -> Column:
    return F.when(F.lower(name).isin("you", "yourself"), owner).otherwise(name)


def _typed(raw: DataFrame) -> DataFrame:
    family, victim, actor = F.col("family"), F.col("_victim"), F.col("_actor")
    # "tries to slash Bob with Barrage": the ability follows the true victim's name, else the first " with ".
    known = actor.isNotNull() & victim.startswith(F.concat(actor, F.lit(" with ")))
    at = F.instr(victim, " with ")
    split_ability = F.when(known, F.substr(victim, F.length(actor) + 7)).when(at > 1, F.substr(victim, at + 6)).otherwise("Auto-Attack")
    split_victim = F.when(known, actor).when(at > 1, F.substr(victim, F.lit(1), at - 1)).otherwise(victim)
    avoid = family == "avoid"
    true_victim = F.when(avoid, split_victim).otherwise(victim)
    special = F.when(family == "damage", normalize_special(F.col("_verb"))).otherwise("None")
    ability = F.when(avoid, split_ability).when(family.isin("applied", "released"), F.col("_effect")).when(family == "death", "Killing").otherwise(F.col("_ability"))
    auto = (ability == "Auto-Attack") | (special != "None")
    category = (
        F.when(family == "damage", F.when(auto, 1).otherwise(2)).when(family.isin("none", "avoid"), F.when(ability == "Auto-Attack", 1).otherwise(2))
        .when(family.isin("heal", "ward"), 3).when(family == "power", 13).when(family == "threat", 16).when(family == "cure", 20)
        .when(family.isin("applied", "released"), 30).when(family == "death", 1).cast("int")
    )
    out = F.col("_outcome")
    avoided = F.when(out.isin("misses", "miss"), -1).when(out.isin("resists", "resist"), -2).when(out.isin("parries", "parry"), -3).when(out.isin("ripostes", "riposte"), -4).when(out.isin("blocks", "block"), -5).otherwise(-9)
    amount = F.when(avoid, avoided).when(family == "death", -10).when(family.isin("none", "cure", "applied", "released"), 0).otherwise(parse_amount(F.col("_amount"))).cast("long")
    amount_text = F.when(avoid, F.when(out.isin("counters", "counter"), "Counter").when(out.isin("dodges", "dodge"), "Dodge"))
    damage_type = (
        F.when(family == "damage", F.col("_school")).when(avoid, "avoided").when(family == "none", "none").when(family == "heal", "heal").when(family == "ward", "Ward (Absorb)")
        .when(family == "power", "power").when(family == "threat", F.when(F.col("_direction") == "reduces", "threat-reduce").otherwise("threat"))
        .when(family == "cure", F.col("_effect")).when(family == "death", "death").otherwise(family)
    )
    by = F.when(avoid & actor.isNotNull() & ~same(actor, true_victim), F.concat(F.lit("by="), resolve_you(actor, F.col("owner"))))
    left = F.when((family == "ward") & F.col("_remaining").isNotNull(), F.concat(F.lit("remaining="), parse_amount(F.col("_remaining")).cast("string")))
    pet = F.when((family == "death") & same(victim, F.col("owner")), "pet-death")
    swing = ~family.isin("zone", "lockout")
    return raw.withColumns({
        "category": category,
        "critical": F.when(swing, F.col("_crit").isNotNull()),
        "special": F.when(swing, special),
        "attacker": F.when(swing, resolve_you(F.coalesce("_attacker", F.lit("Unknown")), F.col("owner"))),
        "ability": F.when(swing, ability),
        "amount": F.when(swing, amount),
        "amount_text": F.when(swing, amount_text),
        "victim": F.when(swing, resolve_you(true_victim, F.col("owner"))),
        "damage_type": F.when(swing, damage_type),
        "extra": F.coalesce(by, left, pet),
        "zone_entered": F.col("_zone"),
        "lockout_s": F.when(family == "lockout", lockout_seconds(F.col("_body"))),
    })


def grammar_coverage(parsed: DataFrame, top: int = 40) -> DataFrame:
    """The most frequent templates of lines that nothing fits."""
    template = F.regexp_replace(F.regexp_replace("message", r"\\aITEM [^:]*:[^\\]*\\/a", "<link>"), r"\d+", "N")
    first = F.array_join(F.slice(F.split(template, " "), 1, 10), " ")
    return parsed.where("family is null").groupBy(first.alias("template")).agg(F.count("*").alias("n_lines")).orderBy(F.desc("n_lines"), "template").limit(top)
