"""Predicates and scalar functions on swing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISS, RESIST, PARRY, RIPOSTE, BLOCK, UNKNOWN, DEATH = -1, -2, -3, -4, -5, -9, -10
KILLING, UNKNOWN_NAME = "Killing", "Unknown"

#: Archetype of each class.
ARCHETYPES = {
    "Fighter": ("Guardian", "Berserker", "Monk", "Bruiser", "Shadowknight", "Paladin"),
    "Priest": ("Templar", "Inquisitor", "Warden", "Fury", "Mystic", "Defiler", "Channeler"),
    "Scout": ("Swashbuckler", "Brigand", "Troubador", "Dirge", "Ranger", "Assassin", "Beastlord"),
    "Mage": ("Wizard", "Warlock", "Illusionist", "Coercer", "Conjuror", "Necromancer"),
}

#: The effect behind a status word, how it is called out, and the
#: schools that a class can't strike with.
CONTROL = {"stun": ("stunned", "stupified"), "stifle": ("silenced",), "mez": ("mesmerized", "dazzled"), "fear": ("terrified", "afraid", "feared"), "root": ("frozen", "rooted"), "snare": ("snared",), "daze": ("dazed",)}
CALLED = {"stun": "stunned", "stifle": "stifled", "mez": "mesmerized", "fear": "feared", "root": "rooted", "snare": "snared", "daze": "dazed", "charm": "charmed", "knockup": "knocked up"}
BLUNT = ("Templar", "Inquisitor")
NEVER_SLASH = BLUNT + ("Mystic", "Defiler", "Wizard", "Warlock", "Illusionist", "Coercer", "Necromancer", "Conjuror")


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def canonical_control(word: Column) -> Column:
    """The control effect of a status word; null if it is none."""
    return _named(word, {w: effect for effect, words in CONTROL.items() for w in words})


def callout_word(effect: Column) -> Column:
    return F.coalesce(_named(effect, CALLED), effect)


def impossible_school(cls: Column, school: Column) -> Column:
    """No weapon of the class does such damage."""
    among = lambda classes: F.lower(cls).isin(*[c.lower() for c in classes])
    return F.coalesce(F.when(F.lower(school) == "slashing", among(NEVER_SLASH)).when(F.lower(school) == "piercing", among(BLUNT)), F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.upper(a) == F.upper(b)


def is_hostile() -> Column:
    return F.col("category").isin(1, 2) & (F.col("ability") != KILLING) & ~same(F.col("attacker"), F.col("victim"))


def is_self_damage() -> Column:
    return F.col("category").isin(1, 2) & same(F.col("attacker"), F.col("victim"))


def is_death(amount="amount") -> Column:
    return F.col(amount) == DEATH


def is_hit(amount="amount") -> Column:
    return F.col(amount) >= 0


def clamp_amount(amount: Column) -> Column:
    """Numbers below the sentinels count as unknown."""
    return F.when(amount < DEATH, UNKNOWN).otherwise(amount)


def amount_class(amount: Column) -> Column:
    return (
        F.when(amount > 0, "damage").when(amount == 0, "none")
        .when(amount == MISS, "miss").when(amount == RESIST, "resist").when(amount == PARRY, "parry")
        .when(amount == RIPOSTE, "riposte").when(amount == BLOCK, "block").when(amount == DEATH, "death").otherwise("unknown")
    )


def avoid_kind(amount: Column, text: Column) -> Column:
    """How an attack without a number was turned aside: what has none of its own is a
    dodge, or a counter where the text says so.  Null for hits."""
    named = F.when(amount == MISS, "miss").when(amount == RESIST, "resist").when(amount == PARRY, "parry").when(amount == RIPOSTE, "riposte").when(amount == BLOCK, "block")
    return F.when(amount < 0, F.coalesce(named, F.when(text == "Counter", "counter").otherwise("dodge")))


def looks_like_player(name: Column) -> Column:
    return (F.length(name) > 0) & ~name.contains(" ") & (name != UNKNOWN_NAME)


def is_boss_title(title: Column) -> Column:
    """Neither a placeholder nor "a ..." or "an ..."."""
    low = F.lower(title)
    return F.coalesce((F.length(title) > 0) & (low != "encounter") & ~low.startswith("a ") & ~low.startswith("an "), F.lit(False))


def normalize_ability(name: Column) -> Column:
    """Trimmed, without a trailing roman numeral, in lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+[IVXLCDM]+$", ""))


def strip_instance_no(zone: Column) -> Column:
    return F.regexp_replace(zone, r"\s+\d+$", "")


def archetype_of(cls: Column) -> Column:
    pairs = [F.lit(x) for arch, classes in ARCHETYPES.items() for c in classes for x in (c.lower(), arch)]
    return F.create_map(*pairs)[F.lower(cls)]


def avoid_actor(extra: Column, victim: Column) -> Column:
    """Who turned an attack aside: self, a weapon of the victim, or a helper."""
    actor = F.substring(extra, 4, 1000)
    return F.when(extra.isNull() | ~extra.startswith("by="), "self").when(same(actor, victim), "self").when(F.upper(actor).startswith(F.concat(F.upper(victim), F.lit("'S "))), "(weapon)").otherwise(actor)


def grouped(amount: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(amount, 0)


def contains_amount(raw: Column, amount: Column) -> Column:
    """The line shows the amount plain, grouped, or shortened to K, M or B."""
    short = F.lit(False)
    for mark, unit in (("K", 1_000), ("M", 1_000_000), ("B", 1_000_000_000)):
        tenths = (amount * 10 / unit).cast("long")
        shown = F.concat((tenths / 10).cast("long").cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit(mark))
        short = short | ((amount >= unit) & raw.contains(shown))
    return raw.contains(grouped(amount)) | raw.contains(amount.cast("string")) | short


def is_live(ts: Column, observed_ms: Column, fresh_s: int = 30) -> Column:
    return observed_ms.isNull() | (observed_ms - ts * 1000 < fresh_s * 1000)


def per_second(total: Column, seconds: Column) -> Column:
    """A rate over whole seconds, at least one."""
    return total.cast("double") / F.greatest(seconds, F.lit(1)).cast("double")


def rounded_rate(total: Column, seconds: Column) -> Column:
    """A rate to two places, halves to the even side; 0 without time."""
    return F.when(seconds > 0, F.bround(total.cast("decimal(20,0)") / seconds.cast("decimal(20,0)"), 2).cast("double")).otherwise(0.0)


def rounded_percent(part: Column, whole: Column) -> Column:
    return rounded_rate(part * 100, whole)
