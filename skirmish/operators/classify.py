"""Where damage comes from, and who counts as a player."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import impossible_school, is_self_damage, normalize_ability
from .stats import FIGHT

#: Up to this many abilities the dimension is broadcast.
BROADCAST_ABILITIES = 100_000
#: The sources of damage.
CLASS, RAID, ITEM, PET, SYSTEM = "class", "raid", "item", "pet", "system"
SYSTEM_ABILITIES = ("Auto-Attack", "Killing")


def _dim(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ABILITIES else df


def detect_classes(kept: DataFrame, class_map: DataFrame) -> DataFrame:
    """(fight, combatant, class, votes, mapped): the class of each combatant with
    abilities in the map's spells.  Each distinct ability votes for its classes;
    the winner needs two votes (else class is null), ties go by name."""
    own = kept.where(~is_self_damage() & ~F.col("ability").isin(*SYSTEM_ABILITIES))
    used = own.select(*FIGHT, F.col("attacker").alias("combatant"), "ability").distinct().withColumn("_key", normalize_ability(F.col("ability")))
    voting = class_map.where("layer = 'spells'").select(F.col("ability").alias("_key"), "classes")
    votes = used.join(_dim(voting), "_key").select(*FIGHT, "combatant", "ability", F.explode("classes").alias("class"))
    key = [*FIGHT, "combatant"]
    mapped = votes.groupBy(*key).agg(F.countDistinct("ability").alias("mapped"))
    counts = votes.groupBy(*key, "class").agg(F.count("*").alias("votes"))
    best = counts.groupBy(*key).agg(F.max("votes").alias("votes"), F.min(F.struct((-F.col("votes")).alias("v"), "class")).alias("_b"))
    return best.join(mapped, key).select(*key, F.when(F.col("votes") >= 2, F.col("_b.class")).alias("class"), "votes", "mapped")


def classify_combatants(stats: DataFrame, detected: DataFrame) -> DataFrame:
    """(fight, combatant, kind, class, mapped, owner_name): who is who.

    Unknown is `system`; others that aren't allies are an `enemy`, or a `bystander`
    if nothing passed between them and anyone; allies with a pet's name are a `pet`;
    of the rest, those with mapped abilities are confirmed players, and bucket_fill
    decides who else is one."""
    key = [*FIGHT, "combatant"]
    fight = Window.partitionBy(*FIGHT)
    pet = is_pet_name(F.col("combatant"))
    fixed = F.when(F.col("combatant") == "Unknown", "system").when(~F.col("ally"), F.when(F.col("linked"), "enemy").otherwise("bystander")).when(pet, "pet")
    seconds = F.max(F.col("damage_ts")).over(fight)  # only tells whether time has passed
    rows = stats.join(detected.select(*key, "class", "mapped"), key, "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)))
    rows = rows.withColumns({"_fixed": fixed, "_total": F.sum(F.col("ally").cast("int")).over(fight), "_moving": F.coalesce(seconds > F.min("first_ts").over(fight), F.lit(False))})
    open_ = rows.where("_fixed is null").select(*key, (F.col("mapped") > 0).alias("confirmed"), F.col("_total").alias("total"), F.when(F.col("_moving"), F.col("damage") + F.col("healed")).otherwise(0).alias("worth"))
    filled = bucket_fill(open_).select(*key, "player")
    owner = pet_owner(F.col("combatant"))
    named = rows.join(filled, key, "left").withColumn("_owner", F.upper(owner))
    present = stats.select(*FIGHT, F.upper("combatant").alias("_owner"), F.col("combatant").alias("owner_name"))
    kind = F.coalesce("_fixed", F.when(F.col("player"), "player").otherwise("pet"))
    owned = named.join(present, [*FIGHT, "_owner"], "left").withColumn("kind", kind)
    # Auto-named pets and players have no owner.
    return owned.select(*key, "kind", "class", "mapped", F.when(F.col("_fixed").isin("enemy", "bystander", "pet"), F.col("owner_name")).alias("owner_name"))


def classify_source(used: DataFrame, class_map: DataFrame, overrides: DataFrame, system: DataFrame) -> DataFrame:
    """used(..., ability, class) with `source`.

    class_map(layer, ability, classes), overrides(ability, rank, classes,
    source, pet), system(ability); abilities of the dimensions are normalised.
    The first override whose classes hold the known class (or that names none)
    decides; a pet rule claims abilities of any other known class; then system
    abilities, abilities nobody's class has (item), one's own class, the raid."""
    key = normalize_ability(F.col("ability"))
    classes = class_map.groupBy("ability").agg(F.array_distinct(F.flatten(F.collect_list("classes"))).alias("_classes")).withColumnRenamed("ability", "_key")
    ruled = overrides.groupBy("ability").agg(F.sort_array(F.collect_list(F.struct("rank", "classes", "source"))).alias("_rules"), F.max(F.coalesce("pet", F.lit(False))).alias("_pet")).withColumnRenamed("ability", "_key")
    sys_ = system.select(F.col("ability").alias("_key"), F.lit(True).alias("_system")).distinct()
    rows = used.withColumn("_key", key).join(_dim(classes), "_key", "left").join(_dim(ruled), "_key", "left").join(_dim(sys_), "_key", "left")
    fits = F.filter("_rules", lambda r: r["source"].isNotNull() & (r["classes"].isNull() | F.coalesce(F.array_contains(r["classes"], F.col("class")), F.lit(False))))
    own = F.coalesce(F.array_contains("_classes", F.col("class")), F.lit(False))
    source = (
        F.when(F.size(fits) > 0, fits[0]["source"]).when(F.coalesce("_pet", F.lit(False)) & F.col("class").isNotNull(), PET)
        .when(F.coalesce("_system", F.lit(False)), SYSTEM).when(F.coalesce(F.size("_classes"), F.lit(0)) <= 0, ITEM).when(own, CLASS).otherwise(RAID)
    )
    return rows.withColumn("source", source).drop("_key", "_classes", "_rules", "_pet", "_system")


def granting_classes(class_map: DataFrame, overrides: DataFrame) -> DataFrame:
    """(ability, granted_by): what an override says, else the effects layer,
    else the spells layer."""
    over = overrides.where("granted_by is not null").groupBy("ability").agg(F.min_by("granted_by", "rank").alias("o"))
    effect = class_map.where("layer = 'effects'").select("ability", F.col("classes").alias("e"))
    spell = class_map.where("layer = 'spells'").select("ability", F.col("classes").alias("s"))
    every = over.join(effect, "ability", "full_outer").join(spell, "ability", "full_outer")
    return every.select("ability", F.coalesce("o", "e", "s").alias("granted_by"))


def raid_buff_credit(raid_damage: DataFrame, granting: DataFrame, ally_classes: DataFrame) -> DataFrame:
    """raid_damage(fight, ability, damage), ally_classes(fight, combatant, class): a row
    a granter with an even part, in whole numbers; several share by estimate.  Damage
    that no ally of a granting class accounts for stays, in one row without granter
    and credit."""
    keyed = raid_damage.withColumn("_key", normalize_ability(F.col("ability"))).join(granting.withColumnRenamed("ability", "_key"), "_key", "left")
    classes = F.array_distinct(F.transform(F.coalesce("granted_by", F.array().cast("array<string>")), F.lower))
    by_class = keyed.select(*FIGHT, "ability", "damage", F.explode_outer(classes).alias("class"))
    named = ally_classes.select(*FIGHT, F.col("combatant").alias("granter"), F.lower("class").alias("class"))
    found = by_class.join(named, [*FIGHT, "class"], "left")
    per = Window.partitionBy(*FIGHT, "ability")
    # Of an ability that nobody grants, or by several classes that are all absent, one row.
    n = F.count("granter").over(per)
    first = F.row_number().over(per.orderBy(F.col("granter").isNull(), "granter"))
    rows = found.withColumns({"granters": n, "_r": first}).where("granter is not null or (granters = 0 and _r = 1)")
    credit = F.when(F.col("granters") > 0, F.expr("damage div greatest(granters, 1)"))
    return rows.select(*FIGHT, "ability", "damage", "granter", "granters", credit.alias("credit"), (F.col("granters") > 1).alias("estimated"))


def padded_attacks(kept: DataFrame, classes: DataFrame, least: int = 5) -> DataFrame:
    """(fight, combatant, damage): landed auto-attacks, at least `least` of a school,
    that no weapon of the combatant's class can deal: a renamed pet's."""
    landed = kept.where("category = 1 and ability = 'Auto-Attack' and amount > 0 and damage_type <> ''")
    by_school = landed.groupBy(*FIGHT, F.col("attacker").alias("combatant"), F.lower("damage_type").alias("school")).agg(F.sum("amount").cast("long").alias("damage"), F.count("*").alias("hits"))
    wrong = by_school.join(classes.where("class is not null").select(*FIGHT, "combatant", "class"), [*FIGHT, "combatant"]).where(impossible_school(F.col("class"), F.col("school")) & (F.col("hits") >= least))
    return wrong.groupBy(*FIGHT, "combatant").agg(F.sum("damage").cast("long").alias("damage"))


def sources_report(tagged: DataFrame, padded: DataFrame | None = None) -> DataFrame:
    """tagged(fight, combatant, class, source, damage): damage by source of each
    combatant, those of unknown class marked; padded attacks (see above) move from
    the system's to a pet's."""
    rows = tagged.select(*FIGHT, "combatant", "class", "source", "damage")
    if padded is not None:
        none = F.lit(None).cast("string").alias("class")
        rows = rows.unionByName(padded.select(*FIGHT, "combatant", none, F.lit(SYSTEM).alias("source"), (-F.col("damage")).alias("damage"))).unionByName(padded.select(*FIGHT, "combatant", none, F.lit(PET).alias("source"), "damage"))
    parts = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col("damage"))), F.lit(0)).cast("long").alias(s) for s in (CLASS, RAID, ITEM, PET, SYSTEM)]
    return rows.groupBy(*FIGHT, "combatant").agg(*parts, F.sum("damage").cast("long").alias("total"), F.max("class").isNull().alias("undetected"))


def top_sources(tagged: DataFrame, n: int = 6) -> DataFrame:
    """The n largest abilities of each source in a fight: a top list by design."""
    sums = tagged.groupBy(*FIGHT, "source", "ability").agg(F.sum("damage").cast("long").alias("damage"))
    rank = F.row_number().over(Window.partitionBy(*FIGHT, "source").orderBy(F.desc("damage"), "ability")).cast("long")
    return sums.withColumn("rank", rank).where(F.col("rank") <= n)


def combatant_sources(tagged: DataFrame) -> DataFrame:
    """Abilities within the source, and a subtotal ("All") for each source."""
    rows = tagged.withColumn("ability", F.explode(F.array("ability", F.lit("All"))))
    sums = rows.groupBy("combatant", "source", "ability").agg(F.sum("damage").cast("long").alias("damage"))
    total = F.sum(F.when(F.col("ability") == "All", F.col("damage"))).over(Window.partitionBy("combatant"))
    return sums.withColumn("share", F.when(total > 0, F.col("damage").cast("double") / total.cast("double")).otherwise(0.0))


def padding_alarm(tagged: DataFrame, padded: DataFrame) -> DataFrame:
    """(fight, combatant, reason, damage): combatants with abilities of a pet that
    isn't theirs, or with padded attacks."""
    pets = tagged.where(F.col("source") == PET).groupBy(*FIGHT, "combatant").agg(F.sum("damage").cast("long").alias("damage")).withColumn("reason", F.lit("pet ability"))
    return pets.unionByName(padded.withColumn("reason", F.lit("impossible school")).select(*FIGHT, "combatant", "damage", "reason"))


def bucket_fill(rows: DataFrame) -> DataFrame:
    """rows(fight, combatant, confirmed, total, worth): who counts as a player.

    With 7 to 10 allies in total a group of 6, with more a raid of 24: the most
    useful unconfirmed fill up, the least useful confirmed fall out, ties by name."""
    fight, side = Window.partitionBy(*FIGHT), Window.partitionBy(*FIGHT, "confirmed")
    r = rows.withColumn("_cap", F.when(F.col("total") <= 6, None).when(F.col("total") <= 10, 6).otherwise(24)).withColumn("_sure", F.sum(F.col("confirmed").cast("int")).over(fight))
    up = F.row_number().over(side.orderBy(F.desc("worth"), "combatant"))
    down = F.row_number().over(side.orderBy("worth", "combatant"))
    player = F.when(F.col("_cap").isNull(), F.col("confirmed")).when(F.col("confirmed"), ~(down <= F.col("_sure") - F.col("_cap"))).otherwise(up <= F.col("_cap") - F.col("_sure"))
    return r.withColumn("player", player).drop("_cap", "_sure")


# The shape of generated pet names, and names that it misses.
AUTO_PET = r"(?i)^(?:[gkjxzv]i|[gkjxzv]e|[gkjxzv]a|[gkjxzv]o|je|jo|ja|ze|zo|ke|gi)(?:ba|be|bo|na|ne|ti|an)?(?:b|bn|ber|bekn|btik|tik|ntik|ner|sn|kn|n)$"
KNOWN_PETS = ("Gibab", "Zosn", "Kebn", "Zebekn", "Jentik")


def is_pet_name(name, known: tuple[str, ...] = KNOWN_PETS):
    """Blank, Unknown, a space in it, generated, or one of the known pet names."""
    trimmed = F.trim(name)
    return name.isNull() | (trimmed == "") | (trimmed == "Unknown") | trimmed.contains(" ") | trimmed.rlike(AUTO_PET) | F.lower(trimmed).isin(*[k.lower() for k in known] or [""])


def pet_owner(name):
    """X of "X's hawk" or "Xs' warder"; null for other names."""
    at = F.when(F.instr(name, "'s ") > 1, F.instr(name, "'s ")).when(F.instr(name, "' ") > 1, F.instr(name, "' "))
    return F.substr(name, F.lit(1), at - 1)
