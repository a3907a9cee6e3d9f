"""Swings from the `events` table, so that every batch operator runs on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a swing; category 0 is a plain line of text that carries no action.
SWING_COLUMNS = ("source_id", "owner", "zone", "seq", "ts", "category", "critical", "special", "attacker", "ability", "amount", "victim", "damage_type", "extra", "amount_text")

SCHOOLS = ("crushing", "slashing", "piercing", "heat", "cold", "magic")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("amt"), k.alias("k"))
    kind, k, user, amt = F.col("event_type"), F.col("k"), F.col("user_id"), F.col("amt")
    text = lambda head, number: F.concat(F.lit(head), number.cast("string"))
    signup = F.element_at(F.array(*map(F.lit, (0, 10, 13, 16, 20, 30))), (k % 6 + 1).cast("int"))
    category = F.when(kind == "signup", signup).when(kind == "view", 2).when(kind == "purchase", 3).otherwise(1)
    special = F.when((kind == "click") & (k % 5).isin(1, 2, 3), F.element_at(F.array(*map(F.lit, ("Multi Attack", "Flurry", "AoE Attack"))), (k % 5).cast("int"))).otherwise("None")
    mob = user % 3 == 0
    killing = (kind == "error") & (k % 10 == 0)
    turned = (kind == "error") & (k % 7 == 3)  # dodged or countered: no number of their own
    ability = F.when(killing, "Killing").when(kind.isin("click", "error"), "Auto-Attack").when((kind == "signup") & (k % 6 == 5), "stunned").otherwise(text("Skill ", k % 6))
    amount = F.when(killing, -10).when(turned, -9).when(kind == "error", -1 - k % 5).when((kind == "view") & (k % 11 == 0), 0).when((kind == "signup") & (k % 6).isin(0, 4, 5), 0).otherwise(amt)
    victim = F.when((kind == "purchase") | mob, text("P", (user + k) % 8)).otherwise(text("a mob ", k % 2))
    signup_type = F.when((k % 6).isin(1, 2), "power").when(k % 6 == 3, "threat").when(k % 6 == 4, text("Effect ", k % 3)).when(k % 6 == 5, "applied").otherwise("")
    school = F.element_at(F.array(*map(F.lit, SCHOOLS)), (k % 6 + 1).cast("int"))
    damage_type = F.when(kind == "purchase", "heal").when(killing, "death").when(kind == "error", "avoided").when((kind == "view") & (k % 11 == 0), "none").when(kind == "signup", signup_type).otherwise(school)
    seq = F.col("event_id")
    return e.select(
        text("log-", seq % 3).alias("source_id"),
        text("P", seq % 3).alias("owner"),
        text("Zone ", F.expr("event_id div 200") % 4).alias("zone"),
        seq.alias("seq"),
        (F.lit(1700000000) + seq + 30 * F.expr("event_id div 40")).cast("long").alias("ts"),
        category.cast("int").alias("category"),
        ((k % 4 == 0) & kind.isin("click", "view", "purchase")).alias("critical"),
        special.alias("special"),
        # At the start of a line a mob's article is a capital, here of every third.
        F.when((kind != "purchase") & mob, F.concat(F.when(k % 3 == 1, "A mob ").otherwise("a mob "), (user % 2).cast("string"))).otherwise(text("P", user % 8)).alias("attacker"),
        ability.alias("ability"),
        amount.cast("long").alias("amount"),
        victim.alias("victim"),
        damage_type.alias("damage_type"),
        F.when(killing & (victim == text("P", seq % 3)), "pet-death").alias("extra"),
        F.when(~killing & turned, F.when(k % 2 == 0, "Dodge").otherwise("Counter")).alias("amount_text"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The swings written out as log lines: (source_id, owner, seq, raw).
    Drains have no line of their own and become noise."""
    s = swings(spark, sf_dir)
    amount = F.col("amount").cast("string")
    crit = F.when(F.col("critical"), "a critical of ").otherwise("")
    by = F.concat(F.col("attacker"), F.lit("'s "), F.col("ability"))
    verb = F.when(F.col("special") == "Multi Attack", " multi attacks ").when(F.col("special") == "Flurry", " flurries ").when(F.col("special") == "AoE Attack", " aoe attacks ").otherwise(" hits ")
    outcome = F.element_at(F.array(*map(F.lit, ("misses", "resists", "parries", "ripostes", "blocks"))), (-F.col("amount")).cast("int"))
    hit = F.concat(F.lit(""), F.col("victim"), F.lit(" for "), crit, amount, F.lit(" "), F.col("damage_type"), F.lit(" damage."))
    message = (
        F.when(F.col("damage_type") == "death", F.concat("attacker", F.lit(" has killed "), "victim", F.lit(".")))
        .when(F.col("damage_type") == "avoided", F.concat("attacker", F.lit(" tries to crush "), "victim", F.lit(", but "), F.when(F.col("amount") == -1, F.lit("")).otherwise(F.concat("victim", F.lit(" "))), F.when(F.col("amount").between(-5, -1), outcome).when(F.col("amount_text") == "Dodge", "dodges").otherwise("counters"), F.lit(".")))
        .when(F.col("damage_type") == "none", F.concat(by, F.lit(" hits "), "victim", F.lit(" but fails to inflict any damage.")))
        .when(F.col("category") == 1, F.concat(F.col("attacker"), verb, hit))
        .when(F.col("category") == 2, F.concat(by, F.lit(" hits "), hit))
        .when(F.col("category") == 3, F.concat(by, F.lit(" heals "), "victim", F.lit(" for "), crit, amount, F.lit(" hit points.")))
        .when(F.col("category") == 13, F.concat(by, F.lit(" refreshes "), "victim", F.lit(" for "), amount, F.lit(" mana points.")))
        .when(F.col("category") == 16, F.concat(by, F.lit(" increases THEIR hate with "), "victim", F.lit(" for "), amount, F.lit(" threat.")))
        .when(F.col("category") == 20, F.concat(by, F.lit(" relieves "), "damage_type", F.lit(" from "), "victim", F.lit(".")))
        .when(F.col("category") == 30, F.concat("victim", F.lit(" is stunned!")))
        .otherwise(F.concat(F.lit("A door creaks "), F.col("seq").cast("string"), F.lit(" times.")))
    )
    stamp = F.date_format(F.timestamp_seconds("ts"), "EEE MMM dd HH:mm:ss yyyy")
    raw = F.concat(F.lit("("), F.col("ts").cast("string"), F.lit(")["), stamp, F.lit("] "), message)
    # Through a generator the text is a plain value, not an expression copied into every use.
    return s.select("source_id", "owner", "seq", F.explode(F.array(raw)).alias("raw"))
