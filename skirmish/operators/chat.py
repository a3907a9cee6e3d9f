"""What people and scripted characters say: shared rules, wins told by a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import RULE_ATTRIBUTES, rule_columns
from .rules import cross_source_dedupe
from .sessions import segment

#: How chat marks who speaks.
PLAYER, SCRIPTED, LINK_END = r"\aPC ", r"\aNPC ", r"\/a"
#: Category of a line that belongs to a running encounter and is no action.
SAID = 99


def chat_rule_shares(lines: DataFrame) -> DataFrame:
    """lines(source_id, seq, ts, message) in which a player shares a rule: sharer,
    is_self and the rule's columns.  Lines without a readable rule drop out."""
    message = F.col("message")
    snippet = F.regexp_extract(message, "(?s)(<Trigger.*?/>)", 1)
    own = message.startswith("You say") | message.startswith("You tell")
    name = F.regexp_extract(message, r"(?s)^\\aPC [^:]*:(.*?)\\/a ", 1)
    said = lines.where(message.contains("<Trigger") & (own | message.startswith(PLAYER)))
    said = said.select("source_id", "seq", "ts", own.alias("is_self"), F.when(own, "You").otherwise(name).alias("sharer"), snippet.alias("_s")).where("_s <> '' and sharer <> ''")
    read = said.withColumn("_r", F.explode(F.array(F.from_xml("_s", RULE_ATTRIBUTES, {"rowTag": "Trigger"})))).select("source_id", "seq", "ts", "is_self", "sharer", "_r.*")
    return rule_columns(read, "source_id", "seq", "ts", "is_self", "sharer")


def new_shares(shares: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_id, seq, ts, rule, message): shares of others, without those of
    rules(zone, category, regex) that are defined already."""
    key = F.concat_ws("|", F.lower("zone"), F.lower("category"), "regex")
    new = shares.where("not is_self").withColumn("rule", key).join(rules.select(key.alias("rule")).distinct(), "rule", "left_anti")
    # The text is the same for all logs of a share; a group is a rule's.
    return new.select("source_id", "seq", "ts", "rule", F.col("regex").alias("message"))


def shared_rule_feed(shares: DataFrame, rules: DataFrame, within_s: float = 10.0) -> DataFrame:
    """Shares of others, once for all logs that saw them within `within_s`."""
    return cross_source_dedupe(new_shares(shares, rules), within_s)


def scripted_win_lines(lines: DataFrame, wins: DataFrame) -> DataFrame:
    """Lines in which a speaker of wins(speakers, phrase) says the phrase.  Lines and
    wins meet on the speaker's name."""
    each = wins.select(F.explode("speakers").alias("_speaker"), F.col("phrase").alias("_phrase")).distinct()
    says = F.instr("message", LINK_END + " says")
    talk = lines.where((F.length("message") <= 600) & F.col("message").startswith(SCRIPTED) & (says > 0))
    named = talk.withColumn("_who", F.regexp_extract("message", r":([^:]*?)\\/a says", 1))
    hit = (F.col("_who") == F.col("_speaker")) & F.substr("message", says).contains(F.col("_phrase"))
    return named.join(each, hit, "left_semi").drop("_who")


def scripted_win_flag(swings: DataFrame, win_lines: DataFrame) -> DataFrame:
    """Encounters during which a winning line was said.  win_lines have the
    columns of swings; they take part in the segmentation as lines that neither
    open nor prolong an encounter."""
    said = win_lines.withColumn("category", F.lit(SAID))
    kept = segment(swings.unionByName(said.select(*swings.columns)))
    return kept.where(F.col("category") == SAID).select("source_id", "encounter_id").distinct()
