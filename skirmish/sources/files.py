"""Log files in, and the folder for tables that jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grammar import parse_header
from ..functions.scalars import contains_amount, normalize_ability


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a local session gets a folder of its
    own; on a cluster, where executors wouldn't see that, it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="skirmish-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what several passes read is
    computed once, and a lost executor costs no more than its own work."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _named(lines: DataFrame) -> DataFrame:
    """Owner from eq2log_<Owner>.txt; server from the folder, none for "logs"."""
    path = F.col("source_id")
    server = F.element_at(F.split(path, "/"), -2)
    return lines.withColumn("owner", F.regexp_extract(path, r"eq2log_([^./]+)\.[^/]*txt$", 1)).withColumn("server", F.when(F.lower(server) == "logs", "").otherwise(server))


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, owner, server, seq, ts, message) of the log files under path.
    A file may be read in several splits: lines are numbered by the split's
    place and their order in it."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    parsed = parse_header(raw)
    order = Window.partitionBy("source_id", "_block").orderBy("_id")
    sizes = parsed.groupBy("source_id", "_block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = parsed.withColumn("_n", F.row_number().over(order)).join(sizes.select("source_id", "_block", before.alias("_before")), ["source_id", "_block"])
    return _named(numbered.select("source_id", (F.col("_before") + F.col("_n")).alias("seq"), "ts", "message"))


#: What lies between the numbers of two chunks' first lines: a chunk is one value, which
#: can't have as many lines.
CHUNK_LINES = 1 << 31


def stream_log_text(spark: SparkSession, path: str, max_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """(source_id, owner, server, seq, ts, message) of logs that land in chunks,
    eq2log_<Owner>.<number>.txt: the chunks of a name are one source, and lines are
    numbered through them.  A chunk is read as a whole, so that its lines keep their
    places; the checkpoint is the resume point."""
    raw = spark.readStream.format("text").option("recursiveFileLookup", "true").option("wholetext", "true").option("maxBytesPerTrigger", str(max_bytes)).load(path)
    file = F.col("_metadata.file_path")
    lines = raw.select(F.regexp_replace(file, r"\.\d+\.txt$", ".txt").alias("source_id"), F.regexp_extract(file, r"\.(\d+)\.txt$", 1).alias("_chunk"), F.posexplode(F.split("value", "\r?\n")).alias("_at", "raw"))
    number = F.coalesce(F.expr("try_cast(_chunk as bigint)"), F.lit(0)) * CHUNK_LINES + F.col("_at") + 1
    return _named(parse_header(lines.withColumn("seq", number)).select("source_id", "seq", "ts", "message"))


def read_log_window(lines: DataFrame, at_ts: int, before_s: int, after_s: int, n: int) -> DataFrame:
    """The last n lines before a moment and the first n from it, in a span: the
    feature is an excerpt."""
    near = lines.where(F.col("ts").between(at_ts - before_s, at_ts + after_s))
    late = F.col("ts") >= at_ts
    by = Window.partitionBy("source_id", late)
    nth = F.when(late, F.row_number().over(by.orderBy("seq"))).otherwise(F.row_number().over(by.orderBy(F.desc("seq"))))
    return near.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def swing_log_focus(swings: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_id, seq, line_seq): for each action the first raw line of its second
    that shows its amount (if above 0) and names its ability (unless auto-attack);
    null if there is none.  lines(source_id, seq, ts, raw)."""
    named = lines.select("source_id", "ts", F.col("seq").alias("line_seq"), "raw")
    shows = (F.col("amount") <= 0) | contains_amount(F.col("raw"), F.col("amount"))
    names = (F.col("ability") == "Auto-Attack") | F.col("raw").contains(F.col("ability"))
    found = swings.join(named, ["source_id", "ts"]).where(shows & names).groupBy("source_id", "seq").agg(F.min("line_seq").alias("line_seq"))
    return swings.select("source_id", "seq").join(found, ["source_id", "seq"], "left")


def zone_seed(parsed: DataFrame, starts: DataFrame) -> DataFrame:
    """Each source's zone at a place in its log, starts(source_id, before_seq), and
    the end of the lockout told within the next three lines (none otherwise)."""
    zones = parsed.where("zone_entered is not null").select("source_id", "seq", "zone_entered").join(starts, "source_id").where("seq < before_seq")
    last = zones.groupBy("source_id").agg(F.max(F.struct("seq", "zone_entered")).alias("_z"))
    told = parsed.where("lockout_s is not null").select("source_id", F.col("seq").alias("_at"), "ts", "lockout_s")
    near = last.select("source_id", F.explode(F.sequence(F.col("_z.seq") + 1, F.col("_z.seq") + 3)).alias("_at")).join(told, ["source_id", "_at"]).groupBy("source_id").agg(F.min(F.struct("_at", (F.col("ts") + F.col("lockout_s")).alias("expiry"))).alias("_t"))
    return last.join(near, "source_id", "left").select("source_id", F.col("_z.zone_entered").alias("zone"), F.col("_t.expiry").alias("instance_expiry"))


#: The fields of a pack.
PACK = (
    "zones array<struct<zone:string, encounters:array<struct<mob:string, triggers:array<struct<regex:string, sound_data:string, sound_type:int, category_restrict:boolean, category:string, timer:boolean, timer_name:string, active:boolean, cooldown_seconds:double>>,"
    " spell_timers:array<struct<name:string, checked:boolean, timer_duration_s:int, warning_value:int, remove_value:int, only_master_ticks:boolean, restrict:boolean, absolute:boolean, modable:boolean, panel1:boolean, panel2:boolean, category:string, restrict_category:boolean, damage_type:string, control_effect:string>>>>>>"
)


def _pack(spark: SparkSession, path: str, which: str) -> DataFrame:
    pack = spark.read.option("multiLine", "true").schema(PACK).json(path)
    deep = pack.select(F.explode("zones").alias("z")).select(F.col("z.zone").alias("zone"), F.explode("z.encounters").alias("e"))
    return deep.select("zone", F.col("e.mob").alias("mob"), F.explode(f"e.{which}").alias("t"))


def _or(column: str, default):
    return F.coalesce(F.col(column), F.lit(default))


def read_rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a nested pack: zones[].encounters[].triggers[].  Without a pattern it
    is none; the category defaults to the mob."""
    t = _pack(spark, path, "triggers").where("t.regex <> ''")
    return t.select(
        "zone", F.coalesce("t.category", "mob").alias("category"), F.col("t.regex").alias("regex"), _or("t.active", False).alias("enabled"), F.when(F.col("t.sound_type").between(0, 3), F.col("t.sound_type")).otherwise(0).alias("sound_type"), _or("t.sound_data", "").alias("sound_data"),
        _or("t.category_restrict", False).alias("restrict_zone"), (_or("t.timer", False) & (_or("t.timer_name", "") != "")).alias("starts_timer"), _or("t.timer_name", "").alias("timer_name"), F.greatest(F.lit(0.0), F.least(F.lit(3600.0), _or("t.cooldown_seconds", 0.0))).alias("cooldown_s"),
    )


def read_pack_timers(spark: SparkSession, path: str) -> DataFrame:
    """Timer definitions of the same pack: zones[].encounters[].spell_timers[]."""
    t = _pack(spark, path, "spell_timers").where("t.name <> ''")
    numbers = {"duration_s": "timer_duration_s", "warning_s": "warning_value", "remove_s": "remove_value"}
    flags = {"only_master": "only_master_ticks", "restrict_me": "restrict", "absolute": "absolute", "modable": "modable", "panel1": "panel1", "panel2": "panel2", "restrict_category": "restrict_category"}
    return t.select(
        "zone", F.coalesce("t.category", "mob").alias("category"), F.col("t.name").alias("name"), _or("t.checked", False).alias("enabled"),
        *[_or(f"t.{v}", 0).alias(k) for k, v in numbers.items()], *[_or(f"t.{v}", False).alias(k) for k, v in flags.items()], _or("t.damage_type", "").alias("damage_type"), _or("t.control_effect", "").alias("control_effect"),
    )


#: The attributes of a rule in the short and the long dialect.
_DIALECTS = {"regex": ("R", "Regex"), "category": ("C", "Category"), "sound_type": ("ST", "SoundType"), "starts_timer": ("T", "Timer"), "timer_name": ("TN", "TimerName"), "restrict_zone": ("CR", "CategoryRestrict"), "zone": ("Z", "Zone"), "active": ("A", "Active")}
RULE_ATTRIBUTES = ", ".join(f"_{n} string" for pair in _DIALECTS.values() for n in pair)


def rule_columns(raw: DataFrame, *kept: str) -> DataFrame:
    """Rules from the attributes of either dialect, with defaults; the columns
    named stay.  A rule without a pattern or a category is none."""
    out = raw.select(*kept, *[F.coalesce(f"_{a}", f"_{b}").alias(k) for k, (a, b) in _DIALECTS.items()])
    sound = F.expr("try_cast(sound_type as int)")
    return out.where("regex <> '' and trim(category) <> ''").select(*kept, "regex", F.trim("category").alias("category"), F.when(sound.between(0, 3), sound).otherwise(0).alias("sound_type"), _flag("starts_timer", False).alias("starts_timer"), F.coalesce("timer_name", F.lit("")).alias("timer_name"), _flag("restrict_zone", False).alias("restrict_zone"), F.trim(F.coalesce("zone", F.lit(""))).alias("zone"), _flag("active", True).alias("enabled"))


def _flag(column: str, default: bool):
    return F.coalesce(F.upper(column).isin("T", "TRUE", "1"), F.lit(default))


#: The attributes of a timer in both dialects, with what stands in for
#: missing ones; a flag that is on unless told otherwise is off at F or False only.
_TIMER = {"name": ("N", "Name"), "category": ("C", "Category"), "zone": ("Z", "Zone"), "checked": ("Checked", "Checked"), "duration_s": ("T", "Timer"), "warning_s": ("WV", "WarningValue"), "remove_s": ("RV", "RemoveValue"), "absolute": ("A", "Absolute"), "restrict_me": ("R", "Restrict"), "restrict_category": ("RC", "RestrictCategory"), "only_master": ("OM", "OnlyMasterTicks"), "modable": ("M", "Modable"), "panel1": ("Panel1", "Panel1"), "panel2": ("Panel2", "Panel2")}
_TIMER_NUMBERS = {"duration_s": 30, "warning_s": 10, "remove_s": -15}
TIMER_ATTRIBUTES = ", ".join(f"_{n} string" for n in dict.fromkeys(n for pair in _TIMER.values() for n in pair))


def timer_columns(raw: DataFrame) -> DataFrame:
    """Timer definitions from the attributes of either dialect, with defaults; a
    definition without a name or a category is none."""
    out = raw.select(*[F.coalesce(f"_{a}", f"_{b}").alias(k) for k, (a, b) in _TIMER.items()]).where("name <> '' and trim(category) <> ''")
    numbers = [F.coalesce(F.expr(f"try_cast({k} as int)"), F.lit(v)).alias(k) for k, v in _TIMER_NUMBERS.items()]
    flags = [F.coalesce(F.upper(k).isin("T", "TRUE"), F.lit(False)).alias(k) for k in ("absolute", "restrict_me", "restrict_category", "only_master", "panel2")]
    unless = [(~F.coalesce(F.upper(k).isin("F", "FALSE"), F.lit(False))).alias(k) for k in ("modable", "panel1")]
    return out.select("name", F.trim("category").alias("category"), F.trim(F.coalesce("zone", F.lit(""))).alias("zone"), F.coalesce(F.upper("checked").isin("T", "TRUE"), F.lit(True)).alias("enabled"), *numbers, *flags, *unless)


def _elements(spark: SparkSession, path: str, tag: str, attributes: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(attributes).load(path)


def read_rule_xml(spark: SparkSession, path: str) -> DataFrame:
    """Trigger definitions in either attribute dialect."""
    return rule_columns(_elements(spark, path, "Trigger", RULE_ATTRIBUTES))


def read_timer_xml(spark: SparkSession, path: str) -> DataFrame:
    """Timer definitions (Spell elements) in either attribute dialect."""
    return timer_columns(_elements(spark, path, "Spell", TIMER_ATTRIBUTES))


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """(kind, all_rows, bad_rows): the elements of an export, and how many of them
    lack what a definition needs."""
    out = None
    for kind, tag, attributes, first in (("trigger", "Trigger", RULE_ATTRIBUTES, _DIALECTS["regex"]), ("timer", "Spell", TIMER_ATTRIBUTES, _TIMER["name"])):
        raw = _elements(spark, path, tag, attributes)
        lacks = (F.coalesce(*[F.col(f"_{n}") for n in first], F.lit("")) == "") | (F.trim(F.coalesce("_C", "_Category", F.lit(""))) == "")
        row = raw.agg(F.count("*").alias("all_rows"), F.coalesce(F.sum(lacks.cast("int")), F.lit(0)).cast("long").alias("bad_rows")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


# --- dimensions ---------------------------------------------------------------
def class_map_rows(raw: DataFrame) -> DataFrame:
    """(layer, ability, classes) from maps spells and effects: ability -> classes."""
    both = [raw.select(F.lit(layer).alias("layer"), F.explode(layer).alias("ability", "classes")) for layer in ("spells", "effects")]
    return both[0].unionByName(both[1])


def override_rows(raw: DataFrame, first: int = 0) -> DataFrame:
    """(ability, rank, classes, source, pet, granted_by) from overrides in a file's
    order; an entry without an ability is none, one with an unknown source or none only grants.
    A pet's kit needs classes that own it."""
    one = raw.select(F.posexplode("overrides").alias("_at", "o")).where("o.ability <> ''")
    classes = F.when(F.size("o.classes") > 0, F.col("o.classes"))
    source = F.lower("o.source")
    return one.select(normalize_ability(F.col("o.ability")).alias("ability"), (F.col("_at") + first).cast("int").alias("rank"), classes.alias("classes"), F.when(source.isin("class", "raid", "item", "pet", "system"), source).alias("source"), (F.coalesce("o.pet", F.lit(False)) & classes.isNotNull()).alias("pet"), F.when(F.size("o.grantedBy") > 0, F.col("o.grantedBy")).alias("granted_by")).where("source is not null or granted_by is not null")


OVERRIDES = "overrides array<struct<ability:string, classes:array<string>, source:string, note:string, grantedBy:array<string>, pet:boolean>>"


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    return class_map_rows(spark.read.option("multiLine", "true").schema("spells map<string,array<string>>, effects map<string,array<string>>").json(path))


def read_overrides(spark: SparkSession, path: str, user_path: str | None = None) -> DataFrame:
    """The shipped overrides; a user's own file ranks before them, its last entry
    first."""
    read = lambda p: spark.read.option("multiLine", "true").schema(OVERRIDES).json(p)
    shipped = override_rows(read(path))
    if user_path is None:
        return shipped
    return override_rows(read(user_path)).withColumn("rank", -1 - F.col("rank")).unionByName(shipped)


def read_scripted_wins(spark: SparkSession, path: str) -> DataFrame:
    """(speakers, phrase); rules without either are none."""
    rules = spark.read.option("multiLine", "true").schema("rules array<struct<speakers:array<string>, phrase:string, note:string>>").json(path)
    return rules.select(F.explode("rules").alias("r")).where("size(r.speakers) > 0 and r.phrase <> ''").select("r.speakers", "r.phrase")
