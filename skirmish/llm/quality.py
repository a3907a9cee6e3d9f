"""Quality rules: a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of words are hashed into buckets.  Two multinomials over
the buckets, of trusted documents and of the raw corpus, give each bucket a log
ratio; a document's score is the mean over its n-grams (so length doesn't
matter), and it is kept if the score reaches a fixed threshold.  Cheap base
rules come before: very few words, or many words in repeated 5-word windows.

Everything is DataFrame expressions.  N-grams are counted in their tasks before
anything is shuffled; the table of ratios has a fixed number of entries and is
sent as one array, so every row is scored where it is read.

Cases: a null or wordless text has no words and fails the base rules; without
trusted documents all ratios are 0 and the base rules decide; every row is
scored for itself, also where rows repeat a doc_id or have none (if one of them
is trusted by its doc_id, all of that doc_id are); a very long text is scored
whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD

BUCKETS = 16384
THRESHOLD = -0.25
SMOOTHING = 1.0
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
#: Up to this many trusted ids (8 bytes each) they are broadcast, beyond it joined by a shuffle.
BROADCAST_IDS = 100_000
BLANKS = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text, words, h): h has a hash for each word."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _words(F.coalesce("text", F.lit(""))).alias("words"))
    return words.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def _after(h: str, i: Column, k: int) -> Column:
    return F.get(F.col(h), i + k)


def base_measures(docs: DataFrame, ratios: Column | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed); with ratios, an array by bucket, also llr, the mean log ratio
    of the row's n-grams."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    window, n = REPEAT_WINDOW, F.size("h")
    # The hash of the window that starts at each word.
    grams = F.when(n >= window, F.transform(F.slice("h", 1, n - (window - 1)), lambda x, i: F.xxhash64(x, *[_after("h", i, k) for k in range(1, window)]))).otherwise(F.array().cast("array<bigint>"))
    score = []
    if ratios is not None:
        one = F.transform("h", lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
        two = F.transform(F.slice("h", 1, F.greatest(n - 1, F.lit(0))), lambda x, i: (F.pmod(F.xxhash64(x, _after("h", i, 1)), F.lit(BUCKETS)) + BUCKETS).cast("int"))
        score = [F.concat(one, two).alias("cells"), ratios.alias("ratios")]
    measured = (
        hashed_words(docs)
        .select("doc_id", "text", "words", "h", grams.alias("grams"), *score)
        .select(
            "doc_id",
            n.cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            # Only where a window repeats: equal windows side by side.
            F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("at"))))).alias("placed"),
            *([(F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.get(F.col("ratios"), c)) / F.greatest(F.size("cells"), F.lit(1))).alias("llr")] if score else []),
        )
        .select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeated(F.col("placed"), window).alias("n_repeat_words"), *(["llr"] if score else []))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def _repeated(placed: Column, window: int) -> Column:
    """Words in windows whose hash occurs twice or more.  placed: the windows'
    hashes and places, sorted; null if no hash repeats."""
    n = F.size(placed)
    # A window counts if a neighbour in that order has its hash: pair each with the one before and the one after.
    none = F.lit(None).cast("struct<g:bigint,at:int>")
    before = F.concat(F.array(none), F.slice(placed, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(placed, 2, F.greatest(n - 1, F.lit(0))), F.array(none))
    trio = F.arrays_zip(placed.alias("x"), before.alias("b"), after.alias("a"))
    twice = F.filter(trio, lambda t: (t["x"]["g"] == t["b"]["g"]).eqNullSafe(True) | (t["x"]["g"] == t["a"]["g"]).eqNullSafe(True))
    places = F.sort_array(F.transform(twice, lambda t: t["x"]["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).alias("last")),
        lambda acc, at: F.struct((acc.sum + F.least(F.lit(window), at - acc.last)).alias("sum"), at.alias("last")),
        lambda acc: acc.sum,
    )
    return F.when(placed.isNotNull(), covered).otherwise(F.lit(0).cast("long"))


def _cells(docs: DataFrame, good: bool) -> DataFrame:
    """(good, bucket): a row a word and a row a bigram of neighbours."""
    pairs = F.arrays_zip(F.col("h").alias("a"), F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))).alias("b"))
    rows = hashed_words(docs).select(F.explode(pairs).alias("p"))
    one = F.pmod("p.a", F.lit(BUCKETS)).cast("int")
    two = F.when(F.col("p.b").isNotNull(), (F.pmod(F.xxhash64("p.a", "p.b"), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    return rows.select(one.alias("u"), two.alias("v")).select(F.lit(good).alias("good"), F.explode(F.array("u", "v")).alias("bucket")).where("bucket is not null")


def bucket_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, ratio): log of the trusted over the raw probability.  trusted:
    doc_id of trusted documents."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct()
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    best = docs.join(small, F.col("doc_id").cast("long") == F.col("t_id"), "left_semi")
    counts = (
        _cells(docs, False).unionByName(_cells(best, True))
        .groupBy("good", "bucket").count()
        .groupBy("bucket").agg(F.coalesce(F.sum(F.when(~F.col("good"), F.col("count"))), F.lit(0)).alias("raw"), F.coalesce(F.sum(F.when(F.col("good"), F.col("count"))), F.lit(0)).alias("target"))
    )
    table = Window.partitionBy((F.col("bucket") >= BUCKETS))
    smooth = lambda c: (F.col(c) + SMOOTHING) / (F.sum(c).over(table) + SMOOTHING * BUCKETS)
    ratio = F.when(F.sum("target").over(table) > 0, F.log(smooth("target") / smooth("raw"))).otherwise(0.0)
    return counts.select("bucket", ratio.alias("ratio"))


def ratio_array(ratios: DataFrame) -> Column:
    """The ratios by bucket as one array, of fixed size; 0 where nothing fell."""
    every = ratios.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(ratios, "bucket", "left")
    cells = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))))
    return every.groupBy().agg(cells.alias("c")).select("c.ratio").scalar()


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its measures, score and verdict."""
    measured = base_measures(docs, ratio_array(bucket_ratios(docs, trusted)))
    # Rounding makes the verdict independent of the order of sums.
    return measured.withColumn("llr", F.round("llr", 9)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
