"""Mixing sources to target weights by a hypergeometric splitting tree.

Sources get targets in words: a share of the total by weight, stopped at twice
the source, the excess reshared.  Documents are cut into blocks of words.  The
target makes an exact quota of blocks: all of them once or twice, and a part of
one further pass.  The quotas of all sources are split among output shards by a
binary tree: at each node the left half draws its share of every source from the
multivariate hypergeometric distribution, so shards have equal sizes, quotas add
up exactly, and each shard is a random sample of the mix.  A leaf's quotas are
ranges of places in the sources' keyed permutations; a shard draws the blocks
whose places lie in its ranges, and blocks in no range aren't taken.  Shards are
then shuffled on their own.

Everything is DataFrame expressions.  The tree has a row a node, with a number a
source; nodes are spread over tasks.  Blocks are ranked by hashed buckets and
the sizes of the buckets before, and meet the ranges in slots about as wide as a
shard's range, so no task holds a source.

Cases: a null text has size 0 and is never drawn; a null source is a source of
its own, ordered last; rows that repeat a doc_id count as separate documents,
told apart by all their columns; rows equal in every column are counted before
anything is shuffled and are drawn each for itself; a very long text is many
blocks; an empty table gives empty results; other columns are left out
(`mix_documents` keeps them).  The result depends on the rows and the seed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BLOCK_WORDS = 64
SHARD_WORDS = 2_000_000
BUCKET_BLOCKS = 2_000
#: Buckets whose sizes are summed in one window.
BUCKET_GROUP = 4096
#: Up to this many sources, the table of sources is broadcast to the documents,
#: and up to this many ranges those of all shards.
BROADCAST_SOURCES = 10_000
BROADCAST_RANGES = 200_000
#: Levels of the tree after which its nodes are spread anew.
SPREAD_LEVELS = 8


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """sizes(source, size): one row a source (source, source_id, source_size,
    n_blocks if present, target).  Sources by code point, null last."""
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy("ratio", "source_id")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    t = (
        sizes.withColumn("source_id", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("want", F.sum("source_size").over(everything) * total)
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        # If all sources of smaller ratio stop at their cap, a unit of weight gets this many words:
        .withColumn("level", (F.col("want") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_id"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return t.withColumn("target", target).drop("weight", "cap", "ratio", "want", "capped", "open", "level")


def _uniform(*key) -> Column:
    """In (0, 1), from a key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def _hypergeometric(total: Column, good: Column, drawn: Column, *key) -> Column:
    """How many of `good` among `total` are in a draw of `drawn`: by inversion over the
    counts within 8 standard deviations of the mean, beyond which doubles hold no mass.
    The higher a node, the more counts there are, and the fewer such nodes."""
    n, g, m = (x.cast("double") for x in (total, good, drawn))
    mean = F.when(n > 0, g * m / n).otherwise(0.0)
    spread = F.sqrt(F.when(n > 1, m * (g / n) * (1 - g / n) * (n - m) / (n - 1)).otherwise(0.0))
    low, high = F.greatest(F.lit(0), drawn - (total - good)), F.least(good, drawn)
    counts = F.sequence(F.greatest(low, F.floor(mean - 8 * spread - 1)), F.least(high, F.ceil(mean + 8 * spread + 1)))

    def following(w, k):  # the weight of k + 1, from that of k
        k = k.cast("double")
        return w * (g - k) * (m - k) / ((k + 1) * (n - g - m + k + 1))

    def step(acc, k):
        return F.struct(following(acc.w, k).alias("w"), (acc.sum + acc.w).alias("sum"))

    def chosen(acc, k):
        return F.struct(
            following(acc.w, k).alias("w"),
            (acc.sum + acc.w).alias("sum"),
            acc.whole.alias("whole"),
            F.coalesce(acc.pick, F.when(acc.sum + acc.w >= acc.whole * _uniform(F.lit(3), *key), k)).alias("pick"),
        )

    one = [F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")]
    whole = F.aggregate(counts, F.struct(*one), step, lambda acc: acc.sum)
    return F.aggregate(counts, F.struct(*one, whole.alias("whole"), F.lit(None).cast("long").alias("pick")), chosen, lambda acc: F.coalesce(acc.pick, high))


def _left_quotas(quotas: Column, *key) -> Column:
    """What the left child of a node gets of each source's quota."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def source(acc, q):
        x = _hypergeometric(acc.total, q, acc.drawn, F.size(acc.out), *key)
        return F.struct((acc.total - q).alias("total"), (acc.drawn - x).alias("drawn"), F.concat(acc.out, F.array(x)).alias("out"))

    start = F.struct(total.alias("total"), F.floor(total / 2).alias("drawn"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(quotas, start, source, lambda acc: acc.out)


def splitting_tree(sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """sources(source_id, quota), numbered from 0: (source_id, shard, start,
    quota), the range of the source's places that each shard draws."""
    zero = F.lit(0).cast("long")
    gathered = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_id", "quota"))).alias("q"))
    tree = gathered.select(zero.alias("node"), F.transform("q", lambda _: zero).alias("starts"), F.col("q.quota").alias("quotas"))
    for level in range(levels):
        split = tree.withColumn("left", _left_quotas(F.col("quotas"), F.lit(seed), F.lit(level), F.col("node")))
        left = F.struct((F.col("node") * 2).alias("node"), "starts", F.col("left").alias("quotas"))
        right = F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("starts", "left", lambda a, b: a + b).alias("starts"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas"))
        tree = split.select(F.explode(F.array(left, right)).alias("child")).select("child.*")
        if level % SPREAD_LEVELS == SPREAD_LEVELS - 1:
            tree = tree.repartition("node")
    leaves = tree.select(F.col("node").alias("shard"), F.posexplode(F.arrays_zip("starts", "quotas")).alias("source_id", "r"))
    return leaves.select("source_id", "shard", F.col("r.starts").alias("start"), F.col("r.quotas").alias("quota")).where("quota > 0")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*plain, *[c.isNull() for c in plain])


def _sized(df: DataFrame, block_words: int) -> DataFrame:
    """Documents as (doc_id, sig, nth, source, size, blocks); sig tells different
    rows of a doc_id apart, nth equal ones."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(df).alias("sig"), "source", n_words("text").alias("size"))
    counted = rows.groupBy("doc_id", "sig", "source", "size").agg(F.count("*").alias("copies"))
    return counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth")).withColumn("blocks", F.ceil(F.col("size") / block_words))


DOC = ("doc_id", "sig", "nth")


class Mix:
    """documents: (doc_id, sig, nth, copies, source_id, source_size, target,
    size); draws: (doc_id, sig, nth, block, words, epoch, shard), one row a drawn
    block."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17):
        self.seed = seed
        sized = stored(_sized(docs, block_words))
        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("blocks").alias("n_blocks"))
        plan = source_targets(totals, weights, total, most).withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        plan = stored(plan.withColumn("quota", F.rint(F.col("share") * F.col("n_blocks")).cast("long")).withColumn("buckets", F.ceil(F.col("n_blocks") / BUCKET_BLOCKS)))
        n_sources, words = plan.agg(F.count("*"), F.sum("source_size")).first()
        self.levels = max(0, math.ceil(math.log2(max(1, (words or 0) * total / shard_words))))
        small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)
        self.documents = sized.join(small(plan), sized.source.eqNullSafe(plan.source)).select(*DOC, "copies", sized.source, "size", "blocks", "source_id", "source_size", "target", "n_blocks", "quota", "buckets")
        ranges = stored(splitting_tree(plan, self.levels, seed).join(small(plan.select("source_id", F.col("quota").alias("of"))), "source_id"))
        few = F.broadcast if ranges.count() <= BROADCAST_RANGES else (lambda x: x)
        self.draws = self._draws(ranges, few, block_words)

    def _draws(self, ranges: DataFrame, few, block_words: int) -> DataFrame:
        width = lambda quota: F.greatest(F.lit(1).cast("long"), F.shiftright(quota, self.levels))
        blocks = (
            self.documents.where("blocks > 0 and quota > 0")
            .select(*DOC, "size", "source_id", "n_blocks", "quota", "buckets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
            .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
            .withColumn("key", F.xxhash64(F.lit(self.seed), "source_id", F.coalesce("doc_id", F.lit(-1)), "sig", "nth", "block"))
            .withColumn("bucket", F.pmod("key", F.col("buckets")))
        )
        # The sizes of the buckets before, in two steps.
        held = blocks.groupBy("source_id", "bucket").count().withColumn("group", F.expr(f"bucket div {BUCKET_GROUP}"))
        earlier = Window.partitionBy("source_id").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        groups = held.groupBy("source_id", "group").agg(F.sum("count").alias("n")).select("source_id", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
        beside = Window.partitionBy("source_id", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = held.withColumn("near", F.coalesce(F.sum("count").over(beside), F.lit(0))).join(groups, ["source_id", "group"]).select("source_id", "bucket", (F.col("ahead") + F.col("near")).alias("before"))
        within = Window.partitionBy("source_id", "bucket").orderBy("key", *DOC, "block")
        ranked = blocks.withColumn("own", F.row_number().over(within) - 1).join(before, ["source_id", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
        # A block has a place in each pass; the shard whose range holds the place draws it.
        passes = F.ceil(F.col("quota") / F.col("n_blocks"))
        places = (
            ranked.select(*DOC, "block", "words", "source_id", "rank", "n_blocks", "quota", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("epoch"))
            .withColumn("place", F.col("epoch") * F.col("n_blocks") + F.col("rank"))
            .withColumn("slot", F.floor(F.col("place") / width(F.col("quota"))))
        )
        ends = F.col("start") + F.col("quota")
        slots = ranges.select("source_id", "shard", "start", ends.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / width(F.col("of"))), F.floor((ends - 1) / width(F.col("of"))))).alias("slot"))
        return places.join(few(slots), ["source_id", "slot"]).where("place >= start and place < end").select(*DOC, "block", "words", "epoch", "shard")

    def shuffled(self) -> DataFrame:
        """The draws with their position in their shard, in random order."""
        order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed + 1), F.coalesce("doc_id", F.lit(-1)), "sig", "nth", "block", "epoch"), *DOC, "block", "epoch")
        return self.draws.withColumn("position", (F.row_number().over(order) - 1).cast("long"))

    def taken(self) -> DataFrame:
        """Each document with the words that the shards take of it, their number,
        and where its first block lies (null if none is taken)."""
        first = F.min(F.struct("shard", "position"))
        words = self.shuffled().groupBy(*DOC).agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("n_shards"), first.alias("first")).withColumnsRenamed({c: f"t_{c}" for c in DOC})
        same = F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & (F.col("sig") == F.col("t_sig")) & (F.col("nth") == F.col("t_nth"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.documents.join(words, same, "left").select("doc_id", "size", "source", "source_size", "target", zero("taken"), zero("n_shards"), F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


def mix_documents(docs: DataFrame, block_words: int = 256, **options) -> DataFrame:
    """The mix as rows like those of docs: a document once for each pass that
    takes it; of the last pass, the text of the blocks drawn, in their order."""
    mix = Mix(docs, block_words=block_words, **options)
    passes = (
        mix.draws.groupBy(*DOC, "epoch").agg(F.sort_array(F.collect_list("block")).alias("__blocks"))
        .select(F.col("doc_id").alias("__doc"), F.col("sig").alias("__of"), "__blocks")
    )
    rows = docs.withColumn("__sig", row_hash(docs))
    if not mix.documents.where("copies > 1").isEmpty():  # equal rows give equal texts: one stands for all
        rows = rows.dropDuplicates(["doc_id", "__sig"])
    joined = passes.join(rows, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__sig") == F.col("__of")))
    size = n_words("text")
    cut = F.regexp_extract_all("text", F.lit(r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){1,%d}" % block_words), F.lit(0))
    part = F.array_join(F.transform("__blocks", lambda b: F.element_at(F.col("__cut"), (b + 1).cast("int"))), "")
    whole = F.size("__blocks") * F.lit(block_words) >= size
    text = F.when(whole, F.col("text")).otherwise(part)
    out = joined.withColumn("__cut", F.when(~whole, cut)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def realised_shares(mix: Mix) -> DataFrame:
    """Per source: size, target and the words taken."""
    return mix.taken().groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
