"""Substring dedup by content-defined chunking with a gear rolling hash.

The bytes of a text are cut where a gear hash of the last 16 bytes meets a mask,
so cuts follow the content and an insertion moves only the cuts beside it.
Variable chunks are deduplicated by 128-bit digest.  Neighbouring repeated
chunks of a document form a span; spans of a least length are reported.

decided_spans keeps the first place of every chunk (by doc_id, then place) and
removes the others; a span has chunks of one decision only.  Spans to remove grow
byte by byte to both sides while the text of the first document agrees, but never
into a chunk that has a decision of its own, before the least length is applied.
So the first place of each repeated chunk stays whole when all spans to remove
go, and what is removed has a copy in an earlier document or place.  A longer
agreement than the neighbouring chunk and REACH bytes would have made that chunk
a repeated one, so no more than that is compared.  Spans that are kept are
reported by whole chunks; so a piece at the end of a passage stays where its
surroundings make it the first chunk of its kind.  Rows with the same doc_id and another text are texts
of one document.

Digests that a thousandth of all chunks share are at most a thousand; they are
broadcast.  All others are joined by a shuffle; where one of them still fills a
task, Spark's own handling of skewed joins splits its rows, as nothing but a
further shuffle follows.

Repeats within one document aren't spans: they are no copies between documents.

Cases: null and empty texts have no chunks; a text without a cut is one chunk;
a very long text is cut whole; rows that repeat a doc_id count as one document; a row without a doc_id is left
out; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

MASK_BITS = 5
LEAST_CHUNK = 8
LEAST_SPAN = 80
#: Windows of hot texts up to these bytes are broadcast, beyond them spread by salts.
BROADCAST_BYTES, SALTS = 64 << 20, 32
HOT_SHARE = 1000
#: Bytes before a cut that decide on it.
REACH = 16 + LEAST_CHUNK
_gear = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)

CHUNKS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("nth", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("high", T.LongType()),
    T.StructField("low", T.LongType()),
])


def cuts(data: bytes, mask_bits: int = MASK_BITS, least: int = LEAST_CHUNK) -> np.ndarray:
    """Ends of the chunks.  h = 2 h + gear[byte] in 16 bits depends on the last
    16 bytes; a cut is where its top bits are 0 and no place shortly before
    qualifies as well, which again depends on the bytes before only."""
    if not data:
        return np.zeros(0, np.int64)
    h = _gear[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # h[i] = sum of gear[i - j] << j, j < 16, by doubling
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint16(step)
        h = h + older
    at = np.flatnonzero((h >> np.uint16(16 - mask_bits)) == 0)
    if len(at):
        at = at[np.concatenate([[True], np.diff(at) >= least])]
    ends = at + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def chunks(docs: DataFrame) -> DataFrame:
    """Every chunk of every text with its digest; places in UTF-8 bytes."""
    small_batches(docs.sparkSession, 1000)

    def run(batches):
        for batch in batches:
            docs_, nths, starts, lengths, digests = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                ends = cuts(data)
                begins = np.concatenate([[0], ends[:-1]])
                docs_.append(np.full(len(ends), doc, np.int64))
                nths.append(np.arange(len(ends), dtype=np.int32))
                starts.append(begins)
                lengths.append((ends - begins).astype(np.int32))
                digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            if digests:
                two = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs_, nths, starts, lengths)] + [pa.array(two[:, 0]), pa.array(two[:, 1])], names=CHUNKS.names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("doc_id is not null and text <> ''").mapInArrow(run, CHUNKS)


def repeated_spans(docs: DataFrame, across: bool = True, least: int = LEAST_SPAN) -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id, is_first): byte spans whose
    chunks occur elsewhere too; across: in another document.  first_doc_id is
    the least document of the span's chunks, is_first tells that no chunk of
    the span occurs in an earlier document."""
    pieces = chunks(docs)
    counted = pieces.groupBy("high", "low").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = stored(counted.where("first < last" if across else "n > 1").select("high", "low", "n", "first"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > total / HOT_SHARE).select("high", "low", "first")  # fewer than HOT_SHARE rows
    rest = shared.where(F.col("n") <= total / HOT_SHARE).select("high", "low", "first")
    marked = pieces.join(F.broadcast(hot.withColumnRenamed("first", "hot_first")), ["high", "low"], "left")
    keep = ("doc_id", "nth", "start", "length", "first")
    found = marked.where("hot_first is not null").withColumnRenamed("hot_first", "first").select(*keep).unionByName(marked.where("hot_first is null").join(rest, ["high", "low"]).select(*keep))
    by_place = Window.partitionBy("doc_id").orderBy("nth")
    run = F.col("nth") - F.dense_rank().over(by_place)
    spans = found.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.countDistinct("nth").alias("n_chunks"), F.min("first").alias("first_doc_id"))
    return spans.where(F.col("end") - F.col("start") >= least).select("doc_id", "start", "end", "n_chunks", "first_doc_id", (F.col("first_doc_id") == F.col("doc_id")).alias("is_first"))


EDGES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("sig", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("first_doc_id", T.LongType()),
    T.StructField("is_first", T.BooleanType()),
    T.StructField("left", T.BooleanType()),
    T.StructField("gap", T.BinaryType()),  # what may be added on this side
    T.StructField("k_doc", T.LongType()),  # the text that it is compared with
    T.StructField("k_sig", T.LongType()),
    T.StructField("k_at", T.LongType()),
])


def span_edges(data: bytes, doc: int, sig: int, shared: list[dict]):
    """Rows of EDGES: both sides of the spans of a text to remove, and the spans
    to keep.  shared: its repeated chunks with their first place."""
    shared = sorted(shared, key=lambda c: c["start"])
    ends = cuts(data)
    runs = []
    for c in shared:
        kept = (c["doc"], c["text"], c["at"]) == (doc, sig, c["start"])
        if runs and runs[-1][0] == kept and runs[-1][1][-1]["start"] + runs[-1][1][-1]["length"] == c["start"]:
            runs[-1][1].append(c)
        else:
            runs.append((kept, [c]))
    for i, (kept, run) in enumerate(runs):
        a, b = run[0]["start"], run[-1]["start"] + run[-1]["length"]
        span = (doc, sig, a, b, len(run), min(c["doc"] for c in run), kept)
        if kept:
            yield (*span, None, None, None, None, None)
            continue
        before = runs[i - 1][1][-1] if i else None
        floor = before["start"] + before["length"] if before else 0
        ceiling = runs[i + 1][1][0]["start"] if i + 1 < len(runs) else len(data)
        at = int(np.searchsorted(ends, a))  # the chunk that ends at a
        last = (int(ends[at - 1]) if at else 0) if a else 0
        low = max(floor, last - REACH)
        high = min(ceiling, int(ends[min(np.searchsorted(ends, b, "right"), len(ends) - 1)]))
        first, final = run[0], run[-1]
        # Copies within a document don't tell that what is beside them occurs elsewhere.
        yield (*span, True, data[low:a] if first["doc"] != doc else b"", first["doc"], first["text"], first["at"])
        yield (*span, False, data[b:high] if final["doc"] != doc else b"", final["doc"], final["text"], final["at"] + final["length"])


def agreement(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _hot_join(pieces: DataFrame, shared: DataFrame, hot: DataFrame) -> DataFrame:
    """pieces with `kept` of the shared digest each has; others drop out.  What hot
    digests (a few rows) keep is broadcast and written beside every piece, as each has
    one at most; the rest is joined by a shuffle."""
    keys = ["high", "low"]
    few = F.broadcast(shared.join(F.broadcast(hot), keys, "left_semi").withColumnRenamed("kept", "hot_kept"))
    marked = pieces.join(few, keys, "left")
    told = marked.where("hot_kept is not null").withColumnRenamed("hot_kept", "kept").select(*pieces.columns, "kept")
    return told.unionByName(marked.where("hot_kept is null").join(shared, keys).select(*pieces.columns, "kept"))


def _window(size: str):
    """As many bytes of k_data beside k_at as the gap has, or as there are."""
    n, at = F.col(size), F.col("k_at")
    return F.when(F.col("left"), F.substring("k_data", F.greatest(F.lit(0), at - n).cast("int") + 1, F.least(n, at).cast("int"))).otherwise(F.substring("k_data", at.cast("int") + 1, n.cast("int")))


def _hot_windows(edges: DataFrame, others: DataFrame) -> DataFrame:
    """edges with window, where many meet few texts.  The places that are asked for are
    gathered first, once each, and cut out of the texts; only these windows, no longer
    than a chunk and its surroundings, are sent or spread to the edges."""
    keys = ["k_doc", "k_sig", "left", "k_at"]
    asked = edges.groupBy(*keys).agg(F.max(F.length("gap")).alias("size"))
    cut = stored(asked.join(others, ["k_doc", "k_sig"]).select(*keys, _window("size").alias("whole")))
    total = cut.agg(F.sum(F.length("whole") + 40)).first()[0] or 0
    if total <= BROADCAST_BYTES:
        met = edges.join(F.broadcast(cut), keys)
    else:
        salted = edges.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sig", "start"), F.lit(SALTS)).cast("int"))
        met = salted.join(cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"])
    n = F.length("gap")
    near = F.when(F.col("left"), F.substring("whole", F.greatest(F.lit(0), F.length("whole") - n) + 1, n)).otherwise(F.substring("whole", F.lit(1), n))
    return met.withColumn("window", near)


def decided_spans(docs: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id, is_first): byte spans whose
    chunks occur in another document too, all to keep (is_first: each chunk is
    the first of its kind) or all to remove.  first_doc_id: the least document
    of its chunks."""
    small_batches(docs.sparkSession, 1000)
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "xxhash64(text) as sig", "text").where("doc_id is not null and text <> ''")
    schema = T.StructType([f for f in CHUNKS.fields if f.name != "nth"] + [T.StructField("sig", T.LongType())])

    def split(batches):
        for batch in batches:
            out, digests = [[], [], [], []], []
            for doc, sig, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                ends = cuts(data)
                begins = np.concatenate([[0], ends[:-1]])
                for column, x in zip(out, (np.full(len(ends), doc, np.int64), begins, (ends - begins).astype(np.int32), np.full(len(ends), sig, np.int64)), strict=True):
                    column.append(x)
                digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            if digests:
                two = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                docs_, starts, lengths, sigs = (pa.array(np.concatenate(c)) for c in out)
                yield pa.RecordBatch.from_arrays([docs_, starts, lengths, pa.array(two[:, 0]), pa.array(two[:, 1]), sigs], names=schema.names)

    pieces = texts.mapInArrow(split, schema)
    place = F.struct("doc_id", "sig", "start")
    counted = pieces.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("kept"), F.max("doc_id").alias("last"))
    shared = stored(counted.where("kept.doc_id < last").select("high", "low", "n", "kept"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > total / HOT_SHARE).select("high", "low")  # fewer than HOT_SHARE rows
    found = _hot_join(pieces, shared.select("high", "low", "kept"), hot)
    chunk = F.struct("start", "length", F.col("kept.doc_id").alias("doc"), F.col("kept.sig").alias("text"), F.col("kept.start").alias("at"))
    by_text = found.groupBy("doc_id", "sig").agg(F.collect_set(chunk).alias("shared"))

    def spans(batches):
        for batch in batches:
            rows = [r for doc, sig, chunks_, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sig", "shared", "text")), strict=True) for r in span_edges(text.encode(), doc, sig, chunks_)]
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=EDGES.names)

    edges = stored(by_text.join(texts, ["doc_id", "sig"]).mapInArrow(spans, EDGES))
    to_grow = edges.where("length(gap) > 0")
    n_grow = to_grow.count()
    k_hot = to_grow.groupBy("k_doc", "k_sig").agg(F.count("*").alias("k")).where(F.col("k") > n_grow / HOT_SHARE).select("k_doc", "k_sig")  # fewer than HOT_SHARE rows
    others = texts.select(F.col("doc_id").alias("k_doc"), F.col("sig").alias("k_sig"), F.encode("text", "utf-8").alias("k_data"))
    keys = ["k_doc", "k_sig"]
    size = F.length("gap")
    rest = to_grow.join(F.broadcast(k_hot), keys, "left_anti").withColumn("size", size).join(others, keys).select(*EDGES.names[:9], _window("size").alias("window"))
    compared = rest.unionByName(_hot_windows(to_grow.join(F.broadcast(k_hot), keys, "left_semi"), others).select(*EDGES.names[:9], "window"))

    def grow(batches):
        for batch in batches:
            more = [agreement(g[::-1], w[::-1]) if left else agreement(g, w) for left, g, w in zip(*(batch.column(c).to_pylist() for c in ("left", "gap", "window")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(more, pa.int64())], names=[*EDGES.names[:8], "more"])

    grown = compared.mapInArrow(grow, T.StructType([*EDGES.fields[:8], T.StructField("more", T.LongType())]))
    both = edges.select(*EDGES.names[:8], F.lit(0).cast("long").alias("more")).unionByName(grown)
    sides = both.groupBy(*EDGES.names[:7]).agg(F.max(F.when(F.col("left"), F.col("more")).otherwise(0)).alias("l"), F.max(F.when(~F.col("left"), F.col("more")).otherwise(0)).alias("r"))
    wide = sides.select("doc_id", "sig", (F.col("start") - F.col("l")).alias("start"), (F.col("end") + F.col("r")).alias("end"), "n_chunks", "first_doc_id", "is_first")
    # Spans that have grown together are one.
    by_place = Window.partitionBy("doc_id", "sig", "is_first").orderBy("start", "end")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    marked = wide.withColumn("fresh", F.when(reached >= F.col("start"), 0).otherwise(1))
    joined = marked.withColumn("island", F.sum("fresh").over(by_place)).groupBy("doc_id", "sig", "is_first", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"))
    return joined.where(F.col("end") - F.col("start") >= least).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "is_first")
