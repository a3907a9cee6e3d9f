"""Line dedup by content-defined line chunks.

A text is split at \\n.  A rolling hash over the hashes of the last two visible lines
(blank lines between them stay with them) chooses boundaries: one falls after every
line where it isn't 0 modulo DIVISOR.  The choice depends on those lines alone, so it
is the same wherever they stand, whatever was inserted before.  The lines of a
boundary's window are its chunk; chunks that occur before (by doc_id, then place) are
removed, after a comparison of their bytes, and each match grows: the windows between a
chunk and the next boundary to either side go too, as long as they equal those beside
the first copy.  So a repeated passage goes whole from its first line to its last,
wherever at least one boundary falls in it.

What the choice costs: a passage in which no boundary falls stays, which is one in
DIVISOR of those of two lines, one in DIVISOR squared of those of three, and so on.
All that is removed occurs before, and the first place of every visible line stays.
Lines of the first copy itself stay where a later copy overlaps it.

Chunks are brought together by 128-bit BLAKE2b digests, and the bytes of all windows of
a digest are compared, in their tasks first, before any is removed; a digest whose
bytes differ removes nothing.  Only digests are shuffled: a chunk carries its own and
those of the windows up to the next boundaries, up to REACH of them.  First copies come
from an aggregation; digests that more than a thousandth of all repeated chunks share
are joined by broadcast, fewer than a thousand rows.

Cases: a null text stays null and has no chunks; an empty text is one empty line; lines
without a visible character, and single lines, are never removed; rows without a doc_id
are left as they are; identical rows (doc_id and text) count as one place, different
texts of one doc_id as several, in the order of a hash; a very long text is cut whole;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

#: One window in this many has no boundary.
DIVISOR = 12
#: Windows that a match may grow by from a chunk, to either side: more lie between two
#: boundaries only where lines recur with a period.
REACH = 32
HOT_SHARE = 1000

CHUNKS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("sig", T.LongType()),
    T.StructField("first_line", T.IntegerType()),
    T.StructField("lines", T.IntegerType()),
    T.StructField("high", T.LongType()),
    T.StructField("low", T.LongType()),
    T.StructField("before", T.BinaryType()),
    T.StructField("after", T.BinaryType()),
])


def line_digest(lines: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(lines).encode(), digest_size=16).digest()


def halves(told: bytes) -> tuple[int, int]:
    return int.from_bytes(told[:8], "big", signed=True), int.from_bytes(told[8:], "big", signed=True)


def windows(lines: list[str]) -> list[tuple[int, int]]:
    """[start, end) of every two neighbouring visible lines."""
    visible = [i for i, line in enumerate(lines) if line.strip()]
    return [(a, b + 1) for a, b in zip(visible, visible[1:])]


def boundaries(lines: list[str], at: list[tuple[int, int]], divisor: int = DIVISOR) -> np.ndarray:
    """Which windows have a boundary: the rolling hash over their line hashes decides."""
    hashes = np.array([xxhash.xxh3_64_intdigest(lines[i]) for i in ([a for a, _ in at] + [at[-1][1] - 1] if at else [])], np.uint64)
    rolled = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    rolled ^= rolled >> np.uint64(33)
    rolled *= np.uint64(0xFF51AFD7ED558CCD)
    return (rolled >> np.uint64(32)) % np.uint64(divisor) != 0


def chunks_of(text: str, divisor: int = DIVISOR, digest=line_digest):
    """(first line, number of lines, digest, digests before, digests after) of a text's
    chunks; the digests of the windows up to the boundaries beside it, nearest first."""
    lines = text.split("\n")
    at = windows(lines)
    chosen = np.flatnonzero(boundaries(lines, at, divisor)).tolist() if at else []
    told = {}

    def of(i: int) -> bytes:
        if i not in told:
            told[i] = digest(lines[at[i][0] : at[i][1]])
        return told[i]

    for k, i in enumerate(chosen):
        low = chosen[k - 1] if k else -1
        high = chosen[k + 1] if k + 1 < len(chosen) else len(at)
        before = b"".join(of(j) for j in range(i - 1, max(low, i - 1 - REACH), -1))
        after = b"".join(of(j) for j in range(i + 1, min(high, i + 1 + REACH)))
        yield at[i][0], at[i][1] - at[i][0], of(i), before, after


def line_chunks(docs: DataFrame, divisor: int = DIVISOR, digest=line_digest) -> DataFrame:
    """Places and digests of the chunks of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = [[] for _ in CHUNKS]
            for doc, sig, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for first, n, d, before, after in chunks_of(text, divisor, digest):
                    for column, x in zip(out, (doc, sig, first, n, *halves(d), before, after), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=CHUNKS.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sig"), "text").where("doc_id is not null and text is not null").mapInArrow(run, CHUNKS)


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, digest=line_digest) -> DataFrame:
    """(doc_id, sig, found) of texts with chunks that occur twice or more.  found: place
    and digest, the digests beside the first copy, and shift, by how many lines a chunk
    lies after a first copy in the same text; null in any other text.  first marks the
    first copy itself."""
    chunks = stored(line_chunks(docs, divisor, digest))
    kept = F.min(F.struct("doc_id", "sig", "first_line", "before", "after")).alias("kept")
    first = stored(chunks.groupBy("high", "low").agg(kept, F.count("*").alias("n")).where("n > 1"))
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = first.where(F.col("n") > total / HOT_SHARE).select("high", "low", F.col("kept").alias("hot_kept"))  # fewer than HOT_SHARE rows, of 2 * REACH digests at most
    rest = first.where(F.col("n") <= total / HOT_SHARE).select("high", "low", "kept")
    places = chunks.select("doc_id", "sig", "first_line", "lines", "high", "low")
    marked = places.join(F.broadcast(hot), ["high", "low"], "left")
    found = marked.where("hot_kept is not null").withColumnRenamed("hot_kept", "kept").unionByName(marked.where("hot_kept is null").drop("hot_kept").join(rest, ["high", "low"]))
    here = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("sig") == F.col("kept.sig"))
    shift = F.when(here, F.col("first_line") - F.col("kept.first_line"))
    told = F.struct("first_line", "lines", "high", "low", F.coalesce(shift == 0, F.lit(False)).alias("first"), shift.alias("shift"), F.col("kept.before").alias("before"), F.col("kept.after").alias("after"))
    return found.groupBy("doc_id", "sig").agg(F.collect_set(told).alias("found"))


def grown(text: str | None, found, digest=line_digest) -> list[tuple[int, int, bytes, int | None, bool]]:
    """(start, end, digest, shift, first) of the windows of a text that occur twice or
    more, as far as its chunks and what they grow by tell."""
    if text is None or not found:
        return []
    lines = text.split("\n")
    at = windows(lines)
    number = {a: i for i, (a, _) in enumerate(at)}
    told, out = {}, set()

    def of(i: int) -> bytes:
        if i not in told:
            told[i] = digest(lines[at[i][0] : at[i][1]])
        return told[i]

    for g in found:
        i = number.get(g["first_line"])
        if i is None or halves(of(i)) != (g["high"], g["low"]):
            continue
        out.add((*at[i], of(i), g["shift"], g["first"]))
        for step, beside in ((-1, g["before"]), (1, g["after"])):
            j = i + step
            for k in range(0, len(beside), 16):
                if not 0 <= j < len(at) or of(j) != beside[k : k + 16]:
                    break
                out.add((*at[j], of(j), g["shift"], g["first"]))
                j += step
    return sorted(out, key=lambda x: (x[0], x[4], x[3] or 0))


BYTES = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("bytes", T.BinaryType())])


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, digest=line_digest) -> DataFrame:
    """docs with every repeated passage that a boundary falls in removed from text;
    adds n_removed (lines)."""
    found = repeated_chunks(docs, divisor, digest).select(F.col("doc_id").alias("__doc"), F.col("sig").alias("__sig"), F.col("found").alias("__found"))
    joined = docs.join(found, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__sig")), "left").drop("__doc", "__sig")
    at = joined.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType())])
    small_batches(docs.sparkSession)

    def told(batches):
        for batch in batches:
            out = {}
            for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = text.split("\n") if found else []
                for a, b, d, *_ in grown(text, found, digest):
                    out.setdefault(d, set()).add("\n".join(lines[a:b]).encode())
            rows = [(*halves(d), b) for d, several in out.items() for b in several]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=BYTES.names)

    # All columns go in, so that the join's shuffle serves this and the removal.
    compared = joined.mapInArrow(told, BYTES).groupBy("high", "low").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a <> b")
    differ = compared.groupBy().agg(F.collect_list(F.struct("high", "low")).alias("d")).scalar()  # digests that collide: none is known

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, found, apart in zip(*(batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1)), strict=True):
                collide = {(d["high"], d["low"]) for d in apart or ()}
                out = set()
                for a, b, d, shift, first in grown(text, found, digest):
                    if not first and halves(d) not in collide:
                        # Within one text, what still belongs to the first copy stays.
                        out.update(range(a if shift is None else max(a, b - shift), b))
                if out:
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)
                texts.append(text)
                counts.append(len(out))
            columns = batch.columns[:-2]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=schema.names)

    return joined.withColumn("__apart", differ).mapInArrow(run, schema)
