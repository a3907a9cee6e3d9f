"""Training-order materialisation of token ids in binary shards.

Every document becomes token ids and a final end id, cut into sequences of a
fixed length (the last one padded), numbered 0 to N - 1 over the corpus.  A
keyed Feistel permutation of the next even power of two, walked along its cycle
until it falls below N, gives each sequence its global slot: a shuffle of any
size that needs no memory and is the same in every run.  Shard s holds slots
[s R, (s + 1) R) as records of a fixed stride, so the record of slot t starts at
(t mod R) x stride of shard t div R, and reading can resume anywhere.

Sequences are numbered as the documents are read, by task and row, and the table
of tokenized documents fixes that for a run.  The same table read with the same
splits gives the same slots; documents sorted by a key (repartitionByRange and
sortWithinPartitions) give the same slots however the input is split or ordered.
Numbering by content instead would move all ids once more, beyond the disk budget.
Each task gets a range of shards and sorts its records by slot; padding is added
there, so it doesn't travel.  Ids travel compressed.

Cases: a null text counts as empty and still gives a sequence with the end id;
repeated rows are numbered each for itself; a very long text gives as many
sequences as it fills; an empty table gives no shard; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .packing import END_ID, default_vocabulary, encoder

LENGTH = 512
SHARD_RECORDS = 4096
PAD_ID = 0xFFFF
ROUNDS = 4
#: Shards that one task assembles and writes.
TASK_SHARDS = 8
#: Records that leave a task's memory at a time.
CUT_RECORDS = 10_000
#: Up to this many tasks, the table of their first numbers (a row each) is broadcast.
BROADCAST_TASKS = 1_000_000
KEY = 0x5EED


def _round(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key + (turn + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of indexes below n: a bijection of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> shift, out[walking] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ _round(right, key, turn, mask)
        out[walking] = (left << shift) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("sequences", T.LongType()),
    T.StructField("ids", T.BinaryType()),  # compressed
    T.StructField("task", T.LongType()),
    T.StructField("before", T.LongType()),  # sequences of the task's rows before this one
])


def tokenized(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """Each document's ids as unsigned little-endian 16-bit numbers."""
    small_batches(docs.sparkSession)
    where = vocabulary or default_vocabulary()

    def run(batches):
        encode, compress = encoder(where), zstandard.ZstdCompressor(level=1).compress
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.array([*encode(text or ""), END_ID], "<u2") for text in batch.column(1).to_pylist()]
            sequences = -(-np.array([len(x) for x in ids], np.int64) // length)
            before = done + np.cumsum(sequences) - sequences
            done += int(sequences.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequences), pa.array([compress(x.tobytes()) for x in ids], pa.binary()), pa.array(np.full(len(ids), task, np.int64)), pa.array(before)], names=DOCUMENTS.names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, DOCUMENTS)


def numbered(held: DataFrame) -> DataFrame:
    """(doc_id, ids, first): with the number of each document's first sequence."""
    ahead = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = stored(held.groupBy("task").agg(F.sum("sequences").alias("s")).select("task", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("offset")))
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_TASKS else offsets
    return held.join(small, "task").select("doc_id", "ids", (F.col("before") + F.col("offset")).cast("long").alias("first"))


SHARDS = T.StructType([
    T.StructField("shard", T.LongType()),
    T.StructField("first_slot", T.LongType()),
    T.StructField("records", T.LongType()),
    T.StructField("stride", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
])

_RECORDS = "part int, slot long, doc_id long, start long, data binary"


def shards(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, per_shard: int = SHARD_RECORDS, key: int = KEY) -> DataFrame:
    """One row a shard: its payload and, by record, where it comes from.  Task k
    holds the k-th range of shards, in order."""
    held = stored(tokenized(docs, vocabulary, length))
    total = held.agg(F.sum("sequences")).first()[0] or 0
    parts = max(1, -(-total // (per_shard * TASK_SHARDS)))

    def cut(batches):
        names = ["part", "slot", "doc_id", "start", "data"]
        compress, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        slots, ids_of, starts, data = [], [], [], []

        def flush():
            at = np.concatenate(slots)
            columns = [pa.array((at // (per_shard * TASK_SHARDS)).astype(np.int32)), pa.array(at), pa.array(ids_of, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())]
            for x in (slots, ids_of, starts, data):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc, packed, first in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids = expand(packed)
                n = -(-len(ids) // (2 * length))
                slots.append(permute(np.arange(first, first + n), total, key))
                ids_of.extend([doc] * n)
                starts.extend(range(0, n * length, length))
                data.extend(compress(ids[2 * length * k : 2 * length * (k + 1)]) for k in range(n))
                if len(data) >= CUT_RECORDS:
                    yield flush()
        if data:
            yield flush()

    def shard(records: list[tuple]) -> pa.RecordBatch:
        first = records[0][0]
        if first % per_shard or [r[0] for r in records] != list(range(first, first + len(records))):
            raise ValueError("a shard lacks slots")
        pad = PAD_ID.to_bytes(2, "little")
        payload = b"".join(r[3] + pad * (length - len(r[3]) // 2) for r in records)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in ([r[1] for r in records], [r[2] for r in records], [len(r[3]) // 2 for r in records])]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (first // per_shard, first, len(records), 2 * length)] + [pa.array([payload], pa.binary()), *lists], names=SHARDS.names)

    def assemble(batches):
        records: list[tuple] = []
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for *place, packed in zip(*(batch.column(c).to_pylist() for c in ("slot", "doc_id", "start", "data")), strict=True):
                r = (*place, expand(packed))
                if records and r[0] // per_shard != records[0][0] // per_shard:
                    yield shard(records)
                    records = []
                records.append(r)
        if records:
            yield shard(records)

    return numbered(held).mapInArrow(cut, _RECORDS).repartitionById(parts, "part").sortWithinPartitions("slot").mapInArrow(assemble, SHARDS)


def write_shards(shard_rows: DataFrame, path: str) -> DataFrame:
    """The shards as Parquet, a file for each range of shards, read back."""
    shard_rows.write.option("compression", "zstd").parquet(path)
    return shard_rows.sparkSession.read.schema(SHARDS).parquet(path)


def read_from(shard_rows: DataFrame, slot: int, per_shard: int = SHARD_RECORDS) -> DataFrame:
    """(slot, record) from a slot on, in training order; earlier shards are skipped."""
    rows = shard_rows.where(F.col("shard") >= slot // per_shard)
    records = rows.select("first_slot", "stride", "payload", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("k"))
    return records.select((F.col("first_slot") + F.col("k")).alias("slot"), F.substring("payload", (F.col("k") * F.col("stride") + 1).cast("int"), F.col("stride").cast("int")).alias("record")).where(F.col("slot") >= slot).orderBy("slot")


def digest(shard_rows: DataFrame) -> DataFrame:
    """A row a sequence, read from the shards by slot and stride."""
    of = F.posexplode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("k", "r")
    rows = shard_rows.select("shard", "first_slot", "stride", "payload", of)
    offset = F.col("k") * F.col("stride")
    ids = F.substring("payload", (offset + 1).cast("int"), (2 * F.col("r.lengths")).cast("int"))
    return rows.select(F.col("r.doc_ids").alias("doc_id"), F.col("r.starts").alias("start"), F.col("r.lengths").alias("length"), (F.col("first_slot") + F.col("k")).alias("slot"), "shard", offset.cast("long").alias("offset"), F.crc32(ids).alias("ids_crc32"))
