"""Quality by compression: the class whose dictionary makes a text smaller.

Two zstandard dictionaries hold pieces of good and of bad labelled texts.  A text
is cut into blocks of BLOCK bytes, each is compressed with either dictionary, and
the difference of the two sums over the larger of them (-1 to 1, above 0: smaller
with the good one) is the text's only feature.  A logistic curve, fitted on other
labelled rows with each class at its own weight, turns it into the probability of
label 1.  Blocks keep a long text comparable with a short one: it can't become
its own dictionary.

Only learning is bounded, by a documented sample: of each label the SAMPLE
documents with the least hash of their doc_id are read whole; half of them give
the pieces (of each text those with the least hash first, DICTIONARY bytes a
label), half the points of the curve.  Every document is scored whole, where it
is read.

Cases: a null or empty text has the difference 0 and the score the curve gives it;
a doc_id labelled both ways, or null, teaches nothing; without rows of both labels
every score is the share of label 1 (0.5 without any label); repeated rows are
scored each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Labelled documents of each label that learning reads, at most.
SAMPLE = 4000
DICTIONARY = 1 << 16
PIECE = 128
BLOCK = 512
LEVEL = 9
#: A score from here on counts as label 1.
LEAST = 0.3


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    bad: bytes
    good: bytes
    intercept: float
    slope: float

    def measure(self):
        """A function from a text to its normalised size difference."""
        if not self.bad or not self.good:
            return lambda text: 0.0
        bad, good = compressor(self.bad), compressor(self.good)

        def difference(text: str | None) -> float:
            data = memoryview((text or "").encode("utf-8", "surrogatepass"))
            b = g = 0
            for at in range(0, len(data), BLOCK):
                block = data[at : at + BLOCK]
                b += len(bad.compress(block))
                g += len(good.compress(block))
            return (b - g) / max(b, g, 1)

        return difference

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -500, 500)))


def chosen_labels(labels: DataFrame, sample: int) -> DataFrame:
    """(key, quality, curve, weight) of at most `sample` doc_ids of each label: half
    of them for the curve; weight: how many of that label a row stands for."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("key"))
    told = one.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_top")).where("quality = _top").drop("_top")
    parts = []
    for label in (0, 1):
        few = told.where(F.col("quality") == label).withColumn("_h", F.xxhash64("key")).orderBy("_h", "key").limit(sample)
        parts.append(few.withColumn("curve", F.shiftrightunsigned("_h", 3) % 2 == 1).drop("_h"))
    sizes = told.groupBy("quality").agg(F.count("*").alias("_all"))
    both = parts[0].unionByName(parts[1])
    taken = both.groupBy("quality").agg(F.count("*").alias("_taken"))
    weight = F.broadcast(sizes.join(taken, "quality").select("quality", (F.col("_all") / F.col("_taken")).alias("weight")))  # two rows
    return both.join(weight, "quality").select("key", "quality", "curve", "weight")


def _pieces(rows: DataFrame, dictionary: int) -> dict[int, bytes]:
    """The dictionary of each label: pieces of PIECE bytes, first the one of least
    hash of every text, then the second, and so on."""
    most = -(-dictionary // PIECE)

    def cut(batches):
        for batch in batches:
            out = [[], [], [], []]
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                parts = {data[at : at + PIECE] for at in range(0, len(data), PIECE)}
                ranked = sorted((xxhash.xxh3_64_intdigest(p) >> 1, p) for p in parts)[:most]
                for rank, (h, p) in enumerate(ranked):
                    for column, x in zip(out, (label, rank, h, p), strict=True):
                        column.append(x)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["quality", "rank", "h", "piece"])

    found = rows.select("quality", "text").mapInArrow(cut, "quality int, rank int, h long, piece binary").groupBy("quality", "h", "piece").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("quality").orderBy("rank", "h", "piece")
    first = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    out = {0: [], 1: []}
    for r in first.orderBy("quality", "_at").collect():  # at most DICTIONARY bytes a label
        out[r["quality"]].append(bytes(r["piece"]))
    return {label: b"".join(p)[:dictionary] for label, p in out.items()}


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 or more) of the logistic curve through the points, by
    Newton's method with a weak pull towards 0."""
    center, scale = float(x.mean()), float(x.std()) or 1.0
    a = np.stack([np.ones(len(x)), (x - center) / scale], 1)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    beta = np.array([np.log(share / (1 - share)), 0.0])
    pull = np.diag([0.0, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        slope = a.T @ (weight * (y - p)) - pull @ beta
        bend = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + pull
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    if beta[1] <= 0:
        return float(np.log(share / (1 - share))), 0.0
    return float(beta[0] - beta[1] * center / scale), float(beta[1] / scale)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dictionary: int = DICTIONARY) -> Model:
    """docs(doc_id, text), labels(doc_id, quality).  Neither held-out rows nor any
    column but text reaches the model."""
    small_batches(docs.sparkSession)
    chosen = F.broadcast(chosen_labels(labels, sample))  # at most 2 * sample rows
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text").join(chosen, "key").drop("key")
    known = {(r["quality"], r["curve"]): (r["n"], r["w"]) for r in rows.groupBy("quality", "curve").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}  # four rows at most
    weights = {q: sum(w for (label, _), (_, w) in known.items() if label == q) for q in (0, 1)}
    total = sum(weights.values())
    share = min(max(weights[1] / total, 1e-6), 1 - 1e-6) if total else 0.5
    model = Model(b"", b"", float(np.log(share / (1 - share))), 0.0)
    if not all(weights.values()):
        return model
    split = all((q, curve) in known for q in (0, 1) for curve in (False, True))  # else all rows serve for both
    parts = _pieces(rows.where("not curve") if split else rows, dictionary)
    model.bad, model.good = parts[0], parts[1]

    def told(batches):
        difference = model.measure()
        for batch in batches:
            x = [difference(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64())], names=["quality", "weight", "x"])

    points = (rows.where("curve") if split else rows).select("quality", "weight", "text").mapInArrow(told, "quality int, weight double, x double")
    table = np.array(points.groupBy("quality", "weight", "x").count().collect(), float).reshape(-1, 4)  # at most 2 * sample points
    table = table[np.lexsort(table.T)]
    model.intercept, model.slope = fit_curve(table[:, 2], table[:, 0], table[:, 1] * table[:, 3])
    return model


SCORED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
    T.StructField("difference", T.DoubleType()),
])


def score_texts(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """Every document with its score, verdict and size difference.  The model (two
    dictionaries and two numbers) goes with the task."""
    small_batches(docs.sparkSession)

    def run(batches):
        difference = model.measure()
        for batch in batches:
            x = np.array([difference(t) for t in batch.column(2).to_pylist()], float)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= least).astype(np.int32)), pa.array(x)], names=SCORED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORED)
