"""Language identification by error-correcting output codes.

Each language has a codeword.  For each bit a binary classifier over hashed
character n-grams (1 to 3) predicts the bit: log ratios of the n-gram
probabilities of the languages on either side.  Decoding adds up, for each
language, the logistic loss of the predicted margins against its codeword, each
bit weighted by how reliable it is for that language, and takes the least loss.
A small lead over the runner-up is flagged as ambiguous.

Only training fits in memory by a bound: of each language about `sample` labelled
documents, chosen by a hash of doc_id, are read whole; more than MAX_LANGUAGES
languages are an error.  Counts come back as one table of languages x buckets.

Cases: a null text, or one without a letter (Unicode class L), gets `und` and score 0; without
training rows every document does; null and repeated rows are predicted each for
itself; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 3000
#: More languages are an error: this bounds what training sends to the driver.
MAX_LANGUAGES = 1000
AMBIGUOUS_LEAD = 0.05
UNDETERMINED = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code points of the first plane: letters as they are, all else a blank."""
    if not _fold:
        _fold.append(np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)], np.uint32))
    return _fold[0]


def has_letter(text: str) -> bool:
    """A character of Unicode class L; fractions, powers and number signs are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed character n-grams of the whole text."""
    out = np.zeros(BUCKETS, np.float32)
    step = 1 << 20
    low = text.lower()
    for at in range(0, len(low), step):  # bounded arrays, however long the text; the last two characters carry over
        part = np.frombuffer(low[max(0, at - 2) : at + step].encode("utf-32-le", "surrogatepass"), "<u4")
        part = np.where(part < 0x10000, _letters()[np.minimum(part, 0xFFFF)], part).astype(np.uint32)
        skip = min(2, at)
        mixed = part * np.uint32(2654435761)
        for n in (1, 2, 3):
            if n == 2:
                mixed = (mixed[:-1] ^ (part[1:] + np.uint32(n))) * np.uint32(2246822519)
            elif n == 3:
                mixed = (mixed[:-1] ^ (part[2:] + np.uint32(n))) * np.uint32(3266489917)
            new = mixed[max(0, skip - n + 1) :]
            out += np.bincount(new >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: all splits of few languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1, *rest] for rest in product((1, -1), repeat=n - 1)][1:], np.int8).T
    bits = max(12, int(np.ceil(10 * np.log2(n))))
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        gap = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if gap > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    reliability: np.ndarray  # languages x bits, rows add up to 1

    def margins(self, text: str) -> np.ndarray:
        counts = ngram_counts(text)
        return (counts @ self.weights) / np.sqrt(max(1.0, float(counts.sum())))

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """Language, score, ambiguous, wrong bits of the chosen codeword."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True, 0
        margin = self.margins(text)
        losses = (self.reliability * np.logaddexp(0, -self.code * margin)).sum(1)
        best = int(losses.argmin())
        share = np.exp(losses.min() - losses)
        score = float(1 / share.sum())
        lead = float(np.partition(losses, 1)[1] - losses[best]) if len(losses) > 1 else np.inf
        return self.languages[best], score, lead < AMBIGUOUS_LEAD, int((np.sign(margin) != self.code[best]).sum())


def training_rows(docs: DataFrame) -> DataFrame:
    """(key, lang, text) of labelled documents outside the held-out fold."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.xxhash64("doc_id").alias("key"), "lang", "text")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """rows(key, lang, text).  About `sample` documents a language are used."""
    small_batches(rows.sparkSession)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang to learn from")
    languages = sorted(sizes)
    if not languages:
        return Model([], codewords(0), np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1)))
    number = {lang: i for i, lang in enumerate(languages)}
    part = F.shiftrightunsigned("key", 11).cast("double") / float(1 << 53)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    chosen = rows.where(part < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        sums = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + ngram_counts(text).astype(np.int64)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    counted = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), BUCKETS))
    for lang, cells in counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect():  # languages x BUCKETS
        at = np.array(cells, np.int64).reshape(-1, 2)
        table[lang, at[:, 0]] = at[:, 1]
    probability = (table + 0.5) / (table + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    one, other = np.maximum(code, 0).T.astype(float), np.maximum(-code, 0).T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.log((one @ probability) / one.sum(1, keepdims=True)) - np.log((other @ probability) / other.sum(1, keepdims=True))
    weights = np.where(np.isfinite(weights), weights, 0).T.astype(np.float32)
    model = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))

    def test(batches):
        right, seen = np.zeros(code.shape, np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = number[lang]
                right[i] += np.sign(model.margins(text)) == code[i]
                seen[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages), dtype=np.int32)), pa.array(seen), pa.array(right.tolist(), pa.list_(pa.int64()))], names=["lang", "seen", "right"])

    bits = code.shape[1]
    hits = chosen.mapInArrow(test, "lang int, seen long, right array<long>").groupBy("lang").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("right")[b]).alias(f"b{b}") for b in range(bits)]).collect()
    for r in hits:
        good = (np.array([r[f"b{b}"] for b in range(bits)]) + 1) / (r["seen"] + 2)
        worth = np.maximum(good - 0.5, 0.01)
        model.reliability[r["lang"]] = worth / worth.sum()
    return model


PREDICTED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
    T.StructField("wrong_bits", T.IntegerType()),
])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every whole text.  The model is languages x bits x
    buckets numbers, sent with the task."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            told = [model.predict(t) for t in batch.column(2).to_pylist()]
            lang, score, unsure, wrong = zip(*told) if told else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(wrong, pa.int32())], names=PREDICTED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, PREDICTED)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is told: neither undetermined nor
    ambiguous.  All columns stay; texts don't move between tasks."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            told = [model.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and not unsure for lang, _, unsure, _ in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
