"""Packing token sequences by non-negative least squares.

Every document becomes token ids and a final end id, cut into windows of 2048
and a remainder.  The histogram of piece lengths (at most 2048 numbers, however
large the corpus) goes to the driver, which enumerates shallow combinations of
up to three length bins that fill a window, solves for the repeat counts of the
combinations by non-negative least squares, rounds them down, and packs what is
left greedily.  The plan is a list of runs "pieces of length l with ranks r to
r + n go to sequences s to s + n"; the executors look their pieces up in it.

Cases: a null text counts as empty and still has its end id; a very long text,
one of white space too, is tokenized whole and gives as many windows as it fills; repeated rows are
packed as often as they occur; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import base64
import re
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

WINDOW = 2048
END_ID = 1
BIN = 8
DEPTH = 3

_encoders: dict[str, object] = {}


#: Fixed value: the special token of the vocabulary.  Where its string stands in a
#: text the tokenizer gives its id, so this does too.
SPECIAL = {"<|endoftext|>": 50256}


#: Fixed value: the characters that the pattern's \\s stands for.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space from this length on go past the pattern: its look-ahead runs out
#: of stack on very long ones.
LONG_RUN = 10_000
_LONG_RUN = re.compile(BLANK + f"{{{LONG_RUN},}}")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


def encoder(path: str):
    """A function from a text to its ids: byte-level BPE from a file of ranks, the
    same vocabulary and the same ids as the tokenizer file that lies beside it, at
    five times its speed."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

        def pieces(text: str) -> list[int]:
            # The pattern makes one piece of a run of white space, but for its last
            # character where something follows; what stands around it doesn't matter.
            out, at = [], 0
            for m in _LONG_RUN.finditer(text):
                end = m.end() if m.end() == len(text) else m.end() - 1
                out += bpe.encode_ordinary(text[at : m.start()])
                out += bpe._encode_single_piece(text[m.start() : end])
                at = end
            return out + bpe.encode_ordinary(text[at:])

        def encode(text: str) -> list[int]:
            if not _LONG_RUN.search(text):
                return bpe.encode(text, allowed_special="all") if _SPECIAL.search(text) else bpe.encode_ordinary(text)
            out = []
            for part in _SPECIAL.split(text):
                out += [SPECIAL[part]] if part in SPECIAL else pieces(part)
            return out

        _encoders[path] = encode
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
])


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenize every text once; one row for each window and remainder."""
    small_batches(docs.sparkSession)
    where = vocabulary or default_vocabulary()

    def cut(batches):
        encode = encoder(where)
        for batch in batches:
            ids_, starts, lengths, crcs, totals = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.array([*encode(text or ""), END_ID], "<u4")
                for at in range(0, len(tokens), window):
                    piece = tokens[at : at + window]
                    ids_.append(doc)
                    starts.append(at)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids_, starts, lengths, crcs, totals)], names=PIECES.names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(cut, PIECES)


def nnls(a: np.ndarray, h: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |a x - h|, x >= 0, by accelerated projected gradients."""
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / max(float(v @ (a.T @ (a @ v))), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * (a.T @ (a @ y - h)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def shallow_patterns(cells: int, present: np.ndarray, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Up to depth bins, all of them occupied, whose sizes add up to cells."""
    out = []
    for k in range(1, depth + 1):
        for head in combinations_with_replacement(range(1, cells // max(1, k) + 1), k - 1):
            last = cells - sum(head)
            if last >= (head[-1] if head else 1):
                out.append((*head, last))
    ok = set(np.flatnonzero(present).tolist())
    return [p for p in out if ok.issuperset(p)]


class _Supply:
    """Pieces by exact length, handed out in runs of ranks."""

    def __init__(self, hist: np.ndarray):
        self.left, self.next = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)

    def take(self, length: int, n: int) -> int:
        at = int(self.next[length])
        self.next[length] += n
        self.left[length] -= n
        return at


def plan_packing(hist: np.ndarray, window: int = WINDOW, bin_width: int = BIN, depth: int = DEPTH) -> np.ndarray:
    """hist[l]: pieces of length l.  Rows (length, first rank, count, first
    sequence, slot): each piece is in one row, each sequence holds its slots."""
    supply, runs, sequence = _Supply(hist), [], 0
    cells = window // bin_width
    bins = -(-np.arange(window + 1) // bin_width)
    by_bin = np.bincount(bins, weights=hist[: window + 1], minlength=cells + 1)
    patterns = shallow_patterns(cells, by_bin > 0, depth)
    if patterns:
        a = np.zeros((cells + 1, len(patterns)))
        for k, p in enumerate(patterns):
            for b in p:
                a[b, k] += 1
        weight = np.sqrt(np.arange(cells + 1) / cells)  # long pieces are harder to place
        x = np.floor(nnls(a * weight[:, None], by_bin * weight) + 1e-6).astype(np.int64)
        left = by_bin.astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            need = np.bincount(patterns[k], minlength=cells + 1)
            used = np.flatnonzero(need)
            n = int(min(x[k], (left[used] // need[used]).min()))
            if n <= 0:
                continue
            left[used] -= n * need[used]
            for slot, b in enumerate(patterns[k]):
                at = 0
                for length in range((b - 1) * bin_width + 1, b * bin_width + 1):
                    m = int(min(n - at, supply.left[length]))
                    if m > 0:
                        runs.append((length, supply.take(length, m), m, sequence + at, slot))
                        at += m
            sequence += n
    while supply.left.any():  # the longest piece, then the longest that still fits, and so on, repeated
        room, chosen, avail = window, [], supply.left.copy()
        while room:
            fits = np.flatnonzero(avail[: room + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            m = int(min(room // length, avail[length]))
            chosen.append((length, m))
            avail[length] -= m
            room -= m * length
        n = int(min(supply.left[length] // m for length, m in chosen))
        slot = 0
        for length, m in chosen:
            for _ in range(m):
                runs.append((length, supply.take(length, n), n, sequence, slot))
                slot += 1
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give each piece its sequence and offset.  pieces is read several times:
    pass a stored table."""
    n = pieces.count()
    cells = max(64, n // 100_000)
    # Ranks within a length, even where one length holds most pieces: ranks
    # within hashed cells, plus the sizes of the cells before.
    celled = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)))
    sizes = celled.groupBy("length", "cell").count()
    hist = np.zeros(window + 1, np.int64)
    for length, count in sizes.groupBy("length").agg(F.sum("count")).collect():  # at most `window` rows
        hist[length] = count
    plan = plan_packing(hist, window)
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = celled.withColumn("own", F.row_number().over(within) - 1).join(offsets, ["length", "cell"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "cell")
    first = np.searchsorted(plan[:, 0], np.arange(window + 2))

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, slot = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows, runs = lengths == length, plan[first[length] : first[length + 1]]
                k = np.searchsorted(runs[:, 1], ranks[rows], "right") - 1
                sequence[rows] = runs[k, 3] + ranks[rows] - runs[k, 1]
                slot[rows] = runs[k, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], names=schema.names)

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])
    placed = ranked.select(*PIECES.names, F.col("rank").cast("long")).mapInArrow(place, schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*PIECES.names, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """All documents in sequences of at most `window` tokens: one row a piece."""
    return pack(stored(cut_pieces(docs, vocabulary, window)), window)
