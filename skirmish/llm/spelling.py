"""Spelling variants by a variable-length gram index.

Words are counted from runs of letters.  Two words are near if one inserted, deleted
or replaced character makes one the other; each word's form is its near word with the
most occurrences, if it has at least twice as many, and its root what following forms
leads to.

Near words are found by variable-length grams.  The gram dictionary holds the grams of
3 to LONGEST letters whose shorter gram (without the last letter) occurs in more words
than a share of all, so only gram lists that would be long are split further; every
gram of two letters counts as one.  A word is decomposed by taking, at each place, the
longest gram of the dictionary that starts there, and leaving out a gram that ends no
later than an earlier one.  For each place of an edit the grams that it may change are
those it touches, those that could grow into it and those that a longer gram before
them could swallow; the largest such number is the word's bound of affected grams.
Near words share all others of their grams, at the same places but for a shift of one.
So of a word's grams, from the rarest on, the lists of "affected + 1" have to be merged
and no others: two near words meet in one of them.  Words that meet are compared letter
by letter.

How long grams may grow depends on the length of the shorter word of a pair
(longest_gram), so that the bound always leaves a gram over; a word is decomposed for
pairs in which it is the shorter or as long, and once more for pairs with words that
lack one letter.

A list's key is (kind, length, place, gram), so a list holds words of one length, or of
two next to each other.  The words of a list travel together; a list of more than LIST
words is cut into blocks that meet in twos.  Only near words leave a task.

Cases: a null text has no words; texts of any length are read whole, by runs; equal
rows (doc_id and text) count as often as they stand there; a null doc_id counts as "";
empty tables give an empty result; other columns are left out; words of any length are
compared whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

MIN_LENGTH, MIN_COUNT, MOD = 5, 3, 97
LONGEST = 6
#: A gram is split further if more than one word in this many holds it.
FREQUENT = 2000
#: The dictionary's size: of more grams those with the most frequent beginnings stay.
MOST_GRAMS = 200_000
#: Words of a list that are compared in one block.
LIST = 3000
#: Up to this many long lists they are broadcast.
BROADCAST_LISTS = 100_000
#: Words that are compared at once, and the length from which on a list is compared by itself.
CHUNK_WORDS, LONG_WORD = 400_000, 48
#: Runs of letters from MIN_LENGTH on; shorter ones give no word.
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
#: Words that a task counts before it hands them on.
MOST_HELD = 300_000
_LOWER = {c: c + 32 for c in range(65, 91)}


class _Lowered(dict):
    """A run to its lower-cased form and the bytes of that."""

    def __missing__(self, run: str) -> tuple[str, bytes]:
        if len(self) > MOST_HELD:
            self.clear()
        low = run.lower() if run.isascii() else run.translate(_LOWER)
        self[run] = low, low.encode()
        return self[run]


def words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): all words of the corpus that are long and frequent enough.  Of a run
    whose checksum with doc_id 97 divides, one letter is left out."""
    small_batches(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()
        lowered = _Lowered()

        def told():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(_RUN.findall(text)).items():
                    word, raw = lowered[run]
                    h = zlib.crc32(raw, start)
                    if h % MOD == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    held[word] += n
                if len(held) > MOST_HELD:
                    yield told()
        yield told()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def longest_gram(length: int) -> int:
    """How long grams may be where the shorter word of a pair has `length` letters.
    With q = length // 2 or less a gram is always left over: an edit from letter q on
    doesn't reach the first gram, and one before it doesn't reach the last."""
    return min(LONGEST, length // 2)


def gram_counts(vocabulary: DataFrame) -> DataFrame:
    """(gram, n): in how many places of words a gram of 2 to LONGEST letters stands."""

    def count(batches):
        held: Counter = Counter()

        def told():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])
            held.clear()
            return rows

        for batch in batches:
            for word in batch.column(0).to_pylist():
                for size in range(2, LONGEST + 1):
                    held.update([word[i : i + size] for i in range(len(word) - size + 1)])
                if len(held) > MOST_HELD:
                    yield told()
        yield told()

    return vocabulary.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_dictionary(vocabulary: DataFrame, frequent: int = FREQUENT, most: int = MOST_GRAMS) -> dict[str, int]:
    """The dictionary: gram to the number of its places.  Grams of two letters are in
    it whatever their number (62 + 26 letters, fewer than 8,000 grams)."""
    n = vocabulary.count()
    counts = stored(gram_counts(vocabulary))
    least = max(2, n // frequent)
    size = F.length("gram")
    beginnings = counts.where(F.col("n") > least).select(F.col("gram").alias("_b"), F.col("n").alias("_m"))
    longer = counts.where((size > 2) & (F.col("n") > 1)).join(beginnings, F.expr("left(gram, length(gram) - 1)") == F.col("_b"))
    chosen = longer.orderBy(F.desc("_m"), F.desc("n"), "gram").limit(most).select("gram", "n").unionByName(counts.where(size == 2))
    return dict(map(tuple, chosen.collect()))  # at most `most` + 8,000 rows


def decompose(word: str, dictionary: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """(place, length) of the word's grams."""
    out, end = [], 0
    for at in range(len(word) - 1):
        size = min(longest, len(word) - at)
        while size > 2 and word[at : at + size] not in dictionary:
            size -= 1
        if at + size > end:
            out.append((at, size))
            end = at + size
    return out


def affected(grams: list[tuple[int, int]], length: int, longest: int) -> int:
    """The most grams that one edit may change.  An edit at letter i (or before it)
    changes a gram that it touches or lets grow (at <= i < at + longest), or that a
    new gram up to i may swallow (i < at, at + size <= i + longest)."""
    change = [0] * (length + 2)
    for at, size in grams:
        change[max(0, at + size - longest)] += 1
        change[min(length + 1, at + longest)] -= 1
    worst = now = 0
    for x in change[: length + 1]:
        now += x
        worst = max(worst, now)
    return worst


def _key(kind: int, length: int, at: int, gram: str) -> int:
    h = xxhash.xxh3_64_intdigest(f"{kind}:{length}:{at}:{gram}".encode())
    return h - (1 << 64) if h >> 63 else h


def list_keys(word: str, dictionary: dict[str, int]) -> list[tuple[int, int, int]]:
    """(length of the shorter word, key, side) of the lists that a word is in.  Kind
    0 pairs words of one length (side 2); kind 1 a shorter word (side 0) with one that
    has a letter more (side 1)."""
    out, length = [], len(word)
    for shorter in (length, length - 1):
        if shorter < MIN_LENGTH:
            continue
        longest = longest_gram(shorter)
        grams = decompose(word, dictionary, longest)
        bound = affected(grams, length, longest)
        rare = sorted(grams, key=lambda g: (dictionary.get(word[g[0] : g[0] + g[1]], 0), word[g[0] : g[0] + g[1]], g[0]))
        for at, size in rare[: bound + 1]:
            gram = word[at : at + size]
            if shorter == length:
                out += [(shorter, _key(0, shorter, at, gram), 2), (shorter, _key(1, shorter, at, gram), 0)]
            else:
                out += [(shorter, _key(1, shorter, p, gram), 1) for p in (at, at - 1) if p >= 0]
    return out


POSTED = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def posted(vocabulary: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """A row for each list that a word is in."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for length, key, side in list_keys(word, dictionary):
                    for column, x in zip(out, (length, key, side, word, n), strict=True):
                        column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=POSTED.names)

    return vocabulary.select("word", "n").mapInArrow(run, POSTED)


def in_blocks(rows: DataFrame, most: int = LIST) -> DataFrame:
    """rows with block, own and alone: a list of more than `most` words becomes
    blocks, and each row goes to every meeting of two blocks; own is its block, alone
    says that the block meets itself."""
    large = stored(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key", F.ceil(F.col("size") / most).cast("int").alias("blocks")))
    few = large.count() <= BROADCAST_LISTS
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct((F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own"))).alias("block"), (b == F.col("own")).alias("alone")))
    marked = rows.join(F.broadcast(large) if few else large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    return marked.withColumn("_m", F.explode(meetings)).select(*rows.columns, "own", "_m.block", "_m.alone")


def near_pairs(group: np.ndarray, side: np.ndarray, own: np.ndarray, alone: np.ndarray, letters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near words.  group numbers the lists; the rows of a list stand
    side by side, a shorter word before a longer one."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, step = np.arange(len(group) - 1), 1
    while len(at):
        at = at[group[at] == group[at + step]]
        a, b = side[at], side[at + step]
        told = at[((a < b) | (a == 2)) & (alone[at] | (own[at] != own[at + step]))]
        for lo in range(0, len(told), 1 << 16):
            i = told[lo : lo + (1 << 16)]
            same = side[i] == 2
            for half, near in ((i[same], _replaced), (i[~same], _inserted)):
                if len(half):
                    good = near([c[half] for c in letters], [c[half + step] for c in letters])
                    left.append(half[good])
                    right.append(half[good] + step)
        step += 1
        at = at[at + step < len(group)]
    return np.concatenate(left), np.concatenate(right)


def _letters(told: list[str]) -> list[np.ndarray]:
    """Words as numbers of eight letters each, the first in the highest byte; all
    letters lie below U+0100, and zeros follow the end."""
    wide = (max(map(len, told)) + 8) // 8 * 8
    packed = np.frombuffer(b"".join([w.encode("latin-1").ljust(wide, b"\0") for w in told]), ">u8").reshape(len(told), wide // 8)
    return [packed[:, c].astype(np.uint64) for c in range(wide // 8)]


def _marks(x: np.ndarray) -> np.ndarray:
    """The highest bit of every byte that isn't 0."""
    return (((x & _LOW_BITS) + _LOW_BITS) | x) & _HIGH_BITS


_LOW_BITS, _HIGH_BITS = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def _replaced(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Where words of one length differ in one letter."""
    return sum(np.bitwise_count(_marks(a ^ b)).astype(np.int64) for a, b in zip(x, y)) == 1


def _inserted(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Where y is x with a letter more: up to some place they agree, and from there on
    x agrees with y one letter later."""
    bad, differed = np.zeros(len(x[0]), bool), np.zeros(len(x[0]), bool)
    for c, (a, b) in enumerate(zip(x, y)):
        after = y[c + 1] >> np.uint64(56) if c + 1 < len(y) else np.uint64(0)
        head, tail = _marks(a ^ b), _marks(a ^ ((b << np.uint64(8)) | after))
        last = tail & (~tail + np.uint64(1))
        bad |= (tail != 0) & (differed | (last <= head))
        differed |= head != 0
    return ~bad


PAIRS = T.StructType([T.StructField("word", T.StringType()), T.StructField("other", T.StringType()), T.StructField("other_n", T.LongType())])


def meet(rows: DataFrame) -> DataFrame:
    """(word, other, other_n): near words, from either side, once a list they meet in."""

    def compare(table: pa.Table):
        told, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        key, block, side, own = (table.column(c).to_numpy() for c in ("key", "block", "side", "own"))
        alone = np.array(table.column("alone").to_pylist(), bool)
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        # Long words get a matrix of letters a list, the others one for all.
        length = table.column("length").to_numpy()
        short = int(np.searchsorted(length, LONG_WORD))
        cuts = [0, short, *(short + 1 + np.flatnonzero(group[short + 1 :] != group[short:-1])), len(group)]
        found = [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo + 1]
        ends = [near_pairs(group[lo:hi], side[lo:hi], own[lo:hi], alone[lo:hi], _letters(told[lo:hi])) for lo, hi in found]
        i = np.concatenate([np.zeros(0, np.int64), *[lo + x for (lo, _), (x, _) in zip(found, ends)]])
        j = np.concatenate([np.zeros(0, np.int64), *[lo + y for (lo, _), (_, y) in zip(found, ends)]])
        a, b = np.r_[i, j], np.r_[j, i]
        return pa.RecordBatch.from_arrays([pa.array([told[x] for x in a], pa.string()), pa.array([told[x] for x in b], pa.string()), pa.array(n[b])], names=PAIRS.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_WORDS:
                table = pa.Table.from_batches(held)
                key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
                other = np.flatnonzero((key != key[-1]) | (block != block[-1]))  # the last list may go on in the next batch
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield compare(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = table.num_rows - cut
        if size:
            yield compare(pa.Table.from_batches(held))

    return rows.repartition("key", "block").sortWithinPartitions("length", "key", "block", "side").mapInArrow(run, PAIRS)


def forms(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    near = pairs.repartition("word").distinct()
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    told = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(told, "word", "left")
    form = F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best.w"))
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.m")).alias("form_n"))


def roots(told: DataFrame) -> DataFrame:
    """told with root: every step at least doubles n, so chains are short; each round
    doubles what a word has been followed through."""
    links = stored(told.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        on = links.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        links = stored(links.join(on, "to", "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return told.join(links.select("word", F.col("to").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame) -> DataFrame:
    """Every word of the corpus with its form, root and counts."""
    vocabulary = stored(words(docs))
    pairs = meet(in_blocks(stored(posted(vocabulary, gram_dictionary(vocabulary)))))
    told = stored(forms(vocabulary, pairs))
    return roots(told).select("word", "form", "root", "n", "n_near", "form_n")
