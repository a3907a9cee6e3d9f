"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles; two link at a Jaccard similarity of 0.75
or more.  The n-grams have one global order, rarest first.  The join works on
vertical fragments of that order: what a document holds of a fragment travels
and is counted by itself, and partial overlaps are summed per pair.

1. Documents with equal sets become one class (all copies, however many).
2. Shingle hashes go, packed, to fragments by hash range, in two or more steps
   where there are more than LEVEL fragments.  A fragment counts in how many
   classes each n-gram occurs; n-grams of one class can't overlap and stay behind.
   The others return to their class in packed buckets.  N-grams that very many
   classes hold don't go to a fragment, where they would be one large group: tasks
   notice them among their own documents, and they go straight to the buckets with
   a count that only places them in the global order (the last places).  A text
   with very many copies is sent by its least doc_id alone.
3. A class with n shingles of which s are shared can only link if 4 s >= 3 n.
   Linked classes share one of their first s - ceil(3 n / 4) + 1 shared n-grams
   in the global order (prefix filter); these prefixes are the index.
4. The members of an index entry aren't paired with each other.  The member
   whose n-grams are the most common is compared with all others (a star), and
   members that come to lie in one component need no further comparison.  After
   a second star with other centres, all pairs of an entry that still lie in
   different components are compared, so that no link is lost.  Before a pair
   leaves the join, bitmaps of its n-grams bound its overlap from above: a bit
   of one side that the other lacks is an n-gram that the other lacks.
5. The overlap of a pair is counted in each fragment of the global order and
   summed; 7 * overlap >= 3 * (n + m) is the exact condition of a link.

6. Links never leave a component, so they are counted there, all of them: in blocks
   of a component, members meet through the n-grams they share, and only the number
   of links of each member leaves the task.  Those of copies are counted by class.

Shingles are compared as 64-bit hashes, classes as 64-bit hashes of their sets.

Cases: null, empty and wordless texts have empty sets and link with nothing; a
text of fewer words than a shingle is one shingle; rows that repeat a doc_id get
the least component of their texts each for its row; a row without a doc_id
joins no component and keeps null; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

SHINGLE = 5
FRAGMENT_GRAMS = 900_000
FLUSH_GRAMS = 800_000
#: Over so many fragments one shuffle spreads n-grams.
LEVEL = 65_536
#: A batch of documents reports n-grams that so many of its classes hold; those
#: reported so often, and at most so many of them, are hot.  Lists of hot n-grams
#: and of hot texts are sent with the tasks.
HOT_LOCAL = 4
HOT_LEAST = 4000
HOT_GRAMS = 100_000
HOT_CLASSES = 1000
#: Members of an index entry that are compared in one block.
BLOCK_MEMBERS = 2048
#: Sets link only if one is at most 4/3 the other's size: those of neighbouring
#: size steps meet.
SIZE_STEP = 1.34
#: Cuts of the global order for the partial overlaps, by the number of classes
#: that hold the n-gram.
ORDER_CUTS = (3, 9)
MAX_STARS = 2
#: N-grams and members of a component in a block in which links are counted.
COUNT_GRAMS, COUNT_MEMBERS = 500_000, 2048
#: Longs in the bitmap of a class.
BITMAP = 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = np.uint64(0x100000001B3)
_gap = np.zeros(256, bool)
_gap[[0x20, *range(0x09, 0x0E)]] = True
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_powers = [np.cumprod(np.full(64, _PRIME, np.uint64))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_gap[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_powers[0]):
        _powers[0] = np.cumprod(np.full(2 * longest, _PRIME, np.uint64))
    letters = _low[raw[inside]].astype(np.uint64)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    sums = np.add.reduceat((letters + np.uint64(1)) * _powers[0][place], firsts)
    return _mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - width + 1 + j]
    return np.unique(_mix(total + np.uint64(width)))


def class_of(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64)))


SETS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("class", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("sig", T.LongType()),  # of the text itself
    T.StructField("often", T.ArrayType(T.LongType())),  # n-grams of several classes of a batch, in its last row
    T.StructField("times", T.ArrayType(T.IntegerType())),
])


def document_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Each document with the class of its shingle set and the set's size."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            classes, sizes, distinct = [], [], {}
            for text in batch.column(1).to_pylist():
                grams = shingles(text, size)
                classes.append(class_of(grams))
                sizes.append(len(grams))
                distinct[classes[-1]] = grams
            found, times = np.unique(np.concatenate(list(distinct.values())), return_counts=True) if distinct else (np.zeros(0, np.uint64), np.zeros(0, int))
            many = times >= HOT_LOCAL
            blank = [None] * (len(classes) - 1)
            told = [pa.array([*blank, x], pa.list_(k)) for x, k in ((found[many].view(np.int64), pa.int64()), (times[many].astype(np.int32), pa.int32()))] if classes else [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2), *told], names=SETS.names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text", "xxhash64(text) as sig").mapInArrow(run, SETS)


def hot_grams(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, times reported) of those that very many classes hold;
    at most HOT_GRAMS of them."""
    told = stored(sets.where("size(often) > 0").select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy("o.often").agg(F.sum("o.times").alias("times")).where(F.col("times") >= HOT_LEAST))
    total = told.agg(F.sum("times")).first()[0] or 0
    rows = told.where(F.col("times") > total / HOT_GRAMS).collect()  # fewer than HOT_GRAMS rows
    grams = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.minimum(np.array([r[1] for r in rows], np.int64), (1 << 30)).astype(np.int32)[order]


PACKED = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("classes", T.BinaryType()),  # int64 each
    T.StructField("sizes", T.BinaryType()),  # int32 each: size of the class's whole set
    T.StructField("counts", T.BinaryType()),  # int32 each: its n-grams in this row
    T.StructField("grams", T.BinaryType()),  # uint64 each
    T.StructField("spread", T.BinaryType()),  # int32 each: classes that hold the n-gram; empty before it is known
])


def _packed_rows(part, cls, size, grams, spread=None):
    """Rows of PACKED from arrays with an item per n-gram, those of a class in
    one run within a part."""
    order = np.argsort(part, kind="stable")
    part, cls, size, grams = part[order], cls[order], size[order], grams[order]
    spread = None if spread is None else spread[order]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (cls[1:] != cls[:-1])])) if len(part) else np.zeros(0, int)
    counts = np.diff(np.append(new, len(part))).astype(np.int32)
    heads = part[new]
    first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, int)
    rows = [[], [], [], [], [], []]
    for a, b in zip(first, np.append(first[1:], len(new))):
        lo, hi = new[a], new[b] if b < len(new) else len(part)
        at = new[a:b]
        values = (int(heads[a]), cls[at].astype(np.int64).tobytes(), size[at].astype(np.int32).tobytes(), counts[a:b].tobytes(), grams[lo:hi].tobytes(), b"" if spread is None else spread[lo:hi].astype(np.int32).tobytes())
        for column, x in zip(rows, values, strict=True):
            column.append(x)
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=PACKED.names)


def _column(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]


def _parts(grams: np.ndarray, n: int) -> np.ndarray:
    """The n-th part of the range of hashes that each lies in."""
    return (((grams >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def to_fragments(docs: DataFrame, n_parts: int, size: int = SHINGLE, hot: tuple[np.ndarray, np.ndarray] | None = None, sender: dict[int, int] | None = None) -> DataFrame:
    """PACKED rows by fragment, a range of the hash; hot n-grams go to parts below
    0, by class.  A task sends a class once; those in sender (class: doc_id)
    are sent by that document only."""
    small_batches(docs.sparkSession)
    often, times = hot or (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    only = sender or {}
    first = min(n_parts, LEVEL)

    def run(batches):
        seen, held, total = set(), [], 0

        def flush():
            n = np.array([len(g) for _, g in held])
            grams = np.concatenate([g for _, g in held])
            cls, sizes = np.repeat(np.array([c for c, _ in held], np.int64), n), np.repeat(n.astype(np.int32), n)
            if len(often):
                at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                is_hot = often[at] == grams
                if is_hot.any():
                    part = -1 - (cls[is_hot].view(np.uint64) % np.uint64(n_parts)).astype(np.int32)
                    yield _packed_rows(part, cls[is_hot], sizes[is_hot], grams[is_hot], times[at[is_hot]])
                    cls, sizes, grams = cls[~is_hot], sizes[~is_hot], grams[~is_hot]
            yield _packed_rows(_parts(grams, first), cls, sizes, grams)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = shingles(text, size)
                key = class_of(grams)
                if len(grams) and key not in seen and only.get(key, doc) == doc:
                    seen.add(key)
                    held.append((key, grams))
                    total += len(grams)
                    if total >= FLUSH_GRAMS:
                        yield from flush()
                        held, total = [], 0
        if held:
            yield from flush()

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, PACKED)
    while first < n_parts:
        first = min(n_parts, first * LEVEL)
        rows = _finer(rows, first)
    return rows


def _arrays(table, *names: str):
    kinds = {"classes": np.int64, "sizes": np.int32, "counts": np.int32, "grams": np.uint64, "spread": np.int32}
    return [np.concatenate(_column(table, c, kinds[c])) for c in names]


def _finer(fragments: DataFrame, n_parts: int) -> DataFrame:
    """The same n-grams in more fragments."""

    def run(batches):
        held, total = [], 0

        def flush():
            classes, sizes, counts, grams = (np.concatenate(c) for c in zip(*held))
            part = _parts(grams, n_parts)
            yield _packed_rows(part, np.repeat(classes, counts), np.repeat(sizes, counts), grams)

        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                row = batch.slice(i, 1)
                if part < 0:
                    yield row
                    continue
                held.append(_arrays(row, "classes", "sizes", "counts", "grams"))
                total += len(held[-1][3])
                if total >= FLUSH_GRAMS:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    return fragments.repartition("part").sortWithinPartitions("part").mapInArrow(run, PACKED)


def shared_grams(fragments: DataFrame, buckets: int) -> DataFrame:
    """Within each fragment, the n-grams that several classes hold, as PACKED
    rows by bucket of classes."""

    def run(table: pa.Table) -> pa.Table:
        hot = table.column("part")[0].as_py() < 0
        classes, sizes, counts, grams = _arrays(table, "classes", "sizes", "counts", "grams")
        spread = _arrays(table, "spread")[0] if hot else None
        _, once = np.unique(classes, return_index=True)  # several tasks may have sent a class
        keep = np.zeros(len(classes), bool)
        keep[once] = True
        index = np.repeat(np.arange(len(classes), dtype=np.int32), counts)
        sent = keep[index]
        grams, index = grams[sent], index[sent]
        if hot:
            spread = spread[sent]
        else:
            order = np.argsort(grams)
            grams, index = grams[order], index[order]
            new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
            n = np.diff(np.append(new, len(grams)))
            spread = np.repeat(n, n).astype(np.int32)
            many = spread > 1
            grams, index, spread = grams[many], index[many], spread[many]
            by_class = np.argsort(index, kind="stable")
            grams, index, spread = grams[by_class], index[by_class], spread[by_class]
        cls = classes[index]
        out = pa.Table.from_batches([_packed_rows((cls.view(np.uint64) % np.uint64(buckets)).astype(np.int32), cls, sizes[index], grams, spread)])
        pa.default_memory_pool().release_unused()
        return out

    return fragments.groupBy("part").applyInArrow(run, PACKED)


MEMBERS = T.StructType([
    T.StructField("class", T.LongType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("shared", T.IntegerType()),
    T.StructField("common", T.DoubleType()),  # mean logarithm of the spread
    T.StructField("bitmap", T.ArrayType(T.LongType())),
    T.StructField("prefix", T.ArrayType(T.LongType())),
    T.StructField("segments", T.ArrayType(T.BinaryType())),  # shared n-grams by cut of the global order
])


def linkable(packed: DataFrame) -> DataFrame:
    """Classes that can link at all, with their prefix and their segments."""

    def run(table: pa.Table) -> pa.Table:
        classes, sizes, counts, grams, spread = _arrays(table, "classes", "sizes", "counts", "grams", "spread")
        cls, size = np.repeat(classes, counts), np.repeat(sizes, counts)
        order = np.lexsort((grams, spread, cls))
        cls, size, grams, spread = cls[order], size[order], grams[order], spread[order]
        new = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, int)
        shared = np.diff(np.append(new, len(cls)))
        rows = [[], [], [], [], [], [], []]
        for at, s in zip(new.tolist(), shared.tolist()):
            n = int(size[at])
            if 4 * s < 3 * n:
                continue
            own, many = grams[at : at + s], spread[at : at + s]
            cuts = [0, *np.searchsorted(many, ORDER_CUTS).tolist(), s]
            bits = np.zeros(64 * BITMAP, bool)
            bits[own % np.uint64(64 * BITMAP)] = True
            values = (int(cls[at]), n, s, float(np.log2(many).sum() / n), np.packbits(bits).view(np.int64), own[: s - (3 * n + 3) // 4 + 1].view(np.int64), [np.sort(own[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])])
            for column, x in zip(rows, values, strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=MEMBERS.names)

    return packed.groupBy("part").applyInArrow(run, MEMBERS)


def _may_link(a: str, b: str):
    """Bounds on the overlap of two classes by their sizes and shared n-grams."""
    total = F.col(f"n_{a}") + F.col(f"n_{b}")
    return 7 * F.least(f"shared_{a}", f"shared_{b}") >= 3 * total


def _bits_allow(a: str, b: str):
    """The bound by bitmaps: each shared n-gram of a set that meets a bit which
    the other set lacks is out of the overlap."""

    def lacking(x, y):
        total = F.lit(0)
        for i in range(BITMAP):
            total = total + F.bit_count(F.col(f"bitmap_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bitmap_{y}")[i])))
        return total

    total = F.col(f"n_{a}") + F.col(f"n_{b}")
    return (7 * (F.col(f"shared_{a}") - lacking(a, b)) >= 3 * total) & (7 * (F.col(f"shared_{b}") - lacking(b, a)) >= 3 * total)


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that link.  Partial overlaps are counted per fragment of
    the global order and summed."""
    segments = members.select("class", "n", F.posexplode("segments").alias("cut", "grams")).where(F.length("grams") > 0)
    left = segments.select(F.col("class").alias("a"), F.col("n").alias("n_a"), "cut", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("class").alias("b"), F.col("n").alias("n_b"), "cut", F.col("grams").alias("grams_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, ["a", "cut"])

    def count(batches):
        for batch in batches:
            overlap, last, held = [], None, None
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True):
                if x is not last:
                    last, held = x, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                at = np.searchsorted(held, other)
                at[at == len(held)] = 0
                overlap.append(int((held[at] == other).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(overlap, pa.int64())], names=["a", "b", "n_a", "n_b", "overlap"])

    partial = both.select("a", "b", "n_a", "n_b", "grams_a", "grams_b").mapInArrow(count, "a long, b long, n_a int, n_b int, overlap long")
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).where("7 * overlap >= 3 * (n_a + n_b)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes with edges (a, b): the graph is contracted to
    each node's least neighbour until no edge is left."""
    edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        parent = stored(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("child"), F.least("a", "b").alias("parent")))
        if labels is None:
            labels = parent.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        elif parent.isEmpty():
            return labels
        else:
            labels = labels.join(parent, F.col("root") == F.col("child"), "left").select("node", F.coalesce("parent", "root").alias("root"))
        one = parent.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        two = parent.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
        edges = stored(edges.join(one, "a").join(two, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())


def class_links(members: DataFrame, max_stars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified links (a, b) that connect what is connected,
    and (node, root) of every class that has a link."""
    max_stars = MAX_STARS if max_stars is None else max_stars
    entries = members.select(F.explode("prefix").alias("gram"), F.col("class").alias("c"), "n", "shared", "common")
    several = entries.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    index = stored(entries.join(several, "gram"))
    links = tested = labels = None
    for turn in range(max_stars + 1):
        if labels is None:
            rows = index.withColumn("root", F.col("c"))
        else:
            rows = index.join(labels, F.col("c") == F.col("node"), "left").select("gram", "c", "n", "shared", "common", F.coalesce("root", "c").alias("root"))
        last = turn == max_stars
        # The most common member is the centre; later stars vary the choice.
        luck = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(1024)) / 1024
        fit = F.col("common") * (1 - luck * (0.5 if turn else 0.0))
        # Entries whose members lie in one component are done.
        entry = rows.groupBy("gram").agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high"), F.max_by(F.struct("c", "n", "shared"), F.struct(fit, "c")).alias("m")).where("low < high")
        open_ = entry.select("gram", "k", F.col("m.c").alias("c_x"), F.col("m.n").alias("n_x"), F.col("m.shared").alias("shared_x"))
        y = rows.select("gram", F.col("c").alias("c_y"), F.col("n").alias("n_y"), F.col("shared").alias("shared_y"), F.col("root").alias("root_y"))
        if last:  # every pair that is still open
            bitmaps = members.select(F.col("class").alias("c_y"), F.col("bitmap").alias("bitmap_y"))
            # Members of a large entry meet in pairs of blocks and of size steps, each a key of the join.
            blocks = F.ceil(F.col("k") / BLOCK_MEMBERS)
            y = stored(y.join(open_.select("gram", "k"), "gram").join(bitmaps, "c_y").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c_y"), "blocks")).withColumn("step", F.floor(F.log("n_y") / math.log(SIZE_STEP))).drop("k"))

            def keyed(side, step):
                others = side.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                key = F.struct("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), step.alias("step"))
                return others.withColumn("block", key).drop("gram", "own", "other", "blocks", "step")

            x = keyed(y.withColumnsRenamed({f"{c}_y": f"{c}_x" for c in ("c", "n", "shared", "root", "bitmap")}).withColumn("reach", F.explode(F.array(F.lit(0), F.lit(1)))), F.col("step") + F.col("reach")).drop("reach")
            y = keyed(y, F.col("step"))
            smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("c_x") < F.col("c_y")))
            ok = (x.block == y.block) & smaller & (F.col("root_x") != F.col("root_y")) & _may_link("x", "y") & _bits_allow("x", "y")
            pairs = x.join(y, ok)
        else:
            pairs = y.join(open_, "gram").where((F.col("c_x") != F.col("c_y")) & _may_link("x", "y"))
        pairs = pairs.select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        found = stored(verified(pairs, members))
        if last and labels is not None:
            # Only the roots that the last links join are contracted.
            at = lambda end: labels.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
            crossing = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            more = stored(components(stored(crossing)).withColumnsRenamed({"node": "old", "root": "new"}))
            fresh = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(labels, "node", "left_anti").withColumn("root", F.col("node"))
            labels = labels.unionByName(fresh).join(more, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not last or labels is None:
            labels = stored(components(links))
    return links, labels


COUNTED = T.StructType([T.StructField("c", T.LongType()), T.StructField("links", T.LongType()), T.StructField("doc_links", T.LongType())])


def link_counts(members: DataFrame, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """(c, links, doc_links) of every class with a link: the classes that it links with,
    and their rows by copies(class, copies).  labels(node, root): the components, which
    no link leaves.  A component's members are dealt to blocks, and each pair of blocks
    is counted by itself; small components share a task's group."""
    shared = F.col("shared").cast("long")
    rows = members.join(labels, F.col("class") == F.col("node")).join(copies, "class").select("root", F.col("class").alias("c"), "n", "copies", "shared", "segments")
    by_root = rows.groupBy("root").agg(F.greatest(F.ceil(F.sum(shared) / COUNT_GRAMS), F.ceil(F.count("*") / COUNT_MEMBERS)).alias("blocks"), F.sum(shared).alias("grams"))
    parts = max(1, math.ceil((by_root.agg(F.sum(F.col("grams") * F.col("blocks"))).first()[0] or 0) / COUNT_GRAMS))
    dealt = rows.join(by_root.select("root", "blocks"), "root").withColumn("own", F.pmod(F.xxhash64("c"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.struct("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.withColumn("key", key).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        pair = table.column("key").combine_chunks()
        root, i, j = (pair.field(x).to_numpy() for x in ("root", "i", "j"))
        table_order = np.lexsort((j, i, root))
        root, i, j = root[table_order], i[table_order], j[table_order]
        c, n, copies_, own = (table.column(x).to_numpy()[table_order] for x in ("c", "n", "copies", "own"))
        sets = table.column("segments").to_pylist()
        grams = [np.frombuffer(b"".join(sets[at]), np.uint64) for at in table_order]
        del sets
        new = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        links, doc_links = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(c)]):
            size, weight, side = n[a:b].astype(np.int64), copies_[a:b], own[a:b]
            across = i[a] != j[a]
            found, at, spread = np.unique(np.concatenate(grams[a:b]), return_inverse=True, return_counts=True)
            lengths = np.array([len(g) for g in grams[a:b]])
            holders = np.repeat(np.arange(b - a), lengths)[np.argsort(at, kind="stable")]  # by n-gram
            starts = np.cumsum(spread) - spread
            ends = np.cumsum(lengths)
            for x in range(b - a):
                held = at[ends[x] - lengths[x] : ends[x]]
                overlap = np.zeros(b - a, np.int64)
                for lo in range(0, len(held), 512):
                    some = held[lo : lo + 512]
                    many = spread[some]
                    place = np.repeat(starts[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    overlap += np.bincount(holders[place], minlength=b - a)
                linked = 7 * overlap >= 3 * (size[x] + size)
                linked[x] = False
                if across:
                    linked &= side != side[x]
                links[a + x], doc_links[a + x] = linked.sum(), weight[linked].sum()
        return pa.table([pa.array(c), pa.array(links), pa.array(doc_links)], names=COUNTED.names)

    return dealt.select("part", "key", "c", "n", "copies", "own", "segments").groupBy("part").applyInArrow(run, COUNTED).groupBy("c").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))


def _linked(docs: DataFrame, size: int, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sets, classes): every row's set, and every class with the least doc_id
    that holds it, its component, the component's root and, if they are counted, its
    links to other classes (links) and their rows with its other own ones (doc_links)."""
    sets = stored(document_sets(docs, size))
    classes = stored(sets.where("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")))
    n, total, copies = classes.agg(F.count("*"), F.sum("n"), F.sum("copies")).first()
    if n > 1:
        parts = max(1, math.ceil(total / FRAGMENT_GRAMS))
        often = classes.where(F.col("copies") > max(1, copies / HOT_CLASSES)).select("class", "rep").collect()  # fewer than HOT_CLASSES rows
        fragments = to_fragments(docs, parts, size, hot_grams(sets), {r["class"]: r["rep"] for r in often})
        members = stored(linkable(shared_grams(fragments, parts)))
        _, labels = class_links(members)
        if labels is not None:
            rooted = classes.join(labels, F.col("class") == F.col("node"))
            roots = rooted.groupBy("root").agg(F.min("rep").alias("component"))
            counted = link_counts(members, labels, classes.select("class", "copies")) if count else None
            classes = classes.join(labels, F.col("class") == F.col("node"), "left").drop("node").join(roots, "root", "left").select("class", "rep", "copies", F.coalesce("root", "class").alias("root"), F.coalesce("component", "rep").alias("component"))
            if count:
                classes = classes.join(counted, F.col("class") == F.col("c"), "left").drop("c")
    if "component" not in classes.columns:
        classes = classes.select("class", "rep", "copies", F.col("class").alias("root"), F.col("rep").alias("component"))
    none = F.lit(0).cast("long")
    of = lambda c: F.coalesce(c, none) if c in classes.columns else none
    return sets, classes.select("class", "rep", "root", "component", of("links").alias("links"), (of("doc_links") + F.col("copies") - 1).alias("doc_links"))


def link_documents(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Every document with n_shingles, component_id (the least doc_id that links
    reach), class_id (of equal sets: their least doc_id), class_links (the other
    classes that its own links with) and doc_links (the rows that it links with, copies
    included); both are 0 for a row without a doc_id."""
    sets, classes = _linked(docs, size, count=True)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    joined = sets.select("doc_id", "n_shingles", "class").join(classes, "class", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce(own, F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"), F.coalesce(own, F.when(F.col("doc_id").isNotNull(), F.col("rep"))).alias("class_id"), *[F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col(c)).otherwise(0).alias(name) for c, name in (("links", "class_links"), ("doc_links", "doc_links"))])


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near duplicates only, of the least
    doc_id; rows without a doc_id and different texts without a shingle stay, and
    so do texts of one doc_id that don't link."""
    sets, classes = _linked(docs, size)
    rows = sets.where("doc_id is not null").join(classes.select("class", "root", "component"), "class", "left").where("n_shingles = 0 or doc_id = component")
    group = F.when(F.col("n_shingles") == 0, F.col("sig")).otherwise(F.col("root"))
    kept = rows.groupBy(F.col("doc_id").alias("__kept"), F.col("n_shingles") == 0, group).agg(F.min(F.struct("class", "sig"))["sig"].alias("__kept_sig")).select("__kept", "__kept_sig")
    keyed = docs.where("doc_id is not null").withColumn("__sig", F.xxhash64("text"))
    same = (F.col("doc_id").cast("long") == F.col("__kept")) & (F.col("__sig") == F.col("__kept_sig"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__sig"]).drop("__sig").unionByName(docs.where("doc_id is null"))
