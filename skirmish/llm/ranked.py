"""Ranked lexical search by a dual tree: the best documents of every item, exactly.

A document's row for term t is s = (10^9 tf) div (1000 tf + 12 m), an item's is
q w (w from the term's document frequency, q its occurrences in the item); their
product summed over the terms is the score.  Items form a tree by repeated halving
along their main direction; the documents of a batch form one as well, sorted so
that documents with the same heaviest term lie side by side.  A node of either tree
holds the maximum of every coordinate over its members, so the product of two nodes'
maxima bounds the score of every pair below them.  A pair of nodes is left as soon as
this bound lies under the weakest kth score of the node's items; else the item node is
opened, then the document node, the better child first, and leaves are scored outright.

Steps: one pass over the texts keeps of each document its length and its
occurrences of the items' terms, as a stored table; document frequencies and the
totals come from that table; first the best of a sample of documents give every
item a kth score that the true one can't be below (this only saves work); then
every task searches its documents with its own trees and gives at most k rows an
item, and the best of those are ranked.

Items are a stated query set.  They are taken in blocks of about BLOCK_ITEMS items and
BLOCK_TERMS term occurrences, so what goes to the tasks is bounded; each block is held
against all documents.

Cases: a null text, or one without a term, has no terms and is no document for N;
an item without terms has no results; rows that repeat are documents of their own
and each is ranked, of equal scores the lower doc_id first, one without doc_id
last; equal rows (item_id and text) of items count once, different texts of one
item_id are ranked each by itself; very long texts are read whole; empty tables give
an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

TOP = 20
#: Items, and their term occurrences, that are searched at once.
BLOCK_ITEMS, BLOCK_TERMS = 500, 20_000
#: Documents of one tree, of its inner nodes and of its leaves; items of a leaf.
BATCH, INNER, LEAF, ITEM_LEAF = 2048, 256, 32, 8
#: A document in this many is scored first, for lower bounds only.
SEED_EVERY = 64
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> Counter:
    """Occurrences of every term of a text."""
    if not text:
        return Counter()
    out: Counter = Counter()
    for term, n in Counter(_TERM.findall(text)).items():  # lower-cased once a distinct term
        out[term.translate(_LOWER) if not term.isascii() else term.lower()] += n
    return out


PROFILE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("term", T.BinaryType()),
    T.StructField("tf", T.BinaryType()),
])


def profiles(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, term, tf): numbers of the vocabulary's terms in a document and
    their occurrences, as packed 32-bit numbers.  Documents without terms are left
    out."""
    small_batches(docs.sparkSession)

    def run(batches):
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            out = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                if found:
                    own = sorted((number[t], tf) for t, tf in found.items() if t in number)
                    at = np.array(own, np.uint32).reshape(-1, 2)
                    for column, x in zip(out, (doc, found.total(), at[:, 0].tobytes(), at[:, 1].tobytes()), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=PROFILE.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def document_frequencies(profile: DataFrame, size: int) -> np.ndarray:
    """df of each of the vocabulary's terms; counted in the tasks."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for term in batch.column(0).to_pylist():
                df[np.frombuffer(term, "<u4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["t", "n"])

    df = np.zeros(size, np.int64)
    for t, n in profile.select("term").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n")).collect():  # a row a term of the block at most
        df[t] = n
    return df


def term_weight(n: int, df: int) -> int:
    """0 or more, as df is n at most; so maxima give bounds."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Items:
    """Items as rows over the vocabulary, and the nodes of their tree."""

    weights: np.ndarray  # items x terms: occurrences times weight
    nodes: list[tuple[np.ndarray, int, int]]  # (items, left, right); -1, -1 for a leaf
    maxima: np.ndarray  # nodes x terms


def halve(rows: np.ndarray) -> np.ndarray:
    """Order of rows along their main direction."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    unit = unit - unit.mean(0)
    v = unit[np.argmax((unit * unit).sum(1))]
    for _ in range(8):
        v = unit.T @ (unit @ v)
        v = v / max(float(np.linalg.norm(v)), 1e-12)
    return np.argsort(np.round(unit @ v, 9), kind="stable")


def item_tree(weights: np.ndarray) -> Items:
    nodes: list[tuple[np.ndarray, int, int]] = []

    def grow(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append((members, -1, -1))
        if len(members) > ITEM_LEAF:
            order = members[halve(weights[members].astype(float))]
            nodes[at] = (members, grow(order[: len(order) // 2]), grow(order[len(order) // 2 :]))
        return at

    if len(weights):
        grow(np.arange(len(weights)))
    maxima = np.array([weights[m].max(0) for m, _, _ in nodes]).reshape(len(nodes), weights.shape[1])
    return Items(weights, nodes, maxima)


class Best:
    """The k best documents of every item so far; least: a score that the kth of all
    documents reaches in any case."""

    def __init__(self, items: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.least = np.ones(items, np.int64) if least is None else np.maximum(least, 1)
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.docs = [np.zeros(0, np.int64) for _ in range(items)]

    def kth(self) -> np.ndarray:
        """What a score must reach to matter."""
        return np.array([max(s[-1] if len(s) == self.k else 0, low) for s, low in zip(self.scores, self.least)], np.int64)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = np.concatenate([self.scores[item], scores]), np.concatenate([self.docs[item], docs])
        order = np.lexsort((d, -s))[: self.k]
        self.scores[item], self.docs[item] = s[order], d[order]


def impacts(n: np.ndarray, at: np.ndarray, tf: np.ndarray, total: int, length: int) -> np.ndarray:
    """s of every (document, term): at gives each one's document."""
    m = 75 + (25 * n * total) // max(length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])


def search_batch(items: Items, best: Best, docs: np.ndarray, at: np.ndarray, term: np.ndarray, s: np.ndarray, rarity: np.ndarray) -> int:
    """Hold a batch of documents against all items; at, term and s: the entries
    (document, term, impact), sorted by document.  Returns the pairs scored."""
    if not len(docs) or not len(at) or not items.nodes:
        return 0
    # Side by side what shares its heaviest term; documents without entries can't score.
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    owner = at[starts]
    heavy = s * rarity[term]
    top = np.maximum.reduceat(heavy, starts)
    first = np.full(len(docs), -1, np.int64)
    winners = np.flatnonzero(heavy == np.repeat(top, np.diff(np.r_[starts, len(at)])))
    first[at[winners[::-1]]] = term[winners[::-1]]
    order = owner[np.lexsort((docs[owner], first[owner]))]
    place = np.full(len(docs), -1, np.int64)
    place[order] = np.arange(len(order))
    row = place[at]
    # Maxima of leaves, inner nodes and the whole: the document tree from below.
    width = items.weights.shape[1]
    leaves = -(-len(order) // LEAF)
    maxima = np.zeros((leaves, width), np.int64)
    np.maximum.at(maxima, (row // LEAF, term), s)
    per = INNER // LEAF
    inner = np.array([maxima[i : i + per].max(0) for i in range(0, leaves, per)])
    levels = [inner.max(0, keepdims=True), inner, maxima]
    # Scores stay under 2^53 where doubles give the products exactly; else whole numbers.
    exact = float(items.weights.sum(1).max()) * float(s.max()) < 2.0**53
    kind = np.float64 if exact else np.int64
    bounds = [items.maxima.astype(kind) @ m.T.astype(kind) for m in levels]
    weights = items.weights.astype(kind)
    by_row = np.argsort(row, kind="stable")
    row, term, s = row[by_row], term[by_row], s[by_row]
    cut = np.searchsorted(row, np.arange(0, leaves + 1) * LEAF)
    kth, scored = best.kth(), 0
    weakest = np.array([kth[m].min() for m, _, _ in items.nodes])
    up = {child: i for i, (_, a, b) in enumerate(items.nodes) for child in (a, b) if child >= 0}

    def leaf(node: int, j: int) -> None:
        nonlocal scored
        members = items.nodes[node][0]
        lo, hi = cut[j], cut[j + 1]
        own, column = np.unique(term[lo:hi], return_inverse=True)
        rows = order[j * LEAF : (j + 1) * LEAF]
        dense = np.zeros((len(rows), len(own)), kind)
        dense[row[lo:hi] - j * LEAF, column] = s[lo:hi]
        scores = (weights[np.ix_(members, own)] @ dense.T).astype(np.int64)
        scored += scores.size
        new = False
        for i, x in zip(members, scores):
            good = x >= kth[i]
            if good.any():
                best.add(i, x[good], docs[rows[good]])
                found = best.scores[i]
                if len(found) == best.k and found[-1] > kth[i]:
                    kth[i], new = found[-1], True
        while new and node >= 0:  # the weakest kth score rises from the leaf upwards
            weakest[node] = kth[items.nodes[node][0]].min()
            node = up.get(node, -1)

    def visit(node: int, level: int, j: int) -> None:
        bound = bounds[level][node, j]
        if bound < weakest[node]:
            return
        _, left, right = items.nodes[node]
        if left >= 0:  # items are opened first, then documents
            for child in sorted((left, right), key=lambda c: -bounds[level][c, j]):
                visit(child, level, j)
        elif level < 2:
            step = (-(-leaves // per), per)[level]
            for child in sorted(range(j * step, min((j + 1) * step, len(levels[level + 1]))), key=lambda c: -bounds[level + 1][node, c]):
                visit(node, level + 1, child)
        else:
            leaf(node, j)

    visit(0, 0, 0)
    return scored


FOUND = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])


def _search(profile: DataFrame, items: Items, rarity: np.ndarray, total: int, length: int, k: int, least: np.ndarray | None = None) -> DataFrame:
    """(item, doc, score): of every task the k best documents of each item."""

    def run(batches):
        best = Best(len(items.weights), k, least)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                n = part.column(1).to_numpy()
                packed = [(np.frombuffer(t, "<u4"), np.frombuffer(f, "<u4")) for t, f in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                at = np.repeat(np.arange(len(n)), [len(t) for t, _ in packed])
                term = np.concatenate([t for t, _ in packed]).astype(np.int64)
                tf = np.concatenate([f for _, f in packed]).astype(np.int64)
                docs = np.array([NO_ID if d is None else d for d in part.column(0).to_pylist()], np.int64)
                search_batch(items, best, docs, at, term, impacts(n, at, tf, total, length), rarity)
        rows = [(i, d, s) for i in range(len(items.weights)) for d, s in zip(best.docs[i].tolist(), best.scores[i].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=FOUND.names)

    return profile.mapInArrow(run, FOUND)


RANKED = T.StructType([T.StructField(c, t) for c, t in (("item_id", T.LongType()), ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))])


def _block(docs: DataFrame, items: list[tuple[int | None, str]], k: int) -> DataFrame:
    """The ranks of one block of items."""
    spark = docs.sparkSession
    wanted = [terms(text) for _, text in items]
    vocabulary = sorted({t for w in wanted for t in w})
    number = {t: i for i, t in enumerate(vocabulary)}
    profile = stored(profiles(docs, vocabulary))
    total, length = profile.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(profile, len(vocabulary))
    w = np.array([term_weight(total, int(d)) for d in df], np.int64)
    rows = np.zeros((len(items), len(vocabulary)), np.int64)
    for i, found in enumerate(wanted):
        for t, q in found.items():
            rows[i, number[t]] = q * w[number[t]]
    tree = item_tree(rows)
    sample = profile.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_EVERY)) == 0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    least = np.zeros(len(items), np.int64)
    for item, score in _search(sample, tree, w, total, length, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("item", "score").collect():  # a row an item
        least[item] = score
    found = _search(profile, tree, w, total, length, k, least)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text): the k best documents of each item
    with a score above 0, as (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    asked = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("_size", F.regexp_count("text", F.lit(_TERM.pattern)).cast("long")).where("_size > 0")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    blocks = max(-(-n // block_items), -(-size // block_terms))
    out = spark.createDataFrame([], RANKED)
    for b in range(blocks):  # a stated query set, block by block; each is sent to the tasks
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").select("item_id", "text").collect()
        if mine:
            out = out.unionByName(_block(docs, [tuple(r) for r in mine], k))
    return out
