"""Ranked lexical search, reversed: the documents stream past an index of the queries."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.terms import alphabet, pieces
from flowlens.session import materialize

#: Bytes of terms, with repeats over its items, that a broadcast index may hold; further items go into further indexes.
INDEX_BYTES = 16 << 20
#: Items of one index, which bounds the heaps of a task.
INDEX_ITEMS = 20_000
#: Groups in which the heaps of all tasks are merged first.
MERGES = 64
#: Ids of documents without one, behind all others among equal scores.
LAST = (1 << 63) - 1


def _counted(terms_of):
    """Per task: documents with terms (id -1), their terms (-2), and documents by wanted term."""
    def run(batches):
        table, wanted = alphabet(digits=True), terms_of.value
        docs, words, df = 0, 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                n, seen = 0, set()
                for terms in pieces(text.as_py(), table):
                    n += len(terms)
                    seen.update(terms)
                docs, words = docs + (n > 0), words + n
                df.update(wanted[t] for t in seen if t in wanted)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *df], pa.int64()), pa.array([docs, words, *df.values()], pa.int64())],
                                         names=["id", "n"])
    return run


class Index:
    """Inverted index over the terms of items: postings of each term, and its weight."""

    def __init__(self, terms: dict[bytes, int], postings: list[list[int]], weights: list[int], items: int):
        self.terms, self.items = terms, items
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in postings], dtype=np.int64)])
        self.postings = np.array([i for p in postings for i in p], dtype=np.int64)
        self.weights = np.array(weights, dtype=np.int64)

    def scores(self, found: list[int], tf: list[int], m: int) -> np.ndarray:
        """Score of every item for a document with these terms; integers throughout."""
        ids, tf = np.array(found, np.int64), np.array(tf, np.int64)
        gain = self.weights[ids] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        starts, sizes = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        offsets = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(offsets - starts, sizes)
        out = np.zeros(self.items, np.int64)
        np.add.at(out, self.postings[at], np.repeat(gain, sizes))
        return out


class Heaps:
    """The ``top`` best documents of each item; equal scores keep the smaller id."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # scores below cannot enter

    def offer(self, scores: np.ndarray, doc: int) -> None:
        for item in np.flatnonzero(scores >= self.least):
            heap, entry = self.heaps[item], (int(scores[item]), -doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        rows = [(i, score, -doc) for i, heap in enumerate(self.heaps) for score, doc in heap]
        item, score, doc = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, score, doc)], names=["item", "score", "doc"])


def _streamed(shared, docs: int, words: int, top: int):
    def run(batches):
        table, index = alphabet(digits=True), shared.value
        heaps = Heaps(index.items, top)
        for batch in batches:
            for doc, text in zip(batch.column(1).to_pylist(), batch.column(0)):
                n, found = 0, Counter()
                for terms in pieces(text.as_py(), table):
                    n += len(terms)
                    found.update(terms)
                known = found.keys() & index.terms.keys()
                if known:
                    scores = index.scores([index.terms[t] for t in known], [found[t] for t in known], 100 - 90 + 90 * n * docs // words)
                    heaps.offer(scores, LAST if doc is None else doc)
        yield heaps.batch()
    return run


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items (id, terms) in lists that keep to the bounds; the driver holds one list at a time. A larger item is a list of its own."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = sum(map(len, row["terms"]))
        if block and (held + size > INDEX_BYTES or len(block) == INDEX_ITEMS):
            yield block
            block, held = [], 0
        block.append(row)
        held += size
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` best documents of every item: (item_id, rank, doc_id, score).

    Terms are runs of letters, digits and characters beyond ASCII, A-Z
    lowered. The score sums rarity times saturated frequency over an item's
    distinct terms, with document length as a brake; all but the logarithm of
    the rarity is done in integers.

    1. The items' terms form an inverted index of at most `INDEX_BYTES` bytes
       and `INDEX_ITEMS` items, which bounds what is broadcast; more items
       make further indexes, each a pass of its own over the texts.
    2. One pass counts documents, words and the documents of indexed terms.
    3. One pass streams every document's term counts through the index and
       updates one bounded heap per item. A task returns its heaps only.
    4. Heaps are merged in `MERGES` groups, then per item.

    NULL and empty texts hold no terms, count as no documents and are never
    found; items without terms find nothing. Rows that repeat an item's id are
    one item with all their terms; a NULL id is an item too. Every row of
    ``docs`` is a document, also when it repeats an id. Equal scores go by
    ascending id, rows without an id last. Empty tables give no rows; other
    columns are not read. Texts are split a megabyte at a time.
    """
    spark = docs.sparkSession
    shape = "item_id long, rank int, doc_id long, score long"
    texts = docs.select(docs[text_col].cast("string").cast("binary").alias("text"), docs[id_col].cast("long").alias("doc"))
    wanted = materialize(_items(items, item_col, item_text_col))
    results = []
    for block in _blocks(wanted):
        known = {t: i for i, t in enumerate(sorted({t for row in block for t in row["terms"]}))}
        postings = [[] for _ in known]
        for at, row in enumerate(block):
            for t in row["terms"]:
                postings[known[t]].append(at)
        shared = spark.sparkContext.broadcast(known)
        counts = dict(texts.select("text").mapInArrow(_counted(shared), "id long, n long").groupBy("id").agg(F.sum("n")).collect())
        docs_n, words = counts.get(-1, 0), counts.get(-2, 0)
        if not words:
            break
        weights = [math.floor(1000 * math.log((2 * docs_n + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(known))]
        index = spark.sparkContext.broadcast(Index(known, postings, weights, len(block)))
        heaps = texts.mapInArrow(_streamed(index, docs_n, words, top), "item long, score long, doc long")
        names = spark.createDataFrame([(at, row["item_id"]) for at, row in enumerate(block)], "item long, item_id long")
        results.append(materialize(_merged(heaps, top).join(F.broadcast(names), "item").select(
            "item_id", "rank", F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "score")))
    out = spark.createDataFrame([], shape)
    for more in results:
        out = out.unionByName(more)
    return out


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has any."""
    table = alphabet(digits=True)

    def split(batches):
        for batch in batches:
            terms = [sorted({t for some in pieces(x.as_py(), table) for t in some}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    found = items.select(items[item_col].cast("long").alias("item_id"), items[text_col].cast("string").cast("binary").alias("text")) \
        .mapInArrow(split, "item_id long, terms array<binary>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def _merged(heaps: DataFrame, top: int) -> DataFrame:
    def best(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    dealt = heaps.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    return best(best(dealt, "item", "part").drop("rank"), "item")
