"""Source divergence audit: how far the word use of two sources of a language lies apart, and by which terms.

Counts become shares in parts of a thousand million, and a chi-square distance
is summed over all terms that a language keeps, in integers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.terms import alphabet, pieces
from flowlens.session import materialize

#: Shares are counted in this unit, in two steps that keep products below 2^63.
HEAD, TAIL = 100_000, 10_000
#: Entries that a task gathers before it hands them on, and rows of a batch.
HELD, ROWS = 250_000, 50_000
#: Terms of a block: 2 to this power.
BLOCK_BITS = 13

PRICED = "lang string, a string, b string, ab long, ba long"


def _counted(batches):
    """(lang, source, term, n, df) summed over as many documents as fit; a term's count and its documents."""
    table, held = alphabet(digits=False), defaultdict(lambda: (Counter(), Counter()))

    def handed():
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for low in range(0, len(terms), ROWS):
                some = terms[low:low + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                     pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()),
                     pa.array([df[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            n, df = held[lang, source]
            before, seen = len(n), set()
            for terms in pieces(text.as_py(), table):
                n.update(terms)
                seen.update(terms)
            df.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from handed()
                size = 0
    yield from handed()


def share(count, total):
    """1 + floor(1,000,000,000 (count + 1) / total) of integers, exact for totals below 9 x 10^13."""
    head, rest = np.divmod((count + 1) * HEAD, total)
    return 1 + head * TAIL + rest * TAIL // total


def distance(p, q):
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def meeting(small: np.ndarray, large: np.ndarray, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that two ascending arrays share, by galloping.

    For each run of the smaller array the reach into the larger one doubles
    until it covers the run; only that window is searched.
    """
    ours, theirs, low = [], [], 0
    for at in range(0, len(small), run):
        needles = small[at:at + run]
        reach = run
        while low + reach < len(large) and large[low + reach] < needles[-1]:
            reach *= 2
        window = large[low:low + reach + 1]
        found = np.searchsorted(window, needles)
        hit = np.flatnonzero(found < len(window))
        hit = hit[window[found[hit]] == needles[hit]]
        ours.append(hit + at)
        theirs.append(found[hit] + low)
        low += int(found[-1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(ours), np.concatenate(theirs)) if ours else (none, none)


def priced(ids_a, n_a, total_a, ids_b, n_b, total_b, terms: int) -> tuple[int, int]:
    """Distance of a from b and of b from a over a block's ``terms``: shared, one-sided and absent ones."""
    if len(ids_a) > len(ids_b):
        return priced(ids_b, n_b, total_b, ids_a, n_a, total_a, terms)[::-1]
    at_a, at_b = meeting(ids_a, ids_b)
    p, q, p0, q0 = share(n_a, total_a), share(n_b, total_b), share(0, total_a), share(0, total_b)
    both_p, both_q = p[at_a], q[at_b]
    absent = terms - len(p) - len(q) + len(at_a)

    def way(f):
        return int(f(both_p, both_q).sum()) + int(f(p, q0).sum() - f(both_p, q0).sum()) \
            + int(f(p0, q).sum() - f(p0, both_q).sum()) + absent * int(f(p0, q0))

    return way(distance), way(lambda x, y: distance(y, x))


def _tasks(batches):
    """Prices of pair tasks, one row each."""
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}

        def array(name, row, columns=columns):
            return columns[name][row].values.to_numpy(zero_copy_only=False)

        ab, ba = [], []
        plain = {c: columns[c].to_pylist() for c in ("a_total", "b_total", "terms")}
        for row in range(batch.num_rows):
            x, y = priced(array("a_ids", row), array("a_n", row), plain["a_total"][row],
                          array("b_ids", row), array("b_n", row), plain["b_total"][row], plain["terms"][row])
            ab.append(x)
            ba.append(y)
        yield pa.RecordBatch.from_arrays([columns["lang"], columns["a"], columns["b"], pa.array(ab, pa.int64()), pa.array(ba, pa.int64())],
                                         names=["lang", "a", "b", "ab", "ba"])


def _share(count: Column, total: Column) -> Column:
    """`share` on columns."""
    whole, parts = (count + 1) * HEAD, F.lit(TAIL)
    div = lambda a, b: F.call_function("div", a, b)
    return 1 + div(whole, total) * parts + div((whole % total) * parts, total)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least: int = 3, ranks: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) group.

    Part ``pair``: every other source of the language, most distant first.
    Part ``term``: the ``ranks`` terms that the group holds above the
    language's share, by their distance. A language keeps the terms that
    ``least`` of its documents hold; shares are add-one smoothed over them.

    1. Tasks count terms of whole texts and hand on sums, so the shuffle holds
       one row per task, group and term, however often a term occurs.
    2. Kept terms get numbers; a block is 8,192 consecutive ones. Each group
       has per block a sorted (term number, count) array.
    3. A pair task joins the arrays of an unordered pair in a block, gallops
       through them and prices shared, one-sided and absent terms in both
       directions. Integer sums over blocks are exact in any order. No task
       holds more than two arrays of a block at a time.
    4. The best terms are limited in every task before they are ranked.

    NULL text, language and source are empty texts. Groups without kept terms
    have shares too; a language without kept terms gives value 0 to its pairs.
    Repeated rows are documents of their own. Ties go by item in UTF-8 order.
    Empty tables give no rows; other columns are not read. A language of one
    source has no pairs. Counts of a group may reach 9 x 10^13 words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), text.cast("binary").alias("text"))
    partial = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    counts = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("df").alias("df")).where(F.col("df") >= least)
                       .select("lang", "term", "everywhere", F.monotonically_increasing_id().alias("id")))
    held = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "everywhere"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("everywhere").alias("lang_n"))
    words = held.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = materialize(rows.select("lang", "source").distinct().join(langs, "lang", "left").join(words, ["lang", "source"], "left").select(
        "lang", "source", (zero("source_n") + zero("v")).alias("total"), (zero("lang_n") + zero("v")).alias("lang_total")))
    return _pairs(groups, kept, held).unionByName(_terms(groups, held, ranks)).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, kept: DataFrame, held: DataFrame) -> DataFrame:
    block = F.shiftright("id", BLOCK_BITS)
    blocks = kept.groupBy("lang", block.alias("block")).agg(F.count(F.lit(1)).alias("terms"))
    arrays = held.groupBy("lang", "source", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x"))
    none = F.array().cast("array<bigint>")
    grid = materialize(groups.join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "block", "source", "total", "terms", F.coalesce(F.col("x.id"), none).alias("ids"), F.coalesce(F.col("x.n"), none).alias("n")))
    side = lambda s: grid.select("lang", "block", F.col("source").alias(s), F.col("total").alias(f"{s}_total"),
                                 F.col("ids").alias(f"{s}_ids"), F.col("n").alias(f"{s}_n"), *(["terms"] if s == "a" else []))
    tasks = side("a").join(side("b"), ["lang", "block"]).where("a < b")
    sums = tasks.mapInArrow(_tasks, PRICED).groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    name = lambda s: groups.select("lang", F.col("source").alias(s))
    pairs = name("a").join(name("b"), "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    ways = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")),
                                                  F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("x"))
    return _ranked(ways.select("lang", "x.source", "x.item", F.coalesce("x.value", F.lit(0)).cast("long").alias("value")), "pair")


def _terms(groups: DataFrame, held: DataFrame, ranks: int) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    over = held.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"),
        _share(F.col("everywhere"), F.col("lang_total")).alias("q")).where("p > q")
    value = F.call_function("div", (p - q) * (p - q), q)
    return _ranked(over.select("lang", "source", "item", value.alias("value")), "term").where(F.col("rank") <= ranks)


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("part", F.lit(part)).withColumn("rank", F.row_number().over(order).cast("int"))
