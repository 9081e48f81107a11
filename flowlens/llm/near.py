"""Near-duplicate documents by bottom-k sketches of their shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import hashing
from flowlens.llm.common import components
from flowlens.session import materialize, release

#: Bitmaps of 32,768 bits each that `_perhaps` broadcasts at most: 4 MB in all.
BITMAPS = 1024


def _sketched(shingle: int, k: int):
    def run(batches):
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for words in hashing.each_text(batch.column(1)):
                found = hashing.shingle_hashes(words, shingle)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                sketches.append(found[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), hashing.lists(sketches, pa.int64())],
                names=["doc_id", "part", "n", "key", "sketch"])
    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            found = [hashing.shingle_hashes(words, shingle) for words in hashing.each_text(batch.column(1))]
            low = 0
            while low < len(found):  # a batch of sets can be larger than its texts
                high, held = low, 0
                while high < len(found) and held < hashing.CHUNK:
                    held, high = held + 8 * len(found[high]), high + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), hashing.lists(found[low:high], pa.int64())],
                                                 names=["id", "all"])
                low = high
    return run


def _shared(percent: int, k: int) -> tuple[float, float]:
    """Least part of a sketch that a linked document's sketch shares: for sets that the sketch holds whole, and for larger ones.

    A set of at most k values that meets a larger one shares at least
    k - (1 - t) k / t of them. Between two larger sets the shared part of the
    k smallest values of the union has mean t and deviation sqrt(t (1 - t) / k);
    six deviations are allowed (one link in a thousand million is lost).
    """
    t = percent / 100
    return max(0.0, (2 * t - 1) / t), max(0.0, t - 6 * math.sqrt(t * (1 - t) / k))


def _prefixes(sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """Inverted lists (value, id, n, core): of each sketch only the values that a link must touch.

    Two sketches that share s values both hold one of them among their first
    |sketch| - s + 1, in any order that is the same for all. Ordered by how
    many sketches hold a value, the common values of widespread passages come
    last and mostly stay out. Values of one sketch alone make no pair. ``core``
    is the mean number of sketches that hold the class's values: high for the
    text that others were copied from.
    """
    small, large = _shared(percent, k)
    values = sketches.select("id", "n", F.explode("sketch").alias("value"))
    held = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = values.join(held, "value").groupBy("id").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("c"))
    length = F.least(F.col("n"), F.lit(k))
    share = F.when(F.col("n") <= k, F.lit(small)).otherwise(F.lit(large))
    alone = length - F.size("c")
    keep = F.greatest(length - F.ceil(length * share - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    core = F.aggregate("c", F.lit(0).cast("bigint"), lambda total, x: total + x["df"]) / length
    lists = common.select("id", "n", core.alias("core"), F.explode(F.slice("c", F.lit(1), keep)).alias("x")).select("x.value", "id", "n", "core")
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return lists.join(sizes, "value")


def _to_hubs(lists: DataFrame, percent: int, turn: int, about: int = 4) -> DataFrame:
    """Pairs (a, b) of each class with a hub, the one with the highest core, where they are in different components.

    In turn 0 a list has one hub; in later turns it falls into random groups
    of about four, each with its own.
    """
    group = F.lit(0) if turn == 0 else F.pmod(F.xxhash64("id", "value", F.lit(turn)), F.ceil(F.col("size") / about)).cast("int")
    dealt = lists.withColumn("group", group)
    hubs = dealt.groupBy("value", "group").agg(F.max(F.struct("core", (-F.col("id")).alias("name"), "n", "c")).alias("hub"))
    met = dealt.join(hubs, ["value", "group"]).where(
        (F.col("c") != F.col("hub.c")) & _close(F.col("n"), F.col("hub.n"), percent)).withColumn("name", -F.col("hub.name"))
    return met.select(F.least("id", "name").alias("a"), F.greatest("id", "name").alias("b")).distinct()


def _close(a: Column, b: Column, percent: int) -> Column:
    """A link needs sizes in this proportion."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _full_lists(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lists like `_prefixes`, over the full sets of some classes (id, n, c): no allowance for sampling is needed.

    The rarest part of a set, 1 - t of its shingles, is mostly its own even in
    a large group of copies of one text that differ too much to be links.
    ``rest`` is the number of the set's shared shingles from the value on.
    """
    values = classes.join(sets, "id").select("id", "n", "c", F.explode("all").alias("value"))
    held = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = values.join(held, "value").groupBy("id").agg(
        F.first("n").alias("n"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    alone = F.col("n") - F.size("v")
    keep = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(percent / 100) - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    lists = common.select("id", "n", "c", F.size("v").alias("size"), F.posexplode(F.slice("v", F.lit(1), keep)).alias("at", "x")) \
        .select("x.value", "id", "n", "c", (F.col("size") - F.col("at")).alias("rest"))
    main = lists.groupBy("value").agg(F.max("c").alias("main"))
    return lists.join(main, "value").withColumn("out", F.col("c") != F.col("main"))


def _across(grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a list: each class outside the main one with all others.

    At the first value that two classes share, the smaller ``rest`` bounds what
    they share in all, so a link meets its need there. A class that is too deep
    in its set for a partner of its own size only meets smaller partners, and
    those must not be deep: two deep ones are never brought together.
    """
    deep = F.col("rest") * (100 + percent) < 2 * F.col("n") * percent
    outside = grouped.where("out").select("value", deep.alias("deep"), F.col("id").alias("a"), F.col("n").alias("an"),
                                          F.col("c").alias("ac"), F.col("rest").alias("ar"))
    others = grouped.withColumn("deep", F.explode(F.when(deep, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    enough = F.least("ar", "rest") * (100 + percent) >= (F.col("an") + F.col("n")) * percent
    return outside.join(others, ["value", "deep"]).where(
        (F.col("ac") != F.col("c")) & (~F.col("out") | (F.col("a") < F.col("id"))) & _close(F.col("an"), F.col("n"), percent) & enough) \
        .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) that are links: the union sketch filters, the full sets decide.

    A sketch is the first k values of its set, so one join a side serves both.
    """
    _, large = _shared(percent, k)
    sa, sb = (F.slice(c, 1, k) for c in ("fa", "fb"))
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, k)
    sketched = F.size(F.array_intersect(F.array_intersect(union, sa), sb))
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("all").alias("fa")), "a") \
        .join(sets.select(F.col("id").alias("b"), F.col("all").alias("fb")), "b")
    likely = full.where(sketched >= F.ceil(F.size(union) * F.lit(large) - 1e-9))
    shared = F.size(F.array_intersect("fa", "fb"))
    return likely.withColumn("both", shared) \
        .where(F.col("both") * 100 >= (F.size("fa") + F.size("fb") - F.col("both")) * percent).select("a", "b")


def _perhaps(rows: DataFrame, marks: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys ``marks`` may hold: all that it does, and others as seldom as its keys are few against the bits.

    Before a join by the same keys, so that rows without a partner are not
    shuffled. The bitmaps are broadcast and of one size however many marks
    there are; when they are full, every row passes.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(BITMAPS << 15))
    bits = marks.select(F.shiftright(place, 15).alias("_map"), place.bitwiseAND(32767).alias("_bit")) \
        .groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumn("_map", F.shiftright(place, 15)).withColumn("_bit", place.bitwiseAND(32767)).join(F.broadcast(bits), "_map")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.col("_bit").bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def part(text: Column) -> Column:
    """Tells the texts of a repeated id apart."""
    return F.xxhash64(text.cast("binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    k: int = 64, turns: int = 2, crowd: int = 16, parts: bool = False) -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id that links reach), ``kept`` (the document is the group's first
    by id and text hash), and with ``parts`` the text hash ``part``.

    Words are runs without white space, A-Z lowered; a set holds the distinct
    runs of ``shingle`` words, or all words as one run if there are fewer.
    Shingles are 64-bit hashes throughout.

    1. One pass hashes every text: set size, digest of the word sequence and
       sketch, the ``k`` smallest values of the set. Texts with equal word
       sequences are one class, named by a number; only classes go on.
    2. Inverted lists of sketch values (`_prefixes`) bring classes together.
    3. For some ``turns`` each class of a list meets one hub (`_to_hubs`).
       Pairs pass the size proportion, the union sketch's estimate and the
       exact Jaccard similarity of the full sets; links form components.
    4. Only classes outside a list's main component are then compared with all
       others of the list, across components. Classes of lists longer than
       ``crowd`` do so by lists over their full sets (`_full_lists`), where the
       place of a value bounds the similarity: as complete, with far fewer pairs. So a large group of near
       copies costs a few comparisons for each member, and no link between
       different components is missed.

    NULL or empty texts have no shingles and link with nothing; so do rows
    with a NULL id, which get a NULL component and are not kept. Rows that
    repeat an id and its text are one document. If an id stands on different
    texts, each is a document of its own with its own text's component; two
    groups can then have the same smallest id, one kept document each. Other columns are not read. Long texts are
    hashed whole; work per text is linear but for sorting its set.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"), part(docs[text_col]).alias("part"))
    sketched = materialize(base.mapInArrow(_sketched(shingle, k), "doc_id long, part long, n long, key binary, sketch array<long>"))
    # equal keys have equal sketches; sketches are shuffled once, and their tables go as soon as the lists are there
    sketches = materialize(sketched.where("doc_id is not null and n > 0").groupBy("key")
                           .agg(F.min(F.struct("doc_id", "part")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
                           .select("key", "first.*", F.monotonically_increasing_id().alias("id"), "n", "sketch"))
    rows = materialize(sketched.select("doc_id", "part", "n", "key"))
    release(sketched)
    classes = materialize(sketches.select("key", "doc_id", "part", "id"))
    lists = materialize(_prefixes(sketches, percent, k))
    release(sketches)
    # a written table: the planner knows its size, and texts are shuffled only where it is too large to broadcast, without those that are no suspects
    suspects = materialize(lists.select("id").distinct().join(classes, "id").select("id", "doc_id", "part"))
    sets = materialize(_perhaps(base, suspects, "doc_id", "part").join(suspects, ["doc_id", "part"]).dropDuplicates(["doc_id", "part", "id"])
                       .select("id", "text").mapInArrow(_sets(shingle), "id long, all array<long>"))
    release(suspects)

    def with_components(found: DataFrame) -> DataFrame:
        return lists.join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left") \
            .withColumn("c", F.coalesce("c", "id"))

    grouped, links = lists.withColumn("c", F.col("id")), None
    for turn in range(turns):
        more = materialize(_confirmed(_to_hubs(grouped, percent, turn), sets, percent, k))
        links = more if links is None else links.unionByName(more)
        found = components(links)
        newer = materialize(with_components(found))
        release(grouped, found)
        grouped = newer
    release(lists)
    # the component that most classes of a list are in
    table = grouped
    main = grouped.groupBy("value", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("value").agg(F.max(F.struct("m", "c")).alias("x")) \
        .select("value", F.col("x.c").alias("main"))
    grouped = grouped.join(main, "value").withColumn("out", F.col("c") != F.col("main"))
    crowded = materialize(grouped.where(F.col("size") > crowd).groupBy("value").agg(F.max("out").alias("any")).where("any")
                          .select("value").join(grouped, "value").select("id", "n", "c").distinct())
    last = _across(grouped.where(F.col("size") <= crowd).withColumn("rest", F.col("n")), percent) \
        .unionByName(_across(_full_lists(crowded, sets, percent), percent)).distinct()
    found = components(links.unionByName(materialize(_confirmed(last, sets, percent, k))))
    release(crowded, sets, table)
    members = classes.join(found, classes["id"] == found["node"]).select("key", "doc_id", "part", "component")
    roots = members.groupBy("component").agg(F.min(F.struct("doc_id", "part")).alias("root"))
    linked = members.join(roots, "component").select("key", "root")
    named = classes.join(linked, "key", "left").select("key", F.coalesce("root", F.struct("doc_id", "part")).alias("root"))
    own, root = F.struct("doc_id", "part"), F.col("root")
    return rows.select("doc_id", "part", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce(root["doc_id"], "doc_id").alias("component_id"),
        F.when(root.isNull(), F.col("doc_id").isNotNull()).otherwise(own == root).alias("kept"), *(["part"] if parts else []))
