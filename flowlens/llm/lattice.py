"""Near-duplicate vectors: random projections decoded to E8 lattice points, verified by cosine."""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import components
from flowlens.llm.hashing import mixed, odd
from flowlens.session import materialize

#: Steps of the fixed-point numbers that are projected: products are whole numbers below 2^53, so every run and batch shape gives equal cells.
STEP = 1 << 15


@functools.lru_cache(maxsize=1)
def _nearest_vectors() -> np.ndarray:
    """The 240 shortest lattice vectors: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    point = np.rint(y)
    off = y - point
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(point.sum(1) % 2)
    point[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight numbers: the nearer of the even whole points and those shifted by a half."""
    whole, half = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1))[:, None], whole, half)


@functools.lru_cache(maxsize=8)
def _projection(dims: int, tables: int, lattices: int, scale: float) -> np.ndarray:
    return np.rint(np.random.default_rng([dims, 8]).normal(size=(tables, lattices, dims, 8)) * scale * STEP)


def cells(unit: np.ndarray, tables: int, lattices: int, probes: int, scale: float) -> np.ndarray:
    """Cells of unit vectors as 64-bit keys: (vectors, tables, 1 + probes), the own cell first, then the nearest neighbours."""
    n, dims = unit.shape
    fixed, around = np.rint(unit * STEP), _nearest_vectors()
    out = np.empty((n, tables, 1 + probes), np.uint64)
    factors = odd(8 * lattices, 3).reshape(lattices, 8)
    as_key = lambda points, which: ((2 * points).astype(np.int64).astype(np.uint64) * factors[which]).sum(1)
    steps = [as_key(around, which) for which in range(lattices)]
    for t, table in enumerate(_projection(dims, tables, lattices, scale)):
        own, gains = np.full(n, (t + 1) * 1_000_003 + dims, np.uint64), []
        for which in range(lattices):
            y = fixed @ table[which] / (STEP * STEP)
            point = decode(y)
            own = own + as_key(point, which)
            gains.append((y - point) @ around.T)
        nearest = np.argsort(-np.concatenate(gains, 1), axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + np.concatenate(steps)[nearest]
    return mixed(out).view(np.int64)


def _cleaned(batches):
    """(vec_id, key, vec): unit vectors; key and vector are NULL where a vector cannot be compared."""
    for batch in batches:
        keys, units = [], []
        for value in batch.column(1):
            x = value.as_py()
            x = None if x is None or not x or any(v is None for v in x) else np.asarray(x, np.float64)
            top = np.abs(x).max() if x is not None else 0.0
            if top > 0 and np.isfinite(top):
                x = x / top if top < 1e-100 or top > 1e100 else x
                units.append(x / np.sqrt((x * x).sum()))
                keys.append(hashlib.blake2b(units[-1].tobytes(), digest_size=16).digest())
            else:
                units.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))],
                                         names=["vec_id", "key", "vec"])


def _by_dims(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return [(rows := np.flatnonzero(sizes == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(sizes)]


def _posted(*shape):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, unit in _by_dims(batch.column(1)):
                keys = cells(unit, *shape).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[rows], keys.shape[1]))], names=["cell", "id"])
    return run


def _first_met(left: np.ndarray, right: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs meet in this cell first: in no earlier table, and in no smaller cell of the same table."""
    fresh, here = np.ones(len(left), bool), np.zeros(len(left), bool)
    for t in range(left.shape[1]):
        rows = np.flatnonzero(fresh & ~here)
        if not len(rows):
            break
        same = left[rows, t, :, None] == right[rows, t, None, :]
        met = same.any((1, 2))
        least = np.where(same, left[rows, t, :, None], np.iinfo(np.int64).max).min((1, 2))
        here[rows[met & (least == cell)]] = True
        fresh[rows[met & (least != cell)]] = False
    return here


def _compared(cosine: float, shape: tuple):
    """Links inside groups (cell, i, j) of sorted rows: per vector how many others, per group a forest of its links."""
    def links(cell, i, j, ids, blocks, times, unit):
        a, b = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        if not len(a) or not len(b):
            return None
        x, y = np.nonzero(unit[a] @ unit[b].T >= cosine)
        x, y = a[x], b[y]
        once = (ids[x] < ids[y]) if i == j else ids[x] != ids[y]
        x, y = x[once], y[once]
        if not len(x):
            return None
        used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        keys = cells(unit[used], *shape)
        px, py = place[:len(x)], place[len(x):]
        mine = np.concatenate([_first_met(keys[px[k:k + 65536]], keys[py[k:k + 65536]], cell) for k in range(0, len(px), 65536)])
        x, y, px, py = x[mine], y[mine], px[mine], py[mine]
        if not len(x):
            return None
        others = np.bincount(px, times[y], len(used)) + np.bincount(py, times[x], len(used))
        root = np.arange(len(used))
        while True:
            low = np.minimum(root[px], root[py])
            after = root.copy()
            np.minimum.at(after, px, low)
            np.minimum.at(after, py, low)
            after = after[after]
            if (after == root).all():
                break
            root = after
        some = others > 0
        return ids[used][some], ids[used][root][some], others[some].astype(np.int64)

    def run(batches):
        held: list = []

        def emit(group):
            cell, i, j = group[0][0]
            parts = [g[1] for g in group]
            found = links(cell, i, j, *(np.concatenate([p[c] for p in parts]) for c in range(4)))
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b", "others"])

        for batch in batches:
            cell, i, j, ids, blocks, times = (batch.column(c).to_numpy() for c in range(6))
            column = batch.column(6)
            dims = len(column[0])
            if len(column.flatten()) != dims * len(ids):
                raise ValueError("vectors of several lengths met in one cell")
            unit = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for low, high in itertools.pairwise([0, *change, len(ids)]):
                name = (int(cell[low]), int(i[low]), int(j[low]))
                if held and held[0][0] != name:
                    yield from emit(held)
                    held = []
                held.append((name, (ids[low:high], blocks[low:high], times[low:high], unit[low:high])))
        if held:
            yield from emit(held)
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, tables: int = 12,
                 lattices: int = 2, probes: int = 4, scale: float = 0.55, block: int = 512) -> DataFrame:
    """Links between vectors of cosine ``cosine`` or more, in double precision.

    One row per input row: ``vec_id``, ``n_links`` (other vectors linked
    directly), ``component_id`` (smallest id that links reach), ``kept``.

    1. Equal unit vectors are one class with a count; only classes go on.
    2. In each table a class is projected to ``lattices`` times eight numbers
       and decoded to as many E8 points: its cell. It is also posted to the
       ``probes`` nearest neighbouring cells. Postings are 16 bytes; cells
       with one posting are dropped before any vector moves.
    3. Vectors of a cell meet in blocks of about ``block``: a crowded cell
       becomes many small tasks, one for each pair of blocks, and none holds
       the cell. A task multiplies two blocks and keeps what reaches the
       cosine. A pair that meets in several cells counts in its first, which
       both vectors' cells tell, so no pair is ever written: tasks give counts
       and a forest of their links.

    Recall at a cosine of exactly 0.9 is above 0.98 by simulation, and near 1
    from 0.95 on; no pair below ``cosine`` is linked. Random vectors meet with
    a probability of about 1e-4 for each table; beyond some 10^8 vectors a
    third lattice and more tables keep the work near linear. Work within a
    group of near copies grows with the square of the group, as links are
    counted exactly.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components
    link with nothing, as do rows with a NULL id, whose component is NULL and
    which are not kept. Vectors of different lengths never link. Rows that
    repeat an id count as one vector for ids and as several in ``n_links``.
    Other columns are not read.
    """
    shape = (tables, lattices, probes, scale)
    rows = materialize(vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vec"))
                       .mapInArrow(_cleaned, "vec_id long, key binary, vec array<double>"))
    classes = materialize(rows.where("key is not null and vec_id is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("vec").alias("vec")))
    postings = materialize(classes.select("id", "vec").mapInArrow(_posted(*shape), "cell long, id long"))
    crowd = postings.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    places = postings.join(crowd, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    meets = places.join(classes.select("id", "times", "vec"), "id") \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "times", "vec")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(meets.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
                        .mapInArrow(_compared(cosine, shape), "a long, b long, others long"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("others").alias("others"))
    reached = components(found.select("a", "b"))
    named = classes.select("key", "id", "times").join(counts, "id", "left") \
        .join(reached.withColumnRenamed("node", "id"), "id", "left") \
        .select("key", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
    whole = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
