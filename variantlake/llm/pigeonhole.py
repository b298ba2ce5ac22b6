"""Near-duplicate vectors by a subspace pigeonhole join with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components, local_components
from .vectors import equal_classes, lengths, usable

BLOCK_SIZE = 16  # components of a block after the rotation
GRID = 2  # leading components of a block that its cells are cut along
HOME_ROWS, VISITOR_ROWS = 8192, 32768  # rows of a cell that one meeting compares with rows of its neighbourhood
SLACK = 1e-4  # added to squared-distance budgets, so rounding in single precision excludes no pair


def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def link_near(df: DataFrame, work: Workspace, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Two rows link when the cosine of their vectors, in double precision, is at least ``threshold``. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing; neither do rows with a null key, nor
    vectors of different lengths with each other. Of repeated rows (one key twice) each is returned, with the same
    values; they count as one. A key with several vectors has the links of all, and the smallest of their components.
    Extra columns are ignored; an empty table gives no rows.

    Unit vectors at cosine c are sqrt(2 - 2c) apart. After a rotation, the vector is split into blocks, each with a
    share of the squared distance in proportion to its components: a pair within the whole distance is within the
    share in at least one block. Per block, rows fall into grid cells as wide as the share's root. A cell's rows are at
    home to visitors from itself and from half of its neighbours, so each pair of neighbouring rows meets once; where
    there are many, both sides are cut into chunks and each pair of chunks meets. A meeting filters by the block's
    distance, leaves a pair to the first block that holds it, verifies it on the original vectors, and returns counts
    and local components, never pairs.
    Equal vectors are joined once, with the number of their copies.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    good = rows.filter(usable(F.col("vector")) & F.col("key").isNotNull()).distinct()
    exact = "float32" if df.schema[vector].dataType.elementType.typeName() == "float" else "float64"
    linked = None
    for size in lengths(good, "vector"):
        part = _linked(good.filter(F.size("vector") == size), size, exact, threshold, work.sub(f"length-{size}"))
        linked = part if linked is None else linked.unionByName(part)
    linked = linked.groupBy("k").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("key").join(linked, F.col("key") == F.col("k"), "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _linked(good: DataFrame, size: int, exact: str, threshold: float, work: Workspace) -> DataFrame:
    """(k, n_links, component_id) of the rows (key, vector), whose vectors have one length."""
    spark = good.sparkSession
    classes = equal_classes(good, "key", "vector", 1).drop("keys")
    sizes = good.groupBy("vector").agg(F.count("*").alias("copies"))
    classes = work.keep(classes.join(sizes, "vector").select("rep", "copies", "vector"), "classes")

    cuts = list(range(0, max(size, 1), BLOCK_SIZE))
    whole = 2 - 2 * threshold
    budgets = [whole * (min(a + BLOCK_SIZE, size) - a) / max(size, 1) + SLACK / len(cuts) for a in cuts]
    width = float(np.sqrt(max(budgets)) + 1e-4)
    turn = spark.sparkContext.broadcast(rotation(max(size, 1)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(size, 1))
            y = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn.value
            data = pa.array([v.tobytes() for v in x.astype(exact)], pa.binary())
            for n, a in enumerate(cuts):
                at = np.floor(y[:, a:a + GRID] / width).astype(np.int32)
                at = np.pad(at, ((0, 0), (0, GRID - at.shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep"), b.column("copies"), data, pa.array(np.full(len(x), n, np.int32)), *[pa.array(at[:, i]) for i in range(GRID)]],
                    names=["rep", "copies", "data", "block", *[f"c{i}" for i in range(GRID)]],
                )

    axes = [f"c{i}" for i in range(GRID)]
    spec = "rep long, copies long, data binary, block int, " + ", ".join(f"{c} int" for c in axes)
    placed = classes.mapInArrow(cells, spec)
    # Components lie between -1 and 1, so the number of cells has a bound that does not depend on the rows.
    crowd = work.keep(placed.groupBy("block", *axes).agg(F.count("*").alias("n")), "crowd")
    steps = [s for s in product((-1, 0, 1), repeat=GRID) if s <= (0,) * GRID]
    towards = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(s)]) for s in steps]))
    homes_of = [(F.col(c) - F.col(f"step.d{i}")).alias(f"h{i}") for i, c in enumerate(axes)]
    cell = [f"h{i}" for i in range(GRID)]
    visitors = crowd.withColumn("step", towards).select("block", *homes_of, "n").groupBy("block", *cell).agg(F.sum("n").alias("visitors"))
    plan = crowd.select("block", *[F.col(c).alias(h) for c, h in zip(axes, cell)], "n").join(visitors, ["block", *cell])
    plan = plan.select("block", *cell, F.ceil(F.col("n") / HOME_ROWS).alias("hcs"), F.ceil(F.col("visitors") / VISITOR_ROWS).alias("vcs"))
    plan = F.broadcast(work.keep(plan, "plan"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    slot = lambda c: F.pmod(F.xxhash64("rep", "block"), F.col(c)).cast("int")
    row = ["rep", "copies", "data"]
    hosts = placed.select("block", *[F.col(c).alias(h) for c, h in zip(axes, cell)], *row).join(plan, ["block", *cell])
    hosts = hosts.select("block", *cell, slot("hcs").alias("hc"), upto("vcs").alias("vc"), *row, F.lit(0).alias("side"))
    coming = placed.withColumn("step", towards)
    own = F.lit(True)
    for i in range(GRID):
        own = own & (F.col(f"step.d{i}") == 0)
    coming = coming.select("block", *homes_of, *row, F.when(own, 1).otherwise(2).alias("side")).join(plan, ["block", *cell])
    coming = coming.select("block", *cell, upto("hcs").alias("hc"), slot("vcs").alias("vc"), *row, "side")
    meet = ["block", *cell, "hc", "vc"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iat[0])
        group = group.sort_values(["side", "rep"])
        side, keys, copies = (group[c].to_numpy() for c in ("side", "rep", "copies"))
        x = np.frombuffer(b"".join(group["data"]), exact).reshape(len(group), -1).astype(np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = unit @ turn.value
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        if not len(a) or not len(b):
            return _NOTHING
        i, j = _within(y, a, b, cuts[block], budgets[block])
        # Rows of the home cell come as visitors too: of those, each pair once.
        once = (side[j] == 2) | (keys[i] < keys[j])
        i, j = i[once], j[once]
        for earlier in range(block):
            if not len(i):
                break
            s = slice(cuts[earlier], cuts[earlier] + BLOCK_SIZE)
            near = np.zeros(len(i), bool)
            for p in range(0, len(i), 1 << 18):
                q = slice(p, p + (1 << 18))
                # As in the earlier block's meeting: a pair belongs to the first block that finds it.
                near[q] = _squares(y[i[q], s], y[j[q], s]) <= budgets[earlier]
            i, j = i[~near], j[~near]
        if len(i):
            cos = np.concatenate([(unit[i[p:p + (1 << 18)]] * unit[j[p:p + (1 << 18)]]).sum(1) for p in range(0, len(i), 1 << 18)])
            i, j = i[cos >= threshold], j[cos >= threshold]
        if not len(i):
            return _NOTHING
        links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        names, inverse = np.unique(keys, return_inverse=True)
        root = local_components(inverse[i], inverse[j], len(names))
        found = np.flatnonzero(links)
        return pd.DataFrame({"rep": keys[found], "links": links[found].astype(np.int64), "root": names[root[inverse[found]]]})

    met = coming.unionByName(hosts).groupBy(*meet).applyInPandas(compare, "rep long, links long, root long")
    met = work.keep(met, "met")
    work.drop("crowd", "plan")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(met.select("rep", "root").distinct(), work, "rep", "root")
    per_class = (
        classes.select("rep", "copies", F.col("vector")).join(links, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return good.join(per_class, "vector").select(F.col("key").alias("k"), "n_links", "component_id")


_NOTHING = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(1)


def _within(y: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the budget in one block: products in single precision, with slack, find them, differences
    in double precision decide."""
    s = slice(start, start + BLOCK_SIZE)
    p, q = y[a, s], y[b, s]
    p4, q4 = p.astype(np.float32), q.astype(np.float32)
    q2 = (q4 * q4).sum(1)
    left, right = [], []
    for k in range(0, len(a), 128):
        part = p4[k:k + 128]
        near = part @ q4.T * -2 + q2 <= (budget + 1e-5) - (part * part).sum(1)[:, None]
        i, j = np.divmod(np.flatnonzero(near), len(b))
        ok = _squares(p[k + i], q[j]) <= budget
        left.append(a[k + i[ok]])
        right.append(b[j[ok]])
    return np.concatenate(left), np.concatenate(right)
