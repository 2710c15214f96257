"""Exact nearest neighbours by the angle between vectors, pruned by pivots.

``PIVOTS`` targets at most (those with the smallest id hashes; a bounded sample that decides speed, never results) are pivots, and
every target belongs to the cell of the pivot it lies nearest to. Angles obey the triangle inequality: with the angle
``a`` from a query to a pivot, no target of a cell whose angles to the pivot lie between ``low`` and ``high`` is nearer to the query
than ``max(a - high, low - a)``. A query meets its own cell first; what it finds there, or the threshold, is the bound for
the second round, in which it visits those cells alone that may still hold something as near.

A cell and its visitors are cut into slices of ``SLICE`` rows and meet slice by slice in groups, so no task holds more than two slices,
however large a cell is. Of equal vectors the two smallest ids are targets: no other can be anybody's nearest.

Defined cases: null vectors, vectors with null or NaN places, without length, or of another size than the pivots' are like none;
ties go to the smaller target id; an id is never its own neighbour; repeated rows of an id are one target, and queries of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwright.functions.storage import kept

#: Pivots at most, targets a pivot stands for, rows of a slice.
PIVOTS, CELL, SLICE = 256, 2000, 4000
#: What angles and similarities may err.
ANGLE_ERROR, LIKENESS_ERROR = 1e-6, 1e-8


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with a vector that has a direction."""
    v = F.col("v")
    own = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m.reshape(0, 0)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def may_hold(angles: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells (columns) may hold something as like a query (rows) as its bound. angles: from queries to pivots; low, high: of each cell."""
    likest = np.cos(np.clip(np.maximum(angles - high, low - angles) - ANGLE_ERROR, 0, np.pi)) + LIKENESS_ERROR
    return likest >= bound[:, None]


def nearest(queries: DataFrame, targets: DataFrame, threshold: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL, slice_rows: int = SLICE) -> DataFrame:
    """(id, target, similarity) of each query's most similar other target at or above the threshold."""
    q, every = _vectors(queries, id_col, vector_col), _vectors(targets, id_col, vector_col)
    sample = every.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, -(-every.count() // cell_rows)))).collect()
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    t = every.withColumn("k", F.dense_rank().over(first)).where("k <= 2").drop("k").dropDuplicates(["id", "v"])
    kind, target_kind = q.schema["id"].dataType.simpleString(), t.schema["id"].dataType.simpleString()
    if not sample:
        return q.select(F.col("id").alias(id_col), F.col("id").cast(target_kind).alias("target"), F.lit(0.0).alias("similarity")).limit(0)
    size = max(len(r["v"]) for r in sample)
    pivots = _unit(pd.Series([r["v"] for r in sample if len(r["v"]) == size]))

    def placed(frames):
        for frame in frames:
            unit = _unit(frame["v"])
            angles = _angles(unit, pivots)
            cell = angles.argmin(1)
            yield frame.assign(v=list(unit), cell=cell, angle=angles[np.arange(len(cell)), cell])

    fits = F.size("v") == size
    t = kept(t.where(fits).mapInPandas(placed, f"id {target_kind}, v array<double>, cell long, angle double"))
    cells = {r["cell"]: (r["n"], r["low"], r["high"]) for r in t.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    held = np.array([c in cells for c in range(len(pivots))])
    low, high = (np.array([cells[c][k] if c in cells else 0.0 for c in range(len(pivots))]) for k in (1, 2))
    q = q.where(fits).withColumn("row", F.monotonically_increasing_id()).mapInPandas(placed, f"id {kind}, v array<double>, row long, cell long, angle double")
    if len(pivots) > 1:
        q = kept(q)

    schema = f"row long, id {kind}, target {target_kind}, s double"

    def meet(visits: DataFrame) -> DataFrame:
        """The best target of each visit (row, id, v, cell, bound) in its cell."""
        visitors = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        many = lambda rows: F.element_at(F.create_map(*[F.lit(x) for c in range(len(pivots)) for x in (c, max(1, -(-rows.get(c, 0) // slice_rows)))]), F.col("cell").cast("int"))
        t_parts, q_parts = many({c: x[0] for c, x in cells.items()}), many(visitors)
        slot = lambda x, parts: F.pmod(F.xxhash64(x), parts).cast("int")
        all_of = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        left = visits.withColumn("qs", slot("row", q_parts)).withColumn("ts", all_of(t_parts))
        right = t.where(F.col("cell").isin(list(visitors))).withColumn("ts", slot("id", t_parts)).withColumn("qs", all_of(q_parts))
        keys = ["cell", "ts", "qs"]

        def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            nothing = pd.DataFrame({"row": [], "id": [], "target": [], "s": []})
            if not len(mine) or not len(theirs):
                return nothing
            theirs = theirs.sort_values("id", kind="stable")  # of equals the first is the smallest
            unit = np.array(mine["v"].tolist())
            # the ring around the pivot that some visitor may have to look at
            a, reach = _angles(unit, pivots[int(mine["cell"].iloc[0])][None, :])[:, 0], np.arccos(np.clip(mine["bound"].to_numpy() - LIKENESS_ERROR, -1, 1)) + ANGLE_ERROR
            theirs = theirs[(theirs["angle"] >= (a - reach).min()) & (theirs["angle"] <= (a + reach).max())]
            if not len(theirs):
                return nothing
            likeness = np.round(unit @ np.array(theirs["v"].tolist()).T, 9)
            ids = theirs["id"].to_numpy()
            likeness[mine["id"].to_numpy()[:, None] == ids[None, :]] = -2
            at = likeness.argmax(1)
            found = pd.DataFrame({"row": mine["row"].to_numpy(), "id": mine["id"].to_numpy(), "target": ids[at], "s": likeness[np.arange(len(at)), at]})
            return found[found["s"] >= np.maximum(threshold, mine["bound"].to_numpy() - LIKENESS_ERROR)]

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)

    def best_of(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.min_by(F.struct("id", "target", "s"), F.struct(-F.col("s"), "target")).alias("b")).select("row", "b.*")

    def told(best: DataFrame) -> DataFrame:
        return best.select(F.col("id").alias(id_col), "target", F.round("s", 5).alias("similarity"))

    own = best_of(meet(q.withColumn("bound", F.lit(float(threshold)))))
    if len(pivots) == 1:
        return told(own)
    own = kept(own)

    def visiting(frames):
        for frame in frames:
            unit = np.array(frame["v"].tolist()).reshape(len(frame), -1)
            if not len(frame):
                continue
            angles = _angles(unit, pivots)
            bound = frame["s"].fillna(threshold).to_numpy()
            may = held[None, :] & may_hold(angles, low, high, bound)
            may[np.arange(len(frame)), frame["cell"].to_numpy()] = False
            row, cell = np.nonzero(may)
            yield pd.DataFrame({"row": frame["row"].to_numpy()[row], "id": frame["id"].to_numpy()[row], "v": [unit[i] for i in row], "cell": cell, "bound": bound[row]})

    more = q.join(own.select("row", "s"), "row", "left").mapInPandas(visiting, f"row long, id {kind}, v array<double>, cell long, bound double")
    return told(best_of(own.unionByName(meet(kept(more)))))
