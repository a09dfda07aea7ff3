"""Minority oversampling by borderline interpolation, with exact nearest neighbours.

Neighbours are found by cells: every point belongs to the nearest of a few pivots, and a cell knows
its number of points and the distance of its farthest one from the pivot. A query first meets the cells nearest to it
until they hold enough points; the k-th distance there is a bound. Then it meets only those other cells
that, by the triangle inequality and by the plane between two pivots, can hold a point
within the bound. Cells and their queries are cut into blocks, so a task compares a bounded
number of them; what is nearest of all blocks is merged, ties by id. Distances are summed the same way
wherever a pair meets, so results depend on neither pivots nor blocks.

Copies of one vector are merged into a single weighted point before any of this, so they
never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import portable_fraction, portable_mix, stable_hash
from ..session import cut_lineage
from .chunks import running

BUCKET = 4000  # points a task compares at once
PIVOTS = 1000  # cells at most; pivots and one row for each cell come to the driver


def distinct_points(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """One row per distinct vector: point id, counts of minority and majority copies."""
    y = F.col(label)
    return df.groupBy(F.col(vector).cast("array<double>").alias("vec")).agg(
        F.min(id_col).alias("pid"), F.count_if(y == 1).alias("n_min"), F.count_if(y != 1).alias("n_maj"))


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows, nearly exact."""
    d2 = (x ** 2).sum(1)[:, None] + (y ** 2).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d2, 0))


def block_nearest(x: np.ndarray, x_id: np.ndarray, y: np.ndarray, y_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, point numbers and squared distances of the k nearest of ``y`` to each of ``x``, ties by id, but itself."""
    rows, cols, d2 = [], [], []
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        rough = _lengths(part, y)
        rough[x_id[lo : lo + 512, None] == y_id[None, :]] = np.inf
        if len(y) > k:
            # all that may be among the k nearest once distances are exact
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
            slack = 1e-6 * (1 + np.abs(y).max() + np.abs(part).max())
            r, c = np.nonzero((rough <= bound[:, None] + slack) & np.isfinite(rough))
        else:
            r, c = np.nonzero(np.isfinite(rough))
        exact = np.empty(len(r))
        for at in range(0, len(r), 1 << 16):
            exact[at : at + (1 << 16)] = ((part[r[at : at + (1 << 16)]] - y[c[at : at + (1 << 16)]]) ** 2).sum(1)
        order = np.lexsort((y_id[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(part)))
        keep = np.arange(len(r)) - first[r] < k
        rows.append(r[keep] + lo)
        cols.append(c[keep])
        d2.append(exact[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(d2)


class Cells:
    """Pivots, and what is known of the points of each one's cell."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.between = pivots, _lengths(pivots, pivots)
        self.count, self.radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and all distances to pivots."""
        d = _lengths(x, self.pivots)
        return d.argmin(1), d

    def seeds(self, d: np.ndarray, k: int) -> np.ndarray:
        """Cells that are searched first for each row of distances: the nearest ones, until they hold more than k points."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (before <= k) & (self.count[order] > 0), axis=1)
        return out

    def reachable(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Cells that can hold a point within ``bound`` of each row."""
        own = d.argmin(1)
        nearest = d[np.arange(len(d)), own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d ** 2 - nearest[:, None] ** 2) / (2 * self.between[own])
        plane[~np.isfinite(plane)] = 0
        least = np.maximum(d - self.radius[None, :], plane)
        slack = 1e-6 * (1 + np.abs(self.pivots).max() + d)
        return (least <= bound[:, None] + slack) & (self.count > 0)[None, :]


def _rows_of(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for d in parts:
        for lo in range(0, len(d), 1000):
            piece = d.iloc[lo : lo + 1000]
            yield piece, np.stack(piece["vec"].to_numpy()).astype(float)


def _assigned(points: DataFrame, cells: Cells) -> DataFrame:
    """Add ``cell`` and ``far``, the distance to its pivot."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, x in _rows_of(parts):
            own, d = cells.own(x)
            yield piece.assign(cell=own.astype(np.int32), far=d[np.arange(len(x)), own])

    return points.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in points.dtypes) + ", cell int, far double")


def _visits(queries: DataFrame, cells: Cells, k: int, bounded: bool) -> DataFrame:
    """One row for each cell that a query has to meet: first the seeds, then, where ``bound`` is known, the others within it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece, x in _rows_of(parts):
            _, d = cells.own(x)
            meets = cells.seeds(d, k)
            if bounded:
                meets = cells.reachable(d, piece["bound"].fillna(np.inf).to_numpy()) & ~meets
            r, c = np.nonzero(meets)
            if not len(r):
                continue
            yield pd.DataFrame({"qid": piece["pid"].to_numpy()[r], "qvec": list(x[r]), "cell": c.astype(np.int32)})

    kind = dict(queries.dtypes)["pid"]
    return queries.mapInPandas(run, f"qid {kind}, qvec array<double>, cell int")


def _meet(visits: DataFrame, data: DataFrame, cells: Cells, k: int, bucket: int) -> DataFrame:
    """The k nearest within each cell of each query that meets it; blocks of queries and points of at most about ``bucket``."""
    visits = cut_lineage(visits)
    asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # one row for each cell
    blocks = [max(1, -(-int(n) // bucket)) for n in cells.count]
    asks = [max(1, -(-asked.get(c, 0) // bucket)) for c in range(len(blocks))]
    number = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cell"))
    every = lambda values: F.explode(F.sequence(F.lit(0), number(values) - 1))
    queries = visits.select("cell", F.pmod(stable_hash("qid"), number(asks)).cast("int").alias("qb"), every(blocks).alias("pb"), "qid", "qvec")
    sides = data.where(F.col("cell").isin([c for c in asked])).select(
        "cell", every(asks).alias("qb"), F.pmod(stable_hash("pid"), number(blocks)).cast("int").alias("pb"), F.col("pid").alias("oid"), F.col("vec").alias("ovec"), "n_min", "n_maj")
    keys = ["cell", "qb", "pb"]

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({c: [] for c in ("pid", "other", "d2", "n_min", "n_maj")})
        x, y = np.stack(q["qvec"].to_numpy()).astype(float), np.stack(p["ovec"].to_numpy()).astype(float)
        r, c, d2 = block_nearest(x, q["qid"].to_numpy(), y, p["oid"].to_numpy(), k)
        return pd.DataFrame({"pid": q["qid"].to_numpy()[r], "other": p["oid"].to_numpy()[c], "d2": d2, "n_min": p["n_min"].to_numpy()[c], "n_maj": p["n_maj"].to_numpy()[c]})

    kind = dict(data.dtypes)["pid"]
    return queries.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInPandas(search, f"pid {kind}, other {kind}, d2 double, n_min long, n_maj long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("pid").orderBy("d2", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(queries: DataFrame, data: DataFrame, pivots: np.ndarray, k: int, bucket: int) -> DataFrame:
    """The k nearest points of ``data`` to each query: pid, rank, other, d2, n_min, n_maj."""
    cells = Cells(pivots)
    data = cut_lineage(_assigned(data, cells))
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row for each cell
        cells.count[r["cell"]], cells.radius[r["cell"]] = r["n"], r["far"]
    first = cut_lineage(_best(_meet(_visits(queries, cells, k, False), data, cells, k, bucket), k))
    bound = first.where(F.col("rank") == k).select("pid", F.sqrt("d2").alias("bound"))
    rest = _meet(_visits(queries.join(bound, "pid", "left"), cells, k, True), data, cells, k, bucket)
    return _best(first.drop("rank").unionByName(rest), k)


def pivots_of(points: DataFrame, bucket: int = BUCKET, seed: int = 0) -> np.ndarray:
    """Vectors of points drawn by a hash, one for each ``bucket`` points and ``PIVOTS`` at most."""
    n = points.count()
    wanted = min(PIVOTS, max(1, n // bucket))
    rows = points.orderBy(stable_hash("pid", seed=seed), "pid").limit(wanted).select("vec").collect()
    return np.array([r["vec"] for r in rows], float)


def nearest(points: DataFrame, dim: int, k_all: int, k_min: int, tables: int | None = None, seed: int = 0,
            bucket: int = BUCKET) -> DataFrame:
    """For every minority point, its nearest points and nearest minority points, exactly; ties by id.

    Rows: pid, kind ('all' or 'min'), rank, other, dist, n_min, n_maj. A task compares at most about
    ``bucket`` queries with ``bucket`` points. The result depends on none of ``dim``, ``tables`` (both
    unused), ``seed`` and ``bucket``. An action: cells are counted, and bounds checkpointed. Work grows with the cells that the
    bounds leave; points spread evenly in many dimensions leave most.
    """
    points = cut_lineage(points)
    queries = points.where("n_min > 0").select("pid", "vec")
    if queries.isEmpty():
        return points.limit(0).select("pid", F.lit("all").alias("kind"), F.lit(1).alias("rank"), F.col("pid").alias("other"), F.lit(0.0).alias("dist"), "n_min", "n_maj")
    pivots = pivots_of(points, bucket, seed)
    every = _search(queries, points, pivots, k_all, bucket).withColumn("kind", F.lit("all"))
    minority = _search(queries, points.where("n_min > 0"), pivots, k_min, bucket).withColumn("kind", F.lit("min"))
    return every.unionByName(minority).select("pid", "kind", "rank", "other", F.sqrt("d2").alias("dist"), "n_min", "n_maj")


def danger_points(points: DataFrame, neighbours: DataFrame, m: int) -> DataFrame:
    """Majority rows among the m nearest of each minority point; danger when m/2 <= majority < m.

    A point's own copies come first, then the neighbours in order until m rows are counted;
    inside a merged point the majority rows are counted first.
    """
    own = points.where("n_min > 0").select("pid", F.least(F.col("n_min") - 1 + F.col("n_maj"), F.lit(m)).alias("own_n"),
                                           F.least("n_maj", F.lit(m)).alias("own_maj"), F.col("n_min").alias("copies"))
    ordered = W.partitionBy("pid").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)  # at most m rows
    near = neighbours.where("kind = 'all'").join(own, "pid").withColumn(
        "__before", F.col("own_n") + F.coalesce(F.sum(F.col("n_min") + F.col("n_maj")).over(ordered), F.lit(0)))
    room = F.greatest(F.lit(m) - F.col("__before"), F.lit(0))
    maj = near.groupBy("pid").agg(F.sum(F.least("n_maj", room)).alias("other_maj"))
    total = F.col("own_maj") + F.coalesce("other_maj", F.lit(0))
    out = own.join(maj, "pid", "left").withColumn("majority", total)
    return out.select("pid", "copies", "majority", ((F.col("majority") >= m / 2) & (F.col("majority") < m)).cast("int").alias("danger"))


def borderline_oversample(df: DataFrame, id_col: str, vector: str, label: str, dim: int, ratio: float = 0.1, m: int = 10,
                          k: int = 5, tables: int | None = None, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Synthetic minority rows so that minority / majority reaches ``ratio``.

    Rows: base, other, step, vec. Base points are the dangerous ones, weighted by their
    copies; each new vector lies on the way to one of the base's nearest minority points.
    """
    points = cut_lineage(distinct_points(df, id_col, vector, label))
    near = cut_lineage(nearest(points, dim, m, k, tables, seed, bucket))
    danger = cut_lineage(danger_points(points, near, m).where("danger = 1").withColumn("__mix", portable_mix("pid", seed)))
    size = df.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) != 1).alias("b")).first()
    need = max(int(ratio * size["b"]) - size["a"], 0)
    ranked = running(danger, [], ["__mix", "pid"], {"__cum": ("sum", F.col("copies"))})
    total = F.broadcast(danger.agg(F.sum("copies").alias("__total")))
    share = lambda c: F.floor(F.lit(float(need)) * c / F.col("__total"))
    counted = ranked.crossJoin(total).withColumn("__new", (share(F.col("__cum")) - share(F.col("__cum") - F.col("copies"))).cast("int"))
    lists = near.where("kind = 'min'").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("__near"))  # k entries
    steps = counted.where("__new > 0").join(lists, "pid").select("pid", "__near", F.explode(F.sequence(F.lit(1), F.col("__new"))).alias("step"))
    draw = portable_mix("pid", seed) * 1009 + F.col("step")
    pick = F.pmod(portable_mix(draw, seed + 1), F.size("__near")).cast("int")
    pairs = steps.select(F.col("pid").alias("base"), F.get("__near", pick)["other"].alias("other"), "step")
    vec = points.select("pid", "vec")
    joined = (pairs.join(vec.select(F.col("pid").alias("base"), F.col("vec").alias("v0")), "base")
              .join(vec.select(F.col("pid").alias("other"), F.col("vec").alias("v1")), "other"))
    u = portable_fraction(portable_mix("base", seed) * 1009 + F.col("step"), seed + 2)
    return joined.withColumn("__u", u).select("base", "other", "step", F.zip_with("v0", "v1", lambda a, c: a + F.col("__u") * (c - a)).alias("vec"))
