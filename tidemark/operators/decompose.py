"""Principal components of curves, Legendre scores, and the distance of their subspaces.

A curve is a row (t, y array<double>). Only factorisations leave Catalyst: sets of rows are reduced to triangles, and rolling
windows are merged from triangles that neighbouring windows share. Operators that need a curve's length
p or the number of rows take them as arguments; where they aren't given, one small job looks them up first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.polynomial.legendre import legvander
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.curves import dot, equal_windows, hopping_windows
from tidemark.operators.ordered import numbered

COMPONENTS = "window_id int, t_start long, t_end long, k int, eigenvalue double, cpve double, loading array<double>"


def basis(p: int, degree: int, x: list[float] | None = None) -> np.ndarray:
    """Legendre polynomials P0 .. P_degree on x, or on p even points of [-1, 1]: p rows. Another number of points, or points beyond [-1, 1], raise."""
    points = np.linspace(-1.0, 1.0, p) if x is None else np.asarray(x, float)
    if points.shape != (p,):
        raise ValueError(f"{len(points)} points for curves of {p}")
    if not (np.abs(points) <= 1.0 + 1e-12).all():
        raise ValueError("points must lie in [-1, 1]")
    return legvander(points, degree)


def orthonormal_basis(p: int, k: int, x: list[float] | None = None) -> np.ndarray:
    return np.linalg.qr(basis(p, k - 1, x))[0]


def _length(curves: DataFrame, p: int | None) -> int | None:
    """p, or the length of the first curve; None without curves."""
    if p is not None:
        return p
    row = curves.select(F.size("y").alias("p")).first()
    return row and row[0]


def _centered(curves: DataFrame, center: bool, p: int | None = None) -> DataFrame:
    """(t, y, means, x): x is y less the mean curve, or y. With p a curve of another length raises."""
    y = F.col("y") if p is None else F.when(F.size("y") == p, F.col("y")).otherwise(F.raise_error(F.lit(f"a curve hasn't {p} points")).cast("array<double>"))
    zero = F.transform("y", lambda v: v * 0.0)
    return curves.crossJoin(F.broadcast(column_means(curves))).select("t", "y", (F.col("means") if center else zero).alias("means"), (F.zip_with(y, "means", lambda a, m: a - m) if center else y).alias("x"))


def basis_at(points: DataFrame, degree: int = 4, *keep: str) -> DataFrame:
    """(keep, x, degree, value) at points (keep, x) from closed forms."""
    x = F.col("x")
    forms = [F.lit(1.0), x, (3 * x * x - 1) / 2, (5 * x * x * x - 3 * x) / 2, (35 * x * x * x * x - 30 * x * x + 3) / 8, (63 * x * x * x * x * x - 70 * x * x * x + 15 * x) / 8]
    if degree >= len(forms):
        raise ValueError("closed forms go up to degree 5")
    return points.select(*keep, "x", F.posexplode(F.array(*forms[: degree + 1])).alias("degree", "value"))


def basis_table(spark: SparkSession, p: int = 101, degree: int = 4) -> DataFrame:
    """(j, x, degree, value) on p even points of [-1, 1]."""
    return basis_at(spark.range(p).select(F.col("id").cast("int").alias("j"), (F.lit(-1.0) + 2.0 * F.col("id") / (p - 1)).alias("x")), degree, "j")


def projections(curves: DataFrame, k: int, p: int | None = None) -> DataFrame:
    """(t, k, score): curves, as they are, projected on the first k orthonormal polynomials over their places."""
    p = _length(curves, p)
    if p is None:
        return curves.sparkSession.createDataFrame([], "t long, k int, score double")
    q = curves.sparkSession.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(orthonormal_basis(p, k).T)], "k int, q array<double>")
    return curves.crossJoin(F.broadcast(q)).select("t", "k", dot(F.col("y"), F.col("q")).alias("score"))


def sign_fixed(found: DataFrame) -> DataFrame:
    """Components whose loadings are turned so that the entry farthest from 0 (of equals the first) is positive."""
    size = F.transform("loading", F.abs)
    top = F.get("loading", (F.array_position(size, F.array_max(size)) - 1).cast("int"))
    return found.withColumn("loading", F.when(top < 0, F.transform("loading", lambda v: -v)).otherwise(F.col("loading")))


def _spectrum(window: int, start: int, end: int, n: int, x: np.ndarray, k: int | None) -> pd.DataFrame:
    """Rows of COMPONENTS for n centred rows x, or their triangle."""
    s, v = np.linalg.svd(x, full_matrices=False)[1:]
    eigen = s**2 / (n - 1) if n > 1 else np.full(len(s), np.nan)
    total = eigen.sum()
    share = np.cumsum(eigen) / total if total else np.full(len(s), np.nan)
    k = len(s) if k is None else min(k, len(s))
    return pd.DataFrame({"window_id": window, "t_start": start, "t_end": end, "k": range(1, k + 1), "eigenvalue": eigen[:k], "cpve": share[:k], "loading": list(v[:k])})


def components(windows: DataFrame, k: int | None = None, center: bool = True) -> DataFrame:
    """The components of each window (window_id, t, y): the first k, or all. cpve is the share of variance up to k.

    k above the rows or columns of a window raises."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = np.stack(pdf["y"].to_numpy())
        if k is not None and k > min(y.shape):
            raise ValueError(f"{k} components of {y.shape[0]} rows and {y.shape[1]} columns")
        x = y - y.mean(0) if center else y
        return _spectrum(key[0], pdf["t"].iloc[0], pdf["t"].iloc[-1], len(x), x, k)

    return windows.select(F.col("window_id").cast("int").alias("window_id"), F.col("t").cast("long").alias("t"), "y").groupBy("window_id").applyInPandas(run, COMPONENTS)


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """R of the stacked rows: the same singular values and right vectors, in at most as many rows as columns."""
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def tall_components(windows: DataFrame, k: int | None = None, center: bool = True) -> DataFrame:
    """components() for windows of any number of rows: a tall-skinny QR.

    Tasks reduce their rows of each window to a triangle, triangles are merged in 64 groups and then in one, and only
    the last triangle is decomposed. There are few windows; their means are broadcast."""
    rows = windows.select(F.col("window_id").cast("int").alias("window_id"), F.col("t").cast("long").alias("t"), "y")
    sizes = rows.groupBy("window_id").agg(F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    if center:
        cells = rows.select("window_id", F.posexplode("y").alias("j", "v")).groupBy("window_id", "j").agg(F.avg("v").alias("v"))
        means = cells.groupBy("window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("means"))
        rows = rows.join(F.broadcast(means), "window_id").select("window_id", F.zip_with("y", "means", lambda a, m: a - m).alias("y"))
    schema = "window_id int, part int, y array<double>"

    def reduce(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for window, y in pdf.groupby("window_id")["y"]:
                more = np.stack(y.to_numpy())
                held[window] = _triangle([held[window], more] if window in held else [more])
        part = TaskContext.get().partitionId() % 64
        for window, r in held.items():
            yield pd.DataFrame({"window_id": window, "part": part, "y": list(r)})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"window_id": key[0], "part": 0, "y": list(_triangle([np.stack(pdf["y"].to_numpy())]))})

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, first = int(pdf["n"].iloc[0]), pdf.iloc[0]
        r = _triangle([np.stack(pdf["y"].to_numpy())])
        if k is not None and k > min(n, r.shape[1]):
            raise ValueError(f"{k} components of {n} rows and {r.shape[1]} columns")
        return _spectrum(key[0], first["t_start"], first["t_end"], n, r, k)

    parts = rows.select("window_id", "y").mapInPandas(reduce, schema).groupBy("window_id", "part").applyInPandas(merge, schema)
    return parts.join(F.broadcast(sizes), "window_id").groupBy("window_id").applyInPandas(finish, COMPONENTS)


def pca(curves: DataFrame, k: int = 5, center: bool = True) -> DataFrame:
    """Components of all curves as one window, with id 0."""
    return tall_components(curves.withColumn("window_id", F.lit(0)), k, center)


def column_means(curves: DataFrame) -> DataFrame:
    """One row (means array<double>)."""
    cells = curves.select(F.posexplode("y").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("v"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("means"))


def scores(curves: DataFrame, found: DataFrame, center: bool = True) -> DataFrame:
    """(t, k, score): curves projected on the components of window 0."""
    load = found.filter("window_id = 0").select("k", "loading")
    return _centered(curves, center).crossJoin(F.broadcast(load)).select("t", "k", dot(F.col("x"), F.col("loading")).alias("score"))


def _fit(x: DataFrame, directions: DataFrame) -> DataFrame:
    """(t, y, fitted, residual) of (t, y, means, x): fitted is the mean curve and sum over k of (x . weight_k) direction_k. directions is one row of arrays."""
    # a score stands in an array before it is used, as a lambda's body is evaluated for every point
    scored = F.transform(F.arrays_zip("weights", "directions"), lambda w: F.struct(dot(F.col("x"), w["weights"]).alias("score"), w["directions"].alias("direction")))
    fitted = F.aggregate(scored, F.col("means"), lambda s, w: F.zip_with(s, w["direction"], lambda a, d: a + w["score"] * d))
    return x.crossJoin(F.broadcast(directions)).withColumn("fitted", fitted).select("t", "y", "fitted", F.zip_with("y", "fitted", lambda a, b: a - b).alias("residual"))


def pca_fit(curves: DataFrame, found: DataFrame, center: bool = True) -> DataFrame:
    """(t, y, fitted, residual) of every curve by the components of window 0, as arrays."""
    load = found.filter("window_id = 0").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "loading"))), lambda x: x["loading"]).alias("weights"))
    return _fit(_centered(curves, center), load.select("weights", F.col("weights").alias("directions")))


def rolling_windows(curves: DataFrame, size: int, step: int, n_rows: int | None = None) -> DataFrame:
    """Curves with window_id, by row count in the order of t. Too few rows give no window."""
    return hopping_windows(numbered(curves, "t"), curves.count() if n_rows is None else n_rows, size, step)


FACTOR = "window_id long, n long, t_start long, t_end long, mean array<double>, triangle array<double>"


def _merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray], center: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, triangle) of two sets of rows together. A triangle is that of the rows less their mean, so the distance of the means is one row more."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    n = a[0] + b[0]
    apart = b[1] - a[1]
    rows = [a[2], b[2], *([apart[None] * np.sqrt(a[0] * b[0] / n)] if center else [])]
    return n, a[1] + apart * (b[0] / n), np.linalg.qr(np.concatenate(rows), mode="r")


def _factor(y: np.ndarray, center: bool) -> tuple[int, np.ndarray, np.ndarray]:
    mean = y.mean(0)
    return len(y), mean, np.linalg.qr(y - mean if center else y, mode="r")


def rolling_components(curves: DataFrame, size: int = 400, step: int = 1, k: int | None = None, center: bool = True) -> DataFrame:
    """components() of each window of `size` rows, `step` rows apart, in the order of t. Too few rows give no window.

    No row is sent to the windows that hold it. The order is cut into runs of `size` rows, one group each; a window is the end
    of one run and the beginning of the next, and each of these is a factor (count, mean, triangle) that is built up block by
    block from the run's rows. A window's two factors are merged, and only that triangle is decomposed."""
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    rows = numbered(curves.select(F.col("t").cast("long").alias("t"), "y"), "t").withColumn("run", F.floor(F.col("rn") / size))

    def factors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        run, y, t = int(key[0]), np.stack(pdf["y"].to_numpy()), pdf["t"].to_numpy()
        n, p = y.shape
        base = run * size
        # starts of windows in this run, and in the one before, by their places there: what they share are the cuts between blocks
        own = [s - base for s in range(-(-base // step) * step, base + size, step)]
        past = [s - (base - size) for s in range(-(-max(base - size, 0) // step) * step, base, step)] if run else []
        cuts = sorted({0, n, *(o for o in own if o < n), *(o for o in past if o <= n)})
        blocks = {a: _factor(y[a:b], center) for a, b in zip(cuts, cuts[1:], strict=False)}
        none, made = (0, np.zeros(p), np.zeros((0, p))), []

        def put(window: int, f: tuple, lo: int, hi: int) -> None:
            made.append((window, f[0], t[lo], t[hi - 1], f[1], f[2].ravel()))

        held, upto = none, set(past)
        for a, b in zip(cuts, cuts[1:], strict=False):  # beginnings, for windows that start in the run before
            held = _merged(held, blocks[a], center)
            if b in upto:
                put((base - size + b) // step, held, 0, b)
        held, upto = none, set(own)
        for a, b in reversed(list(zip(cuts, cuts[1:], strict=False))):  # ends
            held = _merged(blocks[a], held, center)
            if a in upto and n == size:
                put((base + a) // step, held, a, n)
        return pd.DataFrame(made, columns=[c.split()[0] for c in FACTOR.split(", ")], dtype=None if made else object)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(r.n), r.mean, r.triangle.reshape(-1, len(r.mean))) for r in pdf.sort_values("t_start").itertuples()]
        whole = parts[0] if len(parts) == 1 else _merged(parts[0], parts[1], center)
        if whole[0] != size:  # the last rows make no whole window
            return pd.DataFrame(columns=[c.split()[0] for c in COMPONENTS.split(", ")], dtype=object)
        if k is not None and k > min(size, len(whole[1])):
            raise ValueError(f"{k} components of {size} rows and {len(whole[1])} columns")
        return _spectrum(int(key[0]), pdf["t_start"].min(), pdf["t_end"].max(), size, whole[2], k)

    parts = rows.select("run", "rn", "t", "y").groupBy("run").applyInPandas(factors, FACTOR)
    return parts.groupBy("window_id").applyInPandas(finish, COMPONENTS)


def cpve(found: DataFrame, ks: list[int]) -> DataFrame:
    """(window_id, t_start, t_end, k, cpve); a k above the number of components takes the last."""
    last = found.groupBy("window_id").agg(F.max("k").alias("last"))
    wanted = last.select("window_id", "last", F.explode(F.array(*map(F.lit, ks))).alias("want"))
    return found.join(wanted, "window_id").filter(F.col("k") == F.least("want", "last")).select("window_id", "t_start", "t_end", F.col("want").alias("k"), "cpve")


def aligned(found: DataFrame) -> DataFrame:
    """Components with each loading turned towards the one of the window before: `sign` and the turned loading.

    A window's sign is the parity of the negative raw products since the last product that is exactly 0."""
    # the window before is met by an equi-join; only the products' signs, without loadings, are ordered by component
    order = found.select("k", "window_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("window_id")))
    rows = found.join(order, ["k", "window_id"])
    before = rows.select("k", (F.col("_n") + 1).alias("_n"), F.col("loading").alias("_before"))
    raw = rows.join(before, ["k", "_n"], "left").withColumn("_dot", dot(F.col("_before"), F.col("loading"))).drop("_before")
    upto = Window.partitionBy("k").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    signs = raw.select("k", "window_id", "_dot").withColumn("_run", F.sum(F.when(F.col("_dot") == 0, 1).otherwise(0)).over(upto))
    run = Window.partitionBy("k", "_run").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    signs = signs.select("k", "window_id", F.when(F.sum(F.when(F.col("_dot") < 0, 1).otherwise(0)).over(run) % 2 == 1, -1).otherwise(1).alias("sign"))
    turned = raw.join(signs, ["k", "window_id"]).withColumn("loading", F.transform("loading", lambda x: x * F.col("sign")))
    return turned.select(*found.columns, "sign")


def compared_windows(curves: DataFrame, n: int = 4, k: int = 5, rest: str = "drop", n_rows: int | None = None) -> DataFrame:
    """Aligned components of n equal runs of rows; what is left over is dropped or goes to the last run."""
    rows = equal_windows(numbered(curves, "t"), curves.count() if n_rows is None else n_rows, n, rest)
    return aligned(tall_components(rows.withColumnRenamed("window", "window_id"), k))


def subspace_distance(overlap: Column, k: Column | int, metric: str = "projection") -> Column:
    """From the squared Frobenius norm of U'V of two orthonormal bases of k vectors."""
    if metric not in ("projection", "chordal"):
        raise ValueError("metric must be projection or chordal")
    gap = F.greatest(F.lit(0.0), k - overlap)
    return F.sqrt(gap * 2) if metric == "projection" else F.sqrt(gap)


def rolling_distance(curves: DataFrame, size: int = 720, step: int = 24, ks: tuple[int, ...] = (1, 2, 3, 4, 5), metric: str = "projection", time_index: str = "end", p: int | None = None) -> DataFrame:
    """(window_time, k, distance) between each window's first k components and the Legendre basis of degree k - 1."""
    if time_index not in ("start", "end"):
        raise ValueError("time_index must be start or end")
    spark = curves.sparkSession
    p = _length(curves, p)
    if p is None:
        return spark.createDataFrame([], "window_time long, k int, distance double")
    q = spark.createDataFrame([(k, v.tolist()) for k in ks for v in orthonormal_basis(p, k).T], "want int, direction array<double>")
    found = rolling_components(curves, size, step, max(ks)).join(F.broadcast(q), F.col("k") <= F.col("want"))
    product = dot(F.col("loading"), F.col("direction"))
    time = F.col(f"t_{time_index}").alias("window_time")
    return found.groupBy(time, F.col("want").alias("k")).agg(F.sum(product * product).alias("overlap")).select("window_time", "k", subspace_distance(F.col("overlap"), F.col("k"), metric).alias("distance"))


def legendre_weights(p: int, degree: int = 5, ridge: float = 1e-10, x: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phi, phi (phi' phi + ridge)^-1): the basis, and what turns a centred curve into its scores."""
    phi = basis(p, degree, x)
    return phi, phi @ np.linalg.inv(phi.T @ phi + ridge * np.eye(degree + 1))


def legendre_scores(curves: DataFrame, degree: int = 5, center: bool = True, ridge: float = 1e-10, kind: str = "legendre", x: list[float] | None = None, p: int | None = None) -> DataFrame:
    """(t, degree, score): least squares on the Legendre basis over the curve's places x. Only kinds that begin with "leg" exist."""
    if not kind.lower().startswith("leg"):
        raise ValueError("kind must be legendre")
    p = _length(curves, p)
    if p is None:
        return curves.sparkSession.createDataFrame([], "t long, degree int, score double")
    _, w = legendre_weights(p, degree, ridge, x)
    table = curves.sparkSession.createDataFrame([(d, w[:, d].tolist()) for d in range(degree + 1)], "degree int, w array<double>")
    return _centered(curves, center, p).crossJoin(F.broadcast(table)).select("t", "degree", dot(F.col("x"), F.col("w")).alias("score"))


def legendre_fit(curves: DataFrame, degree: int = 5, center: bool = True, ridge: float = 1e-10, x: list[float] | None = None, p: int | None = None) -> DataFrame:
    """(t, y, fitted, residual) of every curve by its Legendre scores, as arrays."""
    p = _length(curves, p)
    if p is None:
        return curves.select("t", "y", F.col("y").alias("fitted"), F.col("y").alias("residual"))
    phi, w = legendre_weights(p, degree, ridge, x)
    table = curves.sparkSession.createDataFrame([(w.T.tolist(), phi.T.tolist())], "weights array<array<double>>, directions array<array<double>>")
    return _fit(_centered(curves, center, p), table)


def score_series(degree: int = 5, p: int | None = None, **variants: DataFrame) -> DataFrame:
    """(variant, t, degree, score) of several matrices under one another."""
    out = None
    for name, curves in variants.items():
        df = legendre_scores(curves, degree, p=p).select(F.lit(name).alias("variant"), "t", "degree", "score")
        out = df if out is None else out.unionByName(df)
    return out


def score_columns(found: DataFrame, degree: int = 5, *keys: str) -> DataFrame:
    """Scores with a row for each t (and keys) and a column Legendre_deg<j> for each degree."""
    return found.groupBy(*keys, "t").agg(*(F.max(F.when(F.col("degree") == d, F.col("score"))).alias(f"Legendre_deg{d}") for d in range(degree + 1)))


def reconstruction(curves: DataFrame, t: int, degree: int = 5, ridge: float = 1e-10, x: list[float] | None = None) -> DataFrame:
    """(j, y, fitted, residual) of the curve at t. A time that isn't there raises KeyError."""
    row = curves.filter(F.col("t") == t).select(F.size("y").alias("p")).first()
    if row is None:
        raise KeyError(t)
    one = legendre_fit(curves, degree, True, ridge, x, row[0]).filter(F.col("t") == t)
    return one.select(F.posexplode(F.arrays_zip("y", "fitted", "residual")).alias("j", "v")).select("j", "v.y", "v.fitted", "v.residual")
