"""Models inside folds, all folds and candidates at once.

Every model is fitted from grouped sums, so rows are never gathered. Elastic nets need the second moments.
Boosted trees see a row only as a cell of a grid of bins: the rows of a fold are counted and summed by cell
once, and a task grows all trees of a fold on its cells. Logistic models take Newton steps: a pass
over the rows sums gradients and curvatures of every fold and candidate, the driver solves for the next
coefficients.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fit_prep
from .stats import moments

#: Cells of a fold's grid of bins, at most, whatever the data: what a task that grows trees holds.
CELLS = 1 << 16
CLASSES = 3


def fit_enet(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], grid: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Test rows scored by every elastic net of a grid: name -> (alpha, l1 share).

    Regressors are imputed and standardised on training rows (population deviation). The objective
    needs only second moments, so the rows are read once for all folds and candidates; tasks then
    descend coordinate by coordinate on the moments of their folds.
    """
    keys, p = list(keys), len(xs)
    ready = fit_prep(df, keys, xs, F.col("role") == "train")
    m = moments(ready, keys, y, xs, F.col("role") == "train")
    packed = m.select(
        *keys, "_my", F.array(*[f"_m{i}" for i in range(p)]).alias("_m"), F.array(*[f"_c{i}" for i in range(p)]).alias("_c"),
        F.array(*[f"_s{min(i, j)}{max(i, j)}" for i in range(p) for j in range(p)]).alias("_s"),
    )

    def descend(batches):
        for pdf in batches:
            mean, c = np.stack(pdf["_m"]).astype(float), np.stack(pdf["_c"]).astype(float)
            gram = np.stack(pdf["_s"]).astype(float).reshape(-1, p, p)
            for place, (name, (alpha, share)) in enumerate(grid.items()):
                b = np.zeros_like(c)
                for _ in range(10_000):
                    before = b.copy()
                    for j in range(p):
                        left = c[:, j] - np.einsum("rk,rk->r", gram[:, j], b) + gram[:, j, j] * b[:, j]
                        shrunk = np.sign(left) * np.maximum(np.abs(left) - alpha * share, 0)
                        b[:, j] = shrunk / np.maximum(gram[:, j, j] + alpha * (1 - share), 1e-300)
                    if np.abs(b - before).max(initial=0) < 1e-14:
                        break
                out = pdf[keys].copy()
                out["candidate"], out["place"] = name, place
                out["_a"] = pdf["_my"].to_numpy() - np.einsum("rk,rk->r", b, mean)
                out["_b"] = list(b)
                yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema.fields)
    fits = packed.mapInPandas(descend, f"{fields}, candidate string, place int, _a double, _b array<double>")
    rows = ready.filter("role = 'test'").join(fits, keys)
    score = sum((F.col("_b")[i] * F.col(x) for i, x in enumerate(xs)), F.col("_a"))
    return rows.withColumn("score", score).drop("_a", "_b")


def three_way(gross: Column, cost: Column, buffer: float = 0.0025) -> Column:
    """0 = loses, 1 = not worth the cost, 2 = gains."""
    edge = cost + F.lit(buffer)
    return F.when(gross > edge, 2.0).when(gross < -edge, 0.0).otherwise(1.0)


class Newton:
    """Gradient and curvature of the balanced three-class logistic loss, summed row by row batch."""

    def __init__(self, fits: list[tuple[dict, float, np.ndarray]], keys: Sequence[str], p: int):
        self.fits, self.keys, self.p = fits, list(keys), p

    def sums(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each fit that a batch has rows of: its number, the gradient and the curvature."""
        width = CLASSES * (self.p + 1)
        for batch in batches:
            names = batch.schema.names
            rows = dict(zip(names, (c.to_numpy(zero_copy_only=False) for c in batch.columns)))
            x = np.column_stack([np.ones(batch.num_rows), *(rows[f"_x{i}"].astype(float) for i in range(self.p))])
            target = np.eye(CLASSES)[rows["_label"].astype(int)]
            weight = rows["_w"].astype(float)
            number, grads, curves = [], [], []
            groups, of = {}, np.zeros(batch.num_rows, np.int64)
            for i, key in enumerate(zip(*(rows[k].tolist() for k in self.keys))):
                of[i] = groups.setdefault(key, len(groups))
            for at, (key, _, theta) in enumerate(self.fits):
                group = groups.get(tuple(key[k] for k in self.keys))
                if group is None:
                    continue
                mine = of == group
                xs, w = x[mine], weight[mine]
                raw = xs @ theta.T
                share = np.exp(raw - raw.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                number.append(at)
                grads.append(((share - target[mine]) * w[:, None]).T @ xs)
                bend = (share[:, :, None] * (np.eye(CLASSES) - share[:, None, :])) * w[:, None, None]
                curves.append(np.einsum("rab,ri,rj->aibj", bend, xs, xs).reshape(width, width))
            if number:
                columns = [pa.array(number, pa.int32()), pa.array([g.ravel().tolist() for g in grads]), pa.array([c.ravel().tolist() for c in curves])]
                yield pa.RecordBatch.from_arrays(columns, ["fit", "g", "h"])


def fit_logits(
    df: DataFrame, keys: Sequence[str], gross: str, cost: str, xs: Sequence[str], grid: Mapping[str, float], buffer: float = 0.0025, steps: int = 50
) -> DataFrame:
    """Test rows scored by P(gains) - P(loses) of every balanced three-class logistic of a grid: name -> C.

    Regressors are imputed and standardised on training rows (population deviation). A class weighs n / (classes *
    its rows). The penalty is half the squared slopes over C, against the weighted loss; intercepts are free. All
    folds and candidates take a Newton step together: one pass over the training rows, of which as many
    sums come back as there are coefficients and pairs of them. Steps end when no gradient exceeds 1e-12 of
    the weights. A class without training rows has probability zero; a fold without any scores nothing.
    """
    keys, p = list(keys), len(xs)
    ready = fit_prep(df, keys, xs, F.col("role") == "train")
    rows = ready.filter("role = 'train'").withColumn("_label", three_way(F.col(gross), F.col(cost), buffer).cast("int"))
    sizes = rows.groupBy(*keys, "_label").agg(F.count(F.lit(1)).alias("_n")).collect()  # three rows a fold
    per = {}
    for r in sizes:
        per.setdefault(tuple(r[k] for k in keys), {})[r["_label"]] = r["_n"]
    spark = df.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    if not per:
        none = spark.createDataFrame([], f"{fields}, candidate string, place int, _theta array<double>, _seen array<boolean>")
        return scored_by(ready, none, keys, xs)
    weighed = [(*key, label, sum(n.values()) / (len(n) * c)) for key, n in per.items() for label, c in n.items()]
    weights = spark.createDataFrame(weighed, f"{fields}, _label int, _w double")
    # three rows a fold, like the sizes that came back
    train = rows.join(F.broadcast(weights), [*keys, "_label"]).select(*keys, "_label", "_w", *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).persist()
    fits, names = [], []
    for key in per:
        for place, (name, c) in enumerate(grid.items()):
            fits.append((dict(zip(keys, key)), c, np.zeros((CLASSES, p + 1))))
            names.append((name, place))
    try:
        for _ in range(steps):
            sums = train.mapInArrow(Newton(fits, keys, p).sums, "fit int, g array<double>, h array<double>")
            each = sums.select("fit", F.posexplode(F.concat("g", "h")).alias("at", "v")).groupBy("fit", "at").agg(F.sum("v").alias("v")).collect()
            found = {}
            for r in each:
                found.setdefault(r.fit, {})[r.at] = r.v
            largest = 0.0
            width = CLASSES * (p + 1)
            for at, (key, c, theta) in enumerate(fits):
                seen = sorted(per[tuple(key[k] for k in keys)])
                v = np.array([found[at][i] for i in range(width + width * width)])
                slope = np.tile(np.r_[0.0, np.ones(p)], CLASSES) / c
                live = np.concatenate([np.arange(k * (p + 1), (k + 1) * (p + 1)) for k in seen])
                g = v[:width] + slope * theta.ravel()
                h = v[width:].reshape(width, width) + np.diag(slope)
                step = np.zeros(width)
                step[live] = np.linalg.lstsq(h[np.ix_(live, live)], g[live], rcond=1e-13)[0]
                n = sum(per[tuple(key[k] for k in keys)].values())
                largest = max(largest, np.abs(g[live]).max() / n)
                # far from the end a full step may overshoot; a unit's change in a coefficient is enough
                step /= max(1.0, np.abs(step).max())
                fits[at] = (key, c, theta - step.reshape(theta.shape))
            if largest < 1e-12:
                break
    finally:
        train.unpersist()
    done = [
        (*key.values(), *names[at], theta.ravel().tolist(), [k in per[tuple(key.values())] for k in range(CLASSES)]) for at, (key, _, theta) in enumerate(fits)
    ]
    models = spark.createDataFrame(done, f"{fields}, candidate string, place int, _theta array<double>, _seen array<boolean>")
    return scored_by(ready, models, keys, xs)


def scored_by(ready: DataFrame, models: DataFrame, keys: list[str], xs: Sequence[str]) -> DataFrame:
    """Test rows with the candidates' names and scores; a row for each candidate of the fold."""
    p = len(xs)
    rows = ready.filter("role = 'test'").join(F.broadcast(models), keys)  # as many rows as fits, made on the driver
    raw = [sum((F.col("_theta")[k * (p + 1) + 1 + i] * F.col(x) for i, x in enumerate(xs)), F.col("_theta")[k * (p + 1)]) for k in range(CLASSES)]
    rows = rows.withColumn("_raw", F.array(*[F.when(F.col("_seen")[k], r) for k, r in enumerate(raw)])).withColumn("_top", F.array_max("_raw"))
    share = [F.coalesce(F.exp(F.col("_raw")[k] - F.col("_top")), F.lit(0.0)) for k in range(CLASSES)]
    return rows.withColumn("score", (share[2] - share[0]) / (share[0] + share[1] + share[2])).drop("_theta", "_seen", "_raw", "_top")


def split_leaf(n: np.ndarray, g: np.ndarray, bins: np.ndarray, l2: float, min_leaf: float) -> tuple[float, int, int] | None:
    """(gain, regressor, last bin on the left) of the best split of a leaf's cells, equal gains to the first."""
    best = None
    for j, b in enumerate(bins.T):
        counts = np.cumsum(np.bincount(b, n))
        sums = np.cumsum(np.bincount(b, g))
        all_n, all_g = counts[-1], sums[-1]
        right_n, right_g = all_n - counts, all_g - sums
        fit = (np.bincount(b, n) > 0) & (counts >= min_leaf) & (right_n >= min_leaf)
        if fit.any():
            at = np.flatnonzero(fit)
            gain = sums[at] ** 2 / (counts[at] + l2) + right_g[at] ** 2 / (right_n[at] + l2) - all_g**2 / (all_n + l2)
            gain = np.round(gain, 12)
            i = int(np.argmax(gain))
            if gain[i] > 0 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), j, int(at[i])
    return best


def grow_trees(n: np.ndarray, total: np.ndarray, bins: np.ndarray, leaves: int, trees: int, rate: float, l2: float, min_leaf: float, trace: list | None = None) -> np.ndarray:
    """Scores of cells (rows of bins) by boosted trees of at most `leaves` leaves, fitted to cells of n rows and a total.

    A tree splits the leaf whose best split gains most, until it is full; a leaf's step is the sum of its residuals
    over (rows + l2). Residuals are in units of the target's deviation over all cells' means, so that equal gains
    are told by rounding.
    """
    rows = n.sum()
    if rows == 0:
        return np.full(len(n), np.nan)
    base = total.sum() / rows
    seen = np.flatnonzero(n > 0)
    scale = np.abs(total[seen] / n[seen] - base).max() or 1.0
    score = np.zeros(len(n))
    y = np.where(n > 0, (total - n * base) / scale, 0.0)
    for _ in range(trees):
        g = y - n * score
        parts = [np.arange(len(n))]
        options = [split_leaf(n, g, bins, l2, min_leaf)]
        while len(parts) < leaves:
            gains = [o[0] if o else 0.0 for o in options]
            at = int(np.argmax(gains))
            if gains[at] <= 0:
                break
            _, j, last = options[at]
            right = bins[parts[at], j] > last
            parts.append(parts[at][right])
            parts[at] = parts[at][~right]
            for leaf in (at, len(parts) - 1):
                cells = parts[leaf]
                part = split_leaf(n[cells], g[cells], bins[cells], l2, min_leaf)
                if leaf == at:
                    options[at] = part
                else:
                    options.append(part)
        for cells in parts:
            score[cells] += rate * g[cells].sum() / (n[cells].sum() + l2)
        if trace is not None:
            trace.append(float((n * score**2 - 2 * y * score).sum()))
    return base + scale * score


def fit_boosted(
    df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], grid: Mapping[str, int],
    trees: int = 150, rate: float = 0.05, l2: float = 1.0, min_leaf: int = 20, bins: int = 255,
) -> DataFrame:
    """Test rows scored by boosted trees of every candidate of a grid: name -> leaves of a tree.

    Missing regressors are the fold's training median. A regressor is cut at quantiles of the training rows into `bins`
    bins, fewer where the grid of all regressors' bins would exceed CELLS. Training rows are counted and summed by
    (fold, cell) once, which is all that least-squares trees on bins need; a task then grows all trees of
    a fold on its cells, and the scores of the grid's cells go back to the test rows by key. A row with a
    missing outcome does not train. The shuffles carry cells, whatever the number of rows.
    """
    keys, p = list(keys), len(xs)
    bins = max(2, min(bins, int(CELLS ** (1 / p) + 1e-9)))
    train = (F.col("role") == "train") & F.col(y).isNotNull()
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    med = df.groupBy(*keys).agg(*[F.percentile(F.when(F.col("role") == "train", F.col(x)), F.lit(0.5)).alias(f"_md{i}") for i, x in enumerate(xs)])
    filled = df.join(F.broadcast(med), keys)  # one row a fold
    filled = filled.withColumns({f"_x{i}": F.coalesce(F.col(x).cast("double"), F.col(f"_md{i}"), F.lit(0.0)) for i, x in enumerate(xs)})
    edges = filled.groupBy(*keys).agg(*[F.percentile(F.when(F.col("role") == "train", F.col(f"_x{i}")), cuts).alias(f"_e{i}") for i in range(p)])

    def bin_of(i: int) -> Column:
        return F.coalesce(F.size(F.filter(f"_e{i}", lambda e: F.col(f"_x{i}") > e)), F.lit(0))

    placed = filled.join(F.broadcast(edges), keys)  # one row a fold
    cell = F.lit(0)
    for i in range(p):
        cell = cell * bins + bin_of(i)
    placed = placed.withColumn("_cell", cell.cast("int")).drop(*[f"{c}{i}" for c in ("_md", "_x", "_e") for i in range(p)])
    cells = placed.filter(train).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(y).cast("double")).alias("_s"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def grow(table: pa.Table) -> pa.Table:
        size = bins**p
        at = table["_cell"].to_numpy()
        n, total = np.zeros(size), np.zeros(size)
        n[at], total[at] = table["_n"].to_numpy(), table["_s"].to_numpy()
        place = np.stack(np.unravel_index(np.arange(size), (bins,) * p), axis=1)
        scores = [grow_trees(n, total, place, leaves, trees, rate, l2, min_leaf) for leaves in grid.values()]
        first = [pa.array([table[k][0].as_py()] * size, table[k].type) for k in keys]
        return pa.table([*first, pa.array(np.arange(size, dtype=np.int32)), pa.array(np.stack(scores, axis=1).tolist())], names=[*keys, "_cell", "_scores"])

    scored = cells.groupBy(*keys).applyInArrow(grow, f"{fields}, _cell int, _scores array<double>")
    rows = placed.filter("role = 'test'").join(scored, [*keys, "_cell"])
    named = F.arrays_zip(F.array(*[F.struct(F.lit(name).alias("candidate"), F.lit(i).alias("place")) for i, name in enumerate(grid)]).alias("c"), F.col("_scores").alias("s"))
    rows = rows.withColumn("_z", F.explode(named))
    return rows.select(*df.columns, F.col("_z.c.candidate").alias("candidate"), F.col("_z.c.place").alias("place"), F.col("_z.s").alias("score"))
