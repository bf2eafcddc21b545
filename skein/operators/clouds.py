"""All series of vector sequences: centres, dispersion, dimension, camps, bimodality, turnover.

One Arrow pass sees the vectors of a stretch of a sequence and returns the series of its windows.
Sequences of at most ``CHUNK`` vectors are one stretch. Longer ones are split: their plane comes
from sums over stretches, and each stretch gets the rows around it that its windows reach into, so
that no task holds a whole sequence and results are those of the sequence as a whole. Own numpy
routines stand in for the usual libraries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut

#: The series of a trajectory in the order they come out.
SERIES = (
    "sims double, adj_sims double, sigma double, eff_dim double, k_modes int, k_eigengap int, k_gap double, bimodality double,"
    " balance double, churn_centroid double, churn double, vendi double, chi double, chi_step double, n int, n_support int"
)
#: Vectors of one sequence that a single task takes in one stretch, in windows.
CHUNK = 200


def gram(x: np.ndarray) -> np.ndarray:
    return np.clip(x @ x.T, -1.0, 1.0)


def camps(x: np.ndarray, cut: float = 0.55, least: int = 2, most: int = 5) -> int:
    """Clusters of at least ``least`` members of an average-linkage tree cut at ``cut``."""
    n = len(x)
    if n <= 2:
        return 1
    dist = np.maximum(1.0 - gram(x), 0.0)
    sums, size, alive = dist.copy(), np.ones(n), np.ones(n, bool)
    while alive.sum() > 1:
        at = np.flatnonzero(alive)
        mean = sums[np.ix_(at, at)] / np.outer(size[at], size[at])
        mean[np.diag_indices(len(at))] = np.inf
        i, j = divmod(int(mean.argmin()), len(at))
        if mean[i, j] > cut:
            break
        a, b = at[min(i, j)], at[max(i, j)]
        sums[a] += sums[b]
        sums[:, a] = sums[a]
        size[a] += size[b]
        alive[b] = False
    return int(min(most, max(1, (size[alive] >= least).sum())))


def spectrum(x: np.ndarray, neighbours: int = 7) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenpairs of the self-tuned normalised Laplacian; None where a point has no neighbour."""
    n = len(x)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * gram(x)))
    local = np.maximum(np.sort(dist, 1)[:, min(neighbours, n - 1)], 1e-6)
    near = np.exp(-(dist**2) / np.outer(local, local))
    np.fill_diagonal(near, 0)
    degree = near.sum(1)
    if (degree <= 1e-12).any():
        return None
    root = 1 / np.sqrt(degree)
    return np.linalg.eigh(np.eye(n) - near * np.outer(root, root))


def silhouette(dist: np.ndarray, side: np.ndarray) -> float:
    """Mean silhouette of a two-way split; lone members count 0."""
    out = []
    for i in range(len(dist)):
        own = side == side[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = dist[i][own].sum() / (own.sum() - 1)
        b = dist[i][~own].mean()
        out.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(out))


def two_sides(x: np.ndarray, pairs) -> tuple[float, float]:
    """(silhouette, share of the smaller side) of the Fiedler split; zeros if there is one side."""
    fiedler = pairs[1][:, 1]
    side = fiedler > 0
    if side.all() or not side.any():
        side = fiedler > np.median(fiedler)
    if side.all() or not side.any():
        return 0.0, 0.0
    return silhouette(np.maximum(0, 1 - gram(x)), side), float(min(side.mean(), 1 - side.mean()))


def assignment(cost: np.ndarray) -> float:
    """Least mean cost of matching the shorter side to the longer one (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return float(np.mean([cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]]))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def turnover(prev: np.ndarray, now: np.ndarray) -> float:
    """Cost of matching two centred blocks; NaN if either has fewer than two members."""
    if min(len(prev), len(now)) < 2:
        return float("nan")
    a, b = unit_rows(prev - prev.mean(0)), unit_rows(now - now.mean(0))
    return assignment(1 - np.clip(a @ b.T, -1, 1))


def vendi(x: np.ndarray) -> float:
    """exp(entropy of the kernel's eigenvalues) over the number of members; 0 below two."""
    if len(x) < 2:
        return 0.0
    values = np.linalg.eigvalsh(gram(x) / len(x))
    values = values[values > 1e-12]
    return float(np.exp(-(values * np.log(values)).sum()) / len(x))


def axis(points: np.ndarray, ratio: float = 2.5) -> float | None:
    """Angle of the long axis of a flat cloud; None if it has no clear one."""
    if len(points) < 3:
        return None
    c = np.cov(points.T)
    values = np.linalg.eigvalsh(c)
    if values[1] <= 1e-12 or values[1] / max(values[0], 1e-12) < ratio:
        return None
    return float(0.5 * np.arctan2(2 * c[0, 1], c[0, 0] - c[1, 1]))


def axis_change(a: float | None, b: float | None) -> float:
    if a is None or b is None:
        return 0.0 if a is b else 0.5
    d = abs(a - b) % np.pi
    return float(min(d, np.pi - d) / (np.pi / 2))


def spread_and_dim(x: np.ndarray) -> tuple[float, float]:
    """(mean cosine distance to the centre, participation ratio of the cosine kernel)."""
    if len(x) < 2:
        return 0.0, 1.0
    mean = x.mean(0)
    length = np.linalg.norm(mean)
    k = x @ x.T
    square = float((k * k).sum())
    return float(1 - length if length > 1e-12 else 1.0), float(np.trace(k) ** 2 / square) if square > 1e-12 else 0.0


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v)
    return v / length if length > 1e-12 else v


def plane_of(scatter: np.ndarray) -> np.ndarray:
    """The two main directions of a scatter matrix; directions of no extent are zero."""
    values, vectors = np.linalg.eigh(scatter)
    out = np.zeros((2, len(scatter)))
    for k in range(min(2, len(values))):
        if values[-1 - k] > 1e-24:
            out[k] = vectors[:, -1 - k]
    return out


class Block:
    """What the turn of a block against another one is read from."""

    def __init__(self, x: np.ndarray, flat: np.ndarray):
        self.centre = unit(x.mean(0))
        self.place = flat.mean(0)
        self.radius = float(np.linalg.norm(self.place))
        self.spread = float(np.linalg.norm(flat - self.place, axis=1).mean()) + 1e-9
        self.tilt = axis(flat)
        self.inside = self.radius < 2 * self.spread


def turn(now: Block, ref: Block, same: float = 0.92) -> float:
    """Turn of a block's place in the plane of its sequence against another block's.

    Blocks of nearly one centre have not turned. If both lie at the origin of the plane, or either
    within twice the lesser spread, the axes of their clouds are compared instead, where both have one.
    """
    if np.clip(now.centre @ ref.centre, -1, 1) >= same:
        return 0.0
    least = 2 * min(now.spread, ref.spread)
    if (now.inside and ref.inside) or min(now.radius, ref.radius) < least:
        return 0.0 if now.tilt is None or ref.tilt is None else axis_change(now.tilt, ref.tilt)
    angle = np.arctan2(now.place[1], now.place[0]) - np.arctan2(ref.place[1], ref.place[0])
    return float(0.5 * (1 - np.cos(angle)))


def turns(x: np.ndarray, blocks: list[np.ndarray]) -> tuple[list[float], list[float]]:
    """Turns of each block against the first and against the previous one."""
    moved = x - x.mean(0)
    flat = moved @ plane_of(moved.T @ moved).T
    all_blocks = [Block(x[b], flat[b]) for b in blocks]
    first = [turn(b, all_blocks[0]) if i else 0.0 for i, b in enumerate(all_blocks)]
    return first, [turn(b, all_blocks[i - 1]) if i else 0.0 for i, b in enumerate(all_blocks)]


def _stretch(x: np.ndarray, at: int, n: int, wins: range, size: int, wide: int, mean: np.ndarray, plane: np.ndarray, first: Block | None) -> list[tuple]:
    """Rows of SERIES for the windows ``wins``.

    x: the vectors from position ``at`` on; n: length of the sequence; first: its first block,
    None if it is among these.
    """
    flat = (x - mean) @ plane.T
    half, rows, prev = max(0, (wide - size) // 2), [], None
    if wins.start:
        b = slice((wins.start - 1) * size - at, wins.start * size - at)
        prev, before = Block(x[b], flat[b]), x[b]
    for i in wins:
        b = slice(i * size - at, min(n, (i + 1) * size) - at)
        now = Block(x[b], flat[b])
        first = first or now
        adj = float(np.clip(prev.centre @ now.centre, -1, 1)) if prev else 1.0
        end = min(n, i * size - half + wide)
        s = x[max(0, end - wide) - at : end - at]
        sigma, dim = spread_and_dim(s)
        pairs = spectrum(s) if len(s) >= 6 else None
        gap, width, bi = 1, 0.0, (float("nan"), float("nan"))
        if pairs is not None:
            gaps = np.diff(pairs[0][: min(6, len(s) - 1) + 1])
            gap, width, bi = int(gaps.argmax()) + 1, float(gaps.max()), two_sides(s, pairs)
        churn = turnover(before, x[b]) if prev else float("nan")
        to_first = float(np.clip(now.centre @ first.centre, -1, 1))
        chi, step = (turn(now, first), turn(now, prev)) if prev else (0.0, 0.0)
        rows.append((i, to_first, adj, sigma, dim, camps(s), gap, width, *bi, 1 - adj, churn, vendi(x[b]), chi, step, len(x[b]), len(s)))
        prev, before = now, x[b]
    return rows


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["e"].to_numpy()).astype(float)


def cloud_series(rows: DataFrame, size: int = 10, wide: int = 30, keys: tuple[str, ...] = ("thread_id",), chunk: int = CHUNK) -> DataFrame:
    """keys, win and the series of SERIES, a row per window.

    rows: keys, pos (from 0 without gaps in each sequence), e (unit vectors) and maybe more, which
    is left out. A series has null where it is not defined (no number). Rows with a null vector or position are left out; an empty table gives none.
    """
    keys = list(keys)
    slim = rows.select(*keys, F.col("pos").cast("long").alias("pos"), "e").filter("pos is not null and e is not null")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    schema, names = f"{head}win long, {SERIES}", ["win", *(c.split()[0] for c in SERIES.split(", "))]
    most = chunk * size
    sizes = slim.groupBy(*keys).agg(F.count("*").alias("__n"))
    if sizes.filter(F.col("__n") > most).isEmpty():

        def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(pdf.sort_values("pos"))
            n, mean = len(x), x.mean(0)
            # of fewer vectors than dimensions the small kernel gives the same plane
            moved = x - mean
            plane = np.zeros((2, x.shape[1]))
            found = np.linalg.svd(moved, full_matrices=False)[2][:2] if n > 1 else plane[:0]
            plane[: len(found)] = found
            out = pd.DataFrame(_stretch(x, 0, n, range(-(-n // size)), size, wide, mean, plane, None), columns=names)
            for i, k in enumerate(keys):
                out.insert(i, k, [key[i]] * len(out))
            return out

        return slim.groupBy(*keys).applyInPandas(whole, schema)
    return _by_stretches(slim, sizes, keys, size, wide, most, head, schema, names)


def _by_stretches(slim: DataFrame, sizes: DataFrame, keys: list[str], size: int, wide: int, most: int, head: str, schema: str, names: list[str]) -> DataFrame:
    """The series of sequences that are split over tasks."""
    halo = max(wide, size)
    part = F.floor(F.col("pos") / most)

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf)
        return pd.DataFrame([(*key, len(x), x.sum(0).tolist(), (x.T @ x).ravel().tolist())], columns=[*keys, "__c", "n", "s", "q"])

    def combine(depth: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = [pdf["n"].sum(), np.sum(np.stack(pdf["s"].to_numpy()), 0).tolist(), np.sum(np.stack(pdf["q"].to_numpy()), 0).tolist()]
            return pd.DataFrame([(*key, *total)], columns=[*keys, "__c", "n", "s", "q"])

        return run

    sums_schema = f"{head}__c long, n long, s array<double>, q array<double>"
    total = slim.groupBy(*keys, part.alias("__c")).applyInPandas(sums, sums_schema)
    for depth in range(3):  # sums of 32 stretches at a time, so that no task gets those of a whole sequence
        total = total.groupBy(*keys, F.floor(F.col("__c") / 32).alias("__c")).applyInPandas(combine(depth), sums_schema)

    def frame(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        s, q = np.sum(np.stack(pdf["s"].to_numpy()), 0), np.sum(np.stack(pdf["q"].to_numpy()), 0)
        mean = s / n
        plane = plane_of(q.reshape(len(s), -1) - n * np.outer(mean, mean))
        return pd.DataFrame([(*key, n, mean.tolist(), plane.ravel().tolist())], columns=[*keys, "__n", "__mean", "__plane"])

    frames = total.groupBy(*keys).applyInPandas(frame, f"{head}__n long, __mean array<double>, __plane array<double>")
    start = slim.filter(F.col("pos") < size).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda r: r["e"]).alias("__first"))
    # the rows around a stretch go to its neighbours too
    near = F.array_distinct(F.array(part, F.floor((F.col("pos") - halo) / most), F.floor((F.col("pos") + halo) / most)))
    spread = slim.withColumn("__c", F.explode(near))
    # frames hold one row a sequence, of as many numbers as three vectors and a block
    spread = spread.repartition(*keys, "__c")

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*keys, *names])
        left, info, c = left.sort_values("pos"), right.iloc[0], int(key[-1])
        n, x, at = int(info["__n"]), _matrix(left), int(left["pos"].iloc[0])
        wins = range(c * most // size, -(-min(n, (c + 1) * most) // size))
        mean, plane = np.asarray(info["__mean"]), np.asarray(info["__plane"]).reshape(2, -1)
        head_x = np.stack([np.asarray(v, float) for v in info["__first"]])
        first = Block(head_x, (head_x - mean) @ plane.T) if c else None
        out = pd.DataFrame(_stretch(x, at, n, wins, size, wide, mean, plane, first), columns=names)
        for i, k in enumerate(keys):
            out.insert(i, k, [key[i]] * len(out))
        return out

    parts = sizes.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / most)))).drop("__n")
    info = cut(parts.join(frames, keys).join(start, keys), "frames")
    return spread.groupBy(*keys, "__c").cogroup(info.groupBy(*keys, "__c")).applyInPandas(one, schema)


def summary(series: DataFrame, keys: tuple[str, ...] = ("thread_id",), last: int = 3) -> DataFrame:
    """One row a sequence: values at the start, at the end and their difference.

    ``late`` is the mean of the finite values among the last ``last`` windows; ``first`` the first
    window's value; both NaN where there is none, and then the difference is too.
    """
    keys, nan = list(keys), F.lit(float("nan"))
    w = series.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    fine = lambda c: (F.abs(F.col(c).cast("double")) < float("inf")) & F.col(c).isNotNull()
    near = F.col("win") >= F.col("__n") - last
    late = lambda c: F.coalesce(F.avg(F.when(near & fine(c), F.col(c).cast("double"))), nan)
    first = lambda c: F.coalesce(F.max(F.when((F.col("win") == 0) & fine(c), F.col(c).cast("double"))), nan)
    over = lambda f, c, when=F.lit(True): F.coalesce(f(F.when(fine(c) & when, F.col(c))), nan)
    out = {"s_end": late("sims"), "adj_sim_late": late("adj_sims"), "churn_late": late("churn"), "chi_step_late": late("chi_step")}
    for c in ("sigma", "eff_dim", "k_modes", "bimodality", "chi"):
        out |= {f"{c}_first": first(c), f"{c}_late": late(c), f"{c}_delta": late(c) - first(c)}
    later = F.col("win") > 0
    out |= {
        "churn_mean": over(F.avg, "churn"), "chi_mean": over(F.avg, "chi"), "chi_range": over(F.max, "chi") - over(F.min, "chi"),
        "chi_step_mean": over(F.avg, "chi_step", later), "adj_sim_mean": over(F.avg, "adj_sims", later),
        "n_comments": F.sum("n"), "n_windows": F.count("*"),
    }
    return w.groupBy(*keys).agg(*[e.alias(n) for n, e in out.items()])


def vendi_means(rows: DataFrame, size: int = 10, sample: int = 30, repeats: int = 5, seed: int = 42, keys: tuple[str, ...] = ("thread_id",), statistic=vendi) -> DataFrame:
    """keys, win, value: mean of a statistic over ``repeats`` seeded draws of ``sample`` vectors.

    A window of at most ``sample`` vectors is taken whole, once: every draw would be all of it.
    """
    keys = list(keys)
    slim = rows.select(*keys, F.floor(F.col("pos") / size).alias("win"), "pos", "e").filter("e is not null")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("pos"))
        if len(x) <= sample:
            value = statistic(x)
        else:
            rng = np.random.default_rng([seed, int(key[-1])])
            value = float(np.mean([statistic(x[rng.choice(len(x), sample, replace=False)]) for _ in range(repeats)]))
        return pd.DataFrame([(*key, value)], columns=[*keys, "win", "value"])

    return slim.groupBy(*keys, "win").applyInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "win long, value double")


def late_pooled(rows: DataFrame, size: int = 10, last: int = 3, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """keys, n, eff_dim, vendi: dimension and diversity of all vectors of the last ``last`` windows together."""
    keys = list(keys)
    slim = rows.select(*keys, "pos", "e").filter("e is not null")
    ends = slim.groupBy(*keys).agg(F.floor(F.max("pos") / size).alias("__w"))
    late = slim.join(ends, keys).filter(F.floor(F.col("pos") / size) > F.col("__w") - last).drop("__w")  # last * size rows a sequence
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("pos"))
        return pd.DataFrame([(*key, len(x), spread_and_dim(x)[1], vendi(x))], columns=[*keys, "n", "eff_dim", "vendi"])

    return late.groupBy(*keys).applyInPandas(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n long, eff_dim double, vendi double")
