"""Implausible readings per source: impossible values, stuck runs and spikes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import null_safe_join, sharded_row_number

BLOCK = 2048  # readings of one source and field that one Python call looks at
HALO = 40  # readings it sees beyond either border: half a level window, and more than a stuck run needs
LEVEL_WINDOW = 31
#: Products uu, ud, uv, dd, dv, vv of a deviation with its differences if deviations of unit size follow each other at
#: random, and the number of readings that this weighs in a source's own ellipsoid, so that a source of few readings has a sound one.
AT_RANDOM = (1.0, 0.0, -2.0, 0.5, 0.0, 6.0)
PRIOR = 50
ORDINARY = 4.5  # robust deviations within which readings shape the ellipsoid


def _spread(x: np.ndarray) -> float:
    """Robust standard deviation; holds where rounding makes most deviations equal."""
    if len(x) == 0:
        return 0.0
    lo, hi = np.percentile(x, (15.87, 84.13))
    return float(max(1.4826 * np.median(np.abs(x - np.median(x))), (hi - lo) / 2))


def running_level(x: np.ndarray, window: int = LEVEL_WINDOW) -> np.ndarray:
    """Centred running median; at the ends the window is moved inwards, not cut."""
    n = len(x)
    if n <= window:
        return np.full(n, np.median(x)) if n else x
    mid = np.median(np.lib.stride_tricks.sliding_window_view(x, window), axis=1)
    half = window // 2
    # Near the ends, a line through the outermost full windows follows a source that moves.
    step = np.median(np.diff(mid[: 2 * half])) if len(mid) > 2 * half else 0.0
    last = np.median(np.diff(mid[-2 * half :])) if len(mid) > 2 * half else 0.0
    return np.concatenate([mid[0] + step * np.arange(-half, 0), mid, mid[-1] + last * np.arange(1, n - half - len(mid) + 1)])


def phase_points(u: np.ndarray) -> np.ndarray:
    """(value, first difference, second difference) of each deviation, n x 3; beyond the ends lies the level, 0."""
    before, after = np.append(0.0, u)[:-1], np.append(u, 0.0)[1:]
    return np.stack([u, (after - before) / 2, after - 2 * u + before], axis=1)


def _products(points: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Sums of products uu, ud, uv, dd, dv, vv of the chosen points."""
    p = points[over]
    return np.array([np.sum(p[:, i] * p[:, j]) for i in range(3) for j in range(i, 3)])


def _squared_radius(points: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Squared distance of points from the centre of the ellipsoid with this covariance."""
    c = np.zeros((3, 3))
    c[np.triu_indices(3)] = (sums + PRIOR * sums[0] / max(n, 1) * np.array(AT_RANDOM)) / (n + PRIOR)
    c = c + np.triu(c, 1).T
    return np.einsum("ij,jk,ik->i", points, np.linalg.pinv(c, rcond=1e-9, hermitian=True), points)


def _ordinary(u: np.ndarray, found: np.ndarray) -> np.ndarray:
    return ~found & (np.abs(u) <= ORDINARY * _spread(u[~found]))


def phase_space(u: np.ndarray, radius: float | None = None) -> np.ndarray:
    """Phase-space thresholding of deviations from the level: True for spike candidates.

    The deviation with its first and second difference is a point in space. Readings that are neither
    found nor far out give the ellipsoid its axes and tilt. A point beyond `radius` times the ellipsoid
    (the universal threshold, if none is given) is a spike if its deviation is the largest
    among its neighbours, whose differences it has pushed outside, too. Its deviation is then set to the level,
    and the ellipsoid is made again, until no point is found.
    """
    found = np.zeros(len(u), bool)
    if len(u) < 5:
        return found
    limit = 2 * np.log(len(u)) if radius is None else radius**2
    near = _ordinary(u, found)
    while True:
        left = np.where(found, 0.0, u)
        calm = near & ~found
        if not np.any(left[calm]):
            return found
        points = phase_points(left)
        size = np.abs(left)
        peak = (size >= np.append(0.0, size[:-1])) & (size >= np.append(size[1:], 0.0))
        out = peak & ~found & (_squared_radius(points, _products(points, calm), int(calm.sum())) > limit)
        if not out.any():
            return found
        found |= out


def phase_points_alone(u: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Phase points of the found readings, each as if all other found ones were at the level."""
    left = np.where(found, 0.0, u)
    before, after = np.append(0.0, left)[:-1], np.append(left, 0.0)[1:]
    return np.stack([u, (after - before) / 2, after - 2 * u + before], axis=1)[found]


def stuck_runs(x: np.ndarray, least: int) -> np.ndarray:
    if len(x) == 0:
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    lengths = np.diff(np.r_[starts, len(x)])
    return np.repeat(lengths >= least, lengths)


def _inspect(bounds: dict[str, tuple[float, float]], names: list[str], stuck: int):
    """Function of one block (source, field, block) for applyInArrow: its faults and candidates with
    their phase points, and a summary row (place null) with the number and the sums of products of its ordinary points."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("pos")
        voice, which, block = (k.as_py() for k in key)
        field = names[which]
        pos, x = t["pos"].to_numpy(), t["value"].to_numpy()
        own = pos // BLOCK == block
        lo, hi = bounds[field]
        impossible, still = (x < lo) | (x > hi), stuck_runs(x, stuck)
        normal = np.flatnonzero(~impossible & ~still)
        u, spike, point = np.zeros(len(normal)), np.zeros(len(normal), bool), np.zeros((len(x), 3))
        if len(normal):
            y = x[normal]
            u = y - running_level(y)
            spike = phase_space(u)
            if 5 <= np.sum(~spike) < len(normal):
                # The level is read again without the candidates, so that a cluster of spikes doesn't move it.
                u = y - np.interp(np.arange(len(y)), np.flatnonzero(~spike), running_level(y[~spike]))
                spike = phase_space(u)
            point[normal[spike]] = phase_points_alone(u, spike)
        calm = _ordinary(u, spike) & own[normal]
        sums = _products(phase_points(np.where(spike, 0.0, u)), calm)
        marked = np.zeros(len(x), bool)
        marked[normal[spike]] = True
        tell = own & (impossible | still | marked)
        kind = np.where(impossible, 0, np.where(still, 1, 2))
        k = int(tell.sum())
        places = t["place"].combine_chunks()
        places = places.cast(pa.struct([f.with_nullable(True) for f in places.type]))
        numbers = pa.array([*point[tell].tolist(), sums.tolist()], pa.list_(pa.float64()))
        return pa.table({
            "voice": pa.array([voice] * (k + 1), pa.string()), "field": pa.array([which] * (k + 1), pa.int32()),
            "place": pa.concat_arrays([places.filter(pa.array(tell)), pa.array([None], places.type)]),
            "kind": pa.array([*kind[tell].tolist(), -1], pa.int32()), "point": numbers, "n": pa.array([0] * k + [int(calm.sum())], pa.int64()),
        })

    return run


def faulty_readings(df: DataFrame, source: str, place: list[str], order: list[Column], shard: Column, bounds: dict[str, tuple[float, float]], stuck: int = 6, spike_radius: float = 6.0) -> DataFrame:
    """One row per faulty reading: source, place columns, field_name, kind, radius.

    `bounds` names the fields with their possible range. kind is 'impossible' (outside the range),
    'stuck' (one of `stuck` or more equal readings in a row of the source) or 'spike': its phase point
    (deviation from the level, first and second difference) lies beyond `spike_radius` times the
    ellipsoid of the source's ordinary readings. Blocks find candidates by ellipsoids of their own, the
    source's ellipsoid, from the sums of all blocks, decides. Ordinary readings stay within 4 deviations, spikes lie
    beyond 6, and a point lies at least as far out as its deviation.

    Null, NaN and 0 are no readings: they are never faults and don't interrupt a stuck run. Rows with
    the same source and place are deliveries of one reading; if they disagree the smallest counts.
    `order` sorts the readings of a source, `shard` must rise with it and cut a source into parts
    that fit a task. Sources are worked on in blocks of BLOCK readings that see HALO more at either
    border, so a source with most of the rows is spread over all tasks. A null source is a source of its own. An
    empty table gives no rows, extra columns are ignored.
    """
    names = list(bounds)
    reading = lambda c: F.when((F.nanvl(F.col(c), F.lit(0.0)) != 0), F.col(c).cast("double"))
    once = df.groupBy(F.col(source).alias("voice"), *place).agg(*[F.min(reading(c)).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("value")) for i, c in enumerate(names)]))
    long = once.select("voice", F.struct(*place).alias("place"), *[o.alias(f"o{i}") for i, o in enumerate(order)], shard.alias("s"), each.alias("r")).select("*", "r.*").drop("r").where(F.col("value").isNotNull())
    placed = sharded_row_number(long, ["voice", "field"], F.col("s"), [F.col(f"o{i}") for i in range(len(order))], "pos")
    home = F.floor(F.col("pos") / BLOCK)
    blocks = F.explode(F.array_distinct(F.array(home, F.floor((F.col("pos") + HALO) / BLOCK), F.greatest(F.lit(0), F.floor((F.col("pos") - HALO) / BLOCK)))))
    seen = placed.select("voice", "field", "place", "pos", "value", blocks.alias("block")).groupBy("voice", "field", "block")
    kind = dict(df.select(F.struct(*place).alias("p")).dtypes)["p"]
    told = cut_lineage(seen.applyInArrow(_inspect(bounds, names, stuck), f"voice string, field int, place {kind}, kind int, point array<double>, n bigint"))

    # The source's ellipsoid from the sums of all its blocks: few rows, whatever the number of readings.
    total, size = F.sum("n"), F.sum(F.col("point")[0]) / F.greatest(F.sum("n"), F.lit(1))
    shape = told.where("kind = -1").groupBy("voice", "field").agg(*[((F.sum(F.col("point")[i]) + PRIOR * at_random * size) / (total + PRIOR)).alias(c) for i, (c, at_random) in enumerate(zip(("uu", "ud", "uv", "dd", "dv", "vv"), AT_RANDOM))])
    faults = null_safe_join(told.where("kind >= 0"), shape, ["voice", "field"])
    in_sd = F.sqrt(_squared_radius_column([F.col("point")[i] for i in range(3)]))
    field = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("field") + 1)
    named = F.element_at(F.array(*[F.lit(x) for x in ("impossible", "stuck", "spike")]), F.col("kind") + 1)
    kept = faults.withColumn("radius", F.when(F.col("kind") == 2, in_sd)).where((F.col("kind") < 2) | (F.col("radius") > spike_radius))
    return kept.select(F.col("voice").alias(source), "place.*", field.alias("field_name"), named.alias("kind"), "radius")


def _squared_radius_column(p: list[Column]) -> Column:
    """p' C^-1 p for the covariance in the columns uu .. vv, by cofactors; null where it has no volume."""
    uu, ud, uv, dd, dv, vv = (F.col(c) for c in ("uu", "ud", "uv", "dd", "dv", "vv"))
    a, b, c = dd * vv - dv * dv, uv * dv - ud * vv, ud * dv - uv * dd
    d, e, f = uu * vv - uv * uv, ud * uv - uu * dv, uu * dd - ud * ud
    det = uu * a + ud * b + uv * c
    x, y, z = p
    return F.when(det > 1e-12 * uu * dd * vv, (a * x * x + d * y * y + f * z * z + 2 * (b * x * y + c * x * z + e * y * z)) / det)
