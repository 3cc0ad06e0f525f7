"""Vectorised functions where column expressions would be unreasonable: headings, monotone cubics, run-length masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest step in m that counts, heading jump in degrees that is a reversal.
LEAST_STEP, REVERSAL = 0.3, 120.0
_PATH = "array<struct<x:double,y:double>>"


def _wrapped(angle: np.ndarray) -> np.ndarray:
    return (angle + np.pi) % (2 * np.pi) - np.pi


def path_headings(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heading change, largest residual of a straight-line fit of heading over length) in degrees of paths as rows, each cut at a reversal; NaN after its end."""
    n, m = x.shape
    rows = np.arange(n)
    heading, length = np.zeros((n, max(m, 1))), np.zeros((n, max(m, 1)))
    count, back = np.zeros(n, np.int64), np.zeros(n, bool)
    last = [x[:, 0].copy(), y[:, 0].copy()] if m else [np.empty(n)] * 2
    before = np.zeros(n)  # the last step's own heading
    for i in range(1, m):
        dx, dy = x[:, i] - last[0], y[:, i] - last[1]
        step = np.hypot(dx, dy)
        moves = step >= LEAST_STEP
        own = np.arctan2(dy, dx)
        turn = _wrapped(own - before)
        back |= moves & (count > 0) & (np.abs(turn) > np.radians(REVERSAL))
        r = rows[moves & ~back]
        at = count[r]
        heading[r, at] = np.where(at > 0, heading[r, at - 1] + turn[r], own[r])
        length[r, at] = step[r]
        count[r] += 1
        before[r], last[0][r], last[1][r] = own[r], x[r, i], y[r, i]
    some = np.arange(heading.shape[1]) < count[:, None]
    k = np.maximum(count, 1)[:, None]
    middle = np.where(some, np.cumsum(length, axis=1) - length / 2, 0)
    spread = np.where(some, middle - middle.sum(axis=1, keepdims=True) / k, 0)
    off = np.where(some, heading - np.where(some, heading, 0).sum(axis=1, keepdims=True) / k, 0)
    square = (spread * spread).sum(axis=1)
    slope = np.divide((spread * off).sum(axis=1), square, out=np.zeros(n), where=square > 0)
    residual = np.abs(off - slope[:, None] * spread).max(axis=1, initial=0)
    change = _wrapped(heading[rows, np.maximum(count - 1, 0)] - heading[:, 0])
    turns = count >= 2
    return np.where(turns, np.degrees(change), 0.0), np.where(turns, np.degrees(residual), 0.0)


def heading(path: Column) -> Column:
    """struct(theta, residual) of a path that starts at the origin; NULL path gives NULL."""

    @F.arrow_udf("struct<theta:double,residual:double>")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        known = xs.is_valid().to_numpy(zero_copy_only=False)
        size = xs.drop_null().value_lengths().to_numpy()
        m = int(size.max(initial=0)) + 1
        inside = np.arange(1, m) <= size[:, None]
        grids = []
        for series in (xs, ys):
            grid = np.zeros((len(size), m))
            grid[:, 1:] = np.nan
            grid[:, 1:][inside] = series.flatten().to_numpy(zero_copy_only=False)
            grids.append(grid)
        out = np.full((len(xs), 2), np.nan)
        out[known] = np.column_stack(path_headings(*grids))
        return pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in out.T], ["theta", "residual"])

    return run(F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"]))


def pchip(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch-Carlson with the weighted harmonic mean), ends held. v: values, or rows of them."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros(np.shape(v))
    if len(t) == 2:
        m[...] = d
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(1, len(t) - 1):
                a, b, left, right = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1], d[..., i - 1], d[..., i]
                m[..., i] = np.where(left * right > 0, (a + b) / (a / left + b / right), 0.0)
        for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[..., 0], d[..., 1])), (-1, (h[-1], h[-2], d[..., -1], d[..., -2]))):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[..., end] = np.where(s * d0 <= 0, 0.0, np.where((d0 * d1 < 0) & (np.abs(s) > 3 * np.abs(d0)), 3 * d0, s))
    at = np.clip(at, t[0], t[-1])
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(h) - 1)
    u = (at - t[k]) / h[k]
    return v[..., k] * (1 + 2 * u) * (1 - u) ** 2 + m[..., k] * h[k] * u * (1 - u) ** 2 + v[..., k + 1] * u * u * (3 - 2 * u) + m[..., k + 1] * h[k] * u * u * (u - 1)


def upsample(points: Column, history: Column | None = None) -> Column:
    """20 samples at 4 Hz through the origin and points at whole seconds, and two samples of history if there are three.

    Paths of one length are interpolated together, a batch at a time.
    """

    @F.pandas_udf("x array<double>, y array<double>")
    def run(xs: pd.Series, ys: pd.Series, past_x: pd.Series, past_y: pd.Series) -> pd.DataFrame:
        kinds: dict[tuple[int, bool], list[int]] = {}
        for i, (x, a, b) in enumerate(zip(xs, past_x, past_y, strict=True)):
            if x is not None and len(x):
                past = a is not None and len(a) >= 3 and bool(np.isfinite(np.array([*a[-3:-1], *b[-3:-1]], float)).all())
                kinds.setdefault((len(x), past), []).append(i)
        out = {"x": [None] * len(xs), "y": [None] * len(xs)}
        for (n, past), rows in kinds.items():
            t = np.array([*([-0.5, -0.25] if past else []), *range(n + 1)], float)
            for c, now, before in (("x", xs, past_x), ("y", ys, past_y)):
                v = np.zeros((len(rows), len(t)))
                v[:, -n:] = np.stack([now[i] for i in rows])
                if past:
                    v[:, :2] = np.stack([before[i][-3:-1] for i in rows])
                for i, path in zip(rows, pchip(t, v, np.arange(1, 21) * 0.25), strict=True):
                    out[c][i] = path
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    of = lambda path, c: F.transform(path, lambda p: p[c])
    before = history if history is not None else F.lit(None).cast(_PATH)
    found = run(of(points, "x"), of(points, "y"), of(before, "x"), of(before, "y"))
    return F.zip_with(found["x"], found["y"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))


class RunMasks:
    """Masks as column-major run lengths, first run background; runs cut at column ends, never expanded to pixels."""

    def __init__(self, heights: np.ndarray, counts: list[np.ndarray]):
        n = np.array([len(c) for c in counts], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)
        mask, first_run = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        ends = np.cumsum(flat)
        ends -= np.concatenate([[0], ends])[first_run][mask]
        drawn = ((np.arange(len(flat)) - first_run[mask]) % 2 == 1) & (flat > 0)
        s, e, mask = (ends - flat)[drawn], ends[drawn], mask[drawn]
        height = np.asarray(heights, np.int64)[mask]
        first, last = s // height, (e - 1) // height
        n = last - first + 1
        run = np.repeat(np.arange(len(s)), n)
        self.masks, self.mask = len(counts), mask[run]
        self.x = first[run] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.top = np.where(self.x == first[run], s[run] % height[run], 0)
        self.bottom = np.where(self.x == last[run], (e[run] - 1) % height[run], height[run] - 1)

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of a point for each mask to its nearest pixel; zero on the mask; infinite without pixels."""
        x, y = np.asarray(x, float)[self.mask], np.asarray(y, float)[self.mask]
        inside = (self.x == np.round(x)) & (self.top <= np.round(y)) & (np.round(y) <= self.bottom)
        dy = np.maximum(np.maximum(self.top - y, y - self.bottom), 0.0)
        between = np.abs(np.clip(np.round(y), self.top, self.bottom) - y)
        found = np.full(self.masks, np.inf)
        np.minimum.at(found, self.mask, np.where(inside, 0.0, np.hypot(self.x - x, np.maximum(dy, between))))
        return found

    def centre_pixels(self) -> tuple[np.ndarray, np.ndarray]:
        """(x, y) of each mask's pixel nearest to its centroid; the first column and row of equals; NaN without pixels."""
        n = self.bottom - self.top + 1
        total = np.maximum(np.bincount(self.mask, n, self.masks), 1)
        cx = (np.bincount(self.mask, self.x * n, self.masks) / total)[self.mask]
        cy = (np.bincount(self.mask, (self.top + self.bottom) / 2 * n, self.masks) / total)[self.mask]
        y = np.clip(np.floor(cy + 0.5), self.top, self.bottom)
        order = np.lexsort((y, self.x, np.hypot(self.x - cx, y - cy), self.mask))
        some, at = np.unique(self.mask[order], return_index=True)
        out = np.full((2, self.masks), np.nan)
        out[:, some] = self.x[order[at]], y[order[at]]
        return out[0], out[1]


class RunMask(RunMasks):
    """One mask."""

    def __init__(self, height: int, counts: np.ndarray):
        super().__init__(np.array([height]), [np.asarray(counts, np.int64)])

    def distance(self, x: float, y: float) -> float:
        return float(self.distances(np.array([x]), np.array([y]))[0])

    def centre_pixel(self) -> tuple[int, int] | None:
        x, y = self.centre_pixels()
        return None if np.isnan(x[0]) else (int(x[0]), int(y[0]))


def _masks(size: pd.Series, counts: pd.Series) -> tuple[np.ndarray, RunMasks]:
    """The rows of a batch that have a mask, and their masks."""
    rows = [i for i, (s, c) in enumerate(zip(size, counts, strict=True)) if s is not None and c is not None and len(s) == 2]
    return np.array(rows, np.int64), RunMasks(np.array([int(size[i][0]) for i in rows], np.int64), [counts[i] for i in rows])


def _box_centres(boxes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Centres of boxes [x, y, w, h]; NaN without one."""
    rows = [i for i, b in enumerate(boxes) if b is not None and len(b) == 4]
    out = np.full((len(boxes), 2), np.nan)
    if rows:
        b = np.stack([boxes[i] for i in rows]).astype(float)
        out[rows] = b[:, :2] + b[:, 2:] / 2
    return out[:, 0], out[:, 1]


def mask_point(segmentation: Column, bbox: Column) -> Column:
    """Stable point of an object: the mask's pixel nearest its centroid, else the centre of the box [x, y, w, h]."""

    @F.pandas_udf("x double, y double")
    def run(size: pd.Series, counts: pd.Series, box: pd.Series) -> pd.DataFrame:
        x, y = _box_centres(box)
        rows, masks = _masks(size, counts)
        mx, my = masks.centre_pixels()
        drawn = ~np.isnan(mx)
        x[rows[drawn]], y[rows[drawn]] = mx[drawn], my[drawn]
        return pd.DataFrame({"x": x, "y": y})

    return run(segmentation["size"], segmentation["counts"], bbox)


def mask_distance(segmentation: Column, bbox: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a mask; without a mask to the centre of the box."""

    @F.pandas_udf("double")
    def run(size: pd.Series, counts: pd.Series, box: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        px, py = x.to_numpy(float), y.to_numpy(float)
        known = ~(np.isnan(px) | np.isnan(py))
        cx, cy = _box_centres(box)
        out = np.hypot(px - cx, py - cy)
        rows, masks = _masks(size, counts)
        out[rows] = masks.distances(px[rows], py[rows])
        return pd.Series(np.where(known, out, np.nan))

    return run(segmentation["size"], segmentation["counts"], bbox, x, y)


def one_decimal(value: Column) -> Column:
    """One decimal of the exact binary value, ties to even, never -0.0."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else f"{round(x, 1) + 0.0:.1f}")

    return run(value)


def encode_path(points: Column) -> Column:
    """``[x, y], …`` with one decimal each."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else ", ".join(f"[{round(q['x'], 1) + 0.0:.1f}, {round(q['y'], 1) + 0.0:.1f}]" for q in p))

    return run(points)
