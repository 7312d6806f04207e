"""Response and Fourier spectra of records held as arrays, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def displacement(a: np.ndarray, dt: float, periods: np.ndarray, damping: float | np.ndarray) -> np.ndarray:
    """Displacements (sample x period) of linear oscillators under `a`, by average acceleration steps."""
    w = 2 * np.pi / periods
    grow = 1 + damping * w * dt + w**2 * dt**2 / 4
    from_w, from_v = damping * w * dt + w**2 * dt**2 / 4, 2 * damping * w + w**2 * dt
    u, v, acc = np.zeros(len(periods)), np.zeros(len(periods)), np.full(len(periods), -a[0])
    out = np.zeros((len(a), len(periods)))
    for j in range(1, len(a)):
        new = (-a[j] - acc * from_w - v * from_v - u * w**2) / grow
        u, v, acc = u + v * dt + dt**2 / 4 * (acc + new), v + dt / 2 * (acc + new), new
        out[j] = u
    return out


def response_spectrum(values: Column, dt: float, periods: list[float], damping: float) -> Column:
    """Array of pseudo-accelerations, one for each period; at period 0 the peak. Null or empty gives null."""
    t = np.array(periods, dtype=float)

    @F.pandas_udf("array<double>")
    def spectrum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_spectrum(np.asarray(a, dtype=float), dt, t, damping) if a is not None and len(a) else None for a in batch])

    return spectrum(values)


def _spectrum(a: np.ndarray, dt: float, t: np.ndarray, damping: float) -> np.ndarray:
    out = np.full(len(t), np.abs(a).max())
    moving = t > 0
    if moving.any():
        out[moving] = (2 * np.pi / t[moving]) ** 2 * np.abs(displacement(a, dt, t[moving], damping)).max(axis=0)
    return out


#: Directions in which the outermost samples of all oscillators are looked for first, and oscillators that turn at once.
FIRST_TURNS = 12
TURNED = 32


def turned_peaks(a: np.ndarray, b: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Greatest |a cos + b sin| (row x angle) over the samples of each row of `a` and `b`; `turn` has the cosines and the sines.

    Only corners of the hull of the points (a, b) and their opposites are outermost in some direction. The outermost
    ones in a few directions make a polygon; what lies in it is left out, and only the rest is turned by all angles.
    """
    first = np.pi * np.arange(FIRST_TURNS) / FIRST_TURNS
    rows, corners = np.arange(len(a)), []
    keep = np.zeros(a.shape, dtype=bool)
    for c, s in zip(np.cos(first), np.sin(first), strict=True):
        v = a * c
        v += b * s
        j = np.abs(v).argmax(axis=1)
        keep[rows, j] = True
        side = np.where(v[rows, j] < 0, -1.0, 1.0)
        corners.append((side * a[rows, j], side * b[rows, j]))
    corners.append((-corners[0][0], -corners[0][1]))
    for (x0, y0), (x1, y1) in zip(corners, corners[1:]):
        nx, ny = y1 - y0, x0 - x1
        v = a * nx[:, None]
        v += b * ny[:, None]
        keep |= np.abs(v, out=v) > (nx * x0 + ny * y0)[:, None]
    # What is not finite is in no polygon.
    keep |= ~np.isfinite(a + b)
    many = keep.sum(axis=1)
    out = np.empty((len(a), turn.shape[1]))
    order = np.argsort(many, kind="stable")
    for i in range(0, len(order), TURNED):
        part = order[i : i + TURNED]
        width = many[part[-1]]
        row, sample = np.nonzero(keep[part])
        place = np.arange(len(row)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
        both = np.zeros((width, len(part), 2))
        both[place, row, 0], both[place, row, 1] = a[part[row], sample], b[part[row], sample]
        v = both.reshape(-1, 2) @ turn
        out[part] = np.abs(v, out=v).reshape(width, len(part), -1).max(axis=0)
    return out


def rotated_spectra(df: DataFrame, keys: list[str], x: str, y: str, dt: float, periods: list[float], damping: float, angles: int) -> DataFrame:
    """Long rows (keys, period, rotd0, rotd50, rotd100, geometric_mean) over `angles` angles from 0 to pi.

    The oscillators are linear, so each component is integrated once and displacements are rotated.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), *(f"{c} double" for c in ("period", "rotd0", "rotd50", "rotd100", "geometric_mean"))])
    theta = np.pi * np.arange(angles) / max(angles - 1, 1)
    t = np.array(periods, dtype=float)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = (np.asarray(getattr(row, c), dtype=float) if getattr(row, c) is not None else np.zeros(0) for c in ("x_", "y_"))
                n = min(len(a), len(b))
                if not n:
                    continue
                a, b = a[:n], b[:n]
                ua, ub = (displacement(v, dt, np.where(t > 0, t, 1.0), damping) for v in (a, b))
                scale = np.where(t > 0, (2 * np.pi / np.where(t > 0, t, 1.0)) ** 2, 1.0)
                ua, ub = (np.where(t > 0, u, v[:, None]) for u, v in ((ua, a), (ub, b)))
                sa = scale * np.stack([np.abs(ua * np.cos(k) + ub * np.sin(k)).max(axis=0) for k in theta])
                both = scale * np.sqrt(np.abs(ua).max(axis=0) * np.abs(ub).max(axis=0))
                out = pd.DataFrame({"period": t, "rotd0": sa.min(axis=0), "rotd50": np.median(sa, axis=0), "rotd100": sa.max(axis=0), "geometric_mean": both})
                for i, k in enumerate(keys):
                    out.insert(i, k, getattr(row, k))
                yield out

    return df.select(*keys, F.col(x).alias("x_"), F.col(y).alias("y_")).mapInPandas(made, schema)


#: Kinds of spectra of a record.
KINDS = ("component_1", "component_2", "component_3", "geometric_mean", "rotd0", "rotd50", "rotd100")

#: Records whose rows go to Spark at once.
RECORDS_AT_ONCE = 16


def spectral_batch(df: DataFrame, keys: list[str], values: list[str], dt: float, periods: list[float], dampings: list[float], angles: int) -> DataFrame:
    """Long rows (keys, damping, period and a column for each of KINDS) of records of three components.

    A missing or empty component has null spectra, and without both of the first two the rotated kinds are
    null too. All oscillators, one for each period and damping, move together through the samples of a record.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), *(f"{c} double" for c in ("damping", "period", *KINDS))])
    t, xi = (g.ravel() for g in np.meshgrid(np.array(periods, dtype=float), np.array(dampings, dtype=float)))
    rest = t <= 0
    scale = np.where(rest, 1.0, (2 * np.pi / np.where(rest, 1.0, t)) ** 2)
    turns = np.pi * np.arange(angles) / max(angles - 1, 1)
    turn = np.stack([np.cos(turns), np.sin(turns)])

    moving, still = np.where(rest, 1.0, t), np.flatnonzero(rest)

    def moved(a: np.ndarray) -> np.ndarray:
        u = displacement(a, dt, moving, xi)
        u[:, still] = a[:, None]
        return np.ascontiguousarray(u.T)

    def spectra_of(arrays: list[np.ndarray]) -> dict[str, np.ndarray]:
        found = dict.fromkeys(KINDS, np.full(len(t), np.nan))
        u = [moved(a) if len(a) else None for a in arrays]
        turned = u[0] is not None and u[1] is not None
        for k in range(2 if turned else 0, 3):
            if u[k] is not None:
                found[KINDS[k]] = scale * np.abs(u[k]).max(axis=1)
        if turned:
            n = min(len(arrays[0]), len(arrays[1]))
            sa = scale[:, None] * turned_peaks(u[0][:, :n], u[1][:, :n], turn)
            found |= {"component_1": sa[:, 0], "component_2": sa[:, (angles - 1) // 2], "rotd0": sa.min(axis=1), "rotd50": np.median(sa, axis=1), "rotd100": sa.max(axis=1)}
            found["geometric_mean"] = np.sqrt(found["component_1"] * found["component_2"])
        return found

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), RECORDS_AT_ONCE):
                part = batch.iloc[i : i + RECORDS_AT_ONCE]
                rows = zip(*(part[f"v{k}_"] for k in range(3)), strict=True)
                found = [spectra_of([np.asarray(a, dtype=float) if a is not None else np.zeros(0) for a in row]) for row in rows]
                out = pd.DataFrame({"damping": np.tile(xi, len(part)), "period": np.tile(t, len(part))} | {k: pd.Series(np.concatenate([f[k] for f in found])).astype("Float64") for k in KINDS})
                for j, k in enumerate(keys):
                    out.insert(j, k, part[k].repeat(len(t)).array)
                yield out

    return df.select(*keys, *[F.col(v).alias(f"v{k}_") for k, v in enumerate(values)]).mapInPandas(made, schema)


def fourier_amplitude(values: Column, dt: float) -> Column:
    """Array of (frequency, amplitude): 2 |FFT dt| of the first half, frequencies up to half the rate, ends included."""

    @F.pandas_udf("array<struct<frequency:double,amplitude:double>>")
    def amplitude(batch: pd.Series) -> pd.Series:
        made: list[list | None] = [None] * len(batch)
        lengths = batch.map(lambda a: len(a) if a is not None else 0).to_numpy()
        for n in np.unique(lengths[lengths > 1]):
            # Records of one length are one transform.
            rows, half = np.flatnonzero(lengths == n), int(n) // 2
            frequency = (np.linspace(0, half, half) / (n * dt)).tolist()
            found = 2 * np.abs(np.fft.fft(np.stack(batch.iloc[rows].to_list()).astype(float), axis=1)[:, :half] * dt)
            for row, values_ in zip(rows, found.tolist(), strict=True):
                made[row] = [{"frequency": f, "amplitude": v} for f, v in zip(frequency, values_, strict=True)]
        return pd.Series(made)

    return amplitude(values)
