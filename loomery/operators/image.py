"""Page-image measures over gray pixel matrices (``array<array<int>>``), as Pandas functions on batches of images.

A page image is one row; every function works on one matrix at a time, so images are spread over tasks as rows are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gray(x) -> np.ndarray:
    return np.array([list(r) for r in x], float) if x is not None and len(x) else np.zeros((0, 0))


def blur(g: np.ndarray) -> float:
    """Variance of the Laplacian over 500, at most 1; edges wrap."""
    lap = np.roll(g, 1, 0) + np.roll(g, -1, 0) + np.roll(g, 1, 1) + np.roll(g, -1, 1) - 4 * g
    return float(min(1.0, lap.var() / 500)) if g.size else 0.0


def brightness(g: np.ndarray) -> float:
    return float(1 - 2 * abs(g.mean() / 255 - 0.5)) if g.size else 0.0


def contrast(g: np.ndarray) -> float:
    return float(min(1.0, (g / 255).std() / 0.25)) if g.size else 0.0


def noise(g: np.ndarray) -> float:
    """Mean absolute difference of neighbours over 25, at most 1."""
    if g.size < 2:
        return 0.0
    return float(min(1.0, np.mean(np.r_[np.abs(np.diff(g, axis=0)).ravel(), np.abs(np.diff(g, axis=1)).ravel()]) / 25))


def otsu(g: np.ndarray) -> int:
    """The threshold that separates two classes of gray best."""
    if not g.size:
        return 128
    h = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256) / g.size
    w, m = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(g: np.ndarray, ink: float = 128) -> float:
    """Slope of the rows' ink centroids, in degrees."""
    rows = [(i, np.flatnonzero(r < ink).mean()) for i, r in enumerate(g) if (r < ink).any()]
    if len(rows) < 3:
        return 0.0
    y, x = np.array(rows, float).T
    return float(np.degrees(np.arctan(np.polyfit(y, x, 1)[0])))


def runs(on: np.ndarray, least: int = 1) -> list[tuple[int, int]]:
    """Half-open runs of true values of ``least`` or more."""
    edge = np.flatnonzero(np.diff(np.r_[0, on.astype(int), 0]))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def zones(g: np.ndarray, ink: float = 128, gap: float = 0.02, least: int = 3) -> list[tuple[str, int, int]]:
    """Text zones by the share of ink per row: header, footer, two columns or body."""
    if not g.size:
        return []
    out = []
    for a, b in runs((g < ink).mean(axis=1) >= gap, least):
        middle = (g[a:b] < ink).mean(axis=0)[g.shape[1] // 3 : 2 * g.shape[1] // 3]
        kind = "header" if b < 0.35 * len(g) and a < 0.15 * len(g) else "footer" if a > 0.75 * len(g) else "two_column" if runs(middle == 0, 5) else "body"
        out.append((kind, a, b))
    return out


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, k // 2), (k, k))


def erode(x: np.ndarray, k: int = 3) -> np.ndarray:
    return _windows(x, k).min(axis=(2, 3)) if x.size else x


def dilate(x: np.ndarray, k: int = 3) -> np.ndarray:
    return _windows(x, k).max(axis=(2, 3)) if x.size else x


def clean(g: np.ndarray, k: int = 3) -> tuple[np.ndarray, int, int, int]:
    """Ink without ruled lines and specks, and how many rows, columns and pixels went."""
    ink = (g <= otsu(g)).astype(np.uint8)
    rows, columns = np.flatnonzero(ink.mean(axis=1) >= 0.6), np.flatnonzero(ink.mean(axis=0) >= 0.6)
    ink[rows] = 0
    ink[:, columns] = 0
    opened = dilate(erode(ink, k), k)
    return opened, len(rows), len(columns), int(ink.sum() - (opened & ink).sum())


def table_grid(g: np.ndarray, ink: float = 128, density: float = 0.5) -> tuple[int, int, float]:
    """Rows and columns of a ruled table, and how regular its lines are (0 with fewer than three)."""
    def lines(p: np.ndarray) -> list[float]:
        return [(a + b - 1) / 2 for a, b in runs(p >= density)]

    def regular(x: list[float]) -> float:
        d = np.diff(x)
        return float(np.exp(-d.std() / d.mean())) if len(x) >= 3 and d.mean() > 0 else 0.0

    if not g.size:
        return 0, 0, 0.0
    h, v = lines((g < ink).mean(axis=1)), lines((g < ink).mean(axis=0))
    return max(0, len(h) - 1), max(0, len(v) - 1), (regular(h) + regular(v)) / 2


MEASURES = "blur double, brightness double, contrast double, noise double, skew double, otsu int, quality double, verdict string, n_zones int, table_rows int, table_columns int, lines_removed int, specks int"


def measure(df: DataFrame, pixels: str) -> DataFrame:
    """All measures of each image, with the weighted quality and a verdict."""

    @F.pandas_udf(MEASURES)
    def all_of(images: pd.Series) -> pd.DataFrame:
        out = []
        for x in images:
            g = _gray(x)
            b, br, c, n = blur(g), brightness(g), contrast(g), noise(g)
            q = 0.4 * b + 0.2 * br + 0.25 * c + 0.15 * (1 - n)
            _, rows, columns, specks = clean(g) if g.size else (g, 0, 0, 0)
            t = table_grid(g)
            out.append((b, br, c, n, skew(g), otsu(g), q, "accept" if q >= 0.6 else "enhance" if q >= 0.35 else "reject", len(zones(g)), t[0], t[1], rows + columns, specks))
        return pd.DataFrame(out, columns=[x.split()[0] for x in MEASURES.split(", ")])

    return df.withColumn("_m", all_of(pixels)).select("*", "_m.*").drop("_m")
