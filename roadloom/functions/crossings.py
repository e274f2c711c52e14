"""Lines and rings of an Arrow batch at once, in numpy: places along lines, parts of lines inside rings, widths of unions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vertices(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and the offsets of the rows of an array<struct<x, y>>."""
    lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
    size = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    points = lines.flatten()
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return (*(points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")), at)


def line_probes(x: np.ndarray, y: np.ndarray, step: float, margin: float) -> np.ndarray:
    """Rows (k, px, py, dx, dy, chord) of the places of one line; see ``faces.probes``."""
    dx, dy = np.diff(x), np.diff(y)
    size = np.sqrt(dx * dx + dy * dy)
    own = size > 1e-9
    if not own.any():
        return np.empty((0, 6))
    x, y, dx, dy, size = x[:-1][own], y[:-1][own], dx[own], dy[own], size[own]
    begins = np.concatenate([[0.0], np.cumsum(size)])
    total = begins[-1]
    free = total - 2 * margin
    n = max(int(free // step), 1) if free > 0 else 1
    d = margin + free * (np.arange(n) + 0.5) / n if free > 0 else np.array([total / 2])
    at = np.concatenate([d, np.maximum(0.0, d - 1), np.minimum(total, d + 1)])
    i = np.maximum(np.searchsorted(begins[:-1], at, side="right") - 1, 0)
    t = np.clip((at - begins[i]) / size[i], 0.0, 1.0)
    px, py = (x[i] + t * dx[i]).reshape(3, n), (y[i] + t * dy[i]).reshape(3, n)
    cx, cy = px[2] - px[1], py[2] - py[1]
    chord = np.sqrt(cx * cx + cy * cy)
    out = np.column_stack([np.arange(n), px[0], py[0], cx, cy, chord])
    return out[chord > 0]


def inside_parts(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): the parts of each straight line inside its ring, in shares of its length, as ``geo.inside_intervals``
    gives them. The ring of a row has the vertices x, y from at[row] to at[row + 1]."""
    rows = len(ax)
    n = np.maximum(np.diff(at) - 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(rows), n)
    i = np.arange(len(row)) - first[row] + at[row]
    x1, y1, x2, y2 = x[i], y[i], x[i + 1], y[i + 1]
    dx, dy = (bx - ax), (by - ay)
    ex, ey = x2 - x1, y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        det = dx[row] * ey - dy[row] * ex
        t = ((x1 - ax[row]) * ey - (y1 - ay[row]) * ex) / det
        u = ((x1 - ax[row]) * dy[row] - (y1 - ay[row]) * dx[row]) / det
        hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    every = np.arange(rows)
    whose, cut = np.concatenate([every, every, row[hit]]), np.concatenate([np.zeros(rows), np.ones(rows), t[hit]])
    order = np.lexsort((cut, whose))
    whose, cut = whose[order], cut[order]
    piece = (whose[1:] == whose[:-1]) & (cut[1:] > cut[:-1])
    whose, a, b = whose[:-1][piece], cut[:-1][piece], cut[1:][piece]
    px, py = ax[whose] + (a + b) / 2 * dx[whose], ay[whose] + (a + b) / 2 * dy[whose]
    m = n[whose]
    of = np.repeat(np.arange(len(whose)), m)
    s = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[whose], m)
    high = (y1[s] > py[of]) != (y2[s] > py[of])
    side = px[of] < ex[s] * (py[of] - y1[s]) / np.where(ey[s] != 0, ey[s], 1.0) + x1[s]
    odd = np.bincount(of[high & side], minlength=len(whose)) % 2 == 1
    return whose[odd], a[odd], b[odd]


def union_widths(row: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray, slack: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, width): the median over the probes k of a row of the first union of its intervals (a, b) that holds 0.5,
    within ``slack``; intervals at most ``eps`` apart are one. Rows without any are left out."""
    order = np.lexsort((b, a, k, row))
    row, k, a, b = row[order], k[order], a[order], b[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1])
    far = np.maximum.accumulate(b + 2.0 * np.cumsum(new)) - 2.0 * np.cumsum(new)  # shares lie in 0 to 1, so probes stay apart
    apart = new.copy()
    apart[1:] |= a[1:] > far[:-1] + eps
    at = np.flatnonzero(apart)
    if not len(at):
        return row, a
    low, high = a[at], np.maximum.reduceat(b, at)
    holds = (low - slack < 0.5) & (high + slack > 0.5)
    probe, row, width = np.cumsum(new)[at][holds], row[at][holds], (high - low)[holds]
    once = np.ones(len(probe), bool)
    once[1:] = probe[1:] != probe[:-1]
    row, width = row[once], width[once]
    order = np.lexsort((width, row))
    row, width = row[order], width[order]
    own, begins, n = np.unique(row, return_index=True, return_counts=True)
    return own, 0.5 * width[begins + (n - 1) // 2] + 0.5 * width[begins + n // 2] if len(own) else width
