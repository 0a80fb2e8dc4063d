"""Plain numpy versions of the operators: oracles for the tests and the single-process side of the bench."""

from __future__ import annotations

import math

import numpy as np


def otsu(v: np.ndarray, bins: int = 256) -> float:
    if v.min() == v.max():
        return float(v[0])
    counts, edges = np.histogram(v, bins=bins)
    centers = (edges[:-1] + edges[1:]) / 2
    best, at = -1.0, 0
    for i in range(bins - 1):
        w1, w2 = counts[:i + 1].sum(), counts[i + 1:].sum()
        if w1 == 0 or w2 == 0:
            continue
        m1, m2 = (counts[:i + 1] * centers[:i + 1]).sum() / w1, (counts[i + 1:] * centers[i + 1:]).sum() / w2
        s = w1 * w2 * (m1 - m2) ** 2
        if s > best * (1 + 1e-12):
            best, at = s, i
    return float(centers[at])


def snr(v: np.ndarray, mask: np.ndarray | None = None) -> float:
    if mask is not None:
        signal, noise = v[mask], v[~mask]
    else:
        pos = v[v > 0]
        if len(pos) == 0:
            return 0.0
        t = otsu(pos)
        signal, noise = v[v > t], v[(v > 0) & (v <= t)]
    if len(signal) == 0 or len(noise) == 0 or noise.std() == 0:
        return 0.0
    return float(signal.mean() / noise.std())


def cnr(v: np.ndarray, mask: np.ndarray) -> float:
    s = np.sort(v[mask])
    n = len(s)
    g, w, noise = s[int(0.3 * n):int(0.5 * n)], s[int(0.7 * n):int(0.9 * n)], v[~mask]
    if min(len(g), len(w), len(noise)) == 0 or noise.std() == 0:
        return 0.0
    return float(abs(g.mean() - w.mean()) / noise.std())


def entropy(v: np.ndarray, bins: int = 256) -> float:
    pos = v[(v > 0) & np.isfinite(v)]
    if len(pos) == 0:
        return 0.0
    d, _ = np.histogram(pos, bins=bins, density=True)
    d = d[d > 0]
    return float(-(d * np.log2(d)).sum())


def normalize(v: np.ndarray, method: str = "zscore", mask: np.ndarray | None = None) -> np.ndarray:
    inside = (lambda a: a[mask]) if mask is not None else (lambda a: a[a > 0])
    roi = inside(v)
    if len(roi) == 0:
        return v.copy()
    out = np.clip(v, *np.percentile(roi, [0.5, 99.5]))
    roi = inside(out)
    if method == "zscore":
        return (out - roi.mean()) / roi.std() if roi.std() > 0 else out
    if method == "minmax":
        return (out - roi.min()) / (roi.max() - roi.min()) if roi.max() > roi.min() else out
    a, b = np.percentile(roi, [1.0, 99.0])
    return np.clip((out - a) / (b - a), 0, 1) if b > a else out


def quantile_map(v: np.ndarray, own: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """``own`` and ``ref``: positive pools of the group and of the reference group."""
    points = np.linspace(0, 1, 100)
    a, b = np.percentile(own, points * 100), np.percentile(ref, points * 100)
    out = v.astype(float).copy()
    pos = v > 0
    out[pos] = np.interp(np.interp(v[pos], a, points, left=0.0, right=1.0), points, b)
    return out


def histogram_map(v: np.ndarray, ref: np.ndarray, bins: int = 256) -> np.ndarray:
    def shares(x):
        h, e = np.histogram(x, bins=bins)
        return np.cumsum(h) / h.sum(), e[:-1]

    def line(x, xs, ys):
        i = np.clip(np.searchsorted(xs, x), 1, len(xs) - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return ys[i - 1] + (x - xs[i - 1]) * (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])

    want, _ = shares(ref[ref > 0])
    pos = v > 0
    have, edges = shares(v[pos])
    out = v.astype(float).copy()
    out[pos] = line(v[pos], edges, line(want, have, edges))
    return out


def box_mean(a: np.ndarray, win: int) -> np.ndarray:
    from numpy.lib.stride_tricks import sliding_window_view
    return sliding_window_view(a, (win, win, win)).mean(axis=(-1, -2, -3))


def ssim(a: np.ndarray, b: np.ndarray, win: int = 7) -> float:
    span = b.max() - b.min()
    n = win ** 3
    ua, ub = box_mean(a, win), box_mean(b, win)
    k = n / (n - 1)
    va, vb = k * (box_mean(a * a, win) - ua * ua), k * (box_mean(b * b, win) - ub * ub)
    cov = k * (box_mean(a * b, win) - ua * ub)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ua * ub + c1) * (2 * cov + c2)) / ((ua ** 2 + ub ** 2 + c1) * (va + vb + c2))).mean())


def tiled_demean(v: np.ndarray, size: int, stride: int) -> np.ndarray:
    out, count = np.zeros(v.shape), np.zeros(v.shape)
    for x in range(0, v.shape[0] - size + 1, stride):
        for y in range(0, v.shape[1] - size + 1, stride):
            for z in range(0, v.shape[2] - size + 1, stride):
                at = np.s_[x:x + size, y:y + size, z:z + size]
                out[at] += v[at] - v[at].mean()
                count[at] += 1
    return np.where(count == 0, v, out / np.maximum(count, 1))


def gaussian_taps(sigma: float) -> np.ndarray:
    tail = int(max(sigma * 4.0, 0.5) + 0.5)
    t = math.sqrt(0.5) / sigma
    return np.array([0.5 * (math.erf(t * (k + 0.5)) - math.erf(t * (k - 0.5))) for k in range(-tail, tail + 1)])


def smooth(v: np.ndarray, sigmas: tuple[float, float, float]) -> np.ndarray:
    for axis, s in enumerate(sigmas):
        w = gaussian_taps(s)
        v = np.apply_along_axis(lambda line: np.convolve(line, w, mode="full")[len(w) // 2:len(w) // 2 + len(line)], axis, v)
    return v


def trilinear(v: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Values at ``pos`` (..., 3), clamped to the grid."""
    p = np.clip(pos, 0, np.array(v.shape) - 1)
    lo = np.floor(p).astype(int)
    out = np.zeros(p.shape[:-1])
    for bits in range(8):
        up = np.array([bits >> i & 1 for i in range(3)])
        at = np.minimum(lo + up, np.array(v.shape) - 1)
        w = np.prod(np.where(up, p - lo, 1 - (p - lo)), axis=-1)
        out += w * v[at[..., 0], at[..., 1], at[..., 2]]
    return out


CROSS = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def shifted(m: np.ndarray, off) -> np.ndarray:
    p = np.pad(m, 1)
    return p[tuple(slice(1 + o, 1 + o + n) for o, n in zip(off, m.shape))]


def erode(m):
    return np.logical_and.reduce([m, *[shifted(m, o) for o in CROSS]])


def dilate(m):
    return np.logical_or.reduce([m, *[shifted(m, o) for o in CROSS]])


def label(m: np.ndarray) -> np.ndarray:
    out = np.zeros(m.shape, int)
    n = 0
    for start in zip(*np.nonzero(m)):
        if out[start]:
            continue
        n += 1
        stack = [start]
        out[start] = n
        while stack:
            p = stack.pop()
            for o in CROSS:
                q = tuple(a + b for a, b in zip(p, o))
                if all(0 <= c < s for c, s in zip(q, m.shape)) and m[q] and not out[q]:
                    out[q] = n
                    stack.append(q)
    return out


def fill_holes(m: np.ndarray) -> np.ndarray:
    outside = label(np.pad(~m, 1, constant_values=True))
    return (outside != outside[0, 0, 0])[1:-1, 1:-1, 1:-1]


def largest(m: np.ndarray) -> np.ndarray:
    lab = label(m)
    if lab.max() == 0:
        return m.copy()
    return lab == np.bincount(lab.ravel())[1:].argmax() + 1


def simple_mask(v: np.ndarray, p: float = 10.0) -> np.ndarray:
    m = erode(fill_holes(v > np.percentile(v[v > 0], p)))
    return largest(dilate(dilate(m)))
