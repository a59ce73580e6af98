"""Small numeric kernels for a driver value or for one group of rows inside a task."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


def chi2_1_tail(x: float) -> float:
    """P(X > x) for one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def chi2_cdf(x: float, n: int) -> float:
    """The regularised lower gamma function of (n/2, x/2), by series or continued fraction."""
    a, y = n / 2, x / 2
    if y <= 0:
        return 0.0
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= y / k
            total += term
        return total * scale
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        f = -i * (i - a)
        b += 2
        d = 1 / (f * d + b)
        c = b + f / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(p: float, n: int) -> float:
    """By bisection: monotone, so always right to the last digits."""
    low, high = 0.0, float(n)
    while chi2_cdf(high, n) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, n) < p else (low, mid)
    return (low + high) / 2


def mahalanobis(x: np.ndarray) -> float:
    """Squared distance of the last row of x from the rows' mean under their covariance."""
    diff = x[-1] - x.mean(0)
    return float(diff @ np.linalg.pinv(np.atleast_2d(np.cov(x, rowvar=False))) @ diff)


def cholesky(sigma: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """The lower factor of sigma, or of stacked sigmas, with a ridge; of the nearest semidefinite matrix if sigma has none.

    The repair cuts negative eigenvalues to nought, so that draws keep the covariance in all directions that have one.
    """
    sigma = (sigma + np.swapaxes(sigma, -1, -2)) / 2
    eye = np.eye(sigma.shape[-1])
    try:
        return np.linalg.cholesky(sigma + ridge * eye)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(sigma)
        fixed = (vectors * np.maximum(values, 0)[..., None, :]) @ np.swapaxes(vectors, -1, -2)
        size = np.trace(fixed, axis1=-2, axis2=-1)[..., None, None] / len(eye)
        return np.linalg.cholesky(fixed + np.maximum(ridge, 1e-9 * size) * eye)


def absorption(r: np.ndarray) -> float:
    """Share of the largest eigenvalue of a correlation matrix, negative ones cut to 0."""
    values = np.clip(np.linalg.eigvalsh(r), 0, None)
    return float(values.max() / values.sum()) if values.sum() > 0 else 0.0


def min_variance(sigma: np.ndarray, cap: float) -> np.ndarray:
    """Long-only weights of least variance that add to 1, each at most `cap`; equal ones if n * cap < 1.

    Projected gradient steps; the projection onto the capped simplex is a
    bisection on its shift.
    """
    n = len(sigma)
    if n * cap <= 1:
        return np.full(n, 1 / n)
    w, step = np.full(n, 1 / n), 1 / (2 * max(np.linalg.eigvalsh(sigma).max(), 1e-12))
    for _ in range(4000):
        v = w - step * 2 * sigma @ w
        low, high = v.min() - cap, v.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
        new = np.clip(v - (low + high) / 2, 0, cap)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w / w.sum()


def least_shock(sigma: np.ndarray, w: np.ndarray, target: float, bound: float, rounds: int = 1000) -> np.ndarray | None:
    """The x of least x' sigma^-1 x with w'x = target and |x| <= bound; None if no such x exists.

    A primal active set: from a point inside all bounds, steps to the best point
    of the free components under the equation; a bound on the way becomes active, and one whose multiplier has the wrong sign becomes free again.
    """
    n, reach = len(w), bound * np.abs(w).sum()
    if abs(target) > reach * (1 + 1e-12) or (reach == 0 and target):
        return None
    p = np.linalg.inv((sigma + sigma.T) / 2)
    scale = np.abs(np.diag(p)).max()
    p = p / scale
    x = np.sign(w * target) * bound * (abs(target) / reach if reach else 0.0)
    at = np.where(np.abs(x) >= bound * (1 - 1e-12), np.sign(x), 0.0)
    for _ in range(rounds):
        free = np.flatnonzero(at == 0)
        g, step, price = p @ x, np.zeros(n), 0.0
        if len(free) and np.abs(w[free]).max() > 0:
            k = len(free)
            system = np.block([[p[np.ix_(free, free)], w[free][:, None]], [w[free][None, :], np.zeros((1, 1))]])
            found = np.linalg.solve(system, np.r_[-g[free], 0.0])
            step[free], price = found[:k], found[k]
        elif len(free):
            step[free] = np.linalg.solve(p[np.ix_(free, free)], -g[free])
        if np.abs(step).max(initial=0) <= 1e-12 * bound:
            held = np.flatnonzero(at)
            if not len(free) and len(held):  # any price will do that suits all bounds
                low, high = -np.inf, np.inf
                for i in held:
                    if w[i]:
                        edge = -g[i] / w[i]
                        low, high = (max(low, edge), high) if at[i] * w[i] < 0 else (low, min(high, edge))
                price = low if np.isfinite(low) else high if np.isfinite(high) else 0.0
            wrong = at[held] * (g[held] + price * w[held])
            if not len(held) or wrong.max() <= 1e-10 * (1 + np.abs(g).max()):
                return x
            at[held[wrong.argmax()]] = 0.0
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(step > 0, (bound - x) / step, np.where(step < 0, (-bound - x) / step, np.inf))
        room[at != 0] = np.inf
        first = int(room.argmin())
        if room[first] < 1:
            x = x + room[first] * step
            x[first], at[first] = np.sign(step[first]) * bound, np.sign(step[first])
        else:
            x = x + step
    return x


def garch_path(r: np.ndarray, mu: float, omega: float, alpha: float, beta: float) -> tuple[float, np.ndarray]:
    """Gaussian log likelihood of a GARCH(1,1), and the variances of all bars and of the next one.

    The first variance is that of the first 75 bars, each counting 0.94 of the one before.
    """
    e2 = ((r - mu) ** 2).tolist()
    w = 0.94 ** np.arange(min(75, len(e2)))
    h = float(w @ np.array(e2[: len(w)]) / w.sum())
    path, h = [], omega + (alpha + beta) * h
    for x in e2:
        path.append(h)
        h = omega + alpha * x + beta * h
    path.append(h)
    v = np.maximum(np.array(path), 1e-300)
    return float(-0.5 * (np.log(2 * np.pi * v[:-1]) + np.array(e2) / v[:-1]).sum()), v


def nelder_mead(f, start: np.ndarray, size: float = 0.4, rounds: int = 600, tolerance: float = 1e-9) -> np.ndarray:
    """Where f is least, near `start`: a simplex that is mirrored, stretched and shrunk; one more run from where the first ends."""
    best = np.asarray(start, float)
    for _ in range(2):
        n = len(best)
        points = np.vstack([best, best + size * np.eye(n)])
        values = np.array([f(p) for p in points])
        for _ in range(rounds):
            order = values.argsort(kind="stable")
            points, values = points[order], values[order]
            if values[-1] - values[0] < tolerance and np.abs(points - points[0]).max() < 1e-5:
                break
            middle = points[:-1].mean(0)
            mirrored = 2 * middle - points[-1]
            m = f(mirrored)
            if m < values[0]:
                far = 3 * middle - 2 * points[-1]
                v = f(far)
                points[-1], values[-1] = (far, v) if v < m else (mirrored, m)
            elif m < values[-2]:
                points[-1], values[-1] = mirrored, m
            else:
                near = (middle + mirrored) / 2 if m < values[-1] else (middle + points[-1]) / 2
                v = f(near)
                if v < min(m, values[-1]):
                    points[-1], values[-1] = near, v
                else:
                    points[1:] = (points[1:] + points[0]) / 2
                    values[1:] = [f(p) for p in points[1:]]
        best = points[values.argmin()]
    return best


def garch_likeliest(r: np.ndarray) -> tuple[float, float, float, float]:
    """(mu, omega, alpha, beta) of the greatest likelihood; alpha + beta < 1 and all but mu positive by the way they are written.

    Starts from the best of a few persistences with the variance that the returns have.
    """
    scale = r.std()
    x = r / scale

    def read(p: np.ndarray) -> tuple[float, float, float, float]:
        held, share = 0.9999 / (1 + math.exp(-min(max(p[2], -30), 30))), 1 / (1 + math.exp(-min(max(p[3], -30), 30)))
        return float(p[0]), math.exp(min(max(p[1], -30), 5)), held * share, held * (1 - share)

    cost = lambda p: -garch_path(x, *read(p))[0]
    starts = [np.array([x.mean(), math.log(1 - held), math.log(held / (0.9999 - held)), math.log(share / (1 - share))]) for held in (0.5, 0.9, 0.98) for share in (0.05, 0.2)]
    mu, omega, alpha, beta = read(nelder_mead(cost, min(starts, key=cost)))
    return mu * scale, omega * scale * scale, alpha, beta


def garch_fit(returns: np.ndarray, least: int = 120, floor: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """(next bar's volatility, volatility path, standardised returns) of one asset's returns.

    Fewer than `least` returns, or none that vary, give trailing deviations instead, and the deviation of all as forecast.
    """
    r = np.asarray(returns, float)
    if len(r) < least or r.std() <= 1e-12:
        s = float(r.std(ddof=1)) if len(r) > 2 else 0.01
        width, few = min(20, max(5, len(r) // 3)), min(3, len(r))
        path = np.array([r[max(0, i - width + 1) : i + 1].std(ddof=1) if i + 1 >= max(few, 2) else np.nan for i in range(len(r))])
        known = path[~np.isnan(path)]
        path = np.maximum(np.where(np.isnan(path), known[0] if len(known) else s, path), floor)
        return max(s, floor), path, r / path
    h = garch_path(r, *garch_likeliest(r))[1]
    path = np.maximum(np.sqrt(h[:-1]), 1e-12)
    return float(max(math.sqrt(h[-1]), floor)), path, r / path


def clusters(x: np.ndarray, k: int, restarts: int = 10, seed: int = 42, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(label of each row, centres): the best of several Lloyd runs from centres drawn far apart."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(restarts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            label = d.argmin(1)
            new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if (new == c).all():
                break
            c = new
        cost = ((x - c[label]) ** 2).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, label, c)
    return best[1], best[2]


def states(features: np.ndarray, k: int = 3, restarts: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of the last row, transition shares, states of all rows) of rows clustered by standardised features.

    States are numbered in the order of their first feature; the posterior goes by the inverse distance to centres. A state that the rows never leave has a row of noughts.
    """
    z = (features - features.mean(0)) / (features.std(0) + 1e-9)
    label, centers = clusters(z, k, restarts, seed)
    rank = np.empty(k, int)
    rank[np.argsort(centers[:, 0], kind="stable")] = np.arange(k)
    label, centers = rank[label], centers[np.argsort(rank)]
    near = 1 / (np.linalg.norm(centers - z[-1], axis=1) + 1e-6)
    moves = np.zeros((k, k))
    np.add.at(moves, (label[:-1], label[1:]), 1.0)
    return near / near.sum(), moves / np.maximum(moves.sum(1, keepdims=True), 1), label
