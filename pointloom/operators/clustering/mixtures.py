"""Mixture kernels: Gaussian, and exponential families over a basis."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pointloom.operators.clustering import kernels as U
from pointloom.operators.clustering.base import Fit, Step, register


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gaussian(x: np.ndarray, k: int, rng: np.random.Generator, cov: str = "full", reg: float = 1e-6, max_iter: int = 100, tol: float = 1e-3):
    """(responsibilities, log-likelihood, BIC, converged, trace) of a Gaussian mixture by EM from k-means."""
    n, d = x.shape
    k = max(1, min(k, n))
    r = np.eye(k)[U.lloyd(x, k, rng, n_init=1)[0]]
    last, trace, converged = -np.inf, [], False
    for _ in range(max_iter):
        w = r.sum(axis=0) + 1e-10
        mu = r.T @ x / w[:, None]
        if cov == "full":
            s = np.array([(r[:, j, None] * (x - mu[j])).T @ (x - mu[j]) / w[j] + reg * np.eye(d) for j in range(k)])
        elif cov == "tied":
            both = sum((r[:, j, None] * (x - mu[j])).T @ (x - mu[j]) for j in range(k)) / n + reg * np.eye(d)
            s = np.repeat(both[None], k, axis=0)
        else:
            s = np.array([np.diag((r[:, j, None] * (x - mu[j]) ** 2).sum(axis=0) / w[j] + reg) for j in range(k)])
        logp = np.empty((n, k))
        for j in range(k):
            chol = np.linalg.cholesky(s[j] + 1e-12 * np.eye(d))
            z = np.linalg.solve(chol, (x - mu[j]).T)
            logp[:, j] = np.log(w[j] / n) - 0.5 * (d * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol)).sum()
        norm = _logsumexp(logp, 1)
        ll = float(norm.sum())
        trace.append(ll)
        r = np.exp(logp - norm[:, None])
        if abs(ll - last) < tol * n:
            converged = True
            break
        last = ll
    p = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d}[cov] + k * d + k - 1
    return r, ll, -2 * ll + p * np.log(n), converged, trace


@register("gmm")
def gmm(x, k, rng, cov="full", reg=1e-6, **_):
    """Gaussian mixture."""
    r, ll, bic, ok, trace = gaussian(x, k or 8, rng, cov, reg)
    return Fit(r.argmax(axis=1), {"bic": bic, "converged": ok}, [Step(-t, {"type": "em"}) for t in trace])


def basis_mixture(phi: np.ndarray, k: int, rng: np.random.Generator, start: np.ndarray, penalty: np.ndarray, l2: float = 1e-2, max_iter: int = 30, tol: float = 1e-5):
    """Mixture of exponential families over a basis, each normalised over the data itself.

    A component weighs row i by the softmax of alpha . (phi_i * W(tau)), W(tau) being
    exp(-tau * penalty / 2). The M step is one Newton step per component with as much
    backtracking as its objective asks for, then a search over multiples of tau; so
    the penalised likelihood never falls.
    """
    n, m = phi.shape
    r = np.eye(k)[start] * 0.9 + 0.1 / k
    alpha, tau = np.zeros((k, m)), np.full(k, 1e-3)
    pi = np.full(k, 1.0 / k)
    trace, edf = [], 0.0

    def log_q(a, t):
        s = phi @ (a * np.exp(-0.5 * t * penalty))
        return s - _logsumexp(s[None, :], 1)

    def goal(j, a, t):
        return float(r[:, j] @ log_q(a, t)) - 0.5 * l2 * n * pi[j] * float(a @ a)

    for it in range(max_iter):
        edf = 0.0
        for j in range(k):
            w = max(float(r[:, j].sum()), 1e-9)
            decay = np.exp(-0.5 * tau[j] * penalty)
            f = phi * decay
            q = np.exp(log_q(alpha[j], tau[j]))
            model = q @ f
            hess = (f * q[:, None]).T @ f - np.outer(model, model)
            grad = r[:, j] @ f / w - model - l2 * alpha[j]
            step = np.linalg.solve(hess + l2 * np.eye(m), grad)
            base, size = goal(j, alpha[j], tau[j]), 1.0
            while size > 1e-4 and goal(j, alpha[j] + size * step, tau[j]) < base:
                size *= 0.5
            if size > 1e-4:
                alpha[j] = alpha[j] + size * step
            options = [tau[j] * c for c in (1.0, 0.5, 2.0)] if it else [tau[j]]
            tau[j] = max(options, key=lambda t: goal(j, alpha[j], t))
            value = np.maximum(np.linalg.eigvalsh(hess), 0.0)
            edf += float((value / (value + l2)).sum()) + 1
        logp = np.column_stack([log_q(alpha[j], tau[j]) for j in range(k)]) + np.log(np.maximum(pi, 1e-12))
        norm = _logsumexp(logp, 1)
        ll = float(norm.sum())
        trace.append(ll)
        r = np.exp(logp - norm[:, None])
        pi = r.mean(axis=0)
        if it and abs(trace[-1] - trace[-2]) < tol * abs(trace[-2]):
            break
    p = k * (m + 1) + k - 1
    return r, trace, {"log_likelihood": trace[-1], "bic": -2 * trace[-1] + p * np.log(n), "bic_eff": -2 * trace[-1] + (edf + k - 1) * np.log(n), "n_params": p, "tau": tau.tolist(), "feature_dim": m}


def fourier(x: np.ndarray, frequencies: int, scales: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines at random frequencies of several scales around one over the median distance, and their squared norms."""
    s = x[rng.choice(len(x), min(len(x), 300), replace=False)]
    d = np.sqrt(U.sq_dists(s, s))
    mid = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
    scale = np.geomspace(0.5, 2.0, scales)[np.arange(frequencies) % scales] / mid
    w = rng.standard_normal((frequencies, x.shape[1])) * scale[:, None]
    z = x @ w.T
    sq = (w * w).sum(axis=1)
    return np.hstack([np.cos(z), np.sin(z)]), np.concatenate([sq, sq])


#: A user's basis: (points, k, stream) -> (a row of features per point, the penalty of each feature).
Basis = Callable[[np.ndarray, int, np.random.Generator], tuple[np.ndarray, np.ndarray]]


def _fmm_once(x, k, rng, frequencies, scales, name, basis: Basis | None = None):
    phi, penalty = basis(x, k, rng) if basis else fourier(x, frequencies, scales, rng)
    start = U.lloyd(x, k, rng, n_init=3)[0]
    r, trace, extra = basis_mixture(phi, k, rng, start, penalty)
    steps = [Step(0.0, {"type": name, "feature_dim": phi.shape[1]}), Step(0.0, {"type": "kmeans_init"})]
    steps += [Step(-t, {"type": "newton_step", "iteration": i}) for i, t in enumerate(trace)]
    return Fit(r.argmax(axis=1), extra, steps)


@register("fmm")
def fmm(x, k, rng, frequencies=24, scales=3, k_search=None, n_basis_samples=1, basis=None, **_):
    """Mixture whose log densities are Fourier series, or series over a user's `basis`; `k_search` (lo, hi) picks k by the effective BIC over several bases."""
    if k_search:
        profile = {}
        for kk in range(k_search[0], k_search[1] + 1):
            fits = [_fmm_once(x, kk, rng, frequencies, scales, "fourier_basis", basis) for _ in range(n_basis_samples)]
            profile[kk] = (float(np.mean([f.extra["bic_eff"] for f in fits])), fits[0])
        best = min(profile, key=lambda kk: profile[kk][0])
        fit = profile[best][1]
        fit.extra |= {"selected_k": best, "bic_profile": {kk: v for kk, (v, _) in profile.items()}}
        fit.steps = [Step(profile[best][0], {"type": "k_search", "selected": best})]
        return fit
    return _fmm_once(x, max(1, min(k or 3, len(x))), rng, frequencies, scales, "user_basis" if basis else "fourier_basis", basis)


@register("lmm")
def lmm(x, k, rng, k_nn=10, most=None, basis=None, **_):
    """The same mixture over the lowest Laplacian vectors of all points (or of `most` landmarks, or a user's `basis`), started from the rotation of them that is nearest to a partition."""
    k = max(2, min(k or 3, len(x) - 1))
    e = basis(x, k, rng)[0] if basis else U.embed(x, k, min(k_nn, len(x) - 1), rng, most, drop_trivial=False)
    z = U.unit_rows(e)
    first = [int(rng.integers(len(z)))]
    c = np.zeros(len(z))
    for _ in range(k - 1):
        c += np.abs(z @ z[first[-1]])
        first.append(int(c.argmin()))
    rot = z[first].T
    for _ in range(50):
        hard = np.eye(k)[(z @ rot).argmax(axis=1)]
        u, _, vt = np.linalg.svd(z.T @ hard)
        new = u @ vt
        if np.abs(new - rot).max() < 1e-9:
            break
        rot = new
    start = (z @ rot).argmax(axis=1)
    r, trace, extra = basis_mixture(z, k, rng, start, np.zeros(k))
    steps = [Step(0.0, {"type": "laplacian_basis", "feature_dim": k})] + [Step(-t, {"type": "newton_step"}) for t in trace]
    return Fit(r.argmax(axis=1), extra, steps)


def autoencoder(x: np.ndarray, width: int, hidden: int, rng: np.random.Generator, epochs: int = 200, rate: float = 0.01) -> np.ndarray:
    """Bottleneck of a tanh network (hidden-width-hidden) trained to give its input back."""
    sizes = [x.shape[1], hidden, width, hidden, x.shape[1]]
    w = [rng.standard_normal((a, b)) / np.sqrt(a) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    b = [np.zeros(s) for s in sizes[1:]]
    m, v, t = [np.zeros_like(p) for p in w + b], [np.zeros_like(p) for p in w + b], 0
    for _ in range(epochs):
        rows = x[rng.choice(len(x), min(len(x), 256), replace=False)]
        acts = [rows]
        for i in range(4):
            z = acts[-1] @ w[i] + b[i]
            acts.append(np.tanh(z) if i < 3 else z)
        delta = (acts[-1] - rows) / len(rows)
        gw, gb = [None] * 4, [None] * 4
        for i in range(3, -1, -1):
            gw[i], gb[i] = acts[i].T @ delta, delta.sum(axis=0)
            if i:
                delta = delta @ w[i].T * (1 - acts[i] ** 2)
        t += 1
        for i, (p, g) in enumerate(zip(w + b, gw + gb, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return np.tanh(np.tanh(x @ w[0] + b[0]) @ w[1] + b[1])


@register("amm")
def amm(x, k, rng, width=None, hidden=128, basis=None, **_):
    """The same mixture over the bottleneck of an autoencoder, or over a user's `basis`."""
    k = max(1, min(k or 3, len(x)))
    z = U.zscore(x)
    code = basis(z, k, rng)[0] if basis else autoencoder(z, width or min(8, max(4, x.shape[1] // 4)), hidden, rng)
    start = U.lloyd(code, k, rng, n_init=3)[0]
    r, trace, extra = basis_mixture(U.zscore(code), k, rng, start, np.zeros(code.shape[1]))
    return Fit(r.argmax(axis=1), extra, [Step(0.0, {"type": "autoencoder_basis"})] + [Step(-t, {"type": "newton_step"}) for t in trace])
