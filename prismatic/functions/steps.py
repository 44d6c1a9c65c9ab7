"""Preprocessing as steps with fit and apply on NumPy matrices (rows are spectra): what a search fits inside each fold, so that nothing of the rows held out is learned.

A step by its name and options is a dictionary: {"step": "msc", "reference": "median"}. A chain takes them in ORDER, whatever the order given; resampling of rows is
not a step of the spectra and comes last, on the rows learned from alone.
"""

from __future__ import annotations

import numpy as np

from prismatic.functions.arrays import kept_channels, savgol_matrix
from prismatic.functions.linalg import Pls, baseline_als


class Step:
    """Learns nothing unless fit() says otherwise; axis() is the axis after the step."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Step:
        return self

    def axis(self, axis: list[float]) -> list[float]:
        return axis

    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Exclude(Step):
    """Without the channels in ranges, ends included; with invert those alone."""

    def __init__(self, ranges: list, invert: bool = False):
        self.ranges, self.invert = [tuple(r) for r in ranges], invert

    def axis(self, axis: list[float]) -> list[float]:
        self.keep = kept_channels(axis, self.ranges, self.invert)
        return [axis[k] for k in self.keep]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.keep]


class Msc(Step):
    """Each row less its offset and divided by its slope against a reference: the mean or median spectrum, or one given. Rows without variation or slope stay."""

    def __init__(self, reference: str | list = "mean"):
        self.reference = reference

    def fit(self, x: np.ndarray, y: np.ndarray) -> Msc:
        named = {"mean": np.mean, "median": np.median}
        self.of = named[self.reference](x, axis=0) if isinstance(self.reference, str) else np.asarray(self.reference, dtype=float)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        r = self.of - self.of.mean()
        slope = (x - x.mean(1, keepdims=True)) @ r / ((r @ r) or 1.0)
        still = (x.std(1) < 1e-12) | (np.abs(slope) < 1e-10) | ((r @ r) == 0)
        slope = np.where(still, 1.0, slope)[:, None]
        offset = np.where(still[:, None], 0.0, x.mean(1, keepdims=True) - slope * self.of.mean())
        return (x - offset) / slope


class Without(Step):
    """Centred rows without some directions of the spectra; subclasses find them."""

    def directions(self, e: np.ndarray, y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def fit(self, x: np.ndarray, y: np.ndarray) -> Without:
        self.mean = x.mean(0)
        self.v = self.directions(x - self.mean, np.asarray(y, dtype=float))
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        e = x - self.mean
        return e - (e @ self.v) @ self.v.T


class LoadingOsc(Without):
    """The first loading of a PLS of y, k times, each from what the one before left."""

    def __init__(self, k: int = 1):
        self.k = k

    def directions(self, e: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((e.shape[1], 0))
        for _ in range(self.k):
            p = Pls(1).fit(e, y).p
            if not p.size or not (size := np.linalg.norm(p[:, 0])):
                break
            out = np.column_stack([out, p[:, 0] / size])
            e = e - np.outer(e @ out[:, -1], out[:, -1])
        return np.linalg.qr(out)[0] if out.size else out


class Epo(Without):
    """The first k directions in which a library of interferents varies."""

    def __init__(self, library: list, k: int = 2):
        self.library, self.k = np.asarray(library, dtype=float), k

    def directions(self, e: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.linalg.svd(self.library - self.library.mean(0), full_matrices=False)[2][: self.k].T


class Dosc(Without):
    """The k leading directions of what a PLS of y leaves."""

    def __init__(self, k: int = 1, components: int | None = None):
        self.k, self.components = k, components

    def directions(self, e: np.ndarray, y: np.ndarray) -> np.ndarray:
        fitted = Pls(self.components or min(10, len(e) - 1, e.shape[1])).fit(e, y)
        return np.linalg.svd(e - fitted.t @ fitted.p.T, full_matrices=False)[2][: self.k].T


class Glsw(Step):
    """Channels weighted by the root of 1 / variance, of the spectra or of what a PLS of y leaves of them; weights average 1."""

    def __init__(self, method: str = "covariance", ridge: float = 1e-6, components: int | None = None):
        self.method, self.ridge, self.components = method, ridge, components

    def fit(self, x: np.ndarray, y: np.ndarray) -> Glsw:
        e = x - x.mean(0)
        if self.method == "residual":
            fitted = Pls(self.components or min(10, len(e) - 1, e.shape[1])).fit(e, np.asarray(y, dtype=float))
            e = e - fitted.t @ fitted.p.T
        w = 1 / (e.var(0) + self.ridge)
        self.root = np.sqrt(w / w.mean())
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x * self.root


class Als(Step):
    def __init__(self, lam: float = 1e5, p: float = 1e-3, rounds: int = 10):
        self.options = (lam, p, rounds)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.stack([baseline_als(r, *self.options) for r in x]) if len(x) else x


class Polynomial(Step):
    def __init__(self, degree: int = 3):
        self.degree = degree

    def apply(self, x: np.ndarray) -> np.ndarray:
        q = np.linalg.qr(np.vander(np.linspace(-1, 1, x.shape[1]), self.degree + 1))[0]
        return x - (x @ q) @ q.T


class Absorbance(Step):
    def apply(self, x: np.ndarray) -> np.ndarray:
        return -np.log10(np.maximum(x, 1e-6))


class Snv(Step):
    def apply(self, x: np.ndarray) -> np.ndarray:
        sd = x.std(1, keepdims=True)
        return (x - x.mean(1, keepdims=True)) / np.where(sd == 0, 1, sd)


class Derivative(Step):
    def __init__(self, order: int = 1, window: int = 7, poly: int | None = None):
        self.options = {"window": window, "polyorder": poly, "deriv": order}

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ savgol_matrix(x.shape[1], **self.options).T


STEPS = {"exclude": Exclude, "absorbance": Absorbance, "als": Als, "polynomial": Polynomial, "msc": Msc, "osc": LoadingOsc, "epo": Epo, "dosc": Dosc, "glsw": Glsw}
ORDER = list(STEPS)
# The spectral treatments by name.
TREATMENTS = {"raw": [], "snv": ["snv"], "deriv": ["deriv"], "snv_deriv": ["snv", "deriv"], "deriv_snv": ["deriv", "snv"]}


class Chain:
    """Interference steps in ORDER, then the spectral treatment."""

    def __init__(self, treatment: str = "raw", order: int = 1, window: int = 7, interference: tuple | list = ()):
        if treatment not in TREATMENTS:
            raise ValueError(f"unknown treatment {treatment}: one of {list(TREATMENTS)}")
        if unknown := [s["step"] for s in interference if s["step"] not in STEPS]:
            raise ValueError(f"unknown steps {unknown}: of {ORDER}")
        made = [STEPS[s["step"]](**{k: v for k, v in s.items() if k != "step"}) for s in sorted(interference, key=lambda s: ORDER.index(s["step"]))]
        self.steps = made + [Snv() if s == "snv" else Derivative(order, window) for s in TREATMENTS[treatment]]
        self.learns = any(type(s).fit is not Step.fit for s in self.steps)

    def axis(self, axis: list[float]) -> list[float]:
        for s in self.steps:
            axis = s.axis(axis)
        return axis

    def fit_apply(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        for s in self.steps:
            x = s.fit(x, y).apply(x)
        return x

    def apply(self, x: np.ndarray) -> np.ndarray:
        for s in self.steps:
            x = s.apply(x)
        return x
