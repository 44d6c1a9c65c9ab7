"""Further small models in NumPy, for tasks that each fit one: trees, forests, gradient boosting, kernel machines, perceptrons, logistic regression, PLS-DA."""

from __future__ import annotations

import numpy as np

from prismatic.functions.linalg import Pls

BINS = 64


class Tree:
    """A regression tree over binned columns; splits take most of the squared error away. sums of (g, h) give leaf values -g / (h + l2)."""

    def __init__(self, depth: int = 6, least: int = 1, columns: float = 1.0, l2: float = 0.0, rng: np.random.Generator | None = None):
        self.depth, self.least, self.columns, self.l2 = depth, least, columns, l2
        self.rng = rng or np.random.default_rng(42)

    def fit(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> Tree:
        self.nodes: list[tuple[int, int, int, int, float]] = []  # column, bin, left, right, value
        self.gain = np.zeros(codes.shape[1])
        self.grow(codes, g, h, np.arange(len(g)), 0)
        return self

    def grow(self, codes, g, h, rows, depth: int) -> int:
        at, gs, hs = len(self.nodes), g[rows].sum(), h[rows].sum()
        self.nodes.append((-1, 0, 0, 0, -gs / (hs + self.l2) if hs + self.l2 else 0.0))
        if depth == self.depth or len(rows) < 2 * self.least:
            return at
        p = codes.shape[1]
        some = self.rng.choice(p, max(1, round(p * self.columns)), replace=False) if self.columns < 1 else np.arange(p)
        flat = (codes[rows][:, some] + np.arange(len(some)) * BINS).ravel()
        shape = (len(some), BINS)
        left = [np.bincount(flat, np.repeat(v, len(some)), len(some) * BINS).reshape(shape).cumsum(1) for v in (g[rows], h[rows], np.ones(len(rows)))]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + self.l2) + (gs - left[0]) ** 2 / (hs - left[1] + self.l2) - gs**2 / (hs + self.l2)
        gain[(left[2] < self.least) | (len(rows) - left[2] < self.least) | ~np.isfinite(gain)] = -np.inf
        best = int(np.argmax(gain))
        column, cut = int(some[best // BINS]), best % BINS
        if not gain.ravel()[best] > 1e-12:
            return at
        self.gain[column] += gain.ravel()[best]
        low = codes[rows, column] <= cut
        a = self.grow(codes, g, h, rows[low], depth + 1)
        b = self.grow(codes, g, h, rows[~low], depth + 1)
        self.nodes[at] = (column, cut, a, b, self.nodes[at][4])
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        column, cut, left, right, value = (np.array(v) for v in zip(*self.nodes))
        at = np.zeros(len(codes), dtype=np.int64)
        for _ in range(self.depth):
            inner = column[at] >= 0
            down = np.where(codes[np.arange(len(codes)), np.maximum(column[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(inner, down, at)
        return value[at]


class ShareTree:
    """A tree of zeros and ones on binned columns, grown a level at a time: splits as Tree's of -y and ones, but each level draws its nodes' columns at once. codes:
    columns by rows, as bytes. Leaf values are shares of ones in steps of 2 ** -40, so that their sums are the same in any order."""

    def __init__(self, depth: int = 30, columns: float = 1.0):
        self.depth, self.columns = depth, columns

    def fit(self, codes: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> ShareTree:
        """Of the rows at these places, some of them repeated; y of 0 and 1."""
        self.gain, y, found, nodes = np.zeros(len(codes)), y.astype(np.int64), [], 0
        times = np.bincount(rows, minlength=codes.shape[1])
        rows = np.flatnonzero(times)
        times, ends = times.astype(float), np.array([0, len(rows)])
        for level in range(self.depth + 1):
            size, held = np.diff(ends), times[rows]
            ones, every = np.add.reduceat(y[rows] * held, ends[:-1]), np.add.reduceat(held, ends[:-1])
            nodes += len(size)
            column, cut, left = np.full(len(size), -1), np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            found.append((column, cut, left, np.round(ones / every * 2.0**40) / 2.0**40))
            mixed = (ones > 0) & (ones < every)
            if level == self.depth or not mixed.any():
                break
            rows, size, at = rows[np.repeat(mixed, size)], size[mixed], np.flatnonzero(mixed)
            best, column[at], cut[at] = self.splits(codes, y, times, rows, size, ones[mixed], every[mixed], rng)
            good = best > 1e-12
            column[at[~good]] = -1
            if not good.any():
                break
            np.add.at(self.gain, column[at[good]], best[good])
            rows, size, at = rows[np.repeat(good, size)], size[good], at[good]
            left[at] = nodes + 2 * np.arange(len(at))
            low = np.concatenate([codes[c][r] <= k for c, k, r in zip(column[at], cut[at], np.split(rows, np.cumsum(size)[:-1]))]) if len(at) < 64 else codes[np.repeat(column[at], size), rows] <= np.repeat(cut[at], size)
            starts = np.cumsum(size) - size
            lows = np.add.reduceat(low.astype(np.int64), starts)
            before = np.cumsum(low) - low  # low rows above each
            before -= np.repeat(before[starts], size)
            place = np.arange(len(rows))
            first = np.repeat(starts, size)
            moved = np.empty_like(rows)
            moved[np.where(low, first + before, place + np.repeat(lows, size) - before)] = rows
            rows, ends = moved, np.append(np.stack([starts, starts + lows], axis=1).ravel(), len(rows))
        self.levels = len(found) - 1
        self.column, self.cut, self.left, self.value = (np.concatenate(v) for v in zip(*found))
        return self

    def splits(self, codes, y, times, rows, size, ones, every, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gain, column and bin of each node's best split; nodes in groups, so that their counts stay in the processor's cache."""
        p, n = codes.shape
        some = max(1, round(p * self.columns)) if self.columns < 1 else p
        out, ends, lo, flat = ([], [], []), np.append(0, np.cumsum(size)), 0, codes.reshape(-1)
        while lo < len(size):
            hi = max(lo + 1, min(lo + GROUP, int(np.searchsorted(ends, ends[lo] + GROUP_ROWS))))
            hi, m = min(hi, len(size)), min(hi, len(size)) - lo
            drawn = np.argpartition(rng.random((m, p)), some - 1, axis=1)[:, :some] if some < p else np.tile(np.arange(p), (m, 1))
            r, of = rows[ends[lo] : ends[hi]], size[lo:hi]
            base = BINS * (y[r] if m == 1 else y[r] + np.repeat(2 * np.arange(m), of))
            counts, held = np.empty((m, some, 2, BINS)), times.take(r)
            for s in range(some):
                code = codes[drawn[0, s]].take(r) if m == 1 else flat.take(np.repeat(drawn[:, s] * n, of) + r)
                counts[:, s] = np.bincount(base + code, held, m * 2 * BINS).reshape(m, 2, BINS)
            np.cumsum(counts, axis=3, out=counts)
            k, a = counts[:, :, 0], counts[:, :, 1]
            t, w = ones[lo:hi, None, None], every[lo:hi, None, None]
            k += a
            gain, rest = a * a, t - a
            gain /= np.maximum(k, 1)  # without rows on one side the gain is 0
            rest *= rest
            rest /= np.maximum(w - k, 1)
            gain += rest
            gain = (gain - t * t / w).reshape(m, -1)
            best = gain.argmax(1)
            for kept, v in zip(out, (gain[np.arange(m), best], drawn[np.arange(m), best // BINS], best % BINS)):
                kept.append(v)
            lo = hi
        return tuple(np.concatenate(v) for v in out)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Of all rows of codes."""
        n, flat, ended = codes.shape[1], codes.reshape(-1), self.column < 0
        # a row that came to a leaf stays there
        first, left, cut = np.where(ended, 0, self.column * n), np.where(ended, np.arange(len(ended)), self.left), np.where(ended, BINS, self.cut)
        at, own = np.zeros(n, dtype=np.int64), np.arange(n)
        for _ in range(self.levels):
            at = left.take(at) + (flat.take(first.take(at) + own) > cut.take(at))
        return self.value[at]


#: Nodes, and about so many rows, that ShareTree looks at together.
GROUP, GROUP_ROWS = 256, 1 << 15


class Binned:
    """Columns cut at quantiles of the rows learned from."""

    def bin(self, x: np.ndarray, learn: bool = False) -> np.ndarray:
        if learn:
            self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        return np.stack([np.searchsorted(self.edges[:, j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)


class Forest(Binned):
    """Bagged trees on random columns; spread() is the trees' standard deviation."""

    def __init__(self, n: int = 100, depth: int = 12, columns: str | float = "sqrt", seed: int = 42):
        self.n, self.depth, self.columns, self.seed = n, depth, columns, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        codes, rng = self.bin(x, True), np.random.default_rng(self.seed)
        share = np.sqrt(x.shape[1]) / x.shape[1] if self.columns == "sqrt" else float(self.columns)
        self.trees = []
        for _ in range(self.n):
            i = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(self.depth, 1, share, 0.0, rng).fit(codes[i], -y[i].astype(float), np.ones(len(i))))
        return self

    def each(self, x: np.ndarray) -> np.ndarray:
        codes = self.bin(x)
        return np.stack([t.predict(codes) for t in self.trees])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.each(x).mean(0)

    def spread(self, x: np.ndarray) -> np.ndarray:
        return self.each(x).std(0)

    def importances(self) -> np.ndarray:
        gain = np.sum([t.gain for t in self.trees], axis=0)
        return gain / (gain.sum() or 1.0)


class ShareForest(Forest):
    """Of zeros and ones. Each tree has a random stream of its own, so trees can be grown apart."""

    def packed(self, x: np.ndarray, learn: bool = False) -> np.ndarray:
        return np.ascontiguousarray(self.bin(x, learn).astype(np.uint8).T)

    def tree(self, codes: np.ndarray, y: np.ndarray, rows: np.ndarray, k: int) -> ShareTree:
        """The k-th tree of these rows."""
        rng, p = np.random.default_rng([self.seed, k]), len(codes)
        share = np.sqrt(p) / p if self.columns == "sqrt" else float(self.columns)
        return ShareTree(self.depth, share).fit(codes, y, rows[np.sort(rng.integers(0, len(rows), len(rows)))], rng)

    def fit(self, x: np.ndarray, y: np.ndarray) -> ShareForest:
        codes = self.packed(x, True)
        self.trees = [self.tree(codes, y, np.arange(len(y)), k) for k in range(self.n)]
        return self

    def each(self, x: np.ndarray) -> np.ndarray:
        codes = self.packed(x)
        return np.stack([t.predict(codes) for t in self.trees])


class GradientBoosted(Binned):
    """Second-order boosting of trees for squared error, or for log loss with classify (y of 0 and 1; predict gives the odds' logarithm)."""

    def __init__(self, n: int = 100, rate: float = 0.1, depth: int = 3, rows: float = 0.8, columns: float = 0.8, l2: float = 1.0, classify: bool = False, seed: int = 42):
        self.n, self.rate, self.depth, self.rows, self.columns, self.l2, self.classify, self.seed = n, rate, depth, rows, columns, l2, classify, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> GradientBoosted:
        codes, rng = self.bin(x, True), np.random.default_rng(self.seed)
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if self.classify else float(y.mean())
        self.base, self.trees = (np.log(mean / (1 - mean)) if self.classify else mean), []
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f)) if self.classify else f
            h = p * (1 - p) if self.classify else np.ones(len(y))
            i = np.sort(rng.choice(len(y), max(1, round(self.rows * len(y))), replace=False))
            tree = Tree(self.depth, 1, self.columns, self.l2, rng).fit(codes[i], (p - y)[i], h[i])
            f = f + self.rate * tree.predict(codes)
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self.bin(x)
        return self.base + self.rate * np.sum([t.predict(codes) for t in self.trees], axis=0)

    importances = Forest.importances


class KernelRegression:
    """Support vector regression by coordinate descent on the dual: eps-insensitive loss, |b| <= c. kernel: rbf (gamma "scale") or linear."""

    def __init__(self, c: float = 1.0, eps: float = 0.1, kernel: str = "rbf", rounds: int = 200, tol: float = 1e-5):
        self.c, self.eps, self.kernel, self.rounds, self.tol = c, eps, kernel, rounds, tol

    def gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return a @ b.T
        d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelRegression:
        self.x, self.shift, self.gamma = x, float(np.mean(y)), 1 / (x.shape[1] * (x.var() or 1.0))
        k, t = self.gram(x, x) + 1.0, y - self.shift  # the added one stands for the intercept
        b, f = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(self.rounds):
            most = 0.0
            for i in range(len(y)):
                free = t[i] - f[i] + k[i, i] * b[i]
                new = np.clip(np.sign(free) * max(0.0, abs(free) - self.eps) / k[i, i], -self.c, self.c)
                if (step := new - b[i]) != 0:
                    f += step * k[:, i]
                    b[i], most = new, max(most, abs(step))
            if most < self.tol * self.c:
                break
        self.b = b
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.gram(x, self.x) + 1.0) @ self.b + self.shift


class Perceptron:
    """Layers of relu units fitted by Adam on standardised columns, with early stopping on a held part."""

    def __init__(self, hidden=(64,), decay: float = 1e-4, rate: float = 1e-3, rounds: int = 500, patience: int = 20, seed: int = 42):
        self.hidden, self.decay, self.rate, self.rounds, self.patience, self.seed = tuple(hidden), decay, rate, rounds, patience, seed

    def forward(self, z: np.ndarray, layers) -> list[np.ndarray]:
        out = [z]
        for k, (w, b) in enumerate(layers):
            z = z @ w + b
            out.append(np.maximum(z, 0) if k + 1 < len(layers) else z)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Perceptron:
        rng, self.mean, self.sd = np.random.default_rng(self.seed), x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
        self.y_mean, self.y_sd = float(y.mean()), float(y.std()) or 1.0
        z, t = (x - self.mean) / self.sd, ((y - self.y_mean) / self.y_sd)[:, None]
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 10], order[len(y) // 10 :]
        sizes = [x.shape[1], *self.hidden, 1]
        layers = [[rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
        first, second = ([[np.zeros_like(v) for v in one] for one in layers] for _ in (0, 1))
        best, self.layers, wait, step = np.inf, layers, 0, 0
        for _ in range(self.rounds):
            for lo in range(0, len(train), 200):
                i = rng.permutation(train)[:200] if len(train) > 200 else train
                a, step = self.forward(z[i], layers), step + 1
                back = 2 * (a[-1] - t[i]) / len(i)
                for k in range(len(layers) - 1, -1, -1):
                    grads = (a[k].T @ back + self.decay * layers[k][0], back.sum(0))
                    back = back @ layers[k][0].T * (a[k] > 0) if k else back
                    for j, g in enumerate(grads):
                        first[k][j] = 0.9 * first[k][j] + 0.1 * g
                        second[k][j] = 0.999 * second[k][j] + 0.001 * g * g
                        layers[k][j] = layers[k][j] - self.rate * (first[k][j] / (1 - 0.9**step)) / (np.sqrt(second[k][j] / (1 - 0.999**step)) + 1e-8)
            watch = held if len(held) else train
            loss = float(((self.forward(z[watch], layers)[-1] - t[watch]) ** 2).mean())
            if loss < best - 1e-5:
                best, wait, self.layers = loss, 0, [[w.copy(), b.copy()] for w, b in layers]
            elif (wait := wait + 1) >= self.patience:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.sd, self.layers)[-1][:, 0] * self.y_sd + self.y_mean

    def importances(self) -> np.ndarray:
        return np.abs(self.layers[0][0]).mean(1)


class Logistic:
    """Logistic regression with a ridge term, by Newton steps; predict gives the odds' logarithm."""

    def __init__(self, alpha: float = 1.0, rounds: int = 50):
        self.alpha, self.rounds = alpha, rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        z = np.column_stack([x, np.ones(len(x))])
        ridge = self.alpha * np.eye(z.shape[1])
        ridge[-1, -1] = 1e-9
        self.w = np.zeros(z.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -35, 35)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ self.w)
            self.w = self.w - step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


class PlsDa:
    """Logistic regression on PLS scores."""

    def __init__(self, n_components: int = 2):
        self.pls, self.logistic = Pls(n_components), Logistic()

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pls.x_mean) @ self.turn

    def fit(self, x: np.ndarray, y: np.ndarray) -> PlsDa:
        self.pls.fit(x, y.astype(float))
        self.turn = self.pls.w @ np.linalg.pinv(self.pls.p.T @ self.pls.w)
        self.logistic.fit(self.scores(x), y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.logistic.predict(self.scores(x))


class OneVsRest:
    """One model of make() for each class; proba() has a column for each of `classes`, adding up to 1."""

    def __init__(self, make, logits: bool = True):
        self.make, self.logits = make, logits

    def fit(self, x: np.ndarray, y: np.ndarray) -> OneVsRest:
        self.classes = np.unique(y)
        self.models = [self.make().fit(x, (y == c).astype(float)) for c in self.classes]
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        return self.shared(np.stack([m.predict(x) for m in self.models], axis=1))

    def shared(self, s: np.ndarray) -> np.ndarray:
        """proba() from what each model says."""
        s = 1 / (1 + np.exp(-np.clip(s, -35, 35))) if self.logits else np.clip(s, 1e-9, 1)
        return s / s.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[np.argmax(self.proba(x), axis=1)]


class BoostedNetworks:
    """Boosted networks as a classifier whose predict gives the odds' logarithm."""

    def __init__(self, **params):
        from prismatic.functions.boosting import NeuralBoosted

        self.of = NeuralBoosted(classify=True, **params)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedNetworks:
        self.of.fit(x, y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of.decision(x)

    def importances(self) -> np.ndarray:
        return self.of.importances()


def classifier(name: str, params: dict) -> OneVsRest:
    """Boosted trees stand in for libraries that are not here; SVM is the kernel machine on 0 and 1; PLS as a classifier is PLS-DA."""
    made = {
        "PLS-DA": (lambda: PlsDa(int(params.get("n_components", 2))), True),
        "PLS": (lambda: PlsDa(int(params.get("n_components", 2))), True),
        "NeuralBoosted": (lambda: BoostedNetworks(**params), True),
        "Logistic": (lambda: Logistic(params.get("alpha", 1.0)), True),
        "RandomForest": (lambda: ShareForest(int(params.get("n", 100)), int(params.get("depth", 12))), False),
        "BoostedTrees": (lambda: GradientBoosted(int(params.get("n", 100)), params.get("rate", 0.1), int(params.get("depth", 3)), classify=True), True),
        "SVM": (lambda: KernelRegression(params.get("c", 1.0), 0.1, params.get("kernel", "rbf")), False),
        "MLP": (lambda: Perceptron(params.get("hidden", (64,))), False),
    }
    return OneVsRest(*made[name])


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the curve of score for y of 0 and 1; ties count half, one class alone gives nan."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if not pos or not neg:
        return float("nan")
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))
