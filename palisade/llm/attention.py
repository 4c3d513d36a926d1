"""A small causal self-attention model over subword ids, in numpy: forward, backward, and scores of whole texts."""

from __future__ import annotations

import numpy as np

#: Ids with leaves of their own (the last leaf is for all others), clusters of leaves, positions of a window, what a
#: window advances by, and the widths of the model.
HEAD, CLUSTERS, WINDOW, STRIDE, WIDTH = 2048, 64, 32, 28, 16
#: Windows of a step of training, and windows scored together.
STEP, BATCH = 64, 64
#: Of absolute discounting; the learning rate.
DISCOUNT, RATE = 0.75, 4e-3


class Frame:
    """What comes from counts over the whole training corpus and stays fixed: which ids have leaves, their clusters, and
    the log probabilities of a leaf after another, split into cluster and leaf."""

    def __init__(self, unigrams: np.ndarray, end: int):
        """unigrams: how often each id comes; end: the id that ends a text, and stands before its first."""
        order = np.lexsort((np.arange(len(unigrams)), -unigrams))
        head = np.concatenate([[end], order[order != end][: HEAD - 2]])
        self.leaf_of = np.full(len(unigrams), HEAD - 1, np.int32)
        self.leaf_of[head] = np.arange(len(head))
        self.end = int(self.leaf_of[end])
        # ids without a leaf share the last one's probability by their counts
        lone = unigrams + 0.5
        lone[head] = 0
        self.inner = np.zeros(len(unigrams), np.float32)
        rest = lone > 0
        self.inner[rest] = np.log10(lone[rest] / lone.sum())

    def fit(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """Counts n of leaf b right after leaf a."""
        pairs = np.zeros((HEAD, HEAD), np.float32)
        pairs[a, b] = n
        single = pairs.sum(0, dtype=np.float64) + 0.5
        single /= single.sum()
        before = pairs.sum(1, keepdims=True, dtype=np.float64)
        kinds = (pairs > 0).sum(1, keepdims=True)
        own = np.maximum(pairs - DISCOUNT, 0) + np.where(before > 0, DISCOUNT * kinds, 1) * single
        own /= np.where(before > 0, before, 1)
        leaves = _clustered(np.sqrt(pairs))  # place -> leaf, clusters of neighbouring places
        place = np.empty(HEAD, np.int32)
        place[leaves] = np.arange(HEAD, dtype=np.int32)
        self.place = place
        split = own[:, leaves].reshape(HEAD, CLUSTERS, -1)
        clusters = split.sum(2)
        self.cluster_bias = np.ascontiguousarray(np.log(clusters), np.float32)
        # log10 of a leaf within its cluster, after another
        self.within = np.ascontiguousarray(np.log10(split / clusters[:, :, None]), np.float32).reshape(HEAD, HEAD)


def _clustered(x: np.ndarray) -> np.ndarray:
    """Columns in an order that puts those after like leaves together: halved again and again along the direction in
    which they differ most."""
    rows = np.ascontiguousarray(x.T)
    rows /= np.sqrt((rows**2).sum(1, keepdims=True)) + 1e-6
    parts = [np.arange(len(rows))]
    while len(parts) < CLUSTERS:
        halves = []
        for part in parts:
            own = rows[part] - rows[part].mean(0)
            v = np.cos(np.arange(own.shape[1], dtype=np.float32))
            for _ in range(12):
                v = own.T @ (own @ v)
                v /= np.sqrt(v @ v) + 1e-12
            part = part[np.lexsort((part, own @ v))]
            halves += [part[: len(part) // 2], part[len(part) // 2 :]]
        parts = halves
    return np.concatenate(parts)


def initial() -> dict[str, np.ndarray]:
    r = np.random.default_rng(7)
    normal = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
    d = WIDTH
    return {
        "ids": normal(HEAD, d, by=0.3), "places": normal(WINDOW, d, by=0.1),
        "look": normal(d, d, by=d**-1.0), "value": normal(d, d, by=0.5 * d**-0.5),
        "clusters": np.zeros((d, CLUSTERS), np.float32), "cluster_bias": np.zeros(CLUSTERS, np.float32),
    }


#: Attention looks at a position and those before it.
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _exp(x: np.ndarray, safe: bool) -> np.ndarray:
    """In place; safe: less the largest of each row, so that float32 holds it whatever the weights."""
    if safe:
        x -= x.max(-1, keepdims=True)
    return np.exp(x, out=x)


class Model:
    """Weights over a Frame. What it computes on the way lies in arrays that are used again by the next call."""

    def __init__(self, frame: Frame, weights: dict[str, np.ndarray]):
        self.frame, self.w, self._bias = frame, weights, None
        self._space: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self._space or self._space[name].size < size:
            self._space[name] = np.empty(size, np.float32)
        return self._space[name][:size].reshape(shape)

    @property
    def _value(self) -> np.ndarray:
        """The value's matrix with a column more, for the ones that sum up what a position looks at."""
        return np.concatenate([self.w["value"], np.zeros((WIDTH, 1), np.float32)], axis=1)

    def _hidden(self, x: np.ndarray, safe: bool = True) -> tuple:
        """States of windows of leaves (n, WINDOW), and what gradients() needs. Of the one head, query meets key and value
        meets its way back in one matrix each."""
        w, room, n = self.w, self._room, len(x)
        given, asked, looks = room("given", n, WINDOW, WIDTH), room("asked", n, WINDOW, WIDTH), room("looks", n, WINDOW, WINDOW)
        value, met, mid = (room(k, n, WINDOW, d) for k, d in (("value", WIDTH + 1), ("met", WIDTH + 1), ("mid", WIDTH)))
        rows = given.reshape(-1, WIDTH)
        np.take(w["ids"], x.ravel(), axis=0, out=rows, mode="clip")
        given += w["places"]
        np.matmul(rows, w["look"], out=asked.reshape(-1, WIDTH))
        np.matmul(asked, given.transpose(0, 2, 1), out=looks)
        _exp(looks, safe)
        looks *= SEEN
        np.matmul(rows, self._value, out=value.reshape(-1, WIDTH + 1))
        value[..., WIDTH] = 1
        np.matmul(looks, value, out=met)
        total = met[..., WIDTH:]
        np.divide(met[..., :WIDTH], total, out=mid)
        mid += given
        return mid, (given, asked, looks, value, met, total)

    def _clusters(self, state: np.ndarray, before: np.ndarray, safe: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the clusters after leaves, given states (rows), and their totals."""
        top, bias = self._room("top", len(state), CLUSTERS), self._room("bias", len(state), CLUSTERS)
        np.matmul(state, self.w["clusters"], out=top)
        np.take(self.bias, before, axis=0, out=bias, mode="clip")
        top += bias
        _exp(top, safe)
        return top, top @ np.ones(CLUSTERS, np.float32)

    @property
    def bias(self) -> np.ndarray:
        if self._bias is None:
            self._bias = self.frame.cluster_bias + self.w["cluster_bias"]
        return self._bias

    def chosen(self, state: np.ndarray, before: np.ndarray, place: np.ndarray, safe: bool = True) -> np.ndarray:
        """log10 probabilities of the leaves at `place` after those before, given states (rows): the model says which
        cluster comes, counts of neighbours which leaf of it."""
        top, total = self._clusters(state, before, safe)
        found = np.log10(top[np.arange(len(place)), place // (HEAD // CLUSTERS)] / total)
        found += self.frame.within.ravel()[before.astype(np.int64) * HEAD + place]
        return found

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (of clusters) per position and gradients. x, y: leaves before and at each position (n, WINDOW), weight: 0
        for filling."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            loss, g = self._gradients(x, y, weight, False)
        if np.isfinite(loss) and all(np.isfinite(own).all() for own in g.values()):
            return loss, g
        return self._gradients(x, y, weight, True)  # an exponent is more than float32 holds

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, safe: bool) -> tuple[float, dict[str, np.ndarray]]:
        w, g, room, flat = self.w, {}, self._room, lambda a: a.reshape(-1, a.shape[-1])
        out, (given, asked, looks, value, met, total) = self._hidden(x, safe)
        n, leaf = max(1.0, float(weight.sum())), x.ravel()
        state, cluster = flat(out), self.frame.place[y.ravel()] // (HEAD // CLUSTERS)
        top, sums = self._clusters(state, leaf, safe)
        rows, scale = np.arange(len(cluster)), weight.ravel() / np.float32(n)
        loss = -float((np.log(top[rows, cluster] / sums) * scale).sum())
        top *= (scale / sums)[:, None]
        top[rows, cluster] -= scale
        g["clusters"], g["cluster_bias"] = state.T @ top, np.ones(len(top), np.float32) @ top
        d_mid = np.matmul(top, w["clusters"].T, out=room("d_mid", *state.shape))
        # the state is given + (looks @ value) / total, where total is the last column of looks @ value
        d_met, total = room("d_met", *met.shape), total.reshape(-1)
        np.divide(d_mid, total[:, None], out=flat(d_met)[:, :WIDTH])
        flat(d_met)[:, WIDTH] = np.einsum("ij,ij->i", d_mid, flat(met)[:, :WIDTH]) / -(total**2)
        d_value = np.matmul(looks.transpose(0, 2, 1), d_met, out=room("d_value", *met.shape))
        d_scores = np.matmul(d_met, value.transpose(0, 2, 1), out=room("d_scores", *looks.shape))
        d_scores *= looks
        d_asked = np.matmul(d_scores, given, out=room("d_asked", *given.shape))
        g["look"], g["value"] = flat(given).T @ flat(d_asked), np.ascontiguousarray((flat(given).T @ flat(d_value))[:, :WIDTH])
        d_given = np.matmul(d_scores.transpose(0, 2, 1), asked, out=room("d_given", *given.shape))
        part = room("part", *state.shape)
        for back in (d_mid, np.matmul(flat(d_asked), w["look"].T, out=part)):
            flat(d_given)[:] += back
        flat(d_given)[:] += np.matmul(flat(d_value), self._value.T, out=part)
        g["places"] = d_given.sum(0)
        # sums by leaf
        own = leaf[:, None].astype(np.int64) * WIDTH + np.arange(WIDTH)
        g["ids"] = np.bincount(own.ravel(), d_given.ravel(), HEAD * WIDTH).astype(np.float32).reshape(HEAD, WIDTH)
        return loss, g

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, given as ids that close with the end. Windows overlap: each position is
        scored in one window, with at least WINDOW - STRIDE positions before it, or all there are."""
        frame, total = self.frame, np.zeros(len(texts))
        if not texts:
            return total
        lengths, ids = np.array([len(x) for x in texts], np.int64), np.concatenate(texts)
        leaves = frame.leaf_of[ids]
        places = frame.place[leaves]
        starts = np.cumsum(lengths) - lengths
        before = np.empty_like(leaves)
        before[1:] = leaves[:-1]
        before[starts[lengths > 0]] = frame.end
        windows = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        for k in range(0, len(owner), BATCH):
            own, i = owner[k : k + BATCH], nth[k : k + BATCH]
            inside = (i * STRIDE)[:, None] + np.arange(WINDOW)  # positions in the text
            real = inside < lengths[own][:, None]
            at = starts[own][:, None] + np.where(real, inside, 0)
            fresh = real & (inside >= np.where(i > 0, i * STRIDE + WINDOW - STRIDE, 0)[:, None])
            x, row = before[at], np.nonzero(fresh)[0]
            after = places[at[fresh]]
            for safe in (False, True):  # the second only where an exponent is more than float32 holds
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    found = self.chosen(self._hidden(x, safe)[0][fresh], x[fresh], after, safe)
                if np.isfinite(found).all():
                    break
            total += np.bincount(own[row], found, len(texts))
        inner = frame.inner[ids]
        if inner.any():
            total += np.bincount(np.repeat(np.arange(len(texts)), lengths), inner, len(texts))
        return total


class Trainer:
    """Steps of Adam over windows as they come. The model's weights become parts of one array."""

    def __init__(self, model: Model):
        self.model, self.steps, self.windows = model, 0, 0
        self.flat, at = packed(model.w), 0
        for k in sorted(model.w):
            x = model.w[k]
            model.w[k] = self.flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.first, self.second, self.root = (np.zeros_like(self.flat) for _ in range(3))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def feed(self, leaves: np.ndarray) -> None:
        """A run of leaves: the first is only looked back on."""
        self.feed_windows(leaves[: WINDOW + 1], np.zeros(1, np.int64))

    def feed_windows(self, leaves: np.ndarray, which: np.ndarray) -> None:
        """Those windows, by their numbers, that a run of leaves is cut into; the run's first leaf is only looked back on."""
        n = len(leaves) - 1
        cut = np.zeros((2, max(1, -(-n // WINDOW)) * WINDOW), np.int32)
        cut[0, :n], cut[1, :n] = leaves[:-1], leaves[1:]
        x, y = cut.reshape(2, -1, WINDOW)
        self.held.append((x[which], y[which], (which[:, None] * WINDOW + np.arange(WINDOW) < n).astype(np.float32)))
        self.waiting += len(which)
        if self.waiting >= STEP:
            every = [np.concatenate(a) for a in zip(*self.held)]
            for k in range(0, self.waiting - STEP + 1, STEP):
                self._step(*(a[k : k + STEP] for a in every))
            rest = self.waiting % STEP
            self.held, self.waiting = [tuple(a[len(a) - rest :] for a in every)] if rest else [], rest

    def step(self) -> float:
        """On what is left."""
        if not self.waiting:
            return 0.0
        every = [np.concatenate(a) for a in zip(*self.held)]
        self.held, self.waiting = [], 0
        return self._step(*every)

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        self.steps, self.windows = self.steps + 1, self.windows + len(x)
        loss, g = self.model.gradients(x, y, weight)
        self.model._bias = None
        rate = RATE * np.sqrt(1 - 0.98**self.steps) / (1 - 0.9**self.steps)
        own, first, second, root = packed(g), self.first, self.second, self.root
        first *= np.float32(0.9)
        np.multiply(own, np.float32(0.1), out=root)
        first += root
        second *= np.float32(0.98)
        own *= own
        own *= np.float32(0.02)
        second += own
        np.sqrt(second, out=root)
        root += np.float32(1e-8)
        np.divide(first, root, out=root)
        root *= np.float32(rate)
        self.flat -= root
        return loss


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    """A copy of its own, as float32."""
    found, k = {}, 0
    for name, x in sorted(initial().items()):
        found[name] = flat[k : k + x.size].reshape(x.shape).astype(np.float32)
        k += x.size
    return found
