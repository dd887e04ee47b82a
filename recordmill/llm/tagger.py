"""A character-level bidirectional LSTM with a CRF over its emissions, trained and run in numpy.

Windows have a fixed length; what is past a text's end is PAD, a character like others whose tag is 0. Tags are 0 for
outside, then B and I of each kind; I follows B or I of its kind, or starts a window that cuts a span.
"""

from __future__ import annotations

import functools
import io

import numpy as np

EMBED, HIDDEN = 16, 24
#: Classes of characters: PAD, one for each printable ASCII character, then space-like, letters and all others.
PAD, _FIRST, SPACE_CLASS, LETTER_CLASS, OTHER_CLASS = 0, 1, 96, 97, 98
CLASSES = 99
#: Fixed values of the fit.
BATCH, STEPS, RATE, SEED = 64, 320, 0.012, 11


@functools.cache
def _class_of() -> np.ndarray:
    """The class of every code point."""
    rest = (SPACE_CLASS if c.isspace() else LETTER_CLASS if c.isalpha() else OTHER_CLASS for c in map(chr, range(0x110000)))
    out = np.fromiter(rest, np.uint8, 0x110000)
    out[32:127] = np.arange(95) + _FIRST
    return out


def classes(text: str, length: int) -> np.ndarray:
    codes = np.frombuffer(text[:length].encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(length, PAD, np.int64)
    out[: len(codes)] = _class_of()[codes]
    return out


def allowed(kinds: int) -> np.ndarray:
    """1 where tag j may follow tag i."""
    n = 1 + 2 * kinds
    ok = np.ones((n, n), np.float32)
    for k in range(kinds):
        inside = 2 + 2 * k
        ok[:, inside] = 0
        ok[[inside - 1, inside], inside] = 1
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _live(s: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
    """How many windows, longest first, have a character at each time."""
    return np.full(len(s), s.shape[1]) if sizes is None else len(sizes) - np.searchsorted(sizes[::-1], np.arange(len(s)), "right")


class Tagger:
    def __init__(self, kinds: int, rng: np.random.Generator | None = None) -> None:
        rng = rng or np.random.default_rng(SEED)
        n, make = 1 + 2 * kinds, lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.kinds = kinds
        self.w = {"embed": make(CLASSES, EMBED) * 3, "out": make(2 * HIDDEN, n), "bias": np.zeros(n, np.float32), "steps": np.zeros((n, n), np.float32), "start": np.zeros(n, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": make(EMBED, 4 * HIDDEN), f"h{d}": make(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remembers at first
        self.ok = allowed(kinds)

    def dumps(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, kinds=self.kinds, **self.w)
        return held.getvalue()

    @staticmethod
    def loads(data: bytes) -> Tagger:
        held = np.load(io.BytesIO(data))
        own = Tagger(int(held["kinds"]))
        own.w = {k: held[k] for k in own.w}
        return own

    # One direction: x is time x batch x EMBED

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        length, batch, _ = x.shape
        z0 = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h = c = np.zeros((batch, HIDDEN), z0.dtype)
        hs, kept = np.empty((length, batch, HIDDEN), z0.dtype), []
        for t in range(length):
            z = z0[t] + h @ self.w[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            kept.append((i, f, o, g, before, tc, last))
        return hs, kept

    def _back(self, x: np.ndarray, d: str, kept: list, dhs: np.ndarray, grads: dict) -> np.ndarray:
        dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), x.dtype)
        dh = dc = np.zeros((x.shape[1], HIDDEN), x.dtype)
        dwh = np.zeros_like(self.w[f"h{d}"])
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, tc, last = kept[t]
            dh = dh + dhs[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            dwh += last.T @ dz
            dh, dc = dz @ self.w[f"h{d}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"x{d}"], grads[f"h{d}"], grads[f"c{d}"] = x.reshape(-1, EMBED).T @ flat, dwh, flat.sum(0)
        return dz_all @ self.w[f"x{d}"].T

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """time x batch x tags of windows (batch x time)."""
        x = self.w["embed"][ids.T]
        forward, kept_f = self._run(x, "f")
        back, kept_b = self._run(x[::-1], "b")
        both = np.concatenate([forward, back[::-1]], axis=2)
        return both @ self.w["out"] + self.w["bias"], (x, both, kept_f, kept_b)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """time x tags x windows: what emissions gives for windows of several lengths, longest first, each run on its own
        length. What lies past a window's end means nothing.

        Gates are rows and windows columns; a step is one product with the state, the embedded character and a one for
        the bias. A sigmoid is a tanh of the half: gates and outputs are kept doubled, weights take halves of them.
        """
        n, length = len(rows), len(rows[0])
        ids = np.zeros((n, length), np.uint8)
        for own, r in zip(ids, rows, strict=True):
            own[: len(r)] = r
        ids = np.ascontiguousarray(ids.T)
        embed = np.ascontiguousarray(self.w["embed"].T)
        half = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, 0.5, 1).astype(np.float32)[:, None]
        out = np.empty((length, len(self.w["bias"]), n), np.float32)
        live = [*_live(out, np.array([len(r) for r in rows])), 0]
        z, c, g, e = (np.empty((k, n), np.float32) for k in (4 * HIDDEN, HIDDEN, HIDDEN, out.shape[1]))
        i, f, o, new = (z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        state = np.ones((HIDDEN + EMBED + 1, n), np.float32)
        h, x = state[:HIDDEN], state[HIDDEN:-1]
        for d, heads in (("f", self.w["out"][:HIDDEN]), ("b", self.w["out"][HIDDEN:])):
            step = half * np.concatenate([self.w[f"h{d}"].T / 2, self.w[f"x{d}"].T, self.w[f"c{d}"][:, None]], axis=1)
            heads = np.ascontiguousarray(heads.T / 2)
            h[:] = c[:] = 0
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                if d == "b":  # windows that end here begin
                    h[:, live[t + 1] : live[t]] = c[:, live[t + 1] : live[t]] = 0
                embed.take(ids[t], axis=1, out=x, mode="clip")
                np.tanh(np.matmul(step, state, out=z), out=z)
                np.add(z[: 3 * HIDDEN], 1, out=z[: 3 * HIDDEN])
                np.multiply(c, f, out=c)
                np.add(c, np.multiply(i, new, out=g), out=c)
                np.multiply(c, np.float32(0.5), out=c)
                np.multiply(o, np.tanh(c, out=g), out=h)
                np.matmul(heads, h, out=e)
                np.add(e, self.w["bias"][:, None] if d == "f" else out[t], out=out[t])
        return out

    def hopeful(self, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Windows (columns of scores, longest first) that can have another best path than all tags 0; the others need no Viterbi.

        For B and for I, the most that a run of tags other than 0 that ends in one of them can gain over zeros; a character
        counts with the best of all kinds, a step with the greatest value of its sort, steps from run to run included.
        """
        steps = (np.where(self.ok > 0, self.w["steps"], -np.inf) - self.w["steps"][0, 0]).astype(np.float32)
        enter, again, leave = steps[0, 1::2].max(), steps[1:, 1::2].max(), steps[1:, 0].max()
        first, more = np.diagonal(steps[1::2, 2::2]).max(), np.diagonal(steps[2::2, 2::2]).max()
        begin = self.w["start"][1:] - self.w["start"][0]
        live = [*_live(s, sizes).tolist(), 0]
        b, i, most, going, spare, top = np.full((6, len(sizes)), -np.inf, np.float32)  # top: of runs to a window's end
        k = 0
        for t in range(len(s)):
            if t % 32 == 0:  # gains of some times at once, each with a step
                part = s[t : t + 32, :, : live[t]]
                gain_b, gain_i = part[:, 1::2].max(axis=1) - part[:, 0] + again, part[:, 2::2].max(axis=1) - part[:, 0] + more
            if live[t] != k:
                k = live[t]
                own_b, own_i, own_most, own_going, own_spare = b[:k], i[:k], most[:k], going[:k], spare[:k]
            up_b, up_i = gain_b[t % 32][:k], gain_i[t % 32][:k]
            if t:
                np.maximum(own_going, own_most, out=own_going)
                np.maximum(own_i, np.add(own_b, first - more, out=own_spare), out=own_i)
                np.add(own_i, up_i, out=own_i)
                np.maximum(own_most, enter - again, out=own_b)
                np.add(own_b, up_b, out=own_b)
            else:
                np.add(up_b, begin[::2].max() - again, out=own_b)
                np.add(up_i, begin[1::2].max() - more, out=own_i)
            np.maximum(own_b, own_i, out=own_most)
            if live[t + 1] < k:
                top[live[t + 1] : k] = most[live[t + 1] : k]
        return np.maximum(top, going + leave) > -2e-3

    def _chains(self, s: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """exp of emissions and steps, and normed forward and backward sums."""
        e = np.exp(s - s.max(axis=2, keepdims=True))
        steps = np.exp(self.w["steps"]) * self.ok
        alpha, beta, live = np.empty_like(e), np.ones_like(e), _live(s, sizes)
        a = np.exp(self.w["start"]) * e[0]
        alpha[0] = a / a.sum(1, keepdims=True)
        for t in range(1, len(e)):
            a = (alpha[t - 1] @ steps) * e[t]
            alpha[t] = a / a.sum(1, keepdims=True)
        for t in range(len(e) - 1, 0, -1):
            b = (beta[t, : live[t]] * e[t, : live[t]]) @ steps.T
            beta[t - 1, : live[t]] = b / b.sum(1, keepdims=True)
        return e, steps, alpha, beta

    def marginals(self, s: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """time x batch x tags; sizes are the windows' lengths, longest first, where they differ."""
        _, _, alpha, beta = self._chains(s, sizes)
        m = alpha * beta
        return m / m.sum(axis=2, keepdims=True)

    def best(self, s: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """The best allowed tags (batch x time) by Viterbi; sizes as for marginals."""
        steps = np.where(self.ok > 0, self.w["steps"], -1e9).astype(np.float32).T
        live = _live(s, sizes)
        score, came, rows = self.w["start"] + s[0], [], np.arange(s.shape[1])
        for t in range(1, len(s)):
            through = score[: live[t], None] + steps
            came.append(through.argmax(2).astype(np.int8))
            score[: live[t]] = through.max(2) + s[t, : live[t]]
        tags = np.zeros((s.shape[1], len(s)), np.int64)
        now = score.argmax(1)
        for t in range(len(s) - 1, -1, -1):
            if t < len(s) - 1:
                k = live[t + 1]
                now[:k] = came[t][rows[:k], now[:k]]
            tags[: live[t], t] = now[: live[t]]
        return tags

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of tags (batch x time)."""
        batch = len(ids)
        s, (x, both, kept_f, kept_b) = self.emissions(ids)
        e, steps, alpha, beta = self._chains(s)
        m = alpha * beta
        m /= m.sum(axis=2, keepdims=True)
        right = beta[1:] * e[1:]
        pairs = alpha[:-1]
        norm = ((pairs @ steps) * right).sum(axis=2, keepdims=True)
        n = s.shape[2]
        expected = steps * (pairs.reshape(-1, n).T @ (right / norm).reshape(-1, n))
        at = tags.T
        ds = m
        np.put_along_axis(ds, at[:, :, None], np.take_along_axis(ds, at[:, :, None], 2) - 1, 2)
        ds /= batch
        seen = np.zeros((n, n), np.float32)
        np.add.at(seen, (at[:-1], at[1:]), 1)
        grads = {"steps": (expected - seen) / batch * self.ok, "start": ds[0].sum(0), "out": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, n), "bias": ds.sum((0, 1))}
        dboth = ds @ self.w["out"].T
        dx = self._back(x, "f", kept_f, dboth[:, :, :HIDDEN], grads) + self._back(x[::-1], "b", kept_b, dboth[::-1, :, HIDDEN:], grads)[::-1]
        grads["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(grads["embed"], ids.T.reshape(-1), dx.reshape(-1, EMBED))
        return grads

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> float:
        """The mean negative log-likelihood, in double precision (for tests)."""
        s = self.emissions(ids)[0].astype(np.float64)
        steps = np.where(self.ok > 0, self.w["steps"], -np.inf).astype(np.float64)
        total, own = self.w["start"] + s[0], self.w["start"][tags[:, 0]] + s[0][np.arange(len(ids)), tags[:, 0]]
        for t in range(1, len(s)):
            total = np.logaddexp.reduce(total[:, :, None] + steps, axis=1) + s[t]
            own = own + steps[tags[:, t - 1], tags[:, t]] + s[t][np.arange(len(ids)), tags[:, t]]
        return float((np.logaddexp.reduce(total, axis=1) - own).mean())

    def fit(self, batch, steps: int = STEPS, rate: float = RATE) -> Tagger:
        """Adam over batches (ids, tags) that batch() gives."""
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            grads = self.gradients(*batch())
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (steps + 1)) ** 0.5
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self
