"""A small causal self-attention language model over subword ids, in numpy.

One attention layer with relative positions reads the last WINDOW tokens; its state chooses among KINDS
distributions over the vocabulary, and the next token's probability is their mixture:

    h_i = x_i + sum over j <= i of softmax(q_i k_j + bias[i - j]) v_j
    p(t | h) = sum over g of softmax(h G)_g P_g(t)

gather() is the expectation step alone, over texts of any number.  learn() takes it along with the layer's gradient (Adagrad),
a few windows at a time: so each executor passes over all its texts, and the layers that come of it are averaged.

Every P_g sums to one, so no sum over the vocabulary is needed to score a token.  The layer learns by gradient
(Adam), the distributions by expectation and maximisation from the same responsibilities; each leans on the
corpus's counts of subwords, which give unseen ones their share.

Outside training two things are cheaper than that.  weights() stands in for exp, so softmax has weights within
6.2 % of the exact ones; they are normalised, so probabilities sum to one all the same.  And the expectation
step over the corpus draws one kind for each token, with the responsibilities as chances, in place of
adding all KINDS shares: the sums have the same expectation.  The draw depends on the token, the one before it
and its place only, so it doesn't matter how texts are batched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens in a window, and those at its start that an earlier window has scored already (they are context only).
WINDOW, CONTEXT = 32, 8
WIDTH, KINDS = 16, 128
#: How many tokens each kind's lean on the corpus's counts is worth.
LEAN = 300.0
#: Windows that are scored together: so few that their kinds' weights stay in a core's cache.
AT_ONCE = 64
#: A float's bits, read as a whole number, grow by this much for each factor of e; one has the bits ONE.
SLOPE, ONE = np.float32(2**23 / np.log(2)), np.float32(127 * 2**23)
#: Logs that weights() tells apart: beyond them it gives the nearest.
FEWEST, MOST = np.float32(-80), np.float32(60)
#: How far learn() moves the layer, and what the squared slopes are taken to have come to before (so the first steps are no leaps).
RATE, REST = 0.03, 10.0
#: Rows of noise that draws choose among.
NOISE = 4096


def weights(scaled: np.ndarray, least: np.float32 | None = np.float32(0), into: np.ndarray | None = None) -> np.ndarray:
    """About exp(x) for scaled = SLOPE * x + ONE: 2^n (1 + f) where x is (n + f) ln 2.  Changes scaled; up to 0 gives 0.

    least: what scaled is raised to; None: all is known to be within MOST of 0, either way.  into: whole numbers of 32 bits that take the result, which is a view of them.
    """
    if least is not None:
        np.clip(scaled, least, ONE + MOST * SLOPE, out=scaled)
    into = np.empty(scaled.shape, np.int32) if into is None else into
    np.copyto(into, scaled, casting="unsafe")
    return into.view(np.float32)


_noise: list[np.ndarray] = []


def noise() -> np.ndarray:
    """(NOISE, KINDS): 1 / e for exponential e.  The place of the largest of shares times a row is a draw by the shares."""
    if not _noise:
        _noise.append((1 / np.random.default_rng(23).exponential(size=(NOISE, KINDS))).astype(np.float32))
    return _noise[0]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows that cover texts of these lengths, each token scored by one."""
    n = np.maximum(1, -(-(lengths - CONTEXT) // (WINDOW - CONTEXT)))
    n[lengths <= 0] = 0
    text = np.repeat(np.arange(len(lengths)), n)
    first = np.cumsum(n) - n
    return text, (np.arange(len(text)) - np.repeat(first, n)) * (WINDOW - CONTEXT)


@dataclass(frozen=True)
class Step:
    """What windows gave on the way to their kinds; scored: which of their places, counted through all windows.

    weight and read are no shares yet, read's last column has their sums.
    """

    given: np.ndarray
    scored: np.ndarray
    x: np.ndarray
    weight: np.ndarray
    values: np.ndarray
    read: np.ndarray
    state: np.ndarray


def _add(found: list[np.ndarray], into: np.ndarray) -> None:
    if found:
        at, n = np.unique(np.concatenate(found), return_counts=True)
        into.reshape(-1)[at] += n


def resting(layer: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Adagrad's sums before the first step."""
    return {k: np.full_like(v, REST) for k, v in layer.items()}


@dataclass
class Attention:
    layer: dict[str, np.ndarray]
    table: np.ndarray  # (vocabulary, KINDS): P
    start: int  # the token that stands before a text

    def logs(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of each token's probability given what stands before it in its text, text after text."""
        out = np.zeros(sum(len(t) for t in texts))
        held, one = self._buffer(), np.ones(self.table.shape[1], np.float32)
        for places, gate, _, target, *_ in self._gates(texts):
            shares = np.take(self.table, target, axis=0, out=held[: len(target)], mode="clip")
            out[places] = np.einsum("ij,ij->i", gate, shares) / (gate @ one)
        np.log10(out, out=out)
        return out

    def gather(self, texts: list[np.ndarray], into: np.ndarray) -> None:
        """Adds to into (vocabulary, KINDS) one for each token, at the kind drawn for it: the expectation step over texts."""
        found, held, room = [], self._buffer(), self._buffer()
        for _, gate, given, target, inside, _ in self._gates(texts):
            gate *= np.take(self.table, target, axis=0, out=held[: len(target)], mode="clip")
            found.append(self._drawn(gate, given, target, inside, room))
        _add(found, into)

    def learn(self, texts: list[np.ndarray], into: np.ndarray, squares: dict[str, np.ndarray], rate: float = RATE) -> None:
        """As gather(), and the layer moves by the gradient of each AT_ONCE windows in turn, with every scored token in it.

        The table stays.  squares: Adagrad's sums, as of resting(); they go on from call to call.
        """
        found, held, room, one = [], self._buffer(), self._buffer(), np.ones(self.table.shape[1], np.float32)
        for _, gate, given, target, inside, step in self._gates(texts, moving=True):
            total = gate @ one + _LEAST
            joint = np.take(self.table, target, axis=0, out=held[: len(target)], mode="clip")
            joint *= gate
            found.append(self._drawn(joint, given, target, inside, room))
            joint *= (total / (joint @ one + _LEAST))[:, None]
            gate -= joint  # the error, total times
            self._move(step, gate, 1 / total, squares, rate)
        _add(found, into)

    def _move(self, step: Step, error: np.ndarray, scale: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> None:
        slopes, rows, by_row = self._slopes(step, error, scale)
        for k, g in slopes.items():
            squares[k] += g * g
            self.layer[k] -= rate * g / (np.sqrt(squares[k]) + _LEAST)
        sums, embed = squares["embed"].take(rows, axis=0) + by_row * by_row, self.layer["embed"]
        squares["embed"][rows] = sums
        embed[rows] = embed.take(rows, axis=0) - rate * by_row / (np.sqrt(sums) + _LEAST)

    def _slopes(self, step: Step, error: np.ndarray, scale: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The loss's slopes of a step's windows, without the embedding; the tokens that have some there, and these.

        As _backward(), with weights() taken for exp.  error, times scale by row: the loss's slope at the gate's inputs, for the scored places.
        """
        layer, x, width = self.layer, step.x, step.x.shape[-1]
        flat = lambda a: a.reshape(-1, a.shape[-1])
        total = step.read[..., -1:] + _LEAST
        weight = step.weight / total
        own = np.zeros((len(error) + 1, width), np.float32)  # the last row is for places that are not scored
        np.matmul(error, layer["gate"].T, out=own[:-1])
        own[:-1] *= scale[:, None]
        spot = np.full(step.given.size, len(error))
        spot[step.scored] = np.arange(len(error))
        dh = own.take(spot, axis=0).reshape(x.shape)
        # Side by side, so that one product each takes the slopes to x and to the layer: through the pair's other token, its own, the value.
        moved = np.empty((*x.shape[:2], 3 * width), np.float32)
        np.matmul(weight.transpose(0, 2, 1), dh, out=moved[..., 2 * width :])
        ds = dh @ step.values[..., :-1].transpose(0, 2, 1)
        ds -= ((dh * step.read[..., :-1]) @ np.ones(width, np.float32))[..., None] / total
        ds *= weight
        np.matmul(ds.transpose(0, 2, 1), x, out=moved[..., :width])
        np.matmul(ds, x, out=moved[..., width : 2 * width])
        asks = layer["query"] @ layer["key"].T
        dx = flat(moved) @ np.vstack((asks, asks.T, layer["value"].T))
        dx += flat(dh)
        by_pair, by_choice = flat(x).T @ flat(moved)[:, width:], (error.T @ (step.state * scale[:, None])).T
        by_asks, by_value = by_pair[:, :width], by_pair[:, width:]
        by_ago = np.bincount(_BACK, (np.ones(len(ds), np.float32) @ ds.reshape(len(ds), -1))[_SEEN], WINDOW).astype(np.float32)
        tokens = step.given.ravel()
        order = np.argsort(tokens.astype(np.uint16) if len(layer["embed"]) <= 1 << 16 else tokens, kind="stable")  # sixteen bits sort faster
        sorted_tokens = tokens.take(order)
        first = np.append(0, np.flatnonzero(sorted_tokens[1:] != sorted_tokens[:-1]) + 1)
        slopes = {"query": by_asks @ layer["key"], "key": by_asks.T @ layer["query"], "value": by_value, "bias": by_ago, "gate": by_choice[:-1], "lean": by_choice[-1]}
        return slopes, sorted_tokens.take(first), np.add.reduceat(dx.take(order, axis=0), first, axis=0)

    def _drawn(self, joint: np.ndarray, given: np.ndarray, target: np.ndarray, inside: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The places in the table of the tokens and the kinds drawn for them.  joint: the kinds' shares; held: room."""
        row = (target * 2_654_435_761 + given * 40_503 + inside * 97) % NOISE
        drawn = np.take(noise(), row, axis=0, out=held[: len(target)], mode="clip")
        drawn *= joint
        return target * drawn.shape[1] + drawn.argmax(axis=1)

    def _buffer(self) -> np.ndarray:
        return np.empty((AT_ONCE * WINDOW, self.table.shape[1]), np.float32)

    def _gates(self, texts: list[np.ndarray], moving: bool = False):
        """For some tokens at a time, each once: their places in the texts' row, the kinds' weights (no softmax yet; good until
        the next ones), the tokens before them, the tokens, their places in the text, and the Step they come from.

        As _forward(), for the scored places only, with sums taken by the matrix products.  moving: the layer changes meanwhile.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        if not lengths.sum():
            return
        target = np.concatenate(texts).astype(np.int64)
        base = np.cumsum(lengths) - lengths
        given = np.empty_like(target)
        given[1:] = target[:-1]
        given[base[lengths > 0]] = self.start
        text, begin = windows(lengths)
        place, embed = np.arange(WINDOW), self.layer["embed"]
        width = embed.shape[1]
        middle = np.append(np.zeros(width, np.float32), ONE)[:, None]
        turned, bias, choice = self._scaled()
        # Large arrays are made once: fresh memory for each step would cost more than the sums.
        size = AT_ONCE * WINDOW
        state, gates, bits = np.ones((size, len(choice)), np.float32), np.empty((size, choice.shape[1]), np.float32), np.empty((size, choice.shape[1]), np.int32)
        for at in range(0, len(text), AT_ONCE):
            if moving and at:
                turned, bias, choice = self._scaled()
            t, b = text[at : at + AT_ONCE], begin[at : at + AT_ONCE]
            inside = b[:, None] + place
            real = inside < lengths[t][:, None]
            index = np.where(real, base[t][:, None] + inside, base[t][:, None])
            scored = np.flatnonzero(real & ((b == 0)[:, None] | (place >= CONTEXT)))  # take() by these is faster than [] by masks
            places = index.take(scored)
            before = given.take(index)
            flat = embed.take(before.ravel(), axis=0)
            x = flat.reshape(*index.shape, width)
            both = flat @ turned
            both[:, -1] = 1
            both = both.reshape(*index.shape, 2 * width + 1)
            values = both[..., width:]
            weight = both[..., :width] @ x.transpose(0, 2, 1)
            weight += bias
            weight = weights(weight)
            read = weight @ values
            n, own = len(places), read.reshape(-1, width + 1).take(scored, axis=0)
            np.divide(own[:, :-1], own[:, -1:] + _LEAST, out=state[:n, :-1])
            state[:n, :-1] += flat.take(scored, axis=0)
            gate = np.matmul(state[:n], choice, out=gates[:n])
            furthest = np.abs(state[:n]).max(axis=0) @ np.abs(choice - middle)
            least = None if furthest.max() < MOST * SLOPE else ONE + FEWEST * SLOPE
            yield places, weights(gate, least, bits[:n]), given.take(places), target.take(places), inside.take(scored), Step(before, scored, x, weight, values, read, state[:n])

    def _scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What gives weights() their inputs: for pairs of tokens (with what gives values beside it, and room for ones), by distance, for kinds."""
        layer = self.layer
        asks = layer["query"] @ layer["key"].T * SLOPE
        bias = np.full(_AGO.size, -1e30, np.float32)
        bias[_SEEN] = (layer["bias"] * SLOPE + ONE).take(_BACK)
        return np.hstack((asks, layer["value"], np.zeros((len(asks), 1), np.float32))), bias.reshape(_AGO.shape), np.vstack((layer["gate"] * SLOPE, layer["lean"] * SLOPE + ONE))  # lean has a component of its own, always one

    def _mixture(self, gate: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.einsum("wig,wig->wi", gate, self.table[target])


#: A share too small to count.
_LEAST = np.float32(1e-30)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _scatter(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """into[at] += rows, where places repeat."""
    order = np.argsort(at, kind="stable")
    kinds, first = np.unique(at[order], return_index=True)
    into[kinds] += np.add.reduceat(rows[order], first, axis=0)


_AGO = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
#: The pairs of a window's places whose first sees the second, and how far back that is.
_SEEN = np.flatnonzero(_AGO >= 0)
_BACK = _AGO.ravel()[_SEEN]


def _forward(layer: dict[str, np.ndarray], given: np.ndarray) -> dict[str, np.ndarray]:
    """given: (windows, WINDOW) tokens.  A window's padding comes last, and no earlier place sees it."""
    x = layer["embed"][given]
    q, k, v = x @ layer["query"], x @ layer["key"], x @ layer["value"]
    bias = np.where(_AGO >= 0, layer["bias"][np.maximum(_AGO, 0)], np.float32(-1e9))
    weight = _softmax(q @ k.transpose(0, 2, 1) + bias)
    h = x + weight @ v
    return {"x": x, "q": q, "k": k, "v": v, "weight": weight, "h": h, "gate": _softmax(h @ layer["gate"] + layer["lean"])}


def _backward(layer: dict[str, np.ndarray], given: np.ndarray, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
    """error: the loss's slope at the gate's inputs."""
    flat = lambda a: a.reshape(-1, a.shape[-1])
    dh = error @ layer["gate"].T
    dv = f["weight"].transpose(0, 2, 1) @ dh
    dw = dh @ f["v"].transpose(0, 2, 1)
    ds = f["weight"] * (dw - (dw * f["weight"]).sum(axis=-1, keepdims=True))
    dq, dk = ds @ f["k"], ds.transpose(0, 2, 1) @ f["q"]
    dx = dh + dq @ layer["query"].T + dk @ layer["key"].T + dv @ layer["value"].T
    by_ago = np.bincount(np.maximum(_AGO, 0).ravel(), np.where(_AGO >= 0, ds.sum(axis=0), 0).ravel(), WINDOW)
    embed = np.zeros_like(layer["embed"])
    _scatter(embed, given.ravel(), flat(dx))
    x = flat(f["x"])
    return {"embed": embed, "query": x.T @ flat(dq), "key": x.T @ flat(dk), "value": x.T @ flat(dv), "bias": by_ago.astype(np.float32), "gate": flat(f["h"]).T @ flat(error), "lean": flat(error).sum(axis=0)}


def shares_of(counts: np.ndarray) -> np.ndarray:
    return ((counts + 0.5) / (counts.sum() + 0.5 * len(counts))).astype(np.float32)


def leant(sums: np.ndarray, unigram: np.ndarray, lean: float = LEAN) -> np.ndarray:
    """The table of the kinds: gathered sums (vocabulary, KINDS), each kind leaning on the corpus's shares."""
    return ((sums + lean * unigram[:, None]) / (sums.sum(axis=0) + lean)).astype(np.float32)


def rows_of(text: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a text (with its end): the tokens before each place, those at it, and which places are real."""
    begin = windows(np.array([len(text)]))[1]
    inside = begin[:, None] + np.arange(WINDOW)
    real = inside < len(text)
    index = np.where(real, inside, 0)
    given = np.concatenate(([start], text[:-1])).astype(np.int64)
    return given[index], text.astype(np.int64)[index], real


def train(given: np.ndarray, target: np.ndarray, real: np.ndarray, counts: np.ndarray, start: int, steps: int = 1500, batch: int = 384, rate: float = 0.03, lean: float = LEAN, seed: int = 5) -> Attention:
    """given, target, real: windows as of rows_of().  counts: of each token in the corpus; lean: see LEAN."""
    rng = np.random.default_rng(seed)
    size = len(counts)
    unigram = shares_of(counts)
    make = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    layer = {"embed": make(size, WIDTH), "query": make(WIDTH, WIDTH), "key": make(WIDTH, WIDTH), "value": make(WIDTH, WIDTH), "bias": np.zeros(WINDOW, np.float32), "gate": make(WIDTH, KINDS), "lean": np.zeros(KINDS, np.float32)}
    if not len(given):
        return Attention(layer, np.repeat(unigram[:, None], KINDS, axis=1), start)
    held = unigram[:, None] * rng.gamma(1.0, size=(size, KINDS)).astype(np.float32) * lean
    kept = held.sum(axis=0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in layer.items()}
    fresh = np.float32(1.0)

    def shares(tokens):
        return (held[tokens] + lean * unigram[tokens][..., None]) / (kept + lean)

    for step in range(1, steps + 1):
        pick = rng.integers(0, len(given), batch)
        here, seen, at = given[pick], real[pick], target[pick]
        f = _forward(layer, here)
        joint = f["gate"] * shares(at)
        answer = joint / joint.sum(axis=-1, keepdims=True)
        error = ((f["gate"] - answer) * seen[..., None] / seen.sum()).astype(np.float32)
        # Later batches count for more: what was learnt from early, worse responsibilities fades.
        fresh *= np.float32(1.02)
        add = answer[seen] * fresh
        _scatter(held, at[seen], add)
        kept += add.sum(axis=0)
        if fresh > 50 or step == steps:
            held /= fresh
            kept /= fresh
            fresh = np.float32(1.0)
        down = min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in _backward(layer, here, f, error).items():
            m, v = moments[k]
            rows = np.flatnonzero(g.any(axis=1)) if k == "embed" else slice(None)  # Adam moves the tokens at hand only
            m[rows] += 0.1 * (g[rows] - m[rows])
            v[rows] += 0.01 * (g[rows] ** 2 - v[rows])
            layer[k][rows] -= rate * down * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)
    return Attention(layer, shares(np.arange(size)).astype(np.float32), start)
