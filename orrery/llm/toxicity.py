"""Operator 3, a toxicity classifier: a bidirectional gated recurrent network with attention pooling.

A word is read by its place in a learned vocabulary and by its runs of five characters, so
unknown words and inflected ones are read as well. Two gated recurrent networks pass over a
window of words, one from either end; attention pools their states into one logit. All
overlapping windows of a text are scored, each step for thousands of windows at once; the text's
score is a calibrated logistic of its worst window. Trained in numpy, by hand-written gradients.

Only whole texts carry labels. Words, and beginnings of words, that occur in a far larger share of toxic than of clean
training texts point to the windows that a toxic label is about; the network is trained on those
against all windows of clean texts, and again with the clean windows that it takes for toxic ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import beside_text, lanes, mix64, text_chunks, utf8, word_hashes
from orrery.llm.labelled import logistic, sample

#: Labelled texts that the network is fitted on, at most: clean ones, toxic ones.
PER_CLASS = (1000, 400)
MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.3
WINDOW, STRIDE = 16, 8
WORD_DIM, CHAR_DIM, CHAR_ROWS, HIDDEN, ATTEND = 8, 4, 1 << 16, 8, 8
#: Windows that one numpy step works on: of scoring, of training. Passes over the training windows
#: and the least number of steps that they take together; parts that in turn place the curve.
BATCH, STEP, EPOCHS, STEPS, FOLDS = 4096, 512, 6, 200, 2
#: Bytes of the beginnings of words that may tell toxic texts.
STEMS = (5, 7)

# ---------------------------------------------------------------- words

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters; anything else stays."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        late = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][late] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and starts, ends and row offsets of the runs of letters and digits."""
    data = _fold(data)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    word = _IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return data, s, e, np.searchsorted(s, offsets)


def char_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of the character table for the five bytes that end at each byte; what is no part of that
    byte's word is 0."""
    word = _IS_WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    index = np.arange(len(data))
    place = index - np.maximum.accumulate(np.where(begins, index, 0))
    code = np.where(word, data, 0).astype(np.uint64)
    out, back = code.copy(), code
    for k in range(1, 5):
        back = np.concatenate([np.zeros(1, np.uint64), back[:-1]])
        out = out * np.uint64(0x100000001B3) + np.where(place >= k, back, np.uint64(0))
    return (mix64(out) % np.uint64(CHAR_ROWS)).astype(np.int64)


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and how many windows each row has (at least one)."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), n)
    return (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE, n


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def initial(rng: np.random.Generator, n_words: int) -> dict[str, np.ndarray]:
    d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTEND
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    # what is never trained must say little
    p = {"word": normal(n_words + 1, WORD_DIM, scale=0.03), "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.03)}
    p["word"][0] = 0  # unknown words
    for k in "fb":
        p |= {f"W{k}": normal(d, 3 * h, scale=d**-0.5), f"U{k}": normal(h, 3 * h, scale=h**-0.5), f"b{k}": np.zeros(3 * h, np.float32)}
    return p | {"A": normal(2 * h, a, scale=0.3), "a": np.zeros(a, np.float32), "v": normal(a, scale=0.3), "o": normal(2 * h, scale=0.3), "c": np.zeros(1, np.float32)}


def _pass(x: np.ndarray, mask: np.ndarray, u: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """States of one gated pass over ``x[t, window, 3h]`` (inputs already projected)."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
    two = 2 * HIDDEN
    for t in order:
        g = h @ u
        zr = _sigmoid(x[t, :, :two] + g[:, :two])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[t, :, two:] + r * g[:, two:])
        m = mask[t]
        new = h + m * (1 - z) * (n - h)
        if keep is not None:
            keep.append((t, h, z, r, n, g[:, two:], m))
        out[t] = h = new
    return out


def forward(p: dict, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; ``mask[t, window, 1]`` is 0 past a text's end."""
    steps = range(len(mask))
    trace = ([], []) if keep is not None else (None, None)
    h = np.concatenate([_pass(xf, mask, p["Uf"], steps, trace[0]), _pass(xb, mask, p["Ub"], steps[::-1], trace[1])], axis=2)
    e = np.tanh(h @ p["A"] + p["a"])
    s = e @ p["v"] + (mask[:, :, 0] - 1) * np.float32(30)
    s = np.exp(s - s.max(axis=0))
    w = s / s.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, h) * mask[0]
    if keep is not None:
        keep |= {"f": trace[0], "b": trace[1], "h": h, "e": e, "w": w, "pooled": pooled}
    return pooled @ p["o"] + p["c"][0]


def backward(p: dict, k: dict, mask: np.ndarray, dlogit: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the parameters, and of the projected inputs of both passes."""
    g = {"o": k["pooled"].T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["o"] * mask[0]
    dw = np.einsum("bh,tbh->tb", dpool, k["h"])
    dh = k["w"][:, :, None] * dpool
    ds = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
    de = ds[:, :, None] * p["v"] * (1 - k["e"] ** 2)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    g |= {"v": np.einsum("tb,tba->a", ds, k["e"]), "A": flat(k["h"]).T @ flat(de), "a": flat(de).sum(axis=0)}
    dh = dh + de @ p["A"].T
    out = []
    for name, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        u, carry = p["U" + name], np.zeros_like(dh[0, :, :HIDDEN])
        du, dx = np.zeros_like(u), np.zeros((*mask.shape[:2], 3 * HIDDEN), np.float32)
        for t, h, z, r, n, gn, m in reversed(k[name]):
            d = dh[t, :, part] + carry
            dn = d * m * (1 - z) * (1 - n**2)
            dz = -d * m * (n - h) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dg
            carry = d * (1 - m * (1 - z)) + dg @ u.T
        g["U" + name] = du
        out.append(dx)
    return g, out[0], out[1]


@dataclass
class Model:
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the vocabulary
    p: dict = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    # ------------------------------------------------ inputs

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table, 0 for unknown words."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def char_means(self, data: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros((0, CHAR_DIM), np.float32)
        # the last row closes the last word; sums between words are left out
        rows = np.concatenate([self.p["char"][char_rows(data, offsets)], np.zeros((1, CHAR_DIM), np.float32)])
        return np.add.reduceat(rows, np.column_stack([s, e]).ravel(), axis=0)[::2] / (e - s).astype(np.float32)[:, None]


    # ------------------------------------------------ scoring

    def logits(self, texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of some texts, and how many windows each has."""
        data, s, e, rows = words(*texts)
        first, n = window_starts(np.diff(rows))
        if not self.p:
            return np.zeros(len(first), np.float32), n
        p, ids = self.p, self.ids(word_hashes(data, s, e, False))
        chars = self.char_means(data, texts[1], s, e)
        joint = np.concatenate([p["Wf"], p["Wb"]], axis=1)
        bias = np.concatenate([p["bf"], p["bb"]])
        by_word = p["word"] @ joint[:WORD_DIM] + bias
        x = by_word[ids] + chars @ joint[WORD_DIM:]
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        at = first + np.repeat(rows[:-1], n)
        end = np.repeat(rows[1:], n)
        out = np.empty(len(at), np.float32)
        three = 3 * HIDDEN
        for i in range(0, len(at), BATCH):
            index = at[i : i + BATCH] + np.arange(WINDOW)[:, None]
            inside = index < end[i : i + BATCH]
            got = x[np.where(inside, index, len(x) - 1)]
            out[i : i + BATCH] = forward(p, got[:, :, :three], got[:, :, three:], inside[:, :, None].astype(np.float32))
        return out, n

    def window_logits(self, texts: "_Texts", windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of some windows of texts whose different words have the rows ``ids``."""
        p, spot_edge = self.p, texts.spots(np.arange(len(texts.hashes)))
        chars = np.add.reduceat(p["char"][spot_edge[0]], spot_edge[1], axis=0) / texts.length[:, None]
        x = np.concatenate([p["word"][ids], chars], axis=1).astype(np.float32)
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        xf, xb = x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]
        out = np.empty(len(windows), np.float32)
        for i in range(0, len(windows), BATCH):
            some = windows[i : i + BATCH]
            grid = texts.begin[some] + np.arange(WINDOW)[:, None]
            inside = grid < texts.stop[some]
            at = np.where(inside, texts.word[np.minimum(grid, len(texts.word) - 1)], len(texts.hashes))
            out[i : i + BATCH] = forward(p, xf[at], xb[at], inside[:, :, None].astype(np.float32))
        return out

    def worst(self, texts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out, n = self.logits(texts)
        return np.maximum.reduceat(out, np.cumsum(n) - n) if len(n) else np.zeros(0, np.float32)

    def scores(self, texts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rounded, so that a text's place among others leaves no trace."""
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts).astype(np.float64) + self.offset, -40, 40))), 4)


# ---------------------------------------------------------------- training


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


class _Texts:
    """Labelled texts, cut into words and windows."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.y = np.array([r[0] for r in rows])
        parts = []  # a hundred texts at a time, to bound what the driver holds
        for i in range(0, len(rows), 100):
            column = _column([t for _, t in rows[i : i + 100]])
            d, ws, we, wa = words(*column)
            parts.append((d, ws, we, np.diff(wa), word_hashes(d, ws, we, False), char_rows(d, column[1]).astype(np.uint16)))
        self.hashes, self.word = np.unique(np.concatenate([x[4] for x in parts]), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate([x[3] for x in parts]))])
        # of each different word its rows of the character table, from one place where it stands
        chars, length, done = [], np.zeros(len(self.hashes), np.int64), np.zeros(len(self.hashes), bool)
        place, heads = np.zeros(len(self.hashes), np.int64), np.zeros((len(STEMS), len(self.hashes)), np.uint64)
        shift, total = 0, 0
        for d, ws, we, _, h, c in parts:
            own, one = np.unique(self.word[shift : shift + len(h)], return_index=True)
            own, one = own[~done[own]], one[~done[own]]
            done[own] = True
            n = we[one] - ws[one]
            chars.append(c[np.repeat(ws[one] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            length[own], place[own] = n, total + np.cumsum(n) - n
            eight = lanes(d)[ws[one]]
            for k, size in enumerate(STEMS):
                some = np.minimum(n, size).astype(np.uint64)
                heads[k, own] = eight & ((np.uint64(1) << np.uint64(8) * some) - np.uint64(1)) | some << np.uint64(56)
            shift, total = shift + len(h), total + int(n.sum())
        self.chars, self.length, self.place = np.concatenate([*chars, np.zeros(0, np.uint16)]), length, place
        #: of each different word its number among all beginnings of words
        self.stems = np.unique(heads, return_inverse=True)[1].reshape(heads.shape)
        #: texts that are no copies of earlier ones, as far as the least hashes of their words tell
        self.own, seen = np.ones(len(rows), bool), set()
        for r in range(len(rows)):
            w = self.hashes[np.unique(self.word[self.at[r] : self.at[r + 1]])]
            bands = [(int(self.y[r]), k, *np.sort(mix64(w ^ np.uint64(k)))[:2].tolist()) for k in range(1, 5)] if len(w) > 1 else []
            self.own[r] = not any(b in seen for b in bands)
            seen.update(bands)
        first, n = window_starts(np.diff(self.at))
        self.owner = np.repeat(np.arange(len(rows)), n)
        self.begin = first + np.repeat(self.at[:-1], n)
        self.stop = np.minimum(self.begin + WINDOW, np.repeat(self.at[1:], n))

    def spots(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the character table of these words, end to end, and where each word's begin."""
        n = self.length[some]
        edge = np.cumsum(n) - n
        return self.chars[np.repeat(self.place[some] - edge, n) + np.arange(n.sum())].astype(np.int64), edge


def _telling(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How surely things that ``bad`` toxic and ``good`` clean texts have point to toxic ones, 0 where not.

    The log likelihood ratio of their share against that of all things, less what the luckiest of
    as many things with as many texts would reach by chance; a tenth of that chance at most.
    """
    n, q = bad + good, max(1e-6, bad.sum() / max(1, (bad + good).sum()))
    share = (bad + 0.5 * q) / (n + 0.5)
    ratio = bad * np.log(np.maximum(share, 1e-12) / q) + good * np.log(np.maximum(1 - share, 1e-12) / (1 - q))
    alike = np.bincount(np.minimum(n, 1000))[np.minimum(n, 1000)]
    sure = ratio - np.log(np.maximum(alike, 1))
    return np.where((bad >= 2) & (share > 2 * q) & (sure > np.log(10)), sure, 0.0)


def _weights(texts: _Texts, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different word how surely it, or its beginning, points to toxic texts, and how many of
    the texts ``train`` have it; copies count once."""
    having, starting = (np.zeros((2, n), np.int64) for n in (len(texts.hashes), texts.stems.max(initial=-1) + 1))
    for r in np.flatnonzero(train & texts.own):
        own = np.unique(texts.word[texts.at[r] : texts.at[r + 1]])
        having[texts.y[r], own] += 1
        starting[texts.y[r], np.unique(texts.stems[:, own])] += 1
    word, stem = (_telling(x[1], x[0]) for x in (having, starting))
    return np.maximum(word, stem[texts.stems].max(axis=0)), having.sum(axis=0)


def _network(texts: _Texts, train: np.ndarray, seed: int) -> Model:
    """The network trained on the texts ``train``, not yet calibrated. Every window of clean texts and
    every telling one of toxic texts takes part."""
    rng = np.random.default_rng(seed)
    weight, having = _weights(texts, train)
    kept = having >= max(3, int(0.004 * train.sum()))
    model = Model(known=texts.hashes[kept])
    p = model.p = initial(rng, len(model.known))
    # the table of words begins with what the texts tell
    p["word"][1:, 0] = np.minimum(weight[kept], 20) / 10
    if not len(texts.word):
        return model
    ids = model.ids(texts.hashes)
    run = np.concatenate([[0.0], np.cumsum(weight[texts.word])])
    heavy = run[texts.stop] - run[texts.begin]
    most = np.zeros(len(texts.y))
    np.maximum.at(most, texts.owner, heavy)
    toxic = (texts.y[texts.owner] == 1) & train[texts.owner]
    positive = np.flatnonzero(toxic & (heavy > 0) & (heavy >= 0.5 * most[texts.owner]))
    if not len(positive):
        positive = np.flatnonzero(toxic)
    clean = rng.permutation(np.flatnonzero((texts.y[texts.owner] == 0) & train[texts.owner]))
    hard = clean[np.argsort(-heavy[clean], kind="stable")[: len(positive)]]
    share = max(-(-len(clean) // EPOCHS), min(len(clean), 2 * len(positive)))
    epochs = max(EPOCHS, -(-STEPS * STEP // (len(positive) + len(hard) + share)))
    epochs = min(epochs, STEPS)
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    step, three = 0, 3 * HIDDEN
    for epoch in range(epochs):
        if epoch in (epochs // 3, epochs // 2, 3 * epochs // 4):
            # windows of clean texts that the network so far takes for toxic ones
            z = model.window_logits(texts, clean, ids)
            hard = np.union1d(hard, clean[np.argsort(-z, kind="stable")[: len(positive)]])
        turn = np.arange(epoch * share, (epoch + 1) * share) % len(clean)
        negative = np.union1d(hard, clean[turn])
        chosen, target = np.concatenate([positive, negative]), np.repeat([1.0, 0.0], [len(positive), len(negative)]).astype(np.float32)
        balance = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())).astype(np.float32)
        rate = 0.01 * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(chosen))
        for i in range(0, len(order), STEP):
            pick = order[i : i + STEP]
            grid = texts.begin[chosen[pick]] + np.arange(WINDOW)[:, None]
            inside = grid < texts.stop[chosen[pick]]
            mask = inside[:, :, None].astype(np.float32)
            flat, back = np.unique(np.where(inside, texts.word[np.minimum(grid, len(texts.word) - 1)], -1), return_inverse=True)
            back, blank = back.reshape(grid.shape), flat < 0
            flat = np.maximum(flat, 0)
            spot, edge = texts.spots(flat)
            length = texts.length[flat]
            chars = np.add.reduceat(p["char"][spot], edge, axis=0) / length[:, None]
            word = np.where(rng.random(len(flat)) < 0.1, 0, ids[flat])  # dropped words become unknown ones
            x = np.concatenate([p["word"][word], chars], axis=1).astype(np.float32)
            x[blank] = 0
            keep: dict = {}
            z = forward(p, (x @ p["Wf"] + p["bf"])[back], (x @ p["Wb"] + p["bb"])[back], mask, keep)
            d = (balance[pick] * (_sigmoid(z) - target[pick]) / len(pick)).astype(np.float32)
            g, df, db = backward(p, keep, mask, d)
            into = lambda dx: np.stack([np.bincount(back.ravel(), dx[:, :, c].ravel(), len(flat)) for c in range(three)], axis=1).astype(np.float32)
            gf, gb = into(df), into(db)
            g |= {"Wf": x.T @ gf, "Wb": x.T @ gb, "bf": gf.sum(axis=0), "bb": gb.sum(axis=0)}
            dx = gf @ p["Wf"].T + gb @ p["Wb"].T
            dx[blank] = 0
            step += 1
            for k, grad in g.items():
                _adam(p[k], *moments[k], grad, rate, step)
            # of the tables only the rows that the step has read
            for k, at, grad in (("word", word, dx[:, :WORD_DIM]), ("char", spot, np.repeat(dx[:, WORD_DIM:] / length[:, None], length, axis=0))):
                read, which = np.unique(at, return_inverse=True)
                total = np.stack([np.bincount(which, grad[:, c], len(read)) for c in range(grad.shape[1])], axis=1).astype(np.float32)
                if k == "word":
                    total[read == 0] = 0
                rows = [p[k][read], *(m[read] for m in moments[k])]
                _adam(*rows, total, rate, step)
                p[k][read], moments[k][0][read], moments[k][1][read] = rows
    return model


def _adam(x: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)


def fit(rows: list[tuple[int, str]], seed: int = 7) -> Model:
    """Train on ``(label, text)``. Without both classes every score is the share of label 1, at
    most 0.95 and at least 0.05 (0.05 without labels).

    The curve from a text's worst window to its label is placed on all texts, each scored by a
    network that was trained without its part of them.
    """
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        share = min(0.95, max(0.05, y.mean())) if len(y) else 0.05
        return Model(offset=float(np.log(share / (1 - share))), slope=0.0)
    texts = _Texts(rows)
    part = np.zeros(len(y), np.int64)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % FOLDS
    model = _network(texts, np.ones(len(y), bool), seed)
    worst = np.zeros(len(y))
    for k in range(FOLDS):
        train = part != k
        if min(np.bincount(y[train], minlength=2)) and (part == k).any():
            other = _network(texts, train, seed + 1 + k)
        else:
            other = model
        for i in np.split(np.flatnonzero(part == k), range(200, (part == k).sum(), 200)):
            worst[i] = other.worst(_column([rows[r][1] for r in i]))
    slope, offset = logistic(worst, y, prior=1.0, alike=False)
    model.slope, model.offset = max(slope, 1e-3), offset
    return model


# ---------------------------------------------------------------- the operator


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled texts, clean and toxic, none of the held-out fold."""
    return fit(sample(docs, labels, "toxic", MODULUS, REMAINDER, per_class))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name`` (0 to 1) to every row of ``docs``, replacing a column of that name in any case.

    Narrow; a null text, an empty one and one without letters are one window of nothing. Long
    texts are scored whole, window by window. Repeated rows get equal scores.
    """
    source, kept, held, schema = beside_text(docs, text, [(name, "double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch, held, 1 << 19):
                part = batch.slice(a, b - a)
                out = model.scores(utf8(pc.fill_null(part.column(len(kept)), "")))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(out, pa.float64())], [*kept, name])

    return source.mapInArrow(run, schema)
