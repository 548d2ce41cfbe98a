"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Two such networks, one inside the other, trained here in numpy.  The inner one
reads the characters of a word; its pooled state and the word's embedding (zero
for words that the training texts do not have) are the word's input to the
outer one, which reads a window of words.  All overlapping windows of a text
are scored, and the text's score is the calibrated score of its worst window.
Long texts are read a run of words at a time; the runs overlap as windows do, so
their windows are those of the whole text.

A word's input to the outer network depends on the word alone, so workers keep
it by word, already multiplied into the gates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom_lm import in_part
from .cluster import release_memory, releasing, small_batches

WINDOW, STRIDE = 24, 16
LETTERS, PIECE = 320, 16  # character codes; a longer word is read in pieces
CACHE_WORDS = 120_000
RUN_CHARS = 1 << 18  # about so many characters of a text are held as words at once
FIT_STEPS = 60  # updates a round at least, where the texts are few
_SHELL = re.compile(r"^[\W_]+|[\W_]+$")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Encoder:
    """Bidirectional GRU with attention pooling; arrays lead with the direction."""

    w: np.ndarray  # 2, inputs, 3 * hidden: update, reset, candidate
    u: np.ndarray  # 2, hidden, 3 * hidden
    b: np.ndarray  # 2, 3 * hidden
    v: np.ndarray  # 2 * hidden: attention

    @classmethod
    def fresh(cls, inputs: int, hidden: int, rng: np.random.Generator) -> Encoder:
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        return cls(draw(2, inputs, 3 * hidden, scale=inputs**-0.5), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), np.zeros((2, 3 * hidden), np.float32), draw(2 * hidden, scale=0.3))

    @property
    def hidden(self) -> int:
        return self.u.shape[1]

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The inputs' part of the gates: 2, rows, 3 * hidden."""
        return np.stack([x @ self.w[d] + self.b[d] for d in (0, 1)])

    def states(self, tables: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States by place (batch, time, 2 * hidden); the gate inputs of place [i, t] are row index[i, t] of both tables."""
        n, steps = index.shape
        h_size = self.hidden
        h = np.zeros((2, n, h_size), np.float32)
        x = np.empty((2, n, 3 * h_size), np.float32)
        out = np.empty((n, steps, 2 * h_size), np.float32)
        full = mask.all(axis=0)
        for t in range(steps):
            back = steps - 1 - t
            np.take(tables[0], index[:, t], axis=0, out=x[0], mode="clip")
            np.take(tables[1], index[:, back], axis=0, out=x[1], mode="clip")
            s = h @ self.u
            zr = _sigmoid(x[..., : 2 * h_size] + s[..., : 2 * h_size])
            z, r = zr[..., :h_size], zr[..., h_size:]
            c = np.tanh(x[..., 2 * h_size :] + r * s[..., 2 * h_size :])
            new = c + z * (h - c)
            if keep is not None or not (full[t] and full[back]):
                m = np.stack([mask[:, t], mask[:, back]])[..., None]
                if keep is not None:
                    keep.append((h, z, r, c, s[..., 2 * h_size :], m))
                new = h + m * (new - h)
            h = new
            out[:, t, :h_size] = h[0]
            out[:, back, h_size:] = h[1]
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = states @ self.v - 1e4 * (1 - mask)
        a = np.exp(a - a.max(axis=1, keepdims=True)) * mask
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        return (a[..., None] * states).sum(axis=1), a

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        keep: list = []
        n, steps = mask.shape
        states = self.states(self.gates(x.reshape(n * steps, -1)), np.arange(n * steps).reshape(n, steps), mask, keep)
        pooled, a = self.pool(states, mask)
        return pooled, (x, mask, keep, states, pooled, a)

    def backward(self, grad: np.ndarray, cache: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradient of the inputs, and of w, u, b, v."""
        x, mask, keep, states, pooled, a = cache
        n, steps, h_size = *mask.shape, self.hidden
        inner = (states * grad[:, None, :]).sum(axis=2) - (pooled * grad).sum(axis=1, keepdims=True)
        da = a * inner
        dv = (da[..., None] * states).sum(axis=(0, 1))
        d_states = a[..., None] * grad[:, None, :] + da[..., None] * self.v
        dg = np.zeros((2, n, steps, 3 * h_size), np.float32)
        du, dh = np.zeros_like(self.u), np.zeros((2, n, h_size), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, sc, m = keep[t]
            dh = dh + np.stack([d_states[:, t, :h_size], d_states[:, steps - 1 - t, h_size:]])
            dn = dh * m
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * sc * r * (1 - r)
            ds = np.concatenate([dz, dr, dc * r], axis=2)
            du += h.transpose(0, 2, 1) @ ds
            dh = dh * (1 - m) + dn * z + ds @ self.u.transpose(0, 2, 1)
            gate = np.concatenate([dz, dr, dc], axis=2)
            dg[0, :, t], dg[1, :, steps - 1 - t] = gate[0], gate[1]
        flat = x.reshape(-1, x.shape[-1])
        dw = np.stack([flat.T @ dg[d].reshape(-1, 3 * h_size) for d in (0, 1)])
        dx = dg[0] @ self.w[0].T + dg[1] @ self.w[1].T
        return dx, [dw, du, dg.sum(axis=(1, 2)), dv]


_SPACE = re.compile(r"\s")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; long ones in pieces, so that no character is left out."""
    out = (text or "").lower().split()
    if max(map(len, out), default=0) > PIECE:
        out = [w[a : a + PIECE] for w in out for a in range(0, len(w), PIECE)]
    return out


def word_runs(text: str | None, chars: int = RUN_CHARS) -> Iterator[list[str]]:
    """The words of a text in runs whose windows, all together, are those of the whole text."""
    held, at, size, begun = [], 0, len(text or ""), False
    while at + chars < size:
        cut = _SPACE.search(text, at + chars)
        if not cut:
            break
        held += words_of(text[at : cut.start()])
        at = cut.start()
        # whole windows only; the next run begins where the next window does
        n = (len(held) - (WINDOW - STRIDE)) // STRIDE
        if n > 0:
            yield held[: n * STRIDE + WINDOW - STRIDE]
            held, begun = held[n * STRIDE :], True
    held += words_of((text or "")[at:])
    # what is left is no window of its own if the last one before it reached the end
    if not begun or len(held) > WINDOW - STRIDE:
        yield held


def window_starts(n: int) -> range:
    """Starts of the overlapping windows that cover n words; an empty text has one empty window."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes and mask of words, padded to the longest."""
    size = max(map(len, words), default=1) or 1
    raw = np.frombuffer("".join(w.ljust(size, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), size).astype(np.int64)
    mask = np.arange(size)[None, :] < np.fromiter(map(len, words), dtype=np.int64, count=len(words))[:, None]
    return np.where(raw < 256, raw, 256 + raw % (LETTERS - 256)), mask.astype(np.float32)


@dataclass
class Network:
    vocabulary: dict[str, int]  # 0 is any other word
    letters: np.ndarray
    words: np.ndarray
    inner: Encoder
    outer: Encoder
    top: np.ndarray
    bias: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    _known: dict = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_table": None}

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        made = cls(vocabulary, draw(LETTERS, 8, scale=0.5), draw(len(vocabulary) + 1, 8, scale=0.1), Encoder.fresh(8, 8, rng), Encoder.fresh(24, 8, rng), draw(16, scale=0.3), np.zeros(1, np.float32))
        made.words[0] = 0
        return made

    def forget(self) -> None:
        """Drop what was kept by word; needed after each change of the parameters."""
        self._known, self._table = {}, None

    def parameters(self) -> list[np.ndarray]:
        return [self.letters, self.words, *(getattr(e, k) for e in (self.inner, self.outer) for k in "wubv"), self.top, self.bias]

    def word_ids(self, words: list[str]) -> np.ndarray:
        return np.array([self.vocabulary.get(_SHELL.sub("", w), 0) for w in words], dtype=np.int64)

    def word_gates(self, words: list[str]) -> np.ndarray:
        """Gate inputs of the outer network for distinct words: 2, words, 3 * hidden."""
        ids = self.word_ids(words)
        letters = self.inner.gates(self.letters)
        out = np.empty((2, len(words), 3 * self.outer.hidden), np.float32)
        by_length = np.argsort(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), kind="stable")
        for at in range(0, len(words), 4096):
            some = by_length[at : at + 4096]
            codes, mask = _codes([words[i] for i in some])
            pooled, _ = self.inner.pool(self.inner.states(letters, codes, mask), mask)
            out[:, some] = self.outer.gates(np.concatenate([pooled, self.words[ids[some]]], axis=1))
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of the word table, new words added; the table starts anew when it is full."""
        known = self._known
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        if fresh:
            if known and len(known) + len(fresh) > CACHE_WORDS:
                known.clear()
                self._table = None
                fresh = list(dict.fromkeys(words))
            gates = self.word_gates(fresh)
            begin = len(known)
            if self._table is None or begin + len(fresh) > self._table.shape[1]:
                grown = np.zeros((2, max(begin + begin // 2 + len(fresh), 1024), gates.shape[2]), np.float32)
                if begin:
                    grown[:, :begin] = self._table[:, :begin]
                self._table = grown
            self._table[:, begin : begin + len(fresh)] = gates
            known.update(zip(fresh, range(begin, begin + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def window_logits(self, places: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        table = self._table if self._table is not None else np.zeros((2, 1, 3 * self.outer.hidden), np.float32)
        for at in range(0, len(begin), 2048):
            step = np.arange(WINDOW)
            inside = step[None, :] < size[at : at + 2048, None]
            where = np.where(inside, begin[at : at + 2048, None] + step, 0)
            mask = inside.astype(np.float32)
            index = places[where] if len(places) else where
            pooled, _ = self.outer.pool(self.outer.states(table, index, mask), mask)
            out[at : at + 2048] = pooled @ self.top + self.bias
        return out

    def text_logits(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest window logit of each text, and all its window logits."""
        parts = self._windows_of([words_of(t) for t in texts])
        return np.array([p.max() for p in parts]), parts

    def run_logits(self, words: list[str]) -> np.ndarray:
        return self._windows_of([words])[0]

    def _windows_of(self, split: list[list[str]]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in split])
        places = self.places([w for s in split for w in s])
        first = np.cumsum(sizes) - sizes
        starts = [np.array(window_starts(n)) for n in sizes]
        begin = np.concatenate([f + s for f, s in zip(first, starts, strict=True)])
        size = np.concatenate([np.minimum(WINDOW, n - s) for n, s in zip(sizes, starts, strict=True)])
        logits = self.window_logits(places, begin, size)
        return np.split(logits, np.cumsum([len(s) for s in starts])[:-1])

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text, however long."""
        out = np.empty(len(texts), np.float32)
        short = [i for i, t in enumerate(texts) if len(t or "") <= RUN_CHARS]
        if short:
            out[short] = self.text_logits([texts[i] for i in short])[0]
        for i in set(range(len(texts))).difference(short):
            out[i] = max(float(self.run_logits(run).max()) for run in word_runs(texts[i]))
        return out

    def all_windows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Window logits of each of many texts, a few at a time."""
        return [p for a in range(0, len(texts), 128) for p in self.text_logits(texts[a : a + 128])[1]]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.worst(texts).astype(np.float64) + b, -60, 60)))


class Trainer:
    """Adam on windows of words."""

    def __init__(self, net: Network, rate: float, rng: np.random.Generator):
        self.net, self.rate, self.rng, self.step = net, rate, rng, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]

    def update(self, windows: list[list[str]], labels: np.ndarray, weights: np.ndarray, forget: float) -> float:
        net = self.net
        flat = [w for x in windows for w in x]
        distinct = list(dict.fromkeys(flat)) or [""]
        index = {w: i for i, w in enumerate(distinct)}
        codes, char_mask = _codes(distinct)
        inner, inner_cache = net.inner.forward(net.letters[codes], char_mask)
        ids = net.word_ids(distinct)
        ids[self.rng.random(len(ids)) < forget] = 0  # so that the characters alone must do, too
        x_word = np.concatenate([inner, net.words[ids]], axis=1)
        where = np.zeros((len(windows), WINDOW), np.int64)
        mask = np.zeros((len(windows), WINDOW), np.float32)
        for i, x in enumerate(windows):
            where[i, : len(x)] = [index[w] for w in x]
            mask[i, : len(x)] = 1
        pooled, outer_cache = net.outer.forward(x_word[where], mask)
        logit = pooled @ net.top + net.bias
        p = _sigmoid(logit)
        d = ((p - labels) * weights / len(windows)).astype(np.float32)
        dx, outer_grads = net.outer.backward(d[:, None] * net.top, outer_cache)
        d_word = np.zeros_like(x_word)
        np.add.at(d_word, where.ravel(), (dx * mask[..., None]).reshape(-1, x_word.shape[1]))
        width = inner.shape[1]
        d_letters, inner_grads = net.inner.backward(d_word[:, :width], inner_cache)
        letters, words = np.zeros_like(net.letters), np.zeros_like(net.words)
        np.add.at(letters, codes.ravel(), d_letters.reshape(-1, letters.shape[1]))
        np.add.at(words, ids, d_word[:, width:])
        words[0] = 0
        self._adam([letters, words, *inner_grads, *outer_grads, d @ pooled, d.sum(keepdims=True)])
        return float(-(weights * np.log(np.where(labels == 1, p, 1 - p) + 1e-7)).mean())

    def _adam(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, 2.0 / (norm + 1e-9))
        for p, g, (m, v) in zip(self.net.parameters(), grads, self.moments, strict=True):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)


def _evidence(split: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """How much each word speaks for label 1, to choose training windows: log odds by the texts that have it, weighed by their number."""
    bad, good = Counter(), Counter()
    for words, y in zip(split, labels, strict=True):
        (bad if y else good).update({_SHELL.sub("", w) for w in words})
    nb, ng = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = {w: float(np.log((bad[w] + 0.5) / (nb + 1) * (ng + 1) / (good[w] + 0.5))) for w in bad if bad[w] >= 2}
    return {w: (x - 1) * bad[w] ** 0.5 for w, x in odds.items() if x > 1}


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on one feature, held to the plain sigmoid by a few texts' weight."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        r, s = w * (p - y), w * p * (1 - p)
        g = np.array([(r * x).sum() + 40 * (a - 1), r.sum() + 0.2 * b])
        h = np.array([[(s * x * x).sum() + 40, (s * x).sum()], [(s * x).sum(), s.sum() + 0.2]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(np.clip(a, 0.2, 3.0)), float(b)


def fit(texts: list[str | None], labels: list[int], prior: float, seed: int = 3, rounds: int = 3, rate: float = 0.02, batch: int = 48) -> Network:
    """Train on labelled texts; `prior` is the share of label 1 to calibrate for.

    A text's label is known, its windows' labels are not: for label 1 the most
    telling windows are taken to have it, for label 0 all windows have it and
    the most telling ones are used with some others.  What is telling is said by
    word odds in the first round and by the network itself in later ones.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    split = [words_of(t) for t in texts]
    order = rng.permutation(len(y))
    held = np.zeros(len(y), dtype=bool)
    held[order[: len(y) // 5]] = True
    learn = np.flatnonzero(~held)
    odds = _evidence([split[i] for i in learn], y[learn])
    common = Counter(_SHELL.sub("", w) for i in learn for w in set(split[i]))
    net = Network.fresh({w: k + 1 for k, (w, n) in enumerate(sorted((x for x in common.items() if x[0] and x[1] >= 3), key=lambda x: (-x[1], x[0])))}, rng)
    if not len(y) or y.min() == y.max():
        net.bias[:] = 4.0 if len(y) and y.max() else -4.0
        net.top[:] = 0
        return net
    trainer = Trainer(net, rate, rng)
    windows = [[s[a : a + WINDOW] for a in window_starts(len(s))] for s in split]
    plain = [np.array([sum(odds.get(_SHELL.sub("", w), 0.0) for w in x) for x in windows[i]]) for i in learn]
    for k in range(rounds):
        told = plain
        if k:
            net.forget()
            told = net.all_windows([texts[i] for i in learn])
        chosen: list[tuple[list[str], float]] = []
        for i, words, network in zip(learn, plain, told, strict=True):
            if y[i]:
                best = np.argsort(-words, kind="stable")[:3]
                take = [int(network.argmax()), *(j for j in best if words[j] > max(2.0, 0.5 * words[best[0]]))]
            else:
                take = [*np.argsort(-network, kind="stable")[:2], int(words.argmax()), *rng.choice(len(words), 1)]
            chosen += [(windows[i][j], y[i]) for j in dict.fromkeys(take)]
        target = np.array([c[1] for c in chosen], dtype=np.float32)
        balance = np.where(target == 1, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)).astype(np.float32)
        epochs = max(2, min(12, -(-FIT_STEPS * batch // len(chosen))))
        for epoch in range(epochs):
            trainer.rate = rate * (1.0, 0.5, 0.2)[min(k, 2)] * (1.0 - 0.6 * epoch / epochs)
            for some in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // batch)):
                trainer.update([chosen[j][0] for j in some], target[some], balance[some], forget=0.4)
    net.forget()
    check = np.flatnonzero(held) if 0 < y[held].sum() < held.sum() else np.arange(len(y))
    x = np.array([p.max() for p in net.all_windows([texts[i] for i in check])], dtype=np.float64)
    share = y[check].mean()
    w = np.where(y[check] == 1, prior / share, (1 - prior) / (1 - share))
    net.scale = _platt(x, y[check].astype(np.float64), w)
    net.forget()
    return net


def sample_labels(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int = 64 << 20) -> tuple[list, float]:
    """Labelled (doc_id, text, label) rows by smallest id hash, and the share of label 1.

    At most `fit_rows` of each label, and of each label whole texts of at most
    `fit_bytes` / 2 bytes together.  Of several texts of one id the smallest is taken.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~in_part(F.col("doc_id"), 4, 2))
    share = known.agg(F.avg("toxic")).first()[0]
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for y in (0, 1)]
    # at most 2 * fit_rows ids and labels, so the broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = F.broadcast(some[0].unionAll(some[1]))
    found = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("upto", upto).where(F.col("upto") <= fit_bytes // 2)
    return sorted((r.doc_id, r.text, r.toxic) for r in rows.select("doc_id", "text", "toxic").collect()), float(share or 0.0)


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = 1500, fit_bytes: int = 64 << 20, seed: int = 3) -> Network:
    """The network fitted on the bounded sample of `sample_labels`."""
    rows, share = sample_labels(docs, labels, fit_rows, fit_bytes)
    net = fit([r[1] for r in rows], [r[2] for r in rows], min(max(share, 0.001), 0.999), seed)
    release_memory()
    return net


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """Add the toxicity score (double, 0 to 1) of each row's whole text.

    Null and empty texts have one empty window.  Other columns pass through; one
    named like `column` is replaced.  Equal texts score equally up to rounding;
    an empty table gives an empty result.  A text of any length is scored whole,
    a run of words at a time.
    """
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name != column]
    places = [docs.columns.index(f.name) for f in keep]
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                piece = batch.slice(a, 128)
                made = pa.array(model.scores(piece.column(at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in places), made], [*(f.name for f in keep), column])
        model.forget()

    return docs.mapInArrow(releasing(run), T.StructType([*keep, T.StructField(column, T.DoubleType())]))
