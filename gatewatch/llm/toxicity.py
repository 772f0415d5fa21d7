"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own hashed vector plus the mean of its character trigrams' hashed vectors. Two
recurrent passes read a window of words, attention pools their states, and a linear unit gives the window's
logit. All overlapping windows of a text are scored; the largest logit, calibrated on texts, is the score.

Only texts are labelled, so windows of toxic texts get their labels in two rounds: first from the log-odds of
their words and trigrams, then from the network of the first round.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, labels
from .samples import ROWS_PER_CLASS, best_cut, class_shares, fold, labelled_texts, platt

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WIDTH = 16
WORD_ROWS = 1 << 15
GRAM_ROWS = 1 << 15
#: Windows that are fitted on at most, of each label.
FIT_WINDOWS = 4_000
POOL_WORDS = 200_000
BLOCK = 1_024
#: Longer runs without white space are cut at their joiners, and parts that are still longer into pieces of
#: ``PIECE`` characters, ``PIECE_STEP`` apart.
LETTERS = 40
PIECE = 6
PIECE_STEP = 2
_JOINERS = re.compile(r"[-_/\\|.,;:+=&~]+")


#: Texts with more characters are cut into words a part at a time, and scored by blocks of windows.
LONG_CHARS = 1 << 18
_GAP = re.compile(r"\s")


def pieces(run: str) -> Iterator[str]:
    """A run without white space as words of at most ``LETTERS`` characters that cover all but its joiners."""
    if len(run) <= LETTERS:
        yield run
        return
    at, any_part = 0, False
    while at < len(run):
        joiner = _JOINERS.search(run, at)
        end = joiner.start() if joiner else len(run)
        if end > at:
            any_part = True
            if end - at <= LETTERS:
                yield run[at:end]
            else:
                yield from (run[s : min(s + PIECE, end)] for s in range(at, end - PIECE + PIECE_STEP, PIECE_STEP))
        at = joiner.end() if joiner else len(run)
    if not any_part:  # joiners only
        yield from (run[s : s + LETTERS] for s in range(0, len(run), LETTERS))


def split(text: str) -> list[str]:
    """All words in lower case, long runs in pieces."""
    words = text.lower().split()
    if max(map(len, words), default=0) > LETTERS:
        words = [p for w in words for p in pieces(w)]
    return words


def split_long(text: str) -> Iterator[str]:
    """The words of :func:`split`, without a list of all of them: parts end at white space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + LONG_CHARS)
        end = gap.start() if gap else len(text)
        for w in text[at:end].lower().split():
            yield from pieces(w)
        at = end


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' character trigrams, flat, and each word's count."""
    marked = [f"^{w}$" for w in words]
    counts = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)) - 2
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x27D4EB2F)) % np.uint32(GRAM_ROWS)
    inside = np.ones(len(points), dtype=bool)
    ends = np.cumsum(counts + 2)
    inside[ends - 1] = inside[ends - 2] = False
    return h[inside[: len(h)]].astype(np.int64), counts


def stripped(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}*#%&$|") or word


def windows_of(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; an empty text has one window of padding."""
    return list(range(0, max(1, n - STRIDE), STRIDE)) if n > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, the forward pass and its gradient. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.word = (rng.standard_normal((WORD_ROWS, WIDTH)) * 0.1).astype(f)
        self.gram = (rng.standard_normal((GRAM_ROWS, WIDTH)) * 0.3).astype(f)
        self.p = {
            "wx": (rng.standard_normal((WIDTH, 6 * HIDDEN)) / np.sqrt(WIDTH)).astype(f),
            "bx": np.zeros(6 * HIDDEN, f),
            "u": (rng.standard_normal((2, HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
            "att": (rng.standard_normal(2 * HIDDEN) * 0.1).astype(f),
            "out": (rng.standard_normal(2 * HIDDEN) * 0.3).astype(f),
            "b": np.zeros(1, f),
        }
        self.slope, self.offset = 1.0, 0.0

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' rows, and their gram rows, flat with counts."""
        word_rows = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % WORD_ROWS for w in words), dtype=np.int64, count=len(words))
        return word_rows, *grams(words)

    def inputs(self, rows: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Vectors of words: their own plus the mean of their grams'."""
        return self.word[rows] + np.add.reduceat(self.gram[flat], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both directions' gates, (words, 2, 3 * HIDDEN)."""
        return (x @ self.p["wx"] + self.p["bx"]).reshape(len(x), 2, 3 * HIDDEN)

    def forward(self, px: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. px: (T, windows, 2, 3 * HIDDEN); real: (windows, T), False where padded."""
        steps, n = px.shape[0], px.shape[1]
        u = self.p["u"]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for t in range(steps):
            x = np.stack([px[t, :, 0], px[steps - 1 - t, :, 1]])
            hu = np.matmul(h, u)
            zr = _sigmoid(x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + r * hu[..., 2 * HIDDEN :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((h, z, r, c, hu[..., 2 * HIDDEN :]))
            h = new
            states[t, :, :HIDDEN] = h[0]
            states[steps - 1 - t, :, HIDDEN:] = h[1]
        energy = np.where(real.T, states @ self.p["att"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.matmul(weight.T[:, None, :], states.transpose(1, 0, 2))[:, 0]
        if keep is not None:
            keep.append((states, weight, pooled))
        return pooled @ self.p["out"] + self.p["b"][0]

    def gradient(self, px: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean logistic loss, gradients of the parameters, and of px."""
        keep: list = []
        logit = self.forward(px, real, keep)
        states, weight, pooled = keep.pop()
        steps, n = px.shape[0], px.shape[1]
        p = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        dl = ((p - y) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["b"][0] = pooled.T @ dl, dl.sum()
        dpool = dl[:, None] * self.p["out"]
        dweight = np.einsum("tnk,nk->tn", states, dpool)
        denergy = weight * (dweight - (weight * dweight).sum(axis=0))
        dstates = weight[..., None] * dpool + denergy[..., None] * self.p["att"]
        g["att"] = np.einsum("tnk,tn->k", states, denergy)
        dpx = np.zeros_like(px)
        u = self.p["u"]
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, hc = keep[t]
            dh = dh + np.stack([dstates[t, :, :HIDDEN], dstates[steps - 1 - t, :, HIDDEN:]])
            dac = dh * (1 - z) * (1 - c * c)
            daz = dh * (h - c) * z * (1 - z)
            dar = dac * hc * r * (1 - r)
            da = np.concatenate([daz, dar, dac * r], axis=-1)
            g["u"] += np.matmul(h.transpose(0, 2, 1), da)
            da_x = np.concatenate([daz, dar, dac], axis=-1)
            dpx[t, :, 0] += da_x[0]
            dpx[steps - 1 - t, :, 1] += da_x[1]
            dh = dh * z + np.matmul(da, u.transpose(0, 2, 1))
        return loss, g, dpx


def _index(word_lists: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, then (windows, WINDOW) numbers into them and which places are real."""
    distinct = sorted({w for ws in word_lists for w in ws})
    number = {w: k for k, w in enumerate(distinct)}
    at = np.zeros((len(word_lists), WINDOW), dtype=np.int64)
    real = np.zeros((len(word_lists), WINDOW), dtype=bool)
    for k, ws in enumerate(word_lists):
        at[k, : len(ws)] = [number[w] for w in ws]
        real[k, : len(ws)] = True
    return distinct, at, real


def _padded(px: np.ndarray, at: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Step-major gate inputs; padding has none."""
    out = px[at.T]
    out[~real.T] = 0
    return out


def train(net: Network, word_lists: list[list[str]], y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 0) -> list[float]:
    """Adam for the dense parameters, Adagrad for the rows of the two tables. Returns the mean loss of each epoch."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    seen_word, seen_gram = np.full(WORD_ROWS, 1e-6, np.float32), np.full(GRAM_ROWS, 1e-6, np.float32)
    step, losses = 0, []
    distinct, all_at, all_real = _index(word_lists)
    if not distinct:
        return []
    all_real[~all_real.any(axis=1), 0] = True
    all_rows, all_flat, all_counts = net.rows(distinct)
    all_first = np.cumsum(all_counts) - all_counts
    for _ in range(epochs):
        total = []
        order = rng.permutation(len(word_lists))
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            words, at = np.unique(all_at[part], return_inverse=True)
            at, real = at.reshape(len(part), WINDOW), all_real[part]
            rows, counts = all_rows[words], all_counts[words]
            flat = all_flat[np.repeat(all_first[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            x = net.inputs(rows, flat, counts)
            loss, g, dpx = net.gradient(_padded(net.project(x), at, real), real, y[part].astype(np.float32))
            total.append(loss)
            spots = at[real]
            by = np.argsort(spots, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(spots[by]) > 0]))
            dp = np.zeros((len(words), 6 * HIDDEN), np.float32)
            dp[spots[by][first]] = np.add.reduceat(dpx.transpose(1, 0, 2, 3)[real].reshape(len(spots), -1)[by], first, axis=0)
            g["wx"], g["bx"] = x.T @ dp, dp.sum(axis=0)
            dx = dp @ net.p["wx"].T
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                net.p[k] -= (rate * 0.5 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            dgram = np.repeat(dx / counts[:, None], counts, axis=0)
            for table, seen, where, d in ((net.word, seen_word, rows, dx), (net.gram, seen_gram, flat, dgram)):
                by = np.argsort(where, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(where[by]) > 0]))
                summed, at_rows = np.add.reduceat(d[by], first, axis=0), where[by][first]
                seen[at_rows] += (summed**2).mean(axis=1)
                table[at_rows] -= (rate * 2 * summed / np.sqrt(seen[at_rows])[:, None]).astype(np.float32)
        losses.append(float(np.mean(total)) if total else 0.0)
    return losses


class Scorer:
    """Scores texts with one network, keeping the gate inputs of known words."""

    def __init__(self, net: Network, pool_words: int = POOL_WORDS):
        self.net, self.pool_words = net, pool_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.px = np.zeros((1, 2, 3 * HIDDEN), np.float32)  # row 0: padding

    def logits(self, texts: list[str]) -> np.ndarray:
        """The largest window logit of each text. Few words are held at once, however long the texts are."""
        out, at = np.empty(len(texts), np.float32), 0
        while at < len(texts):
            if len(texts[at]) > LONG_CHARS:
                out[at] = self._long(split_long(texts[at]))
                at += 1
                continue
            stop, size = at, 0
            while stop < len(texts) and len(texts[stop]) <= LONG_CHARS and (stop == at or size < 4 * LONG_CHARS):
                size += len(texts[stop])
                stop += 1
            out[at:stop] = self._short([split(t) for t in texts[at:stop]])
            at = stop
        return out

    def _long(self, words: Iterator[str]) -> float:
        """Of one text, by blocks of its windows; the windows are those of :func:`windows_of` for the whole text."""
        best, held = -np.inf, []
        while more := list(islice(words, BLOCK * STRIDE)):
            held += more
            whole = (len(held) - STRIDE - 1) // STRIDE  # windows that do not reach the last word held
            if whole > 0:
                best = max(best, float(self._short([held[: (whole - 1) * STRIDE + WINDOW]])[0]))
                held = held[whole * STRIDE :]
        return max(best, float(self._short([held])[0]))

    def _short(self, lists: list[list[str]]) -> np.ndarray:
        if len(self.known) > self.pool_words:
            self._clear()
        new = sorted({w for ws in lists for w in ws}.difference(self.known))
        if new:
            for s in range(0, len(new), 20_000):
                part = new[s : s + 20_000]
                self.known.update(zip(part, range(len(self.px), len(self.px) + len(part)), strict=True))
                self.px = np.concatenate([self.px, self.net.project(self.net.inputs(*self.net.rows([stripped(w) for w in part])))])
        flat = np.fromiter((self.known[w] for ws in lists for w in ws), dtype=np.int64, count=sum(map(len, lists)))
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        counts = [len(ws) for ws in lists]
        begins = np.concatenate([[0], np.cumsum(counts)])
        starts = [windows_of(n) for n in counts]
        owner = np.repeat(np.arange(len(lists)), [len(s) for s in starts])
        start = begins[owner] + np.fromiter((k for s in starts for k in s), dtype=np.int64, count=len(owner))
        end = begins[owner + 1]
        out = np.empty(len(owner), np.float32)
        for s in range(0, len(owner), BLOCK):
            spots = start[s : s + BLOCK, None] + np.arange(WINDOW)
            real = spots < end[s : s + BLOCK, None]
            at = np.where(real, flat[np.minimum(spots, len(flat) - 1)], 0)
            real[~real.any(axis=1), 0] = True
            out[s : s + BLOCK] = self.net.forward(self.px[at.T], real)
        return np.maximum.reduceat(out, np.flatnonzero(np.diff(owner, prepend=-1))) if len(owner) else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.net.slope * self.logits(texts) + self.net.offset, -30, 30)))


def _log_odds(word_lists: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Of words and trigrams, by the number of texts that have them."""
    count = [Counter(), Counter()]
    for ws, label in zip(word_lists, y.tolist(), strict=True):
        distinct = set(ws)
        count[label].update(distinct | {f"~{m[k : k + 4]}" for w in distinct for m in (f"^{w}$",) for k in range(len(m) - 3)})
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    return {k: float(np.log((c + 0.5) / n1) - np.log((count[0][k] + 0.5) / n0)) for k, c in count[1].items() if c >= 3}


def _evidence(word: str, odds: dict[str, float]) -> float:
    marked = f"^{word}$"
    return max([odds.get(word, 0.0), *(odds.get(f"~{marked[k : k + 4]}", 0.0) for k in range(len(marked) - 3))])


def fit(texts: list[tuple[str, int]], shares: dict[int, float] | None = None, seed: int = 0, fit_windows: int | None = FIT_WINDOWS) -> Network:
    """Fits on texts with labels 0 and 1; with one class only, or none, all scores are that class's share.

    ``shares`` are the classes' shares outside the sample, for the calibration. ``fit_windows`` bounds the windows of
    each label that the network is trained on; None takes all of the texts.
    """
    net = Network(seed)
    y = np.array([label for _, label in texts], dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net.slope, net.offset = 0.0, float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    lists = [[stripped(w) for w in split(t)] for t, _ in texts]
    used = np.flatnonzero(~held)
    odds = _log_odds([lists[k] for k in used], y[used])
    memo: dict[str, float] = {}
    sure, calm = [], []
    for k in used:
        found = [lists[k][s : s + WINDOW] for s in windows_of(len(lists[k]))]
        if y[k] == 0:
            calm += found
            continue
        for w in set(lists[k]):
            if w not in memo:
                memo[w] = _evidence(w, odds)
        best = [max(map(memo.get, ws), default=0.0) for ws in found]
        top = max(best)
        sure += [ws for ws, b in zip(found, best, strict=True) if b >= max(2.5, 0.6 * top) or b == top]
    most = fit_windows if fit_windows is not None else max(len(sure), len(calm))
    pick = lambda xs: [xs[k] for k in rng.permutation(len(xs))[:most]]
    pos, neg = pick(sure), pick(calm)
    passes = int(np.clip(40_000 / (len(pos) + len(neg)), 4, 30))
    train(net, pos + neg, np.array([1] * len(pos) + [0] * len(neg)), epochs=passes, seed=seed)
    # second round: toxic windows that the network still rejects were mislabelled; calm ones that it accepts are hard
    scorer = Scorer(net)
    score = lambda xs: scorer.logits([" ".join(ws) for ws in xs]) if xs else np.zeros(0)
    pos = [ws for ws, s in zip(pos, score(pos), strict=True) if s > 0] or pos
    spare = calm if len(calm) <= 4 * most else [calm[k] for k in rng.permutation(len(calm))[: 4 * most]]
    hard = [spare[k] for k in np.argsort(-score(spare))[: most // 4]]
    neg = (neg[: most * 3 // 4] if fit_windows is not None else neg) + hard
    train(net, pos + neg, np.array([1] * len(pos) + [0] * len(neg)), epochs=max(2, passes // 3), rate=0.01, seed=seed + 1)
    check = held if held.any() else np.ones(len(y), dtype=bool)
    margins = Scorer(net).logits([texts[k][0] for k in np.flatnonzero(check)])
    shares = shares or {0: 0.5, 1: 0.5}
    weight = np.array([shares.get(k, 0.5) / max(1e-9, (y[check] == k).mean()) for k in y[check].tolist()])
    net.slope, _ = platt(margins, y[check], weight)
    net.offset = -net.slope * best_cut(margins, y[check], weight)
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity of the whole text (null: of an empty one) in ``score_col``.

    A very long text is scored by blocks of its windows, so no list of all its words is held. All rows and
    columns pass, repeated rows and null ids too; a column called ``score_col`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != score_col]
    schema = docs.select(*names).withColumn(score_col, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            scores = scorer.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(scores, pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, schema)


def fit_on(docs: DataFrame, label_rows: DataFrame, rows_per_class: int = ROWS_PER_CLASS, fit_windows: int | None = FIT_WINDOWS) -> Network:
    """Learns ``toxic`` from rows outside the held-out fold (crc32 of the id, mod 5, is 0); see :func:`fit` for the bounds."""
    learn = fold(F.col("doc_id"), 5) != 0
    return fit(labelled_texts(docs, label_rows, "toxic", learn, rows_per_class), class_shares(label_rows, "toxic", learn), fit_windows=fit_windows)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net = fit_on(docs, labels(spark, sf_dir))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, net).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
