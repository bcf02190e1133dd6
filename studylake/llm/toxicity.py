"""Toxicity of whole texts by a bidirectional gated recurrent network.

A word enters as a word embedding (hashed) joined to the mean of its character
n-gram embeddings (hashed), so an inflected or unseen form still shows its stem.
A window of 32 words runs through a GRU in both directions, attention pools the
states and a logistic unit scores the pool.  Windows overlap by half and every
window of a text is scored, whatever its length.

Labels are of documents, not windows.  Windows of toxic documents are therefore
chosen in rounds: first by the contrast of document frequencies of their words
and n-grams, then by the network itself; windows of clean documents are all
negative, and those that the network finds hardest are added.  The document's
score is a logistic function of its highest window logit and the logarithm of
its number of windows, fitted on labelled documents that the network didn't see.

Training is numpy on a sample of labelled rows bounded by ``Fit`` (documents of
each class, longest text); scoring covers every text.  Words are kept by worker
with their input projections, so a repeated word costs one look-up.

Defined cases: a null, empty or wordless text is one window of padding; every
window of a very long text is scored; rows with null labels or doc_ids are not
learned from; rows that repeat a text score alike, and of equally toxic windows it
makes no difference which counts; without labels of both classes every score is the
share of toxic labels (0 if none); an empty table gives an empty result; further
columns are ignored (``drop_toxic`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, passes

STEP = 16
WINDOW = 2 * STEP
WORDS, GRAMS = 1 << 13, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
KEPT_WORDS = 200_000
#: Words whose n-grams are looked up at once: a row for each n-gram of 100,000 words would be 100 MB.
WORDS_PER_PASS = 8192
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»’‘…¡¿"


@dataclass
class Fit:
    """Bounds and settings of the fit; the sample is about this many documents."""

    toxic_docs: int = 800
    clean_docs: int = 1200
    longest: int = 100_000
    epochs: int = 8
    rounds: int = 3
    batch: int = 256
    rate: float = 0.01
    most_positive: int = 2000
    negatives: int = 3
    seed: int = 7


def features(word: str) -> tuple[int, list[int]]:
    """The hashed word and its hashed character n-grams (4 and 5, edges marked)."""
    bare = word.strip(_EDGES)
    marked = f"^{bare}$"
    grams = [xxhash.xxh32_intdigest(marked[i : i + n]) % GRAMS for n in (4, 5) for i in range(max(1, len(marked) - n + 1))]
    return xxhash.xxh32_intdigest(bare) % WORDS, grams


class Grams:
    """Features of numbered words: the word's hash, and its n-grams end to end."""

    def __init__(self, words: list[str]):
        hashes, sizes, flat = [], [], []
        for at in range(0, len(words), 4096):  # lists of numbers are large, arrays aren't
            found = [features(w) if w else (0, [0]) for w in words[at : at + 4096]]
            hashes.append(np.array([f[0] for f in found], np.int32))
            sizes.append(np.array([len(f[1]) for f in found], np.int32))
            flat.append(np.fromiter(chain.from_iterable(f[1] for f in found), np.int32, int(sizes[-1].sum())))
        self.word, self.sizes, self.flat = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (hashes, sizes, flat))
        self.ends = np.cumsum(self.sizes, dtype=np.int64)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some words, end to end, and how many each has."""
        sizes = self.sizes[words]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.ends[words] - sizes - before, sizes) + np.arange(sizes.sum())], sizes


def word_numbers(texts: list[str]) -> tuple[dict[str, int], list[np.ndarray]]:
    """Numbers of all words (0 is padding) and each text as numbers."""
    number: dict[str, int] = {"": 0}
    return number, [np.array([number.setdefault(w, len(number)) for w in (t or "").lower().split()], np.int32) for t in texts]


def windows(words: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text, padded at its end."""
    blocks = max(2, -(-len(words) // STEP))
    padded = np.zeros(blocks * STEP, words.dtype)
    padded[: len(words)] = words
    padded = padded.reshape(blocks, STEP)
    return np.concatenate([padded[:-1], padded[1:]], 1)


def _mean_rows(table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, 0) / sizes[:, None].astype(np.float32)


def _sum_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to the places ``at`` of a table, places repeated or not."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    into[places[first]] += np.add.reduceat(rows[order], first, 0)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Small random weights; gates in the order update, reset, candidate."""
    d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION
    shapes = {"word": ((WORDS, WORD_DIM), 0.1), "char": ((GRAMS, CHAR_DIM), 0.2), "wx": ((2, d, 3 * h), d**-0.5), "u": ((2, h, 3 * h), h**-0.5), "b": ((2, 1, 3 * h), 0.0), "att": ((2 * h, a), (2 * h) ** -0.5), "va": ((a,), a**-0.5), "out": ((2 * h,), (2 * h) ** -0.5), "bo": ((1,), 0.0)}
    return {k: (rng.standard_normal(s) * scale).astype(np.float32) for k, (s, scale) in shapes.items()}


def forward(p: dict, batch: np.ndarray, vocab: Grams) -> tuple[np.ndarray, dict]:
    """Logits of windows (B, T) of word numbers, and what the gradient needs."""
    uniq, place = np.unique(batch, return_inverse=True)
    place = place.reshape(batch.shape)
    grams, word = vocab.of(uniq), vocab.word[uniq]
    x = np.concatenate([p["word"][word], _mean_rows(p["char"], *grams)], 1)
    xp = x @ p["wx"] + p["b"]  # (2, U, 3H)
    b, t = batch.shape
    h = np.zeros((2, b, HIDDEN), np.float32)
    order = np.stack([place, place[:, ::-1]])
    kept = []
    states = np.zeros((2, t, b, HIDDEN), np.float32)
    for s in range(t):
        xs = np.stack([xp[0][order[0][:, s]], xp[1][order[1][:, s]]])
        hu = h @ p["u"]
        zr = _sigmoid(xs[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        n = np.tanh(xs[..., 2 * HIDDEN :] + r * hu[..., 2 * HIDDEN :])
        kept.append((h, z, r, n, hu[..., 2 * HIDDEN :]))
        h = n + z * (h - n)
        states[:, s] = h
    both = np.concatenate([states[0], states[1][::-1]], 2)  # (T, B, 2H)
    key = np.tanh(both @ p["att"])
    e = key @ p["va"]
    e -= e.max(0)
    a = np.exp(e)
    a /= a.sum(0)
    pool = (a[..., None] * both).sum(0)
    return pool @ p["out"] + p["bo"], {"x": x, "word": word, "grams": grams, "order": order, "kept": kept, "both": both, "key": key, "a": a, "pool": pool}


def gradients(p: dict, c: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of a loss whose derivative by the logits is ``d_logit``."""
    h = HIDDEN
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"], g["bo"] = c["pool"].T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pool = d_logit[:, None] * p["out"]
    both, key, a = c["both"], c["key"], c["a"]
    d_a = (both * d_pool).sum(2)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_both = a[..., None] * d_pool
    d_key = d_e[..., None] * p["va"] * (1 - key * key)
    g["va"] = np.einsum("tb,tba->a", d_e, key)
    g["att"] = np.einsum("tbh,tba->ha", both, d_key)
    d_both += d_key @ p["att"].T
    t = both.shape[0]
    d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]])
    d_xp = np.zeros((2, len(c["x"]), 3 * h), np.float32)
    d_xs = np.empty((2, t, both.shape[1], 3 * h), np.float32)
    d_h = np.zeros_like(c["kept"][0][0])
    for s in range(t - 1, -1, -1):
        h0, z, r, n, hun = c["kept"][s]
        d_h = d_h + d_states[:, s]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h0 - n) * z * (1 - z)
        d_r = d_n * hun * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_n], 2)
        d_hu = np.concatenate([d_z, d_r, d_n * r], 2)
        g["u"] += h0.transpose(0, 2, 1) @ d_hu
        d_h = d_h * z + d_hu @ p["u"].transpose(0, 2, 1)
        d_xs[:, s] = d_x
    for k in (0, 1):
        _sum_rows(d_xp[k], c["order"][k].T.ravel(), d_xs[k].reshape(-1, 3 * h))
    g["b"] = d_xp.sum(1, keepdims=True)
    g["wx"] = c["x"].T @ d_xp
    d_in = (d_xp @ p["wx"].transpose(0, 2, 1)).sum(0)
    _sum_rows(g["word"], c["word"], d_in[:, :WORD_DIM])
    flat, sizes = c["grams"]
    _sum_rows(g["char"], flat, np.repeat(d_in[:, WORD_DIM:] / sizes[:, None].astype(np.float32), sizes, 0))
    return g


class _Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 5.0 / (size + 1e-9))
        lift = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x = x * np.float32(clip)
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (lift * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)).astype(np.float32)


class Scorer:
    """The trained network, folded for scoring, with a worker's known words."""

    def __init__(self, p: dict | None, weights: np.ndarray, prior: float):
        self.p, self.weights, self.prior = p, weights, prior
        self._forget()

    def __getstate__(self):
        return self.p, self.weights, self.prior

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.known = 0
        self.rows = np.zeros((2, 1 << 12, 3 * HIDDEN), np.float32)

    def hold(self, rows: np.ndarray) -> None:
        """Add input projections of the words numbered next; room grows by half."""
        end = self.known + rows.shape[1]
        if end > self.rows.shape[1]:
            wider = np.zeros((2, max(end, self.rows.shape[1] * 3 // 2), 3 * HIDDEN), np.float32)
            wider[:, : self.known] = self.rows[:, : self.known]
            self.rows = wider
        self.rows[:, self.known : end] = rows
        self.known = end

    def _learn(self) -> None:
        fresh = list(islice(self.number, self.known, None))
        if fresh:
            self.hold(self.project(Grams(fresh)))

    def project(self, words: Grams) -> np.ndarray:
        """Input projections (direction, word, gate units) of some words."""
        x = np.empty((len(words.word), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["word"][words.word]
        for i in range(0, len(x), WORDS_PER_PASS):
            sizes = words.sizes[i : i + WORDS_PER_PASS]
            end = words.ends[i + len(sizes) - 1]
            x[i : i + len(sizes), WORD_DIM:] = _mean_rows(self.p["char"], words.flat[end - sizes.sum() : end], sizes)
        rows = x @ self.p["wx"] + self.p["b"]
        rows[..., : 2 * HIDDEN] *= 0.5  # sigmoid by tanh
        return rows

    def logits(self, batch: np.ndarray) -> np.ndarray:
        """Logits of windows of known word numbers; states lie (unit, window)."""
        p, b = self.p, len(batch)
        u = p["u"].transpose(0, 2, 1).copy()
        u[:, : 2 * HIDDEN] *= 0.5
        h = np.zeros((2, HIDDEN, b), np.float32)
        states = np.empty((2, WINDOW, HIDDEN, b), np.float32)
        xs = np.empty((2, 3 * HIDDEN, b), np.float32)
        forward_rows, backward_rows = self.rows
        for s in range(WINDOW):
            xs[0] = forward_rows[batch[:, s]].T
            xs[1] = backward_rows[batch[:, WINDOW - 1 - s]].T
            hu = u @ h
            zr = hu[:, : 2 * HIDDEN]
            zr += xs[:, : 2 * HIDDEN]
            np.tanh(zr, zr)
            zr *= 0.5
            zr += 0.5
            n = hu[:, 2 * HIDDEN :]
            n *= zr[:, HIDDEN:]
            n += xs[:, 2 * HIDDEN :]
            np.tanh(n, n)
            h -= n
            h *= zr[:, :HIDDEN]
            h += n
            states[0, s] = h[0]
            states[1, WINDOW - 1 - s] = h[1]
        e = p["va"] @ np.tanh(p["att"][:HIDDEN].T @ states[0] + p["att"][HIDDEN:].T @ states[1])  # (T, b)
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        out = p["out"]
        worth = np.einsum("h,thb->tb", out[:HIDDEN], states[0]) + np.einsum("h,thb->tb", out[HIDDEN:], states[1])
        return (a * worth).sum(0) + p["bo"]

    def highest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit and number of windows of each text."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        number = self.number
        parts = []
        for text in texts:
            found = (text or "").lower().split()
            parts.append(windows(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))))
        self._learn()
        sizes = np.array([len(x) for x in parts])
        rows = np.concatenate(parts)
        scores = np.concatenate([self.logits(rows[i : i + 1024]) for i in range(0, len(rows), 1024)])
        return np.maximum.reduceat(scores, np.cumsum(sizes) - sizes), sizes

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the label toxic for each text."""
        if self.p is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for a, b in passes([len(t or "") for t in texts], 1_000_000):
            top, count = self.highest(texts[a:b])
            out[a:b] = _sigmoid(_design(top, count) @ self.weights)
        return out


def _design(top: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(top)), top, np.log(count)], 1).astype(np.float64)


def _contrast(docs: list[np.ndarray], toxic: np.ndarray, vocab: Grams) -> np.ndarray:
    """For each word the strongest log ratio of document frequencies of its features."""
    width = WORDS + GRAMS
    df = np.zeros((2, width))
    for words, label in zip(docs, toxic, strict=True):
        if len(words):
            mine = np.unique(words)
            df[int(label), np.unique(np.concatenate([vocab.word[mine], WORDS + vocab.of(mine)[0]]))] += 1
    n0, n1 = max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())
    ratio = np.log((df[1] + 0.2) / (n1 + 0.4)) - np.log((df[0] + 0.2) / (n0 + 0.4))
    strength = ratio * np.sqrt(np.minimum(df[1], 25))  # rare features prove little
    return np.maximum(strength[vocab.word], np.maximum.reduceat(strength[WORDS + vocab.flat], vocab.ends - vocab.sizes))


def train(texts: list[str], labels: list[int], fit: Fit | None = None, odds: float | None = None) -> Scorer:
    """The scorer learned from labelled texts; a fifth of them only fits the last step.

    odds: clean documents for each toxic one where the scorer will work.
    """
    fit = fit or Fit()
    toxic = np.array(labels, np.int64)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    if len(set(toxic.tolist())) < 2:
        return Scorer(None, np.zeros(3), prior)
    rng = np.random.default_rng(fit.seed)
    number, docs = word_numbers(texts)
    vocab = Grams(list(number))
    shuffled = rng.permutation(len(docs))
    apart = np.zeros(len(docs), bool)
    for label in (0, 1):
        mine = shuffled[toxic[shuffled] == label]
        apart[mine[: len(mine) // 5]] = True
    seen = np.flatnonzero(~apart)
    parts = [windows(docs[i]) for i in seen]
    sizes = np.array([len(x) for x in parts])
    rows, owner = np.concatenate(parts), np.repeat(np.arange(len(seen)), sizes)
    del parts
    bad = toxic[seen][owner] == 1
    worth = _contrast([docs[i] for i in seen], toxic[seen], vocab)[rows].max(1)
    p = new_parameters(rng)
    adam = _Adam(p, fit.rate)
    scorer = Scorer(p, np.array([0.0, 1.0, 0.0]), prior)
    scorer.number = number
    for turn in range(fit.rounds):
        best = np.maximum.reduceat(worth, np.cumsum(sizes) - sizes)[owner]
        positive = np.flatnonzero(bad & (worth >= (0.8 * best if turn == 0 else np.minimum(best, 0.0))))
        positive = rng.permutation(positive)[: fit.most_positive]
        clean = np.flatnonzero(~bad)
        hard = clean[np.argsort(-worth[clean])[: len(positive)]]
        negative = np.union1d(rng.choice(clean, min(len(clean), fit.negatives * len(positive)), replace=False), hard)
        chosen = np.concatenate([positive, negative])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(np.float32)
        weight = np.where(target == 1, 0.5 / max(1, len(positive)), 0.5 / max(1, len(negative))).astype(np.float32) * len(chosen)
        for _ in range(fit.epochs if turn == 0 else fit.epochs // 2):
            mixed = rng.permutation(len(chosen))
            for i in range(0, len(mixed), fit.batch):
                pick = mixed[i : i + fit.batch]
                logit, cache = forward(p, rows[chosen[pick]], vocab)
                adam.step(gradients(p, cache, ((_sigmoid(logit) - target[pick]) * weight[pick] / len(pick)).astype(np.float32)))
            adam.rate *= 0.9
        scorer.known = 0
        scorer.hold(scorer.project(vocab))
        worth = np.concatenate([scorer.logits(rows[i : i + 1024]) for i in range(0, len(rows), 1024)])
    held = np.flatnonzero(apart)
    top, count = scorer.highest([texts[i] for i in held])
    clean_weight = (odds or 1.0) * toxic[held].sum() / max(1, (1 - toxic[held]).sum()) if odds else 1.0
    scorer.weights = _logistic(_design(top, count), toxic[held].astype(float), clean_weight)
    scorer._forget()
    return scorer


def _logistic(x: np.ndarray, y: np.ndarray, clean_weight: float, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the network's own logit."""
    base = np.array([0.0, 1.0, 0.0])
    w, pull = base.copy(), np.diag([1e-3, ridge, ridge])
    balance = np.where(y == 1, 1.0, clean_weight)
    for _ in range(50):
        q = _sigmoid(x @ w)
        grad = x.T @ ((q - y) * balance) + pull @ (w - base)
        step = np.linalg.solve((x * (balance * q * (1 - q))[:, None]).T @ x + pull, grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[DataFrame, float]:
    """doc_id, text, toxic: about the bound of each class, chosen by a hash of
    doc_id; and the number of clean labels for each toxic one."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold() != 0).distinct()
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, fit.toxic_docs / max(1, counts.get(1, 0))).otherwise(fit.clean_docs / max(1, counts.get(0, 0)))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= fit.longest)
    return text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), counts.get(0, 0) / max(1, counts.get(1, 0))


def fit_scorer(docs: DataFrame, labels: DataFrame, fit: Fit | None = None) -> Scorer:
    """Learn from labelled documents outside the held-out fold."""
    fit = fit or Fit()
    found, odds = sample(docs, labels, fit)
    rows = sorted(tuple(r) for r in found.collect())
    return train([r[1] for r in rows], [r[2] for r in rows], fit, odds)


def score_column(scorer: Scorer, docs: DataFrame, column: str = "text") -> Column:
    """The toxicity of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score([t if isinstance(t, str) else None for t in texts]))

    return toxicity(F.col(column).cast("string"))


def score_documents(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score_column(scorer, docs).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """Documents below the threshold; all columns stay."""
    names = docs.columns
    return docs.withColumn("_toxicity", score_column(scorer, docs)).filter(F.col("_toxicity") < threshold).select(*[F.col(f"`{n}`") for n in names])
