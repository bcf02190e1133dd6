"""Language of whole texts by a string kernel.

Two texts are compared by the n-grams (one to four bytes of the lowered
letters) that both hold: the blended-spectrum presence kernel is the number of
common n-grams over the root of the product of both numbers.  A set of landmark
texts gives the Nystroem approximation of the kernel, and one ridge regression
for each language separates it from the rest.

N-grams are exact, never hashed together: an n-gram of four bytes is a 32-bit
number, and only those that some landmark holds can add to a kernel, so they are
the columns of the presence matrix; a text's other n-grams count in its norm.

A text is cut into pieces of about 1,000 characters, so that a long text's
n-grams don't saturate; all its pieces are scored, by batched matrix products
(presence by landmarks, then by coefficients), and their mean decides.

The fit reads at most about ``Fit.per_language`` documents of each language,
chosen by a hash of doc_id, none longer than ``Fit.longest``; scoring covers
every text.

Defined cases: a text that is null or has no letter (Unicode category L) is "und"
with score 0; with no labelled text to learn from all others are "und" too; a very
long text is scored piece by piece, whole; ties go to the first language in
binary order; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_arrow, texts_of

PIECE = 1000
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
SLOT_BITS = 20
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


@dataclass
class Fit:
    """Bounds and settings of the fit."""

    per_language: int = 500
    longest: int = 100_000
    pieces: int = 4000
    landmarks: int = 128
    ridge: float = 1e-2
    seed: int = 11


def pieces(text: str) -> list[bytes]:
    """The lowered letters of a text, words parted by blanks, in pieces."""
    letters = f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")
    count = max(1, round(len(letters) / PIECE))
    cuts = [len(letters) * i // count for i in range(count + 1)]
    return [letters[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def ngrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, n-gram) of every distinct n-gram of every piece; an n-gram is its bytes and length as one number."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    code, keys = np.zeros(len(data), np.uint64), []
    for n in range(1, max(SIZES) + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        if n in SIZES:
            same = row[: len(code)] == row[n - 1 :]
            keys.append((row[: len(code)][same] << np.uint64(40)) | np.uint64(n << 32) | code[same])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = np.sort(np.concatenate(keys))
    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return (found >> np.uint64(40)).astype(np.int64), found & np.uint64((1 << 40) - 1)


class Landmarks:
    """Pieces that all others are compared with, by the n-grams that they hold."""

    def __init__(self, parts: list[bytes]):
        row, gram = ngrams(parts)
        self.grams, column = np.unique(gram, return_inverse=True)
        # A slot names one n-gram; those whose slot another has are looked up by search.
        slot = self._slot(self.grams)
        order = np.argsort(slot, kind="stable")
        first = np.concatenate([[True], slot[order][1:] != slot[order][:-1]]) if len(slot) else np.zeros(0, bool)
        self.table = np.full(1 << SLOT_BITS, -1, np.int32)
        self.table[slot[order][first]] = order[first]
        self.crowded = np.zeros(1 << SLOT_BITS, bool)
        self.crowded[slot[order][~first]] = True
        norms = np.sqrt(np.maximum(np.bincount(row, minlength=len(parts)), 1))
        self.matrix = np.zeros((len(self.grams), len(parts)), np.float32)
        self.matrix[column, row] = (1 / norms)[row]

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def kernel(self, parts: list[bytes]) -> np.ndarray:
        """Kernel values (piece, landmark)."""
        row, gram = ngrams(parts)
        norms = np.sqrt(np.maximum(np.bincount(row, minlength=len(parts)), 1)).astype(np.float32)
        slot = self._slot(gram)
        column = self.table[slot]
        hard = np.flatnonzero(self.crowded[slot])
        column[hard] = np.minimum(np.searchsorted(self.grams, gram[hard]), len(self.grams) - 1)
        here = np.flatnonzero(column >= 0)
        here = here[self.grams[column[here]] == gram[here]]
        presence = np.zeros((len(parts), len(self.grams)), np.float32)
        presence[row[here], column[here]] = 1
        return presence @ self.matrix / norms[:, None]


class Classifier:
    """Landmarks and the coefficients of each language."""

    def __init__(self, languages: list[str], landmarks: Landmarks, coefficients: np.ndarray):
        self.languages, self.landmarks, self.coefficients = languages, landmarks, coefficients

    def scores(self, parts: list[bytes]) -> np.ndarray:
        """Ridge outputs (piece, language)."""
        return np.concatenate([self.landmarks.kernel(parts), np.ones((len(parts), 1), np.float32)], 1) @ self.coefficients

    def predict(self, texts: list[str], limit: int = 128) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        held: list[bytes] = []
        owner: list[int] = []
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))

        def flush() -> None:
            if held:
                np.add.at(sums, owner, self.scores(held))
                np.add.at(counts, owner, 1)
                held.clear()
                owner.clear()

        for i, text in enumerate(texts):
            if _LETTER.search(text):
                for part in pieces(text):
                    held.append(part)
                    owner.append(i)
                    if len(held) >= limit:
                        flush()
        flush()
        for i in np.flatnonzero(counts):
            mean = sums[i] / counts[i]
            best = int(np.argmax(mean))
            spread = np.exp(4 * (mean - mean[best]))
            out[i] = (self.languages[best], float(1 / spread.sum()))
        return out


def train(texts: list[str], labels: list[str], fit: Fit | None = None) -> Classifier:
    """The classifier learned from labelled texts."""
    fit = fit or Fit()
    rng = np.random.default_rng(fit.seed)
    rows = [(part, label) for text, label in zip(texts, labels, strict=True) if _LETTER.search(text) for part in pieces(text)]
    if not rows:
        return Classifier([], Landmarks([]), np.zeros((1, 0)))
    by = {}
    for part, label in rows:
        by.setdefault(label, []).append(part)
    languages = sorted(by)
    parts, of = [], []
    for k, language in enumerate(languages):
        mine = by[language]
        pick = rng.permutation(len(mine))[: max(1, fit.pieces // len(languages))]
        parts += [mine[i] for i in pick]
        of += [k] * len(pick)
    of = np.array(of)
    each = max(1, fit.landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(of == k))[:each] for k in range(len(languages))])
    landmarks = Landmarks([parts[i] for i in chosen])
    between = landmarks.kernel([parts[i] for i in chosen]).astype(np.float64)
    kernels = [landmarks.kernel(parts[i : i + 256]) for i in range(0, len(parts), 256)]
    kernel = np.concatenate([np.concatenate(kernels), np.ones((len(parts), 1), np.float32)], 1).astype(np.float64)
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same; the penalty is the norm in the landmarks' space.
    weight = 1.0 / np.bincount(of)[of]
    penalty = np.zeros((len(chosen) + 1,) * 2)
    penalty[:-1, :-1] = between
    gram = kernel.T @ (kernel * weight[:, None]) + fit.ridge * penalty + 1e-8 * np.eye(len(penalty))
    return Classifier(languages, landmarks, np.linalg.solve(gram, kernel.T @ (target * weight[:, None])).astype(np.float32))


def fit_classifier(docs: DataFrame, fit: Fit | None = None) -> Classifier:
    """Learn from documents with a language outside the held-out fold."""
    fit = fit or Fit()
    lang = F.col("lang").cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(fold() != 0)
    counts = [r for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # a row for each language
    if not counts:
        return train([], [], fit)
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], fit.per_language / r["n"]) for r in counts], "lang string, share double"))
    mark = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.join(share, "lang").filter((mark < F.col("share")) & (F.length("text") <= fit.longest))
    found = sorted((r["doc_id"], r["text"], r["lang"]) for r in sample.select("doc_id", "text", "lang").collect())
    return train([r[1] for r in found], [r[2] for r in found], fit)


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
