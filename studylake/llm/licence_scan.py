"""Licence families of paragraphs by a trained sparse classifier.

A paragraph (a line) is the set of its word n-grams (one to three words), those left
out that hold only words of more than a share ``common`` of ordinary lines.  One
logistic regression for each family and one for the class "unknown", made sparse
by an L1 penalty, separate its rows from all else.  Their logits are calibrated
on rows that they didn't see: the rows are dealt to ``folds``, each scored by the
regressions of the others, so that every notice counts once.  A family claims a
paragraph if its probability reaches ``sure`` and that of unknown; a paragraph may
be claimed by several families (two notices in one line).  A claim is confirmed if
the paragraph shares ``overlap`` of the word trigrams of the shorter of itself and
one of the family's templates.

The fit is small: templates, their parts and wordings around them, lines that are no
notices, and at most ``negatives`` lines of about ``documents`` documents (lines of
at most ``longest`` characters, chosen by hash, those that resemble a template left
out).  It runs in numpy on the driver; scanning is DataFrame functions only.

Scanning reads every whole text once.  A family can claim a paragraph only if
its positive weights reach the bar.  ``anchors`` are words without any of which they
can't: texts without one are done.  ``worth`` bounds what each word can add to
the claim nearest to its bar (each n-gram is counted at its rarest word): of the
others, paragraphs whose words add up to less than one are unknown for certain.
Only what is left is taken apart.

Defined cases: a null or empty text has no licence; a very long text or line is
read whole; equally probable families all claim; rows that repeat a doc_id or text
each get their row; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .licence_texts import NEITHER, TEMPLATES

SPLIT = "[^a-z0-9]+"


@dataclass
class Fit:
    """Bounds and settings of the fit."""

    documents: int = 2000
    negatives: int = 2000
    longest: int = 2000
    common: float = 0.01
    steps: int = 200
    folds: int = 3
    rate: float = 0.5
    sparse: float = 5e-4
    sure: float = 0.7
    overlap: float = 0.7
    seed: int = 5


def words(text: str) -> list[str]:
    """Lowered runs of ASCII letters and digits."""
    return [w for w in re.split(SPLIT, text.lower()) if w]


def grams(w: list[str], low: int = 1, high: int = 3) -> set[str]:
    """The word n-grams of a paragraph."""
    return {" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)}


def _parts(w: list[str]) -> list[list[str]]:
    """A notice, cut to its longer parts, and with words around it."""
    n = len(w)
    out = [w, ["this", "file", "is", *w], [*w, "see", "the", "file", "for", "details"], ["copyright", "2020", *w]]
    if n > 12:
        out += [w[: n * 2 // 3], w[n // 3 :], w[: n // 2], w[n // 2 :]]
    return out


def resembles(w: list[str], overlap: float) -> bool:
    """Whether some template shares that much with the paragraph."""
    mine = grams(w, 3, 3) or grams(w)
    return any(len(mine & t) >= overlap * max(1, min(len(mine), len(t))) for f in TEMPLATES.values() for t in (grams(words(x), 3, 3) or grams(words(x)) for x in f))


@dataclass
class Model:
    """Sparse weights by n-gram (a column a family, the last for unknown), biases, calibration, bounds."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    scale: list[tuple[float, float]]  # probability = logistic(a * logit + b)
    anchors: list[str]
    worth: dict[str, float]
    fit: Fit

    def probabilities(self, w: list[str]) -> np.ndarray:
        """Of each family and of unknown."""
        logits = np.array(self.bias) + sum((np.array(self.weights[g]) for g in sorted(grams(w)) if g in self.weights), np.zeros(len(self.bias)))
        return np.array([1 / (1 + np.exp(-(a * x + b))) for x, (a, b) in zip(logits, self.scale, strict=True)])

    def claims(self, w: list[str]) -> dict[str, float]:
        """The families that claim a paragraph, with their probabilities."""
        p = self.probabilities(w)
        return {f: float(q) for f, q in zip(self.families, p, strict=False) if q >= self.fit.sure and q >= p[-1]}


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train(corpus_lines: list[str], fit: Fit | None = None) -> Model:
    """The model from templates, plain lines and some lines of the corpus."""
    fit = fit or Fit()
    rng = np.random.default_rng(fit.seed)
    families = sorted(TEMPLATES)
    rows = [(part, k) for k, f in enumerate(families) for t in TEMPLATES[f] for part in _parts(words(t))]
    plain = [words(x) for x in NEITHER] + [w for w in map(words, corpus_lines) if w and not resembles(w, fit.overlap)]
    rows += [(w, -1) for w in plain]
    counts: dict[str, int] = {}
    for w, k in rows:
        if k >= 0:
            for g in grams(w):
                counts[g] = counts.get(g, 0) + 1
    lines: dict[str, int] = {}
    for line in plain:
        for word in set(line):
            lines[word] = lines.get(word, 0) + 1
    common = {word: n / len(plain) for word, n in lines.items()}
    told = sorted(g for g, n in counts.items() if n >= 2 and min(common.get(word, 0.0) for word in g.split()) < fit.common)
    vocabulary = {g: i for i, g in enumerate(told)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (w, _) in enumerate(rows):
        x[r, [vocabulary[g] for g in grams(w) if g in vocabulary]] = 1
    y = np.array([k % (len(families) + 1) for _, k in rows])[:, None] == np.arange(len(families) + 1)
    fold = rng.permutation(len(rows)) % fit.folds
    unseen = np.zeros(y.shape)
    for f in range(fit.folds):
        w, b = _regress(x[fold != f], y[fold != f], fit)
        unseen[fold == f] = x[fold == f] @ w + b
    scale = [_calibrate(unseen[:, k], y[:, k]) for k in range(y.shape[1])]
    w, b = _regress(x, y, fit)
    weights = {g: w[i].round(6).tolist() for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-6}
    model = Model(families, weights, b.round(6).tolist(), scale, [], {}, fit)
    model.anchors = _anchors(model, common)
    model.worth = _worth(model, common)
    return model


def _regress(x: np.ndarray, y: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic regression a column; both sides of each weigh the same."""
    share = np.where(y, 0.5 / np.maximum(1, y.sum(0)), 0.5 / np.maximum(1, (~y).sum(0)))
    w, b = np.zeros((x.shape[1], y.shape[1])), np.full(y.shape[1], -2.0)
    for _ in range(fit.steps):
        error = (_sigmoid(x @ w + b) - y) * share
        w -= fit.rate * 10 * (x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - fit.rate * fit.sparse * 10, 0)
        b -= fit.rate * error.sum(0)
    return w, b


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, held near 1 and 0 where rows are few."""
    x, w, pull = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0]), np.diag([0.5, 0.5])
    for _ in range(30):
        q = _sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + pull, x.T @ (q - y) + pull @ (w - [1.0, 0.0]))
        w = w - step
    return float(max(w[0], 0.1)), float(w[1])


def _bars(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and biases of the families, and the logits at which they are sure."""
    n = len(model.families)
    table = np.array(list(model.weights.values())).reshape(-1, n + 1)[:, :n]
    bars = np.array([(np.log(model.fit.sure / (1 - model.fit.sure)) - b) / a for a, b in model.scale[:n]]) - 1e-6
    return table, np.array(model.bias[:n]), bars


def _worth(model: Model, common: dict[str, float]) -> dict[str, float]:
    """For each word a bound of its share in reaching a bar: the sum over a paragraph's words is 1 or more if any family claims it."""
    table, bias, bars = _bars(model)
    need = np.maximum(bars - bias, 1e-9)
    sums: dict[str, np.ndarray] = {}
    for g, row in zip(model.weights, np.maximum(table, 0), strict=True):
        rarest = min(g.split(), key=lambda w: (common.get(w, 0.0), w))
        sums[rarest] = sums.get(rarest, 0) + row
    return {w: float((v / need).max()) for w, v in sums.items() if v.any()}


def _anchors(model: Model, common: dict[str, float]) -> list[str]:
    """Words without any of which no family's logit can reach its bar.

    ``common``: shares of ordinary lines that hold a word; rare words come first.
    """
    table, bias, bars = _bars(model)
    held, anchors = [set(g.split()) for g in model.weights], []
    left = np.ones(len(table), bool)
    while True:
        most = bias + np.maximum(table[left], 0).sum(0)
        open_families = most >= bars
        if not open_families.any() or not left.any():
            return sorted(anchors)
        worth: dict[str, float] = {}
        for i in np.flatnonzero(left):
            gain = float(np.maximum(table[i], 0)[open_families].sum())
            for w in held[i]:
                worth[w] = worth.get(w, 0.0) + gain / (1 + 1000 * common.get(w, 0.0))
        best = max(sorted(worth), key=worth.__getitem__)
        anchors.append(best)
        left &= np.array([best not in h for h in held])


def fit_model(docs: DataFrame, fit: Fit | None = None) -> Model:
    """Train with a bounded number of lines from about ``fit.documents`` documents, chosen by hash."""
    fit = fit or Fit()
    share = F.lit(fit.documents / max(1, docs.count()))  # the count comes from the files' own statistics
    mark = F.pmod(F.xxhash64(F.lit("licence"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) / 1_000_000
    some = docs.filter(mark < share)
    line = some.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).filter(F.length("line").between(1, fit.longest))
    found = line.orderBy(F.xxhash64(F.lit("licence"), "line"), "line").limit(fit.negatives).collect()
    return train([r["line"] for r in found], fit)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), SPLIT)


def _grams(w: Column, low: int, high: int) -> Column:
    """Distinct n-grams of an array of words."""
    runs = [F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), (lambda n: lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))(n)) for n in range(low, high + 1)]
    runs = [F.when(F.size(w) >= n, r).otherwise(F.array().cast("array<string>")) for n, r in zip(range(low, high + 1), runs, strict=True)]
    return F.array_distinct(F.concat(*runs))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per paragraph and family that claims it: row, paragraph, family, probability, confirmed.

    ``row`` numbers the documents of the second table returned, (row, doc_id).
    """
    spark, families, fit = docs.sparkSession, model.families, model.fit
    anchors = F.array(*[F.lit(a) for a in model.anchors])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The only pass over the texts; those without an anchor leave just their doc_id.
    kept = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.arrays_overlap(_words(text), anchors), text).alias("text"))
    rows = stage(kept, "licence-rows")
    worth = F.map_from_arrays(F.array(*[F.lit(w) for w in model.worth]), F.array(*[F.lit(v) for v in model.worth.values()])) if model.worth else F.create_map().cast("map<string,double>")
    bound = F.aggregate(F.array_intersect("w", F.map_keys(worth)), F.lit(0.0), lambda t, x: t + F.try_element_at(worth, x))
    par = rows.filter("text IS NOT NULL").select("row", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    par = par.withColumn("w", F.filter(_words(F.col("line")), lambda x: x != "")).filter(F.arrays_overlap("w", anchors)).filter(bound >= 1 - 1e-6).select("row", "paragraph", "w")
    # Dealt anew, so that the few texts with notices don't mean few tasks.
    par = stage(par.repartition("row", "paragraph"), "licence-paragraphs")
    n = len(families)
    # Bounded by the vocabulary of the templates above, whatever the corpus.
    table = F.broadcast(spark.createDataFrame([(g, *v) for g, v in model.weights.items()] or [("", *[0.0] * (n + 1))], ", ".join(["gram string", *[f"w{k} double" for k in range(n + 1)]])))
    hits = par.select("row", "paragraph", F.explode(_grams(F.col("w"), 1, 3)).alias("gram")).join(table, "gram")
    sums = hits.groupBy("row", "paragraph").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(n + 1)])
    p = [1 / (1 + F.exp(-(a * (F.col(f"w{k}") + b0) + b))) for k, (b0, (a, b)) in enumerate(zip(model.bias, model.scale, strict=True))]
    found = sums.select("row", "paragraph", p[n].alias("unknown"), F.array(*[F.struct(q.alias("p"), F.lit(f).alias("f")) for q, f in zip(p, families, strict=False)]).alias("c"))
    claim = F.explode(F.filter("c", lambda c: (c["p"] >= fit.sure) & (c["p"] >= F.col("unknown")))).alias("c")
    claims = found.select("row", "paragraph", claim).select("row", "paragraph", F.col("c.f").alias("family"), F.col("c.p").alias("probability"))
    templates = F.broadcast(spark.createDataFrame([(f, [sorted(grams(words(t), 3, 3) or grams(words(t))) for t in TEMPLATES[f]]) for f in families], "family string, templates array<array<string>>"))
    claimed = claims.join(par, ["row", "paragraph"]).join(templates, "family").withColumn("mine", F.when(F.size("w") >= 3, _grams(F.col("w"), 3, 3)).otherwise(_grams(F.col("w"), 1, 3)))
    near = F.exists("templates", lambda t: F.size(F.array_intersect("mine", t)) >= fit.overlap * F.least(F.size("mine"), F.size(t)))
    return claimed.select("row", "paragraph", "family", "probability", near.alias("confirmed")), rows.select("row", "doc_id")


def scan_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, licences (confirmed families), n_confirmed,
    n_unconfirmed, places (paragraph:family of the confirmed), probability (highest)."""
    found, rows = scan(docs, model)
    sure = F.col("confirmed")
    per = found.groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("licences"),
        F.count_if(sure).alias("n_confirmed"),
        F.count_if(~sure).alias("n_unconfirmed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(sure, F.struct("paragraph", "family")))), lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",").alias("places"),
        F.round(F.max("probability"), 4).alias("probability"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(per, "row", "left").select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), F.coalesce("places", F.lit("")).alias("places"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
