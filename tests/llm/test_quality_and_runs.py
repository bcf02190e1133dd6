"""Quality by votes and periodic runs against plain Python over whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from studylake.llm import period_runs, quality_rules, queries
from studylake.llm.common import read_table

from .conftest import frame

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality --------------------------------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(x in "#*$%&|<>" for x in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_columns_of_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in queries.op11_quality_rules(spark, FOLDER).collect()}
    assert {i: tuple(r[c] for c in (*quality_rules.MEASURES, "base_failed")) for i, r in found.items()} == {i: base(t) for i, t in texts.items()}
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5) for r in found.values())


def test_repeated_windows_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 17, 40, 300)]
    texts += [" ".join(map(str, [*range(30), *range(5, 25), *range(30), 7])), "x\n x\nx\n\n \nx", "a b   c\x1f", "naïve ÉTÉ <b>*&"]
    found = quality_rules.measure(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality_rules.MEASURES) for r in found} == {i: base(t)[:5] for i, t in enumerate(texts)}


def test_labels_agree_on_the_large_table(spark):
    """Labels are never read by the rules; most labelled texts come out as their label says."""
    folder = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in read_table(spark, folder, "labels").collect()}
    rows = [(label[r["doc_id"]], r["kept"]) for r in queries.op11_quality_rules(spark, folder).collect() if r["doc_id"] in label]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert sum(bad) <= 0.05 * len(bad)
    long_enough = sum(good) / len(good)
    assert long_enough >= 0.95


def test_estimate_finds_planted_rates():
    """Rules of unequal worth: one that never votes good, one that votes at random."""
    rng = np.random.default_rng(1)
    rates = {"a": ((0.5, 0.3, 0.2), (0.02, 0.18, 0.8)), "b": ((0.6, 0.4, 0.0), (0.01, 0.99, 0.0)), "c": ((0.4, 0.2, 0.4), (0.05, 0.15, 0.8)), "d": ((0.1, 0.2, 0.7), (0.1, 0.2, 0.7)), "e": ((0.7, 0.1, 0.2), (0.1, 0.1, 0.8))}
    good = (rng.random(60_000) < 0.75).astype(int)
    drawn = np.stack([np.where(good == 1, rng.choice(3, len(good), p=g), rng.choice(3, len(good), p=b)) for b, g in rates.values()], 1) - 1
    model = quality_rules.estimate(sorted(Counter(map(tuple, drawn.tolist())).items()), list(rates))
    assert abs(model.good - 0.75) < 0.03
    for r, both in rates.items():
        assert np.abs(np.array(model.rates[r]) - np.array(both)).max() < 0.06, (r, model.rates[r])
    assert model.accuracies()["a"] > 0.9 > model.accuracies()["d"]


def test_posterior_is_bayes(spark):
    names = [r.name for r in quality_rules.RULES]
    rng = random.Random(2)
    share = lambda a, b, c: tuple(x / (a + b + c) for x in (a, b, c))
    model = quality_rules.Model(0.6, {n: (share(4 + rng.random(), 1, 2), share(1, 1, 4 + rng.random())) for n in names}, 1)
    rows = [tuple(rng.choice((-1, 0, 1)) for _ in names) for _ in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"vote_{n} int" for n in names)).select("*", quality_rules.posterior(model).alias("p"))
    for r in df.collect():
        up, down = model.good, 1 - model.good
        for n in names:
            up, down = up * model.rates[n][1][r[f"vote_{n}"] + 1], down * model.rates[n][0][r[f"vote_{n}"] + 1]
        assert abs(r["p"] - up / (up + down)) < 1e-9


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    found = quality_rules.judge(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in found}
    for i in (1, 2, 3, 6, 7, 8, 9, None):
        assert by_id[i]["base_failed"] and not by_id[i]["kept"]
    assert by_id[1]["quality"] == by_id[2]["quality"] == 0.0
    assert (by_id[4]["n_words"], by_id[4]["n_repeat_words"], by_id[4]["base_failed"]) == (120_000, 120_000, True)
    assert by_id[9]["word_chars"] == 200_000
    assert quality_rules.judge(no_docs).count() == 0


# --- periodic runs ---------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    """Every maximal stretch of every period, the smallest period of equal stretches."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p) and i > start:
                found.setdefault((start, i + p - start), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2],
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    some = {i: t for i, t in texts.items() if len(t or "") < 6000}  # the plain version is quadratic
    assert len(found) == len(texts) and len(some) > 900
    assert {i: found[i] for i in some} == {i: plain_row(i, t) for i, t in some.items()}
    assert sum(r[0] > 0 for r in found.values()) > 50


@pytest.mark.parametrize("points", [7, 200, 1_000_000])
def test_runs_of_random_words(monkeypatch, points):
    """Few words, planted stretches, several texts a pass, parts of any size."""
    monkeypatch.setattr(period_runs, "POINTS", points)
    rng = random.Random(points)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(150))]
            for _ in range(rng.randrange(3)):
                if len(words) > 30:
                    a, p = rng.randrange(len(words) - 20), rng.randrange(1, 20)
                    for i in range(a + p, min(len(words), a + rng.randrange(90))):
                        words[i] = words[i - p]
            texts.append(words)
        rows = period_runs.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64))
        for k, t in enumerate(texts):
            assert [tuple(r[1:].tolist()) for r in rows if r[0] == k] == plain_runs(t)


def test_long_texts_stay_near_linear():
    """One run of a third of a million words, one word alone, every second word equal."""
    for words in (np.arange(300_000) % 6, np.zeros(300_000, np.int64), np.where(np.arange(300_000) % 2, np.arange(300_000), -1)):
        rows = period_runs.runs_of(words.astype(np.int64), np.array([len(words)]))
        assert len(rows) == (0 if words[1] == 1 and words[2] == -1 else 1)


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    found = {r["doc_id"]: r for r in period_runs.find_runs(odd_docs).collect()}
    assert found[1]["runs"] == found[2]["runs"] == found[3]["runs"] == [] and found[1]["collapsed"] == ""
    assert [tuple(r) for r in found[4]["runs"]] == [(0, 120_000, 6)] and found[4]["collapsed"] == "lorem ipsum dolor sit amet consectetur"
    assert found[9]["n_words"] == 1 and found[9]["collapsed"] == "x" * 200_000
    assert found[None]["collapsed"] == "a null id with some words in it"
    assert period_runs.find_runs(odd_docs).count() == odd_docs.count()
    assert period_runs.digest_runs(period_runs.find_runs(period_runs.repeat_tails(no_docs))).count() == 0
