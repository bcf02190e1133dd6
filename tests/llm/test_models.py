"""Trained operators: held-out accuracy, gradients, and the pipeline by plain steps."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from studylake.llm import language_id, licence_scan, toxicity
from studylake.llm import queries as Q
from studylake.llm.licence_texts import TEMPLATES

from .conftest import frame
from .test_near_copies import _kept

MEDIUM = "/root/testdata/sf0.01"
#: Enough toxic labels (about 500) to learn from.
LARGE = "/root/testdata/sf0.1"


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# --- toxicity --------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in Q.op5_toxicity(spark, LARGE).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    assert all(r["held_out"] == _held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[i]["score"], t) for i, t in labels.items() if _held(i) and i in rows]
    good, bad = [s for s, t in held if t == 0], [s for s, t in held if t == 1]
    order = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert order > 0.95
    assert np.mean([(s >= 0.5) == t for s, t in held]) > 0.95


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) * 3 for k, v in toxicity.new_parameters(rng).items()}
    number, texts = toxicity.word_numbers(["some words of a text that is short", "another one, with words!", ""])
    vocab = toxicity.Grams(list(number))
    batch = np.concatenate([toxicity.windows(t) for t in texts])
    weight = rng.standard_normal(len(batch))
    _, cache = toxicity.forward(p, batch, vocab)
    got = toxicity.gradients(p, cache, weight)
    for name in ("wx", "u", "b", "att", "va", "out", "bo", "word", "char"):
        flat = p[name].reshape(-1)
        places = np.flatnonzero(np.abs(got[name].reshape(-1)) > 1e-4)
        for at in rng.permutation(places)[:4]:
            kept, step = flat[at], 3e-3  # states are single floats
            flat[at] = kept + step
            high = toxicity.forward(p, batch, vocab)[0] @ weight
            flat[at] = kept - step
            low = toxicity.forward(p, batch, vocab)[0] @ weight
            flat[at] = kept
            want = (high - low) / (2 * step)
            assert abs(want - got[name].reshape(-1)[at]) <= 0.02 * max(abs(want), 0.02), name


def test_folded_scorer_equals_network():
    rng = np.random.default_rng(4)
    p = toxicity.new_parameters(rng)
    scorer = toxicity.Scorer(p, np.array([0.0, 1.0, 0.0]), 0.5)
    texts = ["word " * 100, "one two three", ""]
    top, count = scorer.highest(texts)
    number, docs = toxicity.word_numbers(texts)
    vocab = toxicity.Grams(list(number))
    for words, t, n in zip(docs, top, count, strict=True):
        mine = toxicity.windows(words)
        assert len(mine) == n
        assert abs(toxicity.forward(p, mine, vocab)[0].max() - t) < 1e-4


def test_projections_need_little_beside_their_rows():
    """A row for each n-gram of all words at once took more than the projections themselves; the values stay."""
    rng = random.Random(1)
    words = toxicity.Grams(["", *("".join(rng.choices("abcdefgh", k=rng.randrange(1, 14))) for _ in range(50_000))])
    p = toxicity.new_parameters(np.random.default_rng(1))
    x = np.concatenate([p["word"][words.word], toxicity._mean_rows(p["char"], words.flat, words.sizes)], 1)
    want = x @ p["wx"] + p["b"]
    want[..., : 2 * toxicity.HIDDEN] *= 0.5
    scorer = toxicity.Scorer(p, np.array([0.0, 1.0, 0.0]), 0.1)
    tracemalloc.start()
    got = scorer.project(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 3.5 * got.nbytes


def test_query_equals_the_plain_network(spark, sf_dir):
    """Every document's score by the query's operator against windows, network and logistic function one by one."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    scorer = toxicity.fit_scorer(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_documents(small, scorer).collect()}
    p = {k: v.astype(np.float32) for k, v in scorer.p.items()}
    for r in small.collect():
        number, (words,) = toxicity.word_numbers([r["text"] or ""])
        vocab, cut = toxicity.Grams(list(number)), toxicity.windows(words)
        top = max(float(toxicity.forward(p, cut[i : i + 64], vocab)[0].max()) for i in range(0, len(cut), 64))
        want = 1 / (1 + np.exp(-(scorer.weights @ [1.0, top, np.log(len(cut))])))
        score, predicted = got[r["doc_id"]]
        assert abs(score - want) < 1e-3 and predicted == (score >= 0.5)


# --- language --------------------------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    right = []
    for r in Q.op6_language_id(spark, MEDIUM).collect():
        d = docs[r["doc_id"]]
        assert r["held_out"] == _held(r["doc_id"]) and 0 <= r["score"] <= 1
        has_letter = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)
        if r["held_out"] and d["lang"] and has_letter:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 100 and np.mean(right) > 0.93


def _naive_kernel(a, b):
    """Common n-grams of one to four bytes over the root of both numbers."""
    x, y = ({p[i : i + n] for n in (1, 2, 3, 4) for i in range(len(p) - n + 1)} for p in (a, b))
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_kernel_equals_sets_of_ngrams():
    rng = random.Random(6)
    make = lambda: " ".join("".join(rng.choice("abcdeé中") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 80))).encode()
    landmarks, parts = [make() for _ in range(40)], [*[make() for _ in range(60)], b"a", b"zz", b" "]
    got = language_id.Landmarks(landmarks).kernel(parts)
    want = [[_naive_kernel(p, m) for m in landmarks] for p in parts]
    assert np.allclose(got, want, atol=1e-5)


def test_predictions_equal_plain_sums(spark):
    """``predict`` against kernels by sets, sums of pieces and a softmax in plain Python."""
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(160).collect()]
    texts, langs = zip(*[(t[:6000], x) for t, x in rows], strict=True)
    fit = language_id.Fit(landmarks=24, pieces=120)
    kept = []
    wrapped = language_id.Landmarks
    language_id.Landmarks = lambda parts: kept.append(parts) or wrapped(parts)
    try:
        classifier = language_id.train(list(texts), list(langs), fit)
    finally:
        language_id.Landmarks = wrapped
    landmarks, asked = kept[0], [*texts[:25], "½ ²", "12 3", "", "x" * 3000]
    for text, (name, score) in zip(asked, classifier.predict(asked), strict=True):
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        parts = language_id.pieces(text)
        mean = np.mean([[*(_naive_kernel(p, m) for m in landmarks), 1.0] @ classifier.coefficients.astype(np.float64) for p in parts], 0)
        assert name == classifier.languages[int(np.argmax(mean))]
        assert abs(score - 1 / np.exp(4 * (mean - mean.max())).sum()) < 1e-3


# --- licences --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(spark, sf_dir):
    return licence_scan.fit_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_notices_get_their_family(spark, licence_model):
    rows, want = [], {}
    for n, (family, texts) in enumerate(TEMPLATES.items()):
        i = 100 + n
        rows.append((i, f"An ordinary line about rivers and towns.\n{texts[0]}\nAnother line.", None))
        want[i] = f"1:{family}"
    rows += [(900 + i, t, None) for i, t in enumerate(["She was licensed to drive in Version 2.0 of the town.", "All rights of free people were reserved to the general public license office", ""])]
    found = {r["doc_id"]: r for r in licence_scan.scan_documents(frame(spark, rows), licence_model).collect()}
    assert {i: found[i]["places"] for i in want} == want
    assert not any(found[i]["n_confirmed"] for i in (900, 901, 902))


def _confirmed(model, w, family):
    mine = licence_scan.grams(w, 3, 3) or licence_scan.grams(w)
    for t in TEMPLATES[family]:
        theirs = licence_scan.grams(licence_scan.words(t), 3, 3) or licence_scan.grams(licence_scan.words(t))
        if len(mine & theirs) >= model.fit.overlap * min(len(mine), len(theirs)):
            return True
    return False


def test_scan_equals_the_model_on_every_paragraph(spark, sf_dir, licence_model):
    """Every column against plain loops over all paragraphs, with notices put in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = [(10_000 + i, f"first\n{x}\nlast") for i, x in enumerate(NOTICES + ORDINARY)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    m, want = licence_model, {}
    for r in docs.collect():
        sure, doubtful, best = [], 0, 0.0
        for k, line in enumerate((r["text"] or "").split("\n")):
            w = licence_scan.words(line)
            for family, p in m.claims(w).items():
                best = max(best, p)
                if _confirmed(m, w, family):
                    sure.append((k, family))
                else:
                    doubtful += 1
        want[r["doc_id"]] = (",".join(sorted({f for _, f in sure})), len(sure), doubtful, ",".join(f"{k}:{f}" for k, f in sorted(sure)), round(best, 4))
    got = {r["doc_id"]: (r["licences"], r["n_confirmed"], r["n_unconfirmed"], r["places"], round(r["probability"], 4)) for r in licence_scan.scan_documents(docs, m).collect()}
    assert got == want and sum(n for _, n, *_ in want.values()) > 10


#: Notices as people write them, none of them a template.
NOTICES = [
    "Copyright 2019 Jane Doe. Licensed under the Apache License, Version 2.0 (the License)",
    "// Licensed under the Apache License, Version 2.0; see LICENSE",
    "code in this folder is released under the MIT License (see below)",
    "/* Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction */",
    "* Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "This file is subject to the terms of the Mozilla Public License, v. 2.0. Read it.",
    "Except where noted, this work is licensed under a Creative Commons Attribution 4.0 International License (CC BY)",
    "Photos: licensed under CC BY-NC 4.0, all others as marked",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this photograph.",
    "(c) 2011 Example Press. All rights reserved.",
    "Dual licence: released under the MIT License, or licensed under the Apache License, Version 2.0.",
]
FAMILIES = ["apache", "apache", "mit", "mit", "bsd", "gpl", "mpl", "cc-by", "cc-by-nc", "public-domain", "proprietary", "apache,mit"]
ORDINARY = [
    "The licence of the pub was renewed under new terms by the council.",
    "He had all rights reserved for himself, she said.",
    "Students may copy the source text without permission of the author.",
    "General Public opinion turned; version 3 of the bill was licensed to fail.",
    "A creative commons of ideas is what the attribution of his work asks for.",
    "The mit was lost, the apache rode on, and the software crashed.",
    "Provided that the following conditions are met, the bridge will open.",
    "Use of the public domain names list is subject to a fee.",
]


def test_varied_notices_have_precision_and_recall(spark, licence_model):
    rows = [(i, f"A line of prose about a town.\n{x}\nMore prose.", None) for i, x in enumerate(NOTICES + ORDINARY)]
    found = {r["doc_id"]: r["licences"] for r in licence_scan.scan_documents(frame(spark, rows), licence_model).collect()}
    right = sum(found[i] == f for i, f in enumerate(FAMILIES))
    wrong = sum(bool(found[i]) for i in range(len(NOTICES), len(rows)))
    assert right >= 0.9 * len(NOTICES) and wrong <= 1, (found, right, wrong)


def test_planted_notices_of_the_table_are_found(spark):
    """Precision and recall over the medium table: lines that the grammar of its notices names, and no other."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    planted = {}
    for r in docs.collect():
        lines = (r["text"] or "").split("\n")
        planted[r["doc_id"]] = sum(bool(re.search(r"(?i)licen[cs]ed under|released under the|all rights reserved", x)) for x in lines)
    found = {r["doc_id"]: r["n_confirmed"] for r in Q.op1_licence_scan(spark, MEDIUM).collect()}
    hit = sum(min(n, found[i]) for i, n in planted.items())
    assert hit >= 0.98 * sum(planted.values()) > 10
    assert hit >= 0.98 * sum(found.values())


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_by_plain_steps(spark, sf_dir):
    """Each stage against brute force over what the stage before it kept."""
    from studylake.llm import decontamination, line_dedup
    from studylake.llm.bytewords import text_words

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    a = steps["toxicity"](spark, docs, sf_dir)
    scorer = toxicity.fit_scorer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    kept = {r["doc_id"]: r["text"] for r, s in zip(rows, scorer.score([r["text"] for r in rows]), strict=True) if s < 0.5}
    assert {r["doc_id"] for r in a.collect()} == set(kept)

    b = steps["line_dedup"](spark, a, sf_dir)
    held: dict = {}
    for i, t in kept.items():
        for k in {k for k in line_dedup.line_keys(t or "") if k}:
            held.setdefault(k, set()).add(i)
    gone = {k: min(v) for k, v in held.items() if len(v) >= 10}
    texts = {}
    for i, t in kept.items():
        seen, out = set(), []
        for line, k in zip((t or "").split("\n"), line_dedup.line_keys(t or ""), strict=True):
            if k not in gone or (gone[k] == i and k not in seen):
                out.append(line)
                seen.add(k)
        texts[i] = "\n".join(out)
    assert {r["doc_id"]: r["text"] for r in b.collect()} == texts

    c = steps["near_dedup"](spark, b, sf_dir)
    texts = {i: texts[i] for i in _kept(texts)}
    assert {r["doc_id"] for r in c.collect()} == set(texts)

    d = steps["decontamination"](spark, c, sf_dir)
    items = [text_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        words = text_words(text)
        for mine in items:
            bag, n = decontamination.shingles(mine), len(mine)
            spots = [s for s in range(len(words) - 4) if tuple(words[s : s + 5]) in bag]
            starts = {s for p in spots for s in (range(max(0, p + 5 - n), min(p, len(words) - n) + 1) if len(words) >= n else (0,))}
            if any(decontamination.similarity(decontamination.shingles(words[s : s + n]), bag) >= 0.8 for s in starts):
                return True
        return False

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    assert {r["doc_id"] for r in d.collect()} == set(texts)
    assert d.columns == docs.columns

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(texts)


def test_short_texts_are_scored_alike_in_any_batch():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bad", "word", "fine"]) for _ in range(rng.randrange(90))) for _ in range(50)]
    scorer = toxicity.Scorer(toxicity.new_parameters(np.random.default_rng(1)), np.array([0.1, 1.0, -0.1]), 0.5)
    whole = scorer.score(texts)
    assert np.allclose(whole, [scorer.score([t])[0] for t in texts], atol=1e-5)
