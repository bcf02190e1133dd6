"""The pipeline's near copies against brute-force Jaccard."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from studylake.llm import common, near_copies, simhash_dedup

from .conftest import frame


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(texts: dict):
    sets = {i: _shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            either = len(sets[a] | sets[b])
            if not either or len(sets[a] & sets[b]) >= 0.8 * either:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in ids if root(i) == i}


def _stage(spark, docs):
    return {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}


def test_edited_copies_go(spark):
    rng = random.Random(4)
    texts = {}
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        for edits in (0, 0, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    texts |= {900: "", 901: None, 902: " \n", 903: "one", 904: "One", 905: "two words"}
    assert _stage(spark, frame(spark, [(i, t, None) for i, t in texts.items()])) == _kept(texts)


def test_chains_in_one_bucket(spark):
    """A walk: neighbours are near copies, ends are not."""
    rng = random.Random(9)
    words, texts = [f"w{k}" for k in range(300)], {}
    for i in range(60):
        words[rng.randrange(300)] = f"x{i}"
        texts[i] = " ".join(words)
    assert _stage(spark, frame(spark, [(i, t, None) for i, t in texts.items()])) == _kept(texts) == {0}


def _shared_passage(n, rng):
    """n texts of one long passage and words of their own, and n edited copies of a text that is not among them."""
    passage, base = [f"p{k}" for k in range(120)], [f"b{k}" for k in range(150)]
    texts = {}
    for i in range(n):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 120))]
        texts[i] = " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])
        words = list(base)
        for _ in range(rng.randrange(4, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts[10_000 + i] = " ".join(words)
    return texts


def test_shared_passages_cost_no_square(spark, monkeypatch):
    """Twice as many texts of one passage, or copies of one text, mean about twice as many comparisons."""
    compared = []
    plain = near_copies._with_texts
    monkeypatch.setattr(near_copies, "_with_texts", lambda pairs, texts: (compared.append(pairs.count()), plain(pairs, texts))[1])
    totals = []
    for n in (150, 300):
        compared.clear()
        texts = _shared_passage(n, random.Random(n))
        assert _stage(spark, frame(spark, [(i, t, None) for i, t in texts.items()])) == _kept(texts)
        totals.append(sum(compared))
    assert totals[1] < 3 * totals[0], totals


def test_sketches_pass_over_few_pairs():
    """Sets of similarity 0.8 are nearly always within APART, unrelated ones never."""
    rng = np.random.default_rng(4)
    apart = lambda a, b: sum((x ^ y).bit_count() if (x ^ y) >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(near_copies.sketch(a), near_copies.sketch(b), strict=True))
    for _ in range(300):
        words = np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
        a, b = words[:450], words[50:]
        assert near_copies.jaccard(a, b) >= 0.79
        assert apart(a, b) <= near_copies.APART
        assert apart(words[:250], words[250:]) > near_copies.APART


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert _stage(spark, docs) == _kept(texts)


def test_null_and_repeated_ids_and_no_rows(spark, odd_docs, no_docs):
    kept = near_copies.keep_one(odd_docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 6, 6, 7, 9, 10, 11]
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert near_copies.keep_one(no_docs).count() == 0


def test_simhash_tables_give_the_first_candidates(spark, monkeypatch):
    """One word of 4,000 changed: within two bits, linked by the tables and verified; a text of other words isn't."""
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(words), " ".join([*words[:7], "other", *words[8:]]), " ".join(f"v{k}" for k in range(4000))]
    found = []
    plain = near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda classes: (found.append(plain(classes).count()), plain(classes))[1])
    assert _stage(spark, frame(spark, [(i, t, None) for i, t in enumerate(texts)])) == {0, 2}
    assert found == [1]
    hashes = [near_copies.shingle_hashes(t.encode().split(), t.encode()) for t in texts]
    assert [simhash_dedup.majority(h) for h in hashes] == [simhash_dedup.fingerprint(t, near_copies.SHINGLE) for t in texts]


def test_batches_of_long_texts_are_bounded(spark):
    """A hub's text stands in each of its pairs: a batch is bounded in bytes too."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    pairs = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("x"))
    got = [r["n"] for r in common.in_arrow(pairs, sizes, "n bigint").collect()]
    assert sum(got) >= 400 * 100_000 and max(got) < 2 * common.BYTES_PER_BATCH
