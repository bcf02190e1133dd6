"""Every operator over awkward rows and over an empty table."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from studylake.llm import decontamination, language_id, licence_scan, line_dedup, media, packing, pii, simhash_dedup, token_store, toxicity


def _benchmark(docs):
    return docs.sparkSession.createDataFrame([(1, "some benchmark question about words in it and more of them"), (2, None), (3, ""), (4, "one")], "item_id long, text string")


def _labels(docs):
    rows = [(i, 1, 0) for i in range(20, 40)] + [(None, 1, 1), (1, None, None)]
    return docs.sparkSession.createDataFrame(rows, "doc_id long, quality int, toxic int")


PER_DOCUMENT = {
    "licences": lambda d: licence_scan.scan_documents(d, licence_scan.fit_model(d)),
    "tokens": token_store.token_table,
    "lines": lambda d: line_dedup.digest_lines(line_dedup.drop_repeated_lines(d)),
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit_scorer(d, _labels(d))),
    "language": lambda d: language_id.identify(d, language_id.fit_classifier(d)),
    "personal data": lambda d: pii.report(pii.find(d)),
    "media": lambda d: media.features(media.media_table(d)),
    "near copies": simhash_dedup.near_duplicates,
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_for_each_row(name, odd_docs, no_docs):
    found = PER_DOCUMENT[name](odd_docs).toPandas()
    assert sorted(found["doc_id"].fillna(-1)) == sorted(odd_docs.toPandas()["doc_id"].fillna(-1))
    assert PER_DOCUMENT[name](no_docs).count() == 0


def test_packing_covers_every_row(odd_docs, no_docs):
    found = packing.pack(odd_docs).toPandas()
    assert set(found["doc_id"].fillna(-1)) == set(odd_docs.toPandas()["doc_id"].fillna(-1))
    assert packing.pack(no_docs).count() == 0


def test_leaks_of_odd_rows(odd_docs, no_docs):
    found = decontamination.find_leaks(odd_docs, _benchmark(odd_docs)).toPandas()
    assert {(r.doc_id, r.item_id) for r in found.itertuples()} == {(6, 4), (7, 4)}
    assert decontamination.find_leaks(no_docs, _benchmark(no_docs)).count() == 0
    assert decontamination.find_leaks(odd_docs, _benchmark(odd_docs).limit(0)).count() == 0


@pytest.mark.parametrize(
    "keep",
    [
        lambda d: line_dedup.drop_repeated_lines(d, keep="first").select(d.columns),
        simhash_dedup.keep_one,
        lambda d: decontamination.drop_leaks(d, _benchmark(d)),
        lambda d: toxicity.drop_toxic(d, toxicity.fit_scorer(d, _labels(d))),
    ],
)
def test_filters_keep_all_columns(keep, odd_docs, no_docs):
    kept = keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.filter("doc_id IS NULL").count() == 1  # a row without an id is never a copy or a leak
    assert kept.agg(F.count("*")).first()[0] <= odd_docs.count()
    assert keep(no_docs).count() == 0


def test_stages_are_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


# --- the values of awkward rows --------------------------------------------------------------------------


def _by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def _sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def odd_texts(odd_docs):
    return {r["doc_id"]: r["text"] or "" for r in odd_docs.select("doc_id", "text").collect()}


def test_values_of_token_store(odd_docs, odd_texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = _by_id(token_store.token_table(odd_docs))
    for i, rows in found.items():
        ids = [*library.encode(odd_texts[i], add_special_tokens=False).ids, 2]
        for r in rows:
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    starts = sorted((r["start"], r["n_tokens"]) for rows in found.values() for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert found[None][0]["start"] == 0 and len(found[6]) == 2


def test_values_of_line_dedup(odd_docs, odd_texts):
    for i, rows in _by_id(line_dedup.digest_lines(line_dedup.drop_repeated_lines(odd_docs))).items():
        for r in rows:
            assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (odd_texts[i].count("\n") + 1, 0, _sha(odd_texts[i].encode()))


def test_values_of_language_and_toxicity(odd_docs, odd_texts):
    found = _by_id(language_id.identify(odd_docs, language_id.fit_classifier(odd_docs)))
    for i, rows in found.items():
        letters = any(c.isalpha() for c in odd_texts[i])
        assert all((r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0.0) for r in rows), i
    scorer = toxicity.fit_scorer(odd_docs, _labels(odd_docs))
    assert {r["score"] for rows in _by_id(toxicity.score_documents(odd_docs, scorer)).values() for r in rows} == {scorer.prior}


def test_values_of_media(odd_docs, odd_texts):
    for i, rows in _by_id(media.features(media.media_table(odd_docs))).items():
        payload = media.payload_of(odd_texts[i])
        for r in rows:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(odd_texts[i].encode()), len(payload), _sha(payload))


def test_values_of_simhash(odd_docs, odd_texts):
    found = _by_id(simhash_dedup.near_duplicates(odd_docs))
    assert {found[i][0]["component_id"] for i in (1, 2, 3, 8)} == {1}  # no word: fingerprint zero
    assert {r["component_id"] for i in (4, 5) for r in found[i]} == {4} and {r["component_id"] for r in found[6]} == {6}
    assert all(found[i][0]["fp"] == 0 for i in (1, 2, 3, 8))


def test_values_of_personal_data(odd_docs):
    found = _by_id(pii.report(pii.find(odd_docs)))
    assert all((r["n_email"], r["spans"]) == (0, "") for i in (1, 2, 3, 6, 8) for r in found[i])
    # Fifty thousand digits, an at sign and thirty thousand "1.": one address, and an ip in every four of them.
    assert (found[11][0]["n_email"], found[11][0]["n_ip"], found[11][0]["n_card"], found[11][0]["n_extra"]) == (1, 7500, 0, 0)
    assert found[11][0]["spans"].startswith("email:0:110000,ip:50001:50008,")


def test_values_of_licences(odd_docs):
    found = _by_id(licence_scan.scan_documents(odd_docs, licence_scan.fit_model(odd_docs)))
    assert {(r["licences"], r["n_confirmed"], r["places"], r["probability"]) for rows in found.values() for r in rows} == {("", 0, "", 0.0)}


def test_values_of_packing(odd_docs, odd_texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, rows in _by_id(packing.pack(odd_docs)).items():
        n = len(library.encode(odd_texts[i], add_special_tokens=False).ids) + 1
        copies = 2 if i == 6 else 1
        assert sum(r["length"] for r in rows) == copies * n and {r["doc_tokens"] for r in rows} == {n}


# --- the whole pipeline ----------------------------------------------------------------------------------


def _folder(tmp_path, docs):
    for name, df in (("documents", docs), ("labels", _labels(docs)), ("benchmark", _benchmark(docs))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pipeline_of_odd_rows(spark, odd_docs, tmp_path):
    """Long texts, repeats, nulls and clashing columns through all stages: copies and leaks go, the rest is packed whole."""
    found = _by_id(corpus_pipeline.run(spark, _folder(tmp_path, odd_docs)))
    # 2, 3 and 8 are copies of 1 (no word), 5 of 4; 6 and 7 hold the one-word item.
    assert set(found) == {None, 1, 4, 9, 10, 11}
    for rows in found.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == rows[0]["doc_tokens"]


def test_pipeline_of_no_rows(spark, no_docs, tmp_path):
    assert corpus_pipeline.run(spark, _folder(tmp_path, no_docs)).count() == 0


def test_no_scratch_outside_the_applications_folder(spark, odd_docs):
    """Tables that were read for the last time are gone; the rest lies in one folder."""
    from pathlib import Path

    from studylake.llm.common import scratch_root

    root = Path(scratch_root(spark).removeprefix("file://"))
    before = {x.name for x in root.iterdir()}
    simhash_dedup.near_duplicates(odd_docs).collect()
    left = {x.name.rsplit("-", 1)[0] for x in root.iterdir() if x.name not in before}
    assert "simhash-classes" not in left and "component-labels" not in left - {"component-labels"} and "component-edges" not in left


def test_plans_move_leftovers_by_an_exchange(spark, odd_docs):
    """The task that packs the leftovers reads what an exchange brings it, not the pieces themselves."""
    plan = packing.pack(odd_docs)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "SinglePartition" in plan or "RoundRobinPartitioning(1)" in plan
    assert "Coalesce" not in plan
