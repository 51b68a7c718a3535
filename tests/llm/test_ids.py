"""Ids that a float cannot hold, beside null ones, come through every operator and stage as they are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, exact_dedup, language_id, licenses, line_dedup, mixing, near_dedup, pii, quality, secrets
from lectern.llm.queries import tokenizer_path, training_fold

IDS = [2**53 + 1, None, 2**53 + 3, 2**63 - 1, -(2**63), 2**63 - 3]


@pytest.fixture(scope="module")
def big(spark):
    words = "river stone lamp green winter paper cloud garden silver road number letter".split()
    rows = [(n, " ".join(words[(i * 5 + j * j) % 12] + str(i) for j in range(14)), "en", "a") for i, n in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


@pytest.mark.parametrize("operator", [
    lambda d: language_id.identify(d, language_id.fit(d, training_fold())), lambda d: bpe.encode(d, tokenizer_path(), texts=False), licenses.scan, lambda d: exact_dedup.mark(d, F.lit(False)),
    mixing.mix, pii.find, line_dedup.dedup_lines, secrets.find, quality.judge, near_dedup.classes,
])
def test_operators_return_ids_as_they_are(big, operator):
    assert sorted((r.doc_id for r in operator(big).collect()), key=str) == sorted(IDS, key=str)


def test_filters_keep_rows_of_such_ids(big):
    assert {r.doc_id for r in near_dedup.drop_copies(big).collect()} == set(IDS)
    assert {r.doc_id for r in exact_dedup.drop_copies(big, F.lit(False)).collect()} == set(IDS)
    model = language_id.fit(big, F.lit(True))
    passed = {r.doc_id for r in language_id.identify(big, model).collect() if not r.rejected}
    kept = language_id.keep_identified(big, model)
    assert {r.doc_id for r in kept.collect()} == passed and kept.schema == big.schema


def test_near_copies_beside_a_null_id_are_linked(big):
    copies = big.filter("doc_id is not null").union(big.filter("doc_id is not null").withColumn("doc_id", F.lit(2**53 + 5)).limit(1).withColumn("text", F.concat("text", F.lit(" end")))).union(big.filter("doc_id is null")).coalesce(1)
    found = {r.doc_id: r.class_size for r in near_dedup.classes(copies).collect()}
    assert found[2**53 + 5] == 2 and sorted(found.values())[-2:] == [2, 2]


def test_stages_keep_such_ids(spark, big):
    docs = big
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, None)
        assert {r.doc_id for r in docs.collect()} == set(IDS), name
