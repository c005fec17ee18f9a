"""The pipeline over a small folder, against brute force of each stage on its own input."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from ledgerlark.llm import simhash
from tests.llm.helpers import DOCS, awkward
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import plain_components


def sentence(i, n=60):
    return " ".join(f"word{(i * 31 + k * k * 7) % 997}" for k in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(200 + i, f"{sentence(i)}\n{sentence(i + 500)}", "en", "s", 1) for i in range(12)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[3][1].replace("\n", "  \n"), "en", "s", 1)]
    rows += [(102, rows[4][1] + " tail", "en", "s", 1)]
    rows += [(103, f"{sentence(700)} mail me@example.org or 10.0.0.1 now", "en", None, 1)]
    rows += [(104, "too short", "en", "s", 1), (105, "same five words again here " * 20, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    path = tmp_path_factory.mktemp("pipeline")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    results = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, results[-1], folder).write.parquet(f"{tmp_path}/{k}")
        results.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert results[-1].columns == columns
    raw, clean, unique, spread, masked, packed = (frame.collect() for frame in results)
    passing = sorted(str((r.doc_id, r.text)) for r in raw if not plain_counts(r.text)[-1])
    assert sorted(str((r.doc_id, r.text)) for r in clean) == passing
    contents = [re.sub(r"\s", "", r.text) for r in unique]
    assert sorted(contents) == sorted({re.sub(r"\s", "", r.text) for r in clean})
    groups = plain_components([(r.doc_id, simhash.fingerprint(r.text)) for r in unique])
    assert len(spread) == len({component for _, _, component in groups}) < len(unique)
    before = {r.doc_id: r for r in spread}
    for row in masked:
        if row.doc_id == 103:
            assert row.text.endswith("mail [EMAIL] or [IP] now") and row.n_chars == len(row.text)
        else:
            assert row == before[row.doc_id]
    tokens = {}
    for row in packed:
        tokens.setdefault(row.sequence_id, []).append((row.offset, row["length"]))
    for pieces in tokens.values():
        ends = [0, *(offset + length for offset, length in sorted(pieces))]
        assert [offset for offset, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    assert {row.doc_id for row in packed} == set(before)


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
