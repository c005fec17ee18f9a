from __future__ import annotations

import zlib

import numpy as np
import pytest

from ledgerlark.llm import sharding
from tests.llm.helpers import awkward, empty


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_is_a_bijection_with_inverse(rows):
    there = sharding.permuted(np.arange(rows), rows, 7)
    assert sorted(there.tolist()) == list(range(rows))
    back = sharding.permuted(there, rows, 7, backwards=True)
    assert back.tolist() == list(range(rows))


def test_seed_and_place_are_computable():
    assert sharding.place_of(10, 100, 24, 3) == sharding.place_of(10, 100, 24, 3)
    assert any(sharding.place_of(i, 100, 24, 3) != sharding.place_of(i, 100, 24, 4) for i in range(5))
    for row in range(100):
        assert sharding.row_at(*sharding.place_of(row, 100, 24, 3), 100, 24, 3) == row


def test_awkward_rows(spark):
    docs = awkward(spark, 5)
    texts = [row.text for row in docs.collect()]
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(texts)
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    counts = {shard: sorted(r.slot for r in rows if r.shard == shard) for shard in range(4)}
    assert all(slots == list(range(len(slots))) for slots in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    for r in rows:
        assert (r.shard, r.slot) == sharding.place_of(r.row_number, len(rows), 4)


def test_independent_of_splits(spark):
    docs = awkward(spark)
    pick = lambda d: sorted(map(str, sharding.shard_documents(d, 3).drop("row_number").collect()))
    assert pick(docs.repartition(7)) == pick(docs.coalesce(1))


def test_empty(spark):
    assert sharding.shard_documents(empty(spark), 24).count() == 0
