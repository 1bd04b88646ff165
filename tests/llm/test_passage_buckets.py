"""Buckets of paragraph digests: three bands in two numbers, one exchange a band; sets without a loop a digest."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lumenrank.llm import arrays, passages


@pytest.mark.parametrize("band", range(passages.BANDS))
def test_colliding_digests_share_one_exchange(spark, band):
    rnd = random.Random(band)
    top = 1 << passages.BUCKET_BITS
    rows = [(i, [top - 1 - rnd.randrange(60) * 12345678901 for _ in range(passages.BANDS)]) for i in range(80)]
    packed = [(i, a | b << 42, b >> 22 | c << 20) for i, (a, b, c) in rows]
    signed = [(i, *[(x & (1 << 64) - 1) - (1 << 64 if x >> 63 & 1 else 0) for x in two]) for i, *two in packed]
    found = passages._colliding(spark.createDataFrame(signed, "id long, one_two long, two_three long"), band)
    got = sorted(map(tuple, found.collect()))
    of = [(b[band] | band << passages.BUCKET_BITS, i) for i, b in rows]
    alone = {b for b, _ in of if sum(b == x for x, _ in of) == 1}
    assert got == sorted((b, i) for b, i in of if b not in alone) and alone
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 1


def test_sets_are_those_of_each_digest():
    text = "one two three four five six seven.\neight nine ten.\none two three four five six seven.\n" * 3
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], names=["doc_id", "text"])
    (out,) = passages._sets(iter([batch]))
    (chunk,) = arrays.chunks(batch.column("text"))
    p = passages.paragraphs(chunk)
    want = {int(d): p.sets[i:j].tobytes() for d, i, j in zip(p.digest, p.offsets, p.offsets[1:])}
    assert dict(zip(*out.to_pydict().values())) == want and len(want) >= 2


def test_distinct_values_that_differ_in_their_lowest_bits():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 1 << 63, 500).astype(np.uint64) // np.uint64(4) * np.uint64(4)
    values = rnd.permutation(np.concatenate([values, values, values + np.uint64(1)]))
    offsets = np.array([0, 0, 400, 401, 1500])
    got, at = arrays.distinct_per_row(values, offsets)
    for k in range(4):
        assert got[at[k]:at[k + 1]].tolist() == sorted(set(values[offsets[k]:offsets[k + 1]].tolist()))
