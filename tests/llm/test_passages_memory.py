"""What a worker holds while it looks for anchors."""

import tracemalloc
from types import SimpleNamespace

import numpy as np

from stratarc.llm import passages as P
from stratarc.llm.common import shrink


def _texts(sizes, width, seed=0):
    r = np.random.default_rng(seed)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.zeros(int(bounds[-1]) + 2 * width + 16, np.uint8)
    raw[: bounds[-1]] = r.integers(97, 123, int(bounds[-1]))
    return raw, bounds


def test_anchors_of_a_pack_take_little_memory():
    raw, bounds = _texts([1000] * 2000, 50)
    tracemalloc.start()
    try:
        h, first, count = P._anchors(raw, bounds, 50)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert count.sum() == 2000 * (1000 - 49)
    assert peak < 15 * int(bounds[-1])  # not some arrays of eight bytes a place


def test_runs_go_on_over_the_ends_of_stripes(monkeypatch):
    raw, bounds = _texts([0, 30, 400, 49, 50, 51, 3000, 7], 50)
    raw[600:900] = 97  # one anchor for long: cut by RUN only
    whole = P._anchors(raw, bounds, 50)
    for stripe in (1, 7, 64, 1000):
        monkeypatch.setattr(P, "STRIPE", stripe)
        for a, b in zip(whole, P._anchors(raw, bounds, 50)):
            assert (a == b).all()
    at = np.concatenate([np.arange(f, f + n) for f, n in zip(whole[1], whole[2])])
    assert at.tolist() == [x for a, z in zip(bounds, bounds[1:]) for x in range(a, z - 49)]


def test_packs_go_on_over_the_ends_of_batches(spark):
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat(hex(id), 500) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        packs = P.packed(docs, "text")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "50"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    batches = [P._from_ipc(r.payload) for r in packs.collect()]
    assert sorted(x for b in batches for x in b.column(0).to_pylist()) == list(range(1000))
    assert len(batches) == 1  # not one for each of 20 batches


def test_answers_are_applied_some_at_a_time():
    n = 20_000
    p = SimpleNamespace(one_=np.arange(n), class_of=np.arange(n), count_=np.full(n, 64), first_=np.arange(n) * 64, ids=np.array([5]), doc_=np.zeros(n, np.int64), sent={0: (0, n)})
    told = [{"bucket": 0, "least": shrink(np.ones(n, np.uint8), np.full(n, 64, np.uint8), np.arange(n) % 2 * 9)}]
    tracemalloc.start()
    try:
        places = sum(len(at) for at in P._repeated_places(p, told))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert places == 64 * n // 2
    assert peak < 10 * 64 * n  # not some arrays of eight bytes a place


def test_ranges_of_keys_merge_as_one():
    raw, _ = _texts([60] * 300, 50, 3)
    length, least = np.full(300, 60), np.arange(300) % 11
    raw = np.concatenate((np.tile(raw[: 150 * 60], 2), np.zeros(16, np.uint8)))
    key = np.tile(np.sort(np.random.default_rng(1).integers(0, 1 << 32, 150)), 2).astype(np.uint32)
    one = list(P._merged(raw, length, least, key, [150, 150], 50))
    half = key < 1 << 31
    parts = []
    for take in (half, ~half):
        at = np.flatnonzero(take)
        r = np.concatenate((raw[P._ranges(at * 60, length[at])], np.zeros(16, np.uint8)))
        parts.append(list(P._merged(r, length[at], least[at], key[at], [int(take[:150].sum()), int(take[150:].sum())], 50)))
    for k, x in enumerate(one):
        for i, whole_ in enumerate(x):
            assert (whole_ == np.concatenate([q[k][i] for q in parts])).all()
