"""Donors on a time line of blocks, against all pairs; work by blocks, not by rows."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from test_streams import CAPTURE, _donors, _files, _Handle, _mixed

from stratarc.streaming import donors, live


def _work(cls=donors.NearestDonors):
    work = cls()
    work.init(_Handle())
    return work


def _row(name, at, donor=None):
    return Row(custom_id=name, at=at, donor=donor and Row(file_name=donor[0], byte_offset=donor[1], custom_id=name, status=200, location=None, payload_size=5, content_type=""))


def _place(r):
    return tuple((x is not None, x) for x in (r.donor.file_name, r.donor.byte_offset, r.custom_id))


def _best(rows, at):
    if at is None:
        newest = max((d.at for d in rows), default=None)
        return min((d for d in rows if d.at == newest), key=_place, default=None)
    return min(rows, key=lambda d: (abs(d.at - at), _place(d)), default=None)


@pytest.mark.parametrize("seed", range(30))
def test_blocks_of_any_size_give_the_nearest_donor(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(donors, "BLOCK", r.choice([1, 2, 8]))
    monkeypatch.setattr(donors, "OPEN", r.choice([1, 2, 32]))
    monkeypatch.setattr(donors, "GROUP", r.choice([1, 7, 10**6]))
    span = r.choice([5, 60, 10**6])
    at = lambda: r.choice([None] + [r.randrange(-span, span)] * 9)
    rows = [_row(f"r{i}", at()) if r.random() < 0.5 else _row(f"c{i}", at(), (r.choice([None, "f", "g"]), r.choice([None, 1, 2, i]))) for i in range(100)]
    rows += r.sample(rows, 10)  # that come again
    work, got, seen = _work(), {}, 0
    while seen < len(rows):
        batch = rows[seen : seen + r.choice([1, 5, 40])]
        seen += len(batch)
        found = list(work.handleInputRows(("uri", "u"), batch, None))
        assert len({x.custom_id for x in found}) == len(found)  # a revisit has one donor a batch
        got |= {x.custom_id: x.donor_id for x in found}
        dated = [x for x in rows[:seen] if x.donor and x.at is not None]
        want = {x.custom_id: _best(dated, x.at) for x in rows[:seen] if not x.donor}
        assert got == {k: v.custom_id for k, v in want.items() if v}


@pytest.mark.parametrize("seed", range(20))
def test_keys_of_a_bucket_stay_apart(monkeypatch, seed):
    r = random.Random(seed)
    for name, size in (("BUCKETS", 1), ("BLOCK", r.choice([1, 3, 8])), ("OPEN", r.choice([1, 32])), ("GROUP", r.choice([5, 10**6])), ("PACK", r.choice([2, 100]))):
        monkeypatch.setattr(donors, name, size)
    key = lambda: r.choice(["", "a", "é", *(f"k{i}" for i in range(r.choice([1, 20])))])
    rows = [(r.random() < 0.5, key(), r.choice([None, *range(-9, 9)]), f"x{i}", r.randrange(4)) for i in range(120)]
    work, got, seen = _work(donors.PackedDonors), {}, 0
    while seen < len(rows):
        some = rows[seen : seen + r.choice([1, 30, 60])]
        seen += len(some)
        is_donor, keys, at, names, offsets = zip(*some)
        columns = {c: pa.nulls(len(some), f.type) for c, f in zip(donors.WIRE.names, donors.WIRE) if c not in ("at", "pos")}
        columns |= {"donor": pa.array(is_donor), "custom_id": pa.array(names), "byte_offset": pa.array(offsets, pa.int64())}
        columns |= {"digest": pa.nulls(len(some), pa.string()), "uri": pa.array(keys), "own": pa.array(at, pa.int64()), "other": pa.array(at, pa.int64())}
        packs = [Row(pack=x["pack"]) for b in donors.packed(iter([pa.RecordBatch.from_pydict(columns)])) for x in b.to_pylist()]
        for found in work.handleInputRows(("uri", 0), packs, None) if packs else ():
            got |= {x["custom_id"]: x["donor_id"] for x in donors.decoded(found.pack, donors.RESULT).to_pylist()}
        want = {}
        for mine, k, t, name, _ in rows[:seen]:
            theirs = [_row(n, u, (None, o)) for d, q, u, n, o in rows[:seen] if d and q == k and u is not None]
            if not mine and theirs:
                want[name] = _best(theirs, t).custom_id
        assert got == want


def _packs(n, moments, named):
    """Half donors and half revisits of one key."""
    wire = {c: pa.nulls(n, f.type) for c, f in zip(donors.WIRE.names, donors.WIRE)}
    wire |= {"donor": pa.array(np.arange(n) % 2 == 0), "at": pa.array(moments), "pos": donors.positions(donors.hashed(["d"]), moments), "custom_id": pa.array([f"{named}{i}" for i in range(n)])}
    return [Row(pack=donors.encoded(pa.RecordBatch.from_pydict(wire, donors.WIRE)))]


def test_a_keys_rows_are_not_taken_one_by_one():
    n, work = 40_000, _work(donors.PackedDonors)
    packs = _packs(n, np.random.default_rng(1).permutation(n) * 1000, "x")
    calls = 0

    def count(_frame, event, _arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = sum(donors.decoded(r.pack, donors.RESULT).num_rows for r in work.handleInputRows(("digest", "d"), packs, None))
    finally:
        sys.setprofile(None)
    assert found == n // 2
    assert calls < n / 4  # before, several for each row


def test_a_small_batch_opens_few_blocks_and_no_block_grows():
    n, work = 60_000, _work(donors.PackedDonors)
    list(work.handleInputRows(("digest", "d"), _packs(n, np.arange(n) * 1000, "x"), None))
    sizes = [donors.decoded(v[0], s).num_rows for held, s in ((work.donors.held, donors.DONORS), (work.revisits.held, donors.REVISITS)) for v in held.values()]
    assert sum(sizes) == n and max(sizes) <= 2 * donors.BLOCK
    read = []
    for state in (work.donors, work.revisits):
        state.getValue = lambda k, held=state.held: read.append(k) or held[k]
    found = [donors.decoded(r.pack, donors.RESULT) for r in work.handleInputRows(("digest", "d"), _packs(2, np.array([30_000_400, 30_000_500]), "new"), None)]
    assert {(x["custom_id"], x["donor_id"]) for f in found for x in f.to_pylist()} >= {("new1", "new0")}
    assert len(read) <= 6 < len(sizes)


def test_packs_have_each_bucket_once_a_buffer():
    batches = [pa.RecordBatch.from_pydict({**{c: pa.nulls(4, t.type) for c, t in zip(donors.WIRE.names, donors.WIRE) if c not in ("at", "pos")}, "donor": [True, False, True, False], "digest": ["d", "d", None, "e"], "uri": ["u", "u", "v", None], "own": pa.array([1, 2, None, 4], pa.int64()), "other": pa.array([1, None, None, 4], pa.int64())})] * 3
    rows = [r for b in donors.packed(iter(batches)) for r in b.to_pylist()]
    assert [r["via"] for r in rows] == ["digest", "digest", "uri"] and rows[0]["bucket"] != rows[1]["bucket"]
    held = sorted(donors.decoded(r["pack"], donors.WIRE).column("at").to_pylist() for r in rows)
    assert held == sorted([[1, 2] * 3, [4] * 3, [1, donors.NO_DATE] * 3])


def test_many_packs_of_a_key_in_a_stream(spark, tmp_path, monkeypatch):
    from stratarc.operators.resolve import resolve_revisits

    for name, size in (("BUFFER", 2000), ("PACK", 3), ("BLOCK", 4), ("GROUP", 10)):
        monkeypatch.setattr(donors, name, size)  # the package goes to workers by value
    rows = _mixed(9, 200)
    want = _donors(resolve_revisits(spark.createDataFrame(rows, CAPTURE)).where("donor IS NOT NULL"))
    got = live.late_revisits(_files(spark, tmp_path, [rows[:120], rows[120:]], CAPTURE), f"file://{tmp_path}/out")
    assert _donors(got) == want
