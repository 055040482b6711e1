"""Donors and revisits of keys on a time line: keyed state of Arrow blocks, merged and searched as arrays."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What is kept of a donor; the first three are its place in file order.
DONOR = ("file_name", "byte_offset", "custom_id", "status", "location", "payload_size", "content_type")
PLACE = DONOR[:3]
DAY = 86_400_000_000
#: The moment of revisits without a date: they take the newest donor.
NO_DATE = -(1 << 63)
#: A position is 16 bytes of a key's hash (BLAKE2) and 8 of a moment, which sort as they are.
HASH, POSITION = 16, 24
FIRST, LAST = bytes(POSITION), b"\xff" * POSITION
#: Keys of a bucket share a key of the state, so that small ones are merged together.
BUCKETS = 1024
#: Rows of a block, before it has twice as many and is cut.
BLOCK = 4096
#: Blocks that a bucket's work holds opened, its rows that are merged at once, bytes of input packed at once and rows of a pack.
OPEN, GROUP, BUFFER, PACK = 32, 100_000, 32 << 20, 16_384

_KIND = {"byte_offset": pa.int64(), "status": pa.int32(), "payload_size": pa.int64()}
_DETAILS = [pa.field(c, _KIND.get(c, pa.string())) for c in DONOR]
DONORS = pa.schema([pa.field("pos", pa.binary(POSITION)), pa.field("at", pa.int64()), *_DETAILS])
REVISITS = pa.schema([("pos", pa.binary(POSITION)), ("at", pa.int64()), ("custom_id", pa.string()), ("donor_at", pa.int64())])
WIRE = pa.schema([("donor", pa.bool_()), *DONORS])
FOUND = "custom_id string, via string, file_name string, byte_offset long, donor_id string, archived_us long, status int, location string, payload_size long, content_type string"
_NAMED = [f.split()[0] for f in FOUND.split(", ")]
_RENAMED = {"donor_id": "custom_id", "archived_us": "at"}
RESULT = pa.schema([pa.field(c, pa.string() if c == "via" else DONORS.field(_RENAMED.get(c, c)).type) for c in _NAMED])
PACKS = "via string, bucket int, pack binary"


def encoded(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def decoded(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    raw = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd")
    return pa.ipc.read_record_batch(raw, schema)


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def hashed(keys: list[str]) -> np.ndarray:
    """A row of bytes for each key."""
    return np.frombuffer(b"".join(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=HASH).digest() for k in keys), dtype=np.uint8).reshape(-1, HASH)


def positions(keys: np.ndarray, at: np.ndarray) -> pa.Array:
    both = np.empty((len(at), POSITION), dtype=np.uint8)
    both[:, :HASH] = keys
    both[:, HASH:] = (at.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, POSITION - HASH)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(POSITION), len(at), [None, pa.py_buffer(both.tobytes())])


def _positions(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("pos")
    return np.frombuffer(column.buffers()[1], dtype=f"S{POSITION}", count=len(column), offset=column.offset * POSITION)


def _words(pos: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pos).view(np.uint64).reshape(-1, POSITION // 8)


def _equal(a: np.ndarray, b: np.ndarray, words: int = POSITION // 8) -> np.ndarray:
    return (_words(a)[:, :words] == _words(b)[:, :words]).all(axis=1)


def _same_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _equal(a, b, HASH // 8)


def _moved(pos: np.ndarray, byte: int) -> np.ndarray:
    """The least (0) or greatest (255) position of each one's key."""
    out = np.array(pos).view(np.uint8).reshape(-1, POSITION)
    out[:, HASH:] = byte
    return out.reshape(-1).view(f"S{POSITION}")


def _order(rows: pa.RecordBatch, by: tuple[str, ...], same: tuple[str, ...]) -> np.ndarray:
    """The rows' places in order of their position, of rows that are the same (in position and ``same``) the first one by ``by``; nulls first."""
    pos = _positions(rows)
    order = np.argsort(pos, kind="stable")
    held = pos[order]
    again = _equal(held[1:], held[:-1])
    if not again.any():
        return order
    numbers = np.empty(len(order), dtype=np.int64)
    numbers[order] = np.cumsum(np.concatenate(([True], ~again)))
    keyed = pa.RecordBatch.from_arrays([pa.array(numbers), *(rows.column(c) for c in by)], names=["n", *by])
    order = pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in ("n", *by)], null_placement="at_start").to_numpy()
    again = numbers[order[1:]] == numbers[order[:-1]]
    for c in same:
        values = rows.column(c).take(pa.array(order))
        a, b = values[1:], values[:-1]
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        again &= equal.to_numpy(zero_copy_only=False)
    return order[np.concatenate(([True], ~again))]


def _runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, from, to) of runs of one number, of which there is one at least."""
    cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist()
    return [(int(numbers[a]), a, b) for a, b in zip([0, *cuts], [*cuts, len(numbers)])]


class _Blocks:
    """Blocks of a bucket's rows in order of their position, each under its first one (the first under ``FIRST``); some are held open."""

    def __init__(self, state, starts: Iterable[bytes], schema: pa.Schema, by: tuple[str, ...], same: tuple[str, ...]) -> None:
        self.state, self.schema, self.by, self.same = state, schema, by, same
        self.names = [bytes(x) for x in starts]
        self.starts = self._array()
        self.open: OrderedDict[bytes, list] = OrderedDict()  # rows, and whether they changed
        self.grown = False

    def _array(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.names), dtype=f"S{POSITION}")

    def __getitem__(self, number: int) -> pa.RecordBatch:
        start = self.names[number]
        if start not in self.open:
            self._hold(start, decoded(self.state.getValue((start,))[0], self.schema), False)
        self.open.move_to_end(start)
        return self.open[start][0]

    def __setitem__(self, number: int, rows: pa.RecordBatch) -> None:
        self._hold(self.names[number], rows, True)

    def _hold(self, start: bytes, rows: pa.RecordBatch, changed: bool) -> None:
        self.open[start] = [rows, changed]
        self.open.move_to_end(start)
        if len(self.open) > OPEN:
            self._close(*self.open.popitem(last=False))

    def _close(self, start: bytes, held: list) -> None:
        if held[1]:
            self.state.updateValue((start,), (encoded(held[0]),))

    def flush(self) -> None:
        for start, held in self.open.items():
            self._close(start, held)
        self.open.clear()

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The number of the block that has, or would have, each position."""
        return np.searchsorted(self.starts, pos, "right") - 1

    def _add(self, number: int, starts: list[bytes]) -> None:
        self.names[number:number] = starts
        self.starts = self._array()
        self.grown = True

    def insert(self, rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Merge rows; for each block with new ones (its number before it is cut, positions, places of the new rows, which of these had another row's position)."""
        if not rows.num_rows:
            return
        rows = rows.take(pa.array(_order(rows, self.by, self.same)))
        own = _positions(rows)
        if not self.names:
            self._add(0, [FIRST])
            self[0] = rows.slice(0, 0)
        for number, a, b in reversed(_runs(self.at(own))):  # blocks that are cut do not move those before
            held, both, new = self[number], rows.slice(a, b - a), np.arange(b - a)
            was = np.zeros(b - a, dtype=bool)
            if n := held.num_rows:
                both = pa.concat_batches([held, both])
                order = _order(both, self.by, self.same)
                new = np.flatnonzero(order >= n)
                if not len(new):
                    continue
                both, before, after = both.take(pa.array(order)), _positions(held), own[order[new] - n + a]
                was = _equal(before[np.minimum(np.searchsorted(before, after), n - 1)], after)
            pos = _positions(both)
            yield number, pos, new, was
            parts = [0]
            if len(pos) > 2 * BLOCK:
                parts = np.unique(np.searchsorted(pos, pos[::BLOCK], "left")).tolist()
            self._add(number + 1, [pos[x : x + 1].tobytes() for x in parts[1:]]) if len(parts) > 1 else None
            for i, (x, y) in enumerate(zip(parts, [*parts[1:], len(pos)])):
                self[number + i] = both.slice(x, y - x)


class NearestDonors(StatefulProcessor):
    """The donors and revisits of a bucket of keys (digests or URIs) on time lines, kept in blocks of some thousand rows.

    ``donors`` and ``revisits`` map a block's first position to its rows (Arrow); ``days`` has the blocks that are there.
    A new donor only touches the revisits between its neighbours in time, a new revisit only the nearest donors, so that
    a batch reads the blocks around its own rows, not all of the bucket's; small keys share blocks.  A row is given
    out when a revisit's donor changes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getValueState("days", "donors array<binary>, revisits array<binary>")
        self.donors = handle.getMapState("donors", "start binary", "rows binary")
        self.revisits = handle.getMapState("revisits", "start binary", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Rows (custom_id, at, donor) of the key; a donor without a date is none."""
        none = Row(*DONOR)(*[None] * len(DONOR))
        taken = [r for r in rows if r.donor is None or r.at is not None]
        at = np.array([NO_DATE if r.at is None else r.at for r in taken], dtype=np.int64)
        columns = {c: [r.custom_id if c == "custom_id" and r.donor is None else (r.donor or none)[c] for r in taken] for c in DONOR}
        columns |= {"donor": [r.donor is not None for r in taken], "at": at, "pos": positions(hashed([key[1]]), at)}
        wire = pa.RecordBatch.from_pydict({c: columns[c] for c in WIRE.names}, WIRE)
        for found in self.step(key[0], [wire]):
            yield from (Row(**r) for r in found.to_pylist())

    def step(self, via: str, wires: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge the rows of a batch, then give the revisits (as ``RESULT``) whose donor they change."""
        held = self.days.get() if self.days.exists() else ([], [])
        donors, revisits = _Blocks(self.donors, held[0], DONORS, PLACE, ()), _Blocks(self.revisits, held[1], REVISITS, ("custom_id",), ("custom_id",))
        lows, highs, replaced = [], [], []
        for rows in _grouped(wires):
            is_donor = rows.column("donor")
            for k, pos, new, was in donors.insert(rows.filter(is_donor).select(DONORS.names)):
                # a neighbour in another block is at its start at least, and at the next one's start at most
                before, after, own = pos[new - 1], pos[np.minimum(new + 1, len(pos) - 1)], pos[new]
                before[new == 0] = donors.starts[k - 1] if k else FIRST
                after[new == len(pos) - 1] = donors.starts[k + 1] if k + 1 < len(donors.starts) else LAST
                undated = _moved(own, 0)
                lows += [before, undated]
                highs += [after, undated]
                replaced.append(own[was])
            other = rows.filter(pc.invert(is_donor)).select(["pos", "at", "custom_id"])
            other = pa.RecordBatch.from_arrays([*other.columns, pa.array(np.full(other.num_rows, NO_DATE))], schema=REVISITS)
            for _, pos, new, _ in revisits.insert(other):
                lows.append(pos[new])
                highs.append(pos[new])
        again = np.sort(np.concatenate(replaced)) if replaced else np.empty(0, dtype=f"S{POSITION}")
        if revisits.names and donors.names:
            marks = np.zeros(len(revisits.names) + 1, dtype=np.int64)
            for a, b in zip(lows, highs):
                np.add.at(marks, revisits.at(a), 1)
                np.add.at(marks, revisits.at(b) + 1, -1)
            for number in np.flatnonzero(np.cumsum(marks)[:-1]).tolist():
                yield from self._resolved(via, revisits, number, donors, again)
        donors.flush()
        revisits.flush()
        if donors.grown or revisits.grown:
            self.days.update((donors.names, revisits.names))

    def _resolved(self, via: str, revisits: _Blocks, number: int, donors: _Blocks, again: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = revisits[number]
        pos, at, old = _positions(rows), _numbers(rows, "at"), _numbers(rows, "donor_at")
        new, changed = old.copy(), False
        if (undated := at == NO_DATE).any():
            pos = np.where(undated, _moved(pos, 255), pos)
        for k, a, b in _runs(donors.at(pos)):
            some = donors[k]
            if k + 1 < len(donors.names):  # the first one behind
                some = pa.concat_batches([some, donors[k + 1].slice(0, 1)])
            best, found = _nearest(some, pos[a:b], at[a:b])
            own, best_at = _positions(some), _numbers(some, "at")[best]
            others = best_at != old[a:b]
            if len(again):
                others |= _equal(again[np.minimum(np.searchsorted(again, own[best]), len(again) - 1)], own[best])
            if not len(which := np.flatnonzero(others & found)):
                continue
            new[a:b][which], changed = best_at[which], True
            hit = some.take(pa.array(best[which]))
            ids = rows.column("custom_id").slice(a, b - a).take(pa.array(which))
            values = {"custom_id": ids, "via": pa.repeat(pa.scalar(via, pa.string()), len(which))}
            yield pa.RecordBatch.from_arrays([values[c] if c in values else hit.column(_RENAMED.get(c, c)) for c in RESULT.names], schema=RESULT)
        if changed:
            revisits[number] = rows.set_column(3, REVISITS.field(3), pa.array(new))

    def close(self) -> None:
        pass


def _nearest(donors: pa.RecordBatch, pos: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the key's donor nearest to each position, and whether there is one; of two as near the first in file order."""
    own, moments = _positions(donors), _numbers(donors, "at")
    last = len(own) - 1
    behind = np.searchsorted(own, pos, "right")
    before, after = np.maximum(behind - 1, 0), np.minimum(behind, last)
    earlier = (behind > 0) & _same_key(own[before], pos)
    later = (behind <= last) & _same_key(own[after], pos)
    to, fro = at - moments[before], moments[after] - at
    best = np.where(later & ~(earlier & (to <= fro)), after, before)
    if (tied := earlier & later & (to == fro)).any():
        order = pc.sort_indices(donors, sort_keys=[(c, "ascending") for c in PLACE], null_placement="at_start").to_numpy()
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order), dtype=order.dtype)
        best = np.where(tied & (rank[after] < rank[before]), after, best)
    return best, earlier | later


def _grouped(wires: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows in wires:
        held.append(rows)
        size += rows.num_rows
        if size >= GROUP:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


class PackedDonors(NearestDonors):
    """The same of rows in packs, as ``packed`` makes them; what is found is in packs too."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for found in self.step(key[0], (decoded(r.pack, WIRE) for r in rows)):
            yield Row(pack=encoded(found))


#: (via, its key, its moment) of the columns that ``packed`` takes.
ROUTES = (("digest", "digest", "own"), ("uri", "uri", "other"))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``WIRE`` without a position, with ROUTES' keys and moments, as packs of a bucket each: a row a bucket and buffer, not one a record and route."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += rows.nbytes
        if size >= BUFFER:
            yield from _packs(pa.concat_batches(held))
            held, size = [], 0
    if held:
        yield from _packs(pa.concat_batches(held))


def _packs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for via, name, moment in ROUTES:
        some = rows.filter(pc.and_(pc.is_valid(rows.column(name)), pc.invert(pc.and_(rows.column("donor"), pc.is_null(rows.column(moment))))))
        if not some.num_rows:
            continue
        key = some.column(name).dictionary_encode()
        codes, hashes = key.indices.to_numpy(), hashed(key.dictionary.to_pylist())
        bucket = (np.ascontiguousarray(hashes[:, :4]).view(">u4").reshape(-1) % BUCKETS).astype(np.int32)[codes]
        order = np.argsort(bucket, kind="stable")
        at = pc.fill_null(some.column(moment), NO_DATE)
        columns = {"at": at, "pos": positions(hashes[codes], at.to_numpy())}
        columns = [columns[f.name] if f.name in columns else some.column(f.name).cast(f.type) for f in WIRE]
        wire = pa.RecordBatch.from_arrays(columns, schema=WIRE).take(pa.array(order))
        buckets, packs, size = [], [], 0
        for number, a, b in _runs(bucket[order]):
            for x in range(a, b, PACK):
                buckets.append(number)
                packs.append(encoded(wire.slice(x, min(PACK, b - x))))
                size += len(packs[-1])
                if size >= 4 << 20:
                    yield _packs_batch(via, buckets, packs)
                    buckets, packs, size = [], [], 0
        if buckets:
            yield _packs_batch(via, buckets, packs)


def _packs_batch(via: str, buckets: list, packs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([via] * len(buckets), pa.string()), pa.array(buckets, pa.int32()), pa.array(packs, pa.binary())], names=["via", "bucket", "pack"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was found (packs and their micro-batch ``__n``) as rows."""
    held, size = [], 0
    for rows in batches:
        for pack, n in zip(rows.column("pack"), rows.column("__n").to_pylist()):
            found = decoded(pack.as_py(), RESULT)
            held.append(found.append_column("__n", pa.array(np.full(found.num_rows, n, dtype=np.int64))))
            size += found.num_rows
            if size >= 2 * BLOCK:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
