"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller id.  The work is laid
out so that equal strings meet, and no task sees more than a bounded share of the corpus:

1. *Packs.*  Documents are written once to the shared folder in compressed packs of some MB, bucketed by pack, so that
   answers are joined to them without moving them again.
2. *Anchors.*  Of the 24-byte hashes inside a width-byte string the least is its anchor; equal strings have equal
   anchors.  Packs send their distinct anchors (four bytes each) to buckets; buckets answer with one bit each: does it
   occur in two documents?  Only what these anchors own can repeat.
3. *Strings.*  Packs send each run of strings with one repeated anchor once (copies inside a pack collapse, with the
   least id) to the anchor's bucket.  Anchors with very many runs own too much for one bucket: their strings go one by
   one to the bucket of their own hash, so that a line on every page is dealt over all tasks.
4. *Merge.*  In a bucket, equal runs of several packs collapse to one; the rest of each pack is a shard with its own
   transform.  The shards' transforms are merged by interleave refinement (:mod:`stratarc.llm.bwt`), a quarter MB of strings
   at a time, and every repeated interval gets its least id.
5. *Cut.*  Packs get the answers, mark strings whose least id is smaller than the document's own, and cut.

Only anchors, repeated strings and answers are exchanged.  Runs collapse only after a comparison of all their bytes.

Defined cases: null texts are empty; texts shorter than ``width`` stay whole; rows with equal ids never cover one
another; a null id counts as larger than any other; repeated rows get a row each; an empty table gives an empty one.
Other columns are kept, except ones named like the added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarc.llm.bwt import least_in_intervals
from stratarc.llm.common import arrow_rows, grow, lean, lean_group, saved, saved_by, shrink

GRAM = 24
PACK_BYTES = 3 << 20
#: Rows that are sent to be packed at once; a pack takes what it needs from several such batches.
PACK_ROWS = 500
#: Strings of one anchor in one document are sent in runs of at most this many.
RUN = 64
#: Bytes of strings that are merged at once inside a bucket (a merge takes some 80 times as much).
BLOCK_BYTES = 1 << 18
#: Bytes of a bucket's strings that are laid side by side at once.
MERGE_BYTES = 4 << 20
#: An anchor with more runs than this sends its strings one by one.
HOT_RUNS = 20_000
#: Places that are hashed at once (their arrays stay in the processor's cache).
STRIPE = 1 << 14
NO_ID = np.iinfo(np.int64).max
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_ipc(data) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(pack, payload): the rows as compressed Arrow batches, a document alone if it is larger than a pack."""

    def run(batches):
        from pyspark import TaskContext

        n, base, left = 0, TaskContext.get().partitionId() << 33, None

        def pack(b):
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([base + n - 1], pa.int64()), pa.array([_ipc(b)], pa.binary())], names=["pack", "payload"])

        for b in batches:
            if left is not None:
                b = pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0] if b.num_rows else left
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + PACK_BYTES, "right")))
                if to >= b.num_rows:
                    break  # the next batch may have more for this pack
                yield pack(b.slice(at, to - at))
                at = to
            left = b.slice(at) if at < b.num_rows else None
        if left is not None:
            yield pack(left)

    with arrow_rows(docs.sparkSession, PACK_ROWS):
        return saved_by(docs.mapInArrow(lean(run), "pack long, payload binary"), "pack", "packs", "uncompressed")


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    out = np.repeat(first - (ends - count), count)
    out += np.arange(len(out))
    return out


def _groups(*sorted_: np.ndarray) -> np.ndarray:
    """Places at which a new group of equal rows begins."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_[0]), bool)
    new[0] = True
    for c in sorted_:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _anchors(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first string, strings) of each run of strings with one anchor; runs of at most RUN.

    ``raw``: all texts one after the other and at least ``width + 8`` bytes more; ``bounds``: where texts begin and end.
    """
    n, gram = int(bounds[-1]), min(GRAM, width)
    wide = width - gram + 1
    long_ = np.diff(bounds) >= width
    edge = np.zeros(n + 1, np.int8)
    edge[bounds[:-1][long_]] += 1
    edge[bounds[1:][long_] - width + 1] -= 1
    begins = np.cumsum(edge[:-1], dtype=np.int8).view(bool)  # where a string begins
    # a stripe leaves only its runs: eight bytes for each place of a pack would be most of a worker's memory
    hashes, places, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    seen, last, before = 0, None, -1
    for a in range(0, n, STRIPE):
        z = min(n, a + STRIPE)
        at = np.flatnonzero(begins[a:z])
        if not len(at):
            continue
        grams = z - a + wide - 1
        size = grams + gram - 8
        word = np.empty(-(-size // 8) * 8, np.uint64)
        for j in range(8):  # the eight bytes at each place
            word[j::8] = np.frombuffer(raw, "<u8", len(word) // 8, a + j)
        h = word[:grams] * _ODD[0]
        h += word[(gram - 8) // 2 :][:grams] * _ODD[1]
        h += word[gram - 8 :][:grams] * _ODD[2]
        h ^= h >> np.uint64(32)
        h *= _ODD[3]
        span = 1
        while span * 2 <= wide:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if wide > span:
            h = np.minimum(h[: -(wide - span)], h[wide - span :])
        h, at = h[at], at + a
        new = np.concatenate(([at[0] != before + 1 or h[0] != last], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)))
        begin = np.flatnonzero(new)
        hashes.append(h[begin])
        places.append(at[begin])
        numbers.append(begin + seen)
        seen, last, before = seen + len(at), h[-1], at[-1]
    h, first = np.concatenate(hashes) * _ODD[4], np.concatenate(places)
    counts = np.diff(np.append(np.concatenate(numbers), seen))
    if len(counts) and counts.max() > RUN:
        pieces = -(-counts // RUN)
        step = _ranges(np.zeros(len(pieces), np.int64), pieces)
        left = np.repeat(counts, pieces) - step * RUN
        h, first, counts = np.repeat(h, pieces), np.repeat(first, pieces) + step * RUN, np.minimum(left, RUN)
    return h, first, counts


def _string_hash(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes at each of the places."""
    eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    h = np.zeros(len(at), np.uint64)
    for o in sorted({*range(0, width - 7, 8), width - 8}):
        h ^= eight[at + o].view("<u8").ravel()
        h *= _ODD[0]
        h ^= h >> np.uint64(29)
    h *= _ODD[2]
    return h ^ (h >> np.uint64(32))


def _collapse(raw: np.ndarray, first: np.ndarray, length: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each string, a string of each class): equal strings with equal keys; classes in order of the key.

    Candidates come by hash; two strings are of one class only if all their bytes are equal.
    """
    hashed = _string_hash(raw, first, width) * _ODD[1] ^ _string_hash(raw, first + length - width, width)
    order = np.lexsort((hashed, key))
    k, h, n, f = key[order], hashed[order], length[order], first[order]
    same = np.concatenate(([False], (k[1:] == k[:-1]) & (h[1:] == h[:-1]) & (n[1:] == n[:-1]))) if len(order) else np.zeros(0, bool)
    twins = np.flatnonzero(same)
    parts = np.cumsum(n[twins]) // BLOCK_BYTES  # places take eight times the strings' bytes
    edges = np.append(_groups(parts), len(twins))
    for a, z in zip(edges, edges[1:]):
        twin = twins[a:z]
        equal = raw[_ranges(f[twin], n[twin])] == raw[_ranges(f[twin - 1], n[twin])]
        same[twin] = np.logical_and.reduceat(equal, np.cumsum(n[twin]) - n[twin])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(~same) - 1
    return of, order[~same]


class _Pack:
    """A pack's texts with their runs and distinct anchors; the same arrays each time it is opened."""

    def __init__(self, payload, id_column: str, text: str, width: int, buckets: int):
        self.batch = _from_ipc(payload)
        self.width, self.buckets = width, buckets
        self.ids = pc.fill_null(self.batch.column(self.batch.schema.get_field_index(id_column)).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
        texts = pc.fill_null(self.batch.column(self.batch.schema.get_field_index(text)).cast(pa.large_string()).cast(pa.large_binary()), b"")
        _, at, data = texts.buffers()
        bounds = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(bounds[-1] - bounds[0])
        self.raw = np.zeros(size + 2 * width + 16, np.uint8)
        if size:
            self.raw[:size] = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.hash, self.first, self.count = _anchors(self.raw, self.bounds, width)
        self.doc = np.searchsorted(self.bounds, self.first, "right") - 1
        # distinct anchors by bucket, then hash
        order = np.argsort(self.hash)
        begin = _groups(self.hash[order])
        keys = self.hash[order][begin]
        at = (keys % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(at, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by] = np.arange(len(keys))
        self.keys, self.key_of = keys[by], np.empty(len(order), np.int64)
        self.key_of[order] = np.repeat(place, np.diff(np.append(begin, len(order))))
        self.begin, self.by, self.order = begin, by, order
        cuts = _groups(at[by])
        self.cuts = {int(at[by[a]]): (int(a), int(z)) for a, z in zip(cuts, np.append(cuts[1:], len(by)))}

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(runs, in two documents) of each distinct anchor."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        ids = self.ids[self.doc][self.order]
        apart = np.minimum.reduceat(ids, self.begin) != np.maximum.reduceat(ids, self.begin)
        return np.diff(np.append(self.begin, len(self.order)))[self.by], apart[self.by]

    def strings(self, told):
        """What the pack sends, from the buckets' bits: sets class_of, of runs first_, count_, of classes bucket_, key_, one_."""
        warm, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for x in told or ():
            a, z = self.cuts[x["bucket"]]
            w, t = grow(x["bits"], np.uint8, np.uint8)
            warm[a:z] = np.unpackbits(w, count=z - a)
            if len(t):
                hot[a:z] = np.unpackbits(t, count=z - a)
        plain, single = np.flatnonzero((warm & ~hot)[self.key_of]), np.flatnonzero(hot[self.key_of])
        one_by_one = _ranges(self.first[single], self.count[single])
        self.first_ = np.concatenate((self.first[plain], one_by_one))
        self.count_ = np.concatenate((self.count[plain], np.ones(len(one_by_one), np.int64)))
        self.doc_ = np.concatenate((self.doc[plain], np.repeat(self.doc[single], self.count[single])))
        key = np.concatenate((self.hash[plain], _string_hash(self.raw, one_by_one, self.width)))
        of, one = _collapse(self.raw, self.first_, self.count_ + self.width - 1, key, self.width)
        bucket = (key[one] % np.uint64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.class_of, self.one_, self.key_, bucket = place[of], one[by], key[one[by]], bucket[by]
        cuts = _groups(bucket)
        self.sent = {int(bucket[a]): (int(a), int(z)) for a, z in zip(cuts, np.append(cuts[1:], len(bucket)))}


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _repeated_anchors(packs: DataFrame, buckets: int, open_pack) -> DataFrame:
    """(pack, told): per bucket two bits for each of the pack's anchors: in two documents; in very many runs."""
    asked = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
    told = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])

    def ask(batches):
        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(1)):
                p = open_pack(payload)
                runs, apart = p.anchors()
                short = (p.keys >> np.uint64(32)).astype(np.uint32)
                out: list[list] = [[], [], []]
                for bucket, (a, z) in p.cuts.items():
                    steps = np.diff(short[a:z], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
                    for c, v in zip(out, (bucket, number, shrink(steps, np.minimum(runs[a:z], 65_535).astype(np.uint16), np.packbits(apart[a:z])))):
                        c.append(v)
                yield _rows(out, asked)

    def answer(table: pa.Table) -> pa.Table:
        keys, runs, apart = [], [], []
        for data in table.column("data"):
            steps, n, twice = grow(data.as_buffer(), np.uint8, np.uint16, np.uint8)
            keys.append(np.cumsum(np.ascontiguousarray(steps.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32))
            runs.append(n)
            apart.append(np.unpackbits(twice, count=len(n)).view(bool))
        sizes = [len(k) for k in keys]
        keys, runs, apart = np.concatenate(keys), np.concatenate(runs), np.concatenate(apart)
        order = np.argsort(keys)
        first = _groups(keys[order])
        counts = np.diff(np.append(first, len(order)))
        warm, hot = np.empty(len(order), bool), np.empty(len(order), bool)
        warm[order] = np.repeat((counts > 1) | np.logical_or.reduceat(apart[order], first), counts)
        hot[order] = np.repeat(np.add.reduceat(runs[order].astype(np.int64), first) > HOT_RUNS, counts)
        hot &= warm
        out: list[list] = [[], [], []]
        bucket, at = table.column("bucket")[0].as_py(), 0
        for number, n in zip(table.column("pack").to_pylist(), sizes):
            w, t = warm[at : at + n], hot[at : at + n]
            at += n
            if w.any():
                for c, v in zip(out, (number, bucket, shrink(np.packbits(w), np.packbits(t) if t.any() else np.zeros(0, np.uint8)))):
                    c.append(v)
        return pa.Table.from_batches([_rows(out, told)])

    bits = packs.mapInArrow(lean(ask), "bucket int, pack long, data binary").groupBy("bucket").applyInArrow(lean_group(answer), "pack long, bucket int, bits binary")
    return saved(bits.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("told")), "anchors")


def _least_ids(packs: DataFrame, anchors: DataFrame, open_pack, width: int) -> DataFrame:
    """(pack, answers): per bucket the least ids of the pack's strings, in the order the pack sent them."""
    sent = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
    told = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("least", pa.binary())])

    def send(batches):
        for b in batches:
            for number, payload, bits in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                p = open_pack(payload)
                p.strings(bits.as_py())
                least = np.full(len(p.one_), NO_ID, np.int64)
                np.minimum.at(least, p.class_of, p.ids[p.doc_])
                first, length = p.first_[p.one_], p.count_[p.one_] + width - 1
                out: list[list] = [[], [], []]
                for bucket, (a, z) in p.sent.items():
                    data = shrink(p.raw[_ranges(first[a:z], length[a:z])], length[a:z].astype(np.uint16), least[a:z], (p.key_[a:z] >> np.uint64(32)).astype(np.uint32))
                    for c, v in zip(out, (bucket, number, data)):
                        c.append(v)
                yield _rows(out, sent)

    def merge(table: pa.Table) -> pa.Table:
        packs_ = table.column("pack").to_pylist()
        parts = [grow(d.as_buffer(), np.uint8, np.uint16, np.int64, np.uint32) for d in table.column("data")]
        # keys ascend in each pack: some MB of strings are merged at once, by ranges of keys
        ranges = -(-sum(len(x[0]) for x in parts) // MERGE_BYTES) or 1
        limits = np.linspace(0, 1 << 32, ranges + 1).astype(np.int64)[1:-1]
        cuts = [np.concatenate(([0], np.searchsorted(x[3], limits), [len(x[3])])) for x in parts]
        ends = [np.concatenate(([0], np.cumsum(x[1], dtype=np.int64))) for x in parts]
        found: list[list] = [[] for _ in parts]
        for k in range(ranges):
            slices = [(c[k], c[k + 1]) for c in cuts]
            raw = np.concatenate([*(x[0][e[a] : e[z]] for x, e, (a, z) in zip(parts, ends, slices)), np.zeros(16, np.uint8)])
            length, least, key = (np.concatenate([x[i][a:z] for x, (a, z) in zip(parts, slices)]).astype(t) for i, t in ((1, np.int64), (2, np.int64), (3, np.uint32)))
            if len(key):
                for f, r in zip(found, _merged(raw, length, least, key, [z - a for a, z in slices], width)):
                    f.append(r)
        bucket = table.column("bucket")[0].as_py()
        out: list[list] = [[], [], []]
        for number, f in zip(packs_, found):
            for c, v in zip(out, (number, bucket, shrink(*(np.concatenate(x) for x in zip(*f))))):
                c.append(v)
        return pa.Table.from_batches([_rows(out, told)])

    strings = packs.join(anchors, "pack").select("pack", "payload", "told").mapInArrow(lean(send), "bucket int, pack long, data binary")
    answers = strings.groupBy("bucket").applyInArrow(lean_group(merge), "pack long, bucket int, least binary")
    return answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "least")).alias("answers"))


def _merged(raw: np.ndarray, length: np.ndarray, least: np.ndarray, key: np.ndarray, sizes: list[int], width: int):
    """For each pack (``sizes``: its strings) the number of runs of each string, the runs' lengths and least ids."""
    pack = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(length) - length
    of, one = _collapse(raw, first, length, key, width)
    low = np.full(len(one), NO_ID, np.int64)
    np.minimum.at(low, of, least)
    first, length, shard, key = first[one], length[one], pack[one], key[one]
    # blocks of some MB; strings with one anchor stay together
    begin = _groups(key)
    block = np.cumsum(length)[begin] // BLOCK_BYTES
    edges = np.append(begin[_groups(block)], len(one))
    runs, sizes_, ids = np.empty(len(one), np.uint8), [], []
    for a, z in zip(edges, edges[1:]):
        r, s, i = _answer(raw, first[a:z], length[a:z], shard[a:z], low[a:z], width)
        runs[a:z] = r
        sizes_.append(s)
        ids.append(i)
    sizes_, ids = np.concatenate(sizes_), np.concatenate(ids)
    ends, at = np.cumsum(runs, dtype=np.int64), 0
    for n in sizes:
        mine = of[at : at + n]
        at += n
        where = _ranges(ends[mine] - runs[mine], runs[mine].astype(np.int64))
        yield runs[mine], sizes_[where], ids[where]


def _answer(raw, first, length, shard, low, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of one block, in their order: the number of runs of places with one least id, their lengths, their ids."""
    by = np.argsort(shard, kind="stable")
    length_, shard_ = length[by], np.unique(shard[by], return_inverse=True)[1]
    ids = least_in_intervals(raw[_ranges(first[by], length_)], length_, shard_, low[by], width)
    counts = length_ - width + 1
    begin = np.empty(len(by), np.int64)
    begin[by] = np.cumsum(counts) - counts
    counts = length - width + 1
    ids = ids[_ranges(begin, counts)]  # back in the strings' own order
    new = np.zeros(len(ids) + 1, bool)
    new[np.cumsum(counts) - counts] = True
    new[1:-1] |= ids[1:] != ids[:-1]
    new[-1] = True
    at = np.flatnonzero(new)
    edge = np.searchsorted(at, np.append(np.cumsum(counts) - counts, len(ids)))
    return np.diff(edge).astype(np.uint8), np.diff(at).astype(np.uint8), ids[at[:-1]]


def dedup_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 50, spans: str = "removed_spans", kept_text: str = "kept_bytes", as_text: bool = False) -> DataFrame:
    """Adds the removed spans (start, length in bytes) and what is left of the UTF-8 text.

    That is binary, since a cut may part a character; with ``as_text`` it is a string without such parts.
    """
    if width < 8:
        raise ValueError("strings of less than eight bytes have no anchors")
    kept = [f for f in docs.schema.fields if f.name.lower() not in (spans.lower(), kept_text.lower())]
    names = [f.name for f in kept]
    packs = packed(docs.select(*(F.col(f"`{n}`") for n in names)), text)
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packs.count() // 8)

    def open_pack(payload) -> _Pack:
        return _Pack(payload.as_buffer(), id_column, text, width, buckets)

    anchors = _repeated_anchors(packs, buckets, open_pack)
    answers = _least_ids(packs, anchors, open_pack, width)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([*kept, T.StructField(spans, span), T.StructField(kept_text, T.StringType() if as_text else T.BinaryType())])

    def cut(batches):
        for b in batches:
            for k, payload in enumerate(b.column(0)):
                bits, told = b.column(1)[k].as_py(), b.column(2)[k].as_py()  # of one pack at a time
                p = open_pack(payload)
                size = int(p.bounds[-1])
                edge = np.zeros(size + 1, np.int32)
                if told:
                    p.strings(bits)
                    for at in _repeated_places(p, told):
                        edge[at] += 1
                        edge[at + width] -= 1
                gone = np.cumsum(edge[:-1], out=edge[:-1]) > 0
                begins, ends = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
                begins[p.bounds], ends[p.bounds] = True, True
                start = np.flatnonzero(gone & (begins[:-1] | ~np.concatenate(([False], gone[:-1]))))
                end = np.flatnonzero(gone & (ends[1:] | ~np.concatenate((gone[1:], [False])))) + 1
                doc = np.searchsorted(p.bounds, start, "right") - 1
                offsets = np.searchsorted(doc, np.arange(len(p.ids) + 1))
                pair = pa.StructArray.from_arrays([pa.array(start - p.bounds[doc], pa.int64()), pa.array(end - start, pa.int64())], ["start", "length"])
                kept_ = p.raw[:size][~gone]
                left = np.concatenate(([0], np.cumsum(~gone, dtype=np.int32)))[p.bounds]
                texts = pa.Array.from_buffers(pa.large_binary(), len(p.ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept_)])
                if as_text:
                    texts = pa.array([t.decode("utf-8", "ignore") for t in texts.to_pylist()], pa.string())
                columns = [p.batch.column(p.batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pair), texts if as_text else texts.cast(pa.binary())], names=[*names, spans, kept_text])

    return packs.join(anchors, "pack", "left").join(answers, "pack", "left").select("payload", "told", "answers").mapInArrow(lean(cut), schema)


def _repeated_places(p: _Pack, told):
    """Places of the pack's strings that a document with a smaller id has too, some at a time."""
    sizes, ids = [np.zeros(0, np.uint8)] * len(told), [np.zeros(0, np.int64)] * len(told)
    told = sorted(told, key=lambda x: p.sent[x["bucket"]])
    for k, x in enumerate(told):
        _, sizes[k], ids[k] = grow(x["least"], np.uint8, np.uint8, np.int64)
    sizes, ids = np.concatenate(sizes), np.concatenate(ids)
    flat = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)  # where the least id of each place of each class is
    counts = p.count_[p.one_]
    begin = np.cumsum(counts) - counts
    edges = np.append(_groups(np.cumsum(p.count_) // STRIPE), len(p.count_))
    for a, z in zip(edges, edges[1:]):
        n = p.count_[a:z]
        least = ids[flat[_ranges(begin[p.class_of[a:z]], n)]]
        yield _ranges(p.first_[a:z], n)[least < np.repeat(p.ids[p.doc_[a:z]], n)]
