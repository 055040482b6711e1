"""Perplexity under a Brown class-based bigram model.

Exchange clustering assigns words to classes.  The most frequent words (``CORE``) seed the classes: each moves to the
class that raises the likelihood of the class bigrams most, until a round gains next to nothing.  Then every other word that training
holds at least ``LEAST`` times moves to the class that raises it most, given how often each class stands before and
after it in the whole corpus; rounds go on until the likelihood gains less than ``GAIN`` of itself.  Rarer words have
no context to speak of: they belong to classes by their shape (length and last sign), which hold any number of words,
unseen ones too.  log10 P(text) sums, over its words and one end mark, class transition + word emission.

Everything that grows with the vocabulary is distributed.  Texts are written once, as packs of word numbers with the
pack's own word list.  Packs send their words to buckets (by hash), which count them and give each a number; later
rounds exchange numbers only: a pack sends the classes met beside each of its words, the bucket answers with the
word's class.  Only the bigram counts between bounded sets (core words and shapes; classes) reach the driver.

Defined cases: null and empty texts score their end mark alone; words never seen in training have count 0 and the
share of one unseen word of their shape; null ids count as training text (crc32 of nothing); repeated rows count and
score each; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import grow, saved, saved_by, shrink

#: Words that are exchanged one by one to seed the classes, and the number of classes.
CORE, CLASSES = 800, 48
#: Words with fewer training tokens have a class by shape.
LEAST = 2
#: Rounds of exchange over the whole vocabulary end when one gains less than this share of the log likelihood.
GAIN, ROUNDS, SEED_GAIN = 0.002, 4, 3e-5
LENGTHS, SIGNS = 12, 4
SHAPES = LENGTHS * SIGNS
#: Weight of the class's own share in a transition.
BACKOFF = 20.0
PACK_BYTES = 3 << 20
#: Contexts of words that are weighed at once.
CHUNK = 1 << 14
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())


def training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shape_of(word: bytes) -> int:
    end = word[-1:]
    sign = 1 if end in b".!?" else 2 if end in b",;:" else 0 if end.isalnum() or end > b"\x7f" else 3
    return min(len(word), LENGTHS) - 1 + LENGTHS * sign


def _grown(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _likelihood(between: np.ndarray) -> float:
    """Log likelihood of the class bigrams, without the part that no classes change."""
    return float(_grown(between).sum() - _grown(between.sum(0)).sum() - _grown(between.sum(1)).sum())


def exchange(bigrams: np.ndarray, movable: int, classes: int) -> np.ndarray:
    """A class per symbol: the first ``movable`` ones are exchanged among ``classes``, each other is its own class.

    Every move raises the likelihood; rounds over all words end when one gains less than ``SEED_GAIN`` of it.
    """
    n = len(bigrams)
    of = np.concatenate((np.arange(movable) % classes, classes + np.arange(n - movable))).astype(np.int64)
    member = np.zeros((n, classes + n - movable))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # per word: counts of classes after and before it
    between = member.T @ right
    reached, before = _likelihood(between), -np.inf
    while reached - before > SEED_GAIN * abs(reached):
        before = reached
        for w in range(movable):
            old, same = of[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[old] -= same
            l[old] -= same
            m = between.copy()
            m[old] -= r
            m[:, old] -= l
            m[old, old] -= same
            out_, in_ = m.sum(1), m.sum(0)
            k = np.arange(classes)
            gain = (_grown(m[k] + r) - _grown(m[k])).sum(1) + (_grown(m[:, k].T + l) - _grown(m[:, k].T)).sum(1)
            d = m[k, k]
            gain += _grown(d + r[k] + l[k] + same) - _grown(d) - (_grown(d + r[k]) - _grown(d)) - (_grown(d + l[k]) - _grown(d))
            gain -= _grown(out_[k] + r.sum() + same) - _grown(out_[k]) + _grown(in_[k] + l.sum() + same) - _grown(in_[k])
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-6:
                continue
            of[w] = new
            m[new] += r
            m[:, new] += l
            m[new, new] += same
            between = m
            right[:, old] -= bigrams[:, w]
            right[:, new] += bigrams[:, w]
            left[:, old] -= bigrams[w]
            left[:, new] += bigrams[w]
        reached = _likelihood(between)
    return of


def best_classes(row: np.ndarray, context: np.ndarray, n: np.ndarray, of: np.ndarray, between: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams most, all else being as it is.

    ``n[i]``: how often word ``row[i]`` (ascending) has the context ``context[i]``: class c after it (c) or before it
    (c + number of classes).  ``of``: the words' present classes.  Words without any context keep theirs.
    """
    words = len(of)
    tables = np.concatenate((between[:classes], between.T[:classes]), 1).T  # context x class
    grown = _grown(tables)
    once = _grown(tables + 1) - grown
    gain = np.zeros((words, classes))
    sums = np.zeros((2, words))
    np.add.at(sums, ((context >= len(between)).astype(np.int64), row), n)
    for a in range(0, len(row), CHUNK):
        r, c, m = row[a : a + CHUNK], context[a : a + CHUNK], n[a : a + CHUNK]
        each = once[c]
        more = np.flatnonzero(m > 1)
        each[more] = _grown(tables[c[more]] + m[more, None]) - grown[c[more]]
        own = np.flatnonzero(of[r] < classes)  # its own counts are taken out of the word's present class
        k = of[r[own]]
        rest = np.maximum(tables[c[own], k] - m[own], 0)
        each[own, k] = _grown(rest + m[own]) - _grown(rest)
        begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        gain[r[begin]] += np.add.reduceat(each, begin)
    at = np.arange(words)
    for share, s in ((between.sum(1)[:classes], sums[0]), (between.sum(0)[:classes], sums[1])):
        for a in range(0, words, CHUNK):
            gain[a : a + CHUNK] -= _grown(share + s[a : a + CHUNK, None]) - _grown(share)
        own = at[of < classes]
        k, s = of[own], s[own]
        rest = np.maximum(share[k] - s, 0)
        gain[own, k] += _grown(share[k] + s) - _grown(share[k]) - _grown(rest + s) + _grown(rest)
    keep = np.where(of < classes, gain[at, np.minimum(of, classes - 1)], -np.inf)
    best = np.argmax(gain, 1)
    return np.where((gain[at, best] > keep + 1e-9) & (sums.sum(0) > 0), best, of)


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Steps between numbers, byte by byte: ascending ones take little room once they are compressed."""
    return np.diff(numbers.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(pack, meta, words, tokens): packs of texts as numbers of the pack's words; -1 ends a text.

    Words are sorted by bucket hash, so that a pack's words of a bucket stand together.
    """
    schema = pa.schema([("pack", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids: list = []
        flat: list[list[int]] = []
        index: dict[bytes, int] = {}
        size = 0

        def flush():
            words = list(index)
            hashes = _hashes(words)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(words) + 1, np.int32)
            place[order] = np.arange(len(words))
            place[-1] = -1
            tokens = place[np.array([x for f in flat for x in f], np.int64)]
            known = np.array([0 if i is None else i for i in ids], np.int64)
            null = np.array([i is None for i in ids], bool)
            train = np.array([training(i) for i in ids], bool)
            ordered = [words[i] for i in order.tolist()]
            lengths = np.fromiter(map(len, ordered), np.int32, len(ordered))
            shapes = np.fromiter(map(shape_of, ordered), np.uint8, len(ordered))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([shrink(np.frombuffer(b"".join(ordered), np.uint8), lengths, _planes(hashes[order] >> np.uint64(32)), shapes)], pa.binary()),
                    pa.array([shrink(known, null, train, tokens.view(np.uint8).reshape(-1, 4).T)], pa.binary()),
                ],
                schema=schema,
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                ids.append(i)
                flat.append([index.setdefault(w, len(index)) for w in words] + [-1])
                size += len(t) if t else 0
                if size > PACK_BYTES:
                    yield flush()
                    number += 1
                    ids, flat, index, size = [], [], {}, 0
        if ids:
            yield flush()

    narrow = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return saved_by(narrow.mapInArrow(run, "pack long, words binary, tokens binary"), "pack", "texts")


class _Pack:
    def __init__(self, words, tokens):
        raw, self.lengths, hashes, self.shapes = grow(words, np.uint8, np.int32, np.uint8, np.uint8)
        self.raw, self.hashes = raw.tobytes(), _from_planes(hashes)  # the upper halves
        self.cuts = np.concatenate(([0], np.cumsum(self.lengths)))
        ids, null, self.train, planes = grow(tokens, np.int64, bool, bool, np.uint8)
        self.ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.tokens = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
        self.ends = np.flatnonzero(self.tokens < 0)
        self.sizes = np.diff(self.ends, prepend=-1)

    def symbols(self, core: dict[bytes, int], core_hashes: np.ndarray) -> np.ndarray:
        """Number of each word: of a core word its own, of all others ``len(core)`` + shape."""
        out = self.shapes.astype(np.int64) + len(core)
        for i in np.flatnonzero(np.isin(self.hashes, core_hashes)).tolist():
            if (c := core.get(self.raw[self.cuts[i] : self.cuts[i + 1]])) is not None:
                out[i] = c
        return out

    def taught(self) -> np.ndarray:
        """Which tokens are training tokens."""
        return np.repeat(self.train, self.sizes)

    def pairs(self, symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(before, after, training) of each token, in ``symbols`` by word, with ``end`` around texts."""
        s = np.append(symbols, end)[self.tokens]  # the end mark is the last one
        return np.concatenate(([end], s[:-1])), s, self.taught()


def _spans(bucket_of: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted bucket numbers."""
    if not len(bucket_of):
        return []
    cuts = np.flatnonzero(np.concatenate(([True], bucket_of[1:] != bucket_of[:-1])))
    return list(zip(bucket_of[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(bucket_of)).tolist()))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of (upper halves of) hashes, so that words in hash order are in bucket order."""
    return hashes * buckets >> 32


def _sums(at: np.ndarray, name: str) -> pa.RecordBatch:
    where = np.flatnonzero(at)
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(at[where], pa.int64())], names=[name, "n"])


def _bigrams(packs: DataFrame, symbols_of, symbols: int) -> np.ndarray:
    """Counts of symbol pairs in the training text (symbols^2 numbers, whatever the size of the corpus)."""

    def count(batches):
        sums = np.zeros(symbols * symbols, np.int64)
        for b in batches:
            for row in b.to_pylist():
                before, after, taught = symbols_of(row)
                sums += np.bincount(before[taught] * symbols + after[taught], minlength=symbols * symbols)
        yield _sums(sums, "pair")

    got = packs.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols * symbols)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(symbols, symbols)


def _counted(packs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, told): per bucket its words with training counts; per pack and bucket the number and count of each word."""
    asked = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
    out = pa.schema([("kind", pa.int32()), ("pack", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("top", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])

    def ask(batches):
        for b in batches:
            for number, words, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = _Pack(words, tokens)
                mine = p.tokens[p.taught() & (p.tokens >= 0)]
                n = np.bincount(mine, minlength=len(p.lengths))
                rows: list[list] = [[], [], []]
                for bucket, a, z in _spans(_bucket(p.hashes, buckets)):
                    data = shrink(np.frombuffer(p.raw[p.cuts[a] : p.cuts[z]], np.uint8), p.lengths[a:z], n[a:z].astype(np.int32))
                    for c, v in zip(rows, (bucket, number, data)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, asked)], schema=asked)

    def count(table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        numbers, counts = [], []
        for data in table.column("data"):
            raw, lengths, n = grow(data.as_buffer(), np.uint8, np.int32, np.int32)
            raw, ends = raw.tobytes(), np.cumsum(lengths).tolist()
            numbers.append(np.fromiter((index.setdefault(raw[a:z], len(index)) for a, z in zip([0, *ends], ends)), np.int32, len(ends)))
            counts.append(n)
        total = np.bincount(np.concatenate(numbers), weights=np.concatenate(counts), minlength=len(index)).astype(np.int64)
        words = list(index)
        place = np.empty(len(words), np.int64)  # numbers in hash order, as packs have their words
        order = np.argsort(_hashes(words), kind="stable")
        place[order] = np.arange(len(words))
        numbers, total, words = [place[k] for k in numbers], total[order], [words[i] for i in order.tolist()]
        top = sorted(range(len(words)), key=lambda i: (-total[i], words[i]))[:CORE]
        bucket = table.column("bucket")[0].as_py()
        rows = [(1, number, bucket, shrink(_planes(k), total[k]), None, None, None) for number, k in zip(table.column("pack").to_pylist(), numbers)]
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        shapes = np.fromiter(map(shape_of, words), np.uint8, len(words))
        best = pickle.dumps([(words[i], int(total[i])) for i in top if total[i]])
        rows.append((0, None, bucket, shrink(lengths, total, shapes), best, int(total.sum()), int((total > 0).sum())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    made = saved(packs.mapInArrow(ask, "bucket int, pack long, data binary").groupBy("bucket").applyInArrow(count, "kind int, pack long, bucket int, data binary, top binary, tokens long, types long"), "words")
    told = made.where("kind = 1").groupBy("pack").agg(F.collect_list(F.struct("bucket", "data")).alias("told"))
    return made.where("kind = 0"), told


def _numbers(told) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(number in its bucket, training count) of a pack's words, in their order, and the buckets' spans."""
    numbers, counts, spans, at = [], [], [], 0
    for x in sorted(told or [], key=lambda x: x["bucket"]):
        k, n = grow(x["data"], np.uint8, np.int64)
        k = _from_planes(k)
        numbers.append(k)
        counts.append(n)
        spans.append((x["bucket"], at, at + len(k)))
        at += len(k)
    none = np.zeros(0, np.int64)
    return np.concatenate(numbers) if numbers else none, np.concatenate(counts) if counts else none, spans


def _round(packs: DataFrame, told: DataFrame, model, classes: int, last: DataFrame | None) -> DataFrame:
    """(pack, bucket, data): new classes of the pack's words, in their order, given all present classes."""
    asked = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
    told_schema = "pack long, bucket int, data binary"

    def ask(batches):
        seeds, between = model.value
        total = len(between)
        for b in batches:
            for r in b.to_pylist():
                p = _Pack(r["words"], r["tokens"])
                numbers, counts, spans = _numbers(r["told"])
                cls = _classes(p, seeds, r.get("classes"))
                before, after, taught = p.pairs(cls, total - 1)
                word = p.tokens
                free = (counts >= LEAST) & (p.symbols(*seeds[:2]) >= len(seeds[0]))
                at = np.flatnonzero(taught & (word >= 0) & np.append(free, False)[word])
                w = np.concatenate((word[at], word[at])).astype(np.int64)
                c = np.concatenate((after[at + 1], before[at] + total))  # a word is never the last token
                key, n = np.unique(w * (2 * total) + c, return_counts=True)
                w, c = key // (2 * total), key % (2 * total)
                met = np.bincount(w, minlength=len(numbers)).astype(np.int32)  # contexts of each word
                edge = np.concatenate(([0], np.cumsum(met)))
                rows: list[list] = [[], [], []]
                for bucket, a, z in spans:
                    lo, hi = edge[a], edge[z]
                    data = shrink(_planes(numbers[a:z]), free[a:z], cls[a:z].astype(np.uint8), met[a:z], c[lo:hi].astype(np.uint16), n[lo:hi].astype(np.int32))
                    for col, v in zip(rows, (bucket, r["pack"], data)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(rows, asked)], schema=asked)

    def move(table: pa.Table) -> pa.Table:
        _, between = model.value
        parts = [grow(d.as_buffer(), np.uint8, bool, np.uint8, np.int32, np.uint16, np.int32) for d in table.column("data")]
        parts = [(_from_planes(p[0]), *p[1:]) for p in parts]
        words = 1 + max((int(p[0].max()) for p in parts if len(p[0])), default=-1)
        of = np.zeros(words, np.int64)
        free = np.zeros(words, bool)
        for number, f, cls, *_ in parts:
            of[number], free[number] = cls, f
        row = np.concatenate([np.repeat(p[0], p[3]) for p in parts])
        context, n = np.concatenate([p[4] for p in parts]).astype(np.int64), np.concatenate([p[5] for p in parts]).astype(np.int64)
        width = 2 * len(between)
        key = row * width + context
        del row, context
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else order
        key, n = key[first], np.add.reduceat(n, first) if len(first) else n
        new = of.copy()
        at = np.flatnonzero(free)
        place = np.cumsum(free) - 1
        new[at] = best_classes(place[key // width], key % width, n, of[at], between, classes)
        bucket = table.column("bucket")[0].as_py()
        rows = [(number, bucket, shrink(new[p[0]].astype(np.uint8))) for number, p in zip(table.column("pack").to_pylist(), parts)]
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pack", "bucket", "data"])

    rows = packs.join(told, "pack", "left")
    if last is not None:
        rows = rows.join(last, "pack", "left")
    found = rows.mapInArrow(ask, "bucket int, pack long, data binary").groupBy("bucket").applyInArrow(move, told_schema)
    return saved_by(found.groupBy("pack").agg(F.collect_list(F.struct("bucket", "data")).alias("classes")), "pack", "classes")


def _classes(p: _Pack, seeds, told) -> np.ndarray:
    """The class of each of the pack's words: as the last round told, else of core words their own, of others by shape."""
    if told:
        return np.concatenate([grow(x["data"], np.uint8)[0] for x in sorted(told, key=lambda x: x["bucket"])]).astype(np.int64)
    core, hashes, of = seeds
    return of[p.symbols(core, hashes)]


def score_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    packs = _texts(docs, id_column, text)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packs.count() // 8)
    vocabulary, told = _counted(packs, buckets)
    told = saved_by(told, "pack", "numbers")
    sums = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()

    # the core: at most CORE words of each bucket are compared, CORE of all are kept
    def best(batches):
        kept: list = []
        for b in batches:
            for top in b.column(0).to_pylist():
                kept = sorted(kept + pickle.loads(top), key=lambda x: (-x[1], x[0]))[:CORE]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    frequent = vocabulary.select("top").mapInArrow(best, "word binary, n long").orderBy(F.desc("n"), "word").limit(CORE).collect()
    core = {bytes(r.word): i for i, r in enumerate(frequent)}
    movable, end = len(core), len(core) + SHAPES
    classes = max(1, min(CLASSES, movable))
    total = classes + SHAPES + 1
    core_hashes = np.sort((_hashes(list(core)) >> np.uint64(32)).astype(np.int64))
    sent = spark.sparkContext.broadcast((core, core_hashes))  # CORE words

    def plain(row):
        p = _Pack(row["words"], row["tokens"])
        return p.pairs(p.symbols(*sent.value), end)

    of = exchange(_bigrams(packs, plain, end + 1), movable, classes)
    seeds = (core, core_hashes, of)
    model = spark.sparkContext.broadcast(seeds)

    def classed(row):
        p = _Pack(row["words"], row["tokens"])
        return p.pairs(_classes(p, model.value, row.get("classes")), total - 1)

    rows, last, between = packs.join(told, "pack", "left"), None, _bigrams(packs, classed, total)
    for _ in range(ROUNDS):
        made = _round(packs, told, spark.sparkContext.broadcast((seeds, between)), classes, last)
        now = _bigrams(packs.join(made, "pack", "left"), classed, total)
        gain = _likelihood(now) - _likelihood(between)
        if last is not None and gain < 0:
            break
        last, between = made, now
        if gain < GAIN * abs(_likelihood(between)):
            break

    # tokens of each class, and the room of each shape: one unseen word each
    def rooms(batches):
        in_class, room = np.zeros(total, np.int64), np.zeros(SHAPES, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                _, n, shape = grow(data, np.int32, np.int64, np.uint8)
                rare = (n > 0) & (n < LEAST)
                room += np.bincount(shape[rare], weights=n[rare] + 1, minlength=SHAPES).astype(np.int64)
        yield _sums(np.concatenate((in_class, room)), "at")

    room = np.ones(SHAPES)
    for r in vocabulary.select("data").mapInArrow(rooms, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        room[r["at"] - total] += r["n"]
    mass = between.sum(0)
    share = (mass + 1) / (mass.sum() + total)
    step = np.log10((between + BACKOFF * share) / (between.sum(1, keepdims=True) + BACKOFF))
    ends = int(mass[-1])
    final = spark.sparkContext.broadcast((seeds, step, mass, room, sums.tokens + ends, sums.types + (ends > 0), ends))

    def score(batches):
        seeds, step, mass, room, tokens, types, ends = final.value
        below = np.log10(tokens + types + 1)
        for b in batches:
            for r in b.to_pylist():
                p = _Pack(r["words"], r["tokens"])
                counts = _numbers(r["told"])[1]
                cls = _classes(p, seeds, r.get("classes"))
                frequent = cls < classes
                emit = np.where(frequent, np.log10(np.maximum(counts, 1) / np.maximum(mass[np.minimum(cls, classes)], 1)), np.log10((counts + 1) / room[p.shapes]))
                emit, base, seen = np.append(emit, 0.0), np.append(np.log10(counts + 1) - below, np.log10(ends + 1) - below), np.append(counts > 0, ends > 0)
                before, after, _ = p.pairs(cls, total - 1)
                first = p.ends - p.sizes + 1
                cut = lambda x: np.add.reduceat(x, first)
                logs = cut(step[before, after] + emit[p.tokens])
                columns = (
                    p.ids,
                    ~p.train,
                    p.sizes,
                    cut(seen[p.tokens].astype(np.int64)),
                    np.full(len(p.ids), tokens),
                    cut(base[p.tokens]),
                    logs,
                    np.power(10.0, -logs / p.sizes),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[n.split()[0] for n in SCORED.split(", ")])

    return rows.join(last, "pack", "left").mapInArrow(score, SCORED)
