"""Toxicity: a convolutional text classifier in numpy over hashed embeddings.

A word's vector is the mean of the hashed vectors of its byte n-grams (word ends marked).  Filters of one, two and
three words run over the whole text; each is pooled by its maximum, and the pooled values feed a logistic unit.
N-gram vectors start from smoothed log odds of the training documents (the first dimension), filters from that
dimension; everything is then trained by Adam.  Thresholds are calibrated per language on labelled rows kept out of
the training; language is never an input of the score.

Training reads all labelled rows that are not held out, in many tasks whose models are mixed behind each epoch; document
frequencies, class sizes and thresholds are counted over all of them (scores to ``BINS`` steps).  Every text is scored whole.

Defined cases: null and empty texts get the score of a text without any word; unlabelled and null labels are not
learned from; without labels of both classes all texts score 0.25; repeated rows get a row each; an empty table gives
an empty table; other columns are kept, except ones named like the added.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarc.llm.common import lean, lean_group, saved

#: Rows of a pack and of a training step, rows from which a further task learns, and most such tasks.
PACK, BATCH, LEAST, WORKERS = 500, 250, 2000, 64
#: Parts of the table that are added up apart; steps of a score in thresholds; labels that are broadcast at most.
CHUNKS, BINS, BROADCAST = 32, 10_000, 500_000
BUCKETS, DIMS = 1 << 18, 8
GRAMS = (3, 4, 5, 6)
WIDTHS, FILTERS = (1, 2, 3), 6
EPOCHS, RATE, TABLE_RATE, SEED = 6, 0.01, 30.0, 7
SMOOTH = 5.0
#: Texts are joined into runs of about this many bytes.
RUN_BYTES = 500_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the word each belongs to, in word order."""
    raw = np.frombuffer(b"<" + b"><".join(words) + b">" + bytes(8), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(word))
    # a row for each place, a column for each length: the words are in order as they are
    at, ok = np.empty((len(word), len(GRAMS)), np.int64), np.empty((len(word), len(GRAMS)), bool)
    for k, n in enumerate(GRAMS):
        h = np.full(len(word), n, np.uint64)
        for j in range(n):
            h ^= raw[j : j + len(word)]
            h *= np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        at[:, k] = h >> np.uint64(46)
        ok[:, k] = left >= n
    return at[ok], np.repeat(word, ok.sum(1))


def _vectors(table: np.ndarray, at: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    sums = np.zeros((n, table.shape[1]), np.float32)
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        sums[of[first]] = np.add.reduceat(table.take(at, 0), first) / np.diff(np.append(first, len(of)))[:, None]
    return sums


def _numbered(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of words of each text, and the words of all texts by their number from 1."""
    index: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    lengths = np.array([len(t) for t in texts], np.int64)
    numbers = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
    return list(index), lengths, numbers


class _Texts:
    """Texts as rows of word numbers, parted by blanks wide enough for every filter (word 0 is the blank)."""

    def __init__(self, texts: list[list[bytes]], known: tuple | None = None):
        index, lengths, numbers = known or _numbered(texts)
        gap = max(WIDTHS) - 1
        sizes = np.maximum(lengths, 1) + gap
        self.start = np.cumsum(sizes) - sizes
        self.tokens = np.zeros(int(sizes.sum()) + gap, np.int64)
        # a text's words go behind its start
        self.tokens[np.repeat(self.start - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(numbers))] = numbers
        self.n_words = len(index) + 1
        self.at, self.of = _grams([b"", *index]) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        real = self.of > 0
        self.at, self.of = self.at[real], self.of[real]

    def hits(self, m: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        """Vectors of words, and the values of each width's filters at each place."""
        words = _vectors(m["table"], self.at, self.of, self.n_words)
        n = len(self.tokens) - (max(WIDTHS) - 1)
        return words, [sum((words @ m["filters"][k][j]).take(self.tokens[j : j + n], 0) for j in range(width)) for k, width in enumerate(WIDTHS)]

    def pooled(self, hits: list[np.ndarray]) -> np.ndarray:
        """Largest value of each filter in each text."""
        return np.concatenate([np.maximum.reduceat(h, self.start, axis=0) for h in hits], 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_texts(m: dict, texts: list[list[bytes]]) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    t = _Texts(texts)
    return _sigmoid(t.pooled(t.hits(m)[1]) @ m["weights"] + m["bias"]).astype(np.float64)


def start(odds: np.ndarray, n1: float, n0: float) -> dict:
    """A model before training, from document frequencies of n-gram buckets by class and the number of documents of each."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32)
    table[:, 0] = np.log((odds[1] / n1 * 1000 + SMOOTH) / (odds[0] / n0 * 1000 + SMOOTH))
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += 1.0
    return {"table": table, "filters": filters, "weights": np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), "bias": np.float32(-4.0), "moments": {}, "step": 0}


def count_buckets(odds: np.ndarray, data: _Texts, labels: np.ndarray) -> None:
    """Adds the texts to the document frequencies of n-gram buckets by class."""
    word_first = np.searchsorted(data.of, np.arange(data.n_words + 1))
    for s, size, label in zip(data.start, np.diff(np.append(data.start, len(data.tokens))), labels):
        mine = np.unique(data.tokens[s : s + size])
        spots = np.concatenate([data.at[word_first[w] : word_first[w + 1]] for w in mine]) if len(mine) else mine
        odds[int(label)][spots] += 1  # once each, however often a bucket is among them


def learn(m: dict, part: _Texts, y: np.ndarray, n1: float, n0: float) -> None:
    """One step over a batch; n1 and n0 count the documents of each class in the whole training set."""
    n = n1 + n0

    def adam(name, value, grad, step):
        a, b = m["moments"].setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        a = a * 0.9 + 0.1 * grad
        b = b * 0.999 + 0.001 * grad * grad
        m["moments"][name] = [a, b]
        return value - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    target = y.astype(np.float32)
    words, hits = part.hits(m)
    pooled = part.pooled(hits)
    wrong = (_sigmoid(pooled @ m["weights"] + m["bias"]) - target) * np.where(target > 0, n / (2 * n1), n / (2 * n0))
    wrong = (wrong / len(y)).astype(np.float32)
    back = wrong[:, None] * m["weights"]
    m["step"] += 1
    step = m["step"]
    grad_words = np.zeros_like(words)
    width_n = len(part.tokens) - (max(WIDTHS) - 1)
    new_filters = []
    for k, width in enumerate(WIDTHS):
        hit = hits[k]
        mine = back[:, k * FILTERS : (k + 1) * FILTERS]
        best = np.stack([s + np.argmax(hit[s:e], axis=0) for s, e in zip(part.start, np.append(part.start[1:], width_n))])
        grad = np.zeros_like(m["filters"][k])
        for j in range(width):
            token = part.tokens[best + j]
            grad[j] = np.einsum("nfd,nf->df", words[token], mine)
            np.add.at(grad_words, token.ravel(), (mine[:, :, None] * m["filters"][k][j].T[None]).reshape(-1, DIMS))
        new_filters.append(adam(f"f{k}", m["filters"][k], grad, step))
    # n-gram vectors move by plain gradient steps: only those of pooled words have any
    touched = np.flatnonzero(np.abs(grad_words).sum(1))
    if len(touched):
        sizes = np.bincount(part.of, minlength=part.n_words)
        inside = np.isin(part.of, touched)
        np.subtract.at(m["table"], part.at[inside], TABLE_RATE * grad_words[part.of[inside]] / sizes[part.of[inside]][:, None])
    m["weights"], m["bias"] = adam("w", m["weights"], pooled.T @ wrong, step), adam("b", np.float32(m["bias"]), wrong.sum(), step)
    m["filters"] = new_filters


def _thresholds(bins: list) -> dict:
    """Per language the middle of the cut between bins (lang, least, most, n0, n1) that gets most rows right; 0.5 where a class is missing."""
    out = {}
    for lang in sorted({b[0] for b in bins if b[0] is not None}):
        mine = sorted(b[1:] for b in bins if b[0] == lang)
        n0, n1 = np.array([b[2] for b in mine]), np.array([b[3] for b in mine])
        if not n0.sum() or not n1.sum():
            continue
        right = np.concatenate(([n1.sum()], n1.sum() + np.cumsum(n0 - n1)))
        best = np.flatnonzero(right == right.max())
        cut = best[len(best) // 2]
        low, high = (mine[cut - 1][1] if cut else 0.0), (mine[cut][0] if cut < len(mine) else 1.0)
        out[lang] = float(min(max((low + high) / 2, 0.1), 0.9))
    return out


def _summed(parts: DataFrame) -> list:
    """(chunk, data) over the tasks' rows (chunk, part, data): arrays of float32, added in the order of tasks; as many rows as there are tasks meet, WORKERS at most."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = np.zeros(len(rows[0]["data"]) // 4, np.float32)
        for r in rows:
            total += np.frombuffer(r["data"], np.float32)
        return pa.table({"chunk": pa.array([rows[0]["chunk"]], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("chunk").applyInArrow(lean_group(add), "chunk int, data binary").collect()


def _chunks(part: int, arrays: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in arrays], pa.int32()), pa.array([part] * len(arrays), pa.int32()), pa.array([a.astype(np.float32).tobytes() for _, a in arrays], pa.binary())], names=["chunk", "part", "data"])


def _dense(m: dict) -> list[np.ndarray]:
    """What is small of a model, in a fixed order: filters, weights, bias, and their moments."""
    names = [*(f"f{k}" for k in range(len(WIDTHS))), "w", "b"]
    values = [*m["filters"], m["weights"], np.float32(m["bias"])]
    zero = [m["moments"].get(n, [np.zeros_like(v), np.zeros_like(v)]) for n, v in zip(names, values)]
    return [np.asarray(x, np.float32) for x in (*values, *(z[0] for z in zero), *(z[1] for z in zero))]


def _set_dense(m: dict, flat: np.ndarray) -> None:
    like, out, at = _dense(m), [], 0
    for x in like:
        out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    k = len(WIDTHS)
    m["filters"], m["weights"], m["bias"] = out[:k], out[k], np.float32(out[k + 1])
    names = [*(f"f{i}" for i in range(k)), "w", "b"]
    m["moments"] = {n: [out[k + 2 + i], out[2 * (k + 2) + i]] for i, n in enumerate(names)}


def _packs(rows: DataFrame, n: int, workers: int) -> DataFrame:
    """The rows (__id, __text, __lang, __toxic), some hundreds in each compressed pack (part, pack, data), dealt by hash; stored.

    All packs of a part are in one file, so that epochs read them where they are.

    A pack has its batches with words as numbers, so that they are told apart once and not in each epoch.
    """
    schema = "part int, pack long, data binary"

    def batch(some: list) -> tuple:
        index, lengths, numbers = _numbered([_words(r[2]) for r in some])
        return np.array([r[1] for r in some], np.int64), b" ".join(index), lengths.astype(np.int32), numbers.astype(np.int32)

    def pack(table: pa.Table) -> pa.Table:
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("__id", "__toxic", "__text"))), key=lambda r: (r[0], r[1], r[2] or ""))
        return pa.table({"part": table.column("part").slice(0, 1), "pack": table.column("pack").slice(0, 1), "data": pa.array([zlib.compress(pickle.dumps([batch(got[at : at + BATCH]) for at in range(0, len(got), BATCH)]), 1)], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("__id", "__text"), F.lit(max(1, -(-n // PACK)))).alias("pack"), "__id", "__text", "__toxic")
    dealt = dealt.withColumn("part", F.pmod("pack", F.lit(workers)).cast("int")).repartition(workers, "part")
    return saved(dealt.groupBy("part", "pack").applyInArrow(lean_group(pack), schema), "labelled")


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> bytes:
    """The model (a few MB, fixed by the parameters), trained on all labelled rows that are not held out.

    Up to ``WORKERS`` tasks learn from their own packs, batch by batch; behind each epoch their models are mixed: an
    n-gram's vector moves by the mean of the tasks that moved it, the small rest is the mean of all.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__toxic IN (0, 1) AND __id IS NOT NULL").where(~held_out(F.col("__id"))).distinct()
    rows = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`").alias("__text"), (F.col(f"`{lang}`") if lang in docs.columns else F.lit(None)).cast("string").alias("__lang"))
    small = marked.limit(BROADCAST + 1).count() <= BROADCAST
    rows = rows.join(F.broadcast(marked) if small else marked, "__id").select("__id", "__text", "__lang", "__toxic")
    apart = F.crc32(F.concat(F.lit("calibrate"), F.col("__id").cast("string")).cast("binary")) % 5 == 0
    fitted = rows.where(~apart)
    sizes = {r[0]: r[1] for r in fitted.groupBy("__toxic").count().collect()}
    if len(sizes) < 2:
        return pickle.dumps(None)
    n0, n1 = float(sizes[0]), float(sizes[1])
    n = sizes[0] + sizes[1]
    packs = _packs(fitted, n, int(min(WORKERS, -(-n // LEAST))))
    schema = "chunk int, part int, data binary"

    def texts_of(batches, rng=None):
        """(part, texts, labels) of some rows at a time."""
        for b in batches:
            for data, part in zip(b.column(0), b.column(1)):
                got = pickle.loads(zlib.decompress(data.as_py()))
                for i in rng.permutation(len(got)) if rng is not None else range(len(got)):
                    y, index, lengths, numbers = got[i]
                    yield part.as_py(), _Texts([], (index.split(b" ") if index else [], lengths.astype(np.int64), numbers.astype(np.int64))), y

    def counts(batches):
        by: dict[int, np.ndarray] = {}
        for part, texts, y in texts_of(batches):
            count_buckets(by.setdefault(part, np.zeros((2, BUCKETS), np.float32)), texts, y)
        for part, odds in by.items():
            yield _chunks(part, list(enumerate(odds)))

    odds = np.stack([np.frombuffer(r.data, np.float32) for r in sorted(_summed(packs.select("data", "part").mapInArrow(lean(counts), schema)))])
    m = start(odds, n1, n0)

    for epoch in range(EPOCHS):
        sent = spark.sparkContext.broadcast(pickle.dumps(m))

        def run(batches):
            own, of, base = None, None, pickle.loads(sent.value)

            def done():
                moved = own["table"] - base["table"]
                hit = np.abs(moved).sum(1) > 0
                cut = BUCKETS // CHUNKS
                yield _chunks(of, [(k, np.concatenate([moved[k * cut : (k + 1) * cut].ravel(), hit[k * cut : (k + 1) * cut].astype(np.float32)])) for k in range(CHUNKS)])
                yield _chunks(of, [(CHUNKS, np.concatenate([*(x.ravel() for x in _dense(own)), np.array([own["step"], 1], np.float32)]))])

            rng = np.random.default_rng(SEED + epoch)
            for part, texts, y in texts_of(batches, rng):
                if part != of:
                    if own is not None:
                        yield from done()
                    own, of = pickle.loads(sent.value), part
                learn(own, texts, y, n1, n0)
            if own is not None:
                yield from done()

        turn = packs.sortWithinPartitions("part", F.xxhash64("pack", F.lit(epoch)), "pack").select("data", "part")
        for chunk, data in _summed(turn.mapInArrow(lean(run), schema)):
            got, cut = np.frombuffer(data, np.float32), BUCKETS // CHUNKS
            if chunk < CHUNKS:
                m["table"][chunk * cut : (chunk + 1) * cut] += got[: cut * DIMS].reshape(cut, DIMS) / np.maximum(got[cut * DIMS :], 1)[:, None]
            else:
                _set_dense(m, got[:-2] / got[-1])
                m["step"] = int(round(got[-2] / got[-1]))
        sent.unpersist()
    m["table"] = m["table"].astype(np.float16)
    del m["moments"], m["step"]
    m["thresholds"] = {}
    rest = score_documents(rows.where(apart).select("__id", "__text", "__lang", "__toxic"), pickle.dumps(m), "__text", "__lang", "__s", "__t")
    bins = rest.groupBy("__lang", F.floor(F.col("__s") * BINS)).agg(F.min("__s"), F.max("__s"), F.count_if(F.col("__toxic") == 0), F.count_if(F.col("__toxic") == 1))
    m["thresholds"] = _thresholds([(r[0], *r[2:]) for r in bins.collect()])  # a row for each language and bin
    return pickle.dumps(m)


def score_documents(docs: DataFrame, model: bytes, text: str = "text", lang: str = "lang", score: str = "score", threshold: str = "threshold") -> DataFrame:
    """Adds ``score`` (0 to 1) and the ``threshold`` of the document's language."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in (score.lower(), threshold.lower())]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(score, T.DoubleType()), T.StructField(threshold, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = pickle.loads(sent.value)
        if m is not None:
            m["table"] = m["table"].astype(np.float32)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + RUN_BYTES)))
                part = b.slice(at, to - at)
                scores = score_texts(m, [_words(t) for t in texts.slice(at, to - at).to_pylist()]) if m is not None else np.full(to - at, 0.25)
                own = m["thresholds"] if m is not None else {}
                cut = [own.get(x, 0.5) for x in part.column(part.schema.get_field_index(lang)).to_pylist()] if lang in names else [0.5] * (to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(scores, pa.float64()), pa.array(cut, pa.float64())], names=[*names, score, threshold])
                at = to

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(lean(run), schema)
