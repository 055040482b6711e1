"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every training passage is a query.  Passages are windows of twice the longest item's words, half overlapping, so that
any leaked item lies whole inside one.  An item's BM25 weights are divided by its own full score, so that one
threshold (a share of the item's score) holds for all.  Items sit in blocks; a term's postings carry the largest
weight over all items and the largest inside each block.  A passage is dropped when the first add up to less than the
threshold, a block when the second do; the items of the blocks left are scored in full.  These bounds never cut off
an item at or above the threshold, so all of them are found.

A found item counts as leaked if the passage holds ``overlap`` of its five-word shingles, and of the words of its
question and of its answer (the last line or sentence; the second half of an item with only one).

The index is built over all items and sent in shards of at most ``SHARD_BYTES`` of text, whose size is checked; every
shard meets every passage.

Defined cases: null and wordless texts and items never match; items under five words are one shingle; a repeated item
matches by each of its ids; null ids of documents stay null; an empty table on either side gives no leaks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import saved

K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK = 8
#: Text of one shard; its term by item matrix stays at some tens of MB.
SHARD_BYTES = 200_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[set[bytes], set[bytes]]:
    parts = [p for p in re.split(r"\n+|(?<=[.!?])\s+", text) if p.split()]
    if len(parts) > 1:
        return set(words_of(" ".join(parts[:-1]))), set(words_of(parts[-1]))
    words = words_of(text)
    return set(words[: (len(words) + 1) // 2]), set(words[len(words) // 2 :])


@dataclass
class Index:
    """Terms by number; ``weights[t]`` holds (item, weight) in item order, ``most[t]`` and ``blocks[t]`` the bounds."""

    items: list[int]
    words: list[list[bytes]]
    terms: dict[bytes, int]
    weights: np.ndarray  # terms x items
    most: np.ndarray
    blocks: np.ndarray  # terms x blocks
    grams: list[set]
    halves: list[tuple[set, set]]
    longest: int


def build_index(items: list[tuple[int, str]], idf: dict[bytes, float], mean: float, longest: int) -> Index:
    items = [(i, t) for i, t in items if words_of(t)]
    words = [words_of(t) for _, t in items]
    terms: dict[bytes, int] = {}
    for w in words:
        for x in w:
            terms.setdefault(x, len(terms))
    weights = np.zeros((len(terms), len(items)), np.float32)
    for k, w in enumerate(words):
        at, tf = np.unique([terms[x] for x in w], return_counts=True)
        got = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        weights[at, k] = got
    weights *= np.array([idf[t] for t in terms], np.float32)[:, None] if terms else 1
    weights /= weights.sum(0) if items else 1
    pad = np.zeros((len(terms), -len(items) % BLOCK), np.float32)
    blocks = np.concatenate((weights, pad), 1).reshape(len(terms), -1, BLOCK).max(2) if items else weights
    return Index([i for i, _ in items], words, terms, weights, weights.max(1) if items else np.zeros(0), blocks, [shingles(w) for w in words], [question_and_answer(t) for _, t in items], longest)


def search(index: Index, words: list[bytes], threshold: float):
    """(window, item, score) of all items at or above the threshold, for every window of a text; windows by number."""
    terms = index.terms
    at = np.array([terms.get(w, -1) for w in words], np.int32)
    step = index.longest
    windows = max(1, -(-len(at) // step) - 1)
    slack = threshold - 1e-4
    # level 0: the largest weights of all words, repeats included, can only be more than those of the distinct ones
    rough = np.concatenate(([0.0], np.cumsum(np.where(at >= 0, index.most[at], 0.0))))
    start = np.arange(windows) * step
    open_ = np.flatnonzero(rough[np.minimum(start + 2 * step, len(at))] - rough[start] >= slack)
    for n in open_.tolist():
        here = at[n * step : (n + 2) * step]
        here = np.unique(here[here >= 0])
        if index.most[here].sum() < slack:
            continue
        alive = np.flatnonzero(index.blocks[here].sum(0) >= slack)
        for b in alive.tolist():
            score = index.weights[here, b * BLOCK : (b + 1) * BLOCK].sum(0)
            for k in np.flatnonzero(score >= slack).tolist():
                yield n, b * BLOCK + k, float(score[k])


def leaks_in(index: Index, text: str | None, threshold: float, overlap: float):
    """(item, score, overlap) of each leaked item, best window first come."""
    words = words_of(text)
    if not words or not index.items:
        return []
    found: dict[int, tuple[float, float]] = {}
    grams: dict[int, tuple] = {}
    for n, k, score in search(index, words, threshold):
        if n not in grams:
            window = words[n * index.longest : (n + 2) * index.longest]
            grams = {n: (shingles(window), set(window), window)}
        have, bag, window = grams[n]
        own = index.grams[k]
        if len(index.words[k]) < SHINGLE:
            size, goal = len(index.words[k]), tuple(index.words[k])
            share = float(any(tuple(window[i : i + size]) == goal for i in range(len(window) - size + 1)))
        else:
            share = len(own & have) / len(own)
        q, a = index.halves[k]
        if share >= overlap and len(q & bag) >= overlap * len(q) and len(a & bag) >= overlap * len(a):
            if k not in found or (share, score) > found[k]:
                found[k] = (share, score)
    return [(index.items[k], score, share) for k, (share, score) in sorted(found.items())]


def index_shards(benchmark: DataFrame, item: str = "item_id", text: str = "text"):
    """Indexes over all items, each of a bounded size; document frequencies are those of all items together."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 + total // SHARD_BYTES
    if shards > 1:
        sized = saved(items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards))), "items")
    else:
        sized = items.withColumn("shard", F.lit(0).cast("long"))
    words = F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t\\n\\x0B\\f\\r]+"), "")
    whole = sized.select(F.size(words).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    frequency = sized.select(F.explode(F.array_distinct(words)).alias("word"), "shard").groupBy("word").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards"))
    if shards > 1:
        frequency = saved(frequency, "frequency")
    for s in range(shards):
        rows = [(r.item, r.text) for r in sized.where(F.col("shard") == s).orderBy("item", "text").select("item", "text").collect()]
        df = frequency.where(F.array_contains("shards", s)).select("word", "df").collect()
        idf = {r.word.encode(): float(np.log(1 + (whole.n - r.df + 0.5) / (r.df + 0.5))) for r in df}
        yield spark.sparkContext.broadcast(build_index(rows, idf, whole.mean or 1.0, max(whole.longest or 1, SHINGLE)))


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, bm25_share, overlap): every leaked item of every document."""
    narrow = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, item_id long, bm25_share double, overlap double"

    def against(index):
        def run(batches):
            for b in batches:
                out: list[list] = [[], [], [], []]
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item, score, share in leaks_in(index.value, t, threshold, overlap):
                        for o, v in zip(out, (i, item, score, share)):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "bm25_share", "overlap"])

        return run

    out = None
    for index in index_shards(benchmark):
        part = narrow.mapInArrow(against(index), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The documents in which no item is leaked, with their columns; each shard of the index filters in turn."""
    at = docs.columns.index(text)

    def against(index):
        def run(batches):
            for b in batches:
                clean = [not leaks_in(index.value, t, threshold, overlap) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    for index in index_shards(benchmark):
        docs = docs.mapInArrow(against(index), docs.schema)
    return docs
