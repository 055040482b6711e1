"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes.  An interval of tokens that covers the same bytes on both sides is parted at an end
that both have: the end in its middle is looked up on the other side by bisection, then its neighbours outwards, and
both halves are parted in turn; an interval without a shared end inside is a leaf group.  All open intervals of some
texts go one step at a time, as arrays.

Tokens of one group are linked where their bytes overlap.  How many documents hold a pair of ids linked is counted over
the corpus: tasks make *packs* of some MB of text, each pack sends its distinct pairs with their numbers of documents,
these are summed, and every pack gets the sums of its own pairs back.  So a pair that all documents have costs a row
for each pack, not for each document, and neither texts nor tokens are exchanged (a pack's references to its pairs are).

Ids come from the tokenizers' own libraries for distinct stretches of text only: a text is cut before single spaces and
around single line feeds between plain signs, where both tokenizers cut in any case.

Defined cases: null and empty texts, and those whose tokens' bytes differ from a space and the text on either side, have
no tokens: zeros, and an empty digest; null ids and repeated rows are kept, each counts as a document; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import grow, lean, runs, saved, shrink, worker_cached

#: Bytes of text that are worked on at a time, and of a pack (each has one text at least).
SLICE, PACK = 1 << 20, 1 << 23
#: Stretches of text whose ids a worker keeps; beyond it the store starts anew (it is only a cache).
CACHED = 200_000
#: Signs that no pre-tokenizer takes for white space; where single spaces and line feeds stand between two of them, it cuts.
PLAIN = "[!-~À-ÖØ-öø-ÿ]"
STRETCH = re.compile(rf" ?{PLAIN}+(?= {PLAIN}|\n{PLAIN}|\Z)|\n(?={PLAIN})|(?s:.+?)(?<={PLAIN})(?= {PLAIN}|\n{PLAIN}|\Z)|(?s:.+)")
#: What stands between spaces and line feeds in most texts; texts with anything else are cut by STRETCH.
REGULAR = re.compile(rf" ?{PLAIN}(?:[^ \n]*{PLAIN})?|\n")
#: Parts stretches for a moment; texts that have it are cut by STRETCH.
MARKER = "\x1f"


def byte_of_sign() -> dict[str, int]:
    """Byte-level entries: printable bytes stand for themselves, the others in order for the signs from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level tokenizer, given as the content of its JSON file: the bytes of each id, and ids of stretches."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        if json.loads(spec)["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a prefix space would be added to every stretch")
        self.coder = Tokenizer.from_str(spec)
        self.coder.encode_special_tokens = True
        of = byte_of_sign()
        entries = self.coder.get_vocab()
        self.surface = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.surface[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(stretches, add_special_tokens=False)]


class Pieces:
    """A piece tokenizer, given as the content of its model file: the bytes of each id, and ids of stretches.

    The space that it puts before a text is left to the caller, so that a stretch has the ids that it has inside a text.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        norm, kinds = spec.normalizer_spec, pb.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that add a space and change nothing else are supported")
        if any(p.type == kinds.NORMAL and ("\n" in p.piece or "▁" in p.piece.lstrip("▁")) for p in spec.pieces):
            raise ValueError("pieces reach over the ends of stretches")
        norm.add_dummy_prefix = False
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace("▁", " ").encode() for p in spec.pieces]

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return self.coder.encode(stretches, num_threads=1)


class Stretches:
    """Ids of both sides for each stretch of text met so far; texts are put together from these."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = a, b
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]
        self.ends = [np.zeros(1, np.int64) for _ in self.sides]

    def _learn(self, words: list[str]) -> None:
        fresh = list(set(words).difference(self.number))
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        for k, side in enumerate(self.sides):
            ids = side.encode(fresh) if fresh else []
            self.flat[k] = np.concatenate([self.flat[k], np.fromiter(chain.from_iterable(ids), np.int32)])
            self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(np.fromiter(map(len, ids), np.int64))])

    def encode(self, texts: list[str]):
        """For both sides: ids of all texts (a space before each that is not empty), and where each text's begin and end."""
        if len(self.number) > CACHED:
            self.forget()
        words, counts = [], [0]
        regular, known = REGULAR.fullmatch, self.number
        for t in texts:
            if t:
                t = " " + t
                own = t.replace(" ", MARKER + " ").replace("\n", f"{MARKER}\n{MARKER}").split(MARKER)[1:] if MARKER not in t else [""]
                if not all(w in known or regular(w) for w in own):
                    own = STRETCH.findall(t)
                words += own
            counts.append(len(words))
        self._learn(words)
        of, counts = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), np.array(counts)
        for flat, ends in zip(self.flat, self.ends):
            first, size = ends[of], ends[of + 1] - ends[of]
            stop = np.concatenate(([0], np.cumsum(size)))
            yield flat[np.repeat(first - stop[:-1], size) + np.arange(stop[-1])], stop[counts]


class Strings:
    """Byte strings by number, gathered in one go."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each of them ends)."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def shared_cuts(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
    """Which ends of a are ends of b; the bounds part both into texts of the same bytes.

    a0, a1, b0, b1 are the open intervals; the last end of each is known to be shared.
    """
    cut = np.zeros(len(a), bool)
    a0, a1, b0, b1 = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    cut[a1[a1 > a0] - 1] = True
    while True:
        open_ = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
        if not len(a0):
            return cut
        middle = (a0 + a1 - 2) // 2
        at, other = np.full(len(a0), -1), np.zeros(len(a0), np.int64)
        looking, step = np.arange(len(a0)), 0
        while len(looking):  # the middle, then its neighbours, left and right in turn
            away = (step + 1) // 2
            m = middle[looking] + (away if step % 2 else -away)
            inside = (m >= a0[looking]) & (m < a1[looking] - 1)
            some, m = looking[inside], m[inside]
            j = np.searchsorted(b, a[m])
            hit = b[j] == a[m]
            at[some[hit]], other[some[hit]] = m[hit], j[hit]
            step += 1
            more = at[looking] < 0
            more &= (middle[looking] - away >= a0[looking]) | (middle[looking] + away < a1[looking] - 1)
            looking = looking[more]
        found = at >= 0
        at, other = at[found], other[found]
        cut[at] = True
        # left and right halves, in order, so that lookups run through b from left to right
        halves = [np.stack(x, 1).ravel() for x in ((a0[found], at + 1), (at + 1, a1[found]), (b0[found], other + 1), (other + 1, b1[found]))]
        a0, a1, b0, b1 = halves


class Aligner:
    """Both tokenizers, and the alignment of some texts at a time."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.stretches = Stretches(self.a, self.b)
        self.bytes_a, self.bytes_b = Strings(self.a.surface), Strings(self.b.surface)
        self.wide = len(self.b.surface)  # a pair's number is a * wide + b
        self.pairs = len(self.a.surface) * self.wide
        self.shown = Strings([b"%d," % i for i in (*range(len(self.a.surface)), *range(self.wide))])

    def coded(self, texts: list[str]):
        """Ids, bounds and ends of both sides, and which texts both give back byte for byte; only these have ids."""
        sound = np.array([bool(t) for t in texts], bool)
        while True:
            kept = [t if s else "" for t, s in zip(texts, sound)]
            (a, a_bounds), (b, b_bounds) = self.stretches.encode(kept)
            want = [(" " + t).encode() if t else b"" for t in kept]
            edges = np.concatenate(([0], np.cumsum([len(w) for w in want])))
            want = np.frombuffer(b"".join(want), np.uint8)
            ends, bad = [], np.zeros(len(texts), bool)
            for ids, bounds, of in ((a, a_bounds, self.bytes_a), (b, b_bounds, self.bytes_b)):
                raw, stop = of.joined(ids)
                stop0 = np.concatenate(([0], stop))
                bad |= np.diff(stop0[bounds]) != np.diff(edges)
                if not bad.any() and not np.array_equal(raw, want):
                    bad[np.searchsorted(edges, np.flatnonzero(raw != want), "right") - 1] = True
                ends.append(stop)
            if not bad.any():
                return a, b, a_bounds, b_bounds, *ends, edges
            sound &= ~bad

    def align(self, texts: list[str | None]) -> dict:
        a, b, a_bounds, b_bounds, a_ends, b_ends, edges = self.coded([t or "" for t in texts])
        n = len(texts)
        cut_a = shared_cuts(a_ends, b_ends, a_bounds, b_bounds)
        cut_b = np.zeros(len(b), bool)
        cut_b[np.searchsorted(b_ends, a_ends[cut_a])] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        # a link ends where a token of either side ends
        mark = np.zeros((2, edges[-1]), bool)
        mark[0, a_ends - 1] = mark[1, b_ends - 1] = True
        spot = np.flatnonzero(mark[0] | mark[1])
        of_a, of_b = (np.cumsum(m) - m for m in (mark[0, spot], mark[1, spot]))
        doc = np.searchsorted(edges, spot, "right") - 1
        key, times = np.unique(doc * self.pairs + a[of_a].astype(np.int64) * self.wide + b[of_b], return_counts=True)
        # groups as text: a1,a2|b1;a3|b2,b3
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a] if len(a) else np.arange(0)
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b] if len(b) else np.arange(0)
        row = np.zeros(len(a) + len(b), np.int64)
        row[place_a], row[place_b] = a, b.astype(np.int64) + len(self.a.surface)
        shown, stop = self.shown.joined(row)
        shown[stop[place_a[cut_a]] - 1], shown[stop[place_b[cut_b]] - 1] = ord("|"), ord(";")
        stop = np.concatenate(([0], stop))[a_bounds + b_bounds].tolist()
        shown = memoryview(shown)
        groups = [bytes(shown[s : e - 1]) if e > s else b"" for s, e in zip(stop, stop[1:])]
        return {
            "n_a": np.diff(a_bounds),
            "n_b": np.diff(b_bounds),
            "n_groups": np.diff(np.concatenate(([0], np.cumsum(cut_a)))[a_bounds]),
            "n_links": np.bincount(doc, minlength=n),
            "n_pairs": np.bincount(key // self.pairs, minlength=n),
            "pair": key % self.pairs,
            "times": times,
            "groups": groups,
        }


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")


def _packed(ids: pa.Array, parts: list[dict], pack: int, kept: bool) -> pa.RecordBatch:
    pair, ref, docs = np.unique(np.concatenate([p["pair"] for p in parts]), return_inverse=True, return_counts=True)
    groups = [g for p in parts for g in p["groups"]]
    digests = b"".join(hashlib.sha256(g).digest() for g in groups)
    sums = shrink(*(np.concatenate([p[c] for p in parts]).astype(np.int64) for c in SUMS))
    refs = shrink(ref.astype(np.int32), np.concatenate([p["times"] for p in parts]).astype(np.int32))
    held = [pa.array([x], pa.binary()) for x in (sums, digests, refs, shrink(pair, docs.astype(np.int32)))]
    text = pa.array([[g.decode() for g in groups] if kept else None], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *held, text], names=["pack", "ids", "sums", "digests", "refs", "pairs", "groups"])


def align_documents(docs: DataFrame, a_spec: str, b_model: bytes, id_column: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256; with ``groups`` also the groups, as text."""
    if len(a_spec) + len(b_model) > 20_000_000:
        raise ValueError("the tokenizers are larger than what is sent to every executor")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = hashlib.sha256(a_spec.encode() + b_model).hexdigest()
    sent = spark.sparkContext.broadcast((a_spec, b_model))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        aligner = worker_cached(("align", key), lambda: Aligner(*sent.value))
        number = TaskContext.get().partitionId() << 33
        ids, done, size = [], [], 0
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= SLICE):
                    held += len(texts[end] or "")
                    end += 1
                ids.append(b.column(0).slice(at, end - at))
                done.append(aligner.align(texts[at:end]))
                at, size = end, size + held
                if size >= PACK:
                    yield _packed(pa.concat_arrays(ids), done, number, groups)
                    number, ids, done, size = number + 1, [], [], 0
        if done:
            yield _packed(pa.concat_arrays(ids), done, number, groups)
        aligner.stretches.forget()

    packs = saved(rows.mapInArrow(lean(pack), f"pack long, ids array<{id_type}>, sums binary, digests binary, refs binary, pairs binary, groups array<string>"), "aligned")

    def asked(batches):
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pair, n = grow(data, np.int64, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number), pa.int64()), pa.array(pair), pa.array(n.astype(np.int64))], names=["pack", "pair", "docs"])

    wide = len(Pieces(b_model).surface)
    held = packs.select("pack", "pairs").mapInArrow(lean(asked), "pack long, pair long, docs long")
    counts = saved(held.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / wide)), "counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = held.select("pack", "pair").join(known, "pair").select("pack", "pair", "n", "best")
    met = packs.select("pack", F.lit(-1).cast("long").alias("pair"), "ids", "sums", "digests", "refs", "groups").unionByName(answers, allowMissingColumns=True)
    names = ["id", *SUMS[:4], "n_best", "count_sum", "groups_sha256"] + ["groups"] * groups

    def finish(batches):
        for t in runs(batches, "pack"):
            sums = dict(zip(SUMS, grow(t.column("sums")[0].as_py(), *[np.int64] * len(SUMS))))
            ref, times = grow(t.column("refs")[0].as_py(), np.int32, np.int32)
            n, best = t.column("n").slice(1).to_numpy(), t.column("best").slice(1).to_numpy()
            edges = np.concatenate(([0], np.cumsum(sums["n_pairs"])))
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(times * x[ref])))[edges])
            digests, sound = t.column("digests")[0].as_py(), sums["n_a"] > 0
            shown = [digests[32 * i : 32 * i + 32].hex() if s else "" for i, s in enumerate(sound.tolist())]
            out = [t.column("ids").combine_chunks().slice(0, 1).flatten(), *(pa.array(sums[c]) for c in SUMS[:4]), pa.array(total(best.astype(np.int64))), pa.array(total(n.astype(np.int64))), pa.array(shown, pa.string())]
            if groups:
                out.append(t.column("groups").combine_chunks().slice(0, 1).flatten())
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id {id_type}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", groups_sha256 string" + ", groups string" * groups
    return met.repartition(parts, "pack").sortWithinPartitions("pack", "pair").mapInArrow(lean(finish), schema)
