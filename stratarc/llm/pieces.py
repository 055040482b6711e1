"""SentencePiece encoding and decoding over a merge-type prefix table.

A byte-pair model merges, again and again, the adjacent pair whose joined piece
scores best (leftmost first among equals).  No merge ever crosses a boundary of
the final segmentation, so the segmentation of a prefix that ends at such a
boundary is the head of the whole one, and a row of pieces is final exactly if
every adjacent pair of it is.  Each prefix therefore has one last piece: among
the pieces that end there (found by an automaton over the vocabulary), the one
that is compatible with the last piece of the prefix before it.  The table holds
that piece per prefix; the ids are then read backwards from the end.

Characters outside the vocabulary become byte pieces.  Texts are cut beforehand
only between two characters that no piece has side by side (before a space mark,
around line feeds, before most punctuation), which is read off the vocabulary.
Each distinct word between marks is encoded once by a worker; a batch's words are
numbered, and ids and decoded bytes are gathered by number in arrays.

Defined cases: null text encodes as empty (no ids, decoded text empty); rows
keep their other columns, whatever these are called; repeated rows are encoded
each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarc.llm.common import worker_cached

MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LEAST = float("-inf")
#: Words, and ids of words, kept by one Python worker; beyond it the store starts anew (it is only a cache).
CACHED_WORDS, CACHED_IDS = 300_000, 1 << 22


class PrefixTable:
    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models have a merge-type prefix table")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.unk_surface = spec.trainer_spec.unk_surface
        self.kind = [p.type for p in spec.pieces]
        if USER_DEFINED in self.kind or UNUSED in self.kind:
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.unk = self.kind.index(UNKNOWN)
        self.controls = {i for i, k in enumerate(self.kind) if k == CONTROL}
        self.byte_ids = [None] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(self.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode())
        self.pieces = [p.piece for p in spec.pieces]
        self.size = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # its own text merges into it; no other piece can be in a final row
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.forget()
        sizes = np.array([len(x) for x in self.surface], np.int64)
        self.surface_size, self.surface_at = sizes, np.cumsum(sizes) - sizes
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        mid_mark = any(b == MARK and a != MARK for p in self.ids for a, b in zip(p, p[1:]))
        line = any("\n" in p for p in self.ids)
        self.cut = None if mid_mark or line else self._cut()
        #: Rough words: what stands between marks and line feeds, cut finer only when met for the first time.
        self.rough = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n") if self.cut else None

    def forget(self) -> None:
        """An empty store of words: numbers by word, ids of all words one after the other."""
        self.number = _Numbers(self)
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def _cut(self) -> re.Pattern:
        """Words end before a mark, around line feeds, and between a letter or digit and a sign that follows none in any piece."""
        letter, other = r"[^\W_]", MARK + "\n"
        late = {b for piece in self.ids for a, b in zip(piece, piece[1:]) if re.match(letter, a)}
        signs = {c for piece in self.ids for c in piece if not re.match(letter, c) and c not in other} - late
        sign = "".join(map(re.escape, sorted(signs)))
        rest = f"(?:[^{other}{sign}]|(?<!{letter})[{sign}])" if signs else f"[^{other}]"
        return re.compile(f"{MARK}*[^{other}]{rest}*|{MARK}+|\n")

    def merged(self, text: str) -> list[str]:
        """The merges carried out one by one; used for single pieces and pairs, which are short."""
        parts, score = list(text), self.score
        gains = [score.get(a + b, LEAST) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > LEAST:
            k = gains.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score.get(parts[k - 1] + parts[k], LEAST)
            if k < len(gains):
                gains[k] = score.get(parts[k] + parts[k + 1], LEAST)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces stay as they are where they meet?"""
        if len(self.pairs) > 4 * CACHED_WORDS:
            self.pairs.clear()
        left_, right_ = self.pieces[left], self.pieces[right]
        got = self.pairs[left << 32 | right] = self.merged(left_ + right_) == [left_, right_]
        return got

    def prefixes(self, text: str) -> list[int]:
        """The last piece of each prefix of the text, by the prefix's length - 1; -1 for a character without a piece."""
        last, done, size, pairs = [-1] * len(text), -1, self.size, self.pairs
        for end, piece in self.automaton.iter(text):  # the longest first
            if end == done:
                continue
            start = end - size[piece]
            if start >= 0 and (left := last[start]) >= 0:
                fits = pairs.get(left << 32 | piece)
                if fits is None:
                    fits = self.compatible(left, piece)
                if not fits:
                    continue
            last[end] = piece
            done = end
        return last

    def word(self, text: str) -> list[int]:
        """The ids of a text without a place to cut."""
        last, at, back = self.prefixes(text), len(text), []
        while at:
            if (i := last[at - 1]) >= 0:
                back.append(i)
                at -= self.size[i]
                continue
            at -= 1
            if text[at] in self.ids:
                raise AssertionError(f"no last piece for a prefix of {text!r}")
            if self.byte_ids[0] is not None:
                back.extend(self.byte_ids[b] for b in reversed(text[at].encode()))
            else:
                back.append(self.unk)
        back.reverse()
        return back

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end)."""
        if len(self.number) > CACHED_WORDS or self.ends[len(self.number)] > CACHED_IDS:
            self.forget()
        words: list[str] = []
        counts = [0]
        lead = MARK if self.dummy_prefix else ""
        for t in texts:
            if t:
                t = lead + t.replace(" ", MARK)
                words += self.rough.findall(t) if self.rough else [t]
            counts.append(len(words))
        of = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, size = self.ends[of], self.ends[of + 1] - self.ends[of]
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(first - stop[:-1], size) + np.arange(stop[-1])]
        return ids, stop[np.array(counts)]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts; those whose byte pieces are no UTF-8 go piece by piece."""
        size = self.surface_size[ids]
        stop = np.concatenate(([0], np.cumsum(size)))
        raw = self.surface_bytes[np.repeat(self.surface_at[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        edge, first = stop[bounds].tolist(), bounds.tolist()
        out = []
        for k, (a, z) in enumerate(zip(edge, edge[1:])):
            strip = self.dummy_prefix and a < z and raw[a] == 32 and self.kind[ids[first[k]]] == NORMAL
            try:
                out.append(raw[a + strip : z].decode())
            except UnicodeDecodeError:
                out.append(self.decode(ids[first[k] : first[k + 1]].tolist()))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        surface, first = self.surface, next((i for i in ids if self.kind[i] != CONTROL), None)
        raw = b"".join(map(surface.__getitem__, ids))
        if self.dummy_prefix and first is not None and self.kind[first] == NORMAL and raw[:1] == b" ":
            raw = raw[1:]
        try:
            if not self.controls.isdisjoint(ids):
                raise ValueError("control pieces part runs of bytes")
            return raw.decode()
        except ValueError:
            return "".join(self._slowly(ids, first))

    def _slowly(self, ids, first: int | None):
        """Runs of byte pieces that are no UTF-8 give one replacement character for each byte."""
        run, fresh = b"", True
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                run, fresh = run + self.surface[i], False
                continue
            while run:
                for n in range(1, 5):
                    try:
                        yield run[:n].decode()
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    yield "�"
                    run = run[1:]
            if i is None or self.kind[i] == CONTROL:
                continue
            text = self.surface[i].decode()
            yield text[1:] if fresh and self.dummy_prefix and self.kind[first] == NORMAL and text[:1] == " " else text
            fresh = False


class _Numbers(dict):
    """Numbers of words; a word met for the first time is encoded."""

    def __init__(self, table: PrefixTable):
        self.table = table

    def __missing__(self, text: str) -> int:
        t, ids = self.table, []
        for word in t.cut.findall(text) if t.cut else [text]:
            ids += t.word(word)
        n = len(self)
        begin, end = int(t.ends[n]), int(t.ends[n]) + len(ids)
        if end > len(t.flat):
            t.flat = np.concatenate((t.flat, np.zeros(max(len(t.flat), end - begin), np.int32)))
        if n + 2 > len(t.ends):
            t.ends = np.concatenate((t.ends, np.zeros(len(t.ends), np.int64)))
        t.flat[begin:end], t.ends[n + 1] = ids, end
        self[text] = n
        return n


def sentencepiece_round_trip(docs: DataFrame, model: bytes, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text", keep_text: bool = True) -> DataFrame:
    """Adds the ids of each whole text and the text decoded from them; see the module for the defined cases.

    ``model`` is the content of a model file (bounded, far below 10 MB).  Added columns that clash with one of the
    input take its place.
    """
    if len(model) > 10_000_000:
        raise ValueError("the model is larger than what is sent to every executor")
    kept = [f for f in docs.schema.fields if f.name.lower() not in (ids.lower(), decoded.lower()) and (keep_text or f.name != text)]
    model_key = hashlib.sha256(model).hexdigest()
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])
    names = [f.name for f in kept]

    def run(batches):
        coder = worker_cached(("pieces", model_key), lambda: PrefixTable(model_of.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                flat, bounds = coder.encode_all(batch.column(batch.schema.get_field_index(text)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(n)) for n in names), lists, pa.array(coder.decode_all(flat, bounds), pa.string())],
                    names=[*names, ids, decoded],
                )
        coder.forget()  # the worker may go on with other work

    return docs.select(*(F.col(f"`{n}`") for n in dict.fromkeys([*names, text]))).mapInArrow(run, schema)
