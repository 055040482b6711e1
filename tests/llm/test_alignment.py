"""Alignment against the two libraries and a plain merge of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens(coders, text):
    """Ids and bytes of both sides, or none."""
    a, b = coders
    if not text:
        return [], []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text, num_threads=1):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == b"".join(x for _, x in right) == want else ([], [])


def brute(coders, rows):
    made, held = [], Counter()
    for doc, text in rows:
        left, right = tokens(coders, text)
        groups, links, open_, i, j, ends = [], [], ([], []), 0, 0, [0, 0]
        while i < len(left) or j < len(right):
            side = 0 if ends[0] <= ends[1] else 1
            i, j = i + (side == 0), j + (side == 1)
            t = (left[i - 1], right[j - 1])[side]
            ends[side] += len(t[1])
            open_[side].append(t[0])
            if ends[0] == ends[1]:
                groups.append(open_)
                open_ = ([], [])
        spans = []
        for side in (left, right):
            at, out = 0, []
            for t, x in side:
                out.append((at, at + len(x), t))
                at += len(x)
            spans.append(out)
        k = 0
        for s, e, t in spans[0]:
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((t, spans[1][k][2]))
                k += 1
        held.update(set(links))
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        made.append((doc, len(left), len(right), len(groups), links, shown))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(
        ((d, a, b, g, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(s.encode()).hexdigest() if a else "") for d, a, b, g, ls, s in made), key=str
    )


def asked(spark, rows, tmp_path):
    from stratarc.llm.queries import op12_alignment

    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return op12_alignment(spark, str(tmp_path))


def test_given_documents(spark, sf_dir, coders):
    from stratarc.llm.queries import op12_alignment

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op12_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(coders, rows)


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (None, "no id"), (5, "same row"), (5, "same row"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"), (7, "a ▁ mark"),
    (8, "x" * 30_000), (9, " two  spaces   three\t\ttabs \n\n lines \r\n end "), (10, "non break em　wide\u0085next\x1c\x1f"), (11, "it's we'll 'tis 123 1234567 +-*/ é ü ß 日本語 \U0001f642\U0001f642"),
    (12, "\x00\x01 zero"), (13, "word\nword \nword\n word\n\nword"), (14, "tail "), (15, "é combining ‍\U0001f468‍\U0001f469"), (16, "﻿mark"), (17, "long words " * 4000),
]


def test_edges(spark, tmp_path, coders):
    """Nulls, empty and very long texts, special strings, a sign that B takes for a space, repeated rows and ids."""
    assert sorted(map(tuple, asked(spark, EDGES, tmp_path).collect()), key=str) == brute(coders, EDGES)


def test_random_signs(spark, tmp_path, coders):
    r = random.Random(5)
    signs = "aab's \n\t.,-_12é  ñ日ß" + "  "
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randrange(60)))) for i in range(300)]
    assert sorted(map(tuple, asked(spark, rows, tmp_path).collect()), key=str) == brute(coders, rows)


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path).count() == 0


def test_packs_and_slices(coders, monkeypatch):
    """Sums over packs do not depend on how texts are cut into slices."""
    import public_tokenizers as P

    from stratarc.llm.alignment import Aligner

    made = Aligner(open(P.path("byte_bpe_50k.json")).read(), open(P.path("piece_bpe_32k.model"), "rb").read())
    texts = [t for _, t in EDGES]
    whole, single = made.align(texts), [made.align([t]) for t in texts]
    for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs", "pair", "times"):
        assert np.array_equal(whole[c], np.concatenate([s[c] for s in single]))
    assert whole["groups"] == [g for s in single for g in s["groups"]]
    assert (whole["n_links"] == whole["n_a"] + whole["n_b"] - whole["n_groups"]).all()


def test_cuts_against_intersection():
    from stratarc.llm.alignment import shared_cuts

    r = random.Random(9)
    for _ in range(200):
        a, b, ab, bb, at = [], [], [0], [0], 0
        for _ in range(r.randrange(1, 5)):
            n = r.randrange(1, 60)
            for ends, bounds, p in ((a, ab, r.random()), (b, bb, r.random())):
                ends += [at + i for i in range(1, n) if r.random() < p] + [at + n]
                bounds.append(len(ends))
            at += n
        a, b = np.array(a), np.array(b)
        assert np.array_equal(shared_cuts(a, b, np.array(ab), np.array(bb)), np.isin(a, b))


def test_groups_and_clashing_columns(spark, coders):
    import public_tokenizers as P

    from stratarc.llm.alignment import align_documents

    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id bigint, text string")
    for c in ("id", "pack", "pair", "groups", "n_a", "ids", "refs"):
        docs = docs.withColumn(c, F.lit("x"))
    got = align_documents(docs, open(P.path("byte_bpe_50k.json")).read(), open(P.path("piece_bpe_32k.model"), "rb").read(), groups=True)
    rows = {r.id: r for r in got.collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256 and rows[1].groups.count(";") == rows[1].n_groups - 1
    assert rows[2].groups == "" == rows[2].groups_sha256
