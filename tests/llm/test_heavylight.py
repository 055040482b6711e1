"""The size-aware Jaccard join against all pairs of plain sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SPACE = "[^\x20\x09-\x0d]+"
DOCS = "doc_id bigint, text string"


def shingle_set(t):
    w = re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    named = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            named[root(i)] = min(d, named.get(root(i), d))
    return sorted(((d, len(s), named.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(seed, sizes, families=60, edits=30):
    """Families of edited texts on both sides of 0.8, in chains, with a line that many share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    line = [word() for _ in range(20)]
    out = []
    for k in range(families):
        text = [word() for _ in range(r.choice(sizes))] + (line if k % 4 == 0 else [])
        out.append(" ".join(text))
        for _ in range(r.randrange(8)):
            text = list(text)
            for _ in range(r.randrange(2 + len(text) // edits)):
                at, how = r.randrange(len(text) + 1), r.random()
                text[at : at + (how < 0.7)] = [] if how > 0.9 else [word()]
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


def asked(spark, rows):
    from stratarc.llm.heavylight import jaccard_classes

    return sorted(map(tuple, jaccard_classes(spark.createDataFrame(rows, DOCS).repartition(5)).collect()), key=str)


@pytest.mark.parametrize("x", [None, 0, 9, 16])
def test_any_boundary_gives_the_same(spark, monkeypatch, x):
    """Small and large sets, by subsets, by lists, and across the boundary wherever it lies."""
    from stratarc.llm import heavylight as H

    monkeypatch.setattr(H, "SAMPLED", 2)
    if x is not None:
        monkeypatch.setattr(H, "_boundary", lambda nodes: x)
    rows = texts(1, [3, 5, 7, 9, 11, 12, 13, 14, 15, 16, 18, 20, 22, 24]) + [(10_000 + i, t) for i, t in texts(2, [60, 200, 400], families=15, edits=40)]
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 60
    assert asked(spark, rows) == want


def test_given_documents(spark, sf_dir):
    from stratarc.llm.queries import op11_jaccard_join

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_jaccard_join(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark):
    """Nulls, empty and wordless texts, null and equal ids, repeated rows, one very long text, case and white space."""
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, ""), (4, "One two"), (5, "one\ttwo"), (6, "one two three"), (None, a), (7, a.upper()), (7, a + " more"), (7, a), (8, "é É"), (9, "É é")]
    rows += [(10, "x " * 100_000), (11, " ".join(f"v{i}" for i in range(50_000))), (None, "alone without an id")]
    assert asked(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    from stratarc.llm.heavylight import jaccard_classes

    assert asked(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g")], DOCS)
    for c in ("node", "id", "n", "root", "token", "component_id"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, jaccard_classes(docs).collect())) == [(1, 3, 1), (2, 3, 1)]


def test_edited_copies_meet_their_source(spark, monkeypatch):
    """1,500 texts with edits of their own: similar to the source, hardly to each other; pairs in proportion, not squared."""
    from stratarc.llm import heavylight as H

    monkeypatch.setattr(H, "SAMPLED", 2)
    r = random.Random(4)
    base = [f"h{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1500):
        t = list(base)
        for j in range(5):
            t[r.randrange(60 * j, 60 * j + 60)] = f"e{k}_{j}"
        rows.append((k + 1, " ".join(t)))
    made = []
    real = H._verified
    monkeypatch.setattr(H, "_verified", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    got = asked(spark, rows)
    assert {c for _, _, c in got} == {0}
    assert sum(made) < 8 * len(rows)


def test_prefix_holds_first_common_value():
    """Whatever two sets link, their first common value in the order is in both prefixes, within far of each."""
    from stratarc.llm.heavylight import need, prefix_size

    r = random.Random(6)
    seen = 0
    for _ in range(20_000):
        m, n = r.randrange(1, 60), r.randrange(1, 60)
        both = min(m, n) - r.randrange(3)
        if both < need(m, n):
            continue
        order = list(range(200))
        r.shuffle(order)
        common, a, b = order[:both], order[both : m], order[m : m + n - both]
        x, y = sorted(common + a), sorted(common + b)
        first = min(common)
        i, j = x.index(first), y.index(first)
        assert i < prefix_size(m) and j < prefix_size(n)
        assert n <= (5 * m - 9 * i) // 4 and m <= (5 * n - 9 * j) // 4
        seen += 1
    assert seen > 500


def test_boundary_follows_cost():
    from stratarc.llm.heavylight import boundary, subsets_of

    assert boundary({8: 1000}, {}) == 0  # no lists to scan: subsets would cost more than postings
    assert boundary({8: 1000}, {(8, 8): 10**6}) >= 8
    assert subsets_of(10, 16) == 45 + 10 + 10 + 1 + 1


def test_values_of_shingles():
    from stratarc.llm.heavylight import shingles

    t = "The quick brown fox jumps over the lazy dog the QUICK brown fox jumps"
    assert len(shingles(t)) == len(shingle_set(t)) == 9
    assert np.array_equal(shingles("a b c d e f"), np.unique(np.concatenate([shingles("a b c d e"), shingles("b c d e f")])))
    assert len(np.intersect1d(shingles("a b c d e"), shingles("b a c d e"))) == 0
