"""The Merkle manifest against a plain recursive one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def lower(t):
    return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """The root and, per node, the siblings of each level and a function from another node to another root."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 8][: i % 8], runs[i // 8][i % 8 + 1 :]))
            at[k] = i // 8
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(leaf(r))))
        subs[g] = tree([leaf(r) for r in groups[g]])
    root, over = tree([subs[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for r, path in zip(groups[g], subs[g][1]):
            path = path + over[k]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            x = leaf({**r, "text": lower(r["text"])} if hit else r)
            for left, right in path:
                x = H(*left, x, *right)
            out.append((r["doc_id"], leaf(r), subs[g][0], root, H(*(s for left, right in path for s in left + right)), x, x == root))
    return sorted(out, key=str)


def asked(spark, rows, tmp_path, schema=DOCS):
    from stratarc.llm.queries import op13_merkle

    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return op13_merkle(spark, str(tmp_path))


def dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


@pytest.mark.parametrize("n", [1, 8, 9, 1300])
def test_against_plain_tree(spark, tmp_path, n):
    """Groups of one row, of full and broken runs, of more than one block and pass; more groups than one run holds."""
    r = random.Random(n)
    rows = [(i * 7 % 1301, f"Text {i} É" + "Ab " * r.randrange(4), r.choice(["en", "en", "en", "de", "", None]), f"s{i % 3}", i) for i in range(n)]
    rows += [(5000 + i, f"T{i}", f"l{i}", None, None) for i in range(70 if n == 1300 else 0)]
    got = asked(spark, rows, tmp_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(dicts(rows))


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and very long texts, equal ids with other texts, repeated rows."""
    rows = [(None, None, None, None, None), (None, "x", None, None, None), (3, "", "en", "", 0), (3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (4, "LONG " * 100_000, "fr", "s", 5)]
    rows += [(5, "-", "-", "-", None), (6, "TIE", "é", "s", 3), (7, "\U0001f642 \x00", "￿", "s", -3)]
    assert sorted(map(tuple, asked(spark, rows, tmp_path).collect()), key=str) == brute(dicts(rows))


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path).count() == 0


def test_other_columns_and_proofs(spark, tmp_path):
    """Columns named like the operator's own change nothing; proofs fold to the root, and only with the right leaf."""
    from stratarc.llm.manifest import Parent, fold, manifest

    rows = [(i, f"t{i}", "en" if i % 4 else "de", "s", i) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs
    for c in ("tree", "pos", "n", "node", "asked", "path", "block", "leaf", "root", "id", "part", "at"):
        wide = wide.withColumn(c, F.lit("x"))
    plain = sorted(map(tuple, manifest(docs, FIELDS).collect()))
    assert sorted(map(tuple, manifest(wide, FIELDS).collect())) == plain
    for row in manifest(docs, FIELDS, proofs=True).where("id % 50 = 0").collect():
        path = [(p.slot, Parent([bytes(k) for k in p.nodes])) for p in row.proof]
        assert fold(bytes(row.leaf), path) == bytes(row.root)
        assert fold(bytes(32), path) != bytes(row.root)


def test_midstate_is_resumed():
    """A folded parent hashes the replacement and what stands on its right only."""
    from stratarc.llm.manifest import Parent

    kids = [hashlib.sha256(bytes([i])).digest() for i in range(8)]
    p = Parent(kids)
    for slot in range(8):
        other = kids[:slot] + [bytes(32)] + kids[slot + 1 :]
        assert p.folded(slot, bytes(32)).hex() == H(*(k.hex() for k in other))
        p.kids[:slot] = [b"?"] * slot  # the left ones are in the state
