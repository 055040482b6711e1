"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random
import re

import pytest

SPACE = "[^\x20\x09-\x0d]+"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(t):
    w = re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Row numbers of the smallest (id, row) of each component of similarities of 0.8 or more; wordless rows all stay."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                up[root(i)], links = root(j), links + 1
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0, i)
        best[root(i)] = min(key, best.get(root(i), key))
    return sorted(k[2] for k in best.values()), links


def mixed(seed=3):
    """Texts with edited copies on both sides of 0.8, chains of edits, exact copies, and a line common to many texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    line = [word() for _ in range(20)]
    out = []
    for k in range(60):
        text = [word() for _ in range(r.choice([3, 6, 12, 60, 300]))] + (line if k % 3 else [])
        out.append(" ".join(text))
        for _ in range(r.randrange(6)):
            text = list(text)
            for _ in range(r.randrange(1 + len(text) // 30)):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("last", [0, 100_000])
def test_stage_matches_brute_force(spark, monkeypatch, last):
    import corpus_pipeline as P
    from stratarc.llm import jaccard

    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    monkeypatch.setattr(jaccard, "LAST", last)
    texts = mixed()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(5, "doc_id")
    kept, links = brute_kept(list(enumerate(texts)))
    assert links > 50 and len(kept) < len(texts) - 30
    assert sorted(r.doc_id for r in P.near_duplicate(spark, docs, "").collect()) == kept


def test_stage_on_given_documents(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    kept, _ = brute_kept(rows)
    got = P.near_duplicate(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [rows[i][0] for i in kept]


def test_hot_group_makes_no_pairs_inside(spark):
    """2,000 near copies of one text: pairs in proportion, not squared."""
    from stratarc.llm import jaccard

    base = [f"h{i}" for i in range(100)]
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(2000)]
    made = []
    real = jaccard._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return real(pairs, *rest)

    jaccard._verified = counted
    try:
        left = jaccard.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
        assert [r.doc_id for r in left.collect()] == [0]
    finally:
        jaccard._verified = real
    assert sum(made) < 4 * len(texts)


def test_rows_without_links_stay(spark):
    """Null and repeated ids name no document; empty texts are no copies of each other."""
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, "another text under the same id"), (6, c + " more"), (1, None), (2, ""), (3, ""), (None, " \t"), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicate(spark, docs, "").collect()), key=str)
    kept, _ = brute_kept(rows)
    assert got == sorted((rows[i] for i in kept), key=str)
    assert got == sorted([(7, a), (None, b), (5, c), (5, "another text under the same id"), (1, None), (2, ""), (3, ""), (None, " \t")], key=str)


def test_far_copies_are_not_paired(spark, monkeypatch):
    """300 copies with edits that are too many to link with one another: no pair of groups for each pair of copies."""
    from stratarc.llm import jaccard

    r = random.Random(5)
    base = [f"h{i}" for i in range(150)]
    texts = []
    for i in range(300):
        text = list(base)
        for j, at in enumerate(r.sample(range(150), 5)):
            text[at] = f"e{i}x{j}"
        texts.append(" ".join(text))
    kept, links = brute_kept(list(enumerate(texts)))
    made = []
    real = jaccard._meeting
    monkeypatch.setattr(jaccard, "_meeting", lambda named: made.append(real(named).count()) or real(named))
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    left = jaccard.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in left.collect()) == kept
    assert len(made) == 1 and made[0] < 10 * len(texts)


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Texts joined by BK-trees are compared, whole sets decide: a near copy links, unlike texts with close fingerprints do not."""
    from stratarc.llm import jaccard

    asked = []
    real = jaccard._alike
    monkeypatch.setattr(jaccard, "_alike", lambda nodes: asked.append(real(nodes).collect()) or real(nodes))
    base = [f"b{i}" for i in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"c{i}" for i in range(50))]
    left = jaccard.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r.doc_id for r in left.orderBy("doc_id").collect()] == [0, 2]
    assert [len(x) for x in asked] == [1]
