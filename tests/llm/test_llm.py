"""The training-data operators: brute force, round trips, held-out accuracy, and the stated edge cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratarc.llm import queries as Q

SPACE = "[^\x20\x09-\x0d]+"
EDGES = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (3, "word", "en", "s", 4),
    (None, "a text without an id that is long enough to be looked at in every way that there is", "en", None, 1),
    (5, "same same same same same same same same same same same same same same same same", "de", "s", 9),
    (5, "same same same same same same same same same same same same same same same same", "de", "s", 9),
    (7, "x" * 200_000, "en", "s", 200_000),
    (8, " \t\n ", "en", "s", 4),
    (9, "é ü🙂 ▁ <tag> ### </turn> \\ \x00 end", "fr", "s", 10),
    (10, "\n".join(f"line {i % 3} of the text" for i in range(500)), "en", "s", 1),
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGES, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# --- passages


def brute_spans(rows):
    """Maximal runs of bytes that go, by id."""
    return {i: re.findall(b"\x01+", gone.tobytes()) for i, _, gone in brute_marks(rows)}


def brute_cuts(rows, width=50):
    return sorted(((i, np.frombuffer(b, np.uint8)[~gone].tobytes()) for i, b, gone in brute_marks(rows, width)), key=str)


def brute_marks(rows, width=50):
    order = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, math.inf), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < order(i):
                gone[k : k + width] = True
        out.append((i, b, gone))
    return out


def test_passages_match_brute_force(spark, docs):
    from stratarc.llm.passages import dedup_passages

    part = docs.where("doc_id % 2 = 0").select("doc_id", "text")
    got = sorted(((r.doc_id, bytes(r.kept_bytes)) for r in dedup_passages(part).collect()), key=str)
    assert got == brute_cuts([(r.doc_id, r.text) for r in part.collect()])


def test_passages_edges(edge, none):
    from stratarc.llm import passages

    clash = edge.withColumn("removed_spans", F.lit(1)).withColumn("pack", F.lit(2))
    rows = passages.dedup_passages(clash).collect()
    assert sorted(((r.doc_id, bytes(r.kept_bytes)) for r in rows), key=str) == brute_cuts([(r[0], r[1]) for r in EDGES])
    assert all(r.pack == 2 for r in rows)
    assert passages.dedup_passages(none).count() == 0


def test_very_frequent_passages_go_string_by_string(spark, monkeypatch):
    from stratarc.llm import passages

    rng = random.Random(5)
    line = "This line stands on each and every page of the whole collection, always."
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(300)) + line + "".join(rng.choice("abcdefgh ") for _ in range(100))) for i in range(60)]
    monkeypatch.setattr(passages, "PACK_BYTES", 2000)
    monkeypatch.setattr(passages, "HOT_RUNS", 3)
    monkeypatch.setattr(passages, "BLOCK_BYTES", 500)
    got = passages.dedup_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, bytes(r.kept_bytes)) for r in got), key=str) == brute_cuts(rows)


def test_merged_transforms():
    from stratarc.llm.bwt import least_in_intervals

    rng = random.Random(3)
    for _ in range(200):
        depth = rng.choice([1, 2, 3, 5])
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 14))]
        owner = np.array([rng.randint(0, 9) for _ in strings])
        least = {}
        for s, o in zip(strings, owner):
            for i in range(len(s) - depth + 1):
                least[s[i : i + depth]] = min(least.get(s[i : i + depth], 99), o)
        shard = np.sort([rng.randint(0, 3) for _ in strings])
        flat = least_in_intervals(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), np.unique(shard, return_inverse=True)[1], owner, depth)
        begin = np.cumsum([0, *(max(0, len(s) - depth + 1) for s in strings)])
        got = [list(flat[a:z]) for a, z in zip(begin, begin[1:])]
        assert got == [[least[s[i : i + depth]] for i in range(len(s) - depth + 1)] for s in strings]


# --- SimHash


def brute_print(t, n=4):
    words = re.findall(SPACE, ascii_lower(t))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    up = {p: p for p in prints.values()}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    values = list(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for d, p in prints.items():
        least[root(p)] = min(d, least.get(root(p), d))
    return {d: least[root(p)] for d, p in prints.items()}


def test_simhash_matches_brute_force(spark, sf_dir, docs):
    got = {r.doc_id: r for r in Q.op2_simhash(spark, sf_dir).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == brute_classes(prints)


def test_simhash_edges(edge, none):
    from stratarc.llm.simhash import near_duplicates

    got = sorted(((r.doc_id, r.fp, r.component_id) for r in near_duplicates(edge).collect()), key=str)
    assert len(got) == len(EDGES)
    assert {(d, c) for d, fp, c in got if fp == 0} == {(1, 1), (2, 1), (8, 1)}
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("shard", [4, 1024])
def test_links_of_large_buckets(spark, shard):
    from stratarc.llm.simhash import components, linked

    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    stars = components(linked(spark.createDataFrame([(p,) for p in signed], "fp bigint"), shard=shard)).collect()
    root = {p: p for p in signed} | {r.a: r.b for r in stars}
    expected = brute_classes({p: p & (1 << 64) - 1 for p in signed})
    assert len(set(root.values())) == len(set(expected.values()))
    assert all((root[a] == root[b]) == (expected[a] == expected[b]) for a in signed[:40] for b in signed)


def test_tree_finds_all_within_the_radius():
    from stratarc.llm.simhash import BKTree

    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for _ in range(50):
        q = rng.getrandbits(12)
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


# --- rules


def test_rules(edge, none):
    from stratarc.llm import rules

    ledger = rules.rule_ledger(edge.withColumn("n_words", F.lit("mine")))
    got = {(r.doc_id, r.n_words): r for r in ledger.collect()}
    assert got[2, 0].fail_bits & 1 and got[1, 0].n_lines == 0
    assert got[5, 16].n_repeat_words == 16 and got[5, 16].n_stutter == 15
    assert got[10, 2500].n_dup_lines == 497
    assert rules.rule_ledger(none).count() == 0 and rules.ablations(rules.rule_ledger(none)).count() == 0
    table = {(r.policy, r.rule): r for r in rules.ablations(ledger).collect()}
    rows = ledger.collect()
    for (policy, rule), r in table.items():
        bit, mask = 1 << list(rules.RULES).index(rule), rules.mask(policy)
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only == sum(x.fail_bits & mask == bit for x in rows)
        assert r.n_kept == sum(not x.fail_bits & mask for x in rows)
    assert rules.apply_policy(ledger, "base").where("kept").count() == table["base", "few_words"].n_kept


# --- language model


def test_base_scores_and_gain(spark, docs, edge, none):
    from stratarc.llm.brown import score_documents

    both = docs.select("doc_id", "text").unionByName(edge.withColumn("pack", F.lit("x")).select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    rows = both.collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [(r.doc_id, [*re.findall(SPACE, ascii_lower(r.text)), None]) for r in rows]
    counts = Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    base = sorted(((str(i), len(ts), sum(counts[t] > 0 for t in ts), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for i, ts in tokens), key=lambda x: x[:2])
    got = score_documents(both).collect()
    mine = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in got), key=lambda x: x[:2])
    assert [x[:3] for x in mine] == [x[:3] for x in base] and np.allclose([x[3] for x in mine], [x[3] for x in base])
    assert all(r.held_out == held(r.doc_id) and r.train_tokens == n for r in got)
    out = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert score_documents(none).count() == 0


def test_exchange_never_lowers_the_likelihood():
    from stratarc.llm.brown import exchange

    rng = np.random.default_rng(1)
    true = rng.integers(0, 3, 24)
    bigrams = np.zeros((26, 26))
    for a in range(24):
        for b in range(24):
            bigrams[a, b] = rng.poisson(9 if (true[a] + 1) % 3 == true[b] else 0.3)
    of = exchange(bigrams, 24, 3)
    assert len({(t, c) for t, c in zip(true, of)}) == 3 and set(of[24:]) == {3, 4}


def test_classes_of_the_vocabulary_by_brute_force():
    from stratarc.llm.brown import best_classes

    rng = np.random.default_rng(2)
    classes, total, words = 4, 7, 9
    of = np.array([0, 1, 2, 3, 4, 5, 0, 1, 2])  # two words still have classes by shape
    met = rng.poisson(1.2, (words, 2, total)) * (rng.random((words, 2, total)) < 0.6)
    rest = rng.poisson(6, (total, total)).astype(float)  # all that other words add
    grown = lambda x: float(np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum())
    like = lambda m: grown(m) - grown(m.sum(0)) - grown(m.sum(1))

    def placed(m, w, k, sign=1):
        m = m.copy()
        m[k] += sign * met[w, 0]
        m[:, k] += sign * met[w, 1]
        return m

    between = rest
    for w in range(words):
        between = placed(between, w, of[w])
    at = np.argwhere(met.transpose(0, 1, 2).reshape(words, -1))
    new = best_classes(at[:, 0], at[:, 1], met.reshape(words, -1)[tuple(at.T)], of, between, classes)
    for w in range(words):
        without = placed(between, w, of[w], -1) if of[w] < classes else between
        # the word's own row and column are weighed one by one: sums over its contexts as they stand
        score = [grown(without[k] + met[w, 0]) - grown(without[k]) + grown(without[:, k] + met[w, 1]) - grown(without[:, k]) for k in range(classes)]
        score = [x - sum(grown(s[k] + n) - grown(s[k]) for s, n in ((without.sum(1), met[w, 0].sum()), (without.sum(0), met[w, 1].sum()))) for k, x in enumerate(score)]
        if of[w] >= classes:
            assert new[w] == int(np.argmax(score))
    assert (new < classes).all()


def test_class_scores_by_brute_force(spark):
    from stratarc.llm import brown

    rng = random.Random(8)
    words = ["aa", "bb.", "c,", "dd", "ee", "f#", "gggg", "hh"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(200 + i, f"aa new{i}, dd") for i in range(12)]
    rows += [(3, rows[3][1]), (None, "aa aa")]
    got = brown.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    seqs = [(i, [w.encode() for w in t.split()]) for i, t in rows]
    count = Counter(w for i, ws in seqs if brown.training(i) for w in ws)
    core = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
    symbol = lambda w: core[w] if w in core else len(core) + brown.shape_of(w)
    end = len(core) + brown.SHAPES
    bigrams = np.zeros((end + 1, end + 1))
    for i, ws in seqs:
        if brown.training(i):
            row = [end, *map(symbol, ws), end]
            for a, b in zip(row, row[1:]):
                bigrams[a, b] += 1
    classes = min(brown.CLASSES, len(core))
    of = brown.exchange(bigrams, len(core), classes)
    total = classes + brown.SHAPES + 1
    between = np.zeros((total, total))
    for a, b in np.argwhere(bigrams):
        between[of[a], of[b]] += bigrams[a, b]
    mass = between.sum(0)
    room = Counter()
    for w, n in count.items():
        if n < brown.LEAST:
            room[brown.shape_of(w)] += n + 1

    def score(ws):
        out, before = 0.0, of[end]
        for w in [*ws, None]:
            c = of[end] if w is None else of[symbol(w)]
            share = (mass[c] + 1) / (mass.sum() + total)
            out += math.log10((between[before, c] + brown.BACKOFF * share) / (between[before].sum() + brown.BACKOFF))
            if w is not None:
                out += math.log10(count[w] / mass[c]) if w in core else math.log10(1 / (1 + room[brown.shape_of(w)]))
            before = c
        return out

    want = sorted((str(i), score(ws)) for i, ws in seqs)
    mine = sorted((str(r.doc_id), r.score) for r in got)
    assert [x[0] for x in mine] == [x[0] for x in want] and np.allclose([x[1] for x in mine], [x[1] for x in want])


# --- toxicity


def test_toxicity_learns_and_scores_everything(spark, edge, none):
    from stratarc.llm.toxicity import fit, score_documents

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "re", "st", "in"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(3, 80))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grolk", "grolkish", "vexund", "vexunda,"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(bad)))
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    odd = spark.createDataFrame([(None, None), (3, None), (-5, 1)], "doc_id bigint, toxic int")
    model = fit(data.select("doc_id", "text", "lang"), data.select("doc_id", "toxic").unionByName(odd))
    got = {r.doc_id: r for r in score_documents(data, model).collect()}
    held = [r for r in got.values() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.95
    scored = score_documents(edge.withColumn("score", F.lit("mine")), model).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    assert score_documents(none, model).count() == 0
    empty = fit(none, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in score_documents(edge, empty).collect()} == {0.25}


# --- chats


def test_trees_with_branches(spark):
    from stratarc.llm.chats import format_trees, loss_text, turns_of

    rows = [
        ("t", "a", None, "user", "hi", 1.0), ("t", "b", "a", "assistant", "yes ### x", 5.0), ("t", "c", "a", "assistant", "no", 1.0), ("t", "d", "b", "user", "</turn> \\e", None),
        ("u", "e", "gone", "system", None, 0.0), ("v", "x", "y", "user", "cycle", 0.0), ("v", "y", "x", "user", "cycle", 0.0), ("t", "f", "d", "assistant", "", 3.0),
    ]
    made = format_trees(spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double"), score="score", best=1)
    got = {r.tree: r for r in made.withColumn("turns", turns_of(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(got) == {"t", "u"}
    assert [(t.role, t.text) for t in got["t"].turns] == [("user", "hi"), ("assistant", "yes ### x"), ("user", "</turn> \\e"), ("assistant", "")]
    assert got["t"].loss == "yes ### x" and [(t.role, t.text) for t in got["u"].turns] == [("system", "")]


def test_long_chain_and_no_rows(spark):
    from stratarc.llm.chats import format_trees, linear_tree

    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [(None, 1, None, None), (None, 1, None, None), (2, None, "a:b", "x")]
    chats = linear_tree(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.tree: r.formatted for r in format_trees(chats).collect()}
    assert got[1] == "".join(f"### {r}: {t} </turn>\n" for _, _, r, t in rows[:300]) and len(got) == 3
    assert format_trees(chats.where("false")).count() == 0


# --- shards


def test_shards_are_even_whole_and_gapless(spark, sf_dir, docs):
    rows = Q.op7_histogram_sort(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    total = sum(r.size for r in rows)
    for s in range(8):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 8) <= 2 * max(r.size for r in rows)


def test_hot_group_is_split(spark, none):
    from stratarc.llm.shards import histogram_shards

    rows = [(i, "copy" if i % 3 else f"text {i}") for i in range(3000)] + [(None, None), (1, "copy"), (1, "copy")]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) < 50
    assert histogram_shards(none).count() == 0
    one = histogram_shards(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")).collect()
    assert [r.slot for r in one] == [0]


# --- pages


def test_pages(spark):
    from stratarc.llm.wrappers import by_tags, extract_pages, parse

    assert by_tags(parse("<body><header>h</header><p>a <b>b</b>c&amp;d<p>e<script>x</script><ul><li>1<li>2</ul><!-- no --><div class='comments'>c</div>f &lt; g")) == "a bc&d e 1 2 f < g"
    page = lambda i, body: (i, f"http://h.com/{i}", f"<html><body><nav>menu</nav><div class='top'><p>Welcome to our site</p></div><div class='text'><p>{body}</p></div><footer>f</footer></body></html>")
    rows = [page(i, f"story {i}") for i in range(8)] + [(8, "http://h.com/8", None), (9, None, ""), (10, "http://o.com/", "<p>alone"), (None, "http://o.com/", "<p>alone"), (11, "http://h.com/x", "<article><h1>T</h1><div hidden>no</div>" + "<p>w</p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("main_text", F.lit(1)).withColumn("__x", F.lit(2))
    got = {r.page_id: r.main_text for r in extract_pages(df).collect()}
    assert [got[i] for i in range(8)] == [f"story {i}" for i in range(8)]  # the greeting is the host's template
    assert got[8] == "" and got[9] == "" and got[10] == got[None] == "alone" and got[11] == "T" + " w" * 3000
    assert extract_pages(df.where("false")).count() == 0


def test_wrapper_finds_the_content_without_tags_or_classes(spark, sf_dir):
    from stratarc.llm.wrappers import by_tags, extract_pages, parse

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer)", "<$1div"), ' class="ad"', "")
    by_hand = {r.page_id: by_tags(parse(r.html)) for r in pages.collect()}  # these pages have an article each
    assert {r.page_id: r.main_text for r in extract_pages(pages).collect()} == by_hand
    plain = pages.withColumn("html", bare)
    hosts = Counter(re.match("https?://([^/]+)", r.url)[1].lower() for r in pages.collect())
    many = [r for r in extract_pages(plain, keep_html=True).collect() if hosts[re.match("https?://([^/]+)", r.url)[1].lower()] > 2]
    assert len(many) > 10 and all(r.main_text == by_hand[r.page_id] for r in many)
    assert all(r.main_text != by_tags(parse(r.html)) for r in many)  # the wrapper changed each of them


def test_two_layouts_of_one_host(spark):
    from stratarc.llm.wrappers import extract_pages

    story = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    a = lambda i: f"<div class='x'><p>All our stories</p></div><div class='t'><h2>{i}</h2><p>{story(i)}</p></div>"
    b = lambda i: f"<table><tr><td>Menu {i % 2}</td></tr></table><section><div><p>{story(i)}</p><p>Send this to a friend</p></div></section>"
    rows = [(i, "http://h.com/", f"<html><body>{(a if i % 2 else b)(i)}</body></html>") for i in range(12)]
    got = {r.page_id: r.main_text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"{i} {story(i)}" if i % 2 else story(i) for i in range(12)}


def test_deep_and_wide_pages(spark):
    from stratarc.llm.wrappers import extract_pages

    odd = ["<b>" * 3000 + "deep<div>block</div>", "<div>" * 20_000 + "<p>low", "<p>x</p><ul><li>q</ul>" * 800, "</i>" * 20_000 + "<li>" * 5000 + "end"]
    rows = [(k * 10 + i, f"http://h{k}.com/", f"{t} {i}") for k, t in enumerate(odd) for i in range(3)]
    got = {r.page_id: r.main_text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got.values())


def test_pages_joined_when_too_large_to_send(spark, sf_dir, monkeypatch):
    from stratarc.llm import wrappers

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sent = {r.page_id: r.main_text for r in wrappers.extract_pages(pages).collect()}
    monkeypatch.setattr(wrappers, "SENT_BYTES", 0)
    assert {r.page_id: r.main_text for r in wrappers.extract_pages(pages).collect()} == sent


# --- leaks


def test_leaks_match_brute_force(spark, sf_dir, docs, edge, none, monkeypatch):
    from stratarc.llm import leaks

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "one two"), (902, "one two"), (None, "three")], "item_id bigint, text string")
    bench = items.unionByName(odd)
    more = spark.createDataFrame([(5_000_000 + i, t) for i, t in enumerate(["", None, "so one two it is", "x " * 50_000])], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    expected = set()
    tests = [(r.item_id, r.text) for r in bench.collect() if (r.text or "").split()]
    for r in both.collect():
        words = leaks.words_of(r.text)
        have, bag = leaks.shingles(words), set(words)
        for i, t in tests:
            own, (q, a) = leaks.words_of(t), leaks.question_and_answer(t)
            share = len(leaks.shingles(own) & have) / len(leaks.shingles(own)) if len(own) >= 5 else float(any(words[k : k + len(own)] == own for k in range(len(words))))
            if share >= 0.8 and len(q & bag) >= 0.8 * len(q) and len(a & bag) >= 0.8 * len(a):
                expected.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(both, bench).collect()}
    assert got == expected and len(got) > 3 and (5_000_002, 902) in got
    monkeypatch.setattr(leaks, "SHARD_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(both, bench).collect()} == expected
    clean = {r.doc_id for r in leaks.decontaminate(both, bench).collect()}
    assert clean == {r.doc_id for r in both.collect()} - {d for d, _ in expected}
    assert leaks.leaked_items(none, bench).count() == 0 and leaks.leaked_items(edge, bench.where("false")).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    import sentencepiece

    from stratarc.llm.pieces import PrefixTable

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        model = f.read()
    return model, PrefixTable(model), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_match_the_library(coder):
    _, mine, theirs = coder
    rng = random.Random(1)
    signs = "  aetnhio\n\t▁é梦字🙂\x00<>s/_0123AB,.'ßñ"
    for k in range(1500):
        s = "".join(rng.choice(signs if k % 3 else "  at▁") for _ in range(rng.randint(0, 60)))
        assert list(mine.encode(s)) == theirs.encode(s) and mine.decode(mine.encode(s)) == theirs.decode(theirs.encode(s))
        ids = [rng.choice([0, 1, 2, 3, 50, 200, 130, 228, 180, 259, 260, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert mine.decode(ids) == theirs.decode(ids)


def test_pieces_of_documents(spark, docs, edge, none, coder):
    from stratarc.llm.pieces import sentencepiece_round_trip

    model, _, theirs = coder
    rows = docs.unionByName(edge).withColumn("decoded_text", F.lit("mine"))
    for r in sentencepiece_round_trip(rows, model).collect():
        ids = theirs.encode(r.text or "")
        assert r.token_ids == ids and r.decoded_text == theirs.decode(ids)
    assert sentencepiece_round_trip(none, model).count() == 0


# --- queries and the pipeline


def test_queries_with_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in Q.oracle_sql().items():
        theirs = c.execute(sql).df()
        ours = Q.queries()[name](spark, sf_dir).toPandas()[list(theirs.columns)]
        plain = lambda d: sorted(map(str, d.astype(object).values.tolist()))
        assert plain(ours) == plain(theirs), name


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "passages", "decontamination", "sentencepiece"]
    rows = P.run(spark, sf_dir).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.exact for r in rows)
    assert 0.6 * docs.count() < len(rows) < docs.count()
    from stratarc.llm.passages import dedup_passages

    again = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id bigint, text string")
    assert dedup_passages(again).where("size(removed_spans) > 0").count() <= 2  # cuts can join two ends into a new repeat


def test_pipeline_without_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_passage_query_matches_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    text = {i: t.encode() for i, t in rows}
    want = {}
    for i, left in brute_cuts(rows):
        want[i] = (len(text[i]), len(text[i]) - len(left), hashlib.sha256(left).hexdigest())
    got = Q.op1_bwt_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want
    spans = {r.doc_id: r.n_spans for r in got}
    assert {i: len(s) for i, s in brute_spans(rows).items()} == spans


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that only rows far beyond the first of a class have is learned, over several tasks and packs."""
    import stratarc.llm.toxicity as X

    monkeypatch.setattr(X, "LEAST", 200)
    monkeypatch.setattr(X, "PACK", 60)
    n = 1500
    texts = [(i, f"calm words number {i % 40} of a quiet day" if i % 3 else f"the vilest zorgle{i % 7} of number {i % 40}", "en") for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")
    seen = []
    real = X.start
    monkeypatch.setattr(X, "start", lambda odds, n1, n0: (seen.append((odds, n1, n0)), real(odds, n1, n0))[1])
    model = X.fit(docs, labels)
    import zlib

    mine = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"calibrate{i}".encode()) % 5]
    assert seen[0][1:] == (sum(i % 3 == 0 for i in mine), sum(i % 3 > 0 for i in mine))
    own = np.zeros((2, X.BUCKETS), np.float32)
    X.count_buckets(own, X._Texts([X._words(texts[i][1]) for i in mine]), np.array([int(i % 3 == 0) for i in mine]))
    assert (own == seen[0][0]).all()  # frequencies of all rows, not of a sample
    asked = spark.createDataFrame([(1, "the vilest zorgle3 of number 5", "en"), (2, "calm words number 5 of a quiet day", "en")], docs.schema)
    got = {r.doc_id: r.score for r in X.score_documents(asked, model).collect()}
    assert got[1] > 0.5 > got[2]
    assert X.fit(docs, labels) == model
    assert not hasattr(X, "SAMPLE")


def test_toxicity_packs_of_a_part_share_a_file(spark):
    """Epochs read packs where they are: a part is not spread over files, so that no exchange has to gather it."""
    import stratarc.llm.toxicity as X

    rows = spark.createDataFrame([(i, f"text {i} of many", "en", i % 2) for i in range(4000)], "__id long, __text string, __lang string, __toxic int").repartition(7)
    packs = X._packs(rows, 4000, 3)
    spread = packs.select("part", F.input_file_name().alias("file")).distinct().groupBy("part").count().collect()
    assert sorted((r.part, r["count"]) for r in spread) == [(0, 1), (1, 1), (2, 1)]
    assert packs.count() == 8


def test_wrapper_leaves_are_matched_without_a_visit(monkeypatch):
    """Pairs of nodes of which one has no blocks match at once; only inner ones are taken apart."""
    from stratarc.llm import wrappers as W

    a, b = (W.parse("<body><div>" + "".join(f"<p>text {i} {x}</p>" for i in range(200)) + "</div></body>") for x in "ab")
    taken = []
    real = W._runs
    monkeypatch.setattr(W, "_runs", lambda nodes: taken.append(len(nodes)) or real(nodes))
    n, pairs, above = W.align(a, b)
    assert n == len(pairs) == len(above) == 203
    assert len(taken) < 20
