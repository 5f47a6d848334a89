import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import exact_dedup as exact_module
from inkmill.llm import near_dedup, suffix_dedup
from inkmill.llm.common import attach, components
from inkmill.llm.exact_dedup import chunk_table, chunks_of, cuts, exact_dedup
from inkmill.llm.near_dedup import near_dups
from inkmill.llm.suffix_dedup import remove_repeats

SPACE = "[\x20\x09-\x0d]+"


def text_of(seed, n, vocabulary=500):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, repeated rows, an extra clashing column."""
    base, passage = text_of(1, 300), text_of(2, 60)
    rnd = random.Random(3)
    near = []
    for _ in range(60):
        words = base.split()
        for _ in range(rnd.randrange(1, 9)):
            words[rnd.randrange(len(words))] = f"x{rnd.random()}"
        near.append(" ".join(words))
    texts = [None, "", " \n\t", "one", "One", "a b c d e", "A\tb c  d e\n", "a b c d f", *[base] * 9, base.upper(), base.replace(" ", "\n"), *near, text_of(4, 20000, 10**6), text_of(4, 20000, 10**6) + " tail", "é" * 300, "é" * 150, "ab" * 300]
    texts += [f"{text_of(10 + i, 80)} {passage} {text_of(40 + i, 80)}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (9, base)]
    return rows, spark.createDataFrame([(i, t, i, True) for i, t in rows], "doc_id long, text string, length long, kept boolean").repartition(5)


def test_exact(corpus):
    rows, df = corpus
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i))
    expected = sorted((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    assert sorted(map(tuple, exact_dedup(df).drop("n_points").collect())) == expected
    assert exact_dedup(df.limit(0)).count() == 0


def test_chunks_are_cut_alike(corpus):
    data = random.Random(0).randbytes(60_000)
    one, two = ([i for i, _ in chunks_of(x)] for x in (data, b"prefix" * 50 + data))
    assert cuts(b"") == [] and cuts(data)[-1] == len(data) and len(set(one) & set(two)) > 0.8 * len(one)
    parts = collections.Counter(c for _, t in corpus[0] for c in chunks_of(re.sub(SPACE, "", t or "").encode()))
    assert sorted((bytes(r.chunk_id), r.n_uses, r.n_bytes) for r in chunk_table(corpus[1]).collect()) == sorted((i, n, len(c)) for (i, c), n in parts.items())


def test_cuts_of_long_texts(monkeypatch):
    data = random.Random(4).randbytes(50_000)
    whole = cuts(data)
    monkeypatch.setattr(exact_module, "STRETCH", 1000)
    assert cuts(data) == whole and exact_module._points("é日a".encode() * 999) == 2997


def test_unlike_chunks_of_one_identifier_fail(spark):
    df = spark.createDataFrame([(bytearray(b"i"), bytearray(b"one")), (bytearray(b"j"), bytearray(b"x")), (bytearray(b"i"), bytearray(b"one"))], "chunk_id binary, data binary")
    assert sorted((bytes(r.chunk_id), r.n_bytes) for r in exact_module.verified(df).collect()) == [(b"i", 3), (b"j", 1)]
    with pytest.raises(Exception, match="different chunks"):
        exact_module.verified(df.union(spark.createDataFrame([(bytearray(b"i"), bytearray(b"two"))], df.schema))).collect()


def test_exact_edges(spark):
    rows = [(-(1 << 63), "a b"), (5, "ab"), (5, "a  b"), (None, "ab"), (None, None), (7, ""), (8, "c"), (8, "c")]
    got = sorted(map(tuple, exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(-(1 << 63), 5, 4, False), (5, 5, 4, False), (5, 5, 4, True), (None, 5, 4, False), (None, 7, 2, False), (7, 7, 2, True), (8, 8, 2, True), (8, 8, 2, True)], key=str)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(SPACE, low) if x]
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)


@pytest.mark.parametrize(("small", "gather"), [(4096, 20_000), (8, 20_000), (4096, 5)])
def test_near(corpus, monkeypatch, small, gather):
    """Also with nodes that branch again, and with components too large to gather."""
    rows, df = corpus
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "GATHER", gather)
    monkeypatch.setattr(near_dedup, "CROWDED", 16)
    assert sorted(map(tuple, near_dups(df).collect())) == brute_components(rows)


def test_near_empty(corpus):
    assert near_dups(corpus[1].limit(0)).count() == 0


def test_structured_words_stay_apart(spark):
    """Complements of Thue-Morse words cancel out in polynomial hashes modulo 2**64."""
    rows = []
    for n in (512, 1024, 2048, 1 << 14):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    got = near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept and r.n_shingles == 1 for r in got) and len(got) == len(rows)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_exact_sets(monkeypatch, bits):
    """Equal hashes of different words or shingles don't make them equal."""
    real = near_dedup.Words._hashes
    monkeypatch.setattr(near_dedup.Words, "_hashes", lambda self: real(self) & near_dedup.U((1 << bits) - 1))
    rnd = random.Random(8)
    texts = ["", "a", "A b", "b a", "x" * 1000, "x" * 999 + "y", "x" * 1000 + " z", *[" ".join(rnd.choice(["k", "kk", "long" * 30, "é", "w1 w2 w3"]) for _ in range(rnd.randrange(3, 40))) for _ in range(30)]]
    sets, found = [shingles(t) for t in texts], near_dedup.Sets([t.encode() for t in texts])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert found.sizes(i, j) == (len(a & b), len(a | b)) and found.linked(i, j) == (len(a & b) > 0 and 100 * len(a & b) >= 75 * len(a | b))


@pytest.fixture(scope="module")
def close_pairs(spark):
    """Pairs of similarity 0.75 to 0.8, each alone, then chains in which each text is so close to the next one only."""
    rnd, rows, pairs = random.Random(12), [], []
    for g in range(2200):
        words = [f"g{g}w{i}" for i in range(rnd.randrange(150, 250))]
        chain = [words]
        for _ in range(1 if g < 1600 else 4):
            words = list(words)
            while True:
                words[rnd.randrange(len(words))] = f"x{rnd.random()}"
                a, b = shingles(" ".join(chain[-1])), shingles(" ".join(words))
                near = len(a & b) / len(a | b)
                if near < 0.8:
                    break
            if near >= 0.75:
                chain.append(words)
        for k, w in enumerate(chain):
            if k:
                pairs.append((len(rows) - 1, len(rows)))
            rows.append((len(rows), " ".join(w)))
    return pairs, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("gather", [20_000, 0])
def test_recall_at_the_threshold(close_pairs, monkeypatch, gather):
    """Components that are gathered, and those that are settled pair by pair."""
    pairs, df = close_pairs
    monkeypatch.setattr(near_dedup, "GATHER", gather)
    root = {r.doc_id: r.component_id for r in near_dups(df).collect()}
    share = sum(root[a] == root[b] for a, b in pairs) / len(pairs)
    assert len(pairs) > 3000 and share >= 0.999, share


def test_near_of_repeated_ids(spark):
    """Texts of one doc_id belong together; rows without doc_id stand alone."""
    x, y, z = (text_of(s, 40, 10**6) for s in (70, 71, 72))
    rows = [(1, x), (5, y), (5, z), (3, z), (7, y + " "), (None, x), (None, x)]
    got = sorted(map(tuple, near_dups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == [(1, 1), (3, 3), (5, 3), (5, 3), (7, 3), (None, None), (None, None)]


@pytest.mark.parametrize(("crowd", "block"), [(1 << 15, 20), (3, 8)])
def test_suffix(corpus, monkeypatch, crowd, block):
    rows, df = corpus
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k : k + 200] for _, t in raw for k in range(len(t) - 199))
    expected = []
    for i, t in raw:
        spans = []
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 200
                else:
                    spans.append([k, k + 200])
        left, at = b"", 0
        for s, e in spans:
            left, at = left + t[at:s], e
        left += t[at:]
        expected.append((i, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    assert sorted(map(tuple, remove_repeats(df).collect())) == sorted(expected)


def test_windows_in_rounds(monkeypatch):
    rnd = random.Random(14)
    base = rnd.randbytes(260)
    pieces = [rnd.randbytes(rnd.randrange(200, 360)) for _ in range(40)] + [base, base[30:] + b"x", b"y" + base[:240], b"z" * 230]
    wanted = np.arange(len(pieces)) % 7 != 3
    seen = collections.Counter(p[k : k + 200] for p in pieces for k in range(len(p) - 199))
    expected = [(i, k) for i, p in enumerate(pieces) if wanted[i] for k in range(len(p) - 199) if seen[p[k : k + 200]] > 1]
    for size, part in ((1 << 21, 1 << 19), (1000, 700)):
        monkeypatch.setattr(suffix_dedup, "ROUND", size)
        monkeypatch.setattr(suffix_dedup, "_PIECE", part)
        owner, at = suffix_dedup._repeated(pieces, wanted)
        assert list(zip(owner.tolist(), at.tolist(), strict=True)) == expected


def test_suffix_of_rows_with_one_id(spark):
    """Null and repeated ids; a long text of one letter, whose every window repeats."""
    x, y = text_of(81, 90), text_of(82, 90)
    rows = [(None, x + " one"), (None, y), (4, x), (4, y), (5, "z" * 300_000), (6, "z" * 199)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, len(x) + 4): (len(x), 1), (None, len(y)): (len(y), 1), (4, len(x)): (len(x), 1), (4, len(y)): (len(y), 1), (5, 300_000): (300_000, 1), (6, 199): (0, 0)}


def test_suffix_empty_and_text(spark):
    df = spark.createDataFrame([(1, "q" * 150 + "é" * 200, "x"), (2, "é" * 200 + "z", "y")], "doc_id long, text string, n_bytes string")
    out = {r.doc_id: r for r in remove_repeats(df, with_text=True, carry=()).collect()}
    assert out[1].kept_text == "q" * 150 and out[2].kept_text == "z"
    assert remove_repeats(df.limit(0)).count() == 0


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1000)
    text = random.Random(5).randbytes(5000)
    covered = {s + k for _, starts, counts, _, _ in suffix_dedup.segments([text, b"short"]) for s, n in zip(starts, counts, strict=True) for k in range(n)}
    assert covered == set(range(len(text) - 199))


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_planted_cluster_is_compared_in_bulk(monkeypatch):
    """Copies of one text with a quarter to a half of it changed: sets refute most pairs by hashes at once, and both ways agree."""
    rnd, base = random.Random(5), [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        words = base[:]
        for at in rnd.sample(range(0, 295, 5), rnd.randrange(1, 16)):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words).encode())
    ids = np.arange(150)
    sets = near_dedup.Sets(texts)
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if sets.linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    calls, linked = [], near_dedup.Sets.linked
    monkeypatch.setattr(near_dedup.Sets, "linked", lambda self, i, j: calls.append((i, j)) or linked(self, i, j))
    assert near_dedup._exact_components(ids, texts).tolist() == root and len(set(root)) > 1
    assert len(calls) < 150
    monkeypatch.setattr(near_dedup, "OVERLAP_BYTES", 0)
    assert near_dedup._exact_components(ids, texts).tolist() == root


def test_attach_joins_nothing_but_rows_and_groups(spark):
    """Keys that are dealt are looked up, not joined, and each row comes once."""
    rows = spark.range(3000).selectExpr("if(id < 2000, 0, id) AS k", "id AS v")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = attach(rows, groups, ["k"], "n", 3000)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert out.count() == 3000 and out.where("k = 0 and n = 2000").count() == 2000
    assert attach(rows, groups.where("k > 2500"), ["k"], "n", 3000, "left").where("n is null").count() == 2501
