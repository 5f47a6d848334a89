import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkmill.llm import queries
from inkmill.llm.line_dedup import line_dedup
from inkmill.llm.packing import CAPACITY, SMALLS, cut, group_lengths, pack, plan, token_ids
from inkmill.llm.piece_sampling import U, _uniform, decode, decode_pieces, lattice, pieces, sample, sample_long, sample_pieces
from inkmill.llm.quality_classifier import HELD_OUT, quality_scores
from inkmill.llm.quality_rules import judged, quality_rules, repeat_words
from inkmill.llm.toxicity import toxicity_scores

P = pytest.importorskip("public_tokenizers")
RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "one two", "é" * 3000, "a b " * 2000, "x\n\ny <|endoftext|> z", "日本語 ▁ \U0001f600\n", "word " * 1500 + "end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece long").repartition(3)


def test_packing(docs):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert [k + n for k, n in cut(len(ids))][-1] == len(ids)
        expected += [(r.doc_id, i, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())) for i, (s, n) in enumerate(cut(len(ids)))]
    got = pack(docs, RANKS, P.PATTERN, with_ids=True).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    check_sequences((r.sequence_id, r.offset, r.length) for r in got)
    assert pack(docs.limit(0), RANKS, P.PATTERN).count() == 0


def check_sequences(rows):
    full = collections.defaultdict(list)
    for seq, offset, length in rows:
        full[seq].append((offset, length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(full)


def best_fit(counts):
    rooms = []
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                room = min(fits)
                rooms.remove(room)
            else:
                room, n = CAPACITY, n + 1
            rooms.append(room - length)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rnd = random.Random(seed)
    draw = [lambda: rnd.randint(1, 1024), lambda: int(rnd.gauss(400, 120)), lambda: rnd.randint(1, 60), lambda: int(rnd.expovariate(1 / 250)), lambda: rnd.randint(300, 1024), lambda: 341][seed]
    counts = collections.Counter(max(1, min(1024, draw())) for _ in range(1500))
    plans = [plan(counts, small=s) for s in SMALLS]
    for rows, n in plans:
        assert check_sequences((s + i, o, length) for length, _, k, s, o in rows.tolist() for i in range(k)) == n
        ranks = sorted((length, first + i) for length, first, k, _, _ in rows.tolist() for i in range(k))
        assert ranks == sorted((length, i) for length, k in counts.items() for i in range(k))
    assert min(n for _, n in plans) <= best_fit(counts) * 1.005 + 1
    assert plan({})[1] == 0 and sum(n for m in group_lengths(counts, 7).values() for _, n in m) == 1500


def test_special_token():
    from inkmill.llm.packing import encoder

    assert token_ids("ab<|endoftext|>cd", encoder(RANKS, P.PATTERN)).tolist() == [397, 50256, 10210]


def test_long_runs_have_the_ids_of_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from inkmill.llm import packing

    tokenizer, enc, rnd = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder(RANKS, P.PATTERN), random.Random(3)
    runs = [" " * 2_000_000, "\n" * 2_000_000 + "end", "\r\n \t" * 500_000 + "x", "a" + "\u3000" * 10_000, "\x1c" * 9000 + "y " + " " * 5000 + "<|endoftext|>" + "\n" * 5000]
    runs += ["".join(rnd.choice([" ", "\n", "\t", "\xa0", "word", "don't", "7", "!", "é"]) * rnd.choice([1, 1, 1, 2, 40, 4095, 4096, 4097, 5000]) for _ in range(60)) for _ in range(8)]
    monkeypatch.setattr(packing, "STRETCH", 700)
    for text in runs:
        assert token_ids(text, enc).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_of_long_white_space(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000 + "a"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = pack(df, RANKS, P.PATTERN).collect()
    assert {r.doc_id for r in got} == {1, 2, None} and sum(r.doc_id is None for r in got) == 2
    check_sequences((r.sequence_id, r.offset, r.length) for r in got)


def test_sampling_is_lossless_and_reproducible(docs):
    a = {(r.doc_id, r.n_pieces, r.ids_crc32): r for r in sample_pieces(docs, MODEL, with_ids=True).collect()}
    b = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in sample_pieces(docs.coalesce(1), MODEL).collect()}
    assert set(a) == b and all(r.lossless for r in a.values())
    c = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in sample_pieces(docs, MODEL, seed=1).collect()}
    assert c != b
    back = decode_pieces(sample_pieces(docs, MODEL, with_ids=True), MODEL)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def test_sampling_follows_the_lattice():
    p = pieces(MODEL)

    def ways(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            rows, at = p.find(np.array([p.hash_text(text[:k])], dtype=U))
            if len(rows):
                for rest, score in ways(text[k:]):
                    yield (int(p.ids[at[0]]), *rest), score + p.scores[at[0]]

    exact = dict(ways(" then"))
    total = sum(map(math.exp, exact.values()))
    n = 40_000
    drawn = collections.Counter(tuple(x.tolist()) for x in sample(p, ["then"] * n, np.arange(n, dtype=U) * U(7919)))
    assert set(drawn) <= set(exact)
    assert all(abs(drawn[k] / n - math.exp(v) / total) < 0.01 for k, v in exact.items())
    assert decode(p, sample(p, [" a  b "], np.ones(1, dtype=U))[0]) == " a  b "


def enumerated(p, text):
    """Every segmentation of a unit and its weight."""
    if not text:
        yield (), 0.0
    for k in range(1, min(16, len(text)) + 1):
        rows, at = p.find(np.array([p.hash_text(text[:k])], dtype=U))
        one = [(int(p.ids[at[0]]), float(p.scores[at[0]]))] if len(rows) else [(-ord(text[0]), p.worst * len(text[0].encode()))] if k == 1 else []
        for i, s in one:
            for rest, score in enumerated(p, text[k:]):
                yield (i, *rest), s + score


@pytest.mark.parametrize("text", ["word", "Zażółć", "日x", "aaaaaa", "\t=="])
def test_sampling_follows_enumeration(text):
    """Also through the way of long units."""
    p = pieces(MODEL)
    ways = dict(enumerated(p, " " + text))
    total = sum(map(math.exp, ways.values()))
    n, chars = 6000, np.array([ord(c) for c in " " + text])
    seeds = np.arange(n, dtype=U) * U(104729)
    cum, ids = lattice(p, chars[None, :], 1.0)
    for long in (False, True):
        drawn = collections.Counter()
        for seed in seeds:
            if long:
                found = sample_long(p, chars, seed, 0, 1.0)[1][::-1].tolist()
            else:
                found, end = [], len(chars) - 1
                while end >= 0:
                    k = int((_uniform(seed, np.array([end])) >= cum[0, end]).sum())
                    found.insert(0, int(ids[0, end, k]))
                    end -= k + 1
            drawn[tuple(found)] += 1
        assert set(drawn) <= set(ways)
        assert sum(abs(drawn[k] / n - math.exp(v) / total) for k, v in ways.items()) / 2 < 0.05


def test_sampling_of_long_units_and_texts(spark, monkeypatch):
    from inkmill.llm import piece_sampling as S

    p, rnd = pieces(MODEL), random.Random(5)
    unit = "".join(rnd.choice("abcdeé日-") for _ in range(3000))
    text = f"one {unit}  two\n{unit[:500]} \U0001f600 " + "word and  another\n" * 300
    seeds = np.array([77], dtype=U)
    whole = sample(p, [text], seeds)[0].tolist()
    monkeypatch.setattr(S, "LONG_UNIT", 100)
    monkeypatch.setattr(S, "BLOCK", 64)
    assert sample(p, [text], seeds)[0].tolist() == whole
    monkeypatch.setattr(S, "STRETCH", 50)
    parts = S._stretches(text)
    assert "".join(t for _, t in parts) == text and len(parts) > 50
    assert [i for begin, part in parts for i in sample(p, [part], seeds, 1.0, [begin])[0].tolist()] == whole and decode(p, whole) == text


def test_sampling_of_a_very_long_unit_and_empty(spark):
    df = spark.createDataFrame([(1, "ab" * 600_000), (None, "x"), (None, "x")], "doc_id long, text string")
    got = sample_pieces(df, MODEL).collect()
    assert all(r.lossless for r in got) and len({(r.n_pieces, r.ids_crc32) for r in got if r.doc_id is None}) == 1
    assert sample_pieces(df.limit(0), MODEL).count() == 0


def test_quality_rules(spark):
    good = "\n".join(" ".join(f"u{i}v{j}" for j in range(8)) + "." for i in range(12))
    nav = "\n".join(["Home | About | News", "CLICK HERE NOW FRIENDS!!", "a### b### c### d.", "menu entry"] * 5)
    words = " ".join(f"w{i}" for i in range(60)) + "."
    cases = {1: good, 2: good + "\n" + nav.splitlines()[0], 3: good[:200] + "\n" + nav * 3, 4: None, 5: "", 6: "be be " * 60 + ".", 7: words, 8: words + "\n" + words, 9: "All rights reserved.\n" + good, 10: " \n" + words}
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = {r.doc_id: r for r in quality_rules(df, with_text=True).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False, 9: True, 10: True}
    assert got[2].clean_text == good and got[9].clean_text == good and got[8].n_dup_lines == 1 and got[8].base_failed and got[7].n_repeat_words == 0
    assert judged(["é a\tb".encode()])[0][0][:2] == (3, 3) and judged([b"a b c x a b c", b"", b"A a A a A a"])[0][0][4] == 6
    assert quality_rules(df.limit(0)).count() == 0


def test_quality_rules_of_other_scripts():
    text = "これは 一つ の 文 です。\n本当 です か？\nメニュー 項目\nहाँ यह ठीक है।"
    assert judged([text.encode()])[0][1].decode() == "これは 一つ の 文 です。\n本当 です か？\nहाँ यह ठीक है।"


def test_repeat_words_against_counting():
    rnd = random.Random(17)
    texts = [" ".join(rnd.choice("abcAB") * rnd.choice([1, 1, 300]) for _ in range(rnd.randrange(0, 60))) for _ in range(200)]
    n, repeated = repeat_words([t.encode() for t in texts])
    for i, t in enumerate(texts):
        w = t.split()
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (n[i], repeated[i]) == (len(w), len(marked))


def test_line_dedup(spark):
    def page(i, host, *lines):
        return (i, f"http://{host}/p{i}", "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "<script>var x='<p>no</p>'</script>")

    rows = [page(i, "a.net", "Menu", f"text {i}", f"text {i}") for i in range(10)] + [page(20, "b.net", "Menu"), page(21, "b.net", "Menu"), (22, None, None), (23, "x", ""), page(3, "a.net", "Menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_lines", F.lit(1))
    got = sorted((r.page_id, r.n_lines, r.n_dropped, r.clean_text) for r in line_dedup(df, 0.3, 3).collect())
    assert (0, 3, 1, "text 0\ntext 0") in got and (20, 1, 0, "Menu") in got and (22, 0, 0, "") in got and (3, 1, 1, "") in got and len(got) == len(rows)
    dropped = {(r.page_id, r.n_dropped) for r in line_dedup(df).collect()}  # nothing but the ratio
    assert {(20, 1), (0, 1), (4, 1)} <= dropped
    few = spark.createDataFrame([page(1, "c.net", "Menu", "own"), page(2, "c.net", "Menu"), page(3, "d.net", "only"), page(4, "e.net", "x"), page(5, "e.net", "x"), page(6, "e.net", "y"), page(None, "e.net", "x")], "page_id long, url string, html string")
    got = {(r.page_id, r.clean_text) for r in line_dedup(few, queries.LINE_RATIO, queries.LINE_PAGES).collect()}
    assert got == {(1, "own"), (2, ""), (3, "only"), (4, ""), (5, ""), (6, "y"), (None, "")}
    assert line_dedup(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("sa", "to", "vi", "pe", "du")]
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(rnd.choice(words) for _ in range(8)).capitalize() + "." for _ in range(15)]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(2):
                at = rnd.randrange(15)
                sentences[at] = sentences[at].replace(" ", rnd.choice([" idiotka ", " trashar "]), 1)
        text = " ".join(sentences)
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scores", "label", "least"), [(quality_scores, "quality", 0.97), (toxicity_scores, "toxic", 0.97)])
def test_classifiers(labelled, scores, label, least):
    docs, labels = labelled
    out = scores(docs, labels)
    assert out.count() == docs.count()
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == HELD_OUT) and 0 <= r.score <= 1 for r in rows)
    held = out.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id")
    assert held.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
    assert scores(docs.limit(0), labels).count() == 0 and scores(docs, labels.limit(0)).count() == docs.count()


def test_rows_without_doc_id(spark):
    """Each is judged by its text, and none belongs to the held-out fold or is learned from."""
    text = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(None, text), (None, text), (None, None), (3, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id is None, r.kept) for r in quality_rules(df).collect()) == [(False, True), (True, False), (True, True), (True, True)]
    for scores in (quality_scores, toxicity_scores):
        rows = scores(df, labels).collect()
        assert len(rows) == 4 and not any(r.held_out for r in rows if r.doc_id is None) and len({r.score for r in rows}) <= 2


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_scores_do_not_depend_on_the_dealing(labelled, scores):
    docs, labels = labelled
    one, two = ({(r.doc_id, r.score, r.predicted) for r in scores(d, x).collect()} for d, x in ((docs, labels), (docs.repartition(7, "text"), labels.repartition(5))))
    assert one == two


def test_prior_from_positives_and_unlabelled():
    """Without negatives, also where the classes overlap: the estimate can be too high by the overlap, not too low by much."""
    from inkmill.llm import quality_classifier as Q

    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        good, bad = rng.normal(1.5, 1, (8000, Q.N_FEATURES)), rng.normal(-1.5, 1, (4000, Q.N_FEATURES))
        k = int(4000 * share)
        unl = np.concatenate([good[4000 : 4000 + k], bad[: 4000 - k]])
        found = Q.estimated_prior(good[:4000], unl)
        assert abs(found - share) < 0.04, (share, found)
        out = Q.forward(np.concatenate([good[4000 + k :], bad[4000 - k :]]), Q.fit(good[:4000], unl, found))[1] >= 0
        truth = np.arange(len(out)) < 4000 - k
        assert (out == truth).mean() > 0.97


def test_features_of_long_texts(monkeypatch):
    from inkmill.llm import quality_classifier as Q

    text = " ".join(random.Random(6).choice(["a", "b b", "C!\n", "d,", "e" * 300]) for _ in range(3000)).encode()
    whole = Q.features(text)
    assert whole[5] > 0
    monkeypatch.setattr(Q, "STRETCH", 100)
    assert np.allclose(Q.features(text), whole)


def test_words_of_long_texts(monkeypatch):
    """Sentences that go on over stretches stay one."""
    from inkmill.llm import toxicity

    rnd = random.Random(7)
    texts = ["".join(rnd.choice(["ab", "Cde ", " ", "! ", "\n", "é", "x" * 90]) for _ in range(n)).encode() for n in (400, 0, 1, 30)]

    def found():
        parts = list(toxicity.words(texts))
        return [np.concatenate([p[k] for p in parts]) for k in range(4)]

    whole = found()
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    parts = found()
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and len(set(whole[1])) >= 2


def test_toxic_sentence_is_located(labelled):
    docs, labels = labelled
    found = [r for r in toxicity_scores(docs, labels).where("predicted = 1").join(docs, "doc_id").collect()]
    near = sum(any(w in r.text.lower()[r.worst_start : r.worst_start + 120].split(".")[0] for w in ("idiotka", "trashar")) for r in found)
    assert found and near >= 0.95 * len(found)


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)

    def prose(n):
        return "\n".join(" ".join(f"word{rnd.randrange(4000)}" for _ in range(10)) + "." for _ in range(n))

    passage = prose(4)
    originals = [prose(12) for _ in range(6)]
    texts = originals + [originals[0].replace(" ", "  "), originals[1].replace("word", "word", 1) + " tail.", "short", None, originals[2][:400] + "\n" + passage + "\n" + prose(8), prose(8) + "\n" + passage]
    rows = [(i, t, "en", f"s{i}", len(t or ""), i) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s3", len(texts[3]), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"], name
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert seen[0] == [0, 1, 2, 3, 3, 4, 5, 6, 7, 10, 11] and seen[1] == [1, 2, 3, 4, 5, 6, 7, 10, 11] and seen[2] == [1, 2, 3, 4, 5, 6, 10, 11] and seen[3] == seen[2]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left[4] == originals[4] and passage[20:-20] not in left[11] and passage[20:-20] not in left[10]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in whole}) == seen[3] and check_sequences((r.sequence_id, r.offset, r.length) for r in whole)


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(queries.ORACLE) <= set(queries.QUERIES)
