"""The pipeline, stage by stage, against plain Python over the same rows."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from inkmill.llm.packing import CAPACITY
from inkmill.llm.quality_rules import BOILERPLATE

P = pytest.importorskip("public_tokenizers")
SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text) if w]


def bad_line(line):
    upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
    ws = words(line)
    return (
        not re.search(r"[.!?:;…\"'”’»)\]。！？；：｡」』）】》।؟۔][\x20\x09-\x0d]*\Z", line)
        or re.search(BOILERPLATE, line, re.IGNORECASE) is not None
        or upper >= 10 and 100 * upper > 60 * (upper + lower)
        or sum(w in "| > >> » · • / - –".split() for w in ws) >= 2
        or 100 * sum(bool(re.search("[#*$%&|<>]", w)) for w in ws) > 30 * len(ws)
    )


def rules(rows):
    out = []
    for i, text in rows:
        ws = words(text or "")
        grams = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        again = {k + j for k in range(len(ws) - 2) if grams[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        if len(ws) < 50 or 100 * len(again) > 50 * len(ws):
            continue
        lines = [x for x in text.split("\n") if not words(x) or not bad_line(x)]
        chars = [sum(map(len, words(x))) for x in (text, "\n".join(lines))]
        if 100 * (chars[0] - chars[1]) <= 50 * chars[0]:
            out.append((i, "\n".join(lines)))
    return out


def exact(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(SPACE, "", text)].append((-len(text), i, text))
    return [(i, t) for g in groups.values() for n, i, t in {x for x in g if x[:2] == min(g)[:2]}]


def near(rows):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(t) for _, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]


def repeats(rows):
    raw = [(i, t.encode()) for i, t in rows]
    seen = collections.Counter(t[k : k + 200] for _, t in raw for k in range(len(t) - 199))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out.append((i, bytes(b for b, g in zip(t, gone.tolist(), strict=True) if not g).decode("utf-8", "ignore")))
    return out


def pieces(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % CAPACITY or CAPACITY
        starts = [0, *range(first, len(ids), CAPACITY)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            out.append((i, k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())))
    return out


def corpus():
    rnd = random.Random(31)

    def line():
        kind = rnd.random()
        if kind < 0.08:
            return rnd.choice(["Home | About | News", "Click here to read more.", "SHOUTING LOUDLY AT ALL READERS!", "no end", "", "a# b# c# d.", "日本 の 文。"])
        return " ".join(rnd.choice(["word", "Term", "é"]) + str(rnd.randrange(3000)) for _ in range(rnd.randrange(5, 14))) + rnd.choice(".!?:")

    def prose():
        return "\n".join(line() for _ in range(rnd.randrange(6, 16)))

    passages = ["\n".join(line() for _ in range(4)) for _ in range(3)]
    texts = [prose() for _ in range(60)]
    for _ in range(25):  # exact copies but for white space
        texts.append(rnd.choice(texts[:60]).replace(" ", rnd.choice([" ", "  ", "\t"])))
    for _ in range(30):  # near copies
        ws = rnd.choice(texts[:60]).split(" ")
        for _ in range(rnd.randrange(1, 6)):
            ws[rnd.randrange(len(ws))] = f"new{rnd.randrange(10**6)}"
        texts.append(" ".join(ws))
    for _ in range(25):
        texts.append(prose() + "\n" + rnd.choice(passages) + "\n" + prose())
    texts += [None, "", "short.", "be be " * 80 + ".", "\n".join(prose() for _ in range(60))]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [rows[3], rows[50]]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or ""), {"k": str(i)}, i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept map<string,string>, n_words long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = docs.columns, []
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], (rules, exact, near, repeats), strict=True):
        docs, rows = stage(spark, docs, str(tmp_path)), plain(rows)
        assert docs.columns == columns, name
        got = sorted((r.doc_id, r.text, r.n_chars, r.source, r.kept["k"]) for r in docs.collect())
        assert got == sorted((i, t, len(t), f"s{i}", str(i)) for i, t in rows), name
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes[:3])) == 3
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted(pieces(rows))
    full = collections.defaultdict(list)
    for r in whole:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= CAPACITY
    assert len(full) <= -(-sum(r.length for r in whole) // CAPACITY) * 1.05 + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_doc_id(spark):
    """A row that agrees with another in doc_id but is a copy goes, the longer text stays."""
    text = " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(5, text), (5, text.replace(" ", "  ")), (None, text), (7, "other " + text)], "doc_id long, text string")
    out = corpus_pipeline.exact(spark, docs, "")
    assert sorted((r.doc_id, len(r.text)) for r in out.collect()) == [(5, len(text) + 59), (7, len(text) + 6)]
