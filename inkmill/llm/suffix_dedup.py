"""Repeated-passage removal: depth-limited radix sort of suffixes.

Suffixes are ordered only through WINDOW bytes, most significant digit first, and
after each pass only groups of two or more go on. The last groups are exactly the
repeated windows.

* Digit 1 is the minimiser of a window: its gram of GRAM bytes with the smallest hash,
  leftmost on ties. Equal windows have equal minimisers at equal offsets, so all windows
  that share one are represented by one row per occurrence of the gram (about two in
  WINDOW - GRAM positions), and a count by gram with map-side combine is the first pass.
* Digit 2 is the segment: all windows that have this occurrence as their minimiser,
  hashed as one string. If all segments of a gram are equal, all their windows repeat;
  likewise for each segment that occurs twice.
* Digit 3, for grams with unequal segments only, is the window itself, over one
  representative per distinct segment.

Counts are pre-aggregated, joins that a popular passage could skew deal the popular keys over salts, and the third pass of grams with over CROWD occurrences is a
distributed count of windows, so no group is gathered in one task. Bitmaps of fixed size keep
rows that cannot matter out of the shuffles. Runs of repeated windows are merged in blocks of BLOCK bytes before a document's come together, at most one span
per WINDOW bytes. Grams are told apart by 64 bits, segments by 64 more within a gram, windows by 128.

Null text counts as empty: nothing is removed, and the digest is that of no bytes. Rows are told apart by doc_id, null included, and 64 bits of the text; rows that repeat
are separate documents, so each removes the other's windows. Texts under WINDOW bytes stay whole; overlapping and touching windows are one span. An empty table
gives no rows. Only doc_id, text and the columns of carry are read, so other columns may have any names. Long texts go in pieces.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap, in_bitmap, python_map, stash
from .rolling import A, B, U, chunks, mix, sliding_min

WINDOW, GRAM = 200, 40
#: Up to so many segments of a gram, under 12 MB, are compared in one task, in rounds of about ROUND bytes; beyond it windows are counted as rows.
CROWD = 1 << 15
_PIECE, ROUND = 1 << 19, 1 << 21
#: Runs are merged in blocks of 2**BLOCK bytes.
BLOCK = 20
_POS = U((1 << 20) - 1)


def _segments(parts: list[bytes]):
    """(part, start, windows, gram hash, segment hash) of every segment of parts, each under 2**20 bytes."""
    size = np.array([len(p) for p in parts])
    off = np.concatenate([[0], np.cumsum(size)])
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if len(buf) < WINDOW:
        return None
    grams = mix(A.windows(A.prefix(buf), GRAM))
    least = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=U), WINDOW - GRAM + 1)
    at = (least & _POS).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), size)[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + WINDOW <= off[part + 1])
    if not len(start):
        return None
    at, part = at[start], part[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    s, e, at, part = start[first], start[last], at[first], part[first]
    seg = mix(B.spans(B.prefix(buf), s, e + WINDOW) + (at - s).astype(U) * U(0x9E3779B97F4A7C15) + (e - s).astype(U))
    return part, s - off[part], e - s + 1, grams[at], seg


def segments(texts: list[bytes]):
    """The same for texts of any length: long ones go in overlapping pieces."""
    parts, owner, base = [], [], []
    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        for b in range(0, max(1, len(t) - WINDOW + 1), _PIECE):
            parts.append(t[b : b + _PIECE + WINDOW - 1])
            owner.append(i)
            base.append(b)
    owner, base = np.array(owner, dtype=np.int64), np.array(base, dtype=np.int64)
    for lo, hi in chunks([len(p) for p in parts], _PIECE):
        if found := _segments(parts[lo:hi]):
            part, s, n, gram, seg = found
            yield owner[lo:hi][part], s + base[lo:hi][part], n, gram, seg


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the text without null, and 64 bits of it."""
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_sum", F.xxhash64("_text"))


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _occurrences(grams: np.ndarray | None):
    """Rows for the segments of a batch (doc_id, _sum, _text); with a bitmap, only of grams in it."""

    def scan(batch):
        ids, sums = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        for owner, s, n, gram, seg in segments(_raw(batch.column(2))):
            gram, seg = gram.view(np.int64), seg.view(np.int64)
            if grams is not None:
                ok = in_bitmap(grams, gram)
                owner, s, n, gram, seg = owner[ok], s[ok], n[ok], gram[ok], seg[ok]
            if len(owner):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(sums[owner]), pa.array(s * 256 + n), pa.array(gram), pa.array(seg)], ["doc_id", "sum", "pos", "gram", "seg"])

    return scan


_OCC = "doc_id long, sum long, pos long, gram long, seg long"


def _counts(batch):
    for _, _, _, gram, seg in segments(_raw(batch.column(0))):
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(seg.view(np.int64))], ["gram", "seg"])


def _cut(batch):
    """Bytes of the wanted segments of each text. Columns: doc_id, sum, text, wanted."""
    ids, sums, out = batch.column(0), batch.column(1), []
    for i, (text, wanted) in enumerate(zip(_raw(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
        for w in wanted:
            s, n = w["pos"] >> 8, w["pos"] & 255
            out.append((i, w["pos"], w["gram"], w["uses"], w["crowd"], text[s : s + n + WINDOW - 1]))
    rows, pos, gram, uses, crowd, piece = zip(*out, strict=True)
    take = pa.array(rows)
    yield pa.RecordBatch.from_arrays([ids.take(take), sums.take(take), pa.array(pos), pa.array(gram), pa.array(uses), pa.array(crowd), pa.array(piece, pa.binary())], ["doc_id", "sum", "pos", "gram", "uses", "crowd", "piece"])


def _windows(pieces: list[bytes]):
    """(piece, offset, hash, hash) of every window of pieces."""
    size = np.array([len(p) for p in pieces])
    buf = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(pieces)), size)
    start = np.flatnonzero(np.arange(len(buf)) + WINDOW <= end[owner])
    owner = owner[start]
    h1, h2 = (mix(f.spans(f.prefix(buf), start, start + WINDOW)) for f in (A, B))
    return owner, start - (end - size)[owner], h1, h2


def _repeated(pieces: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the windows of wanted pieces that stand twice in pieces, in order. Windows are compared in rounds by their hash, so memory
    doesn't grow with a gram."""
    sizes = [len(p) for p in pieces]
    rounds = 1 + sum(sizes) // ROUND
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        found = []
        for lo, hi in chunks(sizes, _PIECE):
            owner, at, h1, h2 = _windows(pieces[lo:hi])
            mine = slice(None) if rounds == 1 else np.flatnonzero((h1 >> U(40)) % U(rounds) == U(r))
            found.append((owner[mine] + lo, at[mine], h1[mine], h2[mine]))
        owner, at, h1, h2 = (np.concatenate([f[k] for f in found]) for k in range(4))
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        hit = np.zeros(len(order), dtype=bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        hit &= wanted[owner]
        hits.append((owner[hit], at[hit]))
    owner, at = (np.concatenate([h[k] for h in hits]) for k in (0, 1))
    order = np.lexsort((at, owner))
    return owner[order], at[order]


def _resolve(batches):
    """Digit 3 within a partition that is sorted by gram, each gram's rows together.
    Yields the repeated runs of windows of segments that occur once."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            gram = held.column("gram").to_numpy()
            edge = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
        else:
            if held is None:
                return
            edge = held.num_rows
        if not edge:
            continue
        done, held = held.slice(0, edge), held.slice(edge) if edge < held.num_rows else None
        sizes = [len(p) for p in done.column("piece").to_pylist()]
        grams = done.column("gram").to_numpy()
        lo = 0
        while lo < edge:  # whole grams, to about _PIECE bytes
            hi, total = lo, 0
            while hi < edge and (total < _PIECE or grams[hi] == grams[hi - 1]):
                total += sizes[hi]
                hi += 1
            part = done.slice(lo, hi - lo)
            owner, at = _repeated(part.column("piece").to_pylist(), part.column("uses").to_numpy() == 1)
            if len(owner):
                rows, pos = _runs(owner, at)
                pos += part.column("pos").to_numpy()[rows] >> 8 << 8
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), part.column("sum").take(pa.array(rows)), pa.array(pos)], ["doc_id", "sum", "pos"])
            lo = hi


def _then_none(it):
    yield from it
    yield None


def _runs(owner: np.ndarray, at: np.ndarray):
    """Runs of consecutive windows as (owner, start * 256 + windows)."""
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    return owner[first], at[first] * 256 + count


def _window_rows(batch):
    """Digit 3 as rows, for crowded grams."""
    n = batch.num_rows
    sizes = [len(p) for p in batch.column("piece").to_pylist()]
    assert n == len(sizes)
    for lo, hi in chunks(sizes, _PIECE):
        part = batch.slice(lo, hi - lo)
        owner, at, h1, h2 = _windows(part.column("piece").to_pylist())
        take = pa.array(owner)
        pos = (part.column("pos").to_numpy()[owner] >> 8) + at
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("sum").take(take), part.column("uses").take(take), pa.array(pos * 256 + 1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "sum", "uses", "pos", "h1", "h2"])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, sum, pos): runs of repeated windows, pos = start * 256 + windows in the run."""
    keyed = _keyed(docs).select("doc_id", F.col("_sum").alias("sum"), "_text")
    # digit 1: counts of grams, and whether their segments differ
    grams = python_map(keyed.select("_text"), _counts, "gram long, seg long").groupBy("gram")
    grams = grams.agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("n > 1")
    grams = stash(grams.select("gram", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "sfx-grams")
    seen = bitmap(grams, "gram")
    total = grams.agg(F.sum("n")).first()[0] or 0
    occ = python_map(keyed, _occurrences(seen), _OCC)
    occ = stash(attach(occ, grams, ["gram"], "n", total), "sfx-occ")
    # digit 2: segments of grams whose segments differ
    mixed = occ.where("mixed")
    segs = mixed.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("doc_id", "sum", "pos")).alias("at"), F.first(F.col("n") > CROWD).alias("crowd"))
    segs = stash(segs, "sfx-segs")
    twice = attach(mixed.select("doc_id", "sum", "pos", "gram", "seg"), segs.where("uses > 1").select("gram", "seg", "uses"), ["gram", "seg"], "uses", total)
    # digit 3: windows of one representative per distinct segment
    wanted = segs.groupBy("at.doc_id", "at.sum").agg(F.collect_list(F.struct("at.pos", "gram", "uses", "crowd")).alias("wanted"))
    holders = bitmap(segs.select(F.xxhash64("at.doc_id").alias("h")), "h")
    texts = python_map(keyed.withColumn("h", F.xxhash64("doc_id")), _only(holders), "doc_id long, sum long, _text string")
    pieces = texts.alias("t").join(wanted.alias("w"), F.equal_null("t.doc_id", "w.doc_id") & (F.col("t.sum") == F.col("w.sum"))).select("t.doc_id", "t.sum", "_text", "wanted")
    pieces = stash(python_map(pieces, _cut, "doc_id long, sum long, pos long, gram long, uses long, crowd boolean, piece binary"), "sfx-pieces")
    calm = pieces.where("not crowd").repartition("gram").sortWithinPartitions("gram").mapInArrow(_resolve, "doc_id long, sum long, pos long")
    rows = python_map(pieces.where("crowd"), _window_rows, "doc_id long, sum long, uses long, pos long, h1 long, h2 long")
    again = stash(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "sfx-windows")
    crowd = attach(rows.where("uses = 1"), again, ["h1", "h2"], "k", again.agg(F.sum("k")).first()[0] or 0)
    cols = ["doc_id", "sum", "pos"]
    return occ.where("not mixed").select(cols).unionAll(twice.select(cols)).unionAll(calm).unionAll(crowd.select(cols))


def _only(words: np.ndarray):
    def scan(batch):
        ok = pa.array(in_bitmap(words, batch.column("h").to_numpy()))
        yield batch.filter(ok).select(["doc_id", "sum", "_text"])

    return scan


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte ranges merged: start, end, start, end, ...; touching ranges are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.concatenate([new[1:], [True]])]], axis=1).ravel()


def _spans(batch):
    """Ranges that the runs of a block cover."""
    out = []
    for runs in batch.column("runs"):
        packed = runs.values.to_numpy()
        out.append(_merged(packed >> 8, (packed >> 8) + (packed & 255) + WINDOW - 1))
    yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_s"), pa.array(out, pa.list_(pa.int64()))], ["_id", "_s", "spans"])


def removed_spans(docs: DataFrame) -> DataFrame:
    """(_id, _s, spans): of each document with repeated windows the ranges they cover, by blocks, two numbers each."""
    block = F.shiftright("pos", 8 + BLOCK).alias("block")
    runs = repeated_runs(docs).groupBy(F.col("doc_id").alias("_id"), F.col("sum").alias("_s"), block).agg(F.collect_list("pos").alias("runs"))
    blocks = python_map(runs.select("_id", "_s", "runs"), _spans, "_id long, _s long, spans array<long>")
    return blocks.groupBy("_id", "_s").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _finish(with_text: bool):
    def scan(batch):
        removed, spans, sha, kept = [], [], [], []
        texts = _raw(batch.column("_text"))
        for n, text, whole, runs in zip(batch.column("n_bytes").to_pylist(), texts, batch.column("sha").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if not runs:
                removed.append(0), spans.append(0), sha.append(whole), kept.append(text)
                continue
            both = np.array(runs, dtype=np.int64)
            found = _merged(both[0::2], both[1::2])
            gone = int((found[1::2] - found[0::2]).sum())
            left = b""
            if gone < n:
                edges = [0, *found.tolist(), n]
                left = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            removed.append(gone), spans.append(len(found) // 2), sha.append(hashlib.sha256(left).hexdigest()), kept.append(left)
        cols = {"n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha)}
        if with_text:
            cols["kept_text"] = pa.array([k.decode("utf-8", "ignore") for k in kept])
        extra = batch.drop_columns(["_text", "sha", "spans"])
        yield pa.RecordBatch.from_arrays([*extra.columns, *cols.values()], [*extra.schema.names, *cols])

    return scan


def _slim(words: np.ndarray | None):
    """Adds size and digest; drops texts that are surely not needed again."""

    def scan(batch):
        texts = _raw(batch.column("_text"))
        sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
        size = pa.array([len(t) for t in texts], pa.int64())
        if words is not None:
            need = in_bitmap(words, batch.column("h").to_numpy())
            text = pa.array([t.decode() if k else None for t, k in zip(texts, need, strict=True)], pa.string())
        else:
            text = batch.column("_text")
        extra = batch.drop_columns(["_text", "h"])
        yield pa.RecordBatch.from_arrays([*extra.columns, text, size, sha], [*extra.schema.names, "_text", "n_bytes", "sha"])

    return scan


def remove_repeats(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, n_bytes, n_removed, n_spans, kept_sha256, and with_text the
    remaining bytes as kept_text (a character that a cut split is left out)."""
    docs = docs.select("doc_id", "text", *carry)
    runs = stash(removed_spans(docs), "sfx-runs")
    words = None if with_text else bitmap(runs.select(F.xxhash64("_id").alias("h")), "h")
    rest = _keyed(docs).withColumn("h", F.xxhash64("doc_id"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    slim = python_map(rest.select("doc_id", *carry, "_sum", "_text", "h"), _slim(words), f"{fields}, _sum long, _text string, n_bytes long, sha string")
    both = slim.join(runs, F.equal_null("doc_id", "_id") & (F.col("_sum") == F.col("_s")), "left").drop("_id", "_s", "_sum")
    return python_map(both, _finish(with_text), f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
