"""SentencePiece sampling and decoding.

A text becomes units that no piece crosses (a run of spaces with the word after it, or one line end). Over the lattice of pieces
within a unit, forward filtering sums the probability of every way to a position, and backward sampling draws
pieces from the end, each in proportion to the ways through it; so segmentations are drawn exactly in proportion to
the product of their pieces' probabilities to the power of alpha. The draw at a position depends on the row key and the position
only, so a row is segmented alike in any batch, task or retry. Pieces have the probability 1 / (rank + 1) of the model's
order. Characters without a piece become byte pieces, U+2581 too, so decoding gives back every text exactly.

Null counts as empty, which has no pieces. Equal rows with one key are segmented alike, with other keys
independently; rows without doc_id have one key. An empty table gives no rows. Of documents only doc_id and text are read, so other columns may have any
names. Long texts go in stretches of units; of a unit over LONG_UNIT characters only the forward sums are kept, and its lattice is built
again in blocks on the way back.
"""

from __future__ import annotations

import array
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_map
from .rolling import U, chunks, mix

ALPHA, LONGEST = 1.0, 16
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_CHUNK = 4 << 20
LONG_UNIT, BLOCK, STRETCH = 1 << 12, 1 << 15, 1 << 20
_models: dict[str, Pieces] = {}


class Pieces:
    """Pieces of a model: hash -> id and score, with spaces for the model's space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        rows = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.bytes_of.append(text.encode())
                if len(text) <= LONGEST and _UNIT.fullmatch(text):
                    rows.append((text, i))
        rank = np.empty(len(rows))
        rank[np.argsort([-model.get_score(i) for _, i in rows], kind="stable")] = np.arange(len(rows))
        self.begins = np.zeros(1 << 20, dtype=bool)
        lengths = np.array([len(t) for t, _ in rows])
        points = np.frombuffer("".join(t.ljust(LONGEST) for t, _ in rows).encode("utf-32-le"), dtype=np.uint32).reshape(-1, LONGEST).astype(U)
        h = np.zeros(len(rows), dtype=U)
        for k in range(LONGEST):
            going = np.flatnonzero(lengths > k)
            h[going] = self.step(h[going], points[going, k])
            self.begins[h[going] >> U(44)] = True
        order = np.argsort(h)
        self.hashes, self.ids, self.scores = h[order], np.array([i for _, i in rows], dtype=np.int32)[order], -np.log(rank[order] + 1)
        self.worst = float(self.scores.min()) - 5
        top = (self.hashes >> U(44)).astype(np.int64)  # pieces with one 20-bit prefix stand together
        self.slot = np.full(1 << 20, len(top), dtype=np.int32)
        self.slot[top[::-1]] = np.arange(len(top) - 1, -1, -1)
        self.same_slot = int(np.bincount(top).max())
        self.padded = np.concatenate([self.hashes, np.zeros(self.same_slot + 1, dtype=U)])

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h * U(0x9E3779B97F4A7C15) + c + U(1))

    def hash_text(self, text: str) -> int:
        h = np.zeros(1, dtype=U)
        for c in text:
            h = self.step(h, np.array([ord(c)], dtype=U))
        return int(h[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of h that are pieces, their index)."""
        at = self.slot[(h >> U(44)).astype(np.int64)]
        ok = self.padded[at] == h
        for k in range(1, self.same_slot):
            more = np.flatnonzero(~ok & (at < len(self.hashes)))
            hit = more[self.padded[at[more] + k] == h[more]]
            at[hit] += k
            ok[hit] = True
        rows = np.flatnonzero(ok)
        return rows, at[rows]


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def lattice(p: Pieces, chars: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """For units of equal length (rows of code points): cumulative probabilities of the length of the piece that
    ends at each position, and ids; unknown characters have minus their code point as id."""
    n, size = chars.shape
    width = min(size, LONGEST)
    score = np.full((n, size, width), -np.inf, dtype=np.float32)  # by end and length
    ids = np.zeros((n, size, width), dtype=np.int32)
    for start in range(size):
        h, alive = np.zeros(n, dtype=U), np.arange(n)
        for k in range(min(width, size - start)):
            h = p.step(h, chars[alive, start + k].astype(U))
            more = p.begins[h >> U(44)]  # others begin no piece
            h, alive = h[more], alive[more]
            if not len(alive):
                break
            rows, at = p.find(h)
            rows = alive[rows]
            score[rows, start + k, k] = alpha * p.scores[at]
            ids[rows, start + k, k] = p.ids[at]
    none = np.isneginf(score[:, :, 0])
    width_of = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    score[:, :, 0] = np.where(none, alpha * p.worst * width_of, score[:, :, 0])
    ids[:, :, 0] = np.where(none, -chars, ids[:, :, 0])
    total = np.zeros((n, size + 1), dtype=np.float64)
    cum = np.zeros((n, size, width), dtype=np.float32)
    for end in range(size):
        k = min(width, end + 1)
        ways = score[:, end, :k] + total[:, end - np.arange(k)]
        top = ways.max(axis=1)
        prob = np.exp(ways - top[:, None])
        mass = prob.sum(axis=1)
        total[:, end + 1] = top + np.log(mass)
        cum[:, end, :k] = np.cumsum(prob / mass[:, None], axis=1)
        last = k - 1 - (score[:, end, :k][:, ::-1] > -np.inf).argmax(axis=1)
        cum[:, end, :] = np.where(np.arange(width) >= last[:, None], 1.0, cum[:, end, :])
    return cum, ids


def _uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(seed + (at.astype(U) + U(1)) * U(0xD1342543DE82EF95)) >> U(11)).astype(np.float64) / (1 << 53)


def _block(p: Pieces, chars: np.ndarray, lo: int, hi: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the pieces that end at the positions lo to hi of one unit, by end and length."""
    score = np.full((hi - lo, LONGEST), -np.inf, dtype=np.float32)
    ids = np.zeros((hi - lo, LONGEST), dtype=np.int32)
    start = np.arange(max(0, lo - LONGEST + 1), hi)
    h = np.zeros(len(start), dtype=U)
    for k in range(LONGEST):
        inside = start + k < hi
        start, h = start[inside], p.step(h[inside], chars[start[inside] + k].astype(U))
        more = p.begins[h >> U(44)]
        start, h = start[more], h[more]
        rows, at = p.find(h)
        end = start[rows] + k - lo
        score[end[end >= 0], k] = alpha * p.scores[at[end >= 0]]
        ids[end[end >= 0], k] = p.ids[at[end >= 0]]
    here = chars[lo:hi]
    none = np.isneginf(score[:, 0])
    width = 1 + (here > 0x7F) + (here > 0x7FF) + (here > 0xFFFF)
    score[:, 0] = np.where(none, alpha * p.worst * width, score[:, 0])
    ids[:, 0] = np.where(none, -here, ids[:, 0])
    return score, ids


def sample_long(p: Pieces, chars: np.ndarray, seed: np.ndarray, begin: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(ends, ids) of the sampled pieces of one unit, in memory of eight bytes a character and one block."""
    n = len(chars)
    total = array.array("d", bytes(8 * (n + 1)))
    for lo in range(0, n, BLOCK):
        score, _ = _block(p, chars, lo, min(lo + BLOCK, n), alpha)
        rows, lengths = np.nonzero(score > -np.inf)
        at = 0
        rows, lengths, values = rows.tolist(), lengths.tolist(), score[rows, lengths].astype(np.float64).tolist()
        while at < len(rows):
            end, ways = rows[at], []
            while at < len(rows) and rows[at] == end:
                if lengths[at] <= lo + end:
                    ways.append(values[at] + total[lo + end - lengths[at]])
                at += 1
            top = max(ways)
            total[lo + end + 1] = top + math.log(sum(math.exp(w - top) for w in ways))
    sums = np.frombuffer(total, dtype=np.float64)
    ends, found, end = [], [], n - 1
    for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        hi = min(lo + BLOCK, n)
        score, ids = _block(p, chars, lo, hi, alpha)
        before = np.arange(lo, hi)[:, None] - np.arange(LONGEST)
        ways = np.where(before >= 0, score + sums[np.maximum(before, 0)], -np.inf)
        prob = np.exp(ways - ways.max(axis=1, keepdims=True))
        cum = np.cumsum(prob / prob.sum(axis=1, keepdims=True), axis=1).astype(np.float32)
        last = LONGEST - 1 - (ways[:, ::-1] > -np.inf).argmax(axis=1)
        cum[np.arange(LONGEST) >= last[:, None]] = 1.0
        draw = (_uniform(seed, begin + np.arange(lo, hi))[:, None] >= cum).sum(axis=1)
        while end >= lo:
            k = int(draw[end - lo])
            ends.append(end)
            found.append(ids[end - lo, k])
            end -= k + 1
    return np.array(ends), np.array(found)


def sample(p: Pieces, texts: list[str], seeds: np.ndarray, alpha: float = ALPHA, begins: list[int] | None = None) -> list[np.ndarray]:
    """Sampled ids of each text, that begins at begins within a longer one and then has no space before it."""
    flat: list[str] = []
    counts = []
    for i, t in enumerate(texts):
        units = _UNIT.findall(t if begins and begins[i] else " " + t) if t else []
        counts.append(len(units))
        flat += units
    if not flat:
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    coded = pa.array(flat, pa.large_string()).dictionary_encode()
    unit, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    length_of = np.array([len(u) for u in words])
    owner = np.repeat(np.arange(len(texts)), counts)
    size = length_of[unit]
    begin = np.cumsum(size) - size  # in all texts
    first = np.cumsum(np.bincount(owner, size, len(texts)).astype(np.int64))
    begin_in = begin - np.concatenate([[0], first[:-1]])[owner] + np.array(begins or [0] * len(texts))[owner]
    out_at, out_id = [], []

    def points(some) -> np.ndarray:
        return np.frombuffer("".join(words[k] for k in some).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)

    for n in np.unique(length_of):
        kinds = np.flatnonzero(length_of == n)
        where = np.flatnonzero(size == n)
        if n > LONG_UNIT:
            for i in where.tolist():
                ends, ids = sample_long(p, points([unit[i]]), seeds[owner[i]], int(begin_in[i]), alpha)
                out_at.append(begin[i] + ends)
                out_id.append(ids)
            continue
        local = np.full(len(words), -1)
        local[kinds] = np.arange(len(kinds))
        most = max(1, (1 << 21) // int(n * min(n, LONGEST)))
        for lo in range(0, len(kinds), most):  # bounded tables
            some = kinds[lo : lo + most]
            cum, ids = lattice(p, points(some).reshape(len(some), n), alpha)
            by_length = np.ascontiguousarray(cum.reshape(len(some) * n, -1).T)
            ids = ids.reshape(len(some) * n, -1)
            row = local[unit[where]]
            inside = (row >= lo) & (row < lo + most)
            occ = where[inside]
            row, end = (row[inside] - lo) * n, np.full(len(occ), n - 1)
            seed, base = seeds[owner[occ]], begin_in[occ]
            while len(occ):
                u, place = _uniform(seed, base + end), row + end
                k = np.zeros(len(occ), dtype=np.int64)
                beyond = np.flatnonzero(u >= by_length[0][place])
                for share in by_length[1:]:  # of the pieces that end here the shortest come first
                    k[beyond] += 1
                    beyond = beyond[u[beyond] >= share[place[beyond]]]
                    if not len(beyond):
                        break
                out_at.append(begin[occ] + end)
                out_id.append(ids[place, k])
                end = end - k - 1
                more = end >= 0
                occ, row, end, seed, base = occ[more], row[more], end[more], seed[more], base[more]
    placed, taken = np.zeros(int(size.sum()), dtype=np.int32), np.zeros(int(size.sum()), dtype=bool)
    for at, ids in zip(out_at, out_id, strict=True):
        placed[at], taken[at] = ids, True
    ends = np.flatnonzero(taken)
    got, edges = placed[ends], np.concatenate([[0], np.searchsorted(ends, first)])
    result = []
    for i in range(len(texts)):
        ids = got[edges[i] : edges[i + 1]]
        if len(ids) and ids.min() < 0:  # characters without a piece
            ids = np.array([x for v in ids.tolist() for x in ([v] if v >= 0 else [p.byte_id[b] for b in chr(-v).encode()])], dtype=np.int32)
        result.append(ids.astype(np.int32))
    return result


def _stretches(text: str) -> list[tuple[int, str]]:
    """(begin with the space before the text counted, stretch) of about STRETCH characters, cut between units."""
    if len(text) <= STRETCH:
        return [(0, text)]
    out, at, last = [], 0, 0
    for m in _UNIT.finditer(" " + text):
        if m.end() - last >= STRETCH:
            out.append((last, text[max(0, last - 1) : m.end() - 1]))
            last = m.end()
        at = m.end()
    if at > last:
        out.append((last, text[max(0, last - 1) : at - 1]))
    return out


def decode(p: Pieces, ids) -> str:
    return p.joined(np.asarray(ids, dtype=np.int64))[1:].decode()


def _encode(path: str, alpha: float, with_ids: bool):
    def scan(batch):
        p = pieces(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        seeds = batch.column("seed").to_numpy().view(U)
        for lo, hi in chunks([len(t) for t in texts], _CHUNK):
            parts = [[(0, t)] for t in texts[lo:hi]] if hi - lo > 1 else [_stretches(texts[lo])]
            n, crc, same, ids = [0] * (hi - lo), [0] * (hi - lo), [True] * (hi - lo), [[] for _ in range(hi - lo)]
            for k in range(max(map(len, parts))):  # all texts at once, or the stretches of one
                of = [i for i, p_ in enumerate(parts) if k < len(p_)]
                got = sample(p, [parts[i][k][1] for i in of], seeds[lo:hi][of], alpha, [parts[i][k][0] for i in of])
                for i, g in zip(of, got, strict=True):
                    begin, part = parts[i][k]
                    n[i] += len(g)
                    crc[i] = zlib.crc32(g.astype("<u4").tobytes(), crc[i])
                    same[i] &= p.joined(g) == (part if begin or not part else " " + part).encode()
                    if with_ids:
                        ids[i].append(g)
            cols, names = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "lossless"]
            if with_ids:
                cols.append(pa.array([np.concatenate(g) for g in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return scan


def sample_pieces(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids_crc32, lossless (decoding gives the text back), and with_ids ids."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("seed"), "text")
    return python_map(rows, _encode(model_path, alpha, with_ids), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def scan(batch):
        p = pieces(model_path)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(p, g or []) for g in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return python_map(encoded.select("doc_id", "ids"), scan, "doc_id long, text string")
