"""Best-fit packing by a linear grouping scheme.

Texts become ids (byte-level BPE, then id 2); only documents over CAPACITY ids are cut, into CAPACITY-id pieces
of which the first may be shorter. What is planned is the histogram of piece lengths, at most CAPACITY
numbers whatever the corpus:

1. lengths over a bound (the best of SMALLS) are put in groups of equal cardinality, longest first, and rounded up to the longest of
   their group;
2. configurations of a few group sizes (the largest left, and the three that fill the rest best) are taken as often as
   the groups allow, so each exhausts a group;
3. actual lengths replace the rounded ones, which leaves known gaps;
4. lengths up to the bound go, longest first, into the tightest gap that holds them.

The plan says for ranks [from, from + count) of a length which sequences and which offset they get. Ranks are
dealt in parallel: each task numbers its own pieces of a length, and a sum over tasks offsets them. Neither
texts nor ids are shuffled unless asked for.

Null text counts as empty: one id (2), one piece. Repeated rows are separate documents, rows without doc_id too. An empty table gives no
pieces. Of the columns only doc_id and text are read, so others may have any names. Ties between plans go to the first bound of
SMALLS. Long texts are encoded in stretches of about STRETCH characters, cut where no token crosses; memory then is four bytes an id and what one word takes.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import python_map, stash

CAPACITY, GROUPS, END = 1024, 512, 2
#: Bounds between small and large lengths that are tried; the plan with the fewest sequences is taken.
SMALLS = (48, 128, 256, 384, 512)
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: White space of the tokenizer's pattern. Its search backtracks over a run of it, so a run of LONG is not left to the pattern.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG, STRETCH = 4096, 1 << 20
_LONG_RUN, _BOUNDARY = re.compile(f"{_SPACE}{{{LONG},}}"), re.compile(f"(?<!{_SPACE}){_SPACE}")
_encoders: dict[str, object] = {}


def encoder(ranks_path: str, pattern: str):
    """A tiktoken encoding of the ranks, one a process."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


def _stretches(text: str):
    """(stretch, whether it is one run of white space that is one word of the pattern). No word spans a place where white space
    begins, and of a run of it all but the last character are one word if more text follows, the whole run if not."""
    at = 0
    for run in _LONG_RUN.finditer(text):
        begin, end = run.span()
        end -= end < len(text)
        yield text[at:begin], False
        yield text[begin:end], True
        at = end
    yield text[at:], False


def _encoded(text: str, enc):
    for part, run in _stretches(text):
        if run:
            yield np.array(enc._encode_single_piece(part), dtype="<u4")
            continue
        at = 0
        while at < len(part):
            cut_at = _BOUNDARY.search(part, at + STRETCH) if len(part) - at > STRETCH else None
            end = cut_at.start() if cut_at else len(part)
            yield np.array(enc.encode_ordinary(part[at:end]), dtype="<u4")
            at = end


def token_ids(text: str, enc) -> np.ndarray:
    """The ids that the JSON form of the tokenizer gives, where SPECIAL is one id."""
    if len(text) < LONG and SPECIAL not in text:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    out = [np.zeros(0, dtype="<u4")]
    for i, part in enumerate(text.split(SPECIAL)):
        if i:
            out.append(np.array([SPECIAL_ID], dtype="<u4"))
        out += _encoded(part, enc)
    return np.concatenate(out)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(ranks_path: str, pattern: str, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(token_ids(text or "", enc), END).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids))):
                    raw = ids[s : s + n].tobytes()
                    for col, v in zip(cols, (i, k, s, n, zlib.crc32(raw), seen[n], part, raw), strict=True):
                        col.append(v)
                    seen[n] += 1
            if not cols[0]:
                continue
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [batch.column("doc_id").take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:7], types, strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def group_lengths(counts: dict[int, int], groups: int) -> dict[int, list[list[int]]]:
    """Rounded size -> [[length, count], ...], longest first."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: dict[int, list[list[int]]] = {}
    size, room = 0, 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                size, room = length, each
            k = min(n, room)
            members = out.setdefault(size, [])
            if members and members[-1][0] == length:
                members[-1][1] += k
            else:
                members.append([length, k])
            n, room = n - k, room - k
    return out


def configurations(sizes: dict[int, int], capacity: int):
    """Yields (sizes of one sequence, times) until sizes is used up."""
    left = dict(sizes)
    have = np.zeros(capacity + 1, dtype=bool)
    have[list(left)] = True
    below = np.zeros(capacity + 1, dtype=np.int64)  # the largest size at most that

    def refresh():
        below[:] = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))

    refresh()

    def largest(rest: int, config: list[int]) -> int:
        """The largest size up to rest that is left besides config."""
        s = int(below[rest])
        while s and left[s] <= config.count(s):
            s = int(below[s - 1])
        return s

    def best_three(rest: int) -> list[int]:
        found = [int(below[rest])]
        if 0 < found[0] < rest:
            x = np.flatnonzero(have[: rest + 1])
            two = x + below[rest - x]
            i = int(two.argmax())
            best = max(found[0], int(two[i]))
            if best > found[0]:
                found = [int(x[i]), int(below[rest - x[i]])]
            if best < rest:
                y = rest - x[:, None] - x[None, :]
                three = np.where(y >= 0, rest - y + below[np.maximum(y, 0)], 0)
                i, j = divmod(int(three.argmax()), len(x))
                if three[i, j] > best:
                    found = [int(x[i]), int(x[j]), int(below[rest - x[i] - x[j]])]
        return [f for f in found if f]

    while left:
        config = [max(left)]
        rest = capacity - config[0]
        while (s := largest(rest, config)) and rest > 3 * s:
            config.append(s)
            rest -= s
        last = best_three(rest)
        if all(left[s] >= (config + last).count(s) for s in last):
            config += last
        else:  # it asks for a size more often than there are
            while s := largest(rest, config):
                config.append(s)
                rest -= s
        times = min(left[s] // config.count(s) for s in config)
        yield config, times
        for s in config:
            left[s] -= times
            if not left[s]:
                del left[s]
                have[s] = False
                refresh()


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALLS[0], groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, count, first sequence, offset), and the number of sequences."""
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # room -> [first sequence, count]
    n_seq = 0

    def place(length: int, count: int, seq: int, offset: int) -> None:
        rows.append((length, used[length], count, seq, offset))
        used[length] += count

    members = group_lengths({k: v for k, v in counts.items() if k > small}, groups)
    for config, times in configurations({s: sum(n for _, n in m) for s, m in members.items()}, capacity):
        done = 0
        while done < times:
            firsts: list[list[int]] = []
            for s in config:
                firsts.append(next(m for m in members[s] if m[1] > sum(f is m for f in firsts)))
            run = min(times - done, *(m[1] // sum(f is m for f in firsts) for m in firsts))
            offset = 0
            for m in firsts:
                place(m[0], run, n_seq, offset)
                offset += m[0]
                m[1] -= run
            for s in set(config):
                members[s] = [m for m in members[s] if m[1]]
            if offset < capacity:
                gaps[capacity - offset].append([n_seq, run])
            n_seq += run
            done += run
    for length in sorted((k for k in counts if k <= small), reverse=True):
        n = counts[length]
        while n:
            room = next((r for r in range(length, capacity + 1) if gaps.get(r)), None)
            if room is None:
                gaps[capacity].append([n_seq, -(-n // (capacity // length))])
                n_seq += gaps[capacity][-1][1]
                continue
            seq, count = gaps[room].pop()
            k = min(n, count)
            place(length, k, seq, capacity - room)
            if k < count:
                gaps[room].append([seq + k, count - k])
            if room > length:
                gaps[room - length].append([seq, k])
            n -= k
    out = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return out, n_seq


def _assign(planned: np.ndarray):
    keys = (planned[:, 0] << 48) + planned[:, 1]

    def scan(batch):
        length = batch.column("length").to_numpy()
        rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
        at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
        seq = planned[at, 3] + rank - planned[at, 1]
        rest = batch.drop_columns(["nth", "before"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(seq), pa.array(planned[at, 4])], [*rest.schema.names, "sequence_id", "offset"])

    return scan


def pack(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids the
    ids as little-endian unsigned 32-bit bytes."""
    more = ", ids binary" * with_ids
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_pieces(ranks_path, pattern, with_ids), f"{fields}, nth long, part long{more}"), "pack-pieces")
    each = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    each = stash(each, "pack-counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned, _ = min((plan(counts, small=small) for small in SMALLS), key=lambda found: found[1])
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("length", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    rows = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "nth", "before")
    return python_map(rows, _assign(planned), f"{fields}{more}, sequence_id long, offset long")
