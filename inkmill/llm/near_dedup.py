"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct 5-word shingles; documents link when 100 * |A & B| >= 75 * |A | B|.
Documents of equal words (by SHA-256 of them) are collapsed first. In each of TREES independent trees a node branches its documents by one or two selected
minwise tokens (4/3 on average, the reciprocal of the threshold, so that a pair at the threshold keeps
one common child on average). A node of up to SMALL documents is compared exhaustively on 128-coordinate
sketches; a larger one compares its documents with its smallest, and branches again unless that reaches
all of them, however deep that goes. Nodes report no pairs but a star for each group of documents that the
sketches can't tell apart at 4.5 standard deviations below the threshold.

The components of those stars hold every link that a tree has met. Each component comes together once, with whole texts, and its
links are confirmed on full shingle sets, one search from each document over those not yet reached. Hashes can only refute a link;
what they propose is settled by the words of the common shingles, byte by byte (``Sets``). Components over GATHER
documents or GATHER_BYTES of text are not gathered: their trees are run again down to nodes of CROWDED
documents, and candidate pairs are confirmed by the same sets in joins in rounds, the likeliest first, until each is confirmed, refuted or
within one component. The two ways differ only in which pairs they try: a gathered component all that the sketches leave, a
crowded one those that met in a node; tests measure the recall of both on thousands of pairs of similarity 0.75 to 0.8.

A pair at the threshold shares a first-level node in one tree with probability 0.81 and a third-level one with about 0.6,
so 16 trees miss it with probability of 2e-12 to 4e-7, and the sketches with 3e-6. The size of a set counts 64-bit hashes.

Null and empty texts have no shingles and link with nothing; texts of fewer than five words are one shingle. Rows of equal doc_id count as
one document for linking, and each is returned; rows without doc_id link with nothing. The smallest doc_id names a component, so there are
no ties. An empty table gives no rows; only doc_id and text are read, so other columns may have any names. Long texts are hashed in
stretches of STRETCH bytes. Hot nodes and hubs go through ``attach``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, bitmap, components, in_bitmap, python_map, stash
from .rolling import U, _splitmix, chunks, mix
from .words import Words, folded

WORDS, PERCENT = 5, 75
COORDS, TREES, SMALL, CROWDED = 128, 16, 4096, 32
GATHER, GATHER_BYTES = 20_000, 16 << 20
SURE_OUT = 0.58
#: Equal coordinates that an estimate of SURE_OUT takes.
LEAST = int(np.ceil((SURE_OUT * (1 - 1 / 256) + 1 / 256) * COORDS))
OVERLAP_BYTES, FEW = 64 << 20, 64
_MUL = _splitmix(0xA4093822299F31D0, COORDS) | U(1)
_XOR = _splitmix(0x082EFA98EC4E6C89, COORDS)
_CHUNK = 1 << 20


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text."""
    out = []
    for lo, hi in chunks([len(t) for t in texts], _CHUNK):
        out += [np.unique(h) for _, h in Words(texts[lo:hi]).shingles(k)]
    return out


class Sets:
    """The shingle sets of some texts. Sizes of intersections are proposed by hashes and settled word by word."""

    def __init__(self, texts: list[bytes], k: int = WORDS):
        self.words, self.k = Words(texts), k
        self.hashes: list[np.ndarray] = []  # sorted, each once
        self.places: list[np.ndarray] = []  # a shingle's first word
        self.clean: list[bool] = []  # shingles of one hash are equal, within the text
        for i, (first, h) in enumerate(self.words.shingles(k)):
            order = np.argsort(h, kind="stable")
            h, at = h[order], first[order].astype(np.int32)
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            kept, again = np.flatnonzero(new), np.flatnonzero(~new)
            self.clean.append(bool(self.same(i, at[again], i, at[kept[np.cumsum(new)[again] - 1]]).all()))
            self.hashes.append(h[kept])
            self.places.append(at[kept])
        self.words.hashes = None

    def same(self, i: int, p: np.ndarray, j: int, q: np.ndarray) -> np.ndarray:
        """Whether the shingles that begin at words p of text i and q of text j are equal."""
        ok = np.ones(len(p), dtype=bool)
        for k in range(self.k):
            there, too = p + k < self.words.edges[i + 1], q + k < self.words.edges[j + 1]
            ok &= there == too
            both = np.flatnonzero(ok & there)
            ok[both] = self.words.equal(p[both] + k, q[both] + k)
        return ok

    def plain(self, i: int) -> set:
        """The set itself, where two shingles of a text have one hash."""
        lo, hi = int(self.words.edges[i]), int(self.words.edges[i + 1])
        w = [self.words.word(x) for x in range(lo, hi)]
        return {tuple(w[x : x + self.k]) for x in range(len(w) - self.k + 1)} if len(w) >= self.k else {tuple(w)} if w else set()

    def sizes(self, i: int, j: int, percent: int = 0) -> tuple[int, int]:
        """(intersection, union); if hashes alone show that they are below percent, their sizes by hashes."""
        if not (self.clean[i] and self.clean[j]):
            a, b = self.plain(i), self.plain(j)
            return len(a & b), len(a | b)
        a, b = (i, j) if len(self.hashes[i]) >= len(self.hashes[j]) else (j, i)
        if not len(self.hashes[a]):
            return 0, 0
        at = np.searchsorted(self.hashes[a], self.hashes[b])
        at[at == len(self.hashes[a])] = 0
        hit = np.flatnonzero(self.hashes[a][at] == self.hashes[b])
        both, total = len(hit), len(self.hashes[a]) + len(self.hashes[b])
        if both and 100 * both >= percent * (total - both):
            both = int(self.same(a, self.places[a][at[hit]], b, self.places[b][hit]).sum())
        return both, total - both

    def linked(self, i: int, j: int) -> bool:
        both, union = self.sizes(i, j, PERCENT)
        return both > 0 and 100 * both >= PERCENT * union


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDS minwise values of a set, 32 bits each."""
    best = np.full(COORDS, np.iinfo(U).max, dtype=U)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 4096):
            part = shingles[lo : lo + 4096]
            best = np.minimum(best, ((part[:, None] ^ _XOR) * _MUL).min(axis=0))
    return best >> U(32)


def _chosen(node: np.ndarray):
    """Coordinates that a node branches by: one, and for a third of nodes another."""
    h = mix(node ^ U(0x452821E638D01377))
    first = (h % U(COORDS)).astype(np.int64)
    second = (first + 1 + ((h >> U(16)) % U(COORDS - 1)).astype(np.int64)) % COORDS
    return first, second, (h >> U(40)) % U(3) == 0


def _child(node: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(node + (coord.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)) ^ value.astype(U))


_ROOTS = mix(_splitmix(0xBE5466CF34E90C6C, TREES))
_C1, _C2, _TWO = _chosen(_ROOTS)
_FIRST_COORD = np.concatenate([_C1, _C2[_TWO]])
_FIRST_ROOT = np.concatenate([_ROOTS, _ROOTS[_TWO]])


def _signatures(batch):
    ids = batch.column(0)
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    n, digests, nodes, sketches = [], [], [], []
    for text, s in zip(texts, shingle_sets([t or b"" for t in texts]), strict=True):
        n.append(len(s))
        digest = hashlib.sha256()
        for part in folded(text or b""):
            digest.update(part)
        digests.append(digest.digest()[:20])
        if len(s):
            sig = signature(s)
            nodes.append(_child(_FIRST_ROOT, _FIRST_COORD, sig[_FIRST_COORD]).view(np.int64))
            sketches.append((sig & U(255)).astype(np.uint8).tobytes())
        else:
            nodes.append(None), sketches.append(None)
    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests), pa.array(nodes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "words", "nodes", "sketch"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint8).reshape(-1, COORDS)


def _estimate(same: np.ndarray) -> np.ndarray:
    return (same / COORDS - 1 / 256) / (1 - 1 / 256)


def _rows(ids: pa.Array, owner, node, sketches: pa.Array):
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), ids.take(take), sketches.take(take)], ["node", "doc_id", "sketch"])


_NODE = "node long, doc_id long, sketch binary"


def _first_level(seen):
    def scan(batch):
        nodes = batch.column("nodes")
        flat = nodes.flatten().to_numpy()
        owner = np.repeat(np.arange(batch.num_rows), len(_FIRST_COORD))
        ok = in_bitmap(seen, flat)
        yield _rows(batch.column("doc_id"), owner[ok], flat[ok], batch.column("sketch"))

    return scan


def _in_nodes(seen):
    def scan(batch):
        yield batch.filter(pa.array(in_bitmap(seen, batch.column("node").to_numpy())))

    return scan


def _branch(batch):
    """Children of the nodes of a batch (node, doc_id, sketch)."""
    node = batch.column("node").to_numpy().view(U)
    sketch = _matrix(batch.column("sketch"))
    c1, c2, two = _chosen(node)
    i = np.arange(len(node))
    owner = np.concatenate([i, i[two]])
    child = np.concatenate([_child(node, c1, sketch[i, c1]), _child(node[two], c2[two], sketch[i[two], c2[two]])])
    yield _rows(batch.column("doc_id"), owner, child, batch.column("sketch"))


def _stars_within(batch):
    """A star from the smallest document of each group that sketches join, for nodes given as lists of (doc_id, sketch)."""
    a, b = [], []
    for group in batch.column("members"):
        ids = group.values.field("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], _matrix(group.values.field("sketch"))[order]
        across = np.ascontiguousarray(m.T)  # a row per coordinate of those in rest, the reached ones too until half are
        rest, left = np.arange(len(ids)), np.ones(len(ids), dtype=bool)
        while left.any():
            hub = rest[np.argmax(left)]
            left[np.argmax(left)] = False
            queue = [hub]
            while queue and left.any():
                near = left & ((across == m[queue.pop()][:, None]).view(np.uint8).sum(axis=0, dtype=np.uint8) >= LEAST)
                found = rest[near]
                queue += found.tolist()
                left &= ~near
                found = found[ids[found] != ids[hub]]
                a.append(np.full(len(found), ids[hub])), b.append(ids[found])
            if 2 * np.count_nonzero(left) < len(left):
                rest, across, left = rest[left], np.ascontiguousarray(across[:, left]), left[left]
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])


class _Overlaps:
    """Sizes of the intersections of one set with many, by hashes: a bit for each hash that two sets or more have, and what sets have of
    none other left out. bits is None where that takes over OVERLAP_BYTES; then only the hashes' numbers are held."""

    def __init__(self, hashes: list[np.ndarray]):
        size = np.array([len(h) for h in hashes])
        _, number, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = count[number] > 1
        owner, self.number = np.repeat(np.arange(len(size)), size)[often], (np.cumsum(count > 1) - 1)[number[often]]
        self.edges = np.searchsorted(owner, np.arange(len(size) + 1))
        self.many = int((count > 1).sum())
        width = self.many // 64 + 1
        self.bits = None
        if len(size) * width * 8 <= OVERLAP_BYTES:
            self.bits = np.zeros((len(size), width), dtype=U)
            np.bitwise_or.at(self.bits, (owner, self.number >> 6), U(1) << (self.number & 63).astype(U))

    def of(self, u: int, rest: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[rest] & self.bits[u]).sum(axis=1, dtype=np.int64)
        mine = np.zeros(self.many, dtype=bool)
        mine[self.number[self.edges[u] : self.edges[u + 1]]] = True
        upto = np.concatenate([[0], np.cumsum(mine[self.number])])
        return upto[self.edges[rest + 1]] - upto[self.edges[rest]]


def _exact_components(ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The smallest linked id of each document, by full sets."""
    order = np.argsort(ids, kind="stable")
    sets = Sets([texts[i] for i in order.tolist()])
    size, clean, ids_of = np.array([len(h) for h in sets.hashes]), np.array(sets.clean), ids[order]
    overlaps = _Overlaps(sets.hashes)
    if overlaps.bits is None:
        m = np.stack([(signature(h) & U(255)).astype(np.uint8) for h in sets.hashes])
    out = ids.copy()
    rest = np.arange(len(ids))
    while len(rest):
        hub, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            some = np.arange(len(rest))
            if overlaps.bits is None:
                some = np.flatnonzero((100 * np.minimum(size[rest], size[u]) >= PERCENT * np.maximum(size[rest], size[u])) & ((m[rest] == m[u]).sum(axis=1) >= LEAST))
            if overlaps.bits is not None or len(some) > FEW:
                both = overlaps.of(u, rest[some])
                maybe = (both > 0) & (100 * both >= PERCENT * (size[rest[some]] + size[u] - both))
                some = some[maybe | ~clean[rest[some]] | ~clean[u] | (ids_of[rest[some]] == ids_of[u])]
            hit = [i for i in some.tolist() if ids_of[rest[i]] == ids_of[u] or sets.linked(u, rest[i])]
            found = rest[hit]
            queue += found.tolist()
            out[order[found]] = ids_of[hub]
            rest = np.delete(rest, hit)
    return out


def _gathered(batches):
    """Exact components of partitions sorted by root, each root's rows together."""
    held: list[tuple[int, bytes]] = []
    root = None

    def done():
        ids = np.array([h[0] for h in held], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_exact_components(ids, [h[1] for h in held]))], ["node", "root"])

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for r, i, t in zip(part.column("root").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if r != root and held:
                    yield done()
                    held = []
                root = r
                held.append((i, t))
    if held:
        yield done()


def _pairs_within(batch):
    """Candidate pairs of crowded components' nodes, one list of (doc_id, sketch) a row."""
    a, b, est = [], [], []
    for group in batch.column("members"):
        ids = group.values.field("doc_id").to_numpy()
        m = _matrix(group.values.field("sketch"))
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        i, j = np.triu_indices(len(ids), 1)
        e = _estimate((m[i] == m[j]).sum(axis=1))
        ok = (e >= SURE_OUT) & (ids[i] != ids[j])
        a.append(ids[i[ok]]), b.append(ids[j[ok]]), est.append(e[ok])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, est)], ["a", "b", "est"])


def _with_hub(batch):
    e = _estimate((_matrix(batch.column("sketch")) == _matrix(batch.column("hub_sketch"))).sum(axis=1))
    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), batch.column("doc_id"), pa.array(e)], ["node", "a", "b", "est"])


def _pairs_with_hub(batch):
    e = _estimate((_matrix(batch.column("sketch")) == _matrix(batch.column("hub_sketch"))).sum(axis=1))
    a, b = batch.column("hub").to_numpy(), batch.column("doc_id").to_numpy()
    ok = (e >= SURE_OUT) & (a != b)
    yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(e[ok])], ["a", "b", "est"])


_PAIR = "a long, b long, est double"


def _confirm(batch):
    a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
    left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
    of: dict[tuple, list[int]] = {}
    for i in range(len(a)):
        of.setdefault((int(a[i]), left[i]), []).append(i)
    ok = np.zeros(len(a), dtype=bool)
    for (_, text), rows in of.items():
        for lo, hi in chunks([len(right[i]) for i in rows], _CHUNK):
            sets = Sets([text, *(right[i] for i in rows[lo:hi])])
            ok[rows[lo:hi]] = [sets.linked(0, 1 + n) for n in range(hi - lo)]
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ok)], ["a", "b", "ok"])


def _wanted(words):
    def scan(batch):
        yield batch.filter(pa.array(in_bitmap(words, batch.column("h").to_numpy()))).select(["doc_id", "text"])

    return scan


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ok) of pairs, on full sets."""
    ends = pairs.select(F.col("a").alias("i")).union(pairs.select("b"))
    words = bitmap(ends.select(F.xxhash64("i").alias("h")), "h")
    texts = python_map(docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")), _wanted(words), "doc_id long, text string")
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = attach(left, hubs, ["a"], "k", pairs.count())
    out = python_map(both.select("a", "b", "text_a", "text_b"), _confirm, "a long, b long, ok boolean")
    return stash(out.groupBy("a", "b").agg(F.max("ok").alias("ok")), "near-verified")


def _named(df: DataFrame, roots: DataFrame | None, column: str, out: str) -> DataFrame:
    """Adds the root of column (itself where it has no link)."""
    if roots is None:
        return df.withColumn(out, F.col(column))
    r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(r, F.col(column) == F.col("_n"), "left").withColumn(out, F.coalesce("_r", column)).drop("_n", "_r")


def _settle(docs: DataFrame, cand: DataFrame, links: DataFrame | None, checked: DataFrame | None, roots: DataFrame | None):
    """Confirms candidates until each is confirmed, refuted or within one component."""
    most = 1
    if checked is not None:
        cand = cand.join(checked, ["a", "b"], "left_anti")
    while True:
        named = _named(_named(cand, roots, "a", "ra"), roots, "b", "rb")
        cand = stash(named.where("ra <> rb").select("a", "b", "est"), "near-open")
        if cand.isEmpty():
            return links, checked, roots
        best = Window.partitionBy("b").orderBy(F.desc("est"), "a")
        picked = stash(cand.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).select("a", "b"), "near-picked")
        found = _verified(docs, picked)
        cand = cand.join(found.select("a", "b"), ["a", "b"], "left_anti")
        new = found.where("ok").select("a", "b")
        links = new if links is None else links.union(new)
        checked = found.select("a", "b") if checked is None else checked.union(found.select("a", "b"))
        roots = components(links, "near")
        most *= 4


def _levels(reps: DataFrame, small: int):
    """Per level of the trees: rows of nodes up to small, gathered by node, and rows of larger nodes with
    their hub; the consumer sends back which of the latter branch on (node, size), or None."""
    deep = None
    while True:
        ids = reps.select("doc_id", F.explode("nodes").alias("node")) if deep is None else deep.select("doc_id", "node")
        nodes = stash(ids.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("hub")).where("size > 1"), "near-nodes")
        little = nodes.where(F.col("size") <= small).select("node")
        level = python_map(reps, _first_level(bitmap(little, "node")), _NODE) if deep is None else deep
        few = level.join(little, "node")
        few = few.groupBy("node").agg(F.collect_list(F.struct("doc_id", "sketch")).alias("members")).select("members")
        large, crowd = nodes.where(F.col("size") > small), None
        if not large.isEmpty():
            hubs = reps.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("hub_sketch"))
            large = stash(large.join(hubs, "hub"), "near-hubs")
            # rows of small nodes, most of all, stay out of the dealing
            level = python_map(reps if deep is None else deep, (_first_level if deep is None else _in_nodes)(bitmap(large, "node")), _NODE)
            crowd = stash(attach(level, large, ["node"], "size", large.agg(F.sum("size")).first()[0]), "near-crowd")
        on = yield few, crowd
        if crowd is None or on is None or on.isEmpty():
            return
        deep = attach(crowd.select("node", "doc_id", "sketch"), on, ["node"], "size", on.agg(F.sum("size")).first()[0])
        deep = stash(python_map(deep.select("node", "doc_id", "sketch"), _branch, _NODE), "near-level")


def _star_edges(reps: DataFrame) -> DataFrame:
    edges, on = [], None
    levels = _levels(reps, SMALL)
    try:
        while True:
            few, crowd = levels.send(on)
            edges.append(stash(python_map(few, _stars_within, "a long, b long").distinct(), "near-stars"))
            on = None
            if crowd is not None:
                close = stash(python_map(crowd.select("node", "doc_id", "sketch", "hub", "hub_sketch"), _with_hub, "node long, a long, b long, est double"), "near-hub-stars")
                edges.append(close.where(F.col("est") >= SURE_OUT).select("a", "b").where("a <> b"))
                unlike = close.groupBy("node").agg(F.min("est").alias("est"), F.count(F.lit(1)).alias("size"))
                on = stash(unlike.where(F.col("est") < SURE_OUT).select("node", "size"), "near-unlike")
    except StopIteration:
        pass
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def _crowded(docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Roots of documents whose components can't be gathered."""
    links = checked = roots = on = None
    levels = _levels(reps, CROWDED)
    try:
        while True:
            few, crowd = levels.send(on)
            cand = python_map(few, _pairs_within, _PAIR)
            if crowd is not None:
                cand = cand.union(python_map(crowd.select("doc_id", "sketch", "hub", "hub_sketch"), _pairs_with_hub, _PAIR))
            cand = stash(cand.groupBy("a", "b").agg(F.max("est").alias("est")), "near-cand")
            links, checked, roots = _settle(docs, cand, links, checked, roots)
            on = None
            if crowd is not None:
                named = _named(crowd.select("node", "doc_id"), roots, "doc_id", "root")
                on = named.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
                on = stash(on.select("node", "size"), "near-unlike")
    except StopIteration:
        pass
    return roots


def _joined(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, root) of documents that have links."""
    roots = components(_star_edges(reps), "near")
    sized = docs.where("doc_id is not null and text is not null").select("doc_id", F.octet_length("text").alias("bytes"))
    sizes = roots.join(sized, roots["node"] == sized["doc_id"]).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    sizes = stash(sizes, "near-sizes")
    fits = (F.col("n") <= GATHER) & (F.col("bytes") <= GATHER_BYTES)
    roots = stash(attach(roots, sizes.select("root", "n", fits.alias("fits")), ["root"], "n", roots.count()), "near-roots")
    words = bitmap(roots.select(F.xxhash64("node").alias("h")), "h")
    texts = python_map(docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")), _wanted(words), "doc_id long, text string")
    members = texts.join(roots.where("fits").withColumnRenamed("node", "doc_id"), "doc_id").select("root", "doc_id", "text")
    found = members.repartition("root").sortWithinPartitions("root", "doc_id").mapInArrow(_gathered, "node long, root long")
    found = stash(found.groupBy("node").agg(F.min("root").alias("root")), "near-exact")
    rest = roots.where("not fits").select(F.col("node").alias("doc_id"))
    if not rest.isEmpty():
        more = _crowded(docs, stash(reps.join(rest, "doc_id", "left_semi"), "near-rest"))
        found = found if more is None else found.union(more)
    return found


def near_dups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    rows = stash(python_map(docs, _signatures, "doc_id long, n_shingles long, words binary, nodes array<long>, sketch binary"), "near-rows")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    groups = some.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"))
    groups = stash(groups, "near-groups")
    roots = _joined(docs, groups.select(F.col("rep").alias("doc_id"), "nodes", "sketch"))
    several = some.groupBy("doc_id").agg(F.min(F.xxhash64("words")).alias("lo"), F.max(F.xxhash64("words")).alias("hi")).where("lo <> hi").select("doc_id")
    if not several.isEmpty():  # texts of one doc_id belong together
        more = some.join(several, "doc_id", "left_semi").join(groups, "words").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        roots = components(roots.toDF("a", "b").union(more), "near")
    classes = _named(groups.select("words", "rep", "size"), roots, "rep", "component_id").select("words", "size", "component_id")
    done = attach(some.select("doc_id", "n_shingles", "words"), classes, ["words"], "size", rows.count())
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = done.select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.equal_null("doc_id", "component_id"))
