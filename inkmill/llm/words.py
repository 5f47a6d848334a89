"""Words of many texts as arrays: places, 64-bit hashes, shingles, and comparison by bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from .rolling import U, _splitmix, mix

_WEIGHT = _splitmix(0x299F31D0082EFA98, 8) | U(1)
_MASK = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], dtype=U)
_GAP = re.compile(rb"[ \t-\r]")
LONG_WORD, STRETCH = 256, 4 << 20


def folded(text: bytes, lower: bool = True):
    """Words of a text, lower-cased (A-Z) or not, each followed by one space, in stretches of about STRETCH bytes."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        part = text[at:end]
        if words := (part.lower() if lower else part).split():
            yield b" ".join(words) + b" "
        at = end


class Words:
    """Words of texts in one buffer of normalised stretches, with a 64-bit hash of each (eight bytes at a time, mixed after each, so no
    structure of a text cancels out; words over LONG_WORD bytes by BLAKE2)."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        parts, counts = [], []
        for t in texts:
            flat = list(folded(t, lower))
            parts += flat
            counts.append(sum(map(len, flat)))
        self.data = b"".join(parts)
        buf = np.frombuffer(self.data + bytes(8), dtype=np.uint8)
        ends = np.flatnonzero(buf == 32)
        self.at = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.size = (ends - self.at).astype(np.int32)
        self.blocks = np.lib.stride_tricks.sliding_window_view(buf, 8)
        self.edges = np.searchsorted(ends, np.concatenate([[0], np.cumsum(counts)]))  # words of text i: edges[i] to edges[i + 1]
        self.hashes = self._hashes()

    def word(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i] + self.size[i]]

    def block(self, word: np.ndarray, k: int) -> np.ndarray:
        """Bytes k to k + 8 of words, zeros beyond their ends."""
        return self.blocks[self.at[word] + k].view("<u8").ravel() & _MASK[np.minimum(self.size[word] - k, 8)]

    def _hashes(self) -> np.ndarray:
        h = mix(self.size.astype(U) + U(0x13198A2E03707344))
        some, k = np.flatnonzero(self.size <= LONG_WORD), 0
        while len(some):
            h[some] = mix(h[some] ^ self.block(some, k))
            k += 8
            some = some[self.size[some] > k]
        for i in np.flatnonzero(self.size > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return h

    def shingles(self, k: int):
        """(first word, hash) of the k-word shingles of each text, repeated ones too."""
        h = self.hashes
        n = max(0, len(h) - k + 1)
        whole = np.zeros(n, dtype=U)
        for j in range(k if n else 0):
            whole += h[j : j + n] * _WEIGHT[j]  # arrays wrap around
        for lo, hi in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.arange(lo, hi - k + 1), mix(whole[lo : hi - k + 1])
            elif hi > lo:  # all words as one, told apart by their number
                yield np.array([lo]), mix((h[lo:hi] * _WEIGHT[: hi - lo]).sum(keepdims=True) + U(hi - lo))
            else:
                yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b have the same bytes."""
        ok = self.size[a] == self.size[b]
        long = ok & (self.size[a] > LONG_WORD)
        for i in np.flatnonzero(long).tolist():
            ok[i] = self.word(a[i]) == self.word(b[i])
        some, k = np.flatnonzero(ok & ~long), 0
        while len(some):
            same = self.block(a[some], k) == self.block(b[some], k)
            ok[some[~same]] = False
            k += 8
            some = some[same]
            some = some[self.size[a[some]] > k]
        return ok
