"""Word shingles as 64-bit hashes, for whole batches of texts at a time (numpy inside tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Texts are hashed in groups of about so many bytes, and longer ones in pieces cut at white space, which bounds memory.
GROUP_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_TURNS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CUT = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS:
        _POWERS[:] = _powers_anew(2 * GROUP_BYTES)
    up, down = _POWERS if n <= len(_POWERS[0]) else _powers_anew(n)  # only a word of this length needs more
    return up[:n], down[:n]


def _powers_anew(n: int) -> list[np.ndarray]:
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, of the texts in order, and the number of words in each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[ends > 0]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, offsets)
    return hashes, np.diff(bounds)


def text_groups(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """The texts in order, nulls as empty, in groups of bounded size; a longer text is a group of its own."""
    group, size = [], 0
    for raw in texts:
        raw = raw or b""
        if group and size + len(raw) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield group


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while at < len(raw):
        found = _CUT.search(raw, at + GROUP_BYTES)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text (UTF-8) the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    for group in text_groups(texts):
        if len(group[0]) > GROUP_BYTES:
            hashes = np.concatenate([word_hashes([x])[0] for x in _pieces(group[0])])
            counts = [len(hashes)]
        else:
            hashes, counts = word_hashes(group)
            counts = counts.tolist()
        n = len(hashes) - k + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(k if n > 0 else 0):
            rolled += hashes[j : j + n] * _TURNS[j % 8] + np.uint64(j)
        rolled = mix64(rolled)
        at = 0
        for count in counts:
            if count >= k:
                yield np.unique(rolled[at : at + count - k + 1])
            elif count:
                short = np.uint64(count)
                with np.errstate(over="ignore"):
                    for j in range(count):
                        short = short + hashes[at + j] * _TURNS[(j + 3) % 8] + np.uint64(j)
                yield mix64(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += count
