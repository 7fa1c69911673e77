"""Plain versions of the contracts, on lists."""

from __future__ import annotations

import hashlib
import re

import numpy as np


def repeats(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str, k: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + min(k, len(words))]) for i in range(max(0, len(words) - min(k, len(words)) + 1))) if words else frozenset()


def components(sets: dict[int, frozenset], percent: int) -> dict[int, int]:
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    ids = list(sets)
    for i in ids:
        both: dict[int, int] = {}
        for x in sets[i]:
            for j in by[x]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
