"""A minimal acyclic transducer from byte strings to id sequences, memory-mapped.

Words added in order of their bytes share prefixes as they come and suffixes as soon
as a node can no longer change: a finished node that equals an earlier one in finality and
arcs is replaced by it, which keeps the automaton minimal at every step. Each
arc carries the number of words that come before those it leads to, so that the sum of
outputs along a word's path is its place in the order; that keeps outputs from
breaking up shared suffixes. The place leads into a table of id sequences.

On disk all is flat integer arrays in one file, which workers map into memory
read-only: those of a machine share the pages.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x534C4558
_PARTS = ("first", "label", "target", "output", "final", "offset", "ids")


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton over ``words``.

    first[s]..first[s+1]: arcs of state s, by ascending label; final[s]: 1 if a word
    ends there; offset[k]..offset[k+1]: ids of the word of place k. State 0 is the start.
    """
    order = sorted(words)
    register: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    # The path of the last word: (final, arcs so far) for each of its nodes.
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            at = register.get(key)
            if at is None:
                at = register[key] = len(finished)
                finished.append(key)
            path[-1][1].append((last[len(path) - 1], at))

    for w in order:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        close(same)
        last = w
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0] = True
    close(0)
    finished.append((path[0][0], tuple(path[0][1])))
    n = len(finished)
    # Nodes finish children first; number them the other way round, the start first.
    number = lambda k: n - 1 - k
    count = np.zeros(n, np.int64)
    for k, (final, arcs) in enumerate(finished):
        count[k] = int(final) + sum(int(count[t]) for _, t in arcs)
    first = np.zeros(n + 1, np.int32)
    label, target, output, final_ = [], [], [], np.zeros(n, np.int32)
    for s in range(n):
        final, arcs = finished[number(s)]
        final_[s] = final
        before = int(final)
        for a, t in arcs:
            label.append(a)
            target.append(number(t))
            output.append(before)
            before += int(count[t])
        first[s + 1] = len(label)
    offset = np.zeros(len(order) + 1, np.int32)
    np.cumsum([len(words[w]) for w in order], out=offset[1:]) if order else None
    ids = np.fromiter((i for w in order for i in words[w]), np.int32)
    as32 = lambda x: np.asarray(x, np.int32)
    return {"first": first, "label": as32(label), "target": as32(target), "output": as32(output), "final": final_, "offset": offset, "ids": ids}


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    head = np.array([MAGIC, *[len(parts[p]) for p in _PARTS]], np.int32)
    return head.tobytes() + b"".join(np.ascontiguousarray(parts[p], np.int32).tobytes() for p in _PARTS)


class Lexicon:
    """Look-ups in a lexicon file mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int32, "r")
        if data[0] != MAGIC:
            raise ValueError(f"{path} holds no lexicon")
        at = 1 + len(_PARTS)
        for name, n in zip(_PARTS, data[1:at].tolist()):
            setattr(self, name, data[at : at + n])
            at += n

    def __len__(self) -> int:
        return len(self.offset) - 1

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for words that aren't there; all walk in step."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(length) - length
        text = np.frombuffer(b"".join(words), np.uint8)
        state, place, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        at = np.flatnonzero(length > 0)
        depth = 0
        while len(at):
            a = text[start[at] + depth]
            lo, hi = self.first[state[at]].astype(np.int64), self.first[state[at] + 1].astype(np.int64)
            end = hi.copy()
            while True:  # binary search among each state's arcs
                busy = lo < hi
                if not busy.any():
                    break
                mid = (lo + hi) >> 1
                less = busy & (self.label[np.minimum(mid, len(self.label) - 1)] < a)
                lo = np.where(less, mid + 1, lo)
                hi = np.where(busy & ~less, mid, hi)
            found = lo < end
            found[found] = self.label[lo[found]] == a[found]
            alive[at[~found]] = False
            arc, at = lo[found], at[found]
            place[at] += self.output[arc]
            state[at] = self.target[arc]
            depth += 1
            at = at[length[at] > depth]
        if not len(self):
            return np.full(n, -1, np.int64)
        return np.where(alive & (self.final[state] == 1), place, -1)

    def of(self, place: int) -> list[int]:
        return self.ids[self.offset[place] : self.offset[place + 1]].tolist()
