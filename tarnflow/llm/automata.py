"""Probabilistic automata inferred from strings by state merging.

A prefix tree of the sample holds, at each state, how many strings pass, end and
go on by each symbol. Going breadth-first, a state is merged into an accepted
one if Hoeffding bounds cannot tell their frequencies apart, there and in all
states below; merging folds its subtree in. What cannot be merged is accepted.
"""

from __future__ import annotations

import math
from collections import deque

#: Confidence of the Hoeffding tests: a larger value merges less.
ALPHA = 0.05
SMOOTH = 0.05


class Automaton:
    """States 0 to n - 1, 0 first; ``moves[s][symbol]`` is (next, count)."""

    def __init__(self, strings: list[tuple], symbols: int, alpha: float = ALPHA):
        self.symbols = symbols
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict] = [{}]
        self.count: list[dict] = [{}]
        self.total, self.ends = [0], [0]
        for s in strings:
            self._add(s)
        self._infer()
        self._number()

    def _add(self, string: tuple) -> None:
        at = 0
        for c in string:
            self.total[at] += 1
            self.count[at][c] = self.count[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.total.append(0)
                self.ends.append(0)
            at = self.next[at][c]
        self.total[at] += 1
        self.ends[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n1, n2 = self.total[a], self.total[b]
            if not n1 or not n2:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n1, self.count[b].get(c, 0), n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add tree state ``b`` and all below it to ``a``."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    pairs.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _infer(self) -> None:
        accepted, queue = [0], deque((0, c) for c in sorted(self.next[0]))
        known = {0}
        while queue:
            parent, c = queue.popleft()
            b = self.next[parent][c]
            if b in known:
                continue
            for a in accepted:
                if self._compatible(a, b):
                    self.next[parent][c] = a
                    self._fold(a, b)
                    # Folding may have hung new tree states below accepted ones.
                    queue.extend((r, x) for r in accepted for x in sorted(self.next[r]) if self.next[r][x] not in known)
                    break
            else:
                accepted.append(b)
                known.add(b)
                queue.extend((b, x) for x in sorted(self.next[b]))
        self.accepted = accepted

    def _number(self) -> None:
        place = {s: k for k, s in enumerate(self.accepted)}
        norm = [self.total[s] + SMOOTH * (self.symbols + 1) for s in self.accepted]
        self.moves = [
            {c: (place[self.next[s][c]], math.log((n + SMOOTH) / norm[k])) for c, n in self.count[s].items()} for k, s in enumerate(self.accepted)
        ]
        self.final = [math.log((self.ends[s] + SMOOTH) / norm[k]) for k, s in enumerate(self.accepted)]
        self.unseen = [math.log(SMOOTH / x) for x in norm]
        del self.next, self.count, self.total, self.ends, self.accepted

    def log_likelihood(self, string: tuple) -> float:
        """Log probability of the string; a symbol that a state has not seen
        leads back to the start at the smoothed probability."""
        at, out = 0, 0.0
        for c in string:
            to, p = self.moves[at].get(c, (0, self.unseen[at]))
            out += p
            at = to
        return out + self.final[at]
