"""Probabilistic automata learned from example strings by merging compatible prefix-tree states."""

from __future__ import annotations

import math


class Automaton:
    """Deterministic automaton with counts; state 0 is the start.

    Built as the prefix tree of the examples.  Then states are visited from the start outwards: each is merged
    into the settled state it resembles most among those that it is statistically compatible with (Hoeffding
    bounds on every outgoing frequency, checked along both subtrees), or becomes settled itself.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05, alphabet: int = 95):
        self.moves: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.total, self.ends = [0], [0]
        self.alphabet = alphabet
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in sorted(strings):
            at = 0
            self.total[0] += 1
            for c in s:
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.seen.append({})
                    self.total.append(0)
                    self.ends.append(0)
                self.seen[at][c] = self.seen[at].get(c, 0) + 1
                at = self.moves[at][c]
                self.total[at] += 1
            self.ends[at] += 1
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            na, nb = self.total[a], self.total[b]
            if not na or not nb:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if self._differ(self.seen[a].get(c, 0), na, self.seen[b].get(c, 0), nb):
                    return False
                if c in self.moves[a] and c in self.moves[b]:
                    waiting.append((self.moves[a][c], self.moves[b][c]))
        return True

    def _likeness(self, a: int, b: int) -> float:
        """Mean log-likelihood of what leaves b under what leaves a."""
        n = self.total[a] + 1
        return sum(k * math.log((self.seen[a].get(c, 0) + 1 / self.alphabet) / n) for c, k in self.seen[b].items()) + (
            self.ends[b] * math.log((self.ends[a] + 1 / self.alphabet) / n))

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, k in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + k
                if c in self.moves[a]:
                    waiting.append((self.moves[a][c], self.moves[b][c]))
                else:
                    self.moves[a][c] = self.moves[b][c]

    def _merge_states(self) -> None:
        settled, queue = [0], [(0, c) for c in sorted(self.moves[0])]
        place = {0}
        while queue:
            parent, c = queue.pop(0)
            state = self.moves[parent][c]
            if state in place:
                continue
            fits = [s for s in settled if self._compatible(s, state)]
            if fits:
                into = max(fits, key=lambda s: (self._likeness(s, state), -s))
                self.moves[parent][c] = into
                self._fold(into, state)
                queue += [(into, d) for d in sorted(self.moves[into]) if self.moves[into][d] not in place]
            else:
                place.add(state)
                settled.append(state)
                queue += [(state, d) for d in sorted(self.moves[state])]
        order = {s: i for i, s in enumerate(settled)}
        self.moves = [{c: order[t] for c, t in self.moves[s].items()} for s in settled]
        self.seen = [self.seen[s] for s in settled]
        self.total, self.ends = [self.total[s] for s in settled], [self.ends[s] for s in settled]
        self._bits = [{c: math.log2((k + 1 / self.alphabet) / (n + 1)) for c, k in seen.items()}
                      for seen, n in zip(self.seen, self.total)]
        self._unseen = [math.log2((1 / self.alphabet) / (n + 1)) for n in self.total]

    def bits(self, string: str) -> float:
        """Log2 likelihood of the characters of a string; an unseen character leads back to the start."""
        at, total = 0, 0.0
        for c in string:
            total += self._bits[at].get(c, self._unseen[at])
            at = self.moves[at].get(c, 0)
        return total


class Background:
    """Character pairs of ordinary words, smoothed: what a string must be less like than like a format."""

    def __init__(self, counts: dict[tuple[str, str], int], alphabet: int = 95):
        """``counts`` of each character after each other; a word starts after a newline."""
        pairs: dict[str, dict[str, int]] = {}
        for (a, b), k in counts.items():
            pairs.setdefault(a, {})[b] = k
        self._bits = {a: {b: math.log2((k + 1 / alphabet) / (sum(after.values()) + 1)) for b, k in after.items()}
                      for a, after in pairs.items()}
        self._unseen = {a: math.log2((1 / alphabet) / (sum(after.values()) + 1)) for a, after in pairs.items()}
        self._floor = -math.log2(alphabet)

    def bits(self, string: str) -> float:
        return sum(self._bits.get(a, {}).get(b, max(self._unseen.get(a, self._floor), self._floor))
                   for a, b in zip("\n" + string, string))
