"""Byte-pair encoding as a path problem: which tokens may follow each other, and the encoding of every prefix of a string.

A sequence of tokens is the encoding of its string exactly if every two neighbours are the encoding of theirs. So each prefix has
one last token that fits the encoding of what stands before it, and the encodings of all prefixes come out of one left-to-right
pass without any merging. `Merges` holds a vocabulary whose symbols are strings of units (characters, or bytes as latin-1).
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

NEVER = 1 << 60


class Merges:
    def __init__(self, tokens: set[str], rank: Callable[[str, str], int | None], longest: int, ties: set[int] = frozenset()) -> None:
        """`rank(a, b)`: when the neighbours a and b merge (smaller first, then leftmost), None if never. `ties`: ranks of several tokens."""
        self.tokens, self.rank, self.longest, self.ties = tokens, rank, longest, ties
        self._found = ahocorasick.Automaton()
        for t in tokens:
            self._found.add_word(t, t)
        self._found.make_automaton()
        self._whole: set[str] = set()
        self._built: dict[str, tuple[str, str, int] | None] = {}
        self._spines: dict[str, tuple[list, list]] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding by merging: the slow form, for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def built(self, token: str) -> tuple[str, str, int] | None:
        """The last merge that makes `token`, and its rank; None if merging does not lead to it."""
        if token not in self._built:
            parts = list(token)
            last = None
            while len(parts) > 1:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
                if not ranked:
                    break
                r, i = min(ranked)
                last = (parts[i], parts[i + 1], r)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._built[token] = last if len(parts) == 1 else None
        return self._built[token]

    def stands(self, token: str) -> bool:
        """True if the encoding of the token's string is the token."""
        ok = len(token) == 1 or self.built(token) is not None
        if ok:
            self._whole.add(token)
        return ok

    def _edges(self, token: str) -> tuple[list, list]:
        """What stood at the left and right edge of a token while it was built, each with the rank of the merge that ended it."""
        if token not in self._spines:
            sides = []
            for side in (0, 1):
                edge, now, until = [], token, NEVER
                while True:
                    edge.append((now, until))
                    made = self.built(now) if len(now) > 1 else None
                    if made is None:
                        break
                    now, until = made[side], made[2]
                sides.append(edge)
            self._spines[token] = tuple(sides)
        return self._spines[token]

    def fits(self, a: str, b: str) -> bool:
        """True if the encoding of a + b is [a, b]: no merge across the border comes before the merges that use up its two sides."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            left, right = self._edges(a)[1], self._edges(b)[0]
            if self.ties and any(until in self.ties for _, until in (*left, *right)):
                known = self.merged(a + b) == [a, b]
            else:
                known = True
                for x, x_until in left:
                    for y, y_until in right:
                        r = self.rank(x, y)
                        if r is not None and r < x_until and r <= y_until:
                            known = False
                            if r in self.ties:
                                known = self.merged(a + b) == [a, b]
                            break
                    else:
                        continue
                    break
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def reach(self, text: str, start: int, end: int, before: str | None) -> list[str | None]:
        """For each place from `start` to `end` the last token of the encoding that begins at `start` after the token `before`, if there is one.

        With `before` None (nothing there that could merge) every place has one.
        """
        last: list[str | None] = [before] + [None] * (end - start)
        known, whole, now = self._fits.get, self._whole, 0
        for at, t in self._found.iter(text, start, end):
            p = at + 1 - start
            if p != now:
                if last[now] is None or p > now + 1:
                    self._alone(text, start, last, max(1, now), p)
                now = p
            elif last[p] is not None:
                continue
            q = p - len(t)
            prev = last[q]
            if prev is None:
                if q:
                    continue
                ok = True
            else:
                ok = known((prev, t))
                if ok is None:
                    ok = self.fits(prev, t)
            if ok and (t in whole or self.stands(t)):
                last[p] = t
        if last[-1] is None:
            self._alone(text, start, last, max(1, now), end - start + 1)
        return last

    def _alone(self, text: str, start: int, last: list[str | None], lo: int, hi: int) -> None:
        """Units that are no token themselves, at the places from `lo` to before `hi`."""
        for p in range(lo, hi):
            if last[p] is None and (p == 1 or last[p - 1] is not None):
                t = text[start + p - 1]
                if t not in self.tokens and (last[p - 1] is None or self.fits(last[p - 1], t)):
                    last[p] = t

    @staticmethod
    def back(last: list[str | None], at: int) -> list[str]:
        """The tokens up to place `at` of a `reach`."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]
