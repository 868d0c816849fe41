"""Many patterns looked for at once, by an automaton over their common beginnings."""
from __future__ import annotations

from collections import deque


class Automaton:
    """Finds which of a set of non-empty patterns occur in a text, in one pass over its characters.

    States are the beginnings of patterns. ``back`` leads to the longest proper end of a state that is a state as well, ``chain`` to the nearest end that is a
    whole pattern, so all patterns that end at a place are found along the chain.
    """

    def __init__(self, patterns: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[int] = [-1]
        for number, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                following = self.next[state].get(c)
                if following is None:
                    following = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.whole.append(-1)
                state = following
            self.whole[state] = number
        self.back, self.chain = [0] * len(self.next), [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for c, following in self.next[state].items():
                end = self.back[state]
                while end and c not in self.next[end]:
                    end = self.back[end]
                end = self.next[end].get(c, 0)
                self.back[following] = end
                self.chain[following] = end if self.whole[end] >= 0 else self.chain[end]
                waiting.append(following)

    def found(self, text: str) -> set[int]:
        """Numbers of the patterns in the text. A chain is left where it has been walked before."""
        step, back, whole, chain = self.next, self.back, self.whole, self.chain
        hits: set[int] = set()
        seen: set[int] = set()
        state = 0
        for c in text:
            following = step[state].get(c)
            while following is None and state:
                state = back[state]
                following = step[state].get(c)
            state = following or 0
            end = state if whole[state] >= 0 else chain[state]
            while end and end not in seen:
                seen.add(end)
                hits.add(whole[end])
                end = chain[end]
        return hits
