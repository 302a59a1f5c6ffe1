"""A trie over words and its traversal by a Levenshtein automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


State = tuple[tuple[int, ...], tuple[int, ...], str]


class Automaton:
    """The Levenshtein automaton of one word, neighbour swaps as one edit; states are built when first reached."""

    def __init__(self, word: str, bound: int):
        self.word, self.bound = word, bound
        self.letters = frozenset(word)
        self.start: State = ((), tuple(min(i, bound + 1) for i in range(len(word) + 1)), "")
        self._next: dict[tuple[State, str], State] = {}

    def step(self, state: State, char: str) -> State:
        """The state after one more character of the other word."""
        char = char if char in self.letters else ""
        got = self._next.get((state, char))
        if got is None:
            before, now, last = state
            cap, row = self.bound + 1, [min(now[0] + 1, self.bound + 1)]
            for i, c in enumerate(self.word):
                cost = min(now[i] + (c != char), now[i + 1] + 1, row[i] + 1, cap)
                if i and before and char == self.word[i - 1] and last == c:
                    cost = min(cost, before[i - 1] + 1)
                row.append(cost)
            got = self._next[state, char] = (now, tuple(row), char)
        return got

    def alive(self, state: State) -> bool:
        """Whether some continuation can still match."""
        return min(state[1]) <= self.bound

    def distance(self, state: State) -> int | None:
        """The distance if the state accepts."""
        return state[1][-1] if state[1][-1] <= self.bound else None


class Trie:
    """Words by their letters."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def neighbours(self, word: str, bound: int) -> Iterator[tuple[str, int]]:
        """Every stored word within `bound` edits, with its distance."""
        automaton = Automaton(word, bound)
        stack = [(self.root, automaton.start)]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (d := automaton.distance(state)) is not None:
                        yield child, d
                elif automaton.alive(after := automaton.step(state, c)):
                    stack.append((child, after))


def bound_for(word: str) -> int:
    """Edits allowed in a word: 0 up to 3 letters, 1 up to 6, 2 beyond."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2
