"""Which of a schema's names a damaged one stands for.

The names are indexed once: by all their beginnings, endings and inner parts, and as a trie along which the rows of the edit distance are computed, so that branches that are too far are left early. A look-up doesn't go through the names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Least lengths for matches by beginning or end, by an inner part, and by edit distance; the largest distance.
SHORTEST_END, SHORTEST_MIDDLE, SHORTEST_FUZZY, FARTHEST = 2, 4, 4, 2


def bare(name: str) -> str:
    """A name without separators and case."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


class NameIndex:
    def __init__(self, known: Iterable[str]):
        self.same: dict[str, str] = {}
        self.begins: dict[str, tuple] = {}
        self.ends: dict[str, tuple] = {}
        self.bare: dict[str, str] = {}
        self.bare_begins: dict[str, tuple] = {}
        self.inner: dict[str, tuple] = {}
        self.trie: dict = {}
        for name in sorted(set(known)):
            low, plain = name.lower(), bare(name)
            self.same.setdefault(low, name)
            self.bare.setdefault(plain, name)
            for k in range(SHORTEST_END, len(low) + 1):
                self._best(self.begins, low[:k], (len(name), name))
                self._best(self.ends, low[-k:], (len(name), name))
            for k in range(1, len(plain) + 1):
                self._best(self.bare_begins, plain[:k], (len(name), name))
            for at in range(1, len(low)):
                for end in range(at + SHORTEST_MIDDLE, len(low) + 1):
                    self._best(self.inner, low[at:end], (len(name), at, name))
            node = self.trie
            for c in low:
                node = node.setdefault(c, {})
            node.setdefault("", name)

    @staticmethod
    def _best(table: dict[str, tuple], part: str, rank: tuple) -> None:
        table[part] = min(table.get(part, rank), rank)

    def find(self, fragment: str) -> tuple[str, str] | None:
        """The known name that a fragment stands for, and how: equal, else the shortest that it begins, else that it ends, else equal or begun without separators, else the shortest that holds it, else the nearest by edit distance. Case doesn't count; None if none fits."""
        low, plain, n = fragment.lower(), bare(fragment), len(fragment)
        if low in self.same:
            return self.same[low], "same"
        if n >= SHORTEST_END:
            for table, part, how in ((self.begins, low, "beginning"), (self.ends, low, "end")):
                if part in table:
                    return table[part][-1], how
            if plain in self.bare:
                return self.bare[plain], "other separators"
            if plain and plain in self.bare_begins:
                return self.bare_begins[plain][-1], "beginning"
        if n >= SHORTEST_MIDDLE and low in self.inner:
            return self.inner[low][-1], "middle"
        if n >= SHORTEST_FUZZY:
            near = min(self._near(low, min(FARTHEST, max(1, n // 3))), default=None)
            if near:
                return near[1], "spelling"
        return None

    def _near(self, word: str, most: int) -> Iterator[tuple[int, str]]:
        """(distance, name) of names within most edits."""
        todo = [(self.trie, list(range(len(word) + 1)))]
        while todo:
            node, row = todo.pop()
            for c, below in node.items():
                if c == "":
                    if row[-1] <= most:
                        yield row[-1], below
                    continue
                nxt = [row[0] + 1]
                for k, letter in enumerate(word):
                    nxt.append(min(nxt[k] + 1, row[k + 1] + 1, row[k] + (letter != c)))
                if min(nxt) <= most:
                    todo.append((below, nxt))


@lru_cache(maxsize=256)
def index_of(names: tuple[str, ...]) -> NameIndex:
    return NameIndex(names)
