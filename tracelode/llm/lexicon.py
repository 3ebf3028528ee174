"""Words with the parts they can play, looked up by word or stem."""

from __future__ import annotations

_NONE: frozenset[int] = frozenset()


class Lexicon:
    """``words``: by language and part, words one after the other; a star stands for any ending of ten letters at most."""

    def __init__(self, words: dict[str, dict[int, str]]):
        self.words = words
        self._exact: dict[str, frozenset[int]] = {}
        self._stems: dict[str, dict[str, frozenset[int]]] = {}  # by the first three letters
        self._known: dict[str, frozenset[int]] = {}
        for parts in words.values():
            for part, text in parts.items():
                for w in text.split():
                    into = self._stems.setdefault(w[:-1][:3], {}) if w.endswith("*") else self._exact
                    into[w.rstrip("*")] = into.get(w.rstrip("*"), _NONE) | {part}

    def parts(self, word: str) -> frozenset[int]:
        """The parts that a word in lower case can play; none for one letter, or a word outside."""
        found = self._known.get(word)
        if found is None:
            found = _NONE
            if len(word) > 1:
                found = self._exact.get(word, _NONE)
                for k in (3, 2):
                    for stem, parts in self._stems.get(word[:k], {}).items():
                        if word.startswith(stem) and len(word) <= len(stem) + 10:
                            found = found | parts
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[word] = found
        return found

    def of(self, *parts: int) -> set[str]:
        """The words of some parts, with their stars."""
        return {w for by in self.words.values() for part, text in by.items() if part in parts for w in text.split()}
