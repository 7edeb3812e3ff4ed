"""Literal occurrences of many terms in a text, in one pass over it (a trie with failure links, from pyahocorasick)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class Terms:
    """Distinct non-empty terms; found() gives what searching for each of them from the left would."""

    def __init__(self, terms: Iterable[str]) -> None:
        import ahocorasick

        self.terms = list(dict.fromkeys(terms))
        if "" in self.terms:
            raise ValueError("an empty term has no occurrences")
        self.trie = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.trie.add_word(t, i)
        if self.terms:
            self.trie.make_automaton()

    def found(self, text: str | None) -> dict[int, list[int]]:
        """Starts (code points) of the non-overlapping occurrences of each term, by the term's number."""
        out: dict[int, list[int]] = {}
        if not text or not self.terms:
            return out
        for last, i in self.trie.iter(text):
            n = len(self.terms[i])
            start = last + 1 - n
            starts = out.setdefault(i, [])
            if not starts or start >= starts[-1] + n:
                starts.append(start)
        return out


_kept: dict[str, Terms] = {}


def kept(name: str, terms: Sequence[str] | None = None) -> Terms:
    """The automaton of that name, built once in a worker; it keeps one at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Terms(terms)
    return _kept[name]
