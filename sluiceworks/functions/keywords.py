"""Keyword lists found in one pass: an Aho-Corasick automaton over letters and digits, then an exact look at what it points to.

Whatever way a list is matched, a keyword can only be in a text if its letters and digits stand in a row among the text's
letters and digits. The automaton holds the letters of all lists at once and names the keywords that pass this test, so
the cost of a text does not follow the number of keywords. Each list then has its own exact rule:

* PLAIN: the keyword stands in the text as it is.
* BARE: its letters and digits do, if they take over two bytes; else it must stand as it is.
* NOISY: its characters come in order with at most NOISE other signs between two of them. A letter or digit out of
  order, or a further sign, starts the keyword anew behind it (see `contains_fuzzy`).

Texts are lower-cased by the caller. A keyword with fewer than SHORT letters would be pointed to everywhere; such ones are looked for by themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

PLAIN, BARE, NOISY = "plain", "bare", "noisy"
NOISE, SHORT = 10, 3

_OTHER = regex.compile(r"[^\p{Alphabetic}\p{N}]+")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
#: The ASCII bytes that are neither letters nor digits.
_ASCII_OTHER = bytes(k for k in range(128) if not chr(k).isalnum())
_ASCII_ALNUM = np.array([chr(k).isalnum() for k in range(128)])


def squeezed(text: str) -> str:
    """Letters and digits only, of any script."""
    return text.encode().translate(None, _ASCII_OTHER).decode() if text.isascii() else _OTHER.sub("", text)


def is_alnum(c: str) -> bool:
    return c.isalnum() if c.isascii() else bool(_ALNUM.match(c))


def alnum_places(text: str) -> list[int]:
    """Where the letters and digits of a text are."""
    if text.isascii():
        return np.flatnonzero(_ASCII_ALNUM[np.frombuffer(text.encode(), np.uint8)]).tolist()
    return [p for p, c in enumerate(text) if is_alnum(c)]


def noisy_in(text: str, word: str, start: int = 0, end: int | None = None) -> bool:
    """Whether the scan for one keyword, begun anew at `start`, ends with the keyword found before `end`."""
    at = noise = 0
    for c in text[start:end]:
        if c == word[at]:
            at, noise = at + 1, 0
            if at == len(word):
                return True
        elif noise == NOISE or is_alnum(c):
            at = noise = 0
        else:
            noise += 1
    return False


@dataclass(frozen=True)
class KeywordList:
    """A list and how its keywords are matched. Unless `every`, one keyword is enough and the list is asked no further."""

    name: str
    how: str
    words: tuple[str, ...]
    every: bool = False


class Keywords:
    """Several lists in one automaton."""

    def __init__(self, lists: tuple[KeywordList, ...]):
        self.lists = lists
        owners: dict[str, list[tuple[int, int]]] = {}
        self.short: list[tuple[int, int]] = []
        for k, one in enumerate(lists):
            for i, word in enumerate(dict.fromkeys(one.words)):
                if len(letters := squeezed(word)) >= SHORT:
                    owners.setdefault(letters, []).append((k, i))
                elif word:
                    self.short.append((k, i))
        self.words = [list(dict.fromkeys(x.words)) for x in lists]
        self.letters, self.owners = list(owners), list(owners.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, letters in enumerate(owners):
            self.automaton.add_word(letters, number)
        self.automaton.make_automaton()

    def found(self, low: str) -> list[set[str]]:
        """For each list the keywords that the text has; at most one where the list does not ask for every one."""
        out: list[set[str]] = [set() for _ in self.lists]
        for k, i in self.short:
            if (self.lists[k].every or not out[k]) and self._short_in(low, self.words[k][i], self.lists[k].how):
                out[k].add(self.words[k][i])
        if not self.owners:
            return out
        bare, ends = squeezed(low), {}
        for end, number in self.automaton.iter(bare):
            ends.setdefault(number, []).append(end)
        places = None
        for number in sorted(ends):
            for k, i in self.owners[number]:
                how, word = self.lists[k].how, self.words[k][i]
                if out[k] and not self.lists[k].every:
                    continue
                if how == NOISY and all(c in low for c in word):
                    places = alnum_places(low) if places is None else places
                    if noisy_near(low, places, word, len(self.letters[number]), ends[number]):
                        out[k].add(word)
                elif how == BARE or (how == PLAIN and word in low):
                    out[k].add(word)
        return out

    @staticmethod
    def _short_in(low: str, word: str, how: str) -> bool:
        if how == NOISY:
            return all(c in low for c in word) and noisy_in(low, word)
        return word in low or (how == BARE and len((letters := squeezed(word)).encode()) > 2 and letters in squeezed(low))


def noisy_near(low: str, places: list[int], word: str, size: int, ends: list[int]) -> bool:
    """noisy_in(low, word), looked for only where its letters stand: `places` are those of letters and digits in `low`, and the
    keyword's, `size` of them, end at the places with the numbers `ends`, which rise.

    A letter that the keyword does not have begins the scan anew. So it is enough to scan from behind the last such one
    before a candidate; stretches that touch are scanned as one, so the whole is in proportion to the text.
    """
    letters = {c for c in word if is_alnum(c)}
    tail = next(k for k, c in enumerate(reversed(word)) if is_alnum(c))
    stretches: list[list[int]] = []
    for end in ends:
        stop, at = places[end] + 1 + tail * (NOISE + 1), end + 1 - size
        behind = stretches[-1][1] if stretches else 0
        while at > 0 and places[at - 1] >= behind and low[places[at - 1]] in letters:
            at -= 1
        if stretches and (at == 0 or places[at - 1] < behind):
            stretches[-1][1] = stop
        else:
            stretches.append([places[at - 1] + 1 if at else 0, stop])
    return any(noisy_in(low, word, a, b) for a, b in stretches)


@lru_cache(maxsize=8)
def keywords(lists: tuple[KeywordList, ...]) -> Keywords:
    """The automaton of these lists, built once a worker."""
    return Keywords(lists)
