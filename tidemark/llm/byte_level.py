"""Byte-level BPE files: vocabulary, merge ranks and the split into pre-tokens.

A text is cut at spaces into units whose pre-tokens don't depend on their neighbours, so results can be
kept by unit: natural text repeats them, and a kept unit costs one dictionary look-up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

#: The pattern of byte-level BPE files (fixed value). White space is the Unicode property, as in the library.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
)
#: A space before more white space: the run's pre-tokens then reach over the cut.
LOOSE = regex.compile(r" \p{White_Space}")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the file: itself if it is printable, else the next free code from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """ids and bytes of tokens, and the rank and result of each merge, from a tokenizer JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        ids = spec["model"]["vocab"]
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in ids.items()}
        self.byte_ids = [ids[c] for c in byte_chars()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token_bytes.update((i, t.encode()) for t, i in self.specials.items())
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text cut at special strings, longest first; a special one comes with its id."""
        if self._special_split is None or not any(s in text for s in self.specials):
            yield text, None
            return
        for part in self._special_split.split(text):
            if part:
                yield part, self.specials.get(part)


@lru_cache(2)
def loaded(path: str) -> Vocabulary:
    """A vocabulary, read once a process."""
    return Vocabulary(path)


#: Characters of the longest key that is kept, so that a store's size is bounded in bytes; values of longer ones are made again.
KEY_CHARS = 64


class Kept(dict):
    """A dictionary that makes missing values and holds two generations of at most bound keys each: at its bound the young one becomes the old one, from which keys that are still in use come back."""

    def __init__(self, make: Callable, bound: int) -> None:
        super().__init__()
        self._make, self._bound, self._old = make, bound, {}

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > KEY_CHARS:
            return self._make(key)
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._bound:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class Units:
    """Looks up a value for each unit of a text: of_pretokens makes it from the list of the unit's pre-tokens."""

    def __init__(self, of_pretokens: Callable[[list[str]], object], bound: int = 400_000) -> None:
        self._make = of_pretokens
        self._spaced = Kept(lambda piece: of_pretokens(PRETOKEN.findall(" " + piece)), bound)

    def values(self, text: str) -> list:
        """One value for each unit in order; a text with loose white space is one unit."""
        if not text:
            return []
        if "  " in text or text[-1] == " " or LOOSE.search(text):
            return [self._make(PRETOKEN.findall(text))]
        first, *rest = text.split(" ")
        out = list(map(self._spaced.__getitem__, rest))
        return [self._make(PRETOKEN.findall(first)), *out] if first else out
