"""Words of noisy text, in one spelling."""

from __future__ import annotations

import re

# Cyrillic letters that look like Latin ones, in lower case, and their Latin twins; е stands for ё.
LOOKALIKES = str.maketrans("авекмнорстухё", "abekmhopctyxe")
_MARKUP = re.compile(r"<[^<>]{0,300}>|&#?\w{1,10};")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = str.maketrans("", "", "\u00ad\u200b\u200c\u200d\u2060\ufeff")
_SEEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


def plain(text: str) -> str:
    """Lower case, without markup, entities and invisible characters (soft hyphens, zero-width marks)."""
    if _SEEN.search(text):
        text = text.translate(_INVISIBLE)
    text = text.lower()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return text


def skeleton(word: str) -> str:
    """One spelling for look-alike letters of the two alphabets, and е for ё."""
    return word.translate(LOOKALIKES)


def words(text: str) -> list[str]:
    """Runs of letters or digits of the plain text, as they stand."""
    return _WORD.findall(plain(text))


class Ids(dict):
    """Number of a word by its skeleton in a fixed vocabulary; `missing` for any other. Remembers spellings, up to a bound."""

    def __init__(self, vocabulary: dict[str, int], missing: int = -1):
        super().__init__()
        self.vocabulary, self.missing = vocabulary, missing

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = self.vocabulary.get(skeleton(word), self.missing)
        return found
