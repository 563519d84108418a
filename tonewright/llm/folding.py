"""Folding of spellings: one form for texts and names that differ only in how they are written."""

from __future__ import annotations

import re
import unicodedata

#: Letters drawn alike in other scripts, each with the Latin letter that stands for all of them.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "h", "ι": "i", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t", "υ": "y", "χ": "x", "ɑ": "a",
    "ɡ": "g", "ı": "i",
}
_TABLE = str.maketrans(LOOK_ALIKES)
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Compatibility form, case folded, ё as е, without marks that do not compose and without format characters."""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if _ODD.search(text):
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return text.casefold().replace("ё", "е")


_ODD = re.compile("[\u00ad\u0300-\u036f\u0483-\u0489\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")


def words(text: str) -> list[str]:
    """The folded words (runs of letters and digits) of a text, look-alike letters as one."""
    return _WORD.findall(fold(text).translate(_TABLE))


def author_key(name: str | None) -> str:
    """The words of a name in one order; empty for null and blank names."""
    return " ".join(sorted(words(name))) if name else ""
