"""English noun inflection by rules, with an injectable table of irregular nouns."""

from __future__ import annotations

import re

IRREGULAR = {"man": "men", "woman": "women", "child": "children", "foot": "feet", "tooth": "teeth", "mouse": "mice", "person": "people"}
_PLURAL = [
    (re.compile(r"(s|x|z|ch|sh)$", re.I), r"\1es"), (re.compile(r"([^aeiou])y$", re.I), r"\1ies"), (re.compile(r"(?<!f)fe?$", re.I), "ves"),
    (re.compile(r"sis$", re.I), "ses"), (re.compile(r"$"), "s"),
]
_SINGULAR = [
    (re.compile(r"([^aeiou])ies$", re.I), r"\1y"), (re.compile(r"(ss|x|z|ch|sh)es$", re.I), r"\1"), (re.compile(r"([^f])ves$", re.I), r"\1f"),
    (re.compile(r"([^sui])s$", re.I), r"\1"),
]


def plural(word: str, irregular: dict[str, str] = IRREGULAR) -> str:
    if word in irregular:
        return irregular[word]
    if word.lower().endswith("sis"):
        return word[:-2] + "es"
    return next(p.sub(r, word, count=1) for p, r in _PLURAL if p.search(word))


def singular(word: str, irregular: dict[str, str] = IRREGULAR) -> str | None:
    """The singular of a plural; None if the word doesn't look like one."""
    back = {v: k for k, v in irregular.items()}
    if word in back:
        return back[word]
    return next((p.sub(r, word, count=1) for p, r in _SINGULAR if p.search(word)), None)


def forms(word: str, inflect: bool) -> list[str]:
    """A word and, if wanted, its singular, the singular's possessive, its plural and the plural's possessive."""
    out = [word]
    if inflect:
        one = singular(word)
        out += [one, one + "'s"] if one else []
        many = plural(word)
        out += [many, many + "'"]
    return out
