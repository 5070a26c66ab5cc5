"""Porter's stemmer (M. F. Porter, 1980) as a table of rules that is turned into one SQL expression.

A step takes the longest of its endings that a word has. The ending is replaced by the
first of its rules whose conditions hold for what stands before it; else the word stays.
Only words of three letters a to z and more are changed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consonants and vowels of the paper: y is a vowel behind a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions on the stem as patterns: its measure (the number of vowel-consonant sequences), a vowel, a short syllable at its end.
SOME, MORE, EXACTLY_ONE = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
VOWEL, SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

# The endings of the paper's steps and what replaces them.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Steps of rules ``(ending, replacement, patterns that the stem must have, patterns that it must not have)``.
STEPS: list[list[tuple[str, str, list[str], list[str]]]] = [
    [(a, b, [], []) for a, b in PLURALS.items()],
    # What is taken off here leaves a mark, which the next step mends.
    [("eed", "ee", [SOME], []), ("ed", "#", [VOWEL], []), ("ing", "#", [VOWEL], [])],
    [("at#", "ate", [], []), ("bl#", "ble", [], []), ("iz#", "ize", [], []), *((c + c + "#", c, [], []) for c in "bcdfghjkmnpqrtvwx"), ("#", "e", [SHORT], []), ("#", "", [], [])],
    [("y", "i", [VOWEL], [])],
    [(a, b, [SOME], []) for a, b in STEP_2.items()],
    [(a, b, [SOME], []) for a, b in STEP_3.items()],
    [*((a, "", [MORE], []) for a in STEP_4), ("ion", "", [MORE, "[st]$"], [])],
    [("e", "", [MORE], []), ("e", "", [EXACTLY_ONE], [SHORT])],
    [("l", "", [MORE, "l$"], [])],
]


def stem_sql(word: str, duckdb: bool = False) -> str:
    """SQL for the stem of the lower-case ``word``, for Spark or for the engine of the checks; each step is a variable of the next."""
    like = (lambda t, p: f"regexp_matches({t}, '{p}')") if duckdb else (lambda t, p: f"{t} rlike '{p}'")
    ends = (lambda t, e: f"ends_with({t}, '{e}')") if duckdb else (lambda t, e: f"endswith({t}, '{e}')")
    out = word
    for i, step in enumerate(STEPS):
        x, cases = f"w{i}", []
        by_ending: dict[str, list] = {}
        for rule in sorted(step, key=lambda r: -len(r[0])):
            by_ending.setdefault(rule[0], []).append(rule)
        for ending, rules in by_ending.items():
            s = f"left({x}, length({x}) - {len(ending)})"
            inner = ""
            for _, to, has, lacks in rules:
                test = " and ".join([like(s, p) for p in has] + [f"not {like(s, p)}" for p in lacks]) or "true"
                inner += f" when {test} then {s} || '{to}'"
            cases.append(f"when {ends(x, ending)} then case{inner} else {x} end")
        step_sql = f"case {' '.join(cases)} else {x} end"
        out = f"list_transform([{out}], lambda {x}: {step_sql})[1]" if duckdb else f"transform(array({out}), {x} -> {step_sql})[0]"
    return f"case when {like(word, '^[a-z]{3,}$')} then {out} else {word} end"


def stem(word: str) -> Column:
    """The stem of the lower-case column ``word``, in the JVM."""
    return F.expr(stem_sql(word))


def _by_ending(step: list) -> list[tuple[str, list]]:
    """The rules of a step by ending, the longest first, with their patterns compiled."""
    out: dict[str, list] = {}
    for ending, to, has, lacks in sorted(step, key=lambda r: -len(r[0])):
        out.setdefault(ending, []).append((to, [re.compile(p) for p in has], [re.compile(p) for p in lacks]))
    return list(out.items())


_COMPILED = [_by_ending(step) for step in STEPS]


def stem_word(word: str) -> str:
    """The same stem of one lower-case word, for tasks that meet each distinct word once."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    for step in _COMPILED:
        for ending, rules in step:
            if word.endswith(ending):
                s = word[: len(word) - len(ending)]
                word = next((s + to for to, has, lacks in rules if all(p.search(s) for p in has) and not any(p.search(s) for p in lacks)), word)
                break
    return word
