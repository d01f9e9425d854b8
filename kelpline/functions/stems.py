"""English analysis of tokens: stop words and the published Porter2 (Snowball English) stemmer as built-in expressions.

A step is a list of rules (which words, which of them it changes, what is cut, what comes instead); the first rule whose pattern finds a word decides, also if it then changes nothing.
"""

from __future__ import annotations

import re
from functools import cache, partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpline.functions.text import let

# The usual short list of English stop words, and the stemmer's published suffixes and exceptions.
STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

_V, _C = "[aeiouy]", "[^aeiouy]"
#: What stands before the first and the second region; a short syllable at the end.
_R1 = f"^{_C}*{_V}+{_C}"
_R2 = f"{_R1}{_C}*{_V}+{_C}"
_SHORT = f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})"

#: (pattern of the words it decides, patterns of those it changes, what is cut, what comes instead)
Rule = tuple[str, tuple[str, ...], str, str]


def _ends(suffixes: str, to: str, region: str = _R1, before: str = "") -> Rule:
    """Words that end in one of the suffixes; they change if these lie in the region, after ``before``."""
    return f"({suffixes})$", (f"{region}.*({suffixes})$", f"{before}({suffixes})$"), f"({suffixes})$", to


_NEVER = ("^$",)
#: Y is a consonant's y; E, O and A are vowels that don't open the first region of some beginnings; * marks what was cut.
STEPS: tuple[tuple[Rule, ...], ...] = (
    (("^y", (), "^y", "Y"), ("^gener", (), "^ge", "gE"), ("^commun", (), "^co", "cO"), ("^arsen", (), "^a", "A")),
    (("sses$", (), "es$", ""), ("^.(ied|ies)$", (), ".$", ""), ("(ied|ies)$", (), "..$", ""), ("(us|ss)$", _NEVER, "", ""), ("s$", (f"{_V}.+s$",), "s$", "")),
    ((f"^({'|'.join(KEPT)})$", _NEVER, "", ""), _ends("eedly|eed", "ee"), ("(ingly|edly|ing|ed)$", (f"{_V}.*(ingly|edly|ing|ed)$",), "(ingly|edly|ing|ed)$", "*")),
    (("(at|bl|iz)[*]$", (), "[*]$", "e"), ("(bb|dd|ff|gg|mm|nn|pp|rr|tt)[*]$", (), ".[*]$", ""), (f"^({_C}+{_V}[^aeiouywxY]|{_V}{_C})[*]$", (), "[*]$", "e"), ("[*]$", (), "[*]$", "")),
    (("[yY]$", (f"^.+{_C}[yY]$",), "[yY]$", "i"),),
    (
        _ends("ational", "ate"), _ends("ization", "ize"), _ends("fulness", "ful"), _ends("ousness", "ous"), _ends("iveness", "ive"), _ends("tional", "tion"), _ends("biliti", "ble"),
        _ends("lessli", "less"), _ends("entli", "ent"), _ends("ation|ator", "ate"), _ends("alism|aliti|alli", "al"), _ends("ousli", "ous"), _ends("iviti", "ive"), _ends("fulli", "ful"),
        _ends("enci", "ence"), _ends("anci", "ance"), _ends("abli", "able"), _ends("izer", "ize"), _ends("bli", "ble"), _ends("ogi", "og", before="l"), _ends("li", "", before="[cdeghkmnrt]"),
    ),
    (_ends("ational", "ate"), _ends("tional", "tion"), _ends("alize", "al"), _ends("icate|iciti|ical", "ic"), _ends("ative", "", _R2), _ends("ness", ""), _ends("ful", "")),
    (_ends("ement", "", _R2), _ends("ment", "", _R2), _ends("ance|ence|able|ible|ant|ent|ism|ate|iti|ous|ive|ize|al|er|ic", "", _R2), _ends("ion", "", _R2, "[st]")),
    ((f"{_SHORT}e$", (f"{_R2}.*e$",), "e$", ""), ("e$", (f"{_R1}.*e$",), "e$", ""), ("ll$", (f"{_R2}.*l$",), "l$", "")),
)


def _step(rules: tuple[Rule, ...], w: Column) -> Column:
    out = None
    for find, holds, cut, to in rules:
        new = w if holds == _NEVER else F.regexp_replace(w, cut, to)
        for h in holds if holds != _NEVER else ():
            new = F.when(w.rlike(h), new).otherwise(w)
        out = F.when(w.rlike(find), new) if out is None else out.when(w.rlike(find), new)
    return out.otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay. Each step binds the one before, so the expression stays small where a filter takes it along."""
    out = F.regexp_replace(word, "([aeiouy])y", "$1Y")
    for rules in STEPS:
        out = let(out, partial(_step, rules))
    kept = F.when(F.char_length(word) < 3, word)
    for w, s in FIXED.items():
        kept = kept.when(word == w, F.lit(s))
    return kept.otherwise(F.lower(out))


#: Words whose stems a worker process remembers; words of a text, without stop words, are letters and digits alone, so a space parts them.
_CACHE = 400_000
_stems: dict[str, str] = {}


@cache
def _compiled() -> list[tuple]:
    """Of each step a pattern of the words that one of its rules decides, and the rules."""
    rule = lambda find, holds, cut, to: (re.compile(find), None if holds == _NEVER else [re.compile(h) for h in holds], re.compile(cut), to)
    return [(re.compile("|".join(f"(?:{r[0]})" for r in rules)), [rule(*r) for r in rules]) for rules in STEPS]


def stem_of(word: str) -> str:
    """``stem`` of one word, by the same rules."""
    if len(word) < 3 or word in FIXED:
        return FIXED.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", word)
    for some, rules in _compiled():
        for find, holds, cut, to in rules if some.search(w) else ():
            if find.search(w):
                if holds is not None and all(h.search(w) for h in holds):
                    w = cut.sub(to, w)
                break
    return w.lower()


def stemmed(tokens: Column) -> Column:
    """The stems of an array of words in one string, parted by spaces. A worker works out a word's stem once while it remembers it, where ``stem`` does for each place that the word stands in."""

    def run(column: pa.Array) -> pa.Array:
        coded = column.flatten().dictionary_encode()
        if len(_stems) > _CACHE:
            _stems.clear()
        each = []
        for w in coded.dictionary.to_pylist():
            if (s := _stems.get(w)) is None:
                s = _stems[w] = stem_of(w)
            each.append(s)
        flat = pa.array(each, pa.string()).take(coded.indices)
        ends = pc.cumulative_sum(pc.cast(pc.list_value_length(column), pa.int32())) if len(column) else pa.array([], pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), flat), " ")

    return F.arrow_udf(run, "string")(tokens)
