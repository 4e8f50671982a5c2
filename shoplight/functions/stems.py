"""English word stems by stripping suffixes in ordered steps, as SQL expressions.

A word is consonants and vowels in turn, [C](VC)^m[V]; most steps look at its measure m without the
suffix in question. The steps are those of Porter's published algorithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What step 2 and step 3 put in the place of a suffix, and the suffixes that step 4 drops.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# A y is a vowel after a consonant. At the start of a word, and after a vowel, it is a consonant.
_CONSONANTS = "(?:[^aeiouy]|^y|(?<=[aeiou])y)(?:[^aeiouy]|(?<=[aeiou])y)*"
_VOWELS = "(?:[aeiou]|(?<![aeiou]|^)y)+"
_ONCE = f"^(?:{_CONSONANTS})?{_VOWELS}{_CONSONANTS}"
_TWICE = f"{_ONCE}{_VOWELS}{_CONSONANTS}"
_JUST_ONCE = f"{_ONCE}(?:{_VOWELS})?$"
_HAS_VOWEL = f"^(?:{_CONSONANTS})?{_VOWELS}"
# Consonant, vowel, consonant other than w, x and y at the end.
_SHORT_END = "(?:[^aeiouy]|^y|(?<=[aeiou])y)[aeiouy][^aeiouwxy]$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _without(word: Column, suffix: str | int) -> Column:
    n = suffix if isinstance(suffix, int) else len(suffix)
    return F.substring(word, F.lit(1), F.length(word) - n)


def _longest(word: Column, suffixes: list[str]) -> Column:
    """The longest of some suffixes that the word ends with; empty if none."""
    return F.regexp_extract(word, f"^.*?({'|'.join(suffixes)})$", 1)


def _plurals(word: Column) -> Column:
    return (F.when(word.endswith("sses") | word.endswith("ies"), _without(word, 2))
            .when(word.endswith("s") & ~word.endswith("ss"), _without(word, 1)).otherwise(word))


def _past_and_running(word: Column) -> Column:
    def mended(rest: Column) -> Column:
        twin = (F.substring(rest, -1, 1) == F.substring(rest, -2, 1)) & (F.length(rest) > 1) & ~rest.rlike("[aeiouylsz]$")
        return (F.when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e"))).when(twin, _without(rest, 1))
                .when(rest.rlike(_JUST_ONCE) & rest.rlike(_SHORT_END), F.concat(rest, F.lit("e"))).otherwise(rest))

    rest = F.when(word.endswith("ed"), _without(word, 2)).when(word.endswith("ing"), _without(word, 3))
    cut = F.when(_without(word, 3).rlike(_ONCE), _without(word, 1)).otherwise(word)
    return F.when(word.endswith("eed"), cut).otherwise(
        _let(rest, lambda r: F.when(r.rlike(_HAS_VOWEL), mended(r)).otherwise(word)))


def _last_y(word: Column) -> Column:
    return F.when(word.endswith("y") & _without(word, 1).rlike(_HAS_VOWEL), F.concat(_without(word, 1), F.lit("i"))).otherwise(word)


def _replaced(word: Column, suffixes: dict[str, str]) -> Column:
    new = F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair])
    return _let(_longest(word, list(suffixes)), lambda s: F.when(
        (s != "") & F.substring(word, F.lit(1), F.length(word) - F.length(s)).rlike(_ONCE),
        F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(s)), F.element_at(new, s))).otherwise(word))


def _dropped(word: Column) -> Column:
    suffix = _longest(word, [*STEP_4, "(?<=[st])ion"])
    return _let(suffix, lambda s: _let(F.substring(word, F.lit(1), F.length(word) - F.length(s)), lambda rest: F.when(
        (s != "") & rest.rlike(_TWICE), rest).otherwise(word)))


def _last_e(word: Column) -> Column:
    return _let(_without(word, 1), lambda rest: F.when(
        word.endswith("e") & (rest.rlike(_TWICE) | (rest.rlike(_JUST_ONCE) & ~rest.rlike(_SHORT_END))), rest).otherwise(word))


def _last_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & _without(word, 1).rlike(_TWICE), _without(word, 1)).otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words of fewer than three letters, or with other symbols than a to z, are their own stems."""
    steps = [_plurals, _past_and_running, _last_y, lambda w: _replaced(w, STEP_2), lambda w: _replaced(w, STEP_3), _dropped, _last_e, _last_l]
    made = word
    for step in steps:
        made = _let(made, step)
    return F.when(word.rlike("^[a-z]{3,}$"), made).otherwise(word)


def same_stem(word: Column, wanted: Column) -> Column:
    """Whether ``wanted`` is the stem of ``word``. All but the last letter of a stem begin its word, so few words are stripped."""
    return word.startswith(F.substring(wanted, F.lit(1), F.length(wanted) - 1)) & (stem(word) == wanted)
