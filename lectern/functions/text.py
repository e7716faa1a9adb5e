"""Words and search tokens, as column expressions, and the stemmer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: the characters that ECMAScript's \s names.
SPACE = r"[\t\n\x0B\f\r\x20   -     　﻿]+"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def words(text: Column) -> Column:
    """The words of a text; none for an empty or null one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def tokens(text: Column) -> Column:
    """Search tokens without stemming: runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


#: Characters of more than 16 bits; a set of them is slow to match.
_FAR = re.compile("[\U00010000-\U0010ffff]")


@cache
def _marks() -> re.Pattern:
    """The characters of 16 bits that combine with the one before."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.combining(chr(c))) + "]+")


def folded(text: str) -> str:
    """Lower case, without diacritics."""
    lower = text.lower()
    if lower.isascii():
        return lower
    return _FAR.sub(lambda m: "" if unicodedata.combining(m[0]) else m[0], _marks().sub("", unicodedata.normalize("NFD", lower)))


# The suffixes of Porter's algorithm (1980), steps 2 to 4; fixed values.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """Each letter as c (consonant) or v (vowel); y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of other than a-z, and of up to two letters, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word.removesuffix(ending) + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (m := re.fullmatch("(.*)(ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for ending in sorted(table, key=len, reverse=True):
            if word.endswith(ending):
                base = word.removesuffix(ending)
                word = base + table[ending] if _measure(base) else word
                break
    for ending in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            base = word.removesuffix(ending)
            if _measure(base) > 1 and (ending != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or m == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if _doubled(word) and word[-1] == "l" and _measure(word[:-1]) > 1 else word


_TOKEN = re.compile(r"[^\W_]+")


def stemmed_tokens(text: str | None, known: dict[str, str]) -> list[str]:
    found = _TOKEN.findall(folded(text or ""))
    for token in set(found).difference(known):
        known[token] = stem(token)
    return [known[token] for token in found]


def porter_tokens(text: Column) -> Column:
    """Search tokens folded, without diacritics, and stemmed."""

    @F.pandas_udf("array<string>")
    def tokenize(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in texts:
            if len(known) > 500_000:
                known.clear()
            yield pd.Series([stemmed_tokens(t, known) for t in batch], dtype=object)

    return tokenize(text)


#: A phrase of a snippet: its terms (stems), and whether the last is only begun.
Terms = tuple[tuple[str, ...], bool]


def _instances(terms: list[str], phrases: list[Terms]) -> list[tuple[int, int, int]]:
    """(first token, phrase, tokens) of all instances, by place."""
    out = []
    for number, (wanted, prefix) in enumerate(phrases):
        n = len(wanted)
        for k in range(len(terms) - n + 1):
            whole = n - 1 if prefix else n
            if tuple(terms[k : k + whole]) == wanted[:whole] and (not prefix or terms[k + n - 1].startswith(wanted[-1])):
                out.append((k, number, n))
    return sorted(out)


def _sentence_starts(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Tokens that begin the text, or follow a stop or colon and white space."""
    out = [0] if spans else []
    for k, (start, _) in enumerate(spans[1:], 1):
        before = text[:start].rstrip(" \t\n\r") if text[start - 1] in " \t\n\r" else ""
        if before.endswith((".", ":")):
            out.append(k)
    return out


def _windows(instances: list[tuple[int, int, int]], starts: list[int], size: int, most: int) -> Iterator[tuple[int, int]]:
    """Windows worth showing (score, first token): around the hits from each hit on, and from the sentence it stands in.

    A window is worth 1000 for each phrase in it and 1 for each further hit; that it begins a sentence is worth 100, and
    that it begins the text 120.
    """

    def inside(first: int) -> list[tuple[int, int, int]]:
        return [i for i in instances if first <= i[0] < first + most]

    def score(hits: list[tuple[int, int, int]]) -> int:
        phrases = len({p for _, p, _ in hits})
        return 1000 * phrases + len(hits) - phrases

    for place, *_ in instances:
        hits = inside(place)
        spread = hits[-1][0] + hits[-1][2] - hits[0][0]
        yield score(hits), max(0, min(hits[0][0] - int((most - spread) / 2), size - most))
        sentence = max((s for s in starts if s <= place), default=place)
        if size > most and sentence < place:
            yield score(inside(sentence)) + (100 if sentence else 120), sentence


def snippet_of(texts: list[str | None], phrases: list[Terms], most: int = 10, marks: tuple[str, str, str] = ("«", "»", "…")) -> str:
    """The best window of ``most`` tokens among the texts (columns of one row), hits in marks, cut ends as an ellipsis."""
    best = (0, 0, 0)  # score, column, first token; of equal ones the first found
    prepared = []
    for column, text in enumerate(texts):
        text = text or ""
        spans = [m.span() for m in _TOKEN.finditer(text)]
        found = _instances([stem(folded(text[a:b])) for a, b in spans], phrases)
        prepared.append((text, spans, found))
        for score, first in _windows(found, _sentence_starts(text, spans), len(spans), most):
            if score > best[0]:
                best = (score, column, first)
    text, spans, found = prepared[best[1]]
    if not spans:
        return text
    first, last = best[2], min(len(spans), best[2] + most) - 1
    runs: list[list[int]] = []  # instances that overlap are one run
    for place, _, n in found:
        if runs and place <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], place + n - 1)
        else:
            runs.append([place, place + n - 1])
    at = spans[first][0] if first else 0
    out = marks[2] if first else ""
    for a, b in runs:
        if first <= a <= last:
            end = spans[min(b, last)][1]
            out += text[at : spans[a][0]] + marks[0] + text[spans[a][0] : end] + marks[1]
            at = end
    return out + (text[at:] if last == len(spans) - 1 else text[at : spans[last][1]] + marks[2])


def snippet(columns: list[str], phrases: list[Terms], most: int = 10) -> Column:
    """``snippet_of`` over some columns of each row."""

    @F.pandas_udf("string")
    def cut(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([snippet_of(list(row), phrases, most) for row in rows.itertuples(index=False)], dtype=object)

    return cut(F.struct(*columns))
