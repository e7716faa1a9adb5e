"""Quality rules from tokeniser fertility.

How a public vocabulary splits a text says how far it is from ordinary prose: symbol noise, capitals and mojibake
need more tokens a character, other scripts fall back to bytes, and repetition makes the tokens predictable. For
each document the operator measures, over its whole text,

* ``chars_per_token``: code points of its words by tokens, each word split as it stands after a space;
* ``byte_share``: the share of those tokens that fall back to bytes (they hold part of a character only);
* ``token_entropy``: entropy in bits of the document's own token distribution;
* ``entropy_ratio``: that entropy by the most that this many tokens, or MOST_TOKENS if there are more, allow (1 for fewer
  than two tokens): a long text's entropy levels off, and its length alone must not count against it;

and compares them with bands that depend on the language, or on the script (of most letters, by Unicode's property) where
the language is unknown or the text is in another script.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACES, map_column

#: A byte-level vocabulary for many languages; in prose it spends about as much on each of them.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Tokens beyond which a text's entropy is compared with the same most.
MOST_TOKENS = 4096
#: Words whose split is remembered in a worker; beyond that the memory starts anew.
REMEMBERED = 1_000_000


class Band(NamedTuple):
    """Limits between which a text is kept, for texts of at least ``least_tokens`` tokens."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy_ratio: float
    least_tokens: int = 50


#: By language, then by script; ``none`` for texts without letters, ``other`` for scripts that aren't listed. The lower
#: limits of scripts are about half of what clean prose in them measures with VOCABULARY.
BANDS = {
    "en": Band((1.80, 12.0), 0.10, 0.35),
    "de": Band((1.80, 12.0), 0.10, 0.35),
    "fr": Band((1.70, 12.0), 0.10, 0.35),
    "es": Band((1.70, 12.0), 0.10, 0.35),
    "latin": Band((1.60, 12.0), 0.15, 0.35),
    "none": Band((1.60, 12.0), 0.15, 0.35),
    "cyrillic": Band((1.0, 12.0), 0.35, 0.35),
    "greek": Band((0.7, 12.0), 0.75, 0.35),
    "arabic": Band((0.7, 12.0), 0.75, 0.35),
    "hebrew": Band((0.7, 12.0), 0.75, 0.35),
    "han": Band((0.3, 6.0), 1.0, 0.30),
    "kana": Band((0.3, 6.0), 1.0, 0.30),
    "hangul": Band((0.3, 6.0), 1.0, 0.30),
    "devanagari": Band((0.35, 12.0), 1.0, 0.20),
    "thai": Band((0.4, 12.0), 1.0, 0.25),
    "other": Band((0.2, 14.0), 1.0, 0.15),
}
#: Names of scripts, and the Unicode scripts whose letters count for each. Letters of any other script are ``other``.
SCRIPTS = {
    "latin": ("Latin",),
    "greek": ("Greek",),
    "cyrillic": ("Cyrillic",),
    "arabic": ("Arabic",),
    "hebrew": ("Hebrew",),
    "han": ("Han",),
    "kana": ("Hiragana", "Katakana"),
    "hangul": ("Hangul",),
    "devanagari": ("Devanagari",),
    "thai": ("Thai",),
}
#: Code points whose scripts are looked up; letters beyond (none so far) are ``other``.
POINTS = 0x32000

FIELDS = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long,
    chars_per_token double, byte_share double, token_entropy double, entropy_ratio double, script string"""


def numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and for each word which of them it is."""
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    return list(number), ids


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words that lie in a ``width``-word window found twice or more, the first occurrence included."""
    n = len(ids)
    if n <= width:
        return 0
    keys = ids[: n - width + 1]
    for k in range(1, width):
        keys = keys * distinct + ids[k : n - width + 1 + k]
        if k < width - 1 and distinct ** (k + 2) >= 2**62:  # renumbered, so that the next product fits
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : len(keys) + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines (split at ``\\n``) that hold a word and equal an earlier line."""
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in seen:
            found += 1
        elif line.strip(SPACES):
            seen.add(line)
    return found


_SCRIPT_OF: list[np.ndarray] = []


def script_numbers() -> np.ndarray:
    """For each code point below POINTS: 0 if it is no letter, 1 plus the place in SCRIPTS, or one more for other letters."""
    if not _SCRIPT_OF:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, POINTS)]))
        table = np.zeros(POINTS, np.uint8)
        for number, pattern in [(len(SCRIPTS) + 1, r"\p{L}+")] + [(k + 1, "(?V1)[[" + "".join(rf"\p{{Script={n}}}" for n in names) + r"]&&\p{L}]+") for k, names in enumerate(SCRIPTS.values())]:
            for found in regex.finditer(pattern, every):
                table[[ord(c) for c in found[0]]] = number
        _SCRIPT_OF.append(table)
    return _SCRIPT_OF[0]


def main_script(text: str) -> str:
    """The script with most of the letters (of equal ones the first in SCRIPTS, then ``other``); ``none`` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(script_numbers()[points[points < POINTS]], minlength=len(SCRIPTS) + 2)[1:]
    return [*SCRIPTS, "other"][int(counts.argmax())] if counts.any() else "none"


class Splitter:
    """Splits texts word by word, with a bounded memory of words seen."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        for piece, i in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.is_byte[i] = True
        self.known: dict[bytes, bytes] = {}

    def split(self, word: bytes) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = array("I", self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))).tobytes()
        if len(word) < 100:
            self.known[word] = ids
        return ids

    def measure(self, text: str) -> tuple:
        words = text.encode("utf-8", "replace").split()
        chars = len(text) - sum(map(text.count, SPACES))
        distinct, of_word = numbered(words)
        get = self.known.get
        split = [get(w) or self.split(w) for w in distinct]
        ids = np.frombuffer(b"".join(split), np.uint32)
        times = np.repeat(np.bincount(of_word, minlength=len(distinct)), np.fromiter(map(len, split), np.int64, len(split)) // 4)
        n = int(times.sum())
        counts = np.bincount(ids, times)
        counts = counts[counts > 0]
        entropy = float(math.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0
        return (
            len(words),
            chars,
            sum(map(text.count, SYMBOLS)),
            duplicate_lines(text),
            repeated_words(of_word, len(distinct)),
            n,
            chars / n if n else 0.0,
            float(times[self.is_byte[ids]].sum() / n) if n else 0.0,
            entropy,
            entropy / math.log2(min(n, MOST_TOKENS)) if n > 1 else 1.0,
            main_script(text),
        )


#: One for each vocabulary in a worker: tasks that follow find the words of those before.
_SPLITTERS: dict[str, Splitter] = {}


def metrics(docs: DataFrame, text: str = "text", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with FIELDS for every row's whole text; one pass, no shuffle. Null texts count as empty.

    ``vocabulary`` is a rank file's path (default: VOCABULARY of the installed public tokenizers). Columns of ``docs`` that
    bear the name of a field are replaced; every other column stays.
    """

    def make() -> Callable[[list], dict[str, pa.Array]]:
        import public_tokenizers

        path = vocabulary or public_tokenizers.path(VOCABULARY)
        splitter = _SPLITTERS[path] = _SPLITTERS.get(path) or Splitter(path)
        names = [f.split()[0] for f in FIELDS.split(",")]

        def work(texts: list) -> dict[str, pa.Array]:
            rows = [splitter.measure(t or "") for t in texts]
            return {name: pa.array([r[i] for r in rows], pa.string() if name == "script" else pa.int64() if i < 6 else pa.float64()) for i, name in enumerate(names)}

        return work

    return map_column(docs, F.col(text), FIELDS, make, keep)


def in_band(lang: Column | None, bands: dict[str, Band] = BANDS) -> Column:
    """Whether a row's metrics lie in the band of its language, else of its script, else ``other``."""

    def inside(band: Band) -> Column:
        return (F.col("n_tokens") < band.least_tokens) | (
            F.col("chars_per_token").between(*band.chars_per_token)
            & (F.col("byte_share") <= band.byte_share)
            & (F.col("entropy_ratio") >= band.entropy_ratio)
        )

    scripts = {*SCRIPTS, "none"}
    script = F.col("script")
    tests = [(script == name, inside(bands[name])) for name in sorted(scripts) if name in bands]
    if lang is not None:  # a language's band is for its own (Latin) script, and for texts of no letters at all
        tests = [((lang == name) & script.isin("latin", "none"), inside(band)) for name, band in bands.items() if name not in scripts | {"other"}] + tests
    out = inside(bands["other"])
    for condition, verdict in reversed(tests):
        out = F.when(condition, verdict).otherwise(out)
    return out


def rejected_by_base() -> Column:
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judged(docs: DataFrame, text: str = "text", lang: str | None = "lang", bands: dict[str, Band] = BANDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the metrics, ``base_failed`` and ``kept``.

    Nulls: a null text is empty (no words, so ``base_failed``); a null or unknown language uses the script's band.
    Empty tables give an empty result; repeated rows are judged alike, each on its own.
    """
    carried = docs.columns if keep is None else keep
    known = lang is not None and lang in docs.columns
    held = carried if not known or lang in carried else [*carried, lang]
    out = metrics(docs, text, keep=held)
    out = out.withColumn("base_failed", rejected_by_base())
    out = out.withColumn("kept", ~F.col("base_failed") & in_band(F.col(lang) if known else None, bands))
    return out if held == carried else out.drop(lang)
