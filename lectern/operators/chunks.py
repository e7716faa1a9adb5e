"""Overlapping chunks of long texts, cut at speaker turns and sentence ends."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Words that end in a stop without ending a sentence; fixed values.
ABBREVIATIONS = frozenset(("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "vs.", "etc.", "e.g.", "i.e.", "Inc.", "Ltd.", "Co.", "Corp."))
_SPACE = re.compile(r"[\t\n\x0b\f\r    -     　﻿]+")
_TURN = (re.compile(r"(Speaker|SPEAKER) [0-9]+:"), re.compile(r"\[(Speaker|SPEAKER) [0-9]+\]:"))

#: Texts of a batch that are chunked, and passed on, at once.
AT_ONCE = 256

SCHEMA = "chunk_idx int, text string, start_word int, end_word int, word_count int"


@dataclass(frozen=True)
class Strategy:
    """Words in a chunk, shared with the one before, needed to chunk at all, and searched for a boundary either way."""

    size: int = 300
    overlap: int = 50
    threshold: int = 500
    boundary_window: int = 30
    version: int = 2

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError(f"a chunk must be longer than its overlap, which can't be negative: {self}")

    def text(self) -> str:
        return ";".join(f"{k}={v}" for k, v in asdict(self).items())


def split_words(text: str | None) -> list[str]:
    return [w for w in _SPACE.split(text or "") if w]


def ends_sentence(word: str) -> bool:
    if word.endswith(("!", "?")):
        return True
    length = len(word.encode("utf-16-le")) // 2
    return word.endswith(".") and not word.endswith("..") and not "0" <= word[0] <= "9" and length > 2 and word not in ABBREVIATIONS


def _closest(places: list[int], low: int, high: int, target: int) -> int | None:
    """The place from low to high closest to the target; of two equally close, the earlier."""
    at = bisect_left(places, target)
    near = [p for p in places[max(0, at - 1) : at + 1] if low <= p <= high]
    return min(near, key=lambda p: (abs(p - target), p), default=None)


class Cuts:
    """Where chunks that begin at any word end. ``words`` may be a part of a text; if it isn't the last one, as many words
    must follow a chunk's first as ``reach`` says."""

    def __init__(self, words: list[str], strategy: Strategy):
        self.n, self.strategy = len(words), strategy
        self.stops = [k for k, w in enumerate(words) if w[-1] in ".!?" and ends_sentence(w)]
        # A turn's best place to cut is the word before it.
        self.turns = [k - 1 for k in range(1, self.n - 1) if words[k].lstrip("[") in ("Speaker", "SPEAKER") and any(p.fullmatch(f"{words[k]} {words[k + 1]}") for p in _TURN)]

    @staticmethod
    def reach(strategy: Strategy) -> int:
        return 2 * (strategy.size + strategy.boundary_window + strategy.overlap) + 3

    def last(self, first: int) -> int:
        """The last word of the chunk that begins at ``first``."""
        s, n = self.strategy, self.n
        target = first + s.size - 1
        if target >= n - 1:
            return n - 1
        low, high = max(first + 1, target - s.boundary_window), min(n - 1, target + s.boundary_window)
        return next((p for p in (_closest(self.turns, low, high, target), _closest(self.stops, low, high, target)) if p is not None), target)

    def next(self, first: int, last: int) -> int:
        """Where the next chunk begins."""
        return max(first + 1, last + 1 - self.strategy.overlap)

    def absorbs(self, last: int, next_last: int) -> bool:
        """Whether a chunk takes in the next one, the text's last, which is too short for itself."""
        return next_last == self.n - 1 and next_last - last < 2 * self.strategy.overlap


def spans(words: list[str], strategy: Strategy = Strategy()) -> list[tuple[int, int]]:
    """First and last word of each chunk; none below the threshold."""
    n = len(words)
    if n < strategy.threshold or not n:
        return []
    cuts, out, first = Cuts(words, strategy), [], 0
    while not out or out[-1][1] < n - 1:
        last = cuts.last(first)
        out.append((first, last))
        first = cuts.next(first, last)
    if len(out) > 1 and cuts.absorbs(out[-2][1], out[-1][1]):
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def chunked(texts: DataFrame, key: str = "folder_name", body: str = "body", strategy: Strategy = Strategy()) -> DataFrame:
    """The chunks of each text: ``key``, SCHEMA, and ``chunk_id``, a fixed function of key and index. No shuffle."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(begin, AT_ONCE) for whole in batches for begin in range(0, whole.num_rows, AT_ONCE)):
            rows = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                words = split_words(text)
                rows += [(at, k, " ".join(words[a : b + 1]), a, b, b - a + 1) for k, (a, b) in enumerate(spans(words, strategy))]
            at, *columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types)]], [key, "chunk_idx", "text", "start_word", "end_word", "word_count"])

    out = texts.select(key, F.col(body).cast("string")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
    return out.withColumn("chunk_id", F.xxhash64(F.col(key), F.col("chunk_idx")))


#: Characters of a text from which on it is chunked by several tasks, and those of a task's part of it.
LONG, PART = 8_000_000, 1_000_000

_PARTS = "part int, own long, text string, ends boolean"
_EXITS = "text_row long, part int, words long, leaves array<long>, before array<long>, chunks array<long>"
_ENTRIES = "text_row long, part int, enters long, before long, chunk_offset long, word_offset long"


def _cut_parts(text: str, size: int, reach: int) -> Iterator[tuple[int, str, bool]]:
    """The text in parts of about ``size`` characters, cut at white space: how long a part is, itself with ``reach`` words
    of what follows, and whether that is all."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        seen = end
        for k, space in enumerate(_SPACE.finditer(text, end)):
            seen = space.start()
            if k > reach:
                break
        else:
            seen = len(text)
        yield end - at, text[at:seen], seen == len(text)
        at = end


def chunked_by_parts(texts: DataFrame, written: Callable[[str, DataFrame], DataFrame], key: str = "folder_name", body: str = "body", strategy: Strategy = Strategy(), part: int = PART) -> DataFrame:
    """What ``chunked`` gives, for texts that are too long for one task: several work on a text. ``written`` stores a table
    under a name and returns it as read again; the result reads it.

    Texts are cut into parts. Where a part's first chunk begins depends on all before it, but only on how far the last chunk
    before reaches in; so each part is chunked from every word at which one can begin, which tells where its chunks leave
    it again, and following these through a text's parts, a few numbers each, gives the ones that count. Then each part's
    chunks are cut out by its own task.
    """
    kind, reach = dict(texts.dtypes)[key], Cuts.reach(strategy)
    parts_schema, exits_schema, entries_schema, chunk_schema = (to_arrow_schema(_parse_datatype_string(d)) for d in (_PARTS, _EXITS, _ENTRIES, SCHEMA))
    # A text is known by a number that its row gets once, as parts are stored: keys may repeat.
    rows = texts.select(F.col(key).alias("text_key"), F.monotonically_increasing_id().alias("text_row"), F.col(body).cast("string").alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(2).to_pylist()):
                text = text or ""
                if len(text) <= part and len(split_words(text)) < strategy.threshold:
                    continue  # no chunks
                for k, (own, piece, ends) in enumerate(_cut_parts(text, part, reach)):
                    values = [pa.array([x], f.type) for x, f in zip((k, own, piece, ends), parts_schema)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), *values], ["text_key", "text_row", *parts_schema.names])

    def prepared(own: int, text: str, ends: bool) -> tuple[list[str], int, Cuts]:
        """The words, how many of them are the part's own, and the cuts."""
        words = split_words(text)
        return words, len(split_words(text[:own])), Cuts(words, strategy)

    def tried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word at which a part's first chunk can begin: where the first one after the part begins (counted from
        the part's end, -1 if there is none), where the chunk before that ends, and how many begin in the part."""
        for batch in batches:
            for row, k, own, text, ends in zip(*[c.to_pylist() for c in batch.columns]):
                words, mine, cuts = prepared(own, text, ends)
                # A text begins with its first word. Chunks from different words soon begin at the same ones.
                few = min(mine, 1 if k == 0 else strategy.size + strategy.boundary_window + 1)
                known: dict[int, tuple[int, int, int]] = {}
                for first in range(few):
                    path = []
                    while first not in known:
                        path.append(first)
                        last = cuts.last(first)
                        follows = -1 if ends and last == cuts.n - 1 else cuts.next(first, last)
                        if 0 <= follows < mine:
                            first = follows
                        else:
                            known[path.pop()] = (-1 if follows < 0 else follows - mine, last - mine, 1)
                    leave, end, chunks = known[first]
                    for at in reversed(path):
                        chunks += 1
                        known[at] = (leave, end, chunks)
                leaves, before, chunks = ([known[at][c] for at in range(few)] for c in range(3))
                told = {"text_row": [row], "part": [k], "words": [mine], "leaves": [leaves], "before": [before], "chunks": [chunks]}
                yield pa.RecordBatch.from_pydict(told, schema=exits_schema)

    def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of exits in order of texts and parts, where each part that begins a chunk is entered."""
        text_row, out, enters, before, chunk, word = None, [], 0, None, 0, 0
        named = lambda rows: pa.RecordBatch.from_pylist([dict(zip(entries_schema.names, r)) for r in rows], schema=entries_schema)
        done: list[tuple] = []
        for batch in batches:
            for row, part, words, leaves, befores, chunks in zip(*[c.to_pylist() for c in batch.columns]):
                if row != text_row:
                    done += out if word >= strategy.threshold else []
                    text_row, out, enters, before, chunk, word = row, [], 0, None, 0, 0
                if 0 <= enters < words:
                    out.append((row, part, enters, before, chunk, word))
                    chunk += chunks[enters]
                    enters, before = leaves[enters], befores[enters]
                elif enters >= 0:  # a part shorter than a chunk
                    enters, before = enters - words, None if before is None else before - words
                word += words
            yield named(done)
            done = []
        yield named(out if word >= strategy.threshold else [])

    def chunks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (own, text, ends, first, before, chunk, word) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]])):
                words, mine, cuts = prepared(own, text, ends)
                found: list[tuple[int, int]] = []
                while first < mine:
                    last = cuts.last(first)
                    final = ends and last == cuts.n - 1
                    if final and (found or before is not None) and cuts.absorbs(found[-1][1] if found else before, last):
                        break  # the chunk before has taken it in
                    follows = cuts.next(first, last)
                    if not final and ends and cuts.absorbs(last, cuts.last(follows)):
                        last = cuts.n - 1
                    found.append((first, last))
                    if last == cuts.n - 1 and ends:
                        break
                    first = follows
                rows = {"chunk_idx": [chunk + k for k in range(len(found))], "text": [" ".join(words[a : b + 1]) for a, b in found], "start_word": [word + a for a, _ in found], "end_word": [word + b for _, b in found], "word_count": [b - a + 1 for a, b in found]}
                columns = [pa.array(c, f.type) for c, f in zip(rows.values(), chunk_schema)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * len(found), pa.int32())), *columns], [key, *rows])

    parts = written("parts", rows.mapInArrow(cut, f"text_key {kind}, text_row long, {_PARTS}").repartition("text_row", "part"))
    exits = written("exits", parts.select("text_row", "part", "own", "text", "ends").mapInArrow(tried, _EXITS))
    entries = exits.repartition("text_row").sortWithinPartitions("text_row", "part").mapInArrow(followed, _ENTRIES)
    # The entries are looked up by part: the parts with their texts aren't sorted.
    out = parts.join(entries.hint("shuffle_hash"), ["text_row", "part"]).select("text_key", "own", "text", "ends", "enters", "before", "chunk_offset", "word_offset").mapInArrow(chunks_of, f"`{key}` {kind}, {SCHEMA}")
    return out.withColumn("chunk_id", F.xxhash64(F.col(key), F.col("chunk_idx")))
