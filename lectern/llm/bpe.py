"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into pieces, pieces not seen before are merged together: the symbols of all of them lie in one flat
array, and each round looks every neighbouring pair up by binary search in the sorted pair keys, finds the lowest
rank within each piece and merges all of that pair's occurrences there. Pieces without a known pair leave the array.
A piece takes as many rounds as ranks occur in it, so unbroken runs of over LONG bytes don't go in rounds: their pairs,
looked up in the same way, wait in a heap by rank and place.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_column

VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose ids are remembered in a worker; beyond that the memory starts anew.
REMEMBERED = 800_000
#: Bytes merged in one batch of rounds, and bytes of a piece that is merged in rounds at most.
BATCH, LONG = 4_000_000, 512

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = np.int64(2**40)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        out[chr(256 + k)] = b
    return out


class Vocabulary:
    """Merge tables and byte strings of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for text, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.all_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.rank_of: dict[int, int] = {}

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge_long(self, piece: bytes) -> bytes:
        """The ids of one piece: the pair of lowest rank is merged, of equal ones the first, until none is known."""
        packed = self.of_byte[np.frombuffer(piece, np.uint8)]
        symbols, n = packed.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._ranks(packed[:-1] << 32 | packed[1:])
        known = np.flatnonzero(ranks != _NONE)
        heap = (ranks[known] << 32 | known).tolist()
        heapq.heapify(heap)
        if not self.rank_of:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        rank_of, merged, push, pop = self.rank_of.get, self.merged.tolist() if heap else [], heapq.heappush, heapq.heappop
        while heap:
            entry = pop(heap)
            k = entry & 0xFFFFFFFF
            j = after[k]
            if symbols[k] < 0 or j >= n or rank_of(symbols[k] << 32 | symbols[j]) != entry >> 32:
                continue  # one of the two has been merged since
            symbols[k], symbols[j] = merged[entry >> 32], -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                rank = rank_of(symbols[k] << 32 | symbols[j])
                if rank is not None:
                    push(heap, rank << 32 | k)
            i = before[k]
            if i >= 0:
                rank = rank_of(symbols[i] << 32 | symbols[k])
                if rank is not None:
                    push(heap, rank << 32 | i)
        left = np.array(symbols, np.int64)
        return left[left >= 0].astype("<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (none of them empty), as little-endian unsigned 32-bit integers."""
        if any(len(p) > LONG for p in pieces):
            short = iter(self.merge([p for p in pieces if len(p) <= LONG]))
            return [self.merge_long(p) if len(p) > LONG else next(short) for p in pieces]
        out = [b""] * len(pieces)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        while len(symbols):
            # Ranks of the pair that begins at each symbol; none at a piece's last symbol.
            pair = np.full(len(symbols), _NONE)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pair[inside] = self._ranks(symbols[inside] << 32 | symbols[inside + 1])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(pair, first)
            done = lowest == _NONE
            sizes = np.diff(np.append(first, len(symbols)))
            if done.any():
                left = ~np.repeat(done, sizes)
                ready = symbols[~left].astype("<u4").tobytes()
                ends = np.cumsum(sizes[done]) * 4
                for k, start, end in zip(owner[first[done]].tolist(), (ends - sizes[done] * 4).tolist(), ends.tolist()):
                    out[k] = ready[start:end]
                symbols, owner, pair = symbols[left], owner[left], pair[left]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            chosen = pair == np.repeat(lowest, sizes)
            hit = np.flatnonzero(chosen)
            # In a run such as "aaa" the pairs overlap: every second one counts, from the left.
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[pair[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each cut by the pattern on its own."""
        cut = [self.pattern.findall(c) for c in chunks]
        ids: dict[str, bytes] = {}
        batch: list[str] = []
        held = 0
        for piece in {p for pieces in cut for p in pieces}:
            batch.append(piece)
            held += len(piece)
            if held >= BATCH:
                ids.update(zip(batch, self.merge([p.encode("utf-8", "replace") for p in batch])))
                batch, held = [], 0
        ids.update(zip(batch, self.merge([p.encode("utf-8", "replace") for p in batch])))
        return [ids[p[0]] if len(p) == 1 else b"".join([ids[x] for x in p]) for p in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers.

        Between two characters that aren't white space, a single space always begins a piece. So texts are cut there
        and what follows each such space is remembered by its ids. Texts with other white space beside a space, or
        with a special token, are cut in larger parts.
        """
        get, rows, missing, odd, heads = self.known.get, [], set(), [], []
        for k, text in enumerate(texts):
            head, *rest = text.split(" ")
            got = list(map(get, rest))
            new = [w for w, ids in zip(rest, got) if ids is None] if None in got else []
            if not head or head[-1].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w in new) or self.at_special and self.at_special.search(text):
                odd.append(k)
                rows.append(None)
                continue
            missing.update(new)
            heads.append(head)
            rows.append((rest, got))
        words = list(missing)
        learnt = self.learn([*heads, *[" " + w for w in words]])
        found = dict(zip(words, learnt[len(heads) :]))
        begins = iter(learnt)
        out = [b"" if row is None else next(begins) + b"".join([found[w] if ids is None else ids for w, ids in zip(*row)] if missing else row[1]) for row in rows]
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        self.known.update((w, ids) for w, ids in found.items() if len(w) < 100)
        for k in odd:
            parts = self.at_special.split(texts[k]) if self.at_special else [texts[k]]
            out[k] = b"".join([self.special[x].to_bytes(4, "little") if at % 2 else b"".join(self.learn(chunked(x))) for at, x in enumerate(parts)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.all_bytes[at].tobytes().decode("utf-8", "replace")


def chunked(text: str) -> list[str]:
    """``text`` cut before each single space that stands between characters other than white space."""
    if not text:
        return []
    first, *rest = text.split(" ")
    chunks = [first, *[" " + x for x in rest]]
    if all(x and not x[0].isspace() and not x[-1].isspace() for x in rest) and (first and not first[-1].isspace() or not rest):
        return chunks
    out = [chunks[0]]
    for chunk in chunks[1:]:
        if len(chunk) == 1 or chunk[1].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] += chunk  # white space beside this space: not a safe cut
        else:
            out.append(chunk)
    return out


#: One for each file in a worker: tasks that follow find the pieces of those before.
_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoded(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text as an ``array<int>`` column. Null texts count as empty."""

    def make() -> Callable[[list], dict[str, pa.Array]]:
        words = vocabulary(path)

        def work(texts: list) -> dict[str, pa.Array]:
            rows = words.encode([t or "" for t in texts])
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            return {out: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))}

        return work

    return map_column(docs, F.col(text), f"`{out}` array<int>", make, keep)


def decoded(docs: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the text of each row's ids, special tokens included. Null ids give a null text."""

    def make() -> Callable[[list], dict[str, pa.Array]]:
        words = vocabulary(path)
        return lambda rows: {out: pa.array([None if r is None else words.decode(np.array(r, np.int64)) for r in rows], pa.string())}

    return map_column(docs, F.col(ids), f"`{out}` string", make, keep)


def digests(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each whole text, and SHA-256 of its ids and of the text decoded from them.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8. Null texts count as empty
    (no tokens), rows that repeat are encoded alike, an empty table gives an empty result, and columns of ``docs``
    that bear a result's name are replaced. One pass, no shuffle.
    """

    def make() -> Callable[[list], dict[str, pa.Array]]:
        words = vocabulary(path)

        def work(texts: list) -> dict[str, pa.Array]:
            rows = words.encode([t or "" for t in texts])
            back = [words.decode(np.frombuffer(r, "<u4")).encode("utf-8", "replace") for r in rows]
            return {
                "n_tokens": pa.array([len(r) // 4 for r in rows], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rows]),
                "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
            }

        return work

    return map_column(docs, F.col(text), FIELDS, make, keep)
