"""Token ids in seekable files: independent zstandard frames, a checksum for each, and a trailing seek table.

A shard file holds the ids of its documents end to end, as little-endian unsigned integers of two or four bytes (by the
vocabulary's size), cut into frames that decompress on their own. After them comes a skippable frame with the document
index (ids and lengths), and a seek table as in zstandard's published seekable format: compressed size, decompressed
size and the low 32 bits of XXH64 for each frame. A reader fetches the table, the index and then only the frames that
overlap the documents it wants.

Shards follow each other in ascending document id. A shard is written under a name of its own attempt and then moved,
so a task that is lost or run twice leaves either nothing or the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import byte_alphabet
from lectern.llm.common import free_name

VOCABULARY = "word_bpe_49k.json"
#: The id that ends each document.
END = 1
#: Bytes of ids in a frame, about; a longer document is cut into frames of this size.
FRAME = 1 << 18
LEVEL = 3
#: Words, and parts of words, whose ids are remembered in a worker; beyond that the memory starts anew. A part that is
#: forgotten costs several times what a word does whose parts are known.
REMEMBERED, PARTS = 450_000, 1_200_000
#: Parts that the library's model encodes in one go.
JOINED = 256

_SKIPPABLE, _SEEK_TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them for this word-level vocabulary file.

    The vocabulary drops white space and never merges over it, so words between ASCII white space are encoded on their
    own and remembered. A word of Latin letters only (below U+0300, where lower case and composition are fixed) is
    normalised and cut here and its parts go to the library's model; any other word goes through all of the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends_part = np.zeros(size, bool)
        for piece, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends_part[i] = piece.endswith("</w>")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.may_fold = all("<|" in s for s in self.special)
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.pattern = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # \n parts the words here
        self.beyond = regex.compile("[̀-􏿿]|" + "|".join(map(regex.escape, self.special)))
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found: dict[bytes, bytes] = {}
        if self.beyond.search("\n".join(texts)):
            is_odd = [self.beyond.search(t) is not None for t in texts]
            odd = [(w, t) for w, t, o in zip(words, texts, is_odd) if o]
            for (word, _), e in zip(odd, self.whole.encode_batch_fast([t for _, t in odd], add_special_tokens=False)):
                found[word] = np.array(e.ids, self.dtype).tobytes()
            words = [w for w, o in zip(words, is_odd) if not o]
            texts = [t for t, o in zip(texts, is_odd) if not o]
        if not words:
            return found
        cut = self.pattern.findall("\n".join(texts).lower() + "\n")
        if len(self.parts) > PARTS:
            self.parts.clear()
        self.parts["\n"] = b""
        new = list(set(cut) - self.parts.keys())
        self.parts.update(zip(new, self._parts(new)))
        ids = list(map(self.parts.__getitem__, cut))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.cumsum(sizes)[sizes == 0].tolist()
        data = b"".join(ids)
        found.update((w, data[a:b]) for w, a, b in zip(words, [0, *ends], ends))
        return found

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The model's ids of parts. They are joined by spaces, and told apart by the ids that end a word."""
        shown = [p if p.isascii() and p.isprintable() else "".join([self.shown[b] for b in p.encode()]) for p in parts]
        lines = [" ".join(shown[k : k + JOINED]) for k in range(0, len(shown), JOINED)]
        width, out = self.dtype.itemsize, []
        for e in self.model.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self.ends_part[ids]) + 1) * width
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        if len(out) != len(parts):
            raise ValueError("this vocabulary doesn't mark where words end")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        rows, missing, get = [], set(), self.words.get
        for text in texts:
            raw = text.encode("utf-8", "replace")
            words = (raw.lower() if self.may_fold and b"<|" not in raw else raw).split()  # the case of special tokens counts
            got = list(map(get, words))
            if None in got:
                missing.update([w for w, ids in zip(words, got) if ids is None])
            rows.append((words, got))
        found = self._learn(list(missing)) if missing else {}
        out = [b"".join([found[w] if ids is None else ids for w, ids in zip(*row)] if missing else row[1]) for row in rows]
        if len(self.words) + len(found) > REMEMBERED:
            self.words.clear()
        self.words.update((w, ids) for w, ids in found.items() if len(w) < 100)
        return out


#: One for each file in a worker: tasks that follow find the words of those before.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Writes one shard to a binary stream, frame by frame."""

    def __init__(self, out: BinaryIO, dtype: np.dtype, frame: int = FRAME):
        import zstandard

        self.out, self.dtype, self.frame = out, dtype, frame
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(data) // self.dtype.itemsize)
        for at in range(0, len(data), self.frame):
            part = data[at : at + self.frame]
            if self.size and self.size + len(part) > self.frame:
                self.flush()
            self.held.append(part)
            self.size += len(part)

    def flush(self) -> None:
        from xxhash import xxh64_intdigest

        data = b"".join(self.held)
        packed = self.press.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = struct.pack("<BQ", self.dtype.itemsize, len(self.ids)) + known.tobytes()
        index += np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        packed = self.press.compress(index)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *row) for row in self.table)
        self.out.write(struct.pack("<II", _SEEK_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE))


class ShardReader:
    """Reads one shard from a seekable binary stream."""

    def __init__(self, file: BinaryIO, size: int):
        import zstandard

        self.file, self.unpress = file, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or flags != 0x80:
            raise ValueError("not a seekable token file: its seek table is missing")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.ends = np.cumsum(table[:-1, 1])  # of the frames' contents
        self.sums = table[:-1, 2]
        head = self._at(int(self.starts[n - 1]), int(table[-1, 0]))
        index = self.unpress.decompress(head[8:])
        width, docs = struct.unpack_from("<BQ", index)
        self.dtype = np.dtype(f"<u{width}")
        known = np.frombuffer(index, np.uint8, docs, 9)
        ids = np.frombuffer(index, "<i8", docs, 9 + docs)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        self.lengths = np.frombuffer(index, "<u8", docs, 9 + 9 * docs).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        from xxhash import xxh64_intdigest

        if self._last[0] != k:
            data = self.unpress.decompress(self._at(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])))
            if xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self._last = (k, data)
        return self._last[1]

    def document(self, position: int) -> np.ndarray:
        """The ids of the document at a position in the shard; only the frames that it overlaps are decompressed."""
        width = self.dtype.itemsize
        first, last = int(self.offsets[position]) * width, int(self.offsets[position + 1]) * width
        parts, k = [], int(np.searchsorted(self.ends, first, side="right"))
        while first < last:
            start = int(self.ends[k - 1]) if k else 0
            part = self.frame(k)[first - start : last - start]
            parts.append(part)
            first += len(part)
            k += 1
        return np.frombuffer(b"".join(parts), self.dtype)


class Shard(NamedTuple):
    shard: int
    path: str
    n_docs: int
    n_tokens: int


def write(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end: int = END, shards: int | None = None) -> list[Shard]:
    """Encodes every whole text and writes the shards to ``folder``, which driver and executors share.

    Documents ascend by id (null ids first), rows of one id by a hash of their text. Null texts are empty: the end id
    alone. Repeated rows are all written. ``shards`` defaults to the session's shuffle partitions. Returns the shards
    in order; an empty table has none.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, top = FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        temporary = f"{top}/.{part:06d}-{uuid.uuid4().hex}"
        words = encoder(path)
        writer = out = None
        stop = np.array([end], words.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(temporary)
                    writer = ShardWriter(out, words.dtype)
                for i, ids in zip(rows.column(0).to_pylist(), words.encode(rows.column(1).to_pylist())):
                    writer.add(i, ids + stop)
        if writer:
            writer.close()
            out.close()
            final = f"{top}/{part:06d}.ids.zst"
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pylist([{"shard": part, "path": f"{folder.rstrip('/')}/{part:06d}.ids.zst", "n_docs": len(writer.ids), "n_tokens": sum(writer.lengths)}])

    made = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")
    return sorted(Shard(*row) for row in made.collect())


def read(spark: SparkSession, shards: list[Shard], digest: bool = False) -> DataFrame:
    """The documents of written shards: ``doc_id, start, n_tokens`` and ``ids``, or with ``digest`` their ``ids_crc32``.

    ``start`` is the number of ids of all documents before it; the sum is over 32-bit little-endian ids.
    """
    result = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    before, rows = 0, []
    for s in shards:
        rows.append((s.path, before))
        before += s.n_tokens
    if not rows:
        return spark.createDataFrame([], result)
    table = spark.createDataFrame(rows, "path string, before long").repartition(len(rows), "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                fs, at = FileSystem.from_uri(row["path"])
                with fs.open_input_file(at) as file:
                    shard = ShardReader(file, file.size())
                    for k in range(0, len(shard.doc_ids), 1024):
                        span = range(k, min(k + 1024, len(shard.doc_ids)))
                        ids = [shard.document(p).astype("<u4") for p in span]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[span.start : span.stop], pa.int64()),
                                pa.array(shard.offsets[span.start : span.stop] + row["before"]),
                                pa.array(shard.lengths[span.start : span.stop]),
                                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                        )

    return table.mapInArrow(run, result)


def documents(shards: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Only the documents whose ids are in ``wanted``: (doc_id, ids), decompressing only the frames that hold them.

    ``shards`` is a table with a ``path`` column. Each shard's ids are joined with the wanted ones, and what matches is
    read by position.
    """

    def listing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    ids = ShardReader(file, file.size()).doc_ids
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(ids, pa.int64()), pa.array(range(len(ids)), pa.int64())], ["path", "found", "position"])

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        open_path, shard, file = None, None, None
        for batch in batches:
            out = []
            for path, found, position in zip(*[c.to_pylist() for c in batch.columns]):
                if path != open_path:
                    fs, at = FileSystem.from_uri(path)
                    file = fs.open_input_file(at)
                    open_path, shard = path, ShardReader(file, file.size())
                out.append(shard.document(position).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    listed = shards.select("path").mapInArrow(listing, "path string, found long, position long")
    key = free_name(listed, "wanted_id")
    chosen = listed.join(wanted.select(F.col(doc_id).cast("long").alias(key)).distinct(), F.col("found") == F.col(key), "left_semi")
    return chosen.repartition("path").sortWithinPartitions("path", "position").mapInArrow(fetch, "doc_id long, ids array<long>")
