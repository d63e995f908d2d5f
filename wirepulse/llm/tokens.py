"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the concatenated ids of its documents at the width their vocabulary needs,
the document ends as an Elias-Fano sequence with samples for select, the document
ids, and a footer. Ends take about ``2 + log2(tokens / documents)`` bits each; the offset of
any document comes from one sample, a short stretch of the upper bits and its lower
bits, without a table of 64-bit offsets.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wirepulse.llm.files import attempt_path, create, open_file, output_folder
from wirepulse.session import checkpointed

MAGIC = b"WPTOKEN1"
#: Ones of the upper bits between two select samples.
SAMPLE = 512
#: Pieces of text whose ids a worker remembers, and their ids in all; beyond that only pieces met again in a later block stay.
REMEMBERED, REMEMBERED_IDS = 400_000, 3_200_000
#: Characters of new pieces that the library is given at once, and bytes of texts encoded at a time (a text at least).
STRUNG, BLOCK = 1 << 17, 1 << 21
#: Ids read back at a time (one document at least).
READ_TOKENS = 1 << 21


class Encoder:
    """Ids of whole texts, a column at a time; ids of repeated pieces of text are remembered.

    Where the tokenizer is byte-level BPE with the usual splitting pattern and no
    normalizer, no token crosses the start of a single space, or a single line feed,
    between two characters that are not white space, or goes on from an ASCII letter to an ASCII character that
    is none. Texts are cut there, in one pass over their bytes, and
    each distinct piece is encoded by the library once. Any other tokenizer, and a text that
    holds the string of an added token, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        before = settings.get("pre_tokenizer") or {}
        self.pieces = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and settings.get("normalizer") is None and settings["model"]["type"] == "BPE" and not settings.get("post_processor")
        )
        self.added = [t["content"] for t in settings.get("added_tokens", [])]
        count = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if count <= 1 << 16 else "<u4")
        # A byte-level token has a letter for each of its bytes.
        self.sizes = np.array([len(self.library.id_to_token(i) or "") for i in range(count)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.counts, self.pool, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype), 0
        self.again = np.zeros(1 << 12, bool)

    def _full(self) -> bool:
        return len(self.slots) > REMEMBERED or self.used > REMEMBERED_IDS

    def _thin(self) -> None:
        """Keep the pieces met again since the last time, the oldest of them, up to half of what is remembered."""
        kept = np.flatnonzero(self.again[: len(self.slots)])[: REMEMBERED // 2]
        kept = kept[np.cumsum(self.counts[kept]) <= REMEMBERED_IDS // 2]
        stays = np.zeros(len(self.slots), bool)
        stays[kept] = True
        pieces = [piece for piece, stay in zip(self.slots, stays.tolist()) if stay]  # slots count in the order of the dictionary
        counts = self.counts[kept]
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.starts[kept] - ends + counts, counts) + np.arange(counts.sum())]
        self._forget()
        self._remember(pieces, ids, counts)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _remember(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        first, size = len(self.slots), len(self.slots) + len(pieces)
        while len(self.counts) < size:
            self.starts, self.counts, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.again))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.counts[first:size] = counts
        self.starts[first:size] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.slots.update(zip(pieces, range(first, size)))

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: those that begin with one space or none, strung together, and what is between cut apart by its bytes."""
        held, size, alone = [], 0, []
        for piece in pieces:
            body = piece[1:] if piece[0] == " " else piece
            if body and body == body.strip() and "\u180e" not in body:
                held.append(piece)
                size += len(piece)
                if size >= STRUNG:
                    self._learn_strung(held)
                    held, size = [], 0
            else:
                alone.append(piece)
        if held:
            self._learn_strung(held)
        for piece in alone:
            ids = self._whole(piece)
            self._remember([piece], ids, np.array([len(ids)]))

    def _learn_strung(self, pieces: list[str]) -> None:
        strung = [p if p[0] == " " else "\n" + p for p in pieces]
        ids = self._whole("".join(strung))
        ends = np.cumsum([len(p.encode()) for p in strung])
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")
        counts = np.diff(upto, prepend=0)
        # The line feed put in front of a piece is a token of its own.
        extra = np.array([p[0] != " " for p in pieces])
        first = (upto - counts)[extra]
        self._remember(pieces, np.delete(ids, first), counts - extra)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of a column of strings without nulls, and their number for each string."""
        special = np.zeros(len(column), bool)
        for token in self.added:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not self.pieces:
            special[:] = True
        if not special.any():
            return self._encode_pieces(column)
        usual, counts = self._encode_pieces(column.filter(pa.array(~special)))
        parts, rest, at = [], iter(counts.tolist()), 0
        for text, whole in zip(column.to_pylist(), special.tolist()):
            if whole:
                parts.append(self._whole(text))
            else:
                size = next(rest)
                parts.append(usual[at : at + size])
                at += size
        return np.concatenate([*parts, np.zeros(0, self.dtype)]), np.array([len(p) for p in parts], np.int64)

    def _encode_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._full():
            self._thin()
        offsets, data = _bytes(column)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(column), np.int64)
        begins = _cuts(data, offsets)
        ends = np.append(begins, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        known = self.slots.get
        slots = np.array([known(p, -1) for p in distinct], np.int64)
        new = np.flatnonzero(slots < 0)
        self.again[slots[slots >= 0]] = True
        pieces = [distinct[k] for k in new.tolist()]
        self._learn(pieces)
        slots[new] = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        slots = slots[found.indices.to_numpy()]
        counts = self.counts[slots]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.starts[slots] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(begins, offsets)])

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


#: Bytes of white space of one byte; longer characters of white space by their UTF-8 bytes (fixed values: the Unicode property, and U+180E).
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: ASCII characters that are no letters.
OTHER = ~LETTER & (np.arange(256) < 128)
LONG_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings."""
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: texts, single spaces between other characters, such line feeds and what follows them, what follows letters."""
    blank = BLANK[data]
    for lead in {b[0] for b in LONG_BLANKS}:
        at = np.flatnonzero(data == lead)
        for code in LONG_BLANKS:
            if code[0] == lead and len(at):
                same = at[at + len(code) <= len(data)]
                for k in range(1, len(code)):
                    same = same[data[same + k] == code[k]]
                for k in range(len(code)):
                    blank[same + k] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at + 1 < len(data))]
    at = at[~(blank[at - 1] | blank[at + 1] | cut[at] | cut[at + 1])]
    cut[at] = True
    cut[at[data[at] == 10] + 1] = True
    cut[1:-1] |= LETTER[data[:-1]] & OTHER[data[1:]]
    return np.flatnonzero(cut[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process, kept between its tasks."""
    return Encoder(path)


# ---------------------------------------------------------------- Elias-Fano


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, np.ndarray]:
    """Lower width, lower bits, upper bits and select samples of an ascending sequence."""
    count = len(ends)
    width = max(0, (int(ends[-1]) // count).bit_length() - 1) if count else 0
    lower = []
    for start in range(0, count, 1 << 15):  # multiples of eight values, so blocks join at byte ends
        block = ends[start : start + (1 << 15)].astype(np.uint64)
        bits = (block[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        lower.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    places = (ends >> width) + np.arange(count)
    upper = np.zeros(int(places[-1]) + 1 if count else 0, np.uint8)
    upper[places] = 1
    return width, b"".join(lower), np.packbits(upper, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4")


class Boundaries:
    """Select over an Elias-Fano sequence."""

    def __init__(self, count: int, width: int, lower: bytes, upper: bytes, samples: np.ndarray):
        self.count, self.width, self.samples = count, width, samples
        self.lower, self.upper = np.frombuffer(lower, np.uint8), np.frombuffer(upper, np.uint8)

    def select(self, first: int, last: int) -> np.ndarray:
        """Places in the upper bits of ones number ``first`` to ``last`` (exclusive)."""
        at, wanted = int(self.samples[first // SAMPLE]), first // SAMPLE * SAMPLE
        stop = int(self.samples[(last - 1) // SAMPLE + 1]) if (last - 1) // SAMPLE + 1 < len(self.samples) else len(self.upper) * 8
        start = at // 8
        bits = np.unpackbits(self.upper[start : (stop + 7) // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits) + start * 8
        ones = ones[ones >= at]
        return ones[first - wanted : last - wanted]

    def ends(self, first: int, last: int) -> np.ndarray:
        """Ends of documents ``first`` to ``last`` (exclusive)."""
        index = np.arange(first, last)
        high = (self.select(first, last) - index) << self.width
        if not self.width:
            return high
        bit = index[:, None] * self.width + np.arange(self.width)
        bits = (self.lower[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return high | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def span(self, document: int) -> tuple[int, int]:
        """Start and end of one document."""
        if document:
            start, end = self.ends(document - 1, document + 1)
            return int(start), int(end)
        return 0, int(self.ends(0, 1)[0])


# ---------------------------------------------------------------- files


def write_file(stream, documents: Iterable[tuple[int | None, bytes]], dtype: np.dtype) -> tuple[int, int]:
    """Write ``(id, ids as bytes)`` in order; returns documents and tokens."""
    stream.write(MAGIC)
    names, ends, total = [], [], 0
    for name, ids in documents:
        stream.write(ids)
        total += len(ids) // dtype.itemsize
        names.append(name)
        ends.append(total)
    width, lower, upper, samples = elias_fano(np.array(ends, np.int64))
    missing = np.packbits(np.array([n is None for n in names], bool)).tobytes()
    deltas = np.diff(np.array([n or 0 for n in names], np.int64), prepend=0).tobytes()
    sections = [lower, upper, samples.tobytes(), missing, zstandard.ZstdCompressor().compress(deltas)]
    for section in sections:
        stream.write(section)
    footer = struct.pack("<QQBB5Q", len(names), total, dtype.itemsize, width, *map(len, sections))
    stream.write(footer + struct.pack("<I", len(footer)) + MAGIC)
    return len(names), total


class TokenFile:
    """Random access to the documents of a file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        length, magic = struct.unpack("<I8s", file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError("not a token file")
        count, self.tokens, item, width, *sizes = struct.unpack("<QQBB5Q", file.read_at(length, size - 12 - length))
        self.dtype, self.count = np.dtype(f"<u{item}"), count
        at, sections = len(MAGIC) + self.tokens * item, []
        for part in sizes:
            sections.append(file.read_at(part, at) if part else b"")
            at += part
        lower, upper, samples, missing, deltas = sections
        self.boundaries = Boundaries(count, width, lower, upper, np.frombuffer(samples, "<u4"))
        names = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(deltas), np.int64)) if count else np.zeros(0, np.int64)
        absent = np.unpackbits(np.frombuffer(missing, np.uint8))[:count].astype(bool)
        self.names = [None if gone else int(n) for n, gone in zip(names, absent)]

    def ids(self, start: int, end: int) -> np.ndarray:
        item = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * item, len(MAGIC) + start * item), self.dtype)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, start and ids of every document, read in stretches of about ``READ_TOKENS``."""
        for first in range(0, self.count, 4096):
            last = min(first + 4096, self.count)
            ends = self.boundaries.ends(first, last)
            starts = np.concatenate([[self.boundaries.span(first)[0]], ends[:-1]])
            k = 0
            while k < len(ends):
                stop = max(k + 1, int(np.searchsorted(ends, starts[k] + READ_TOKENS, side="right")))
                block = self.ids(int(starts[k]), int(ends[stop - 1]))
                for d in range(k, stop):
                    yield self.names[first + d], int(starts[d]), block[starts[d] - starts[k] : ends[d] - starts[k]]
                k = stop


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode all texts into files in ascending id order; returns ``(part, path, documents, tokens)``, checkpointed.

    One range shuffle orders the texts; they are encoded after it, so the range sample
    costs no encoding. A null text is empty (its end id alone), null ids come first, and
    rows that repeat an id are ordered by a hash of the text and may span several parts.
    ``tokenizer`` is a path that every executor can read. No rows, no files. Other
    columns are not read.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tied = rows.select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = (F.asc_nulls_first("id"), F.col("hash"), F.col("row"))
    sorted_rows = tied.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = attempt_path(folder, ".tok")

        def documents() -> Iterator[tuple[int | None, bytes]]:
            end = np.array([end_id], codec.dtype).tobytes()
            for batch in batches_left:
                offsets, start = _bytes(batch.column(1))[0], 0
                while start < batch.num_rows:
                    stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
                    block = batch.slice(start, stop - start)
                    ids, counts = codec.encode_column(block.column(1))
                    ends = np.cumsum(counts)
                    for name, a, b in zip(block.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                        yield name, ids[a:b].tobytes() + end
                    start = stop

        batches_left = (b for b in batches if b.num_rows)
        first = next(batches_left, None)
        if first is None:
            return
        rest = batches_left
        batches_left = (b for part in ([first], rest) for b in part)
        codec = encoder(path)
        with create(out) as stream:
            count, total = write_file(stream, documents(), codec.dtype)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [out], "documents": [count], "tokens": [total]})

    return checkpointed(sorted_rows.mapInArrow(run, "part long, path string, documents long, tokens long"))


def read_tokens(files: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document in ``files``, ``start`` counting over all files."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "start", "n_tokens", "ids_crc32")

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=list(names))

        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                with open_file(path) as file:
                    for name, start, ids in TokenFile(file).documents():
                        rows.append((name, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield emit(rows)
                            rows = []
                if rows:
                    yield emit(rows)

    placed = files.select("path", before.alias("base"))
    return placed.repartition(max(1, files.count())).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of all documents to the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    written = write_tokens(docs, output_folder(spark, "tokens"), tokenizer)
    return read_tokens(written).withColumnRenamed("id", "doc_id")
