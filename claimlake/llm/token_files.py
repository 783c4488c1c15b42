"""Token ids of a corpus in length-delimited binary records with an offset index.

A data file is a run of records::

    length of the payload      8 bytes, little-endian
    masked CRC-32 of the length  4 bytes
    payload                    document id (8 bytes), then 2 or 4 bytes for each token id
    masked CRC-32 of the payload 4 bytes

The mask rotates the checksum right by 15 bits and adds 0xa282ead8, so data that hold checksums
keep a useful checksum of their own.  Beside each data file, ``.idx`` holds the byte offset of each
record (8 bytes each) for reads in any order.

Files hold ascending document ids; a range exchange and a sort inside each range are all the
order needs.  Where a file's ids begin is the sum over the files before it.  Files are
written under a name of the task attempt and renamed, so a repeated task replaces its own work; an attempt that fails
removes its unfinished file, and what a lost executor leaves is in no list of files.

Null and empty texts have the end id alone; null ids come first; rows of one id are in the order of a hash of their texts, each with a
record of its own.  Other columns are not used.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, shared_path, until_the_end
from .words import U64, mix, text_blocks

END_ID = 2
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where texts may be cut without changing their tokens, and which of them follow a space.

    Pre-tokens hold a space only at their start or are white space throughout, so a cut before a space
    that follows a character other than white space is always between two of them.  Unicode white space is found by its
    last bytes, generously: a place left out only makes a piece longer.
    """
    n = len(buffer)
    space = buffer == 0x20
    before = np.concatenate([[0x20], buffer[:-1]])
    lead = np.concatenate([[0, 0], buffer[:-2]])[:n]
    lead3 = np.concatenate([[0, 0, 0], buffer[:-3]])[:n]
    wide = (before >= 0x80) & ((lead == 0xC2) | (lead3 == 0xE1) | (lead3 == 0xE2) | (lead3 == 0xE3))
    at = space & ~_WHITE[before] & ~wide
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < n]
    at[first] = True
    starts = np.flatnonzero(at)
    at[first] = False
    return starts, at[starts]


class PieceEncoder:
    """Token ids of whole texts; each distinct piece is encoded once and remembered.

    At most ``most_pieces`` are remembered; beyond that the memory starts anew.
    """

    def __init__(self, path: str, most_pieces: int = 1_500_000):
        self.most_pieces = most_pieces
        self._forget()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for piece, i in vocabulary.items():
            self.n_bytes[i] = len(piece.encode()) if piece in special else len(piece)
        self.powers = np.zeros(0, U64)

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in found]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of each."""
        raw = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not raw:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        buffer, ends = np.frombuffer(raw, np.uint8), np.cumsum(sizes)
        starts, regular = _cuts(buffer, ends)
        stops = np.append(starts[1:], len(buffer))
        regular &= np.append(regular[1:], False)  # in a line, the next piece's space must be a cut as well
        keys = self._keys(buffer, starts, stops)
        keys, where, which = np.unique(keys, return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True) if len(self.keys) else np.ones(len(keys), bool)
        if len(self.keys) + new.sum() > self.most_pieces and len(self.keys):
            self._forget()
            new[:] = True
        where = where[new]
        self._remember(keys[new], *self._distinct(raw, starts[where], stops[where], regular[where]))
        entry = np.searchsorted(self.keys, keys)[which]
        length, begin = self.length[entry], self.begin[entry]
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        owner = np.searchsorted(ends, starts, "right")
        return self.pool[place], np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)

    def _forget(self) -> None:
        self.keys, self.begin, self.length, self.pool = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _remember(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        begin = np.concatenate([self.begin, first[:-1] + len(self.pool)])
        length = np.concatenate([self.length, np.diff(first)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.length = keys[order], begin[order], length[order]
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def _keys(self, buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit names of the pieces of one block."""
        base, n = 0x9E3779B97F4A7C15, len(buffer)
        with np.errstate(over="ignore"):
            if len(self.powers) < n:
                p = np.full(n, base, U64)
                p[0] = 1
                self.powers = np.multiply.accumulate(p)
                q = np.full(n, pow(base, -1, 1 << 64), U64)
                q[0] = 1
                self.inverse = np.multiply.accumulate(q)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(np.arange(1, 257, dtype=U64))[buffer] * self.powers[:n])])
            return mix((sums[stops] - sums[starts]) * self.inverse[starts]) ^ (stops - starts).astype(U64)

    def _distinct(self, raw: bytes, starts: np.ndarray, stops: np.ndarray, regular: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece and where they begin; pieces that begin with a space are encoded as long lines."""
        lines, groups = [], []
        order = np.flatnonzero(regular)
        for k in range(0, len(order), 4096):
            group = order[k : k + 4096]
            lines.append(b"".join(raw[a:b] for a, b in zip(starts[group], stops[group])))
            groups.append(group)
        odd = np.flatnonzero(~regular)
        found = self._ids(lines + [raw[starts[i] : stops[i]] for i in odd])
        counts = np.zeros(len(starts), np.int64)
        for group, ids in zip(groups, found):
            reach = np.cumsum(stops[group] - starts[group])
            at = np.searchsorted(np.cumsum(self.n_bytes[ids]), reach)  # the token that ends with each piece
            counts[group] = np.diff(at + 1, prepend=0)
        counts[odd] = [len(x) for x in found[len(lines) :]]
        first = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(first[-1]), np.int64)
        for group, ids in zip(groups, found):
            self._place(out, first, group, counts, ids)
        if len(odd):
            self._place(out, first, odd, counts, np.concatenate([np.zeros(0, np.int64), *found[len(lines) :]]))
        return out, first

    @staticmethod
    def _place(out: np.ndarray, first: np.ndarray, group: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        n = counts[group]
        out[np.repeat(first[group] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(ids))] = ids


@functools.lru_cache(1)
def encoder_of(path: str) -> PieceEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return PieceEncoder(path)


def _masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", _masked(size)), payload, struct.pack("<I", _masked(payload))))


def unframe(data: memoryview | bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next begins; raises where checksums differ."""
    size = bytes(data[at : at + 8])
    (n,), (crc,) = struct.unpack("<Q", size), struct.unpack("<I", data[at + 8 : at + 12])
    if crc != _masked(size):
        raise ValueError(f"length checksum differs at byte {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) != n or struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != _masked(payload):
        raise ValueError(f"payload checksum differs at byte {at}")
    return payload, at + 16 + n


NO_ID = -(1 << 63)
MOST_READERS = 10_000  # tasks, each of which reads its files one by one


class _Writer:
    """One data file and its index."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(folder)
        self.name = f"{root}/{uuid.uuid4().hex}"
        self.data, self.offsets, self.at = self.files.open_output_stream(f"{self.name}.part"), [], 0

    def write(self, payload: bytes) -> None:
        record = frame(payload)
        self.data.write(record)
        self.offsets.append(self.at)
        self.at += len(record)

    def drop(self) -> None:
        self.data.close()
        self.files.delete_file(f"{self.name}.part")

    def close(self) -> str:
        self.data.close()
        with self.files.open_output_stream(f"{self.name}.idx") as index:
            index.write(np.array(self.offsets, "<u8").tobytes())
        self.files.move(f"{self.name}.part", f"{self.name}.rec")
        return self.name.rsplit("/", 1)[1]


_FILES = "name string, first_id long, last_id long, n_docs long, n_tokens long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, width: str, block_bytes: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    encoder, writer, done = encoder_of(tokenizer), None, []

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"name": writer.close(), "first_id": done[0], "last_id": done[1], "n_docs": done[2], "n_tokens": done[3]}], schema=pa.schema([("name", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    most = np.iinfo(width).max
    try:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, block in text_blocks(batch.column(1).to_pylist(), block_bytes):
                ids, counts = encoder.encode(block)
                if len(ids) and ids.max() > most:
                    raise ValueError(f"token id {ids.max()} does not fit into {width}")
                ends = np.cumsum(counts)
                ids = ids.astype(width)
                for i, a, b in zip(doc_ids[start : start + len(block)], ends - counts, ends):
                    if writer is None:
                        writer, done = _Writer(folder), [i, i, 0, 0]
                    payload = struct.pack("<q", NO_ID if i is None else i) + ids[a:b].tobytes() + np.array([END_ID], width).tobytes()
                    writer.write(payload)
                    done = [done[0], i, done[2] + 1, done[3] + int(b - a) + 1]
                    if writer.at >= file_bytes:
                        yield closed()
                        writer = None
        if writer is not None:
            yield closed()
            writer = None
    finally:
        if writer is not None:
            writer.drop()


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, width: str = "<u2", block_bytes: int = 4 << 20, file_bytes: int = 32 << 20) -> DataFrame:
    """Write ``docs`` to ``folder`` in ascending id order (null ids first); one row for each file.

    Null and empty texts have the end id alone.  ``width`` is ``<u2`` for vocabularies under 65,536, else ``<u4``.
    """
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    return rows.mapInArrow(lambda b: _write(b, folder, tokenizer, width, block_bytes, file_bytes), _FILES)


def _read(batches: Iterator[pa.RecordBatch], folder: str, width: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            files, root = fs.FileSystem.from_uri(folder)
            with files.open_input_stream(f"{root}/{name}.idx") as index:
                offsets = np.frombuffer(index.read(), "<u8")
            doc_ids, counts, crcs = [], [], []
            with files.open_input_file(f"{root}/{name}.rec") as source:
                data = memoryview(source.read_buffer())
                for at in offsets:
                    payload, _ = unframe(data, int(at))
                    (i,) = struct.unpack("<q", payload[:8])
                    ids = np.frombuffer(payload, width, offset=8)
                    doc_ids.append(None if i == NO_ID else i)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]]) if counts else []
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame, folder: str, width: str = "<u2") -> DataFrame:
    """Read the files of ``write_token_files`` back by their indexes and check every record."""
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "name").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # one row for each file
    return placed.select("name", "start").repartition(max(1, min(MOST_READERS, files.count())), "name").mapInArrow(lambda b: _read(b, folder, width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    folder = shared_path(docs.sparkSession, "tokens")
    until_the_end(docs.sparkSession, folder)
    return read_token_files(cut(write_token_files(docs, folder)), folder)
