"""Token ids in bit-packed files: written in the order of the documents' ids, read back whole or by position.

Every id takes the bits that the vocabulary needs. A file is a run of blocks of
``BLOCK`` ids, then a footer: the byte offset of each block, and per document its id
and the position of its first token. 64 ids fill exactly ``width`` 64-bit words, so
packing and unpacking are 64 shifts over whole arrays, and any range of ids is read
by seeking to its blocks.

Tasks write files under fresh names; the driver's commit lists them in order in the
folder's manifest, with their counts and with points at which large files are split
for reading. A lost or repeated task leaves nothing that is read.

The rows are dealt out by ranges of the id, so no task holds more than its share, and
encoded after that, next to the writer. The encoder cuts a text before single spaces
and line breaks, where the tokenizer's pattern always cuts, and remembers what the
tokenizer said of each part in a cache of bounded size. Texts with other white space
go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from molspark.llm.text import slices, small_batches, text_bytes
from molspark.staging import fresh_path

MAGIC, MANIFEST = b"IDPACK01", "manifest.json"
END_ID = 0
BLOCK = 1 << 16  # ids per block, a multiple of 64
SPLIT_IDS = 1 << 22  # ids per read partition, about
BATCH_IDS = 1 << 19
CACHE_PARTS, CACHE_LENGTH = 600_000, 40
_ROWS = 256
_TAIL = struct.Struct("<BQQQ8s")  # width, ids, documents, footer's place


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, lowest bit first, filled up with zeros to whole bytes."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((64, groups), np.uint64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes[:] = padded.reshape(groups, 64).T
    words = np.zeros((width, groups), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return words.T.astype("<u8").tobytes()[: -(-len(ids) * width // 8)]


def unpack(packed: bytes, width: int, count: int) -> np.ndarray:
    """The first ``count`` ids of :func:`pack`'s bytes."""
    groups = -(-count // 64)
    words = np.frombuffer(packed.ljust(groups * width * 8, b"\0")[: groups * width * 8], "<u8").reshape(groups, width).T
    lanes, mask = np.empty((64, groups), np.uint64), np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[lane] = value & mask
    return lanes.T.reshape(-1)[:count].astype(np.uint32)


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library, without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._break = np.array(self._whole(["\n"])[0], "<u4")
        self._known: dict[str, bytes | None] = {}
        self._spent = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known, parts, new = self._known, [], set()
        for text in texts:
            part = text.replace("\n", " \n").split(" ")
            part[0] += " "  # the only one without a space or break before it
            parts.append(part)
            new.update([p for p in part if p not in known])
        self._learn(list(new))
        look_up, out = known.__getitem__, []
        for text, part in zip(texts, parts):
            try:
                out.append(b"".join(map(look_up, part)))
            except TypeError:  # a part without an answer of its own
                out.append(np.array(self._whole([text])[0], "<u4").tobytes())
        if len(known) > CACHE_PARTS:
            for part in new:
                del known[part]
            self._spent += len(new)
            if self._spent > 8 * CACHE_PARTS:  # the texts have changed
                known.clear()
                self._spent = 0
        else:
            for part in new:
                if len(part) > CACHE_LENGTH:
                    del known[part]
        return out

    def _learn(self, parts: list[str]) -> None:
        """Puts the ids of new parts into the cache; None where white space would mix with the next part's."""
        plain, single = [], []
        for part in parts:
            body = part[:-1] if part.endswith(" ") else part.removeprefix("\n")
            if body.isspace() or len(body.split()) > 1 or body != body.strip() or not (body or part == " "):
                self._known[part] = None
            elif part == " ":
                self._known[part] = b""
            elif body != part or len(self._break) != 1:
                single.append(part)
            else:
                plain.append(part)
        told = [p[:-1] if p.endswith(" ") else p if p.startswith("\n") else f" {p}" for p in single]
        for part, ids in zip(single, self._whole(told) if told else []):
            self._known[part] = np.array(ids, "<u4").tobytes()
        for at in range(0, len(plain), 4096):  # many parts as one text of lines
            some = plain[at : at + 4096]
            ids = np.array(self._whole(["\n".join(f" {p}" for p in some)])[0], "<u4")
            cuts = np.flatnonzero(ids == self._break[0])
            if len(cuts) != len(some) - 1:
                raise ValueError("the tokenizer joins line breaks with words")
            begins, raw = [0, *(cuts + 1).tolist()], ids.tobytes()
            for part, begin, end in zip(some, begins, [*cuts.tolist(), len(ids)]):
                self._known[part] = raw[4 * begin : 4 * end]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """``id, ids``: every row's ids as little-endian 32-bit numbers in one binary value, with ``end_id`` after them.

    Null and empty texts have the end id alone. Rows keep their order and partition.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    end = b"" if end_id is None else struct.pack("<I", end_id)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in slices(batches, _ROWS):
            texts = [(t or b"").decode() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids + end for ids in encoder(texts)], pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    ids: int
    documents: int
    first: int | None
    last: int | None
    splits: list[int]  # documents at which a new read partition begins


class IdWriter(DataSourceArrowWriter):
    """Writes ``id bigint, ids binary``, sorted by id with nulls first; option ``width`` is the bits of an id."""

    def __init__(self, options: dict) -> None:
        self._path, self._width = options["path"].rstrip("/"), int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self._path)
        name, partition = f"part-{uuid.uuid4().hex}.ids", TaskContext.get().partitionId()
        offsets, starts, names, nulls, splits = [], [], [], [], [0]
        total, waiting, size, out = 0, [], 0, None
        for batch in iterator:
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(MAGIC)
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(packed.as_buffer(), "<u4")
                if len(ids) and int(ids.max()) >> self._width:
                    raise ValueError(f"an id takes more than {self._width} bits")
                if total - (starts[splits[-1]] if starts else 0) > SPLIT_IDS:
                    splits.append(len(starts))
                starts.append(total)
                names.append(key or 0)
                nulls.append(key is None)
                total += len(ids)
                waiting.append(ids)
                size += len(ids)
            if size >= BLOCK:
                joined = np.concatenate(waiting)
                for at in range(0, size - size % BLOCK, BLOCK):
                    offsets.append(out.tell())
                    out.write(pack(joined[at : at + BLOCK], self._width))
                waiting, size = [joined[size - size % BLOCK :]], size % BLOCK
        if out is None:
            return Written(partition, name, 0, 0, None, None, [])
        if size:
            offsets.append(out.tell())
            out.write(pack(np.concatenate(waiting), self._width))
        place = out.tell()
        for part, kind in ((offsets, "<u8"), (starts, "<u8"), (names, "<i8"), (nulls, "u1")):
            out.write(np.array(part, kind).tobytes())
        out.write(_TAIL.pack(self._width, total, len(starts), place, MAGIC))
        out.close()
        known = [n for n, null in zip(names, nulls) if not null]
        return Written(partition, name, total, len(starts), known[0] if known else None, known[-1] if known else None, splits)

    def commit(self, messages: list) -> None:
        fs, base = pafs.FileSystem.from_uri(self._path)
        fs.create_dir(base, recursive=True)
        files, last, start = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.partition), None, 0
        listed = []
        for m in files:
            if m.first is not None and last is not None and m.first < last:
                raise ValueError("rows were not dealt out by ascending id")
            last = m.last if m.last is not None else last
            listed.append({"name": m.name, "ids": m.ids, "documents": m.documents, "start": start, "splits": m.splits})
            start += m.ids
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps({"width": self._width, "ids": start, "files": listed}).encode())

    def abort(self, messages: list) -> None:
        """Nothing to undo: files that no manifest names are never read."""


def manifest(folder: str) -> dict:
    """``width``, ``ids`` and the ``files`` of a folder, each with the position of its first id."""
    fs, base = pafs.FileSystem.from_uri(folder.rstrip("/"))
    with fs.open_input_stream(f"{base}/{MANIFEST}") as file:
        return json.loads(file.read())


class IdFile:
    """One file: its index, and any range of its ids."""

    def __init__(self, path: str) -> None:
        fs, path = pafs.FileSystem.from_uri(path)
        self._file = fs.open_input_file(path)
        end = self._file.size()
        self.width, self.ids, self.documents, place, magic = _TAIL.unpack(self._at(end - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} holds no packed ids")
        blocks = -(-self.ids // BLOCK)
        raw = self._at(place, 8 * blocks + 17 * self.documents)
        self.offsets = np.frombuffer(raw, "<u8", blocks)
        self.starts = np.append(np.frombuffer(raw, "<u8", self.documents, 8 * blocks).astype(np.int64), self.ids)
        self.names = np.frombuffer(raw, "<i8", self.documents, 8 * (blocks + self.documents))
        self.nulls = np.frombuffer(raw, "u1", self.documents, 8 * (blocks + 2 * self.documents)).astype(bool)

    def _at(self, place: int, size: int) -> bytes:
        self._file.seek(place)
        return self._file.read(size)

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` up to ``end``; of the first and last block only the groups of 64 that are needed."""
        parts, end = [np.zeros(0, np.uint32)], min(end, self.ids)
        while begin < end:
            block, skip = divmod(begin, BLOCK)
            stop = min(end - block * BLOCK, BLOCK)
            group = skip // 64
            raw = self._at(int(self.offsets[block]) + group * 8 * self.width, -(-(stop - group * 64) * self.width // 8))
            parts.append(unpack(raw, self.width, stop - group * 64)[skip - group * 64 :])
            begin = block * BLOCK + stop
        return np.concatenate(parts)

    def close(self) -> None:
        self._file.close()


@dataclass
class Documents(InputPartition):
    path: str
    start: int  # position of the file's first id
    first: int
    end: int


@dataclass
class Windows(InputPartition):
    files: list  # path, start, ids
    first: int
    end: int


class IdReader(DataSourceReader):
    """Options: ``path``; ``length`` for windows of so many ids instead of documents."""

    def __init__(self, options: dict) -> None:
        self._path, self._length = options["path"].rstrip("/"), int(options.get("length", 0))

    def partitions(self) -> list[InputPartition]:
        known = manifest(self._path)
        files = [{**f, "path": f"{self._path}/{f['name']}"} for f in known["files"]]
        if not self._length:
            return [Documents(f["path"], f["start"], a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], f["documents"]])]
        out, count, step = [], known["ids"] // self._length, max(1, SPLIT_IDS // self._length)
        for first in range(0, count, step):
            end = min(count, first + step)
            low, high = first * self._length, end * self._length
            held = [(f["path"], f["start"], f["ids"]) for f in files if f["start"] < high and f["start"] + f["ids"] > low]
            out.append(Windows(held, first, end))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what a folder without files is read by
            return iter(())
        return self._windows(partition) if isinstance(partition, Windows) else self._documents(partition)

    def _documents(self, partition: Documents) -> Iterator[pa.RecordBatch]:
        file, at = IdFile(partition.path), partition.first
        while at < partition.end:
            stop = int(np.searchsorted(file.starts, file.starts[at] + BATCH_IDS))
            stop = min(max(stop, at + 1), partition.end, at + 10_000)
            starts = file.starts[at : stop + 1]
            raw = file.read(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
            cuts = (starts - starts[0]) * 4
            ids = pa.array([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file.names[at:stop], mask=file.nulls[at:stop]),
                    pa.array(starts[:-1] + partition.start),
                    pa.array(np.diff(starts)),
                    ids,
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )
            at = stop
        file.close()

    def _windows(self, partition: Windows) -> Iterator[pa.RecordBatch]:
        files = [(IdFile(path), start, ids) for path, start, ids in partition.files]
        step = max(1, BATCH_IDS // self._length)
        for first in range(partition.first, partition.end, step):
            end = min(partition.end, first + step)
            low, high = first * self._length, end * self._length
            ids = np.concatenate([f.read(max(0, low - s), max(0, min(n, high - s))) for f, s, n in files if s < high and s + n > low])
            raw, size = ids.astype("<u4").tobytes(), 4 * self._length
            rows = [raw[k * size : (k + 1) * size] for k in range(end - first)]
            yield pa.RecordBatch.from_arrays([pa.array(range(first, end), pa.int64()), pa.array(rows, pa.binary())], ["window", "ids"])
        for file, *_ in files:
            file.close()


class IdSource(DataSource):
    """``spark.read.format("packed_ids").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        windows = int(self.options.get("length", 0))
        return "window bigint, ids binary" if windows else "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema) -> IdReader:
        return IdReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> IdWriter:
        return IdWriter(dict(self.options))


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = END_ID) -> None:
    """Writes the ids of all rows to a folder, in ascending order of an integer id.

    Null ids come first. Rows of equal id follow the digests of their texts; equal rows
    are all written, and are dealt out like others. Null and empty texts have the end
    id alone. A text of any length is one document over as many blocks as it takes.
    Other columns are not read; an empty table gives a manifest without files.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs.sparkSession.dataSource.register(IdSource)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    width = width_of(_encoder(path).vocabulary)
    encode(dealt, "id", "text", path, end_id).write.format("packed_ids").option("width", str(width)).mode("append").save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document, the number of ids before it, and its ids as little-endian 32-bit numbers."""
    spark.dataSource.register(IdSource)
    return spark.read.format("packed_ids").load(folder)


def read_windows(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """``window, ids``: the stream of all ids cut into windows of ``length``; a shorter rest at the end is left out."""
    spark.dataSource.register(IdSource)
    return spark.read.format("packed_ids").option("length", str(length)).load(folder)


def read_range(folder: str, begin: int, end: int) -> np.ndarray:
    """Ids at positions ``begin`` up to ``end`` of a folder, by seeking to their blocks."""
    parts = [np.zeros(0, np.uint32)]
    for f in manifest(folder)["files"]:
        low, high = max(begin, f["start"]) - f["start"], min(end - f["start"], f["ids"])
        if low < high:
            file = IdFile(f"{folder.rstrip('/')}/{f['name']}")
            parts.append(file.read(low, high))
            file.close()
    return np.concatenate(parts)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col, start, n_tokens, ids`` of every row, read back from files written by :func:`write_ids`."""
    folder = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, folder, id_col, text_col, path)
    return read_documents(docs.sparkSession, folder).withColumnRenamed("doc_id", id_col)
