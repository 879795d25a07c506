"""Token ids in one wavelet matrix file for each shard (operator 13).

Documents are range-partitioned by id; every task encodes its documents in order (each distinct unit of text, some white space and what
follows up to the next, once) and cuts a file whenever it holds ``shard_tokens`` ids, so shards are runs of
consecutive documents and no table of ids is stored or exchanged.  A file is written under a temporary name and renamed, and its name depends on the
partition alone: a repeated task replaces its own files.  The table of files (part, seq, name, counts) is the record of what was written; ids before a
file are running sums over it.

The file holds a wavelet matrix (Claude and Navarro, "The wavelet matrix", 2012): one plane for each bit of an id, highest first; after
each plane the ids are parted by that bit, zeros first, in stable order.  A plane is cut into blocks of 65,536 bits, compressed one by one where that is
shorter, with the number of ones before each block in the directory.  So ``access`` (id at a position), ``rank`` and ``count`` (occurrences of an id)
and ``select`` (place of its j-th occurrence) read the directory and about one block for each plane, not the file.

    "WVM1" | planes u4 | ids u8 | documents u8 | blocks in a plane u8 | directory: (offset u8, bytes u4, packed u4, ones before u8) plane by plane |
    zeros in each plane u8 | document ids i8 | 1 where the id is present u1 | ids up to each document's end u8 | blocks

Numbers are little-endian.  The folder may be any that pyarrow opens by URI (file, hdfs, s3, gs) and all executors share.

Defined cases: a null text is empty, and an empty text has the end id only; null ids come first; documents of equal id stand by the checksum of their text, equal rows beside
each other; a very long text is encoded whole, window by window of units, and may make a file longer than ``shard_tokens``; an empty table gives no files and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import materialise, slices

END = 0
SHARD_TOKENS = 1 << 22
BLOCK_BITS = 1 << 16
WINDOW = 1 << 23
MAGIC = b"WVM1"
HEAD = np.dtype([("magic", "S4"), ("planes", "<u4"), ("n", "<u8"), ("docs", "<u8"), ("blocks", "<u8")])
ENTRY = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("packed", "<u4"), ("before", "<u8")])


# ---- the file

def pack_shard(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """The file of one shard: its ids and, for each document, its id and where it ends."""
    n, planes = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    blocks = -(-n // BLOCK_BITS)
    directory, zeros, data = np.zeros((planes, blocks), ENTRY), np.zeros(planes, "<u8"), []
    packer = zstandard.ZstdCompressor(level=1)
    left = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes):
        bits = (left & left.dtype.type(1 << (planes - 1 - plane))) != 0
        raw = np.packbits(bits, bitorder="little").tobytes()
        before = 0
        for b in range(blocks):
            own = raw[b * BLOCK_BITS // 8:(b + 1) * BLOCK_BITS // 8]
            short = packer.compress(own)
            packed = len(short) < len(own)
            data.append(short if packed else own)
            directory[plane, b] = (0, len(data[-1]), packed, before)
            before += int(np.count_nonzero(bits[b * BLOCK_BITS:(b + 1) * BLOCK_BITS]))
        zeros[plane] = n - before
        left = np.concatenate([left[~bits], left[bits]])
    head = np.array([(MAGIC, planes, n, len(doc_ids), blocks)], HEAD).tobytes()
    tables = [zeros.tobytes(), np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
              np.array([d is not None for d in doc_ids], "u1").tobytes(), np.asarray(ends, "<u8").tobytes()]
    first = len(head) + directory.nbytes + sum(map(len, tables))
    sizes = directory["bytes"].ravel().astype(np.uint64)
    directory["offset"] = (first + np.cumsum(sizes) - sizes).reshape(directory.shape)
    return b"".join([head, directory.tobytes(), *tables, *data])


class Shard:
    """A file, read block by block; at most ``cached`` blocks are kept."""

    def __init__(self, source, cached: int = 64) -> None:
        self.source, self.cached, self.kept = source, cached, {}
        head = np.frombuffer(self._read(0, HEAD.itemsize), HEAD)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.planes, self.n, docs, self.blocks = (int(head[x]) for x in ("planes", "n", "docs", "blocks"))
        at = HEAD.itemsize
        parts = []
        for kind, count in ((ENTRY, self.planes * self.blocks), ("<u8", self.planes), ("<i8", docs), ("u1", docs), ("<u8", docs)):
            size = np.dtype(kind).itemsize * count
            parts.append(np.frombuffer(self._read(at, size), kind))
            at += size
        self.directory = parts[0].reshape(self.planes, self.blocks)
        self.zeros, self.doc_ids, self.present, self.ends = parts[1].astype(np.int64), parts[2], parts[3].astype(bool), parts[4].astype(np.int64)
        self.starts = np.append(0, self.ends[:-1]) if docs else self.ends

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _bits(self, plane: int, block: int) -> np.ndarray:
        entry = self.directory[plane, block]
        raw = self._read(int(entry["offset"]), int(entry["bytes"]))
        raw = zstandard.ZstdDecompressor().decompress(raw) if entry["packed"] else raw
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a block and the ones up to each of them."""
        key = (plane, block)
        if key not in self.kept:
            if len(self.kept) >= self.cached:
                self.kept.pop(next(iter(self.kept)))
            bits = self._bits(plane, block)
            self.kept[key] = bits, np.append(0, np.cumsum(bits, dtype=np.int64)) + int(self.directory[plane, block]["before"])
        return self.kept[key]

    def _ones(self, plane: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        if at >= self.n:
            return self.n - int(self.zeros[plane])
        return int(self._block(plane, at // BLOCK_BITS)[1][at % BLOCK_BITS])

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            bit = int(self._block(plane, at // BLOCK_BITS)[0][at % BLOCK_BITS])
            ones = self._ones(plane, at)
            at = int(self.zeros[plane]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        """Where the occurrences of an id among the first ``at`` ids end up behind the last plane."""
        if not 0 <= token < 1 << self.planes:
            return 0, 0
        low, high = 0, at
        for plane in range(self.planes):
            a, b = self._ones(plane, low), self._ones(plane, high)
            one = token >> (self.planes - 1 - plane) & 1
            low, high = (int(self.zeros[plane]) + a, int(self.zeros[plane]) + b) if one else (low - a, high - b)
        return low, high

    def rank(self, token: int, at: int) -> int:
        """Occurrences of an id among the first ``at`` ids."""
        low, high = self._range(token, min(max(at, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """The position of the j-th occurrence (from 0) of an id."""
        low, high = self._range(token, self.n)
        if not 0 <= j < high - low:
            raise IndexError(j)
        at = low + j
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            at = self._find(plane, at - int(self.zeros[plane]) if one else at, one)
        return at

    def _find(self, plane: int, j: int, one: int) -> int:
        """The position of the j-th bit of a kind in a plane."""
        before = self.directory["before"][plane].astype(np.int64)
        if not one:
            before = np.arange(self.blocks) * BLOCK_BITS - before
        block = int(np.searchsorted(before, j, "right")) - 1
        bits = self._block(plane, block)[0]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[j - before[block]])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the planes are merged again from the last to the first, each read once."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for plane in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._bits(plane, b) for b in range(self.blocks)] or [np.empty(0, np.uint8)]).view(bool)
            here = np.empty(self.n, kind)
            zeros = int(self.zeros[plane])
            here[~bits] = below[:zeros]
            here[bits] = below[zeros:] | kind(1 << (self.planes - 1 - plane))
            below = here
        return below


def open_shard(folder: str, name: str) -> Shard:
    files, path = FileSystem.from_uri(folder)
    return Shard(files.open_input_file(f"{path}/{name}"))


def _store(folder: str, name: str, data: bytes) -> None:
    """A whole file or none: written beside its place, then moved there."""
    files, path = FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(data)
    try:
        files.move(draft, f"{path}/{name}")
    except OSError:  # some stores do not replace: another attempt of this task has been here
        if files.get_file_info(f"{path}/{name}").type != FileType.File:
            raise
        files.delete_file(draft)


# ---- writing and reading with Spark

# kinds of bytes of UTF-8
SPACE, SOLID, LETTER, POINT, INNER, LEAD2, LEAD3, LEAD4 = (1 << i for i in range(8))


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(b" \n\r\t")] |= SPACE
    kinds[0x21:0x7F] |= SOLID
    kinds[[x for x in range(128) if chr(x).isalpha()]] |= LETTER
    kinds[list(b",.;:!?\"'()/-")] |= POINT
    kinds[0x80:0xC0] |= INNER
    # leads under which no character is white space by any table
    kinds[0xC3:0xE0] |= LEAD2
    kinds[0xE4:0xEF] |= LEAD3
    kinds[0xF0:0xF5] |= LEAD4
    return kinds


KINDS = _kinds()


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where units of a text's bytes begin, apart from its own beginning.

    A unit ends before white space that follows anything else, and where a Latin letter meets plain punctuation: the pattern of byte-level
    tokenizers parts every text there, and it looks back nowhere.
    """
    kinds = KINDS[data]
    at = np.flatnonzero(kinds & (SPACE | POINT))
    at = at[at > 0]
    last = kinds[at - 1]
    back = [kinds[np.maximum(at - i, 0)] for i in (2, 3, 4)]
    inner = (last & INNER) != 0
    two = inner & ((back[0] & LEAD2) != 0)
    three = inner & ((back[0] & INNER) != 0) & ((back[1] & LEAD3) != 0)
    four = inner & ((back[0] & INNER) != 0) & ((back[1] & INNER) != 0) & ((back[2] & LEAD4) != 0)
    latin = two & (data[np.maximum(at - 2, 0)] == 0xC3) & (data[at - 1] != 0x97) & (data[at - 1] != 0xB7)  # not the signs of times and division
    space = (kinds[at] & SPACE) != 0
    return at[np.where(space, ((last & SOLID) != 0) | two | three | four, ((last & LETTER) != 0) | latin)]


def cuts_safely(tokenizer_json: str) -> bool:
    """Whether the tokenizer is a byte-level one that parts texts before white space and changes nothing else."""
    spec = json.loads(tokenizer_json)
    before = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])))


class Encoder:
    """The tokenizer, asked once for every distinct unit of text it does not remember.

    At most ``kept`` units (about 200 bytes each), and those of one call, are remembered; beyond, the half met most often stays.
    """

    def __init__(self, tokenizer_json: str, kept: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer, self.by_unit, self.kept = Tokenizer.from_str(tokenizer_json), cuts_safely(tokenizer_json), kept
        self.code: dict[str, int] = {}
        self.ids, self.starts, self.met = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one after the other, and where each begins and the last ends."""
        sizes = self.starts[codes + 1] - self.starts[codes]
        before = np.append(0, np.cumsum(sizes))
        return self.ids[np.repeat(self.starts[codes] - before[:-1], sizes) + np.arange(before[-1])], before

    def _shrink(self) -> None:
        stay = np.sort(np.argsort(self.met, kind="stable")[len(self.met) - self.kept // 2:])
        self.ids, self.starts = self._gather(stay)
        units = list(self.code)
        self.code, self.met = {units[i]: n for n, i in enumerate(stay.tolist())}, self.met[stay] // 2

    def _codes(self, data: pa.Buffer, starts: np.ndarray) -> np.ndarray:
        """The number of each unit; units lie one behind the other in ``data``, from ``starts[0]`` to ``starts[-1]``."""
        cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        units = cells.dictionary.to_pylist()
        get = self.code.get
        codes = np.array([get(u, -1) for u in units], np.int64)
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            new = [units[i] for i in unknown]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([u.decode() for u in new], add_special_tokens=False)]
            codes[unknown] = np.arange(len(self.code), len(self.code) + len(new))
            self.code.update(zip(new, codes[unknown].tolist(), strict=True))
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum([len(f) for f in found]))
            self.ids = np.concatenate([self.ids, *found])
        codes = codes[cells.indices.to_numpy(zero_copy_only=False)]
        self.met = np.append(self.met, np.zeros(len(self.code) - len(self.met), np.int64)) + np.bincount(codes, minlength=len(self.code))
        return codes

    def encode(self, texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids up to the end of each); a null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_unit or not len(texts):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.cumsum([len(f) for f in found], dtype=np.int64)
        _, places, buffer = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer or b"", np.uint8)
        ids, ends, held, at = [], np.zeros(len(texts), np.int64), 0, int(places[0])
        size = window
        while at < places[-1]:
            stop = min(at + size, int(places[-1]))
            inside = places[np.searchsorted(places, at, "right"):np.searchsorted(places, stop, "left")]
            begins = np.zeros(stop - at, bool)
            begins[unit_starts(data[at:stop])] = True
            begins[inside - at] = True
            begins[0] = True
            starts = np.flatnonzero(begins) + at
            if stop < places[-1]:  # what begins last may go on behind the window
                if len(starts) == 1:
                    size *= 2
                    continue
                stop, starts = int(starts[-1]), starts[:-1]
            starts = np.append(starts, stop)
            own, before = self._gather(self._codes(buffer, starts))
            if len(self.code) > self.kept:
                self._shrink()
            here = (places[1:] > at) & (places[1:] <= stop)
            ends[here] = held + before[np.searchsorted(starts, places[1:][here])]
            ids.append(own)
            held += len(own)
            at, size = stop, window
        # a text without bytes ends where the one before it does
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.maximum.accumulate(ends)


@lru_cache(maxsize=1)
def encoder_of(tokenizer_json: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(tokenizer_json)


FILES = "part long, seq long, name string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write all documents in ascending id; returns the stored table of files, FILES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_json)
        part = TaskContext.get().partitionId()
        ids, doc_ids, ends, held, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, ends, held, seq
            name = f"{part:06d}-{seq:06d}.wvm"
            _store(folder, name, pack_shard(np.concatenate(ids), doc_ids, np.cumsum(ends)))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "n_docs": len(doc_ids), "n_tokens": held}],
                                             pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            ids, doc_ids, ends, held, seq = [], [], [], 0, seq + 1
            return row

        closing = np.array([end], np.uint32)
        for batch in batches:
            for rows in slices(batch, 1) if batch.num_rows else []:
                found, stops = encoder.encode(rows.column(1))
                start = 0
                for doc_id, stop in zip(rows.column(0).to_pylist(), stops.tolist(), strict=True):
                    ids += [found[start:stop], closing]
                    doc_ids.append(doc_id)
                    ends.append(stop - start + 1)
                    held += ends[-1]
                    start = stop
                    if held >= shard_tokens:
                        yield flush()
        if doc_ids:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "mark", "tie"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(dealt.mapInArrow(run, FILES), "shards")


def with_starts(files: DataFrame) -> DataFrame:
    """``start``: the ids of all files before each."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("own")).select(
        "part", F.coalesce(F.sum("own").over(before.orderBy("part")), F.lit(0)).alias("before"))  # one row for each task of the writing job
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return files.withColumn("start", inside).join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(folder, row["name"])
                ids = shard.ids()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(shard.starts, shard.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids.astype(np.int64), mask=~shard.present), pa.array(row["start"] + shard.starts), pa.array(shard.ends - shard.starts),
                     pa.array(crc, pa.int64()), pa.array([row["name"]] * len(crc), pa.string())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    named = materialise(with_starts(files).select("name", "start"), "starts")
    return named.repartition(max(1, min(named.count(), 10_000))).mapInArrow(run, DOCS)


def find_tokens(files: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """(shard, token, n, first): occurrences of each of the given ids in each file and the position of its first one, by rank and select only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("shard", pa.string()), ("token", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                shard = open_shard(folder, name)
                rows = [{"shard": name, "token": t, "n": (n := shard.count(t)), "first": shard.select(t, 0) if n else None} for t in tokens]
                yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("name").mapInArrow(run, "shard string, token long, n long, first long")
