"""Token ids of whole texts in a binary file format, and reading them back.

Texts are tokenized where they lie, ids are counted globally, and a canonical length-limited
Huffman code is made from the counts (at most one row for each id of the vocabulary reaches the
driver). Documents are coded, range-partitioned and sorted by ``doc_id``, and written as
independent blocks.

The file format is a folder of Parquet files, which every store of the cluster can hold, with a
row for each block of about ``block_ids`` ids: ``part`` and ``block`` (ascending in doc_id order),
the documents' ids and id counts, the bytes of each document's code, their concatenation as one
opaque payload, and the checkpoints (bit offsets within each document's code, every 512 ids). The
code itself is the small table of code lengths by id. A block is decoded without any other block.

Defined results: a null text is an empty one and has only the end id; rows with equal doc_ids are
separate documents, ordered by a hash of their ids; null doc_ids come first; an empty table gives
an empty file. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .huffman import Code, canonical, code_lengths, decode, encode
from ..store import new_path
from .text import bounded_batches, byte_hashes, flat, pieces

_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = _SPACE.copy()
_BREAK[0x20] = False
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ",.;:!?"]] = True


class UnitTokenizer:
    """Encodes texts by their distinct units, each with the tokenizers library.

    A byte-level BPE with the usual pre-tokenizing pattern never joins characters across the
    start of white space after a visible ASCII character, before the last space ahead of one, on
    either side of another white space character ahead of one, or between an ASCII letter and a
    point or comma; texts are cut only there. The ids of a unit
    are kept for the next texts, up to ``most`` units at a time.
    """

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        # Tasks share the cores already; threads of the library beside them only cost CPU time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Known units: two independent hashes, sorted by the first, and the place and number of each one's ids in one array."""
        self.keys, self.second, self.base, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, second: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        base = np.cumsum(sizes) - sizes + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.second = np.concatenate([self.second, second])[order]
        self.keys, self.base, self.size = all_keys[order], np.concatenate([self.base, base])[order], np.concatenate([self.size, sizes])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, ids of each row)."""
        data, offsets = flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        graphic, space = _GRAPHIC[data], _SPACE[data]
        # A special token may follow "<", and ends the text before it for the pattern.
        ahead = graphic[1:] & (data[1:] != 0x3C)
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        ahead[edges - 1] = False
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] |= space[1:] & graphic[:-1]
        cut[:-2] |= (data[:-1] == 0x20) & ahead
        last_break = _BREAK[data[:-1]] & ahead
        cut[:-2] |= last_break
        cut[1:-1] |= last_break
        cut[1:-1] |= _LETTER[data[:-1]] & _POINT[data[1:]]
        cut[offsets] = True
        cut[len(data)] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        unique, first, inverse = np.unique(byte_hashes(data, start, end), return_index=True, return_inverse=True)
        check = byte_hashes(data, start, end, seed=1)
        second = check[first]
        if len(self.keys) + len(unique) > self.most:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            a, b = start[first[new]].tolist(), end[first[new]].tolist()
            raw = data.tobytes()
            self._learn(unique[new], second[new], [raw[i:j].decode("utf-8", "replace") for i, j in zip(a, b)])
            at = np.searchsorted(self.keys, unique)
        if (self.second[at] != second).any() or (second[inverse] != check).any():
            # Two units have one hash: these texts go to the tokenizer whole.
            found = [e.ids for e in self.tokenizer.encode_batch_fast(column.cast(pa.string()).fill_null("").to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts
        ids, base, sizes = self.ids, self.base[at], self.size[at]
        each = sizes[inverse]
        total = np.cumsum(each)
        out = ids[np.arange(total[-1]) - np.repeat(total - each - base[inverse], each)]
        row_end = np.concatenate([[0], total])[np.searchsorted(start, offsets)]
        return out, np.diff(row_end)


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def _tokenizer(path: str) -> UnitTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = UnitTokenizer(path)
    return _TOKENIZERS[path]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive runs of ``data``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def tokenized(docs: DataFrame, path: str, end_id: int, wide: bool = False) -> DataFrame:
    """doc_id and ids (little-endian, 2 bytes each, or 4 if ``wide``), and count rows (id_list, id_counts) by task."""
    kind = dict(docs.dtypes)["doc_id"]
    dtype = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "ids", "tie", "id_list", "id_counts"]
        totals: np.ndarray = np.zeros(1, np.int64)
        id_type = pa.null()
        for batch in pieces(batches, "text", 1 << 20):
            ids, counts = _tokenizer(path).encode(batch.column("text"))
            id_type = batch.column("doc_id").type
            counts = counts + 1
            with_end = np.full(int(counts.sum()), end_id, np.uint32)
            inner = np.ones(len(with_end), bool)
            inner[np.cumsum(counts) - 1] = False
            with_end[inner] = ids
            seen = np.bincount(with_end, minlength=len(totals))
            seen[: len(totals)] += totals
            totals = seen
            narrow = with_end.astype(dtype)
            sizes = counts * narrow.itemsize
            raw = narrow.view(np.uint8)
            last = np.cumsum(sizes)
            tie = byte_hashes(raw, last - sizes, last).view(np.int64)
            n = len(counts)
            yield pa.record_batch([batch.column("doc_id"), _binary(raw, sizes), pa.array(tie), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names)
        used = np.flatnonzero(totals)
        if len(used):
            yield pa.record_batch([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([used.astype(np.int32)]), pa.array([totals[used]])], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, tie long, id_list array<int>, id_counts array<long>")


def _coded(ids: DataFrame, code, wide: bool) -> DataFrame:
    kind = dict(ids.dtypes)["doc_id"]
    dtype = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 1 << 20):
            column = batch.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            values = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].tobytes()
            all_ids = np.frombuffer(values, dtype)
            counts = np.diff(offsets) // all_ids.itemsize
            data, run_bytes, marks, n_marks = encode(code.value, all_ids, counts)
            yield pa.record_batch([batch.column("doc_id"), batch.column("tie"), pa.array(counts), _binary(data, run_bytes), _binary(marks.view(np.uint8), 4 * n_marks)], ["doc_id", "tie", "n_ids", "payload", "marks"])

    return ids.mapInArrow(run, f"doc_id {kind}, tie long, n_ids long, payload binary, marks binary")


def _blocks(coded: DataFrame, block_ids: int) -> DataFrame:
    """Consecutive documents of a partition, put together to blocks of about ``block_ids`` ids."""
    kind = dict(coded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        ids_held = 0

        def out() -> pa.RecordBatch:
            table = pa.concat_arrays([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, t))
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([int(counts.sum())], pa.int64()), lists(table, None),
                    lists(counts, pa.int64()), lists(sizes, pa.int64()), pa.array([b"".join(h[3] for h in held)]), pa.array([b"".join(h[4] for h in held)]),
                ],
                ["part", "block", "block_n_ids", "doc_ids", "n_ids", "n_bytes", "payload", "marks"],
            )

        for batch in batches:
            counts = batch.column("n_ids").to_numpy()
            sizes = pc.binary_length(batch.column("payload")).to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                room = np.cumsum(counts[at:]) + ids_held
                to = at + min(int(np.searchsorted(room, block_ids, "left")) + 1, batch.num_rows - at)
                piece = batch.slice(at, to - at)
                held.append((piece.column("doc_id"), counts[at:to], sizes[at:to], b"".join(piece.column("payload").to_pylist()), b"".join(piece.column("marks").to_pylist())))
                ids_held += int(counts[at:to].sum())
                at = to
                if ids_held >= block_ids:
                    yield out()
                    held, ids_held, block = [], 0, block + 1
        if held:
            yield out()

    return coded.mapInArrow(run, f"part int, block int, block_n_ids long, doc_ids array<{kind}>, n_ids array<long>, n_bytes array<long>, payload binary, marks binary")


def write_token_file(docs: DataFrame, tokenizer_path: str, to: str, end_id: int = 0, vocabulary: int = 50_257, block_ids: int = 1 << 18) -> None:
    """Tokenize, code and write ``docs`` under the folder ``to`` (blocks, and the code's lengths)."""
    spark = bounded_batches(docs.sparkSession)
    wide = vocabulary > 1 << 16
    held = new_path(spark, "token-ids")
    tokenized(docs, tokenizer_path, end_id, wide).write.option("compression", "zstd").parquet(held)
    table = spark.read.parquet(held)
    pairs = table.where("id_list is not null").select(F.explode(F.arrays_zip("id_list", "id_counts")).alias("x"))
    # At most one row for each id of the vocabulary.
    totals = pairs.groupBy(F.col("x.id_list").alias("id")).agg(F.sum("x.id_counts").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in totals:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(i, n) for i, n in enumerate(lengths.tolist()) if n], "id int, length int").coalesce(1).write.parquet(f"{to}/code")
    code = spark.sparkContext.broadcast(canonical(lengths))
    coded = _coded(table.where("ids is not null").select("doc_id", "ids", "tie"), code, wide)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    _blocks(ordered, block_ids).write.option("compression", "none").parquet(f"{to}/blocks")


def read_token_file(spark, at: str, vocabulary: int = 50_257) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document of the file."""
    return _decoded(spark, at, vocabulary, lambda raw: raw, "ids binary", pa.binary())


def read_checksums(spark, at: str, vocabulary: int = 50_257) -> DataFrame:
    """As ``read_token_file``, with the CRC-32 of the ids in their place."""
    return _decoded(spark, at, vocabulary, zlib.crc32, "ids_crc32 long", pa.int64())


def _decoded(spark, at: str, vocabulary: int, digest, column: str, kind: pa.DataType) -> DataFrame:
    lengths = np.zeros(vocabulary, np.int64)
    for r in spark.read.parquet(f"{at}/code").collect():
        lengths[r["id"]] = r["length"]
    code = spark.sparkContext.broadcast(canonical(lengths))
    blocks = spark.read.parquet(f"{at}/blocks")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the file, then one for each block of a partition.
    parts = blocks.groupBy("part").agg(F.sum("block_n_ids").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0))).drop("n")
    index = blocks.select("part", "block", "block_n_ids").join(parts, "part")
    index = index.select("part", "block", (F.col("part_start") + F.coalesce(F.sum("block_n_ids").over(before.partitionBy("part").orderBy("block")), F.lit(0))).alias("start"))
    placed = blocks.drop("block_n_ids").join(F.broadcast(index), ["part", "block"]) if index.count() <= 1_000_000 else blocks.drop("block_n_ids").join(index, ["part", "block"])
    id_kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: B023, E731
                counts = get("n_ids").values.to_numpy()
                data, marks = np.frombuffer(get("payload").as_buffer(), np.uint8), np.frombuffer(get("marks").as_buffer(), np.uint32)
                ids = decode(code.value, data, get("n_bytes").values.to_numpy(), counts, marks).astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                digests = [digest(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([get("doc_ids").values, pa.array(starts + get("start").as_py()), pa.array(counts), pa.array(digests, kind)], ["doc_id", "start", "n_tokens", column.split()[0]])

    return placed.select("part", "block", "start", "doc_ids", "n_ids", "n_bytes", "payload", "marks").mapInArrow(run, f"doc_id {id_kind}, start long, n_tokens long, {column}")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0, vocabulary: int = 50_257) -> DataFrame:
    """Write the token file in the shared folder and digest what is read back from it."""
    to = new_path(docs.sparkSession, "token-file")
    write_token_file(docs, tokenizer_path, to, end_id, vocabulary)
    return read_checksums(docs.sparkSession, to, vocabulary)
