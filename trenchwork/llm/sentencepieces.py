"""SentencePiece ids of whole texts, and the texts decoded from them, by a table of distinct marked words.

The library turns each space into a marker and puts one before the text. Where no piece has a marker after another
character, no piece reaches over the end of a word, so a text's ids are those of its marked words (the markers and what
follows up to the next), one after the other. Three jobs make use of that:

1. Texts are cut into blocks of about 8 MB where they lie. Each block's distinct marked words, found exactly by Arrow's
   dictionary encoding, go to slices by their hash, as one compressed list for each block and slice.
2. A slice is the table of its distinct words: whatever block a word comes from, it is encoded once, by the library. The lists
   go back as ids.
3. The texts are cut into the same blocks again, as numbers of words; a block's numbers and its lists meet, the ids of each
   of its words are decoded once, and ids and decoded text are put together by position.

What is shuffled are compressed lists of distinct words by block, and numbers, never texts, and no row for each word. A
frequent word is in each block's list once. The number of slices follows the bytes of all texts, so a slice's table stays
small, and blocks are bounded (a longer text is a block of its own). Nothing is broadcast but the model's path. The two cuts are held
together by a fingerprint of each block: if they ever differed, the job would fail instead of giving wrong ids.

For a model in which a marker can stand within a piece, or that changes texts before it encodes them, a whole text counts as one word.

Defined results: a null text is an empty one, without ids and with an empty decoded text; a marker that stands in the
text decodes as a space, as the library does; rows with equal ids are rows of their own; an empty table gives an empty
result. Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _give_back, bounded_batches, byte_hashes, mix64, pieces

MARKER = "▁"
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 32 << 20


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def words_apart(path: str) -> bool:
    """Whether a text's ids are those of its marked words: the model takes texts as they are, puts a marker before them,
    knows the marker, and has no piece with a marker after another character."""
    model = _model(path)
    if any(MARKER in model.id_to_piece(i).lstrip(MARKER) for i in range(model.get_piece_size())):
        return False
    sample = " a  b\tﬁ ①　é \n"
    kept = model.decode(model.encode(sample)) == sample
    known = model.piece_to_id(MARKER) != model.unk_id() and model.unk_id() not in model.encode(sample)
    return kept and known and model.encode("", out_type=str) == [] and model.encode(" ", out_type=str) in ([MARKER * 2], [MARKER] * 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of about BLOCK_BYTES of text."""
    held, size = [], 0
    for piece in pieces(batches, "text", BLOCK_BYTES):
        now = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        if held and size + now > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _words(texts: pa.Array, apart: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(marked words of all texts as a dictionary array, number of words before each text and in all).

    A marked word is given as its bytes with spaces for markers; a text's first one has the marker that the library adds."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, MARKER, " ") if apart else texts
    filled = pc.greater(pc.binary_length(texts), 0)
    marked = pc.if_else(filled, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
    marked = marked.cast(pa.large_binary())
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(marked) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    if apart:
        space = data == 0x20
        first[1:] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    bounds = np.concatenate([starts, ends[-1:]]).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return words.dictionary_encode(), np.searchsorted(starts, offsets)


def _ordered(words: pa.DictionaryArray, slices: int) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """(distinct words by slice, ends of the slices, each word's number in that order, a fingerprint of it all)."""
    distinct = words.dictionary
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
    data = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8)
    hashes = byte_hashes(data, offsets[:-1], offsets[1:])
    of = (hashes % np.uint64(slices)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    codes = number[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    context = TaskContext.get()
    place = np.arange(len(order), dtype=np.uint64)
    print_ = int(mix64(hashes[order] + place).sum(dtype=np.uint64)) + 3 * len(codes) + ((context.partitionId() if context else 0) << 20)
    return distinct.take(pa.array(order)), np.cumsum(np.bincount(of, minlength=slices)), codes, print_


def _planes(data: bytes, width: int) -> bytes:
    """Numbers of ``width`` bytes as planes of their first bytes, second bytes and so on; high planes hardly take any place."""
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes() if width > 1 else data


def _squeezed(sizes: np.ndarray, data: bytes, width: int = 1) -> bytes:
    """Byte strings of these sizes, made of numbers of ``width`` bytes, compressed; the first 16 bytes tell their number and the bytes when opened."""
    raw = _planes(sizes.astype("<u4").tobytes(), 4) + _planes(data, width)
    return len(sizes).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(packed: bytes, width: int = 1) -> tuple[np.ndarray, memoryview]:
    n, size = int.from_bytes(packed[:8], "little"), int.from_bytes(packed[8:16], "little")
    raw = np.frombuffer(pa.decompress(packed[16:], size, "zstd", asbytes=True), np.uint8)
    sizes = np.ascontiguousarray(raw[: 4 * n].reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
    return sizes, memoryview(np.ascontiguousarray(raw[4 * n :].reshape(width, -1).T).reshape(-1))


def _parted(packed: bytes) -> list[bytes]:
    sizes, data = _opened(packed)
    ends = np.cumsum(sizes)
    return [bytes(data[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _lists(docs: DataFrame, slices: int, apart: bool) -> DataFrame:
    """Job 1: (block, slice, words) of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_blocks(batches)):
            distinct, ends, _, print_ = _ordered(_words(batch.column("text"), apart)[0], slices)
            offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
            data = distinct.buffers()[2] if len(distinct) else b""
            cuts = [0, *ends.tolist()]
            full = [s for s in range(slices) if cuts[s + 1] > cuts[s]]
            packed = [_squeezed(np.diff(offsets[cuts[s] : cuts[s + 1] + 1]), memoryview(data)[offsets[cuts[s]] : offsets[cuts[s + 1]]].tobytes()) for s in full]
            block = _block_id(k, print_)
            yield pa.record_batch([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["block", "slice", "words"])

    return docs.mapInArrow(run, "block long, slice int, words binary")


def _block_id(k: int, print_: int) -> int:
    """A number that a block has in both cuts, of its place in the partition, the partition and its words."""
    return int(mix64(np.array([(print_ + (k << 44)) % (1 << 64)], np.uint64))[0] >> np.uint64(1))


def _segmented(lists: DataFrame, slices: int, model_path: str) -> DataFrame:
    """Job 2: (block, slice, ids) for each list; a slice's distinct words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, ids = _model(model_path), None, {}
        for batch in batches:
            for block, part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if part != now:
                    now, ids = part, {}
                words = _parted(packed)
                fresh = [w for w in words if w not in ids]
                if fresh:
                    # The library puts the first marker before the text again. It gives nothing for an empty text, which
                    # here is a single marker, as at the end of "word ".
                    made = [x or [model.piece_to_id(MARKER)] for x in model.encode([w[1:].decode() for w in fresh], num_threads=1)]
                    ids.update(zip(fresh, (np.array(x, "<u4").tobytes() for x in made)))
                found = [ids[w] for w in words]
                out = _squeezed(np.fromiter(map(len, found), np.int64, len(found)), b"".join(found), 4)
                yield pa.record_batch([pa.array([x], t) for x, t in zip((block, part, out), (pa.int64(), pa.int32(), pa.binary()))], ["block", "slice", "ids"])
        _give_back()

    # Sorted, so that a slice's lists come together and only one table is held at a time.
    dealt = lists.repartition(min(slices, max(1, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "slice")
    return dealt.sortWithinPartitions("slice").mapInArrow(run, "block long, slice int, ids binary")


def _numbers(docs: DataFrame, slices: int, apart: bool, kind: str) -> DataFrame:
    """Job 3, first half: a row for each block with its documents' ids, their numbers of words and the words' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_blocks(batches)):
            words, before = _words(batch.column("text"), apart)
            distinct, _, codes, print_ = _ordered(words, slices)
            width = 2 if len(distinct) <= 1 << 16 else 4
            packed = _squeezed(np.diff(before), codes.astype(f"<u{width}").tobytes(), width)
            ids = batch.column("id")
            held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.record_batch([pa.array([_block_id(k, print_)], pa.int64()), held, pa.array([len(distinct)], pa.int64()), pa.array([packed], pa.binary())], ["block", "doc_ids", "distinct", "numbers"])

    return docs.mapInArrow(run, f"block long, doc_ids array<{kind}>, distinct long, numbers binary")


def _strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    """Byte strings of these sizes, as an array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])), pa.py_buffer(data)])


def _tables(packed: list[bytes], model_path: str) -> tuple[pa.Array, pa.Array]:
    """(ids as bytes, decoded text) of a block's distinct words, from their lists in order. Each is decoded once; the library
    takes away the first marker, which is put back."""
    opened = [_opened(p, 4) for p in packed]
    sizes, data = np.concatenate([np.zeros(0, np.int64), *[s for s, _ in opened]]), b"".join(d for _, d in opened)
    ids, ends = np.frombuffer(data, "<u4").tolist(), (np.cumsum(sizes) // 4).tolist()
    texts = [b" " + x.encode() for x in _model(model_path).decode([ids[a:b] for a, b in zip([0, *ends], ends)], num_threads=1)] if ends else []
    return _strings(sizes, data), _strings(np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts))


def _taken(table: pa.Array, codes: np.ndarray, before: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(the bytes of all words of some documents, where each document begins and the last one ends)."""
    if not len(codes):
        return memoryview(b""), np.zeros(len(before), np.int64)
    found = table.take(pa.array(codes))
    offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(codes) + 1]
    return memoryview(found.buffers()[2]), offsets[before]


def encoded(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: the id, ``ids`` (array of int) and ``decoded`` (the text that those ids decode to)."""
    spark = bounded_batches(docs.sparkSession)
    apart, kind = words_apart(model_path), dict(docs.dtypes)[id_column]
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SLICE_BYTES))
    lists = _segmented(_lists(texts, slices, apart), slices, model_path)
    numbers = _numbers(texts, slices, apart, kind)
    both = numbers.withColumns({"slice": F.lit(slices), "ids": F.lit(None).cast("binary")}).unionByName(lists, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                block, part = batch.column("block")[row].as_py(), batch.column("slice")[row].as_py()
                if block != now:
                    now, ids = block, []
                if part < slices:
                    ids.append(batch.column("ids")[row].as_py())
                    continue
                (id_table, text_table), n = _tables(ids, model_path), batch.column("distinct")[row].as_py()
                if len(id_table) != n:
                    raise RuntimeError(f"block {block} has {n} distinct words, but {len(id_table)} came back")
                yield from _put_together(batch.column("doc_ids")[row].values, batch.column("numbers")[row].as_py(), n, id_table, text_table)
                now, ids = None, []
        _give_back()

    ordered = both.repartition("block").sortWithinPartitions("block", "slice")
    out = ordered.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_column)


def _put_together(doc_ids: pa.Array, packed: bytes, distinct: int, id_table: pa.Array, text_table: pa.Array, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The documents of a block, about ``most`` words at a time."""
    width = 2 if distinct <= 1 << 16 else 4
    counts, raw = _opened(packed, width)
    codes = np.frombuffer(raw, f"<u{width}")
    before = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        own, starts = codes[before[at] : before[to]], before[at : to + 1] - before[at]
        data, cuts = _taken(id_table, own, starts)
        flat_ids = np.frombuffer(data, "<i4", int(cuts[-1]) // 4)
        ids = pa.ListArray.from_arrays(pa.array((cuts // 4).astype(np.int32)), pa.array(flat_ids))
        data, cuts = _taken(text_table, own, starts)
        # The first marker of each text is the library's own.
        texts = [data[a + 1 : b].tobytes().decode() if b > a else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        yield pa.record_batch([doc_ids.slice(at, to - at), ids, pa.array(texts, pa.string())], ["id", "ids", "decoded"])
        at = to


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 of every document."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), ",")
    made = encoded(docs, model_path)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
