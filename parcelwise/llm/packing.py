"""Best-fit decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded_texts, lists, text_sizes, vocabulary
from .common import chunks, written

#: Pieces that one task packs; the open sequence that each shard may leave is one in many thousands.
PIECES_PER_SHARD = 40_000
CHUNK_CHARS = 2_000_000


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest one that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """The window of least room that is at least ``length``, taken out: (room, window)."""
        node, low, high = self._first(length)
        if node is None:
            return None
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return room, self.windows[room].pop()

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def _first(self, length: int):
        """The leftmost subtree that lies at or right of ``length`` and isn't empty."""
        node = length + self.size
        if self.tree[node]:
            return node, 0, 0
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                return node + 1, 0, 0
            node >>= 1
        return None, 0, 0


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces of equal length in the order given."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, n = OpenWindows(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        if length == capacity:
            window[k], offset[k] = n, 0
            n += 1
            continue
        found = opened.tightest(length)
        room, at = found if found else (capacity, n)
        n += found is None
        window[k], offset[k] = at, capacity - room
        if room > length:
            opened.add(room - length, at)
    return window, offset


def cut(documents: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int | None = 0, with_ids: bool = True) -> DataFrame:
    """Pieces (key, start, length, doc_tokens, ids_crc32[, ids]): each document's ids and ``end_id``, cut into full windows and one rest.

    Null texts count as empty; an empty text is one piece with ``end_id`` alone, or none if that is None. Rows are kept
    one for one, repeated ones and null keys too; further columns are ignored; an empty table gives no pieces.
    """
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def pieces(batches):
        vocab = vocabulary(vocab_path)
        for table in chunks(batches, text_sizes, CHUNK_CHARS):
            ids, counts = encoded_texts(vocab, table["text"].to_pylist())
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            n_pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n_pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = nth * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = (np.cumsum(counts) - counts)[doc] + start
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            out = {"key": table["key"].combine_chunks().take(pa.array(doc)), "start": start, "length": length, "doc_tokens": counts[doc], "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = lists(ids, length)
            yield pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    return rows.mapInArrow(pieces, f"key {key_type}, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids).withColumnRenamed("key", key)


def pack(documents: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int | None = 0, with_ids: bool = True) -> DataFrame:
    """The pieces of ``cut`` with sequence_id and offset, by best-fit decreasing.

    Pieces are dealt evenly to shards of about ``PIECES_PER_SHARD``, each packed alone, so neither a long document nor a
    hot source makes a shard large. Null texts count as empty (one piece with ``end_id`` alone; none if that is None);
    repeated rows and null keys are packed like any other row; further columns are ignored.
    """
    cuts = written(cut(documents, vocab_path, key, text, capacity, end_id, with_ids), "pieces")
    shards = max(1, -(-cuts.count() // PIECES_PER_SHARD))
    schema = cuts.select(F.col(key).alias("key"), *[c for c in cuts.columns if c != key]).schema

    def place(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.drop_columns(["shard"]).append_column("sequence_id", pa.array([], pa.int64())).append_column("offset", pa.array([], pa.int64()))
        shard = table["shard"][0].as_py()
        table = table.sort_by([("key", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(table["length"].to_numpy(), capacity)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(window + (shard << 36))).append_column("offset", pa.array(offset))

    out = schema.add("sequence_id", "long").add("offset", "long")
    # by their place in the written table, so that repeated rows part as others do
    dealt = cuts.withColumnRenamed(key, "key").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(lambda table: place(table), out).withColumnRenamed("key", key)
