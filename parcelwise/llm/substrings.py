"""Exact removal of repeated word windows behind a count-min prefilter.

1. Every task counts its windows in a sketch of its own; the sketches, sent as sorted cells, are merged by ranges of
   cells. What is left of them is one bit per cell: whether it counted two or more. Sketch counts are never below the
   true ones, so no repeated window is lost.
2. A second pass over the texts keeps only windows whose every cell says "repeated", groups them by a 96-bit key of
   their word sequence and finds which start earlier elsewhere. The key's halves come from two unrelated hashes of the
   words; that any two of n different sequences share a key has a chance of n ** 2 / 2 ** 97.
3. The starts to be removed go back to their texts.

``sketch_bits`` bounds what is broadcast: 2 ** (bits - 2) bytes for both rows, whatever the input. Past the size where
that sketch fills, it lets more windows into the exact pass; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, packed, unpacked
from .words import Words, byte_sizes, windows

CHUNK_BYTES = 6_000_000
#: Fixed odd multipliers: of the two window keys and the rows of the sketch.
KEY_HIGH, KEY_LOW = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
ROWS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
SHARD_BITS = 6


def sketch_width(octets: int, most: int) -> int:
    """Bits of a cell number: about one cell per byte of text, within bounds."""
    return int(min(most, max(16, int(octets).bit_length())))


def repeated_cells(rows: DataFrame, size: int, bits: int) -> list[np.ndarray]:
    """For each row of the sketch, a bit for each cell that counts two windows or more in all partitions together."""
    shard_bits = min(SHARD_BITS, bits - 3)
    within = bits - shard_bits

    def sketch(batches):
        held: list[list[np.ndarray]] = [[] for _ in ROWS]
        n = 0

        def emitted():
            out = []
            for row, cells in enumerate(held):
                cell, count = np.unique(np.concatenate(cells), return_counts=True)
                shard = cell >> within
                for k in np.unique(shard).tolist():
                    own = slice(*np.searchsorted(shard, [k, k + 1]))
                    local = (cell[own] - (k << within)).astype(np.uint32)
                    out.append((row, k, packed(step=np.diff(local, prepend=np.uint32(0)), many=count[own] > 1)))
                cells.clear()
            return pa.record_batch({"row": pa.array([x[0] for x in out], pa.int32()), "shard": pa.array([x[1] for x in out], pa.int32()), "data": pa.array([x[2] for x in out], pa.binary())})

        for table in chunks(batches, byte_sizes, CHUNK_BYTES):
            words = Words(table["text"])
            _, key = windows(words, size, words.hashes(), KEY_HIGH)
            for row, multiplier in enumerate(ROWS):
                held[row].append(cells_of(key, multiplier, bits))
            n += len(key)
            if n >= 6_000_000:
                yield emitted()
                n = 0
        if n:
            yield emitted()

    def merge(batches):
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, shard, data in zip(batch["row"].to_pylist(), batch["shard"].to_pylist(), batch["data"], strict=True):
                table = unpacked(data.as_buffer())
                counts = seen.setdefault((row, shard), np.zeros(1 << within, np.uint8))
                cell = np.cumsum(table["step"].to_numpy(), dtype=np.uint32)
                counts[cell] = np.minimum(counts[cell] + 1 + table["many"].to_numpy(), 2)
        for (row, shard), counts in seen.items():
            yield pa.record_batch({"row": pa.array([row], pa.int32()), "shard": pa.array([shard], pa.int32()), "data": pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())})

    schema = "row int, shard int, data binary"
    merged = rows.mapInArrow(sketch, schema).repartition("row", "shard").mapInArrow(merge, schema)
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in ROWS]
    for row, shard, data in merged.toLocalIterator():  # 2 ** bits / 8 bytes a row at most
        at = shard << (within - 3)
        out[row][at : at + len(data)] = np.frombuffer(data, np.uint8)
    return out


def cells_of(key: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    return ((key * np.uint64(multiplier)) >> np.uint64(64 - bits)).astype(np.int64)


def later_starts(rows: DataFrame, size: int, bits: int, cells: list[np.ndarray], buckets: int) -> DataFrame:
    """(key, tie, starts): for each text, the word numbers where a window starts that also starts earlier."""
    key_type = rows.schema["key"].dataType.simpleString()
    sketch = rows.sparkSession.sparkContext.broadcast(cells)

    def candidates(batches):
        part, chunk = TaskContext.get().partitionId(), 0
        for table in chunks(batches, byte_sizes, CHUNK_BYTES):
            table = table.take(pc.sort_indices(table.select(["key", "tie"]), sort_keys=[("key", "ascending"), ("tie", "ascending")]))
            name, chunk = (part << 32) + chunk, chunk + 1
            words = Words(table["text"])
            hashes = words.hashes()
            at, high = windows(words, size, hashes, KEY_HIGH)
            keep = np.ones(len(at), bool)
            for bit, multiplier in zip(sketch.value, ROWS, strict=True):
                cell = cells_of(high, multiplier, bits)
                keep &= (bit[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            # the second half of the key has word hashes of its own, so what the first takes for equal it still tells apart
            _, low = windows(words, size, words.hashes(other=True), KEY_LOW)
            at, high, low = at[keep], high[keep], (low[keep] >> np.uint64(32)).astype(np.uint32)
            # the first of each key in this chunk stands for all; the others are known to be later
            order = np.lexsort((at, low, high))
            new = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])][: len(order)]
            first = order[new]
            entry_doc = same_as_before(table)[words.doc[at]]
            number = at - words.base[words.doc[at]]
            owner_first = np.repeat(first, np.diff(np.r_[np.flatnonzero(new), len(order)]))
            later = (entry_doc[order] != entry_doc[owner_first]) | (number[order] != number[owner_first])
            known = order[later]
            out = [(-1 - name % buckets, packed(doc=words.doc[at[known]].astype(np.int32), number=number[known].astype(np.int32)), packed(key=table["key"].combine_chunks(), tie=table["tie"].combine_chunks()))]
            bucket = (high[first] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((at[first], bucket))
            first, bucket = first[by], bucket[by]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
                if b > a:
                    own = first[a:b]
                    doc = words.doc[at[own]]
                    out.append((k, packed(high=high[own], low=low[own], doc=doc.astype(np.int32), number=number[own].astype(np.int32)), packed(key=table["key"].combine_chunks().take(pa.array(u := np.unique(doc))), tie=table["tie"].combine_chunks().take(pa.array(u)), doc=u.astype(np.int32))))
            yield pa.record_batch({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([name] * len(out), pa.int64()), "data": pa.array([x[1] for x in out], pa.binary()), "docs": pa.array([x[2] for x in out], pa.binary())})

    def group(table: pa.Table) -> pa.Table:
        """Of one bucket: for each chunk, the entries whose key has an earlier one."""
        if table.num_rows and table["bucket"][0].as_py() < 0:
            return table.drop_columns(["bucket"])
        parts = [unpacked(x.as_buffer()) for x in table["data"]]
        docs = [unpacked(x.as_buffer()) for x in table["docs"]]
        if not parts:
            return table.drop_columns(["bucket"])
        # all documents of the bucket in order; equal key and tie get equal rank
        every = pa.concat_tables([d.select(["key", "tie"]) for d in docs])
        order = pc.sort_indices(every, sort_keys=[("key", "ascending"), ("tie", "ascending")])
        ranked = same_as_before(every.take(order))
        rank = np.empty(len(ranked), np.int64)
        rank[order.to_numpy()] = ranked
        base, place = 0, []
        for part, own in zip(parts, docs, strict=True):
            place.append(rank[base + np.searchsorted(own["doc"].to_numpy(), part["doc"].to_numpy())])
            base += own.num_rows
        when = (np.concatenate(place) << 32) + np.concatenate([p["number"].to_numpy() for p in parts])
        high, low = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("high", "low"))
        order = np.lexsort((low, high))
        new = np.r_[True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])]
        begin = np.flatnonzero(new)
        earliest = np.minimum.reduceat(when[order], begin)
        later = np.empty(len(order), bool)
        later[order] = when[order] > np.repeat(earliest, np.diff(np.r_[begin, len(order)]))
        out, base = [], 0
        for part in parts:
            own = part.filter(pa.array(later[base : base + part.num_rows]))
            base += part.num_rows
            out.append(packed(doc=own["doc"].combine_chunks(), number=own["number"].combine_chunks()))
        return pa.table({"chunk": table["chunk"], "data": pa.array(out, pa.binary()), "docs": pa.nulls(len(out), pa.binary())})

    def collect(table: pa.Table) -> pa.Table:
        """Of one chunk: the starts of each of its texts."""
        docs = unpacked(next(x for x in table["docs"] if x.is_valid).as_buffer())
        parts = [unpacked(x.as_buffer()) for x in table["data"]]
        doc, number = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("doc", "number"))
        order = np.lexsort((number, doc))
        doc, number = doc[order], number[order]
        some = np.unique(doc)
        bounds = np.searchsorted(doc, np.r_[some, some[-1] + 1] if len(some) else [0])
        return pa.table({"key": docs["key"].take(pa.array(some)), "tie": docs["tie"].take(pa.array(some)), "starts": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(number))})

    asked = rows.mapInArrow(candidates, "bucket long, chunk long, data binary, docs binary")
    answered = asked.groupBy("bucket").applyInArrow(lambda table: group(table), "chunk long, data binary, docs binary")
    return answered.groupBy("chunk").applyInArrow(lambda table: collect(table), f"key {key_type}, tie long, starts array<int>")


def same_as_before(table: pa.Table) -> np.ndarray:
    """For rows in order of key and tie: numbers from 0 that stay the same while both do."""
    n = table.num_rows
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    for name in ("key", "tie"):
        column = table[name].combine_chunks()
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20, sketch_bits: int = 28) -> DataFrame:
    """Rows (``key``, n_words, n_removed, kept): each text without the words that a window covers which also starts earlier.

    Earlier: smaller key (null last), then smaller 64-bit hash of the text, then smaller start. Rows equal in key and
    text are one document to each other: neither is earlier. Null texts count as empty; a text of fewer than ``size``
    words has no windows and stays whole. Further columns are ignored, whatever their names.
    """
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tie"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    octets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_width(octets, sketch_bits)
    buckets = int(min(16384, max(64, octets >> 24)))
    starts = later_starts(rows, size, bits, repeated_cells(rows, size, bits), buckets)
    # rows of one document in several chunks have the same starts up to what each chunk knew of itself
    starts = starts.groupBy("key", "tie").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    joined = rows.alias("d").join(starts.alias("s"), F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.tie") == F.col("s.tie")), "left").select("d.key", "d.text", "s.starts")

    def cut(batches):
        for table in chunks(batches, byte_sizes, CHUNK_BYTES):
            words = Words(table["text"])
            starts = table["starts"].combine_chunks()
            n = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(words.base, n) + pc.fill_null(starts, []).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            covered = np.cumsum(np.bincount(at, minlength=len(words.start) + size) - np.bincount(at + size, minlength=len(words.start) + size)[: len(words.start) + size])[: len(words.start)] > 0
            gone = np.bincount(words.doc[covered], minlength=len(words.count)).astype(np.int64)
            yield pa.record_batch({"key": table["key"].combine_chunks(), "n_words": pa.array(words.count), "n_removed": pa.array(gone), "kept": words.texts(~covered)})

    return joined.mapInArrow(cut, f"key {key_type}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)
