"""Byte-level BPE over whole tables.

``encode`` keeps one distinct-word table for the corpus: a first pass splits texts into words and deals every word to
the one partition that owns it, which encodes it once; a second pass notes which word stands where, and the ids return
to those positions. ``decode`` joins ids with their pieces on the map side (the vocabulary's size bounds the pieces).

Null texts count as empty; an empty text has no ids. Rows are kept one for one, repeated rows and null keys included;
columns other than the key and the text are ignored, whatever their names. A text of any length stays whole.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, packed, quiet_threads, taken, unpacked

#: How byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space beyond ASCII.
WIDE_SPACE = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]

#: Characters of text that one task holds at a time.
CHUNK_CHARS = 4_000_000


IDS_AT_ONCE = 500_000
LEAST_SHARES = 48


class Vocabulary:
    """A tokenizers file with its splitting rule and its pieces as bytes."""

    def __init__(self, path: str):
        quiet_threads()
        self.path = path
        self.words = regex.compile(PATTERN)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = sorted(self.specials, key=len, reverse=True)
        self.apart = ["  ", " \n", "\n ", "\0", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f", *special]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        n = 1 + max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"]), 0)
        pieces = [b""] * n
        for piece, i in spec["model"]["vocab"].items():
            pieces[i] = bytes(byte_of[c] for c in piece)
        for t in spec["added_tokens"]:
            pieces[t["id"]] = t["content"].encode()
        self.ranks = ranked(spec, pieces)
        self.pieces = pa.array(pieces, pa.binary())
        self.id_type = np.uint16 if n <= 65536 else np.int32
        self.decimals = pa.array([str(i) for i in range(n)], pa.string())

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    @functools.cached_property
    def fast(self):
        """The same vocabulary as ranks, which encodes faster; None where ranks can't express it."""
        import tiktoken

        return self.ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, **self.ranks)

    def split(self, text: str) -> list[str]:
        """The text in words that encode alone as they do in it: cut before each space; where white space meets white space, by the vocabulary's pattern."""
        if text[0] == " " or text[-1] == " " or any(x in text for x in self.apart) or (not text.isascii() and any(x in text for x in WIDE_SPACE)):
            parts = self.special.split(text) if self.special else [text]
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.words.findall(part))]
        return text.replace(" ", "\0 ").split("\0")

    def ids(self, words: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [self.text_ids(w).tolist() if len(w) > 1000 or w in self.specials else self.fast.encode_ordinary(w) for w in words]

    def text_ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.int32)
            except ValueError:  # the ranks' pattern gives up on some very long runs
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


def ranked(spec: dict, pieces: list[bytes]) -> dict | None:
    """The ranks of pieces and the special tokens; None unless merges come in the order of the ids they make."""
    vocab = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if made != sorted(set(made)) or any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback")) or spec["normalizer"]:
        return None
    ranks = {pieces[i]: i for piece, i in vocab.items() if piece not in special}
    return {"mergeable_ranks": ranks, "special_tokens": special}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    table = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Characters of each row's text, one more so that empty rows count."""
    return 1 + pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)


def least_type(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.int64)


def words_packed(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    return packed(n=least_type(n)), pa.compress(b"".join(raw), "zstd", asbytes=True)


def words_unpacked(lengths: pa.Buffer, data: pa.Buffer) -> list[str]:
    n = unpacked(lengths)["n"].to_numpy().astype(np.int64)
    ends = np.cumsum(n).tolist()
    raw = pa.decompress(data, ends[-1], "zstd", asbytes=True)
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def distinct_words(vocab: Vocabulary, texts: list[str | None]) -> list[str]:
    found: set[str] = set()
    for text in texts:
        if text:
            found.update(vocab.split(text))
    return list(found)


def owned(words: list[str], buckets: int) -> tuple[list[str], np.ndarray]:
    """Distinct words in order of the bucket that owns them, then of the word; and each one's bucket."""
    words = sorted(words)
    owner = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % buckets
    order = np.argsort(owner, kind="stable")
    return [words[k] for k in order.tolist()], owner[order]


def mark_of(words: list[str]) -> int:
    """A hash of words in order."""
    return xxhash.xxh64_intdigest("\0".join(words).encode()) - 2**63


def positions(vocab: Vocabulary, texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Each position's word as its number in the order of ``owned``, the words of each text, the distinct words and their mark."""
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            words = vocab.split(text)
            counts[k] = len(words)
            flat += words
    words, _ = owned(list(set(flat)), buckets)
    number = {w: k for k, w in enumerate(words)}
    return np.fromiter(map(number.__getitem__, flat), np.int32, len(flat)), counts, len(words), mark_of(words)


def id_counts(batch: pa.RecordBatch) -> np.ndarray:
    return 1 + pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encoded_texts(vocab: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts end to end, and how many each has."""
    own = [vocab.text_ids(t) if t else np.zeros(0, np.int32) for t in texts]
    return np.concatenate([np.zeros(0, np.int32), *own]), np.fromiter(map(len, own), np.int64, len(own))


def shares(octets: int) -> int:
    """Shares of the distinct-word table for so many bytes of text: distinct words grow by about the root of the text."""
    return int(min(32_768, max(LEAST_SHARES, LEAST_SHARES * (octets / (1 << 29)) ** 0.5)))


def encode(documents: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (``key``, ids ARRAY<INT>), one for each input row.

    ``documents`` is read twice and should be a scan or another input whose partitions are the same both times; a
    second pass that differs from the first fails. ``buckets``: shares of the distinct-word table, by the bytes of text
    if not given; a task holds the distinct words of its shares, never their occurrences.
    """
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    buckets = buckets or shares(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    schema = "chunk long, bucket int, mark long, lengths binary, data binary"

    def cut(batches):
        """The texts in chunks that are the same in both passes over them, numbered from the partition's number."""
        part = TaskContext.get().partitionId()
        for n, table in enumerate(chunks(batches, text_sizes, CHUNK_CHARS)):
            yield (part << 32) + n, table

    def ask(batches):
        vocab = vocabulary(vocab_path)
        for chunk, table in cut(batches):
            words, owner = owned(distinct_words(vocab, table["text"].to_pylist()), buckets)
            ends = np.cumsum(np.bincount(owner, minlength=buckets)).tolist()
            parts = [(b, *words_packed(words[start:end])) for b, (start, end) in enumerate(zip([0, *ends], ends, strict=False)) if end > start]
            yield pa.record_batch({"chunk": pa.array([chunk] * len(parts), pa.int64()), "bucket": pa.array([x[0] for x in parts], pa.int32()), "mark": pa.array([mark_of(words)] * len(parts), pa.int64()), "lengths": pa.array([x[1] for x in parts], pa.binary()), "data": pa.array([x[2] for x in parts], pa.binary())})

    def answer(batches):
        vocab, known = vocabulary(vocab_path), {}
        for batch in batches:
            done = []
            for lengths, data in zip(batch["lengths"], batch["data"], strict=True):
                words = words_unpacked(lengths.as_buffer(), data.as_buffer())
                new = [w for w in words if w not in known]
                known.update((w, np.array(ids, vocab.id_type).tobytes()) for w, ids in zip(new, vocab.ids(new), strict=True))
                own = [known[w] for w in words]
                n = np.fromiter(map(len, own), np.int64, len(own)) // np.dtype(vocab.id_type).itemsize
                done.append((packed(n=least_type(n)), packed(ids=np.frombuffer(b"".join(own), vocab.id_type))))
            yield pa.record_batch({"chunk": batch["chunk"], "bucket": batch["bucket"], "mark": batch["mark"], "lengths": pa.array([x[0] for x in done], pa.binary()), "data": pa.array([x[1] for x in done], pa.binary())})

    def place(batches):
        vocab = vocabulary(vocab_path)
        for chunk, table in cut(batches):
            codes, counts, n_words, mark = positions(vocab, table["text"].to_pylist(), buckets)
            # numbers by falling frequency, one byte plane after another, take the least room
            order = np.argsort(-np.bincount(codes, minlength=n_words), kind="stable").astype(np.int32)
            rank = np.empty(n_words, np.int32)
            rank[order] = np.arange(n_words, dtype=np.int32)
            planes = rank[codes].astype("<i4").view(np.uint8).reshape(-1, 4).T
            parts = [("texts", packed(key=table["key"].combine_chunks(), n=counts)), ("mark", mark), ("order", packed(at=order)), ("codes", packed(**{f"b{k}": np.ascontiguousarray(planes[k]) for k in range(4)}))]
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int64())} | {name: pa.array([data], pa.int64() if name == "mark" else pa.binary()) for name, data in parts})

    def join_back(words: pa.Table, places: pa.Table) -> pa.Table:
        texts, order, codes = (unpacked(places[x][0].as_buffer()) for x in ("texts", "order", "codes"))
        words = words.sort_by("bucket")
        n = np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_buffer())["n"].to_numpy() for x in words["lengths"])])
        flat = np.concatenate([np.zeros(0, np.int32), *(unpacked(x.as_buffer())["ids"].to_numpy() for x in words["data"])]).astype(np.int32)
        if len(n) != order.num_rows or set(words["mark"].to_pylist()) - {places["mark"][0].as_py()}:
            raise RuntimeError("the two passes over the texts differ: write the input before encoding it")
        ranks = np.stack([codes[f"b{k}"].to_numpy() for k in range(4)], axis=1).view("<i4").ravel()
        index, lengths = taken(n, order["at"].to_numpy()[ranks])
        counts = texts["n"].to_numpy()
        of_text = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=lengths, minlength=len(counts)).astype(np.int64)
        return pa.table({"key": texts["key"], "ids": lists(flat[index], of_text)})

    answered = rows.mapInArrow(ask, schema).repartition("bucket").mapInArrow(answer, schema)
    places = rows.mapInArrow(place, "chunk long, texts binary, mark long, order binary, codes binary")
    return answered.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(lambda words, places: join_back(words, places), f"key {key_type}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the decoded text as ``out`` (replaces a column of that name).

    Bytes that are no UTF-8 decode to U+FFFD; ids outside the vocabulary and null ids are passed over; null ids lists decode to an empty text.
    """
    kept = [c for c in encoded.columns if c != out]
    schema = encoded.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit("")).schema

    def join_pieces(batches):
        pieces = vocabulary(vocab_path).pieces
        for batch in batches:
            texts = decoded(batch.column(kept.index(ids)), pieces)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*kept, out])

    return encoded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(join_pieces, schema)


def decoded(column: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The texts of lists of ids: every id joined with its piece."""
    column = pc.fill_null(column, [])
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    valid = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), False)
    taken_pieces = pc.take(pieces, pc.if_else(valid, flat, pa.scalar(0, flat.type)))
    taken_pieces = pc.if_else(valid, taken_pieces, pa.scalar(b"", pa.binary()))
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), taken_pieces), b"")
    try:
        return whole.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def digest(encoded: DataFrame, vocab_path: str, key: str = "doc_id") -> DataFrame:
    """(``key``, n_tokens, ids_sha256, decoded_sha256) of rows (``key``, ids), decoded as ``decode`` does."""

    def joined(batches):
        vocab = vocabulary(vocab_path)
        for batch in chunks(batches, id_counts, IDS_AT_ONCE):
            ids = batch["ids"].combine_chunks()
            offsets = pa.array(np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32))
            strings = pa.ListArray.from_arrays(offsets, pc.take(vocab.decimals, ids.flatten()))
            yield pa.record_batch({"key": batch["key"].combine_chunks(), "n_tokens": pc.list_value_length(ids).cast(pa.int64()), "joined": pc.binary_join(strings, ","), "decoded": decoded(ids, vocab.pieces)})

    key_type = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), "ids").mapInArrow(joined, f"key {key_type}, n_tokens long, joined string, decoded string")
    return rows.select(F.col("key").alias(key), "n_tokens", F.sha2("joined", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
