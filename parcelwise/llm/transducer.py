"""Byte-level BPE by a finite-state transducer that grows as texts need it, and decoding by a UTF-8 state machine.

Ranks alone decide the encoding, as merging the lowest-ranked neighbours does: a sequence of tokens is the encoding of
its bytes exactly if each token and each two neighbours are. So every prefix of a word has one last token, and the
tokens that longer prefixes can still get begin at boundaries from which some token goes on that fits. A state of the
machine holds those boundaries: what has been read since each, and a token that stands for all that could be before it
with the same tokens fitting after. This is the determinised transducer that guesses boundaries, with equal futures
made one; its states are made when a text first reaches them. A step reads one byte and notes the prefix's last token;
tokens are emitted as soon as the paths back from all boundaries that are left agree on them, which looks ahead no
further than the paths part, or at a word's end.

Null texts count as empty; an empty text has no ids. Rows are kept one for one, repeated rows and null keys included;
columns other than the key and the text are ignored, whatever their names. A text of any length stays whole. Nothing is
shuffled: each task encodes the rows that it scans.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import id_counts, lists, text_sizes
from .common import chunks, quiet_threads

#: States, pairs and words that a worker keeps before it forgets some; results don't depend on it.
MOST_STATES, MOST_PAIRS, MOST_WORDS = 60_000, 200_000, 400_000
#: States that the table of moves has room for at first, and by how many it grows.
MORE_STATES = 8192
#: Characters of text and ids that one task holds at a time.
CHUNK_CHARS, IDS_AT_ONCE = 4_000_000, 500_000
#: White space next to a space: such runs are the rule's to split.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
BESIDE_SPACE = re.compile(r"\s | \s|^ | $")
#: Bytes from which a word is read by itself.
LONG_WORD = 64
#: In place of a token before: the start of a word.
START = -1
#: Tokens going on from a boundary, over which boundaries aren't compared.
MOST_COMPARED = 32
#: Bytes of a word that are read before tokens are emitted.
READ_AHEAD = 4096


#: Letters and numbers of Unicode after version 16, which the published rule's tables don't know as such.
NEWER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1
ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


class Merges:
    """Ranks by bytes, and what they say of single tokens and neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = [b""] * (1 + max(ranks.values()))
        for piece, i in ranks.items():
            self.pieces[i] = piece
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        #: The two tokens that each token is last merged from; tokens of one byte and those that merging never gives have none.
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[bytes, int] = {}
        for piece, i in ranks.items():
            if len(piece) > 1:
                *_, last = [[piece]] if (steps := self.merged(piece)) is None else steps
                if steps is None or len(last) != 2:
                    self.whole[piece] = i
                else:
                    self.halves[i] = ranks[last[0]], ranks[last[1]]
        if any(max(pair) >= i for i, pair in self.halves.items()):
            raise ValueError("a token ranks before one that it is merged from")
        #: Tokens in the order of their bytes: those that go on from a prefix are neighbours.
        self.sorted = sorted(ranks)
        self._fits: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[list[bytes]] | None:
        """The states on the way of merging ``data`` down to one token; None if it doesn't get there."""
        parts, steps = [data[k : k + 1] for k in range(len(data))], []
        while len(parts) > 1:
            found = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == 1 << 60:
                return None
            steps.append(list(parts))
            k = found.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return steps

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart side by side; at the start of a word, whether merging gives the token."""
        if left == START:
            return self.pieces[right] not in self.whole
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MOST_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.pieces[right] not in self.whole and self.apart(left, right)
        return known

    def apart(self, left: int, right: int) -> bool:
        """Undo merges beside the boundary, the latest first: none of the pairs that met there may have merged before its own parts did."""
        ranks, pieces, halves = self.ranks, self.pieces, self.halves
        crossing = ranks.get(pieces[left] + pieces[right])
        if crossing is not None:
            return False
        while True:
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # equal ranks merge from the left, so the right one is the later
            if b is None or (a is not None and left > right):
                when, left, tie = left, a[1], 0
            else:
                when, right, tie = right, b[0], 1
            crossing = ranks.get(pieces[left] + pieces[right])
            if crossing is not None and crossing < when + tie:
                return False


class Transducer:
    """The deterministic machine over the bytes of words: the boundaries of each state and its prefix's last token, and a table of moves by byte, less than zero where none is made yet."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.lengths = np.array([len(p) for p in merges.pieces])
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((MORE_STATES, 256), -1, np.int32)
        self.last = np.zeros(MORE_STATES, np.int32)
        self.likes: dict[tuple[int, bytes], int | None] = {}
        self.firsts: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.number((b"", ((0, START),)))

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n == len(self.table):
                self.table = np.vstack([self.table, np.full((MORE_STATES, 256), -1, np.int32)])
                self.last = np.concatenate([self.last, np.zeros(MORE_STATES, np.int32)])
            self.last[n] = state[1][-1][1]
        return n

    def like(self, token: int, read: bytes) -> int | None:
        """The first token seen after which the same tokens that go on from ``read`` fit as after this one; None if none does. Where very many go on, the token itself."""
        key = token, read
        if key not in self.likes:
            order, merges = self.merges.sorted, self.merges
            lo, hi = bisect_right(order, read), bisect_left(order, read + b"\xff" * 8)
            if hi - lo > MOST_COMPARED:
                return token
            after = [merges.ranks[piece] for piece in order[lo:hi]]
            fitting = tuple(t for t in after if merges.pieces[t] not in merges.whole and (token == START or merges.apart(token, t)))
            self.likes[key] = self.firsts.setdefault((read, fitting), token) if fitting else None
        return self.likes[key]

    def grow(self, at: int, byte: int) -> int:
        """The move from a state by a byte, made now."""
        read, boundaries = self.states[at]
        merges, read = self.merges, read + bytes((byte,))
        for length, before in boundaries:
            last = merges.ranks.get(read[len(read) - length - 1 :])
            if last is not None and merges.fits(before, last):
                break
        else:
            raise RuntimeError("a prefix without a last token")
        alive = [(n + 1, self.like(before, read[len(read) - n - 1 :])) for n, before in boundaries]
        alive = [(n, before) for n, before in alive if before is not None]
        longest = alive[0][0] if alive else 0
        move = self.number((read[len(read) - longest :], (*alive, (0, last))))
        self.table[at, byte] = move
        return move

    def each(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, none of them empty, four bytes an id: all take their next byte at once."""
        if len(self.states) > MOST_STATES:
            self.clear()
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-n, kind="stable")
        n = n[order]
        width = int(n.max(initial=0))
        data = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in order.tolist()), np.uint8).reshape(len(words), width)
        state, lasts = np.zeros(len(words), np.int32), np.zeros((len(words), width), np.int32)
        for k in range(width):
            m = int(np.searchsorted(-n, -k, side="left"))  # words longer than k
            at, byte = state[:m], data[:m, k]
            new = self.table[at, byte]
            if (unmade := new < 0).any():
                for pair in np.unique(at[unmade].astype(np.int64) * 256 + byte[unmade]).tolist():
                    self.grow(pair >> 8, pair & 255)
                new = self.table[at, byte]
            state[:m], lasts[:m, k] = new, self.last[new]
        # back from each word's end, token by token
        end, back, rows = n.copy(), [], np.arange(len(words))
        while len(rows):
            token = lasts[rows, end[rows] - 1]
            back.append((rows, token))
            end[rows] -= self.lengths[token]
            rows = rows[end[rows] > 0]
        row, token = (np.concatenate([b[k] for b in back]) if back else np.zeros(0, np.int64) for k in (0, 1))
        place = np.lexsort((-np.arange(len(row)), row))
        flat, ends = token[place].astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(row, minlength=len(words)))).tolist()
        out = [b""] * len(words)
        for k, a, b in zip(order.tolist(), [0, *ends], ends, strict=False):
            out[k] = flat[a:b]
        return out

    def ids(self, word: bytes) -> list[int]:
        """The ids of one word of any length, of which only what isn't decided yet is held."""
        state, lasts, out = 0, [], []
        for byte in word:
            move = int(self.table[state, byte])
            state = move if move >= 0 else self.grow(state, byte)
            lasts.append(int(self.last[state]))
            if len(lasts) >= READ_AHEAD:
                lasts = self.emit(state, lasts, out)
                if len(self.states) > MOST_STATES:
                    held = self.states[state]
                    self.clear()
                    state = self.number(held)
        return out + self.path(lasts, len(lasts))

    def path(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to a boundary, from what was last at each."""
        out, pieces = [], self.merges.pieces
        while end:
            out.append(lasts[end - 1])
            end -= len(pieces[lasts[end - 1]])
        return out[::-1]

    def emit(self, state: int, lasts: list[int], out: list[int]) -> list[int]:
        """Add to ``out`` the tokens that the paths to all boundaries of the state share; what is noted since."""
        pieces, paths = self.merges.pieces, [self.path(lasts, len(lasts) - n) for n, _ in self.states[state][1]]
        agreed = next((k for k, tokens in enumerate(zip(*paths, strict=False)) if len(set(tokens)) > 1), min(map(len, paths)))
        out += paths[0][:agreed]
        return lasts[sum(len(pieces[t]) for t in paths[0][:agreed]) :]


def next_open(parts: list, at: int) -> int:
    """The place of the next None from ``at`` on, the end if there is none."""
    try:
        return parts.index(None, at)
    except ValueError:
        return len(parts)


class Utf8Machine:
    """Bytes of tokens to text, token by token: a state is the bytes of a character that isn't whole yet, three at most.

    Bytes that are no UTF-8 become U+FFFD, one for each longest run that could have begun a character. The moves of
    tokens are kept once made.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        #: The texts of tokens that begin and end between characters; None for others.
        self.closed = [None if (m := self.move(b"", i))[0] or "\ufffd" in m[1] else m[1] for i in range(len(pieces))]

    @staticmethod
    def need(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a first one, and the range of the second; (0, ..) for bytes that begin nothing."""
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def step(self, held: bytes, byte: int) -> tuple[bytes, str]:
        """The bytes held after one more, and the characters that it completes."""
        if held:
            follow, low, high = self.need(held[0])
            if len(held) > 1:
                low, high = 0x80, 0xBF
            if low <= byte <= high:
                held += bytes((byte,))
                return (b"", held.decode()) if len(held) > follow else (held, "")
            after, text = self.step(b"", byte)
            return after, "�" + text
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes((byte,)), "") if self.need(byte)[0] else (b"", "�")

    def move(self, held: bytes, token: int) -> tuple[bytes, str]:
        known = self.moves.get((held, token))
        if known is None:
            after, out = held, []
            for byte in self.pieces[token] if 0 <= token < len(self.pieces) else b"":
                after, text = self.step(after, byte)
                out.append(text)
            known = self.moves[held, token] = after, "".join(out)
        return known

    def text(self, ids: list[int | None]) -> str:
        try:
            parts = list(map(self.closed.__getitem__, ids))  # tokens that leave the machine where it began
            if ids and min(ids) < 0:
                raise IndexError
        except (TypeError, IndexError):
            ids = [i for i in ids if i is not None and 0 <= i < len(self.pieces)]
            parts = list(map(self.closed.__getitem__, ids))
        held, at = b"", 0
        while (at := next_open(parts, at)) < len(parts):
            while True:
                held, parts[at] = self.moves.get((held, ids[at])) or self.move(held, ids[at])
                at += 1
                if not held or at == len(parts):
                    break
        return "".join(parts) + ("\ufffd" if held else "")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


class Decoder:
    """What decoding needs of a file of ranks."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        pieces = [b""] * (1 + max(ranks.values()))
        for piece, i in ranks.items():
            pieces[i] = piece
        self.utf8 = Utf8Machine(pieces)
        self.decimals = pa.array([str(i) for i in range(len(pieces))], pa.string())


class Encoder:
    """A file of ranks with the rule that splits texts into words."""

    def __init__(self, path: str, pattern: str):
        quiet_threads()
        ranks = read_ranks(path)
        self.words = regex.compile(pattern)
        self.newer = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in (map(lambda x: int(x, 16), run.split("-")) for run in NEWER.split())) + "]")
        self.merges = Merges(ranks)
        self.machine = Transducer(self.merges)
        #: The ids of parts met lately and before; those met again are kept.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Parts that encode alone as they do in the text: cut before each space, or by the rule itself where a space has white space beside it."""
        if text.isascii():
            apart = text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES)
        else:
            apart = BESIDE_SPACE.search(text)
        if apart or "\0" in text:
            return self.matches(text)
        return text.replace(" ", "\0 ").split("\0")

    def matches(self, text: str) -> list[str]:
        if not text.isascii() and self.newer.search(text):
            plain = self.newer.sub("\U0010ffff", text)  # neither letter nor number nor space
            return [text[m.start() : m.end()] for m in self.words.finditer(plain)]
        return self.words.findall(text)

    def simple(self, part: str) -> str | list[str]:
        """A part's matches; for letters alone, or with one sign after them, without the rule."""
        letters = part[1:] if part[0] == " " else part
        if letters.isalpha():
            return part
        if letters and letters[-1] in ".,;:!?" and letters[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.matches(part)

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that aren't known yet, each distinct match of the rule once."""
        new = []
        for p in parts.difference(self.known):
            ids = self.before.get(p)
            if ids is None:
                new.append(p)
            else:
                self.known[p] = ids
        matches = list(map(self.simple, new))
        words = {w for m in matches for w in ([m] if isinstance(m, str) else m)}
        raw = {w: w.encode() for w in words}
        whole = self.merges.whole
        # a token that merging can't give stands for itself
        ids = {w: np.array([whole[b]] if b in whole else self.machine.ids(b), np.int32).tobytes() for w, b in raw.items() if b in whole or len(b) > LONG_WORD}
        short = [w for w in words if w not in ids]
        ids.update(zip(short, self.machine.each([raw[w] for w in short]), strict=True))
        self.known.update((p, ids[m] if isinstance(m, str) else b"".join(map(ids.__getitem__, m))) for p, m in zip(new, matches, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of texts, none for null and empty ones."""
        if len(self.known) > MOST_WORDS:
            self.known, self.before = {}, self.known
        parts = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, own)), np.int32) for own in parts]


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encoded_batches(batches, ranks_path: str, pattern: str):
    """Batches (key, ids) of batches (key, text)."""
    own = encoder(ranks_path, pattern)
    for table in chunks(batches, text_sizes, CHUNK_CHARS):
        ids = own.encode(table["text"].to_pylist())
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        yield pa.RecordBatch.from_arrays([table["key"].combine_chunks(), lists(np.concatenate([np.zeros(0, np.int32), *ids]), counts)], ["key", "ids"])


def encode(documents: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """Rows (``key``, ids ARRAY<INT>), one for each input row, by the file of ranks; ``pattern`` splits texts into words that are encoded each for itself."""
    pattern = pattern or split_pattern()
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: encoded_batches(batches, ranks_path, pattern), f"key {key_type}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the decoded text as ``out`` (replaces a column of that name).

    Bytes that are no UTF-8 decode to U+FFFD; ids outside the ranks and null ids are passed over; null lists decode to an empty text.
    """
    kept = [c for c in encoded.columns if c != out]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def decoded(batches):
        utf8 = decoder(ranks_path).utf8
        for batch in batches:
            texts = [utf8.text(x or ()) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out])

    return rows.mapInArrow(decoded, rows.withColumn(out, F.lit("")).schema)


def digested(own: Decoder, table: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    """(key, n_tokens, joined, decoded) of rows (key, ids)."""
    ids = table["ids"].combine_chunks() if isinstance(table, pa.Table) else table["ids"]
    key = table["key"].combine_chunks() if isinstance(table, pa.Table) else table["key"]
    counts = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten()
    strings = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pc.take(own.decimals, flat))
    if ids.null_count or flat.null_count:
        each = [x or [] for x in ids.to_pylist()]
    else:
        values, ends = flat.to_numpy().tolist(), np.cumsum(counts).tolist()
        each = [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    texts = pa.array(map(own.utf8.text, each), pa.string(), size=len(each))
    return pa.RecordBatch.from_arrays([key, pa.array(counts, pa.int64()), pc.binary_join(strings, ","), texts], ["key", "n_tokens", "joined", "decoded"])


def hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("key").alias(key), "n_tokens", F.sha2("joined", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digest(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """(``key``, n_tokens, ids_sha256, decoded_sha256) of rows (``key``, ids), decoded as ``decode`` does."""

    def joined(batches):
        for batch in chunks(batches, id_counts, IDS_AT_ONCE):
            yield digested(decoder(ranks_path), batch)

    key_type = encoded.schema[key].dataType.simpleString()
    return hashed(encoded.select(F.col(key).alias("key"), "ids").mapInArrow(joined, f"key {key_type}, n_tokens long, joined string, decoded string"), key)


def round_trip(documents: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """``digest`` of what ``encode`` gives, in one pass, so that the ids needn't leave the worker that made them."""
    pattern = pattern or split_pattern()

    def joined(batches):
        for batch in encoded_batches(batches, ranks_path, pattern):
            yield digested(decoder(ranks_path), batch)

    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return hashed(rows.mapInArrow(joined, f"key {key_type}, n_tokens long, joined string, decoded string"), key)
