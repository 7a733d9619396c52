"""SimHash fingerprints and exact near-duplicate groups by distributed vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_side, taken, written
from .graph import components, local_components
from .words import Words, byte_sizes, mixed, windows

CHUNK_BYTES = 2_000_000
#: Fingerprints in a shard, about; those on which the shards' tree is fitted, for each shard and in all: beyond some five hundred million distinct fingerprints shards grow.
SHARD_POINTS = 8192
SAMPLE, MOST_SAMPLE = 64, 1 << 20
LEAF_POINTS = 192


def voted(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For groups of hashes that start there and have so many members: a bit is set if it is in over half of the group."""
    votes = np.zeros((len(starts), 64), np.int64)
    step = 65_536
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low, high = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + len(bits), side="left")
        votes[low:high] += np.add.reduceat(bits, np.maximum(starts[low:high] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(words: Words, size: int, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each text: bit set if set in over half of its shingles' XXH64; no words: zero."""
    data, ends = words.joined()
    begins = np.r_[0, ends[:-1] + 1][: len(ends)]
    n = np.maximum(words.count - size + 1, np.minimum(words.count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = words.base[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + size, words.base[doc] + words.count[doc]) - 1
    raw = memoryview(data.tobytes())
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(doc))
    out[some] = voted(hashes, starts, n[some])
    return out


def fingerprint(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """(key, tie, fp): the fingerprint of each text as LONG; tie is a 64-bit hash of the text. Null texts count as empty."""
    key_type = documents.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(whole).alias("tie"), whole.alias("text"))

    def run(batches):
        for table in chunks(batches, byte_sizes, CHUNK_BYTES):
            fp = fingerprints(Words(table["text"], lower=True), size, seed)
            yield pa.record_batch({"key": table["key"].combine_chunks(), "tie": table["tie"].combine_chunks(), "fp": pa.array(fp.view(np.int64))})

    return rows.mapInArrow(run, f"key {key_type}, tie long, fp long")


class Tree:
    """The upper levels of a vantage-point tree: in each node a vantage fingerprint and the distance that parts its children."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.vantage, self.radius = depth, np.zeros(1 << depth, np.uint64), np.zeros(1 << depth, np.int64)
        groups = [points]
        for level in range(depth):
            below = []
            for k, own in enumerate(groups):
                node = (1 << level) + k
                pool = own if len(own) else points
                self.vantage[node] = pool[0] if len(pool) else 0
                d = distance(own, self.vantage[node])
                self.radius[node] = int(np.median(d)) if len(d) else 32
                below += [own[d <= self.radius[node]], own[d > self.radius[node]]]
            groups = below

    def shards(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home shard of each point, and (point, shard) for every shard after its home that may hold points within ``reach``."""
        home = np.ones(len(points), np.int64)
        who, node = np.arange(len(points)), np.ones(len(points), np.int64)
        for _ in range(self.depth):
            home = 2 * home + (distance(points, self.vantage[home]) > self.radius[home])
            d, edge = distance(points[who], self.vantage[node]), self.radius[node]
            near, far = d - reach <= edge, d + reach > edge
            who, node = np.r_[who[near], who[far]], np.r_[2 * node[near], 2 * node[far] + 1]
        later = node > home[who]
        return home, who[later], node[later]


def distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits of fingerprints, each one word or a row of words."""
    bits = np.bitwise_count(a ^ b)
    return bits.sum(axis=-1, dtype=np.int64) if a.ndim > 1 else bits.astype(np.int64)


def near_pairs(points: np.ndarray, queries: np.ndarray, reach: int, found, at_point=None, at_query=None) -> None:
    """Call ``found(point numbers, query numbers)`` with all pairs within ``reach``, descending a vantage-point tree and pruning by the triangle inequality.

    Fingerprints are single words or rows of words; ``at_point`` and ``at_query`` say which of them take part.
    """
    wide = points.ndim > 1
    at_point = np.arange(len(points)) if at_point is None else at_point
    at_query = np.arange(len(queries)) if at_query is None else at_query
    while True:
        if not len(at_point) or not len(at_query):
            return
        own = points[at_point]
        split = None
        if len(own) > LEAF_POINTS:
            for try_at in (0, len(own) // 2, len(own) - 1):
                d = distance(own, own[try_at])
                edge = int(np.median(d))
                inside = d <= edge
                if 0 < inside.sum() < len(own):
                    split = own[try_at], edge, inside
                    break
        if split is None:
            step = max(1, 4_000_000 // own.size)
            for k in range(0, len(at_query), step):
                apart = np.bitwise_count(own[:, None] ^ queries[at_query[k : k + step]][None, :])
                p, q = np.nonzero((apart.sum(axis=2, dtype=np.int64) if wide else apart) <= reach)
                found(at_point[p], at_query[k : k + step][q])
            return
        vantage, edge, inside = split
        dq = distance(queries[at_query], vantage)
        near_pairs(points, queries, reach, found, at_point[inside], at_query[dq - reach <= edge])
        at_point, at_query = at_point[~inside], at_query[dq + reach > edge]


def linked(points: np.ndarray, visitors: np.ndarray, reach: int) -> np.ndarray:
    """For home points and then visitors: the smallest number among those joined by links of which one end at least is a home point."""
    every = np.r_[points, visitors]
    return joined(every, np.arange(len(every)), np.arange(len(points)), reach)


def joined(prints: np.ndarray, asking: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """For fingerprints: the smallest number joined with each by links of at most ``reach`` differing bits between one of ``asking`` and one of ``home``, found in a vantage-point tree of the latter."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def found(p, q):
        nonlocal size
        apart = p != q
        held.append((p[apart], q[apart]))
        size += int(apart.sum())
        if size > 2_000_000:
            label = local_components(len(prints), *map(np.concatenate, zip(*held, strict=True)))
            some = np.flatnonzero(label != np.arange(len(prints)))
            held[:] = [(some, label[some])]
            size = len(some)

    near_pairs(prints, prints, reach, found, home, asking)
    return local_components(len(prints), *map(np.concatenate, zip(*held, strict=True))) if held else np.arange(len(prints))


def groups(prints: DataFrame, reach: int = 2) -> DataFrame:
    """(fp, root, component): for each distinct fingerprint, the fingerprint that stands for its group and the group's smallest key.

    Links join fingerprints of at most ``reach`` differing bits.

    ``prints``: (key, tie, fp), read several times, so best a written table. Copies meet as one fingerprint before any
    search; a shard sends on at most one link for each fingerprint it holds.
    """
    spark = prints.sparkSession
    distinct = written(prints.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD_POINTS))))
    depth = min(depth, (MOST_SAMPLE // 16).bit_length() - 1)
    share = min(1.0, min(MOST_SAMPLE, max(SAMPLE << depth, 4096)) / max(n, 1))
    # about that share, by a hash: the same on every run, and no sort
    sample = distinct.select("fp").where(F.xxhash64("fp", F.lit(1)) <= min(2**63 - 1, int(-(2**63) + share * (2**64 - 1)))).toArrow() if depth else None
    points = np.sort(sample["fp"].to_numpy()).view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = spark.sparkContext.broadcast(Tree(points[np.random.default_rng(1).permutation(len(points))], depth))

    def deal(batches):
        for batch in batches:
            points = batch["fp"].to_numpy().view(np.uint64)
            home, who, shard = tree.value.shards(points, reach)
            for shards, fps, mine in ((home, points, True), (shard, points[who], False)):
                yield pa.record_batch({"shard": pa.array(shards), "fp": pa.array(fps.view(np.int64)), "home": pa.array(np.full(len(fps), mine))})

    def search(table: pa.Table) -> pa.Table:
        fps, home = table["fp"].to_numpy().view(np.uint64), table["home"].to_numpy(zero_copy_only=False)
        every = np.r_[np.sort(fps[home]), np.sort(fps[~home])]
        label = linked(every[: int(home.sum())], every[int(home.sum()) :], reach)
        some = np.flatnonzero(label != np.arange(len(every)))
        return pa.table({"a": pa.array(every[some].view(np.int64)), "b": pa.array(every[label[some]].view(np.int64))})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    stars = components(dealt.groupBy("shard").applyInArrow(lambda table: search(table), "a long, b long"))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, reach: int = 2) -> DataFrame:
    """(``key``, fingerprint, component_id) for each row; component_id is the smallest key reachable over links, itself included.

    Texts of fewer than ``size`` words are one shingle; texts without words, null ones too, have fingerprint zero and
    link with each other. Rows with a null key link like others and take the smallest key that isn't null, or null if
    there is none. Repeated rows each get their row. Further columns are ignored, whatever their names.
    """
    prints = written(fingerprint(documents, key, text, size, seed), "prints")
    found = prints.join(groups(prints, reach), "fp")
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Words of 64 bits in a wide fingerprint, and the MinHash values by which wide fingerprints meet.
WIDE, MEETINGS = 4, 4
#: Fingerprints of a block, and bytes of shingle sets, that meet in one task; larger blocks and groups are split.
MEET, SET_BYTES = 4096, 16 << 20


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, shingle): the distinct hashes of each text's shingles of ``size`` words, text by text in rising order."""
    hashes = words.hashes()
    at, shingle = windows(words, size, hashes, 0x9FB21C651E98DF25)
    # a text of fewer words is one shingle
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    of = [mixed(np.array([int(h) for h in hashes[words.base[k] : words.base[k] + words.count[k]]], np.uint64) + np.arange(words.count[k], dtype=np.uint64)).sum(dtype=np.uint64) for k in short.tolist()]
    doc, shingle = np.r_[words.doc[at], short], np.r_[shingle, np.array(of, np.uint64)]
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[new], shingle[new]


def wide_fingerprints(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a number for its set of shingles, a fingerprint of ``WIDE`` words over the set, and ``MEETINGS`` least hashes of it."""
    doc, shingle = shingle_sets(words, size)
    n = np.bincount(doc, minlength=len(words.count))
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    prints, least = np.zeros((len(n), WIDE), np.uint64), np.zeros((len(n), MEETINGS), np.uint64)
    node = np.zeros(len(n), np.uint64)
    if len(some):
        node[some] = np.add.reduceat(mixed(shingle ^ np.uint64(0xE7037ED1A0B428DB)), starts)
        for k in range(WIDE):
            prints[some, k] = voted(mixed(shingle + np.uint64(k)), starts, n[some])
        for k in range(MEETINGS):
            least[some, k] = np.minimum.reduceat(mixed(shingle ^ np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64)), starts)
    return node, prints, least


def linked_sets(sets: list[np.ndarray], similarity: float, label: np.ndarray, asking: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For sets of distinct hashes: the smallest number joined with each by links of a Jaccard similarity of at least ``similarity``.

    Sets of one ``label`` are joined already. Each set of ``asking`` is compared with those of ``home``.
    """
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    label, held = label.copy(), np.zeros(len(values), bool)
    for k in asking.tolist():
        # members of one component need no further link
        rest = home[label[home] != label[k]]
        rest = rest[np.minimum(size[rest], size[k]) >= similarity * np.maximum(size[rest], size[k])]
        if not len(rest):
            continue
        own = ids[start[k] : start[k] + size[k]]
        held[own] = True
        index, n = taken(size, rest)
        # no set is empty
        both = np.add.reduceat(held[ids[index]], np.cumsum(n) - n, dtype=np.int64)
        held[own] = False
        near = label[rest[both >= similarity * (size[k] + n - both)]]
        if len(near):
            join = np.isin(label, np.r_[near, label[k]])
            label[join] = label[join].min()
    return label


def met(rows: DataFrame, member: str) -> DataFrame:
    """Rows dealt to the tasks (i, j) of their block: as one of the block's home part i, met by every part j of the rows that ask, and, if it asks, as one of part j at every home part.

    ``rows``: with ``parts`` home parts, ``asking_parts`` and ``asks``.
    """
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n, seed: F.pmod(F.xxhash64(F.col(member), F.lit(seed)), F.col(n))
    home = rows.select("*", part("parts", 1).alias("i"), to("asking_parts").alias("j"), F.lit(True).alias("home"))
    away = rows.where("asks").select("*", to("parts").alias("i"), part("asking_parts", 2).alias("j"), F.lit(False).alias("home"))
    return home.unionByName(away)


PRINT = [f"p{k}" for k in range(WIDE)]


def candidate_links(nodes: DataFrame, reach: int) -> DataFrame:
    """(a, b) that join the fingerprints (node, p0 ..., least) of at most ``reach`` differing bits that share a least hash.

    A block of more than ``MEET`` fingerprints is first held against its smallest one. What lies near that is joined
    by it; only the others go on to ask all parts of the block, so groups of copies take one step, however large. In each
    block or part the search descends a vantage-point tree of its fingerprints.
    """

    def deal(batches):
        for b in batches:
            least = np.frombuffer(b"".join(b["least"].to_pylist()), np.uint64).reshape(-1, MEETINGS)
            block = mixed(least + np.arange(MEETINGS, dtype=np.uint64)[None, :]).view(np.int64)
            rows = pa.array(np.repeat(np.arange(len(least)), MEETINGS))
            yield pa.record_batch({"block": pa.array(block.ravel()), "node": b["node"].take(rows)} | {p: b[p].take(rows) for p in PRINT})

    dealt = written(nodes.mapInArrow(deal, "block long, node long, " + ", ".join(f"{p} long" for p in PRINT)), "dealt")
    large = dealt.groupBy("block").agg(F.count("*").alias("n"), F.min(F.struct("node", *PRINT)).alias("first")).where(F.col("n") > MEET)
    large = written(large.select("block", "n", F.col("first.node").alias("leader"), *[F.col(f"first.{p}").alias(f"l{p}") for p in PRINT]), "large")
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"l{p}"))) for p in PRINT), F.lit(0))
    asks = F.coalesce(apart > reach, F.lit(False))
    rows = dealt.join(small_side(large), "block", "left").withColumn("asks", asks).drop(*[f"l{p}" for p in PRINT])
    led = rows.where("leader IS NOT NULL AND NOT asks AND node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    asking = small_side(written(rows.where("asks").groupBy("block").agg(F.count("*").alias("n_asking")), "asking"))
    in_parts = lambda n: F.coalesce(F.ceil(F.col(n) / MEET), F.lit(1)).cast("long")
    # large blocks that nothing asks are done
    rows = rows.join(asking, "block", "left").where("n IS NULL OR n_asking > 0").withColumns({"parts": in_parts("n"), "asking_parts": in_parts("n_asking"), "whole": F.col("n").isNull()})

    def meet(batches):
        """Blocks of one partition, part by part; most are single fingerprints."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        block, i, j = (table[c].to_numpy() for c in ("block", "i", "j"))
        order = np.lexsort((table["node"].to_numpy(), j, i, block))
        block, i, j, node = block[order], i[order], j[order], table["node"].to_numpy()[order]
        home, whole = (table[c].to_numpy(zero_copy_only=False)[order] for c in ("home", "whole"))
        fps = np.stack([table[p].to_numpy()[order].view(np.uint64) for p in PRINT], axis=1)
        begin = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        end = np.r_[begin[1:], len(block)]
        left, right = [], []
        for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
            every = np.arange(b - a)
            label = joined(fps[a:b], every if whole[a] else every[~home[a:b]], every[home[a:b]], reach)
            some = np.flatnonzero(label != every)
            left.append(node[a:b][some])
            right.append(node[a:b][label[some]])
        if left:
            yield pa.record_batch({"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))})

    return led.unionByName(met(rows, "node").select("block", "i", "j", "node", "home", "whole", *PRINT).repartition("block", "i", "j").mapInArrow(meet, "a long, b long"))


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that join the members (node, group, shingles) of a group whose sets have a Jaccard similarity of at least ``similarity``.

    All members are held against the group's smallest first; only those unlike it are compared with all others, in
    parts of bounded size. Members that are joined already need no further link.
    """
    leaders = sets.where("node = group").select("group", F.col("shingles").alias("leader"))

    def against(batches):
        for b in batches:
            near = []
            for own, leader in zip(b["shingles"].to_pylist(), b["leader"].to_pylist(), strict=True):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(leader, np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if small >= similarity * large else 0
                near.append(both >= similarity * (small + large - both))
            yield pa.record_batch({"node": b["node"], "group": b["group"], "asks": pa.array(~np.array(near, bool)), "octets": pc.binary_length(b["shingles"]).cast(pa.int64())})

    told = written(sets.join(leaders, "group").select("node", "group", "shingles", "leader").mapInArrow(against, "node long, group long, asks boolean, octets long"), "against")
    led = told.where("NOT asks AND node <> group").select(F.col("node").alias("a"), F.col("group").alias("b"))
    in_parts = lambda n: F.ceil(n / SET_BYTES).cast("long")
    open_groups = told.groupBy("group").agg(in_parts(F.sum("octets")).alias("parts"), in_parts(F.sum(F.when(F.col("asks"), F.col("octets")))).alias("asking_parts")).where("asking_parts > 0")
    rows = told.join(small_side(written(open_groups, "open")), "group").drop("octets")
    rows = rows.join(sets.select("node", "shingles"), "node")

    def verify(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        node, home, asks = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "home", "asks"))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        every = np.arange(len(node))
        # a member that asks in its own part is there twice; those that don't ask are joined by the leader
        label = np.unique(node, return_index=True)[1][np.unique(node, return_inverse=True)[1]]
        label[~asks] = label[~asks].min(initial=len(node))
        label = linked_sets(sets, similarity, label, every[~home], every[home])
        some = np.flatnonzero(node[label] != node)
        return pa.table({"a": pa.array(node[some]), "b": pa.array(node[label[some]])})

    compared = met(rows, "node").groupBy("group", "i", "j").applyInArrow(lambda table: verify(table), "a long, b long")
    return led.unionByName(compared)


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, candidate_reach: int = 64) -> DataFrame:
    """The rows of ``documents``, all columns as they were, without all but one of each near-duplicate group.

    Texts link where the Jaccard similarity of their sets of shingles of ``size`` words is at least ``similarity``.
    Candidates are found by fingerprints of ``64 * WIDE`` bits over the sets, of which texts of similarity 0.8 differ in
    39 bits and, but for a few in a million, in at most ``candidate_reach``. At that radius a vantage-point tree over the
    whole table sends each fingerprint into nearly all shards; shards are the fingerprints that share one of
    ``MEETINGS`` least shingle hashes instead, where texts of similarity 0.8 miss each other less than twice in a
    thousand, and within a shard a vantage-point tree finds those in reach. The sets of each group of candidates are then
    compared themselves. Equal sets count once.

    The row of the smallest key stays (null first, then the smaller hash of the text); of rows equal in both, any one.
    Texts without words, null ones too, are copies of each other. Columns of any name stay; an empty table stays empty.
    """
    key_type = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    whole = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    rows = rows.select("row", F.col(f"row.`{key}`").alias("key"), F.xxhash64(whole).alias("tie"))
    texts = rows.select("key", "tie", whole.alias("text"))

    def run(batches):
        for table in chunks(batches, byte_sizes, CHUNK_BYTES):
            node, prints, least = wide_fingerprints(Words(table["text"], lower=True), size)
            columns = {"key": table["key"].combine_chunks(), "tie": table["tie"].combine_chunks(), "node": pa.array(node.view(np.int64))}
            yield pa.record_batch(columns | {p: pa.array(prints[:, k].view(np.int64)) for k, p in enumerate(PRINT)} | {"least": pa.array([r.tobytes() for r in least], pa.binary())})

    schema = f"key {key_type}, tie long, node long, " + ", ".join(f"{p} long" for p in PRINT) + ", least binary"
    prints = written(texts.mapInArrow(run, schema), "wide")
    nodes = prints.groupBy("node", *PRINT, "least").agg(F.min(F.struct("key", "tie")).alias("of"))
    nodes = written(nodes.select("node", *PRINT, "least", F.col("of.key").alias("of_key"), F.col("of.tie").alias("of_tie")), "nodes")

    def sets(batches):
        for table in chunks(batches, byte_sizes, CHUNK_BYTES):
            doc, shingle = shingle_sets(Words(table["text"], lower=True), size)
            cuts = np.searchsorted(doc, np.arange(table.num_rows + 1)).tolist()
            yield pa.record_batch({"node": table["node"].combine_chunks(), "group": table["group"].combine_chunks(), "shingles": pa.array([shingle[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})

    members = components(candidate_links(nodes, candidate_reach)).select("node", F.col("root").alias("group"))
    members = members.unionByName(members.select(F.col("group").alias("node"), "group").distinct())
    members = members.join(nodes.select("node", "of_key", "of_tie"), "node")
    # rows equal in key and text are one
    said = texts.join(members, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("tie") == F.col("of_tie"))).groupBy("node", "group").agg(F.min("text").alias("text"))
    held = written(said.mapInArrow(sets, "node long, group long, shingles binary"), "sets")
    roots = components(verified_links(held, similarity))
    roots = nodes.select("node", "of_key", "of_tie").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("of_key", "of_tie")).alias("of"))
    kept = roots.select(F.col("of.of_key").alias("kept_key"), F.col("of.of_tie").alias("kept_tie"))
    joined = rows.join(kept, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("tie") == F.col("kept_tie")), "left_semi")
    return joined.dropDuplicates(["key", "tie"]).select("row.*")
