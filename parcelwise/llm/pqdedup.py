"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, exact cosine rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components, local_components

#: Vectors on which lists and codebooks are fitted: this many, more for more lists, up to a bound; members wanted in a list; members compared in one task.
SAMPLE, MOST_SAMPLE, LIST_SIZE, BLOCK = 16_384, 131_072, 256, 2048
#: Lists at most, an eighth of the greatest sample: beyond some four million vectors lists grow, and work with them.
MOST_LISTS = 16_384
SUBSPACES, CODES = 8, 256


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = np.argmax(points[at : at + 4096] @ centres.T - half, axis=1)
    return out


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centres, and for each subspace a codebook of residuals; fitted on a bounded sample, used for every vector."""

    def __init__(self, sample: np.ndarray, lists: int, reach: float):
        self.centres = k_means(sample, max(1, min(lists, len(sample))), 8, 1)
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.books = [k_means(rest[:, p], min(CODES, len(rest)), 6, 2) for p in self.parts]
        gap = ((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(axis=2) if len(self.centres) <= 512 else None
        self.gap = None if gap is None else np.sqrt(gap)
        self.reach = reach

    def probes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each vector, and which lists hold vectors about ``reach`` away: those whose border with the home list is that near."""
        score = vectors @ self.centres.T - (self.centres**2).sum(axis=1) / 2
        home = np.argmax(score, axis=1)
        gap = self.gap[home] if self.gap is not None else np.sqrt(np.maximum(((self.centres**2).sum(axis=1)[home, None] + (self.centres**2).sum(axis=1) - 2 * self.centres[home] @ self.centres.T), 0))
        return home, score[np.arange(len(home)), home][:, None] - score <= self.reach * gap

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals as codes, and how far each is from what its codes say."""
        codes = np.stack([nearest(rest[:, p], book) for p, book in zip(self.parts, self.books, strict=True)], axis=1)
        said = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(rest - said, axis=1)


def links_in_block(index: Index, number: int, own: np.ndarray, codes: np.ndarray, off: np.ndarray, vectors: np.ndarray, weight: np.ndarray, back: np.ndarray, least: float):
    """For one block of a list: the links that each row of it sees, and the smallest row number joined with it.

    ``own``: rows of the block's members, with their codes and how far off those are; the others only visit. A member
    sees a visitor only where ``back`` says that the visitor's list isn't probed by the member, which would see it there.
    """
    centre = index.centres[number]
    count = np.zeros(len(vectors), np.int64)
    label = np.arange(len(vectors))
    # a product is off by no more than its member's code is, and by the rounding of floats
    bound = (least - off - 1e-5).astype(np.float32)[:, None]
    step = max(1, 400_000 // max(len(own), 1))
    for at in range(0, len(vectors), step):
        queries = vectors[at : at + step]
        near = np.repeat((queries @ centre).astype(np.float32)[None, :], len(own), axis=0)
        for m, (part, book) in enumerate(zip(index.parts, index.books, strict=True)):
            near += (book @ queries[:, part].T).astype(np.float32)[codes[:, m]]
        p, q = np.nonzero(near >= bound)
        apart = own[p] != q + at
        q, p = q[apart], p[apart]
        for k in range(0, len(q), 100_000):
            a, b = q[k : k + 100_000] + at, own[p[k : k + 100_000]]
            linked = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= least
            a, b = a[linked], b[linked]
            np.add.at(count, a, weight[b])
            seen = back[a, p[k : k + 100_000][linked]] if len(a) else np.zeros(0, bool)
            np.add.at(count, b[seen], weight[a[seen]])
            label = local_components(len(vectors), np.r_[a, np.flatnonzero(label != np.arange(len(label)))], np.r_[b, label[label != np.arange(len(label))]])
    return count, label


def canonical(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): each vector's numbers as bytes in their own precision, null if it links with nothing."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    width = np.float32 if kind == "float" else np.float64
    id_type = vectors.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            column = b["v"]
            flat = column.flatten()
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(width) + width(0)  # no negative zeros
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            some = np.flatnonzero(n)
            bad = np.ones(len(n), bool)
            if len(some):
                starts = (ends - n)[some]
                bad[some] = ~np.logical_and.reduceat(np.isfinite(x), starts) | ~np.logical_or.reduceat(x != 0, starts)
            bad |= np.array(b["id"].is_null())
            raw = x.tobytes()
            size = x.itemsize
            yield pa.record_batch({"id": b["id"], "v": pa.array([None if no else raw[size * (e - k) : size * e] for no, e, k in zip(bad.tolist(), ends.tolist(), n.tolist(), strict=True)], pa.binary())})

    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{'float' if width == np.float32 else 'double'}>").alias("v"))
    return rows.mapInArrow(run, f"id {id_type}, v binary").withColumn("digest", F.unhex(F.left(F.sha2("v", 256), F.lit(32))))


def unit(column, width) -> np.ndarray:
    """Vectors of one length in double precision, of length one."""
    x = np.frombuffer(b"".join(column.to_pylist()), width).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, slack: float = 3.0) -> DataFrame:
    """(``key``, n_links, component_id, kept) for each row.

    Links join rows of cosine ``least`` or more in double precision; only pairs seen by their lists are found: a vector
    visits every list whose border lies within ``slack`` standard deviations of a neighbour's offset, which finds nearly
    all. Equal vectors meet as one with a weight, so all links between them count. Rows whose vector is null, empty,
    zero or holds null or non-finite components link with nothing and are their own component; rows with a null key
    link with nothing and are not kept. Rows equal in key and vector count as rows each; vectors of different lengths
    aren't compared; further columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    width = np.float32 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else np.float64
    rows = written(canonical(vectors, key, vector), "rows")
    reps = rows.where("v IS NOT NULL").groupBy("v", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    reps = written(reps.withColumn("dim", F.octet_length("v") / width().itemsize), "reps")
    dims = reps.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each length of vectors
    parts = [links_of_length(reps.where(F.col("dim") == d), int(d), n, least, slack, width) for d, n in dims]
    id_type = rows.schema["id"].dataType.simpleString()
    seen = parts[0] if parts else spark.createDataFrame([], f"rep {id_type}, other {id_type}, n long")
    for more in parts[1:]:
        seen = seen.unionAll(more)
    seen = written(seen, "seen")
    counts = seen.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(seen.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    about = reps.select("digest", "rep", "weight").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.where("v IS NOT NULL").select("id", "digest").join(about, "digest").select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def links_of_length(reps: DataFrame, dim: int, n: int, least: float, slack: float, width) -> DataFrame:
    """(rep, other, n): what the vectors of one length see of each other, by rows from each block.

    Codes are kept in a table of their own with the lists; a block gets its members' codes, with their vectors for the
    rerank, and its visitors' vectors.
    """
    spark = reps.sparkSession
    lists = int(min(MOST_LISTS, -(-n // LIST_SIZE)))
    size = min(MOST_SAMPLE, max(SAMPLE, 8 * lists))
    sample = unit(pa.array([r[0] for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(size).select("v").collect()], pa.binary()), width)
    reach = slack * np.sqrt(max(0.0, 2 - 2 * least) / dim)
    index = spark.sparkContext.broadcast(Index(sample, lists, reach))
    id_type = reps.schema["rep"].dataType.simpleString()

    def coded(batches):
        for b in batches:
            x = unit(b["v"], width)
            home, _ = index.value.probes(x)
            codes, off = index.value.codes(x - index.value.centres[home])
            yield pa.record_batch({"rep": b["rep"], "weight": b["weight"], "v": b["v"], "list": pa.array(home), "codes": pa.array([r.tobytes() for r in codes], pa.binary()), "off": pa.array(off)})

    codes = written(reps.select("rep", "weight", "v").mapInArrow(coded, f"rep {id_type}, weight long, v binary, list long, codes binary, off double"), "codes")
    sizes = codes.groupBy("list").agg(F.count("*").alias("n")).collect()  # MOST_LISTS rows at most
    blocks = np.ones(len(index.value.centres), np.int64)
    for number, count in sizes:
        blocks[number] = -(-count // BLOCK)
    shared = spark.sparkContext.broadcast(blocks)

    def deal(batches):
        for b in batches:
            home, probe = index.value.probes(unit(b["v"], width))
            who, number = np.nonzero(probe)
            n_blocks = shared.value[number]
            who, number, first = np.repeat(who, n_blocks), np.repeat(number, n_blocks), np.cumsum(n_blocks) - n_blocks
            block = np.arange(len(who)) - np.repeat(first, n_blocks)
            at_home = (number == home[who]) & (block == (b["place"].to_numpy()[who] % shared.value[number]))
            only = pa.array(np.where(at_home, who, 0), mask=~at_home)  # visitors need neither codes nor probes
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(probe.sum(axis=1))].astype(np.int32)), pa.array(np.nonzero(probe)[1].astype(np.int32)))
            every = pa.array(who)
            yield pa.record_batch({"list": pa.array(number), "block": pa.array(block), "rep": b["rep"].take(every), "weight": b["weight"].take(every), "of": pa.array(home[who]), "codes": b["codes"].take(only), "off": b["off"].take(only), "probes": lists.take(only), "v": b["v"].take(every)})

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        own = np.flatnonzero(table["codes"].combine_chunks().is_valid().to_numpy(zero_copy_only=False))
        if not len(own):
            return pa.table({"rep": table["rep"].slice(0, 0), "other": table["rep"].slice(0, 0), "n": pa.array([], pa.int64())})
        vectors, of, number = unit(table["v"], width), table["of"].to_numpy(), table["list"][0].as_py()
        members = table.take(pa.array(own))
        codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(own), -1)
        probes = members["probes"].combine_chunks()
        probed = np.zeros((len(own), len(index.value.centres)), bool)
        probed[np.repeat(np.arange(len(own)), probes.value_lengths().to_numpy()), probes.flatten().to_numpy()] = True
        back = ~probed[:, of].T & (of != number)[:, None]
        count, label = links_in_block(index.value, number, own, codes, members["off"].to_numpy(), vectors, table["weight"].to_numpy(), back, least)
        some = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
        return pa.table({"rep": table["rep"].take(pa.array(some)), "other": table["rep"].take(pa.array(label[some])), "n": pa.array(count[some])})

    schema = f"list long, block long, rep {id_type}, weight long, of long, codes binary, off double, probes array<int>, v binary"
    dealt = codes.select("v", "rep", "weight", "codes", "off", F.abs(F.xxhash64("rep")).alias("place")).mapInArrow(deal, schema)
    return dealt.groupBy("list", "block").applyInArrow(lambda table: compare(table), f"rep {id_type}, other {id_type}, n long")
