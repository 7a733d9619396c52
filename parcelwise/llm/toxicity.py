"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word enters as the mean of its character n-grams' vectors beside a vector of its own; runs of ``WINDOW`` words that
overlap cover every text, and the network gives each window a logit. A text's score follows from its greatest logit
and its number of windows by a logistic fit. Training, in numpy, takes a bounded sample of labelled rows: at most
``per_class`` of each label, chosen by a hash of the key. A text's label is explained by any of its windows (noisy or),
since most words of a toxic text are harmless. A first round learns from ``windows`` windows of each text, evenly
spread; Spark then scores every window of the sampled texts, and a second round learns from those that score most in
each. The logistic fit rests on the greatest logit among all windows of each sampled text, as scores do.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_sizes
from .common import chunks, written
from .words import mixed

WINDOW, STRIDE = 64, 48
#: Width of a state in one direction, of a word's vector, of an n-gram's vector, and of the attention.
STATE, WORD, CHARS, ATTEND = 8, 8, 16, 8
CHUNK_CHARS, BATCH, CACHED_WORDS = 1_500_000, 2048, 120_000
WORDS_AT_ONCE = 20_000
#: N-grams are told apart by this many bits of a hash.
BUCKET_BITS, FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all runs of three to five characters of words between ^ and $, word after word, and the word of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(c))
    c = np.r_[c, np.zeros(5, np.uint64)]
    n = len(c) - 5
    runs, h = np.empty((n, 3), np.uint64), c[:n] * FACTOR + c[1 : n + 1]
    for k in range(3):
        h = h * FACTOR + c[k + 2 : n + k + 2]
        runs[:, k] = mixed(h) >> np.uint64(64 - BUCKET_BITS)
    whole = left[:, None] >= np.arange(3, 6)[None, :]
    return runs[whole].astype(np.int64), np.repeat(np.repeat(np.arange(len(words)), lengths), whole.sum(axis=1))


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover ``n`` words; the last one ends with the text."""
    return np.r_[np.arange(0, max(n - WINDOW, 0), STRIDE), max(n - WINDOW, 0)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """The parameters, the two vocabularies and the passes through the network."""

    def __init__(self, words: list[str], buckets: np.ndarray, seed: int = 3):
        """``buckets``: those of known n-grams; n-grams in others are passed over."""
        rng = np.random.default_rng(seed)
        self.words = {w: k + 1 for k, w in enumerate(words)}
        self.row = np.full(1 << BUCKET_BITS, -1, np.int32)
        self.row[buckets] = np.arange(len(buckets))
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": np.zeros((len(words) + 1, WORD), np.float32), "gram": 0.1 * rng.standard_normal((len(buckets), CHARS)).astype(np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": draw(WORD + CHARS, 3 * STATE), f"U{way}": draw(STATE, 3 * STATE), f"b{way}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"A": draw(2 * STATE, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "w": draw(2 * STATE), "c": np.full(1, -2, np.float32)}
        self.fit = np.array([1.0, 0.0, 0.0])

    def grow(self, words: list[str], buckets: np.ndarray, seed: int = 4) -> None:
        """Make room for more words and buckets."""
        for w in words:
            self.words.setdefault(w, len(self.words) + 1)
        new = buckets[self.row[buckets] < 0]
        self.row[new] = len(self.p["gram"]) + np.arange(len(new))
        self.p["word"] = np.concatenate([self.p["word"], np.zeros((len(self.words) + 1 - len(self.p["word"]), WORD), np.float32)])
        self.p["gram"] = np.concatenate([self.p["gram"], 0.1 * np.random.default_rng(seed).standard_normal((len(new), CHARS)).astype(np.float32)])

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word (0: unknown), its known n-grams end to end, and how many each has."""
        bucket, word = gram_buckets(words)
        row = self.row[bucket]
        known = row >= 0
        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words)), row[known].astype(np.int64), np.bincount(word[known], minlength=len(words))

    def vectors(self, features) -> np.ndarray:
        number, piece, n = features
        sums = np.zeros((len(n), CHARS), np.float32)
        some = n > 0
        if some.any():
            sums[some] = np.add.reduceat(self.p["gram"][piece], (np.cumsum(n) - n)[some], axis=0)
        return np.concatenate([self.p["word"][number], sums / np.maximum(n, 1)[:, None].astype(np.float32)], axis=1)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates in both directions; row 0 stands for no word."""
        out = np.concatenate([vectors @ self.p["Wf"] + self.p["bf"], vectors @ self.p["Wb"] + self.p["bb"]], axis=1)
        return np.concatenate([np.zeros((1, 6 * STATE), np.float32), out.astype(np.float32)])

    def logits(self, gates: np.ndarray, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window; ``codes``: rows of ``gates``, 0 after a window's last word."""
        n, length = codes.shape
        real = (codes > 0).astype(np.float32)
        states = np.zeros((length, n, 2 * STATE), np.float32)
        steps = {"f": [], "b": []}
        for way, times in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            side = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            inputs = slice(0, 3 * STATE) if way == "f" else slice(3 * STATE, 6 * STATE)
            h, U, own = np.zeros((n, STATE), np.float32), self.p[f"U{way}"], gates[:, inputs]
            for t in times:
                x, rec, m = own[codes[:, t]], h @ U, real[:, t : t + 1]
                zr = sigmoid(x[:, : 2 * STATE] + rec[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                new = np.tanh(x[:, 2 * STATE :] + r * rec[:, 2 * STATE :])
                if keep is not None:
                    steps[way].append((t, h, z, r, new, rec[:, 2 * STATE :], m))
                h = h + m * (1 - z) * (new - h)
                states[t, :, side] = h
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(real.T > 0, u @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0)) * (real.T > 0)
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "u": u, "alpha": alpha, "pooled": pooled, "codes": codes}
        return pooled @ self.p["w"] + self.p["c"][0]

    def gradients(self, kept: dict, d: np.ndarray, n_gates: int) -> tuple[dict, np.ndarray]:
        """Of all dense parameters, and of the rows of ``gates``, from ``d``, the gradient of the logits."""
        states, u, alpha, codes = kept["states"], kept["u"], kept["alpha"], kept["codes"]
        g = {"w": kept["pooled"].T @ d, "c": np.array([d.sum()])}
        d_pooled = d[:, None] * self.p["w"]
        d_states = alpha[:, :, None] * d_pooled[None]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_e, u)
        d_u = d_e[:, :, None] * self.p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tnh,tna->ha", states, d_u), d_u.sum(axis=(0, 1))
        d_states += d_u @ self.p["A"].T
        d_gates = np.zeros((n_gates, 6 * STATE))
        for way in "fb":
            side = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            inputs = slice(0, 3 * STATE) if way == "f" else slice(3 * STATE, 6 * STATE)
            U, d_U, d_h = self.p[f"U{way}"], np.zeros((STATE, 3 * STATE)), np.zeros((codes.shape[0], STATE))
            by_step = np.zeros((codes.shape[1], codes.shape[0], 3 * STATE))
            for t, h, z, r, new, rec_n, m in reversed(kept["steps"][way]):
                d_h = d_h + d_states[t, :, side]
                d_out = m * d_h
                d_n = d_out * (1 - z) * (1 - new * new)
                d_z = d_out * (h - new) * z * (1 - z)
                d_r = d_n * rec_n * r * (1 - r)
                back = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_U += h.T @ back
                d_h = (1 - m) * d_h + d_out * z + back @ U.T
                by_step[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            some, total = summed(codes.T.ravel(), by_step.reshape(-1, 3 * STATE))
            d_gates[some, inputs] = total
            g[f"U{way}"] = d_U
        return g, d_gates[1:]


class Bags:
    """The windows of labelled texts as numbers of words: ``texts`` has a list of arrays for each text, ``words`` each word once."""

    def __init__(self, bags, labels):
        number: dict[str, int] = {}
        self.texts = [[np.fromiter((number.setdefault(w, len(number)) for w in window.split()), np.int32) for window in bag] for bag in bags]
        self.words, self.labels = list(number), np.array(labels)

    def known(self) -> tuple[list[str], np.ndarray]:
        """The words and n-grams that a network should know: words of at least three texts, n-grams of at least three words."""
        n = np.zeros(len(self.words), np.int32)
        for text in self.texts:
            n[np.unique(np.concatenate([np.zeros(0, np.int32), *text]))] += 1
        grams = np.zeros(1 << BUCKET_BITS, np.int32)
        for at in range(0, len(self.words), WORDS_AT_ONCE):
            grams += np.bincount(gram_buckets(self.words[at : at + WORDS_AT_ONCE])[0], minlength=1 << BUCKET_BITS).astype(np.int32)
        return sorted(self.words[k] for k in np.flatnonzero(n >= 3).tolist()), np.flatnonzero(grams >= 3)


def train(bags: Bags, net: Network | None = None, epochs: int = 2, least_steps: int = 120, rate: float = 0.01, seed: int = 5) -> Network:
    """A network fitted to bags of windows, or ``net`` fitted further."""
    if net is None:
        net = Network(*bags.known())
    else:
        net.grow(*bags.known())
    parts = [net.features(bags.words[at : at + WORDS_AT_ONCE]) for at in range(0, len(bags.words), WORDS_AT_ONCE)]
    every = tuple(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int32) for k in range(3))
    del parts
    begin = np.cumsum(every[2]) - every[2]
    rows, labels = bags.texts, bags.labels
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(epochs, -(-least_steps // -(-len(rows) // 32)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            picked = order[at : at + 32]
            windows = [x for k in picked for x in rows[k]]
            bag = np.repeat(np.arange(len(picked)), [len(rows[k]) for k in picked])
            known, codes = padded(windows)
            n = every[2][known]
            piece = every[1][np.repeat(begin[known] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            features = every[0][known], piece, n
            vectors, kept = net.vectors(features), {}
            logit = net.logits(net.gates(vectors), codes, kept).astype(np.float64)
            p = sigmoid(logit)
            none = np.zeros(len(picked))
            np.add.at(none, bag, np.log1p(-np.clip(p, 0, 1 - 1e-7)))
            y, any_p = labels[picked], np.clip(-np.expm1(none), 1e-6, 1 - 1e-7)
            # of the cross entropy of 1 - prod(1 - p)
            d = np.where(y[bag] == 1, -p * (1 - any_p[bag]) / any_p[bag], p) / len(picked)
            g, d_gates = net.gradients(kept, d, len(known) + 1)
            d_vectors = d_gates[:, : 3 * STATE] @ net.p["Wf"].T + d_gates[:, 3 * STATE :] @ net.p["Wb"].T
            g |= {"Wf": vectors.T @ d_gates[:, : 3 * STATE], "bf": d_gates[:, : 3 * STATE].sum(axis=0), "Wb": vectors.T @ d_gates[:, 3 * STATE :], "bb": d_gates[:, 3 * STATE :].sum(axis=0)}
            step += 1
            now = rate * (1 - 0.7 * epoch / epochs)
            for k, grad in g.items():
                adam(net.p[k], moments[k], grad, step, now, slice(None))
            known_words = np.flatnonzero(features[0])
            sparse(net.p["word"], moments["word"], features[0][known_words], d_vectors[known_words, :WORD], step, now)
            sparse(net.p["gram"], moments["gram"], piece, np.repeat((d_vectors[:, WORD:] / np.maximum(n, 1)[:, None]).astype(np.float32), n, axis=0), step, now)
    return net


def padded(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in windows, and each window as 1 + place among them, 0 after its end."""
    known, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *windows]), return_inverse=True)
    lengths = np.array([len(x) for x in windows])
    codes = np.zeros((len(windows), max(1, lengths.max(initial=1))), np.int64)
    codes[np.arange(codes.shape[1])[None, :] < lengths[:, None]] = inverse + 1
    return known, codes


def adam(value: np.ndarray, moment, grad: np.ndarray, step: int, rate: float, at) -> None:
    m, v = moment
    m[at] = 0.9 * m[at] + 0.1 * grad
    v[at] = 0.99 * v[at] + 0.01 * grad * grad
    value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)


def summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and the sum of the rows of each."""
    order = np.argsort(index, kind="stable")
    begin = np.flatnonzero(np.diff(index[order], prepend=-1))
    return index[order][begin], np.add.reduceat(rows[order], begin, axis=0)


def sparse(value: np.ndarray, moment, index: np.ndarray, grad: np.ndarray, step: int, rate: float) -> None:
    if len(index):
        some, total = summed(index, grad)
        adam(value, moment, total, step, rate, some)


def calibrated(logit: np.ndarray, n: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """(slope, by log of the windows, intercept) of a ridge logistic fit, each label weighted to its share."""
    x = np.stack([logit, np.log(n), np.ones(len(n))], axis=1)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    b = np.array([1.0, 0.0, 0.0])
    ridge = np.diag([1e-2, 1.0, 1e-3])
    for _ in range(50):
        p = sigmoid(x @ b)
        gradient = x.T @ (weight * (p - y)) + ridge @ (b - np.array([1.0, 0.0, 0.0]))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        change = np.linalg.solve(hessian, gradient)
        b = b - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return b


def fit(documents: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1500, windows: int = 8) -> Network | None:
    """A network fitted to rows of ``documents`` whose key has a label 0 or 1 and for which ``usable`` (of the key) holds; None without both labels.

    ``per_class`` bounds the labelled rows that are learnt from, ``windows`` what of each reaches the driver in a round;
    every window of them is scored in Spark. Of rows that repeat a key the least text stands for all; a key with both
    labels counts as 1. Rows without a usable label, null keys and further columns take no part; empty tables give None.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & usable).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    counts = {y: n for y, n in rows.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return None
    rows = rows.withColumn("h", F.xxhash64(F.lit(11), "key"))
    chosen = rows.where("y = 0").orderBy("h").limit(per_class).unionAll(rows.where("y = 1").orderBy("h").limit(per_class))
    texts = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen.select("key", "y", "h")), "key")
    sample = written(texts.groupBy("h", "y").agg(F.min("text").alias("text")), "sample")

    def spread(batches):
        for b in batches:
            out = []
            for value in b["text"].to_pylist():
                words = words_of(value)
                starts = window_starts(len(words))
                starts = starts[np.unique(np.linspace(0, len(starts) - 1, windows).astype(int))]
                out.append([" ".join(words[k : k + WINDOW]) for k in starts.tolist()])
            yield pa.record_batch({"h": b["h"], "y": b["y"], "bag": pa.array(out, pa.list_(pa.string()))})

    def scored(net: Network, most: int):
        """For each sampled text its greatest logit, its number of windows, and the ``most`` windows that score most."""
        shared = documents.sparkSession.sparkContext.broadcast(net)

        def run(batches):
            scorer = Scorer(shared.value)
            for table in chunks(batches, text_sizes, CHUNK_CHARS):
                texts = table["text"].to_pylist()
                owner, first, logit = scorer.windows(texts)
                order = np.lexsort((-logit, owner))
                n = np.bincount(owner, minlength=len(texts))
                begin = np.cumsum(n) - n
                bags = []
                for t, a, k in zip(texts, begin.tolist(), n.tolist(), strict=True):
                    words = words_of(t) if most else []
                    bags.append([" ".join(words[i : i + WINDOW]) for i in first[order[a : a + min(k, most)]].tolist()])
                yield pa.record_batch({"h": table["h"].combine_chunks(), "y": table["y"].combine_chunks(), "best": pa.array(logit[order[begin]], pa.float64()), "n": pa.array(n), "bag": pa.array(bags, pa.list_(pa.string()))})

        out = sorted(sample.mapInArrow(run, "h long, y int, best double, n long, bag array<string>").collect())
        shared.destroy()
        return out

    got = sorted(sample.mapInArrow(spread, "h long, y int, bag array<string>").collect())
    if {r.y for r in got} != {0, 1}:
        return None
    net = train(Bags((r.bag for r in got), [r.y for r in got]))
    got = scored(net, windows)
    net = train(Bags((r.bag for r in got), [r.y for r in got]), net=net, rate=0.005, seed=6)
    got = scored(net, 0)
    net.fit = calibrated(np.array([r.best for r in got]), np.array([r.n for r in got]), np.array([r.y for r in got]), counts[1] / (counts[0] + counts[1]))
    return net


class Scorer:
    """Scores texts in one task and remembers words."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = [self.net.gates(np.zeros((0, WORD + CHARS), np.float32))]

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, first word, logit) of every window of every text, text by text."""
        if len(self.number) > CACHED_WORDS:
            self.forget()
        flat: list[str] = []
        n = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            words = words_of(t)
            n[k] = len(words)
            flat += words
        new = [w for w in dict.fromkeys(flat) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number) + 1, len(self.number) + 1 + len(new)), strict=True))
            self.rows.append(self.net.gates(self.net.vectors(self.net.features(new)))[1:])
        gates = np.concatenate(self.rows)
        self.rows = [gates]
        codes = np.r_[np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)), np.zeros(WINDOW, np.int64)]
        starts = [window_starts(k) for k in n.tolist()]
        owner = np.repeat(np.arange(len(n)), [len(x) for x in starts])
        first = np.concatenate([np.zeros(0, np.int64), *starts])
        base = np.cumsum(n) - n
        logit = np.zeros(len(owner))
        for at in range(0, len(owner), BATCH):
            own, k = owner[at : at + BATCH], first[at : at + BATCH]
            place = np.arange(WINDOW)[None, :] + k[:, None]
            window = np.where(place < n[own][:, None], codes[np.minimum(base[own][:, None] + place, len(codes) - 1)], 0)
            logit[at : at + BATCH] = self.net.logits(gates, window)
        return owner, first, logit

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        owner, _, logit = self.windows(texts)
        n = np.bincount(owner, minlength=len(texts))
        best = np.full(len(n), -np.inf)
        np.maximum.at(best, owner, logit)
        x = np.stack([best, np.log(n), np.ones(len(n))], axis=1)
        return sigmoid(x @ self.net.fit)


def score(documents: DataFrame, net: Network | None, text: str = "text", out: str = "score") -> DataFrame:
    """``documents`` with ``out``, from 0 to 1: how likely label 1 is for the whole text.

    Null and empty texts, and texts without letters, get the score of a window without words. Without a network (no
    labels to learn from) every score is 0. Columns of ``documents`` stay as they are; one named ``out`` is replaced.
    """
    if net is None:
        return documents.withColumn(out, F.lit(0.0))
    shared = documents.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in documents.columns if c != out]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches):
        scorer = Scorer(shared.value)
        for table in chunks(batches, text_sizes, CHUNK_CHARS):
            yield pa.record_batch({"row": table["row"].combine_chunks(), "score": pa.array(scorer(table["text"].to_pylist()))})

    schema = rows.select("row").schema.add("score", "double")
    return rows.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("score").alias(out))
