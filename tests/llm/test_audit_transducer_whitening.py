"""The filter audit, the transducer and the whitening against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from parcelwise.llm import audit, queries, transducer, whitening

RANKS = queries.vocab_path(queries.RANKS)


def plain_audit(docs, labels):
    """Each order applied filter by filter."""
    tests = {
        "A": lambda t, w: len(w) < 200,
        "B": lambda t, w: 100 * len(set(w)) < 50 * len(w),
        "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
        "D": lambda t, w: bool(re.search("[#$%&*|]", t)),
    }
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    rows = []
    for k, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, test in tests.items() if test(t, words)}
        if k is not None and least[t] < k:
            fails.add("E")
        rows.append((part or "", fails, any(k is not None and d == k and q == 1 for d, q, _ in labels), any(k is not None and d == k and x == 1 for d, _, x in labels)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                total[f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v[:6], total[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "delta#", "e", "zeta"]
    texts = [None, "", " \t\n ", "A" * 40, "x " * 30_000, " ", *(" ".join(rng.choice(words[: rng.randint(1, 6)]) + rng.choice(["", str(rng.randint(0, 999))]) for _ in range(rng.choice([3, 150, 250]))) for _ in range(40))]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [docs[7], docs[7], (None, texts[8], "en"), (None, texts[8], "en"), (3, texts[9], "de"), (-5, texts[8], "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_every_order_of_the_filters(spark, audited):
    docs, labels = audited
    d = spark.createDataFrame([(*r, "m", 1, "d") for r in docs], "doc_id long, text string, lang string, mask string, n int, digest string").repartition(3)
    g = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(audit.masks(d, g)).collect()}
    want = plain_audit(docs, labels)
    assert got == want and len(got) == 600 * len({(r[2] or "") for r in docs})
    assert audit.audit(audit.masks(d.where("doc_id > 10000"), g)).isEmpty()
    alone = audit.audit(audit.masks(d.where("doc_id = 20"), g.where("doc_id > 100000"))).collect()
    assert len(alone) == 600 and {r.good_lost for r in alone} == {0}


def test_the_audit_in_sql(spark, audited):
    docs, labels = audited
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    cursor = c.execute(audit.AUDIT_SQL)
    assert {tuple(r[:3]): tuple(r[3:]) for r in cursor.fetchall()} == plain_audit(docs, labels)


def test_the_zeta_transform_sums_over_subsets(spark):
    values = [random.Random(1).randint(0, 99) for _ in range(32)]
    got = spark.range(1).select(audit.zeta(F.array(*[F.lit(v).cast("bigint") for v in values]))).first()[0]
    assert got == [sum(v for t, v in enumerate(values) if t & s == t) for s in range(32)]


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=transducer.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return transducer.Encoder(RANKS, transducer.split_pattern())


def hard_texts():
    rng = random.Random(12)
    pieces = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "a", "B1", "'s", "'LL", "é", "日本", "9", "!?", "<|endoftext|>", "\0", "=====", "the", " ingly", "🙂", "՘", "\U00010ee7a", "ing.", "न्"]
    return [None, "", " ", "word " * 3000, "y" * 9000, "=" * 5000, "é" * 5000, " " * 700, *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(1500))]


def test_texts_encode_as_the_library_does(own, encoding):
    texts = hard_texts()
    assert [x.tolist() for x in own.encode(texts)] == [encoding.encode_ordinary(t or "") for t in texts]


def test_every_code_point_encodes_and_decodes(own, encoding):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}" for c in points[k : k + 64]) for k in range(0, len(points), 64 * 3)]
    ids = own.encode(texts)
    utf8 = transducer.Decoder(RANKS).utf8
    for t, got in zip(texts, ids, strict=True):
        assert got.tolist() == encoding.encode_ordinary(t) and utf8.text(got.tolist()) == t


def test_bytes_encode_as_merging_does_with_little_memory(encoding, monkeypatch):
    for name, value in (("MOST_STATES", 300), ("MOST_PAIRS", 50), ("MOST_WORDS", 40), ("READ_AHEAD", 16), ("MOST_COMPARED", 4), ("MORE_STATES", 8)):
        monkeypatch.setattr(transducer, name, value)
    small = transducer.Encoder(RANKS, transducer.split_pattern())
    rng = random.Random(3)
    pieces = small.merges.pieces
    for _ in range(300):
        word = b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert small.machine.ids(word) == encoding._encode_single_piece(word)
        assert np.frombuffer(small.machine.each([word])[0], np.int32).tolist() == encoding._encode_single_piece(word)
    texts = hard_texts()[:60]
    assert [x.tolist() for k in range(0, 60, 6) for x in small.encode(texts[k : k + 6])] == [encoding.encode_ordinary(t or "") for t in texts]


def plain_merges(ranks, data):
    parts = [data[k : k + 1] for k in range(len(data))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks_even_ones_with_tokens_that_merging_never_gives(seed):
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = [b"a", b"b", b"c"]
    while len(tokens) < 25:
        new = rng.choice(tokens) + rng.choice(tokens)
        if new not in ranks and len(new) < 9:
            ranks[new] = 256 + len(tokens)
            tokens.append(new)
    lost = b"abcabcabc" if seed % 2 else None
    if lost and lost not in ranks:
        ranks[lost] = 400
    machine = transducer.Transducer(transducer.Merges(ranks))
    for _ in range(400):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
        want = [ranks[word]] if word in ranks else plain_merges(ranks, word)
        whole = machine.merges.whole
        assert ([whole[word]] if word in whole else machine.ids(word)) == want


def test_bytes_that_are_no_text_decode_as_python_does():
    utf8 = transducer.Utf8Machine([bytes([b]) for b in range(256)])
    rng = random.Random(4)
    for _ in range(3000):
        data = bytes(rng.choice([*range(0x7E, 0x100), 0x41]) for _ in range(rng.randint(0, 9)))
        assert utf8.text(list(data)) == data.decode("utf-8", "replace")
    assert utf8.text([65, None, 300, -1, 66]) == "AB"


def test_round_trips_of_tables(spark, encoding):
    texts = hard_texts()[:200]
    rows = [(k, t, "i", "k", "n") for k, t in enumerate(texts)] + [(5, texts[5], "i", "k", "n"), (None, "null key", "i", "k", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, key string, n_tokens string").repartition(3)
    encoded = transducer.encode(df, RANKS)
    for got in (transducer.round_trip(df, RANKS).collect(), transducer.digest(encoded, RANKS).collect()):
        assert len(got) == len(rows)
        for r in got:
            text = "null key" if r.doc_id is None else texts[r.doc_id] or ""
            ids = encoding.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = transducer.decode(encoded.withColumn("decoded", F.lit(1)), RANKS)
    assert back.columns == ["doc_id", "ids", "decoded"] and all(r.decoded == ("null key" if r.doc_id is None else texts[r.doc_id] or "") for r in back.collect())
    assert transducer.round_trip(df.where("doc_id > 10000"), RANKS).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, [72, None, 99_999_999])], "doc_id long, ids array<int>")
    assert [r.decoded for r in transducer.decode(odd, RANKS).orderBy("doc_id").collect()] == ["", encoding.decode([72])]


SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def whitened(spark, rows):
    return whitening.whiten(spark.createDataFrame([(k, v, "x", 9) for k, v in rows], SCHEMA).repartition(3)).collect()


def plain_whitening(rows):
    kept = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    mean = fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return kept, fit, mean, values[::-1], vectors[:, ::-1]


def vectors(dims, n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) * np.linspace(2, 0.2, dims)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    return [*rows, rows[3], rows[3], (None, rows[4][1]), (n + 1, rows[5][1]), (n + 2, None), (n + 3, [None] * dims), (n + 4, [float("nan")] * dims), (n + 5, [float("inf")] + [0.0] * (dims - 1))]


@pytest.mark.parametrize("dims", [2, 4, 24, 90])
def test_whitening_by_the_covariance_itself(spark, dims):
    rows = vectors(dims, 300)
    got = whitened(spark, rows)
    kept, fit, mean, values, turn = plain_whitening(rows)
    k = min(4, dims)
    assert len(got) == k * len(kept) and {r.n for r in got} == {len(fit)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sums = [int(c) for c in fit.sum(axis=0)]
    known = {}
    for key, x in kept:
        known.setdefault(key, []).append(x)
    signs = {}
    for r in sorted(got, key=lambda r: (r.component, str(r.vec_id))):
        x = known[r.vec_id][0]
        assert r.deviation == sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = (np.array(x) - mean) @ turn[:, r.component - 1] / np.sqrt(values[r.component - 1])
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert r.whitened == pytest.approx(sign * want, abs=1e-7)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


def test_close_eigenvalues_are_certified(spark):
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(k, [int(c) for c in v]) for k, v in enumerate(np.round(rng.standard_normal((3000, 120)) * 500))], "vec_id long, x array<bigint>")
    model = whitening.fit(x, 120, 4, width=8, held=4)
    data = np.array([r.x for r in x.collect()], float)
    values = np.linalg.eigvalsh(np.cov(data.T, bias=True))[::-1]
    assert model.passes > 10 and model.eigenvalues == pytest.approx(values[:4], rel=1e-11) and model.residuals.max() <= 1e-12 * values[0]
    with pytest.raises(RuntimeError):
        whitening.fit(x, 120, 4, width=8, most=2)


def test_whitening_of_little_and_of_nothing(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None), (2, [])]) == []
    one = whitened(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, 0.0) for r in one)
    two = whitened(spark, [(1, [0.5, 0.25, 1.0]), (2, [0.75, 0.25, 1.0])])
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in two) == [(v, c, c > 1) for v in (1, 2) for c in (1, 2, 3)]
    assert {round(abs(r.whitened), 9) for r in two if r.component == 1} == {1.0} and two[0].identity_error < 1e-9
    uneven = whitened(spark, [(1, [0.5, 0.25]), (2, [0.75, 1.0]), (3, [1.0])])
    assert {r.vec_id for r in uneven} == {1, 2}
    huge = whitening.Whitening(3, [2**60, 0], 1.0, np.eye(2), np.ones(2), np.zeros(2), 1)
    assert whitening.deviations(np.array([[0, 0], [2**60 // 3, 1]]), huge) == [None, 10]
