"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, each operator against brute force."""

import hashlib
import html as entities
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelwise.llm import bpe, graph, html, lines, packing, pii, pqdedup, queries, simhash, substrings, topk, toxicity
from parcelwise.llm.words import Words

VOCAB = queries.vocab_path()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, tie string, source string, n_chars long, row string, fp string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "x", "ETA", "日本語", "theta iota"]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = [None, "", " ", "\n\t ", "one", "two words", "a\x00b  c \n d", "x<|endoftext|>  <|endoftext|> y", shared, shared, "start " + shared + " end", " ".join(["same"] * 90)]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    out += [shared[:200] + "\n" + " ".join(rng.choice(vocabulary) for _ in range(30)), "word " * 30000, "y" * 5000]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(k, t, "k", "t", "src", 1, "r", "f") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (5, texts[5], "k", "t", "src", 1, "r", "f"), (None, "null key", "k", "t", None, None, "r", "f")], SCHEMA).repartition(3)


def as_input(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    documents.write.parquet(path)
    return documents.sparkSession.read.parquet(path)


@pytest.fixture(scope="module")
def stored(documents, tmp_path_factory):
    return as_input(documents, tmp_path_factory)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def test_bpe_round_trip(stored, texts, tokenizer):
    got = bpe.digest(bpe.encode(stored, VOCAB), VOCAB).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "null key" if r.doc_id is None else texts[r.doc_id] or ""
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        want = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want.encode()).hexdigest())
    decoded = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(stored, VOCAB), VOCAB).collect()}
    assert all(decoded[k] == (t or "") for k, t in enumerate(texts))


def test_bpe_of_every_code_point_and_of_white_space(spark, tokenizer, tmp_path):
    rng = random.Random(12)
    blocks = ["".join(chr(c) for c in range(a, min(a + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 4096)]
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "a", "B1", "'s", "'LL", "é", "日本", "9", "!?", "<|endoftext|>", "\0"]
    texts = [*blocks, *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r.ids for r in bpe.encode(spark.read.parquet(str(tmp_path / "t")), VOCAB).collect()}
    for k, t in enumerate(texts):
        assert got[k] == tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_a_second_pass_that_differs_is_noticed(spark):
    import os

    noise = F.udf(lambda x: os.urandom(8).hex()).asNondeterministic()
    changing = spark.range(2).select(F.col("id").alias("doc_id"), noise("id").alias("text"))
    with pytest.raises(Exception, match="the two passes over the texts differ"):
        bpe.encode(changing, VOCAB).collect()


def test_shares_grow_with_the_text():
    assert bpe.shares(0) == bpe.shares(1 << 29) == 48 and bpe.shares(1 << 35) == 384 and bpe.shares(1 << 60) == 32_768


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [197, None, -4, 10**6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, VOCAB).orderBy("doc_id").collect()][1:] == ["", ""]


def test_packing_covers_every_id_once(stored, texts, tokenizer):
    got = packing.pack(stored, VOCAB, capacity=64).collect()
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    seen, sequences = {}, {}
    for r in got:
        if r.doc_id is not None:
            assert r.ids == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[k] == len(x) * (1 + (k == 5)) for k, x in ids.items())
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1]) and sum(n for _, n in own) <= 64
    assert sum(seen.values()) > 0.97 * 64 * (len(sequences) - 1)


def test_best_fit_takes_the_tightest_window():
    lengths = np.array([6, 5, 4, 4, 1])
    window, offset = packing.best_fit_decreasing(lengths, 10)
    assert window.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 9]


def test_windows_that_start_earlier_are_removed(stored, texts):
    for size in (3, 20):
        first, want = set(), {}
        for k, t in sorted(enumerate(texts), key=lambda x: x[0]):
            w = WORD.findall(t or "")
            gone = np.zeros(len(w), bool)
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in first:
                    gone[i : i + size] = True
                first.add(tuple(w[i : i + size]))
            want[k] = (len(w), int(gone.sum()), " ".join(a for a, b in zip(w, gone) if not b))
        got = substrings.remove_repeats(stored, size=size, sketch_bits=18).collect()
        assert len(got) == len(texts) + 2
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is not None} == want


def test_a_crowded_sketch_loses_nothing(stored):
    wide = substrings.remove_repeats(stored, size=5, sketch_bits=22)
    # with 256 cells every window looks repeated
    for bits in (16, 8):
        assert wide.exceptAll(substrings.remove_repeats(stored, size=5, sketch_bits=bits)).isEmpty()


def prints_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups(stored, texts, monkeypatch):
    fp = {k: prints_of(t) for k, t in enumerate(texts)}
    label = dict(zip(fp, fp))
    for _ in fp:
        for a in fp:
            label[a] = min(label[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 2)
    # one shard, a deep tree, and a tree with more leaves than fingerprints
    for points in (8192, 4, 0.1):
        monkeypatch.setattr(simhash, "SHARD_POINTS", points)
        got = simhash.near_duplicates(stored).collect()
        assert len(got) == len(texts) + 2
        assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == label[r.doc_id] for r in got if r.doc_id is not None)


def test_vantage_point_search_is_exact():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    points[1500:] = points[:1500] ^ (np.uint64(1) << rng.integers(0, 63, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 1500, dtype=np.uint64))
    found = set()
    simhash.near_pairs(points, points, 2, lambda p, q: found.update(zip(p.tolist(), q.tolist())))
    brute = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert found == set(zip(*(x.tolist() for x in np.nonzero(brute))))


def test_one_of_each_group_stays(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(30)]
    near = [" ".join("changed" if k in (50, 120) else w for k, w in enumerate(b.split())) for b in base[:10]]
    rows = [(k, t) for k, t in enumerate(base + near + base[:5])] + [(90, None), (91, ""), (None, base[29])]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(29), 90, None}


@pytest.mark.parametrize("small", [False, True])
def test_groups_hold_only_what_the_shingles_link(spark, small, monkeypatch):
    if small:  # every block and group is split
        monkeypatch.setattr(simhash, "MEET", 2)
        monkeypatch.setattr(simhash, "SET_BYTES", 4000)
    rng = random.Random(5)
    rows = []
    for k in range(60):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(4, 196, 6), 1 + k % 10):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    rows += [(200, "one two three four five " * 9 + "six"), (201, "one two three four five")]
    # chains: each like the next, the ends unlike; copies of one text with few words changed
    words = [f"c{k}" for k in range(200)]
    for k in range(300, 330):
        words[(k * 6) % 200] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join([f"d{i}" for i in range(150)] + [f"own{k}"])) for k in range(400, 430)]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows for w in [t.split()]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert sum(0.6 <= alike(2 * k, 2 * k + 1) < 0.8 for k in range(60)) > 20
    label = {k: k for k in sets}
    for _ in range(40):
        label = {k: min([label[k], *(label[j] for j in sets if alike(j, k) >= 0.8)]) for k in sets}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("key", "tie", "node", "row", "_kept_key")})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k in sets if label[k] == k}
    assert 300 in label.values() and sum(v == 300 for v in label.values()) > 5 and sum(v == 400 for v in label.values()) == 30


def test_lines_of_a_host(spark):
    frame = "All rights reserved"
    rows = [(k, "a", f"{frame}\n\nown line {k}\n {frame} ") for k in range(8)] + [(10, "a", frame), (11, "a", None), (12, None, frame), (13, "b", "x\nx\nx"), (14, "a", ""), (15, "a", "own\n" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.row.doc_id: (r.n_lines, r.n_dropped, r.row.text) for r in lines.cleaned(df).collect()}
    assert got[3] == (3, 2, "\nown line 3") and got[10] == (1, 1, "") and got[11] == (0, 0, None) and got[12] == (1, 0, frame) and got[13] == (3, 0, "x\nx\nx") and got[14] == (0, 0, "") and got[15] == (50_000, 0, "own\n" * 50_000)
    assert lines.drop_boilerplate(df, broadcast_bytes=0).exceptAll(lines.drop_boilerplate(df)).isEmpty()
    assert lines.drop_boilerplate(df.limit(0)).isEmpty()
    clashing = df.withColumns({c: F.lit(k) for k, c in enumerate(("host", "common", "lines", "row", "n_lines", "_host", "_lines"))})
    assert lines.drop_boilerplate(clashing).drop(*clashing.columns[3:]).exceptAll(lines.drop_boilerplate(df)).isEmpty()
    assert lines.drop_boilerplate(clashing).columns == clashing.columns and lines.drop_boilerplate(clashing).select("common", "_lines").distinct().collect() == [(1, 6)]


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, value):
    n = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in value.split("."))
    if kind == "card":
        d = [int(c) for c in n][::-1]
        return 14 <= len(n) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0
    return kind == "email" or 10 <= len(n) <= 15


def test_personal_data_spans(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "a@b.c_d@e.f", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "300.1.1.1", "001.02.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2345", "+49 30 1234567 ", "+1", "é日", " ", "\n", "5.5", "12", "٣", "a.b@c", "0" * 40 + "1.1.1.1", "9" * 3000, "a" * 3000]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for k in range(300)] + [(900, None), (901, ""), (902, " ".join(["a@b.c"] * 500)), (903, "a@b" + ".c" * 4000)]
    got = {r.doc_id: r for r in pii.summary(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k, text in rows:
        spans = sorted((m.start(), list(FORMS).index(f), m.end(), f) for f, p in FORMS.items() for m in re.finditer(p, text or "") if right(f, m[0]))
        told = ",".join(f"{f}:{a}:{b}" for a, _, b, f in spans)
        assert got[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), text
        assert [got[k][f"n_{f}"] for f in FORMS] == [sum(s[3] == f for s in spans) for f in FORMS]


def test_terms_that_disclose(spark):
    rows = [(k, f"Call Zorblax now at joe@site.example for item{k}.\nOther line {k}") for k in range(6)] + [(k, f"call now at home for line {k}") for k in range(6, 80)] + [(99, "ZORBLAX, the man. Zorblaxian no"), (100, None), (None, "zorblax")]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in pii.summary(found).collect()}
    assert spans[99] == "term:0:7" and spans[None] == "term:0:7" and spans[100] == "" and spans[50] == "" and "term:5:12" in spans[0]
    clean = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    assert clean[99] == "[EMAIL RELATED], the man. Zorblaxian no" and clean[100] is None and clean[50] == "call now at home for line 50"
    assert "Zorblax" not in clean[0] and "[EMAIL]" in clean[0]


def test_many_matches_and_clashing_columns(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, "é! a@b.c, 1.2.3.4\n" * n, 7, "x")], "doc_id long, text string, said long, row string").withColumns({c: F.lit(c) for c in ("key", "tie", "spans", "clean", "email")})
        start = time.time()
        r = pii.summary(pii.detect(df)).first()
        clean = pii.sanitised(pii.detect(df))
        assert (r.n_email, r.n_ip) == (n, n) and r.spans.startswith("email:3:8,ip:10:17,email:21:26")
        assert clean.first().text == "é! [EMAIL], [IP]\n" * n and clean.columns == df.columns and clean.first().email == "email"
        return time.time() - start

    took(10)
    assert took(16_000) < 5 * took(2_000) + 10


def test_terms_of_two_lines_disclose(spark):
    rows = [(0, "Call Zorblax now at joe@site.example for item0."), (1, "We met Quindle here\n\njoe@site.example\nand then zorblax left"), (2, "Quindle asks joe@site.example"), (3, "Unrelated zorblax text"), (4, "lone Wexford at once@site.example")]
    # a line copied with all around it is one line; a word of many other lines discloses nothing by two
    rows += [(k, "first\nVarnop two@site.example\nlast") for k in (5, 6)] + [(k, f"Common three@site.example {k}") for k in (7, 8)] + [(k, f"call now here for common line {k}") for k in range(9, 80)]
    spans = {r.doc_id: r.spans for r in pii.summary(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    terms = {k: [rows[k][1][int(a) : int(b)] for kind, a, b in (s.split(":") for s in v.split(",") if v) if kind == "term"] for k, v in spans.items()}
    assert terms == {k: [] for k in range(80)} | {0: ["Zorblax"], 1: ["Quindle", "zorblax"], 2: ["Quindle"], 3: ["zorblax"]}


@pytest.mark.parametrize("bits", [8, 2])
def test_exact_top_k(spark, bits):
    rng = np.random.default_rng(2)
    vecs = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.integers(-300, 301, (400, 6)) / 256)]
    vecs += [(k, vecs[k - 20][1]) for k in range(400, 420)]
    vecs += [(1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (1003, []), (3, vecs[3][1]), (7, vecs[8][1]), (100, vecs[100][1]), (1050, [0.01] * 5), (None, [0.0] * 6)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    rows = df.select("vec_id", topk.scaled(F.col("embedding")).alias("vector")).withColumns({c: F.lit(1) for c in ("row", "cells", "query", "id")})
    got = {}
    for r in topk.exact_top_k(rows, F.col("vec_id") % 50 == 0, bits=bits).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v in vecs if k is not None and v and len(v) == 6 and v[0] is not None and np.isfinite(v[0])]
    first = dict(reversed(whole))
    assert set(got) == set(range(0, 420, 50))
    for q in got:
        best = sorted(((-int(first[q] @ v), k) for k, v in whole if k != q))[:5]
        assert sorted(got[q]) == [(i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert 1050 not in got and topk.exact_top_k(rows.limit(0), F.col("vec_id") % 50 == 0).isEmpty()


def test_top_k_of_huge_and_constant_numbers(spark):
    rows = [(k, [(k * 37 % 11 - 5) * 10**7, 10**7]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") == 0, k=3).collect()}
    best = sorted((-(rows[0][1][0] * v[0] + rows[0][1][1] * v[1]), k) for k, v in rows[1:])[:3]
    assert got == {(0, i + 1): (k, -s) for i, (s, k) in enumerate(best)}
    few = topk.exact_top_k(df.where("vec_id < 3").withColumn("vector", F.array(F.lit(1), F.lit(1)).cast("array<bigint>")), F.lit(True))
    assert sorted(map(tuple, few.collect())) == [(0, 1, 1, 2), (0, 2, 2, 2), (1, 1, 0, 2), (1, 2, 2, 2), (2, 1, 0, 2), (2, 2, 1, 2)]


def test_vector_duplicates(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 32))
    base[300:420] = base[5] + 0.05 * rng.standard_normal((120, 32))
    base[420:520] = base[200:300] + 0.1 * rng.standard_normal((100, 32))
    base[600:640] = base[7]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("inf")] * 32), (2003, []), (2004, [None] * 32), (None, [1.0] * 32)]
    rows += [(2005, [1.0] * 8), (2006, [2.0] * 8), (2007, [None, *[1.0] * 31])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "id", "rep", "list", "digest")})
    got = {r.vec_id: r for r in pqdedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and (got[2005].n_links, got[2006].component_id) == (1, 2005) and got[2007].n_links == 0
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    n = np.array([got[k].n_links for k in range(len(base))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.9 * near.sum()
    label = graph.local_components(len(base), *np.nonzero(near))
    assert np.mean(label == [got[k].component_id for k in range(len(base))]) > 0.99
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(2000, 2005)) and not got[None].kept


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and got[501] == 500 and 500 not in got


def test_main_text(spark):
    page = lambda body, k: f"<html><head><title>t{k}</title><style>p{{}}</style><script>var a='</p><article>';</script></head><body><header>Top {k}</header><nav><ul><li>m{k}<li>n</ul></nav><article><h1>Title {k}</h1><p>One &amp; two&nbsp;{k}<br>b<b>o</b>ld<p>Next{body}<div class='share'>Share</div><!-- no --></article><section id='comments'><p>rude</section><aside>side</aside><footer>f</footer></body></html>"
    rows = [(k, "http://www.h.example/a", page("", k)) for k in range(6)] + [(20, None, None), (21, "http://h.example/b", ""), (22, "http://x.example", "plain &lt;text&gt;"), (23, "http://h.example/c", "<div><p>no article here</p></div>"), (24, "http://y.example", "<p unclosed"), (25, "http://z.example", "<div>" * 5000 + "deep")]
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3][0] == "Title 3 One & two 3 b old Next".replace("b old", "bold") or got[3][0] == "Title 3 One & two 3 bold Next"
    assert got[20] == ("", 0) and got[21] == ("", 0) and got[22][0] == "plain <text>" and got[23][0] == "no article here" and got[25][0] == "deep"
    assert all(len(t) == n for t, n in got.values())


def test_wrappers_mark_optional_and_repeated_parts():
    a, b = (html.wrapper(html.parsed(x)) for x in ("<body><div class=a><h1>x</h1><p>1<p>2</div></body>", "<body><div class=a><h1>y</h1><p>3</div><div class=b>only</div></body>"))
    both = html.merged(a, b)
    body = both[html.CHILDREN][0]
    first, second = body[html.CHILDREN]
    assert second[html.FLAGS] & html.OPTIONAL and not first[html.FLAGS] & html.OPTIONAL
    assert first[html.CHILDREN][1][html.FLAGS] & html.REPEATED and first[html.CHILDREN][0][html.CHILDREN][0][html.FIXED] is None


def article_of(page):
    """The article of a page of the synthetic tables, by patterns alone."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S)[1]
    body = re.sub(r"</?b>|<!--.*?-->", "", re.sub(r"<(script|style).*?</\1>", "", body, flags=re.S), flags=re.S)
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_main_text_of_the_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("key", F.lit(1)).withColumn("rule", F.lit("x")).withColumn("host", F.lit(2))
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == want
    assert {r.page_id: r.text for r in html.main_text(pages.repartition(7), broadcast_bytes=0).collect()} == want


def test_what_a_host_always_says_is_not_main_text(spark):
    page = lambda k: f"<body><div class=x1>Welcome to our pages</div><article><div class=q7>Read this first</div><p>Own text {k} of it<p>and more {k * k}" + "<div class=q9>Was changed later</div>" * (k % 2) + "</article><div class=x2>Buy at our shop</div></body>"
    rows = [(k, "http://h.example/a", page(k)) for k in range(12)] + [(k, "http://copies.example/a", page(3)) for k in range(20, 32)] + [(40, "http://few.example", page(3))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[k] == f"Own text {k} of it and more {k * k}" for k in range(12))
    # copies of one page, or few pages, don't show what is fixed
    assert got[20] == got[40] == "Read this first Own text 3 of it and more 9 Was changed later"


def test_names_of_parts_count_only_as_a_whole():
    page = "<body><article><p>a <span class='share'>x <b>y</b></span> b<div class='form-of-life'>kept</div><div class='comment-list'>no<div>no</div></div><div class='ad-300x250'>no</div><p>c</article><div id=talk><article class='reader-comment'>much longer than the article itself is</article></div></body>"
    tree = html.parsed(page)
    assert html.extracted(tree, html.rule(html.wrapper(tree))) == "a b kept c"


def test_deep_and_wide_pages():
    for page, want in (
        ("<p>t" + "<span class=ad>" * 5000 + "y" + "</span>" * 5000 + " tail", "t tail"),
        ("<article>" + "<section>" * 5000 + "deep" + "</section>" * 5000 + "<p>after", "deep after"),
        ("".join(f"<section class=c{chr(97 + k % 26)}{chr(97 + k // 26)}>s{k}</section>" for k in range(600)), " ".join(f"s{k}" for k in range(600))),
        ("<p>" * 20000 + "x", "x"),
    ):
        tree = html.parsed(page)
        whole = html.merged(html.wrapper(tree), html.wrapper(tree))
        assert html.extracted(tree, html.rule(whole)) == want


def test_toxicity_learns_and_holds(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randint(3, 9)))
    rows, labels = [], []
    for k in range(700):
        words, toxic = [word() for _ in range(rng.randint(5, 200))], k % 4 == 0
        for _ in range(len(words) // 12 + 1 if toxic else 0):
            words[rng.randrange(len(words))] = "zkwx" + word()[:3]
        rows.append((k, " ".join(words), "lang"))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame([*rows, (9000, None, "x"), (9001, "", "x"), (9002, "1234", "x")], "doc_id long, text string, row string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, lab, ~queries.held_out("doc_id"))
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    right_ones = np.mean([(got[k] >= 0.5) == (k % 4 == 0) for k in held])
    assert right_ones > 0.93 and len(got) == 703 and all(0 <= x <= 1 for x in got.values())
    # a text's score is that of its windows, one by one
    scorer = toxicity.Scorer(net)
    for k, text, _ in rows[:40]:
        words = toxicity.words_of(text)
        parts = [" ".join(words[a : a + toxicity.WINDOW]) for a in toxicity.window_starts(len(words)).tolist()]
        best = max(scorer.windows([x])[2][0] for x in parts)
        assert got[k] == pytest.approx(float(toxicity.sigmoid(np.array([best, np.log(len(parts)), 1.0]) @ net.fit)), abs=1e-5)
    assert toxicity.fit(df, lab.where("toxic = 0"), F.lit(True)) is None and toxicity.fit(df.limit(0), lab, F.lit(True)) is None and toxicity.fit(df, lab.limit(0), F.lit(True)) is None
    assert toxicity.score(df, None).where("score <> 0").isEmpty()


def test_a_toxic_passage_of_a_long_text_is_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randint(3, 9)))
    rows = []
    for k in range(400):
        words = [word() for _ in range(rng.choice([60, 200, 1500]))]
        if k % 3 == 0:
            at = rng.randrange(len(words) - 40)
            words[at : at + 40] = ["zkwx" + word()[:3] for _ in range(40)]
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, toxic int")
    net = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), ~queries.held_out("doc_id"))
    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]) > 0.93


def test_gradients_match_differences():
    net = toxicity.Network(["aa", "bb"], np.arange(50))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    gates = np.concatenate([np.zeros((1, 6 * toxicity.STATE)), rng.standard_normal((5, 6 * toxicity.STATE))])
    codes = np.array([[1, 2, 3, 4], [5, 1, 0, 0]])
    kept = {}
    net.logits(gates, codes, kept)
    g, d_gates = net.gradients(kept, np.array([1.0, -0.5]), len(gates))
    total = lambda: float(net.logits(gates, codes) @ np.array([1.0, -0.5]))
    for name, at in (("Uf", (2, 3)), ("Ub", (1, 9)), ("A", (3, 2)), ("v", (1,)), ("w", (4,))):
        before, net.p[name][at] = total(), net.p[name][at] + 1e-3
        assert (total() - before) / 1e-3 == pytest.approx(g[name][at], rel=0.05, abs=2e-4)
        net.p[name][at] -= 1e-3
    before, gates[3, 10] = total(), gates[3, 10] + 1e-3
    assert (total() - before) / 1e-3 == pytest.approx(d_gates[2, 10], rel=0.05, abs=2e-4)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    data, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, data)
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(c.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (bpe.digest(bpe.encode(none, VOCAB), VOCAB), packing.pack(none, VOCAB), substrings.remove_repeats(none), pii.summary(pii.detect(none)), simhash.near_duplicates(none), simhash.keep_one(none), pqdedup.near_duplicates(vectors), html.main_text(pages), toxicity.score(none, None)):
        assert out.isEmpty()


def test_words_of_bytes():
    import pyarrow as pa

    w = Words(pa.array(["a b", None, "", " \t", "日本 x\n"]))
    assert w.count.tolist() == [2, 0, 0, 0, 2] and w.texts(np.array([True, False, True, True])).to_pylist() == ["a", "", "", "", "日本 x"]
