"""The whole pipeline against a plain version of each of its stages, on documents whose case is clear."""

import random
import re
import struct
import zlib

import corpus_pipeline
import __spark_entry__
from parcelwise.llm.queries import vocab_path

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def made():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randint(3, 9)))
    rows, toxic = [], {}
    for k in range(400):
        words = [word() for _ in range(rng.randint(150, 300))]
        toxic[k] = int(k % 5 == 0)
        for _ in range(25 * toxic[k]):
            words[rng.randrange(len(words))] = "zkwx" + word()[:3]
        text = " ".join(words) + (f"\nmail q{k}@host{k}.example.com now" if k % 7 == 0 else "")
        rows.append((k, "All rights reserved\n" + text if k % 3 == 0 else text, "en", "a", len(text)))
    for k in range(400, 430):  # exact and near copies of clean documents
        source = rows[k - 399][1] if k % 2 else " ".join("other" if i == 70 else w for i, w in enumerate(rows[k - 399][1].split(" ")))
        rows.append((k, source, "en", "b", len(source)))
        toxic[k] = toxic[k - 399]
    return rows, toxic


def test_stages_and_result(spark, tmp_path):
    rows, toxic = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in toxic.items()], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    want = {k: t for k, t, *_ in rows if not toxic[k]}
    lines = {k: t.split("\n") for k, t in want.items()}
    frames = {s for s in ("All rights reserved",) if sum(s in x for x in lines.values()) > 0.1 * len(lines)}
    want = {k: "\n".join(x for x in lines[k] if x not in frames or k >= 400) for k in want}
    shingles = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in want.items() if (w := t.split())}
    for k in sorted(want):
        if any(j < k and len(shingles[j] & shingles[k]) >= 0.8 * len(shingles[j] | shingles[k]) for j in want):
            del want[k]
    want = {k: EMAIL.sub("[EMAIL]", t) for k, t in want.items()}

    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns, name
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept == want
    assert all(r.n_chars == len(r.text) for r in got.collect())

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocab_path())
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in want.items()}
    pieces = __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()
    total = dict.fromkeys(ids, 0)
    for r in pieces:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32
        total[r.doc_id] += r.length
    assert total == {k: len(x) for k, x in ids.items()}
