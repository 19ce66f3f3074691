import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, neardup
from tests.llm import test_lines, test_neardup, test_quality


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for i in range(70):
        lines = [" ".join(rng.choices(words, k=rng.randint(6, 30))) for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(0, "the very same head of many pages")
        rows.append((i, "\n".join(lines), "en", rng.choice("ab")))
    rows += [(100 + i, rows[i][1], "en", "a") for i in range(5)]
    rows += [(200 + i, rows[20 + i][1] + " more", "en", "b") for i in range(5)]
    return rows + [(300, "short", "en", "a"), (301, None, "en", None)]


def test_every_stage_against_plain_python(spark, make_docs, tmp_path):
    docs = make_docs(corpus())
    seen = []
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{place}")
        out = spark.read.parquet(f"{tmp_path}/{place}")
        seen.append((name, docs, out))
        docs = out
    assert all(out.columns == before.columns for _, before, out in seen[:-1])
    texts = [({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in out.collect()}) for _, before, out in seen]

    before, after = texts[0]
    rows = [(r.doc_id, r.text, r.source) for r in seen[0][1].collect()]
    assert set(after) == {r[0] for r, v in zip(rows, test_quality.brute(rows)) if v[-1]}

    before, after = texts[1]
    gone = test_lines.brute(list(before.items()))
    for (doc, text), removed in gone.items():
        assert after[doc].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in removed)

    before, after = texts[2]
    rows = list(before.items())
    labels = test_neardup.groups(rows, [neardup.fingerprint(t) & (2**64 - 1) for _, t in rows])
    assert sorted(after) == sorted(set(labels)) and len(after) < len(before)

    before, after = texts[3]
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(seen[3][1]).collect()}
    assert {i: len(r.text.split()) for i, r in after.items()} == {i: n for i, n in taken.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = texts[4]
    for i, text in before.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert after[i].n_tokens == len(ids) and after[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert after[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_over_written_tables(spark, make_docs, tmp_path):
    make_docs(corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 40 and got.filter(F.col("n_tokens") > 0).count() > 40
    make_docs(corpus()).filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
