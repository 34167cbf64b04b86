"""The pipeline's stages against brute force on a small corpus."""

import random
from collections import Counter

import corpus_pipeline as p
from pyspark.sql import functions as F
from test_operators import plain_dedup, plain_verdicts, shingles, words

from sweepline.llm import bpe, queries


def build(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(120):
        texts.append(". ".join(" ".join(words(rng, "en", rng.randrange(8, 14))).capitalize() for _ in range(9)) + ".")
    texts += [texts[0], texts[1] + " tail", "too short", None, "", texts[2][: len(texts[2]) // 2] + " " + texts[60]]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), texts


def test_stages(spark):
    docs, texts = build(spark)
    assert [len(p.STAGES) in (4, 5), p.ORACLE_SQL] == [True, None]
    good = p.quality_rules(spark, docs, "").checkpoint()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    want = plain_verdicts([(i, t, "en") for i, t in enumerate(texts)])
    assert kept ^ {i for i, v in want.items() if v[3]} <= {i for i, v in want.items() if v[4]} and len(kept) > 100

    single = p.near_copies(spark, good, "").checkpoint()
    left = set()
    for i in sorted(kept):
        a = shingles(texts[i])
        if not any((n := len(a & shingles(texts[j]))) >= 0.8 * (len(a) + len(shingles(texts[j])) - n) for j in left):
            left.add(i)
    assert {r.doc_id for r in single.collect()} == left and single.columns == docs.columns

    clean = p.repeated_passages(spark, single, "").checkpoint()
    want = plain_dedup([(i, texts[i]) for i in left])
    assert {r.doc_id: r.text for r in clean.collect()} == want and clean.where("n_chars <> length(text)").count() == 0

    mixed = p.mix_sources(spark, clean, "").checkpoint()
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= left and max(times.values()) <= 3

    tok = bpe.load(queries.tokenizer_path())
    for r in p.encode(spark, mixed, "").collect():
        assert r.ids == tok.encode(want[r.doc_id]) and r.n_tokens == len(r.ids)


def test_repeated_rows_stay_single(spark):
    docs, _ = build(spark)
    twice = docs.union(docs.where("doc_id = 5"))
    got = p.near_copies(spark, twice, "").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert got.where("doc_id = 5").first().n == 1


def test_odd_rows(spark):
    """Null ids, sources and languages, repeated rows, a very long text, and columns with clashing names."""
    docs, texts = build(spark)
    odd = [(None, texts[7] + " one more", "en", None, 1), (None, None, None, None, 0), (9, texts[9], "en", "s1", 1), (9, texts[8] + " two", "en", "s1", 1), (900, " ".join(texts[10:60]), None, "s2", 1)]
    df = docs.union(spark.createDataFrame(odd, docs.schema))
    for c in ("id", "hash", "rank", "size", "key", "n", "block", "text_hash", "row_key"):
        df = df.withColumn(c, F.lit("clash"))
    for name, stage in p.STAGES:
        df = stage(spark, df, "").checkpoint()
        assert df.count() > 0, name
        if name == "n-gram Jaccard join":
            n = Counter(r.doc_id for r in df.collect())
            assert n[9] == 2 and n[None] <= 1 and n[0] == 1
        if name != p.STAGES[-1][0]:
            assert df.columns == list(p.COLUMNS)
            for c in ("id", "hash", "rank", "size", "key", "n"):
                df = df.withColumn(c, F.lit("clash"))


def test_empty(spark):
    docs, _ = build(spark)
    df = docs.limit(0)
    for _, stage in p.STAGES:
        df = stage(spark, df, "")
        assert df.count() == 0
