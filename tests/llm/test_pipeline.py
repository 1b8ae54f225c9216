"""The pipeline's stages one after the other, each against what its own input says."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import decontam, quality, simhash


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after

    before, after = seen["quality rules"]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).where("kept").collect()}
    assert {r["doc_id"] for r in after} == kept

    before, after = seen["SimHash near-dedup"]
    assert {r["text"] for r in after} <= {r["text"] for r in before} and len({r["text"] for r in after}) == len(after)
    lost = {r["doc_id"]: r["text"] for r in before} | {}
    for r in after:
        lost.pop(r["doc_id"])
    words = lambda t: set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False))
    others = [(r["doc_id"], words(r["text"])) for r in before]
    for d, t in lost.items():  # each document that went resembles another
        w = words(t)
        assert any(o != d and len(w & x) >= 0.7 * len(w | x) for o, x in others)

    before, after = seen["benchmark decontamination"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontam.scan(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), bench).where("n_hit > 0").collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - hit

    before, after = seen["mixing sources to target weights"]
    n = Counter(r["doc_id"] for r in after)
    assert set(n) == {r["doc_id"] for r in before} and set(n.values()) <= {1, 2}

    before, after = seen["sharding"]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
    sizes = Counter(r["shard"] for r in after)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_near_copies_are_found_and_others_left(spark):
    import random

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
    rows = []
    for k in range(40):
        text = [word() for _ in range(300)]
        rows.append((2 * k, " ".join(text)))
        copy = list(text)
        for _ in range(3 if k % 2 else 60):  # a similarity of some 0.9, and of some 0.3
            copy[rnd.randrange(len(copy))] = word()
        rows.append((2 * k + 1, " ".join(copy)))
    left = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert {2 * k for k in range(40)} <= left
    assert {2 * k + 1 for k in range(0, 40, 2)} <= left
    assert len({2 * k + 1 for k in range(1, 40, 2)} & left) <= 1


def test_union_of_all_columns_survives(spark):
    df = spark.createDataFrame([(1, "word " * 30, "x", 3)], "doc_id long, text string, kept string, _k int")
    assert simhash.deduplicated(df).columns == df.columns
    assert quality.accepted(df).columns == df.columns
    assert df.agg(F.count("*")).first()[0] == 1


def test_near_copies_at_the_similarity_as_brute_force(spark):
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    texts = []
    for k in range(120):
        text = [word() for _ in range(200)]
        copy = list(text)
        if k % 3 == 0:
            copy += [word() for _ in range(48 if k % 2 else 51)]  # appended: a similarity of 0.803, and of 0.794
        elif k % 3 == 1:
            for at in range(20, 180, 40):  # four words, far apart: 176 of 216
                copy[at] = word()
        else:
            for at in range(20, 200, 30):  # six: 166 of 226
                copy[at] = word()
        texts += [text, copy]
    want = set(range(240))
    for k in range(120):
        a, b = shingles(texts[2 * k]), shingles(texts[2 * k + 1])
        if len(a & b) >= 0.8 * len(a | b):
            want.discard(2 * k + 1)
    assert len(want) == 240 - 60
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.deduplicated(df).select("doc_id").collect()}
    assert want <= left and len(left - want) <= 2  # a candidate is found with a probability of 0.997


def test_components_of_hubs_and_chains(spark):
    edges = [(7, k) for k in range(100, 4100)] + [(k, k + 1) for k in range(5000, 5300)] + [(4099, 6000), (6000, 6001), (9, 9)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    want = {k: 7 for k in [*range(100, 4100), 6000, 6001]} | {k: 5000 for k in range(5001, 5301)}
    assert got == want


def test_sieve_loses_no_key(spark):
    from sieveline.llm.common import sifted

    df = spark.range(20_000).withColumnRenamed("id", "k").unionByName(spark.sql("select cast(null as long) k"))
    keys = spark.range(0, 20_000, 7).withColumnRenamed("id", "i")
    some, rest = (([r["k"] for r in x.collect()]) for x in sifted(df, F.xxhash64("k"), keys, F.xxhash64("i")))
    assert sorted(some + rest, key=str) == sorted([*range(20_000), None], key=str)
    assert set(range(0, 20_000, 7)) <= set(some) and len(some) < 3000
    none, all_ = sifted(df, F.xxhash64("k"), keys.limit(0), F.xxhash64("i"))
    assert none.count() == 0 and all_.count() == 20_001
