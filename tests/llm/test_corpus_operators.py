"""Operators that compare documents, and the pipeline, against plain versions."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagframe.llm import common, graph, hamming, jaccard, suffixes
from tests.llm import brute


def near_copies(seed: int = 3) -> list[tuple[int, str]]:
    """Chains of edits, a group larger than a long list, passages shared by different texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(15):
        words = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = [word() if rng.random() < 0.03 else w for w in words]
    base = [word() for _ in range(120)]
    texts += [" ".join(word() if rng.random() < 0.02 else w for w in base) for _ in range(120)]
    texts += [" ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40)) for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("case", "rows", "shingles", "hot"), [("near", 1024, 1 << 20, 1 << 17), ("near", 7, 900, 40), ("odd", 2, 9, 1)])
def test_jaccard(spark, case, rows, shingles, hot):
    if case == "near":
        data = near_copies()
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    else:
        data = [(d, t) for d, t, *_ in brute.odd_documents()]
        df = brute.documents(spark)
    got = Counter(tuple(r) for r in jaccard.join(df, 5, rows, shingles, hot).select("doc_id", "n_shingles", "component_id").collect())
    assert got == Counter(brute.components(data))
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    firsts = {c for d, n, c in brute.components(data) if d is not None}
    assert {r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()} == firsts


def test_jaccard_of_nothing(spark):
    assert jaccard.join(brute.empty(spark)).count() == 0 and jaccard.representatives(brute.empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_repeated_windows_core():
    rng = random.Random(1)
    for length in (3, 5, 8, 20):
        for trial in range(15):
            base = "".join(rng.choice("ab" if trial % 2 else "abcdef") for _ in range(60))
            text = "".join(rng.choice("abc") for _ in range(rng.randint(length, 200))) + base + "".join(rng.choice("abcd") for _ in range(30)) + base[5:50]
            starts = np.arange(len(text) - length + 1)
            seen = Counter(text[k : k + length] for k in starts)
            got = suffixes.repeated_windows(np.frombuffer(text.encode(), np.uint8), starts, length)
            assert got.tolist() == [seen[text[k : k + length]] > 1 for k in starts]


@pytest.mark.parametrize("tripled", [0, 1 << 21])
def test_settled_suffixes_are_not_sorted_again(monkeypatch, tripled):
    rng = random.Random(7)
    once = rng.randbytes(20_000)
    text = np.frombuffer(once + once[100:700] + b"ab" * 300, np.uint8)
    sorted_ = []
    argsort = np.argsort
    monkeypatch.setattr(suffixes, "TRIPLED", tripled)
    monkeypatch.setattr(suffixes.np, "argsort", lambda a, **more: sorted_.append(len(a)) or argsort(a, **more))
    order = suffixes.suffix_order(text, 400)
    data = text.tobytes()
    prefixes = [data[k : k + 400] for k in order]
    assert prefixes == sorted(prefixes) and sorted(order.tolist()) == list(range(len(data)))
    assert sorted_[0] == len(data) and sum(sorted_[1:]) < len(data)


@pytest.mark.parametrize(("length", "block"), [(400, 1 << 20), (40, 400), (40, 50)])
def test_removed_bytes(spark, length, block):
    data = [(d, t) for d, t, *_ in brute.odd_documents()] + [(100 + k, t) for k, t in near_copies()[:80]]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("first", F.lit(1))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digests(df, length, block).collect())
    plain = brute.removed([t for _, t in data], length)
    assert got == Counter((d, n, g, s, brute.sha(k)) for (d, _), (n, g, s, k) in zip(data, plain, strict=True))
    cut = Counter((r["doc_id"], r["text"] or "") for r in suffixes.remove(df, length, block).collect())
    assert cut == Counter((d, k.decode(errors="ignore")) for (d, _), (*_, k) in zip(data, plain, strict=True))


@pytest.mark.parametrize(("words", "block"), [(51, 1 << 20), (6, 400), (6, 60)])
def test_removed_passages(spark, words, block):
    rng = random.Random(5)
    passage = " ".join(f"ü{k % 7}" for k in range(52))  # over 50 words, under 400 bytes
    around = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))) for _ in range(8)]
    texts = [f"{a}\n{passage}\t{b}" for a, b in zip(around[::2], around[1::2], strict=True)] + [passage.replace(" ", "\n"), passage[3:], passage + " x"]
    data = [(d, t) for d, t, *_ in brute.odd_documents()] + [(100 + k, t) for k, t in near_copies()[:40]] + [(300 + k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("first", F.lit(1))
    got = suffixes.remove_passages(df, words, block)
    assert got.columns == df.columns
    plain = brute.without_passages([t for _, t in data], words)
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter((d, t) for (d, _), t in zip(data, plain, strict=True))
    assert suffixes.remove_passages(brute.empty(spark), words).count() == 0


def test_pipeline_leaves_no_shared_passage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    texts = [r["text"] or "" for r in docs.collect()]
    passages = Counter(p for t in texts for w in [t.split()] for p in {tuple(w[k : k + 51]) for k in range(len(w) - 50)})
    assert texts and max(passages.values()) == 1


def test_removal_from_nothing(spark):
    assert suffixes.digests(brute.empty(spark)).count() == 0 and suffixes.remove(brute.empty(spark)).count() == 0


def test_long_text_is_taken_in_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 300)
    text = bytes(random.Random(2).randbytes(2000))
    anchor, _, first, last = suffixes.contexts(text, 50)
    assert first[0] == 0 and last[-1] == 1950 and (first[1:] == last[:-1] + 1).all() and len(anchor) == len(first)


@pytest.mark.parametrize(("shard", "block"), [(1 << 14, 1 << 10), (40, 3)])
def test_nearest_codes(spark, shard, block):
    rng = random.Random(4)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(150)] + [77] * 60 + [77 ^ (1 << k) for k in range(20)]
    data = [(k, c) for k, c in enumerate(codes)] + [(None, 1), (5000, None), (3, codes[3])]
    df = spark.createDataFrame(data, "id long, code long").withColumn("shard", F.lit(1))
    queries = df.where("id % 50 = 0 OR id = 160")
    got = Counter(tuple(r) for r in hamming.top_k(df, queries, 10, shard, block).select("query_id", "rank", "id", "distance").collect())
    good = [(i, c) for i, c in data if i is not None and c is not None]
    expected: Counter = Counter()
    for q, code in good:
        if q % 50 == 0 or q == 160:
            near = sorted((((code ^ c) & ((1 << 64) - 1)).bit_count(), i) for i, c in good)[:10]
            expected.update((q, r + 1, i, d) for r, (d, i) in enumerate(near))
    assert got == expected
    assert hamming.top_k(df.limit(0), queries).count() == 0 and hamming.top_k(df, queries.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "doc_id" in docs.columns else {}
        docs = common.stage(stage(spark, docs, sf_dir), name)
        if name == "harmonic_packing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert 0 < len(after) <= n and set(after) <= set(before)
        if name == "jaccard_join":
            assert set(after) == {c for *_, c in brute.components(list(before.items()))}
        if name == "suffix_dedup":
            plain = brute.removed(list(before.values()), 400)
            assert list(after[d] or "" for d in before) == [k.decode(errors="ignore") for *_, k in plain]
        if name == "pii_sanitisation":
            assert not any(brute.base_spans(t) for t in after.values())


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_stages_on_odd_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame(brute.odd_documents() if rows == "odd" else [], brute.SCHEMA).withColumn("key", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, docs.count()
        docs = common.stage(stage(spark, docs, sf_dir), name)
        if name != "harmonic_packing":
            assert docs.columns == columns and docs.count() <= before
            assert docs.where("key <> 'x'").count() == 0
    assert (docs.count() > 0) == (rows == "odd")


def test_staged_tables_are_dropped(spark, sf_dir):
    import os

    common.drop_staged(spark)
    corpus_pipeline.run(spark, sf_dir).count()
    assert 0 < len(common.STAGED) <= 6
    paths = list(common.STAGED)
    common.drop_staged(spark)
    assert not common.STAGED and not any(os.path.exists(p) for p in paths)


@pytest.mark.parametrize("stage", [corpus_pipeline.jaccard_join, corpus_pipeline.suffix_dedup])
def test_a_stage_leaves_only_what_its_result_reads(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.drop_staged(spark)
    out = stage(spark, docs, sf_dir)
    assert len(common.STAGED) == 1 and all(common.STAGED[0] in f for f in out.inputFiles()) and out.count() > 0
    common.drop_staged(spark)


def test_staging_leaves_no_shuffle_files(spark):
    def files() -> set[str]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}

    before = files()
    df = common.stage(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    end = time.time() + 10
    while files() - before and time.time() < end:  # they go in the background
        time.sleep(0.1)
    assert not files() - before and df.count() == 7
    common.drop_staged(spark)


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    jaccard.join(brute.documents(spark)).count()
    assert spark.conf.get(key) == before
