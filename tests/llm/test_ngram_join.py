"""The n-gram join against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import components, ngram_join
from veilframe.llm.parity import Bands, bit_sketch, folded, hamming
from veilframe.llm.shingles import Shingler


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def brute(docs, k=4, percent=85):
    """component_id of each doc by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(seed=3):
    """Groups of copies of all degrees around the threshold, chains, and a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 8, 12, 30, 80, 200]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own += [word()]
            texts.append(" ".join(own))
    for _ in range(25):
        own = [word() for _ in range(20)]
        at = rng.randrange(20)
        texts.append(" ".join(own[:at] + passage + own[at:]))
    chain = [word() for _ in range(100)]
    for i in range(12):
        chain[8 * i] = word()
        texts.append(" ".join(chain))
    texts += ["one two", "One  TWO", "a b c d", "", " \t "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    docs = near_copies(words)
    want, sizes = brute(docs, words, percent)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ngram_join.join_components(df, ngram_join.JoinSettings(words=words, percent=percent, block=3, side=2)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    kept = {r.doc_id for r in ngram_join.keep_first(df, ngram_join.JoinSettings(words=words, percent=percent)).collect()}
    assert kept == set(want.values())


def test_shuffled_instead_of_broadcast(spark):
    docs = near_copies(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.join_components(df, ngram_join.JoinSettings(broadcast_rows=0)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs)[0]


def test_given_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in ngram_join.join_components(docs).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té.", max_size=60), max_size=8), st.integers(1, 5))
def test_shingle_counts(texts, k):
    got = list(Shingler(k).sets(texts))
    assert [len(x) for x in got] == [len(shingles(t, k)) for t in texts]
    for t, x in zip(texts, got, strict=True):
        for u, y in zip(texts, got, strict=True):
            assert (shingles(t, k) == shingles(u, k)) == np.array_equal(x, y)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_keys(percent):
    """Pigeonhole: sets that reach the similarity share as many keys as promised."""
    rng, bands = np.random.default_rng(1), Bands(percent)
    for n in (6, 7, 9, 13, 20, 33, 59, 60, 61, 95, 96, 97, 150, 152, 400, 1200):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop, add = rng.integers(0, n // 5 + 2), rng.integers(0, n // 5 + 2)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert ngram_join.shared(bands, len(a), len(b), np.sort(bands.keys(a)), np.sort(bands.keys(b))) is not None


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    own = {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in own}


def test_a_small_graph_takes_few_jobs(spark, monkeypatch):
    """One task contracts it; rounds of dozens of jobs would fill the driver's memory. Beyond a task's links the rounds agree."""
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(2000 - i, 1999 - i) for i in range(100)] + [(7, 7), (-5, 3000)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("small graph", "components")
    try:
        got = {(r.id, r.label) for r in components.components(df).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("small graph")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 10
    monkeypatch.setattr(components, "EDGES_PER_TASK", 60)
    assert {(r.id, r.label) for r in components.components(df).collect()} == got
    named = df.select(*(F.format_string("%05d", F.col(c) + 10).alias(c) for c in "ab"))
    assert {(int(r.id) - 10, int(r.label) - 10) for r in components.components(named).collect()} == got
    assert components.components(df.where("a = b")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 30), st.integers(-9, 30)), min_size=1, max_size=40))
def test_least_reachable(links):
    want = {x: x for p in links for x in p}
    for _ in links:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    ids, label = components.least_reachable(*(np.array(c, np.int64) for c in zip(*links, strict=True)))
    assert dict(zip(ids.tolist(), label.tolist(), strict=True)) == want


def test_bit_sketches_bound_differences():
    rng = np.random.default_rng(2)
    for n in (3, 17, 64, 200, 900):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for drop, add in ((0, 0), (1, 0), (n // 4, n // 4), (n // 2, 2 * n)):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            rows = folded([bit_sketch(a), bit_sketch(b)])
            assert hamming(rows[0], rows[1:])[0] <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
