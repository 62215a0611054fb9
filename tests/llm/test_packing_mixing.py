"""Packing and mixing against plain versions of themselves."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import mixing, packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    runs = packing.plan(dict(Counter(lengths)), 50)
    bins = defaultdict(list)
    ranks = defaultdict(set)
    for r in runs:
        for k in range(r.count):
            bins[r.bin + k // r.each].append((r.offset + k % r.each * r.length, r.length))
            ranks[r.length].add(r.rank + k)
    assert {n: len(x) for n, x in ranks.items()} == dict(Counter(lengths))
    assert all(x == set(range(len(x))) for x in ranks.values())
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 50
    assert len(bins) == packing.reference_bins(lengths, 50)
    assert set(bins) == set(range(len(bins)))


def test_plan_does_not_grow_with_counts():
    few = packing.plan({n: 1000 + n for n in range(1, 2049)})
    many = packing.plan({n: 10**9 * (1000 + n) for n in range(1, 2049)})
    assert len(many) < 3 * len(few) and sum(r.count for r in many) == sum(10**9 * (1000 + n) for n in range(1, 2049))


def test_tree():
    rng = random.Random(1)
    tree, there = packing.CapacityTree(100), set()
    for _ in range(2000):
        x = rng.randint(1, 100)
        on = rng.random() < 0.4
        tree.put(x, on)
        there = there | {x} if on else there - {x}
        y = rng.randint(1, 100)
        assert tree.tightest(y) == min((z for z in there if z >= y), default=None)


def test_pieces_round_trip(spark, small_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(ids)
    for doc, pieces in seen.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(ids[doc])
        assert all(n == 2048 for _, _, n in pieces[1:]) and (len(ids[doc]) > 2048 or len(pieces) == 1)
    for items in sequences.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) == packing.reference_bins([r.length for r in rows])


def test_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n", "<|endoftext", "<|<|endoftext|>|>"]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "  \n", "ab", "'s", "é", "1", "<|", "|>", "."]) for _ in range(30)) for _ in range(200)]
    rows = packing.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in rows}
    for i, text in enumerate(texts):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert packing.tokenizer().encode(texts[0], allowed_special="all") == [64, 220, 50256, 275]


def slow_targets(sizes, mix):
    """Reshares the excess until no source is above its cap."""
    from fractions import Fraction

    weights = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    total, capped = Fraction(sum(sizes)), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(capped.values())
        level = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if level[i] > mix.most_times * sizes[i]]
        if not over:
            return [float(capped.get(i, level.get(i, 0))) for i in range(len(sizes))]
        capped |= {i: Fraction(mix.most_times * sizes[i]) for i in over}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    mix = mixing.Mix()
    got = mixing.targets(sizes, mix)
    assert got == pytest.approx(slow_targets(sizes, mix), abs=1e-6)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True))


def test_split_is_exact():
    out = mixing.split_quotas([10, 0, 333, 7], 8, 1)
    assert out.sum(0).tolist() == [10, 0, 333, 7] and np.ptp(out.sum(1)) <= 1 and (out >= 0).all()
    assert (out == mixing.split_quotas([10, 0, 333, 7], 8, 1)).all()


def test_mix_of_given_documents(spark, mid_dir):
    docs = spark.read.parquet(f"{mid_dir}/documents.parquet")
    mix = mixing.Mix(block_docs=16)
    rows = mixing.assign(docs, mix).collect()
    again = {r.doc_id: (r.taken, r.shards) for r in mixing.assign(docs.repartition(7), mix).collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len(r.shards) == r.copies
        taken[r.source] += r.taken
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert {r.doc_id: (r.taken, r.shards) for r in rows} == again
    for s in taken:  # a block so small may lack the document that would fit; a block of the usual size doesn't
        assert abs(taken[s] - target[s]) <= largest[s]
    usual = defaultdict(int)
    for r in mixing.assign(docs).collect():
        usual[r.source] += r.taken
    assert all(abs(usual[s] - target[s]) <= 0.01 * target[s] for s in usual)
    per_shard = Counter(x for r in rows for x in r.shards)
    assert len(per_shard) == 8 and max(per_shard.values()) < 2 * min(per_shard.values())
    mixed = mixing.mix_rows(docs, mix)
    assert mixed.count() == sum(r.copies for r in rows)
    parts = mixing.shuffle_shards(mixed).groupBy("mix_shard").count().collect()
    assert {r.mix_shard: r["count"] for r in parts} == dict(per_shard)


def test_pipeline_writes_shards_in_order(spark, mid_dir):
    import corpus_pipeline
    from veilframe.llm.queries import queries

    docs = spark.read.parquet(f"{mid_dir}/documents.parquet")
    given = queries()["op5_source_mix"](spark, mid_dir).collect()
    want = sorted((s, o, r.doc_id) for r in given for s, o in zip(r.shards, r.orders, strict=True))
    assert all(len(r.orders) == r.copies for r in given) and len({s for s, _, _ in want}) > 1
    assert [r.doc_id for r in corpus_pipeline.mix(spark, docs, mid_dir).collect()] == [i for _, _, i in want]


def test_repeated_rows_share_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e", "s"), (3, "f", None), (4, " ".join("x" * 40), "t")], "doc_id long, text string, source string")
    rows = mixing.assign(docs).collect()
    assert mixing.mix_rows(docs).count() == sum(r.copies for r in rows)


def test_nothing_is_taken_past_the_tree(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: 0 * split(quotas, shards, seed))
    assert {(r.taken, r.copies, tuple(r.shards)) for r in mixing.assign(docs).collect()} == {(0, 0, ())}


def test_many_repeated_rows(spark):
    """A third of all rows repeat one: they are spread over blocks, each at most three times, and reruns agree."""
    rows = [(1, "a b c", "s")] * 2000 + [(i, f"w{i} x " * (i % 9), f"t{i % 3}") for i in range(10, 4010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = mixing.Mix(block_docs=100, run=4)
    got = mixing.assign(docs, mix).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) <= 3 and sum(r.same == 2000 for r in got) == 2000
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in taken)
    again = Counter((r.doc_id, r.copies, tuple(r.shards), tuple(r.orders)) for r in mixing.assign(docs.repartition(3), mix).collect())
    assert again == Counter((r.doc_id, r.copies, tuple(r.shards), tuple(r.orders)) for r in got)
    mixed = mixing.mix_rows(docs, mix)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == i))})
