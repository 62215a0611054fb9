"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from veilframe.llm import compression_classifier, packing


def test_stages(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{small_dir}/labels.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], small_dir).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert out[-1].columns == columns
    rows = [{r.doc_id: r for r in x.collect()} for x in out[:4]]
    # 1: what the classifier scores below its threshold is gone, nothing else
    scores = {r.doc_id: r.predicted for r in compression_classifier.classify(docs, labels).collect()}
    assert set(rows[1]) == {i for i, p in scores.items() if p == 1}
    # 2: a line of several texts that three sites carry is left in its first text only
    texts, sites = {}, defaultdict(set)
    for i in sorted(rows[1]):
        texts.setdefault(rows[1][i].text, rows[1][i])
        sites[rows[1][i].text].add(rows[1][i].source)
    tidy = lambda x: " ".join(x.split()).lower()
    holders = defaultdict(dict)
    for text, r in texts.items():
        for line in text.split("\n"):
            if line.strip():
                holders[tidy(line)].setdefault(text, r)
    owner = {}
    for line, who in holders.items():
        if len(who) > 1 and len(set().union(*(sites[t] for t in who))) >= (3 if len(line.split()) >= 5 else 10):
            owner[line] = min(who.values(), key=lambda r: r.doc_id).text
    for i, r in rows[1].items():
        want = "\n".join(x for x in r.text.split("\n") if owner.get(tidy(x), r.text) == r.text)
        assert rows[2][i].text == want if want.strip() else i not in rows[2]
        assert not want.strip() or rows[2][i].n_chars == (len(want) if want != r.text else r.n_chars)
    # 3: the first document of every component of five-word shingles at 0.8
    component, _ = brute([(i, r.text) for i, r in rows[2].items()], 5, 80)
    assert set(rows[3]) == set(component.values())
    # 4: copies come near the targets
    copies = Counter(r.doc_id for r in out[4].select("doc_id").collect())
    assert set(copies) <= set(rows[3]) and max(copies.values()) <= 3
    size = lambda t: len((t or "").encode().split())
    taken = sum(n * size(rows[3][i].text) for i, n in copies.items())
    total = sum(size(r.text) for r in rows[3].values())
    assert abs(taken - total) < 0.05 * total
    # 5: every copy is packed, as tightly as best fit packs it
    pieces = out[5].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    assert len({r.sequence_id for r in pieces}) == packing.reference_bins([r.length for r in pieces])


def test_run(spark, small_dir):
    rows = corpus_pipeline.run(spark, small_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_awkward_tables(spark, tmp_path):
    """Every stage on nulls, empty, long and repeated texts, clashing columns, and on empty tables; what the docstrings say holds."""
    from pyspark.sql import functions as F

    from tests.llm.test_edges import CLASHES, LONG

    own = [(i, " ".join(f"w{i}x{k * k % 83}" for k in range(60)), "en", f"s{i % 3}", 5) for i in range(20, 32)]
    rows = [*own, own[0], (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "b", 7), (4, LONG, "en", None, 7), (None, "only here " * 9, "en", "a", 7)]
    spread = "this line stands on three sites of three texts"
    rows += [(40 + i, f"{own[i][1].replace('w', 'other')}\n{spread}", "en", f"s{i}", 7) for i in range(3)] + [(50, spread.upper(), "en", "s7", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    for name, part in (("some", docs), ("none", docs.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    out = [spark.read.parquet(f"{tmp_path}/some/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(stage(spark, out[-1], f"{tmp_path}/some"))
        if k < 4:
            assert out[-1].columns == docs.columns
            assert all(r[c] == f"own {c}" for r in out[-1].collect() for c in CLASHES)
    ids = [Counter(r.doc_id for r in x.collect()) for x in out[:4]]
    assert ids[1] == ids[0]  # only good labels: nothing is rejected
    assert ids[2] == ids[1] - Counter([50])  # its only line goes; null and empty texts stay
    assert ids[3] == ids[2] - Counter([4, 20])  # the copy and the repeated row go; a null id and texts without words stay
    copies = Counter(r.doc_id for r in out[4].collect())
    assert set(copies) <= set(ids[3]) and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in out[5].collect() if r.piece == 0) == copies
