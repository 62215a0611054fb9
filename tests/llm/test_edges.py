"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from veilframe.llm import compression_classifier, edit_fingerprint, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, url_filter, wrappers
from veilframe.llm.queries import URL_RULES

LONG = " ".join(f"word{i % 977}" for i in range(120_000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en", "a", 3, "x", 1, "k", 9),
    (1, "the cat sat on the mat and the dog ran", "en", "a", 3, "x", 1, "k", 9),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "x", 1, "k", 9),
    (4, "  \n\t ", "fr", "b", 4, "x", 1, "k", 9),
    (5, LONG, "en", "a", len(LONG), "x", 1, "k", 9),
    (6, LONG, "en", "c", len(LONG), "x", 1, "k", 9),
    (None, "le chat est sur la table et le chien court", "fr", "b", 5, "x", 1, "k", 9),
    (7, "1234 5678", "fr", "b", 5, "x", 1, "k", 9),
    (8, "emoji \U0001f600 \U0001f600 and é", "fr", "a", 5, "x", 1, "k", 9),
    (8, "same id, another text", "fr", "a", 5, "x", 1, "k", 9),
]
# Columns named like those that the operators make inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tk string, rid long, key string, size long"
PAGES = [(1, "http://a.example.com/x", "<p>one", 1), (1, "http://a.example.com/x", "<p>one", 1), (2, None, None, 1), (3, "no scheme", "", 1), (None, "https://B.org", "<div>" * 3000 + "deep", 1), (4, "x://h?q", "<p>a" + "<p>b c" * 5000, 1)]
LABELS = [(1, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 1), (1, 1, 0), (99, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, host int")


OPERATORS = {
    "op1": lambda d, p, x: ngram_join.join_components(d),
    "op2": lambda d, p, x: language_id.detect(d, language_id.Settings(steps=20)),
    "op3": lambda d, p, x: wrappers.extract_pages(p),
    "op4": lambda d, p, x: line_dedup.dedup_lines(d),
    "op5": lambda d, p, x: mixing.assign(d),
    "op6": lambda d, p, x: edit_fingerprint.fingerprint(d),
    "op7": lambda d, p, x: url_filter.judge(p, URL_RULES),
    "op8": lambda d, p, x: quality_rules.judge(d),
    "op9": lambda d, p, x: packing.pack(d),
    "op10": lambda d, p, x: compression_classifier.classify(d, x),
}
FILTERS = {
    "keep_first": lambda d, x: ngram_join.keep_first(d),
    "keep_good": lambda d, x: compression_classifier.keep_good(d, x),
    "mix_rows": lambda d, x: mixing.mix_rows(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, docs, pages, labels):
    rows = OPERATORS[name](docs, pages, labels).collect()
    if name != "op9":
        assert len(rows) == (len(PAGES) if name in ("op3", "op7") else len(ROWS))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, pages, labels):
    assert OPERATORS[name](docs.limit(0), pages.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters(name, docs, labels):
    got = FILTERS[name](docs, labels)
    assert got.columns[: len(docs.columns)] == docs.columns
    got.collect()
    assert FILTERS[name](docs.limit(0), labels.limit(0)).collect() == []


#: Names that operators use inside, or return.
CLASHES = "_row_key _drop _hashes _drop_key lines_removed _id _tk _k _shards _rows _key _copy _source mix_shard mix_order row_key drop hashes same at key tk rid bucket mark _at h a b label draw block".split()


@pytest.mark.parametrize("name", [*OPERATORS, *FILTERS])
def test_clashing_columns(name, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    rows = [(i, f"text number {i} of some words that are all its own {i * 7}", "en", f"s{i % 3}", 5) for i in range(12)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"<p>page {i}") for i in range(5)], "page_id long, url string, html string")
    wide = lambda df: df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    run = (lambda d, p: FILTERS[name](d, labels)) if name in FILTERS else lambda d, p: OPERATORS[name](d, p, labels)
    plain, got = run(docs, pages), run(wide(docs), wide(pages))
    got_rows = sorted(map(str, got.select(*plain.columns).collect()))
    assert got_rows == sorted(map(str, plain.collect())) and got_rows
    if name in FILTERS or name == "op4":
        made = {"lines_removed"} if name == "op4" else {"mix_shard", "mix_order"} if name == "mix_rows" else set()
        assert all(set(got.columns) >= {c} for c in CLASHES) and len(got.columns) == len(set(got.columns))
        assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASHES if c not in made)


def test_results_of_awkward_rows(docs, labels):
    by = {}
    for r in ngram_join.join_components(docs).collect():
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(7, 1), (7, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(0, 4)]
    assert {c for _, c in by[5] + by[6]} == {5} and by[None][0][1] is None
    assert sorted(c for _, c in by[8]) == [8, 8]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_first(docs).collect()]
    assert kept.count((1, ROWS[0][1])) == 1 and (6, LONG) not in kept and (5, LONG) in kept and {i for i, _ in kept} >= {2, 3, 4, None, 7, 8}
    assert {r.doc_id: r.lang_pred for r in language_id.detect(docs, language_id.Settings(steps=5)).collect() if r.doc_id in (2, 3, 4, 7)} == {2: "und", 3: "und", 4: "und", 7: "und"}
    quality = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert quality[2].n_words == 0 and quality[2].base_failed and not quality[2].kept and quality[5].n_words == 120_000
    assert quality[5].n_repeat_words == 120_000 and quality[5].base_failed


def test_one_label_class(docs, spark):
    only = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in compression_classifier.classify(docs, only).collect()} == {1}
