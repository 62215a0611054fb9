"""Trained operators by their held-out accuracy, and what they must not look at."""

import numpy as np

from veilframe.llm import compression_classifier, language_id
from veilframe.llm.queries import queries


def test_language_held_out(spark, mid_dir):
    docs = spark.read.parquet(f"{mid_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries()["op2_language_id"](spark, mid_dir).collect()
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_uses_text_only(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    model = language_id.train(language_id.training_sample(docs, language_id.Settings()), language_id.Settings(steps=60))
    a = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    b = {r.doc_id - 10**6: r.lang_pred for r in language_id.identify(docs.selectExpr("doc_id + 1000000 as doc_id", "text"), model).collect()}
    assert a == b


def test_whole_texts_count(spark):
    sample = [("the of and to in is that it was for " * 20, "en"), ("der die und das ist nicht ein zu von mit " * 20, "de")] * 20
    model = language_id.train(sample, language_id.Settings(steps=120))
    text = "the of and to in is " * 10 + "der die und das ist nicht " * 300
    assert language_id.Predictor(model).predict([text, None, "123", "the and that it was"])[0] == ["de", "und", "und", "en"]


def test_windows_cover_everything():
    x, held = language_id.windows(b"ab" * 100, 64)
    assert x.shape == (4, 64) and held.sum() == 200 and x.tobytes().rstrip(b" ") == b"ab" * 100


def test_quality_held_out(spark, mid_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{mid_dir}/labels.parquet").collect()}
    rows = queries()["op10_compression_quality"](spark, mid_dir).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    assert np.mean(good) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_ignores_held_out_labels(spark, mid_dir):
    docs, labels = (spark.read.parquet(f"{mid_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    s = compression_classifier.Settings()
    assert compression_classifier.labelled_sample(docs, labels, s) == compression_classifier.labelled_sample(docs, flipped, s)


def test_samples_are_bounded(spark):
    """Repeated rows of an id, many languages, long texts: the driver gets what the settings say, from all of every text."""
    rows = [(i % 8 + 100, "ein wort und noch eines " * 50 + str(i), "de") for i in range(400)] + [(i, "one word " * 2000, f"l{i % 40}") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    s = language_id.Settings(sample_rows=205, passage_chars=100)
    got = language_id.training_sample(docs, s)
    by = {y: [t for t, x in got if x == y] for _, y in got}
    assert len(by) == 41 and all(len(x) <= 5 for x in by.values()) and got == language_id.training_sample(docs.repartition(3), s)
    assert any(t not in rows[-1][1][:1000] or len(t) < 100 for x in by.values() for t in x)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 1200)], "doc_id long, quality int")
    c = compression_classifier.Settings(sample_per_class=60, passages_per_class=25, passage_chars=100)
    sample = compression_classifier.labelled_sample(docs, labels, c)
    assert {q: sum(x == q for _, x in sample) for q in (0, 1)} == {0: 25, 1: 25}


def test_difference_alone_tells_quality(spark):
    """Scored against a plain version: sizes window by window, one weight for the difference, one for one."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, 97 + rng.integers(0, 6, n)))
    rows = [(i, " ".join(word(4) for _ in range(200)) if i % 2 else " | ".join(word(4).upper() for _ in range(200))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    model = compression_classifier.fit(docs, labels)
    import zstandard

    def size(text, d):
        c = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        data = text.encode()
        return sum(len(c.compress(data[k : k + 64])) for k in range(0, len(data), 64))

    for r in compression_classifier.classify(docs, labels).where("doc_id < 20").collect():
        good, bad = size(rows[r.doc_id][1], model.good), size(rows[r.doc_id][1], model.bad)
        at = model.weights[0] * 10 * (bad - good + 100 * model.usual) / (bad + good + 100) + model.weights[1]
        assert abs(r.score - 1 / (1 + np.exp(-at))) < 1e-9 and r.predicted == r.doc_id % 2


def test_language_network_by_plain_sums():
    """The tables of byte pairs give what embedding, filters, pooling and softmax give written out."""
    sample = [("the of and to in is that it was for " * 20, "en"), ("der die und das ist nicht ein zu von mit " * 20, "de"), ("le la les et que dans pour une est pas " * 20, "fr")] * 10
    s = language_id.Settings(steps=30, window=32)
    model = language_id.train(sample, s)
    for text in ("the and of", "die katze und der hund " * 5, "é" * 40, "x"):
        data, total, weight = text.encode().lower(), np.zeros(3), 0
        for at in range(0, len(data), 32):
            part = data[at : at + 32]
            window, pooled = part.ljust(32), []
            for k in s.widths:
                for f in range(s.filters):
                    sums = [sum(float(model.tables[k][j][window[i + j], f]) for j in range(k)) for i in range(32 - k + 1)]
                    pooled.append(max(0.0, max(sums) + float(model.bias[k][f])))
            total += len(part) * (np.array(pooled) @ model.weights + model.offset)
            weight += len(part)
        q = np.exp(total / weight - (total / weight).max())
        q /= q.sum()
        (name,), (score,) = language_id.Predictor(model).predict([text])
        assert name == model.languages[int(q.argmax())] and abs(score - q.max()) < 1e-4
