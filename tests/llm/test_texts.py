"""Extraction, lines, fingerprints, rules and the queries that SQL can express."""

import hashlib

import numpy as np
import pytest

from tests.compare import compare
from veilframe.llm import edit_fingerprint, line_dedup, url_filter, wrappers
from veilframe.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, mid_dir, name):
    assert compare(spark, name, queries()[name], oracle_sql()[name], mid_dir) is None


def test_names_and_columns(spark, small_dir):
    found = queries()
    assert [n.split("_")[0] for n in found if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li>Menu {n}</li><li>B</li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content"><h1>Title&nbsp;{n}</h1><p>First   {n} &amp; more<br>line</p><div class="ad-box">Buy {n}</div><p>Second <b>bold</b> {n}<p>Third {n}
<form><input><button>Go</button>Mail me</form><aside>Related {n}</aside></div><div id="comments"><p>Nice! {n}</p></div><div class="x1">All rights reserved</div><footer>&copy; {n}</footer></body></html>"""


def test_wrapper_of_a_host(spark):
    pages = [(i, f"http://h.example.com/{i}", PAGE.format(n=i)) for i in range(8)] + [(99, "http://other.example.com/", "<article><h1>A</h1><p>b &lt; c &#233;</p><section class='comments'><p>no</p></section></article><p>out")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in wrappers.extract_pages(df).collect()}
    assert got[3].text == "Title 3\n\nFirst 3 & more line\n\nSecond bold 3\n\nThird 3" and got[3].n_chars == len(got[3].text)
    assert got[99].text == "A\n\nb < c é"


def test_union_free_wrapper():
    a = "<body><ul><li>1</li><li>2</li></ul><p>fixed</p><div>x</div></body>"
    b = "<body><ul><li>3</li></ul><h2>only here</h2><p>fixed</p><div>y</div></body>"
    assert wrappers.expression(wrappers.infer([a, b])) == "<body><ul>(<li>#TEXT</li>)+</ul>(<h2>only\\ here</h2>)?<p>fixed</p><div>#TEXT</div></body>"


def test_slots_choose_the_text(spark):
    """Template lines inside an article go, also among paragraphs of their shape; teaser articles don't hide the real text."""
    story = "<body><article><h1>Title {n}</h1><p>Own text {n} of the page</p><p>Tell your friends about us</p><div class=x>Printed at home</div></article></body>"
    cards = "<body><div class=story><p>The long text number {n} of this page, which is told at length</p><p>More of number {n} here</p></div><article>Card {n}</article></body>"
    pages = [(i, f"http://h.example.com/{i}", story.format(n=i)) for i in range(40)] + [(100 + i, f"http://h.example.com/c{i}", cards.format(n=i)) for i in range(9)]
    pages += [(200, "http://h.example.com/7", story.format(n=7))] * 50  # copies don't make template text
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wrappers.extract_pages(df).collect()}
    assert all(got[i] == f"Title {i}\n\nOwn text {i} of the page" for i in range(40)) and got[200] == got[7]
    assert wrappers.infer(["<div>" * 3000 + "deep"] * 3) and wrappers.extract("<div>" * 3000 + "deep") == "deep"
    assert all(got[100 + i] == f"The long text number {i} of this page, which is told at length\n\nMore of number {i} here" for i in range(9))
    # Without the wrappers the template's lines stay and the teasers win.
    assert "Tell your friends" in wrappers.extract(story.format(n=3)) and wrappers.extract(cards.format(n=3)) != got[103]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><meta charset=utf-8><title>t</title><body><p>all of it</p></body>", "all of it"),
        ("<head><title>t</title><p>all of it</p>", "all of it"),
        ("<body><nav><ul><li>Menu</ul><div><p>all of it</p></div></body>", "all of it"),
        ("<body><div><button>Go<p>all of it</p></div></body>", "all of it"),
        ("<p>one</p><svg-icon></svg-icon><p>two</p><svg/><iframe src='x' /><math /><video-player></video-player><p>three</p>", "one\n\ntwo\n\nthree"),
        ("<script src=/a/>var x='<p>no</p>';</script><title/><p>yes</p><script src='a' />no</script><p>yes</p>", "yes\n\nyes"),
        ("<article><h2 id='related-work'>Related work</h2><p>text</p></article>", "Related work\n\ntext"),
    ],
)
def test_ordinary_html(source, text):
    assert wrappers.extract(source) == text


def test_words_inside_articles_count_where_they_recur(spark):
    page = "<body><article><div class='article-header'>Title {n}</div>{more}<p>Text {n}</p><div class='related'>Next {n}</div></article></body>"
    pages = [(i, f"http://h.example.com/{i}", page.format(n=i, more="<section id=advertising>On adverts</section>" if i == 3 else "")) for i in range(8)]
    got = {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\n\nOn adverts\n\nText 3" and got[4] == "Title 4\n\nText 4"


def article_blocks(source):
    """The blocks of the article by the library's own parser: a plain version for the given pages."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        blocks, parts, inside = None, None, 0

        def cut(self):
            text = " ".join("".join(self.parts).split())
            self.blocks += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag == "br":
                self.parts.append(" ")
            elif tag in wrappers.BLOCK:
                self.cut()

        def handle_endtag(self, tag):
            if tag in wrappers.BLOCK:
                self.cut()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    reader = Reader()
    reader.blocks, reader.parts = [], []
    reader.feed(source)
    reader.close()
    return reader.blocks


def test_given_pages(spark, mid_dir):
    """All given pages have an article: its blocks, joined by an empty line, to the character."""
    rows = queries()["op3_html_wrappers"](spark, mid_dir).join(spark.read.parquet(f"{mid_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        want = "\n\n".join(article_blocks(r.html))
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id


def test_lines_keep_their_first_text(spark):
    shared = "this passage stands on many sites " * 3
    rows = [(i, f"own text number {i} that only one document has\n{shared}", f"s{i}") for i in range(5)]
    rows += [(10 + i, f"copied whole {i % 1}\nand nothing else here at all", f"s{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert shared in got[0].text and all(shared not in got[i].text and got[i].lines_removed == 1 for i in range(1, 5))
    assert all(got[10 + i].text == rows[5][1] for i in range(5))


def test_sites_of_copies_count(spark):
    """A passage in two texts, one of them on twenty sites, stands on twenty sites."""
    shared = "this passage stands in two texts only " * 3
    rows = [(i, f"first text of its own\n{shared}", f"s{i}") for i in range(20)] + [(50, f"second text of its own\n{shared}", "s3")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].text == rows[i][1] for i in range(20)) and got[50].text == "second text of its own" and got[50].lines_removed == 1


def test_sure_and_near_counts_agree(spark):
    rows = [(100 * k + i, f"line of number {k} on some sites\nfiller {k} {i} a b c d", f"s{i}") for k in range(1, 16) for i in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r.doc_id // 100 for r in line_dedup.dedup_lines(df, line_dedup.Spread(min_sites=4, near=2.0)).collect() if r.lines_removed}
    assert removed == {k for k in range(1, 16) if k >= 4}


def test_fingerprints_by_brute_force(spark, small_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries()["op6_edit_fingerprint"](spark, small_dir).collect()}
    embed = edit_fingerprint.Embedder()
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[1][:half]
        p, q = embed.prints([text, changed])
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].fingerprint == p.tobytes().hex() and got[i].edited_fingerprint == q.tobytes().hex()
        assert got[i].near_edited == pytest.approx(edit_fingerprint.likeness(p[None], q[None])[0])
        assert got[i].near_next == pytest.approx(edit_fingerprint.likeness(p[None], embed.prints([following[1]]))[0])
    assert np.mean([r.near_edited for r in got.values()]) > 0.4 and np.median([r.near_next for r in got.values()]) < 0.2


def test_small_edits_stay_near():
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    shifted = "xyz" + text[:2000] + text[2004:]
    a, b = edit_fingerprint.Embedder().prints([text, shifted])
    assert edit_fingerprint.likeness(a[None], b[None])[0] > 0.5


def test_early_insertions_in_long_texts_stay_near():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, 97 + rng.integers(0, 26, n))) for n in [20000] * 12 + [50] * 100]
    embed = edit_fingerprint.Embedder()
    own = embed.prints(texts)
    for k in (5, 10, 20):
        like = edit_fingerprint.likeness(own, embed.prints(["q" * k + t for t in texts]))[:12]
        assert np.median(like) >= 0.8 and np.mean(like >= 0.8) > 0.6
    # Side by side or alone, a text has one fingerprint, which a plain walk confirms.
    alone = embed.prints(texts[:1])
    assert (alone[0] == own[0]).all() and (embed.prints(texts[20:21])[0] == own[20]).all()
    at, steps = 0, []
    for c in np.frombuffer(texts[0].encode("utf-32-le"), "<u4"):
        steps.append(at)
        at += int(embed.wait[int(edit_fingerprint.mix(np.array([c], np.uint64))[0]) % 64 * 4096 + at % 4096])
    assert (embed._steps([np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts])[0] == steps).all()


def test_near_pairs(spark):
    text = "".join(chr(97 + (i * 31 + i // 11) % 26) for i in range(3000))
    rows = [(1, text), (2, text), (3, text[:2990] + "!"), (4, text[::-1])]
    embed = edit_fingerprint.Embedder()
    prints = spark.createDataFrame([(i, embed.prints([t])[0].tobytes().hex()) for i, t in rows], "id long, fingerprint string")
    assert {(r.a, r.b) for r in edit_fingerprint.near_pairs(prints).collect()} == {(1, 2), (1, 3)}


@pytest.mark.parametrize("block", [512, 5])
def test_near_pairs_of_mixed_buckets(spark, block):
    """All fingerprints share every bucket; those that are near each other are neither its least nor its greatest."""
    rng = np.random.default_rng(3)
    shared = sorted({int(i) for _ in range(24) for i in rng.choice(128, 4, replace=False)})
    rest = [i for i in range(128) if i not in shared]
    rows = rng.integers(0, 255, (40, 128)).astype(np.uint8)
    rows[:, shared] = rows[0, shared]
    for k in range(5, 25, 3):
        rows[k + 1, rest[:45]] = rows[k, rest[:45]]
        rows[k + 2, rest[10:]] = rows[k + 1, rest[10:]]
    near = {(i, j) for i in range(40) for j in range(i + 1, 40) if edit_fingerprint.likeness(rows[i : i + 1], rows[j : j + 1])[0] >= 0.8}
    prints = spark.createDataFrame([(i, r.tobytes().hex()) for i, r in enumerate(rows)], "id long, fingerprint string")
    got = {(r.a, r.b) for r in edit_fingerprint.near_pairs(prints, block=block).collect()}

    def groups(links):
        of = list(range(40))
        for a, b in links:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(i for i in range(40) if of[i] == x) for x in of}

    assert len(near) > 10 and got <= near and groups(got) == groups(near)


def test_insertions_anywhere_stay_near():
    """0.1 % of a long text inserted at its start, middle or end; unrelated texts stay far apart."""
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, rng.integers(2, 9)))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 8500))[:50_000] for _ in range(4)]
    embed = edit_fingerprint.Embedder()
    own = embed.prints(texts)
    for at in (0, 25_000, 49_000):
        like = edit_fingerprint.likeness(own, embed.prints([t[:at] + "zq x" * 12 + "yy" + t[at:] for t in texts]))
        assert np.median(like) > 0.8, (at, like)
    assert max(edit_fingerprint.likeness(own[i : i + 1], own[j : j + 1])[0] for i in range(4) for j in range(i)) < 0.1


def test_near_documents_by_brute_force(spark, small_dir):
    """All pairs of fingerprints that reach the likeness lie in one class; classes hold nothing else."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    rng = np.random.default_rng(8)
    rows += [(10_000 + i, t[: len(t) - 1 - int(rng.integers(0, 40))] + "!") for i, t in rows if len(t) > 200]
    prints = edit_fingerprint.Embedder().prints([t for _, t in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if edit_fingerprint.likeness(prints[i : i + 1], prints[j : j + 1])[0] >= 0.8]
    of = list(range(len(rows)))
    for i, j in pairs:
        of = [of[j] if x == of[i] else x for x in of]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[of[k]] = min(least.get(of[k], i), i)
    got = {r.doc_id: r for r in edit_fingerprint.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) > 50 and len(got) == len(rows)
    found = np.mean([got[rows[i][0]].class_id == got[rows[j][0]].class_id for i, j in pairs])
    assert found >= 0.9
    assert np.mean([got[i].class_id == least[of[k]] for k, (i, _) in enumerate(rows)]) >= 0.9
    assert all((got[i].n_links > 0) == (got[i].class_id != i or any(r.class_id == i and r.doc_id != i for r in got.values())) for i, _ in rows)


def test_string_ids(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    names = docs.selectExpr("concat('d', lpad(cast(doc_id as string), 8, '0')) as doc_id", "text")
    a = {f"d{r.doc_id:08d}": r[1:] for r in edit_fingerprint.fingerprint(docs).collect()}
    assert a == {r.doc_id: r[1:] for r in edit_fingerprint.fingerprint(names).collect()}


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", url_filter.registered_domain(F.col("host")), url_filter.suffix(F.col("host"))).collect()}
    assert got == hosts


def test_strengths_follow_the_outcomes(spark):
    """Hosts of one mind each: a strong correlation, so a weak prior. Hosts that all behave alike: a strong one."""
    apart = [(f"h{i}.a.com", i % 2 == 0) for i in range(40) for _ in range(10)] + [("new.a.com", True)]
    alike = [(f"h{i}.a.com", k % 2 == 0) for i in range(40) for k in range(10)] + [("new.a.com", True)]
    mean = [{r.host: r.mean for r in url_filter.host_reputation(spark.createDataFrame(x, "host string, good boolean")).collect()}["new.a.com"] for x in (apart, alike)]
    assert mean[0] > 0.7 and mean[1] < 0.51


def test_line_limits_follow_the_host(spark):
    """A short line of a large host's ordinary texts stays; boilerplate of a small host goes."""
    from veilframe.llm import quality_rules

    rows = [(i, f"own words {i} of text {i * i}\n" + ("now and then" if i % 120 == 0 else f"else {i}"), "large") for i in range(3000)]
    rows += [(5000 + i, f"line {i}\nall of this is boilerplate", "small") for i in range(30)]
    got = {r.doc_id: r.lost_words for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[120] == 0 and got[5003] == 5


def test_url_rules(spark):
    rules = [url_filter.Rule("com/en/", "block"), url_filter.Rule("example.com/en/7", "allow")]
    urls = ["http://WWW.Example.com/en/77?x", "http://example.com/en/8#y", "ftp://notcom/en/1", "a://b://c/d", None, "plain", "x://com", "http://h?x=://y/z"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(df, rules).collect()}
    assert got == {0: ("www.example.com", "/en/77", "example.com/en/7"), 1: ("example.com", "/en/8", "com/en/"), 2: ("notcom", "/en/1", None), 3: ("b:", "//c/d", None), 4: ("", "", None), 5: ("", "", None), 6: ("com", "", None), 7: ("h", "", None)}


def test_reputation_shrinks(spark):
    rows = [("bad.example.com", False)] * 40 + [("good.example.com", True)] * 40 + [("new.example.com", False)] + [(f"h{i}.other.com", True) for i in range(40)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, good boolean")).collect()}
    assert got["bad.example.com"].upper < 0.5 < got["new.example.com"].upper and got["good.example.com"].mean > 0.85
