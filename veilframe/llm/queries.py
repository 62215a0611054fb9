"""The queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import compression_classifier, edit_fingerprint, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, url_filter, wrappers
from veilframe.llm.common import table

URL_RULES = [url_filter.Rule("com/en/", "block"), url_filter.Rule("example.com/en/7", "allow"), url_filter.Rule("net/de/", "allow"), url_filter.Rule("example.net/de/8", "block"), url_filter.Rule("org/es/", "block")]


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op1_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.detect(table(spark, sf_dir, "documents"))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op4_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprint(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", "orders")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banding and verification of op6's fingerprints over all documents."""
    return edit_fingerprint.near_documents(table(spark, sf_dir, "documents"))


QUERIES = (op1_parity_join, op2_language_id, op3_html_wrappers, op4_site_spread, op5_source_mix, op6_edit_fingerprint, op7_url_reputation, op8_line_frequency, op9_best_fit_packing, op10_compression_quality, near_fingerprints)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP7_SQL = r"""
with urls as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
), fit as (
  select *, case
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule
  from urls
), ruled as (
  select *, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' end as by_rule,
    case when two in (TWO) then array_to_string(string_split(host, '.')[-3:], '.') else two end as domain,
    case when two in (TWO) then two else string_split(host, '.')[-1] end as suffix
  from (select *, array_to_string(string_split(host, '.')[-2:], '.') as two from fit)
), h as (
  select host, any_value(domain) as domain, any_value(suffix) as suffix, count(*) as n, count(*) filter (where by_rule = 'allow') as k
  from ruled where rule is not null group by host
), d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
s as (select suffix, sum(n) as n, sum(k) as k from d group by all),
w as (select coalesce(sum(k), 0) as k, coalesce(sum(n), 0) as n from s),
r0 as (select sum(c.k * (c.k - 1) - c.n * (c.n - 1) * (w.k::double / w.n) * (w.k::double / w.n)) as x, sum(c.n * (c.n - 1) * (w.k::double / w.n) * (1 - w.k::double / w.n)) as y from s c, w),
r1 as (select sum(c.k * (c.k - 1) - c.n * (c.n - 1) * (p.k::double / p.n) * (p.k::double / p.n)) as x, sum(c.n * (c.n - 1) * (p.k::double / p.n) * (1 - p.k::double / p.n)) as y from d c join s p using (suffix)),
r2 as (select sum(c.k * (c.k - 1) - c.n * (c.n - 1) * (p.k::double / p.n) * (p.k::double / p.n)) as x, sum(c.n * (c.n - 1) * (p.k::double / p.n) * (1 - p.k::double / p.n)) as y from h c join d p using (domain, suffix)),
m as (
  select i, case when coalesce(y, 0) = 0 then 8.0::double else round(1 / least(greatest(x / y, 1 / 201.0::double), 0.5::double) - 1, 3) end as strength
  from (select 0 as i, * from r0 union all select 1, * from r1 union all select 2, * from r2)
),
m0 as (select strength as v from m where i = 0), m1 as (select strength as v from m where i = 1), m2 as (select strength as v from m where i = 2),
s1 as (select suffix, (w.k + 1)::double / (w.n + 2) * v + s.k as a, (1 - (w.k + 1)::double / (w.n + 2)) * v + s.n - s.k as b from s, w, m0),
s2 as (select suffix, a / (a + b) as mean, a / (a + b) + 2.0::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as upper from s1),
d1 as (select domain, mean * v + k as a, (1 - mean) * v + n - k as b from d join s2 using (suffix), m1),
d2 as (select domain, a / (a + b) as mean, a / (a + b) + 2.0::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as upper from d1),
h1 as (select host, mean * v + k as a, (1 - mean) * v + n - k as b from h join d2 using (domain), m2),
h2 as (select host, a / (a + b) + 2.0::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as upper from h1)
select page_id, host, path, rule,
  coalesce(by_rule, case when coalesce(h2.upper, d2.upper, s2.upper, 1.0) < 0.5 then 'block' else 'allow' end) as verdict,
  coalesce(h2.upper, d2.upper, s2.upper, 1.0)::double as reputation
from ruled left join h2 using (host) left join d2 using (domain) left join s2 using (suffix)
""".replace("TWO", ", ".join(f"'{x}'" for x in url_filter.TWO_LABELS))

OP8_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, source, text as t0, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), tri as (
  select r, i, (w[i], w[i + 1], w[i + 2]) as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from tri) where n > 1
), covered as (
  select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r
), lines as (
  select distinct r, source, t0, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as x
  from (select r, source, t0, unnest(l) as x from d)
), hosts as (
  select source, count(distinct t0) as texts from lines group by source
), common as (
  select c.source, c.x from (select source, x, count(*) as n from (select distinct source, t0, x from lines) group by all) c
  join hosts h on c.source is not distinct from h.source where n > 20 and n > 0.01 * texts
), loss as (
  select r, sum(len(string_split(x, ' '))) as every, sum(case when exists (select 1 from common c where c.source is not distinct from lines.source and c.x = lines.x) then len(string_split(x, ' ')) else 0 end) as lost
  from lines group by r
), m as (
  select d.*, len(w) as n_words, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost_words, coalesce(every, 0) as every,
    len(w) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed
  from d left join covered using (r) left join loss using (r)
)
select doc_id, n_words::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not lost_words > 0.7 * every as kept, lost_words::bigint as lost_words
from m
"""


OP4_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, text from documents),
texts as (select text, min(doc_id) as first_doc from d where text is not null group by text),
sites as (select distinct text, coalesce(source, chr(0)) as site from d where text is not null),
lines as (
  select distinct text, first_doc, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as x
  from (select text, first_doc, unnest(string_split(text, chr(10))) as x from texts) where regexp_matches(x, '[^\x20\x09-\x0D]')
), spread as (
  select x, min(first_doc) as owner from lines join sites using (text) group by x
  having count(distinct text) > 1 and count(distinct site) >= case when len(string_split(x, ' ')) >= 5 then 3 else 10 end
), gone as (select l.text, l.x from lines l join spread s using (x) where l.first_doc <> s.owner),
parts as (
  select r, text, unnest(string_split(text, chr(10))) as y, unnest(range(len(string_split(text, chr(10))))) as i from d where text is not null
), marked as (
  select p.r, p.y, p.i, g.x is null as stays
  from parts p left join gone g on g.text = p.text and g.x = lower(trim(regexp_replace(p.y, '[\x20\x09-\x0D]+', ' ', 'g')))
), clean as (
  select r, coalesce(string_agg(y, chr(10) order by i) filter (where stays), '') as t, count(*) filter (where not stays) as lines_removed from marked group by r
)
select d.doc_id, case when d.text is null then null else c.t end as text, d.source, coalesce(c.lines_removed, 0)::bigint as lines_removed
from d left join clean c using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_site_spread": OP4_SQL, "op7_url_reputation": OP7_SQL, "op8_line_frequency": OP8_SQL}
