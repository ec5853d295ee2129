"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.llm import alignment, decision_list, decontaminate, html_text, maxent, near_dup, packing, phrases, rule_ensemble, secrets, sharding, suffix_dedup, warc
from turnforge.llm.common import read
from turnforge.llm.stats import BASE


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = decision_list.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return got.select("doc_id", *BASE, "base_failed", "kept")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(read(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.with_spans(read(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed("spans", base_only=True), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.language_model_scores(read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_text": op3_html_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc_index": op6_warc_index,
    "op7_secret_scan": op7_secret_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_model": op10_language_model,
    "op11_phrases": op11_phrases,
    "op12_sharding": op12_sharding,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {}

SQL["op1_decontamination"] = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
iw as (
  select distinct item_id, len(words[p:p + least(10, len(words)) - 1]) as n, array_to_string(words[p:p + least(10, len(words)) - 1], ' ') as win
  from (select item_id, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) as p from i where len(words) > 0)),
sizes as (select distinct n from iw),
dw as (
  select doc_id, s.n, p, array_to_string(words[p:p + s.n - 1], ' ') as win
  from (select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) as p from w, sizes where len(words) >= n) s),
m as (select dw.doc_id, dw.p, dw.n, iw.item_id from dw join iw on dw.win = iw.win and dw.n = iw.n),
hit as (
  select doc_id, count(distinct pos) as n_hit
  from (select doc_id, unnest(generate_series(p, p + n - 1)) as pos from m) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from m) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (doc_id) left join its using (doc_id)
"""

SQL["op2_suffix_dedup"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as materialized (
  select doc_id, h, p, substr(h, 2 * p + 1, 100) as s
  from (select doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) as p from d where length(h) >= 100)),
least as (select s, min(doc_id) as first from s group by s having min(doc_id) < max(doc_id)),
m as (
  select doc_id, p, lag(p) over w as before from (select s.doc_id, s.p from s join least using (s) where s.doc_id > first) x
  window w as (partition by doc_id order by p)),
g as (select doc_id, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by doc_id order by p) as k from m),
r as (select doc_id, k, min(p) as a, max(p) + 50 as b from g group by doc_id, k),
e as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from r),
kept as (
  select doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as h, max(b) as upto, count(*) as n_spans, sum(b - a) as n_removed
  from e join d using (doc_id) group by doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when kept.doc_id is null then d.h else kept.h || substr(d.h, 2 * upto + 1) end)) as kept_sha256
from d left join kept using (doc_id)
"""

SQL["op5_near_duplicates"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
sh as materialized (
  select distinct doc_id, unnest(case when len(words) = 1 then [words[1]] else [words[p] || ' ' || words[p + 1] for p in generate_series(1, len(words) - 1)] end) as s
  from w where len(words) > 0),
n as materialized (select doc_id, count(*) as n from sh group by doc_id),
links as materialized (
  select x.a, x.b from (select p.doc_id as a, q.doc_id as b, count(*) as both from sh p join sh q on p.s = q.s and p.doc_id < q.doc_id group by all) x
  join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b
  where 100 * x.both >= 80 * (na.n + nb.n - x.both)),
edges as materialized (select a, b from links union select b, a from links),
reach(node, other) as (
  select a, b from edges union select r.node, e.b from reach r join edges e on r.other = e.a),
low as (select node, least(node, min(other)) as component_id from reach group by node)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(low.component_id, w.doc_id) as component_id,
  coalesce(low.component_id, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join low on low.node = w.doc_id
"""

SQL["op6_warc_index"] = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
b as (
  select page_id, html, hex, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 10 * (k // 8) + 1, 10) as bigint) >> (35 - 5 * (k % 8))) & 31), 1)
    for k in generate_series(0, 31)], '') as digest
  from p),
r as (select html, max(page_id) as first from p group by html)
select b.page_id, cast(octet_length(encode(b.html)) as bigint) as payload_bytes, digest as payload_digest,
  case when b.page_id = r.first then 'response' else 'revisit' end as record_type,
  case when b.page_id = r.first then null else r.first end as refers_to
from b join r on b.html = r.html
"""

SQL["op11_phrases"] = r"""
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
g as materialized (
  select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, words, k, unnest(generate_series(1, len(words) - k + 1)) as i from w, (select unnest([1, 2, 3, 4]) as k) s where len(words) >= k) x
  group by all),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as words from g where k > 1 and f >= 30),
cuts as (
  select x.lang, x.phrase, a, j, l.f as l, r.f as r, cast(2000000::hugeint * a // (l.f + r.f) as bigint) as score
  from (select lang, k, phrase, a, words, unnest(generate_series(1, k - 1)) as j from c) x
  join g l on l.lang = x.lang and l.phrase = array_to_string(x.words[1:j], ' ')
  join g r on r.lang = x.lang and r.phrase = array_to_string(x.words[j + 1:x.k], ' ')),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as nth from cuts) x where nth = 1),
inner_part as (
  select lang, array_to_string(words[i:i + s - 1], ' ') as phrase, max(a) as longer
  from (select lang, words, a, k, s, unnest(generate_series(1, k - s + 1)) as i from c, (select unnest([2, 3]) as s) t where s < k) x group by all),
ranked as (
  select b.lang, b.phrase, a, l, r, score, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join inner_part i on i.lang = b.lang and i.phrase = b.phrase where longer is null or 100 * longer < 80 * a)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
  cast(n as bigint) as n, score
from ranked join (select lang, sum(f) as n from g where k = 1 group by lang) t using (lang) where rank <= 2000
"""
