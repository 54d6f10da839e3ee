"""The registered queries of this folder: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import decontaminate, langid, licenses, packing, phrases, qualityrules, repeats, resample, simhash, tokencount, tokenrecords, urlfilter, weakquality


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document: a null text is empty, repeated rows and null ids have their rows."""
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), _tokenizer())


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to record files and read back: a null text has the end id alone, null ids come first."""
    return tokenrecords.read_token_records(tokenrecords.write_token_records(_read(spark, sf_dir, "documents"), _tokenizer()))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into windows: a null text has the end id alone, repeated rows are packed one by one."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer(), with_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document: null and empty texts get the score of a text without features."""
    docs = _read(spark, sf_dir, "documents")
    return weakquality.score_quality(docs, weakquality.fit_quality_model(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document: und with score 0 for a null text and one without letters."""
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_language_model(docs))


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page: a null URL and one without :// have an empty host and path and no rule."""
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log ratio and verdict of every document: a null text has no words and fails."""
    docs = _read(spark, sf_dir, "documents")
    model = qualityrules.fit_ratio(docs, _read(spark, sf_dir, "labels").where("quality = 1"))
    return qualityrules.judge(docs, model).withColumn("log_ratio", F.round("log_ratio", 6))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses and differences of wording of every document: a null or empty text has none."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).drop("found")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: texts without words have fingerprint zero and link like others."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits and items of every document: a null text has no words and no hits."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_xxhash64")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier: a null text has no bytes."""
    return repeats.without_repeats(_read(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark's words: a null text has no features and weight 0."""
    docs, target = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return resample.resample(docs, resample.bucket_gains(docs, target))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of all documents: a null text has no words, a null language is und."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_token_records,
        op3_packing,
        op4_quality_classifier,
        op5_language_id,
        op6_url_filter,
        op7_quality_rules,
        op8_license_scan,
        op9_simhash,
        op10_decontamination,
        op11_repeats,
        op12_resample,
        op13_collocations,
    )
}

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op6_url_filter": rf"""
with rules(v, h, p) as (values {_RULES_SQL}),
u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
),
n as (select distinct host, path from u),
best as (
  select host, path, arg_max(h || p, (length(h || p), length(h))) as rule, arg_max(v, (length(h || p), length(h))) as v
  from n join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path
)
select u.page_id, u.host, u.path, best.rule, coalesce(best.v, 'allow') as verdict
from u left join best on u.host = best.host and u.path = best.path
""",
    "op7_quality_rules": r"""
with d as (select row_number() over () as i, doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
v as (select i, unnest(w) as v, unnest(range(1, len(w) + 1)) as p from d),
e as (select i, p, concat_ws(' ', v, lead(v, 1) over o, lead(v, 2) over o, lead(v, 3) over o, lead(v, 4) over o, lead(v, 5) over o, lead(v, 6) over o, lead(v, 7) over o) as s, lead(v, 7) over o as last from v window o as (partition by i order by p)),
k as (select i, p, count(*) over (partition by i, s) as n from e where last is not null),
r as (select i, count(distinct q) as n_repeat_words from (select i, unnest(range(p, p + 8)) as q from k where n > 1) group by i),
l as (select i, count(*) as n, count(distinct s) as m from (select i, unnest(string_split(t, chr(10))) as s from d) where regexp_matches(s, '[^\x20\x09-\x0D]') group by i),
b as (
  select i, doc_id, w, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n - m, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join l using (i) left join r using (i)
),
x as (select i, p, cast('0x' || md5(translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))[1:8] as ubigint) as h from v),
f as (select i, h, lead(h) over (partition by i order by p) as h2 from x),
y as (select i, h from x union all select i, xor((h * 2246822507::ubigint) & 4294967295::ubigint, (h2 + 668265263::ubigint) & 4294967295::ubigint) from f where h2 is not null),
g as (select i, ((h * 2654435761::ubigint) & 4294967295::ubigint) >> 18 as bucket from y),
c as (
  select bucket, count(*) as raw, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as target from g join d using (i) group by bucket
),
s as (select sum(raw) + 8192.0 as raw, sum(target) + 8192.0 as target from c),
z as (select bucket, ln((c.target + 0.5) / s.target) - ln((c.raw + 0.5) / s.raw) as ratio from c, s),
m as (select i, avg(ratio) as log_ratio from g join z using (bucket) group by i)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, round(log_ratio, 6) as log_ratio,
       coalesce(not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and log_ratio >= -0.1, false) as kept
from b left join m using (i)
""",
    "op10_decontamination": r"""
with w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
),
d as (select doc_id, w, len(w) as n from w),
i as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
),
win as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as p from i where len(w) > 0)
),
pos as (select doc_id, w, n, unnest(range(1, n + 1)) as p from d),
hit as (
  select doc_id, p, k, item_id
  from (select doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') as s from pos, (select distinct k from win) where p + k - 1 <= n) as a
  join win using (k, s)
),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hit) group by doc_id),
items as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s
  from hit group by doc_id
)
select d.doc_id, cast(n as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""",
    "op12_resample": r"""
with t(b, c) as (select range, list_reduce(list_prepend(range, range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) from range(256)),
tab as (select list(c order by b) as t from t),
d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
),
i as (
  select list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
),
r as (select row_number() over () as i, doc_id, w from d),
e as (select i, unnest(w) as v from r),
ew as (select unnest(w) as v from i),
dv as (select distinct v from e union select distinct v from ew),
hx as (select v, hex(encode(v)) as x from dv),
bs as (select v, list_transform(range(1, length(x), 2), lambda p: (strpos('0123456789ABCDEF', x[p]) - 1) * 16 + strpos('0123456789ABCDEF', x[p + 1]) - 1) as y from hx),
k as (
  select v, xor(list_reduce(list_prepend(4294967295, y), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 as bucket
  from bs, tab
),
s as (select bucket, count(*) as s from e join k using (v) group by bucket),
t2 as (select bucket, count(*) as t from ew join k using (v) group by bucket),
g as (
  select b.range as bucket, cast(floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from e) + 10000)::double) / ((coalesce(s, 0) + 1)::double * ((select count(*) from ew) + 10000)::double))) as bigint) as gain
  from range(10000) as b left join s on b.range = s.bucket left join t2 on b.range = t2.bucket
),
wt as (select i, cast(sum(gain) as bigint) as weight from e join k using (v) join g using (bucket) group by i),
z as (
  select i, doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score
  from r left join wt using (i)
),
o as (select i, row_number() over (order by score desc, doc_id) as rank from z where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (10 * (select count(*) from o)) // 100 then rank end as rank from z left join o using (i)
""",
    "op13_collocations": r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents
),
w as (select row_number() over () as i, lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
e as (select lang, i, w, unnest(range(1, len(w) + 1)) as pos from w where len(w) > 0),
g as (select lang, array_to_string(w[pos : pos + k - 1], ' ') as s, k from e, (values (1), (2), (3), (4)) as v(k) where pos + k - 1 <= len(w)),
f as (select lang, s, k, count(*) as f from g group by lang, s, k),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select lang, s, k, f as a, string_split(s, ' ') as w from f where k > 1 and f >= 30),
cut as (select lang, s, a, unnest(range(1, k)) as j, w, k from c),
part as (select lang, s, a, j, array_to_string(w[1:j], ' ') as x, array_to_string(w[j + 1 : k], ' ') as y from cut),
sc as (
  select part.lang, part.s, a, j, l.f as l, r.f as r, cast((2000000::hugeint * a) // (l.f + r.f) as bigint) as score
  from part join f as l on l.lang = part.lang and l.s = x join f as r on r.lang = part.lang and r.s = y
),
best as (select * from (select *, row_number() over (partition by lang, s order by score, j) as o from sc) where o = 1),
inner1 as (select lang, a, w, k, unnest(range(2, k)) as m from c where k > 2),
inner2 as (select lang, a, w, m, unnest(range(1, k - m + 2)) as pos from inner1),
longer as (select lang, array_to_string(w[pos : pos + m - 1], ' ') as s, max(a) as longer from inner2 group by all),
kept as (select best.*, row_number() over (partition by best.lang order by score desc, a desc, best.s) as rank from best left join longer using (lang, s) where longer is null or 100::hugeint * longer < 80::hugeint * a)
select lang, rank, s as phrase, a, l, r, n, score from kept join n using (lang) where rank <= 2000
""",
}
