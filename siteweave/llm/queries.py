"""One query for each operator, over its whole table with production parameters, and the SQL that checks it.

Each returns its operator's rows; digests are derived from them here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm import bpe, html, langid, leaks, lines, merkle, prefixes, quality, shards, simhash, spelling, topk, urls
from siteweave.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


OP3_SQL = """
with rules(verdict, rule, rhost, rpath) as (values
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
cut as (
  select page_id, url, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut),
fit as (
  select p.page_id, max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) as r
  from parts p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by p.page_id)
select p.page_id, coalesce(host, '') as host, coalesce(path, '') as path, fit.r.rule as rule, coalesce(fit.r.verdict, 'allow') as verdict
from parts p left join fit using (page_id)
"""


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 5
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines_removed", "text")


OP8_SQL = """
with cut as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
occ as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as n from cut),
w as (
  select doc_id, line, n, cast(doc_id as hugeint) * 4294967296 + n as pos,
    list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') as ws
  from occ),
d as (select line, any_value(ws) as ws, min(pos) as first, any_value(len(ws)) as m from w where len(ws) > 0 group by line),
long as (select *, array_to_string(ws, ' ') as plain from d where m >= 5),
place as (select line, ws, first, m, unnest(range(1, m + 1)) as i from long),
var as (select line, first, m, i, array_to_string(list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, m)), ' ') as v from place),
near as (
  select a.line from var a join var b on a.v = b.v and a.i = b.i and a.m = b.m where b.first < a.first
  union select a.line from var a join long b on a.v = b.plain and b.m = a.m - 1 where b.first < a.first
  union select b.line from var a join long b on a.v = b.plain and b.m = a.m - 1 where a.first < b.first
  union select a.line from long a join long b using (plain) where b.first < a.first),
gone as (select w.doc_id, w.n from w join d using (line) where w.pos > d.first or d.line in (select line from near)),
kept as (
  select o.doc_id, string_agg(o.line, chr(10) order by o.n) filter (where g.n is null) as text, count(g.n) as lines_removed
  from occ o left join gone g on g.doc_id = o.doc_id and g.n = o.n group by o.doc_id)
select c.doc_id, cast(coalesce(k.lines_removed, 0) as int) as lines_removed,
  case when c.text is null then null else coalesce(k.text, '') end as text
from cut c left join kept k using (doc_id)
"""

def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_join(leaks.item_list("leaks").cast("array<string>"), ",").alias("items"),
    )


OP10_SQL = """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as ts from documents),
b as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as ts from benchmark where text is not null),
item as (
  select item_id, ts, len(ts) as m, least(len(ts), 13) as w, least(len(ts), 13) - least(len(ts), 13) // 6 as need from b where len(ts) >= 5),
bt as (select item_id, m, w, need, unnest(ts) as tok, unnest(range(len(ts))) as pos from item),
dt as (select doc_id, len(ts) as n, unnest(ts) as tok, unnest(range(len(ts))) as pos from d),
pair as (
  select doc_id, n, item_id, m, w, need, dt.pos - bt.pos as diag, list(bt.pos) as ps
  from dt join bt using (tok) group by all having count(*) >= need),
win as (select *, unnest(range(0, m - w + 1)) as s from pair),
leak as (
  select distinct doc_id, item_id from win
  where s + diag >= 0 and s + diag + w <= n and len(list_filter(ps, lambda p: p >= s and p < s + w)) >= need)
select d.doc_id, count(l.item_id) > 0 as contaminated, coalesce(string_agg(cast(l.item_id as varchar), ',' order by l.item_id), '') as items
from d left join leak l using (doc_id) group by d.doc_id
"""

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verified_manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = """
with recursive marked as (
  select *, replace(text, chr(10), '') as flat,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
        lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)), 4294967295::ubigint) % 2 = 0 as chosen
  from documents),
hashed as (
  select doc_id, source,
    case when doc_id is null then '-' else strlen(cast(doc_id as varchar)) || ':' || doc_id end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end
      || case when n_chars is null then '-' else strlen(cast(n_chars as varchar)) || ':' || n_chars end as head,
    case when text is null then '-' else strlen(text) || ':' || text end as body,
    case when text is null then '-' when chosen then strlen(flat) || ':' || flat else strlen(text) || ':' || text end as other
  from marked),
leaves as (
  select doc_id, coalesce('=' || source, '') as s, sha256(head || body) as leaf, sha256(head || other) as other from hashed),
placed as (
  select *, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by s) as n from leaves),
nodes as (
  select 0 as level, s, r as i, n, leaf as digest from placed
  union all
  select level + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by i)) from nodes where n > 1 group by level, s, i // 3, n),
subroots as (select s, digest, row_number() over (order by encode(s)) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, '' as s, i, n, digest from subroots
  union all
  select level + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by i)) from tops where n > 1 group by level, s, i // 3, n),
kin as (
  select false as top, a.level, a.s, a.i, coalesce(string_agg(b.digest, '' order by b.i) filter (b.i < a.i), '') as l,
    coalesce(string_agg(b.digest, '' order by b.i) filter (b.i > a.i), '') as r
  from nodes a join nodes b on a.level = b.level and a.s = b.s and a.i // 3 = b.i // 3 where a.n > 1 group by all
  union all
  select true, a.level, a.s, a.i, coalesce(string_agg(b.digest, '' order by b.i) filter (b.i < a.i), ''),
    coalesce(string_agg(b.digest, '' order by b.i) filter (b.i > a.i), '')
  from tops a join tops b on a.level = b.level and a.i // 3 = b.i // 3 where a.n > 1 group by all),
inside as (
  select s, r as id, 0 as level, r as i, leaf, other as cur, '' as proof, doc_id from placed
  union all
  select f.s, f.id, f.level + 1, f.i // 3, f.leaf, sha256(k.l || f.cur || k.r), f.proof || k.l || k.r, f.doc_id
  from inside f join kin k on not k.top and k.level = f.level and k.s = f.s and k.i = f.i),
climbed as (select * from inside qualify level = max(level) over (partition by s)),
above as (
  select c.s, c.id, 0 as level, t.i, c.leaf, c.cur, c.proof, c.doc_id, t.digest as subroot from climbed c join subroots t using (s)
  union all
  select f.s, f.id, f.level + 1, f.i // 3, f.leaf, sha256(k.l || f.cur || k.r), f.proof || k.l || k.r, f.doc_id, f.subroot
  from above f join kin k on k.top and k.level = f.level and k.i = f.i)
select a.doc_id, a.leaf, a.subroot, t.digest as root, sha256(a.proof) as proof_sha256, a.cur as folded_root, a.cur = t.digest as verified
from above a join tops t on t.n = 1
qualify a.level = max(a.level) over ()
"""

def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.token_counts(prefixes.prefix_table(table(spark, sf_dir, "documents")), limit=2048)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP13_SQL = """
with recursive found as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) as run from documents),
lowered as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from found group by all),
hashed as (
  select run, n, xor(list_reduce(
      list_prepend(4294967295::ubigint, flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: case when unicode(c) < 128 then [unicode(c)] else [192 + unicode(c) // 64, 128 + unicode(c) % 64] end))::ubigint[]),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
        lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)), 4294967295::ubigint) as h
  from lowered),
spelt as (
  select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed),
words as materialized (select word, cast(sum(n) as bigint) as n from spelt where length(word) >= 7 group by word having sum(n) >= 2),
places as materialized (
  select word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
  select a.word, b.word as other, b.n as m from places a join places b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union select p.word, w.word, w.n from places p join words w on p.head || p.tail = w.word
  union select w.word, p.word, p.n from places p join words w on p.head || p.tail = w.word),
best as (
  select word, count(*) as n_near, max(m) as m, min(other) filter (m = top) as other
  from (select *, max(m) over (partition by word) as top from near) group by word),
forms as materialized (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 10 * w.n then b.other end as form, case when b.m >= 10 * w.n then b.m end as form_n
  from words w left join best b using (word)),
chain as (
  select word, word as root, 0 as steps from forms
  union all
  select c.word, f.form, steps + 1 from chain c join forms f on f.word = c.root where f.form is not null),
last as (select word, max_by(root, steps) as root from chain group by word)
select word, form, root, n, n_near, form_n from forms join last using (word)
"""

#: name: (query, SQL or None). Without SQL the query is tested against brute force in tests/llm.
QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_bpe_round_trip": (op2_bpe_round_trip, None),
    "op3_url_rules": (op3_url_rules, OP3_SQL),
    "op4_shards": (op4_shards, None),
    "op5_quality": (op5_quality, None),
    "op6_top_k": (op6_top_k, OP6_SQL),
    "op7_simhash": (op7_simhash, None),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_main_text": (op9_main_text, None),
    "op10_benchmark_leaks": (op10_benchmark_leaks, OP10_SQL),
    "op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL),
    "op12_token_counts": (op12_token_counts, None),
    "op13_spelling_variants": (op13_spelling_variants, OP13_SQL),
}
