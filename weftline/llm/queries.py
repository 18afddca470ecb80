"""The corpus operators as registered queries, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import centroids, chat_format, importance, language_id, license_scan, line_dedup, media, near_dup, packing, prefix_trie, quality_rules, sharding, source_mixing
from weftline.llm.common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rules and host verdicts of all documents."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed", "host_rejected", "host_rate")


ORACLES["op2_host_quality"] = r"""
with w as (
  select doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8),
g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i:i+7], ' ')) as n from p),
m as (select doc_id, unnest(range(i, i + 8)) as k from g where n > 1),
r as (select doc_id, count(distinct k) as n_repeat_words from m group by doc_id),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
f as (
  select w.doc_id, source as host, len(w)::bigint as n_words,
    length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w join l using (doc_id) left join r using (doc_id)),
x as (
  select *, n_words < 20 as f1, 100 * n_repeat_words > 30 * n_words as f2,
    10 * n_symbols > n_words as f3, 10 * n_dup_lines > 3 * n_lines as f4 from f),
h as (
  select host, count(*)::double as n, sum(f1::int)::double as a1, sum(f2::int)::double as a2,
    sum(f3::int)::double as a3, sum(f4::int)::double as a4 from x group by host),
u as (
  select host, n, k, case k when 1 then a1 when 2 then a2 when 3 then a3 else a4 end as a
  from h, (select unnest([1, 2, 3, 4]) as k)),
t as (select k, sum(n) as n, count(*) as hosts, sum(a) / sum(n) as mean, sum(a * a / n) / sum(n) as q from u group by k),
b as (select *, q - mean * mean - mean * (1 - mean) * hosts / n as v from t),
s as (select k, mean, v > 1e-12 as spread, case when v > 1e-12 then mean * (1 - mean) / v - 1 else 0 end as s from b),
y as (
  select host, k, mean, spread, case when spread then (a + mean * s) / (n + s) else mean end as rate, n + s as weight from u join s using (k)),
z as (
  select *, case when spread then round(rate - 1.5 * sqrt(greatest(rate * (1 - rate), 0) / (weight + 1)), 6) else mean end as low from y),
o as (
  select host, max(round(rate, 6)) as host_rate, bool_or(low > 0.5) as host_rejected,
    bool_or(k = 1 and spread and low > mean) as s1, bool_or(k = 2 and spread and low > mean) as s2,
    bool_or(k = 3 and spread and low > mean) as s3, bool_or(k = 4 and spread and low > mean) as s4 from z group by host),
e as (
  select x.*, host_rate, host_rejected, (f1 and s1) or (f2 and s2) or (f3 and s3) or (f4 and s4) as host_failed
  from x join o on x.host is not distinct from o.host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 or f2) as base_failed,
  not (f1 or f2) and not host_rejected and not host_failed as kept, host_failed, host_rejected, host_rate
from e
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What site-relative line deduplication leaves of each document, by the plain ratio."""
    out = line_dedup.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("clean_chars"), F.md5(F.col("text").cast("binary")).alias("clean_md5"))


ORACLES["op7_line_dedup"] = r"""
with l as (
  select doc_id, source, i, string_split(text, chr(10))[i] as line
  from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
t as (select source, count(*) as pages from documents where text is not null group by source),
c as (select source, line, count(distinct doc_id) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by source, line),
b as (select c.source, line from c join t on c.source is not distinct from t.source where n >= 2 and n > 0.05 * pages),
f as (
  select l.*, b.line is not null as bad from l left join b on l.source is not distinct from b.source and l.line = b.line),
s as (
  select doc_id, count(*) as n_lines, count(*) filter (bad) as n_dropped,
    string_agg(line, chr(10) order by i) filter (not bad) as good from f group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped,
  length(case when n_dropped > 0 then coalesce(good, '') else text end)::bigint as clean_chars,
  md5(case when n_dropped > 0 then coalesce(good, '') else text end) as clean_md5
from documents d left join s on d.doc_id = s.doc_id
"""


@query
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_near_dup"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i+4], ' ') as sh from (select *, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select sh from s group by sh having count(*) > 1),
i as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id where a.sh in (select sh from c) group by 1, 2),
e as (
  select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i.n >= 85 * (x.n + y.n - i.n)),
r as (select doc_id as a, doc_id as b from w union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id, w.doc_id = min(r.b) as kept
from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, mixed like the corpus."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.digests(chat_format.format_chats(turns.unionByName(own)))


ORACLES["op5_chat_format"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g')) as n from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(n + length(role) + length('<turn >') + length('</turn>') + 2)::bigint as formatted_chars,
  0::bigint as n_attachments, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::bigint as expanded_tokens
from e group by conv_id
"""


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a Netpbm image, read back, and cut into NPY tiles; a BMP preview beside."""
    return media.text_media(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query
def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents resampled towards those labelled as good."""
    good = importance.labelled(table(spark, sf_dir, "labels"), F.col("quality") == 1)
    return importance.resample(table(spark, sf_dir, "documents"), good, share=0.85)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    quoted = lambda *x: ", ".join("'" + v.replace("'", "''") + "'" for v in x)
    values = ", ".join(f"({quoted(*t)})" for t in license_scan.TEMPLATES)
    notices = ", ".join(f"({quoted(*t)})" for t in license_scan.NOTICES)
    classes = ", ".join(f"({n}, {license_scan.window_class(n)})" for n in range(1, 1000))
    return (
        r"""
with t as (select * from (values """
        + values
        + r""") as v(template, license, text)),
y as (select * from (values """
        + notices
        + r""") as v(template, license, text)),
z as (select * from (values """
        + classes
        + r""") as v(n, c)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
s as (select doc_id, i - 1 as p, array_to_string(w[i:i+4], ' ') as h from (select *, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
u as (select template, license, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from t),
v as (select distinct template, license, array_to_string(w[i:i+4], ' ') as h from (select *, unnest(range(1, len(w) - 3)) as i from u)),
m as (select v.template, count(*) as m, any_value(c) as c from v join u on v.template = u.template join z on n = len(u.w) - 4 group by v.template),
x as (
  select distinct doc_id, template, license, m, h, p - p % c as start from s join v using (h) join m using (template)
  union select doc_id, template, license, m, h, greatest(p - p % c - c, 0) from s join v using (h) join m using (template) where p - p % c > 0),
c as (select doc_id, template, license, m, start, count(*) as n from x group by all),
k as (select template, license, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') as h, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as n from y),
g as (select doc_id, i - 1 as p, n, array_to_string(w[i:i+n-1], ' ') as h from (select d.*, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from k) where len(w) >= n))
select doc_id, template, license, round(max(n) / max(m), 6) as containment, min(start)::bigint as first_word, count(*)::bigint as windows
from c where 100 * n >= 80 * m group by doc_id, template, license
union all select doc_id, template, license, 1.0, min(p)::bigint, count(*)::bigint from g join k using (n, h) group by doc_id, template, license
"""
    )


ORACLES["op4_license_scan"] = _license_sql()

#: One and a half passes over the corpus' tokens, sources all but even, no token more than twice.
MIX = source_mixing.Target(entropy=0.9999, repeats=2.0, passes=1.5)


@query
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken in one and a half passes, with sources at 99.99 % of the full entropy as far as no token comes more than twice."""
    return source_mixing.mixture(table(spark, sf_dir, "documents"), MIX)


#: The mixture of a table called docs, for queries to come: (doc_id, source, n_tokens, weight, copies, block_key, doc_key).
MIX_SQL = r"""
base as (
  select doc_id, coalesce('=' || source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from docs),
nb as (select greatest(1, round(sqrt(count(*))))::bigint as blocks from base),
keyed as (
  select *, substr(md5('block0|' || source || '|' || block), 1, 16) as bkey, substr(md5('doc0|' || doc_id), 1, 16) as dkey
  from (select *, ('0x' || substr(md5('deal0|' || doc_id), 1, 8))::bigint % blocks as block from base, nb)),
src as (select source, tokens, tokens / sum(tokens) over () as p from (select source, sum(n_tokens)::double as tokens from base group by source) where tokens > 0),
lim as (select {entropy} * ln(count(*)) as h from src),
ent as (
  select 0 as step, 0::bigint as lo, 16777216::bigint as hi
  union all
  select step + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
    select *, (select ln(sum(pow(p, mid / 16777216))) - mid / 16777216 * sum(pow(p, mid / 16777216) * ln(p)) / sum(pow(p, mid / 16777216)) from src)
      >= (select h from lim) - 1e-12 as ok
    from (select *, (lo + hi) // 2 as mid from ent where step < 24))),
a1 as (
  select case when (select -sum(p * ln(p)) from src) >= (select h from lim) - 1e-12 then 1.0::double
    else (select lo / 16777216 from ent where step = 24) end as alpha),
rep as (
  select 0 as step, 0::bigint as lo, 16777216::bigint as hi
  union all
  select step + 1, case when ok then lo else mid end, case when ok then mid else hi end from (
    select *, (select {passes} * max(pow(p, mid / 16777216) / p) / sum(pow(p, mid / 16777216)) from src) <= {repeats} + 1e-12 as ok
    from (select *, (lo + hi) // 2 as mid from rep where step < 24))),
a2 as (
  select case when (select {passes} * max(pow(p, alpha) / p) / sum(pow(p, alpha)) from src, a1) > {repeats} + 1e-12
    then greatest(alpha, (select hi / 16777216 from rep where step = 24)) else alpha end as alpha from a1),
wt as (
  select source, tokens, pow(p, alpha) / sum(pow(p, alpha)) over () as weight,
    {passes} * sum(tokens) over () as budget from src, a2),
q as (select source, tokens, weight, floor(round(weight * budget, 3)) as quota from wt),
pl as (select *, floor(quota / tokens) as epochs, quota - floor(quota / tokens) * tokens as rest from q),
ep as (select *, sum(n_tokens) over (partition by source order by bkey, dkey) as upto from keyed),
mixed as (
  select ep.doc_id, case when ep.source <> '' then substr(ep.source, 2) end as source, n_tokens,
    coalesce(round(weight, 6), 0) as weight, coalesce(epochs + (upto <= rest)::int, 0)::bigint as copies,
    bkey as block_key, dkey as doc_key from ep left join pl on ep.source = pl.source)
"""

ORACLES["op1_source_mixing"] = "with recursive docs as (select * from documents)," + MIX_SQL.format(entropy=MIX.entropy, repeats=MIX.repeats, passes=MIX.passes) + "select * from mixed"


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each beginning like the first of its twenty."""
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"), group=20, most=4)
    return prefix_trie.prefix_trie(turns)


ORACLES["op11_prefix_trie"] = r"""
with a as (
  select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from conversations where conv_id is not null),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, h) as p from a),
z as (
  select conv_id as c, count(*) as len, flatten(list_transform(range(1, length(conv_id::varchar) + 1),
    lambda i: [unicode(substr(conv_id::varchar, i::bigint, 1)), -1, -1, -1, -1, -1, -1, -1, -1])) as steps from t group by conv_id),
o as (
  select c, len, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(steps, lambda s: s::bigint)),
    lambda x, s: case when s >= 0 then xor(x, s) else xor(x >> 1, 3988292384 * (x & 1)) end)) % 4 as h from z),
b as (select o.c, o.h, o.c - o.c % 20 as base, least(o.h, coalesce(y.len, 0)) as hb from o left join o y on y.c = o.c - o.c % 20),
r as (
  select c, 0::bigint as d, '' as h, 0::bigint as n from b
  union all select b.c, p, t.h, n from b join t on t.conv_id = base and p <= hb
  union all select b.c, p - b.h + hb, t.h, n from b join t on t.conv_id = b.c and p > b.h),
k as (select c, d, n, md5(string_agg(h, '') over (partition by c order by d)) as key, max(d) over (partition by c) as len from r),
g as (
  select d, key, min(c) as conv_id, count(*) as n_convs, min(n) as n,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (len = d), '')) as ends_sha256 from k group by d, key),
m as (select k.c, k.d, g.conv_id from k join g using (d, key)),
q as (select g.*, m.conv_id as parent from g left join m on m.c = g.conv_id and m.d = g.d - 1),
e as (select parent, d - 1 as d, count(*) as n_children from q where parent is not null group by all),
w as (select q.conv_id, q.d, q.parent, n_convs, n, ends_sha256, coalesce(n_children, 0) as n_children from q left join e on e.parent = q.conv_id and e.d = q.d),
u as (
  select m.conv_id, m.d, sum((n_children = 0)::bigint)::bigint as n_leaves, sum((n_convs - 1) * n)::bigint as saved_tokens
  from w join m on m.c = w.conv_id and m.d <= w.d group by all)
select conv_id, d as depth, parent as parent_conv_id, n_convs, n_children::bigint as n_children, n_leaves, saved_tokens, ends_sha256 from w join u using (conv_id, d)
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components after three rounds over 16 centroids."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), width=64)


def _centroid_sql() -> str:
    parts = [
        r"""v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x,
    row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), embedding) - 1 as first
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 as (select first as k, x as c from v where first < 16)"""
    ]
    for i in range(4):
        parts.append(f"""d{i} as materialized (
  select r, vec_id, x, k, d from (
    select r, vec_id, x, k, d, row_number() over (partition by r order by d, k) as n from (
      select r, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{i})) where n = 1)""")
        if i < 3:
            parts.append(f"""s{i} as (select k, p, count(*) as n, sum(e)::bigint as s from (select k, unnest(x) as e, unnest(range(64)) as p from d{i}) group by k, p),
m{i} as (select k, list((s - ((s % n) + n) % n) // n order by p) as c from s{i} group by k),
c{i + 1} as materialized (select c{i}.k, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (k))""")
    return "with " + ", ".join(parts) + """
select vec_id, k::integer as "cluster", d as distance, sum(d) over (partition by k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(c3.c, ',')) as centroid_sha256 from d3 join c3 using (k)"""


ORACLES["op12_centroids"] = _centroid_sql()


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards, and where one more shard would put them."""
    return sharding.sharded(table(spark, sf_dir, "documents"), [1.0] * 8)


#: The unsigned CRC-32 of the column text of a table named base, as crc; one step for each byte by a table made from the polynomial.
CRC_SQL = r"""
tb as (select list(v order by i) as tbl from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, s: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v from (select unnest(range(0, 256)) as i))),
bytes as (select *, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ','), lambda h: case when h = '' then null else ('0x' || h)::bigint end) as b from base),
summed as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b[:-2]), lambda x, v: xor(x >> 8, tbl[(xor(x, v) & 255) + 1])))::bigint as crc from bytes, tb)
"""

ORACLES["op13_sharding"] = (
    r"""with base as (select row_number() over () as r, doc_id, coalesce(doc_id::varchar, '') as key, coalesce(text, '') as text from documents),"""
    + CRC_SQL
    + r""",
draws as (select r, s, -ln((('0x' || substr(md5(key || '/' || s), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) as e from base, (select unnest(range(0, 9)) as s)),
own as (select r, arg_min(s, (e, s)) as shard from draws where s < 8 group by r),
grown as (select r, arg_min(s, (e, s)) as shard from draws group by r)
select doc_id, octet_length(encode(text)) + 1 as size, crc as text_crc32, 'key' as law, own.shard::integer as shard,
  row_number() over (partition by own.shard order by doc_id nulls first, crc, octet_length(encode(text))) - 1 as slot, grown.shard::integer as grown_shard
from summed join own using (r) join grown using (r)
"""
)
