"""The subpackage's registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, conversation_repair, fertility, html_wrappers, lexical_search, licenses, mixing, near_dedup, packing, quality_lm, repeated_spans, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", *packing.ADDED)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.license_scan(table(spark, sf_dir, "documents"), path)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    chats = chat.format_chats(turns.unionByName(own))
    chats = chats.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    conversations, repaired = conversation_repair.repair(conversation_repair.damaged(turns))
    digests = conversation_repair.digests(repaired).select(F.col("conv_id").alias("d_conv"), "sha256")
    out = turns.select(F.col("conv_id").alias("every")).distinct().join(conversations, F.col("every").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("every").eqNullSafe(F.col("d_conv")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_licenses": op5_licenses,
    "op6_near_dedup": op6_near_dedup,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_neighbours": op9_neighbours,
    "op10_fertility": op10_fertility,
    "op11_repeats": op11_repeats,
    "op12_repair": op12_repair,
    "op13_search": op13_search,
}

SQL_OP3 = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('17|' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as key
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, [5.0::double, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight,
    3.0::double * source_size as cap, cast(sum(source_size) over () as double) as total
  from s),
r as (
  select *, cap / weight as ratio, sum(weight) over () as weights,
    sum(cap) over (order by cap / weight, source nulls last rows unbounded preceding) as cap_to_here,
    sum(weight) over (order by cap / weight, source nulls last rows unbounded preceding) as weight_to_here
  from w),
c as (select *, cap_to_here + ratio * (weights - weight_to_here) < total as clamped from r),
t as (
  select source, source_size, case when clamped then cap else
    (total - sum(case when clamped then cap else 0 end) over ()) * weight / sum(case when clamped then 0 else weight end) over () end as target
  from c),
p as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
k as (
  select d.source, d.key, cast(sum(size) as bigint) as size from d group by d.source, d.key),
o as (
  select k.source, k.key, k.size, p.target - p.whole * p.source_size as part,
    coalesce(sum(k.size) over (partition by k.source order by k.key rows between unbounded preceding and 1 preceding), 0) as before
  from k join p on k.source is not distinct from p.source),
l as (select source, max(case when before + size / 2 < part then key end) as last_key from o group by source)
select d.doc_id, d.size, p.source_size, p.target, (p.whole + case when d.key <= coalesce(l.last_key, -1) then 1 else 0 end) * d.size as taken, d.source
from d join p on d.source is not distinct from p.source join l on d.source is not distinct from l.source
"""

SQL_OP7 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?ROLE\]|SEP\]|/?INST\])', '\1\\\2\3', 'g') as erole,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?ROLE\]|SEP\]|/?INST\])', '\1\\\2\3', 'g') as etext from t),
n as (
  select *, lag(erole) over (partition by conv_id order by turn nulls first, erole, etext) as prior from e)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, erole, etext)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, erole, etext), '')) as loss_sha256,
  cast(sum(length(etext) + case when prior is null or prior <> erole then length(erole) + 20 else 5 end) as bigint) as formatted_chars
from n group by conv_id
"""

SQL_OP11 = r"""
with d as (select doc_id, encode(coalesce(text, '')) as data, row_number() over (order by doc_id nulls first) as r from documents),
p as (select r, unnest(range(1, octet_length(data) - 98)) as i, data from d where octet_length(data) >= 100),
w as (select r, i, array_slice(data, i, i + 99) as s from p),
m as (select r, i from w qualify row_number() over (partition by s order by r, i) > 1),
e as (select r, i, case when i - 100 <= lag(i) over (partition by r order by i) then 0 else 1 end as opens from m),
g as (select r, i, sum(opens) over (partition by r order by i) as span from e),
s as (select r, span, min(i) as a, max(i) + 99 as b from g group by r, span),
k as (
  select s.r, coalesce(lag(b) over (partition by s.r order by a), 0) + 1 as a, s.a - 1 as b, d.data from s join d using (r)
  union all select s.r, max(b) + 1, octet_length(any_value(d.data)), any_value(d.data) from s join d using (r) group by s.r),
h as (select r, unhex(coalesce(string_agg(hex(array_slice(data, a, b)), '' order by a) filter (b >= a), '')) as kept from k group by r),
c as (select r, sum(b - a + 1)::bigint as n_removed, count(*) as n_spans from s group by r)
select d.doc_id, octet_length(d.data) as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(h.kept, d.data)) as kept_sha256
from d left join c using (r) left join h using (r)
"""

SQL_OP12 = r"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key
  from conversations),
k as (
  select *, xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, e: case when e >= 0 then xor(s, e) else xor(s >> 1, 3988292384 * (s & 1)) end)) % 20 as kind
  from c),
d as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case kind when 3 then [0, 1] else [0] end) as copy
  from k where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
f as (
  select *, substr(role, 1, 1) as x, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from o),
v as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) as n
  from f group by conv_id),
g as (
  select conv_id, count(*) as illegal from (select conv_id, lag(x) over (partition by conv_id order by i) as before, x from f)
  where before is not null and before || x not in ('su', 'ua', 'au') group by conv_id),
step as (
  select conv_id, 0::bigint as i, [{'c': 0, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''}, {'c': 1000000, 'a': '', 'r': ''}] as s from v
  union all
  select conv_id, i, [
    {'c': e[1].c + 4, 'a': e[1].a || 'D', 'r': e[1].r},
    list_min([{'c': e[2].c + 4, 'a': e[2].a || 'D', 'r': e[2].r}, {'c': case when x = 's' then e[1].c + keep else 1000000 end, 'a': e[1].a || 'K', 'r': e[1].r || line}]),
    list_min([{'c': e[3].c + 4, 'a': e[3].a || 'D', 'r': e[3].r},
      {'c': case when x = 'u' then e[1].c + keep else 1000000 end, 'a': e[1].a || 'K', 'r': e[1].r || line},
      {'c': case when x = 'u' then e[2].c + keep else 1000000 end, 'a': e[2].a || 'K', 'r': e[2].r || line},
      {'c': case when x = 'u' then e[4].c + keep else 1000000 end, 'a': e[4].a || 'K', 'r': e[4].r || line},
      {'c': e[1].c + keep + 3, 'a': e[1].a || 'R', 'r': e[1].r || chr(10) || 'user:' || text},
      {'c': e[2].c + keep + 3, 'a': e[2].a || 'R', 'r': e[2].r || chr(10) || 'user:' || text},
      {'c': e[4].c + keep + 3, 'a': e[4].a || 'R', 'r': e[4].r || chr(10) || 'user:' || text}]),
    list_min([{'c': e[4].c + 4, 'a': e[4].a || 'D', 'r': e[4].r},
      {'c': case when x = 'a' then e[3].c + keep else 1000000 end, 'a': e[3].a || 'K', 'r': e[3].r || line},
      {'c': e[3].c + keep + 3, 'a': e[3].a || 'R', 'r': e[3].r || chr(10) || 'assistant:' || text}])]
  from (
    select f.conv_id, f.i, x, text, chr(10) || role || ':' || text as line, case fault when '' then 0 when 'truncated' then 3 else 900000 end as keep, [
      s[1], s[2],
      list_min([s[3]] || [{'c': q.c + 3, 'a': q.a || 'I', 'r': q.r || chr(10) || 'user:'} for q in [s[1], s[2], s[4]]]),
      list_min([s[4], {'c': s[3].c + 3, 'a': s[3].a || 'I', 'r': s[3].r || chr(10) || 'assistant:'}]
        || [{'c': q.c + 6, 'a': q.a || 'II', 'r': q.r || chr(10) || 'user:' || chr(10) || 'assistant:'} for q in [s[1], s[2]]])] as e
    from step join f on f.conv_id is not distinct from step.conv_id and f.i = step.i + 1)),
z as (
  select v.*, list_min([s[1], s[4], {'c': s[3].c + 3, 'a': s[3].a || 'I', 'r': s[3].r || chr(10) || 'assistant:'},
    {'c': s[2].c + 6, 'a': s[2].a || 'II', 'r': s[2].r || chr(10) || 'user:' || chr(10) || 'assistant:'}]) as best
  from v join step on v.conv_id is not distinct from step.conv_id and v.n = step.i)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(substr(coalesce(best.r, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) a left join z on a.conv_id is not distinct from z.conv_id left join g on a.conv_id is not distinct from g.conv_id
"""

SQL_OP13 = r"""
with i as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
d as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
n as (select count(*) as documents, sum(len(terms))::bigint as total from d where len(terms) > 0),
p as (
  select doc_id, r, len(terms) as length, unnest(terms) as term from d),
f as (select doc_id, r, length, term, count(*) as tf from p where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * (select documents from n) + 2) / (2 * count(*) + 1)::double))::bigint as weight from f group by term),
s as (
  select i.item_id, f.doc_id, f.r, sum(w.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * f.length * (select documents from n)) // (select total from n)))))::bigint as score
  from i join f using (term) join w using (term) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id nulls last) <= 10
"""

ORACLE_SQL: dict[str, str] = {"op3_mixing": SQL_OP3, "op7_chat": SQL_OP7, "op11_repeats": SQL_OP11, "op12_repair": SQL_OP12, "op13_search": SQL_OP13}
