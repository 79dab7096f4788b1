"""Queries on documents, cells, pages and conversations: scalars, naive Bayes, mapping, projections, crawling, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sql
from ..functions import text, values
from ..operators import classify, conversations, mapping
from ..operators.shared import written
from ..sources import api, formats, web
from .derived import table


def slug_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    whole = F.col("text")
    return d.select("doc_id", text.slug(whole).alias("slug"), text.collapse(whole).alias("collapsed"), F.size(text.words(whole)).alias("n_words"))


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    plain = F.concat((F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    shape = F.element_at(F.array(plain, F.concat(F.lit("$ "), plain), F.concat(F.lit("("), plain, F.lit(")")), F.concat(F.lit("-"), plain), F.concat(plain, F.lit(" USD")), F.concat(F.lit("$$"), plain), F.concat(F.lit("1-"), plain)), (k % 7 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(k, shape.alias("shown"))
    return o.select("o_orderkey", "shown", values.parse_money(F.col("shown")).alias("amount"), values.validate("money", F.col("shown")).alias("valid"))


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    fmt = lambda f: F.date_format(day, f)
    shape = F.element_at(F.array(fmt("yyyy-MM-dd"), fmt("yyyy/M/d"), fmt("M/d/yyyy"), fmt("MM-dd-yyyy"), fmt("MMMM d, yyyy"), fmt("d MMM yyyy"), F.concat(fmt("yyyy-MM-dd"), F.lit("T10:30:00Z")), F.concat(fmt("yyyy-MM-dd"), F.lit(" junk")), F.concat(fmt("yyyy"), F.lit("-02-31"))), (k % 9 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(k, day, shape.alias("shown"))
    return o.select("o_orderkey", "shown", values.parse_date(F.col("shown")).alias("iso"))


def kind_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds accept each distinct word of the documents; money and dates have queries of their own."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("v")).where("v != ''").distinct()
    kinds = ("id", "name", "status", "text", "phone", "email", "address", "number")
    return w.select("v", *[values.validate(k, F.col("v")).alias(f"is_{k}") for k in kinds])


def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    shown = F.when(k % 3 == 0, F.concat(F.lit("Case: "), k.cast("string"), F.lit("-A"))).when(k % 3 == 1, F.concat(F.lit("no ("), (k + 1000).cast("string"), F.lit("),"))).otherwise("none given")
    c = table(spark, sf_dir, "orders").select(k, values.coerce("id", shown).alias("c"))
    return c.select("o_orderkey", "c.ok", F.when(F.col("c.ok"), F.col("c.value")).alias("value"), "c.reformatted")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells of seven sources that use their own labels."""
    k = F.col("o_orderkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 2 + 1).cast("int"))
    cell = lambda i, label, value: F.struct(F.lit(i).alias("label_ord"), label.alias("label"), value.alias("value"))
    o = table(spark, sf_dir, "orders")
    row = F.array(
        cell(0, pick("Parcel Number", "apn"), F.concat(F.lit("P-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))),
        cell(1, pick("Balance Due", "amount owed"), F.when(k % 11 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(15,2)").cast("string")))),
        cell(2, pick("Filed Date", "date"), F.date_format("o_orderdate", "M/d/yyyy")),
        cell(3, pick("Status", "Disposition"), F.when(F.col("o_orderstatus") == "F", "sold").otherwise("open")),
        cell(4, pick("Lat Lon", "lat lon"), F.concat((k % 90).cast("string"), F.lit(".5, -"), (k % 180).cast("string"), F.lit(".25"))),
    )
    return o.select(F.concat(F.lit("s"), (k % 14).cast("string")).alias("source_id"), k.alias("record"), F.explode(row).alias("c")).select("source_id", "record", "c.label_ord", "c.label", "c.value")


def value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mapping.samples(cells(spark, sf_dir))
    return s.groupBy("source_id", "label").agg(F.count("*").alias("sampled"), F.avg(values.validate("money", F.col("value")).cast("double")).alias("money_rate"), F.max("record").alias("last_record"))


def part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.part_counts(mapping.samples(cells(spark, sf_dir)))


def infer_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mapping.infer_mapping(cells(spark, sf_dir), mapping.schema_fields(spark))
    return m.select("source_id", "name", "label", "part", F.round("confidence", 6).alias("confidence"))


def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, c = mapping.schema_fields(spark), cells(spark, sf_dir)
    r = mapping.extract(c, mapping.infer_mapping(c, fields), fields)
    get = lambda f: F.element_at("canonical", f)
    return r.select("source_id", "record", get("parcel_id").alias("parcel_id"), get("amount_due").alias("amount_due"), get("event_date").alias("event_date"), F.round("completeness", 6).alias("completeness"))


def extracted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells all the way to property events."""
    fields, c = mapping.schema_fields(spark), cells(spark, sf_dir)
    r = mapping.extract(c, mapping.infer_mapping(c, fields), fields)
    sources = c.select("source_id").distinct().select("source_id", F.lit("Elm County").alias("jurisdiction"), F.lit("tax_delinquency").alias("label"), F.lit("2024").alias("as_of"), F.lit("2024-01-01T00:00:00Z").alias("recorded_at"), F.lit(0.9).alias("confidence"))
    return mapping.build_events(r, fields, sources).select("property_key", "kind", "event_date", "source_id", "amount")


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("lang").alias("class"), "text")
    return d.select("doc", "class"), written(classify.bags(d, "doc", F.col("text"), "class", limit=None))


def nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of each class; the words of a text are counted in place."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    return d.groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("docs"), F.sum(F.size(classify.body_tokens(F.col("text"), None)).cast("long")).alias("tokens"))


def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with even identifiers by the model of odd ones, and the other way round."""
    labels, bag = (t.withColumn("fold", F.pmod("doc", F.lit(2))) for t in labelled(spark, sf_dir))
    hits, totals = classify.train(bag.withColumn("fold", 1 - F.col("fold")), labels.withColumn("fold", 1 - F.col("fold")), ["fold"])
    p = classify.predict(labels, bag.drop("class"), hits, totals, by=["fold"])
    return p.where("place = 1").select("doc", "class", F.round("probability", 6).alias("probability"))


def nb_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("lang").alias("class"), "text")
    texts, labels = classify.text_blocks(d, "doc", F.col("text"), "class", limit=None), d.select("doc", "class")
    p = classify.leave_one_out(labels, texts, *classify.train(texts, labels))
    return p.where("place = 1").join(labels.withColumnRenamed("class", "truth"), "doc").select("doc", "truth", F.col("class").alias("guess"), F.round("probability", 6).alias("probability"))


def nb_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null").withColumn("class", F.col("lang"))
    hits = written(classify.train(classify.tokens(d, "doc_id", F.col("text"), "class", limit=None), d)[0])
    return classify.vocabulary(*classify.train(hits.withColumnRenamed("hits", "n"), d), 20).withColumn("lift", F.round("lift", 6))


def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the quality label predicts the toxic one: plain scores of two label columns."""
    pairs = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("guess"))
    s = classify.scores(pairs)
    return s.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat objects without a parser: keys in order, values as text."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("label", "value"))


#: Keys that one body spans, so that its size doesn't grow with the table.
BODY_KEYS = 20_000


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as JSON documents, market segments as CSV ones, of up to BODY_KEYS keys each."""
    part = lambda key: F.floor(F.col(key) / BODY_KEYS).cast("string")
    e = table(spark, sf_dir, "events")
    js = e.groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 50).cast("string"), F.lit("-"), part("event_id")).alias("source_id")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(F.struct("event_id", "value", F.struct("user_id").alias("who")))).alias("rows"))).alias("body"))
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(', Mr"')), F.col("c_acctbal").cast("string"))
    cs = c.groupBy(F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.lit("-"), part("c_custkey")).alias("source_id")).agg(F.concat(F.lit("key,name,balance\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("body"))
    return js.unionByName(cs).select("source_id", F.lit("").alias("content_type"), "body")


def parsed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents through detection and parsing."""
    cells = formats.parse_documents(bodies(spark, sf_dir))
    return cells.groupBy("format", "label").agg(F.count("*").alias("cells"), F.countDistinct("source_id").alias("documents"))


def sql_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents from SQL: a table function over the table of them."""
    sql.register(spark, "detect_format", "parse_documents")
    return spark.sql("""
        select format, label, count(*) as cells, count(distinct source_id) as documents
        from parse_documents(table(select source_id, detect_format(content_type, body) as format, body from {docs})) group by format, label""", docs=bodies(spark, sf_dir))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through the functions that SQL can call."""
    sql.register(spark, "slug", "parse_money", "property_key", "jaro_winkler", "validate_id")
    return spark.sql("""
        select c_custkey, slug(c_name) as slug, parse_money('$' || cast(cast(abs(c_acctbal) as decimal(15, 2)) as string)) as amount, property_key(c_mktsegment || ' County', 'P-' || c_custkey, null) as property,
          round(jaro_winkler(c_mktsegment, substring(c_mktsegment, 1, 4)), 6) as likeness, validate_id('P-' || c_custkey) as plausible
        from {customer}""", customer=table(spark, sf_dir, "customer"))


def page_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", formats.page_projection(F.col("html")).alias("p"), formats.script_shell(F.col("html")).alias("shell"))
    return p.select("page_id", F.col("p.title").alias("title"), F.size("p.headings").alias("headings"), F.array_join("p.links", " ").alias("links"), F.col("p.items").alias("items"), "shell")


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host linked in a ring, crawled from its first page for four rounds and twelve pages at most; robots rules close one path."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*", "").alias("url"), "html")
    h = web.host(F.col("url"))
    after = Window.partitionBy(h).orderBy("page_id")
    both = p.select("url", F.lead("url").over(after).alias("a"), F.lead("url", 3).over(after).alias("b"))
    edges = both.select("url", F.posexplode(F.array("a", "b")).alias("place", "target")).where("target is not null")
    seeds = p.groupBy(h.alias("h")).agg(F.min_by("url", "page_id").alias("url")).select("url")
    text = F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-Agent: *\nCrawl-delay: 2\nDisallow: /de\nAllow: /de/a"))
    rules = p.select(h.alias("host")).distinct().select("host", web.robots(text, "recordloom/1.0")["rules"].alias("rules"))
    pages = p.groupBy("url").agg(F.min(F.sha2("html", 256)).alias("body_hash"), F.min("page_id").alias("page_id")).select("url", "body_hash", (F.col("page_id") % 9 != 4).alias("follow"))
    return web.crawl(seeds, pages, edges, 4, 12, rules=rules)


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.paged(table(spark, sf_dir, "orders").select("o_orderkey"), 1000)


def joined_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as pages of four, joined up to ten; every fifth customer's second page fails."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor((F.row_number().over(w) - 1) / 4).cast("int").alias("page"))
    pages = o.groupBy(F.col("o_custkey").alias("source_id"), "page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("o_orderkey")))).alias("body"))
    failed = (F.col("source_id") % 5 == 0) & (F.col("page") == 1)
    pages = pages.select("source_id", "page", F.lit(True).alias("allowed"), F.when(failed, 503).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"), F.lit("application/json").alias("content_type"), "body")
    keys = F.from_json("body", "array<struct<o_orderkey: bigint>>")
    return api.joined_pages(pages, 4, 10).select("source_id", "ok", F.size(keys).alias("records"), F.array_max(F.transform(keys, lambda x: x["o_orderkey"])).alias("last"), "truncated", "pages")


def turn_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations have nine turns at most, so they are folded beyond four."""
    return conversations.compacted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), most=4, keep=2)


QUERIES = {f.__name__: f for f in (slug_tokens, money_parse, date_parse, kind_validate, coerce_values, value_samples, part_counts, infer_mapping, extract_records, extracted_events, nb_counts, nb_predict, nb_leave_one_out, nb_vocabulary, confusion_f1, json_flatten, parsed_bodies, sql_documents, sql_functions, page_projection, crawl_frontier, api_pages, joined_bodies, turn_compaction)}

WORDS = "list_transform(regexp_extract_all(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda w: lower(w))"
STOP = ", ".join(f"'{w}'" for w in classify.STOP)
SQL_BAG = f"""
tk as (select doc_id as doc, lang as class, list_filter({WORDS.format("coalesce(text, '')")}, lambda w: length(w) >= 2 and not list_contains([{STOP}], w) and not regexp_matches(w, '^[0-9]+$')) as ts from documents where doc_id is not null),
bag as (select doc, class, token, count(*) as n from (select doc, class, unnest(ts) as token from tk) group by all)
"""
SQL_CELLS = """
ce as (
  select 's' || (o_orderkey % 14) as source_id, o_orderkey as record, o_orderkey % 2 as odd, 'P-' || lpad(cast(o_custkey as varchar), 6, '0') as parcel,
    case when o_orderkey % 11 = 0 then null else cast(o_totalprice as decimal(15, 2)) end as amount, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderstatus
  from orders)
"""
TRIM = "regexp_replace(regexp_replace({}, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')"

ORACLE_SQL = {
    "slug_tokens": f"""select doc_id, array_to_string({WORDS.format('text')}, '_') as slug, regexp_replace({TRIM.format('text')},'[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') as collapsed,
  cast(len({WORDS.format('text')}) as integer) as n_words from documents""",
    "money_parse": """with c as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders), p as (select *, cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0') as plain, o_orderkey % 7 as k from c)
select o_orderkey, [plain, '$ ' || plain, '(' || plain || ')', '-' || plain, plain || ' USD', '$$' || plain, '1-' || plain][k + 1] as shown,
  case when k in (0, 1) then cast(plain as double) when k in (2, 3) then -cast(plain as double) end as amount, k in (0, 1) as valid from p""",
    "date_parse": """select o_orderkey, [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y/%-m/%-d'), strftime(o_orderdate, '%-m/%-d/%Y'), strftime(o_orderdate, '%m-%d-%Y'), strftime(o_orderdate, '%B %-d, %Y'), strftime(o_orderdate, '%-d %b %Y'),
  strftime(o_orderdate, '%Y-%m-%dT10:30:00Z'), strftime(o_orderdate, '%Y-%m-%d junk'), strftime(o_orderdate, '%Y-02-31')][o_orderkey % 9 + 1] as shown, case when o_orderkey % 9 < 7 then strftime(o_orderdate, '%Y-%m-%d') end as iso from orders""",
    "kind_validate": """with w as (select distinct unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) as v from documents), f as (select v, strlen(v) as n, length(regexp_replace(v, '[^0-9]', '', 'g')) as d, regexp_matches(v, '[A-Za-z]') as alpha from w where v <> '')
select v, n between 3 and 30 and not contains(v, '$') and d >= 2 and d * 10 >= n * 4 and not regexp_matches(v, '^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$') as is_id, n between 2 and 80 and alpha and not contains(v, '$') and d * 2 <= n as is_name,
  n <= 60 and alpha as is_status, n >= 3 as is_text, n between 5 and 120 and alpha and d >= 1 and d * 2 <= n as is_address, n <= 40 and regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?0[xX]([0-9a-fA-F]+[.]?[0-9a-fA-F]*|[.][0-9a-fA-F]+)([pP][+-]?[0-9]+)?$') as is_number, d between 10 and 15 and regexp_matches(v, '^[-0-9() +.xX]*$') as is_phone,
  n between 6 and 254 and regexp_matches(v, '^[^@ ]+@[^@ ]+[.][^@. ]{2,}$') as is_email from f""",
    "coerce_values": """with s as (select o_orderkey, o_orderkey % 3 as k, cast(o_orderkey as varchar) as own, cast(o_orderkey + 1000 as varchar) as more from orders),
t as (select *, length(own) * 10 >= (length(own) + 8) * 4 and length(own) >= 2 as whole from s)
select o_orderkey, case k when 0 then length(own) >= 2 when 1 then true else false end as ok, case when k = 0 and length(own) >= 2 then case when whole then 'CASE: ' || own || '-A' else own || '-A' end when k = 1 then 'NO (' || more || '),' end as value,
  k = 0 and length(own) >= 2 and not whole as reformatted from t""",
    "value_samples": "with " + SQL_CELLS + """, l as (select source_id, record, unnest(case when odd = 0 then ['Parcel Number', 'Balance Due', 'Filed Date', 'Status', 'Lat Lon'] else ['apn', 'amount owed', 'date', 'Disposition', 'lat lon'] end) as label, unnest([false, amount is not null, false, false, false]) as money from ce),
r as (select *, row_number() over (partition by source_id, label order by record) as n from l)
select source_id, label, count(*) as sampled, avg(case when money then 1.0 else 0.0 end) as money_rate, max(record) as last_record from r where n <= 25 group by all""",
    "part_counts": "with " + SQL_CELLS + "select source_id, unnest(case when odd = 0 then ['Parcel Number', 'Balance Due', 'Filed Date', 'Status', 'Lat Lon'] else ['apn', 'amount owed', 'date', 'Disposition', 'lat lon'] end) as label, cast(unnest([0, 0, 0, 0, 2]) as integer) as parts from (select distinct source_id, odd from ce)",
    "extracted_events": "with " + SQL_CELLS + "select 'elm_county|p:' || replace(parcel, '-', '') as property_key, 'tax_delinquency' as kind, day as event_date, source_id, coalesce(cast(amount as double), 0.0) as amount from ce",
    "infer_mapping": "with " + SQL_CELLS + """, l as (select source_id, odd, avg(case when amount is not null then 1.0 else 0.0 end) as paid from (select *, row_number() over (partition by source_id order by record) as n from ce) where n <= 25 group by source_id, odd)
select source_id, unnest(['parcel_id', 'amount_due', 'event_date', 'status', 'latitude', 'longitude']) as name, unnest(case when odd = 0 then ['Parcel Number', 'Balance Due', 'Filed Date', 'Status', 'Lat Lon', 'Lat Lon'] else ['apn', 'amount owed', 'date', 'Disposition', 'lat lon', 'lat lon'] end) as label,
  unnest([-1, -1, -1, -1, 0, 1])::integer as part, unnest([1.0::double, round(0.55 + 0.45 * paid, 6), 1.0, 1.0, 1.0, 1.0]) as confidence from l""",
    "extract_records": "with " + SQL_CELLS + "select source_id, record, parcel as parcel_id, cast(amount as varchar) as amount_due, day as event_date, round((6 - case when amount is null then 1 else 0 end) / 6.0::double, 6) as completeness from ce",
    "nb_counts": "with " + SQL_BAG + "select class, (select count(*) from documents d where d.lang is not distinct from b.class and doc_id is not null) as docs, cast(sum(n) as bigint) as tokens from bag b group by class",
    "nb_predict": "with " + SQL_BAG + """,
h as (select 1 - doc % 2 as fold, class, token, sum(n) as hits from bag group by all), t as (select fold, class, sum(hits) as tokens from h group by all), d as (select 1 - doc % 2 as fold, class, count(*) as docs from tk group by all),
v as (select fold, count(distinct token) as v from h group by fold), a as (select fold, sum(docs) as all_docs from d group by fold),
c as (select d.fold, d.class, ln(d.docs / a.all_docs) as prior, t.tokens + v.v as den from d join t using (fold, class) join v using (fold) join a using (fold)),
z as (select distinct fold, token from h), k as (select b.doc, b.token, b.n, z.fold from bag b join z on z.token = b.token and z.fold = b.doc % 2),
l as (select k.doc, c.class, sum(k.n * ln((coalesce(h.hits, 0) + 1.0) / c.den)) as lift from k join c on c.fold = k.fold left join h on h.fold = k.fold and h.token = k.token and h.class = c.class group by all),
s as (select tk.doc, c.class, c.prior + coalesce(l.lift, 0) as score from tk join c on c.fold = tk.doc % 2 left join l on l.doc = tk.doc and l.class = c.class),
p as (select doc, class, exp(score - max(score) over (partition by doc)) as e from s), q as (select doc, class, e / sum(e) over (partition by doc) as probability from p)
select doc, class, round(probability, 6) as probability from (select *, row_number() over (partition by doc order by probability desc, class) as n from q) where n = 1""",
    "nb_leave_one_out": "with " + SQL_BAG + """,
h as (select class, token, sum(n) as hits from bag group by all), t as (select class, sum(hits) as tokens from h group by class), d as (select class, count(*) as docs from tk group by class),
f as (select token, count(distinct doc) as df from bag group by token), v as (select count(*) as v from f), a as (select count(*) as all_docs from tk),
o as (select tk.doc, tk.class as truth, coalesce(sum(n), 0) as own, coalesce(sum(case when df = 1 then 1 else 0 end), 0) as lone from tk left join bag b on b.doc = tk.doc left join f on f.token = b.token group by all),
k as (select b.doc, b.class as truth, b.token, b.n from bag b join f using (token) where df > 1),
c as (select o.doc, o.truth, d.class, d.docs - (d.class = o.truth)::int as docs, t.tokens - case when d.class = o.truth then own else 0 end + (select v from v) - lone as den from o cross join d join t on t.class = d.class),
x as (select c.doc, c.truth, c.class, c.docs, sum(k.n * ln((coalesce(h.hits, 0) - case when c.class = c.truth then k.n else 0 end + 1.0) / c.den)) as lift from c left join k on k.doc = c.doc left join h on h.token = k.token and h.class = c.class where c.docs > 0 group by all),
s as (select doc, truth, class, ln(docs / ((select all_docs from a) - 1)) + coalesce(lift, 0) as score from x),
p as (select *, exp(score - max(score) over (partition by doc)) as e from s), q as (select *, e / sum(e) over (partition by doc) as probability from p)
select doc, truth, class as guess, round(probability, 6) as probability from (select *, row_number() over (partition by doc order by probability desc, class) as n from q) where n = 1""",
    "nb_vocabulary": "with " + SQL_BAG + """,
h as (select class, token, sum(n) as hits from bag group by all), w as (select *, sum(hits) over (partition by token) as everywhere, sum(hits) over (partition by class) as tokens, sum(hits) over () as all_tokens from h),
l as (select class, token, cast(hits as bigint) as hits, (hits / tokens) / (everywhere / all_tokens) as lift from w where hits >= 2),
r as (select *, row_number() over (partition by class order by round(lift * ln(1 + hits), 9) desc, token) as place from l)
select class, token, hits, round(lift, 6) as lift, cast(place as integer) as place from r where place <= 20""",
    "confusion_f1": """with p as (select cast(quality as varchar) as truth, cast(toxic as varchar) as guess from labels), c as (select distinct truth as class from p union select distinct guess from p),
n as (select class, (select count(*) from p where truth = class) as t, (select count(*) from p where guess = class) as g, (select count(*) from p where truth = class and guess = class) as tp from c),
r as (select class, case when g > 0 then tp / g else 0.0 end as precision, case when t > 0 then tp / t else 0.0 end as recall, t as support from n)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 6) as f1, support from r""",
    "json_flatten": "select event_id, key as label, json_extract_string(props, '$.' || key) as value from (select event_id, props, unnest(json_keys(props)) as key from events)",
    "parsed_bodies": """with e as (select event_type || '-' || (user_id % 50) || '-' || (event_id // 20000) as source_id, event_id, value, user_id from events),
j as (select source_id, unnest(['event_id', 'value', 'who.user_id']) as label, unnest([event_id is not null, value is not null, user_id is not null]) as held from e),
c as (select distinct c_mktsegment || '-' || c_nationkey || '-' || (c_custkey // 20000) as source_id from customer)
select 'json' as format, label, count(*) as cells, count(distinct source_id) as documents from j where held group by label union all select 'text', null, count(*), count(*) from c""",
    "sql_functions": """select c_custkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(c_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda w: lower(w)), '_') as slug,
  cast(abs(cast(c_acctbal as decimal(15, 2))) as double) as amount, lower(c_mktsegment) || '_county|p:P' || c_custkey as property, round(0.4 + 0.6 * (4.0 / length(c_mktsegment) + 2) / 3, 6) as likeness,
  length(shown) between 3 and 30 and not contains(shown, '$') and length(regexp_replace(shown, '[^0-9]', '', 'g')) >= 2 and length(regexp_replace(shown, '[^0-9]', '', 'g')) * 10 >= length(shown) * 4
    and not regexp_matches(shown, '^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$') as plausible from (select *, 'P-' || c_custkey as shown from customer)""",
    "api_pages": """with n as (select count(*) as upto from orders), p as (select upto, unnest(range(0, cast(upto // 1000 as bigint) + 1)) as page from n)
select cast(page as integer) as page, least(1000, upto - page * 1000) as n, case when upto - page * 1000 < 1000 then 'short' else 'next' end as stop from p""",
    "joined_bodies": """with o as (select o_custkey as source_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders),
k as (select *, case when source_id % 5 = 0 and n > 4 then 4 else least(n, 10) end as kept from o)
select source_id, true as ok, any_value(kept)::integer as records, max(o_orderkey) filter (i <= kept) as last, any_value(case when source_id % 5 = 0 then n >= 4 else n > 10 or n % 4 = 0 end) as truncated, ceil(any_value(kept) / 4)::integer as pages from k group by source_id""",
    "turn_compaction": """with c as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn, role, text) as pos from conversations),
f as (select conv_id, count(*) filter (n <= 4 or pos > n - 2) as kept, coalesce(string_agg(role || ': ' || text, chr(10) order by pos) filter (n > 4 and pos <= n - 2), '') as summary from c group by conv_id)
select conv_id, kept, right(summary, 2400) as summary from f""",
    "page_projection": r"""with p as (select page_id, html, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"''#]+)', 1) as l,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g') as bare from pages)
select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as title,
  cast(len(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>')) as integer) as headings, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as links,
  cast(len(regexp_extract_all(html, '(?i)<li\b')) as integer) as items,
  regexp_matches(lower(html), 'id="(root|app|__next)"\s*>\s*</div>|data-reactroot|ng-app') or strlen(trim(bare)) * 4 < strlen(array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1), '')) as shell from p""",
    "crawl_frontier": r"""with recursive u as (select page_id, regexp_replace(url, '#.*', '') as url, html from pages), p as (select page_id, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as h from u),
e as (select url, lead(url) over (partition by h order by page_id) as a, lead(url, 3) over (partition by h order by page_id) as b from p),
g as (select url, target, min(place) as place from (select url, unnest([a, b]) as target, unnest([0, 1]) as place from e) where target is not null group by all),
ls as (select url, list(target order by place, target) as targets from g group by url),
b as (select url, min(sha256(html)) as body, min(page_id) % 9 <> 4 as follow, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as path from u group by url),
st as (
  select arg_min(url, page_id) as seed, 0 as i, [{'u': arg_min(url, page_id), 'd': 0}] as q, []::varchar[] as bodies, null::varchar as url, null::integer as depth, null::varchar as outcome from p group by h
  union all
  select seed, i + 1, case when outcome = 'fetched' and coalesce(b.follow, false) and q[i + 1].d < 4 then q || list_transform(list_distinct_kept[1:96 - len(q)], lambda t: {'u': t, 'd': q[i + 1].d + 1}) else q end,
    case when outcome = 'fetched' then list_append(bodies, b.body) else bodies end, q[i + 1].u, q[i + 1].d, outcome
  from (select st.* exclude (url, depth, outcome), b, list_filter(coalesce(ls.targets, []), lambda t: not list_contains(list_transform(q, lambda x: x.u), t)) as list_distinct_kept,
      case when starts_with(b.path, '/de') and not starts_with(b.path, '/de/a') then 'robots' when b.url is null then 'failed' when list_contains(bodies, b.body) then 'duplicate' else 'fetched' end as outcome
    from st left join b on b.url = q[i + 1].u left join ls on ls.url = q[i + 1].u where i < len(q) and len(bodies) < 12))
select seed, url, depth, i::bigint as place, outcome from st where i > 0""",
}
ORACLE_SQL["sql_documents"] = ORACLE_SQL["parsed_bodies"]
