"""The catalogue's tables: append-only event logs, runs, sources, seeds. Parquet tables or JSON lines under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.operations import first_by

SALTS = 32
EVENT_SCHEMA = "id string, property_key string, kind string, event_date string, recorded_at string, source_id string, source_label string, as_of string, run_id string, amount double, confidence double, details map<string,string>"


def read_log(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(events, bad): a JSON-lines log, each id once (first in order of record), and the lines that can't be read."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where("_bad is null and id is not null").drop("_bad")
    raw = spark.read.text(path)
    bad = raw.where(F.trim("value") != "").where(F.try_parse_json("value").isNull() | F.get_json_object("value", "$.id").isNull()).select(F.col("value").alias("line"))
    return first_by(good, ["id"], "recorded_at"), bad


def write_events(events: DataFrame, path: str) -> None:
    """Appends events to a table laid out by county, so that compiling one county reads its folder alone. A county's properties are
    dealt over SALTS tasks, so a county with a third of all events isn't one task's."""
    county = F.substring_index("property_key", "|", 1)
    salt = F.pmod(F.xxhash64("property_key"), F.lit(SALTS))
    events.withColumn("county", county).repartition("county", salt).write.mode("append").partitionBy("county").parquet(path)


def plan_seed(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """seed (id, name, url, ...) with plan: create, skip (known) or reject (no id, name or http url)."""
    bad = (F.coalesce(F.trim("id"), F.lit("")) == "") | (F.coalesce(F.trim("name"), F.lit("")) == "") | ~F.coalesce(F.col("url").rlike("^(render\\+)?(https?|file)://"), F.lit(False))
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    return seed.join(known, "id", "left").withColumn("plan", F.when(bad, "reject").when(F.col("known"), "skip").otherwise("create")).drop("known")


def with_source_ids(sources: DataFrame) -> DataFrame:
    """Sources (name, url) with an id: the name's slug and six digits of the address's hash."""
    return sources.withColumn("id", F.concat(slug(F.col("name")), F.lit("_"), F.substring(F.sha2("url", 256), 1, 6)))


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(class, path, body): files under a folder for each class."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.col("length") <= 32 * 1024 * 1024).select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("class"), "path", F.decode("content", "UTF-8").alias("body"))


def scan_files(spark: SparkSession, path: str, most: int = 32 * 1024 * 1024) -> DataFrame:
    """(path, body, error) of files under a path, bodies binary; larger ones than `most` have an error and no body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > most
    return files.select("path", F.when(~large, F.col("content")).alias("body"), F.when(large, F.concat(F.lit("body over "), F.lit(most), F.lit(" bytes"))).alias("error"))


CORPUS = "domain string, name string, display string, values array<string>, label string, label_source string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus of labelled columns, JSON lines; lines that can't be read are left out."""
    return spark.read.schema(CORPUS).option("mode", "DROPMALFORMED").json(path).where("name is not null")


def append_corpus(columns: DataFrame, path: str) -> None:
    columns.select(*[f.split(" ")[0] for f in CORPUS.split(", ")]).write.mode("append").json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, classifications, fields, fault) of an answer key {"sources": [{id, classification, fields}]}, whose labels are a
    string or a list of them. fault: no id, a repeated id, or no classification."""
    many = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))
    schema = "sources array<struct<id:string,classification:string,fields:map<string,string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["sources"]).alias("s")).select(F.coalesce("s.id", F.lit("")).alias("source_id"), many(F.col("s.classification")).alias("classifications"), F.transform_values("s.fields", lambda k, v: many(v)).alias("fields"))
    times = F.count("*").over(Window.partitionBy("source_id"))
    fault = F.when(F.col("source_id") == "", "no id").when(times > 1, "repeated id").when(F.coalesce(F.size("classifications"), F.lit(0)) == 0, "no classification")
    return rows.withColumn("fault", fault)


def keep_bodies(fetched: DataFrame, path: str) -> None:
    """Raw bodies (source_id, body) under their content's hash, each once, dealt over 256 folders of its first digits."""
    hashed = fetched.where("body is not null").select(F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"), F.col("body").cast("binary").alias("body")).dropDuplicates(["body_hash"])
    hashed.withColumn("shelf", F.substring("body_hash", 1, 2)).write.mode("append").partitionBy("shelf").parquet(path)


def kept_bodies(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """(body_hash, body) of wanted hashes (body_hash); copies that parallel writers stored are one."""
    return first_by(spark.read.parquet(path).join(hashes.select("body_hash").distinct(), "body_hash", "left_semi"), ["body_hash"], "shelf").select("body_hash", "body")


def snapshots(runs: DataFrame, cells: DataFrame, rates: DataFrame, sample: int = 12) -> DataFrame:
    """(source_id, snapshot) as JSON: a run (source_id, run_id, at, format, container, label, confidence), the labels of its document,
    the first `sample` cells of its first record, and its fields' rates. cells: (source_id, record, label_ord, label, value); rates:
    (source_id, field, rate)."""
    labels = cells.select("source_id", "label_ord", "label").distinct().groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("label_ord", "label")))["label"].alias("labels"))
    first = cells.where("record = 0").groupBy("source_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("label_ord", "label", "value"))), 1, sample).alias("c"))
    first = first.select("source_id", F.transform("c", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("raw_sample"))
    of = rates.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "rate")))).alias("field_rates"))
    rows = runs.join(labels, "source_id", "left").join(first, "source_id", "left").join(of, "source_id", "left")
    told = F.struct("at", "run_id", "format", "container", "labels", "raw_sample", F.struct("label", "confidence").alias("classification"), "field_rates")
    return rows.select("source_id", F.to_json(told).alias("snapshot"))


def save_model(hits: DataFrame, totals: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").parquet(f"{path}/hits")
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved classifier's (hits, totals); one that doesn't add up raises: counts below one, or a class whose tokens aren't its hits'."""
    hits, totals = spark.read.parquet(f"{path}/hits"), spark.read.parquet(f"{path}/totals")
    sums = hits.groupBy(F.col("class").alias("of_class")).agg(F.sum("hits").alias("sum"), F.min("hits").alias("least"))
    bad = sums.join(totals, F.col("of_class").eqNullSafe(F.col("class")), "full").where((F.coalesce("sum", F.lit(0)) != F.coalesce("tokens", F.lit(-1))) | (F.coalesce("least", F.lit(1)) < 1) | (F.coalesce("docs", F.lit(0)) < 1))
    if bad.limit(1).count():
        raise ValueError(f"the model at {path} doesn't add up")
    return hits, totals


def same_pages(pages: DataFrame) -> DataFrame:
    """Cells of pages (source_id, page, record, label, value) as far as every page has the labels of the source's first one: pages from
    the first that differs on are left out, as their rows would be another table's."""
    shape = pages.groupBy("source_id", "page").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    firsts = shape.groupBy("source_id").agg(F.min_by("labels", "page").alias("first_labels"))
    stop = shape.join(firsts, "source_id").where("labels != first_labels").groupBy("source_id").agg(F.min("page").alias("stop"))
    return pages.join(stop, "source_id", "left").where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")
