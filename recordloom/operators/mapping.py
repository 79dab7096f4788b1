"""Mapping a source's own column labels onto a canonical schema by measured evidence.

cells: (source_id, record, label_ord, label, value), one row for each cell. fields: (field_ord, name, kind, role, identity,
authority, synonyms, low, high), the schema as configuration. Label similarity runs over distinct pairs only; values are
sampled per label, so evidence costs the same for any number of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..functions.text import let, split_parts, trim, words
from ..functions.values import KINDS, WEAK, chosen, money_text, normalize, parse_money
from .shared import written

# Weights and limits of the evidence.
ACCEPT, ACCEPT_PART, LABEL_WEIGHT, VALUE_WEIGHT, SAMPLE, WEAK_FLOOR, MAX_PARTS, NEURAL_GATE = 0.65, 0.80, 0.55, 0.45, 25, 0.70, 6, 0.7
TOKEN_LEAST, SLUG_LEAST = 0.92, 0.90

#: A default schema: name, kind, role, identity, authority, synonyms, range.
SCHEMA = (
    ("parcel_id", "id", "parcel", True, "", ("parcel", "parcel number", "apn", "pin", "account number"), None, None),
    ("address", "address", "address", True, "", ("property address", "situs", "situs address", "location", "site address"), None, None),
    ("zip", "id", "", False, "", ("zip code", "postal code"), None, None),
    ("owner", "name", "owner", False, "deed_transfer", ("owner name", "taxpayer", "owner of record"), None, None),
    ("mailing_address", "address", "", False, "", ("mailing address", "owner address"), None, None),
    ("owner_phone", "phone", "", False, "", ("phone", "telephone"), None, None),
    ("owner_email", "email", "", False, "", ("email", "e mail"), None, None),
    ("property_use", "text", "", False, "", ("use", "land use", "property class"), None, None),
    ("amount_due", "money", "amount", False, "tax_delinquency", ("balance", "balance due", "total due", "amount owed"), None, None),
    ("assessed_value", "money", "amount", False, "assessor_roll", ("assessment", "total assessed value"), None, None),
    ("sale_price", "money", "amount", False, "deed_transfer", ("price", "sold for", "consideration"), None, None),
    ("event_date", "date", "event_date", False, "", ("date", "filed date", "issue date"), None, None),
    ("auction_date", "date", "fallback_date", False, "trustee_auction", ("sale date", "auction"), None, None),
    ("case_number", "id", "", False, "foreclosure_filing", ("case", "case no", "permit number"), None, None),
    ("status", "status", "status", False, "", ("state", "disposition"), None, None),
    ("plaintiff", "name", "", False, "", ("lender",), None, None),
    ("defendant", "name", "", False, "", ("borrower",), None, None),
    ("buyer", "name", "", False, "", ("grantee", "purchaser"), None, None),
    ("legal_description", "text", "", False, "", ("legal", "legal desc"), None, None),
    ("description", "text", "", False, "", ("work", "violation", "notes"), None, None),
    ("latitude", "number", "", False, "", ("lat",), -90.0, 90.0),
    ("longitude", "number", "", False, "", ("lon", "lng"), -180.0, 180.0),
)


def schema_fields(spark: SparkSession, schema: tuple = SCHEMA) -> DataFrame:
    """The schema as a table; a field's own name is its last synonym. Duplicate names, unknown kinds and a schema without
    an identity field are errors."""
    names = [f[0] for f in schema]
    if len(set(names)) != len(names) or not any(f[3] for f in schema) or any(f[1] not in KINDS for f in schema):
        raise ValueError("schema: names must differ, kinds be known, and one field be an identity")
    rows = [(i, *f[:5], [*f[5], f[0].replace("_", " ")], f[6], f[7]) for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "field_ord int, name string, kind string, role string, identity boolean, authority string, synonyms array<string>, low double, high double")


def label_similarity(label_words: list[str], synonym_words: list[str]) -> float:
    """1 for equal slugs; else the best of matched words over the longer list and of the whole slugs, each above its bar."""
    a, b = "_".join(label_words), "_".join(synonym_words)
    if a == b:
        return 1.0
    if not label_words or not synonym_words or (len(synonym_words) == 1 and len(label_words) > 1):
        return 0.0
    best = (max(jaro_winkler(s, w) for w in label_words) for s in synonym_words)
    token = sum(x for x in best if x >= TOKEN_LEAST) / max(len(label_words), len(synonym_words))
    whole = jaro_winkler(a, b)
    return max(token, whole if whole >= SLUG_LEAST else 0.0)


def label_scores(labels: DataFrame, fields: DataFrame) -> DataFrame:
    """(label, name, similarity): each distinct label against each field's synonyms (configuration, so broadcast)."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "name": b["name"], "similarity": [label_similarity(list(x), list(y)) for x, y in zip(b["lw"], b["sw"], strict=True)]})

    syn = fields.select("name", F.explode("synonyms").alias("synonym")).select("name", words(F.col("synonym")).alias("sw"))
    pairs = labels.select("label").distinct().select("label", words(F.col("label")).alias("lw")).crossJoin(F.broadcast(syn))
    return pairs.mapInPandas(score, "label string, name string, similarity double").groupBy("label", "name").agg(F.max("similarity").alias("similarity"))


def coerce_any(rows: DataFrame, kind: str = "kind", value: str = "piece") -> DataFrame:
    """rows with c, what coerce() makes of `value` by a kind that is a column; low and high bound numbers. The choice of a
    part is one expression per kind, money's text is made once after it."""
    choice = F.lit(None).cast("struct<value:string,reformatted:boolean>")
    for k in KINDS:
        x = chosen(k, F.col(value))
        if k == "number":
            inside = lambda c: F.when((F.col("low").isNull() | (c["value"].try_cast("double") >= F.col("low"))) & (F.col("high").isNull() | (c["value"].try_cast("double") <= F.col("high"))), c)
            x = let(x, inside)
        choice = F.when(F.col(kind) == k, x).otherwise(choice)
    picked = F.col("__x.value")
    text = F.when(F.col(kind) == "money", F.coalesce(money_text(parse_money(picked)), picked))
    for k in ("date", "id", "email"):
        text = text.when(F.col(kind) == k, normalize(k, picked))
    made = F.struct(F.col("__x").isNotNull().alias("ok"), text.otherwise(normalize("text", picked)).alias("value"), F.coalesce(F.col("__x.reformatted"), F.lit(False)).alias("reformatted"))
    return rows.withColumn("__x", choice).withColumn("c", made).drop("__x")


def samples(cells: DataFrame) -> DataFrame:
    """The first SAMPLE non-empty cells of each label, in order of record."""
    w = Window.partitionBy("source_id", "label").orderBy("record")
    full = cells.where(trim(F.coalesce("value", F.lit(""))) != "")
    return full.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE).drop("n")


def part_counts(sampled: DataFrame) -> DataFrame:
    """(source_id, label, parts): into how many parts a label's values split, where all of two or more samples agree; else 0."""
    n = F.size(split_parts(F.col("value")))
    agg = sampled.groupBy("source_id", "label").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.count("*").alias("n"))
    good = (F.col("lo") == F.col("hi")) & (F.col("n") >= 2) & F.col("lo").between(2, MAX_PARTS)
    return agg.select("source_id", "label", F.when(good, F.col("lo")).otherwise(0).alias("parts"))


#: A trained column tagger: weights, classes and heads (see operators.columns).
Network = tuple[dict, list[str], int]


def tagged(cells: DataFrame, network: Network) -> DataFrame:
    """(source_id, label, name, neural): the field that the tagger gives a label with its first three values, if it is sure of one."""
    from . import columns

    full = cells.where(F.coalesce("value", F.lit("")) != "")
    w = Window.partitionBy("source_id", "label").orderBy("record")
    first = full.withColumn("n", F.row_number().over(w)).where(F.col("n") <= columns.VALUES)
    values = F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"])
    held = cells.select("source_id", "label").distinct().join(first.groupBy("source_id", "label").agg(values.alias("values")), ["source_id", "label"], "left")
    weights, classes, heads = network
    said = columns.tag(held.withColumn("name", F.col("label")), weights, classes, heads, keys=("source_id", "label"))
    return said.where((F.col("probability") >= NEURAL_GATE) & (F.col("class") != "none")).select("source_id", "label", F.col("class").alias("name"), F.col("probability").alias("neural"))


def candidates(cells: DataFrame, fields: DataFrame, network: Network | None = None) -> DataFrame:
    """(source_id, label_ord, label, part, field_ord, name, similarity, pass_rate, reformatted, confidence, eligible); part -1 is the whole cell.

    A part of a composite value is scored by the label's word in its place, where it has as many words as parts, and else not claimed. With
    a tagger (network) a whole cell's name evidence is the greater of similarity and the tagger's probability for the field that it names.
    """
    sampled = written(samples(cells))  # SAMPLE cells a label
    parts = part_counts(sampled)
    pieces = sampled.join(parts, ["source_id", "label"]).select("source_id", "label", "label_ord", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("part"), trim(F.col("value")).alias("piece"))), F.when(F.col("parts") > 0, F.transform(split_parts(F.col("value")), lambda p, i: F.struct(i.alias("part"), p.alias("piece")))).otherwise(F.array().cast("array<struct<part:int,piece:string>>")))).alias("p")).select("source_id", "label", "label_ord", "p.part", "p.piece").where("piece != ''")
    config = fields.select("field_ord", "name", "kind", "low", "high")
    tried = coerce_any(pieces.crossJoin(F.broadcast(config)))
    rates = tried.groupBy("source_id", "label", "part", "field_ord", "name", "kind").agg(F.min("label_ord").alias("label_ord"), F.avg(F.col("c.ok").cast("double")).alias("pass_rate"), (F.sum(F.col("c.reformatted").cast("int")) * 2 > F.sum(F.col("c.ok").cast("int"))).alias("reformatted"))
    rates = rates.join(parts, ["source_id", "label"]).withColumn("words", words(F.col("label"))).where((F.col("part") < 0) | (F.size("words") == F.col("parts")))
    rates = rates.withColumn("scored", F.when(F.col("part") < 0, F.col("label")).otherwise(F.get("words", F.col("part")))).drop("parts", "words")
    by_label = label_scores(rates.select(F.col("scored").alias("label")), fields).withColumnRenamed("label", "scored")
    scored = rates.join(by_label, ["scored", "name"]).withColumn("reformatted", F.col("reformatted") | (F.col("part") >= 0))
    if network is not None:
        scored = scored.join(tagged(cells, network), ["source_id", "label", "name"], "left").withColumn("neural", F.coalesce("neural", F.lit(0.0)))
        evidence = F.when(F.col("part") < 0, F.greatest("similarity", "neural")).otherwise(F.col("similarity"))
    else:
        scored, evidence = scored.withColumn("neural", F.lit(0.0)), F.col("similarity")
    confidence = LABEL_WEIGHT * evidence + VALUE_WEIGHT * F.col("pass_rate")
    weak = F.col("kind").isin(*WEAK)
    eligible = (F.col("pass_rate") > 0) & F.when(F.col("part") >= 0, (confidence >= ACCEPT_PART) & ~weak).otherwise((confidence >= ACCEPT) & (~weak | (F.col("similarity") >= WEAK_FLOOR)))
    return scored.select("source_id", "label_ord", "label", "part", "field_ord", "name", "similarity", "neural", "pass_rate", "reformatted", confidence.alias("confidence"), eligible.alias("eligible"))


def assign(found: DataFrame) -> DataFrame:
    """Greedy one-to-one choice per source, most confident first (ties: label, field, whole before parts). A label goes whole
    or in parts, each field and slot once. A source has labels times fields candidates at most, so a group is small."""

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["confidence", "label_ord", "field_ord", "part"], ascending=[False, True, True, True], kind="stable")
        fields, slots, whole, split, keep = set(), set(), set(), set(), []
        for r in rows.itertuples():
            slot, taken = (r.label, r.part), r.label in (split if r.part < 0 else whole)
            if r.name in fields or slot in slots or taken:
                keep.append(False)
                continue
            fields.add(r.name)
            slots.add(slot)
            (whole if r.part < 0 else split).add(r.label)
            keep.append(True)
        return rows[keep][["source_id", "field_ord", "name", "label", "part", "confidence"]]

    names = found.withColumnRenamed("name", "field").where("eligible").select("source_id", "label_ord", "label", "part", "field_ord", F.col("field").alias("name"), "confidence")
    return names.groupBy("source_id").applyInPandas(greedy, "source_id string, field_ord int, name string, label string, part int, confidence double")


def infer_mapping(cells: DataFrame, fields: DataFrame, network: Network | None = None) -> DataFrame:
    """Accepted (source_id, field_ord, name, label, part, confidence); nothing for a source without an identity field."""
    chosen = written(assign(candidates(cells, fields, network)))  # a row for each source and field, which several branches read
    anchored = chosen.join(F.broadcast(fields.where("identity").select("name")), "name", "left_semi").select("source_id").distinct()
    return chosen.join(anchored, "source_id", "left_semi")


def override(mapping: DataFrame, pins: DataFrame) -> DataFrame:
    """mapping with an operator's pins (source_id, name, label): a pin replaces what was inferred, an absent label unmaps."""
    left = mapping.join(pins.select("source_id", "name"), ["source_id", "name"], "left_anti").join(pins.where("label is not null").select("source_id", "label"), ["source_id", "label"], "left_anti")
    pinned = pins.where("label is not null").select("source_id", F.lit(-1).alias("field_ord"), "name", "label", F.lit(-1).alias("part"), F.lit(1.0).alias("confidence"))
    return left.select(*pinned.columns).unionByName(pinned)


def extract(cells: DataFrame, mapping: DataFrame, fields: DataFrame) -> DataFrame:
    """(source_id, record, canonical map, completeness): mapped cells in normal form; what can't be coerced is left out."""
    config = fields.select("name", "kind", "low", "high")
    per_source = mapping.groupBy("source_id").agg(F.count("*").alias("mapped"))
    # cells that aren't mapped stay for their record, which may have no others; cells are read and shuffled once
    known = mapping.select("source_id", "label", "part", "name").join(F.broadcast(config), "name")
    joined = cells.join(known, ["source_id", "label"], "left")
    piece = F.when(F.col("part") < 0, trim(F.col("value"))).otherwise(F.get(split_parts(F.col("value")), F.col("part")))
    got = coerce_any(joined.withColumn("piece", F.when(F.col("name").isNotNull(), piece)))
    entry = F.when(F.col("c.ok"), F.struct("name", F.col("c.value").alias("value")))
    made = got.select("source_id", "record", entry.alias("entry")).groupBy("source_id", "record").agg(F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("canonical"))
    out = made.join(per_source, "source_id")
    return out.select("source_id", "record", F.coalesce("canonical", F.create_map().cast("map<string,string>")).alias("canonical"), (F.coalesce(F.size("canonical"), F.lit(0)) / F.col("mapped")).alias("completeness"))


def build_events(records: DataFrame, fields: DataFrame, sources: DataFrame) -> DataFrame:
    """Property events of canonical records. sources: source_id, jurisdiction, label, as_of, recorded_at, confidence. A record
    that names no property is left out; the first non-empty field of a role counts, in schema order."""
    from ..functions.places import property_key
    from ..functions.text import content_hash
    from ..operators.lifecycle import kind_of

    roles: dict[str, list[str]] = {}
    for r in fields.orderBy("field_ord").select("name", "role").collect():  # the schema
        roles.setdefault(r["role"], []).append(r["name"])
    role = lambda name: F.coalesce(*[F.nullif(F.element_at("canonical", f), F.lit("")) for f in roles.get(name, [])], F.lit(None).cast("string"))
    e = records.join(sources, "source_id").withColumn("property_key", property_key(F.col("jurisdiction"), role("parcel"), role("address"))).where("property_key is not null")
    e = e.select("property_key", kind_of(F.col("label"), role("status")).alias("kind"), F.coalesce(role("event_date"), role("fallback_date"), F.lit("")).alias("event_date"), "recorded_at", "source_id", F.col("label").alias("source_label"), "as_of", F.coalesce(role("amount").try_cast("double"), F.lit(0.0)).alias("amount"), F.col("confidence").alias("confidence"), F.col("canonical").alias("details"))
    case = F.element_at("details", "case_number")
    basis = F.concat_ws("|", "property_key", "kind", "event_date", "source_id", case)
    return e.withColumn("id", content_hash(basis))


def mapping_scores(golden: DataFrame, inferred: DataFrame) -> DataFrame:
    """(tp, spurious, missing, precision, recall, f1) of inferred (source_id, name, label) against golden (source_id, name, labels).

    An empty label in golden's list means that unmapped is right too; ratios of nothing are 1."""
    both = golden.join(inferred.select("source_id", "name", "label"), ["source_id", "name"], "full")
    right = F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False))
    may_miss = F.coalesce(F.array_contains("labels", ""), F.lit(False))
    total = both.agg(F.count_if(right).alias("tp"), F.count_if(F.col("label").isNotNull() & ~right).alias("spurious"), F.count_if(F.col("labels").isNotNull() & ~right & ~(F.col("label").isNull() & may_miss)).alias("missing"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(1.0)
    t = total.withColumn("precision", share(F.col("tp"), F.col("spurious"))).withColumn("recall", share(F.col("tp"), F.col("missing")))
    return t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def field_rates(cells: DataFrame) -> DataFrame:
    """(source_id, field, rate) of (source_id, record, field, ok): the share of the source's records with a valid value of the field."""
    n = cells.groupBy("source_id").agg(F.count_distinct("record").alias("records"))
    hits = cells.groupBy("source_id", "field").agg(F.count_if("ok").alias("hits"))
    return hits.join(n, "source_id").select("source_id", "field", (F.col("hits") / F.col("records")).alias("rate"))


def overall_rates(records: DataFrame) -> DataFrame:
    """(source_id, rate): the mean completeness of all of a source's records, empty ones included."""
    return records.groupBy("source_id").agg(F.avg(F.coalesce("completeness", F.lit(0.0))).alias("rate"))


def mapping_confidence(mapping: DataFrame) -> DataFrame:
    """(source_id, confidence): the mean of a mapping's fields."""
    return mapping.groupBy("source_id").agg(F.avg("confidence").alias("confidence"))


def mapping_faults(mapping: DataFrame) -> DataFrame:
    """(source_id, fault, at) of a stored mapping (source_id, name, label, part, confidence): scores outside 0 to 1, a field that is
    mapped twice, a label's part that is used twice. A mapping without rows here can be used."""
    scored = mapping.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).select("source_id", F.lit("score").alias("fault"), F.col("name").alias("at"))
    twice = lambda *by: mapping.groupBy("source_id", *by).agg(F.count("*").alias("n")).where("n > 1")
    fields = twice("name").select("source_id", F.lit("field twice").alias("fault"), F.col("name").alias("at"))
    parts = twice("label", "part").select("source_id", F.lit("part twice").alias("fault"), F.concat_ws("|", "label", F.col("part").cast("string")).alias("at"))
    return scored.unionByName(fields).unionByName(parts)


def in_schema_order(mapping: DataFrame, fields: DataFrame) -> DataFrame:
    """A mapping's rows by source, in the order that the schema has its fields."""
    return mapping.join(F.broadcast(fields.select("name", "field_ord")), "name").orderBy("source_id", "field_ord")
