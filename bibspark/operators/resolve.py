"""Resolution: from candidates to one value, or list of values, for each field, and one schema for each record.

Grouping keys begin with the record, so each step after the first shuffle on the record's key works in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibspark.functions.text import doi_from_url, doi_selected
from bibspark.operators.ledger import HUMAN
from bibspark.operators.rounds import checkpointed

# Bonuses, thresholds and aliases of the resolution rules.
SOURCE_BONUS = {"pdf": 0.0, "bibtex": 0.06, "ris": 0.06, "catalog": 0.0}
METHOD_BONUS = {"api_review": 0.30, "review_memory_exact": 0.28, "bibtex_raw_field": 0.10, "ris_raw_field": 0.10, "bibtex_metadata": 0.08, "ris_metadata": 0.08, "doi_regex": 0.08, "web_print_profile": 0.05, "publisher_profile": 0.05}
LAYOUT_PENALTY = 0.08
FIELD_SUPPORT, FIELD_SUPPORT_CAP = 0.03, 0.10
SCHEMA_SUPPORT, SCHEMA_SUPPORT_CAP = 0.025, 0.08
CONFLICT_LEAST, CONFLICT_GAP = 0.84, 0.12
CLOSE_LEAST, CLOSE_GAP = 0.90, 0.04
ALIAS_COST = 0.03
ALIASES = (
    ("academic_place", "place"),
    ("presentation_year", "publication_year"),
    ("defense_year", "publication_year"),
    ("part_title", "title"),
    ("service_title", "title"),
    ("newspaper_title", "periodical_title"),
    ("newspaper_date", "publication_date"),
    ("newspaper_date", "publication_year"),
    ("media_support", "support"),
    ("electronic_description", "support"),
)
UNKNOWN_PLACE = "[S. l.]"
UNORDERED = 10_000


def _bonus(table: dict[str, float], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), F.lit(0.0))


def candidate_score(confidence: Column, source_format: Column, method: Column) -> Column:
    raw = confidence + _bonus(SOURCE_BONUS, source_format) + _bonus(METHOD_BONUS, method)
    raw = F.when(F.startswith(method, F.lit("pdf_metadata")), raw - LAYOUT_PENALTY).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def _supported(best: Column, sources: Column) -> Column:
    return F.least(F.lit(1.0), best + F.least(F.lit(FIELD_SUPPORT_CAP), F.lit(FIELD_SUPPORT) * (sources - 1)))


def _label() -> Column:
    return F.concat("source_format", F.lit(":"), "source_file", F.when(F.coalesce("source_record_id", F.lit("")) != "", F.concat(F.lit("#"), "source_record_id")).otherwise(""))


def alternatives(ledger: DataFrame, repeatable: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per alternative of a field: keys, values, norms, score, human, sources, methods.

    Scalar fields group by normalized value; repeatable ones group the lists that each provenance states.  repeatable:
    (field_id, repeatable).  Support counts different (format, file, record) triples, a missing record id being a value.
    """
    keys = keys or ["record_id", "field_id"]
    scored = ledger.join(F.broadcast(repeatable.select("field_id", "repeatable")), "field_id", "left")
    scored = scored.withColumn("repeatable", F.coalesce("repeatable", F.lit(False))).withColumn("score", candidate_score(F.col("confidence"), F.col("source_format"), F.col("method"))).withColumn("human", F.coalesce(F.col("method").isin(*HUMAN), F.lit(False))).withColumn("label", _label())
    provenance = ["source_format", "source_file", "source_record_id", "method"]
    single = scored.filter(~F.col("repeatable")).select(*keys, F.array("value").alias("values"), F.array("normalized_value").alias("norms"), *provenance, "score", "human", "label", "ord")
    member = F.struct(F.when(F.coalesce("sequence", F.lit(0)) == 0, UNORDERED).otherwise(F.col("sequence")).alias("at"), F.col("value"), F.col("normalized_value"))
    lists = scored.filter("repeatable").groupBy(*keys, *provenance).agg(F.array_sort(F.collect_list(member)).alias("m"), F.max("score").alias("score"), F.first("human").alias("human"), F.first("label").alias("label"), F.min("ord").alias("ord"))
    lists = lists.select(*keys, F.col("m.value").alias("values"), F.col("m.normalized_value").alias("norms"), *provenance, "score", "human", "label", "ord")
    return (
        single.unionByName(lists)
        .groupBy(*keys, "norms")
        .agg(
            F.max_by("values", F.struct("score", -F.col("ord"))).alias("best"), F.min_by("values", "ord").alias("earliest"), F.size(F.first("norms")).alias("n_values"), F.max("score").alias("top"),
            F.count_distinct(F.struct("source_format", "source_file", "source_record_id")).alias("support"), F.bool_or("human").alias("human"), F.array_sort(F.collect_set("label")).alias("sources"), F.array_sort(F.collect_set("method")).alias("methods"),
        )
        .join(F.broadcast(repeatable.select("field_id", "repeatable")), "field_id", "left")
        .select(*keys, F.when(F.coalesce("repeatable", F.lit(False)), F.col("earliest")).otherwise(F.col("best")).alias("values"), "norms", "n_values", _supported(F.col("top"), F.col("support")).alias("score"), "human", "sources", "methods")
    )


def resolve_fields(ledger: DataFrame, repeatable: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per field: keys, values, norms, status (selected or conflict), confidence, n_alternatives, runner_up, sources, human.

    Alternatives rank by score, number of values and normalized values, all falling; a human one goes first.  There is a conflict
    without human choice if the two best both reach 0.84 and lie within 0.12.  Scores are compared unrounded.
    """
    keys = keys or ["record_id", "field_id"]
    ranked = [F.col("score").desc(), F.col("n_values").desc(), F.col("norms").desc()]
    field = W.partitionBy(*keys)
    rows = alternatives(ledger, repeatable, keys)
    rows = rows.withColumn("chosen", F.row_number().over(field.orderBy(F.col("human").desc(), *ranked)) == 1)
    order = field.orderBy(F.col("chosen").desc(), *ranked)
    rows = rows.withColumn("second", F.lead("score").over(order)).withColumn("runner_up", F.lead("values").over(order)).withColumn("n_alternatives", F.count(F.lit(1)).over(field))
    close = ~F.col("human") & (F.col("score") >= CONFLICT_LEAST) & (F.col("second") >= CONFLICT_LEAST) & (F.col("score") - F.col("second") <= CONFLICT_GAP)
    return rows.filter("chosen").select(*keys, "values", "norms", F.when(F.coalesce(close, F.lit(False)), "conflict").otherwise("selected").alias("status"), F.least(F.col("score"), F.lit(1.0)).alias("confidence"), F.col("n_alternatives").cast("long").alias("n_alternatives"), "runner_up", "sources", "human")


def resolve_schema(types: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(record_id, schema_id, schema_confidence, schema_reason) from candidates (record_id, schema_id, source_format, confidence, reason, ord).

    Score: the best candidate's, plus support for more of them; ties go to the greater id.  A close second is noted.  An override
    (record_id, schema_override) decides.
    """
    score = F.least(F.lit(1.0), F.col("confidence") + _bonus(SOURCE_BONUS, F.col("source_format")))
    named = types.filter("schema_id IS NOT NULL").groupBy("record_id", "schema_id").agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "reason"))).alias("reasons"))
    named = named.select("record_id", "schema_id", F.least(F.lit(1.0), F.col("best") + F.least(F.lit(SCHEMA_SUPPORT_CAP), F.lit(SCHEMA_SUPPORT) * (F.col("n") - 1))).alias("score"), F.array_join(F.array_distinct("reasons.reason"), "; ").alias("reason"))
    order = W.partitionBy("record_id").orderBy(F.col("score").desc(), F.col("schema_id").desc())
    named = named.withColumn("nth", F.row_number().over(order)).withColumn("next_score", F.lead("score").over(order)).withColumn("next_id", F.lead("schema_id").over(order)).filter("nth = 1")
    close = (F.col("next_score") >= CLOSE_LEAST) & (F.col("score") - F.col("next_score") <= CLOSE_GAP)
    note = F.when(close, F.concat(F.lit("; close alternative schema="), "next_id", F.lit(" score="), F.format_string("%.2f", "next_score"))).otherwise("")
    out = named.select("record_id", "schema_id", F.col("score").alias("schema_confidence"), F.concat("reason", note).alias("schema_reason"))
    if overrides is None:
        return out
    decided = overrides.filter("schema_override IS NOT NULL").select("record_id", F.col("schema_override").alias("schema_id"), F.lit(1.0).alias("schema_confidence"), F.lit("reviewed").alias("schema_reason"))
    return out.join(decided.select("record_id"), "record_id", "left_anti").unionByName(decided)


def with_aliases(ledger: DataFrame, wanted: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """The candidates of each wanted (record_id, field_id): direct ones, or else those of the alias fields at a lower confidence.

    Excluded fields have none.
    """
    if excluded is not None:
        wanted = wanted.join(excluded, ["record_id", "field_id"], "left_anti")
    direct = ledger.join(wanted.select("record_id", "field_id"), ["record_id", "field_id"], "left_semi")
    spark = ledger.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(ALIASES)], "field_id string, source_field string, alias_order int"))
    lacking = wanted.select("record_id", "field_id").join(table, "field_id").join(ledger.select("record_id", "field_id").distinct(), ["record_id", "field_id"], "left_anti").withColumnRenamed("field_id", "target")
    aliased = ledger.join(lacking, (ledger["record_id"] == lacking["record_id"]) & (ledger["field_id"] == lacking["source_field"])).select(
        ledger["record_id"], F.col("target").alias("field_id"), *[ledger[c] for c in ledger.columns if c not in ("record_id", "field_id", "method", "confidence", "ord")],
        F.concat(F.lit("alias:"), "source_field", F.lit(":"), ledger["method"]).alias("method"), F.greatest(F.lit(0.0), ledger["confidence"] - ALIAS_COST).alias("confidence"), (ledger["ord"] + F.col("alias_order") * 10**8).alias("ord"),
    )
    return direct.unionByName(aliased.select(*direct.columns))


def _default(wanted: DataFrame, present: DataFrame, field: str, value: str, method: str, label: str) -> DataFrame:
    rows = wanted.filter(F.col("field_id") == field).join(present.select("record_id", "field_id").distinct(), ["record_id", "field_id"], "left_anti")
    return rows.select("record_id", "field_id", F.lit(value).alias("value"), F.lit(value.lower()).alias("normalized_value"), F.lit("catalog").alias("source_format"), F.lit(label).alias("source_file"), F.lit(None).cast("string").alias("source_record_id"), F.lit(method).alias("method"), F.lit(1.0).alias("confidence"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("raw_field_name"), F.lit(None).cast("int").alias("sequence"), F.lit(0).cast("long").alias("ord"))


def cohere_url(fields: DataFrame, ledger: DataFrame, repeatable: DataFrame) -> DataFrame:
    """Align the URL with the selected DOI: prefer URLs of that DOI, or derive one where the URL names another DOI.  A conflict stays one."""
    doi = fields.filter("field_id = 'doi'").select("record_id", doi_selected(F.try_element_at("values", F.lit(1))).alias("doi"), F.col("confidence").alias("doi_confidence"), F.col("sources").alias("doi_sources")).filter("doi IS NOT NULL")
    same = ledger.filter("field_id = 'url'").join(doi.select("record_id", "doi"), "record_id").filter(doi_from_url(F.col("value")) == F.col("doi")).drop("doi")
    matching = resolve_fields(same, repeatable).select("record_id", F.col("values").alias("own_values"), F.col("norms").alias("own_norms"), F.col("confidence").alias("own_confidence"), F.col("sources").alias("own_sources"))
    url = fields.filter("field_id = 'url'").join(doi, "record_id", "left").join(matching, "record_id", "left")
    other = doi_from_url(F.try_element_at("values", F.lit(1)))
    derived = F.concat(F.lit("https://doi.org/"), "doi")
    wrong = F.col("doi").isNotNull() & F.col("own_values").isNull() & (other != F.col("doi"))
    pick = lambda own, new, old: F.when(F.col("own_values").isNotNull(), own).when(wrong, new).otherwise(old)
    url = url.select("record_id", "field_id", pick(F.col("own_values"), F.array(derived), F.col("values")).alias("values"), pick(F.col("own_norms"), F.array(F.lower(derived)), F.col("norms")).alias("norms"), "status", pick(F.col("own_confidence"), F.col("doi_confidence"), F.col("confidence")).alias("confidence"), "n_alternatives", "runner_up", pick(F.col("own_sources"), F.col("doi_sources"), F.col("sources")).alias("sources"), "human")
    return fields.filter("field_id <> 'url'").unionByName(url)


def missing_required(present: DataFrame, schemas: DataFrame, dim_schema_field: DataFrame, dim_condition: DataFrame, *, strict: bool = True) -> DataFrame:
    """(record_id, missing array) for every record of schemas (record_id, schema_id); present: (record_id, field_id) with values.

    Required fields without a value in the schema's order, then conditions in theirs.  An any_of of fields that the
    schema doesn't have can't be met; strict=False leaves such conditions out.
    """
    own = present.groupBy("record_id").agg(F.collect_set("field_id").alias("have"))
    base = schemas.select("record_id", "schema_id").join(own, "record_id", "left").withColumn("have", F.coalesce("have", F.expr("cast(array() as array<string>)")))
    needs = dim_schema_field.groupBy("schema_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("ordinal", "field_id")))), lambda x: x["field_id"]).alias("required"), F.collect_set("field_id").alias("fields"))
    rules = dim_condition.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("condition", "any_of", "when_field", "then_required"))).alias("rules"))
    joined = base.join(F.broadcast(needs), "schema_id", "left").join(F.broadcast(rules), "schema_id", "left")
    none = F.expr("cast(array() as array<string>)")
    lacks = lambda names: F.filter(names, lambda f: ~F.array_contains(F.col("have"), f))
    applies = lambda r: F.lit(strict) | F.exists(r["any_of"], lambda f: F.array_contains(F.col("fields"), f))
    broken = F.transform(
        F.coalesce("rules", F.expr("cast(array() as array<struct<condition:int,any_of:array<string>,when_field:string,then_required:array<string>>>)")),
        lambda r: F.when(r["any_of"].isNotNull(), F.when(~F.exists(r["any_of"], lambda f: F.array_contains(F.col("have"), f)) & applies(r), F.array(F.concat(F.lit("any_of:"), F.array_join(r["any_of"], "|")))).otherwise(none)).when(F.array_contains(F.col("have"), r["when_field"]), lacks(r["then_required"])).otherwise(none),
    )
    return joined.select("record_id", F.array_distinct(F.concat(F.coalesce(lacks(F.col("required")), none), F.flatten(broken))).alias("missing"))


def resolve(ledger: DataFrame, types: DataFrame, catalog, *, access_date: str, overrides: DataFrame | None = None, excluded: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fields, records).  fields: a row for each field of a record's schema that has values, with its ordinal.  records: record_id,
    schema_id, family, medium, schema_confidence, schema_reason, missing, conflicting, ready.  A record without a schema isn't ready.

    A missing access date is the run's; a missing place is unknown, even where it was excluded.
    """
    from bibspark.plans.catalog import repeatable as repeatable_of

    spark = ledger.sparkSession
    ledger, types = checkpointed(ledger), checkpointed(types)  # read several times below; what they come from runs once
    repeatable = repeatable_of(catalog.dim_field(spark))
    shape = catalog.dim_schema_field(spark)
    chosen = resolve_schema(types.join(F.broadcast(catalog.dim_schema(spark).select("schema_id")), "schema_id", "left_semi"), overrides)
    known = chosen.join(F.broadcast(catalog.dim_schema(spark)), "schema_id")
    wanted = known.select("record_id", "schema_id").join(F.broadcast(shape), "schema_id")
    candidates = with_aliases(ledger, wanted, excluded)
    candidates = checkpointed(candidates)  # read several times below
    candidates = candidates.unionByName(_default(wanted, candidates, "access_date", access_date, "execution_date", "<execution>").select(*candidates.columns)).unionByName(_default(wanted, candidates, "place", UNKNOWN_PLACE, "normative_unknown_place", "<catalog>").select(*candidates.columns))
    fields = cohere_url(checkpointed(resolve_fields(candidates, repeatable)), ledger, repeatable)
    fields = checkpointed(fields.join(wanted.select("record_id", "field_id", "ordinal", "required"), ["record_id", "field_id"]))
    missing = missing_required(fields.select("record_id", "field_id"), known, shape, catalog.dim_condition(spark), strict=strict)
    conflicts = fields.filter("status = 'conflict'").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "field_id"))), lambda x: x["field_id"]).alias("conflicting"))
    everyone = ledger.select("record_id").unionByName(types.select("record_id")).distinct()
    records = everyone.join(known, "record_id", "left").join(missing, "record_id", "left").join(conflicts, "record_id", "left")
    none = F.expr("cast(array() as array<string>)")
    records = records.select("record_id", "schema_id", "family", "medium", F.coalesce("schema_confidence", F.lit(0.0)).alias("schema_confidence"), "schema_reason", F.coalesce("missing", none).alias("missing"), F.coalesce("conflicting", none).alias("conflicting"), (F.col("schema_id").isNotNull() & (F.size("missing") == 0)).alias("ready"))
    return fields, records
