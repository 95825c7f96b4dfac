"""Contracts of a corpus: operations, sources and mappings of an integrator file, and who calls them.

One pass reads the integrator's tags, one pass the tags of all other files that hold a reference to it. Everything after
that is relational: alias coalescing, late binding of endpoints, the mapping pivot, caller classes, links and diagnostics
are columns and joins over the tags. Files that cannot be read are rows of the diagnostics.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.config import MAPPING_SUFFIXES, Vocabulary
from lodeline.operators import closure, resolve
from lodeline.sources import corpus
from lodeline.sources.corpus import ending, value

INTEGRATOR_TAGS = ("DataSource", "Product", "Phase", "Rule")
DIAGNOSTIC = ["severity", "code", "file_path", "tag_offset", "rule_class", "message", "evidence"]


@dataclass
class Contracts:
    """Named DataFrames, and what the build was asked for."""

    tables: dict[str, DataFrame]
    metadata: dict[str, str] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)


def variants(references: tuple[str, ...]) -> tuple[str, ...]:
    """References as written and with either slash."""
    spelled = (v for r in references if r for v in (r, r.replace("\\", "/"), r.replace("/", "\\")))
    return tuple(dict.fromkeys(spelled))


def _by_class(vocabulary: Vocabulary, concept: str, rule_class: Column) -> Column:
    """A concept's value where some classes have attributes of their own."""
    own = sorted({*vocabulary.attributes, *vocabulary.attributes_exact, *vocabulary.overrides, *vocabulary.overrides_exact})
    plain = value(vocabulary.names(concept))
    out = plain
    full = F.lower(F.trim(F.coalesce(rule_class, F.lit(""))))
    # Whole names are asked before last parts, so they are put on last.
    for name in sorted(own, key=lambda n: "." in n):
        names = vocabulary.names(concept, name)
        if names != vocabulary.names(concept):
            out = F.when((full if "." in name else resolve.class_suffix(full)) == name, value(names)).otherwise(out)
    return out


def _in(rule_class: Column, exact, by_suffix) -> Column:
    full = F.lower(F.trim(F.coalesce(rule_class, F.lit(""))))
    return full.isin(list(exact)) | resolve.class_suffix(full).isin(list(by_suffix))


def _or_none(c: Column, text: str) -> Column:
    return F.coalesce(c, F.lit(text))


def _diagnostic(severity: str, code: str, message, *, offset=None, rule_class=None, evidence=None) -> list[Column]:
    text = F.lit(message) if isinstance(message, str) else message
    return [
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("file").alias("file_path"),
        (F.lit(None) if offset is None else offset).cast("long").alias("tag_offset"),
        (F.lit(None) if rule_class is None else rule_class).cast("string").alias("rule_class"), text.alias("message"),
        (F.create_map().cast("map<string,string>") if evidence is None else evidence).alias("evidence"),
    ]


def _evidence(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def attribute_problems(tags: DataFrame) -> DataFrame:
    """A diagnostic per value that was cut and per attribute that stands twice."""
    cut = tags.select("*", F.explode("truncated").alias("_x")).select(*_diagnostic("WARNING", "ATTRIBUTE_VALUE_TRUNCATED", "A selected attribute exceeded one MiB; its offset is kept.", offset=F.col("offset"), evidence=_evidence(attribute=F.col("_x.name"), observed_bytes=F.col("_x.observed_bytes"))))
    twice = tags.select("*", F.explode("duplicates").alias("_x")).select(*_diagnostic("WARNING", "DUPLICATE_XML_ATTRIBUTE", "An attribute stands twice in a tag; the last value was kept.", offset=F.col("offset"), evidence=_evidence(attribute=F.col("_x"))))
    return cut.unionByName(twice)


def unreadable(tags: DataFrame) -> DataFrame:
    rules = tags.where(F.col("error").isNotNull() & F.col("name").isNotNull()).select(*_diagnostic("WARNING", "INCOMPATIBLE_RULE", "A Rule could not be read; scanning went on.", offset=F.col("offset"), evidence=_evidence(reason=F.col("error"))))
    files = tags.where(F.col("error").isNotNull() & F.col("name").isNull()).select(*_diagnostic("ERROR", "FILE_SCAN_FAILED", F.concat(F.lit("Could not inspect "), F.col("file"), F.lit(": "), F.col("error"))))
    return rules.unionByName(files)


def mappings(tags: DataFrame, *keys: str) -> DataFrame:
    """Flattened prefix_Suffix attributes of each tag to a row per prefix; the longest suffix that fits counts."""
    names = sorted((s[1:] for s in MAPPING_SUFFIXES), key=len, reverse=True)
    canon = F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
    pattern = f"(?i)^(.+)_({'|'.join(names)})$"
    a = tags.select(*keys, F.explode("attributes").alias("a"))
    a = a.select(*keys, F.regexp_extract("a.name", pattern, 1).alias("mapping_prefix"), canon[F.lower(F.regexp_extract("a.name", pattern, 2))].alias("k"), F.col("a.value").alias("v"))
    g = a.where("mapping_prefix <> ''").groupBy(*keys, "mapping_prefix").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    at = lambda n: F.col("attributes")[n]
    item = resolve.first_filled(at("SolutionDataItemMapping"), at("DataItemMapping"), at("ExportedProperty"))
    into, out_of = resolve.flag(at("In")) | resolve.flag(at("PubIn")), resolve.flag(at("Out")) | resolve.flag(at("PubOut"))
    way = F.when(into & out_of, "INOUT").when(into, "INPUT").when(out_of, "OUTPUT").otherwise("UNKNOWN")
    out = g.select(*keys, "mapping_prefix", item.alias("solution_data_item"), at("PropertyKey").alias("property_key"), way.alias("direction"), at("ClassType").alias("class_type"), "attributes")
    return out.where("solution_data_item IS NOT NULL OR coalesce(property_key, '') <> ''")


def integrator(tags: DataFrame, vocabulary: Vocabulary) -> dict[str, DataFrame]:
    """Tables that come from the integrator's own tags."""
    ok = tags.where("error IS NULL AND NOT is_end AND name IS NOT NULL")
    bag = F.map_from_entries(F.array_distinct(F.transform("attributes", lambda a: F.struct(a["name"], a["value"]))))
    name = value(("Name",))
    sources = ok.where("name = 'DataSource'").select(
        F.col("file").alias("integrator_file"), F.col("offset").alias("tag_offset"), value(("Name", "SourceName", "DataSourceName")).alias("source_name"),
        value(("ClassType",)).alias("class_type"), F.coalesce(value(vocabulary.names("base_url")), ending("url", "uri")).alias("base_url"), bag.alias("attributes"),
    )
    said = F.lower(F.concat_ws(" ", "class_type", "base_url"))
    sources = sources.where(F.col("base_url").isNotNull() | said.rlike("odata|swagger|rest|http"))
    rules = ok.where("name = 'Rule'").withColumn("class", value(("RuleClassName", "ClassType"))).withColumn("rule_class", _or_none(F.col("class"), "<missing>"))
    concept = lambda c: _by_class(vocabulary, c, F.col("class"))
    path_names = {n.casefold() for n in vocabulary.names("path")}
    known_api = _in(F.col("class"), vocabulary.api_exact, vocabulary.api)
    method_map = resolve.exact_then_suffix(F.coalesce("class", F.lit("")), vocabulary.methods_exact, vocabulary.methods)[0]
    said_method = F.coalesce(concept("method"), ending("method"))
    path = F.coalesce(concept("path"), ending("path", "url", "uri"))
    source = F.coalesce(concept("source"), ending("source"))
    shaped = rules.select("*", known_api.alias("_api"), said_method.alias("_method"), path.alias("api_path"), source.alias("source_name"), concept("output").alias("output_group"), concept("result").alias("results_group"))
    kind = F.when(F.col("_api"), "CONFIRMED").when(F.col("_method").isNotNull() & F.col("api_path").isNotNull(), "STRUCTURAL").when(F.col("api_path").isNotNull() & (F.col("source_name").isNotNull() | F.col("output_group").isNotNull() | F.col("results_group").isNotNull()), "CANDIDATE")
    ops = shaped.withColumn("classification", kind).where("classification IS NOT NULL").select(
        F.col("file").alias("integrator_file"), F.col("offset").alias("tag_offset"), value(("eid",)).alias("rule_eid"), name.alias("rule_name"), "rule_class",
        "product_name", "product_eid", "phase_name", "classification", value(("RuleType",)).alias("rule_type"), "disabled", "source_name",
        value([n for n in vocabulary.names("base_url") if n.casefold() not in path_names]).alias("base_url"),
        F.coalesce("_method", method_map).alias("action"), "api_path", concept("filter").alias("filter_expr"), concept("request").alias("request_group"),
        concept("target").alias("target_group"), "results_group", "output_group", bag.alias("attributes"), F.col("_method").alias("said_method"),
    )
    # Endpoints bind late: the last declaration of a source's folded name, wherever it stands, and never for no name.
    declared = sources.where("coalesce(source_name, '') <> ''").select(F.lower("source_name").alias("_key"), F.col("tag_offset").alias("_at"), "base_url")
    keyed = ops.withColumn("_key", F.when(F.col("source_name") != "", F.lower("source_name")))
    ops = resolve.late_bound(keyed, declared, "_key", "base_url", "_at").drop("_key")
    census = rules.groupBy(F.col("file").alias("integrator_file"), "rule_class").agg(F.count("*").alias("occurrence_count"))
    odd = ops.where("classification <> 'CONFIRMED'")
    unknown_api = odd.withColumn("file", F.col("integrator_file")).select(*_diagnostic("WARNING", "UNKNOWN_API_RULE_CLASS", "A rule shaped like an API call has an unknown class; it is kept as evidence.", offset=F.col("tag_offset"), rule_class=F.col("rule_class"), evidence=_evidence(classification=F.col("classification"), method=F.col("said_method"), path=F.col("api_path"))))
    known = _in(F.col("rule_class"), vocabulary.api_exact, {*vocabulary.api, *vocabulary.component, *vocabulary.other})
    strange = census.where(~known & (F.col("rule_class") != "<missing>")).join(odd.select("rule_class").distinct(), "rule_class", "left_anti").withColumn("file", F.col("integrator_file"))
    unknown = strange.select(*_diagnostic("NOTICE", "UNKNOWN_RULE_CLASS", F.concat(F.lit("Unknown rule class, "), F.col("occurrence_count"), F.lit(" time(s).")), rule_class=F.col("rule_class"), evidence=_evidence(count=F.col("occurrence_count"))))
    loose = tags.where("note = 'UNBALANCED'").select(*_diagnostic("WARNING", "UNBALANCED_XML_STRUCTURE", F.concat(F.lit("Closing </"), F.col("name"), F.lit("> has no tracked opening tag.")), offset=F.col("offset")))
    left = tags.where("note LIKE 'UNCLOSED%'").select(*_diagnostic("WARNING", "UNCLOSED_XML_STRUCTURE", "The integrator ended inside a Product or Phase.", evidence=_evidence(open_products=F.split("note", " ")[1], open_phases=F.split("note", " ")[2])))
    products = ok.where("name = 'Product'").select("file", "offset", "attributes", name.alias("product"), value(("eid",)).alias("eid"))
    own = mappings(products, "file", "offset", "product", "eid").select(F.col("file").alias("integrator_file"), F.col("product").alias("product_name"), F.col("eid").alias("product_eid"), F.col("offset").alias("tag_offset"), "mapping_prefix", F.col("solution_data_item").alias("exported_property"), "property_key", "direction", "class_type", "attributes")
    problems = unreadable(tags.where("name IS NULL OR name = 'Rule' OR error IS NULL")).unionByName(attribute_problems(ok))
    for more in (unknown_api, unknown, loose, left):
        problems = problems.unionByName(more)
    return {"odata_operations": ops.drop("said_method"), "data_sources": sources, "integrator_mappings": own, "rule_class_census": census, "diagnostics": problems}


def callers(tags: DataFrame, references: tuple[str, ...], vocabulary: Vocabulary, *, ignore_case: bool = False, dynamic: bool = False) -> dict[str, DataFrame]:
    """Rules whose tag holds a reference, classified, with their mappings and diagnostics."""
    seen = tags.where("name IS NOT NULL AND NOT is_end AND error IS NULL")
    is_rule = F.lower(F.substring_index("name", ":", -1)) == "rule"
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    wanted = [resolve.normal_reference(fold(F.lit(r))) for r in references]
    selectors = [n.casefold() for n in vocabulary.names("selector")]
    direct = F.filter("hits", lambda h: h != "$$")
    held = seen.withColumn("rule_class", value(("RuleClassName", "ClassType"))).withColumn("_direct", F.size(direct) > 0)
    holds = lambda v: F.exists(F.array(*wanted), lambda w: F.contains(resolve.normal_reference(fold(v)), w))
    pick = F.get(F.filter("attributes", lambda a: a["folded"].isin(selectors) & holds(a["value"])), 0)["value"]
    symbol = F.get(F.filter("attributes", lambda a: a["folded"].isin(selectors) & F.ltrim(a["value"]).startswith("$$")), 0)["value"]
    held = held.select("*", pick.alias("_selector"), symbol.alias("_symbol"), F.get(direct, 0).alias("_hit"))
    other = held.where(~is_rule & F.col("_direct")).select(*_diagnostic("NOTICE", "REFERENCE_ON_NON_RULE_TAG", F.concat(F.lit("A reference stands on <"), F.col("name"), F.lit("> rather than on a Rule.")), offset=F.col("offset"), evidence=_evidence(tag=F.col("name"), reference=F.col("_hit"))))
    rules = held.where(is_rule)
    loose = rules.where("NOT _direct AND _selector IS NULL AND _symbol IS NOT NULL").select(*_diagnostic("NOTICE", "DYNAMIC_REFERENCE_UNRESOLVED", "A dynamic selector cannot be shown to target this integrator.", offset=F.col("offset"), rule_class=F.col("rule_class"), evidence=_evidence(selector=F.col("_symbol"))))
    found = rules.where("_direct")
    component = _in(F.col("rule_class"), {}, vocabulary.component)
    kind = F.when(F.col("_selector").isNotNull() & component, "CONFIRMED").when(F.col("_selector").isNotNull(), "CONFIRMED_UNKNOWN_RULE").when(component, "INFERRED_UNKNOWN_SELECTOR").otherwise("UNCLASSIFIED_REFERENCE")
    found = found.withColumn("classification", kind)
    bag = F.map_from_entries(F.array_distinct(F.transform("attributes", lambda a: F.struct(a["name"], a["value"]))))
    calls = found.select(
        F.col("file").alias("caller_file"), F.col("offset").alias("tag_offset"), value(("eid",)).alias("rule_eid"), value(("Name",)).alias("rule_name"), "rule_class",
        "classification", value(("RuleType",)).alias("rule_type"), resolve.flag(value(("RuleDisabled",))).alias("disabled"), F.coalesce("_selector", "_hit").alias("selector"),
        value(("Source", "SourceName")).alias("source_name"), value(("ComponentList",)).alias("component_list"), bag.alias("attributes"),
    )
    told = {
        "CONFIRMED_UNKNOWN_RULE": ("UNKNOWN_CALL_RULE_CLASS", "A known selector references the integrator, but the rule's class is unknown.", _evidence(selector=F.col("_selector"))),
        "INFERRED_UNKNOWN_SELECTOR": ("UNKNOWN_REFERENCE_ATTRIBUTE", "A component call holds the reference in an unknown attribute.", _evidence(reference=F.col("_hit"))),
        "UNCLASSIFIED_REFERENCE": ("UNCLASSIFIED_REFERENCE_RULE", "A rule holds the reference, but neither its class nor a selector is known.", _evidence(reference=F.col("_hit"))),
    }
    problems = unreadable(tags).unionByName(attribute_problems(found)).unionByName(other)
    lost = tags.where("note = 'LOOSE'").select(*_diagnostic("WARNING", "MALFORMED_REFERENCE_CONTEXT", "A reference was found, but no start tag that holds it.", offset=F.col("offset")))
    problems = problems.unionByName(lost)
    if dynamic:
        problems = problems.unionByName(loose)
    for k, (code, message, evidence) in told.items():
        problems = problems.unionByName(found.where(F.col("classification") == k).select(*_diagnostic("WARNING", code, message, offset=F.col("offset"), rule_class=F.col("rule_class"), evidence=evidence)))
    maps = mappings(found, "file", "offset").withColumnRenamed("file", "caller_file").withColumnRenamed("offset", "tag_offset")
    files = held.where("_direct").select(F.col("file").alias("file_path")).distinct()
    return {"caller_references": calls, "caller_mappings": maps, "diagnostics": problems, "referencing_files": files}


def targets() -> Column:
    """Names that a caller gives in its component list and its source."""
    return F.array_distinct(F.concat(*(F.coalesce(resolve.name_targets(F.col(c)), F.array().cast("array<string>")) for c in ("component_list", "source_name"))))


def links(calls: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, diagnostics): each caller with every operation of the products it names, or why there is none."""
    who = F.struct("caller_file", "tag_offset")
    asked = calls.select(who.alias("reference"), targets().alias("targets"))
    ops = operations.select(F.struct("integrator_file", "tag_offset").alias("operation"), "product_name")
    out = resolve.linked(asked, "reference", "targets", ops, "operation", "product_name")
    made = out.where("operation IS NOT NULL").withColumnRenamed("status", "resolution_status")
    lost = out.where("operation IS NULL").join(calls.select(who.alias("reference"), "rule_class"), "reference").withColumn("file", F.col("reference.caller_file"))
    message = F.when(F.col("status") == "NO_API_OPERATION", "The integrator has no known API operation.").otherwise("The caller's target could not be resolved to one product.")
    cols = _diagnostic("WARNING", "", message, offset=F.col("reference.tag_offset"), rule_class=F.col("rule_class"))
    cols[1] = F.col("status").alias("code")
    return made, lost.select(*cols)


def shared_links(calls: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, products) and (products, operation, resolution_status): the same links, once for callers with the same.

    Callers that name the same products have the same operations, so a link is told per set of products and not per
    caller. Names that no product has are left out; what names such alone is in neither table, and callers without any
    name share the empty set.
    """
    named = calls.select(targets().alias("targets")).distinct()
    keys = operations.select(F.lower("product_name").alias("_key")).where("_key <> ''").distinct()
    known = named.select("targets", F.explode("targets").alias("_key")).join(keys, "_key").groupBy("targets").agg(F.array_sort(F.collect_set("_key")).alias("products"))
    known = known.unionByName(named.where(F.size("targets") == 0).withColumn("products", F.col("targets")))
    ops = operations.select(F.struct("integrator_file", "tag_offset").alias("operation"), "product_name")
    made = resolve.linked(known.select("products").distinct(), "products", "products", ops, "operation", "product_name")
    return known, made.where("operation IS NOT NULL").withColumnRenamed("status", "resolution_status")


def build(spark: SparkSession, root: str, integrator_file: str, references: tuple[str, ...] | str | None = None, *, vocabulary: Vocabulary | None = None, ignore_case: bool = False, include_dynamic: bool = False, only: DataFrame | None = None) -> Contracts:
    """Contracts of the integrator and of the corpus below root. `only`: files (file) to look for callers in."""
    closure.shared_folder(spark)  # where checkpoints go
    vocabulary = vocabulary or Vocabulary()
    base = integrator_file.replace("\\", "/").rpartition("/")[2]
    asked = (references,) if isinstance(references, str) else tuple(references or (base,))
    asked = tuple(r for r in asked if r)
    if not asked:
        raise ValueError("reference must not be empty")
    everything = corpus.files(spark, root)
    same = F.col("file").endswith("/" + base) if "/" not in integrator_file else F.regexp_replace("file", "^file:/+", "/") == integrator_file.removeprefix("file:")
    own_tags = corpus.tags(everything.where(same), names=INTEGRATOR_TAGS, vocabulary=vocabulary).checkpoint()
    own = integrator(own_tags, vocabulary)
    others = everything.where(~same)
    if only is not None:
        others = others.join(only.select("file"), "file", "left_semi")
    spelled = variants(asked)
    sought = spelled + (("$$",) if include_dynamic else ())
    hit_tags = corpus.tags(others, vocabulary=vocabulary, references=sought, ignore_case=ignore_case, only_hits=True).checkpoint()
    found = callers(hit_tags, spelled, vocabulary, ignore_case=ignore_case, dynamic=include_dynamic)
    made, lost = links(found["caller_references"], own["odata_operations"])
    problems = own["diagnostics"].unionByName(found["diagnostics"]).unionByName(lost)
    twins = everything.where(F.lower(F.substring_index("file", "/", -1)) == base.lower()).count()
    if twins > 1 and any("/" not in r and "\\" not in r and r.casefold() == base.casefold() for r in asked):
        one = spark.createDataFrame([(integrator_file,)], "file string").select(*_diagnostic("WARNING", "AMBIGUOUS_INTEGRATOR_FILENAME", "Several rule files have the integrator's name.", evidence=_evidence(filename=F.lit(base), candidate_count=F.lit(twins))))
        problems = problems.unionByName(one)
    signature = hashlib.sha256(json.dumps([integrator_file, asked, ignore_case, include_dynamic, vocabulary.payload()], sort_keys=True).encode()).hexdigest()
    tables = {k: v for k, v in own.items() if k != "diagnostics"} | {k: found[k] for k in ("caller_references", "caller_mappings", "referencing_files")}
    tables |= {"caller_operation_links": made, "diagnostics": problems}
    meta = {"schema_version": "1", "integrator_file": integrator_file, "reference": ", ".join(asked), "reference_signature": signature, "ignore_case": str(int(ignore_case)), "include_dynamic": str(int(include_dynamic)), "rule_config": json.dumps(vocabulary.payload(), sort_keys=True)}
    return Contracts(tables, meta)


def summary(made: Contracts) -> dict[str, int | str]:
    """Counts of each table, and the build's status."""
    out: dict = {k: t.count() for k, t in made.tables.items()}
    failed = made.diagnostics.where("code = 'FILE_SCAN_FAILED'").count()
    out["files_failed"] = failed
    out["status"] = "partial_with_errors" if failed else "complete_with_diagnostics" if out["diagnostics"] else "complete"
    return out


SCANNED = "file string, mark string, signature string"


def refresh(spark: SparkSession, store, root: str, integrator_file: str, references: tuple[str, ...] | str | None = None, **options) -> Contracts:
    """Contracts brought up to date in a store: callers are read again only in files that are new or changed.

    A file is known by its length and time and by the signature of the build. Only files that held a reference are
    remembered, so the store stays a slice of the corpus; the others are searched again, which needs no table of them.
    Rows of files that changed or vanished go, links are made anew, and the version is published as a whole.
    """
    closure.shared_folder(spark)
    asked = build(spark, root, integrator_file, references, only=spark.createDataFrame([], "file string"), **options)
    signature = asked.metadata["reference_signature"]
    now = corpus.files(spark, root).select("file", F.concat_ws(":", "length", F.col("modified").cast("double")).alias("mark"))
    before = store.table("scan_files", SCANNED).where(F.col("signature") == signature).select("file", "mark")
    status = resolve.fingerprint_diff(before, now, "file", "mark")
    cached = status.where("status = 'CACHED'").select("file").checkpoint()
    todo = now.join(cached, "file", "left_anti").select("file")
    made = build(spark, root, integrator_file, references, only=todo, **options)
    keep = {"caller_references": "caller_file", "caller_mappings": "caller_file", "caller_diagnostics": "file_path"}
    tables = dict(made.tables)
    linking = F.col("code").isin("AMBIGUOUS_OPERATION_TARGET", "NO_API_OPERATION")
    own = asked.diagnostics.where(~linking).checkpoint()
    # What the integrator's own file is told about comes with every build; the rest belongs to callers.
    fresh = made.diagnostics.where(~linking)
    mine = own.select("file_path", "code", F.coalesce("tag_offset", F.lit(-1)).alias("tag_offset")).distinct()
    tables["caller_diagnostics"] = fresh.join(mine, fresh["file_path"].eqNullSafe(mine["file_path"]) & (fresh["code"] == mine["code"]) & (F.coalesce(fresh["tag_offset"], F.lit(-1)) == mine["tag_offset"]), "left_anti").select(*DIAGNOSTIC)
    for name, at in keep.items():
        old = store.table(name, tables[name].schema).join(cached.withColumnRenamed("file", at), at, "left_semi")
        tables[name] = tables[name].unionByName(old.select(*tables[name].columns))
    hits = tables["referencing_files"].unionByName(cached.select(F.col("file").alias("file_path"))).distinct()
    tables["referencing_files"] = hits
    tables["scan_files"] = now.join(hits, F.col("file") == F.col("file_path"), "left_semi").withColumn("signature", F.lit(signature))
    tables["caller_operation_links"], lost = links(tables["caller_references"], tables["odata_operations"])
    tables["diagnostics"] = own.select(*DIAGNOSTIC).unionByName(tables["caller_diagnostics"]).unionByName(lost)
    return Contracts(tables, made.metadata)
