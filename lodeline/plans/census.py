"""Compatibility census: what a corpus' rules are, how far a trace understands them, and findings with samples.

Each file is read on its own in one task and gives rows: a row per rule and a row per finding. Counts, samples and
coverage are aggregations over these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.config import BRANCHES, Semantics, Vocabulary, vocabulary
from lodeline.operators import closure, rollup
from lodeline.plans.expand import Effects, Node, Source, component_paths, ends_with, filled, selector, truthy
from lodeline.plans.trace import relative
from lodeline.sources import corpus

# Findings with their severity, what they mean and what to do.
HELP = {
    "UNKNOWN_RULE": ("warning", "A trace does not see what the rule does.", "Give the class a kind once its reads, writes and control are confirmed."),
    "UNKNOWN_BRANCH": ("warning", "The child runs under a condition that is not known.", "Declare the parent's branch attribute and labels."),
    "MISSING_SET_TARGET": ("warning", "The assignment writes nothing that is recognized.", "Check the type and the target attribute."),
    "MISSING_ASSIGNMENT_SOURCE": ("warning", "The assignment's source attribute is absent.", "Check the source type and its attribute."),
    "UNSUPPORTED_ASSIGNMENT_TARGET_TYPE": ("warning", "The target type has no semantics.", "Adapt the rule once its target is confirmed."),
    "UNSUPPORTED_ASSIGNMENT_SOURCE_TYPE": ("warning", "The source type has no semantics.", "Adapt the rule once its source is confirmed."),
    "MISSING_EXPRESSION": ("warning", "A condition or expression is empty.", "Configure its attribute, or confirm that it may be empty."),
    "MISSING_COMPONENT_SELECTOR": ("warning", "A call names no file.", "Configure the selector's attribute."),
    "DYNAMIC_COMPONENT": ("warning", "A call's file depends on a variable.", "Give the path variable."),
    "COMPONENT_NOT_FOUND": ("error", "A call's file is not in the corpus.", "Add the file or correct the path."),
    "COMPONENT_NOT_UNIQUE": ("error", "A call may mean several files.", "Make the path unique."),
    "OUTSIDE_ROOT": ("error", "A call's file is outside the corpus.", "Choose a root that holds it."),
    "API_ATTRIBUTE_CONFLICT": ("warning", "Several attributes give a concept different values.", "Override the concept for the class."),
    "MISSING_API_METHOD": ("warning", "An API rule has no method.", "Map the class to a method."),
    "API_TRACE_SEMANTIC_CONFLICT": ("error", "A class is both an API rule and a traced kind.", "Keep one of the two."),
    "TRUNCATED_ATTRIBUTE": ("warning", "A value was cut.", "Read the source at its offset."),
    "DUPLICATE_ATTRIBUTE": ("warning", "An attribute stands twice; the last counts.", "Correct the export."),
    "FILE_ERROR": ("error", "A file could not be read.", "Correct the file."),
    "FILE_DISCOVERY_ERROR": ("error", "A folder could not be listed.", "Check its permissions."),
    "SCAN_FILE_LIMIT": ("error", "Files were left out.", "Raise the limit."),
    "LINK_NOT_FOUND": ("error", "A shared rule is missing.", "Correct the reference."),
    "LINK_NOT_UNIQUE": ("error", "A shared rule's eid stands several times.", "Make the eid unique."),
    "LINK_RECURSIVE": ("error", "A shared rule refers to itself.", "Break the cycle."),
}
SCALAR = ("source", "method", "path", "base_url", "filter", "payload", "header_name", "header_value", "language")
KIND = "file string, offset long, line long, row string, category string, class string, disabled boolean, understood boolean, code string, details string"


class Inspector:
    """Rows of one file."""

    def __init__(self, voc: Vocabulary, semantics: Semantics, variables: dict[str, str], there):
        self.voc, self.semantics, self.variables, self.there = voc, semantics, variables, there

    def rows(self, file: str, content: bytes) -> Iterator[dict]:
        try:
            src = Source(file, content, self.semantics.branch_attributes)
        except (ValueError, UnicodeError) as e:
            yield {"file": file, "row": "finding", "code": "FILE_ERROR", "details": json.dumps({"message": str(e)})}
            return
        yield {"file": file, "row": "file", "details": json.dumps({"sha256": src.sha256, "size": src.size})}
        off: dict[int, bool] = {}
        for n in src.nodes:
            bag = Semantics.normal(n.attributes, self.semantics.of(_class(n))) if n.tag == "Rule" else n.kept
            off[n.offset] = truthy(bag.get("RuleDisabled")) or (n.parent is not None and off[n.parent.offset])
            if n.tag == "Rule":
                yield from self.rule(src, n, off[n.offset])
            for p in src.problems.get(n.key, []):
                yield self.found(n, p["code"], **{k: v for k, v in p.items() if k not in ("code", "node")})

    @staticmethod
    def found(n: Node, code: str, **more) -> dict:
        return {"file": n.file, "offset": n.offset, "line": n.line, "row": "finding", "code": code, "details": json.dumps({"eid": n.eid, "name": n.name, **more}, ensure_ascii=False)}

    def rule(self, src: Source, n: Node, disabled: bool) -> Iterator[dict]:
        raw, cls = n.attributes, _class(n)
        shown = cls or "<missing>"
        spec = self.semantics.of(cls)
        bag, kind, api = Semantics.normal(raw, spec), spec["kind"], self.voc.api_match(cls)
        link = raw.get("LinkReference")
        traced = kind != "unknown" or bool(link)
        category = "api" if api else ("project" if spec["origin"] == "project_extension" else "standard") if traced else "component_class_only" if self.voc.is_component(cls) else "unknown"
        yield {"file": n.file, "offset": n.offset, "line": n.line, "row": "rule", "category": category, "class": shown, "disabled": disabled, "understood": traced or bool(api)}
        say = lambda code, **more: self.found(n, code, rule_class=shown, **more)
        if category == "unknown":
            yield say("UNKNOWN_RULE")
        if link:
            target = link.strip()
            hits = src.by_eid.get(target, [])
            if len(hits) != 1:
                yield say("LINK_NOT_UNIQUE" if hits else "LINK_NOT_FOUND", target=target)
            elif hits[0] is n:
                yield say("LINK_RECURSIVE", target=target)
            return
        if api:
            if kind != "unknown":
                yield say("API_TRACE_SEMANTIC_CONFLICT", trace_kind=kind)
            if not (filled(raw, self.voc.names("method", cls)) or ends_with(raw, "method") or self.voc.method_match(cls)):
                yield say("MISSING_API_METHOD")
            low = {k.casefold(): v for k, v in raw.items()}
            for concept in SCALAR:
                given = {x: low[x.casefold()] for x in self.voc.names(concept, cls) if low.get(x.casefold())}
                if not self.voc.overridden(cls, concept) and len(set(given.values())) > 1:
                    yield say("API_ATTRIBUTE_CONFLICT", concept=concept, attributes=given)
        if kind in ("evaluate", "expression") and not bag.get("Expression"):
            yield say("MISSING_EXPRESSION", trace_kind=kind)
        if kind == "set":
            yield from self.assignment(bag, say)
        if kind == "evaluate":
            by, labels = spec.get("branch_attribute", "RuleType"), spec.get("branches", BRANCHES)
            for c in n.children:
                if c.tag == "Rule" and c.kept.get(by, "") not in labels:
                    yield self.found(c, "UNKNOWN_BRANCH", parent_rule_class=shown, branch_attribute=by, label=c.kept.get(by, ""))
        if kind == "call":
            yield from self.call(n, raw, spec, cls, say)

    @staticmethod
    def assignment(bag, say) -> Iterator[dict]:
        target, origin = bag.get("Type", "Data Item"), bag.get("FromType", "Value")
        if target not in Effects.TYPES:
            yield say("UNSUPPORTED_ASSIGNMENT_TARGET_TYPE", target_type=target)
        elif not bag.get(Effects.TYPES[target][0]):
            yield say("MISSING_SET_TARGET", attribute=Effects.TYPES[target][0])
        if origin in Effects.TYPES:
            if not bag.get("From" + Effects.TYPES[origin][0]):
                yield say("MISSING_ASSIGNMENT_SOURCE", attribute="From" + Effects.TYPES[origin][0])
        elif origin != "Value":
            yield say("UNSUPPORTED_ASSIGNMENT_SOURCE_TYPE", source_type=origin)

    def call(self, n, raw, spec, cls, say) -> Iterator[dict]:
        value = selector(raw, spec, self.voc.names("selector", cls))
        if not value:
            yield say("MISSING_COMPONENT_SELECTOR")
            return
        paths = component_paths(value, n.file, self.variables)
        if paths is None:
            yield say("DYNAMIC_COMPONENT", selector=value)
        elif all(p.startswith(("..", "/")) for p in paths):
            yield say("OUTSIDE_ROOT", selector=value)
        else:
            # Whether the files are there is settled by a join over all files.
            yield {**say("COMPONENT", selector=value), "row": "call", "details": json.dumps({"paths": [p for p in paths if not p.startswith(("..", "/"))], "selector": value, "rule_class": cls})}


def _class(n: Node) -> str:
    return n.attributes.get("RuleClassName", n.attributes.get("ClassType", ""))


def inspected(spark: SparkSession, root: str, *, config: dict | None = None, variables: dict[str, str] | None = None, max_files: int | None = None) -> DataFrame:
    """Rows of kind file, rule and finding of a corpus. max_files: inspect the first so many files by name; that others
    were left out is a finding."""
    if max_files is not None and max_files < 1:
        raise ValueError("inspect limits must be positive")
    closure.shared_folder(spark)  # where checkpoints go
    voc, semantics = vocabulary(config or {}), Semantics(config or {})
    contents = corpus.files(spark, root).select(relative(F.col("file"), root).alias("file"), "content")
    names = [f.split()[0] for f in KIND.split(",")]
    everything, left_out = contents, None
    if max_files is not None and (discovered := contents.count()) > max_files:
        first = contents.select("file").orderBy(F.lower("file"), "file").limit(max_files)
        contents = contents.join(first, "file", "left_semi")
        told = json.dumps({"discovered": discovered, "max_files": max_files, "omitted": discovered - max_files})
        left_out = spark.createDataFrame([("", None, None, "finding", None, None, None, None, "SCAN_FILE_LIMIT", told)], KIND)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = Inspector(voc, semantics, variables or {}, None)
        for pdf in batches:
            rows = [r for f, c in zip(pdf["file"], pdf["content"]) for r in look.rows(f, bytes(c))]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    rows = contents.mapInPandas(run, KIND).checkpoint()
    calls = rows.where("row = 'call'")
    there = everything.select(F.col("file").alias("path")).distinct()
    wanted = calls.select("file", "offset", F.explode(F.from_json("details", "struct<paths: array<string>>")["paths"]).alias("path"))
    hits = wanted.join(there, "path").groupBy("file", "offset").agg(F.countDistinct("path").alias("n"))
    missed = calls.join(hits, ["file", "offset"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
    missed = missed.withColumn("code", F.when(F.col("n") == 0, "COMPONENT_NOT_FOUND").otherwise("COMPONENT_NOT_UNIQUE")).withColumn("row", F.lit("finding")).drop("n")
    out = rows.where("row <> 'call'").unionByName(missed.select(*rows.columns))
    return out if left_out is None else out.unionByName(left_out)


def census(rows: DataFrame, *, max_samples: int = 5) -> dict[str, DataFrame]:
    """classes (category, class, n), coverage (one row) and findings (code, n, samples, more, severity, impact, action)."""
    rules = rows.where("row = 'rule'")
    classes = rules.groupBy("category", "class").agg(F.count("*").alias("n"))
    coverage = rows.agg(
        F.count_if(F.col("row") == "file").alias("files_scanned"), F.count_if(F.col("code") == "FILE_ERROR").alias("files_failed"),
        F.count_if(F.col("row") == "rule").alias("rules"), F.count_if((F.col("row") == "rule") & F.col("disabled")).alias("disabled_rules"),
        F.count_if((F.col("row") == "rule") & F.col("understood")).alias("semantically_understood_rules"),
        *(F.count_if(F.col("category") == c).alias(f"{c}_rules") for c in ("api", "standard", "project", "component_class_only", "unknown")),
    )
    sample = F.struct("file", "offset", "line", "details")
    found = rollup.findings(rows.where("row = 'finding'").withColumn("sample", sample), "code", "sample", max_samples)
    told = F.create_map(*(x for k, v in HELP.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("code")]
    found = found.select("code", "n", "samples", "more", told[0].alias("severity"), told[1].alias("impact"), told[2].alias("action"))
    return {"classes": classes, "coverage": coverage, "findings": found}


def census_markdown(tables: dict[str, DataFrame]) -> str:
    c = tables["coverage"].collect()[0].asDict()
    lines = ["# Compatibility census", "", *(f"- {k}: {v}" for k, v in c.items()), "", "## Classes", ""]
    lines += [f"- {r['category']}: `{r['class']}` {r['n']}" for r in tables["classes"].orderBy("category", F.lower("class")).collect()] + ["", "## Findings", ""]
    for r in tables["findings"].orderBy("code").collect():
        lines += [f"### {r['code']} ({r['severity']}, {r['n']})", "", f"{r['impact']} {r['action']}", ""]
        lines += [f"- {s['file']}:{s['line']} {s['details']}" for s in r["samples"]] + [f"- … {r['more']} more"] * (r["more"] > 0) + [""]
    return "\n".join(lines)


def todo_markdown(tables: dict[str, DataFrame]) -> str:
    """What is left to adapt: unknown classes by frequency, then findings by severity."""
    lines = ["# To adapt", ""]
    unknown = tables["classes"].where("category IN ('unknown', 'component_class_only')").orderBy(F.desc("n"), F.lower("class"))
    lines += [f"- [ ] `{r['class']}` ({r['n']}): confirm what it reads, writes and controls" for r in unknown.collect()]
    rank = rollup.ranked(F.col("severity"), ["error", "warning"])
    lines += [f"- [ ] {r['code']} ({r['n']}): {r['action']}" for r in tables["findings"].orderBy(rank, "code").collect()]
    return "\n".join(lines) + "\n"
