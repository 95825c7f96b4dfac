"""Reports of contracts, traces and censuses as Markdown and JSON. Ordering and counting stay in Spark."""

from __future__ import annotations

import json
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text
from lodeline.operators import closure, rollup
from lodeline.plans import contracts

ORDER = {
    "odata_operations": ["tag_offset"], "data_sources": ["source_name", "tag_offset"], "integrator_mappings": ["product_name", "mapping_prefix"],
    "caller_references": ["caller_file", "tag_offset"], "caller_mappings": ["caller_file", "tag_offset", "mapping_prefix"],
}
MOST_CHAINS, MOST_ANCHORS, MOST_DEPTH, MOST_SAMPLES = 12, 20, 32, 12


def _cell(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\r", " ").replace("\n", " ").replace("`", "'")


def _table(names: list[str], rows) -> list[str]:
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(_cell(v) for v in r) + " |" for r in rows), ""]


#: Order of a report's blocks; sections first, then what a section is ordered by.
_PLACE = ["section", "rank", "name", "more", "at"]
#: Bytes of lists of lines that are sent to every task, and lines of lists that a task gives.
MOST_SENT, TASK_LINES = 32 << 20, 4_000_000


def _escaped(c: Column) -> Column:
    """The same as _cell, as a column."""
    return F.translate(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n`", "  '")


def _block(rows: DataFrame, section: int, lines: Column, *, products: str | None = None, tail: Column | None = None, rank: Column | None = None, name: str | None = None, more: str | None = None, at: str | None = None) -> DataFrame:
    key = lambda c, kind: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(kind)
    return rows.select(F.lit(section).alias("section"), key(rank, "long").alias("rank"), key(name, "string").alias("name"), key(more, "string").alias("more"), key(at, "long").alias("at"), lines.alias("lines"), key(products, "array<string>").alias("products"), (F.array() if tail is None else tail).cast("array<string>").alias("tail"))


def _row(*cells: Column) -> Column:
    return F.array(F.concat(F.lit("| "), F.concat_ws(" | ", *map(_escaped, cells)), F.lit(" |")))


def contract_blocks(made) -> tuple[DataFrame, DataFrame]:
    """The report of a contract as rows (section, rank, name, more, at, lines, products, tail): headings, table rows and
    callers, each with its lines; and rows (products, lines): the operations of callers, whose lines stand between a
    block's lines and its tail. Operations and callers are in order of their place, diagnostics by severity."""
    spark = made.odata_operations.sparkSession
    ops = made.odata_operations.withColumn("request", F.concat_ws(" ", "action", text.joined_path(F.col("base_url"), F.col("api_path"))))
    cols = ["rule_name", "rule_class", "product_name", "phase_name", "classification", "disabled", "source_name", "request", "filter_expr", "request_group", "results_group", "output_group"]
    sources, maps_of = ["source_name", "class_type", "base_url"], ["product_name", "mapping_prefix", "exported_property", "property_key", "direction"]
    told, counted = {"severity": "severity", "code": "code", "file": "file_path", "offset": "tag_offset", "message": "message"}, {"class": "rule_class", "count": "occurrence_count"}
    head = lambda names: _table(list(names), [])[:-1]
    first = ["# Integrator contract", "", *(f"- {k}: `{_cell(made.metadata.get(k))}`" for k in ("integrator_file", "reference")), "", "## API requests", ""]
    heads = [
        (0, [*first, *(["No API rule was recognized."] if ops.isEmpty() else head(cols))]), (2, ["", "## Data sources", "", *head(sources)]), (4, ["", "## Product mappings", "", *head(maps_of)]),
        (6, ["", "## Callers", ""]), (8, ["## Diagnostics", "", *head(told)]), (10, ["", "## Rule classes", "", *head(counted)]), (12, [""]),
    ]
    named = made.odata_operations.select(F.struct("integrator_file", "tag_offset").alias("operation"), F.col("rule_name").alias("calls"))
    said = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    listed = lambda kind, c: F.transform(c, lambda x: said(f"- {kind}: ", _escaped(x)))
    # Operations are sorted lists, one for all callers that name the same products; a caller's mappings come to it as one.
    known, links = contracts.shared_links(made.caller_references, made.odata_operations)
    lists = links.join(named, "operation").groupBy("products").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "resolution_status", "calls"))).alias("calls"))
    lists = closure.kept(lists.select("products", listed("operation", F.col("calls")).alias("lines")), "lists")
    known = known.join(lists.select("products"), "products", "left_semi")
    maps = made.caller_mappings.groupBy(F.struct("caller_file", "tag_offset").alias("reference")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "mapping_prefix", "direction", "solution_data_item", F.lit("<->"), "property_key"))).alias("maps"))
    callers = made.caller_references.withColumn("reference", F.struct("caller_file", "tag_offset")).withColumn("targets", contracts.targets()).join(known, "targets", "left").join(maps, "reference", "left")
    title = F.coalesce(*(F.when(_escaped(F.col(c)) != "", _escaped(F.col(c))) for c in ("rule_name", "rule_eid")), F.lit("Unnamed rule"))
    own = F.array(
        said("### ", title), F.lit(""), said("- file: `", _escaped(F.col("caller_file")), "` at byte ", F.col("tag_offset").cast("string")),
        said("- class: `", _escaped(F.col("rule_class")), "`, ", F.col("classification"), ", disabled: ", F.when(F.col("disabled"), "yes").otherwise("no")), said("- selector: `", _escaped(F.col("selector")), "`"),
    )
    own = F.when(F.col("products").isNull(), F.concat(own, F.array(F.lit("- operation: unresolved")))).otherwise(own)
    mapped = F.coalesce("maps", F.array().cast("array<string>"))
    severity = rollup.ranked(F.col("severity"), ["ERROR", "WARNING"])
    blocks = [
        spark.createDataFrame(heads, "section int, lines array<string>").transform(lambda d: d.select("section", *(F.lit(None).cast(t).alias(c) for c, t in zip(_PLACE[1:], ("long", "string", "string", "long"))), "lines", F.lit(None).cast("array<string>").alias("products"), F.array().cast("array<string>").alias("tail"))),
        _block(ops, 1, _row(*(F.initcap(F.col(c).cast("string")) if c == "disabled" else F.col(c) for c in cols)), at="tag_offset"),
        _block(made.data_sources, 3, _row(*map(F.col, sources)), name="source_name", at="tag_offset"),
        _block(made.integrator_mappings, 5, _row(*map(F.col, maps_of)), name="product_name", more="mapping_prefix"),
        _block(callers, 7, own, products="products", tail=F.concat(listed("mapping", mapped), F.array(F.lit(""))), name="caller_file", at="tag_offset"),
        _block(made.diagnostics, 9, _row(*map(F.col, told.values())), rank=severity, name="file_path", at="tag_offset"),
        _block(made.rule_class_census, 11, _row(*map(F.col, counted.values())), rank=-F.col("occurrence_count"), name="rule_class"),
    ]
    return reduce(DataFrame.unionByName, blocks), lists


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition with the partition's number and how many of its lines stand before them."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b["n"].to_numpy(zero_copy_only=False)
        upto = before + n.cumsum()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(upto - n, pa.int64()), *b.columns], names=["part", "first", *b.schema.names])
        before = int(upto[-1]) if len(n) else before


def numbered(blocks: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """(place, line) of all lines in the order of their blocks, from 0. Blocks are sorted in ranges and lines counted per
    range; of each range one number comes to the driver, and no line does.

    lists: (products, lines), which blocks with these products have between their lines and their tail. Blocks are sorted
    and numbered with the lengths of lists alone; the lines are laid out last, where they are read."""
    spark = blocks.sparkSession
    if lists is None:
        lists = spark.createDataFrame([], "products array<string>, lines array<string>")
        blocks = blocks.select("*", F.lit(None).cast("array<string>").alias("products"), F.array().cast("array<string>").alias("tail"))
    blocks = blocks.join(lists.select("products", F.size("lines").cast("long").alias("inner")), "products", "left").withColumn("inner", F.coalesce("inner", F.lit(0).cast("long")))
    # Kept, since finding the ranges reads the blocks once more.
    blocks = closure.kept(blocks.withColumn("n", F.size("lines") + F.col("inner") + F.size("tail")).where("n > 0"), "blocks")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = blocks.repartitionByRange(width, *_PLACE).sortWithinPartitions(*_PLACE, "lines", "tail").select("lines", "products", "tail", "inner", "n")
    parts = closure.kept(in_order.mapInArrow(_counted, "part int, first long, lines array<string>, products array<string>, tail array<string>, inner long, n long"), "lines")
    sizes = {r["part"]: r for r in parts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("inner").alias("inner")).collect()}
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]["n"]
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    parts = parts.join(base, "part").withColumn("start", F.col("base") + F.col("first"))
    ahead = F.size("lines")
    own = parts.select("start", "inner", ahead.alias("ahead"), F.posexplode(F.concat("lines", "tail")).alias("k", "line"))
    own = own.select((F.col("start") + F.col("k") + F.when(F.col("k") >= F.col("ahead"), F.col("inner")).otherwise(0)).alias("place"), "line")
    inner = sum(r["inner"] for r in sizes.values())
    if not inner:
        return own
    # Rows that stand for many lines each are dealt out evenly; lists go to them unless they are large.
    dealt = parts.where("inner > 0").select((F.col("start") + ahead).alias("start"), "products").repartition(max(width, -(-inner // TASK_LINES)))
    held = lists.agg(F.sum(F.length(F.concat_ws("", "products", "lines")))).first()[0] or 0
    laid = dealt.join(F.broadcast(lists) if held <= MOST_SENT else lists, "products").select("start", F.posexplode("lines").alias("k", "line"))
    return own.unionByName(laid.select((F.col("start") + F.col("k")).alias("place"), "line"))


def contract_lines(made) -> Iterator[str]:
    """The lines of the Markdown report, some at a time."""
    return (r["line"] for r in numbered(*contract_blocks(made)).orderBy("place").toLocalIterator())


def contracts_markdown(made) -> str:
    """A Markdown report; operations and callers in order of their place, diagnostics by severity."""
    return "\n".join(contract_lines(made))


def contracts_json(made) -> str:
    tables = {}
    for name, df in made.tables.items():
        ordered = df.orderBy(*ORDER[name]) if name in ORDER else df
        tables[name] = [json.loads(x) for x in ordered.toJSON().collect()]
    return json.dumps({"metadata": made.metadata, **tables}, ensure_ascii=False, indent=2)


def chains(evidence: dict, seed: str) -> list[list[str]]:
    """A shortest way from an anchor to each API call it draws values from, found breadth first."""
    by_id = {e["id"]: e for e in evidence["events"]}
    back = defaultdict(list)
    for x in evidence["edges"]:
        if x.get("dependency_role") != "control":
            back[x["to"]].append(x["from"])
    came, queue, out = {seed: None}, deque([seed]), []
    while queue:
        at = queue.popleft()
        if by_id.get(at, {}).get("api"):
            way, k = [], at
            while k is not None:
                way.append(k)
                k = came[k]
            out.append(way)
            continue
        for p in back[at]:
            if p in by_id and p not in came:
                came[p] = at
                queue.append(p)
    return out


def _way(evidence: dict, way: list[str]) -> str:
    by_id = {e["id"]: e for e in evidence["events"]}
    if len(way) > MOST_DEPTH:
        way = [*way[: MOST_DEPTH // 2], None, *way[-MOST_DEPTH // 2 :]]
    return " -> ".join("…" if k is None else f"{by_id[k]['name']} ({by_id[k]['kind']})" for k in way)


def summary_markdown(evidence: dict) -> str:
    """A bounded summary: anchors, ways to API calls, blockers and issues, each list with how many more there are."""
    c = evidence["conclusions"]
    lines = ["# Trace summary", "", f"- target: `{_cell(json.dumps(evidence.get('target', {}), ensure_ascii=False))}`", f"- status: **{c['overall_status']}**", f"- files: {evidence['coverage']['files_read']}, contexts: {evidence['coverage']['contexts_examined']}", ""]
    names = {e["id"]: e["name"] for e in evidence["events"]}
    for a in c["anchors"][:MOST_ANCHORS]:
        lines += [f"## {_cell(names.get(a['seed'], a['seed']))}: {a['status']}", ""]
        ways = chains(evidence, a["seed"])
        lines += [f"- {_way(evidence, w)}" for w in ways[:MOST_CHAINS]] + [f"- … {len(ways) - MOST_CHAINS} more"] * (len(ways) > MOST_CHAINS)
        lines += [f"- blocker {b['code']} ({b['count']}): {', '.join(b['events'][:3])}" for b in a["blockers"]] + [""]
    if len(c["anchors"]) > MOST_ANCHORS:
        lines += [f"… {len(c['anchors']) - MOST_ANCHORS} more anchors", ""]
    by_code = Counter(i["code"] for i in evidence["issues"])
    lines += [f"- issue {k}: {n}" for k, n in by_code.most_common(MOST_SAMPLES)] + [f"- … {len(by_code) - MOST_SAMPLES} more codes"] * (len(by_code) > MOST_SAMPLES)
    return "\n".join(lines) + "\n"


def trace_markdown(evidence: dict) -> str:
    nodes = evidence["nodes"]
    lines = ["# Trace evidence", "", "## Events", ""]
    rows = [(e["id"], e["kind"], e["name"], nodes[e["node"]]["file"], nodes[e["node"]]["line"], ", ".join(f["path"] for f in e["reads"]), ", ".join(f["path"] for f in e["writes"]), e["slice_role"], e.get("scenario", {}).get("status", "")) for e in evidence["events"]]
    lines += _table(["id", "kind", "name", "file", "line", "reads", "writes", "role", "scenario"], rows)
    lines += ["## Definitions", "", *_table(["from", "to", "field", "relation", "order", "conditional"], [(x["from"], x["to"], x["field"]["path"], x["relation"], x["event_order"], x["conditional"]) for x in evidence["edges"]])]
    lines += ["## Open inputs", "", *_table(["event", "field", "status"], [(i["event"], i["field"]["path"], i["status"]) for i in evidence["inputs"]])]
    for e in evidence["events"]:
        for concept, t in e.get("api", {}).get("templates", {}).items():
            if t["variants"]:
                lines += [f"## {_cell(e['name'])}: {concept}", "", *_table(["template", "conditions"], [(v["template"], "; ".join(f"{g['condition']} is {g['branch']}" for g in v["guards"])) for v in t["variants"]])]
    if evidence.get("scenario"):
        lines += ["## Conditions", "", *_table(["event", "expression", "result", "reason"], [(x["event"], x["expression"], x["result"], x["reason"]) for x in evidence["scenario"]["conditions"]])]
    lines += ["## Issues", "", *_table(["code", "details"], [(i["code"], json.dumps({k: v for k, v in i.items() if k != "code"}, ensure_ascii=False)[:320]) for i in evidence["issues"]])]
    return "\n".join(lines)


def write_bundle(folder: str, traces: list[dict], request: dict, performance: dict) -> None:
    """evidence.json, next.json, report.md, summary.md and performance.json."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files = {k: v for t in traces for k, v in t["files"].items()}
    before = request.get("file_fingerprints", {})
    for t in traces:
        t["issues"] += [{"code": "SOURCE_CHANGED_SINCE_REQUEST", "file": k} for k, v in t["files"].items() if before.get(k, v) != v]
    follow = {**{k: request.get(k) for k in ("path_variables", "rules_config", "max_files", "max_contexts")}, "schema_version": 1, "targets": [t["target"] for t in traces], "file_fingerprints": files, "pending": [{k: t[k] for k in ("target", "issues", "inputs")} for t in traces]}
    whole = traces[0] if len(traces) == 1 else {"schema_version": 1, "traces": traces}
    for name, body in (("evidence.json", whole), ("next.json", follow), ("performance.json", performance)):
        (out / name).write_text(json.dumps(body, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    rule = "\n\n---\n\n"
    (out / "report.md").write_text(rule.join(map(trace_markdown, traces)), encoding="utf-8")
    (out / "summary.md").write_text(rule.join(map(summary_markdown, traces)), encoding="utf-8")
