"""python -m lodeline build|report|trace|inspect: the engine on a corpus of rule files."""

from __future__ import annotations

import argparse
import json
import sys
import time
from contextlib import nullcontext
from pathlib import Path

from pyspark.sql import SparkSession

from lodeline.config import ConfigError, read_config, vocabulary


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="extract contracts into a store")
    b.add_argument("root")
    b.add_argument("--integrator", required=True)
    b.add_argument("--store", required=True)
    b.add_argument("--reference", action="append")
    b.add_argument("--ignore-case", action="store_true")
    b.add_argument("--include-dynamic-references", action="store_true")
    b.add_argument("--fresh", action="store_true", help="forget what earlier builds found")
    b.add_argument("--quiet", action="store_true")
    r = sub.add_parser("report", help="render a store")
    r.add_argument("--store", required=True)
    r.add_argument("--format", choices=("markdown", "json"), default="markdown")
    r.add_argument("--output")
    t = sub.add_parser("trace", help="trace fields or rules backwards")
    t.add_argument("root")
    t.add_argument("--file")
    for name in ("--eid", "--field", "--rule-eid", "--entry", "--request", "--scenario", "--output"):
        t.add_argument(name)
    t.add_argument("--max-files", type=int)
    t.add_argument("--max-contexts", type=int)
    cache = t.add_mutually_exclusive_group()
    cache.add_argument("--cache-dir", help="folder of an eid index kept up to date, read in place of the corpus")
    cache.add_argument("--no-cache", action="store_true", help="search the corpus for an eid anew")
    i = sub.add_parser("inspect", help="census of rule classes and findings")
    i.add_argument("root")
    i.add_argument("--output", required=True)
    i.add_argument("--max-samples", type=int, default=5)
    i.add_argument("--max-files", type=int, default=10_000)
    i.add_argument("--quiet", action="store_true")
    for c in (b, t, i):
        c.add_argument("--rules-config")
    for c in (t, i):
        c.add_argument("--path-var", action="append", default=[])
    for c in (b, t):
        c.add_argument("--strict", action="store_true")
    return p


def _variables(pairs: list[str]) -> dict[str, str]:
    if any("=" not in x for x in pairs):
        raise ConfigError("--path-var needs NAME=PATH")
    return dict(x.split("=", 1) for x in pairs)


def _build(spark, args) -> int:
    from lodeline.functions.text import duration
    from lodeline.plans import contracts
    from lodeline.sources import corpus
    from lodeline.sources.store import Store, publish_contracts

    began, store = time.time(), Store(spark, args.store)
    if args.fresh:
        store.reset()
    before = corpus.listing(spark, args.root)
    voc = vocabulary(read_config(args.rules_config))
    made = contracts.refresh(spark, store, args.root, args.integrator, tuple(args.reference) if args.reference else None, vocabulary=voc, ignore_case=args.ignore_case, include_dynamic=args.include_dynamic_references)
    counts = publish_contracts(store, made, spark=spark, listing=(args.root, before))
    if not args.quiet:
        print(json.dumps(counts), duration(time.time() - began))
    return 2 if args.strict and counts["diagnostics"] else 0


def _report(spark, args) -> int:
    from lodeline.plans import report
    from lodeline.plans.contracts import Contracts
    from lodeline.sources.store import Store

    store = Store(spark, args.store)
    made = Contracts({n: store.table(n) for n in store.names()}, store.metadata())
    with open(args.output, "w", encoding="utf-8") if args.output else nullcontext(sys.stdout) as out:
        if args.format == "json":
            out.write(report.contracts_json(made))
        else:
            for k, line in enumerate(report.contract_lines(made)):
                out.write("\n" * (k > 0) + line)
        if not args.output:
            out.write("\n")
    return 0


def _trace(spark, args) -> int:
    from lodeline.plans import locate, report, trace
    from lodeline.sources.store import Store

    began = time.time()
    request = json.loads(Path(args.request).read_text(encoding="utf-8")) if args.request else {}
    config = read_config(args.rules_config)
    variables = {**(request.get("path_variables") or {}), **_variables(args.path_var)}
    load = lambda f: Path(args.root, f).read_bytes()
    if args.eid:
        asked = spark.createDataFrame([(args.eid,)], "eid string")
        # The index is known by file length and time; only new and changed files are read for it.
        index = locate.refresh(spark, Store(spark, args.cache_dir), args.root) if args.cache_dir else None
        files = [args.file] if args.file else [r["file"] for r in locate.candidates(spark, args.root, asked, index).select(trace.relative("file", args.root).alias("file")).collect()]
        targets = [locate.located(load, args.eid, files, args.entry)]
    elif args.file:
        if bool(args.field) == bool(args.rule_eid):
            raise ValueError("Supply one of --field and --rule-eid")
        targets = [{"file": args.file, "field": args.field, "rule_eid": args.rule_eid, "entry": args.entry}]
    else:
        targets = request.get("targets") or []
    if not targets:
        raise ValueError("Supply --eid, --file with one of --field/--rule-eid, or a request with targets")
    scenario = Path(args.scenario).read_text(encoding="utf-8") if args.scenario else None
    rows = [(k, t["file"], t.get("field"), t.get("rule_eid"), t.get("entry"), scenario or (json.dumps(t["scenario"]) if t.get("scenario") else None)) for k, t in enumerate(targets)]
    limits = {"max_files": args.max_files or request.get("max_files") or 50, "max_contexts": args.max_contexts or request.get("max_contexts") or 5000}
    got = trace.trace_targets(spark, args.root, spark.createDataFrame(rows, trace.TARGET), config=config, variables=variables, **limits)
    traces = [json.loads(r["evidence"]) for r in got.orderBy("target_id").collect()]
    if bad := [t["error"] for t in traces if "error" in t]:
        raise ValueError("; ".join(bad))
    out = args.output or "trace-output"
    if Path(out).resolve() == Path(args.root).resolve():
        raise ValueError("Trace output must differ from the corpus")
    report.write_bundle(out, traces, request | limits | {"path_variables": variables}, {"schema_version": 1, "total_seconds": time.time() - began})
    print(f"Trace bundle: {out}; files={sum(t['coverage']['files_read'] for t in traces)}; contexts={sum(len(t['events']) for t in traces)}")
    if any(t["failed"] for t in traces):
        return 1
    return 2 if args.strict and any(t["issues"] or t["inputs"] for t in traces) else 0


def _inspect(spark, args) -> int:
    from lodeline.plans import census

    config = read_config(args.rules_config)
    if min(args.max_files, args.max_samples) < 1:
        raise ValueError("inspect limits must be positive")
    rows = census.inspected(spark, args.root, config=config, variables=_variables(args.path_var), max_files=args.max_files)
    tables = census.census(rows, max_samples=args.max_samples)
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    (out / "census.md").write_text(census.census_markdown(tables), encoding="utf-8")
    (out / "census.json").write_text(json.dumps({k: [json.loads(x) for x in t.toJSON().collect()] for k, t in tables.items()}, ensure_ascii=False, indent=2), encoding="utf-8")
    (out / "todo.md").write_text(census.todo_markdown(tables), encoding="utf-8")
    (out / "rules-config.json").write_text(json.dumps(config, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    if not args.quiet:
        c = tables["coverage"].first()
        print(f"Census: {out}; files={c['files_scanned']}; rules={c['rules']}; understood={c['semantically_understood_rules']}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 done, 1 incomplete or wrong input, 2 findings under --strict."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodeline").getOrCreate()
    from lodeline.operators.closure import shared_folder

    shared_folder(spark)
    try:
        return {"build": _build, "report": _report, "trace": _trace, "inspect": _inspect}[args.command](spark, args)
    except (ValueError, OSError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
