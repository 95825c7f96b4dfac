import json

import pytest
from tests.fixtures import clinic, lineage

from lodeline.config import ConfigError, Semantics, vocabulary
from lodeline.plans import census, contracts, locate, report, trace
from lodeline.sources.store import Store, publish_contracts


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return contracts.build(spark, clinic(tmp_path_factory.mktemp("c") / "corpus"), "ClinicHub.ifp")


def test_operations_and_sources(made):
    assert rows(made.odata_operations, "rule_eid", "product_name", "phase_name", "classification", "action", "base_url", "api_path", "disabled") == [
        ("R1", "FindPatient", "Go", "CONFIRMED", "GET", "https://hub.test/odata/", "/patients", False),
        ("R2", "Book", "Send", "CONFIRMED", "POST", "https://hub.test/v2", "slots", True),
    ]
    assert made.data_sources.count() == 2
    assert rows(made.integrator_mappings, "product_name", "mapping_prefix", "direction") == [("Book", "Slot", "INOUT"), ("FindPatient", "Name", "OUTPUT")]
    assert rows(made.rule_class_census, "rule_class", "occurrence_count") == [("EvaluateRule", 1), ("SwaggerIntegrationRule", 1), ("a.b.InvokeIRISRule", 1)]


def test_callers_links_and_diagnostics(made):
    kinds = {(r["rule_name"], r["classification"]) for r in made.caller_references.collect()}
    assert kinds == {("Ask hub", "CONFIRMED"), ("Book it", "CONFIRMED"), ("Legacy", "CONFIRMED_UNKNOWN_RULE"), (None, "UNCLASSIFIED_REFERENCE")}
    assert sorted((r["mapping_prefix"], r["direction"]) for r in made.caller_mappings.collect()) == [("Id", "INPUT"), ("Nm", "OUTPUT"), ("S", "INOUT")]
    assert [r["resolution_status"] for r in made.caller_operation_links.collect()] == ["EXACT_PRODUCT", "EXACT_PRODUCT"]
    codes = sorted(r["code"] for r in made.diagnostics.collect())
    assert codes == ["AMBIGUOUS_OPERATION_TARGET", "AMBIGUOUS_OPERATION_TARGET", "REFERENCE_ON_NON_RULE_TAG", "UNCLASSIFIED_REFERENCE_RULE", "UNKNOWN_CALL_RULE_CLASS"]
    assert made.referencing_files.count() == 2


def test_store_and_report(spark, made, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    counts = publish_contracts(store, made, spark=spark)
    assert counts["status"] == "complete_with_diagnostics" and counts["odata_operations"] == 2
    again = contracts.Contracts({n: store.table(n) for n in made.tables}, store.metadata())
    text = report.contracts_markdown(again)
    assert "GET https://hub.test/odata/patients" in text and "EXACT_PRODUCT Post slot" in text
    assert len(json.loads(report.contracts_json(again))["caller_references"]) == 4
    assert store.metadata()["scan_status"] == "complete_with_diagnostics"


def test_report_lines_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from lodeline.plans import corpora

    taken = DataFrame.collect

    def few(self):
        rows = taken(self)
        assert len(rows) <= 100
        return rows

    monkeypatch.setattr(DataFrame, "collect", few)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    got = corpora.report_lines(spark, "/root/testdata/sf0.001")
    assert got.count() > 200 and got.agg({"place": "max"}).first()[0] == got.count() - 1


def test_report_is_numbered_across_ranges(spark):
    kind = "section int, rank long, name string, more string, at long, lines array<string>"
    blocks = [(7, None, f"f{k % 7}", None, k, [f"f{k % 7} {k:03d} {i}" for i in range(k % 4)]) for k in range(200)]
    blocks += [(0, None, None, None, None, ["head", "x|y"]), (12, None, None, None, None, [""])]
    got = [tuple(r) for r in report.numbered(spark.createDataFrame(blocks[::-1], kind)).orderBy("place").collect()]
    assert got == list(enumerate(["head", "x|y", *sorted(x for b in blocks[:200] for x in b[5]), ""]))


def test_scenarios_share_an_expansion(spark):
    from lodeline.plans import corpora

    files = {"c/S.ifp": corpora._KINDS.replace("<Question", "<Quest").replace("<Button", "<Butt"), "lib/Api.ifp": corpora._API}
    load = lambda f: files[f].encode() if f in files else None
    specs = [None, {"name": "a", "assumptions": [{"field": "A.b", "value": "x"}]}, {"name": "b"}]
    target = {"file": "c/S.ifp", "field": "A.sum", "entry": "K.P"}
    voc, sem = vocabulary({}), Semantics({})
    x, seeds = trace.expanded(load, target, voc, sem)
    for spec in specs:
        asked = target if spec is None else target | {"scenario": spec}
        alone = trace.trace(load, asked, voc, sem)
        assert trace.evidence(x, seeds, asked) == alone and not any("scenario" in e for e in x.events)
        assert trace.evidence(x, seeds, asked, ("scenario", "issues")) == {k: alone[k] for k in ("scenario", "issues")}
    rows = [(k, "c/S.ifp", "A.sum", None, "K.P", None if s is None else json.dumps(s)) for k, s in enumerate([*specs, {"nonsense": 1}])]
    got = trace.trace_targets(spark, corpora._files(spark, files), spark.createDataFrame(rows, trace.TARGET), parts=("scenario",))
    got = {r["target_id"]: json.loads(r["evidence"]) for r in got.collect()}
    assert got[0] == {"scenario": None} and got[1]["scenario"]["specification"] == specs[1] and got[2]["scenario"]["specification"] == specs[2]
    assert "Scenario supports" in got[3]["error"]


@pytest.mark.parametrize("products", [("Alpha", "Beta"), ("Alpha",), ()])
def test_report_lays_shared_operations_out_last(spark, monkeypatch, products):
    rule = lambda p, k: f'<Rule Name="{p} {k}" eid="{p}{k}" RuleClassName="x.InvokeIRISRule" ResourcePath="/{k}" IRISAction="GET"/>'
    hub = "".join(f'<Product Name="{p}"><Phase Name="Go">{"".join(rule(p, k % 9) for k in range(10))}</Phase></Product>' for p in products)
    named = ["alpha", "Beta;ALPHA", "x/beta", "alpha,Nowhere", "Nowhere", "", "alpha", "beta|beta"] * 3
    calls = "".join(f'<Rule Name="C{k}" RuleClassName="x.CallComponentRule" SelectComponent="lib/Hub.ifp" ComponentList="{n}" I_SolutionDataItemMapping="D.I" I_PropertyKey="I" I_In="Y"/>' for k, n in enumerate(named))
    files = [("lib/Hub.ifp", f"<Project><Products>{hub}</Products></Project>"), ("c/A.ifp", f"<Project><Rules>{calls}</Rules></Project>")]
    made = contracts.build(spark, spark.createDataFrame(files, "file string, text string").selectExpr("file", "encode(text, 'utf-8') AS content"), "Hub.ifp")
    names = {r["tag_offset"]: r["rule_name"] for r in made.odata_operations.collect()}
    pairs = [(r["reference"]["tag_offset"], f"{r['resolution_status']} {names[r['operation']['tag_offset']]}") for r in made.caller_operation_links.collect()]
    want = []
    for c in sorted(made.caller_references.collect(), key=lambda r: r["tag_offset"]):
        want += [f"### {c['rule_name']}", *(f"- operation: {x}" for x in sorted(x for at, x in pairs if at == c["tag_offset"]) or ["unresolved"]), "- mapping: I INPUT D.I <-> I"]
    assert len(pairs) == {2: 210, 1: 150, 0: 0}[len(products)]
    kept = {}

    def seen(rows, name, keep=report.closure.kept):
        kept[name] = keep(rows, name)
        return kept[name]

    monkeypatch.setattr(report.closure, "kept", seen)
    for sent, lines in ((1 << 20, 1000), (-1, 7)):
        monkeypatch.setattr(report, "MOST_SENT", sent)
        monkeypatch.setattr(report, "TASK_LINES", lines)
        text = report.contracts_markdown(made).split("\n")
        assert [x for x in text if x.startswith(("### ", "- operation: ", "- mapping: "))] == want and text[-1] == "" and text.index("## Diagnostics") > text.index(want[-1])
        # No table that is written holds an operation once per caller.
        assert not [x for n in ("blocks", "lines") for r in kept[n].collect() for x in r["lines"] if x.startswith("- operation: ") and not x.endswith("unresolved")]


def test_config_extends_and_rejects():
    v = vocabulary({"api_rule_classes": ["x.HouseApi"], "attribute_aliases": {"path": ["Weg"]}, "api_rule_attribute_overrides": {"HouseApi": {"path": ["Pfad"]}}, "method_by_rule_class": {"x.HouseApi": "put"}})
    assert v.api_match("y.houseapi") == {"match": "suffix", "key": "houseapi"} and v.names("path", "HouseApi")[0] == "Pfad" and v.names("path")[-1] == "Weg"
    assert v.method_match("X.HouseApi")["method"] == "PUT" and v.method_match("HouseApi") is None
    for bad in ({"api_rule_classes": ["GotoRule"]}, {"api_rule_classes": ["a.B", "c.b"]}, {"method_by_rule_class": {"B": "GET"}}, {"attribute_aliases": {"nope": []}}, {"api_rule_classes": "x"}):
        with pytest.raises(ConfigError):
            vocabulary(bad)
    for bad in ({"trace": {"rules": [{"class": "SetValueRule", "kind": "set"}]}}, {"trace": {"x": 1}}, {"trace": {"rules": [{"class": "A", "kind": "zzz"}]}}, {"trace_rule_kinds": {"GotoRule": "set"}}):
        with pytest.raises(ConfigError):
            Semantics(bad)
    s = Semantics({"trace": {"rules": [{"class": "My.Set", "kind": "set", "attributes": {"PropertyName": "Ziel"}, "defaults": {"FromType": "Value"}}]}})
    assert s.normal({"PropertyName": "x", "Ziel": "y"}, s.of("My.Set")) == {"FromType": "Value", "Ziel": "y", "PropertyName": "y"}


def run(spark, root, **target):
    got = trace.trace_targets(spark, root, spark.createDataFrame([(1, "Screen.ifp", target.get("field"), target.get("rule_eid"), target.get("entry"), target.get("scenario"))], trace.TARGET))
    return got, json.loads(got.collect()[0]["evidence"])


def test_a_file_late_in_the_alphabet_is_held(spark, tmp_path):
    root = lineage(tmp_path / "l")
    folder = tmp_path / "l"
    (folder / "Api.ifp").rename(folder / "Zapi.ifp")
    more = "".join(f'<Rule Name="Gone{k}" eid="G{k}" RuleClassName="CallComponentRule" SelectComponent="A{k:03}.ifp" ComponentList="Find"/>' for k in range(110))
    screen = (folder / "Screen.ifp").read_text().replace("Api.ifp", "Zapi.ifp").replace("</Phase>", more + "</Phase>")
    (folder / "Screen.ifp").write_text(screen)
    _, e = run(spark, root, field="Desk.Title")
    assert sorted(e["files"]) == ["Screen.ifp", "Zapi.ifp"]
    assert "Get" in {x["name"] for x in e["events"]}


def test_only_files_that_are_called_are_read(spark, tmp_path, monkeypatch):
    root = lineage(tmp_path / "l")
    folder = tmp_path / "l"
    (folder / "odd [name].ifp").write_text("<Project><Products><Product Name='Odd'><Phase Name='P'><Rule eid='OD' RuleClassName='CallComponentRule' SelectComponent='Screen.ifp' ComponentList='Screen'/></Phase></Product></Products></Project>")
    for k in range(5):  # files that a reader would fail on
        (folder / f"unread{k}.ifp").write_bytes(b"<Rule eid='S5'")
        (folder / f"unread{k}.ifp").chmod(0)
    look = lambda **o: trace.reachable(trace._Folder(spark, root), ["Screen.ifp"], vocabulary({}), Semantics({}), {}, **o)
    for most in (trace.DRIVER_BYTES, 0):  # read by the driver, and by a job
        monkeypatch.setattr(trace, "DRIVER_BYTES", most)
        assert look() == (["Api.ifp", "Screen.ifp"], [("Api.ifp", "Screen.ifp")])
    _, e = run(spark, root, field="Desk.Title")
    assert sorted(e["files"]) == ["Api.ifp", "Screen.ifp"]
    got = trace.trace_targets(spark, root, spark.createDataFrame([(1, "odd [name].ifp", None, "OD", None, None)], trace.TARGET))
    assert sorted(json.loads(got.first()["evidence"])["files"]) == ["Api.ifp", "Screen.ifp", "odd [name].ifp"]
    assert look(most=1) is None
    gone = trace.trace_targets(spark, root, spark.createDataFrame([(1, "none.ifp", None, "X", None, None)], trace.TARGET))
    assert "FILE_ERROR" in gone.first()["evidence"]


def test_paths_without_a_separator_have_no_prefix(spark):
    from pyspark.sql import functions as F

    from lodeline.operators import flow, resolve

    rows = spark.createDataFrame([("a",), ("a/b/c",), (None,), ("",)], "p string").select(flow.prefixes(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in rows][:2] == [[], ["a", "a/b"]] and rows[3]["x"] == []
    ops = spark.createDataFrame([(k, "One") for k in range(2500)], "op long, product string")
    callers = spark.createDataFrame([(1, []), (2, None), (3, ["one"]), (4, ["two"])], "caller long, targets array<string>")
    got = {(r["caller"], r["status"]): r["count"] for r in resolve.linked(callers, "caller", "targets", ops, "op", "product").groupBy("caller", "status").count().collect()}
    assert got == {(1, "SINGLE_PRODUCT_FALLBACK"): 2500, (2, "SINGLE_PRODUCT_FALLBACK"): 2500, (3, "EXACT_PRODUCT"): 2500, (4, "AMBIGUOUS_OPERATION_TARGET"): 1}


def test_inspect_says_what_it_left_out(spark, tmp_path, capsys):
    from lodeline.cli import main

    root = lineage(tmp_path / "x")
    tables = census.census(census.inspected(spark, root, max_files=1))
    assert {r["code"]: r["n"] for r in tables["findings"].collect()} == {"SCAN_FILE_LIMIT": 1} and tables["coverage"].first()["files_scanned"] == 1
    assert main(["inspect", root, "--output", str(tmp_path / "o"), "--max-files", "1", "--quiet"], spark) == 0 and not capsys.readouterr().out
    assert main(["inspect", root, "--output", str(tmp_path / "o"), "--max-files", "0"], spark) == 1
    assert main(["trace", root, "--eid", "S5", "--cache-dir", f"file://{tmp_path}/idx", "--output", str(tmp_path / "t")], spark) == 0


def test_long_chains_raise(spark):
    from lodeline.operators.closure import reach

    edges = spark.createDataFrame([(k + 1, k) for k in range(6)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "seed long")
    assert reach(spark, seeds, edges, sent_edges=0, most=7).count() == 7
    with pytest.raises(RuntimeError):
        reach(spark, seeds, edges, sent_edges=0, most=3)


def test_lineage_over_files(spark, tmp_path):
    root = lineage(tmp_path / "l")
    got, e = run(spark, root, field="Desk.Title")
    names = {x["name"]: x for x in e["events"]}
    assert "Unused" not in names and {"Show", "Yes", "Get", "Init"} <= names.keys()
    assert sorted(e["files"]) == ["Api.ifp", "Screen.ifp"]
    assert [i["code"] for i in e["issues"] if i["code"] == "UNKNOWN_BRANCH"] == ["UNKNOWN_BRANCH"]
    api = names["Get"]["api"]
    assert (api["method"], api["base_url"]) == ("GET", "https://hub.test") and len(api["templates"]["path"]["variants"]) == 2
    assert e["conclusions"]["anchors"][0]["direct_source_api_events"] == [names["Get"]["id"]]
    kinds = {r["kind"] for r in trace.relation(got, "events").select("kind").collect()}
    assert {"api", "call", "input_mapping", "output_mapping"} <= kinds
    assert trace.anchors(got).count() == 1 and trace.relation(got, "edges").count() == len(e["edges"])
    assert "Get (api)" in report.summary_markdown(e) and "/p/one" in report.trace_markdown(e)


def test_scenario_excludes_branches(spark, tmp_path):
    root = lineage(tmp_path / "s")
    _, e = run(spark, root, field="Desk.Name", entry="Screen.Main", scenario=json.dumps({"name": "n"}))
    status = {x["name"]: x["scenario"]["status"] for x in e["events"]}
    assert status["No"] == "excluded" and status["Yes"] == "candidate"
    gate = e["scenario"]["conditions"][0]
    assert gate["result"] is True and gate["facts"][0]["basis"]["reason"] == "literal_assignment"


def test_barrier_reset_and_unknown():
    files = {"a.ifp": """<Phase Name="P">
      <Rule Name="w1" RuleClassName="SetValueRule" PropertyName="A.x" FromValue="1"/>
      <Rule Name="odd" RuleClassName="Strange" Foo="$$Z.z$"/>
      <Rule Name="w2" RuleClassName="ResetDataRule" ResetProperty="A.x"/>
      <Rule Name="w3" eid="T" RuleClassName="SetValueRule" PropertyName="B.y" FromValue="$$A.x$"/>
    </Phase>""".encode()}
    e = trace.trace(files.get, {"file": "a.ifp", "rule_eid": "T"}, vocabulary({}), Semantics({}))
    names = {x["id"]: x["name"] for x in e["events"]}
    assert [(names[x["from"]], names[x["to"]], x["relation"]) for x in e["edges"]] == [("w2", "w3", "definition")]
    assert [names[x["from"]] for x in e["opaque_dependencies"]] == ["odd"]
    codes = [b["code"] for b in e["conclusions"]["anchors"][0]["blockers"]]
    assert e["conclusions"]["overall_status"] == "blocked" and codes == ["OPAQUE_RULE_MAY_AFFECT"]


def test_ui_events_and_limits():
    files = {"a.ifp": b"""<Phase Name="P"><Question Name="q" eid="Q" PropertyKey="A.x"/>
      <Button Name="b"><Rule Name="s" eid="T" RuleClassName="SetValueRule" PropertyName="B" FromValue="$$A.x$"/></Button></Phase>"""}
    voc, sem = vocabulary({}), Semantics({})
    e = trace.trace(files.get, {"file": "a.ifp", "rule_eid": "T"}, voc, sem)
    assert [(x["event_order"], x["conditional"]) for x in e["edges"]] == [("unknown_between_ui_events", True)]
    e = trace.trace(files.get, {"file": "a.ifp", "field": "B"}, voc, sem, max_contexts=2)
    assert e["coverage"]["limited"] and any(i["code"] == "CONTEXT_LIMIT" for i in e["issues"])
    with pytest.raises(ValueError):
        trace.trace(files.get, {"file": "a.ifp", "field": "B", "scenario": {}}, voc, sem)


def test_recursion_and_missing_component():
    files = {"a.ifp": b"""<Phase Name="P"><Rule eid="L" RuleClassName="ContainerRule"><Rule eid="K" LinkReference="L"/></Rule>
      <Rule eid="C" RuleClassName="CallComponentRule" SelectComponent="none.ifp"/><Rule RuleClassName="CallComponentRule" SelectComponent="$$V$/x.ifp"/></Phase>"""}
    e = trace.trace(files.get, {"file": "a.ifp", "rule_eid": "C"}, vocabulary({}), Semantics({}))
    codes = {i["code"] for i in e["issues"]}
    assert {"RECURSIVE_REFERENCE", "COMPONENT_NOT_UNIQUE", "DYNAMIC_COMPONENT"} <= codes


def test_census(spark, tmp_path):
    tables = census.census(census.inspected(spark, lineage(tmp_path / "x")))
    found = {r["code"]: r["n"] for r in tables["findings"].collect()}
    assert found == {"UNKNOWN_BRANCH": 1}
    c = tables["coverage"].collect()[0]
    assert (c["files_scanned"], c["rules"], c["api_rules"], c["standard_rules"], c["semantically_understood_rules"]) == (2, 8, 1, 7, 8)
    assert "UNKNOWN_BRANCH" in census.census_markdown(tables)


def test_locator_is_incremental(spark, tmp_path):
    root = lineage(tmp_path / "e")
    store = Store(spark, f"file://{tmp_path}/index")
    index = locate.refresh(spark, store, root)
    want = spark.createDataFrame([("A1",), ("nope",)], "eid string")
    assert [r["file"].endswith("Api.ifp") for r in locate.candidates(spark, root, want, index).collect()] == [True]
    (tmp_path / "e" / "Api.ifp").unlink()
    (tmp_path / "e" / "New.ifp").write_text("<Phase Name='N'><Rule eid='A1' RuleClassName='GotoRule'/></Phase>")
    index = locate.refresh(spark, store, root)
    assert [r["file"].endswith("New.ifp") for r in locate.candidates(spark, root, want, index).collect()] == [True]
    load = lambda f: (tmp_path / "e" / f).read_bytes()
    assert locate.located(load, "A1", ["New.ifp"])["entry"] == "N"
    with pytest.raises(ValueError, match="EID_NOT_FOUND"):
        locate.located(load, "zz", ["New.ifp"])


def test_cli(spark, tmp_path, capsys):
    from lodeline.cli import main

    root = lineage(tmp_path / "r")
    out = tmp_path / "bundle"
    assert main(["trace", root, "--eid", "S5", "--output", str(out)], spark) == 0
    assert sorted(p.name for p in out.iterdir()) == ["evidence.json", "next.json", "performance.json", "report.md", "summary.md"]
    assert main(["trace", root, "--request", str(out / "next.json"), "--output", str(tmp_path / "again"), "--strict"], spark) == 2
    assert main(["trace", root, "--eid", "missing"], spark) == 1
    assert main(["inspect", root, "--output", str(tmp_path / "c")], spark) == 0
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["census.json", "census.md", "rules-config.json", "todo.md"]
    assert main(["build", root, "--integrator", "Api.ifp", "--store", f"file://{tmp_path}/st"], spark) == 0
    assert main(["report", "--store", f"file://{tmp_path}/st", "--output", str(tmp_path / "r.md")], spark) == 0


def test_refresh_reads_only_what_changed(spark, tmp_path):
    root = tmp_path / "corpus"
    clinic(root)
    store = Store(spark, f"file://{tmp_path}/store")
    whole = contracts.build(spark, str(root), "ClinicHub.ifp")
    want = {k: whole.tables[k].count() for k in ("caller_references", "caller_mappings", "caller_operation_links", "diagnostics")}
    for _ in range(2):
        got = contracts.refresh(spark, store, str(root), "ClinicHub.ifp")
        publish_contracts(store, got, spark=spark)
        assert {k: store.table(k).count() for k in want} == want
    assert store.table("scan_files").count() == 2
    (root / "Desk.IFP").unlink()
    (root / "plain.ifp").write_text("<P><Rule Name='new' RuleClassName='CallComponentRule' SelectComponent='lib/ClinicHub.ifp' ComponentList='Book'/></P>")
    got = contracts.refresh(spark, store, str(root), "ClinicHub.ifp")
    publish_contracts(store, got, spark=spark)
    assert {r["rule_name"] for r in store.table("caller_references").collect()} == {"Legacy", None, "new"}
    assert store.table("caller_operation_links").count() == 1


def test_stream_of_files(spark, tmp_path):
    from lodeline.streaming import incremental

    root, index = lineage(tmp_path / "in"), f"file://{tmp_path}/idx"
    incremental.watch_eids(spark, root, index)
    n = incremental.eids(spark, index).count()
    assert n == 9
    (tmp_path / "in" / "More.ifp").write_text("<Phase eid='zz'/>")
    incremental.watch_eids(spark, root, index)
    assert incremental.eids(spark, index).count() == n + 1


@pytest.mark.parametrize("sent", [0, 1000])
def test_closure_walks_and_rounds(spark, sent):
    from lodeline.operators.closure import reach

    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (5, 4), (6, 6)], "src long, dst long")  # a cycle and a tail
    seeds = spark.createDataFrame([(1,), (6,), (9,), (1,)], "seed long")
    stop = spark.createDataFrame([(4,)], "node long")
    got = sorted(tuple(r) for r in reach(spark, seeds, edges, stop=stop, sent_edges=sent).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (6, 6), (9, 9)]
    assert reach(spark, seeds, edges.limit(0), sent_edges=sent).count() == 3


def test_parse_cache_is_by_content(spark, tmp_path):
    from lodeline.sources import corpus

    root = tmp_path / "c"
    clinic(root)
    store = Store(spark, f"file://{tmp_path}/cache")
    plain = corpus.tags(corpus.files(spark, str(root))).count()
    read = lambda: corpus.cached_tags(spark, store, corpus.files(spark, str(root)))
    assert read().count() == plain == read().count()
    (root / "Desk.IFP").rename(root / "Moved.ifp")
    (root / "Twin.ifp").write_bytes((root / "Moved.ifp").read_bytes())
    got = read()
    assert got.count() == corpus.tags(corpus.files(spark, str(root))).count()
    assert got.where("file LIKE '%Desk%'").count() == 0 and got.where("file LIKE '%Twin%'").count() > 0


def test_store_grows_columns_and_refuses_moved_files(spark, made, tmp_path):
    from lodeline.sources import corpus

    store = Store(spark, f"file://{tmp_path}/g")
    store.publish({"t": spark.range(3)}, files=1)
    assert store.table("t", "id long, more string").where("more IS NULL").count() == 3
    with pytest.raises(ValueError):
        store.publish({"t": spark.range(5)}, checks={"none": spark.range(1)})
    assert store.table("t").count() == 3 and store.names() == ["t"]
    root = lineage(tmp_path / "moving")
    before = corpus.listing(spark, root)
    (tmp_path / "moving" / "Api.ifp").write_text("<Phase/>")
    with pytest.raises(ValueError, match="changed"):
        publish_contracts(store, made, spark=spark, listing=(root, before))
    store.reset()
    assert store.names() == []


def test_duration():
    from lodeline.functions.text import duration

    assert [duration(x) for x in (5, 65, 3725)] == ["5s", "1m 05s", "1h 02m 05s"]
