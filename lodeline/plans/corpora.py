"""Rule corpora made from the driver's tables, and the engine's own code run on them, each with DuckDB SQL for the rows.

Activity corpus: a file per user of `events`, a phase with a rule per event in order. Clicks copy one field to another,
views show a field, purchases reset one, errors are rules of an unknown class, signups test a field and set another where
it holds. A target per user is its last view. Hub corpus: one integrator with an operation per `supplier` in a product per
`nation`, and a file per nation that calls it once per `customer`. Corpora are tables (file, content), so nothing is
written; SQL works the expected rows out from the tables alone.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.config import Semantics, vocabulary
from lodeline.operators import closure, resolve
from lodeline.plans import census, contracts, locate, report, trace
from lodeline.sources import corpus
from lodeline.sources.store import Store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the activity corpus ------------------------------------------------------------------------------------------------

#: The field an event is about, and the text of its rule; both languages read these expressions.
_K = {"spark": "CAST(get_json_object(props, '$.k') AS INT)", "duck": "CAST(json_extract_string(props, '$.k') AS INT)"}


def _rule(k: str) -> str:
    field = lambda n: f"'A.f' || CAST(({k} + {n}) % 4 AS VARCHAR(2))"
    at = "CAST(event_id AS VARCHAR(20))"
    head = f"""'<Rule Name="n' || {at} || '" eid="E' || {at} || '" RuleClassName='"""
    return f"""CASE event_type
 WHEN 'click' THEN {head} || '"x.SetValueRule" PropertyName="' || {field(0)} || '" FromValue="$$' || {field(1)} || '$"/>'
 WHEN 'view' THEN {head} || '"SetValueRule" PropertyName="B.v' || {at} || '" FromValue="$$' || {field(0)} || '$ &amp; co"/>'
 WHEN 'purchase' THEN '<!-- <Rule eid="H' || {at} || '"/> -->' || {head} || '"ResetDataRule" ResetProperty="' || {field(0)} || '"/>'
 WHEN 'error' THEN {head} || '"House.StrangeRule" Note="$$' || {field(0)} || '$" Note="again"/>'
 ELSE {head} || '"EvaluateRule" RuleDisabled="no" Expression="$$' || {field(0)} || '$ == ''1''">' || '<Rule Name="c' || {at} || '" eid="C' || {at}
   || '" RuleType="True" RuleClassName="SetValueRule" PropertyName="' || {field(2)} || '" FromValue="lit"/></Rule>' END || chr(10)"""


_HEAD = """'<Project Name="U' || CAST(user_id AS VARCHAR(20)) || '"><Products><Product Name="U">' || chr(10) || '<Phase Name="Main" eid="P' || CAST(user_id AS VARCHAR(20)) || '">' || chr(10)"""
_TAIL = "</Phase></Product></Products></Project>"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content), a file per user."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_rule(_K["spark"])).alias("rule"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "rule"))), lambda r: r["rule"]), "")
    files = rows.groupBy("user_id").agg(text.alias("rules"))
    return files.select(F.concat(F.lit("u/U"), "user_id", F.lit(".ifp")).alias("file"), F.encode(F.concat(F.expr(_HEAD), "rules", F.lit(_TAIL)), "utf-8").alias("content"))


_ACTIVITY = f"""
WITH e AS (SELECT *, {_K['duck']} AS k, {_rule(_K['duck'])} AS rule FROM events),
f AS (SELECT user_id, {_HEAD} AS head FROM (SELECT DISTINCT user_id FROM events)),
p AS (SELECT e.*, 'u/U' || e.user_id || '.ifp' AS file, head, strlen(head) + coalesce(sum(strlen(rule)) OVER w, 0) + CASE WHEN event_type = 'purchase' THEN strpos(rule, '-->') + 2 ELSE 0 END AS spot,
      2 + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS line FROM e JOIN f ON e.user_id = f.user_id
      WINDOW w AS (PARTITION BY e.user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def corpus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as the lexer reads them: place, line, structure, product, phase."""
    tags = corpus.tags(corpus.files(spark, activity(spark, sf_dir)), names=corpus.STRUCTURAL)
    eid = corpus.value(("eid",))
    return tags.where("name = 'Rule' AND NOT is_end").select("file", eid.alias("eid"), F.col("offset").alias("start"), "line", "self_closing", "depth", (F.col("parent") == F.col("offset")).alias("own_parent"), "product_name", "phase_name", "disabled", F.size("attributes").alias("n_attributes"), F.size("duplicates").alias("n_twice"))


def corpus_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered attributes with entities unescaped, of rules whose class contracts would not keep but a scan does."""
    tags = corpus.tags(corpus.files(spark, activity(spark, sf_dir)), names=("Rule",)).where("NOT is_end")
    eid = corpus.value(("eid",))
    return tags.select(eid.alias("eid"), F.posexplode("attributes").alias("place", "a")).select("eid", "place", F.col("a.name").alias("name"), F.col("a.value").alias("value"))


def corpus_eids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of eids; those in comments are candidates too."""
    return corpus.eid_index(corpus.files(spark, activity(spark, sf_dir)))


def corpus_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files damaged in five ways: what is still read, and what is told."""
    files = activity(spark, sf_dir)
    n = F.regexp_extract("file", "([0-9]+)", 1).cast("long") % 5
    text = F.col("content").cast("string")
    hurt = F.when(n == 0, F.encode(F.concat(text, F.lit("<!-- open")), "utf-8")).when(n == 1, F.encode(F.replace(text, F.lit('Name="Main"'), F.lit("Name=Main")), "utf-8"))
    hurt = hurt.when(n == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "utf-16le"))).when(n == 3, F.concat(F.unhex(F.lit("FFFE0000")), F.col("content"))).otherwise(F.col("content"))
    tags = corpus.tags(files.withColumn("content", hurt), names=("Phase", "Rule"))
    good = F.col("error").isNull() & F.col("name").isNotNull() & ~F.col("is_end")
    return tags.groupBy("file").agg(F.count_if(good).alias("n_read"), F.count_if(F.col("error").isNotNull() & F.col("name").isNotNull()).alias("n_broken"), F.max(F.when(F.col("name").isNull(), F.col("error"))).alias("file_error"), F.count_if(F.col("note").isNotNull()).alias("n_notes"))


def corpus_attribute_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that stand twice, as diagnostics."""
    tags = corpus.tags(corpus.files(spark, activity(spark, sf_dir)), names=("Rule",))
    return contracts.attribute_problems(tags).groupBy("file_path", "severity", "code").agg(F.count("*").alias("n"), F.max(F.col("evidence")["attribute"]).alias("attribute"))


def _targets(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    last = _table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias("e"))
    null = F.lit(None).cast("string")
    return last.select(F.col("user_id").alias("target_id"), F.concat(F.lit("u/U"), "user_id", F.lit(".ifp")).alias("file"), null.alias("field"), F.concat(F.lit("E"), "e").alias("rule_eid"), null.alias("entry"), null.alias("scenario"))


def _evidence(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Traces of every user's last view, kept in the shared folder since relations read them more than once."""
    got = trace.trace_targets(spark, activity(spark, sf_dir), _targets(spark, sf_dir), **options)
    return closure.kept(got, "evidence")


def _named(rows: DataFrame, evidence: DataFrame, *ends: str) -> DataFrame:
    """Event ids as the names of their rules."""
    names = trace.relation(evidence, "events").select(F.col("target_id").alias("_t"), F.col("id").alias("_i"), F.col("name").alias("_n"))
    for c in ends:
        rows = rows.join(names, (F.col("target_id") == F.col("_t")) & (F.col(c) == F.col("_i")), "left").withColumn(c, F.col("_n")).drop("_t", "_i", "_n")
    return rows


def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that the slices follow: from, to, field, whether alone, whether under a condition."""
    ev = _evidence(spark, sf_dir)
    rows = _named(trace.relation(ev, "edges"), ev, "from", "to")
    return rows.select(F.col("target_id").alias("user_id"), F.col("from").alias("giver"), F.col("to").alias("taker"), F.col("field.path").alias("path"), "relation", "event_order", "conditional")


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the slices with kind, role, reads and writes."""
    rows = trace.relation(_evidence(spark, sf_dir), "events")
    paths = lambda c: F.array_join(F.transform(c, lambda f: f["path"]), "|")
    return rows.select(F.col("target_id").alias("user_id"), "name", "kind", "slice_role", paths("reads").alias("reads"), paths("writes").alias("writes"), F.size("parents").alias("n_parents"))


def trace_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads without a sure writer."""
    ev = _evidence(spark, sf_dir)
    return _named(trace.relation(ev, "inputs"), ev, "event").select(F.col("target_id").alias("user_id"), "event", F.col("field.path").alias("path"), "status")


def trace_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of unknown effect before an anchor, kept as boundaries."""
    ev = _evidence(spark, sf_dir)
    return _named(trace.relation(ev, "opaque_dependencies"), ev, "from", "to").select(F.col("target_id").alias("user_id"), F.col("from").alias("giver"), F.col("to").alias("taker"), "relation")


def trace_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _evidence(spark, sf_dir)
    return _named(trace.relation(ev, "issues"), ev, "event").select(F.col("target_id").alias("user_id"), "event", "code")


def trace_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conclusions per target: status, whether under a condition, how many events they rest on."""
    ev = _evidence(spark, sf_dir)
    return _named(trace.anchors(ev), ev, "seed").select(F.col("target_id").alias("user_id"), "seed", "status", "conditional_path", "dependency_event_count")


def trace_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What traces examined and exported; with few contexts allowed they say that they were limited."""
    out = None
    for limit in (5000, 20):
        got = F.from_json("evidence", "struct<coverage: struct<files_read: long, contexts_examined: long, limited: boolean>, error: string>")
        rows = _evidence(spark, sf_dir, max_contexts=limit).select(F.col("target_id").alias("user_id"), got.alias("e"))
        rows = rows.select("user_id", F.lit(limit).cast("long").alias("allowed"), "e.coverage.files_read", "e.coverage.contexts_examined", "e.coverage.limited")
        out = rows if out is None else out.unionByName(rows)
    return out


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges that a trace follows to find its files, over the hub corpus."""
    voc, semantics = vocabulary({}), Semantics({})
    contents = corpus.files(spark, hub(spark, sf_dir))
    return trace.call_edges(contents, voc, semantics, {"LIB": "lib"}).select(F.col("src").alias("callee"), F.col("dst").alias("caller"))


def census_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.census(census.inspected(spark, activity(spark, sf_dir)))["classes"]


def census_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.census(census.inspected(spark, activity(spark, sf_dir)))["coverage"]


def census_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = census.inspected(spark, activity(spark, sf_dir).unionByName(hub(spark, sf_dir)), variables={"LIB": "lib"})
    return census.census(rows, max_samples=3)["findings"].select("code", "n", "more", "severity", F.size("samples").alias("n_samples"), F.col("samples")[0]["file"].alias("first_file"))


# -- the hub corpus -----------------------------------------------------------------------------------------------------

_OPERATION = """'<Rule Name="' || s_name || '" eid="S' || CAST(s_suppkey AS VARCHAR(20)) || '" RuleClassName="' || CASE s_suppkey % 5
 WHEN 0 THEN 'a.b.InvokeIRISRule" IRISSource="Region ' || CAST(s_nationkey % 5 AS VARCHAR(2)) || '" IRISAction="GET" ResourcePath="/s/' || CAST(s_suppkey AS VARCHAR(20)) || '" ResultsDataGroup="R[1]"'
 WHEN 1 THEN 'SwaggerIntegrationRule" SourceName="nowhere" RuleDisabled="Y"'
 WHEN 2 THEN 'x.HouseApi" HttpMethod="POST" Path="p' || CAST(s_suppkey AS VARCHAR(20)) || '"'
 WHEN 3 THEN 'x.HouseCall" Path="q" Source="region 1"'
 ELSE 'EvaluateRule" Expression="$$a.b$"' END || '/>'"""
_CALL = """'<Rule Name="' || c_name || '" eid="C' || CAST(c_custkey AS VARCHAR(20)) || '" RuleClassName="' || CASE c_custkey % 4
 WHEN 0 THEN 'x.CallComponentRule" SelectComponent="lib' || chr(92) || 'Hub.ifp" ComponentList="NATION_' || CAST(c_nationkey AS VARCHAR(3)) || '" Id_SolutionDataItemMapping="D.Id" Id_PropertyKey="In.Id" Id_In="Y" Out_DataItemMapping="D.Name" Out_PropertyKey="O" Out_PubOut="true" Both_PropertyKey="B" Both_In="1" Both_Out="on" Note_ClassType="m"'
 WHEN 1 THEN 'HouseRule" ComponentPath="lib/Hub.ifp" ComponentList="Atlantis"'
 WHEN 2 THEN 'CallComponentRule" SelectComponent="$$LIB$/Hub.ifp" Component="lib/Hub.ifp" RuleDisabled="yes" ComponentList="x/nation_' || CAST(c_nationkey AS VARCHAR(3)) || ';NATION_0"'
 ELSE 'HouseRule" Note="see lib/Hub.ifp"' END || '/>'"""


def hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): the integrator, a file of callers per nation, and one with a reference that no tag holds."""
    join = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda r: r[c]), "")
    ops = _table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.expr(_OPERATION).alias("x")).groupBy("s_nationkey").agg(join("x", "s_suppkey").alias("rules"))
    products = ops.join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    attributes = F.concat(F.lit('" In_ExportedProperty="N.In" In_PropertyKey="k'), "n_nationkey", F.lit('" In_PubIn="Y"><Phase Name="Go">'))
    product = F.concat(F.lit('<Product Name="'), "n_name", F.lit('" eid="N'), "n_nationkey", attributes, "rules", F.lit("</Phase></Product>"))
    source = F.concat(F.lit('<DataSource Name="Region '), "r_regionkey", F.lit('" ClassType="a.ODataSource" ServiceRootUri="https://'), F.lower("r_name"), F.lit('.test/"/>'))
    parts = products.select(F.lit("p").alias("k"), F.col("n_nationkey").alias("at"), product.alias("x")).unionByName(_table(spark, sf_dir, "region").select(F.lit("s").alias("k"), F.col("r_regionkey").alias("at"), source.alias("x")))
    in_order = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("at", "x")))), lambda r: r["x"]), "")
    # The integrator is one file.
    one = parts.agg(in_order("p").alias("products"), in_order("s").alias("sources"))
    one = one.select(F.lit("lib/Hub.ifp").alias("file"), F.concat(F.lit("<Project><Products>"), "products", F.lit("</Products>"), "sources", F.lit("</Project></Phase>")).alias("text"))
    calls = _table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr(_CALL).alias("x")).groupBy("c_nationkey").agg(join("x", "c_custkey").alias("rules"))
    callers = calls.select(F.concat(F.lit("c/N"), "c_nationkey", F.lit(".IFP")).alias("file"), F.concat(F.lit("<Project><Rules>"), "rules", F.lit('</Rules><Button Text="lib/Hub.ifp"/></Project>')).alias("text"))
    stray = spark.createDataFrame([("c/Stray.ifp", "see lib/Hub.ifp <Phase/>")], "file string, text string")
    return one.unionByName(callers).unionByName(stray).select("file", F.encode("text", "utf-8").alias("content"))


# -- the screen corpus --------------------------------------------------------------------------------------------------

_SCREEN = """'<Project><Products><Product Name="Screen"><Rule Name="Prod" RuleClassName="SetValueRule" PropertyName="Desk.Name" FromValue="p"/><Phase Name="Main">
<Rule Name="Init" RuleClassName="SetValueRule" PropertyName="Desk.Id" FromValue="' || CAST(c_nationkey % 3 AS VARCHAR(3)) || '"/>
<Rule Name="Gate" RuleClassName="EvaluateRule" Expression="$$Desk.Id$ == ' || chr(39) || CAST(c_custkey % 3 AS VARCHAR(3)) || chr(39) || ' AND NOT $$Desk.Seg$ != ' || chr(39) || c_mktsegment || chr(39) || '">
<Rule Name="Yes" RuleType="True" RuleClassName="CallComponentRule" SelectComponent="../lib/Api.ifp" ComponentList="Find" I_SolutionDataItemMapping="Desk.Id" I_PropertyKey="Find[1].Id" I_In="Y" N_SolutionDataItemMapping="Desk.Name" N_PropertyKey="Find[1].Out.Name" N_Out="true"/>
<Rule Name="No" RuleType="False" RuleClassName="SetValueRule" PropertyName="Desk.Name" FromValue="nobody"/>
<Rule Name="Odd" RuleType="Maybe" RuleClassName="SetValueRule" PropertyName="Desk.Other" FromValue="x"/></Rule>
<Rule Name="Off" RuleDisabled="Y" RuleClassName="SetValueRule" PropertyName="Desk.Name" FromValue="off"/>
<Rule Name="Show" RuleClassName="SetValueRule" PropertyName="Desk.Title" FromValue="Dr $$Desk.Name$"/></Phase></Product></Products></Project>'"""
_API = """<Project><DataSources><DataSource Name="Feed" ServiceRootUri="https://hub.test"/></DataSources><Products><Product Name="Find" InitialPhase="Find.Run"><Phase Name="Run">
<Rule Name="Get" RuleClassName="z.InvokeIRISRule" IRISSource="Feed" IRISAction="GET" ResourcePath="/p/$%IF Find[1].Id == '1'$one$%ELSE$$$Find[1].Id$$%ENDIF$" ResultsDataGroup="Find[1].Out"/></Phase></Product></Products></Project>"""


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a screen per customer that asks one component, and the component."""
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c/S"), "c_custkey", F.lit(".ifp")).alias("file"), F.encode(F.expr(_SCREEN), "utf-8").alias("content"))
    return rows.unionByName(spark.createDataFrame([("lib/Api.ifp", bytearray(_API.encode()))], "file string, content binary"))


def _screen_targets(spark: SparkSession, sf_dir: str, scenario: str | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), F.concat(F.lit("c/S"), "c_custkey", F.lit(".ifp")).alias("file"), F.lit("Desk.Title").alias("field"), null.alias("rule_eid"), F.lit("Screen.Main").alias("entry"), F.lit(scenario).cast("string").alias("scenario"))


def _screen_evidence(spark: SparkSession, sf_dir: str, scenario: str | None = None) -> DataFrame:
    return closure.kept(trace.trace_targets(spark, screens(spark, sf_dir), _screen_targets(spark, sf_dir, scenario)), "evidence")


_ASSUMED = '{"name": "builders", "assumptions": [{"field": "Desk.Seg", "value": "BUILDING"}]}'


def screen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a slice over two files under a scenario, with kind, role and label."""
    got = F.from_json("evidence", "struct<events: array<struct<name: string, kind: string, slice_role: string, triggers: array<string>, scenario: struct<status: string, excluded_by: array<string>>>>>")
    rows = _screen_evidence(spark, sf_dir, _ASSUMED).select(F.col("target_id").alias("c_custkey"), F.explode(got["events"]).alias("e"))
    return rows.select("c_custkey", "e.name", "e.kind", "e.slice_role", "e.scenario.status", F.size("e.scenario.excluded_by").alias("n_against"))


def screen_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions across files, conditions and product rules."""
    ev = _screen_evidence(spark, sf_dir)
    kinds = trace.relation(ev, "events").select(F.col("target_id").alias("_t"), F.col("id").alias("_i"), F.concat_ws(":", "name", "kind").alias("_n"))
    rows = trace.relation(ev, "edges")
    for c in ("from", "to"):
        rows = rows.join(kinds, (F.col("target_id") == F.col("_t")) & (F.col(c) == F.col("_i")), "left").withColumn(c, F.col("_n")).drop("_t", "_i", "_n")
    return rows.select(F.col("target_id").alias("c_custkey"), F.col("from").alias("giver"), F.col("to").alias("taker"), F.col("field.path").alias("path"), "relation", "event_order", "conditional")


def screen_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests under a scenario in three values, and where each fact comes from."""
    got = F.from_json("evidence", "struct<scenario: struct<conditions: array<struct<result: string, reason: string, facts: array<struct<field: string, value: string, status: string, basis: struct<reason: string>>>>>>>")
    names = {0: "builders", 1: "nothing"}
    targets = _screen_targets(spark, sf_dir).withColumn("scenario", F.explode(F.array(F.lit(_ASSUMED), F.lit('{"name": "nothing"}'))))
    # An id is a customer and a scenario; evidence is read once here, so it is not kept.
    targets = targets.withColumn("target_id", F.col("target_id").cast("long") * 2 + (F.col("scenario") != _ASSUMED).cast("int"))
    name = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.pmod("target_id", F.lit(2)).cast("int"))
    rows = trace.trace_targets(spark, screens(spark, sf_dir), targets, parts=("scenario",))
    rows = rows.select(F.shiftright("target_id", 1).alias("c_custkey"), name.alias("scenario"), F.explode(got["scenario"]["conditions"]).alias("c"))
    return rows.select("c_custkey", "scenario", "c.result", "c.reason", F.array_join(F.transform("c.facts", lambda f: F.concat_ws("=", f["field"], F.coalesce(f["value"], F.lit("?")), f["basis"]["reason"])), "; ").alias("facts"))


def screen_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API call that a field comes from: endpoint, method, template variants, and the conclusions."""
    got = F.from_json("evidence", "struct<events: array<struct<name: string, kind: string, api: struct<method: string, path: string, base_url: string, templates: map<string, struct<status: string, variants: array<struct<template: string>>, dependencies: array<struct<field: string>>>>>>>, conclusions: struct<overall_status: string, anchors: array<struct<direct_source_api_events: array<string>, blockers: array<struct<code: string, count: long>>>>>, coverage: struct<files_read: long>>")
    rows = _screen_evidence(spark, sf_dir).select(F.col("target_id").alias("c_custkey"), got.alias("e"))
    api = F.filter("e.events", lambda x: x["kind"] == "api")[0]["api"]
    path = api["templates"]["path"]
    return rows.select(
        "c_custkey", api["method"].alias("method"), api["base_url"].alias("base_url"), F.array_join(F.transform(path["variants"], lambda v: v["template"]), " ").alias("variants"),
        F.array_join(F.transform(path["dependencies"], lambda d: d["field"]), " ").alias("fields"), F.col("e.conclusions.overall_status").alias("status"), F.col("e.coverage.files_read").alias("files_read"),
        F.array_join(F.transform(F.col("e.conclusions.anchors")[0]["blockers"], lambda b: F.concat_ws("=", b["code"], b["count"].cast("string"))), " ").alias("blockers"),
    )


# -- rule kinds and codes: one file each, expected rows as a list in SQL --------------------------------------------------

_KINDS = """<Project><Rules><Rule Name="Shared" eid="SH" RuleClassName="ContainerRule"><Rule Name="InShared" RuleClassName="SetValueRule" PropertyName="Sh.x" FromValue="1"/></Rule></Rules><Products><Product Name="K"><Phase Name="P">
<Rule Name="Box" RuleClassName="ContainerRule"><Rule Name="Eval" eid="EV" RuleClassName="EvaluateRule" Expression="A.b == 'x' AND $$C.d.trim()$ != '$$q$'"/></Rule>
<Rule Name="Expr" RuleClassName="ExpressionRule" Expression="$$A.n$ + $$A.m[$$A.k$]$" OutputProperty="A.sum"/>
<Rule Name="SetVar" RuleClassName="SetValueRule" Type="Variable" VariableName="v" FromType="Data Item" FromPropertyName="A.sum"/>
<Rule Name="SetGroup" RuleClassName="SetValueRule" Type="Data Group" PropertyGroupName="G[1]" FromType="Data Group" FromPropertyGroupName="H[1]"/>
<Rule Name="SetInstance" RuleClassName="SetValueRule" Type="Data Group Instance" PropertyGroupInstanceName="G" FromValue="$$A.k$"/>
<Rule Name="Reset" RuleClassName="ResetDataRule" ResetProperty="A.n, A.m" ResetPropertyGroup="G" ResetVariable="v"/>
<Rule Name="Count" RuleClassName="IncrementorRule" PropertyName="A.n" IncrementBy="$$A.step$"/>
<Rule Name="CountInstance" RuleClassName="IncrementorRule" Type="Data Group Instance" PropertyGroupName="G"/>
<Rule Name="Repeat" RuleClassName="RepeatRule" DataGroupName="G" EndInstance="$$A.last$"><Rule Name="InLoop" RuleClassName="SetValueRule" PropertyName="G[C].x" FromValue="$$H[C].x$"/></Rule>
<Rule Name="Goto" RuleClassName="GotoRule" Phase="Next" OperationType="open"/>
<Rule Name="Api" RuleClassName="SwaggerIntegrationRule" HTTPMethod="PUT" ResourcePath="/x/$$A.k$" Payload="$%IF A.b$$$A.n$$%ENDIF$" Input="In[1]" ResultsDataGroup="Out[1]" ErrorCodeDataItem="Err.code" AdditionalHTTPDataGroups="More"/>
<Question Name="Ask" PropertyKey="A.typed"/><Question Name="Seen" PropertyKey="A.seen" ReadOnly="Y" ConditionExpression="A.b == '1'"/><Button Name="Go" eid="GO"/>
<Rule Name="Link" LinkReference="SH"/>
<Rule Name="Off" eid="OF" RuleDisabled="true" RuleClassName="SetValueRule" PropertyName="A.off"/>
<Rule Name="Strange" RuleClassName="House.Odd" Note="$$A.note$"/>
<Rule Name="List" RuleClassName="AddToListRule" ListType="Static" StaticListToAddTo="L" KeyType="Data Item" KeyPropertyName="A.key" ValueType="Value" Value="$$A.val$" ErrorCodeDataItem="Err.l"/>
<Rule Name="Compare" eid="CM" RuleClassName="CompareMultiListValuesRule" CurrentListValue="A.cur" NewListValues="A.new"/>
<Rule Name="Status" eid="ST" RuleClassName="SetQuestionStatus" Question="Ask, Seen" ReadOnly="Y"/></Phase></Product></Products></Project>"""

_CODES = {
    "DYNAMIC_COMPONENT": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="$$V$/x.ifp"/></Phase>',
    "COMPONENT_NOT_UNIQUE": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="none.ifp"/></Phase>',
    "MISSING_COMPONENT_SELECTOR": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule"/></Phase>',
    "COMPONENT_ENTRY_NOT_UNIQUE": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="codes/callee.ifp" ComponentList="A,B"/></Phase>',
    "INITIAL_PHASE_NOT_UNIQUE": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="codes/callee.ifp" ComponentList="A"/></Phase>',
    "INCOMPLETE_MAPPING": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="codes/callee.ifp" ComponentList="B" M_PropertyKey="k" M_In="Y"/></Phase>',
    "OUTSIDE_ROOT": '<Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="../../up.ifp"/></Phase>',
    "LINK_NOT_UNIQUE": '<Phase Name="P"><Rule eid="T" LinkReference="nowhere"/></Phase>',
    "RECURSIVE_REFERENCE": '<Phase Name="P"><Rule eid="T" RuleClassName="ContainerRule"><Rule LinkReference="T"/></Rule></Phase>',
    "UNKNOWN_BRANCH": '<Phase Name="P"><Rule eid="T" RuleClassName="EvaluateRule" Expression="a.b"><Rule RuleClassName="GotoRule" RuleType="Perhaps"/></Rule></Phase>',
    "UNSUPPORTED_ASSIGNMENT_TARGET_TYPE": '<Phase Name="P"><Rule eid="T" RuleClassName="SetValueRule" Type="Moon"/></Phase>',
    "UNSUPPORTED_ASSIGNMENT_SOURCE_TYPE": '<Phase Name="P"><Rule eid="T" RuleClassName="SetValueRule" PropertyName="A" FromType="Moon"/></Phase>',
    "MISSING_ASSIGNMENT_SOURCE": '<Phase Name="P"><Rule eid="T" RuleClassName="SetValueRule" PropertyName="A" FromType="Data Item"/></Phase>',
    "PHASE_TRANSITION_BOUNDARY": '<Phase Name="P"><Rule eid="T" RuleClassName="GotoRule" Phase="Q"/></Phase>',
    "API_TEMPLATE_UNRESOLVED": '<Phase Name="P"><Rule eid="T" RuleClassName="InvokeIRISRule" Path="/$%IF a.b$"/></Phase>',
    "UNKNOWN_RULE": '<Phase Name="P"><Rule eid="T" RuleClassName="House.Odd"/></Phase>',
    "DUPLICATE_ATTRIBUTE": '<Phase Name="P"><Rule eid="T" RuleClassName="GotoRule" Note="1" Note="2"/></Phase>',
    "FILE_ERROR": '<Phase Name="P"><Rule eid="T" RuleClassName="GotoRule">',
    "ANCHOR_NOT_FOUND": '<Phase Name="P"><Rule eid="other" RuleClassName="ContainerRule"/></Phase>',
}
_CALLEE = '<Project><Products><Product Name="A" InitialPhase="A.None"/><Product Name="B"><Phase Name="P"/></Product></Products></Project>'


def _files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(f, bytearray(t.encode())) for f, t in files.items()], "file string, content binary")


def rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of rule: what its event reads and writes."""
    asked = [(f, None) for f in _KIND_FIELDS] + [(None, e) for e in ("EV", "GO", "OF", "CM", "ST")]
    target = spark.createDataFrame([(k, "K.ifp", f, e, None, None) for k, (f, e) in enumerate(asked)], trace.TARGET)
    rows = trace.relation(trace.trace_targets(spark, _files(spark, {"K.ifp": _KINDS}), target), "events")
    mark = lambda c: F.array_join(F.transform(c, lambda f: F.concat(F.when(f["scope"].endswith("session"), "!").otherwise(""), f["path"], F.when(f["group"], "*").otherwise(""))), " ")
    return rows.select("name", "kind", mark("reads").alias("reads"), mark("writes").alias("writes"), F.size("loops").alias("n_loops")).distinct()


#: Fields that the kinds' rules write, one target each, so that every rule is in a slice.
_KIND_FIELDS = ("A.sum", "!v", "G[1]", "G[2].x", "A.n", "Out[1].y", "Err.code", "More.z", "A.typed", "A.seen", "Sh.x", "Err.l")


def issue_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code of an expansion, each from a file that calls for it."""
    files = {f"codes/{c}.ifp": t for c, t in _CODES.items()} | {"codes/callee.ifp": _CALLEE}
    targets = spark.createDataFrame([(k, f"codes/{c}.ifp", None, "T", None, None) for k, c in enumerate(_CODES)], trace.TARGET)
    rows = trace.relation(trace.trace_targets(spark, _files(spark, files), targets), "issues")
    return rows.select(F.col("target_id"), "code", F.col("event").isNotNull().alias("has_event"))


def limit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What traces say at their limits of files and contexts."""
    files = {f"L{k}.ifp": f'<Project><Products><Product Name="L"><Phase Name="P"><Rule eid="T" RuleClassName="CallComponentRule" SelectComponent="L{k + 1}.ifp" ComponentList="L"/></Phase></Product></Products></Project>' for k in range(6)}
    target = spark.createDataFrame([(0, "L0.ifp", None, "T", None, None)], trace.TARGET)
    out = None
    for name, limits in (("files", {"max_files": 3}), ("contexts", {"max_contexts": 4}), ("none", {})):
        ev = trace.trace_targets(spark, _files(spark, files), target, **limits)
        rows = trace.relation(ev, "issues").select(F.lit(name).alias("limit"), "code", "file")
        out = rows if out is None else out.unionByName(rows)
    return out


def eid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From eids to file and entry: the index gives candidates, the file confirms them or tells why not."""
    files = _files(spark, {"a.ifp": '<Project><Products><Product Name="S"><Phase Name="M"><Rule eid="one"/><Rule eid="two"/><!-- eid="gone" --></Phase></Product></Products><Rule eid="top"><Rule eid="low"/></Rule></Project>', "b.ifp": '<Phase Name="N"><Rule eid="two"/></Phase>'})
    asked = ["one", "two", "gone", "low", "never"]
    found = {}
    for r in locate.candidates(spark, files, spark.createDataFrame([(e,) for e in asked], "eid string")).collect():
        found.setdefault(r["eid"], []).append(r["file"])
    content = {r["file"]: bytes(r["content"]) for r in files.collect()}
    rows = []
    for e in asked:
        try:
            rows.append((e, len(found.get(e, [])), (t := locate.located(content.get, e, found.get(e, [])))["file"], t["entry"], None))
        except ValueError as why:
            rows.append((e, len(found.get(e, [])), None, None, str(why).split(":")[0]))
    return spark.createDataFrame(rows, "eid string, n_candidates int, file string, entry string, problem string")


def vocabulary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute names, methods and kinds under an extended configuration, and what an invalid one is told."""
    voc = vocabulary({"api_rule_classes": ["x.HouseApi"], "api_rule_classes_exact": ["y.Own"], "attribute_aliases": {"path": ["Weg"]}, "api_rule_attribute_overrides": {"HouseApi": {"path": ["Pfad"]}}, "api_rule_attributes_exact": {"y.Own": {"path": ["Last"]}}, "method_by_rule_class": {"x.HouseApi": "put"}, "method_by_rule_class_suffix": {"Own": "get"}})
    semantics = Semantics({"trace": {"rules": [{"class": "My.Set", "kind": "set", "attributes": {"PropertyName": "Ziel"}, "defaults": {"FromType": "Value"}}]}})
    rows = [("first path", n, voc.names("path", n)[0]) for n in ("HouseApi", "y.Own", "z.Own")] + [("last path", n, voc.names("path", n)[-1]) for n in ("HouseApi", "y.Own", "z.Own")]
    rows += [("api", n, json.dumps(voc.api_match(n))) for n in ("q.houseapi", "Y.OWN", "Own", "GotoRule")] + [("method", n, json.dumps(voc.method_match(n))) for n in ("X.HouseApi", "HouseApi", "any.Own")]
    rows += [("kind", n, semantics.of(n)["kind"]) for n in ("my.set", "x.SetValueRule", "Nothing", "Broadcast")] + [("normal", "My.Set", json.dumps(semantics.normal({"PropertyName": "x", "Ziel": "y"}, semantics.of("My.Set")), sort_keys=True))]
    for bad in ({"api_rule_classes": ["GotoRule"]}, {"api_rule_classes": ["a.B", "c.b"]}, {"method_by_rule_class": {"B": "GET"}}, {"attribute_aliases": {"nope": []}}, {"trace": {"x": 1}}, {"trace_rule_kinds": {"GotoRule": "set"}}):
        try:
            vocabulary(bad)
            Semantics(bad)
            rows.append(("invalid", json.dumps(bad), "accepted"))
        except ValueError:
            rows.append(("invalid", json.dumps(bad), "refused"))
    return spark.createDataFrame(rows, "what string, name string, value string")


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishing, a refused version, columns that an older version lacks, reset but for some tables."""
    s = Store(spark, f"{closure.shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    rows = [("empty", str(s.names()), 0)]
    tell = lambda step, name: rows.append((step, ",".join(s.names()), s.table(name).count()))
    s.publish({"a": spark.range(3), "b": spark.range(5)}, {"k": "v"})
    tell("published", "a")
    held = s.table("a")
    s.publish({"a": spark.range(4), "b": spark.range(5)}, {"k": "w"})
    tell("again", "a")
    rows.append(("a reader of the version before", s.metadata()["k"], held.count()))
    try:
        s.publish({"a": spark.range(9)}, checks={"orphans": spark.range(1)})
    except ValueError:
        rows.append(("refused", "orphans", s.table("a").count()))
    rows.append(("a column more", "null", s.table("a", "id long, more string").where("more IS NULL").count()))
    s.reset(keep=("b",))
    tell("reset but for b", "b")
    s.reset()
    rows.append(("reset", str(s.names()), 0))
    return spark.createDataFrame(rows, "step string, shown string, n long")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the contract report over the hub corpus: sections, callers, operations and mappings, in order."""
    wanted = lambda x: reduce(or_, (F.startswith(x, F.lit(p)) for p in ("## ", "- operation: E", "- mapping: Id", "- class: ")))
    blocks, lists = report.contract_blocks(_contracts(spark, sf_dir))
    only = lambda rows, *names: rows.withColumns({c: F.filter(c, wanted) for c in names})
    return report.numbered(only(blocks, "lines", "tail"), only(lists, "lines")).select(F.col("place").cast("int").alias("place"), "line")


def _contracts(spark: SparkSession, sf_dir: str) -> contracts.Contracts:
    # Dealt out row by row, since a task lexes whole files: by their nation's hash some tasks get many more.
    files = hub(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    return contracts.build(spark, closure.kept(files, "hub"), "Hub.ifp", include_dynamic=True)


def contract_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).odata_operations.select("rule_eid", "rule_name", "rule_class", "product_name", "product_eid", "phase_name", "classification", "disabled", "source_name", "base_url", "action", "api_path", "results_group")


def contract_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).data_sources.select("source_name", "class_type", "base_url")


def contract_product_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).integrator_mappings.select("product_name", "product_eid", "mapping_prefix", "exported_property", "property_key", "direction")


def contract_rule_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).rule_class_census.select("rule_class", "occurrence_count")


def contract_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).caller_references.select("caller_file", "rule_eid", "rule_name", "rule_class", "classification", "disabled", "selector", "component_list")


def contract_caller_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _contracts(spark, sf_dir)
    who = made.caller_references.select("caller_file", "tag_offset", "rule_eid")
    return made.caller_mappings.join(who, ["caller_file", "tag_offset"]).select("rule_eid", "mapping_prefix", "solution_data_item", "property_key", "direction")


def contract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _contracts(spark, sf_dir)
    who = made.caller_references.select(F.struct("caller_file", "tag_offset").alias("reference"), F.col("rule_eid").alias("caller"))
    what = made.odata_operations.select(F.struct("integrator_file", "tag_offset").alias("operation"), F.col("rule_eid").alias("calls"))
    return made.caller_operation_links.join(who, "reference").join(what, "operation").select("caller", "calls", "resolution_status")


def contract_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contracts(spark, sf_dir).diagnostics.groupBy("severity", "code", "file_path").agg(F.count("*").alias("n"))


def contract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a build by table, and its status."""
    rows = [(k, str(v)) for k, v in contracts.summary(_contracts(spark, sf_dir)).items() if k not in ("diagnostics", "caller_mappings")]
    return spark.createDataFrame(rows, "name string, value string")


def contract_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh reads again after files of a third of the nations changed and those of another third vanished."""
    now = hub(spark, sf_dir).select("file", F.sha2("content", 256).alias("mark"))
    n = F.coalesce(F.regexp_extract("file", "([0-9]+)", 1).try_cast("int") % 3, F.lit(2))
    before = now.withColumn("mark", F.when(n == 0, F.lit("old")).otherwise(F.col("mark")))
    return resolve.fingerprint_diff(before, now.where(n != 1), "file", "mark")


QUERIES = {f.__name__: f for f in (
    corpus_tags, corpus_attributes, corpus_eids, corpus_problems, corpus_attribute_problems, trace_edges, trace_events, trace_inputs, trace_opaque,
    trace_issues, trace_anchors, trace_coverage, screen_events, screen_edges, screen_conditions, screen_api, rule_kinds, issue_codes, limit_codes, eid_lookup, vocabulary_names, store_versions, report_lines, call_graph, census_classes, census_coverage, census_findings, contract_operations,
    contract_sources, contract_product_mappings, contract_rule_census, contract_callers, contract_caller_mappings, contract_links,
    contract_diagnostics, contract_summary, contract_refresh,
)}

# Nodes: rules by sequence (children of tests follow them). Reads r and writes w are fields by number.
_SLICE = """
WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
n AS (
  SELECT user_id, 2 * event_id AS s, 'n' || event_id AS name, event_type AS kind, NULL::BIGINT AS test, event_id,
    CASE event_type WHEN 'click' THEN (k + 1) % 4 WHEN 'view' THEN k % 4 WHEN 'signup' THEN k % 4 END AS r,
    CASE WHEN event_type IN ('click', 'purchase') THEN k % 4 END AS w, event_type IN ('click', 'purchase') AS sure, k FROM e
  UNION ALL SELECT user_id, 2 * event_id + 1, 'c' || event_id, 'child', 2 * event_id, event_id, NULL, (k + 2) % 4, false, k FROM e WHERE event_type = 'signup'),
seed AS (SELECT user_id, 2 * max(event_id) AS s FROM e WHERE event_type = 'view' GROUP BY user_id),
bar AS (SELECT r.user_id, r.s, r.r, coalesce(max(w.s), -1) AS last FROM n r LEFT JOIN n w ON w.user_id = r.user_id AND w.w = r.r AND w.sure AND w.s < r.s
  WHERE r.r IS NOT NULL AND r.kind <> 'error' GROUP BY ALL),
d AS (SELECT b.user_id, w.s AS a, b.s AS b, b.r, w.test FROM bar b JOIN n w ON w.user_id = b.user_id AND w.w = b.r AND w.s < b.s AND w.s >= b.last),
x(user_id, s) AS (SELECT user_id, s FROM seed
  UNION SELECT q.user_id, q.s FROM (
    SELECT x.user_id, d.a AS s FROM x JOIN d ON d.user_id = x.user_id AND d.b = x.s
    UNION ALL SELECT x.user_id, n.test FROM x JOIN n ON n.user_id = x.user_id AND n.s = x.s AND n.test IS NOT NULL) q),
edge AS (SELECT d.*, count(*) OVER (PARTITION BY d.user_id, d.b) AS many FROM d JOIN x ON x.user_id = d.user_id AND x.s = d.b),
inp AS (SELECT x.user_id, x.s, b.r, count(d.a) AS n, count(d.test) AS loose FROM x JOIN bar b ON b.user_id = x.user_id AND b.s = x.s LEFT JOIN d ON d.user_id = x.user_id AND d.b = x.s GROUP BY ALL),
opaque AS (SELECT n.user_id, n.s, n.name FROM n JOIN seed ON seed.user_id = n.user_id WHERE n.kind = 'error' AND n.s < seed.s)
"""
_CLASS = "CASE event_type WHEN 'click' THEN 'x.SetValueRule' WHEN 'view' THEN 'SetValueRule' WHEN 'purchase' THEN 'ResetDataRule' WHEN 'error' THEN 'House.StrangeRule' ELSE 'EvaluateRule' END"
_OPS = """
WITH o AS (SELECT *, s_suppkey % 5 AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey),
op AS (SELECT * FROM o WHERE m < 4),
c AS (SELECT *, c_custkey % 4 AS m, 'c/N' || c_nationkey || '.IFP' AS file FROM customer),
named AS (SELECT c_custkey, 'nation_' || c_nationkey AS p FROM c WHERE m IN (0, 2) UNION SELECT c_custkey, 'nation_0' FROM c WHERE m = 2),
link AS (SELECT DISTINCT c_custkey, s_suppkey FROM named JOIN op ON lower(n_name) = p)
"""
_FILE_KIND = "CASE user_id % 5 WHEN 0 THEN"

_CUSTOMERS = "WITH c AS (SELECT *, c_nationkey % 3 = c_custkey % 3 AS m, c_mktsegment = 'BUILDING' AS b FROM customer)"

ORACLE_SQL = {
    "corpus_tags": _ACTIVITY + """
SELECT file, 'E' || event_id AS eid, spot::BIGINT AS start, line::BIGINT AS line, event_type <> 'signup' AS self_closing, 3 AS depth, false AS own_parent, 'U' AS product_name, 'Main' AS phase_name, false AS disabled,
  CASE event_type WHEN 'purchase' THEN 4 ELSE 5 END AS n_attributes, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS n_twice FROM p
UNION ALL SELECT file, 'C' || event_id, (spot + strpos(rule, '><'))::BIGINT, line::BIGINT, true, 4, false, 'U', 'Main', false, 6, 0 FROM p WHERE event_type = 'signup'""",
    "corpus_attributes": f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, {_CLASS} AS cls FROM events),
a AS (SELECT 'E' || event_id AS eid, unnest(CASE event_type
    WHEN 'click' THEN [('Name', 'n' || event_id), ('eid', 'E' || event_id), ('RuleClassName', cls), ('PropertyName', 'A.f' || k % 4), ('FromValue', '$$A.f' || (k + 1) % 4 || '$')]
    WHEN 'view' THEN [('Name', 'n' || event_id), ('eid', 'E' || event_id), ('RuleClassName', cls), ('PropertyName', 'B.v' || event_id), ('FromValue', '$$A.f' || k % 4 || '$ & co')]
    WHEN 'purchase' THEN [('Name', 'n' || event_id), ('eid', 'E' || event_id), ('RuleClassName', cls), ('ResetProperty', 'A.f' || k % 4)]
    WHEN 'error' THEN [('Name', 'n' || event_id), ('eid', 'E' || event_id), ('RuleClassName', cls), ('Note', '$$A.f' || k % 4 || '$'), ('Note', 'again')]
    ELSE [('Name', 'n' || event_id), ('eid', 'E' || event_id), ('RuleClassName', cls), ('RuleDisabled', 'no'), ('Expression', '$$A.f' || k % 4 || '$ == ''1''')] END) AS v, unnest(range(CASE event_type WHEN 'purchase' THEN 4 ELSE 5 END)) AS place FROM e
  UNION ALL SELECT 'C' || event_id, unnest([('Name', 'c' || event_id), ('eid', 'C' || event_id), ('RuleType', 'True'), ('RuleClassName', 'SetValueRule'), ('PropertyName', 'A.f' || (k + 2) % 4), ('FromValue', 'lit')]), unnest(range(6)) FROM e WHERE event_type = 'signup')
SELECT eid, place::INT AS place, v[1] AS name, v[2] AS value FROM a""",
    "corpus_eids": """
SELECT 'E' || event_id AS eid, 'u/U' || user_id || '.ifp' AS file FROM events UNION ALL SELECT 'C' || event_id, 'u/U' || user_id || '.ifp' FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'H' || event_id, 'u/U' || user_id || '.ifp' FROM events WHERE event_type = 'purchase' UNION ALL SELECT DISTINCT 'P' || user_id, 'u/U' || user_id || '.ifp' FROM events""",
    "corpus_problems": """
WITH c AS (SELECT user_id, user_id % 5 AS m, 1 + count(*) + count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY user_id)
SELECT 'u/U' || user_id || '.ifp' AS file, CASE m WHEN 3 THEN 0 WHEN 1 THEN n - 1 ELSE n END AS n_read, CASE m WHEN 1 THEN 1 ELSE 0 END AS n_broken,
  CASE m WHEN 0 THEN 'Unclosed comment section' WHEN 3 THEN 'UTF-32 is not supported' END AS file_error, CASE m WHEN 1 THEN 1 ELSE 0 END AS n_notes FROM c""",
    "corpus_attribute_problems": """
SELECT 'u/U' || user_id || '.ifp' AS file_path, 'WARNING' AS severity, 'DUPLICATE_XML_ATTRIBUTE' AS code, count(*) AS n, 'Note' AS attribute FROM events WHERE event_type = 'error' GROUP BY user_id""",
    "trace_edges": _SLICE + """
SELECT e.user_id, a.name AS giver, b.name AS taker, 'A.f' || e.r AS path, CASE WHEN many > 1 THEN 'candidate_definition' ELSE 'definition' END AS relation, 'configuration_order' AS event_order, e.test IS NOT NULL AS conditional
FROM edge e JOIN n a ON a.user_id = e.user_id AND a.s = e.a JOIN n b ON b.user_id = e.user_id AND b.s = e.b""",
    "trace_events": _SLICE + """
SELECT n.user_id, n.name, CASE kind WHEN 'purchase' THEN 'reset' WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'evaluate' ELSE 'set' END AS kind, CASE WHEN kind = 'error' THEN 'context_or_boundary' ELSE 'dependency' END AS slice_role,
  CASE WHEN kind = 'error' THEN '' WHEN r IS NULL THEN '' ELSE 'A.f' || r END AS reads, CASE WHEN kind = 'view' THEN 'B.v' || event_id WHEN w IS NULL THEN '' ELSE 'A.f' || w END AS writes, CASE kind WHEN 'child' THEN 2 ELSE 1 END AS n_parents
FROM n JOIN (SELECT user_id, s FROM x UNION SELECT user_id, s FROM opaque) y ON y.user_id = n.user_id AND y.s = n.s
UNION ALL SELECT user_id, 'Main', 'structure', 'context_or_boundary', '', '', 0 FROM seed""",
    "trace_inputs": _SLICE + """
SELECT i.user_id, n.name AS event, 'A.f' || i.r AS path, CASE WHEN i.n = 0 THEN 'external_or_unresolved' ELSE 'conditional_write_or_prior_value' END AS status
FROM inp i JOIN n ON n.user_id = i.user_id AND n.s = i.s WHERE i.n = i.loose""",
    "trace_opaque": _SLICE + "SELECT o.user_id, o.name AS giver, n.name AS taker, 'opaque_rule_may_affect_anchor' AS relation FROM opaque o JOIN seed s ON s.user_id = o.user_id JOIN n ON n.user_id = s.user_id AND n.s = s.s",
    # Problems of a file's attributes are told wherever they are in the file.
    "trace_issues": _SLICE + """SELECT user_id, name AS event, 'UNKNOWN_RULE' AS code FROM opaque
UNION ALL SELECT n.user_id, NULL, 'DUPLICATE_ATTRIBUTE' FROM n JOIN seed USING (user_id) WHERE kind = 'error'""",


    "screen_events": _CUSTOMERS + """
SELECT c_custkey, name, kind, slice_role, CASE WHEN place = 'product' THEN 'other_event_context' WHEN (place = 'yes' AND NOT (m AND b)) OR (place = 'no' AND m AND b) THEN 'excluded' ELSE 'candidate' END AS status,
  CASE WHEN (place = 'yes' AND NOT (m AND b)) OR (place = 'no' AND m AND b) THEN 1 ELSE 0 END AS n_against
FROM c, (VALUES ('Screen', 'product_rules', 'context_or_boundary', 'product'), ('Prod', 'set', 'dependency', 'product'), ('Main', 'structure', 'context_or_boundary', ''), ('Init', 'set', 'dependency', ''),
  ('Gate', 'evaluate', 'dependency', ''), ('Yes', 'call', 'context_or_boundary', 'yes'), ('Yes', 'input_mapping', 'dependency', 'yes'), ('Run', 'structure', 'context_or_boundary', 'yes'), ('Get', 'api', 'dependency', 'yes'),
  ('Yes', 'output_mapping', 'dependency', 'yes'), ('No', 'set', 'dependency', 'no'), ('Show', 'set', 'dependency', '')) v(name, kind, slice_role, place)""",
    "screen_edges": _CUSTOMERS + """
SELECT c_custkey, v.* FROM c, (VALUES ('Prod:set', 'Show:set', 'Desk.Name', 'candidate_definition', 'unknown_product_scheduling', true), ('Yes:output_mapping', 'Show:set', 'Desk.Name', 'candidate_definition', 'configuration_order', true),
  ('No:set', 'Show:set', 'Desk.Name', 'candidate_definition', 'configuration_order', true), ('Get:api', 'Yes:output_mapping', 'Find[1].Out.Name', 'definition', 'configuration_order', false),
  ('Init:set', 'Gate:evaluate', 'Desk.Id', 'definition', 'configuration_order', false), ('Yes:input_mapping', 'Get:api', 'Find[1].Id', 'definition', 'configuration_order', false),
  ('Init:set', 'Yes:input_mapping', 'Desk.Id', 'definition', 'configuration_order', false)) v(giver, taker, path, relation, event_order, conditional)""",
    "screen_conditions": _CUSTOMERS + """
SELECT c_custkey, 'builders' AS scenario, CASE WHEN m AND b THEN 'true' ELSE 'false' END AS result, 'supported_expression' AS reason, 'Desk.Id=' || c_nationkey % 3 || '=literal_assignment; Desk.Seg=BUILDING=initial_scenario_assumption' AS facts FROM c
UNION ALL SELECT c_custkey, 'nothing', CASE WHEN m THEN 'unknown' ELSE 'false' END, CASE WHEN m THEN 'partial_information' ELSE 'supported_expression' END, 'Desk.Id=' || c_nationkey % 3 || '=literal_assignment; Desk.Seg=?=no_definition_in_this_activation' FROM c""",
    "screen_api": "SELECT c_custkey, 'GET' AS method, 'https://hub.test' AS base_url, '/p/one /p/$$Find[1].Id$' AS variants, 'Find[1].Id Find[1].Id' AS fields, 'blocked' AS status, 2::BIGINT AS files_read, 'PRODUCT_RULE_SCHEDULING_UNKNOWN=1 UNKNOWN_BRANCH=1 UNRESOLVED_VALUE=2' AS blockers FROM customer",
    "eid_lookup": "SELECT * FROM (VALUES ('one', 1, 'a.ifp', 'S.M', NULL), ('two', 2, NULL, NULL, 'EID_NOT_UNIQUE'), ('gone', 1, NULL, NULL, 'EID_NOT_FOUND'), ('low', 1, 'a.ifp', '@top', NULL), ('never', 0, NULL, NULL, 'EID_NOT_FOUND')) v(eid, n_candidates, file, entry, problem)",
    "vocabulary_names": """
SELECT * FROM (VALUES ('first path', 'HouseApi', 'Pfad'), ('first path', 'y.Own', 'ResourcePath'), ('first path', 'z.Own', 'ResourcePath'), ('last path', 'HouseApi', 'Weg'), ('last path', 'y.Own', 'Last'), ('last path', 'z.Own', 'Weg'),
  ('api', 'q.houseapi', '{"match": "suffix", "key": "houseapi"}'), ('api', 'Y.OWN', '{"match": "exact", "key": "y.own"}'), ('api', 'Own', 'null'), ('api', 'GotoRule', 'null'),
  ('method', 'X.HouseApi', '{"method": "PUT", "match": "exact", "key": "x.houseapi"}'), ('method', 'HouseApi', 'null'), ('method', 'any.Own', '{"method": "GET", "match": "suffix", "key": "own"}'),
  ('kind', 'my.set', 'set'), ('kind', 'x.SetValueRule', 'set'), ('kind', 'Nothing', 'unknown'), ('kind', 'Broadcast', 'unknown'), ('normal', 'My.Set', '{"FromType": "Value", "PropertyName": "y", "Ziel": "y"}'),
  ('invalid', '{"api_rule_classes": ["GotoRule"]}', 'refused'), ('invalid', '{"api_rule_classes": ["a.B", "c.b"]}', 'refused'), ('invalid', '{"method_by_rule_class": {"B": "GET"}}', 'refused'), ('invalid', '{"attribute_aliases": {"nope": []}}', 'refused'),
  ('invalid', '{"trace": {"x": 1}}', 'refused'), ('invalid', '{"trace_rule_kinds": {"GotoRule": "set"}}', 'refused')) v(what, name, value)""",
    "store_versions": "SELECT step, shown, n::BIGINT AS n FROM (VALUES ('empty', '[]', 0), ('published', 'a,b', 3), ('again', 'a,b', 4), ('a reader of the version before', 'w', 3), ('refused', 'orphans', 4), ('a column more', 'null', 4), ('reset but for b', 'b', 5), ('reset', '[]', 0)) v(step, shown, n)",
    "rule_kinds": """
SELECT name, kind, reads, writes, n_loops::INT AS n_loops FROM (VALUES ('Api', 'api', 'A.k A.n A.b In[1]*', 'Out[1]* Err.code More*', 0), ('Ask', 'ui_input', '', 'A.typed', 0), ('Count', 'increment', 'A.n A.step', 'A.n', 0),
  ('CountInstance', 'instance', '@instance:G', '@instance:G', 0), ('Expr', 'expression', 'A.n A.k A.m[$$A.k$]*', 'A.sum', 0), ('Goto', 'goto', '', '', 0), ('InLoop', 'set', 'H[C].x', 'G[C].x', 1), ('InShared', 'set', '', 'Sh.x', 0),
  ('Link', 'link', '', '', 0), ('List', 'unknown', 'A.val A.key', 'Err.l', 0), ('P', 'structure', '', '', 0), ('Repeat', 'repeat', 'A.last G*', '@instance:G', 0), ('Reset', 'reset', '', 'A.n A.m G* !v', 0),
  ('Seen', 'ui_event', 'A.seen', '', 0), ('SetGroup', 'set', 'H[1]*', 'G[1]*', 0), ('SetInstance', 'instance', 'A.k', '@instance:G', 0), ('SetVar', 'set', 'A.sum', '!v', 0), ('Shared', 'container', '', '', 0), ('Strange', 'unknown', 'A.note', '', 0),
  ('Box', 'container', '', '', 0), ('Eval', 'evaluate', 'C.d q A.b', '', 0), ('Off', 'disabled', '', '', 0), ('Compare', 'unknown', 'A.cur', '', 0), ('Status', 'unknown', '', '', 0), ('Go', 'ui_event', '', '', 0)) v(name, kind, reads, writes, n_loops)""",
    "issue_codes": """
SELECT target_id::BIGINT AS target_id, code, has_event FROM (VALUES (0, 'DYNAMIC_COMPONENT', false), (1, 'COMPONENT_NOT_UNIQUE', false), (2, 'MISSING_COMPONENT_SELECTOR', true), (3, 'COMPONENT_ENTRY_NOT_UNIQUE', true), (4, 'INITIAL_PHASE_NOT_UNIQUE', true),
  (5, 'INCOMPLETE_MAPPING', true), (6, 'COMPONENT_NOT_UNIQUE', false), (7, 'LINK_NOT_UNIQUE', true), (8, 'RECURSIVE_REFERENCE', false), (9, 'PHASE_TRANSITION_BOUNDARY', true), (9, 'UNKNOWN_BRANCH', true), (10, 'UNSUPPORTED_ASSIGNMENT_TARGET_TYPE', true),
  (11, 'UNSUPPORTED_ASSIGNMENT_SOURCE_TYPE', true), (12, 'MISSING_ASSIGNMENT_SOURCE', true), (13, 'PHASE_TRANSITION_BOUNDARY', true), (14, 'API_TEMPLATE_UNRESOLVED', true), (15, 'UNKNOWN_RULE', true), (16, 'DUPLICATE_ATTRIBUTE', false),
  (16, 'PHASE_TRANSITION_BOUNDARY', true), (17, 'ANCHOR_NOT_FOUND', false), (17, 'FILE_ERROR', false), (18, 'ANCHOR_NOT_FOUND', false)) v(target_id, code, has_event)""",
    "limit_codes": "SELECT * FROM (VALUES ('files', 'FILE_LIMIT', 'L3.ifp'), ('contexts', 'CONTEXT_LIMIT', 'L2.ifp'), ('none', 'COMPONENT_NOT_UNIQUE', 'L5.ifp')) v(\"limit\", code, file)",
    "report_lines": _OPS + """,
x AS (SELECT file, c_custkey, 0 AS part, 0 AS which, CASE m WHEN 0 THEN '- class: `x.CallComponentRule`, CONFIRMED, disabled: no' WHEN 1 THEN '- class: `HouseRule`, CONFIRMED_UNKNOWN_RULE, disabled: no' WHEN 2 THEN '- class: `CallComponentRule`, CONFIRMED, disabled: yes' ELSE '- class: `HouseRule`, UNCLASSIFIED_REFERENCE, disabled: no' END AS line FROM c
  UNION ALL SELECT c.file, c.c_custkey, 1, row_number() OVER (PARTITION BY c.c_custkey ORDER BY s_name), '- operation: EXACT_PRODUCT ' || s_name FROM link JOIN c ON c.c_custkey = link.c_custkey JOIN op ON op.s_suppkey = link.s_suppkey
  UNION ALL SELECT file, c_custkey, 2, 0, '- mapping: Id INPUT D.Id <-> In.Id' FROM c WHERE m = 0),
y AS (SELECT 4 AS section, file, c_custkey, part, which, line FROM x UNION ALL SELECT s, '', 0, 0, 0, l FROM (VALUES (0, '## API requests'), (1, '## Data sources'), (2, '## Product mappings'), (3, '## Callers'), (5, '## Diagnostics'), (6, '## Rule classes')) v(s, l))
SELECT (row_number() OVER (ORDER BY section, file, c_custkey, part, which) - 1)::INT AS place, line FROM y""",
    "census_findings": """
WITH f AS (SELECT 'UNKNOWN_RULE' AS code, 'warning' AS severity, 'u/U' || user_id || '.ifp' AS file FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'DUPLICATE_ATTRIBUTE', 'warning', 'u/U' || user_id || '.ifp' FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'UNKNOWN_RULE', 'warning', 'c/N' || c_nationkey || '.IFP' FROM customer WHERE c_custkey % 4 IN (1, 3))
SELECT code, count(*) AS n, greatest(count(*) - 3, 0) AS more, severity, least(count(*), 3)::INT AS n_samples, min(file) AS first_file FROM f GROUP BY code, severity
UNION ALL SELECT 'FILE_ERROR', 1, 0, 'error', 1, 'lib/Hub.ifp'""",
    "contract_operations": _OPS + """
SELECT 'S' || s_suppkey AS rule_eid, s_name AS rule_name, CASE m WHEN 0 THEN 'a.b.InvokeIRISRule' WHEN 1 THEN 'SwaggerIntegrationRule' WHEN 2 THEN 'x.HouseApi' ELSE 'x.HouseCall' END AS rule_class, n_name AS product_name, 'N' || n_nationkey AS product_eid, 'Go' AS phase_name,
  CASE WHEN m < 2 THEN 'CONFIRMED' WHEN m = 2 THEN 'STRUCTURAL' ELSE 'CANDIDATE' END AS classification, m = 1 AS disabled, CASE m WHEN 0 THEN 'Region ' || n_nationkey % 5 WHEN 1 THEN 'nowhere' WHEN 3 THEN 'region 1' END AS source_name,
  CASE m WHEN 0 THEN (SELECT 'https://' || lower(r_name) || '.test/' FROM region WHERE r_regionkey = n_nationkey % 5) WHEN 3 THEN (SELECT 'https://' || lower(r_name) || '.test/' FROM region WHERE r_regionkey = 1) END AS base_url,
  CASE m WHEN 0 THEN 'GET' WHEN 2 THEN 'POST' END AS action, CASE m WHEN 0 THEN '/s/' || s_suppkey WHEN 2 THEN 'p' || s_suppkey WHEN 3 THEN 'q' END AS api_path, CASE m WHEN 0 THEN 'R[1]' END AS results_group FROM op""",
    "contract_sources": "SELECT 'Region ' || r_regionkey AS source_name, 'a.ODataSource' AS class_type, 'https://' || lower(r_name) || '.test/' AS base_url FROM region",
    "contract_product_mappings": _OPS + "SELECT DISTINCT n_name AS product_name, 'N' || n_nationkey AS product_eid, 'In' AS mapping_prefix, 'N.In' AS exported_property, 'k' || n_nationkey AS property_key, 'INPUT' AS direction FROM o",
    "contract_rule_census": _OPS + "SELECT CASE m WHEN 0 THEN 'a.b.InvokeIRISRule' WHEN 1 THEN 'SwaggerIntegrationRule' WHEN 2 THEN 'x.HouseApi' WHEN 3 THEN 'x.HouseCall' ELSE 'EvaluateRule' END AS rule_class, count(*) AS occurrence_count FROM o GROUP BY m",
    "contract_callers": _OPS + """
SELECT file AS caller_file, 'C' || c_custkey AS rule_eid, c_name AS rule_name, CASE m WHEN 0 THEN 'x.CallComponentRule' WHEN 2 THEN 'CallComponentRule' ELSE 'HouseRule' END AS rule_class,
  CASE m WHEN 1 THEN 'CONFIRMED_UNKNOWN_RULE' WHEN 3 THEN 'UNCLASSIFIED_REFERENCE' ELSE 'CONFIRMED' END AS classification, m = 2 AS disabled,
  CASE m WHEN 0 THEN 'lib' || chr(92) || 'Hub.ifp' WHEN 1 THEN 'lib/Hub.ifp' WHEN 2 THEN '$$LIB$/Hub.ifp' ELSE 'Hub.ifp' END AS selector,
  CASE m WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'Atlantis' WHEN 2 THEN 'x/nation_' || c_nationkey || ';NATION_0' END AS component_list FROM c""",
    "contract_caller_mappings": _OPS + """
SELECT 'C' || c_custkey AS rule_eid, v.p AS mapping_prefix, v.i AS solution_data_item, v.k AS property_key, v.d AS direction FROM c,
  (VALUES ('Id', 'D.Id', 'In.Id', 'INPUT'), ('Out', 'D.Name', 'O', 'OUTPUT'), ('Both', NULL, 'B', 'INOUT')) v(p, i, k, d) WHERE m = 0""",
    "contract_links": _OPS + "SELECT 'C' || c_custkey AS caller, 'S' || s_suppkey AS calls, 'EXACT_PRODUCT' AS resolution_status FROM link",
    "contract_diagnostics": _OPS + """,
x AS (SELECT file, m, c_custkey, c_custkey NOT IN (SELECT c_custkey FROM link) AS lost FROM c)
SELECT 'WARNING' AS severity, 'AMBIGUOUS_OPERATION_TARGET' AS code, file AS file_path, count(*) AS n FROM x WHERE lost GROUP BY file
UNION ALL SELECT 'WARNING', CASE m WHEN 1 THEN 'UNKNOWN_CALL_RULE_CLASS' ELSE 'UNCLASSIFIED_REFERENCE_RULE' END, file, count(*) FROM x WHERE m IN (1, 3) GROUP BY m, file
UNION ALL SELECT 'NOTICE', 'REFERENCE_ON_NON_RULE_TAG', file, 1 FROM x GROUP BY file
UNION ALL SELECT 'WARNING', 'UNKNOWN_API_RULE_CLASS', 'lib/Hub.ifp', count(*) FROM o WHERE m IN (2, 3) HAVING count(*) > 0
UNION ALL SELECT 'WARNING', 'UNBALANCED_XML_STRUCTURE', 'lib/Hub.ifp', 1
UNION ALL SELECT 'WARNING', 'MALFORMED_REFERENCE_CONTEXT', 'c/Stray.ifp', 1""",
    "contract_summary": _OPS + """
SELECT * FROM (VALUES ('data_sources', (SELECT count(*) FROM region)::VARCHAR), ('odata_operations', (SELECT count(*) FROM op)::VARCHAR), ('integrator_mappings', (SELECT count(DISTINCT n_nationkey) FROM o)::VARCHAR),
  ('rule_class_census', (SELECT count(DISTINCT m) FROM o)::VARCHAR), ('caller_references', (SELECT count(*) FROM c)::VARCHAR), ('referencing_files', (SELECT count(DISTINCT file) FROM c)::VARCHAR),
  ('caller_operation_links', (SELECT count(*) FROM link)::VARCHAR), ('files_failed', '0'), ('status', 'complete_with_diagnostics')) v(name, value)""",
    "contract_refresh": """
WITH f AS (SELECT DISTINCT 'c/N' || c_nationkey || '.IFP' AS file, c_nationkey % 3 AS m FROM customer UNION ALL SELECT 'lib/Hub.ifp', 2 UNION ALL SELECT 'c/Stray.ifp', 2)
SELECT file, CASE m WHEN 0 THEN 'CHANGED' WHEN 1 THEN 'VANISHED' ELSE 'CACHED' END AS status FROM f""",
    "trace_anchors": _SLICE + """
SELECT s.user_id, 'n' || s.s // 2 AS seed, CASE WHEN coalesce(o.n, 0) > 0 OR coalesce(i.n, 0) > 0 THEN 'blocked' WHEN coalesce(g.loose, false) THEN 'conditional' ELSE 'static_candidate' END AS status, coalesce(g.loose, false) AS conditional_path, c.n + 1 AS dependency_event_count
FROM seed s JOIN (SELECT user_id, count(*) AS n FROM x GROUP BY 1) c ON c.user_id = s.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM opaque GROUP BY 1) o ON o.user_id = s.user_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM inp WHERE n = loose GROUP BY 1) i ON i.user_id = s.user_id LEFT JOIN (SELECT user_id, bool_or(test IS NOT NULL) AS loose FROM edge GROUP BY 1) g ON g.user_id = s.user_id""",
    "trace_coverage": """
WITH c AS (SELECT user_id, 1 + count(*) + count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY user_id HAVING bool_or(event_type = 'view'))
SELECT user_id, a AS allowed, 1::BIGINT AS files_read, least(n, a) AS contexts_examined, n > a AS limited FROM c, (SELECT unnest([5000, 20])::BIGINT AS a)""",
    "call_graph": "SELECT p AS callee, 'c/N' || c_nationkey || '.IFP' AS caller FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 4 IN (0, 2)), (SELECT unnest(['lib/Hub.ifp', 'c/lib/Hub.ifp']) AS p)",
    "census_classes": f"SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'standard' END AS category, {_CLASS} AS class, count(*) + CASE WHEN {_CLASS} = 'SetValueRule' THEN (SELECT count(*) FROM events WHERE event_type = 'signup') ELSE 0 END AS n FROM events GROUP BY event_type",
    "census_coverage": """
SELECT count(DISTINCT user_id) AS files_scanned, 0::BIGINT AS files_failed, count(*) + count(*) FILTER (event_type = 'signup') AS rules, 0::BIGINT AS disabled_rules, count(*) FILTER (event_type <> 'error') + count(*) FILTER (event_type = 'signup') AS semantically_understood_rules,
  0::BIGINT AS api_rules, count(*) FILTER (event_type <> 'error') + count(*) FILTER (event_type = 'signup') AS standard_rules, 0::BIGINT AS project_rules, 0::BIGINT AS component_class_only_rules, count(*) FILTER (event_type = 'error') AS unknown_rules FROM events""",
}
