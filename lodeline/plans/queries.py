"""Engine queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables stand for the engine's relations: pages are markup, events are activations (user = scope, event_id =
sequence, types act as reads, writes, barriers and opaque rules), lineitem and orders are attribute bags and callers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import conditions, text
from lodeline.operators import closure, flow, markup, resolve, rollup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_VISIBLE_SQL = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<!\[CDATA\[.*?\]\]>', '', 'gs'), '<script.*?</script>', '', 'gs')"


def visible_tag_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags outside comments and scripts, counted by name."""
    return markup.start_tags(_table(spark, sf_dir, "pages"), F.col("html")).groupBy("tag").agg(F.count("*").alias("n"))


def attribute_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tag_attributes(_table(spark, sf_dir, "pages"), F.col("html"), "page_id", ["href", "src", "charset", "class"])


def stack_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and owner of the balanced block tags of a page."""
    found = F.regexp_extract_all(markup.visible(F.col("html")), F.lit(r"(</?(?:nav|ul|li|article)(?:[ ][^>]*)?>)"), 1)
    tags = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ordinal", "raw"))
    name = F.regexp_extract("raw", "([a-z]+)", 1)
    tags = tags.select("page_id", "ordinal", name.alias("tag"), F.when(F.col("raw").startswith("</"), -1).otherwise(1).alias("delta"))
    return markup.structure(tags, "page_id", "ordinal", "tag", "delta")


def reference_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    selector = F.array_join(F.regexp_extract_all(markup.visible(F.col("html")), F.lit(' href="([^"]*)"'), 1), " ")
    cls = lambda ref: resolve.reference_class(F.col("html"), markup.visible(F.col("html")), selector, ref)
    return p.select("page_id", cls("/the").alias("about_the"), cls("track(").alias("about_track"), cls("nowhere!").alias("about_nothing"))


def alias_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    blank = lambda col, v: F.when(F.col(col) == v, "").otherwise(F.col(col))
    value = resolve.first_filled(blank("o_orderpriority", "5-LOW"), blank("o_orderstatus", "P"), F.col("c_name"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", value.alias("label"))


def class_suffix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", F.lower(F.split("p_name", " ")[0]), F.col("p_type"))
    value, match = resolve.exact_then_suffix(name, {"red.economy": "GET", "small.promo": "PUT"}, {"economy": "POST", "large": "DELETE"})
    return _table(spark, sf_dir, "part").select("p_partkey", value.alias("method"), match.alias("matched"))


def late_binding_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    rows = e.where("event_type = 'view'").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    declared = e.where("event_type = 'purchase'").select("user_id", "event_id", "value")
    return resolve.late_bound(rows, declared, "user_id", "value", "event_id").select("event_id", "user_id", "value")


def operation_link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _table(spark, sf_dir, "nation")
    own = F.concat(F.lit(" Lib\\"), F.concat(F.lit("NATION_"), F.col("s_nationkey")), F.lit("/; ,NATION_1|"))
    names = F.when(F.col("s_suppkey") % 7 == 0, F.lit(None)).when(F.col("s_suppkey") % 5 == 0, F.lit("Atlantis")).otherwise(own)
    callers = _table(spark, sf_dir, "supplier").select("s_suppkey", resolve.name_targets(names).alias("targets"))
    return resolve.linked(callers, "s_suppkey", "targets", ops, "n_nationkey", "n_name")


def flattened_mapping_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("l_returnflag") == "A", "_In").when(F.col("l_returnflag") == "R", "_PubOut").otherwise("_PropertyKey")
    bag = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.col("l_linestatus"), suffix).alias("name"), F.when(F.col("l_quantity") > 25, "Yes").otherwise("no").alias("value"))
    return resolve.mapping_rows(bag, ["l_orderkey"], "name", "value", ["_In", "_Out", "_PubIn", "_PubOut", "_PropertyKey"])


def stale_and_cache_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("mark"))
    before = d.where("doc_id % 3 <> 0").withColumn("mark", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("mark")))
    return resolve.fingerprint_diff(before, d.where("doc_id % 7 <> 0"), "doc_id", "mark")


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return flow.reaching_definitions(_table(spark, sf_dir, "events"), "user_id", "event_id", kind == "view", kind == "click", kind == "purchase")


def prefix_group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address lies under another page's, addresses cut to the first parts."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$|/$", "").alias("path"))
    groups = p.select(F.col("page_id").alias("group_id"), F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return flow.group_overlap(p, groups, "path", "page_id", "group_id")


def guard_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.hour("ts").alias("guard"), (F.col("value") > 20).alias("branch"))
    return flow.compatible_counts(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "guard", "branch", "event_id")


def opaque_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, last = flow.opaque_before(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")
    out = _table(spark, sf_dir, "events").select("event_id", "event_type", n.alias("n_opaque"), last.alias("last_opaque"))
    return out.where("event_type = 'view'").select("event_id", "n_opaque", "last_opaque")


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each event depends on events id/3 (by value) and id/3 + 1 (by control); purchases are not left."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type")
    down = F.floor(F.col("event_id") / 3).cast("long")
    value = e.where("event_id > 2").select(down.alias("src"), F.col("event_id").alias("dst"))
    control = e.where("event_id > 2").select((down + 1).alias("src"), F.col("event_id").alias("dst"))
    seeds = e.select(F.col("event_id").alias("seed"))
    return value, control, seeds, e.where("event_type = 'purchase'").select(F.col("event_id").alias("node"))


def backward_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, control, seeds, stop = _edges(spark, sf_dir)
    return closure.reach(spark, seeds, value.union(control), stop=stop)


def value_vs_control_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, control, seeds, stop = _edges(spark, sf_dir)
    every = closure.reach(spark, seeds, value.union(control), stop=stop).groupBy("seed").agg(F.count("*").alias("n_all"))
    data = closure.reach(spark, seeds, value, stop=stop).groupBy("seed").agg(F.count("*").alias("n_value"))
    return every.join(data, "seed").select("seed", "n_all", "n_value")


def ancestor_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    off = closure.any_ancestor(rows, F.col("s_acctbal") < 0, F.col("n_nationkey") % 7 == 0, F.col("r_regionkey") == 1)
    return rows.select("s_suppkey", off.alias("disabled"))


_CONDITION = """NOT $$labels.toxic$ == '1' AND ('$$labels.quality$' == "1" OR $$lang$ != 'en')"""


def kleene_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, names = _table(spark, sf_dir, "documents"), {"labels.toxic": F.col("toxic").cast("string"), "labels.quality": F.col("quality").cast("string"), "lang": F.col("lang")}
    got = conditions.column(conditions.parse(_CONDITION), names.__getitem__)
    rows = d.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(got, "true").when(~got, "false").otherwise("unknown").alias("result"))


def asof_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    last = flow.last_value(e, "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", "event_type", last.alias("value")).where("event_type = 'view'").select("event_id", "value")


def scenario_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate, excluded by a false guard, or another trigger's context, which outranks both."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    guard = F.when(k % 5 != 0, k > 40)  # unknown where k is a multiple of five
    label = F.when(F.col("user_id") % 3 != 0, "other_event_context").when(~guard, "excluded").otherwise("candidate")
    return e.select("event_id", label.alias("status"))


def anchor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kind = F.col("event_type")
    per = _table(spark, sf_dir, "events").groupBy("user_id").agg(count(kind == "purchase").alias("s"), count((kind == "error") & (F.col("value") > 40)).alias("b"), count(kind == "click").alias("c"))
    return per.select("user_id", rollup.anchor_status(F.col("s"), F.col("b"), F.col("c")).alias("status"))


def findings_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.findings(_table(spark, sf_dir, "events"), "event_type", "event_id", 3)


def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    order = rollup.ranked(F.col("event_type"), ["error", "purchase", "click"])
    return per.select("event_type", "n", F.row_number().over(Window.orderBy(order, F.desc("n"), "event_type")).alias("place"))


def template_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("/p/$%IF a.b == 'x'$"), F.col("p_type"), F.lit("$%ELSE$any$%ENDIF$/$%IF c.d$"), F.col("p_size").cast("string"), F.lit("$%ENDIF$"))
    v = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.template_variants(raw)).alias("variant", "v"))
    return v.select("p_partkey", "variant", F.col("v.template").alias("template"), F.col("v.n_guards").alias("n_guards"))


def field_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("$$"), F.col("event_type"), F.lit(".k.trim()$ == '$$user$' AND Data.Item["), F.get_json_object("props", "$.k"), F.lit("].Name"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(text.condition_references(raw), "|").alias("fields"))


def duplicate_eids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns found by (conversation, role), which is only a reference where one turn has it."""
    c = _table(spark, sf_dir, "conversations")
    n = F.count("*").over(Window.partitionBy("conv_id", "role"))
    status = F.when(n == 1, "UNIQUE").otherwise("LINK_NOT_UNIQUE")
    return c.select("conv_id", "turn", "role", n.alias("n"), status.alias("status"))


def class_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("l_returnflag") == "A", "api").when(F.col("l_returnflag") == "R", "standard").otherwise("unknown")
    rows = _table(spark, sf_dir, "lineitem").select(category.alias("category"), F.col("l_linestatus").alias("class"), "l_quantity")
    return rows.groupBy("category", "class").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 40).alias("n_large"))


QUERIES = {f.__name__: f for f in (
    visible_tag_census, attribute_projection, stack_ownership, reference_classification, alias_coalesce, class_suffix_resolution,
    late_binding_last_wins, operation_link_resolution, flattened_mapping_pivot, stale_and_cache_diff, content_fingerprint,
    reaching_definitions, prefix_group_overlap, guard_compatibility, opaque_predecessors, backward_closure, value_vs_control_closure,
    ancestor_disabled, kleene_conditions, asof_last_value, scenario_labels, anchor_status, findings_topn, severity_order,
    template_variants, field_references, duplicate_eids, class_census,
)}

_CLOSURE_SQL = """
WITH RECURSIVE v AS (SELECT event_id // 3 AS src, event_id AS dst FROM events WHERE event_id > 2),
c AS (SELECT event_id // 3 + 1 AS src, event_id AS dst FROM events WHERE event_id > 2),
e AS (SELECT * FROM v UNION SELECT * FROM c),
stop AS (SELECT event_id FROM events WHERE event_type = 'purchase'),
r(seed, node) AS (SELECT event_id, event_id FROM events
  UNION SELECT r.seed, e.src FROM r JOIN e ON e.dst = r.node WHERE r.node NOT IN (SELECT event_id FROM stop)),
d(seed, node) AS (SELECT event_id, event_id FROM events
  UNION SELECT d.seed, v.src FROM d JOIN v ON v.dst = d.node WHERE d.node NOT IN (SELECT event_id FROM stop))
"""

ORACLE_SQL = {
    "visible_tag_census": f"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_VISIBLE_SQL}, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag",
    "attribute_projection": f"""
WITH l AS (SELECT page_id, regexp_extract_all({_VISIBLE_SQL}, ' ((?:href|src|charset|class)="[^"]*")', 1) AS a FROM pages),
x AS (SELECT page_id, a, unnest(range(len(a))) AS i FROM l), p AS (SELECT page_id, i, a[i + 1] AS p FROM x)
SELECT page_id, i::INT AS ordinal, split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 2, length(p) - strpos(p, '=') - 2) AS value FROM p""",
    "stack_ownership": f"""
WITH l AS (SELECT page_id, regexp_extract_all({_VISIBLE_SQL}, '(</?(?:nav|ul|li|article)(?:[ ][^>]*)?>)', 1) AS a FROM pages),
x AS (SELECT page_id, a, unnest(range(len(a))) AS i FROM l),
t AS (SELECT page_id, i::INT AS ordinal, regexp_extract(a[i + 1], '([a-z]+)', 1) AS tag, CASE WHEN a[i + 1] LIKE '</%' THEN -1 ELSE 1 END AS delta FROM x),
d AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY ordinal) - delta AS depth FROM t),
o AS (SELECT * FROM d WHERE delta = 1),
m AS (SELECT a.page_id, a.ordinal, max(b.ordinal) AS parent FROM o a LEFT JOIN o b ON a.page_id = b.page_id AND b.depth = a.depth - 1 AND b.ordinal < a.ordinal GROUP BY ALL)
SELECT o.page_id, o.ordinal, o.tag, o.depth::BIGINT AS depth, m.parent, p.tag AS parent_tag
FROM o JOIN m ON o.page_id = m.page_id AND o.ordinal = m.ordinal LEFT JOIN o p ON p.page_id = o.page_id AND p.ordinal = m.parent""",
    "reference_classification": f"""
WITH s AS (SELECT page_id, html, {_VISIBLE_SQL} AS seen FROM pages),
h AS (SELECT *, array_to_string(regexp_extract_all(seen, ' href="([^"]*)"', 1), ' ') AS sel FROM s)
SELECT page_id, {', '.join(f"CASE WHEN contains(sel, '{r}') THEN 'CONFIRMED' WHEN contains(replace(seen, chr(92), '/'), '{r}') THEN 'INFERRED' WHEN contains(replace(html, chr(92), '/'), '{r}') THEN 'HIDDEN' ELSE 'NONE' END AS {n}" for r, n in (('/the', 'about_the'), ('track(', 'about_track'), ('nowhere!', 'about_nothing')))} FROM h""",
    "alias_coalesce": """
SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END, ''),
  nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, ''), nullif(c_name, '')) AS label
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "class_suffix_resolution": """
WITH n AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1) || '.' || p_type) AS f, lower(p_type) AS s FROM part),
m AS (SELECT p_partkey, CASE f WHEN 'red.economy' THEN 'GET' WHEN 'small.promo' THEN 'PUT' END AS a, CASE s WHEN 'economy' THEN 'POST' WHEN 'large' THEN 'DELETE' END AS b FROM n)
SELECT p_partkey, coalesce(a, b) AS method, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'suffix' END AS matched FROM m""",
    "late_binding_last_wins": """
WITH d AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY user_id)
SELECT event_id, user_id, coalesce(CASE WHEN value > 50 THEN value END, d.v) AS value FROM events LEFT JOIN d USING (user_id) WHERE event_type = 'view'""",
    "operation_link_resolution": """
WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN [] WHEN s_suppkey % 5 = 0 THEN ['atlantis'] ELSE ['nation_' || s_nationkey, 'nation_1'] END AS names FROM supplier),
x AS (SELECT DISTINCT s_suppkey, unnest(names) AS k FROM t),
e AS (SELECT DISTINCT s_suppkey, n_nationkey FROM x JOIN nation ON lower(n_name) = k)
SELECT s_suppkey, n_nationkey, 'EXACT_PRODUCT' AS status FROM e
UNION ALL SELECT s_suppkey, NULL, 'AMBIGUOUS_OPERATION_TARGET' FROM t WHERE s_suppkey NOT IN (SELECT s_suppkey FROM e)""",
    "flattened_mapping_pivot": """
SELECT l_orderkey, l_linestatus AS prefix, CASE WHEN i AND o THEN 'INOUT' WHEN i THEN 'INPUT' WHEN o THEN 'OUTPUT' ELSE 'UNKNOWN' END AS direction, n_attributes
FROM (SELECT l_orderkey, l_linestatus, bool_or(l_returnflag = 'A' AND l_quantity > 25) AS i, bool_or(l_returnflag = 'R' AND l_quantity > 25) AS o, count(*) AS n_attributes
      FROM lineitem GROUP BY 1, 2)""",
    "stale_and_cache_diff": """
WITH b AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'NEW' WHEN n.doc_id IS NULL THEN 'VANISHED' WHEN b.doc_id % 5 = 0 THEN 'CHANGED' ELSE 'CACHED' END AS status
FROM b FULL JOIN n ON b.doc_id = n.doc_id""",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "reaching_definitions": """
WITH r AS (SELECT r.event_id AS reader, r.user_id, coalesce(max(b.event_id), -1) AS bar FROM events r LEFT JOIN events b ON b.user_id = r.user_id AND b.event_type = 'purchase' AND b.event_id < r.event_id
  WHERE r.event_type = 'view' GROUP BY 1, 2),
p AS (SELECT w.event_id AS writer, reader FROM r JOIN events w ON w.user_id = r.user_id AND w.event_type IN ('click', 'purchase') AND w.event_id < reader AND w.event_id >= bar)
SELECT writer, reader, CASE WHEN count(*) OVER (PARTITION BY reader) > 1 THEN 'candidate_definition' ELSE 'definition' END AS relation FROM p""",
    "prefix_group_overlap": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$|/$', '', 'g') AS path FROM pages),
g AS (SELECT page_id AS group_id, regexp_replace(path, '/[^/]*$', '') AS path FROM p)
SELECT group_id, page_id FROM g JOIN p ON starts_with(p.path, g.path || '/')""",
    "guard_compatibility": """
WITH e AS (SELECT event_id, user_id, event_type, hour(ts) AS g, value > 20 AS b FROM events)
SELECT r.event_id, count(w.event_id) AS n_compatible FROM (SELECT * FROM e WHERE event_type = 'view') r
LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') w ON w.user_id = r.user_id AND NOT (w.g = r.g AND w.b <> r.b) GROUP BY r.event_id""",
    "opaque_predecessors": """
SELECT r.event_id, count(o.event_id) AS n_opaque, max(o.event_id) AS last_opaque FROM events r
LEFT JOIN events o ON o.user_id = r.user_id AND o.event_type = 'error' AND o.event_id < r.event_id WHERE r.event_type = 'view' GROUP BY r.event_id""",
    "backward_closure": _CLOSURE_SQL + "SELECT seed, node FROM r",
    "value_vs_control_closure": _CLOSURE_SQL + "SELECT a.seed, a.n AS n_all, b.n AS n_value FROM (SELECT seed, count(*) AS n FROM r GROUP BY 1) a JOIN (SELECT seed, count(*) AS n FROM d GROUP BY 1) b ON a.seed = b.seed",
    "ancestor_disabled": """
SELECT s_suppkey, (s_acctbal < 0 OR coalesce(n_nationkey % 7 = 0, false) OR coalesce(r_regionkey = 1, false)) AS disabled
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "kleene_conditions": """
WITH x AS (SELECT d.doc_id, NOT (toxic = 1) AND (quality = 1 OR lang <> 'en') AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN r THEN 'true' WHEN NOT r THEN 'false' ELSE 'unknown' END AS result FROM x""",
    "asof_last_value": """
SELECT r.event_id, arg_max(p.value, p.event_id) AS value FROM events r LEFT JOIN events p ON p.user_id = r.user_id AND p.event_type = 'purchase' AND p.value IS NOT NULL AND p.event_id < r.event_id
WHERE r.event_type = 'view' GROUP BY r.event_id""",
    "scenario_labels": """
WITH x AS (SELECT event_id, user_id, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN 'other_event_context' WHEN k % 5 <> 0 AND NOT k > 40 THEN 'excluded' ELSE 'candidate' END AS status FROM x""",
    "anchor_status": """
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'not_assessable' WHEN count(*) FILTER (event_type = 'error' AND value > 40) > 0 THEN 'blocked'
  WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'conditional' ELSE 'static_candidate' END AS status FROM events GROUP BY user_id""",
    "findings_topn": "SELECT event_type, count(*) AS n, list_sort(list(event_id))[1:3] AS samples, greatest(count(*) - 3, 0) AS more FROM events GROUP BY event_type",
    "severity_order": """
SELECT event_type, n, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, n DESC, event_type)::INT AS place
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""",
    "template_variants": """
SELECT p_partkey, v AS variant, '/p/' || CASE WHEN v < 2 THEN p_type ELSE 'any' END || '/' || CASE WHEN v % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS template, 2 AS n_guards
FROM part, (SELECT unnest([0, 1, 2, 3])::INT AS v)""",
    "field_references": "SELECT event_id, event_type || '.k|user|Data.Item[' || json_extract_string(props, '$.k') || '].Name' AS fields FROM events",
    "duplicate_eids": """
SELECT conv_id, turn, role, count(*) OVER w AS n, CASE WHEN count(*) OVER w = 1 THEN 'UNIQUE' ELSE 'LINK_NOT_UNIQUE' END AS status
FROM conversations WINDOW w AS (PARTITION BY conv_id, role)""",
    "class_census": """
SELECT CASE l_returnflag WHEN 'A' THEN 'api' WHEN 'R' THEN 'standard' ELSE 'unknown' END AS category, l_linestatus AS class, count(*) AS n, count(*) FILTER (l_quantity > 40) AS n_large
FROM lineitem GROUP BY 1, 2""",
}
