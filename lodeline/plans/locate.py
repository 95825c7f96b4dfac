"""From an eid to the file, entry and rule it stands for, through an incremental inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import resolve
from lodeline.plans.expand import Source
from lodeline.sources import corpus
from lodeline.sources.store import Store


def refresh(spark: SparkSession, store: Store, root: str) -> DataFrame:
    """The index (eid, file) of a corpus, read anew only for files whose size or time changed; vanished files go."""
    now = corpus.files(spark, root)
    marked = now.select("file", F.concat_ws(":", "length", F.col("modified").cast("double")).alias("mark"))
    old = store.table("eids", "eid string, file string, mark string")
    before = old.select("file", "mark").distinct()
    status = resolve.fingerprint_diff(before, marked, "file", "mark")
    stale = status.where("status IN ('NEW', 'CHANGED')").select("file")
    fresh = corpus.eid_index(now.join(stale, "file", "left_semi")).join(marked, "file").select("eid", "file", "mark")
    # A file without any eid keeps its mark, so that it is not read again.
    none = marked.join(stale, "file", "left_semi").select(F.lit(None).cast("string").alias("eid"), "file", "mark")
    kept = old.join(status.where("status = 'CACHED'").select("file"), "file", "left_semi").select("eid", "file", "mark")
    store.publish({"eids": kept.unionByName(fresh).unionByName(none).distinct()})
    return store.table("eids").where("eid IS NOT NULL").select("eid", "file")


def candidates(spark: SparkSession, root: str, eids: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(eid, file) where an eid may stand."""
    found = index if index is not None else corpus.eid_index(corpus.files(spark, root)).distinct()
    return found.join(eids.select("eid").distinct(), "eid", "left_semi").select("eid", "file")


def located(load, eid: str, files: list[str], entry: str | None = None) -> dict:
    """The one node of an eid as a trace target: its phase, else its outermost rule, as entry."""
    found = []
    for file in sorted(files):
        src = Source(file, load(file))
        allowed = None
        if entry:
            roots = src.entries(entry)
            allowed = {id(r) for r in roots}
        for node in src.by_eid.get(eid, []):
            up = list(node.up())
            if allowed is not None and allowed.isdisjoint(map(id, up)):
                continue
            found.append((file, node, up, src))
    if not found:
        raise ValueError(f"EID_NOT_FOUND: {eid!r} in the selected files/entry")
    if len(found) > 1:
        where = ", ".join(f"{f}:{n.line}" for f, n, _, _ in found[:20])
        raise ValueError(f"EID_NOT_UNIQUE: {eid!r} matches {len(found)} nodes: {where}")
    file, node, up, src = found[0]
    if entry is None:
        phase = next((n for n in up if n.tag == "Phase"), None)
        if phase is not None and len(src.entries(src.phase_name(phase))) == 1:
            entry = src.phase_name(phase)
        else:
            top = phase or next((n for n in reversed(up) if n.tag == "Rule"), node)
            if not top.eid:
                raise ValueError(f"Cannot infer an entry for eid {eid!r} in {file}")
            entry = "@" + top.eid
    return {"file": file, "field": None, "rule_eid": eid, "entry": entry}
