"""Backward reachability as a semi-naive fixpoint over written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds at most; each is one more step away from a seed. A chain that is longer is an error, never a shorter result.
MOST_ROUNDS = 5000
#: Edges up to which a graph is sent to every task, which then walks it from its own seeds.
SENT_EDGES = 250_000
#: Pairs that a walk gives at a time, at least.
ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='lodeline-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read back: their lineage is cut, and they are worked out once."""
    spark = rows.sparkSession
    where = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(where)
    return spark.read.schema(rows.schema).parquet(where)


def _walk(sent):
    """Seeds of a partition to the pairs (seed, node) they reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        back = sent.value
        for pdf in batches:
            seeds, nodes = [], []
            for seed in pdf["seed"].tolist():
                done, todo = {seed}, [seed]
                while todo:
                    for n in back.get(todo.pop(), ()):
                        if n not in done:
                            done.add(n)
                            todo.append(n)
                seeds += [seed] * len(done)
                nodes += done
                if len(nodes) >= ROWS:
                    yield pd.DataFrame({"seed": seeds, "node": nodes})
                    seeds, nodes = [], []
            if nodes:
                yield pd.DataFrame({"seed": seeds, "node": nodes})

    return run


def reach(spark: SparkSession, seeds: DataFrame, edges: DataFrame, *, stop: DataFrame | None = None, most: int = MOST_ROUNDS, sent_edges: int = SENT_EDGES) -> DataFrame:
    """(seed, node) reachable from each seed against (src, dst) edges: from dst to src; nodes in `stop` are not left.

    A graph of at most `sent_edges` edges (counted first) goes to every task, and seeds are walked side by side. A larger
    one stays distributed: each round joins the newest pairs with the edges and keeps what is new by an anti-join.
    Rounds are written to the shared folder, which cuts the plan and survives executors.
    """
    root = f"{shared_folder(spark).rstrip('/')}/reach-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    steps = edges.select(F.col("src").alias("to"), F.col("dst").alias("at")).distinct()
    blocked = stop.select(F.col("node")).distinct() if stop is not None else None
    if blocked is not None:
        steps = steps.join(blocked, steps["at"] == blocked["node"], "left_anti")
    steps = keep(steps, "edges")
    starts = seeds.select("seed").distinct()
    if steps.count() <= sent_edges:
        pairs, back = steps.toPandas(), {}
        for at, to in zip(pairs["at"].tolist(), pairs["to"].tolist()):
            back.setdefault(at, []).append(to)
        sent = spark.sparkContext.broadcast(back)
        kind = starts.schema["seed"].dataType.simpleString()
        return starts.mapInPandas(_walk(sent), f"seed {kind}, node {kind}")
    new = keep(starts.select("seed", F.col("seed").alias("node")), "0")
    done = [f"{root}/0"]
    for k in range(1, most + 1):
        found = new.join(steps, new["node"] == steps["at"]).select("seed", F.col("to").alias("node")).distinct()
        seen = spark.read.schema(new.schema).parquet(*done)
        new = keep(found.join(seen, ["seed", "node"], "left_anti"), str(k))
        if new.isEmpty():
            break
        done.append(f"{root}/{k}")
    else:
        if most:
            raise RuntimeError(f"nodes more than {most} steps away from a seed; raise `most`")
    return spark.read.schema(new.schema).parquet(*done)


def any_ancestor(rows: DataFrame, own: Column, *up: Column) -> Column:
    """Whether a row or any of its joined ancestors has the flag."""
    out = F.coalesce(own, F.lit(False))
    for c in up:
        out = out | F.coalesce(c, F.lit(False))
    return out
