"""Connected components of an undirected graph that is a DataFrame of edges.

Alternating large-star / small-star rounds: each round every node points its
larger neighbours at its smallest neighbour. The edges stay distributed; the
driver reads two numbers a round (an edge count and an order-free checksum).
Each round is written to the shared stage folder, so lineage stays short and
a lost executor costs a re-read. Both sides of each join come straight from a
scan, so a node with very many neighbours can be split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, u: str, v: str, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of a proper edge; root is the smallest node
    of its component. Nodes without an edge to another node do not appear."""
    e = written(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), f"{name}-edges")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
                      f"{name}-low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .where("u > v").distinct(), f"{name}-large")
        low2 = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low2")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v")))
        e = written(small.where("u > v").distinct(), f"{name}-edges")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
