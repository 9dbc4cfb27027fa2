"""Reference edges: reachability, cycles, referrers and tree differences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.settle import settled


def edges(df: DataFrame, src: str, dst: str, nodes: DataFrame, node: str) -> DataFrame:
    """Distinct (src, dst) between nodes, without loops."""
    known = nodes.select(F.col(node).alias("_node")).distinct()
    out = df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src != dst").distinct()
    return out.join(known, F.col("dst") == F.col("_node"), "left_semi").join(known, F.col("src") == F.col("_node"), "left_semi")


def reach(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst) pairs joined by a path of one edge or more, by doubling: round k knows paths of up to 2 ** k edges.

    The result has a row a pair; for graphs of a template or a hierarchy, not for webs.
    """
    known = settled(links.select("src", "dst").distinct())
    n = known.count()
    for _ in range(rounds):
        step = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        known = settled(known.unionByName(step).distinct())
        m = known.count()
        if m == n:
            break
        n = m
    return known


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without an edge in or out go, again and again."""
    n = edges.count()
    while n:
        begun, ended = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = settled(edges.join(ended, "src", "left_semi").join(begun, "dst", "left_semi").select("src", "dst"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def cycle_nodes(links: DataFrame) -> DataFrame:
    """Nodes that reach themselves.

    No pairs are made: nodes pass on the largest name that reaches them; those from which the owner of their name can be
    reached by nodes of that name are one strong component, and go with it; what is left starts again. A round is a join
    of the edges; there are as many as the longest way that a name or its owner's search takes.
    """
    edges = settled(links.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    edges = settled(edges.where("src != dst"))
    while (edges := _trimmed(edges)).take(1):
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        named = settled(nodes.select("node", F.col("node").alias("name")))
        while True:
            met = edges.join(named, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("name").alias("other"))
            both = named.join(met, F.col("node") == F.col("dst"), "left")
            step = settled(both.select("node", F.coalesce(F.greatest("name", "other"), "name").alias("name"), F.coalesce(F.col("other") > F.col("name"), F.lit(False)).alias("moved")))
            named = step.select("node", "name")
            if not step.where("moved").take(1):
                break
        ends = named.select(F.col("node").alias("dst"), F.col("name").alias("to"))
        inside = settled(edges.join(named.select(F.col("node").alias("src"), "name"), "src").join(ends, "dst").where("name = to").select("src", "dst", "name"))
        held = settled(named.where("node = name").select("node", "name"))
        new = held
        while new.take(1):
            before = inside.join(new.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "name").distinct()
            new = settled(before.join(held.select("node"), "node", "left_anti"))
            held = settled(held.unionByName(new))
        several = held.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
        found = settled(found.unionByName(held.join(several, "name", "left_semi").select("node")))
        gone = held.select("node")
        edges = settled(edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return found.distinct()


def first_cycles(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(template_id, cycle): the first cycle of each template that has one, its first node again at the end.

    links has (template_id, src, dst, late, ord), nodes (template_id, node, ord). Nodes are entered in their order, and so
    are the edges of a node; the first edge back to a node that is still open closes the cycle. A template is one group.
    """

    def cycle(order: list[str], ends: list[dict]) -> list[str] | None:
        after: dict[str, list[str]] = {}
        for e in ends:
            after.setdefault(e["src"], []).append(e["dst"])
        closed: set[str] = set()
        for start in order:
            if start in closed:
                continue
            way, rest, at = [start], [iter(after.get(start, ()))], {start: 0}
            while way:
                node = next(rest[-1], None)
                if node is None:
                    gone = way.pop()
                    rest.pop()
                    del at[gone]
                    closed.add(gone)
                elif node in at:
                    return [*way[at[node] :], node]
                elif node not in closed:
                    at[node] = len(way)
                    way.append(node)
                    rest.append(iter(after.get(node, ())))
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cycle(*x) for x in zip(batch.column("nodes").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("template_id"), pa.array(found, pa.list_(pa.string()))], ["template_id", "cycle"])

    ends = links.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("late", "ord", "src", "dst"))).alias("ends"))
    own = nodes.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node"))).alias("nodes"))
    both = ends.join(own, "template_id").select(F.col("template_id").cast("string").alias("template_id"), F.transform("nodes", lambda x: x["node"]).alias("nodes"), "ends")
    return both.mapInArrow(run, "template_id string, cycle array<string>").where("cycle is not null")


def referrers(nodes: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """Each node with the sources of its edges, in order, joined by commas; empty if there are none."""
    by = links.groupBy(F.col("dst").alias("_dst")).agg(F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), ",").alias("referrers"))
    return nodes.join(by, F.col(node) == F.col("_dst"), "left").select(*nodes.columns, F.coalesce("referrers", F.lit("")).alias("referrers"))


def tree_diff(base: DataFrame, head: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path, change) of two node tables (scope, path, vtype, sval); path is an array of steps.

    Of an added, removed or modified node only the topmost is told: rows under a changed path are dropped by an equality
    join on their ancestors.
    """
    a = base.select(*scope, "path", F.col("vtype").alias("_bt"), F.col("sval").alias("_bv"), F.lit(True).alias("_b"))
    b = head.select(*scope, "path", F.col("vtype").alias("_ht"), F.col("sval").alias("_hv"), F.lit(True).alias("_h"))
    both = a.join(b, [*scope, "path"], "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(~(F.col("_bt").eqNullSafe(F.col("_ht")) & F.col("_bv").eqNullSafe(F.col("_hv"))), "modified")
    changed = both.select(*scope, "path", change.alias("change")).where("change is not null")
    above = changed.where(F.size("path") > 0).withColumn("_up", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))))
    tops = changed.select(*scope, F.col("path").alias("_up"))
    below = above.join(tops, [*scope, "_up"], "left_semi").select(*scope, "path").distinct()
    return changed.join(below, [*scope, "path"], "left_anti")
