"""Fixpoints on edge tables: reachability, closure, type-gated reachability, cycles, components.

Each is a loop of joins on the driver; a round's result is a written table, so plans stay short and a
lost executor costs a round at most. Frontiers are anti-joined with what is known (semi-naive
evaluation): a round's work is that of the new rows. A graph, or what rounds have left of one, of at
most LOCAL_EDGES edges is solved in one task on an executor instead, with the same result;
larger ones shrink round by round until they are that small or done.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.functions.tables import Scratch

MOST_ROUNDS = 10_000
#: Edges that one task holds: some 100 MB in a Python worker.
LOCAL_EDGES = 1_000_000


def _coded(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Columns of ids as positions in their sorted distinct values, and these values."""
    values = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).unique()
    values = values.take(pc.array_sort_indices(values))
    return [pc.index_in(x, values).to_numpy().astype(np.int64) for x in columns], values


def _local(df: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One task solves a whole table, which the caller knows to be small."""
    return df.groupBy(F.lit(0).alias("__all")).applyInArrow(lambda t: solve(t.drop(["__all"]) if "__all" in t.column_names else t), schema)


def _local_reach(t: pa.Table) -> pa.Table:
    """Rows with a null target are roots."""
    edge = pc.is_valid(t.column("dst"))
    (src, dst), ids = _coded(t.column("src"), pc.coalesce(t.column("dst"), t.column("src")))
    edge = edge.to_numpy()
    order = np.argsort(src[edge], kind="stable")
    heads, begin = dst[edge][order].tolist(), np.searchsorted(src[edge][order], np.arange(len(ids) + 1)).tolist()
    known = np.zeros(len(ids), bool)
    work = np.unique(src[~edge]).tolist()
    known[work] = True
    while work:
        v = work.pop()
        for w in heads[begin[v] : begin[v + 1]]:
            if not known[w]:
                known[w] = True
                work.append(w)
    return pa.table({"id": ids.filter(pa.array(known))})


def reach(edges: DataFrame, roots: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", id_: str = "id") -> DataFrame:
    """The roots and all that edges lead to from them. What is small is solved in one task."""
    e = scratch.save(edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).filter("__s is not null and __d is not null").distinct(), "reach-edges")
    known = frontier = scratch.save(roots.select(F.col(roots.columns[0]).alias(id_)).distinct(), "reach")
    if e.count() + known.count() <= LOCAL_EDGES:
        kind = dict(e.dtypes)["__s"]
        rows = e.select(F.col("__s").alias("src"), F.col("__d").alias("dst")).unionByName(known.filter(F.col(id_).isNotNull()).select(F.col(id_).cast(kind).alias("src"), F.lit(None).cast(kind).alias("dst")))
        return scratch.save(_local(rows, _local_reach, f"id {kind}").withColumnRenamed("id", id_), "reached")
    for _ in range(MOST_ROUNDS):
        new = frontier.join(e, F.col(id_) == F.col("__s")).select(F.col("__d").alias(id_)).distinct().join(known, id_, "left_anti")
        frontier = scratch.save(new, "frontier")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise RuntimeError("reach did not end")


def closure(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """All pairs (src, dst) that one edge or more connect, also from a node to itself on a cycle."""
    e = scratch.save(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "edges")
    known = frontier = e
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("__next"))
    for _ in range(MOST_ROUNDS):
        new = frontier.join(step, "dst").select("src", F.col("__next").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
        frontier = scratch.save(new, "frontier")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise RuntimeError("closure did not end")


def _local_live(t: pa.Table) -> pa.Table:
    """Rows of three kinds: symbols (0: a id, b parent, name, flags), edges (1: a to b), uses (2: a uses name)."""
    follow, uses, members, ungated, live, names = {}, {}, {}, set(), set(), set()
    by_name, work = {}, []
    for tag, a, b, name, member, free, root in zip(*(t.column(c).to_pylist() for c in ("tag", "a", "b", "name", "is_member", "ungated", "root")), strict=True):
        if tag == 1:
            follow.setdefault(a, []).append(b)
        elif tag == 2:
            uses.setdefault(a, []).append(name)
        else:
            if member and name is not None:
                by_name.setdefault(name, []).append((a, b))
                members.setdefault(b, []).append((a, name))
                if free:
                    ungated.add(a)
            if root:
                work.append(a)
    while work:
        v = work.pop()
        if v in live:
            continue
        live.add(v)
        work += follow.get(v, ())
        work += [m for m, name in members.get(v, ()) if name in names]
        for name in uses.get(v, ()):
            if name not in names:
                names.add(name)
                work += [m for m, parent in by_name.get(name, ()) if m in ungated or parent in live]
    return pa.table({"id": pa.array(list(live), t.schema.field("a").type)})


def gated_reach(symbols: DataFrame, edges: DataFrame, name_uses: DataFrame, live_children: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids that are live: the least fixpoint of four rules.

    symbols: id, parent (null: none), name, is_member, ungated, root. A root is live; so are the targets
    (edges: src, dst), the parent and the live_children (parent, child) of what is live; a member is,
    when its name is used (name_uses: src, name) by something live and it is ungated or its
    parent is live. Names stay names: they are never joined to all members that carry them before
    the gate lets these through.
    """
    s = scratch.save(symbols.select("id", "parent", "name", "is_member", "ungated", "root"), "symbols")
    direct = edges.select("src", "dst").unionByName(s.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))).unionByName(live_children.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    direct = scratch.save(direct.distinct(), "direct")
    uses = scratch.save(name_uses.select("src", "name").distinct(), "uses")
    if s.count() + direct.count() + uses.count() <= LOCAL_EDGES:
        kind, none, off = dict(s.dtypes)["id"], F.lit(None).cast("string"), F.lit(False)
        flags = [off.alias(c) for c in ("is_member", "ungated", "root")]
        rows = s.select(F.lit(0).alias("tag"), F.col("id").alias("a"), F.col("parent").cast(kind).alias("b"), F.col("name").cast("string").alias("name"), "is_member", "ungated", "root")
        rows = rows.unionByName(direct.select(F.lit(1).alias("tag"), F.col("src").alias("a"), F.col("dst").alias("b"), none.alias("name"), *flags))
        rows = rows.unionByName(uses.select(F.lit(2).alias("tag"), F.col("src").alias("a"), F.lit(None).cast(kind).alias("b"), F.col("name").cast("string").alias("name"), *flags))
        return scratch.save(_local(rows, _local_live, f"id {kind}"), "live")
    members = s.filter("is_member").select("id", "parent", "name", "ungated")
    live = new = scratch.save(s.filter("root").select("id").distinct(), "live")
    names = scratch.save(uses.join(new, uses["src"] == new["id"]).select("name").distinct(), "names")
    new_names = names
    for _ in range(MOST_ROUNDS):
        from_edges = direct.join(new, direct["src"] == new["id"]).select(F.col("dst").alias("id"))
        # A member passes when its name or its parent is new and the other one known.
        by_name = members.join(new_names, "name")
        parents = live.select(F.col("id").alias("parent"))
        open_ = by_name.filter("ungated").select("id").unionByName(by_name.join(parents, "parent", "left_semi").select("id"))
        by_parent = members.join(new.select(F.col("id").alias("parent")), "parent", "left_semi").join(names, "name", "left_semi").select("id")
        found = from_edges.unionByName(open_).unionByName(by_parent).distinct().join(live, "id", "left_anti")
        new = scratch.save(found, "new")
        if new.isEmpty():
            return live
        live = live.unionByName(new)
        new_names = scratch.save(uses.join(new, uses["src"] == new["id"]).select("name").distinct().join(names, "name", "left_anti"), "new-names")
        names = names.unionByName(new_names)
    raise RuntimeError("gated_reach did not end")


def _trimmed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out, until nothing changes: no others lie on cycles."""
    n = edges.count()
    while n:
        both = edges.select(F.col("src").alias("id")).distinct().intersect(edges.select("dst").distinct())
        edges = scratch.step(edges.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi"), "trimmed")
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def _tarjan(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's strong component."""
    order = np.argsort(src, kind="stable")
    heads, begin = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, on, label, stack, count = [-1] * n, [0] * n, [False] * n, list(range(n)), [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, begin[root])]
        while work:
            v, e = work.pop()
            if e == begin[v]:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            while e < begin[v + 1]:
                w = heads[e]
                e += 1
                if index[w] < 0:
                    work.append((v, e))
                    work.append((w, begin[w]))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    for w in members:
                        label[w] = least
                if work:
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
    return np.array(label, np.int64)


def _local_components(t: pa.Table) -> pa.Table:
    (src, dst), ids = _coded(t.column("src"), t.column("dst"))
    label = _tarjan(src, dst, len(ids))
    kept = np.flatnonzero(np.bincount(label, minlength=len(ids))[label] > 1)
    return pa.table({"id": ids.take(pa.array(kept)), "component": ids.take(pa.array(label[kept]))})


def strong_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of the nodes in strongly connected components of more than one node; a component is named by its least id.

    Colouring: every node takes the least id that reaches it; within a colour, what reaches the
    node of that id is its component. Each round settles one component of every colour at least. What
    is small is solved in one task.
    """
    left = scratch.save(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst").distinct(), "edges")
    kind, out = dict(left.dtypes)["src"], None

    def with_(more: DataFrame) -> DataFrame:
        return more if out is None else out.unionByName(more)

    for _ in range(MOST_ROUNDS):
        if left.count() <= LOCAL_EDGES:
            return scratch.save(with_(_local(left, _local_components, f"id {kind}, component {kind}")), "strong")
        left = _trimmed(left, scratch)
        color = scratch.save(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("color", F.col("id")), "color")
        while True:
            come = left.join(color.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("__c"))
            new = scratch.step(color.join(come, "id", "left").select("id", F.least("color", F.coalesce("__c", "color")).alias("color"), (F.col("__c") < F.col("color")).alias("moved")), "color")
            color = new.drop("moved")
            if new.filter("moved").isEmpty():
                break
        same = left.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").filter("a = b").select("src", "dst")
        same = scratch.save(same, "within")
        found = reach(same, color.filter("id = color").select("id"), scratch, "dst", "src")
        found = scratch.save(found.join(color, "id"), "found")
        # The least id that reaches a component's anchor is the anchor, so colours name components by their least ids.
        out = with_(found.join(found.groupBy("color").count().filter("count > 1").select("color"), "color", "left_semi").select("id", F.col("color").alias("component")))
        gone = found.select("id")
        left = scratch.save(left.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"), "left")
    raise RuntimeError("strong_components did not end")


def _local_cycles(t: pa.Table) -> pa.Table:
    """Breadth-first from each anchor, neighbours in order, so that paths come in order within a layer."""
    (anchor, src, dst), ids = _coded(t.column("component"), t.column("src"), t.column("dst"))
    order = np.lexsort((dst, src))
    src, dst, anchor = src[order], dst[order], anchor[order]
    begin, heads = np.searchsorted(src, np.arange(len(ids) + 1)).tolist(), dst.tolist()
    out = []
    for a in np.unique(anchor).tolist():
        before, queue, end = {a: None}, [a], None
        for v in queue:
            for w in heads[begin[v] : begin[v + 1]]:
                if w == a:
                    end = v
                    break
                if w not in before:
                    before[w] = v
                    queue.append(w)
            if end is not None:
                break
        path = []
        while end is not None:
            path.append(end)
            end = before[end]
        out.append((a, path[::-1]))
    flat = [v for _, p in out for v in p]
    paths = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) for _, p in out)]), pa.int32()), ids.take(pa.array(flat, pa.int64())))
    return pa.table({"component": ids.take(pa.array([a for a, _ in out], pa.int64())), "path": paths})


def shortest_cycles(edges: DataFrame, components: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, path, others): per component the shortest cycle through its least id, of several the least path, and the other members.

    Breadth-first layers keep the least path to each node; a component is done at the first layer
    with an edge back to its anchor.
    """
    c = components.select("id", "component")
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst").distinct()
    e = e.join(c.select(F.col("id").alias("src"), F.col("component").alias("component")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("__b")), "dst").filter("component = __b").select("component", "src", "dst")
    e = scratch.save(e, "cycle-edges")
    kind = dict(e.dtypes)["src"]
    members = c.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    if e.count() <= LOCAL_EDGES:
        done = scratch.save(_local(e, _local_cycles, f"component {kind}, path array<{kind}>"), "cycles")
        return done.join(members, "component").select("component", "path", F.array_except("members", "path").alias("others"))
    layer = scratch.save(c.filter("id = component").select("component", F.col("id").alias("at"), F.array("id").alias("path")), "layer")
    seen, done = layer.select("component", "at"), None
    while not layer.isEmpty():
        step = scratch.save(layer.join(e, (layer["at"] == e["src"]) & (layer["component"] == e["component"])).select(e["component"], "dst", "path"), "step")
        closed = scratch.save(step.filter("dst = component").groupBy("component").agg(F.min("path").alias("path")), "closed")
        done = closed if done is None else done.unionByName(closed)
        nxt = step.join(closed.select("component"), "component", "left_anti").groupBy("component", F.col("dst").alias("at")).agg(F.min("path").alias("path"))
        nxt = nxt.join(seen, ["component", "at"], "left_anti").select("component", "at", F.concat("path", F.array("at")).alias("path"))
        layer = scratch.save(nxt, "layer")
        seen = seen.unionByName(layer.select("component", "at"))
    return done.join(members, "component").select("component", "path", F.array_except("members", "path").alias("others"))


def _least_labels(t: pa.Table) -> pa.Table:
    (a, b), ids = _coded(t.column("lo"), t.column("hi"))
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b], a, b):
            np.minimum.at(new, x, low)
        while (new != (jumped := new[new])).any():
            new = jumped
        if (new == label).all():
            break
        label = new
    return pa.table({"id": ids, "component": ids.take(pa.array(label))})


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of an undirected edge table (a, b): the least id that links reach, for every end of an edge.

    A large graph is contracted: every vertex points to its least neighbour, pointers are doubled to
    their roots, and roots replace the ends of edges; more than half of the vertices go each round.
    Aggregations are minima, combined before they are shuffled; joins on a root with very many
    vertices are left to the adaptive splitting of skewed partitions. What is small is solved in one task.
    """
    left = scratch.save(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "pairs")
    kind, labels = dict(left.dtypes)["lo"], None
    for _ in range(MOST_ROUNDS):
        small = left.count() <= LOCAL_EDGES
        if small:
            point = scratch.step(_local(left, _least_labels, f"id {kind}, component {kind}").withColumnRenamed("component", "to"), "point")
        else:
            ends = left.select(F.col("hi").alias("id"), "lo").unionByName(left.select(F.col("lo").alias("id"), "lo"))
            point = scratch.step(ends.groupBy("id").agg(F.min("lo").alias("to")), "point")
            while True:
                over = point.select(F.col("id").alias("to"), F.col("to").alias("__n"))
                new = scratch.step(point.join(over, "to").select("id", F.col("__n").alias("to"), (F.col("to") != F.col("__n")).alias("moved")), "point")
                point = new.drop("moved")
                if new.filter("moved").isEmpty():
                    break
        if labels is None and small:
            return point.withColumnRenamed("to", "component")
        found = point if labels is None else labels.join(point.select(F.col("id").alias("component"), F.col("to").alias("__t")), "component", "left").select("id", F.coalesce("__t", "component").alias("to"))
        labels = scratch.step(found.select("id", F.col("to").alias("component")), "labels")
        if small:
            return labels
        lo, hi = point.select(F.col("id").alias("lo"), F.col("to").alias("x")), point.select(F.col("id").alias("hi"), F.col("to").alias("y"))
        left = scratch.step(left.join(lo, "lo").join(hi, "hi").filter("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "pairs")
    raise RuntimeError("components did not end")
