"""Parent links to full hierarchies: root, depth, path, descendants, and nodes that reach no root.

Each task puts the links whose parent it also holds into weighted disjoint sets: every node knows the top of its local
chain, the number of links to it and the smallest id on the way, and a link that would close a ring is a cycle. Only tops
whose parent lies elsewhere (boundary links) go further. A boundary link is looked up by its parent id, which contracts the
chain inside the other task to one weighted link. The contracted links, far fewer, are merged the same way in a tree of
tasks, one level for each wider locality; what is still open then, because it leads across all of them, is finished by
doubling joins, so no task ever holds more than a group of a locality, wherever the parents lie.

Paths come from the parent traversal inside each task, prefixed with the path of the contracted link. Descendants are
counted by adding subtree sizes upward: inside each task, over the contracted links (a node takes the sums of those that jump
to it, jumps doubling), and inside each task once more; nothing is exploded.

Locality: rows that share `locality` go to one task. It is a list of expressions with bounded groups, each one's groups made of
whole groups of the one before, e.g. the document with its order index divided by 4,096 and by 65,536, so a document with a
third of all rows is spread as well.

Defined results: ids compare without white space at the ends; a blank or null id isn't a node; a blank or null
parent marks a root; a node stored several times counts once, with its smallest parent if they differ; a parent
that doesn't exist ends the chain (end_kind 'missing', end_id that parent); a chain that runs into a cycle has
end_kind 'cycle' and the smallest id on the cycle, nodes on the cycle included; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import blank_to_null, cut, tasks_for

ROWS_A_TASK = 200_000
LOCAL = "node string, parent string, top string, hops long, low string, ext string, cyc string, wider array<long>, size long, path array<string>"
LINKS = "top string, to string, hops long, low string, kind string, end string, wider array<long>"
SEP = "/"


class Forest:
    """Weighted disjoint sets over the numbers below n. up[x] lies above x, hops[x] links away, and low[x] is the smallest
    rank on these links, x's own included; finding the top of x makes it up[x]."""

    def __init__(self, hops: list[int], low: list[int]):
        self.up = list(range(len(low)))
        self.hops, self.low = hops, low  # of each one's own link, and as far as up[x] once it is linked
        self.cycle: dict[int, int] = {}  # top -> smallest rank on the cycle it closes

    def find(self, x: int) -> int:
        up = self.up
        way = []
        while up[x] != x:
            way.append(x)
            x = up[x]
        for y in reversed(way[:-1]):
            u = up[y]
            self.hops[y] += self.hops[u]
            self.low[y] = min(self.low[y], self.low[u])
            up[y] = x
        return x

    def link(self, x: int, parent: int) -> None:
        """x is the top of its set: puts it below its parent."""
        top = self.find(parent)
        below = self.low[parent] if parent != top else self.low[x]
        if top == x:
            self.cycle[x] = min(self.low[x], below)
            return
        self.up[x] = top
        self.low[x] = min(self.low[x], below)
        if parent != top:
            self.hops[x] += self.hops[parent]


def links(df: DataFrame, node: str, parent: str, locality: Sequence[Column] = ()) -> DataFrame:
    """node, parent, loc, wider: one row for each node."""
    loc = [F.xxhash64(c) for c in locality] or [F.xxhash64(blank_to_null(F.col(node)))]
    x = df.select(blank_to_null(F.col(node)).alias("node"), blank_to_null(F.col(parent)).alias("parent"), F.array(*loc).alias("loc"))
    x = x.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), F.min("loc").alias("loc"))
    return x.select("node", "parent", F.col("loc")[0].alias("loc"), F.slice("loc", 2, len(loc)).alias("wider"))


def local_forest(pdf: pd.DataFrame, paths: bool = False, sizes: bool = False) -> pd.DataFrame:
    """node, parent, wider -> LOCAL. ext: the parent id outside of this set, null if the chain ends in a root or a cycle; size: nodes
    below and at a node in this set; path: ids from the local top down to the node."""
    nodes, parents = pdf["node"].tolist(), [p if isinstance(p, str) else None for p in pdf["parent"]]
    n = len(nodes)
    at = {x: i for i, x in enumerate(nodes)}
    order = sorted(range(n), key=nodes.__getitem__)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    to = [at.get(p, -1) if p is not None else -1 for p in parents]
    f = Forest([1] * n, list(rank))
    for i, p in enumerate(to):
        if p >= 0:
            f.link(i, p)
    top = [f.find(i) for i in range(n)]
    hops = [f.hops[i] if t != i else 0 for i, t in enumerate(top)]
    into = [f.cycle.get(t) for t in top]
    size: list[int | None] = [None] * n
    path: list[list[str] | None] = [None] * n
    if sizes or paths:
        good = [i for i in sorted(range(n), key=hops.__getitem__) if into[i] is None]
        total = [1] * n
        for i in reversed(good):
            if hops[i]:
                total[to[i]] += total[i]
        for i in good:
            size[i] = total[i]
            if paths:
                path[i] = [*path[to[i]], nodes[i]] if hops[i] else [nodes[i]]
    return pd.DataFrame(
        {
            "node": nodes, "parent": parents, "top": [nodes[t] for t in top], "hops": hops, "low": [nodes[order[min(f.low[i], rank[t])]] for i, t in enumerate(top)],
            "ext": [parents[t] if c is None else None for t, c in zip(top, into)], "cyc": [None if c is None else nodes[order[c]] for c in into], "wider": pdf["wider"], "size": pd.array(size, dtype="Int64"), "path": path,
        }
    )


def _one(f):
    """Gathers a task's batches: tasks are of bounded size, see ROWS_A_TASK and locality."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            yield f(pd.concat(got, ignore_index=True))

    return run


def merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """LINKS -> LINKS: those that lead to another of this set go on to where that one leads."""
    tops, low = pdf["top"].tolist(), pdf["low"].tolist()
    names = sorted(set(low))
    rank = {x: i for i, x in enumerate(names)}
    kind, to, end, hops = (pdf[c].tolist() for c in ("kind", "to", "end", "hops"))
    at = {x: i for i, x in enumerate(tops)}
    f = Forest([int(h) for h in hops], [rank[x] for x in low])
    for i, (k, t) in enumerate(zip(kind, to)):
        if k is None and t in at:
            f.link(i, at[t])
    out = []
    for i, x in enumerate(tops):
        t = f.find(i)
        if t in f.cycle:
            out.append((x, None, int(hops[i]), low[i], "cycle", names[f.cycle[t]]))
        elif t == i:
            out.append((x, to[i], int(hops[i]), low[i], kind[i], end[i]))
        else:
            out.append((x, to[t], f.hops[i] + int(hops[t]), names[min(f.low[i], rank[low[t]])], kind[t], end[t]))
    return pd.DataFrame(out, columns=["top", "to", "hops", "low", "kind", "end"]).assign(wider=pdf["wider"])


def _contract(local: DataFrame) -> DataFrame:
    """LINKS of the tops that go on outside of their task, each looked up by its parent; kind null: goes on, to another top."""
    x = local.select(
        F.col("node").alias("ext"), F.col("top").alias("to"), (F.col("hops") + 1).alias("hops"), F.col("low").alias("l2"), F.col("cyc"), F.col("ext").alias("more")
    )
    j = local.where("node = top and ext is not null").select("top", "ext", "wider").join(x, "ext", "left")
    kind = F.when(F.col("to").isNull(), "missing").when(F.col("cyc").isNotNull(), "cycle").when(F.col("more").isNull(), "root")
    return j.select(
        "top",
        F.coalesce("to", "ext").alias("to"),
        F.coalesce("hops", F.lit(1)).cast("long").alias("hops"),
        F.coalesce("l2", "top").alias("low"),
        kind.alias("kind"),
        F.when(kind == "missing", F.col("ext")).when(kind == "cycle", F.col("cyc")).when(kind == "root", F.col("to")).alias("end"),
        "wider",
    )


def _double(c: DataFrame) -> DataFrame:
    """One round of doubling over all open contracted links."""
    b = c.select(F.col("top").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("h2"), F.col("low").alias("l2"), F.col("kind").alias("k2"), F.col("end").alias("e2"))
    open_ = c.where("kind is null").join(b, "to", "left")
    step = open_.select(
        "top", F.col("to2").alias("to"), (F.col("hops") + F.when(F.col("k2") == "cycle", F.lit(0)).otherwise(F.col("h2"))).alias("hops"), F.least("low", "l2").alias("low"), F.col("k2").alias("kind"), F.col("e2").alias("end"), "wider"
    )
    return c.where("kind is not null").unionByName(step)


def forest(df: DataFrame, node: str, parent: str, locality: Sequence[Column] = (), paths: bool = False, sizes: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local, contracted, solved): local as LOCAL for every node; contracted and solved as LINKS for every top that goes on
    outside its task, before and after all of them are followed to their ends."""
    spark = df.sparkSession
    x = cut(links(df, node, parent, locality))
    n = tasks_for(x.count(), ROWS_A_TASK, spark)
    local = cut(x.repartition(n, "loc").select("node", "parent", "wider").mapInPandas(_one(lambda b: local_forest(b, paths, sizes)), LOCAL))
    first = c = cut(_contract(local))
    rows = c.count()
    for k in range(len(locality) - 1):
        c = c.repartition(tasks_for(rows, ROWS_A_TASK, spark), F.col("wider")[k]).mapInPandas(_one(merged), LINKS)
    c = cut(c) if len(locality) > 1 else c
    left, before, rounds = c.where("kind is null").count(), -1, 0
    # A round that settles none leaves only cycles, which take as many rounds as go round the longest there could be.
    while left and (left != before or 1 << rounds < 2 * left):
        c, before, rounds = cut(_double(c)), left, rounds + 1
        left = c.where("kind is null").count()
    if left:
        # What is open leads into cycles: where it has got to lies on one, and low has gone round it from there.
        round_ = c.select(F.col("top").alias("to"), F.col("low").alias("around"))
        into = c.where("kind is null").join(round_, "to").select("top", F.lit(None).cast("string").alias("to"), "hops", "low", F.lit("cycle").alias("kind"), F.col("around").alias("end"), "wider")
        c = c.where("kind is not null").unionByName(into)
    return local, first, c


def _resolved(local: DataFrame, solved: DataFrame) -> DataFrame:
    done = local.where("ext is null").select(
        "node",
        "parent",
        F.when(F.col("cyc").isNull(), F.col("top")).alias("root"),
        F.when(F.col("cyc").isNull(), F.col("hops")).alias("depth"),
        F.when(F.col("cyc").isNull(), "root").otherwise("cycle").alias("end_kind"),
        F.coalesce("cyc", "top").alias("end_id"),
    )
    s = solved.select("top", F.col("to").alias("root"), F.col("hops").alias("h2"), "kind", "end")
    far = local.where("ext is not null").join(s, "top")
    ok = F.col("kind") == "root"
    far = far.select("node", "parent", F.when(ok, F.col("root")).alias("root"), F.when(ok, F.col("hops") + F.col("h2")).alias("depth"), F.col("kind").alias("end_kind"), F.col("end").alias("end_id"))
    return done.unionByName(far)


def unreachable(df: DataFrame, node: str, parent: str, locality: Sequence[Column] = ()) -> DataFrame:
    """node, end_kind, end_id of every node whose chain of parents arrives at no root."""
    local, _, solved = forest(df, node, parent, locality)
    near = local.where("cyc is not null").select("node", F.lit("cycle").alias("end_kind"), F.col("cyc").alias("end_id"))
    bad = solved.where("kind <> 'root'").select("top", F.col("kind").alias("end_kind"), F.col("end").alias("end_id"))
    return near.unionByName(local.where("ext is not null").join(bad, "top").select("node", "end_kind", "end_id"))


def _subtrees(local: DataFrame, contracted: DataFrame, solved: DataFrame) -> DataFrame:
    """node, descendants, for every node whose chain arrives at a root."""
    roots = solved.where("kind = 'root'").select("top")
    tops = local.where("node = top and ext is not null").select("top", "ext", F.col("size").alias("below"))
    jump = F.when(F.col("kind").isNull(), F.col("to"))
    t = cut(tops.join(roots, "top").join(contracted.select("top", jump.alias("jump")), "top"))
    while not t.where("jump is not null").isEmpty():
        # What jumps to a node has summed up all that lies less than the jump below it.
        add = t.where("jump is not null").groupBy(F.col("jump").alias("top")).agg(F.sum("below").alias("add"))
        on = t.select(F.col("top").alias("jump"), F.col("jump").alias("next"))
        t = cut(t.join(add, "top", "left").join(on, "jump", "left").select("top", "ext", (F.col("below") + F.coalesce("add", F.lit(0))).alias("below"), F.col("next").alias("jump")))
    extra = cut(t.groupBy(F.col("ext").alias("node")).agg(F.sum("below").alias("extra")))
    own = local.where("size is not null").join(roots.withColumn("ok", F.lit(True)), "top", "left").where("ext is null or ok")
    touched = local.join(extra, "node", "left_semi").select("top").distinct().withColumn("touched", F.lit(True))
    own = own.select("node", "parent", "top", "hops", "size").join(touched, "top", "left")
    n = tasks_for(local.count(), ROWS_A_TASK, local.sparkSession)
    again = own.where("touched").join(extra, "node", "left").repartition(n, "top").mapInPandas(_one(_added), "node string, descendants long")
    return own.where("touched is null").select("node", (F.col("size") - 1).alias("descendants")).unionByName(again)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole local trees with what hangs on their nodes from outside."""
    nodes, hops = pdf["node"].tolist(), pdf["hops"].to_numpy()
    at = {x: i for i, x in enumerate(nodes)}
    total = pdf["extra"].fillna(0).to_numpy(dtype=np.int64).copy()
    up = [at[p] if h else -1 for p, h in zip(pdf["parent"], hops)]
    for i in np.argsort(-hops, kind="stable"):
        if up[i] >= 0:
            total[up[i]] += total[i]
    return pd.DataFrame({"node": nodes, "descendants": total + pdf["size"].to_numpy(dtype=np.int64) - 1})


def measures(df: DataFrame, node: str, parent: str, locality: Sequence[Column] = ()) -> DataFrame:
    """node, parent, root, depth (0 for a root), descendants (count), end_kind (root, missing, cycle), end_id: all but the paths,
    whose length adds up to the square of the depth. Nodes that reach no root have a null root, depth and descendants."""
    local, contracted, solved = forest(df, node, parent, locality, sizes=True)
    out = _resolved(local, solved).join(_subtrees(local, contracted, solved), "node", "left")
    return out.select("node", "parent", "root", "depth", "descendants", "end_kind", "end_id")


def hierarchy(df: DataFrame, node: str, parent: str, locality: Sequence[Column] = ()) -> DataFrame:
    """node, parent, root, depth, path (array from the root), descendants (count), end_kind, end_id.

    Nodes that reach no root have a null root, depth, path and descendants. Use descendants() for the pairs."""
    local, contracted, solved = forest(df, node, parent, locality, paths=True, sizes=True)
    res = _resolved(local, solved).join(_subtrees(local, contracted, solved), "node", "left")
    paths = local.where("ext is null and cyc is null").select("node", "path")
    heads = local.where("node = top and ext is not null").select("top", "ext").join(solved.where("kind = 'root'").select("top"), "top")
    # Outer prefixes, nearest first: rounds double with the boundaries on the deepest chain.
    at = local.select(F.col("node").alias("ext"), F.col("top").alias("nxt"), F.col("path").alias("prefix"), F.col("ext").alias("more"))
    pre = cut(heads.join(at, "ext").select("top", "prefix", F.when(F.col("more").isNotNull(), F.col("nxt")).alias("nxt")))
    while not pre.where("nxt is not null").isEmpty():
        up = pre.select(F.col("top").alias("nxt"), F.col("prefix").alias("p2"), F.col("nxt").alias("n2"))
        j = pre.where("nxt is not null").join(up, "nxt").select("top", F.concat("p2", "prefix").alias("prefix"), F.col("n2").alias("nxt"))
        pre = cut(pre.where("nxt is null").unionByName(j))
    far = local.where("ext is not null").select("node", "top", F.col("path").alias("own_path"))
    far = far.join(pre.select("top", "prefix"), "top").select("node", F.concat("prefix", "own_path").alias("path"))
    out = res.join(paths.unionByName(far), "node", "left")
    return out.select("node", "parent", "root", "depth", "path", "descendants", "end_kind", "end_id")


def descendants(h: DataFrame) -> DataFrame:
    """ancestor, node, distance, for every pair of a hierarchy(); one row for each node and ancestor, itself included."""
    x = h.where("path is not null").select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return x.select("ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))
