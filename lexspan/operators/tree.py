"""Code trees as adjacency rows (id, parent, ...): paths, order, depth, subtrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Workspace, join_unique, ranked


class _Doubling:
    """Pointer doubling up a forest: in each round a node that points at an ancestor takes over what that ancestor has gathered and
    points where it points, so a walk to the roots takes as many rounds as the depth has binary digits.

    gathered: name -> (first value, how the ancestor's value `a` and the node's own `s` become one). Every round's nodes are
    staged once; those that have arrived are not written again. Nodes below a missing parent arrive with rooted = false; a
    cycle, whose nodes never arrive, raises ValueError.
    """

    def __init__(self, ws: Workspace, nodes: DataFrame, gathered: dict[str, tuple], depth: int | None = None):
        self.ws, self.gathered, self.rounds = ws, gathered, 0
        carried = [c for c in nodes.columns if c not in ("id", "parent")]
        first = nodes.select("id", "parent", *carried, F.col("parent").alias("anc"), *[v.alias(k) for k, (v, _) in gathered.items()], F.lit(1).alias("depth"), F.lit(True).alias("rooted"))
        open_ = ws.stage(first, "walk-0")
        total, left = open_.agg(F.count(F.lit(1)), F.count("anc")).first()
        arrived = [open_.where("anc is null")]
        while left:
            # after r rounds a node has looked past 2^r of its ancestors
            if 2**self.rounds > 2 * total:
                raise ValueError(f"{left} nodes hang on a cycle")
            self.rounds += 1
            known = reduce(DataFrame.unionByName, arrived, open_.where("anc is not null"))
            up = known.select(F.col("id").alias("anc"), F.col("anc").alias("__anc"), *[F.col(k).alias(f"__{k}") for k in gathered], F.col("depth").alias("__depth"), F.col("rooted").alias("__rooted"))
            met = open_.where("anc is not null").join(up, "anc", "left")
            found = F.col("__depth").isNotNull()
            made = met.select(
                "id", "parent", *carried, F.col("__anc").alias("anc"), *[F.when(found, join(F.col(f"__{k}"), F.col(k))).otherwise(F.col(k)).alias(k) for k, (_, join) in gathered.items()],
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.coalesce("__rooted", F.lit(False)).alias("rooted"))
            # nodes that are known to lie too deep need no more rounds
            open_ = ws.stage(made if depth is None else made.where(F.col("depth") + F.col("anc").isNotNull().cast("int") <= depth), f"walk-{self.rounds}")
            arrived.append(open_.where("anc is null"))
            now = open_.agg(F.count(F.lit(1)), F.count("anc")).first()
            if now[0] > left:
                raise ValueError("the same id has several rows or parents")
            left = now[1]
        self.nodes = reduce(DataFrame.unionByName, arrived)


def _place(ord_: Column, id_: Column) -> Column:
    """What siblings are ordered by: their number, null first, then their id."""
    return F.struct(ord_.isNotNull().alias("given"), ord_.cast("long").alias("ord"), id_.cast("string").alias("id"))


def paths(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes below the roots (null parent), with path (slugs joined by /), parent_path, sort_path (an array that orders a walk) and
    depth (1 for roots); down to `depth`, if that is given.

    nodes: id (unique), parent, slug, ord (any whole number; siblings come by it, null first, then by id). Paths are put
    together by pointer doubling: as many rounds as the depth has binary digits. Nodes whose parent is missing, and all
    below them, are left out; a cycle raises ValueError (unless `depth` ends the walk before).
    """
    ws = Workspace(nodes.sparkSession, "tree")
    walk = _Doubling(ws, nodes.select("id", "parent", "slug", "ord"), {
        "path": (F.col("slug"), lambda a, s: F.concat(a, F.lit("/"), s)), "sort_path": (F.array(_place(F.col("ord"), F.col("id"))), lambda a, s: F.concat(a, s)),
    }, depth)
    up = F.when(F.col("depth") > 1, F.left("path", F.length("path") - F.length("slug") - 1))
    return walk.nodes.where("rooted" if depth is None else f"rooted and depth <= {int(depth)}").select("id", "parent", "slug", "path", up.alias("parent_path"), "sort_path", "depth")


def intervals(nodes: DataFrame) -> DataFrame:
    """id, parent, root, depth, enter and leave of every node below a root: enter is its place in a walk of its root's tree, from 0,
    and leave the place of the last node below it, so what lies below a node is a range of enter, which reaches a scan.

    nodes: as for paths(); ids and ordinals only, so a chain of n nodes costs n rows a round, not n paths. Sizes of subtrees
    come first: after round r a node knows its descendants less than 2^r below it, and adds those of the nodes 2^r below.
    Prefix sums of sizes over siblings give each node's distance from its parent in the walk, and pointer doubling
    adds these up to the root. No family of siblings is gathered in one task.
    """
    ws = Workspace(nodes.sparkSession, "intervals")
    given = ws.stage(nodes.select("id", "parent", "ord"), "nodes")
    total, rounds = given.count(), 0
    sizes = given.select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size"))
    while True:
        below = sizes.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        up = sizes.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        pointed = sizes.join(below, "id", "left").join(up, "anc", "left")
        sizes = ws.stage(pointed.select("id", F.col("next").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), f"sizes-{rounds}")
        rounds += 1
        now = sizes.agg(F.count(F.lit(1)), F.count("anc")).first()
        if now[0] > total:
            raise ValueError("the same id has several rows or parents")
        if not now[1]:
            break
        if 2**rounds > 2 * total:
            raise ValueError("nodes hang on a cycle")
    # sizes of the siblings before: prefix sums over all nodes, less what the family's first has
    sized = given.join(sizes.select("id", "size"), "id")
    placed = ws.stage(ranked(ws, sized, [F.col("parent"), _place(F.col("ord"), F.col("id"))], "before", F.col("size")), "placed")
    firsts = ws.stage(placed.where("parent is not null").groupBy("parent").agg(F.min("before").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    steps = join_unique(placed.where("parent is not null"), firsts, ["parent"], "n", "inner").select("id", "parent", "size", (F.col("before") - F.col("first") + 1).alias("step"))
    steps = steps.unionByName(placed.where("parent is null").select("id", "parent", "size", F.lit(0).cast("long").alias("step")))
    walk = _Doubling(ws, steps, {"enter": (F.col("step"), lambda a, s: a + s), "root": (F.col("id"), lambda a, s: a)})
    return walk.nodes.where("rooted").select("id", "parent", "root", "depth", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def below(tree: DataFrame, id_: object) -> DataFrame:
    """The node with an id and all below it, from a table of intervals(): one lookup, then a range of its root's numbers."""
    at = tree.where(F.col("id") == F.lit(id_)).select("root", "enter", "leave").first()
    if at is None:
        return tree.limit(0)
    return tree.where((F.col("root") == F.lit(at["root"])) & F.col("enter").between(at["enter"], at["leave"]))


def preorder(tree: DataFrame, group: Column) -> DataFrame:
    """sort_order of each node in a walk of its group's tree, from 0: a range sort by (group, sort_path) with prefix sums over
    partitions, less the group's first rank; no group is gathered in one task."""
    ws = Workspace(tree.sparkSession, "preorder")
    placed = ws.stage(ranked(ws, tree.withColumn("__group", group), [F.col("__group"), F.col("sort_path")], "__rank"), "placed")
    firsts = ws.stage(placed.groupBy("__group").agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n")), "firsts")
    return join_unique(placed, firsts, ["__group"], "__n", "inner").withColumn("sort_order", F.col("__rank") - F.col("__first")).drop("__group", "__rank", "__first", "__n")


def subtree(tree: DataFrame, path: str) -> DataFrame:
    """The node at a path and all below it; both tests are pushed to the scan."""
    return tree.where((F.col("path") == path) | F.startswith("path", F.lit(f"{path}/")))


def limit_depth(tree: DataFrame, depth: int | None) -> DataFrame:
    """Nodes down to a depth; no depth, or 0, means all."""
    return tree.where(F.col("depth") <= depth) if depth else tree


def reroot(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing become roots."""
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("__known"))
    return nodes.join(known, "parent", "left").withColumn("parent", F.when(F.col("__known"), F.col("parent"))).drop("__known")


def collapse(nodes: DataFrame) -> DataFrame:
    """Drop an only child whose slug is its parent's; its children move up and its has_content passes to the parent. One level."""
    n = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__child"))
    child = nodes.select(F.col("id").alias("__child"), F.col("slug").alias("__slug"), F.col("has_content").alias("__content"))
    same = nodes.join(n.where("__n = 1 and id is not null"), "id").join(child, "__child").where("slug = __slug").select("id", "__child", "__content")
    gone = same.select(F.col("__child").alias("parent"), F.col("id").alias("__up"))
    kept = nodes.join(same.select(F.col("__child").alias("id")), "id", "left_anti").join(same.select("id", "__content"), "id", "left")
    kept = kept.withColumn("has_content", F.col("has_content") | F.coalesce("__content", F.lit(False))).drop("__content")
    return kept.join(gone, "parent", "left").withColumn("parent", F.coalesce("__up", "parent")).drop("__up")


def outline(tree: DataFrame, group: str, label: str, depth: int) -> DataFrame:
    """One text for each group: an indented line for each node in walk order, down to a depth."""
    lines = limit_depth(tree, depth).withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.col(label)))
    ordered = F.sort_array(F.collect_list(F.struct("sort_path", "line")))
    return lines.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("outline"))


def expand(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One level more below contents that have no content of their own: `links` (parent, id, title, ord) under their nodes, without
    a node's link to itself, each once. If any node has content, nothing is expanded."""
    if nodes.where("has_content").first() is not None:
        return nodes
    below = links.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").where("id != parent").groupBy("parent", "id").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
    return nodes.unionByName(below.withColumn("has_content", F.lit(False)).select(*nodes.columns))
