"""Trees over region, nation, customer and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..staging import Workspace
from .base import query, table


def nodes(spark, sf_dir, content: bool = True):
    """The four tables as adjacency rows: id, parent, slug, ord, kind."""
    def rows(name, kind, key, parent, up):
        slug = F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
        over = F.concat(F.lit(f"{up}-"), F.col(parent).cast("string")) if up else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(slug.alias("id"), over.alias("parent"), slug.alias("slug"), F.col(key).cast("long").alias("ord"), F.lit(kind).alias("kind"))

    out = rows("region", "region", "r_regionkey", None, None).unionByName(rows("nation", "nation", "n_nationkey", "n_regionkey", "region")).unionByName(rows("customer", "customer", "c_custkey", "c_nationkey", "nation"))
    return out.unionByName(rows("orders", "order", "o_orderkey", "o_custkey", "customer")) if content else out


ALL = """
n as (select 'region-' || r_regionkey id, null::varchar parent, r_regionkey::bigint ord from region union all select 'nation-' || n_nationkey, 'region-' || n_regionkey, n_nationkey from nation
      union all select 'customer-' || c_custkey, 'nation-' || c_nationkey, c_custkey from customer union all select 'order-' || o_orderkey, 'customer-' || o_custkey, o_orderkey from orders),
t as (select id, parent, id path, null::varchar parent_path, lpad(ord::varchar, 10, '0') s, 1 depth from n where parent is null union all
      select n.id, n.parent, t.path || '/' || n.id, t.path, t.s || '.' || lpad(n.ord::varchar, 10, '0'), t.depth + 1 from n join t on n.parent = t.id)
"""


@query(f"with recursive {ALL} select id, path, parent_path, depth::bigint depth from t")
def tree_paths(spark, sf_dir):
    return tree.paths(nodes(spark, sf_dir)).select("id", "path", "parent_path", F.col("depth").cast("long").alias("depth"))


@query(f"with recursive {ALL} select id, split_part(path, '/', 1) root, row_number() over (partition by split_part(path, '/', 1) order by s) - 1 sort_order from t")
def tree_preorder(spark, sf_dir):
    return tree.intervals(nodes(spark, sf_dir)).select("id", "root", F.col("enter").alias("sort_order"))


@query(f"with recursive {ALL}, w as (select id, path, split_part(path, '/', 1) root, depth, row_number() over (partition by split_part(path, '/', 1) order by s) - 1 enter from t), "
       "up as (select id, unnest(list_transform(range(1, depth + 1), lambda k: array_to_string(list_slice(string_split(path, '/'), 1, k), '/'))) path from w), n_below as (select path, count(*) n from up group by path) "
       "select w.id, w.root, w.depth::bigint depth, w.enter, w.enter + n - 1 leave from w join n_below using (path)")  # fmt: skip
def tree_intervals(spark, sf_dir):
    """Where a walk of its root's tree enters and leaves each node."""
    return tree.intervals(nodes(spark, sf_dir)).select("id", "root", F.col("depth").cast("long").alias("depth"), "enter", "leave")


@query(f"with recursive {ALL} select id, depth::bigint depth from t where id = 'nation-8' or contains(path, '/nation-8/')")
def subtree_range(spark, sf_dir):
    """A subtree as a range of a written table of intervals."""
    ws = Workspace(spark, "subtrees")
    numbered = ws.stage(tree.intervals(nodes(spark, sf_dir)).repartitionByRange("root", "enter").sortWithinPartitions("root", "enter"), "intervals")
    return tree.below(numbered, "nation-8").select("id", F.col("depth").cast("long").alias("depth"))


@query(f"with recursive {ALL} select id, depth::bigint depth from t where depth <= 3")
def recursive_depth_guard(spark, sf_dir):
    return tree.paths(nodes(spark, sf_dir), 3).select("id", F.col("depth").cast("long").alias("depth"))


@query(f"with recursive {ALL} select path from t where depth <= 2")
def depth_limit(spark, sf_dir):
    return tree.limit_depth(tree.paths(nodes(spark, sf_dir), 3), 2).select("path")


@query(f"with recursive {ALL} select path from t where path = 'region-1/nation-1' or starts_with(path, 'region-1/nation-1/')")
def subtree(spark, sf_dir):
    return tree.subtree(tree.paths(nodes(spark, sf_dir)), "region-1/nation-1").select("path")


@query("select 'nation-' || n_nationkey id, n_name heading from nation where n_regionkey = 1 union all select 'region-' || r_regionkey, r_name from region where r_regionkey = 1")
def node_children(spark, sf_dir):
    own = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("heading"))
    below = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("heading"))
    return own.unionByName(below)


@query(f"with recursive {ALL} select path, row_number() over (partition by split_part(path, '/', 1) order by s) place from t where id like 'order-%'")
def content_leaves(spark, sf_dir):
    rows = tree.paths(nodes(spark, sf_dir)).where(F.startswith("id", F.lit("order-"))).withColumn("root", F.substring_index("path", "/", 1))
    return tree.preorder(rows, F.col("root")).select("path", (F.col("sort_order") + 1).cast("long").alias("place"))


@query("select 'customer-' || c_custkey id, case when c_nationkey not in (select n_nationkey from nation where n_regionkey = 2) then 'nation-' || c_nationkey end parent from customer")
def tree_orphans(spark, sf_dir):
    rows = nodes(spark, sf_dir, content=False).where("kind != 'region' and not (kind = 'nation' and parent = 'region-2')")
    return tree.reroot(rows).where("kind = 'customer'").select("id", "parent")


CODES = """
n as (select 'a-' || c_custkey id, null::varchar parent, 'chapter-' || c_custkey slug, false has_content from customer
      union all select 'b-' || c_custkey, 'a-' || c_custkey, case when c_custkey % 3 = 2 then 'article-' else 'chapter-' end || c_custkey, c_custkey % 2 = 0 from customer
      union all select 'c-' || c_custkey, 'a-' || c_custkey, 'section-x', true from customer where c_custkey % 5 = 0
      union all select 'o-' || o_orderkey, 'b-' || o_custkey, 'section-' || o_orderkey, true from orders)
"""


@query(f"with {CODES}, lone as (select parent id, min(id) child from n where parent is not null group by parent having count(*) = 1), gone as (select lone.id, lone.child, c.has_content from lone join n p on p.id = lone.id join n c on c.id = lone.child where p.slug = c.slug) "
       "select n.id, coalesce(u.id, n.parent) parent, n.slug, n.has_content or coalesce(g.has_content, false) has_content from n left join gone g on g.id = n.id left join gone u on u.child = n.parent where n.id not in (select child from gone)")  # fmt: skip
def tree_collapse(spark, sf_dir):
    """Chapters of customers, a division below each (with its slug, mostly), at times a section beside it, and orders as sections."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    row = lambda id, parent, slug, content: [id.alias("id"), parent.cast("string").alias("parent"), slug.alias("slug"), content.alias("has_content")]
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = customers.select(*row(name("a-", "c_custkey"), F.lit(None), name("chapter-", "c_custkey"), F.lit(False)))
    rows = rows.unionByName(customers.select(*row(name("b-", "c_custkey"), name("a-", "c_custkey"), F.when(key % 3 == 2, name("article-", "c_custkey")).otherwise(name("chapter-", "c_custkey")), key % 2 == 0)))
    rows = rows.unionByName(customers.where("c_custkey % 5 = 0").select(*row(name("c-", "c_custkey"), name("a-", "c_custkey"), F.lit("section-x"), F.lit(True))))
    rows = rows.unionByName(table(spark, sf_dir, "orders").select(*row(name("o-", "o_orderkey"), name("b-", "o_custkey"), name("section-", "o_orderkey"), F.lit(True))))
    return tree.collapse(rows).select("id", "parent", "slug", "has_content")


@query("select c_custkey, coalesce(nullif(case when c_mktsegment = 'BUILDING' then '' else c_mktsegment end, ''), n_name, c_custkey::varchar) title from customer left join nation on n_nationkey = c_nationkey and n_regionkey = 1")
def toc_title(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = F.nullif(F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")), F.lit(""))
    return table(spark, sf_dir, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce(own, "n_name", F.col("c_custkey").cast("string")).alias("title"))


@query(f"with recursive {ALL} select split_part(path, '/', 1) root, string_agg(repeat('  ', depth - 1) || id, chr(10) order by s) outline from t where depth <= 2 group by 1")
def outline_text(spark, sf_dir):
    rows = tree.paths(nodes(spark, sf_dir, content=False), 2).withColumn("root", F.substring_index("path", "/", 1))
    return tree.outline(rows, "root", "id", 2)


@query(f"with recursive {ALL} select path, coalesce(parent_path, '') up, id leaf from t where depth <= 3")
def path_parts(spark, sf_dir):
    paths = tree.paths(nodes(spark, sf_dir, content=False), 3).select("path")
    up = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    return paths.select("path", up.alias("up"), F.substring_index("path", "/", -1).alias("leaf"))
