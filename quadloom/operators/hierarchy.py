"""Parent-child links to full hierarchies by heavy-path decomposition.

1. Nodes get dense ids in byte order of their names; a node with several parents keeps the smallest.
2. Cycle separation: pointers double (2^k steps after k rounds) until no further node reaches a root; what is
   still open leads into a circle. The same rounds add up subtree sizes.
3. The child with the largest subtree carries its parent's chain on; heads are found by doubling along heavy links.
4. Any way to a root crosses at most log2(n) chains, so the chains' own tree is flat: a few doublings concatenate,
   for every chain, the segments (chain, last position) of the path above it and the offset of its depth-first
   interval. A node's path is its chain's segments and its own prefix of the chain; its descendants are the
   interval [lft + 1, lft + size - 1] of its root.

Every round is an equi-join on long ids or a pre-aggregated sum, cut by a written table. Depth costs a logarithm
of rounds, nothing is broadcast but one row a partition, and no group is collected but the nodes of one chain,
which also stand in one row of the path of its last node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .chunks import number_rows

NS = "https://voc.kelmar.example/ns#"
UP = (NS + "within", NS + "partOf")
DOWN = (NS + "contains",)
#: Numbers of a descendant interval that are turned into rows at once.
PIECE = 1 << 14


def links_of(quads: DataFrame, up: tuple[str, ...] = UP, down: tuple[str, ...] = DOWN) -> DataFrame:
    """Distinct (child, parent) names of the statements that link two units.

    ``up`` predicates have the child as subject, ``down`` predicates the parent. Objects that are literals or
    null, and null subjects, make no link; graph, repetition, load time and other columns don't matter.
    """
    p, s, o = F.col("p"), F.col("s.v"), F.col("o.v")
    rows = quads.where(p.isin(*up, *down) & F.col("o.k").isin(0, 1))
    return rows.select(F.when(p.isin(*up), s).otherwise(o).alias("child"), F.when(p.isin(*up), o).otherwise(s).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()


@dataclass
class Hierarchy:
    """``nodes``: id, node, parent, root, depth (-1: leads into a circle, whose smallest name is root), n_parents, and
    for tree nodes chain, pos, size (of the subtree, with the node) and lft (number from 0 in the root's tree).
    ``chains``: chain, segs: array of (chain, upto) above it, from the root down."""

    nodes: DataFrame
    chains: DataFrame

    def found(self) -> DataFrame:
        """node, root, depth: in a tree the root is the head of the first chain above, depth the links of all segments above and on the node's own chain."""
        above = F.aggregate("segs", F.lit(0).cast("long"), lambda n, x: n + x["upto"] + 1)
        chains = self.chains.select("chain", above.alias("above"), F.coalesce(F.get("segs", F.lit(0))["chain"], "chain").alias("id"))
        heads = chains.join(self.nodes.select("id", F.col("node").alias("root")), "id").select("chain", "above", "root")
        tree = self.nodes.where("depth >= 0").select("node", "chain", "pos").join(heads, "chain")
        circles = self.nodes.where("depth < 0").select("node", "root", F.col("depth").cast("long").alias("depth"))
        return tree.select("node", "root", (F.col("above") + F.col("pos")).cast("long").alias("depth")).unionByName(circles)

    def paths(self, separator: str = " > ") -> DataFrame:
        """node, parent, root, depth, n_descendants, lft and the full path of names from the root; for nodes that lead into a circle path, n_descendants and lft are null."""
        tree = self.nodes.where("depth >= 0")
        # the nodes of one chain: never more than the path of the chain's last node has
        members = tree.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("names"))
        above = (
            self.chains.select(F.col("chain").alias("of"), F.posexplode("segs").alias("i", "seg"))
            .select("of", "i", F.col("seg.chain").alias("chain"), F.col("seg.upto").alias("upto"))
            .join(members, "chain")
            .groupBy("of")
            .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", F.slice("names", F.lit(1), (F.col("upto") + 1).cast("int")).alias("part")))), lambda x: x["part"])).alias("prefix"))
        )
        chains = members.join(above.withColumnRenamed("of", "chain"), "chain", "left")
        with_path = tree.join(chains, "chain").select(
            "node", "parent", "root", F.col("depth").cast("long").alias("depth"), (F.col("size") - 1).alias("n_descendants"), "lft",
            F.array_join(F.concat(F.coalesce("prefix", F.array().cast("array<string>")), F.slice("names", F.lit(1), (F.col("pos") + 1).cast("int"))), separator).alias("path"),
        )
        circles = self.nodes.where("depth < 0").select("node", "parent", "root", F.col("depth").cast("long").alias("depth"), F.lit(None).cast("long").alias("n_descendants"), F.lit(None).cast("long").alias("lft"), F.lit(None).cast("string").alias("path"))
        return with_path.unionByName(circles)

    def intervals(self) -> DataFrame:
        """node, root, lft, first, last: the descendants of a node are those of its root whose lft lies between first and last (none if last < first); one row a node, however many descendants it has."""
        return self.nodes.where("depth >= 0").select("node", "root", "lft", (F.col("lft") + 1).alias("first"), (F.col("lft") + F.col("size") - 1).alias("last"))

    def descendants(self) -> DataFrame:
        """(node, descendant, distance): every node of a tree with every node below it, which are those numbered from lft + 1 to lft + size - 1."""
        tree = self.nodes.where("depth >= 0").select("node", "root", "depth", "lft", (F.col("lft") + F.col("size") - 1).alias("last"))
        # a long interval becomes rows in pieces: no array has more than PIECE numbers of it
        pieces = tree.where("last > lft").select("node", "root", "depth", "last", F.explode(F.expr(f"sequence(lft + 1, last, {PIECE}L)")).alias("first"))
        each = pieces.select("node", "root", "depth", F.explode(F.expr(f"sequence(first, least(first + {PIECE - 1}, last))")).alias("lft"))
        below = tree.select("root", "lft", F.col("node").alias("descendant"), F.col("depth").alias("ddepth"))
        return each.join(below, ["root", "lft"]).select("node", "descendant", (F.col("ddepth") - F.col("depth")).cast("long").alias("distance"))


@dataclass
class Circled:
    """The nodes that lead into a circle. ``rows``: node, parent, root (the circle's smallest name). ``tree``: their
    links without the one from root up, so that every circle is a tree below its root. ``circles``: root, end (the
    root's parent), end_lft, length (nodes on the circle), others (nodes that lead into it, without one)."""

    rows: DataFrame
    tree: Hierarchy
    circles: DataFrame

    def paths(self, separator: str = " > ") -> DataFrame:
        """node, parent, root, on_circle, steps (links up to root), n_descendants and the path of names from root; every node of a circle has all other nodes that lead into it below it."""
        placed = self.tree.paths(separator).select("node", "lft", F.col("depth").alias("steps"), F.col("n_descendants").alias("below"), "path")
        # a circle of one node without others has no link in the tree
        all_ = self.rows.join(self.circles, "root").join(placed, "node", "left").withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("lft", "steps", "below")})
        on = F.col("end_lft").between(F.col("lft"), F.col("lft") + F.col("below"))
        return all_.select("node", "parent", "root", on.alias("on_circle"), "steps", F.when(on, F.col("others")).otherwise(F.col("below")).alias("n_descendants"), F.coalesce("path", "node").alias("path"))

    def descendants(self) -> DataFrame:
        """(node, descendant, distance): every node with every other node from which following parents reaches it; distance is the number of links."""
        n = self.tree.nodes
        end = F.col("lft") + F.col("size")
        on = n.join(self.circles, "root").where((F.col("lft") <= F.col("end_lft")) & (F.col("end_lft") < end))
        on = on.select("root", "node", F.col("lft").alias("first"), end.alias("end"), (F.col("length") - F.col("depth")).alias("rest"))
        # what isn't below a circle's node in the tree reaches it through the root's own link
        around = n.select("root", F.col("node").alias("descendant"), "lft", "depth").join(on, "root").where("lft < first OR lft >= end")
        return self.tree.descendants().unionByName(around.select("node", "descendant", (F.col("depth") + F.col("rest")).cast("long").alias("distance")))


def circled(h: Hierarchy, ws: Workspace) -> Circled:
    """The nodes of depth -1 of a hierarchy: those on circles and all that hang below one. An empty table if there is none."""
    rows = h.nodes.where("depth < 0").select("node", "parent", "root")
    tree = build(rows.where("node <> root").select(F.col("node").alias("child"), "parent"), ws)
    end = tree.nodes.select(F.col("node").alias("end"), F.col("lft").alias("end_lft"), (F.col("depth") + 1).alias("length"))
    others = tree.nodes.where("node = root").select("root", (F.col("size") - 1).alias("others"))
    circles = rows.where("node = root").select("root", F.col("parent").alias("end")).join(end, "end", "left").join(others, "root", "left")
    return Circled(rows, tree, ws.table(circles.select("root", "end", F.coalesce("end_lft", F.lit(0)).alias("end_lft"), F.coalesce("length", F.lit(1)).alias("length"), F.coalesce("others", F.lit(0)).alias("others")), "circles"))


def build(links: DataFrame, ws: Workspace) -> Hierarchy:
    """Hierarchies of a table of (child, parent) names; further columns are ignored.

    Rows with a null on either side are no links, repeated rows count once, a node linked to itself is a circle of
    one. A node with several different parents keeps the one that is smallest in byte order; n_parents tells.
    An empty table gives empty results.
    """
    links = links.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL")
    parents = ws.table(links.groupBy("child").agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("n_parents")), "parents")
    names = parents.select(F.col("child").alias("node")).union(parents.select("parent")).distinct()
    ids = ws.table(number_rows(names, [], ["node"], ws, out="id"), "ids")
    base = ids.join(parents.withColumnRenamed("child", "node"), "node", "left").join(ids.select(F.col("node").alias("parent"), F.col("id").alias("par")), "parent", "left")
    base = ws.table(base.select("id", "node", "parent", "par", F.coalesce("n_parents", F.lit(0)).alias("n_parents")), "base")

    # cycle separation and subtree sizes: dist is 2^k for rows whose pointer may go on
    t, n_open = ws.counted(base.select("id", "par", F.coalesce("par", "id").alias("ptr"), F.when(F.col("par").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("size"), F.col("par").isNotNull().alias("open")), "open", "t0")
    k, was = 0, None
    while True:
        if n_open == 0 or n_open == was:
            break
        was, reach = n_open, 1 << k
        far = t.where(F.col("dist") == reach)
        add = far.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("add"))
        to = t.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("open").alias("open2"))
        moved = t.where("open").join(to, "ptr").select("id", "par", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), "size", F.col("open2").alias("open"))
        rest = t.where("NOT open").select("id", "par", "ptr", "dist", "size", "open")
        new, n_open = ws.counted(moved.unionByName(rest).join(add, "id", "left").select("id", "par", "ptr", "dist", (F.col("size") + F.coalesce("add", F.lit(0))).alias("size"), "open"), "open", f"t{k + 1}")
        ws.drop(t)
        t, k = new, k + 1
    # a row that closed is at its root; size still lacks what lies at the last distances of exactly 2^k
    far = t.where((F.col("dist") == (1 << k)) & ~F.col("open"))
    add = far.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("add"))
    tree = ws.table(t.where("NOT open").join(add, "id", "left").select("id", "par", F.col("ptr").alias("root"), F.col("dist").alias("depth"), (F.col("size") + F.coalesce("add", F.lit(0))).alias("size")), "tree")
    circles = _circles(t.where("open").select("id", "par"), ws)

    # heavy child, chain heads by doubling along heavy links
    heavy = tree.where("par IS NOT NULL").groupBy("par").agg(F.max(F.struct("size", (-F.col("id")).alias("nid"))).alias("h")).select((-F.col("h.nid")).alias("id"), F.lit(True).alias("heavy"))
    c = tree.join(heavy, "id", "left").select("id", "par", F.when(F.col("heavy"), F.col("par")).otherwise(F.col("id")).alias("chain"), F.coalesce("heavy", F.lit(False)).alias("open"), F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("pos"))
    c, n_open = ws.counted(c, "open", "c0")
    while n_open:
        to = c.select(F.col("id").alias("chain"), F.col("chain").alias("chain2"), F.col("pos").alias("pos2"), F.col("open").alias("open2"))
        moved = c.where("open").join(to, "chain").select("id", "par", F.col("chain2").alias("chain"), F.col("open2").alias("open"), (F.col("pos") + F.col("pos2")).alias("pos"))
        new, n_open = ws.counted(moved.unionByName(c.where("NOT open").select("id", "par", "chain", "open", "pos")), "open", "c")
        ws.drop(c)
        c = new

    # depth-first offsets: the heavy child comes first, light ones by size; exact running sums of sizes among siblings
    before = number_rows(tree.where("par IS NOT NULL").select("id", "par", "size"), ["par"], [F.col("size").desc(), F.col("id")], ws, out="before", value="size")
    heads = c.where("pos = 0").join(before.select("id", "before"), "id", "left")
    attach = c.select(F.col("id").alias("par"), F.col("chain").alias("up"), F.col("pos").alias("at"))
    h = heads.select(F.col("id"), "par", "before").join(attach, "par", "left")
    segs0 = F.when(F.col("up").isNotNull(), F.array(F.struct(F.col("up").alias("chain"), F.col("at").alias("upto")))).otherwise(F.array().cast("array<struct<chain:bigint,upto:bigint>>"))
    d, n_open = ws.counted(h.select(F.col("id").alias("chain"), F.col("up"), segs0.alias("segs"), F.when(F.col("up").isNotNull(), F.col("at") + 1 + F.col("before")).otherwise(F.lit(0)).cast("long").alias("off")), "up IS NOT NULL", "d0")
    while n_open:
        to = d.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("segs").alias("segs2"), F.col("off").alias("off2"))
        moved = d.where("up IS NOT NULL").join(to, "up").select("chain", F.col("up2").alias("up"), F.concat("segs2", "segs").alias("segs"), (F.col("off") + F.col("off2")).alias("off"))
        new, n_open = ws.counted(moved.unionByName(d.where("up IS NULL").select("chain", "up", "segs", "off")), "up IS NOT NULL", "d")
        ws.drop(d)
        d = new
    placed = tree.join(c.select("id", "chain", "pos"), "id").join(d.select("chain", "off"), "chain").select("id", "root", "depth", "size", "chain", "pos", (F.col("off") + F.col("pos")).alias("lft"))
    nothing = [F.lit(None).cast("long").alias(x) for x in ("size", "chain", "pos", "lft")]
    both = placed.unionByName(circles.select("id", "root", F.lit(-1).cast("long").alias("depth"), *nothing))
    nodes = ws.table(base.select("id", "node", "parent", "n_parents").join(both, "id").join(ids.select(F.col("id").alias("root"), F.col("node").alias("root_name")), "root").select("id", "node", "parent", F.col("root_name").alias("root"), "depth", "n_parents", "size", "chain", "pos", "lft"), "nodes")
    chains = ws.table(d.select("chain", "segs"), "chains")
    ws.drop(parents, ids, base, t, tree, c, d)
    return Hierarchy(nodes, chains)


def _circles(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(id, root) of nodes from which following parents never ends: root is the smallest id of the circle reached."""
    f = ws.table(rows.select("id", F.col("par").alias("ptr")), "f0")
    count = -1
    while True:
        image = f.select("ptr").distinct().count()
        if image == count or image == 0:
            break
        count = image
        to = f.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        new = ws.table(f.join(to, "ptr").select("id", F.col("ptr2").alias("ptr")), "f")
        ws.drop(f)
        f = new
    on = f.select(F.col("ptr").alias("id")).distinct()
    m, n_open = ws.counted(rows.join(on, "id", "left_semi").select("id", F.col("par").alias("ptr"), F.col("id").alias("least"), F.lit(True).alias("moved")), "moved", "m0")
    while n_open:
        to = m.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("least").alias("least2"))
        new, n_open = ws.counted(m.join(to, "ptr").select("id", F.col("ptr2").alias("ptr"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved")), "moved", "m")
        ws.drop(m)
        m = new
    return f.join(m.select(F.col("id").alias("ptr"), F.col("least").alias("root")), "ptr").select("id", "root")
