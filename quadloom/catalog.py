"""Queries over the statement tables, one group for each operator of the core, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import statement_sql
from .operators import chunks, hierarchy, rejects, setsketch, wide
from .workspace import Workspace

SHARE = 0.02


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tree(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.build(hierarchy.links_of(_read(spark, d, "tree_quads")), Workspace(spark, "tree"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).found()


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).paths().select("node", "parent", "root", "depth", "n_descendants", "path")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).descendants()


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of every node as an interval of its root's numbers."""
    return _tree(spark, d).intervals()


def _circled(spark: SparkSession, d: str) -> hierarchy.Circled:
    return hierarchy.circled(_tree(spark, d), Workspace(spark, "circled"))


def p1_circle_paths(spark: SparkSession, d: str) -> DataFrame:
    """The nodes for which p1_paths has no path."""
    return _circled(spark, d).paths()


def p1_circle_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that p1_descendants hasn't: of nodes on circles and below them."""
    return _circled(spark, d).descendants()


def _key_stats(spark: SparkSession, d: str) -> DataFrame:
    q = _read(spark, d, "quads")
    obj = [F.col("o.k").alias("ok"), F.col("o.v").alias("ov"), F.col("o.dt").alias("od"), F.col("o.lang").alias("ol"), "stated_at", "row_id"]
    pred = q.select(F.lit("pred").alias("pos"), F.col("p").alias("key_iri"), *obj)
    subj = q.select(F.lit("subj").alias("pos"), F.col("s.v").alias("key_iri"), *obj)
    rows = pred.union(subj).where("key_iri IS NOT NULL")
    return chunks.key_states(rows, ["pos", "key_iri"], ["ok", "ov", "od", "ol"], "stated_at", "row_id", Workspace(spark, "keys"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    total = _read(spark, d, "quads").agg(F.count(F.lit(1)).alias("total"))
    return _key_stats(spark, d).where(F.col("n_rows") >= total.scalar() * SHARE).select("pos", "key_iri")


def p2_keys(spark: SparkSession, d: str) -> DataFrame:
    return _key_stats(spark, d).select("pos", "key_iri", "n_rows", F.col("lowest").alias("earliest"), F.col("highest").alias("latest"), F.col("n_distinct").alias("n_objects"))


KEYS3 = ["day", "p", "g"]


def _finest(spark: SparkSession, d: str) -> DataFrame:
    q = _read(spark, d, "quads").where("s IS NOT NULL")
    rows = q.select(F.to_date("stated_at").alias("day"), "p", F.col("g.v").alias("g"), setsketch.hashed(F.col("s.k"), F.col("s.v")).alias("h"))
    return setsketch.merge(setsketch.partials(rows, KEYS3, "h"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct subjects per day, p, g and every combination; gset's bits tell which of them are rolled up."""
    return setsketch.estimates(setsketch.roll_up(_finest(spark, d), KEYS3))


def p3_day_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and Jaccard of the subjects of each day and the day after."""
    finest = _finest(spark, d).where("day IS NOT NULL").withColumns({"p": F.lit(None).cast("string"), "g": F.lit(None).cast("string")})
    days = Workspace(spark, "days").table(setsketch.merge(finest).select("day", "sketch"))
    after = days.select(F.date_sub("day", 1).alias("day"), F.col("sketch").alias("next"))
    return setsketch.joints(days.join(after, "day"), "sketch", "next")


def _compacted(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    columns = wide.declared(_read(spark, d, "predicates"))
    run = wide.write_run(wide.deltas(_read(spark, d, "attr_quads"), columns), Workspace(spark, "wide"))
    return wide.compact([run]), columns


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.cell_faults(*_compacted(spark, d))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide(*_compacted(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_lines(_read(spark, d, "rdf_lines")).where("status = 'rejected'").select("line_id", "reason")


def p5_statements(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_lines(_read(spark, d, "rdf_lines")).where("status = 'valid'").select("line_id", "path", "s", "p", "o", "g")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The terms of the loaded statements as flat columns; blank nodes without their names."""
    rows = rejects.load_lines(_read(spark, d, "rdf_lines")).where("status = 'valid'")
    return rows.select("line_id", F.when(F.col("s.k") == 1, F.col("s.v")).alias("s"), "p", F.when(F.col("o.k") > 0, F.col("o.v")).alias("o"), F.col("o.dt").alias("dt"), F.col("o.lang").alias("lang"), F.when(F.col("g.k") == 1, F.col("g.v")).alias("g"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_intervals, p1_circle_paths, p1_circle_descendants, p2_found, p2_keys, p3_counts, p3_day_overlap, p4_found, p4_wide, p5_found, p5_statements, p5_loaded)}

_LINKS = """links AS (
  SELECT DISTINCT CASE WHEN p LIKE '%#contains' THEN o.v ELSE s.v END AS child, CASE WHEN p LIKE '%#contains' THEN s.v ELSE o.v END AS parent
  FROM tree_quads WHERE p IN ('https://voc.kelmar.example/ns#within', 'https://voc.kelmar.example/ns#partOf', 'https://voc.kelmar.example/ns#contains') AND o.k IN (0, 1)),
par AS (SELECT child, min(parent) AS parent FROM links GROUP BY child),
nodes AS (SELECT child AS node FROM par UNION SELECT parent FROM par),
up(node, anc) AS (SELECT child, parent FROM par UNION SELECT up.node, par.parent FROM up JOIN par ON up.anc = par.child),
circle AS (SELECT node FROM up WHERE node = anc),
tops AS (SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM par)),
treed AS (SELECT n.node, coalesce(u.anc, n.node) AS root, (SELECT count(*) FROM up x WHERE x.node = n.node) AS depth
  FROM nodes n LEFT JOIN (SELECT node, anc FROM up WHERE anc IN (SELECT node FROM tops)) u ON u.node = n.node
  WHERE u.node IS NOT NULL OR n.node IN (SELECT node FROM tops)),
circled AS (SELECT node, min(anc) AS root, -1 AS depth FROM up WHERE anc IN (SELECT node FROM circle) GROUP BY node)"""

#: Of nodes that lead into a circle: every one above, with the number of links; ends where the way runs into itself.
_WALK = f"""{_LINKS},
walk(node, anc, steps, seen) AS (SELECT node, node, 0, [node] FROM circled
  UNION ALL SELECT w.node, par.parent, w.steps + 1, list_append(w.seen, par.parent) FROM walk w JOIN par ON par.child = w.anc WHERE NOT list_contains(w.seen, par.parent))"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT node, root, depth FROM treed UNION ALL SELECT node, root, depth FROM circled",
    "p1_paths": f"""WITH RECURSIVE {_LINKS},
walk(node, path) AS (SELECT node, node FROM tops UNION ALL SELECT par.child, walk.path || ' > ' || par.child FROM walk JOIN par ON par.parent = walk.node)
SELECT t.node, par.parent, t.root, t.depth, (SELECT count(*) FROM up x WHERE x.anc = t.node) AS n_descendants, w.path
FROM treed t LEFT JOIN par ON par.child = t.node JOIN walk w ON w.node = t.node
UNION ALL SELECT c.node, par.parent, c.root, c.depth, NULL, NULL FROM circled c JOIN par ON par.child = c.node""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT u.anc AS node, u.node AS descendant, t.depth - a.depth AS distance FROM up u JOIN treed t ON t.node = u.node JOIN treed a ON a.node = u.anc""",
    "p1_circle_paths": f"""WITH RECURSIVE {_WALK}
SELECT c.node, par.parent, c.root, c.node IN (SELECT node FROM circle) AS on_circle, w.steps,
  (SELECT count(*) FROM walk x WHERE x.anc = c.node AND x.node <> c.node) AS n_descendants, array_to_string(list_reverse(w.seen), ' > ') AS path
FROM circled c JOIN par ON par.child = c.node JOIN walk w ON w.node = c.node AND w.anc = c.root""",
    "p1_circle_descendants": f"WITH RECURSIVE {_WALK} SELECT anc AS node, node AS descendant, steps AS distance FROM walk WHERE steps > 0",
    "p2_found": """SELECT 'pred' AS pos, p AS key_iri FROM quads GROUP BY p HAVING count(*) >= 0.02 * (SELECT count(*) FROM quads)
UNION ALL SELECT 'subj', s.v FROM quads GROUP BY s.v HAVING count(*) >= 0.02 * (SELECT count(*) FROM quads)""",
    "p2_keys": """SELECT 'pred' AS pos, p AS key_iri, count(*) AS n_rows, min(stated_at) AS earliest, max(stated_at) AS latest, count(DISTINCT o) AS n_objects FROM quads WHERE p IS NOT NULL GROUP BY p
UNION ALL SELECT 'subj', s.v, count(*), min(stated_at), max(stated_at), count(DISTINCT o) FROM quads WHERE s.v IS NOT NULL GROUP BY s.v""",
    "p4_found": statement_sql.CELL_FAULTS,
    "p4_wide": statement_sql.WIDE,
    "p5_found": statement_sql.LINE_REJECTS,
    "p5_loaded": statement_sql.LOADED,
}
