"""SPARQL queries, one or more for each operator of the engine, with SQL of the same meaning.

They run over the relational tables as a virtual graph (prefix ns:) or over the statement tables (prefix k:).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import IRI, Literal
from .graph import Graph
from .sources.mapping import mapped

PREFIX = """PREFIX ns: <http://data.example/ns#> PREFIX r: <http://data.example/region/> PREFIX n: <http://data.example/nation/>
PREFIX gr: <http://data.example/graph/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX k: <https://voc.kelmar.example/ns#> PREFIX kg: <https://id.kelmar.example/graph/>
"""


@dataclass(frozen=True)
class Spec:
    query: str
    sql: str | None = None
    types: dict[str, str] = field(default_factory=dict)
    rounded: dict[str, int] = field(default_factory=dict)
    table: str | None = None  # a statement table instead of the relational ones
    bindings: dict[str, IRI | Literal] | None = None

    def __call__(self, spark: SparkSession, d: str) -> DataFrame:
        g = Graph(spark.read.parquet(f"{d}/{self.table}.parquet")) if self.table else mapped(spark, d)
        df = g.sparql(PREFIX + self.query, self.bindings).native(**self.types)
        return df.withColumns({c: F.round(c, n) for c, n in self.rounded.items()}) if self.rounded else df


L, D, TS = "bigint", "double", "timestamp_ntz"
N1 = "'http://data.example/"
_CNT = {"n": L}
_K = "'https://voc.kelmar.example/ns#"
_DAY = "2024-01-01T00:00:00"

SPECS: dict[str, Spec] = {
    # scans, projections, filters
    "bgp_scan": Spec("SELECT ?s ?name {?s ns:c_name ?name}", f"SELECT {N1}customer/' || c_custkey AS s, c_name AS name FROM customer"),
    "bgp_const_object": Spec('SELECT ?id {?c ns:c_mktsegment "BUILDING" ; ns:c_custkey ?id}', "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'", {"id": L}),
    "bgp_repeated_var": Spec("SELECT ?p (COUNT(*) AS ?n) {?x ?p ?x} GROUP BY ?p", "SELECT p, count(*) AS n FROM quads WHERE s = o GROUP BY p", _CNT, table="quads"),
    "bgp_var_predicate": Spec("SELECT ?p (COUNT(*) AS ?n) {?s ?p ?o} GROUP BY ?p", "SELECT p, count(*) AS n FROM quads GROUP BY p", _CNT, table="quads"),
    "bgp_all_tables": Spec("SELECT (COUNT(*) AS ?n) {?s a ?t ; ?p ?o FILTER(?t = ns:Nation || ?t = ns:Region)}", "SELECT (SELECT count(*) * 5 FROM nation) + (SELECT count(*) * 3 FROM region) AS n", _CNT),
    "graph_const": Spec("SELECT ?s ?o {GRAPH kg:tides {?s k:flag ?o}}", "SELECT s.v AS s, o.v AS o FROM quads WHERE g.v = 'https://id.kelmar.example/graph/tides' AND p = 'https://voc.kelmar.example/ns#flag'", table="quads"),
    "graph_var": Spec("SELECT ?g (COUNT(*) AS ?n) {GRAPH ?g {?s ?p ?o}} GROUP BY ?g", "SELECT g.v AS g, count(*) AS n FROM quads WHERE g IS NOT NULL GROUP BY g.v", _CNT, table="quads"),
    "graph_var_mapped": Spec("SELECT ?g (COUNT(?o) AS ?n) {GRAPH ?g {?s a ?o}} GROUP BY ?g", "SELECT 'http://data.example/graph/' || t AS g, n FROM (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'heldout', count(*) FROM heldout)", _CNT),
    "graph_from": Spec("SELECT (COUNT(*) AS ?n) FROM kg:tides {?s k:flag ?o}", "SELECT count(*) AS n FROM quads WHERE g.v = 'https://id.kelmar.example/graph/tides' AND p = 'https://voc.kelmar.example/ns#flag'", _CNT, table="quads"),
    "graph_from_named": Spec("SELECT ?g (COUNT(*) AS ?n) FROM NAMED kg:tides FROM NAMED kg:outer {GRAPH ?g {?s k:flag ?o}} GROUP BY ?g", "SELECT g.v AS g, count(*) AS n FROM quads WHERE g.v IN ('https://id.kelmar.example/graph/tides', 'https://id.kelmar.example/graph/outer') AND p = 'https://voc.kelmar.example/ns#flag' GROUP BY 1", _CNT, table="quads"),
    "project": Spec("SELECT ?name ?nothing {?s ns:s_name ?name ; ns:s_acctbal ?b}", "SELECT s_name AS name, CAST(NULL AS VARCHAR) AS nothing FROM supplier"),
    "bind_expr": Spec("SELECT ?id ?twice ?more {?o ns:p_partkey ?id ; ns:p_size ?s BIND(?s * 2 AS ?twice) BIND(?twice + 1 AS ?more)}", "SELECT p_partkey AS id, CAST(p_size * 2 AS BIGINT) AS twice, CAST(p_size * 2 + 1 AS BIGINT) AS more FROM part", {"id": L, "twice": L, "more": L}),
    "filter_compare": Spec("SELECT ?id ?p {?o ns:o_orderkey ?id ; ns:o_totalprice ?p FILTER(?p > 250000.0)}", "SELECT o_orderkey AS id, o_totalprice AS p FROM orders WHERE o_totalprice > 250000", {"id": L, "p": D}),
    "filter_exists": Spec("SELECT ?name {?n ns:n_name ?name FILTER EXISTS {?s ns:s_nation ?n ; ns:s_acctbal ?b FILTER(?b > 9000)}}", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)"),
    "filter_not_exists": Spec("SELECT ?name {?n ns:n_name ?name FILTER NOT EXISTS {?s ns:s_nation ?n ; ns:s_acctbal ?b FILTER(?b > 9000)}}", "SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)"),
    "filter_exists_correlated": Spec("SELECT ?id {?s ns:s_suppkey ?id ; ns:s_nation ?n ; ns:s_acctbal ?b FILTER NOT EXISTS {?t ns:s_nation ?n ; ns:s_acctbal ?c FILTER(?c > ?b)}}", "SELECT s_suppkey AS id FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal)", {"id": L}),
    "exists_compound": Spec("SELECT ?name {?n ns:n_name ?name ; ns:n_nationkey ?k FILTER(?k < 5 || EXISTS {?s ns:s_nation ?n ; ns:s_acctbal ?b FILTER(?b > 9000)})}", "SELECT n_name AS name FROM nation WHERE n_nationkey < 5 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)"),
    "not_exists_uncorrelated": Spec('SELECT ?name {?r ns:r_name ?name FILTER NOT EXISTS {?c ns:c_mktsegment "NOTHING"}}', "SELECT r_name AS name FROM region"),
    "values_inline": Spec('SELECT ?x ?y {VALUES (?x ?y) {(1 "a") (2 UNDEF) (2 "b"@en)}}', "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL), (2, 'b')) t(x, y)", {"x": L}),
    # joins
    "join_star": Spec("SELECT ?name ?bal ?seg {?c ns:c_name ?name ; ns:c_acctbal ?bal ; ns:c_mktsegment ?seg}", "SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer", {"bal": D}),
    "join_chain": Spec("SELECT ?c ?nation ?region {?x ns:c_name ?c ; ns:c_nation ?n . ?n ns:n_name ?nation ; ns:n_region ?r . ?r ns:r_name ?region}", "SELECT c_name AS c, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_big": Spec("SELECT ?seg (COUNT(*) AS ?n) (SUM(?q) AS ?qty) {?l ns:l_order ?o ; ns:l_quantity ?q . ?o ns:o_customer ?c . ?c ns:c_mktsegment ?seg} GROUP BY ?seg", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1", {"n": L, "qty": D}, {"qty": 2}),
    "join_cross": Spec("SELECT ?a ?b {?x ns:r_name ?a . ?y ns:n_name ?b}", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "values_join": Spec('SELECT ?seg ?id {VALUES ?seg {"BUILDING" "MACHINERY"} ?c ns:c_mktsegment ?seg ; ns:c_custkey ?id}', "SELECT c_mktsegment AS seg, c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", {"id": L}),
    "values_undef": Spec('SELECT ?id ?seg ?nk {?c ns:c_custkey ?id ; ns:c_mktsegment ?seg ; ns:c_nationkey ?nk VALUES (?seg ?nk) {("BUILDING" UNDEF) (UNDEF 3)}}', "SELECT c_custkey AS id, c_mktsegment AS seg, CAST(c_nationkey AS BIGINT) AS nk FROM customer JOIN (VALUES ('BUILDING', NULL), (NULL, 3)) v(s, k) ON (s IS NULL OR s = c_mktsegment) AND (k IS NULL OR k = c_nationkey)", {"id": L, "nk": L}),
    "optional": Spec("SELECT ?id ?repo {?d ns:doc_id ?id OPTIONAL {?d ns:repo ?repo}}", "SELECT doc_id AS id, repo FROM documents", {"id": L}),
    "optional_filter": Spec("SELECT ?name ?b {?n ns:n_name ?name OPTIONAL {?s ns:s_nation ?n ; ns:s_acctbal ?b FILTER(?b > 8000)}}", "SELECT n_name AS name, s_acctbal AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000", {"b": D}),
    "optional_filter_outer": Spec("SELECT ?id ?o {?s ns:s_suppkey ?id ; ns:s_nation ?n ; ns:s_acctbal ?b OPTIONAL {?t ns:s_nation ?n ; ns:s_acctbal ?c ; ns:s_suppkey ?o FILTER(?c > ?b)}}", "SELECT a.s_suppkey AS id, b.s_suppkey AS o FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal", {"id": L, "o": L}),
    "optional_multi": Spec("SELECT ?id ?repo ?kernel ?at {?d ns:doc_id ?id OPTIONAL {?d ns:repo ?repo} OPTIONAL {?d ns:kernel ?kernel} OPTIONAL {?d ns:pushed_at ?at}}", "SELECT doc_id AS id, repo, kernel, pushed_at AS at FROM documents", {"id": L, "at": TS}),
    "optional_shared": Spec("SELECT ?id ?x ?n {?d ns:doc_id ?id OPTIONAL {?d ns:lang ?x} {SELECT ?x (COUNT(*) AS ?n) {?h ns:item_id ?i ; ns:lang ?x} GROUP BY ?x}}", "SELECT doc_id AS id, h.lang AS x, n FROM documents d JOIN (SELECT lang, count(*) AS n FROM heldout GROUP BY lang) h ON d.lang IS NULL OR d.lang = h.lang", {"id": L, "n": L}),
    "minus": Spec("SELECT ?id {?d ns:doc_id ?id MINUS {?d ns:kernel ?k}}", "SELECT doc_id AS id FROM documents WHERE kernel IS NULL", {"id": L}),
    "join_theta_filter": Spec("SELECT ?a ?b {?x ns:n_nationkey ?a ; ns:n_region ?r . ?y ns:n_nationkey ?b ; ns:n_region ?r FILTER(?a < ?b)}", "SELECT CAST(x.n_nationkey AS BIGINT) AS a, CAST(y.n_nationkey AS BIGINT) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey", {"a": L, "b": L}),
    "subselect": Spec("SELECT ?id ?p ?m {?o ns:o_orderkey ?id ; ns:o_customer ?c ; ns:o_totalprice ?p {SELECT ?c (MAX(?q) AS ?m) {?x ns:o_customer ?c ; ns:o_totalprice ?q} GROUP BY ?c} FILTER(?p = ?m)}", "SELECT o_orderkey AS id, o_totalprice AS p, m FROM orders JOIN (SELECT o_custkey AS c, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c = o_custkey WHERE o_totalprice = m", {"id": L, "p": D, "m": D}),
    # paths
    "path_sequence": Spec("SELECT ?name ?r {?c ns:c_name ?name ; ns:c_nation/ns:n_region/ns:r_name ?r}", "SELECT c_name AS name, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_alternative": Spec("SELECT ?x {?s ns:c_name|ns:s_name ?x}", "SELECT c_name AS x FROM customer UNION ALL SELECT s_name FROM supplier"),
    "path_negated": Spec("SELECT ?p (COUNT(*) AS ?n) {?s !(k:seenAt|k:logged) ?o . ?s ?p ?o FILTER(?p != k:seenAt && ?p != k:logged && ?p != k:depthReading && ?p != k:flag)} GROUP BY ?p", "SELECT b.p, count(*) AS n FROM quads a JOIN quads b ON a.s = b.s AND a.o = b.o WHERE a.p NOT IN ('https://voc.kelmar.example/ns#seenAt', 'https://voc.kelmar.example/ns#logged') AND b.p NOT IN ('https://voc.kelmar.example/ns#seenAt', 'https://voc.kelmar.example/ns#logged', 'https://voc.kelmar.example/ns#depthReading', 'https://voc.kelmar.example/ns#flag') GROUP BY b.p", _CNT, table="quads"),
    "path_inverse": Spec("SELECT ?name ?c {?n ns:n_name ?name ; ^ns:c_nation/ns:c_name ?c}", "SELECT n_name AS name, c_name AS c FROM nation JOIN customer ON c_nationkey = n_nationkey"),
    "path_zero_or_one": Spec("SELECT (COUNT(*) AS ?n) {?s k:near? ?o}", "SELECT count(*) AS n FROM (SELECT s AS a, s AS b FROM tree_quads UNION SELECT o, o FROM tree_quads UNION SELECT s, o FROM tree_quads WHERE p = 'https://voc.kelmar.example/ns#near')", _CNT, table="tree_quads"),
    "path_zero_or_one_const": Spec("SELECT ?x {n:3 ns:n_region? ?x}", "SELECT 'http://data.example/nation/3' AS x UNION ALL SELECT 'http://data.example/region/' || n_regionkey FROM nation WHERE n_nationkey = 3"),
    "path_graph": Spec("SELECT ?g (COUNT(*) AS ?n) {GRAPH ?g {?s k:near? ?o}} GROUP BY ?g", "SELECT g.v AS g, count(*) AS n FROM (SELECT g, s AS a, s AS b FROM tree_quads UNION SELECT g, o, o FROM tree_quads UNION SELECT g, s, o FROM tree_quads WHERE p = 'https://voc.kelmar.example/ns#near') WHERE g IS NOT NULL GROUP BY 1", _CNT, table="tree_quads"),
    # aggregates
    "agg_count": Spec("SELECT ?c (COUNT(?o) AS ?n) {?o ns:o_customer ?x . ?x ns:c_custkey ?c} GROUP BY ?c", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1", {"c": L, "n": L}),
    "agg_count_optional": Spec("SELECT ?fmt (COUNT(?repo) AS ?n) {?d ns:fmt ?fmt OPTIONAL {?d ns:repo ?repo}} GROUP BY ?fmt", "SELECT fmt, count(repo) AS n FROM documents GROUP BY 1", _CNT),
    "agg_count_star": Spec("SELECT ?t (COUNT(*) AS ?n) {?e ns:event_type ?t} GROUP BY ?t", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1", _CNT),
    "agg_count_distinct": Spec("SELECT ?t (COUNT(DISTINCT ?u) AS ?n) {?e ns:event_type ?t ; ns:user_id ?u} GROUP BY ?t", "SELECT event_type AS t, count(DISTINCT user_id) AS n FROM events GROUP BY 1", _CNT),
    "agg_count_distinct_star": Spec("SELECT (COUNT(DISTINCT *) AS ?n) {?s k:flag ?o}", "SELECT count(*) AS n FROM (SELECT DISTINCT s, o FROM quads WHERE p = 'https://voc.kelmar.example/ns#flag')", _CNT, table="quads"),
    "agg_sum": Spec("SELECT ?f (SUM(?q) AS ?qty) {?l ns:l_returnflag ?f ; ns:l_quantity ?q} GROUP BY ?f", "SELECT l_returnflag AS f, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1", {"qty": D}, {"qty": 2}),
    "agg_sum_distinct": Spec("SELECT ?b (SUM(DISTINCT ?s) AS ?x) {?p ns:p_brand ?b ; ns:p_size ?s} GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS x FROM part GROUP BY 1", {"x": L}),
    "agg_sum_dynamic": Spec("SELECT ?s (SUM(?o) AS ?x) {?s k:depthReading ?o} GROUP BY ?s", "SELECT s.v AS s, CASE WHEN count(*) = count(CASE WHEN o.dt IN ('xsd:integer', 'xsd:decimal', 'xsd:double') THEN try_cast(o.v AS DOUBLE) END) THEN round(sum(try_cast(o.v AS DOUBLE)), 4) END AS x FROM quads WHERE p = 'https://voc.kelmar.example/ns#depthReading' GROUP BY s", {"x": D}, {"x": 4}, table="quads"),
    "agg_min": Spec("SELECT ?c (MIN(?d) AS ?x) {?o ns:o_custkey ?c ; ns:o_orderdate ?d} GROUP BY ?c", "SELECT o_custkey AS c, min(o_orderdate) AS x FROM orders GROUP BY 1", {"c": L, "x": TS}),
    "agg_max": Spec("SELECT ?b (MAX(?p) AS ?x) (MAX(?n) AS ?y) {?q ns:p_brand ?b ; ns:p_retailprice ?p ; ns:p_name ?n} GROUP BY ?b", "SELECT p_brand AS b, max(p_retailprice) AS x, max(p_name) AS y FROM part GROUP BY 1", {"x": D}),
    "agg_avg": Spec("SELECT ?b (AVG(?s) AS ?x) {?p ns:p_brand ?b ; ns:p_size ?s} GROUP BY ?b", "SELECT p_brand AS b, round(avg(p_size), 6) AS x FROM part GROUP BY 1", {"x": D}, {"x": 6}),
    "agg_avg_distinct": Spec("SELECT ?b (AVG(DISTINCT ?s) AS ?x) {?p ns:p_brand ?b ; ns:p_size ?s} GROUP BY ?b", "SELECT p_brand AS b, round(avg(DISTINCT p_size), 6) AS x FROM part GROUP BY 1", {"x": D}, {"x": 6}),
    "agg_group_concat": Spec('SELECT ?r (GROUP_CONCAT(?n; separator=";") AS ?x) {?y ns:n_name ?n ; ns:n_regionkey ?r} GROUP BY ?r', "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, ';' ORDER BY n_name) AS x FROM nation GROUP BY 1", {"r": L}),
    "agg_group_concat_customer": Spec('SELECT ?k (GROUP_CONCAT(?n; separator=";") AS ?x) {?c ns:c_name ?n ; ns:c_nationkey ?k} GROUP BY ?k', "SELECT CAST(c_nationkey AS BIGINT) AS k, string_agg(c_name, ';' ORDER BY c_name) AS x FROM customer GROUP BY 1", {"k": L}),
    "agg_group_concat_distinct": Spec("SELECT ?n (GROUP_CONCAT(DISTINCT ?s) AS ?x) {?c ns:c_nationkey ?n ; ns:c_mktsegment ?s} GROUP BY ?n", "SELECT CAST(c_nationkey AS BIGINT) AS n, string_agg(DISTINCT c_mktsegment, ' ' ORDER BY c_mktsegment) AS x FROM customer GROUP BY 1", {"n": L}),
    "agg_sample": Spec("SELECT ?r (SAMPLE(?n) AS ?x) {?y ns:n_name ?n ; ns:n_regionkey ?r} GROUP BY ?r", None, {"r": L}),
    "agg_multi": Spec("SELECT ?f ?s (SUM(?q) AS ?qty) (SUM(?p) AS ?price) (AVG(?d) AS ?disc) (COUNT(*) AS ?n) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) {?l ns:l_returnflag ?f ; ns:l_linestatus ?s ; ns:l_quantity ?q ; ns:l_extendedprice ?p ; ns:l_discount ?d} GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2", {"qty": D, "price": D, "disc": D, "n": L, "lo": D, "hi": D}, {"qty": 2, "price": 2, "disc": 6}),
    "agg_expr": Spec("SELECT ?b ((MIN(?s) + MAX(?s)) / 2 AS ?mid) (SUM(?s * 2) AS ?x) {?p ns:p_brand ?b ; ns:p_size ?s} GROUP BY ?b", "SELECT p_brand AS b, (min(p_size) + max(p_size)) / 2 AS mid, CAST(sum(p_size * 2) AS BIGINT) AS x FROM part GROUP BY 1", {"mid": D, "x": L}),
    "agg_having": Spec("SELECT ?c (COUNT(?o) AS ?n) {?o ns:o_custkey ?c} GROUP BY ?c HAVING(COUNT(?o) > 15)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15", {"c": L, "n": L}),
    "agg_global": Spec('SELECT (COUNT(*) AS ?n) (SUM(?s) AS ?x) (MIN(?s) AS ?lo) {?p ns:p_brand "none" ; ns:p_size ?s}', "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS x, CAST(NULL AS BIGINT) AS lo", {"n": L, "x": L, "lo": L}),
    "group_no_agg": Spec("SELECT ?b {?p ns:p_brand ?b} GROUP BY ?b", "SELECT DISTINCT p_brand AS b FROM part"),
    "group_by_expr": Spec("SELECT ?y (COUNT(*) AS ?n) {?o ns:o_orderdate ?d} GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1", {"y": L, "n": L}),
    # order and slices
    "order_by": Spec("SELECT ?n {?x ns:n_name ?n} ORDER BY DESC(?n)", "SELECT n_name AS n FROM nation ORDER BY 1 DESC"),
    "order_by_orders": Spec("SELECT ?id ?p {?o ns:o_orderkey ?id ; ns:o_totalprice ?p} ORDER BY DESC(?p) ?id", "SELECT o_orderkey AS id, o_totalprice AS p FROM orders ORDER BY p DESC, id", {"id": L, "p": D}),
    "order_multi": Spec("SELECT ?r ?n {?x ns:n_regionkey ?r ; ns:n_name ?n} ORDER BY DESC(?r) ?n", "SELECT CAST(n_regionkey AS BIGINT) AS r, n_name AS n FROM nation ORDER BY 1 DESC, 2", {"r": L}),
    "order_limit": Spec("SELECT ?id ?p {?o ns:o_orderkey ?id ; ns:o_totalprice ?p} ORDER BY DESC(?p) ?id LIMIT 10", "SELECT o_orderkey AS id, o_totalprice AS p FROM orders ORDER BY p DESC, id LIMIT 10", {"id": L, "p": D}),
    "order_limit_offset": Spec("SELECT ?id {?o ns:o_orderkey ?id ; ns:o_totalprice ?p} ORDER BY DESC(?p) ?id LIMIT 10 OFFSET 5", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, id LIMIT 10 OFFSET 5", {"id": L}),
    "order_offset": Spec("SELECT ?n {?x ns:n_name ?n} ORDER BY ?n OFFSET 20", "SELECT n_name AS n FROM nation ORDER BY 1 OFFSET 20"),
    "order_terms": Spec("SELECT ?o {?s k:depthReading ?o} ORDER BY DESC(?o) LIMIT 1", None, table="quads"),
    "limit": Spec("SELECT ?n {?x ns:n_name ?n} LIMIT 7", None),
    "offset": Spec("SELECT ?n {?x ns:n_name ?n} OFFSET 7", None),
    "distinct_limit": Spec("SELECT DISTINCT ?s {?c ns:c_mktsegment ?s} ORDER BY ?s LIMIT 3", "SELECT DISTINCT c_mktsegment AS s FROM customer ORDER BY 1 LIMIT 3"),
    # sets
    "union": Spec("SELECT ?x {{?c ns:c_name ?x} UNION {?s ns:s_name ?x}}", "SELECT c_name AS x FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union_hetero": Spec("SELECT ?x ?y {{?c ns:c_name ?x} UNION {?s ns:s_name ?y}}", "SELECT c_name AS x, CAST(NULL AS VARCHAR) AS y FROM customer UNION ALL SELECT NULL, s_name FROM supplier"),
    "distinct": Spec("SELECT DISTINCT ?s ?n {?c ns:c_mktsegment ?s ; ns:c_nationkey ?n}", "SELECT DISTINCT c_mktsegment AS s, CAST(c_nationkey AS BIGINT) AS n FROM customer", _CNT),
    "reduced": Spec("SELECT REDUCED ?s {?c ns:c_mktsegment ?s}", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "ask": Spec("ASK {?c ns:c_acctbal ?b FILTER(?b > 9000)}", "SELECT count(*) > 0 AS ask FROM customer WHERE c_acctbal > 9000", {"ask": "boolean"}),
    "bound_params": Spec("SELECT ?seg ?id {?c ns:c_mktsegment ?seg ; ns:c_custkey ?id}", "SELECT 'BUILDING' AS seg, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'", {"id": L}, bindings={"seg": Literal("BUILDING")}),
    # expressions
    "expr_logic": Spec("SELECT ?id ?x ?y {?d ns:doc_id ?id OPTIONAL {?d ns:n_cells ?c} OPTIONAL {?d ns:repo ?r} BIND(?c > 5 || BOUND(?r) AS ?x) BIND(!(?c > 5) && ?c != 3 AS ?y)}", "SELECT doc_id AS id, n_cells > 5 OR repo IS NOT NULL AS x, NOT (n_cells > 5) AND n_cells <> 3 AS y FROM documents", {"id": L, "x": "boolean", "y": "boolean"}),
    "expr_compare": Spec(f'SELECT (COUNT(*) AS ?n) {{?e ns:ts ?t ; ns:value ?v ; ns:event_type ?k FILTER(?t >= "{_DAY}"^^xsd:dateTime && ?v <= 50 && ?k != "view")}}', f"SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_DAY.replace('T', ' ')}' AND value <= 50 AND event_type <> 'view'", _CNT),
    "expr_compare_terms": Spec("SELECT (COUNT(*) AS ?n) {?s ?p ?o FILTER(?o > 20)}", "SELECT count(*) AS n FROM quads WHERE o.dt IN ('xsd:integer', 'xsd:decimal', 'xsd:double', 'xsd:float') AND try_cast(trim(o.v) AS DOUBLE) > 20", _CNT, table="quads"),
    "expr_in": Spec('SELECT ?id {?c ns:c_custkey ?id ; ns:c_nationkey ?n ; ns:c_mktsegment ?s FILTER(?n IN (1, 2, 3.0) && ?s NOT IN ("BUILDING"))}', "SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment <> 'BUILDING'", {"id": L}),
    "expr_arith": Spec("SELECT ?id ?a ?b ?c ?d {?p ns:p_partkey ?id ; ns:p_size ?s ; ns:p_retailprice ?r BIND(?s / 4 AS ?a) BIND(-?s - 3 AS ?b) BIND(?r * 2 + ?s AS ?c) BIND(?s / 0 AS ?d)}", "SELECT p_partkey AS id, p_size / 4 AS a, CAST(-p_size - 3 AS BIGINT) AS b, round(p_retailprice * 2 + p_size, 4) AS c, CAST(NULL AS DOUBLE) AS d FROM part", {"id": L, "a": D, "b": L, "c": D, "d": D}, {"c": 4}),
    "expr_forms": Spec('SELECT ?id ?a ?b ?c {?d ns:doc_id ?id OPTIONAL {?d ns:repo ?r} OPTIONAL {?d ns:kernel ?k} BIND(IF(BOUND(?r), "yes", "no") AS ?a) BIND(COALESCE(?r, ?k, "none") AS ?b) BIND(sameTerm(?k, "python3") AS ?c)}', "SELECT doc_id AS id, CASE WHEN repo IS NOT NULL THEN 'yes' ELSE 'no' END AS a, coalesce(repo, kernel, 'none') AS b, kernel = 'python3' AS c FROM documents", {"id": L, "c": "boolean"}),
    "expr_term_tests": Spec("SELECT (SUM(IF(isIRI(?o), 1, 0)) AS ?i) (SUM(IF(isBlank(?o), 1, 0)) AS ?b) (SUM(IF(isLiteral(?o), 1, 0)) AS ?l) {?s ?p ?o}", "SELECT CAST(count(*) FILTER (o.k = 1) AS BIGINT) AS i, CAST(count(*) FILTER (o.k = 0) AS BIGINT) AS b, CAST(count(*) FILTER (o.k = 2) AS BIGINT) AS l FROM quads", {"i": L, "b": L, "l": L}, table="quads"),
    "expr_term_access": Spec("SELECT ?dt ?l (COUNT(*) AS ?n) {?s ?p ?o BIND(STR(DATATYPE(?o)) AS ?dt) BIND(LANG(?o) AS ?l)} GROUP BY ?dt ?l", "SELECT CASE WHEN o.dt = 'rdf:langString' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' WHEN o.dt LIKE 'xsd:%' THEN 'http://www.w3.org/2001/XMLSchema#' || o.dt[5:] ELSE o.dt END AS dt, CASE WHEN o.k = 2 THEN coalesce(o.lang, '') END AS l, count(*) AS n FROM quads GROUP BY 1, 2", _CNT, table="quads"),
    "expr_term_build": Spec('SELECT ?a ?b ?c {?x ns:r_name ?r BIND(IRI(CONCAT("http://x/", ?r)) AS ?a) BIND(STRDT(?r, ns:t) AS ?b) BIND(STRLANG(?r, "EN") AS ?c) FILTER(isBlank(BNODE(?r)) && STRLEN(STRUUID()) = 36)}', "SELECT 'http://x/' || r_name AS a, r_name AS b, r_name AS c FROM region"),
    "expr_string": Spec('SELECT ?n ?u ?l ?len ?c ?s ?e ?x {?p ns:p_name ?n BIND(UCASE(?n) AS ?u) BIND(LCASE(?n) AS ?l) BIND(STRLEN(?n) AS ?len) BIND(CONTAINS(?n, "a") AS ?c) BIND(STRSTARTS(?n, "Part") AS ?s) BIND(STRENDS(?n, "1") AS ?e) BIND(CONCAT(?n, "-", ?n) AS ?x)}', "SELECT p_name AS n, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS len, contains(p_name, 'a') AS c, starts_with(p_name, 'Part') AS s, ends_with(p_name, '1') AS e, p_name || '-' || p_name AS x FROM part", {"len": L, "c": "boolean", "s": "boolean", "e": "boolean"}),
    "expr_substr": Spec("SELECT ?a ?b ?c {?p ns:c_name ?n BIND(SUBSTR(?n, 3) AS ?a) BIND(SUBSTR(?n, 2, 4) AS ?b) BIND(SUBSTR(?n, 0, 4) AS ?c)}", "SELECT c_name[3:] AS a, c_name[2:5] AS b, c_name[1:3] AS c FROM customer"),
    "expr_strbefore_after": Spec('SELECT ?a ?b ?c {?p ns:c_name ?n BIND(STRBEFORE(?n, "#") AS ?a) BIND(STRAFTER(?n, "#") AS ?b) BIND(STRAFTER(?n, "?") AS ?c)}', "SELECT split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, '' AS c FROM customer"),
    "expr_encode_uri": Spec("SELECT ?a {?e ns:c_name ?n BIND(ENCODE_FOR_URI(?n) AS ?a)}", "SELECT url_encode(c_name) AS a FROM customer"),
    "expr_regex": Spec('SELECT ?n {?c ns:c_name ?n FILTER(REGEX(?n, "^customer#0*[13]5", "i"))}', "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '^customer#0*[13]5', 'i')"),
    "expr_replace": Spec('SELECT ?a {?c ns:c_name ?n BIND(REPLACE(?n, "0+([1-9])", "-$1") AS ?a)}', r"SELECT regexp_replace(c_name, '0+([1-9])', '-\1', 'g') AS a FROM customer"),
    "expr_lang": Spec('SELECT ?id ?l {?d ns:item_id ?id ; ns:text ?t BIND(LANG(?t) AS ?l) FILTER(langMatches(LANG(?t), "FR") || langMatches(LANG(?t), "de"))}', "SELECT item_id AS id, lang AS l FROM heldout WHERE lang IN ('fr', 'de')", {"id": L}),
    "expr_numeric": Spec("SELECT ?id ?a ?b ?c ?d {?s ns:s_suppkey ?id ; ns:s_acctbal ?x BIND(ABS(?x) AS ?a) BIND(ROUND(?x) AS ?b) BIND(CEIL(?x) AS ?c) BIND(FLOOR(?x) AS ?d)}", "SELECT s_suppkey AS id, abs(s_acctbal) AS a, floor(s_acctbal + 0.5) AS b, ceil(s_acctbal) AS c, floor(s_acctbal) AS d FROM supplier", {"id": L, "a": D, "b": D, "c": D, "d": D}),
    "expr_datetime": Spec("SELECT ?id ?y ?m ?d ?h ?i {?e ns:event_id ?id ; ns:ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?i)}", "SELECT event_id AS id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i FROM events", {x: L for x in ("id", "y", "m", "d", "h", "i")}),
    "expr_datetime_terms": Spec("SELECT ?h (COUNT(*) AS ?n) {?s k:logged ?t BIND(HOURS(?t) AS ?h)} GROUP BY ?h", r"SELECT CASE WHEN o.dt = 'xsd:dateTime' AND regexp_matches(o.v, '^\s*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\s*$') THEN try_cast(regexp_extract(o.v, 'T([0-9]{2}):', 1) AS BIGINT) END AS h, count(*) AS n FROM quads WHERE p = 'https://voc.kelmar.example/ns#logged' GROUP BY 1", {"h": L, "n": L}, table="quads"),
    "expr_hash": Spec("SELECT ?n ?a ?b ?c {?x ns:n_name ?n BIND(MD5(?n) AS ?a) BIND(SHA1(?n) AS ?b) BIND(SHA256(?n) AS ?c)}", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "expr_hash_customer": Spec("SELECT ?n ?a ?b ?c {?x ns:c_name ?n BIND(MD5(?n) AS ?a) BIND(SHA1(?n) AS ?b) BIND(SHA256(?n) AS ?c)}", "SELECT c_name AS n, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer"),
    "bgp_repeated_tree": Spec("SELECT ?p (COUNT(*) AS ?n) {?x ?p ?x} GROUP BY ?p", "SELECT p, count(*) AS n FROM tree_quads WHERE s.k = o.k AND s.v = o.v GROUP BY p", _CNT, table="tree_quads"),
    "path_negated_subjects": Spec("SELECT ?s (COUNT(*) AS ?n) {?s !(k:berthedBy|k:cargoOf) ?o} GROUP BY ?s", "SELECT s.v AS s, count(*) AS n FROM quads WHERE p NOT IN ('https://voc.kelmar.example/ns#berthedBy', 'https://voc.kelmar.example/ns#cargoOf') GROUP BY s.v", _CNT, table="quads"),
    "exists_maybe_unbound": Spec(
        "SELECT ?s {?s k:near ?x OPTIONAL {?s k:within ?y} FILTER EXISTS {?z k:partOf ?y}}",
        f"SELECT n.s.v AS s FROM tree_quads n LEFT JOIN (SELECT s, o FROM tree_quads WHERE p = {_K}within') w ON w.s.v = n.s.v AND w.s.k = n.s.k WHERE n.p = {_K}near' AND CASE WHEN w.o IS NULL THEN EXISTS (SELECT 1 FROM tree_quads WHERE p = {_K}partOf') ELSE EXISTS (SELECT 1 FROM tree_quads q WHERE q.p = {_K}partOf' AND q.o.v = w.o.v AND q.o.k = w.o.k AND q.o.dt IS NOT DISTINCT FROM w.o.dt) END",
        table="tree_quads",
    ),
    "minus_maybe_unbound": Spec(
        "SELECT ?s {?s k:near ?x OPTIONAL {?s k:within ?y} MINUS {?z k:partOf ?y}}",
        f"SELECT n.s.v AS s FROM tree_quads n LEFT JOIN (SELECT s, o FROM tree_quads WHERE p = {_K}within') w ON w.s.v = n.s.v AND w.s.k = n.s.k WHERE n.p = {_K}near' AND (w.o IS NULL OR NOT EXISTS (SELECT 1 FROM tree_quads q WHERE q.p = {_K}partOf' AND q.o.v = w.o.v AND q.o.k = w.o.k AND q.o.dt IS NOT DISTINCT FROM w.o.dt))",
        table="tree_quads",
    ),
    "agg_sum_large": Spec("SELECT (SUM(?x) AS ?n) {?o ns:o_custkey ?c BIND(xsd:decimal(?c) * 0 + 620000000000000 AS ?x)}", "SELECT CAST(CAST(620000000000000 AS DECIMAL(20, 0)) * CAST(count(*) AS DECIMAL(18, 0)) AS DECIMAL(38, 18)) AS n FROM orders", {"n": "decimal(38,18)"}),
    "agg_min_max_distinct": Spec("SELECT ?c (MIN(DISTINCT ?t) AS ?a) (MAX(DISTINCT ?t) AS ?b) {?o ns:o_custkey ?c ; ns:o_totalprice ?t} GROUP BY ?c", "SELECT o_custkey AS c, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY o_custkey", {"c": L, "a": D, "b": D}),
    "expr_decimal": Spec(
        "SELECT ?id ?a ?b ?c ?d {?s ns:s_suppkey ?id BIND(xsd:decimal(?id) / 0.0000004 AS ?a) BIND(xsd:decimal(?id) * 0.0000000004 AS ?b) BIND((?id + 3000000000000000.5) / 0.5 AS ?c) BIND((?id + 0.123456789) * 0.000000001 AS ?d)}",
        "SELECT s_suppkey AS id, CAST(s_suppkey AS DECIMAL(38, 18)) * 2500000 AS a, CAST(CAST(s_suppkey AS DECIMAL(18, 0)) * 0.0000000004 AS DECIMAL(38, 18)) AS b, CAST(2 * (CAST(s_suppkey AS DECIMAL(18, 0)) + 3000000000000000.5) AS DECIMAL(38, 18)) AS c, CAST(CAST(CAST(s_suppkey AS DECIMAL(18, 0)) + 0.123456789 AS DECIMAL(19, 9)) * 0.000000001 AS DECIMAL(38, 18)) AS d FROM supplier",
        {"id": L, **{x: "decimal(38,18)" for x in "abcd"}},
    ),
    "expr_datetime_zone": Spec("SELECT ?z (COUNT(*) AS ?n) {?s k:logged ?t BIND(TZ(?t) AS ?z)} GROUP BY ?z", r"SELECT CASE WHEN o.dt = 'xsd:dateTime' AND regexp_matches(o.v, '^\s*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\s*$') THEN regexp_extract(trim(o.v), '(Z|[+-][0-9]{2}:[0-9]{2})$', 1) END AS z, count(*) AS n FROM quads WHERE p = 'https://voc.kelmar.example/ns#logged' GROUP BY 1", _CNT, table="quads"),
    "expr_casts_from_text": Spec('SELECT ?id ?a ?b ?c ?d {?s ns:s_suppkey ?id BIND(xsd:decimal(CONCAT(STR(?id), ".50")) AS ?a) BIND(xsd:date(CONCAT("2020-01-", IF(?id < 10, "0", ""), STR(?id))) AS ?b) BIND(xsd:float(STR(?id)) AS ?c) BIND(isNumeric(?id) AS ?d)}', "SELECT s_suppkey AS id, CAST(s_suppkey + 0.5 AS DECIMAL(38, 18)) AS a, CASE WHEN s_suppkey BETWEEN 1 AND 31 THEN DATE '2020-01-01' + CAST(s_suppkey - 1 AS INT) END AS b, CAST(s_suppkey AS FLOAT) AS c, true AS d FROM supplier", {"id": L, "a": "decimal(38,18)", "b": "date", "c": "float", "d": "boolean"}),
    "expr_cast": Spec("SELECT ?id ?a ?b ?c ?d ?e {?s ns:s_suppkey ?id ; ns:s_acctbal ?x ; ns:s_name ?n BIND(xsd:integer(?x) AS ?a) BIND(xsd:string(?id) AS ?b) BIND(xsd:double(?id) AS ?c) BIND(xsd:boolean(?id) AS ?d) BIND(xsd:integer(?n) AS ?e)}", "SELECT s_suppkey AS id, CAST(trunc(s_acctbal) AS BIGINT) AS a, CAST(s_suppkey AS VARCHAR) AS b, CAST(s_suppkey AS DOUBLE) AS c, s_suppkey <> 0 AS d, CAST(NULL AS BIGINT) AS e FROM supplier", {"id": L, "a": L, "c": D, "d": "boolean", "e": L}),
}


def result_json(spark: SparkSession, d: str) -> DataFrame:
    """Solutions as JSON objects."""
    return mapped(spark, d).sparql(PREFIX + "SELECT ?r ?n {?x ns:n_region ?r ; ns:n_name ?n}").json()


def result_json_customer(spark: SparkSession, d: str) -> DataFrame:
    """Solutions as JSON objects, a row a customer."""
    return mapped(spark, d).sparql(PREFIX + "SELECT ?n {?x ns:c_name ?n}").json()


def rdf_read(spark: SparkSession, d: str) -> DataFrame:
    """Statements written as N-Quads files and read again."""
    from .sources.rdf import read_rdf, write_nquads
    from .workspace import Workspace

    path = Workspace(spark, "rdf").root
    write_nquads(spark.read.parquet(f"{d}/graph_quads.parquet"), path)
    back = read_rdf(spark, path + "/*.nq.gz")
    return back.select(F.col("s.v").alias("s"), "p", F.when(F.col("o.k") > 0, F.col("o.v")).alias("o"), F.col("o.dt").alias("dt"))


def _written(spark: SparkSession, lines: DataFrame, extension: str, **options: object) -> DataFrame:
    from .sources.rdf import read_rdf, write_lines
    from .workspace import Workspace

    path = Workspace(spark, "rdf").root
    write_lines(lines, path, extension, **options)
    back = read_rdf(spark, f"{path}/*.{extension}.gz")
    return back.select(F.col("s.v").alias("s"), "p", F.col("o.v").alias("o"), F.col("o.dt").alias("dt"), F.col("o.lang").alias("lang"), F.col("g.v").alias("g"))


def rdf_read_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Statements with values of every kind, ill-typed ones among them, written as N-Quads files and read again."""
    from .sources.rdf import read_rdf, write_nquads
    from .workspace import Workspace

    path = Workspace(spark, "rdf").root
    write_nquads(spark.read.parquet(f"{d}/attr_quads.parquet"), path)
    back = read_rdf(spark, path + "/*.nq.gz")
    return back.select(F.when(F.col("s.k") == 1, F.col("s.v")).alias("s"), "p", F.when(F.col("o.k") > 0, F.col("o.v")).alias("o"), F.col("o.dt").alias("dt"))


def rdf_read_turtle(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as Turtle files, a document a line, and read again."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    line = F.format_string('@prefix : <http://data.example/ns#> . <http://data.example/customer/%d> :name "%s"@en , \'\'\'%s\'\'\' ; :key %d ; a :Customer .', "c_custkey", "c_name", "c_mktsegment", "c_custkey")
    return _written(spark, c.select(line.alias("value")), "ttl")


def rdf_read_trig(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as TriG files, each market segment a graph, and read again."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    line = F.format_string('@prefix : <http://data.example/ns#> . GRAPH <http://data.example/graph/%s> { <http://data.example/customer/%d> :name "%s" }', F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")), "c_custkey", "c_name")
    return _written(spark, c.select(line.alias("value")), "trig")


def rdf_read_xml(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as RDF/XML, some hundred to a file, and read again."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    node = F.format_string('<x:Customer rdf:about="http://data.example/customer/%d"><x:key rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">%d</x:key><x:name xml:lang="en">%s</x:name></x:Customer>', "c_custkey", "c_custkey", "c_name")
    files = c.groupBy(F.floor(F.col("c_custkey") / 500).alias("file")).agg(F.concat_ws("", F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://data.example/ns#">'), F.array_join(F.collect_list(node), ""), F.lit("</rdf:RDF>")).alias("value"))
    return _written(spark, files.select("value"), "rdf", maxRecordsPerFile=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**SPECS, "result_json": result_json, "rdf_read": rdf_read, "rdf_read_attributes": rdf_read_attributes, "rdf_read_turtle": rdf_read_turtle, "rdf_read_trig": rdf_read_trig, "rdf_read_xml": rdf_read_xml, "result_json_customer": result_json_customer}
SQL: dict[str, str] = {k: s.sql for k, s in SPECS.items() if s.sql}
SQL["rdf_read"] = "SELECT s.v AS s, p, CASE WHEN o.k > 0 THEN o.v END AS o, o.dt AS dt FROM graph_quads"
SQL["result_json"] = """SELECT '{"r":{"value":"http://data.example/region/' || n_regionkey || '","dataType":"http://www.w3.org/2001/XMLSchema#anyURI","language":null},"n":{"value":"' || n_name || '","dataType":"http://www.w3.org/2001/XMLSchema#string","language":null}}' AS value FROM nation"""
SQL["result_json_customer"] = """SELECT '{"n":{"value":"' || c_name || '","dataType":"http://www.w3.org/2001/XMLSchema#string","language":null}}' AS value FROM customer"""
SQL["rdf_read_attributes"] = "SELECT CASE WHEN s.k = 1 THEN s.v END AS s, p, CASE WHEN o.k > 0 THEN o.v END AS o, o.dt AS dt FROM attr_quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"
_TYPE, _OF = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p", "'http://data.example/customer/' || c_custkey AS s"
_KEY = f"SELECT {_OF}, 'http://data.example/ns#key' AS p, CAST(c_custkey AS VARCHAR) AS o, 'xsd:integer' AS dt, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS g FROM customer UNION ALL SELECT {_OF}, {_TYPE}, 'http://data.example/ns#Customer', NULL, NULL, NULL FROM customer UNION ALL SELECT {_OF}, 'http://data.example/ns#name', c_name, 'rdf:langString', 'en', NULL FROM customer"
SQL["rdf_read_turtle"] = f"{_KEY} UNION ALL SELECT {_OF}, 'http://data.example/ns#name', c_mktsegment, 'xsd:string', NULL, NULL FROM customer"
SQL["rdf_read_xml"] = _KEY
SQL["rdf_read_trig"] = f"SELECT {_OF}, 'http://data.example/ns#name' AS p, c_name AS o, 'xsd:string' AS dt, CAST(NULL AS VARCHAR) AS lang, 'http://data.example/graph/' || lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) AS g FROM customer"
