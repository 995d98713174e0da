"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

Placement statistics take 4 partitions and the degree threshold 30.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.columns import INFINITY
from orbweave.functions.tables import shared_dir
from orbweave.operators import algorithms as alg
from orbweave.operators import engine
from orbweave.operators.graph import Graph
from orbweave.operators.program import Direction, Vertex, VertexProgram
from orbweave.plans.fixtures import SQL, edges, graph, least_source
from orbweave.sources import edges as files
from orbweave.sources import reports

PARTS, THRESHOLD = 4, 30
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def base(fixture: str) -> str:
    """Common tables of the oracles: loop-free edges, vertices, both orientations, out-degrees."""
    return f"""WITH RECURSIVE raw AS MATERIALIZED ({SQL[fixture]}),
e AS MATERIALIZED (SELECT src, dst FROM raw WHERE src <> dst),
v AS MATERIALIZED (SELECT src AS id FROM raw UNION SELECT dst FROM raw),
u AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM e UNION ALL SELECT dst, src FROM e),
od AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src),
idg AS MATERIALIZED (SELECT dst, count(*) AS k FROM e GROUP BY dst),
h AS MATERIALIZED (SELECT dst AS id FROM e GROUP BY dst HAVING count(*) > {THRESHOLD})"""


def query(name: str, fixture: str, sql: str, run: Callable[[Graph], DataFrame]) -> None:
    """Register a query that is a function of a fixture's graph, and its SQL after the common tables."""
    QUERIES[name] = lambda spark, sf_dir: run(graph(spark, sf_dir, fixture))
    ORACLE_SQL[name] = base(fixture) + sql


# the graph model
query("edges_clean", "events", " SELECT src, dst FROM e", lambda g: g.edges)
query("vertices", "events", " SELECT id FROM v", lambda g: g.vertices)
query("degrees", "events", " SELECT id, coalesce(idg.k, 0)::BIGINT AS in_degree, coalesce(od.k, 0)::BIGINT AS out_degree FROM v LEFT JOIN idg ON idg.dst = id LEFT JOIN od ON od.src = id", lambda g: g.degrees)
query("in_neighbors", "events", " SELECT dst AS id, string_agg(src::VARCHAR, ',' ORDER BY src) AS neighbors FROM e GROUP BY dst", lambda g: g.in_neighbors())
query("out_neighbors", "events", " SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM e GROUP BY src", lambda g: g.out_neighbors())
query("undirected_edges", "events", " SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw", lambda g: files.undirected(g.raw))
query("partition_sizes", "supply", f""", a AS (SELECT id % {PARTS} AS part, count(*) AS n FROM v GROUP BY 1), b AS (SELECT dst % {PARTS} AS part, count(*) AS n FROM e GROUP BY 1)
SELECT a.part, a.n AS n_vertices, coalesce(b.n, 0)::BIGINT AS n_edges FROM a LEFT JOIN b USING (part)""", lambda g: g.partition_sizes(PARTS))
query("degree_classes", "supply", " SELECT CASE WHEN id IN (SELECT id FROM h) THEN 'high' ELSE 'low' END AS degree_class, count(*) AS n_vertices FROM v GROUP BY 1", lambda g: g.degree_classes(THRESHOLD))
query("edge_placement", "supply", f""", m AS (SELECT src, dst, dst IN (SELECT id FROM h) AS is_high FROM e)
SELECT CASE WHEN is_high THEN src ELSE dst END % {PARTS} AS part, sum(CASE WHEN is_high THEN 0 ELSE 1 END)::BIGINT AS n_low, sum(CASE WHEN is_high THEN 1 ELSE 0 END)::BIGINT AS n_high FROM m GROUP BY 1""", lambda g: g.edge_placement(PARTS, THRESHOLD))
MIRRORS = f""", lm AS (SELECT DISTINCT src, dst % {PARTS} AS part FROM e WHERE src % {PARTS} <> dst % {PARTS} AND dst NOT IN (SELECT id FROM h) AND src NOT IN (SELECT id FROM h))"""
query("mirror_sets", "supply", MIRRORS + " SELECT src AS id, string_agg(part::VARCHAR, ',' ORDER BY part) AS mirrors FROM lm GROUP BY src", lambda g: g.mirror_sets(PARTS, THRESHOLD))
query("load_stats", "supply", MIRRORS + f""" SELECT (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM h)) AS low_master, (SELECT count(*) FROM h) AS high_master,
(SELECT count(*) FROM lm) AS low_mirror, (SELECT count(*) FROM h) * {PARTS - 1} AS high_mirror""", lambda g: g.load_stats(PARTS, THRESHOLD))


# files
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orbweave/{name}-{uuid.uuid4().hex}"


def edges_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "edges-binary")
    files.write_binary(edges(spark, sf_dir, "events"), at)
    return files.read_binary(spark, at)


def edges_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "edges-text")
    files.write_text(edges(spark, sf_dir, "supply"), at)
    return files.read_text(spark, at)


def bench_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of log lines made from the nations: a folder a region, a time a nation."""
    at = _scratch(spark, "bench")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = rows.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("name"), F.explode(F.array(F.concat(F.lit("Total computing time: "), (F.col("n_nationkey") / 4).cast("string"), F.lit(" (s)")), F.lit("Loading time: 9 (s)"))).alias("value"))
    lines.write.partitionBy("name").text(at)
    return reports.bench_average(spark, at).select(F.regexp_replace("name", "^name=", "").alias("name"), "avg")


QUERIES |= {"edges_binary_roundtrip": edges_binary_roundtrip, "edges_from_text": edges_from_text, "bench_average": bench_average}
ORACLE_SQL |= {
    "edges_binary_roundtrip": SQL["events"],
    "edges_from_text": SQL["supply"],
    "bench_average": "SELECT 'region' || n_regionkey AS name, avg(n_nationkey / 4.0) AS avg FROM nation GROUP BY 1",
}


# single phases
class InSum(VertexProgram):
    """Sum of the in-neighbours' ids; the other phase programs differ in direction and aggregate."""

    gather_edges = Direction.IN

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return v.id, F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return nbr.value

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        return total, total != v.value


class OutSum(InSum):
    gather_edges = Direction.OUT


class AllMin(InSum):
    gather_edges = Direction.ALL
    op = staticmethod(F.min)


class AllCount(InSum):
    gather_edges = Direction.ALL

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return F.lit(1).cast("long")


def gathered(program: VertexProgram) -> Callable[[Graph], DataFrame]:
    return lambda g: engine.gather(program, g.edges, engine.initial(program, g))


query("gather_in_sum", "events", " SELECT dst AS id, sum(src)::BIGINT AS acc FROM e GROUP BY dst", gathered(InSum()))
query("gather_out_sum", "events", " SELECT src AS id, sum(dst)::BIGINT AS acc FROM e GROUP BY src", gathered(OutSum()))
query("gather_all_min", "events", " SELECT id, min(nbr) AS acc FROM u GROUP BY id", gathered(AllMin()))
query("gather_all_count", "events", " SELECT id, count(*) AS acc FROM u GROUP BY id", gathered(AllCount()))


def apply_pagerank_step(g: Graph) -> DataFrame:
    return alg.pagerank(g, max_iterations=1).select("id", F.round("rank", 6).alias("rank"))


def scatter_sssp_step(g: Graph) -> DataFrame:
    """The vertices active after one round of shortest paths."""
    program = alg.ShortestPaths(0)
    state = engine.initial(program, g)
    applied = engine.apply(program, state, engine.gather(program, g.edges, state), F.col("v_active"))
    return engine.scatter(program, g.edges, applied)


def init_state(program: VertexProgram) -> Callable[[Graph], DataFrame]:
    return lambda g: engine.initial(program, g).select("id", "value", "active")


PR_STEP = "SELECT e.dst AS id, sum(x.val / od.k) AS m FROM e JOIN r x ON x.id = e.src JOIN od ON od.src = e.src GROUP BY 1"


def pagerank_sql(rounds: int) -> str:
    return f""", r(id, it, val) AS (SELECT id, 0, 1.0::DOUBLE FROM v UNION ALL
SELECT r.id, r.it + 1, 0.85 + 0.15 * coalesce(g.m, 0) FROM r LEFT JOIN ({PR_STEP}) g ON g.id = r.id WHERE r.it < {rounds})
SELECT id, round(val, 6) AS rank FROM r WHERE it = {rounds}"""


query("apply_pagerank_step", "events", pagerank_sql(1), apply_pagerank_step)
query("scatter_sssp_step", "events", " SELECT DISTINCT dst AS id FROM e WHERE src = 0", scatter_sssp_step)
query("init_sssp", "events", f" SELECT id, {INFINITY}::BIGINT AS value, id = 0 AS active FROM v", init_state(alg.ShortestPaths(0)))
query("init_cc", "events", " SELECT id, id AS value, true AS active FROM v", init_state(alg.Components()))


# algorithms
def ranks(g: Graph) -> DataFrame:
    return alg.pagerank(g).select("id", F.round("rank", 6).alias("rank"))


def frontier_sql(rounds: int) -> str:
    """Active vertices of PageRank: those reached from an active one; a round without any is the last."""
    return f""", a(it, id) AS (SELECT DISTINCT 0, dst FROM e UNION SELECT it + 1, e.dst FROM a JOIN e ON e.src = a.id WHERE it < {rounds - 1}),
c AS (SELECT it, count(*) AS n FROM a GROUP BY it)
SELECT it::BIGINT AS iteration, n AS active FROM c UNION ALL SELECT coalesce(max(it) + 1, 0)::BIGINT, 0::BIGINT FROM c HAVING coalesce(max(it), -1) < {rounds - 1}"""


def sssp_sql(source: str) -> str:
    return f""", s(id, dist) AS (SELECT id, 0 FROM v WHERE id = {source} UNION SELECT e.dst, s.dist + 1 FROM s JOIN e ON e.src = s.id WHERE s.dist < 63)
SELECT v.id, coalesce(min(dist), {INFINITY})::BIGINT AS distance FROM v LEFT JOIN s ON s.id = v.id GROUP BY v.id"""


CC_ROUNDS = f""", r(id, it, val) AS (SELECT id, 0, id FROM v UNION ALL
SELECT r.id, r.it + 1, least(r.val, coalesce(g.m, {INFINITY}), {INFINITY}) FROM r LEFT JOIN (SELECT u.id, min(x.val) AS m FROM u JOIN r x ON x.id = u.nbr GROUP BY 1) g ON g.id = r.id WHERE r.it < 32)"""
CC_ACTIVE = """, a AS (SELECT cur.it - 1 AS it, count(DISTINCT u.nbr) AS n FROM r cur JOIN r prev ON prev.id = cur.id AND prev.it = cur.it - 1 AND cur.val < prev.val
JOIN u ON u.id = cur.id JOIN r x ON x.id = u.nbr AND x.it = cur.it AND cur.val < x.val GROUP BY 1),
f AS (SELECT i AS it, coalesce(a.n, 0) AS n FROM (SELECT unnest(generate_series(0, 31)) AS i) LEFT JOIN a ON a.it = i)
SELECT it::BIGINT AS iteration, n::BIGINT AS active FROM f WHERE it <= coalesce((SELECT min(it) FROM f WHERE n = 0), 31)"""


def kcore_sql(k: int) -> str:
    return f""", r(id, it, val) AS (SELECT id, 0, {k}::BIGINT FROM v UNION ALL
SELECT r.id, r.it + 1, CASE WHEN r.val >= {k} THEN coalesce(g.m, 0) ELSE r.val END FROM r LEFT JOIN (SELECT u.id, count(*) AS m FROM u JOIN r x ON x.id = u.nbr AND x.val >= {k} GROUP BY 1) g ON g.id = r.id WHERE r.it < 50)"""


query("pagerank", "events", pagerank_sql(32), ranks)
query("pagerank_dag", "supply", pagerank_sql(32), ranks)
query("pagerank_iterations", "chain", frontier_sql(32), lambda g: alg.iterations(g, alg.PageRank()))
query("pagerank_iterations_dag", "supply", frontier_sql(32), lambda g: alg.iterations(g, alg.PageRank()))
query("sssp", "events", sssp_sql("0"), lambda g: alg.shortest_paths(g, 0))
query("sssp_dag", "supply", sssp_sql("(SELECT min(src) FROM e)"), lambda g: alg.shortest_paths(g, least_source(g)))
query("sssp_deep", "chain", sssp_sql("0"), lambda g: alg.shortest_paths(g, 0))
query("sssp_missing_source", "events", sssp_sql("-1"), lambda g: alg.shortest_paths(g, -1))
query("vec_sssp", "events", sssp_sql("0"), lambda g: alg.vector_shortest_paths(g, 0))
query("cc", "supply", CC_ROUNDS + " SELECT id, val AS component FROM r WHERE it = 32", alg.connected_components)
query("cc_truncated", "chain", CC_ROUNDS + " SELECT id, val AS component FROM r WHERE it = 32", alg.connected_components)
query("cc_iterations", "chain", CC_ROUNDS + CC_ACTIVE, lambda g: alg.iterations(g, alg.Components()))
query("kcore", "events", kcore_sql(120) + " SELECT id, val AS core_value FROM r WHERE it = 50", lambda g: alg.k_core(g, 120))
query("kcore_peel", "chain", kcore_sql(2) + " SELECT id, val AS core_value FROM r WHERE it = 50", lambda g: alg.k_core(g, 2))
query("kcore_members", "supply", kcore_sql(20) + " SELECT id, val AS core_value FROM r WHERE it = 50 AND val >= 20", lambda g: alg.k_core(g, 20).filter("core_value >= 20"))
query("cc_dot", "supply", CC_ROUNDS + """, l AS (SELECT id, dense_rank() OVER (ORDER BY val) AS n FROM r WHERE it = 32)
SELECT '  ' || id || ' [front=white, color=' || (['red', 'orange', 'yellow', 'green', 'cyan', 'blue', 'purple', 'black'])[n] || ']' AS line FROM l""", lambda g: reports.component_dot(alg.connected_components(g)))
query("kcore_dot", "supply", kcore_sql(20) + " SELECT '  ' || id || ' [front=white, color=red]' AS line FROM r WHERE it = 50 AND val >= 20", lambda g: reports.core_dot(alg.k_core(g, 20), 20))


# users' own programs
class InDegree(VertexProgram):
    """One round that counts in-edges."""

    scatter_edges = Direction.NONE

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return F.lit(0), F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return F.lit(1).cast("long")

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        return total, total != v.value


class MaxOfThree(VertexProgram):
    """Three rounds of passing the largest id along edges; ``gather`` looks at both ends."""

    iterations = 3
    gather_uses_vertex = True

    def init(self, v: Vertex) -> tuple[Column, Column]:
        return v.id, F.lit(True)

    def gather(self, v: Vertex, nbr: Vertex) -> Column:
        return F.greatest(v.value, nbr.value)

    op = staticmethod(F.max)

    def apply(self, v: Vertex, total: Column) -> tuple[Column, Column]:
        new = F.greatest(v.value, total)
        return new, new != v.value

    def scatter(self, v: Vertex, nbr: Vertex) -> Column:
        return v.value > nbr.value


query("custom_indegree_program", "events", " SELECT id, coalesce(idg.k, 0)::BIGINT AS value FROM v LEFT JOIN idg ON idg.dst = id", lambda g: engine.run(g, InDegree()).vertices.select("id", "value"))
query("custom_max_program", "events", """, r(id, it, val) AS (SELECT id, 0, id FROM v UNION ALL
SELECT r.id, r.it + 1, greatest(r.val, coalesce(g.m, r.val)) FROM r LEFT JOIN (SELECT e.dst AS id, max(x.val) AS m FROM e JOIN r x ON x.id = e.src GROUP BY 1) g ON g.id = r.id WHERE r.it < 3)
SELECT id, val AS value FROM r WHERE it = 3""", lambda g: engine.run(g, MaxOfThree()).vertices.select("id", "value"))
