"""The registered queries of the architecture engine, each with the SQL that gives the same rows.

Every query works on the whole tables of ``sf_dir``, which ``sources.surrogate`` reads as instances and pairs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import api
from .functions.expressions import corrected_count, four_significant
from .operators import documents, overlap, reports, score_store
from .operators import maintenance as M
from .options import ScoringOptions
from .plans import architecture as A
from .plans import linearise as L
from .plans import greedy, scoring, weights
from .sources import predictors, text
from .sources import surrogate as S
from .storage import cut, new_path

#: The surrogate's e-values are discounts; its cut is 0.08.
OPTIONS = ScoringOptions(instance_evalue=0.08, count_correction="loge")
CONSTRAINED = replace(OPTIONS, constraints={"pfam": 0.4, "smart_PROMO": 0.1})
WITH_CLANS = replace(OPTIONS, weight_multiplicity=0.6, weight_clan=0.2, weight_position=0.2)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

INST = """inst AS (SELECT l_orderkey AS protein_id, 400 AS length, tool, tool IN ('pfam', 'smart') AS linearized, tool || '_' || p_type AS feature,
  CASE WHEN tool = 'pfam' THEN 'CL1' WHEN tool || '_' || p_type = 'smart_MEDIUM' THEN 'CL2' END AS clan,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS i,
  CAST(1 + (l_suppkey * 7 + l_linenumber * 41) % 300 AS INTEGER) AS start, CAST(1 + (l_suppkey * 7 + l_linenumber * 41) % 300 + 10 + CAST(l_quantity AS INTEGER) AS INTEGER) AS stop, l_discount AS evalue
  FROM (SELECT *, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'pfam' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'smart' ELSE 'tmhmm' END AS tool
        FROM lineitem JOIN part ON l_partkey = p_partkey) x)"""
ARCH = INST + """, arch AS (SELECT *, CAST(start + stop AS DOUBLE) / 2.0 / length AS position FROM inst WHERE evalue IS NULL OR evalue <= 0.08)"""
LIN = ARCH + """, lin AS (SELECT *, CAST(row_number() OVER (PARTITION BY protein_id ORDER BY stop, i) - 1 AS INTEGER) AS rank FROM arch WHERE linearized)"""
EDGE = LIN + """, edge AS (SELECT a.protein_id, a.rank AS u, b.rank AS v FROM lin a JOIN lin b ON a.protein_id = b.protein_id AND a.rank < b.rank
  AND a.stop - b.start + 1 <= 0)"""
RED = EDGE + """, direct AS (SELECT * FROM edge EXCEPT SELECT x.protein_id, x.u, y.v FROM edge x JOIN edge y ON x.protein_id = y.protein_id AND x.v = y.u),
red AS (SELECT protein_id, u, v FROM direct
  UNION ALL SELECT protein_id, -1, rank FROM lin WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.protein_id = lin.protein_id AND e.v = lin.rank)
  UNION ALL SELECT protein_id, rank, 1000000 FROM lin WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.protein_id = lin.protein_id AND e.u = lin.rank)
  UNION ALL SELECT o_orderkey, -1, 1000000 FROM orders WHERE o_orderkey NOT IN (SELECT protein_id FROM lin))"""
PATHS = "RECURSIVE " + RED + """, walk AS (SELECT o_orderkey AS protein_id, -1 AS node, CAST([] AS INTEGER[]) AS path FROM orders
  UNION ALL SELECT w.protein_id, r.v, CASE WHEN r.v = 1000000 THEN w.path ELSE list_append(w.path, r.v) END FROM walk w JOIN red r ON w.protein_id = r.protein_id AND w.node = r.u),
paths AS (SELECT protein_id, path FROM walk WHERE node = 1000000)"""
PAIRS = """, pairs AS (SELECT * FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seed, o_orderkey AS query FROM orders) WHERE seed IS NOT NULL)"""


def _score_sql(w_ms: float, w_cs: float, w_ps: float, weights_sql: str | None = None, distance: bool = False, also: str = "", constraints: dict | None = None, default: float = 0.5) -> str:
    """CTEs up to ``best``: seed, query and the best pair of paths with its scores, for all pairs."""
    weight = "1.0" if weights_sql is None and not distance else f"coalesce(wt.weight, {default if distance else 1.0})"
    wjoin = "" if weights_sql is None else ("LEFT JOIN wt ON wt.feature = x.feature" if distance else "LEFT JOIN wt ON wt.protein_id = x.seed AND wt.feature = x.feature")
    if distance:
        totals = "CASE WHEN sum(w) > 1 THEN 1 / sum(w) ELSE 1.0 END"
        parts = ", ".join(f"1 - sum((1 - {a}) * w) * any_value(scale) AS {b}" for a, b in (("share", "ms"), ("match", "ps"), ("ratio", "ls")))
        clan = "1 - sum(CASE WHEN n_q IS NOT NULL THEN 1 - least(n_q / n_s, 1.0) ELSE 0 END) / count(*)"
        none = "1.0"
    else:
        totals = "CASE WHEN sum(w) > 0 THEN 1 / sum(w) ELSE 0.0 END"
        parts = ", ".join(f"sum({a} * w) * any_value(scale) AS {b}" for a, b in (("share", "ms"), ("match", "ps"), ("ratio", "ls")))
        clan = "sum(CASE WHEN n_q IS NOT NULL THEN n_s * n_q / (greatest(n_s, n_q) * greatest(n_s, n_q)) ELSE 0 END) / count(*)"
        none = "0.0"
    fixed = "SELECT * FROM raw_part"
    if constraints:
        tools = {k: v for k, v in constraints.items() if "_" not in k}
        alone = ", ".join(f"'{k}'" for k in constraints)
        limit = "CASE split_part(feature, '_', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tools.items()) + " END"
        free = f"feature NOT IN ({alone}) AND split_part(feature, '_', 1) IN ('pfam', 'smart')"
        fixed = f"""SELECT * EXCLUDE (w, lim, total, free), CASE WHEN free AND total > 0 AND total < lim THEN w * (lim / total) ELSE w END AS w
  FROM (SELECT *, {free} AS free, {limit} AS lim, sum(CASE WHEN {free} THEN w * n END) OVER (PARTITION BY seed, query, sp, qp, split_part(feature, '_', 1)) AS total FROM raw_part)"""
    wt = "" if weights_sql is None else f", wt AS ({weights_sql})"
    return PATHS + PAIRS + also + wt + f""",
n_lin AS (SELECT o_orderkey AS protein_id, count(rank) AS n FROM orders LEFT JOIN lin ON protein_id = o_orderkey GROUP BY o_orderkey),
whole AS (SELECT protein_id, list((tool, feature, start, stop, evalue) ORDER BY tool, feature, start, stop, evalue) AS content FROM inst GROUP BY protein_id),
same AS (SELECT seed, query FROM pairs JOIN whole a ON a.protein_id = seed JOIN whole b ON b.protein_id = query AND a.content = b.content JOIN n_lin ON n_lin.protein_id = query AND n > 0),
allp AS (SELECT protein_id, list(rank ORDER BY rank) AS path FROM lin GROUP BY protein_id),
lastp AS (SELECT protein_id, max(path) AS path FROM paths GROUP BY protein_id),
cand AS (
  SELECT seed, query, s.path AS sp, q.path AS qp FROM pairs JOIN n_lin ON n_lin.protein_id = query AND n > 0 JOIN paths s ON s.protein_id = seed JOIN paths q ON q.protein_id = query
    WHERE NOT EXISTS (SELECT 1 FROM same WHERE same.seed = pairs.seed AND same.query = pairs.query)
  UNION ALL SELECT pairs.seed, pairs.query, s.path, q.path FROM pairs JOIN n_lin ON n_lin.protein_id = query AND n = 0 JOIN lastp s ON s.protein_id = seed JOIN lastp q ON q.protein_id = query
  UNION ALL SELECT seed, query, s.path, q.path FROM same JOIN allp s ON s.protein_id = seed JOIN allp q ON q.protein_id = query),
member AS (SELECT p.protein_id, p.path, l.feature, l.clan, 0 AS kind, l.rank AS k, l.position, l.stop - l.start + 1 AS len FROM (SELECT * FROM paths UNION SELECT * FROM allp) p JOIN lin l ON l.protein_id = p.protein_id AND list_contains(p.path, l.rank)
  UNION ALL SELECT p.protein_id, p.path, a.feature, NULL, 1, a.i, a.position, a.stop - a.start + 1 FROM (SELECT * FROM paths UNION SELECT * FROM allp) p JOIN arch a ON a.protein_id = p.protein_id AND NOT a.linearized),
nf AS (SELECT protein_id, path, feature, count(*) AS n FROM member GROUP BY ALL),
near AS (SELECT c.seed, c.query, c.sp, c.qp, s.feature, s.k, max(1 - abs(s.position - q.position)) AS match,
    arg_max(least(q.len, s.len) / greatest(q.len, s.len), (1 - abs(s.position - q.position), -q.k)) AS ratio
  FROM cand c JOIN member s ON s.protein_id = c.seed AND s.path = c.sp JOIN member q ON q.protein_id = c.query AND q.path = c.qp AND q.feature = s.feature GROUP BY ALL),
feat AS (SELECT seed, query, sp, qp, feature, sum(match) / count(*) AS match, sum(ratio) / count(*) AS ratio FROM near GROUP BY ALL),
raw_part AS (SELECT x.*, {weight} AS w FROM (SELECT c.seed, c.query, c.sp, c.qp, s.feature, s.n, CASE WHEN q.n IS NULL THEN 0.0 ELSE least(q.n / s.n, 1.0) END AS share, coalesce(f.match, 0.0) AS match, coalesce(f.ratio, 0.0) AS ratio
    FROM cand c JOIN nf s ON s.protein_id = c.seed AND s.path = c.sp
    LEFT JOIN nf q ON q.protein_id = c.query AND q.path = c.qp AND q.feature = s.feature
    LEFT JOIN feat f ON f.seed = c.seed AND f.query = c.query AND f.sp = c.sp AND f.qp = c.qp AND f.feature = s.feature) x {wjoin}),
part AS ({fixed}),
scaled AS (SELECT seed, query, sp, qp, {totals} AS scale FROM part GROUP BY ALL),
three AS (SELECT seed, query, sp, qp, {parts} FROM part JOIN scaled USING (seed, query, sp, qp) GROUP BY ALL),
nc AS (SELECT protein_id, path, clan, count(*) AS n FROM member WHERE clan IS NOT NULL GROUP BY ALL),
clans AS (SELECT seed, query, sp, qp, {clan} AS cs FROM (SELECT c.*, s.clan, s.n AS n_s, q.n AS n_q FROM cand c JOIN nc s ON s.protein_id = c.seed AND s.path = c.sp
    LEFT JOIN nc q ON q.protein_id = c.query AND q.path = c.qp AND q.clan = s.clan) GROUP BY ALL),
every AS (SELECT cand.*, coalesce(ms, {none}) AS ms, coalesce(ps, {none}) AS ps, coalesce(ls, {none}) AS ls, coalesce(cs, 0.0) AS cs,
    coalesce(ms, {none}) * {w_ms} + coalesce(cs, 0.0) * {w_cs} + coalesce(ps, {none}) * {w_ps} AS final
  FROM cand LEFT JOIN three USING (seed, query, sp, qp) LEFT JOIN clans USING (seed, query, sp, qp)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, query ORDER BY round(final, 10) DESC, qp, sp) AS nth FROM every) WHERE nth = 1)"""


SCORES = ", ".join(f"round({c}, 12) + 0.0 AS {c}" for c in ("final", "ms", "ps", "cs", "ls"))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 12) for c in cols})


def _arch(spark, d):
    return A.architecture(S.instances(spark, d), OPTIONS)


def _prepared(spark, d, options=OPTIONS):
    return scoring.prepare(A.proteins(S.universe(spark, d), S.instances(spark, d), options), options)


# architectures


@query("arch_filtered", f"WITH {ARCH} SELECT protein_id, i, tool, feature, start, stop, position FROM arch")
def arch_filtered(spark, d):
    return _arch(spark, d).select("protein_id", "i", "tool", "feature", "start", "stop", "position")


@query("arch_ranked", f"WITH {LIN} SELECT protein_id, rank, i, feature, start, stop FROM lin")
def arch_ranked(spark, d):
    return A.ranked(_arch(spark, d)).select("protein_id", "rank", "i", "feature", "start", "stop")


@query("arch_both_sides", f"WITH {LIN} SELECT protein_id, 'F' AS kind, CAST(count(*) AS BIGINT) AS n FROM lin GROUP BY 1 UNION ALL SELECT protein_id, 'O', count(*) FROM arch WHERE NOT linearized GROUP BY 1")
def arch_both_sides(spark, d):
    p = A.proteins(S.universe(spark, d), S.instances(spark, d), OPTIONS)
    rows = p.select("protein_id", F.explode(F.array(F.struct(F.lit("F").alias("kind"), F.size("lin").cast("long").alias("n")), F.struct(F.lit("O").alias("kind"), F.size("normal").cast("long").alias("n")))).alias("r"))
    return rows.select("protein_id", "r.*").where("n > 0")


@query("no_linearisation", f"WITH {ARCH} SELECT protein_id, count(*) AS n, CAST(sum(CAST(linearized AS INTEGER) * 0) AS BIGINT) AS n_linearized FROM arch GROUP BY 1")
def no_linearisation(spark, d):
    a = A.architecture(S.instances(spark, d), replace(OPTIONS, linearize=False))
    return a.groupBy("protein_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("linearized").cast("int")).alias("n_linearized"))


@query("feature_counts", f"WITH {INST} SELECT feature, count(*) AS n FROM inst GROUP BY 1")
def feature_counts(spark, d):
    return A.feature_counts(S.instances(spark, d))


@query("clan_counts", f"WITH {ARCH} SELECT protein_id, clan, count(*) AS n FROM arch GROUP BY 1, 2")
def clan_counts(spark, d):
    return A.clan_counts(_arch(spark, d))


@query("parse_time_prune", f"WITH {INST} SELECT protein_id, feature, i, start, stop FROM inst WHERE evalue <= 0.03")
def parse_time_prune(spark, d):
    return A.pruned(S.instances(spark, d), 0.001, 0.03).select("protein_id", "feature", "i", "start", "stop")


@query("id_restriction", f"WITH {ARCH} SELECT protein_id, count(*) AS n FROM arch WHERE protein_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def id_restriction(spark, d):
    ids = S.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("protein_id"))
    known = M.check_ids(ids, S.universe(spark, d))
    return _arch(spark, d).join(known, "protein_id", "left_semi").groupBy("protein_id").agg(F.count(F.lit(1)).alias("n"))


# pairs


@query("pairs_listed", f"WITH {INST}{PAIRS} SELECT seed, query FROM pairs")
def pairs_listed(spark, d):
    return S.pairs(spark, d)


@query("pairs_allvsall", "SELECT a.s_suppkey AS seed, b.s_suppkey AS query FROM supplier a CROSS JOIN supplier b")
def pairs_allvsall(spark, d):
    ids = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("protein_id"))
    return api.all_pairs(ids, ids)


@query("pairs_allvsall_groups", "SELECT a.o_orderkey AS seed, b.o_orderkey AS query FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def pairs_allvsall_groups(spark, d):
    """All against all inside each group, of all proteins."""
    o = S.read(spark, d, "orders")
    return o.select("o_custkey", F.col("o_orderkey").alias("seed")).join(o.select("o_custkey", F.col("o_orderkey").alias("query")), "o_custkey").select("seed", "query")


OLD = ", old AS (SELECT CASE WHEN seed % 2 = 0 THEN query ELSE seed END AS seed, CASE WHEN seed % 2 = 0 THEN seed ELSE query END AS query FROM pairs WHERE (seed + query) % 3 = 0)"


def _old(p: DataFrame) -> DataFrame:
    even = F.col("seed") % 2 == 0
    return p.where("(seed + query) % 3 = 0").select(F.when(even, F.col("query")).otherwise(F.col("seed")).alias("seed"), F.when(even, F.col("seed")).otherwise(F.col("query")).alias("query"))


@query("old_results_antijoin", f"WITH {INST}{PAIRS}{OLD} SELECT seed, query FROM pairs WHERE NOT EXISTS (SELECT 1 FROM old WHERE least(old.seed, old.query) = least(pairs.seed, pairs.query) AND greatest(old.seed, old.query) = greatest(pairs.seed, pairs.query))")
def old_results_antijoin(spark, d):
    p = S.pairs(spark, d)
    return M.without_old(p, _old(p))


@query("pair_sample", f"WITH {INST}{PAIRS} SELECT seed, query FROM pairs ORDER BY md5('1:' || CAST(seed AS VARCHAR) || ':' || CAST(query AS VARCHAR)), seed, query LIMIT 100")
def pair_sample(spark, d):
    return M.sample_pairs(S.pairs(spark, d), 100)


_TWINS = "twin AS (SELECT protein_id, tool, feature, start, stop, evalue FROM inst UNION ALL SELECT -1 - protein_id, tool, feature, start, stop, CASE WHEN protein_id % 3 = 0 THEN evalue + 1 ELSE evalue END FROM inst)"


@query("identity_pairs", f"WITH {INST}, {_TWINS}, w AS (SELECT protein_id, list((tool, feature, start, stop, evalue) ORDER BY tool, feature, start, stop, evalue) AS c FROM twin GROUP BY 1) SELECT a.protein_id AS seed, b.protein_id AS query FROM w a JOIN w b ON b.protein_id = -1 - a.protein_id AND a.c = b.c WHERE a.protein_id >= 0")
def identity_pairs(spark, d):
    """Each protein and a twin, which for every third one has other e-values."""
    rows = S.instances(spark, d).select("protein_id", "tool", "feature", "start", "stop", "evalue")
    other = F.when(F.col("protein_id") % 3 == 0, F.col("evalue") + 1).otherwise(F.col("evalue"))
    twins = rows.withColumn("evalue", other).withColumn("protein_id", -1 - F.col("protein_id"))
    pairs = rows.select(F.col("protein_id").alias("seed"), (-1 - F.col("protein_id")).alias("query")).distinct()
    return M.identical_pairs(pairs, rows.union(twins))


# weights

_RAW = "counts AS (SELECT feature, {expr} AS n FROM (SELECT feature, CAST(count(*) AS DOUBLE) AS c FROM inst GROUP BY 1)), have AS (SELECT DISTINCT protein_id, feature FROM inst), raw AS (SELECT protein_id, feature, sum(n) OVER (PARTITION BY protein_id) / n AS raw FROM have JOIN counts USING (feature))"
_CORRECTED = {"loge": "round_even(ln(c), 0) + 1", "log10": "round_even(log10(c), 0) + 1", "root4": "round_even(pow(c, 0.25), 0)", "root8": "round_even(pow(c, 0.125), 0)"}


def _weights_query(method: str):
    def run(spark, d):
        rows = S.instances(spark, d)
        return _rounded(weights.frequency_weights(rows, A.feature_counts(rows), replace(OPTIONS, count_correction=method)), "weight")

    return run


for _m, _e in _CORRECTED.items():
    query(f"weights_{_m}", f"WITH {INST}, {_RAW.format(expr=_e)} SELECT protein_id, feature, round(raw / sum(raw) OVER (PARTITION BY protein_id), 12) AS weight FROM raw")(_weights_query(_m))


@query("weights_uniform", f"WITH {INST}, have AS (SELECT DISTINCT protein_id, feature FROM inst) SELECT protein_id, feature, round(1.0 / CAST(count(*) OVER (PARTITION BY protein_id) AS DOUBLE), 12) AS weight FROM have")
def weights_uniform(spark, d):
    return _rounded(weights.uniform_weights(S.instances(spark, d)), "weight")


@query("count_correction", f"WITH {INST}, c AS (SELECT feature, CAST(count(*) AS DOUBLE) AS c FROM inst GROUP BY 1) SELECT feature, {', '.join(f'CAST({e} AS INTEGER) AS {m}' for m, e in _CORRECTED.items())} FROM c")
def count_correction(spark, d):
    return A.feature_counts(S.instances(spark, d)).select("feature", *[corrected_count(F.col("n"), m).alias(m) for m in _CORRECTED])


CONSTRAINED_SQL = f"""WITH {INST}, {_RAW.format(expr=_CORRECTED['loge'])},
g AS (SELECT protein_id, feature, n, CASE WHEN feature = 'smart_PROMO' THEN 'f' WHEN feature LIKE 'pfam%' THEN 't' ELSE 'r' END AS grp FROM have JOIN counts USING (feature)),
r AS (SELECT *, sum(n) OVER (PARTITION BY protein_id, grp) / n AS raw2 FROM g),
s AS (SELECT *, raw2 / sum(raw2) OVER (PARTITION BY protein_id, grp) AS share, max(CASE grp WHEN 'f' THEN 0.1 ELSE 0 END) OVER (PARTITION BY protein_id) + max(CASE grp WHEN 't' THEN 0.4 ELSE 0 END) OVER (PARTITION BY protein_id) AS filled FROM r),
cw AS (SELECT protein_id, feature, CASE grp WHEN 'f' THEN 0.1 WHEN 't' THEN share * 0.4 ELSE share * (1.0 - filled) END AS weight FROM s)"""


@query("weights_constrained", CONSTRAINED_SQL + " SELECT protein_id, feature, round(weight, 12) AS weight FROM cw")
def weights_constrained(spark, d):
    rows = S.instances(spark, d)
    return _rounded(weights.constrained_weights(rows, A.feature_counts(rows), CONSTRAINED), "weight")


@query("weights_rescaled", CONSTRAINED_SQL + """, kept AS (SELECT cw.protein_id, cw.feature, weight FROM cw JOIN (SELECT DISTINCT protein_id, feature FROM inst WHERE evalue <= 0.08) k USING (protein_id, feature)),
t AS (SELECT *, sum(CASE WHEN feature LIKE 'pfam%' THEN weight END) OVER (PARTITION BY protein_id, split_part(feature, '_', 1)) AS total FROM kept)
SELECT protein_id, feature, round(CASE WHEN total > 0 AND total < 0.4 THEN weight * (0.4 / total) ELSE weight END, 12) AS weight FROM t""")
def weights_rescaled(spark, d):
    rows = S.instances(spark, d)
    w = weights.constrained_weights(rows, A.feature_counts(rows), CONSTRAINED)
    return _rounded(weights.rescaled_weights(w, _arch(spark, d), CONSTRAINED), "weight")


# graph


@query("interval_precedence", f"WITH {EDGE} SELECT protein_id, u, v FROM edge")
def interval_precedence(spark, d):
    return L.precedence(A.ranked(_arch(spark, d)), OPTIONS)


@query("interval_precedence_overlap", f"WITH {LIN} SELECT a.protein_id, a.rank AS u, b.rank AS v FROM lin a JOIN lin b ON a.protein_id = b.protein_id AND a.rank < b.rank AND a.stop - b.start + 1 <= 20 AND a.stop - b.start + 1 <= 0.4 * (a.stop - a.start) AND a.stop - b.start + 1 <= 0.4 * (b.stop - b.start)")
def interval_precedence_overlap(spark, d):
    return L.precedence(A.ranked(_arch(spark, d)), replace(OPTIONS, max_overlap=20))


@query("graph_reduced", f"WITH {RED} SELECT protein_id, u, v FROM red")
def graph_reduced(spark, d):
    return L.reduced(L.with_predecessors(A.proteins(S.universe(spark, d), S.instances(spark, d), OPTIONS), OPTIONS))


_OVERLAPPING = replace(OPTIONS, max_overlap=20)


@query(
    "graph_reduced_overlap",
    f"""WITH RECURSIVE {LIN}, edge AS (SELECT a.protein_id, a.rank AS u, b.rank AS v FROM lin a JOIN lin b ON a.protein_id = b.protein_id AND a.rank < b.rank
  AND a.stop - b.start + 1 <= 20 AND a.stop - b.start + 1 <= 0.4 * (a.stop - a.start) AND a.stop - b.start + 1 <= 0.4 * (b.stop - b.start)),
reach AS (SELECT protein_id, u, v FROM edge UNION SELECT reach.protein_id, reach.u, edge.v FROM reach JOIN edge ON edge.protein_id = reach.protein_id AND edge.u = reach.v)
SELECT protein_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v FROM edge WHERE NOT EXISTS (SELECT 1 FROM edge e JOIN reach r ON r.protein_id = e.protein_id AND r.u = e.v WHERE e.protein_id = edge.protein_id AND e.u = edge.u AND r.v = edge.v)
UNION ALL SELECT protein_id, -1, CAST(rank AS INTEGER) FROM lin WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.protein_id = lin.protein_id AND edge.v = lin.rank)
UNION ALL SELECT protein_id, CAST(rank AS INTEGER), 1000000 FROM lin WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.protein_id = lin.protein_id AND edge.u = lin.rank)
UNION ALL SELECT o_orderkey, -1, 1000000 FROM orders WHERE o_orderkey NOT IN (SELECT protein_id FROM lin)""",
)
def graph_reduced_overlap(spark, d):
    """With an allowed overlap an instance may follow another without all that follow it following the first."""
    return L.reduced(L.with_predecessors(A.proteins(S.universe(spark, d), S.instances(spark, d), _OVERLAPPING), _OVERLAPPING))



@query("path_counts", f"WITH {PATHS} SELECT protein_id, count(*) AS n_paths FROM paths GROUP BY 1")
def path_counts(spark, d):
    return _prepared(spark, d).select("protein_id", "n_paths")


@query("paths_enumerated", f"WITH {PATHS} SELECT protein_id, array_to_string(path, ',') AS path FROM paths")
def paths_enumerated(spark, d):
    p = L.with_paths(L.routed(_prepared(spark, d), OPTIONS, False).where("not greedy"))
    return p.select("protein_id", F.explode("paths").alias("p")).select("protein_id", F.concat_ws(",", F.col("p").cast("array<string>")).alias("path"))


_STEPS = """nexts AS (SELECT protein_id, u, count(*) AS n, min(v) AS first FROM red WHERE v < 1000000 GROUP BY 1, 2),
steps AS (SELECT o_orderkey AS protein_id, -1 AS node, CAST(0 AS BIGINT) AS total FROM orders
  UNION ALL SELECT s.protein_id, n.first, s.total + CASE WHEN n.n > 1 THEN n.n ELSE 0 END FROM steps s JOIN nexts n ON n.protein_id = s.protein_id AND n.u = s.node)"""


@query("complexity", f"WITH {PATHS}, {_STEPS} SELECT protein_id, n_paths, greedy_steps FROM (SELECT protein_id, count(*) AS n_paths FROM paths GROUP BY 1) JOIN (SELECT protein_id, max(total) AS greedy_steps FROM steps GROUP BY 1) USING (protein_id)")
def complexity(spark, d):
    return L.complexity(_prepared(spark, d))


@query("route_mode", f"WITH {PATHS} SELECT protein_id, count(*) AS n_paths, any_value(n) >= 6 OR count(*) > 10 AS seed_greedy, any_value(n) > 6 OR count(*) > 10 AS query_greedy FROM paths JOIN (SELECT o_orderkey AS protein_id, count(rank) AS n FROM orders LEFT JOIN lin ON protein_id = o_orderkey GROUP BY 1) USING (protein_id) GROUP BY 1")
def route_mode(spark, d):
    o = replace(OPTIONS, max_features=6, max_paths=10)
    p = _prepared(spark, d, o)
    s = L.routed(p, o, True).withColumnRenamed("greedy", "seed_greedy")
    return L.routed(s, o, False).select("protein_id", "n_paths", "seed_greedy", F.col("greedy").alias("query_greedy"))


@query("path_limit_na", f"WITH {PATHS}{PAIRS}, n AS (SELECT protein_id, count(*) AS n FROM paths GROUP BY 1) SELECT seed, query FROM pairs JOIN n a ON a.protein_id = seed JOIN n b ON b.protein_id = query WHERE a.n > 10 OR b.n > 10")
def path_limit_na(spark, d):
    p, o = _prepared(spark, d), replace(OPTIONS, paths_limit=10)
    return scoring.score_pairs(S.pairs(spark, d), p, p, o).where("final is null").select("seed", "query")


# scores without linearization

#: A share as score files print it: four significant digits.
_FOUR = "CASE WHEN {0} = 0 THEN '0.0' ELSE CAST(round({0}, CAST(3 - floor(log10({0})) AS INTEGER)) AS VARCHAR) END"
UNLIN = f"""WITH {ARCH}{PAIRS}, s AS (SELECT seed, query, a.feature, a.i, a.position AS sp, a.stop - a.start + 1 AS sl, q.i AS qi, q.position AS qp, q.stop - q.start + 1 AS ql
  FROM pairs JOIN arch a ON a.protein_id = seed LEFT JOIN arch q ON q.protein_id = query AND q.feature = a.feature),
n AS (SELECT seed, query, feature, i, count(qi) AS n_q, max(1 - abs(sp - qp)) AS match, arg_max(least(sl, ql) / greatest(sl, ql), (1 - abs(sp - qp), -qi)) FILTER (qi IS NOT NULL) AS ratio FROM s GROUP BY ALL),
f AS (SELECT seed, query, feature, count(*) AS n_s, max(n_q) AS n_q, avg(coalesce(match, 0.0)) AS p, avg(coalesce(ratio, 0.0)) AS l FROM n GROUP BY ALL),
u AS (SELECT seed, query, avg(least(n_q / n_s, 1.0)) AS ms, avg(p) AS ps, avg(l) AS ls FROM f GROUP BY ALL)"""


def _unlinearized(spark, d):
    return scoring.unlinearized_scores(S.pairs(spark, d), _arch(spark, d))


for _c in ("ms", "ps", "ls"):
    query(f"{_c}_unlinearised", UNLIN + f" SELECT seed, query, round({_c}, 12) AS {_c} FROM u")(lambda spark, d, c=_c: _rounded(_unlinearized(spark, d).select("seed", "query", c), c))


@query("score_unlinearised", UNLIN + " SELECT seed, query, round(ms * 0.7 + ps * 0.3, 12) AS final, round(ms, 12) AS ms, round(ps, 12) AS ps, round(ls, 12) AS ls FROM u")
def score_unlinearised(spark, d):
    u = _unlinearized(spark, d)
    return _rounded(u.select("seed", "query", (F.col("ms") * 0.7 + F.col("ps") * 0.3).alias("final"), "ms", "ps", "ls"), "final", "ms", "ps", "ls")


@query("nearest_match", UNLIN + " SELECT seed, query, feature, i, round(match, 12) AS match, round(ratio, 12) AS ratio FROM n WHERE n_q > 0")
def nearest_match(spark, d):
    near = scoring.nearest_instances(S.pairs(spark, d), _arch(spark, d)).where("n_q > 0").drop("n_q")
    return _rounded(near, "match", "ratio")


@query("common_feature", f"WITH {LIN}{PAIRS}, t AS (SELECT protein_id, list(DISTINCT feature) AS f FROM lin GROUP BY 1) SELECT seed, query, list_has_any(a.f, b.f) AS common FROM pairs JOIN t a ON a.protein_id = seed JOIN t b ON b.protein_id = query")
def common_feature(spark, d):
    return scoring.common_feature(S.pairs(spark, d), _arch(spark, d))


# scores


def _score(spark, d, options=OPTIONS, weight=None, distance=False, reverse=False, prepared=None):
    p = _prepared(spark, d, options) if prepared is None else prepared
    pairs = S.pairs(spark, d)
    if reverse:
        pairs = pairs.select(F.col("query").alias("seed"), F.col("seed").alias("query"))
    return scoring.score_pairs(pairs, p, p, options, weight, distance)


_OUT = ["final", "ms", "ps", "cs", "ls"]
_PLAIN = _score_sql(0.7, 0.0, 0.3)
_LOGE = f"SELECT protein_id, feature, raw / sum(raw) OVER (PARTITION BY protein_id) AS weight FROM (SELECT protein_id, feature, sum(n) OVER (PARTITION BY protein_id) / n AS raw FROM (SELECT DISTINCT protein_id, feature FROM inst) JOIN (SELECT feature, round_even(ln(CAST(count(*) AS DOUBLE)), 0) + 1 AS n FROM inst GROUP BY 1) USING (feature))"
_DIST = "SELECT * FROM (VALUES ('pfam_ECONOMY', 0.4), ('smart_PROMO', 0.2), ('tmhmm_LARGE', 0.05)) t(feature, weight)"


def _distance_weights(spark):
    return spark.createDataFrame([("pfam_ECONOMY", 0.4), ("smart_PROMO", 0.2), ("tmhmm_LARGE", 0.05)], "feature string, weight double")


@query("score_exhaustive", f"WITH {_PLAIN} SELECT seed, query, {SCORES}, array_to_string(sp, ',') AS seed_path, array_to_string(qp, ',') AS query_path FROM best")
def score_exhaustive(spark, d):
    s = _score(spark, d)
    return _rounded(s, *_OUT).select("seed", "query", *_OUT, *[F.concat_ws(",", F.col(f"{k}_path").cast("array<string>")).alias(f"{k}_path") for k in ("seed", "query")])


@query("cs_score", f"WITH {_score_sql(0.6, 0.2, 0.2)} SELECT seed, query, round(final, 12) AS final, round(cs, 12) AS cs FROM best")
def cs_score(spark, d):
    return _rounded(_score(spark, d, WITH_CLANS), "final", "cs").select("seed", "query", "final", "cs")


@query("score_weighted", f"WITH {_score_sql(0.7, 0.0, 0.3, _LOGE)} SELECT seed, query, {SCORES} FROM best")
def score_weighted(spark, d):
    rows = S.instances(spark, d)
    w = weights.frequency_weights(rows, A.feature_counts(rows), OPTIONS)
    return _rounded(_score(spark, d, OPTIONS, w), *_OUT).select("seed", "query", *_OUT)


_CW = CONSTRAINED_SQL[len(f"WITH {INST}, "):]


@query("score_constrained", f"WITH {_score_sql(0.7, 0.0, 0.3, 'SELECT * FROM cw', also=', ' + _CW, constraints=CONSTRAINED.constraints)} SELECT seed, query, {SCORES} FROM best")
def score_constrained(spark, d):
    rows = S.instances(spark, d)
    w = weights.constrained_weights(rows, A.feature_counts(rows), CONSTRAINED)
    return _rounded(_score(spark, d, CONSTRAINED, w), *_OUT).select("seed", "query", *_OUT)


def _changed(sql: str, old: str, new: str) -> str:
    """``sql`` with ``old`` replaced, which must be there."""
    if old not in sql:
        raise ValueError(f"not in the SQL: {old}")
    return sql.replace(old, new)


_REVERSED = _changed(_PLAIN, "SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seed, o_orderkey AS query FROM orders) WHERE seed IS NOT NULL", "SELECT o_orderkey AS seed, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS query FROM orders) WHERE query IS NOT NULL")


@query("score_bidirectional", f"WITH fwd AS (WITH {_PLAIN} SELECT seed, query, final FROM best), rev AS (WITH {_REVERSED} SELECT query AS seed, seed AS query, final AS r FROM best) SELECT seed, query, round(final, 12) AS fwd_final, round(r, 12) AS rev_final FROM fwd LEFT JOIN rev USING (seed, query)")
def score_bidirectional(spark, d):
    p = _prepared(spark, d)
    both = scoring.bidirectional(_score(spark, d, prepared=p), _score(spark, d, reverse=True, prepared=p))
    return _rounded(both, "fwd_final", "rev_final")


@query("score_empty_query", f"WITH {_PLAIN} SELECT seed, query, round(final, 12) AS final, array_to_string(sp, ',') AS seed_path FROM best WHERE query IN (SELECT protein_id FROM n_lin WHERE n = 0)")
def score_empty_query(spark, d):
    p = _prepared(spark, d)
    none = p.where(F.size("lin") == 0).select(F.col("protein_id").alias("query"))
    s = scoring.score_pairs(S.pairs(spark, d).join(none, "query", "left_semi").select("seed", "query"), p, p, OPTIONS)
    return _rounded(s, "final").select("seed", "query", "final", F.concat_ws(",", F.col("seed_path").cast("array<string>")).alias("seed_path"))


@query("score_lines", f"WITH {UNLIN[5:]} SELECT '#' || chr(9) || seed || chr(9) || query || chr(9) || {_FOUR.format('ms')} AS line FROM u")
def score_lines(spark, d):
    u = _unlinearized(spark, d)
    return reports.score_lines(u.select("seed", "query", four_significant("ms").alias("final")))


def _distance(spark, d):
    return _rounded(_score(spark, d, WITH_CLANS, _distance_weights(spark), True), *_OUT)


_DISTANCE = _score_sql(0.6, 0.2, 0.2, _DIST, True)
for _c in ("ms", "ps", "cs"):
    query(f"distance_{_c}", f"WITH {_DISTANCE} SELECT seed, query, round({_c}, 12) + 0.0 AS {_c} FROM best")(lambda spark, d, c=_c: _distance(spark, d).select("seed", "query", c))


@query("distance_score", f"WITH {_DISTANCE} SELECT seed, query, {SCORES} FROM best")
def distance_score(spark, d):
    return _distance(spark, d).select("seed", "query", *_OUT)


#: A weight file of the distance variant with a default of its own.
_WEIGHT_FILE = '{"weights": {"pfam_ECONOMY": 0.4, "smart_PROMO": 0.2, "tmhmm_LARGE": 0.05}, "default": 0.15}'
_DEFAULTED = _score_sql(0.6, 0.2, 0.2, _DIST, True, default=0.15)


def _weight_file(spark):
    named, default = reports.parse_weight_file(_WEIGHT_FILE)
    return spark.createDataFrame(list(named.items()), "feature string, weight double"), replace(WITH_CLANS, distance_default=default)


@query("distance_weight_file", f"WITH {_DEFAULTED} SELECT seed, query, {SCORES} FROM best")
def distance_weight_file(spark, d):
    w, o = _weight_file(spark)
    return _rounded(_score(spark, d, o, w, True), *_OUT).select("seed", "query", *_OUT)


@query("greedy_score")
def greedy_score(spark, d):
    return _score(spark, d, replace(OPTIONS, max_features=5, max_paths=6)).where("mode <> 'exhaustive/exhaustive'").select("seed", "query", *_OUT, "mode")


def _greedy_distance(spark, d):
    w, o = _weight_file(spark)
    return _score(spark, d, replace(o, max_features=5, max_paths=6), w, True)


@query("greedy_distance")
def greedy_distance(spark, d):
    return _greedy_distance(spark, d).where("mode <> 'exhaustive/exhaustive'").select("seed", "query", *_OUT, "mode")


_LEGACY = f"""WITH {LIN}{PAIRS}, s AS (SELECT seed, query, q.feature, q.rank, q.position AS qp, a.position AS sp FROM pairs JOIN lin q ON q.protein_id = query LEFT JOIN arch a ON a.protein_id = seed AND a.feature = q.feature),
n AS (SELECT seed, query, feature, rank, count(sp) AS n_s, coalesce(max(1 - abs(qp - sp)), 0.0) AS match FROM s GROUP BY ALL),
f AS (SELECT seed, query, feature, least(max(n_s) / count(*), 1.0) AS share, avg(match) AS p FROM n GROUP BY ALL),
m AS (SELECT seed, query, avg(share) AS ms, avg(p) AS ps FROM f GROUP BY ALL),
c AS (SELECT protein_id, clan, sum(CAST(linearized AS INTEGER)) AS n_path, count(*) AS n_all FROM arch WHERE clan IS NOT NULL GROUP BY 1, 2),
k AS (SELECT protein_id AS query, sum(n_path * n_all / (greatest(n_path, n_all) * greatest(n_path, n_all))) / count(*) AS cs FROM c WHERE n_path > 0 GROUP BY 1),
legacy AS (SELECT seed, query, ms, ps, coalesce(cs, 0.0) AS cs FROM m LEFT JOIN k USING (query))"""


def _partial(spark, d):
    """A query's linearized instances against the whole seed, as the greedy walk values its paths."""
    p = cut(A.proteins(S.universe(spark, d), S.instances(spark, d), WITH_CLANS).drop("mark"), "proteins")
    queries = p.where(F.size("lin") > 0)
    return _rounded(greedy.partial_scores(S.pairs(spark, d), p, queries, WITH_CLANS), "final", "ms", "ps", "cs")


@query("legacy_ms_ps", _LEGACY + " SELECT seed, query, round(ms, 12) AS ms, round(ps, 12) AS ps FROM legacy")
def legacy_ms_ps(spark, d):
    return _partial(spark, d).select("seed", "query", "ms", "ps")


@query("legacy_cs", _LEGACY + " SELECT seed, query, round(cs, 12) AS cs FROM legacy")
def legacy_cs(spark, d):
    return _partial(spark, d).select("seed", "query", "cs")


@query("legacy_score", _LEGACY + " SELECT seed, query, round(ms * 0.6 + cs * 0.2 + ps * 0.2, 12) AS final FROM legacy")
def legacy_score(spark, d):
    return _partial(spark, d).select("seed", "query", "final")


# reports

_ACC = "acc AS (SELECT * FROM (VALUES ('pfam_ECONOMY', 'IPR000001'), ('pfam_SMALL', 'IPR000002'), ('smart_PROMO', 'IPR000003')) t(feature, interpro)), plen AS (SELECT * FROM (VALUES ('pfam_ECONOMY', 120), ('smart_MEDIUM', 77)) t(feature, phmm_length))"


_UNIFORM = "SELECT seed, query, feature, round(1.0 / CAST(count(*) OVER (PARTITION BY seed, query) AS DOUBLE), 4) AS weight FROM types"


def _domain_sql(best: str, share: str = _UNIFORM) -> str:
    return f"""WITH {best}, {_ACC},
sides AS (SELECT seed, query, 'seed' AS side, seed AS protein_id, sp AS path FROM best UNION ALL SELECT seed, query, 'query', query, qp FROM best WHERE seed <> query),
onpath AS (SELECT s.seed, s.query, s.side, l.i FROM sides s JOIN lin l ON l.protein_id = s.protein_id AND list_contains(s.path, l.rank) UNION ALL SELECT s.seed, s.query, s.side, a.i FROM sides s JOIN arch a ON a.protein_id = s.protein_id AND NOT a.linearized),
types AS (SELECT DISTINCT o.seed, o.query, x.feature FROM onpath o JOIN inst x ON x.protein_id = o.seed AND x.i = o.i WHERE o.side = 'seed'),
share AS ({share})
SELECT CAST(s.seed AS VARCHAR) || '#' || CAST(s.query AS VARCHAR) AS pair_id, s.protein_id AS ortholog, x.length AS seq_length, x.feature, x.start, x.stop, share.weight, CASE WHEN o.i IS NULL THEN 'N' ELSE 'Y' END AS path, coalesce(acc.interpro, 'NA') AS interpro, x.evalue, plen.phmm_length
FROM sides s JOIN inst x ON x.protein_id = s.protein_id LEFT JOIN onpath o ON o.seed = s.seed AND o.query = s.query AND o.side = s.side AND o.i = x.i
LEFT JOIN share ON share.seed = s.seed AND share.query = s.query AND share.feature = x.feature LEFT JOIN acc ON acc.feature = x.feature LEFT JOIN plen ON plen.feature = x.feature"""


def _domains(spark, d, options, weight=None, distance=False):
    p, rows = _prepared(spark, d, options), S.instances(spark, d)
    scores = _score(spark, d, options, weight, distance, prepared=p)
    out = reports.domain_report(scores, (p, rows), (p, rows), S.accessions(spark), S.profile_lengths(spark), weight, distance, options.distance_default)
    return out.select("pair_id", "ortholog", "seq_length", "feature", "start", "stop", "weight", "path", "interpro", "evalue", "phmm_length")


@query("domains_report", _domain_sql(_PLAIN))
def domains_report(spark, d):
    return _domains(spark, d, OPTIONS)


_SCALED = "SELECT seed, query, feature, round(w * CASE WHEN sum(w) OVER (PARTITION BY seed, query) > 1 THEN 1 / sum(w) OVER (PARTITION BY seed, query) ELSE 1.0 END, 4) AS weight FROM (SELECT types.*, coalesce(wt.weight, 0.15) AS w FROM types LEFT JOIN wt ON wt.feature = types.feature)"


@query("domains_report_distance", _domain_sql(_DEFAULTED, _SCALED))
def domains_report_distance(spark, d):
    w, o = _weight_file(spark)
    return _domains(spark, d, o, w, True)


@query("domains_unscored", f"WITH {INST}, acc AS (SELECT * FROM (VALUES ('pfam_ECONOMY', 'IPR000001.3'), ('pfam_SMALL', 'IPR000002.1'), ('smart_PROMO', 'IPR000003')) t(feature, interpro)), plen AS (SELECT * FROM (VALUES ('pfam_ECONOMY', 120), ('smart_MEDIUM', 77)) t(feature, phmm_length)) SELECT 'G#' || CAST(protein_id AS VARCHAR) AS pair_id, protein_id AS ortholog, length AS seq_length, inst.feature, start, stop, coalesce(acc.interpro, 'NA') AS interpro, phmm_length FROM inst LEFT JOIN acc ON acc.feature = inst.feature LEFT JOIN plen ON plen.feature = inst.feature WHERE protein_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def domains_unscored(spark, d):
    ids = S.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("protein_id"))
    return reports.unscored_domains(S.instances(spark, d), ids, S.accessions(spark), S.profile_lengths(spark), "G")


@query("domain_split_counts", f"WITH {ARCH}{PAIRS} SELECT CAST(seed AS VARCHAR) AS seed_id, feature, count(*) AS n FROM pairs JOIN arch ON protein_id = seed WHERE seed % 50 = 0 GROUP BY 1, 2")
def domain_split_counts(spark, d):
    """Domain rows split to a folder for each seed that is asked for (every fiftieth), and read back."""
    rows = S.pairs(spark, d).join(_arch(spark, d).withColumnRenamed("protein_id", "seed"), "seed").select(F.concat_ws("#", "seed", "query").alias("pair_id"), "feature")
    ids = S.universe(spark, d).where("protein_id % 50 = 0").select(F.col("protein_id").cast("string").alias("seed_id"))
    path = new_path(spark, "split-domains")
    reports.write_split_domains(rows, path, ids)
    back = spark.read.option("sep", "\t").option("header", True).schema("pair_id string, feature string, seed_id string").csv(path)
    return back.groupBy("seed_id", "feature").agg(F.count(F.lit(1)).alias("n"))


@query("phylogenetic_profile", f"WITH {UNLIN[5:]} SELECT seed AS gene_id, 'ncbi' || CAST(c_nationkey AS VARCHAR) AS ncbi_id, query AS ortho_id, round(ms, 12) AS forward_score, 0.0::DOUBLE AS reverse_score FROM u JOIN orders ON o_orderkey = query JOIN customer ON c_custkey = o_custkey")
def phylogenetic_profile(spark, d):
    mapping = S.read(spark, d, "orders").join(S.read(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("o_orderkey").alias("protein_id"), F.concat(F.lit("ncbi"), F.col("c_nationkey").cast("string")).alias("ncbi_id"))
    scores = _unlinearized(spark, d).select("seed", "query", F.round("ms", 12).alias("fwd_final"), F.lit(None).cast("double").alias("rev_final"))
    return reports.phylogenetic_profile(scores, mapping)


_GROUPS = "m AS (SELECT o_custkey AS grp, c_nationkey AS taxon, o_orderkey AS protein_id, o_orderkey AS pos FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT grp, first_value(protein_id) OVER w AS seed, first_value(taxon) OVER w AS seed_taxon, protein_id AS query, taxon AS query_taxon, pos, min(pos) OVER (PARTITION BY grp) AS first FROM m WINDOW w AS (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), groups AS (SELECT grp, seed, seed_taxon, query, query_taxon FROM g WHERE pos > first)"


def _members(spark, d):
    return S.read(spark, d, "orders").join(S.read(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("o_custkey").alias("grp"), F.col("c_nationkey").alias("taxon"), F.col("o_orderkey").alias("protein_id"), F.col("o_orderkey").alias("pos"))


@query("ortholog_groups", f"WITH {_GROUPS} SELECT grp, seed, seed_taxon, query, query_taxon FROM groups")
def ortholog_groups(spark, d):
    return M.ortholog_groups(_members(spark, d))


@query("group_filter", f"WITH {_GROUPS} SELECT grp, seed, query FROM groups WHERE grp IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def group_filter(spark, d):
    names = S.read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("grp"))
    return M.ortholog_groups(_members(spark, d), names=names).select("grp", "seed", "query")


@query("group_domains", f"WITH {ARCH}, {_GROUPS} SELECT CAST(grp AS VARCHAR) || '#' || concat_ws('|', CAST(grp AS VARCHAR), CAST(query_taxon AS VARCHAR), CAST(query AS VARCHAR)) AS pair_id, feature, start, stop FROM groups JOIN arch ON protein_id = query")
def group_domains(spark, d):
    g = M.ortholog_groups(_members(spark, d))
    rows = g.select("seed", "query").join(_arch(spark, d).withColumnRenamed("protein_id", "query"), "query").select("seed", "query", "feature", "start", "stop")
    return reports.group_domains(rows, g).select("pair_id", "feature", "start", "stop")


@query("taxon_pair_buckets", "WITH t AS (SELECT o_orderkey, c_nationkey, lag(c_nationkey) OVER (ORDER BY o_orderkey) AS p FROM orders JOIN customer ON c_custkey = o_custkey), m AS (SELECT o.o_custkey, c_nationkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS k, o_orderdate FROM orders o JOIN customer ON c_custkey = o_custkey) SELECT a.c_nationkey AS tax1, b.c_nationkey AS tax2, count(*) AS n_pairs FROM m a JOIN m b ON a.o_orderdate = b.o_orderdate AND b.k = a.k + 1 GROUP BY 1, 2")
def taxon_pair_buckets(spark, d):
    rows = S.read(spark, d, "orders").join(S.read(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    w = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    pairs = rows.select(F.col("c_nationkey").alias("tax1"), F.lead("c_nationkey").over(w).alias("tax2")).where("tax2 is not null")
    return M.taxon_pairs(pairs)


# overlaps


@query("overlap_stats")
def overlap_stats(spark, d):
    return overlap.overlap_statistics(S.instances(spark, d), "pfam", "smart", 0.5)


def _overlap_sql() -> tuple[str, list[str]]:
    parts, cols = [], []
    for k, (x, y) in enumerate((("pfam", "smart"), ("smart", "pfam")), 1):
        parts.append(f"""b{k} AS (SELECT feature, sum(hit) AS hits, count(*) AS n FROM (SELECT a.feature, CASE WHEN EXISTS (SELECT 1 FROM inst o WHERE o.protein_id = a.protein_id AND o.tool = '{y}' AND
  CASE WHEN a.start BETWEEN o.start AND o.stop THEN o.stop - a.start WHEN o.start BETWEEN a.start AND a.stop THEN a.stop - o.start END >= 0.5 * greatest(o.stop - o.start, a.stop - a.start)) THEN 1 ELSE 0 END AS hit FROM inst a WHERE tool = '{x}') GROUP BY 1),
r{k} AS (SELECT CAST(count(*) FILTER (hits > 0) AS BIGINT) AS types_overlapping_{k}, count(*) AS types_{k}, CAST(sum(hits) AS BIGINT) AS instances_overlapping_{k}, CAST(sum(n) AS BIGINT) AS instances_{k}, CAST(coalesce(sum(hits) FILTER (hits > 0), 0) AS BIGINT) AS overlapping_of_types_{k}, CAST(coalesce(sum(n) FILTER (hits > 0), 0) AS BIGINT) AS instances_of_types_{k} FROM b{k})""")
        cols.append(f"r{k}")
    return f"WITH {INST}, " + ", ".join(parts), cols


ORACLES["overlap_stats"] = _overlap_sql()[0] + " SELECT * FROM r1, r2"


@query("overlap_shares", _overlap_sql()[0] + " " + " UNION ALL ".join(f"SELECT {k} AS direction, '{kind}' AS kind, {a}_{k} AS overlapping, {b}_{k} - {a}_{k} AS free FROM r{k}" for k in (1, 2) for kind, a, b in (("types", "types_overlapping", "types"), ("instances", "instances_overlapping", "instances"), ("within_types", "overlapping_of_types", "instances_of_types"))))
def overlap_shares(spark, d):
    return overlap.overlap_shares(overlap_stats(spark, d))


# annotations and maintenance

_ANY = "names AS (SELECT protein_id, tool, list(DISTINCT feature) AS f FROM inst GROUP BY 1, 2)"


@query("features_any", f"WITH {INST}, {_ANY} SELECT DISTINCT protein_id FROM names WHERE list_contains(f, 'pfam_SMALL') OR list_contains(f, 'smart_PROMO')")
def features_any(spark, d):
    return M.proteins_with(S.instances(spark, d), ["small", "PROMO"], False)


@query("features_all", f"WITH {INST}, {_ANY} SELECT DISTINCT protein_id FROM names WHERE list_contains(f, 'pfam_SMALL') AND list_contains(f, 'pfam_ECONOMY')")
def features_all(spark, d):
    return M.proteins_with(S.instances(spark, d), ["small", "economy"], True)


@query("missing_annotation", f"WITH {INST} SELECT c_nationkey AS taxon, count(*) AS n_missing, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS missing FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT protein_id FROM inst) GROUP BY 1")
def missing_annotation(spark, d):
    m = _members(spark, d)
    four = m.select(F.col("protein_id").alias("id1"), F.col("taxon").alias("tax1"), F.col("protein_id").alias("id2"), F.col("taxon").alias("tax2"))
    return M.missing_by_taxon(four, S.instances(spark, d)).select("taxon", "n_missing", F.concat_ws(",", F.col("missing").cast("array<string>")).alias("missing"))


@query("extract_subproteome", f"WITH {INST} SELECT feature, count(*) AS n FROM inst WHERE protein_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def extract_subproteome(spark, d):
    ids = S.read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("protein_id"))
    return M.sub_proteome(S.instances(spark, d), ids)[1]


@query("annotation_merge", f"WITH {INST} SELECT feature, CAST(sum(n) AS BIGINT) AS n FROM (SELECT protein_id % 3 AS proteome, feature, count(*) AS n FROM inst GROUP BY 1, 2) GROUP BY 1")
def annotation_merge(spark, d):
    rows = M.merge_annotations(S.instances(spark, d).withColumn("proteome", F.col("protein_id") % 3))
    return M.merged_counts(rows.groupBy("proteome", "feature").agg(F.count(F.lit(1)).alias("n")))


@query("annotation_update", f"WITH {INST} SELECT protein_id, tool, count(*) AS n, CAST(sum(start) AS BIGINT) AS s FROM (SELECT protein_id, tool, start FROM inst WHERE tool <> 'pfam' UNION ALL SELECT protein_id, tool, start + 1000 FROM inst WHERE tool = 'pfam' AND evalue <= 0.05) GROUP BY 1, 2")
def annotation_update(spark, d):
    old = S.instances(spark, d)
    new = old.where("evalue <= 0.05").withColumn("start", F.col("start") + 1000)
    return M.replace_tool(old, new, "pfam").groupBy("protein_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("s"))


@query("annotation_last_wins", f"WITH {INST} SELECT protein_id, tool, CASE WHEN protein_id % 2 = 0 THEN 1 ELSE 0 END AS src, count(*) AS n FROM inst GROUP BY 1, 2, 3")
def annotation_last_wins(spark, d):
    rows = S.instances(spark, d)
    both = rows.withColumn("src", F.lit(0)).union(rows.where("protein_id % 2 = 0").withColumn("src", F.lit(1)))
    return M.last_wins(both, ["protein_id", "tool"], "src").groupBy("protein_id", "tool", "src").agg(F.count(F.lit(1)).alias("n"))


@query("annotation_refresh", f"WITH {INST} SELECT feature, count(*) AS n FROM inst WHERE protein_id % 5 <> 0 OR evalue <= 0.05 GROUP BY 1")
def annotation_refresh(spark, d):
    rows = S.instances(spark, d)
    return M.refreshed(rows.where("protein_id % 5 <> 0"), rows.where("protein_id % 5 = 0 and evalue <= 0.05"))[1]


_FILES = f"WITH {INST}{PAIRS}, files AS (SELECT seed, query, 0 AS file_pos, 0.25::DOUBLE AS final FROM pairs WHERE seed % 2 = 0 UNION ALL SELECT query, seed, 1, 0.5 FROM pairs)"


@query("scores_merge", _FILES + ", n AS (SELECT *, row_number() OVER (PARTITION BY least(seed, query), greatest(seed, query) ORDER BY file_pos, seed, query) AS k FROM files) SELECT seed, query, file_pos, final FROM n WHERE k = 1")
def scores_merge(spark, d):
    p = S.pairs(spark, d)
    a = p.where("seed % 2 = 0").select("seed", "query", F.lit(0).alias("file_pos"), F.lit(0.25).alias("final"))
    b = p.select(F.col("query").alias("seed"), F.col("seed").alias("query"), F.lit(1).alias("file_pos"), F.lit(0.5).alias("final"))
    return M.merge_scores(a.union(b))


@query("scores_update", f"WITH {INST}{PAIRS}{OLD} SELECT seed, query, 0.25::DOUBLE AS final FROM pairs WHERE NOT EXISTS (SELECT 1 FROM old WHERE least(old.seed, old.query) = least(pairs.seed, pairs.query) AND greatest(old.seed, old.query) = greatest(pairs.seed, pairs.query)) UNION ALL SELECT seed, query, 0.75 FROM old")
def scores_update(spark, d):
    p = S.pairs(spark, d)
    return M.update_scores(p.withColumn("final", F.lit(0.25)), _old(p).withColumn("final", F.lit(0.75)))


@query("scores_store_update", ORACLES["scores_update"])
def scores_store_update(spark, d):
    """The same update in a store of buckets, of which it reads and writes those that it meets."""
    p = S.pairs(spark, d)
    path = new_path(spark, "score-store")
    score_store.create(p.withColumn("final", F.lit(0.25)), path, 16)
    score_store.update(spark, path, _old(p).withColumn("final", F.lit(0.75)), 16)
    return score_store.read(spark, path).select("seed", "query", "final")


@query("results_union", f"WITH {INST}{PAIRS} SELECT seed, query, CASE WHEN seed % 3 = 0 THEN 0 WHEN seed % 3 = 1 THEN 1 ELSE 2 END AS run FROM pairs")
def results_union(spark, d):
    p = S.pairs(spark, d)
    return M.union_results([p.where(f"seed % 3 = {k}") for k in range(3)])


@query("tsv_to_json_pairs", f"WITH {UNLIN[5:]} SELECT '{{\"' || CAST(seed AS VARCHAR) || '_' || CAST(query AS VARCHAR) || '\":[\"' || {_FOUR.format('ms')} || '\",\"NA\"]}}' AS value FROM u")
def tsv_to_json_pairs(spark, d):
    """Scores written as a table, read from it, and given as JSON."""
    u = _unlinearized(spark, d).select("seed", "query", F.lit("x").alias("mode"), *[F.col("ms").alias(f"fwd_{k}") for k in _OUT], *[F.lit(None).cast("double").alias(f"rev_{k}") for k in _OUT])
    path = new_path(spark, "score-table")
    reports.write_score_table(u, path)
    return reports.score_json(text.read_score_table(spark, path))


@query("version_mismatch", "SELECT o_orderpriority AS tool, count(DISTINCT o_orderstatus) AS n_versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def version_mismatch(spark, d):
    v = S.read(spark, d, "orders").select(F.col("o_custkey").alias("proteome"), F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("value"))
    return M.version_mismatches(v)


@query("version_report", "SELECT user_id AS proteome, event_type AS tool, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def version_report(spark, d):
    v = S.read(spark, d, "events").select(F.col("user_id").alias("proteome"), F.col("event_type").alias("tool"), F.from_json("props", "map<string,string>").alias("info"))
    return reports.version_report(v)


@query("dims_lookup", f"""WITH {INST}, f AS (SELECT DISTINCT feature FROM inst), fam AS (SELECT * FROM (VALUES ('pfam_ECONOMY', 'PF1.3', 'CL1'), ('pfam_SMALL', 'PF2.1', 'NA')) t(feature, accession, clan)), plen AS (SELECT * FROM (VALUES ('pfam_ECONOMY', 120), ('smart_MEDIUM', 77)) t(feature, plen))
SELECT feature, 'clan' AS kind, clan AS value FROM f JOIN fam USING (feature) WHERE clan <> 'NA' UNION ALL SELECT feature, 'accession', accession FROM f JOIN fam USING (feature) UNION ALL SELECT feature, 'length', CAST(plen AS VARCHAR) FROM f JOIN plen USING (feature)""")
def dims_lookup(spark, d):
    families = spark.createDataFrame([("ECONOMY", "PF1.3", "CL1"), ("SMALL", "PF2.1", "NA")], "id string, accession string, clan string")
    found = documents.looked_up(S.instances(spark, d), families, S.profile_lengths(spark))
    rows = [found[n].select("feature", F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for n, k, c in (("clans", "clan", "clan"), ("accessions", "accession", "interpro"), ("lengths", "length", "plen"))]
    return rows[0].union(rows[1]).union(rows[2])


# text formats


@query("pair_file_four_columns", f"WITH {INST}{PAIRS} SELECT 'p' || CAST(seed AS VARCHAR) AS id1, 't' || CAST(seed % 7 AS VARCHAR) AS tax1, 'p' || CAST(query AS VARCHAR) AS id2, 't' || CAST(query % 7 AS VARCHAR) AS tax2 FROM pairs WHERE query % 5 <> 0")
def pair_file_four_columns(spark, d):
    """A file of pairs with their taxa, in which every fifth line lacks a column."""
    p = S.pairs(spark, d)
    cells = [F.concat(F.lit(a), (F.col(c) % m if m else F.col(c)).cast("string")) for a, c, m in (("p", "seed", 0), ("t", "seed", 7), ("p", "query", 0), ("t", "query", 7))]
    path = new_path(spark, "pair-file")
    line = F.when(F.col("query") % 5 == 0, F.concat_ws(" ", *cells[:3])).otherwise(F.concat_ws("  ", *cells[:2], F.concat_ws("\t", *cells[2:])))
    p.select(line.alias("value")).write.text(path)
    return text.four_columns(spark.read.text(path))


_RUNS = "WITH c AS (SELECT doc_id AS id, regexp_replace(text, '[^e]', '.', 'g') AS s FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)), p AS (SELECT id, unnest(range(1, CAST(length(s) AS BIGINT) + 1)) AS pos, s FROM c), r AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM p WHERE s[pos] = 'e')"


@query("coil_runs", _RUNS + " SELECT id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) AS INTEGER) AS stop FROM r GROUP BY id, g")
def coil_runs(spark, d):
    masked = S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "(?s)[^e]", ".").alias("sequence"))
    return predictors.runs(masked, "e", "coils_coiled_coil").select("id", "start", "stop")


@query("disorder_runs", "WITH m AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_totalprice > 150000 AS hit FROM orders), l AS (SELECT *, max(pos) OVER (PARTITION BY id) AS last FROM m), g AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM l WHERE hit) SELECT id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop FROM g GROUP BY id, g HAVING max(pos) + 1 <= max(last)")
def disorder_runs(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    residues = S.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.row_number().over(w) - 1).alias("pos"), F.when(F.col("o_totalprice") > 150000, "*").otherwise(".").alias("mark"))
    return predictors.islands(residues)


@query("interpro_parse", f"WITH {INST}, fam AS (SELECT * FROM (VALUES ('ECONOMY', 'PF1', 'CL1'), ('SMALL', 'PF2', NULL)) t(accession, id, clan)), u AS (SELECT protein_id, tool, split_part(feature, '_', 2) AS accession, start, stop, evalue FROM inst) SELECT protein_id, tool, tool || '_' || CASE WHEN tool = 'pfam' THEN coalesce(id, u.accession) ELSE u.accession END AS feature, CASE WHEN tool = 'pfam' THEN clan END AS clan, start, stop, evalue FROM u LEFT JOIN fam ON fam.accession = u.accession UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT protein_id FROM inst)")
def interpro_parse(spark, d):
    fam = spark.createDataFrame([("ECONOMY", "PF1", "CL1"), ("SMALL", "PF2", "NA")], "accession_base string, id string, clan string")
    lengths = S.profile_lengths(spark)
    rows = S.instances(spark, d).select("protein_id", "length", F.substring_index("feature", "_", -1).alias("accession"), "start", "stop", F.col("evalue").cast("string").alias("evalue"), F.upper("tool").alias("tool"), F.lit("-").alias("interpro"))
    parsed = text.interpro_table(rows, fam, lengths, ["pfam", "smart", "tmhmm"])
    sequences = S.universe(spark, d).select(F.col("protein_id").alias("id"), F.lit(S.LENGTH).alias("length"))
    return text.with_featureless(parsed, sequences).select("protein_id", "tool", "feature", "clan", "start", "stop", "evalue")


@query("phmm_lengths", "SELECT 'f' || CAST(p_partkey AS VARCHAR) AS feature, p_size AS plen FROM part")
def phmm_lengths(spark, d):
    p = S.read(spark, d, "part").select(F.col("p_type").alias("file"), "p_partkey", "p_size")
    lines = p.select("file", F.explode(F.array(F.struct((F.col("p_partkey") * 2).alias("pos"), F.concat(F.lit("NAME  f"), F.col("p_partkey").cast("string")).alias("value")), F.struct((F.col("p_partkey") * 2 + 1).alias("pos"), F.concat(F.lit("LENG  "), F.col("p_size").cast("string")).alias("value")))).alias("l")).select("file", "l.*")
    return text.profile_lengths(lines)
