"""The catalog's queries in DuckDB's SQL. Tables: the shared test tables."""

from __future__ import annotations

from .catalog import BIAS, TREES, WEIGHTS
from .config import HOUR_LABELS

EV = """ev AS (SELECT event_id AS row_id, ts, CAST(user_id AS varchar) AS entity_id, event_type AS segment, value AS actual,
 lag(value, 1) OVER w AS prediction_a, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prediction_b
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def errors(source: str = "ev", actual: str = "actual", a: str = "prediction_a", b: str = "prediction_b", time: str = "ts", entity: str = "entity_id", scale: str = "1.0") -> str:
    """Rows with errors (er, ec), their sizes (aer, aec), date d, hour h and entity e."""
    return f"""base AS (SELECT *, ({a} - {actual}) * {scale} AS er, ({b} - {actual}) * {scale} AS ec, abs(({a} - {actual}) * {scale}) AS aer, abs(({b} - {actual}) * {scale}) AS aec,
 {actual} AS act, {b} AS cand, strftime({time}, '%Y-%m-%d') AS d, hour({time}) AS h, {entity} AS e FROM {source}),
paired AS (SELECT * FROM base WHERE er IS NOT NULL AND ec IS NOT NULL), candidate AS (SELECT * FROM base WHERE ec IS NOT NULL)"""


def r(x: str, name: str, digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


HOUR = "CASE WHEN h IS NULL THEN '(missing/nonfinite)' WHEN h <= 5 THEN '00–05' WHEN h <= 11 THEN '06–11' WHEN h <= 17 THEN '12–17' ELSE '18–23' END"


def metrics(tol: float = 10.0, digits: int = 9, least: int = 30) -> str:
    q = lambda x, n: r(x, n, digits)
    out = ["count(*) AS n", "count(DISTINCT e) AS entities", "count(DISTINCT d) AS dates"]
    for s, e, a in (("reference", "er", "aer"), ("candidate", "ec", "aec")):
        out += [q(f"avg({a})", f"{s}_mae"), q(f"sqrt(avg({e} * {e}))", f"{s}_rmse"), q(f"quantile_cont({a}, 0.95)", f"{s}_p95"), q(f"avg({e})", f"{s}_bias"), q(f"quantile_cont({a}, 0.5)", f"{s}_median"), q(f"avg(CASE WHEN {a} <= {tol} THEN 100.0 ELSE 0.0 END)", f"{s}_within_tolerance_pct")]
    out += [q("avg(aec) - avg(aer)", "mae_delta"), q("CASE WHEN avg(aer) > 0 THEN (avg(aer) - avg(aec)) / avg(aer) * 100 END", "mae_improvement_pct"), q("quantile_cont(aec, 0.95) - quantile_cont(aer, 0.95)", "p95_delta"), q("avg(CASE WHEN aec < aer THEN 100.0 ELSE 0.0 END)", "win_rate_pct"), q("avg(CASE WHEN aec = aer THEN 100.0 ELSE 0.0 END)", "tie_rate_pct"), f"count(*) < {least} AS low_support"]
    return ", ".join(out)


def summary(where: str = "true", source: str | None = None, **kw) -> str:
    return f"WITH {source or EV}, {errors(**kw)} SELECT {metrics()} FROM paired WHERE {where}"


def sliced(label: str, name: str = '"group"') -> str:
    return f"WITH {EV}, {errors()} SELECT {label} AS {name}, {metrics()} FROM paired GROUP BY 1"


GAP = f"""{EV}, gap AS (SELECT row_id, ts, CASE WHEN row_id % 23 IN (3, 5) THEN NULL ELSE actual END AS num, prediction_a, CASE WHEN row_id % 23 = 7 THEN NULL ELSE prediction_b END AS prediction_b,
 CASE WHEN row_id % 23 = 11 THEN NULL ELSE entity_id END AS entity_id, CASE WHEN row_id % 23 = 13 THEN NULL ELSE 0.5 END AS off, segment, actual FROM ev WHERE strftime(ts, '%d') NOT IN ('07', '08'))"""
GAP_ERRORS = errors("gap", "num", "prediction_a", "(prediction_b + off)", scale="2.0")


def gap_coverage(where: str = "true") -> str:
    return f"""WITH {GAP}, {GAP_ERRORS} SELECT count(*) AS total, count(num) AS valid_target, count(*) FILTER (er IS NOT NULL AND ec IS NOT NULL) AS paired, count(er) AS reference_available, count(ec) AS candidate_available,
 count(*) - count(*) FILTER (er IS NOT NULL AND ec IS NOT NULL) AS excluded, 0 AS missing_time, 0 AS nonfinite_error_rows, count(er) AS reference_evaluable, count(ec) AS candidate_evaluable,
 count(ec) - count(*) FILTER (er IS NOT NULL AND ec IS NOT NULL) AS candidate_only_evaluable FROM base WHERE {where}"""


def cases(order: str) -> str:
    return f"WITH {EV}, {errors()} SELECT row_id, {r('aer', 'ae_reference')}, {r('aec', 'ae_candidate')}, {r('aec - aer', 'loss_change')} FROM paired ORDER BY {order}, row_id LIMIT 20"


def tests(keys: list[tuple[str, str]], unit: str | None = "d", loss: str = "aec - aer", correction: str = "by", digits: int = 9) -> str:
    """A t-test per cell. The p-value is the finite series for whole degrees of freedom (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    names = [n for n, _ in keys]
    k = "".join(f"{n}, " for n in names)
    own = "".join(f"{x} AS {n}, " for n, x in keys)
    u = f"{unit} AS u" if unit else "row_id AS u"
    group = f"GROUP BY {', '.join(names)}" if names else ""
    rank = f"""rank_all AS (SELECT *, count(*) OVER (PARTITION BY status = 'ok') AS m, row_number() OVER (PARTITION BY status = 'ok' ORDER BY p) AS k FROM p),
 raw AS (SELECT *, CASE WHEN status = 'ok' THEN p * m / k * {"(SELECT sum(1.0 / i) FROM unnest(range(1, m + 1)) x(i))" if correction == "by" else "1.0"} END AS adjusted FROM rank_all),
 q AS (SELECT *, CASE WHEN status = 'ok' THEN least(1.0, min(adjusted) OVER (PARTITION BY status = 'ok' ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM raw)"""
    return f"""WITH {EV}, {errors()},
 units AS (SELECT {own}{u}, count(*) AS k, avg({loss}) AS v FROM paired GROUP BY ALL),
 cell AS (SELECT {k}sum(k)::BIGINT AS row_count, count(*) AS unit_count, avg(v) AS mean, stddev_samp(v) AS sd FROM units {group}),
 st AS (SELECT *, CASE WHEN row_count < 30 THEN 'low_rows' WHEN unit_count < 10 THEN 'low_units' WHEN sd = 0 THEN 'zero_variance' ELSE 'ok' END AS status FROM cell),
 t AS (SELECT *, CASE WHEN status = 'ok' THEN mean / (sd / sqrt(unit_count)) END AS t, CASE WHEN status = 'ok' THEN unit_count - 1 END AS df FROM st),
 th AS (SELECT *, atan(abs(t) / sqrt(df)) AS a, cos(atan(abs(t) / sqrt(df))) AS c FROM t),
 p AS (SELECT *, CASE WHEN df % 2 = 0 THEN 1 - sin(a) * (1 + coalesce((SELECT sum(exp(lgamma(i + 0.5) - lgamma(i + 1) - 0.5 * ln(pi()) + 2 * i * ln(c))) FROM unnest(range(1, CAST(df / 2 AS BIGINT))) x(i)), 0))
   ELSE 1 - 2 / pi() * (a + sin(a) * c * (1 + coalesce((SELECT sum(exp(lgamma(i + 1) + lgamma(1.5) - lgamma(i + 1.5) + 2 * i * ln(c))) FROM unnest(range(1, CAST((df - 1) / 2 AS BIGINT))) x(i)), 0))) END AS p FROM th),
 {rank}
 SELECT {k}row_count, row_count AS n, row_count AS paired_n, row_count AS tested_n, 0 AS excluded_unit_rows, unit_count, {r('mean', 'mean_loss_difference', digits)}, {r('t', 't_statistic', digits)}, {r('CAST(df AS DOUBLE)', 'df', digits)},
 abs(round(p, {digits})) AS p_value, abs(round(q, {digits})) AS q_value, coalesce(q <= 0.05, false) AS significant, CASE WHEN q <= 0.001 THEN '***' WHEN q <= 0.01 THEN '**' WHEN q <= 0.05 THEN '*' ELSE '' END AS significance,
 row_count < 30 OR unit_count < 10 AS low_support, status FROM q"""


def error_stats(tol: float = 10.0) -> str:
    return ", ".join(["count(*) AS n", r("avg(aec)", "candidate_mae"), r("sqrt(avg(ec * ec))", "candidate_rmse"), r("avg(ec)", "candidate_bias"), *[r(f"quantile_cont(aec, {p})", f"candidate_{n}") for p, n in ((0.5, "median_ae"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))], *[r(f"avg(CASE WHEN {c} THEN 100.0 ELSE 0.0 END)", f"candidate_{n}_pct") for c, n in ((f"aec <= {tol}", "within_tol"), ("ec < 0", "under"), ("ec > 0", "over"), ("ec = 0", "exact"))], "count(*) < 30 AS low_support"])


TAIL = "tail AS (SELECT quantile_cont(aec, 0.95) AS threshold, sum(aec) AS total FROM candidate)"
SERIES = f"""{EV}, {errors()}, found AS (SELECT epoch_us(ts) // 21600000000 AS bin, count(*) AS n, count(DISTINCT e) AS entities, avg(ec) AS bias, avg(aec) AS mae FROM candidate GROUP BY 1),
 grid AS (SELECT unnest(range((SELECT min(bin) FROM found), (SELECT max(bin) FROM found) + 1)) AS bin),
 series AS (SELECT bin, coalesce(n, 0) AS n, coalesce(entities, 0) AS entities, bias, mae, coalesce(n, 0) >= 5 AS supported, CASE WHEN n >= 5 THEN bias END AS signal FROM grid LEFT JOIN found USING (bin))"""
CORR = "CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 3 AND regr_sxx(y, x) > 0 AND regr_syy(y, x) > 0 THEN greatest(-1.0, least(1.0, regr_sxy(y, x) / (sqrt(regr_sxx(y, x)) * sqrt(regr_syy(y, x))))) END"


def view(a: str, b: str, c: str, join: str = "") -> str:
    return f"WITH {EV}, {errors()} SELECT row_id, {r(a, 'view_actual')}, {r(b, 'view_reference')}, {r(c, 'view_candidate')}, true AS view_valid FROM paired {join}"


def folds(label: str) -> str:
    return f"""WITH day AS (SELECT CAST(ts AS DATE) AS d, {label} AS l FROM events), dates AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () - 3 AS k FROM (SELECT DISTINCT d FROM day)),
 starts AS (SELECT unnest(range(11, (SELECT max(k) FROM dates) - 4 + 1, 4)) AS s), plan AS (SELECT row_number() OVER (ORDER BY s) AS fold, s FROM starts),
 named AS (SELECT fold, s, (SELECT d FROM dates WHERE i = 0) AS t0, (SELECT d FROM dates WHERE i = s - 2) AS t1, (SELECT d FROM dates WHERE i = s) AS v0, (SELECT d FROM dates WHERE i = s + 3) AS v1 FROM plan)
 SELECT fold, strftime(t0, '%Y-%m-%d') AS train_start, strftime(t1, '%Y-%m-%d') AS train_end, strftime(v0, '%Y-%m-%d') AS validation_start, strftime(v1, '%Y-%m-%d') AS validation_end, s - 1 AS train_dates, 4 AS validation_dates,
 count(*) FILTER (d <= t1 AND coalesce(l < v0, false)) AS train_rows, count(*) FILTER (d >= v0) AS validation_rows, count(*) FILTER (d <= t1 AND NOT coalesce(l < v0, false)) AS label_purged_rows, count(*) FILTER (d <= t1) AS scheduled_train_rows
 FROM day JOIN named ON d BETWEEN t0 AND v1 GROUP BY fold, s, t0, t1, v0, v1"""


FEATURES = "f AS (SELECT vec_id, CAST(label AS DOUBLE) AS target, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(4)) + " FROM embeddings)"
LONG = f"{EV.replace('ev AS', 'ev0 AS', 1)}, ev AS (SELECT row_id, ts, entity_id, segment, actual, CASE WHEN strftime(ts, '%d') > '20' THEN prediction_a END AS prediction_a, CASE WHEN strftime(ts, '%d') > '20' THEN prediction_b END AS prediction_b FROM ev0)"



def _leaves() -> str:
    """(leaf, v, f, threshold, is_left, share) of every split on every leaf's path."""
    rows, leaf = [], 0

    def walk(node: tuple, path: list) -> None:
        nonlocal leaf
        if len(node) == 2:
            rows.extend(f"({leaf}, {node[0]}::DOUBLE, {f}, {t}::DOUBLE, {left}, {share!r}::DOUBLE)" for f, t, left, share in path)
            leaf += 1
            return
        f, t, n, a, b = node
        for child, left in ((a, "true"), (b, "false")):
            walk(child, [*path, (f, t, left, child[2 if len(child) > 2 else 1] / n)])

    for tree in TREES:
        walk(tree, [])
    return "leaves AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") x(leaf, v, f, threshold, is_left, share))"


#: Shapley values by all subsets: the trees' expectations where a set of features is known, weighted over the sets without a feature.
SHAPLEY = f"""{FEATURES}, {_leaves()}, x AS (SELECT vec_id, target, unnest([f0, f1, f2, f3]) AS x, unnest([0, 1, 2, 3]) AS f FROM f),
 part AS (SELECT vec_id, s, leaf, any_value(v) * product(CASE WHEN (s >> l.f) & 1 = 1 THEN ((x <= threshold) = is_left)::INT::DOUBLE ELSE share END) AS p FROM x JOIN leaves l USING (f), range(16) r(s) GROUP BY vec_id, s, leaf),
 known AS (SELECT vec_id, s, sum(p) + {BIAS} AS e FROM part GROUP BY vec_id, s),
 shap AS (SELECT a.vec_id, f, sum((b.e - a.e) * [0.25, 1 / 12.0, 1 / 12.0, 0.25][bit_count(a.s::INT) + 1]) AS shap_value FROM known a JOIN range(4) q(f) ON (a.s >> f) & 1 = 0 JOIN known b ON b.vec_id = a.vec_id AND b.s = a.s | (1 << f) GROUP BY a.vec_id, f)"""

#: Each feature, then the group, each shuffled five times by the same hash.
PERMUTED = f"""{FEATURES}, e AS (SELECT *, {' + '.join(f'f{i} * ({w})' for i, w in enumerate(WEIGHTS))} - target AS e0 FROM f), g AS (SELECT * FROM (VALUES ('f0', [0]), ('f1', [1]), ('f2', [2]), ('f3', [3]), ('f0+f1', [0, 1])) x(g, m)),
 a AS (SELECT *, row_number() OVER (PARTITION BY g, r ORDER BY vec_id) AS p, row_number() OVER (PARTITION BY g, r ORDER BY md5('0:' || vec_id || ':' || g || ':' || r), vec_id) AS q FROM e, g, range(1, 6) x(r)),
 b AS (SELECT a.g, a.m, a.r, a.e0, {' + '.join(f'(CASE WHEN list_contains(a.m, {i}) THEN s.f{i} ELSE a.f{i} END) * ({w})' for i, w in enumerate(WEIGHTS))} - a.target AS e1 FROM a JOIN a s ON s.g = a.g AND s.r = a.r AND s.q = a.p),
 per AS (SELECT g, m, r, count(*) AS n, avg(abs(e1)) - avg(abs(e0)) AS mae, sqrt(avg(e1 * e1)) - sqrt(avg(e0 * e0)) AS rmse FROM b GROUP BY g, m, r)"""


def walked(name: str, features: list[str]) -> str:
    """Out-of-fold predictions of least squares by its closed form, for one feature or two."""
    x = features[-1]
    m = f"avg(actual) AS my, avg(prediction_a) AS ma, avg({x}) AS mb, covar_pop(actual, prediction_a) AS ya, covar_pop(actual, {x}) AS yb, var_pop(prediction_a) AS aa, var_pop({x}) AS bb, covar_pop(prediction_a, {x}) AS ab"
    if len(features) == 1:
        return f"{name} AS (SELECT row_id, my + ya / aa * (prediction_a - ma) AS {name} FROM valid JOIN (SELECT fold, {m} FROM train GROUP BY fold) USING (fold))"
    return f"{name} AS (SELECT row_id, my + (ya * bb - yb * ab) / (aa * bb - ab * ab) * (prediction_a - ma) + (yb * aa - ya * ab) / (aa * bb - ab * ab) * (prediction_b - mb) AS {name} FROM valid JOIN (SELECT fold, {m} FROM train GROUP BY fold) USING (fold))"


CV = f"""{EV}, ok AS (SELECT *, CAST(ts AS DATE) AS day, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS i FROM ev WHERE prediction_a IS NOT NULL), n AS (SELECT max(i) + 1 AS n FROM ok),
 starts AS (SELECT s, row_number() OVER (ORDER BY s) AS fold FROM (SELECT unnest(range(15, (SELECT n FROM n) - 4, 5)) AS s ORDER BY s DESC LIMIT 2)),
 train AS (SELECT fold, ok.* FROM ok JOIN starts ON i < s), valid AS (SELECT fold, ok.* FROM ok JOIN starts ON i >= s AND i < s + 5), {walked('cv_1', ['prediction_a'])}, {walked('cv_2', ['prediction_a', 'prediction_b'])}, oof AS (SELECT * FROM valid JOIN cv_1 USING (row_id) JOIN cv_2 USING (row_id))"""


def shifts(least: int, penalty: float, most: int) -> str:
    """Greedy binary segmentation, a split at a time."""
    out = f"""WITH {EV}, {errors()}, day AS (SELECT epoch_us(ts) // 86400000000 AS bin, avg(ec) AS y FROM candidate GROUP BY 1), n AS (SELECT count(*) AS n, avg(y) AS mean FROM day), top AS (SELECT max(abs(y - mean)) AS top FROM day, n),
 z AS (SELECT row_number() OVER (ORDER BY bin) - 1 AS i, bin, y, (y - mean) / top AS z FROM day, n, top), price AS (SELECT {penalty} * var_pop(z) * ln(count(*)) AS price FROM z), p AS (SELECT 0 AS k, 0.0::DOUBLE AS s UNION ALL SELECT i + 1, sum(z) OVER (ORDER BY i) FROM z), seg0 AS (SELECT 0 AS a, n AS b FROM n)"""
    for j in range(1, most + 1):
        out += f""", best{j} AS (SELECT {j}::BIGINT AS rank, g.a, k.k, g.b, greatest((k.s - pa.s) ** 2 / (k.k - g.a) + (pb.s - k.s) ** 2 / (g.b - k.k) - (pb.s - pa.s) ** 2 / (g.b - g.a), 0) AS gain FROM seg{j - 1} g JOIN p k ON k.k BETWEEN g.a + {least} AND g.b - {least} JOIN p pa ON pa.k = g.a JOIN p pb ON pb.k = g.b ORDER BY gain DESC, g.a, k.k LIMIT 1),
 ok{j} AS (SELECT best{j}.* FROM best{j}, price WHERE gain > price), seg{j} AS (SELECT a, b FROM seg{j - 1} ANTI JOIN ok{j} USING (a, b) UNION ALL SELECT a, k FROM ok{j} UNION ALL SELECT k, b FROM ok{j})"""
    at = lambda x: f"strftime(make_timestamp({x}), '%Y-%m-%d %H:%M:%S')"
    middle = "86400000000 + 43200000000"
    return out + f""" SELECT rank, {at(f'l.bin * {middle}')} AS left_time, {at(f'r.bin * {middle}')} AS right_time, {at(f'(l.bin + r.bin) * 43200000000 + 43200000000')} AS boundary_time, f.k - f.a AS left_n, f.b - f.k AS right_n,
 {r('(SELECT avg(y) FROM z WHERE i >= f.a AND i < f.k)', 'mean_before')}, {r('(SELECT avg(y) FROM z WHERE i >= f.k AND i < f.b)', 'mean_after')}, {r('gain', 'reduction_normalized')}, {r('price', 'penalty_normalized')}
 FROM ({' UNION ALL '.join(f'SELECT * FROM ok{j}' for j in range(1, most + 1))}) f JOIN z l ON l.i = f.k - 1 JOIN z r ON r.i = f.k, price"""


LINEITEMS = f"""ev AS (SELECT l_suppkey, l_extendedprice, l_returnflag, l_shipdate, l_quantity * p_retailprice AS prediction_a, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS prediction_b FROM lineitem JOIN part ON l_partkey = p_partkey),
 {errors(actual='l_extendedprice', time='l_shipdate', entity='l_suppkey')}"""
ORDERED = f"""ev AS (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS prediction_a, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prediction_b FROM orders),
 {errors(actual='o_totalprice', time='o_orderdate', entity='o_custkey')}"""
#: The normal quantile of p by Newton's steps; the distribution is its power series.
NORMAL = "z0 AS (SELECT p, greatest(-2.0, least(2.0, ln(p / (1 - p)) / 1.6)) AS x FROM p), " + ", ".join(
    f"z{i + 1} AS (SELECT p, x - (0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * x * list_sum(list_transform(range(80), lambda k: pow(x * x, k) * exp(0.5 * ln(pi()) - (k + 1) * ln(2) - lgamma(k + 1.5)))) - p) / (exp(-x * x / 2) / sqrt(2 * pi())) AS x FROM z{i})" for i in range(8)
)

ORACLE_SQL = {
    "coverage": gap_coverage(),
    "paired_summary": summary(),
    "gap_summary": f"WITH {GAP}, {GAP_ERRORS} SELECT {metrics()} FROM paired",
    "slice_metrics": sliced("segment"),
    "slice_numeric_bins": sliced("CASE WHEN actual < 0 OR actual > 100 THEN '(outside bins)' WHEN actual <= 10 THEN '(-0.001, 10.0]' WHEN actual <= 50 THEN '(10.0, 50.0]' ELSE '(50.0, 100.0]' END"),
    "slice_top_n": f"WITH {EV}, {errors()}, top AS (SELECT entity_id AS t FROM paired GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT coalesce(t, '(other)') AS \"group\", {metrics()} FROM paired LEFT JOIN top ON entity_id = t GROUP BY 1",
    "cross_slice": f"WITH {EV}, {errors()} SELECT segment AS x, {HOUR} AS y, {metrics()} FROM paired GROUP BY 1, 2",
    "daily": sliced("d", "date"),
    "date_sensitivity": f"WITH {EV}, {errors()}, day AS (SELECT d, sum(aec - aer) AS s, count(*) AS k FROM paired GROUP BY 1), tot AS (SELECT *, sum(s) OVER () AS ts, sum(k) OVER () AS tk FROM day) SELECT count(*) AS dates, sum(k)::BIGINT AS dated_rows, 0 AS missing_date_rows, {r('avg(s / k)', 'date_equal_delta')}, {r('min((ts - s) / (tk - k))', 'lodo_min')}, {r('max((ts - s) / (tk - k))', 'lodo_max')} FROM tot",
    "missingness": f"""WITH {GAP}, m AS (SELECT count(*) AS total, count(*) FILTER (row_id IS NULL) AS row_id, count(*) FILTER (ts IS NULL) AS ts, count(*) FILTER (entity_id IS NULL) AS entity_id, count(*) FILTER (segment IS NULL) AS segment, 0 AS actual,
 count(*) FILTER (prediction_a IS NULL) AS prediction_a, count(*) FILTER (prediction_b IS NULL) AS prediction_b, count(*) FILTER (off IS NULL) AS "offset" FROM gap),
 u AS (UNPIVOT m ON row_id, ts, entity_id, segment, actual, prediction_a, prediction_b, "offset" INTO NAME "column" VALUE missing_n) SELECT "column", missing_n, {r('missing_n * 100.0 / total', 'missing_pct')} FROM u""",
    "cases_harm": cases("aec - aer DESC"),
    "cases_help": cases("aec - aer"),
    "cases_absolute": cases("aec DESC"),
    "filter_range": summary("actual >= 10 AND actual < 90"),
    "filter_exact_ci": summary("segment IN ('click', 'view')"),
    "filter_contains": summary("segment LIKE '%i%'"),
    "filter_starts_with": summary("segment LIKE 'p%' OR segment LIKE 's%'"),
    "filter_ends_with": summary("segment LIKE '%w'"),
    "filter_missing": gap_coverage("entity_id IN ('1', '2', '3') OR entity_id IS NULL"),
    "filter_chain": summary("actual >= 5 AND segment = 'click'"),
    "paired_test_record": tests([], None, "ec * ec - er * er", digits=6),
    "paired_test_date": tests([]),
    "paired_test_entity": tests([], "e"),
    "slice_test_by": tests([('"group"', "segment")]),
    "slice_test_bh": tests([('"group"', "segment")], "e", correction="bh"),
    "cross_slice_test": tests([("x", "segment"), ("y", HOUR)]),
    "candidate_summary": f"WITH {EV}, {errors()}, {TAIL} SELECT {error_stats()}, count(DISTINCT e) AS entities, count(DISTINCT d) AS dates, 0 AS missing_date_rows, {r('max(threshold)', 'tail_threshold')}, count(*) FILTER (aec > threshold) AS tail_n, {r('count(*) FILTER (aec > threshold) * 100.0 / count(*)', 'tail_pct')}, {r('sum(aec) FILTER (aec > threshold) / max(total) * 100', 'tail_error_share_pct')} FROM candidate, tail",
    "calibration": f"""WITH {EV}, {errors()}, edge AS (SELECT list_sort(list_distinct(quantile_cont(cand, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM candidate),
 placed AS (SELECT *, len(list_filter(q[2:len(q) - 1], lambda z: z < cand)) AS b FROM candidate, edge)
 SELECT row_number() OVER (ORDER BY b) AS bin, count(*) AS n, {r('min(cand)', 'predicted_min')}, {r('max(cand)', 'predicted_max')}, {r('avg(cand)', 'mean_prediction')}, {r('avg(act)', 'mean_actual')}, {r('avg(ec)', 'candidate_bias')}, {r('avg(aec)', 'candidate_mae')} FROM placed GROUP BY b""",
    "residual_quantiles": f"WITH {EV}, {errors()}, q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS quantile, unnest(quantile_cont(ec, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS v FROM candidate) SELECT quantile, {r('v', 'signed_error')} FROM q",
    "worst_slices": f"""WITH {EV}, {errors()}, {TAIL}, each AS (SELECT 0 AS i, 'segment' AS spec, 'segment' AS "column", segment AS "group", ec, aec FROM candidate UNION ALL SELECT 1, 'hour', '__hour', {HOUR}, ec, aec FROM candidate),
 s AS (SELECT spec, "column", "group", avg(aec) AS raw, {error_stats()}, {r('sum(aec) / max(total) * 100', 'error_share_pct')}, count(*) FILTER (aec > threshold) AS tail_n, {r('coalesce(sum(aec) FILTER (aec > threshold), 0) / max(total) * 100', 'tail_error_share_pct')} FROM each, tail GROUP BY ALL)
 SELECT * EXCLUDE (raw) FROM s ORDER BY low_support, raw DESC LIMIT 6""",
    "worst_cases": f"WITH {EV}, {errors()} SELECT row_id, segment, {r('act', 'actual')}, {r('cand', 'candidate')}, {r('ec', 'signed_error')}, {r('aec', 'abs_error')}, d AS date, e AS entity FROM candidate ORDER BY aec DESC, row_id LIMIT 20",
    "candidate_daily": f"WITH {EV}, {errors()} SELECT d AS date, {error_stats()} FROM candidate GROUP BY 1",
    "clock_series": f"""WITH {SERIES} SELECT strftime(make_timestamp(bin * 21600000000), '%Y-%m-%d %H:%M:%S') AS time, strftime(make_timestamp(bin * 21600000000 + 10800000000), '%Y-%m-%d %H:%M:%S') AS time_center, n, entities, {r('bias', 'bias')}, {r('mae', 'mae')}, supported, {r('signal', 'signal')},
 {r('avg(signal) OVER (ORDER BY bin ROWS 3 PRECEDING)', 'rolling_signal')}, count(signal) OVER (ORDER BY bin ROWS 3 PRECEDING) AS rolling_supported_bins FROM series""",
    "clock_acf": f"""WITH {SERIES}, p AS (SELECT lag_bins, a.signal AS x, b.signal AS y FROM range(1, 9) l(lag_bins), series a JOIN series b ON b.bin = a.bin + lag_bins)
 SELECT lag_bins, {r('lag_bins * 21600.0', 'lag_seconds')}, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS pair_n, {r(CORR, 'correlation')} FROM p GROUP BY lag_bins""",
    "spectrum": f"""WITH {SERIES}, s AS (SELECT bin * 21600.0 + 10800 AS t, signal - avg(signal) OVER () AS y, min(bin * 21600.0 + 10800) OVER () AS t0, max(bin * 21600.0 + 10800) OVER () AS t1 FROM series WHERE signal IS NOT NULL),
 f AS (SELECT 2 / (max(t1) - max(t0)) + i * (1 / 86400.0 - 2 / (max(t1) - max(t0))) / 511 AS f FROM s, range(512) x(i) GROUP BY i),
 c AS (SELECT f, y, cos(2 * pi() * f * (t - t0)) AS c, sin(2 * pi() * f * (t - t0)) AS s FROM s, f),
 m AS (SELECT f, avg(y * y) AS yy, avg(y * c) AS yc, avg(y * s) AS ys, avg(c) AS mc, avg(s) AS ms, avg(c * c) - avg(c) * avg(c) AS pc, avg(s * s) - avg(s) * avg(s) AS ps, avg(c * s) - avg(c) * avg(s) AS pcs FROM c GROUP BY f)
 SELECT {r('f', 'frequency_hz', 6)}, {r('1 / f', 'period_seconds', 6)}, {r('(ps * yc * yc + pc * ys * ys - 2 * pcs * yc * ys) / (yy * (pc * ps - pcs * pcs))', 'power', 6)}, {r('mc * mc + ms * ms', 'sampling_window', 6)} FROM m""",
    "event_lags": f"""WITH {EV}, {errors()}, v AS (SELECT e, ts, avg(ec) AS y, count(*) AS k FROM candidate GROUP BY 1, 2), a AS (SELECT (SELECT count(*) FROM candidate) AS source_rows, sum(k)::BIGINT AS eligible_rows, count(*) AS distinct_events FROM v),
 p AS (SELECT lag_events, e, y, lag(y, lag_events) OVER w AS x, epoch_us(ts) - epoch_us(lag(ts, lag_events) OVER w) AS gap FROM v, range(1, 6) l(lag_events) WINDOW w AS (PARTITION BY lag_events, e ORDER BY ts))
 SELECT lag_events, count(*) AS pair_n, count(DISTINCT e) AS entity_n, {r(CORR, 'correlation')}, {r('quantile_cont(gap, 0.5) / 1e6', 'median_gap_seconds')}, {r('quantile_cont(gap, 0.9) / 1e6', 'p90_gap_seconds')}, 'ok' AS status,
 max(source_rows) AS source_rows, max(eligible_rows) AS eligible_rows, max(distinct_events) AS distinct_events, max(eligible_rows - distinct_events) AS tied_rows_collapsed FROM p, a WHERE gap IS NOT NULL GROUP BY lag_events""",
    "intraday_bins": f"""WITH {EV}, {errors()}, b AS (SELECT *, epoch_us(ts) // 3600000000 AS bin FROM paired), g AS (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1)) AS bin), m AS (SELECT bin, {metrics()} FROM b GROUP BY bin)
 SELECT strftime(make_timestamp(bin * 3600000000), '%Y-%m-%d %H:%M:%S') AS time, coalesce(n, 0) AS n, coalesce(entities, 0) AS entities, coalesce(dates, 0) AS dates, m.* EXCLUDE (bin, n, entities, dates, low_support), coalesce(n, 0) < 30 AS low_support, coalesce(n, 0) >= 30 AS supported FROM g LEFT JOIN m USING (bin)""",
    "residual_view": view("0.0", "er", "ec"),
    "level_view": view("act", "prediction_a", "cand"),
    "within_entity_view": view("act - mean", "prediction_a - mean", "cand - mean", "JOIN (SELECT e, avg(act) AS mean FROM paired GROUP BY e) USING (e)"),
    "attach_predictions": sliced("segment"),
    "from_long_predictions": f"WITH {LONG}, {errors()} SELECT {metrics()} FROM paired",
    "reselect_pair": summary(a="50.0"),
    "walk_forward_folds": folds("ts").replace("coalesce(l < v0, false)", "true"),
    "label_purge": folds("CAST(CASE WHEN event_id % 17 <> 0 THEN ts + INTERVAL 2 DAY END AS DATE)"),
    "model_scores": f"WITH {FEATURES} SELECT vec_id, {r('target + ' + ' + '.join(f'f{i} * ({w})' for i, w in enumerate(WEIGHTS)), 'prediction')} FROM f",
    "linear_shap": f"WITH {FEATURES}, c AS (" + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, {w} * (f{i} - avg(f{i}) OVER ()) AS x FROM f" for i, w in enumerate(WEIGHTS)) + f") SELECT feature, {r('avg(abs(x))', 'mean_abs_contribution')}, {r('avg(x)', 'mean_contribution')}, count(*) AS n FROM c GROUP BY 1",
    "permutation_importance": f"WITH {PERMUTED} SELECT g AS feature_group, max(n) AS n, {r('avg(mae)', 'mae_increase')}, {r('stddev_samp(mae)', 'mae_increase_sd')}, {r('avg(rmse)', 'rmse_increase')}, {r('stddev_samp(rmse)', 'rmse_increase_sd')}, count(*) AS repeats, array_to_string(list_transform(m, lambda i: 'f' || i), ',') AS feature_columns, len(m) AS feature_count FROM per GROUP BY g, m",
    "sampled_points": f"""WITH {EV}, {errors()}, top AS (SELECT segment AS t FROM paired GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), s AS (SELECT * FROM paired ORDER BY md5('0:' || row_id), row_id LIMIT 2000),
 v AS (SELECT row_id, CASE WHEN segment IS NULL THEN 'Missing (not supplied)' WHEN segment IN (SELECT t FROM top) THEN 'Value: ' || segment ELSE 'Other categories (display only)' END AS side, CASE WHEN actual > 0 THEN actual END AS q FROM s)
 SELECT row_id, side AS view_side, side AS view_color, {r('12 + 128 * sqrt(coalesce(q / max(q) OVER (), 0))', 'view_size')}, CASE WHEN q IS NULL THEN 'unknown/nonpositive' ELSE 'positive' END AS view_quantity_status FROM v""",
    "local_time": "SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "mean_shift": shifts(2, 0.1, 3),
    "linear_oof": f"WITH {CV} SELECT row_id, fold AS cv_fold, {r('cv_1', 'cv_1', 6)}, {r('cv_2', 'cv_2', 6)} FROM oof",
    "linear_cv": f"WITH {CV}, {errors('oof', a='cv_1', b='cv_2')} SELECT fold AS fold_id, any_value(t.k) AS train_finite_target_rows, count(*) AS validation_input_rows, {metrics(1.0, 6)} FROM paired JOIN (SELECT fold, count(*) AS k FROM train GROUP BY fold) t USING (fold) GROUP BY fold",
    "tree_contributions": f"WITH {SHAPLEY} SELECT vec_id, 'f' || f AS feature, {r('shap_value', 'shap_value')}, (SELECT {r('max(e)', 'e')} FROM known WHERE s = 0) AS base_value FROM shap",
    "tree_shap": f"WITH {SHAPLEY} SELECT 'f' || f AS feature, {r('2 * avg(abs(shap_value))', 'mean_abs_shap')}, {r('2 * avg(shap_value)', 'mean_signed_shap')}, count(*) AS n FROM shap GROUP BY f",
    "tree_residuals": f"WITH {SHAPLEY}, worst AS (SELECT vec_id FROM known WHERE s = 15 ORDER BY abs(e - 0.5) DESC, vec_id LIMIT 15) SELECT vec_id, 'f' || f AS feature, {r('shap_value', 'shap_value')}, {r('shap_value', 'shap_value_scaled')} FROM shap JOIN worst USING (vec_id)",
    "trade_audit": f"""WITH {EV}, {errors()}, n AS (SELECT count(*) AS n, count(DISTINCT d) AS days, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS span FROM paired),
 f AS (SELECT *, CASE WHEN span <= 3 THEN '30min' WHEN span <= 14 THEN '1h' ELSE '1D' END AS f, CASE WHEN span <= 3 THEN 1800000000 WHEN span <= 14 THEN 3600000000 ELSE 86400000000 END AS w FROM n), b AS (SELECT epoch_us(ts) // w AS b, count(*) AS k FROM paired, f GROUP BY 1), e AS (SELECT e, count(*) AS k FROM paired GROUP BY 1)
 SELECT f AS frequency, days AS local_dates, span AS calendar_span_days, n AS paired_rows, n AS timed_rows, least(n, 2000) AS plotted_rows, least(n, 2000) AS sampled_rows, (SELECT max(b) - min(b) + 1 FROM b) AS total_bins, (SELECT count(*) FROM b WHERE k >= 200) AS supported_bins, (SELECT max(b) - min(b) + 1 - count(*) FROM b) AS empty_bins,
 0::BIGINT AS missing_view_rows, 0::BIGINT AS missing_entity_rows, (SELECT count(*) FROM e WHERE k = 1) AS singleton_entity_rows, 'side' AS color_role FROM f""",
    "entity_focus": summary("e = '7'"),
    "temporal_summary": f"""WITH {GAP}, {GAP_ERRORS}, b AS (SELECT epoch_us(ts) // 21600000000 AS b, count(*) AS k FROM candidate GROUP BY 1), s AS (SELECT max(b) - min(b) + 1 AS total, count(*) AS occupied, count(*) FILTER (k >= 5) AS supported FROM b)
 SELECT (SELECT count(*) FROM candidate) AS total_rows, (SELECT count(ts) FROM candidate) AS timed_rows, 0::BIGINT AS missing_time_rows, total AS total_bins, occupied AS occupied_bins, supported AS supported_bins, occupied - supported AS unsupported_bins, total - occupied AS missing_bins, CASE WHEN supported > 0 THEN 'ok' ELSE 'no_supported_bins' END AS status, 'disabled' AS change_status FROM s""",
    "latest_folds": folds("ts").replace("coalesce(l < v0, false)", "true").replace("plan AS (SELECT row_number() OVER (ORDER BY s) AS fold, s FROM starts)", "plan AS (SELECT row_number() OVER (ORDER BY s) AS fold, s FROM (SELECT s FROM starts ORDER BY s DESC LIMIT 2))"),
    "saved_predictions": f"WITH {FEATURES}, p AS (SELECT vec_id, {' + '.join(f'f{i} * ({w})' for i, w in enumerate(WEIGHTS))} AS p FROM f) SELECT vec_id, {r('CASE WHEN vec_id % 7 = 0 THEN p + 1 END', 'saved')}, {r('p', 'again')} FROM p WHERE vec_id % 7 = 0 OR vec_id % 11 = 0",
    "filter_no_condition": gap_coverage("entity_id IS NOT NULL"),
    "filter_no_values": gap_coverage("entity_id IS NULL"),
    "remainder": f"""WITH {SHAPLEY}, k AS (SELECT vec_id, 'f' || f AS feature, round(shap_value, 9) AS v FROM shap), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, feature) AS rank FROM k)
 SELECT vec_id, rank, feature, {r('v', 'shap_value_scaled')} FROM o WHERE rank <= 2 UNION ALL SELECT vec_id, 3, 'Other 2 features', {r('sum(v)', 'shap_value_scaled')} FROM o WHERE rank > 2 GROUP BY vec_id""",
    "histogram": f"""WITH {LINEITEMS}, m AS (SELECT count(*) AS n, min(ec) AS lo, max(ec) AS hi, least(50, greatest(1, floor(sqrt(count(*)))::INT)) AS bins FROM candidate), edge AS (SELECT i AS bin, lo + (hi / bins - lo / bins) * i AS l, CASE WHEN i = bins - 1 THEN hi ELSE lo + (hi / bins - lo / bins) * (i + 1) END AS up, bins FROM m, range(50) q(i) WHERE i < bins)
 SELECT bin, {r('any_value(l)', '"left"', 5)}, {r('any_value(up)', '"right"', 5)}, count(ec) AS n FROM edge LEFT JOIN candidate ON ec >= l AND (ec < up OR (bin = bins - 1 AND ec = up)) GROUP BY bin""",
    "normal_quantiles": f"""WITH {ORDERED}, p AS (SELECT (i + 0.5) / 500 AS p FROM range(500) x(i)), {NORMAL}, n AS (SELECT quantile_cont(ec, [0.25, 0.5, 0.75]) AS q, quantile_cont(ec, {[(i + 0.5) / 500 for i in range(500)]}) AS o FROM candidate)
 SELECT {r('p', 'probability', 8)}, {r('x', 'theoretical', 8)}, {r('o[row_number() OVER (ORDER BY p)] / ((q[3] - q[1]) / (2 * 0.6744897501960817))', 'observed', 8)}, {r('q[2] / ((q[3] - q[1]) / (2 * 0.6744897501960817)) + x', 'reference', 8)} FROM z8, n""",
    "even_points": f"""WITH {ORDERED}, c AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n, o_orderkey, ec FROM candidate), w AS (SELECT DISTINCT CASE WHEN i = m - 1 THEN n - 1 ELSE floor(i * ((n - 1) / (m - 1)::DOUBLE))::BIGINT END AS position FROM (SELECT max(n) AS n, least(max(n), 3000) AS m FROM c), range(3000) x(i) WHERE i < m)
 SELECT position, o_orderkey, {r('ec', 'error_candidate', 6)} FROM c JOIN w USING (position)""",
    "source_positions": f"WITH {EV}, numbered AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS source_position FROM ev), {errors('numbered')} SELECT row_id, source_position, {r('aec', 'abs_error')} FROM candidate WHERE segment IN ('click', 'view') ORDER BY aec DESC, row_id LIMIT 50",
    "heatmap_grid": f"WITH {EV}, {errors()}, c AS (SELECT segment AS x, {HOUR} AS y, avg(aec) - avg(aer) AS v FROM paired GROUP BY 1, 2) SELECT x, " + ", ".join(r(f"max(v) FILTER (y = '{h}')", f'"{h}"') for h in HOUR_LABELS) + " FROM c GROUP BY x",
    "significance_grid": f"WITH t AS ({tests([('x', 'segment'), ('y', HOUR)])}) SELECT x, " + ", ".join(f"max(t_statistic) FILTER (y = '{h}') AS \"{h}\"" for h in HOUR_LABELS) + " FROM t GROUP BY x",
    "lineitem_slices": f"""WITH ev AS (SELECT l_suppkey, l_extendedprice, l_returnflag, l_shipdate, l_quantity * p_retailprice AS prediction_a, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS prediction_b FROM lineitem JOIN part ON l_partkey = p_partkey),
 {errors(actual='l_extendedprice', time='l_shipdate', entity='l_suppkey')} SELECT l_returnflag AS "group", {metrics(1000.0, 6)} FROM paired GROUP BY 1""",
    "orders_dates": f"""WITH ev AS (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS prediction_a, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prediction_b FROM orders),
 {errors(actual='o_totalprice', time='o_orderdate', entity='o_custkey')}, top AS (SELECT d AS t FROM paired GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 40) SELECT coalesce(t, '(other)') AS "group", {metrics(1000.0, 6)} FROM paired LEFT JOIN top ON d = t GROUP BY 1""",
}
