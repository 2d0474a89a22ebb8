"""DuckDB oracles of the trained kernel machines.

The dual of a hinge-loss SVM with intercept is solved in SQL itself: a recursive CTE holds one row per fit (run, machine,
parameters, held-out fold) with the lists alpha and gradient, and moves the pair of coordinates that gains most until no
pair of slopes differs by more than 1e-9. A held-out row has the upper bound 0, so that it never enters
a model; its decision value is read from its gradient. The optimum is unique, so both engines must agree.
"""

from __future__ import annotations

import re

from .oracle import SPLIT_W, _ap_sql, _auc_sql, _h, sql
from .oracle_fixtures import W
from .oracle_kernels import (BASE64, GRID_CTES, N, STUDY_CTES, SYM, bloch_select, custom2_sql, pauli_pair_expr, pauli_sql,
                             r6, zz2_sql)
from .params import CV_FOLDS, SEED

C_VALUES = "(VALUES (0.1::DOUBLE, 1), (1.0::DOUBLE, 2), (10.0::DOUBLE, 3)) cs(c, c_place)"

# R (run_id, idx, row_key, y, fold), KM (kid, row_at, ks), FITS (fit, run_id, kid, held, c, ...) -> S (fit, al, g)
SOLVER = ["""FU AS MATERIALIZED (
  SELECT fit, kid, list(2.0 * R.y - 1 ORDER BY idx) AS ys, list(CASE WHEN R.fold = held THEN 0.0 ELSE c END ORDER BY idx) AS ub
  FROM FITS JOIN R USING (run_id) GROUP BY fit, kid)""", """S(fit, al, g) USING KEY (fit) AS (
  SELECT fit, list_transform(ys, lambda v: 0.0::DOUBLE), list_transform(ys, lambda v: -1.0::DOUBLE) FROM FU
  UNION
  SELECT fit,
    list_transform(al, lambda v, t: CASE WHEN t = i THEN least(greatest(v + ys[i] * mv, 0), ub[i])
                                         WHEN t = j THEN least(greatest(v - ys[j] * mv, 0), ub[j]) ELSE v END),
    list_transform(list_zip(ys, g, ki, kj), lambda z: z[2] + z[1] * mv * (z[3] - z[4]))
  FROM (
    SELECT q.*, KM.ks AS kj,
      least((m - dn[j]) / greatest(2 - 2 * ki[j], 1e-12), CASE WHEN ys[i] > 0 THEN ub[i] - al[i] ELSE al[i] END,
            CASE WHEN ys[j] > 0 THEN al[j] ELSE ub[j] - al[j] END) AS mv
    FROM (
      SELECT *, list_position(gain, list_max(gain)) AS j FROM (
        SELECT p.*, KM.ks AS ki, list_transform(list_zip(dn, KM.ks),
          lambda z: CASE WHEN z[1] < m THEN (m - z[1]) * (m - z[1]) / greatest(2 - 2 * z[2], 1e-12) ELSE -1.0 END) AS gain
        FROM (
          SELECT *, list_max(up) AS m, list_position(up, list_max(up)) AS i FROM (
            SELECT S.fit, S.al, S.g, FU.kid, FU.ys, FU.ub,
              list_transform(list_zip(ys, g, al, ub), lambda z: CASE WHEN (z[1] > 0 AND z[3] < z[4]) OR (z[1] < 0 AND z[3] > 0) THEN -z[1] * z[2] ELSE -1e300 END) AS up,
              list_transform(list_zip(ys, g, al, ub), lambda z: CASE WHEN (z[1] > 0 AND z[3] > 0) OR (z[1] < 0 AND z[3] < z[4]) THEN -z[1] * z[2] ELSE 1e300 END) AS dn
            FROM S JOIN FU USING (fit))
          WHERE list_max(up) - list_min(dn) > 1e-9) p
        JOIN KM ON KM.kid = p.kid AND KM.row_at = p.i)) q
    JOIN KM ON KM.kid = q.kid AND KM.row_at = q.j))""", """SOL AS MATERIALIZED (
  SELECT fit, al, g, ys, (list_max(list_transform(list_zip(ys, g, al, ub), lambda z: CASE WHEN (z[1] > 0 AND z[3] < z[4]) OR (z[1] < 0 AND z[3] > 0) THEN -z[1] * z[2] ELSE -1e300 END))
    + list_min(list_transform(list_zip(ys, g, al, ub), lambda z: CASE WHEN (z[1] > 0 AND z[3] > 0) OR (z[1] < 0 AND z[3] < z[4]) THEN -z[1] * z[2] ELSE 1e300 END))) / 2 AS b
  FROM S JOIN FU USING (fit))""", """HELD AS (
  SELECT FITS.*, R.y, ys[R.idx] * (g[R.idx] + 1) + b AS score FROM SOL JOIN FITS USING (fit) JOIN R ON R.run_id = FITS.run_id AND R.fold = FITS.held)""",
    """CVF AS (
  SELECT run_id, model, params, c, place, held, CASE WHEN count(*) FILTER (WHERE score > 0 OR y = 1) = 0 THEN 0
      ELSE 2.0 * count(*) FILTER (WHERE score > 0 AND y = 1) / (count(*) FILTER (WHERE score > 0) + count(*) FILTER (WHERE y = 1)) END AS f1
  FROM HELD GROUP BY ALL)""", """CVT AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id, model ORDER BY round(mean_f1, 12) DESC, place) AS INTEGER) AS rank
  FROM (SELECT run_id, model, params, c, place, avg(f1) AS mean_f1, stddev_pop(f1) AS std_f1, count(*) AS folds FROM CVF GROUP BY ALL))""",
    """COEFS AS (
  SELECT FITS.run_id, FITS.model, FITS.params, FITS.c, R.row_key, R.y, al[R.idx] * ys[R.idx] AS coef, b,
    list_sum(list_transform(list_zip(al, g), lambda z: z[1] * (z[2] + 1))) / 2 + FITS.c * list_sum(list_transform(list_zip(ys, g), lambda z: greatest(0, -z[2] - z[1] * b))) AS objective
  FROM SOL JOIN FITS USING (fit) JOIN CVT ON CVT.run_id = FITS.run_id AND CVT.model = FITS.model AND CVT.params = FITS.params AND CVT.rank = 1
    JOIN R ON R.run_id = FITS.run_id WHERE FITS.held = -1 AND al[R.idx] > 0)"""]


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def _rows(src: str, seed: str) -> str:
    """R from scaled rows (run_id, row_key, y): place, fold by the rule of the stratified folds."""
    return f"""R AS MATERIALIZED (
  SELECT e.*, row_number() OVER (PARTITION BY run_id ORDER BY row_key) AS idx,
    CAST((coalesce((SELECT count(*) FROM {src} e2 WHERE e2.run_id = e.run_id AND e2.y < e.y), 0)
      + row_number() OVER (PARTITION BY run_id, y ORDER BY {_h('folds', seed)}, row_key) - 1) % {CV_FOLDS} AS INTEGER) AS fold
  FROM {src} e)"""


def _pairs(src: str) -> str:
    """All pairs of a run's rows as wide rows; keys are run|place."""
    return f"""AP AS (SELECT concat(v.run_id, '|', v.idx) AS i_key, concat(t.run_id, '|', t.idx) AS j_key,
    {', '.join(f'v.a{q} AS x{q}' for q in range(N))}, {', '.join(f't.a{q} AS z{q}' for q in range(N))}
  FROM {src} v JOIN {src} t ON v.run_id = t.run_id)"""


def _chain(name: str, chain_sql: str, prefix: str) -> str:
    """A kernel form as CTE ``name`` with raw values; its own CTEs get a prefix of their own."""
    text = chain_sql.strip()
    text = re.sub(r"round\((.*), 6\) \+ 0\.0 AS k", r"\1 AS k", text)
    if not text.startswith(","):
        return f"{name} AS ({text})"
    for cte in dict.fromkeys(re.findall(r"(\w+) AS \(SELECT", text)):
        text = re.sub(rf"\b{cte}\b", f"{prefix}{cte}", text).replace(f"{prefix}{cte} AS (", f"{prefix}{cte} AS MATERIALIZED (")
    head, _, tail = text.rpartition("\nSELECT ")
    return f"{head.lstrip(',').strip()},\n{name} AS (SELECT {tail})"


def _lists(kernel: str, kid: str) -> str:
    """Rows of KM from a pair kernel keyed by run|place."""
    return f"""SELECT concat('{kid}|', split_part(i_key, '|', 1)) AS kid, CAST(split_part(i_key, '|', 2) AS BIGINT) AS row_at,
    list(k ORDER BY CAST(split_part(j_key, '|', 2) AS BIGINT)) AS ks FROM {kernel} GROUP BY ALL"""


def _fidelity_fits(names: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT concat('{m}|', run_id, '|', held, '|', c) AS fit, run_id, concat('{k}|', run_id) AS kid, CAST(held AS INTEGER) AS held, c,
    '{m}' AS model, concat('C=', c) AS params, c_place AS place
  FROM (SELECT DISTINCT run_id FROM R), range(-1, {CV_FOLDS}) h(held), {C_VALUES}""" for m, k in names)


# ---------------------------------------------------------------- M3 on the 64-row subset
_ONE = ["ENC1 AS (SELECT 0 AS run_id, * FROM ENC)", _rows("ENC1", f"'{SEED}'"), _pairs("R")]
_ONE_CUSTOM = [*BASE64, *_ONE, _chain("KC", custom2_sql("AP", False), "c_"), f"KM AS MATERIALIZED ({_lists('KC', 'q')})",
               f"FITS AS MATERIALIZED ({_fidelity_fits([('QSVM', 'q')])})", *SOLVER]
sql("q_kernel_svm_cv", _with(*_ONE_CUSTOM) + f"""
SELECT params, c AS "C", {r6('mean_f1')} AS mean_f1, {r6('std_f1')} AS std_f1, folds, rank FROM CVT""")
sql("q_kernel_svm_coefficients", _with(*_ONE_CUSTOM) + """
SELECT row_key, y, c AS "C", round(coef, 5) + 0.0 AS coef, round(b, 5) + 0.0 AS intercept, round(objective, 5) + 0.0 AS objective FROM COEFS""")

_METRIC_SQL = f"""
  {r6('CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp)')} AS accuracy,
  {r6('(CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2')} AS balanced_accuracy,
  {r6('CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END')} AS precision,
  {r6('CAST(tp AS DOUBLE) / (tp + fn)')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END')} AS f1"""
_COUNTS = """count(*) FILTER (WHERE y = 0 AND score <= 0) AS tn, count(*) FILTER (WHERE y = 0 AND score > 0) AS fp,
  count(*) FILTER (WHERE y = 1 AND score <= 0) AS fn, count(*) FILTER (WHERE y = 1 AND score > 0) AS tp"""

sql("q_kernel_svm_eval", _with(
    *BASE64, *_ONE, f"KP AS ({pauli_sql('AP', 2, False)})", f"KM AS MATERIALIZED ({_lists('KP', 'q')})",
    f"FITS AS MATERIALIZED ({_fidelity_fits([('QSVM', 'q')])})", *SOLVER,
    f"SB AS (SELECT *, {bloch_select()} FROM ENC)", f"TB AS (SELECT *, {bloch_select()} FROM TENC)",
    f"""SC AS (SELECT i.row_key, i.y, sum(c.coef * {pauli_pair_expr()}) + any_value(c.b) AS score
       FROM TB i, SB j JOIN COEFS c ON c.row_key = j.row_key GROUP BY i.row_key, i.y)""",
    f"CM AS (SELECT {_COUNTS} FROM SC)") + f"""
SELECT tn, fp, fn, tp, (SELECT c FROM CVT WHERE rank = 1) AS "C",{_METRIC_SQL},
  {r6('CAST(tn AS DOUBLE) / (tn + fp)')} AS specificity, {r6('CAST(fp AS DOUBLE) / (tn + fp)')} AS false_positive_rate,
  {r6(_auc_sql('SC'))} AS roc_auc, {r6(_ap_sql('SC'))} AS average_precision,
  (SELECT {r6('mean_f1')} FROM CVT WHERE rank = 1) AS cv_f1_mean, (SELECT {r6('std_f1')} FROM CVT WHERE rank = 1) AS cv_f1_std
FROM CM""")

# ---------------------------------------------------------------- J7 / M6 on estimates from counts
def _estimate(src: str) -> str:
    return f"""len(list_filter(range(200), lambda s: ('0x' || substr(md5(concat_ws('~', '{SEED}', 'shot', {src}.i_key, {src}.j_key, s)), 1, 8))::BIGINT::DOUBLE
      / 4294967296 < {src}.k)) / 200::DOUBLE"""


_UPPER = [SYM, f"KU AS ({pauli_sql('PW', 2, False)})", f"KE AS MATERIALIZED (SELECT i_key, j_key, k, {_estimate('KU')} AS e FROM KU)",
          "KA AS MATERIALIZED (SELECT i_key, j_key, k, e FROM KE UNION ALL SELECT j_key, i_key, k, e FROM KE WHERE i_key <> j_key)"]
sql("q_kernel_compare_counts", _with(*BASE64, *_UPPER) + f"""
SELECT count(*) AS entries, {r6('avg(abs(k - e))')} AS mean_abs_diff, {r6('max(abs(k - e))')} AS max_abs_diff,
  {r6('avg(abs(e - 1)) FILTER (WHERE i_key = j_key)')} AS diagonal_deviation, 0::BIGINT AS only_first, 0::BIGINT AS only_second FROM KA""")

_CROSS = f"""TS AS (SELECT * FROM TENC ORDER BY {_h('sample')}, row_key LIMIT 64),
PT AS (SELECT i.row_key AS i_key, j.row_key AS j_key, {', '.join(f'i.a{q} AS x{q}' for q in range(N))}, {', '.join(f'j.a{q} AS z{q}' for q in range(N))} FROM TS i, ENC j),
KT AS ({pauli_sql('PT', 2, False)}),
KX AS MATERIALIZED (SELECT i_key, j_key, k, {_estimate('KT')} AS e FROM KT)"""
sql("q_two_kernel_svm", _with(
    *BASE64, *_UPPER, *_ONE[:2], _CROSS,
    """KM AS MATERIALIZED (SELECT kid, i.idx AS row_at, list(v ORDER BY j.idx) AS ks FROM (
      SELECT 'exact' AS kid, i_key, j_key, k AS v FROM KA UNION ALL SELECT 'counts', i_key, j_key, e FROM KA) a
      JOIN R i ON i.row_key = a.i_key JOIN R j ON j.row_key = a.j_key GROUP BY ALL)""",
    f"""FITS AS MATERIALIZED (SELECT concat(m, '|', held, '|', c) AS fit, 0 AS run_id, m AS kid, CAST(held AS INTEGER) AS held, c, m AS model, concat('C=', c) AS params,
      c_place AS place FROM (VALUES ('exact'), ('counts')) ms(m), range(-1, {CV_FOLDS}) h(held), {C_VALUES})""", *SOLVER,
    """SC AS (SELECT x.kernel, t.row_key, t.y, sum(c.coef * x.v) + any_value(c.b) AS score
      FROM (SELECT 'exact' AS kernel, i_key, j_key, k AS v FROM KX UNION ALL SELECT 'counts', i_key, j_key, e FROM KX) x
      JOIN COEFS c ON c.model = x.kernel AND c.row_key = x.j_key JOIN TS t ON t.row_key = x.i_key GROUP BY ALL)""",
    f"CM AS (SELECT kernel, {_COUNTS} FROM SC GROUP BY kernel)",
    "SE AS (SELECT * FROM SC WHERE kernel = 'exact')", "SS2 AS (SELECT * FROM SC WHERE kernel = 'counts')") + f"""
SELECT CM.kernel, c AS "C", {r6('mean_f1')} AS cv_f1, tn, fp, fn, tp,{_METRIC_SQL},
  {r6('CAST(tn AS DOUBLE) / (tn + fp)')} AS specificity, {r6('CAST(fp AS DOUBLE) / (tn + fp)')} AS false_positive_rate,
  CASE kernel WHEN 'exact' THEN {r6(_auc_sql('SE'))} ELSE {r6(_auc_sql('SS2'))} END AS roc_auc,
  CASE kernel WHEN 'exact' THEN {r6(_ap_sql('SE'))} ELSE {r6(_ap_sql('SS2'))} END AS average_precision
FROM CM JOIN CVT ON CVT.model = CM.kernel AND rank = 1""")

# ---------------------------------------------------------------- M4: maps x repeats
_MAPS = [("zz", "zz"), ("pauli", "pauli"), ("custom", "custom")]
_MSUBSET = STUDY_CTES[:6]
sql("q_map_study_svm", _with(
    W, *SPLIT_W, *_MSUBSET, _rows("MENC", "CAST(seed AS VARCHAR)"), _pairs("R"), f"KP AS ({pauli_sql('AP', 2, False)})",
    _chain("KC", custom2_sql("AP", False), "c_"), _chain("KZ", zz2_sql("AP"), "z_"),
    f"KM AS MATERIALIZED ({_lists('KP', 'pauli')} UNION ALL {_lists('KC', 'custom')} UNION ALL {_lists('KZ', 'zz')})",
    f"FITS AS MATERIALIZED ({_fidelity_fits(_MAPS)})", *SOLVER) + f"""
SELECT model AS feature_map, run_id AS repeat, c AS "C", {r6('mean_f1')} AS cv_f1 FROM CVT WHERE rank = 1""")

# ---------------------------------------------------------------- M5: sizes x repeats, both machines
_D2 = " + ".join(f"pow(v.f{q} - t.f{q}, 2)" for q in range(N))
_CELLS = " UNION ALL ".join(f"SELECT run_id, fold, f{q} AS v FROM R" for q in range(N))
_GRID_RBF = f"""SELECT concat('rbf|', run_id, '|', held, '|', c, '|', gamma) AS fit, run_id, concat('rbf|', run_id, '|', held, '|', gamma) AS kid,
    CAST(held AS INTEGER) AS held, c, 'SVM-RBF' AS model, concat('C=', c, ',gamma=', gamma) AS params, 3 * c_place + g_place AS place
  FROM (SELECT DISTINCT run_id FROM R), range(-1, {CV_FOLDS}) h(held), {C_VALUES}, (VALUES ('scale', 1), ('auto', 2), ('0.01', 3)) gs(gamma, g_place)"""
_SUBSETS = f"SUBF AS (SELECT s.*, r.seed, {', '.join(f'least(greatest(s.f{q}, -3), 3) / 3 * pi() AS a{q}' for q in range(N))} FROM SUBS s JOIN RUNS r USING (run_id))"
sql("q_compare_svm_pauli", _with(
    W, *SPLIT_W, *GRID_CTES[:8], _SUBSETS,  # runs, scaled subsets and test rows, with their Bloch vectors
    _rows("SUBF", "CAST(seed AS VARCHAR)"), _pairs("R"), f"KP AS ({pauli_sql('AP', 2, False)})",
    f"""WIDTHS AS (SELECT run_id, held, gamma, CASE gamma WHEN 'auto' THEN 1.0 / 9 WHEN '0.01' THEN 0.01 ELSE 1.0 / (9 * var_pop(v)) END AS w
      FROM ({_CELLS}), range(-1, {CV_FOLDS}) h(held), (VALUES ('scale'), ('auto'), ('0.01')) gs(gamma) WHERE fold <> held GROUP BY run_id, held, gamma)""",
    f"D2 AS (SELECT v.run_id, v.idx AS i, t.idx AS j, {_D2} AS d FROM R v JOIN R t ON v.run_id = t.run_id)",
    f"""KM AS MATERIALIZED ({_lists('KP', 'q')}
      UNION ALL SELECT concat('rbf|', run_id, '|', held, '|', gamma) AS kid, i AS row_at, list(exp(-w * d) ORDER BY j) AS ks FROM D2 JOIN WIDTHS USING (run_id) GROUP BY ALL)""",
    f"FITS AS MATERIALIZED ({_fidelity_fits([('QSVM', 'q')])} UNION ALL {_GRID_RBF})", *SOLVER,
    f"""BESTW AS (SELECT run_id, w FROM WIDTHS JOIN CVT USING (run_id) WHERE held = -1 AND rank = 1 AND model = 'SVM-RBF' AND params = concat('C=', c, ',gamma=', gamma))""",
    f"""SC AS (
      SELECT 'QSVM' AS model, i.run_id, i.row_key, i.y, sum(c.coef * {pauli_pair_expr()}) + any_value(c.b) AS score
      FROM TEB i JOIN SUBB j ON i.run_id = j.run_id JOIN COEFS c ON c.run_id = j.run_id AND c.row_key = j.row_key AND c.model = 'QSVM'
      GROUP BY i.run_id, i.row_key, i.y
      UNION ALL
      SELECT 'SVM-RBF', v.run_id, v.row_key, v.y, sum(c.coef * exp(-w * ({_D2}))) + any_value(c.b)
      FROM TES v JOIN SUBS t ON v.run_id = t.run_id JOIN COEFS c ON c.run_id = t.run_id AND c.row_key = t.row_key AND c.model = 'SVM-RBF'
        JOIN BESTW ON BESTW.run_id = v.run_id
      GROUP BY v.run_id, v.row_key, v.y)""",
    f"CM AS (SELECT model, run_id, {_COUNTS} FROM SC GROUP BY model, run_id)") + f"""
SELECT model, size AS subset_size, repeat,{_METRIC_SQL}, {r6('CAST(fp AS DOUBLE) / (tn + fp)')} AS false_positive_rate
FROM CM JOIN RUNS USING (run_id)""")
