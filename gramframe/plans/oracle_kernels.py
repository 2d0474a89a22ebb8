"""DuckDB oracles of the encoding, gate-table and kernel queries.

Kernel definitions used here (radians, a = row angles x0.., b = other row's angles z0..):
  pauli    product over features of single-qubit fidelities (1 + r(x).r(y)) / 2, the Bloch
           vector r followed through both repetitions gate by gate
  custom1  product over features of cos^2((a-b)/2) cos^2 d + cos^2((a+b)/2) sin^2 d, d = (a^2-b^2)/(2 pi)
  zz1, custom2, zz2   path sums over the chain, carried feature by feature (chained CTEs)
Complex numbers are (re, im) pairs of SQL expressions.
"""

from __future__ import annotations

from .oracle import FEATS, SPLIT_W, _h, _stats_sql, sql
from .oracle_fixtures import E as E_FIX
from .oracle_fixtures import W, with_
from .params import SEED

N = 9
PI = "pi()"


def sub_cte(name: str, size: int, src: str = "WT", seed: int = SEED) -> str:
    return f"""{name} AS (
  SELECT *, CAST(row_number() OVER (ORDER BY {_h('shuffle', f"'{seed}'")}, row_key) - 1 AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_h('subset', f"'{seed}'")}, row_key) AS rn FROM {src})
  WHERE rn <= {size // 2}
)"""


def scaled_cte(name: str, src: str, stats: str, extra: str = "") -> str:
    cols = ", ".join(
        f"(coalesce({c}, (SELECT median FROM {stats} WHERE feature = '{c}')) - (SELECT mean FROM {stats} WHERE feature = '{c}'))"
        f" / (SELECT sd FROM {stats} WHERE feature = '{c}') AS {c}" for c in FEATS)
    return f"{name} AS (SELECT row_key, y{extra}, {cols} FROM {src})"


def enc_cte(name: str, src: str, extra: str = "") -> str:
    cols = ", ".join(f"least(greatest({c}, -3), 3) / 3 * {PI} AS a{q}" for q, c in enumerate(FEATS))
    return f"{name} AS (SELECT row_key, y{extra}, {cols} FROM {src})"


def prepared_ctes(size: int, tag: str = "") -> list[str]:
    """Subset of `size`, its stats, the scaled subset/test split and their angles."""
    return [sub_cte(f"SUB{tag}", size), f"SS{tag} AS ({_stats_sql(f'SUB{tag}')})",
            scaled_cte(f"SUBP{tag}", f"SUB{tag}", f"SS{tag}", ", position"),
            scaled_cte(f"WEP{tag}", "WE", f"SS{tag}"),
            enc_cte(f"ENC{tag}", f"SUBP{tag}", ", position"), enc_cte(f"TENC{tag}", f"WEP{tag}")]


BASE64 = [W, *SPLIT_W, *prepared_ctes(64)]


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def pairs_wide(name: str, left: str, right: str, symmetric: bool) -> str:
    xs = ", ".join(f"i.a{q} AS x{q}" for q in range(N))
    zs = ", ".join(f"j.a{q} AS z{q}" for q in range(N))
    cond = "ON i.position <= j.position" if symmetric else "ON TRUE"
    return f"{name} AS (SELECT i.row_key AS i_key, j.row_key AS j_key, {xs}, {zs} FROM {left} i JOIN {right} j {cond})"


# ---------------------------------------------------------------- complex helpers
def cmul(a, b):
    (ar, ai), (br, bi) = a, b
    return (f"(({ar})*({br}) - ({ai})*({bi}))", f"(({ar})*({bi}) + ({ai})*({br}))")


def cadd(*zs):
    return ("(" + " + ".join(z[0] for z in zs) + ")", "(" + " + ".join(z[1] for z in zs) + ")")


def cexp(theta):
    return (f"cos({theta})", f"sin({theta})")


def conj(z):
    return (z[0], f"(-({z[1]}))")


def creal(x):
    return (f"({x})", "0.0")


# ---------------------------------------------------------------- product kernels
def pauli_sql(src_pairs: str, reps: int = 2, round_k: bool = True) -> str:
    """Bloch vectors gate by gate (Rz(a), Rx(theta) per repetition, H in between), per feature,
    then the product of single-qubit fidelities."""
    def bloch(v: str, q: int):
        a = f"{v}{q}"
        th = f"({a} / 2 + ({v}{q - 1} + {a}) / 2)" if q > 0 else f"({a} / 2)"
        x, y, z = "1.0", "0.0", "0.0"
        for rep in range(reps):
            x, y = f"(({x}) * cos({a}) - ({y}) * sin({a}))", f"(({x}) * sin({a}) + ({y}) * cos({a}))"
            y, z = f"(({y}) * cos({th}) - ({z}) * sin({th}))", f"(({y}) * sin({th}) + ({z}) * cos({th}))"
            if rep + 1 < reps:
                x, y, z = z, f"(-({y}))", x                  # Hadamard between repetitions
        return x, y, z

    factors = []
    for q in range(N):
        bx, bz = bloch("x", q), bloch("z", q)
        factors.append(f"((1 + ({bx[0]})*({bz[0]}) + ({bx[1]})*({bz[1]}) + ({bx[2]})*({bz[2]})) / 2)")
    k = " * ".join(factors)
    return f"SELECT i_key, j_key, {r6(k) if round_k else k} AS k FROM {src_pairs}"


def custom1_sql(src_pairs: str, round_k: bool = True) -> str:
    factors = []
    for q in range(N):
        a, b = f"x{q}", f"z{q}"
        d = f"(({a}*{a} - {b}*{b}) / (2 * {PI}))"
        factors.append(f"(pow(cos(({a} - {b}) / 2), 2) * pow(cos({d}), 2) + pow(cos(({a} + {b}) / 2), 2) * pow(sin({d}), 2))")
    k = " * ".join(factors)
    return f"SELECT i_key, j_key, {r6(k) if round_k else k} AS k FROM {src_pairs}"


# ---------------------------------------------------------------- recursions as chained CTEs
def zz1_sql(src_pairs: str) -> str:
    keep = "i_key, j_key"
    ctes = [f"Z0 AS (SELECT {keep}, cos((x0 - z0) / 2) AS ur, sin((x0 - z0) / 2) AS ui, "
            f"cos((x0 - z0) / 2) AS vr, -sin((x0 - z0) / 2) AS vi, * EXCLUDE (i_key, j_key) FROM {src_pairs})"]
    for q in range(1, N):
        w = f"((x{q - 1} * x{q} - z{q - 1} * z{q}) / (2 * {PI}))"
        dl = f"((x{q} - z{q}) / 2)"
        u, v = ("ur", "ui"), ("vr", "vi")
        up = cmul(cadd(cmul(u, cexp(w)), cmul(v, cexp(f"-{w}"))), cexp(dl))
        vp = cmul(cadd(cmul(u, cexp(f"-{w}")), cmul(v, cexp(w))), cexp(f"-{dl}"))
        ctes.append(f"Z{q} AS (SELECT {keep}, {up[0]} AS ur, {up[1]} AS ui, {vp[0]} AS vr, {vp[1]} AS vi, "
                    f"{', '.join(f'x{t}, z{t}' for t in range(N))} FROM Z{q - 1})")
    final = f"(pow(ur + vr, 2) + pow(ui + vi, 2)) / {4 ** N}"
    return ",\n" + ",\n".join(ctes) + f"\nSELECT i_key, j_key, {r6(final)} AS k FROM Z{N - 1}"


def _u_custom(a: str):
    """U(a) = Rz(a^2/pi) Ry(a): entries [[e- c, -e- s], [e+ s, e+ c]] as complex SQL pairs."""
    c, s, t = f"cos({a} / 2)", f"sin({a} / 2)", f"({a} * {a} / {PI})"
    em, ep = cexp(f"(-{t} / 2)"), cexp(f"({t} / 2)")
    return [[cmul(em, creal(c)), cmul(em, creal(f"-{s}"))], [cmul(ep, creal(s)), cmul(ep, creal(c))]]


def custom2_sql(src_pairs: str, round_k: bool = True) -> str:
    keep = "i_key, j_key, " + ", ".join(f"x{t}, z{t}" for t in range(N))
    names = {(p, pp): (f"t{p}{pp}r", f"t{p}{pp}i") for p in (0, 1) for pp in (0, 1)}
    ctes = []
    for q in range(N):
        ua, ub = _u_custom(f"x{q}"), _u_custom(f"z{q}")
        f = [ua[0][0], ua[1][0]]
        g = [ub[0][0], ub[1][0]]
        amat = {(p, pp): cadd(*[cmul(conj(ua[r][p]), ub[r][pp]) for r in (0, 1)]) for p in (0, 1) for pp in (0, 1)}
        cols = []
        for (p, pp), (nr, ni) in names.items():
            if q == 0:
                val = cmul(amat[(p, pp)], cmul(conj(f[p]), g[pp]))
            else:
                terms = [cmul(names[(o, oo)], cmul(conj(f[p ^ o]), g[pp ^ oo])) for o in (0, 1) for oo in (0, 1)]
                val = cmul(amat[(p, pp)], cadd(*terms))
            cols += [f"{val[0]} AS {nr}", f"{val[1]} AS {ni}"]
        src = src_pairs if q == 0 else f"C{q - 1}"
        ctes.append(f"C{q} AS (SELECT {keep}, {', '.join(cols)} FROM {src})")
    tot_r = " + ".join(v[0] for v in names.values())
    tot_i = " + ".join(v[1] for v in names.values())
    kk = f"pow({tot_r}, 2) + pow({tot_i}, 2)"
    return ",\n" + ",\n".join(ctes) + f"\nSELECT i_key, j_key, {r6(kk) if round_k else kk} AS k FROM C{N - 1}"


def zz2_sql(src_pairs: str) -> str:
    keep = "i_key, j_key, " + ", ".join(f"x{t}, z{t}" for t in range(N))
    states = [(s, t, u) for s in (1, -1) for t in (1, -1) for u in (1, -1)]

    def nm(st):
        tag = "".join("p" if v > 0 else "m" for v in st)
        return (f"s{tag}r", f"s{tag}i")

    def site(q, st):
        s, t, u = st
        bits = lambda v: 1 if v < 0 else 0
        sign = -1 if (bits(s) * bits(t) + bits(t) * bits(u)) % 2 else 1
        ph = f"(0.5 * (x{q} * ({s}) + (x{q} - z{q}) * ({t}) - z{q} * ({u})))"
        e = cexp(ph)
        return cmul(creal(f"{0.25 * sign}"), e)

    ctes = []
    for q in range(N):
        cols = []
        for st in states:
            if q == 0:
                val = site(0, st)
            else:
                al = f"(x{q - 1} * x{q} / {PI})"
                be = f"(z{q - 1} * z{q} / {PI})"
                terms = []
                for so in states:
                    ph = (f"(0.5 * ({al} * ({st[0] * so[0]}) + ({al} - {be}) * ({st[1] * so[1]})"
                          f" - {be} * ({st[2] * so[2]})))")
                    terms.append(cmul(nm(so), cexp(ph)))
                val = cmul(site(q, st), cadd(*terms))
            n_ = nm(st)
            cols += [f"{val[0]} AS {n_[0]}", f"{val[1]} AS {n_[1]}"]
        src = src_pairs if q == 0 else f"Q{q - 1}"
        ctes.append(f"Q{q} AS (SELECT {keep}, {', '.join(cols)} FROM {src})")
    tot_r = " + ".join(nm(st)[0] for st in states)
    tot_i = " + ".join(nm(st)[1] for st in states)
    return ",\n" + ",\n".join(ctes) + f"\nSELECT i_key, j_key, {r6(f'pow({tot_r}, 2) + pow({tot_i}, 2)')} AS k FROM Q{N - 1}"


# ---------------------------------------------------------------- registered oracles
SYM = pairs_wide("PW", "ENC", "ENC", True)
RECT = pairs_wide("PR", "TENC", "ENC", False)

sql("q_angle_encode", with_(*BASE64) + f"SELECT row_key, {', '.join(r6(f'a{q}') + f' AS a{q}' for q in range(N))} FROM TENC")


# (stage inside a repetition, 1 for pairs, place, gate, angle SQL of x and its neighbour y)
GATE_STAGES = {
    "zz": [(1, 0, 1, "Rz", "x"), (2, 1, 1, "CX", None), (2, 1, 2, "Rz", f"x * y / {PI}"), (2, 1, 3, "CX", None), (3, 0, 1, "H", None)],
    "pauli": [(1, 0, 1, "Rz", "x"), (1, 0, 2, "Rx", "x / 2"), (2, 1, 1, "CX", None), (2, 1, 2, "Rx", "(x + y) / 2"),
              (2, 1, 3, "CX", None), (3, 0, 1, "H", None)],
    "custom": [(1, 0, 1, "Ry", "x"), (1, 0, 2, "Rz", f"x * x / {PI}"), (2, 1, 1, "CX", None)],
}


def gate_table_sql(name: str, reps: int = 2) -> str:
    """Stages x repetitions x units as a join, numbered by a window: H (stage 3) follows every repetition
    but the last, counting a repetition 0 that holds nothing else."""
    per_stage = " UNION ALL ".join(
        f"SELECT row_key, rep, {stage} AS stage, {place} AS place, '{gate}' AS gate, unit, unit + {pair} AS qubit, "
        f"{'unit' if gate == 'CX' else 'NULL'} AS control, {r6(angle) if angle else 'CAST(NULL AS DOUBLE)'} AS angle "
        f"FROM UNITS WHERE unit < {N - pair} AND {f'rep < {reps}' if gate == 'H' else 'rep > 0'}"
        for stage, pair, place, gate, angle in GATE_STAGES[name])
    listed = ", ".join(f"a{q}" for q in range(N))
    return f"""
SELECT row_key, '{name}' AS feature_map,
       CAST(row_number() OVER (PARTITION BY row_key ORDER BY rep, stage, unit, place) - 1 AS INTEGER) AS step,
       CAST(rep AS INTEGER) AS repetition, gate, CAST(qubit AS INTEGER) AS qubit, CAST(control AS INTEGER) AS control,
       CAST(angle AS DOUBLE) AS angle
FROM (WITH UNITS AS (SELECT row_key, rep, unit, [{listed}][unit + 1] AS x, [{listed}][unit + 2] AS y
                     FROM ENC, range(0, {reps + 1}) r(rep), range(0, {N}) u(unit))
      {per_stage})"""


for _m in ("zz", "pauli", "custom"):
    sql(f"q_map_params_{_m}", with_(*BASE64) + gate_table_sql(_m))

sql("q_map_gate_count", with_(*BASE64) + f"""
SELECT feature_map, gate, count(*) AS gates, count(DISTINCT row_key) AS rows,
       CAST(count(*) / count(DISTINCT row_key) AS BIGINT) AS gates_per_row
FROM ({gate_table_sql('zz')} UNION ALL {gate_table_sql('pauli')} UNION ALL {gate_table_sql('custom')})
GROUP BY feature_map, gate""")

sql("q_pairs_symmetric", with_(*BASE64) + """
SELECT i.row_key AS i_key, j.row_key AS j_key, i.position AS i_pos, j.position AS j_pos
FROM ENC i JOIN ENC j ON i.position <= j.position""")

sql("q_pairs_rect", with_(*BASE64) + "SELECT i.row_key AS i_key, j.row_key AS j_key FROM TENC i, ENC j")

sql("q_kernel_pauli", with_(*BASE64, SYM) + pauli_sql("PW"))
sql("q_kernel_custom_r1", with_(*BASE64, SYM) + custom1_sql("PW"))
sql("q_kernel_zz_r1", with_(*BASE64, SYM) + zz1_sql("PW"))
sql("q_kernel_custom_r2", with_(*BASE64, SYM) + custom2_sql("PW"))
sql("q_kernel_zz_r2", with_(*BASE64, SYM) + zz2_sql("PW"))
sql("q_kernel_pauli_test", with_(*BASE64, RECT) + pauli_sql("PR"))
sql("q_kernel_custom_r2_test", with_(*BASE64, RECT) + custom2_sql("PR"))

_GAMMA = f"""GAM AS (SELECT 1.0 / (9 * var_pop(v)) AS g FROM (
  {' UNION ALL '.join(f'SELECT {c} AS v FROM SUBP' for c in FEATS)}))"""
sql("q_gamma_scale", with_(*BASE64, _GAMMA) + f"SELECT {r6('g')} AS gamma_scale, CAST(1.0 / 9 AS DOUBLE) AS gamma_auto FROM GAM")

sql("q_kernel_rbf", with_(*BASE64, _GAMMA) + f"""
SELECT i.row_key AS i_key, j.row_key AS j_key,
       {r6('exp(-(SELECT g FROM GAM) * (' + ' + '.join(f'pow(i.{c} - j.{c}, 2)' for c in FEATS) + '))')} AS k
FROM SUBP i JOIN SUBP j ON i.position <= j.position""")

sql("q_kernel_vectors", with_(E_FIX, sub_cte("LM", 64, "E")) + f"""
SELECT e.row_key AS i_key, l.row_key AS j_key, {r6('pow(list_inner_product(e.vec, l.vec), 2)')} AS k
FROM E e, LM l""")

sql("q_vectors_diagnostics", with_(E_FIX) + f"""
, P AS (SELECT i.row_key = j.row_key AS diag, i.y = j.y AS same, pow(list_dot_product(i.vec, j.vec), 2) AS k FROM E i, E j),
A AS (SELECT (SELECT count(*) FROM E) AS n, coalesce(avg(k) FILTER (WHERE NOT diag AND same), 0) AS w, coalesce(avg(k) FILTER (WHERE NOT diag AND NOT same), 0) AS b,
        avg(k) FILTER (WHERE NOT diag) AS o, sum(CASE WHEN same THEN k ELSE -k END) AS kt, sum(k * k) AS kk, sum(k) FILTER (WHERE diag) AS t FROM P)
SELECT n, {r6('w')} AS within_class_mean, {r6('b')} AS between_class_mean, {r6('w - b')} AS separation, {r6('o')} AS off_diagonal_mean,
  {r6('kt / (sqrt(kk) * n)')} AS kernel_target_alignment, {r6('t')} AS trace, {r6('kk')} AS frobenius2, {r6('t * t / kk')} AS participation_ratio FROM A""")

# pivoted incomplete Cholesky of <u, v>^2, a step a recursion: K - sum of the factor products so far
_CHOL = "WITH RECURSIVE " + E_FIX + """,
S AS (
  SELECT 0 AS step, row_key, vec, pow(list_inner_product(vec, vec), 2) AS d, []::DOUBLE[] AS l, NULL::VARCHAR AS taken, NULL::DOUBLE AS pd FROM E
  UNION ALL
  SELECT step + 1, row_key, vec, greatest(d - f * f, 0), list_append(l, f), pk, pres
  FROM (SELECT s.*, p.row_key AS pk, p.d AS pres,
          (pow(list_inner_product(s.vec, p.vec), 2) - CASE WHEN s.step = 0 THEN 0 ELSE list_inner_product(s.l, p.l) END) / sqrt(p.d) AS f
        FROM S s, (SELECT * FROM S ORDER BY round(d, 10) DESC, row_key LIMIT 1) p
        WHERE s.step < 24 AND round(p.d, 10) > 1e-9))
"""
sql("q_kernel_low_rank", _CHOL + f"""
SELECT step, taken AS row_key, {r6('pd')} AS pivot_residual, {r6('(SELECT sum(d) FROM S WHERE step = 0)')} AS trace, {r6('sum(d)')} AS residual_trace
FROM S WHERE step > 0 GROUP BY step, taken, pd""")
sql("q_kernel_low_rank_factors", _CHOL + """
SELECT row_key, unnest(range(1, step + 1))::INTEGER AS step, round(unnest(l), 5) + 0.0::DOUBLE AS factor, round(d, 5) + 0.0::DOUBLE AS residual
FROM S WHERE step = (SELECT max(step) FROM S)""")

sql("q_pair_budget", with_(W, *SPLIT_W) + """
SELECT CAST(8 AS INTEGER) AS subset_size, least(m, 8) AS eval_size, CAST(36 AS BIGINT) AS train_pairs,
       least(m, 8) * 8 AS test_pairs, 36 + least(m, 8) * 8 AS circuits, (36 + least(m, 8) * 8) * 200 AS total_shots
FROM (SELECT count(*) AS m FROM WE)""")

FULL = pairs_wide("PF", "ENC", "ENC", False)
sql("q_kernel_sanity", with_(*BASE64, FULL) + f"""
, KF AS ({pauli_sql('PF', 2, False)}),
M AS (SELECT max(abs(a.k - b.k)) AS asym, max(CASE WHEN a.i_key = a.j_key THEN abs(a.k - 1) END) AS diag, min(a.k) AS lo, max(a.k) AS hi, count(*) AS entries
      FROM KF a JOIN KF b ON a.i_key = b.j_key AND a.j_key = b.i_key)
SELECT {r6('asym')} AS max_asymmetry, {r6('diag')} AS max_diagonal_error, {r6('lo')} AS min_k, {r6('hi')} AS max_k, entries,
  asym <= 1e-8 AS symmetric, diag <= 1e-8 + 1e-5 AS unit_diagonal, lo >= -1e-8 AND hi <= 1 + 1e-8 + 1e-5 AS in_range FROM M""")

# ---------------------------------------------------------------- phase 4
from .oracle_fixtures import C as C_FIX  # noqa: E402

sql("q_outcome_probability", with_(C_FIX) + f"""
SELECT i, j, {r6("CAST(coalesce(sum(n) FILTER (WHERE outcome = 'view'), 0) AS DOUBLE) / sum(n)")} AS p,
       CAST(sum(n) AS BIGINT) AS shots
FROM C GROUP BY i, j""")

sql("q_kernel_mirror", with_(C_FIX) + f"""
, P AS (SELECT i, j, CAST(coalesce(sum(n) FILTER (WHERE outcome = 'view'), 0) AS DOUBLE) / sum(n) AS p
      FROM (SELECT least(i, j) AS i, greatest(i, j) AS j, outcome, n FROM C) GROUP BY i, j),
G AS (SELECT CAST(a.r AS INTEGER) AS i, CAST(b.r AS INTEGER) AS j
      FROM range(0, (SELECT greatest(max(i), max(j)) + 1 FROM P)) a(r), range(0, (SELECT greatest(max(i), max(j)) + 1 FROM P)) b(r))
SELECT G.i, G.j, {r6('coalesce(P.p, 0)')} AS k, P.p IS NOT NULL AS present
FROM G LEFT JOIN P ON P.i = least(G.i, G.j) AND P.j = greatest(G.i, G.j)""")

sql("q_kernel_compare", with_(*BASE64, FULL) + f"""
, KP AS ({pauli_sql('PF', 1, False)}),
KC AS ({custom1_sql('PF', False)})
SELECT count(*) AS entries, {r6('avg(abs(KP.k - KC.k))')} AS mean_abs_diff, {r6('max(abs(KP.k - KC.k))')} AS max_abs_diff,
       {r6('avg(CASE WHEN KC.i_key = KC.j_key THEN abs(KC.k - 1) END)')} AS diagonal_deviation,
       count(*) FILTER (WHERE KP.k IS NULL) AS only_first, count(*) FILTER (WHERE KC.k IS NULL) AS only_second
FROM KP FULL OUTER JOIN KC ON KP.i_key = KC.i_key AND KP.j_key = KC.j_key""")

FOLDS_SUB = f"""FS AS (
  SELECT row_key, CAST((coalesce((SELECT count(*) FROM ENC e2 WHERE e2.y < e.y), 0)
             + row_number() OVER (PARTITION BY y ORDER BY {_h('folds')}, row_key) - 1) % 5 AS INTEGER) AS fold
  FROM ENC e)"""
sql("q_kernel_fold_slice", with_(*BASE64, FULL, FOLDS_SUB) + f"""
, KF AS ({pauli_sql('PF', 2, False)})
SELECT CAST(f.r AS INTEGER) AS fold, CASE WHEN fi.fold <> f.r THEN 'train' ELSE 'validate' END AS block,
       KF.i_key, KF.j_key, {r6('KF.k')} AS k
FROM KF JOIN FS fi ON fi.row_key = KF.i_key JOIN FS fj ON fj.row_key = KF.j_key, range(5) f(r)
WHERE fj.fold <> f.r""")

SYM_LAB = "LAB AS (SELECT K.*, a.y AS yi, b.y AS yj FROM K JOIN ENC a ON a.row_key = K.i_key JOIN ENC b ON b.row_key = K.j_key)"


def diag_sql() -> str:
    """Definitions over the full matrix (both triangles from the i <= j half)."""
    return f"""
, FULLK AS (SELECT i_key, j_key, k, yi, yj FROM LAB UNION ALL
            SELECT j_key, i_key, k, yj, yi FROM LAB WHERE i_key <> j_key)
SELECT CAST(count(*) FILTER (WHERE i_key = j_key) AS BIGINT) AS n,
  {r6('coalesce(avg(k) FILTER (WHERE i_key <> j_key AND yi = yj), 0)')} AS within_class_mean,
  {r6('coalesce(avg(k) FILTER (WHERE i_key <> j_key AND yi <> yj), 0)')} AS between_class_mean,
  {r6('coalesce(avg(k) FILTER (WHERE i_key <> j_key AND yi = yj), 0) - coalesce(avg(k) FILTER (WHERE i_key <> j_key AND yi <> yj), 0)')} AS separation,
  {r6('avg(k) FILTER (WHERE i_key <> j_key)')} AS off_diagonal_mean,
  {r6('sum(k * CASE WHEN yi = yj THEN 1 ELSE -1 END) / (sqrt(sum(k * k)) * count(*) FILTER (WHERE i_key = j_key))')} AS kernel_target_alignment
FROM FULLK"""


sql("q_kernel_diagnostics", with_(*BASE64, SYM) + f", K AS ({custom2_sql('PW')[2:].split(chr(10) + 'SELECT')[0]}" if False else
    with_(*BASE64, SYM) + custom2_sql("PW", False).replace("\nSELECT i_key, j_key, ", ",\nK AS (SELECT i_key, j_key, ", 1)
    .rstrip() + ")," + SYM_LAB + "\nSELECT n, within_class_mean, between_class_mean, separation, off_diagonal_mean FROM (" +
    diag_sql().replace("\n, FULLK", "WITH FULLK", 1) + ")")

sql("q_kernel_alignment", with_(*BASE64, SYM) + f", K AS ({pauli_sql('PW', 2, False)}), {SYM_LAB}"
    + "\nSELECT kernel_target_alignment FROM (" + diag_sql().replace("\n, FULLK", "WITH FULLK", 1) + ")")

sql("q_kernel_participation", with_(*BASE64, SYM) + f""", K AS ({pauli_sql('PW', 2, False)})
SELECT {r6('sum(k) FILTER (WHERE i_key = j_key)')} AS trace,
       {r6('sum(CASE WHEN i_key = j_key THEN 1 ELSE 2 END * k * k)')} AS frobenius2,
       {r6('pow(sum(k) FILTER (WHERE i_key = j_key), 2) / sum(CASE WHEN i_key = j_key THEN 1 ELSE 2 END * k * k)')} AS participation_ratio
FROM K""")

sql("q_kernel_reorder", with_(*BASE64, FULL) + f""", KF AS ({pauli_sql('PF', 2, False)}),
O AS (SELECT row_key, CAST(row_number() OVER (ORDER BY y, position) - 1 AS INTEGER) AS new_index FROM ENC)
SELECT a.new_index AS i_new, b.new_index AS j_new, {r6('KF.k')} AS k,
       (SELECT count(*) FROM ENC WHERE y = 0) AS boundary
FROM KF JOIN O a ON a.row_key = KF.i_key JOIN O b ON b.row_key = KF.j_key""")

SCORE = f""", PT AS (SELECT i.row_key AS i_key, j.row_key AS j_key, i.y AS yi,
      CASE WHEN j.y = 1 THEN 1.0 / (SELECT count(*) FROM ENC WHERE y = 1) ELSE -1.0 / (SELECT count(*) FROM ENC WHERE y = 0) END AS coef,
      {', '.join(f'i.a{q} AS x{q}' for q in range(N))}, {', '.join(f'j.a{q} AS z{q}' for q in range(N))}
    FROM TENC i, ENC j),
KS AS (SELECT i_key, yi, coef, {pauli_sql('PT', 2, False).split('SELECT i_key, j_key, ')[1].split(' AS k FROM')[0]} AS k FROM PT),
S AS (SELECT i_key AS row_key, yi AS y, sum(coef * k) AS score FROM KS GROUP BY i_key, yi)"""

sql("q_kernel_score", with_(*BASE64).rstrip() + SCORE + f"""
SELECT row_key, y, {r6('score')} AS score, CAST(score > 0 AS INTEGER) AS pred FROM S""")

from .oracle import _ap_sql, _auc_sql  # noqa: E402

sql("q_kernel_score_metrics", with_(*BASE64).rstrip() + SCORE + f""",
SR AS (SELECT row_key, y, score, CAST(score > 0 AS INTEGER) AS pred FROM S),
CM AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM SR)
SELECT tn, fp, fn, tp,
  {r6('CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp)')} AS accuracy,
  {r6('CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END')} AS balanced_accuracy,
  {r6('CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END')} AS precision,
  {r6('CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END')} AS f1,
  {r6('CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END')} AS specificity,
  {r6('CASE WHEN tn + fp > 0 THEN CAST(fp AS DOUBLE) / (tn + fp) ELSE 0 END')} AS false_positive_rate,
  {r6(_auc_sql('SR'))} AS roc_auc, {r6(_ap_sql('SR'))} AS average_precision
FROM CM""")

# ---------------------------------------------------------------- phase 5/6: run grids, bench
def bloch_select(reps: int = 2, src_prefix: str = "a") -> str:
    """Per-row Bloch vectors b{x,y,z}{q} of the pauli map (gate by gate)."""
    cols = []
    for q in range(N):
        a = f"{src_prefix}{q}"
        th = f"({a} / 2 + ({src_prefix}{q - 1} + {a}) / 2)" if q > 0 else f"({a} / 2)"
        x, y, z = "1.0", "0.0", "0.0"
        for rep in range(reps):
            x, y = f"(({x}) * cos({a}) - ({y}) * sin({a}))", f"(({x}) * sin({a}) + ({y}) * cos({a}))"
            y, z = f"(({y}) * cos({th}) - ({z}) * sin({th}))", f"(({y}) * sin({th}) + ({z}) * cos({th}))"
            if rep + 1 < reps:
                x, y, z = z, f"(-({y}))", x
        cols += [f"{x} AS bx{q}", f"{y} AS by{q}", f"{z} AS bz{q}"]
    return ", ".join(cols)


def pauli_pair_expr(li: str = "i", lj: str = "j") -> str:
    return " * ".join(f"((1 + {li}.bx{q} * {lj}.bx{q} + {li}.by{q} * {lj}.by{q} + {li}.bz{q} * {lj}.bz{q}) / 2)"
                      for q in range(N))


ANG = ", ".join(f"least(greatest(f{q}, -3), 3) / 3 * {PI} AS a{q}" for q in range(N))

RUNS5 = """RUNS AS (
  SELECT CAST(si * 5 + r AS INTEGER) AS run_id, CAST(size AS INTEGER) AS size, CAST(r AS INTEGER) AS repeat,
         CAST(20260802 + 100 * size + r AS INTEGER) AS seed
  FROM (VALUES (0, 16), (1, 32), (2, 64)) s(si, size), range(5) t(r)
)"""

GRID_CTES = [RUNS5, f"""SUBR AS (
  SELECT * FROM (SELECT RUNS.run_id, RUNS.size, RUNS.seed, WT.*,
                        row_number() OVER (PARTITION BY run_id, WT.y ORDER BY {_h('subset', 'CAST(seed AS VARCHAR)')}, row_key) AS rn
                 FROM RUNS, WT) WHERE rn <= size / 2)""",
    "MED AS (SELECT run_id, " + ", ".join(f"median(f{q}) AS m{q}" for q in range(N)) + " FROM SUBR GROUP BY run_id)",
    "STR AS (SELECT s.run_id, " + ", ".join(
        f"any_value(m{q}) AS m{q}, avg(coalesce(f{q}, m{q})) AS u{q}, "
        f"CASE WHEN stddev_pop(coalesce(f{q}, m{q})) = 0 THEN 1.0 ELSE stddev_pop(coalesce(f{q}, m{q})) END AS d{q}"
        for q in range(N)) + " FROM SUBR s JOIN MED USING (run_id) GROUP BY s.run_id)",
    "SUBS AS (SELECT run_id, row_key, y, " + ", ".join(f"(coalesce(f{q}, m{q}) - u{q}) / d{q} AS f{q}" for q in range(N))
    + " FROM SUBR JOIN STR USING (run_id))",
    "TES AS (SELECT run_id, row_key, y, " + ", ".join(f"(coalesce(f{q}, m{q}) - u{q}) / d{q} AS f{q}" for q in range(N))
    + " FROM WE, STR)",
    f"SUBB AS (SELECT *, {bloch_select()} FROM (SELECT *, {ANG} FROM SUBS))",
    f"TEB AS (SELECT *, {bloch_select()} FROM (SELECT *, {ANG} FROM TES))",
    "COEF AS (SELECT run_id, row_key, CASE WHEN y = 1 THEN 1.0 / count(*) OVER (PARTITION BY run_id, y) "
    "ELSE -1.0 / count(*) OVER (PARTITION BY run_id, y) END AS coef FROM SUBS)",
    "GAMMA AS (SELECT run_id, 1.0 / (9 * var_pop(v)) AS g FROM (" + " UNION ALL ".join(
        f"SELECT run_id, f{q} AS v FROM SUBS" for q in range(N)) + ") GROUP BY run_id)",
    f"""SCORES AS (
  SELECT 'QSVM' AS model, i.run_id, i.row_key, i.y, sum(c.coef * {pauli_pair_expr()}) AS score
  FROM TEB i JOIN SUBB j ON i.run_id = j.run_id JOIN COEF c ON c.run_id = j.run_id AND c.row_key = j.row_key
  GROUP BY i.run_id, i.row_key, i.y
  UNION ALL
  SELECT 'SVM-RBF', i.run_id, i.row_key, i.y,
         sum(c.coef * exp(-g.g * ({' + '.join(f'pow(i.f{q} - j.f{q}, 2)' for q in range(N))})))
  FROM TES i JOIN SUBS j ON i.run_id = j.run_id JOIN COEF c ON c.run_id = j.run_id AND c.row_key = j.row_key
       JOIN GAMMA g ON g.run_id = i.run_id
  GROUP BY i.run_id, i.row_key, i.y)""",
    """CMR AS (SELECT model, run_id,
    count(*) FILTER (WHERE y = 0 AND score <= 0) AS tn, count(*) FILTER (WHERE y = 0 AND score > 0) AS fp,
    count(*) FILTER (WHERE y = 1 AND score <= 0) AS fn, count(*) FILTER (WHERE y = 1 AND score > 0) AS tp
  FROM SCORES GROUP BY model, run_id)""",
    """MR AS (SELECT model, size AS subset_size, repeat,
    CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp) AS accuracy,
    CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2
         WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END
      AS balanced_accuracy,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1,
    CASE WHEN tn + fp > 0 THEN CAST(fp AS DOUBLE) / (tn + fp) ELSE 0 END AS false_positive_rate
  FROM CMR JOIN RUNS USING (run_id))"""]

SIX_SQL = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "false_positive_rate"]
sql("q_compare_models_pauli", with_(W, *SPLIT_W, *GRID_CTES)
    + f"SELECT model, subset_size, repeat, {', '.join(r6(m) + ' AS ' + m for m in SIX_SQL)} FROM MR")
sql("q_comparison_mean", with_(W, *SPLIT_W, *GRID_CTES) + "SELECT model, subset_size, " + ", ".join(
    f"{r6(f'avg({m})')} AS {m}" for m in ["accuracy", "balanced_accuracy", "f1", "false_positive_rate"])
    + " FROM MR GROUP BY model, subset_size")
sql("q_comparison_spread", with_(W, *SPLIT_W, *GRID_CTES) + f"""
SELECT model, subset_size, {r6('avg(f1)')} AS mean, {r6('coalesce(stddev_samp(f1), 0)')} AS std, count(*) AS runs
FROM MR GROUP BY model, subset_size""")

# bench queries over all W rows
WALL = [f"WS0 AS (SELECT row_key, y, " + ", ".join(
    f"(coalesce(f{q}, (SELECT median FROM SS WHERE feature = 'f{q}')) - (SELECT mean FROM SS WHERE feature = 'f{q}'))"
    f" / (SELECT sd FROM SS WHERE feature = 'f{q}') AS f{q}" for q in range(N)) + " FROM W)",
    f"WB AS (SELECT *, {bloch_select()} FROM (SELECT *, {ANG} FROM WS0))",
    f"LB AS (SELECT *, {bloch_select()} FROM ENC)",
    "LC AS (SELECT row_key, CASE WHEN y = 1 THEN 1.0 / count(*) OVER (PARTITION BY y) "
    "ELSE -1.0 / count(*) OVER (PARTITION BY y) END AS coef FROM ENC)"]

sql("q_bench_kernel_pauli", with_(*BASE64, *WALL) + f"""
SELECT count(*) AS entries, {r6('avg(k)')} AS mean_k, {r6('min(k)')} AS min_k, {r6('max(k)')} AS max_k
FROM (SELECT {pauli_pair_expr()} AS k FROM WB i, LB j)""")

sql("q_bench_ranking_metrics", with_(*BASE64, *WALL) + f""",
SB AS (SELECT i.row_key, i.y, sum(c.coef * {pauli_pair_expr()}) AS score
       FROM WB i, LB j JOIN LC c ON c.row_key = j.row_key GROUP BY i.row_key, i.y)
SELECT {r6(_auc_sql('SB'))} AS roc_auc, {r6(_ap_sql('SB'))} AS average_precision""")

sql("q_bench_preprocess", with_(W, f"SW AS ({_stats_sql('W')})") + "\nUNION ALL\n".join(
    f"""SELECT 'f{q}' AS feature, {r6('avg(v)')} AS mean, {r6('var_pop(v)')} AS var, count(*) AS rows FROM (
  SELECT (coalesce(f{q}, (SELECT median FROM SW WHERE feature = 'f{q}')) - (SELECT mean FROM SW WHERE feature = 'f{q}'))
         / (SELECT sd FROM SW WHERE feature = 'f{q}') AS v FROM W)""" for q in range(N)))

# ---------------------------------------------------------------- M4 map study, A19, A20
def _split_kernel(chain_sql: str, name: str) -> str:
    """',\\nC0 AS (...)...\\nSELECT i_key, j_key, k FROM C8' -> ',\\nC0 ...,\\nname AS (SELECT ...)'."""
    head, _, tail = chain_sql.rpartition("\nSELECT ")
    return f"{head},\n{name} AS (SELECT {tail})"


STUDY_CTES = [
    "MRUNS AS (SELECT CAST(r AS INTEGER) AS run_id, CAST(20260802 + 1000 + r AS INTEGER) AS seed FROM range(3) t(r))",
    f"""MSUB AS (SELECT * FROM (SELECT MRUNS.run_id, MRUNS.seed, WT.*,
        row_number() OVER (PARTITION BY run_id, WT.y ORDER BY {_h('subset', 'CAST(seed AS VARCHAR)')}, row_key) AS rn
      FROM MRUNS, WT) WHERE rn <= 32)""",
    "MMED AS (SELECT run_id, " + ", ".join(f"median(f{q}) AS m{q}" for q in range(N)) + " FROM MSUB GROUP BY run_id)",
    "MSTR AS (SELECT s.run_id, " + ", ".join(
        f"any_value(m{q}) AS m{q}, avg(coalesce(f{q}, m{q})) AS u{q}, "
        f"CASE WHEN stddev_pop(coalesce(f{q}, m{q})) = 0 THEN 1.0 ELSE stddev_pop(coalesce(f{q}, m{q})) END AS d{q}"
        for q in range(N)) + " FROM MSUB s JOIN MMED USING (run_id) GROUP BY s.run_id)",
    "MSS AS (SELECT run_id, seed, row_key, y, " + ", ".join(
        f"(coalesce(f{q}, m{q}) - u{q}) / d{q} AS f{q}" for q in range(N)) + " FROM MSUB JOIN MSTR USING (run_id))",
    f"MENC AS (SELECT run_id, seed, row_key, y, {ANG} FROM MSS)",
    f"""MFOLD AS (SELECT run_id, row_key, y, {', '.join(f'a{q}' for q in range(N))},
      CAST((coalesce((SELECT count(*) FROM MENC e2 WHERE e2.run_id = e.run_id AND e2.y < e.y), 0)
            + row_number() OVER (PARTITION BY run_id, y ORDER BY {_h('folds', 'CAST(seed AS VARCHAR)')}, row_key) - 1) % 5
           AS INTEGER) AS fold
    FROM MENC e)""",
    f"""MPAIRS AS (SELECT concat(v.run_id, '|', v.row_key) AS i_key, concat(t.run_id, '|', t.row_key) AS j_key,
      {', '.join(f'v.a{q} AS x{q}' for q in range(N))}, {', '.join(f't.a{q} AS z{q}' for q in range(N))}
    FROM MFOLD v JOIN MFOLD t ON v.run_id = t.run_id AND t.fold <> v.fold)""",
    """MCNT AS (SELECT f.run_id, f.fold, count(*) FILTER (WHERE t.y = 1) AS n1, count(*) FILTER (WHERE t.y = 0) AS n0
    FROM (SELECT DISTINCT run_id, fold FROM MFOLD) f JOIN MFOLD t ON t.run_id = f.run_id AND t.fold <> f.fold
    GROUP BY f.run_id, f.fold)""",
    f"KP AS ({pauli_sql('MPAIRS', 2, False)})",
]
STUDY_KERNELS = ",\n".join(STUDY_CTES) + _split_kernel(custom2_sql("MPAIRS", False), "KC") \
    + _split_kernel(zz2_sql("MPAIRS"), "KZ0") + ",\nKZ AS (SELECT i_key, j_key, k FROM KZ0)"


def _fold_f1(kernel: str, name: str) -> str:
    return f"""SELECT '{name}' AS feature_map, run_id, fold,
    CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1
  FROM (SELECT run_id, fold, count(*) FILTER (WHERE y = 1 AND score > 0) AS tp,
               count(*) FILTER (WHERE y = 0 AND score > 0) AS fp, count(*) FILTER (WHERE y = 1 AND score <= 0) AS fn
        FROM (SELECT v.run_id, v.fold, v.row_key, v.y,
                     sum(CASE WHEN t.y = 1 THEN 1.0 / c.n1 ELSE -1.0 / c.n0 END * K.k) AS score
              FROM {kernel} K JOIN MFOLD v ON concat(v.run_id, '|', v.row_key) = K.i_key
                   JOIN MFOLD t ON concat(t.run_id, '|', t.row_key) = K.j_key
                   JOIN MCNT c ON c.run_id = v.run_id AND c.fold = v.fold
              GROUP BY v.run_id, v.fold, v.row_key, v.y)
        GROUP BY run_id, fold)"""


# zz2_sql rounds its output; the study needs the raw value
STUDY_KERNELS = STUDY_KERNELS.replace(
    _split_kernel(zz2_sql("MPAIRS"), "KZ0"), _split_kernel(zz2_sql("MPAIRS").replace(
        "SELECT i_key, j_key, round(", "SELECT i_key, j_key, (").replace(", 6) + 0.0 AS k FROM Q8", ") AS k FROM Q8"), "KZ0"))

FOLD_F1 = f"FF AS ({_fold_f1('KZ', 'zz')} UNION ALL {_fold_f1('KP', 'pauli')} UNION ALL {_fold_f1('KC', 'custom')})"
_STUDY = with_(W, *SPLIT_W, STUDY_KERNELS, FOLD_F1)

sql("q_map_study", _STUDY + f"SELECT feature_map, run_id AS repeat, {r6('avg(f1)')} AS cv_f1 FROM FF GROUP BY feature_map, run_id")

sql("q_choose_map", _STUDY + f""", CV AS (SELECT feature_map, run_id, avg(f1) AS cv_f1 FROM FF GROUP BY feature_map, run_id)
SELECT feature_map, {r6('avg(cv_f1)')} AS mean,
       CAST(row_number() OVER (ORDER BY avg(cv_f1) DESC, feature_map) AS INTEGER) AS rank
FROM CV GROUP BY feature_map""")

sql("q_cv_summary", _STUDY + f"""
SELECT feature_map AS params, {r6('avg(f1)')} AS mean_f1, {r6('stddev_pop(f1)')} AS std_f1, count(*) AS folds,
       CAST(row_number() OVER (ORDER BY avg(f1) DESC,
            CASE feature_map WHEN 'zz' THEN 1 WHEN 'pauli' THEN 2 ELSE 3 END) AS INTEGER) AS rank
FROM FF GROUP BY feature_map""")

sql("q_rbf_expansion_metrics", with_(*BASE64, _GAMMA) + f""",
RS AS (SELECT t.row_key, t.y,
              sum(CASE WHEN s.y = 1 THEN 1.0 / (SELECT count(*) FROM SUBP WHERE y = 1)
                       ELSE -1.0 / (SELECT count(*) FROM SUBP WHERE y = 0) END
                  * exp(-(SELECT g FROM GAM) * ({' + '.join(f'pow(t.{c} - s.{c}, 2)' for c in FEATS)}))) AS score
       FROM WEP t, SUBP s GROUP BY t.row_key, t.y),
SR AS (SELECT row_key, y, score, CAST(score > 0 AS INTEGER) AS pred FROM RS),
CM AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM SR)
SELECT tn, fp, fn, tp,
  {r6('CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp)')} AS accuracy,
  {r6('CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2 WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END')} AS balanced_accuracy,
  {r6('CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END')} AS precision,
  {r6('CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END')} AS f1,
  {r6('CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END')} AS specificity,
  {r6('CASE WHEN tn + fp > 0 THEN CAST(fp AS DOUBLE) / (tn + fp) ELSE 0 END')} AS false_positive_rate,
  {r6(_auc_sql('SR'))} AS roc_auc, {r6(_ap_sql('SR'))} AS average_precision
FROM CM""")
