"""DuckDB oracle statements, one per registered query that SQL can express.

code. Every double is rounded to 6 decimals (+0.0 removes -0.0) on both sides.
"""

from __future__ import annotations

from .oracle_fixtures import C, D, E, W, with_
from .params import SEED

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = text


FEATS = [f"f{q}" for q in range(9)]

# ---------------------------------------------------------------- phase 1: profile
sql("q_profile", with_(W) + "SELECT count(*) AS rows, CAST(9 AS INTEGER) AS features FROM W")

sql("q_class_counts", with_(W) + "SELECT y, count(*) AS n FROM W WHERE y IS NOT NULL GROUP BY y ORDER BY y")

sql("q_missing", with_(W) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({q} AS INTEGER) AS position, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS BIGINT) AS n_missing FROM W"
    for q, c in enumerate(FEATS)))

sql("q_duplicates", with_(W) + f"""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATS)}, y FROM W)) AS BIGINT) AS duplicates,
       (SELECT count(*) FROM (SELECT DISTINCT {', '.join(FEATS)}, y FROM W)) AS distinct_rows
FROM W""")

sql("q_duplicates_docs", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, text FROM documents)) AS BIGINT) AS duplicates,
       (SELECT count(*) FROM (SELECT DISTINCT lang, text FROM documents)) AS distinct_rows
FROM documents""")

_LABEL_DOMAIN = """
SELECT count(DISTINCT y) AS n_labels, CAST(min(y) AS INTEGER) AS min_label, CAST(max(y) AS INTEGER) AS max_label,
       CAST(count(*) FILTER (WHERE y IS NULL) AS BIGINT) AS null_labels,
       (count(DISTINCT y) = 2 AND min(y) = 0 AND max(y) = 1) AS valid
FROM {t}"""
sql("q_label_domain", with_(W) + _LABEL_DOMAIN.format(t="W"))
sql("q_label_domain_docs", with_(D) + _LABEL_DOMAIN.format(t="D"))

sql("q_project_features", with_(W) + f"SELECT row_key, {', '.join(FEATS)}, CAST(y AS INTEGER) AS y FROM W")

sql("q_head", with_(W) + f"""
SELECT row_key, {', '.join(FEATS)}, y FROM W
ORDER BY md5(concat_ws('~', '{SEED}', 'order', row_key)), row_key LIMIT 16""")

# ---------------------------------------------------------------- phase 2: sampling, prep, metrics
def _h(purpose: str, seed_sql: str = f"'{SEED}'", key: str = "row_key") -> str:
    return f"md5(concat_ws('~', {seed_sql}, '{purpose}', {key}))"


def _split_ctes(src: str, prefix: str) -> list[str]:
    """Stratified split of view `src` into `{prefix}S` (all rows + split); allocation `{prefix}A`."""
    return [
        f"""{prefix}A AS (
  SELECT y, c - (fl + CASE WHEN rn <= need THEN 1 ELSE 0 END) AS n_test, c AS n_class FROM (
    SELECT y, c, fl, ntr - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, y) AS rn FROM (
      SELECT y, c, ntr, floor(cont) AS fl, cont - floor(cont) AS rem FROM (
        SELECT y, c, ntr, CAST(c AS DOUBLE) / CAST(tot AS DOUBLE) * CAST(ntr AS DOUBLE) AS cont FROM (
          SELECT y, c, sum(c) OVER () AS tot,
                 sum(c) OVER () - ceil(CAST(0.2 AS DOUBLE) * CAST(sum(c) OVER () AS DOUBLE)) AS ntr
          FROM (SELECT y, count(*) AS c FROM {src} GROUP BY y)))))
)""",
        f"""{prefix}S AS (
  SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY t.y ORDER BY {_h('split')}, row_key) <= a.n_test
                   THEN 'test' ELSE 'train' END AS split
  FROM {src} t JOIN {prefix}A a ON t.y = a.y
)""",
        f"{prefix}T AS (SELECT * FROM {prefix}S WHERE split = 'train')",
        f"{prefix}E AS (SELECT * FROM {prefix}S WHERE split = 'test')",
    ]


SPLIT_W = _split_ctes("W", "W")
SUB64 = f"""SUB AS (
  SELECT *, CAST(row_number() OVER (ORDER BY {_h('shuffle')}, row_key) - 1 AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_h('subset')}, row_key) AS rn FROM WT)
  WHERE rn <= 32
)"""

sql("q_stratified_split", with_(W, *SPLIT_W) + "SELECT row_key, y, split FROM WS")

sql("q_split_allocation", with_(W, *SPLIT_W) + "SELECT y, n_class, CAST(n_test AS BIGINT) AS n_test FROM WA")

sql("q_balanced_subset", with_(W, *SPLIT_W, SUB64) + "SELECT row_key, y, position FROM SUB")

RUNS = """RUNS AS (
  SELECT CAST(si * 5 + r AS INTEGER) AS run_id, CAST(size AS INTEGER) AS size,
         CAST(20260802 + 100 * size + r AS INTEGER) AS seed
  FROM (VALUES (0, 16), (1, 32), (2, 64)) s(si, size), range(5) t(r)
)"""
sql("q_balanced_subset_runs", with_(W, *SPLIT_W, RUNS) + f"""
SELECT run_id, size, seed, row_key, y,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY {_h('shuffle', 'CAST(seed AS VARCHAR)')}, row_key) - 1 AS INTEGER)
         AS position
FROM (SELECT RUNS.*, WT.row_key, WT.y,
             row_number() OVER (PARTITION BY run_id, y ORDER BY {_h('subset', 'CAST(seed AS VARCHAR)')}, row_key) AS rn
      FROM RUNS, WT)
WHERE rn <= size / 2""")

sql("q_undersample", with_(D, *_split_ctes("D", "D")) + f"""
SELECT row_key, y FROM (
  SELECT row_key, y, row_number() OVER (PARTITION BY y ORDER BY {_h('undersample')}, row_key) AS rn FROM DT)
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM DT GROUP BY y))""")

sql("q_stratified_folds", with_(W, *SPLIT_W) + f"""
SELECT row_key, y,
       CAST((coalesce((SELECT count(*) FROM WT lower_rows WHERE lower_rows.y < t.y), 0)
             + row_number() OVER (PARTITION BY y ORDER BY {_h('folds')}, row_key) - 1) % 5 AS INTEGER) AS fold
FROM WT t""")

sql("q_uniform_sample", with_(W, *SPLIT_W) + f"SELECT row_key, y FROM WE ORDER BY {_h('sample')}, row_key LIMIT 8")

sql("q_run_grid", with_(W, *SPLIT_W) + """
SELECT g.*, (n0 >= subset_size / 2 AND n1 >= subset_size / 2) AS feasible
FROM (
  SELECT CAST(mi * 3 + r AS INTEGER) AS run_id, 'map_study' AS kind, m AS feature_map, CAST(64 AS INTEGER) AS subset_size,
         CAST(r AS INTEGER) AS repeat, CAST(20260802 + 1000 + r AS INTEGER) AS seed
  FROM (VALUES (0, 'zz'), (1, 'pauli'), (2, 'custom')) mm(mi, m), range(3) t(r)
  UNION ALL
  SELECT CAST(9 + si * 5 + r AS INTEGER), 'compare', CAST(NULL AS VARCHAR), CAST(size AS INTEGER), CAST(r AS INTEGER),
         CAST(20260802 + 100 * size + r AS INTEGER)
  FROM (VALUES (0, 16), (1, 32), (2, 64)) s(si, size), range(5) t(r)
) g, (SELECT count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM WT) c""")

sql("q_lookup_rows", with_(W, *SPLIT_W, SUB64) + f"""
SELECT row_key, {', '.join(FEATS)}, y FROM W WHERE row_key IN (SELECT row_key FROM SUB)""")

sql("q_fit_median", with_(W, *SPLIT_W) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(median({c}), 6) + 0.0 AS median FROM WT" for c in FEATS))


def _stats_sql(src: str) -> str:
    """Per feature: median, then mean and population sd of the imputed column (sd 0 -> 1)."""
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, m AS median, avg(coalesce({c}, m)) AS mean,
       CASE WHEN stddev_pop(coalesce({c}, m)) = 0 THEN 1.0 ELSE stddev_pop(coalesce({c}, m)) END AS sd
FROM {src}, (SELECT median({c}) AS m FROM {src}) GROUP BY m""" for c in FEATS)


sql("q_fit_scaler", with_(W, *SPLIT_W, f"ST AS ({_stats_sql('WT')})") + """
SELECT feature, round(median, 6) + 0.0 AS median, round(mean, 4) + 0.0 AS mean, round(sd, 4) + 0.0 AS sd FROM ST""")

_SUB_STATS = f"SS AS ({_stats_sql('SUB')})"


def _apply(src: str, extra: str) -> str:
    cols = ", ".join(
        f"round((coalesce({c}, (SELECT median FROM SS WHERE feature = '{c}')) - (SELECT mean FROM SS WHERE feature = '{c}'))"
        f" / (SELECT sd FROM SS WHERE feature = '{c}'), 6) + 0.0 AS {c}" for c in FEATS)
    return f"SELECT row_key, y{extra}, {cols} FROM {src}"


sql("q_preprocess_fit_self", with_(W, *SPLIT_W, SUB64, _SUB_STATS) + _apply("SUB", ", position"))
sql("q_preprocess_train_test", with_(W, *SPLIT_W, SUB64, _SUB_STATS) + _apply("WE", ""))

SCORED_DOCS = """SD AS (
  SELECT row_key, y, coalesce(f7, 0) - coalesce(f4, 0) - coalesce(f6, 0) AS score FROM D
), SDP AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM SD)"""

sql("q_confusion", with_(D, SCORED_DOCS) + """
SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM SDP""")

sql("q_metrics", with_(D, SCORED_DOCS) + """
, CM AS (
SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM SDP)
SELECT tn, fp, fn, tp,
  round(CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp), 6) + 0.0 AS accuracy,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2
             WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn)
             WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END, 6) + 0.0 AS balanced_accuracy,
  round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision,
  round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) + 0.0 AS f1,
  round(CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END, 6) + 0.0 AS specificity,
  round(CASE WHEN tn + fp > 0 THEN CAST(fp AS DOUBLE) / (tn + fp) ELSE 0 END, 6) + 0.0 AS false_positive_rate
FROM CM""")


def _auc_sql(src: str) -> str:
    """Mann-Whitney: (sum of mid-ranks of positives - P(P+1)/2) / (P N)."""
    return f"""(SELECT (sum(r) FILTER (WHERE y = 1) - P * (P + 1) / 2.0) / (P * N) FROM (
      SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {src}),
      (SELECT CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS P, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS N FROM {src})
    GROUP BY P, N)"""


def _ap_sql(src: str) -> str:
    """sum over thresholds (descending distinct scores) of (R_n - R_(n-1)) * P_n."""
    return f"""(SELECT sum((rec - coalesce(prev_rec, 0)) * prec) FROM (
      SELECT rec, prec, lag(rec) OVER (ORDER BY score DESC) AS prev_rec FROM (
        SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) / (SELECT count(*) FILTER (WHERE y = 1) FROM {src}) AS rec,
               CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) / sum(cnt) OVER (ORDER BY score DESC) AS prec
        FROM (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) AS cnt FROM {src} GROUP BY score))))"""


SCORED_LINES = "SL AS (SELECT row_key, y, f0 AS score FROM WE)"
sql("q_roc_auc", with_(W, *SPLIT_W, SCORED_LINES) + f"SELECT round({_auc_sql('SL')}, 6) + 0.0 AS roc_auc")
sql("q_average_precision", with_(W, *SPLIT_W, SCORED_LINES)
    + f"SELECT round({_ap_sql('SL')}, 6) + 0.0 AS average_precision")
sql("q_ranking_metrics_docs", with_(D, SCORED_DOCS)
    + f"SELECT round({_auc_sql('SD')}, 6) + 0.0 AS roc_auc, round({_ap_sql('SD')}, 6) + 0.0 AS average_precision")

from ..sources.csv_io import CONTRACT_FEATURES  # noqa: E402

sql("q_csv_contract", with_(W) + "SELECT count(*) AS rows, count(*) FILTER (WHERE y = 0) AS n0, "
    "count(*) FILTER (WHERE y = 1) AS n1, " + ", ".join(
        f"count(*) FILTER (WHERE {f} IS NULL) AS missing_{c}" for f, c in zip(FEATS, CONTRACT_FEATURES)) + " FROM W")
