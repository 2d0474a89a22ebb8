"""DuckDB oracles of the output, parameter and quarantine queries: what was read back must equal the definition."""

from __future__ import annotations

from ..sources.csv_io import CONTRACT_FEATURES
from .oracle import FEATS, ORACLE, _split_ctes, sql
from .oracle_fixtures import W, with_
from .oracle_kernels import BASE64, SYM, pauli_sql, r6
from . import oracle_machines  # noqa: F401  (its statements are reused below)

sql("q_sink_csv", ORACLE["q_compare_models_pauli"])
sql("q_sink_json", ORACLE["q_kernel_score_metrics"])
sql("q_sink_kernel", with_(*BASE64, SYM) + f", K AS ({pauli_sql('PW', 2, False)})\n"
    f"SELECT i_key, j_key, {r6('k')} AS k, y AS i_class FROM K JOIN ENC ON ENC.row_key = K.i_key")
sql("q_sink_manifest", with_(W) + f"""
SELECT 'class_counts' AS name, 'csv' AS format, 0::BIGINT AS version, count(DISTINCT y) AS rows FROM W
UNION ALL SELECT 'missing_values', 'json', 0, {len(FEATS)}
UNION ALL SELECT 'features', 'parquet', v, count(*) FROM W, (VALUES (0), (1)) t(v) GROUP BY v""")

_SPLIT25 = [c.replace("0.2 AS DOUBLE", "0.25 AS DOUBLE").replace("'20260802'", "'7'") for c in _split_ctes("W", "W")]
sql("q_config_split", with_(W, *_SPLIT25[:2]) + """
SELECT y, split, count(*) AS n, CAST(sum(('0x' || substr(md5(row_key), 1, 8))::BIGINT) AS BIGINT) AS key_sum,
  7 AS seed, 5 AS cv_folds, 12 AS remote_subset_size FROM WS GROUP BY y, split""")
sql("q_strip_prefix", f"SELECT params, mean_f1, rank FROM ({ORACLE['q_kernel_svm_cv']})")
_DIGIT = "substr(md5(row_key), 1, 1)"
sql("q_quarantine", with_(W) + f"""
SELECT reason, count(*) AS n FROM (
  SELECT unnest(CASE {_DIGIT} WHEN '0' THEN ['{CONTRACT_FEATURES[0]} is not a number', '{CONTRACT_FEATURES[2]} is not finite']
    WHEN '1' THEN ['label is not 0 or 1'] WHEN '2' THEN ['label is missing'] WHEN '3' THEN ['{CONTRACT_FEATURES[2]} is not finite'] ELSE ['accepted'] END) AS reason
  FROM W) GROUP BY reason""")
