"""DuckDB definitions of the fixture views, written from FIXTURES.md (not from the Spark code).

Each query of ``oracle.py`` prepends the CTEs it needs.
"""

W = """W AS (
  SELECT
    concat_ws('~', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
              CAST(l_linenumber AS VARCHAR),
              CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber
                                      ORDER BY l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS VARCHAR)
    ) AS row_key,
    CAST(l_quantity AS DOUBLE) AS f0,
    CAST(l_extendedprice AS DOUBLE) AS f1,
    CAST(nullif(l_discount, 0) AS DOUBLE) AS f2,
    CAST(nullif(l_tax, 0) AS DOUBLE) AS f3,
    CAST(o_totalprice AS DOUBLE) AS f4,
    CAST(p_retailprice AS DOUBLE) AS f5,
    CAST(p_size AS DOUBLE) AS f6,
    CAST(s_acctbal AS DOUBLE) AS f7,
    CAST(CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS DOUBLE) AS f8,
    CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""

D = """D0 AS (
  SELECT doc_id, quality, text, n_chars, length(text) AS len,
         length(text) - length(replace(text, ' ', '')) AS spaces,
         length(text) - length(replace(text, chr(10), '')) AS lines,
         length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper_n,
         length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower_n
  FROM labels JOIN documents USING (doc_id)
),
D AS (
  SELECT CAST(doc_id AS VARCHAR) AS row_key,
         CAST(n_chars AS DOUBLE) AS f0,
         CAST(spaces + 1 AS DOUBLE) AS f1,
         CAST((len - spaces) AS DOUBLE) / (spaces + 1) AS f2,
         CAST(nullif(digits, 0) AS DOUBLE) / nullif(len, 0) AS f3,
         CAST(upper_n AS DOUBLE) / nullif(len, 0) AS f4,
         CAST(nullif(lines, 0) AS DOUBLE) AS f5,
         CAST(len - spaces - upper_n - lower_n AS DOUBLE) / nullif(len, 0) AS f6,
         CAST(lower_n AS DOUBLE) / nullif(len, 0) AS f7,
         CAST(nullif(digits, 0) AS DOUBLE) AS f8,
         CAST(quality AS INTEGER) AS y
  FROM D0
)"""

E = """E AS (
  SELECT CAST(vec_id AS VARCHAR) AS row_key, CAST(embedding AS DOUBLE[]) AS vec,
         CAST(label AS INTEGER) AS label, CAST(label % 2 AS INTEGER) AS y
  FROM embeddings
)"""

C = """C AS (
  SELECT CAST(user_id % 16 AS INTEGER) AS i, CAST((user_id // 16) % 16 AS INTEGER) AS j,
         event_type AS outcome, count(*) AS n
  FROM events GROUP BY ALL
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
