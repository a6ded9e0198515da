"""SQL that the SQL-expressible training-data queries are compared with."""

# Exact ranks of the measured values: v is the value at the wanted rank in units, low the least number of units of its bucket (11 leading bits).
_RANKS = """WITH req AS (SELECT * FROM request_metrics QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at) = 1),
 f AS (SELECT coalesce(nullif(legal_family, ''), 'unknown') AS legal_family, latency_ms, cost_usd FROM req),
 m AS (SELECT 'latency_ms' AS metric, legal_family, latency_ms::BIGINT AS v FROM f WHERE latency_ms >= 0 UNION ALL SELECT 'cost_usd', legal_family, round(cost_usd * 1e6)::BIGINT FROM f WHERE cost_usd >= 0 AND NOT isnan(cost_usd)),
 r AS (SELECT *, row_number() OVER (PARTITION BY metric, legal_family ORDER BY v) AS rank, count(*) OVER (PARTITION BY metric, legal_family) AS n FROM m),
 x AS (SELECT metric, legal_family, quantile, n, v, CASE WHEN v < 2048 THEN v ELSE (v >> (length(bin(v)) - 11)::BIGINT) << (length(bin(v)) - 11)::BIGINT END AS low FROM r, unnest([0.5, 0.9, 0.95, 0.99, 0.999]) AS q(quantile) WHERE rank = greatest(ceil(quantile * n), 1))"""

_SHINGLES = r"""t AS (SELECT 'parent_chunks' AS table_name, parent_chunk_id AS id, any_value(text) AS text FROM parent_chunks GROUP BY ALL UNION ALL SELECT 'child_chunks', child_chunk_id, any_value(text) FROM child_chunks GROUP BY ALL),
 w AS (SELECT table_name, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t),
 s AS (SELECT DISTINCT table_name, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
 n AS (SELECT table_name, id, count(*) AS n FROM s GROUP BY ALL),
 pairs AS (SELECT a.table_name, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.table_name = b.table_name AND a.s = b.s AND a.id < b.id GROUP BY ALL)"""

SQL: dict[str, str] = {
    "p4_error_check": f"{_RANKS} SELECT metric, legal_family, quantile, n, low AS exact_units, true AS within_bound FROM x",
    # a group of fewer values than the compression has an exact digest: the stated bound is 0, and the value is the exact one's bucket
    "p4_percentiles": f"{_RANKS} SELECT metric, legal_family, quantile, n, CASE WHEN metric = 'cost_usd' THEN low / 1e6 ELSE low END AS value, 20 * (n // 20000) AS rank_error_bound FROM x",
    "p5_found": f"WITH {_SHINGLES} SELECT pairs.table_name, id_a, id_b FROM pairs JOIN n a ON a.table_name = pairs.table_name AND a.id = id_a JOIN n b ON b.table_name = pairs.table_name AND b.id = id_b WHERE c >= 0.6 * (a.n + b.n - c)",
}
