"""Registered queries as SQL: GRID over array stores made of the given tables, TABLES over the tables themselves.

A value is one text for both dialects, or (Spark's, DuckDB's).  EMB and CUBE are the grids as SQL, for the oracle.
"""

from __future__ import annotations

EMB = "emb AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS v FROM embeddings)"
CUBE = """cells AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS m, l_linenumber AS ln, CAST(ascii(l_returnflag) AS INTEGER) AS rf, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
cube AS (SELECT m.m, ln.ln, rf.rf, coalesce(q, 0) AS q, coalesce(n, 0) AS n
 FROM (SELECT DISTINCT m FROM cells) m CROSS JOIN (SELECT DISTINCT ln FROM cells) ln CROSS JOIN (SELECT DISTINCT rf FROM cells) rf
 LEFT JOIN cells c ON c.m = m.m AND c.ln = ln.ln AND c.rf = rf.rf)"""

GRID = {
    "grid_scan_2d": "SELECT vec_id, dim, v FROM emb",
    "grid_scan_3d": "SELECT m, ln, rf, q, n FROM cube",
    "grid_projection": "SELECT vec_id, v FROM emb WHERE dim < 4",
    "grid_coords_only": "SELECT DISTINCT ln, rf FROM cube",
    "grid_alias_arithmetic": "SELECT m AS month_no, ln, rf, q * 2 AS twice, q - n AS rest, (q - 32) * 5 / 9 AS scaled FROM cube",
    "grid_filter_eq": "SELECT vec_id, v FROM emb WHERE dim = 7",
    "grid_filter_eq_all": "SELECT v FROM emb WHERE dim = 3 AND vec_id = 11",
    "grid_filter_eq_two_dims": "SELECT m, q FROM cube WHERE ln = 2 AND rf = 82",
    "grid_filter_absent": "SELECT vec_id, v FROM emb WHERE dim = 9999",
    "grid_filter_conflict": "SELECT vec_id, v FROM emb WHERE dim = 1 AND dim = 2",
    "grid_filter_range": "SELECT vec_id, dim, v FROM emb WHERE dim BETWEEN 10 AND 13 AND vec_id >= 50 AND vec_id < 90",
    "grid_filter_in": "SELECT vec_id, dim, v FROM emb WHERE dim IN (0, 5, 63)",
    "grid_filter_not_in": "SELECT m, q FROM cube WHERE ln NOT IN (1, 2, 3) AND rf = 65",
    "grid_filter_or": "SELECT vec_id, dim, v FROM emb WHERE dim = 2 OR vec_id = 5",
    "grid_filter_cast": "SELECT vec_id, v FROM emb WHERE CAST(dim AS BIGINT) = 5",
    "grid_filter_value": "SELECT m, ln, rf, q FROM cube WHERE q > 100 AND n < 50",
    "grid_filter_value_or": "SELECT m, ln, rf FROM cube WHERE q > 400 OR q < 10",
    "grid_filter_not_null": "SELECT count(*) AS c FROM cube WHERE q IS NOT NULL AND m IS NOT NULL",
    "grid_limit_sorted": "SELECT vec_id, dim, v FROM emb ORDER BY vec_id, dim LIMIT 10",
    "grid_limit_offset": "SELECT vec_id, dim, v FROM emb ORDER BY vec_id, dim LIMIT 10 OFFSET 20",
    "grid_top_k": "SELECT m, ln, rf, q FROM cube ORDER BY q DESC, m, ln, rf LIMIT 12",
    "grid_count_meta": "SELECT count(*) AS c FROM emb",
    "grid_count_column_meta": "SELECT count(v) AS c, count(1) AS d FROM emb",
    "grid_count_null_meta": "SELECT count(NULL) AS c FROM emb",
    "grid_min_max_meta": "SELECT min(dim) AS lo, max(dim) AS hi, min(vec_id) AS a, max(vec_id) AS b FROM emb",
    "grid_mixed_meta": "SELECT count(*) AS c, min(ln) AS lo, max(m) AS hi FROM cube",
    "grid_count_distinct": "SELECT count(DISTINCT dim) AS c FROM emb",
    "grid_count_filter_clause": "SELECT count(*) FILTER (WHERE dim < 3) AS c FROM emb",
    "grid_renamed_subquery": "SELECT min(x) AS lo, max(x) AS hi FROM (SELECT -dim AS x FROM emb) t",
    "grid_shadowed_name": "SELECT max(dim) AS hi FROM (SELECT -dim AS dim FROM emb) t",
    "grid_min_max_value": "SELECT min(q) AS lo, max(q) AS hi FROM cube",
    "grid_sum": "SELECT sum(q) AS s, CAST(sum(n) AS BIGINT) AS n FROM cube",
    "grid_avg": "SELECT round(avg(q), 6) AS a FROM cube",
    "grid_several_aggregates": "SELECT count(*) AS c, round(avg(q), 6) AS a, min(q) AS lo, max(q) AS hi, CAST(sum(n) AS BIGINT) AS n FROM cube",
    "grid_group_by_one": "SELECT ln, round(avg(q), 6) AS a FROM cube GROUP BY ln",
    "grid_group_by_two": "SELECT ln, rf, round(avg(q), 6) AS a, CAST(sum(n) AS BIGINT) AS n FROM cube GROUP BY ln, rf",
    "grid_having": "SELECT m, max(q) AS hi FROM cube GROUP BY m HAVING max(q) > 100",
    "grid_distinct": "SELECT DISTINCT m FROM cube",
    "grid_group_dim": "SELECT dim, round(sum(CAST(v AS DOUBLE)), 4) AS s, min(v) AS lo, max(v) AS hi FROM emb GROUP BY dim",
    "grid_self_join": "SELECT a.ln, a.rf, a.m, a.q AS q0, b.q AS q1, b.q - a.q AS change FROM cube a JOIN cube b ON a.ln = b.ln AND a.rf = b.rf AND b.m = a.m + 1 WHERE a.rf = 78",
    "grid_join_all_keys": "SELECT a.m, a.ln, a.rf, a.q, b.n FROM cube a JOIN cube b ON a.m = b.m AND a.ln = b.ln AND a.rf = b.rf",
    "grid_left_join_expression": "SELECT a.m, a.ln, a.rf, a.q, b.q AS other FROM cube a LEFT JOIN cube b ON a.ln = b.ln + 1 AND a.m = b.m AND a.rf = b.rf",
    "grid_join_table": "SELECT e.vec_id, t.label, round(sum(CAST(e.v AS DOUBLE) * e.v), 4) AS norm FROM emb e JOIN embeddings t ON e.vec_id = t.vec_id GROUP BY e.vec_id, t.label",
    "grid_row_number": "SELECT m, ln, rf, q, CAST(row_number() OVER (PARTITION BY m ORDER BY q DESC, ln, rf) AS BIGINT) AS r FROM cube",
    "grid_moving_average": "SELECT m, q, round(avg(q) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS a FROM cube WHERE ln = 1 AND rf = 78",
    "grid_rank_dense": "SELECT m, ln, rf, CAST(rank() OVER (PARTITION BY rf ORDER BY n DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY rf ORDER BY n DESC) AS BIGINT) AS d FROM cube",
    "grid_lag_lead": "SELECT m, q, lag(q, 1) OVER (ORDER BY m) AS before, lead(q, 1) OVER (ORDER BY m) AS after FROM cube WHERE ln = 1 AND rf = 65",
    "grid_cte": "WITH daily AS (SELECT m, round(avg(q), 6) AS a FROM cube GROUP BY m) SELECT m, a FROM daily",
    "grid_ctes_union": "WITH hot AS (SELECT ln, rf FROM cube GROUP BY ln, rf HAVING avg(q) > 50), cold AS (SELECT ln, rf FROM cube GROUP BY ln, rf HAVING avg(q) <= 50) SELECT 'hot' AS kind, count(*) AS c FROM hot UNION ALL SELECT 'cold' AS kind, count(*) AS c FROM cold",
    "grid_derived_table": "SELECT t.m, t.s FROM (SELECT m, sum(q) AS s FROM cube GROUP BY m) t WHERE t.s > 100",
    "grid_scalar_subquery": "SELECT m, ln, rf FROM cube WHERE q > (SELECT avg(q) FROM cube)",
    "grid_rollup": "SELECT ln, rf, CAST(sum(n) AS BIGINT) AS n FROM cube GROUP BY ROLLUP (ln, rf)",
}

TABLES = {
    "table_join_three": "SELECT c_name, o_orderkey, l_linenumber, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 200000",
    "table_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "table_right_join": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey",
    "table_full_join": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
    "table_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "table_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "table_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "table_theta_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "table_join_hints": ("SELECT /*+ MERGE(o), SHUFFLE_HASH(c) */ c_mktsegment, count(*) AS c FROM customer c JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS c FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "table_group_aggregates": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS d, count(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "table_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS c FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "table_cube": "SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "table_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "table_stddev_var": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag",
    "table_corr_covar": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS v, round(regr_slope(l_extendedprice, l_quantity), 4) AS s FROM lineitem",
    "table_bool_bit": "SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS a, bool_or(c_acctbal > 9000) AS o, CAST(bit_and(c_custkey) AS BIGINT) AS ba, CAST(bit_or(c_custkey) AS BIGINT) AS bo FROM customer GROUP BY c_mktsegment",
    "table_median": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    "table_percentile": ("SELECT percentile(o_totalprice, 0.9) AS p FROM orders", "SELECT quantile_cont(o_totalprice, 0.9) AS p FROM orders"),
    "table_approx_distinct": ("SELECT abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.1 * count(DISTINCT l_orderkey) AS near FROM lineitem", "SELECT abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.2 * count(DISTINCT l_orderkey) AS near FROM lineitem"),
    "table_string_agg": ("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "table_array_agg": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "table_first_last": ("SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS f, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS l FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey"),
    "table_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS t FROM customer",
    "table_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS p, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS c FROM supplier",
    "table_first_nth_value": "SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, nth_value(o_totalprice, 2) OVER w AS n, last_value(o_totalprice) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "table_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c FROM part",
    "table_order_nulls": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "table_limit_offset": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 20",
    "table_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "table_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "table_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "table_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "table_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "table_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "table_recursive_cte": "WITH RECURSIVE numbers AS (SELECT 0 AS n UNION ALL SELECT n + 1 FROM numbers WHERE n < 5) SELECT n FROM numbers",
    "table_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "table_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)",
    "table_values": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)",
    "table_math": "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 50), 6) AS e, round(power(p_size, 2), 4) AS w, sign(p_size - 25) AS g, round(cbrt(p_size), 6) AS b, round(degrees(atan2(p_size, 3)), 6) AS d FROM part",
    "table_math_dialect": ("SELECT p_partkey, gcd(p_partkey, 36) AS g, lcm(p_partkey, 6) AS l, truncate_to(p_retailprice, 1) AS t, iszero(p_size % 2) AS z FROM part", "SELECT p_partkey, gcd(p_partkey, 36) AS g, lcm(p_partkey, 6) AS l, floor(p_retailprice * 10) / 10 AS t, p_size % 2 = 0 AS z FROM part"),
    "table_conditional": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, greatest(c_acctbal, 0) AS g, least(c_nationkey, 10) AS l FROM customer",
    "table_string": ("SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_name, 2, 3) AS s, concat(p_brand, '-', p_type) AS c, replace(p_type, ' ', '_') AS r, lpad(p_brand, 12, '*') AS l, reverse(p_brand) AS v, split_part(p_name, ' ', 1) AS f, strpos(p_name, 'a') AS a, translate(p_brand, 'ab', 'xy') AS t, levenshtein(p_brand, p_type) AS d FROM part", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_name, 2, 3) AS s, concat(p_brand, '-', p_type) AS c, replace(p_type, ' ', '_') AS r, lpad(p_brand, 12, '*') AS l, reverse(p_brand) AS v, split_part(p_name, ' ', 1) AS f, strpos(p_name, 'a') AS a, translate(p_brand, 'ab', 'xy') AS t, levenshtein(p_brand, p_type) AS d FROM part"),
    "table_string_predicates": ("SELECT p_partkey FROM part WHERE startswith(p_type, 'S') OR contains(p_name, 'e') AND NOT endswith(p_brand, '1') OR p_name LIKE '%a%b'", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') OR contains(p_name, 'e') AND NOT ends_with(p_brand, '1') OR p_name LIKE '%a%b'"),
    "table_regex": ("SELECT doc_id, regexp_replace(text, '[aeiou]+', '_') AS r, regexp_extract(text, '[0-9]+', 0) AS d, text RLIKE '[0-9]{4}' AS l FROM documents", "SELECT doc_id, regexp_replace(text, '[aeiou]+', '_', 'g') AS r, regexp_extract(text, '[0-9]+', 0) AS d, regexp_matches(text, '[0-9]{4}') AS l FROM documents"),
    "table_date": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS t, date_format(o_orderdate, 'yyyy-MM') AS f, CAST(date_part('day', o_orderdate) AS INT) AS d FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t, strftime(o_orderdate, '%Y-%m') AS f, CAST(date_part('day', o_orderdate) AS INT) AS d FROM orders"),
    "table_dialect_array": ("SELECT n_nationkey, array_has(make_array(1.5D, 2D), n_nationkey % 3) AS h, array_has_any(make_array(n_nationkey, 7), make_array(7L)) AS a, array_has_all(generate_series(1, 5), make_array(n_regionkey)) AS e, array_length(generate_series(1, n_regionkey + 1)) AS n, array_to_string(make_array(n_nationkey, n_regionkey), '-') AS s FROM nation", "SELECT n_nationkey, n_nationkey % 3 IN (2) AS h, true AS a, n_regionkey BETWEEN 1 AND 5 AS e, n_regionkey + 1 AS n, concat_ws('-', n_nationkey, n_regionkey) AS s FROM nation"),
    "table_dialect_string": ("SELECT n_nationkey, starts_with(n_name, 'A') AS a, ends_with(n_name, 'A') AS e, sha256(n_name) AS s, hex(digest(n_name, 'sha256')) AS d, strpos(n_name, 'A') AS p FROM nation", "SELECT n_nationkey, starts_with(n_name, 'A') AS a, ends_with(n_name, 'A') AS e, sha256(n_name) AS s, upper(sha256(n_name)) AS d, strpos(n_name, 'A') AS p FROM nation"),
    "table_dialect_regex": ("SELECT p_partkey, array_to_string(regexp_match(p_brand, '([A-Za-z]+)#([0-9])'), '|') AS m, array_to_string(regexp_match(p_type, '[A-Z]+'), '|') AS w FROM part", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#([0-9])') THEN regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 1) || '|' || regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) END AS m, CASE WHEN regexp_matches(p_type, '[A-Z]+') THEN regexp_extract(p_type, '[A-Z]+') END AS w FROM part"),
    "table_dialect_types": ("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice, 1) AS t, trunc(-l_quantity / 7) AS q, arrow_cast(l_quantity, 'Int64') AS c, map_extract(map('a', l_linenumber), 'a')[0] AS m, get_field(named_struct('x', l_partkey), 'x') AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice * 10) / 10 AS t, trunc(-l_quantity / 7) AS q, CAST(l_quantity AS BIGINT) AS c, l_linenumber AS m, l_partkey AS f FROM lineitem"),
    "table_date_bin_origin": ("SELECT to_unixtime(date_bin(INTERVAL '7 hours', ts, TIMESTAMP '2030-01-01 01:30:00')) AS t, count(*) AS c FROM events GROUP BY 1", "SELECT CAST(epoch(time_bucket(INTERVAL '7 hours', ts, TIMESTAMP '2030-01-01 01:30:00')) AS BIGINT) AS t, count(*) AS c FROM events GROUP BY 1"),
    "table_date_bin": ("SELECT to_unixtime(date_bin(INTERVAL '15 minutes', ts)) AS t, count(*) AS c FROM events GROUP BY 1", "SELECT CAST(floor(epoch_us(ts) / 1000000 / 900) * 900 AS BIGINT) AS t, count(*) AS c FROM events GROUP BY 1"),
    "table_array": ("SELECT vec_id, size(embedding) AS n, array_contains(sequence(1, 5), 3) AS h, array_join(slice(array('a', 'b', 'c'), 2, 2), '-') AS j, round(element_at(embedding, 1), 4) AS f, array_has_all(array('a', 'b'), array('a')) AS k FROM embeddings", "SELECT vec_id, len(embedding) AS n, list_contains(range(1, 6), 3) AS h, array_to_string(['a', 'b', 'c'][2:3], '-') AS j, round(embedding[1], 4) AS f, list_has_all(['a', 'b'], ['a']) AS k FROM embeddings"),
    "table_unnest": ("SELECT vec_id, pos, round(v, 4) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, round(unnest(embedding), 4) AS v FROM embeddings"),
    "table_map_struct": ("SELECT n_nationkey, element_at(map('k', n_name), 'k') AS m, named_struct('a', n_regionkey).a AS s FROM nation", "SELECT n_nationkey, map(['k'], [n_name])['k'] AS m, struct_pack(a := n_regionkey).a AS s FROM nation"),
    "table_hash": "SELECT n_nationkey, md5(n_name) AS m FROM nation",
    "table_sha": ("SELECT n_nationkey, sha2(n_name, 256) AS s FROM nation", "SELECT n_nationkey, sha256(n_name) AS s FROM nation"),
    "table_json": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "table_typeof_cast": ("SELECT DISTINCT typeof(CAST(o_orderkey AS DOUBLE)) AS t FROM orders", "SELECT DISTINCT lower(typeof(CAST(o_orderkey AS DOUBLE))) AS t FROM orders"),
}
