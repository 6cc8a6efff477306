"""Arrays, maps, structs, lambdas, generators."""

from __future__ import annotations

from lumenframe.plans.registry import sql

W = "split(p_name, ' ')"
D = "string_split(p_name, ' ')"
sql("array_basic", f"SELECT p_partkey, size({W}) AS n, cardinality({W}) AS c, array_contains({W}, 'red') AS has, element_at({W}, 1) AS e1, element_at({W}, -1) AS el, array_join({W}, '-') AS j, sort_array({W}) AS s, reverse({W}) AS r FROM {{part}}",
    f"SELECT p_partkey, CAST(len({D}) AS INTEGER) AS n, CAST(len({D}) AS INTEGER) AS c, list_contains({D}, 'red') AS has, {D}[1] AS e1, {D}[-1] AS el, array_to_string({D}, '-') AS j, list_sort({D}) AS s, list_reverse({D}) AS r FROM {{part}}")
sql("array_sets", "SELECT k, array_sort(array_union(a, b)) AS u, array_sort(array_intersect(a, b)) AS i, array_sort(array_except(a, b)) AS e, array_sort(array_distinct(concat(a, b))) AS d, arrays_overlap(a, b) AS o FROM (SELECT n_nationkey AS k, array(n_nationkey, n_nationkey + 1, 3) AS a, array(3, n_regionkey) AS b FROM {nation}) t",
    "SELECT k, list_sort(list_distinct(list_concat(a, b))) AS u, list_sort(list_intersect(a, b)) AS i, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS e, list_sort(list_distinct(list_concat(a, b))) AS d, list_has_any(a, b) AS o FROM (SELECT n_nationkey AS k, [n_nationkey, n_nationkey + 1, 3] AS a, [3, n_regionkey] AS b FROM {nation}) t")
sql("array_numbers", "SELECT vec_id, round(array_max(embedding), 6) AS mx, round(array_min(embedding), 6) AS mn, size(slice(embedding, 2, 3)) AS s, array_position(embedding, embedding[4]) AS p FROM {embeddings}", "SELECT vec_id, round(list_max(embedding), 6) AS mx, round(list_min(embedding), 6) AS mn, 3::INTEGER AS s, CAST(list_position(embedding, embedding[5]) AS BIGINT) AS p FROM {embeddings}")
sql("array_make", "SELECT sequence(1, 5) AS s, array_repeat('a', 3) AS r, flatten(array(array(1, 2), array(3))) AS f, array_remove(array(1, 2, 1), 1) AS d, slice(array(1, 2, 3, 4), -2, 2) AS l, size(shuffle(array(1, 2, 3))) AS h, array_append(array(1), 2) AS a, array_insert(array(1, 3), 2, 2) AS i, array_compact(array(1, NULL, 2)) AS c", "SELECT [1,2,3,4,5] AS s, ['a','a','a'] AS r, [1,2,3] AS f, [2] AS d, [3,4] AS l, 3::INTEGER AS h, [1,2] AS a, [1,2,3] AS i, [1,2] AS c")
sql("arrays_zip_flatten", f"SELECT p_partkey, transform(arrays_zip({W}, sequence(1, size({W}))), z -> concat(z['0'], z['1'])) AS z FROM {{part}}", f"SELECT p_partkey, list_transform({D}, lambda x, i: x || i) AS z FROM {{part}}")
sql("lambda_array", f"SELECT p_partkey, transform({W}, x -> upper(x)) AS t, filter({W}, x -> length(x) > 4) AS f, exists({W}, x -> x LIKE 'b%') AS e, forall({W}, x -> length(x) > 2) AS a, aggregate({W}, 0, (s, x) -> s + length(x)) AS g, zip_with({W}, reverse({W}), (x, y) -> concat(x, y)) AS z, array_sort({W}, (l, r) -> length(l) - length(r)) IS NOT NULL AS s FROM {{part}}",
    f"SELECT p_partkey, list_transform({D}, lambda x: upper(x)) AS t, list_filter({D}, lambda x: length(x) > 4) AS f, len(list_filter({D}, lambda x: x LIKE 'b%')) > 0 AS e, len(list_filter({D}, lambda x: length(x) <= 2)) = 0 AS a, CAST(length(replace(p_name, ' ', '')) AS INTEGER) AS g, list_transform(list_zip({D}, list_reverse({D})), lambda z: z[1] || z[2]) AS z, true AS s FROM {{part}}")
sql("lambda_dot_product", "SELECT vec_id, round(aggregate(zip_with(embedding, embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (s, x) -> s + x), 4) AS norm FROM {embeddings}", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM {embeddings}")
sql("map_basic", "SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey)['b'] AS b, map_keys(map('a', 1, 'b', 2)) AS k, map_values(map('a', n_nationkey)) AS v, size(map_concat(map(1, 'x'), map(2, 'y'))) AS s, element_at(map('q', n_name), 'q') AS e, map_from_arrays(array('k'), array(n_name))['k'] AS f, str_to_map('a:1,b:2')['b'] AS m, map_contains_key(map(1, 2), 1) AS c FROM {nation}", "SELECT n_nationkey, n_regionkey AS b, ['a','b'] AS k, [n_nationkey] AS v, 2::INTEGER AS s, n_name AS e, n_name AS f, '2' AS m, true AS c FROM {nation}")
sql("map_lambda", "SELECT n_nationkey, map_filter(m, (k, v) -> v > 5)['n'] AS f, transform_values(m, (k, v) -> v * 2)['r'] AS tv, map_keys(transform_keys(m, (k, v) -> upper(k))) AS tk, map_zip_with(m, m, (k, a, b) -> a + b)['n'] AS z, size(map_entries(m)) AS e, map_from_entries(array(struct('x', n_nationkey)))['x'] AS fe FROM (SELECT n_nationkey, map('n', n_nationkey, 'r', n_regionkey) AS m FROM {nation}) t", "SELECT n_nationkey, CASE WHEN n_nationkey > 5 THEN n_nationkey END AS f, n_regionkey * 2 AS tv, ['N','R'] AS tk, n_nationkey * 2 AS z, 2::INTEGER AS e, n_nationkey AS fe FROM {nation}")
sql("struct_basic", "SELECT c_custkey, s.name AS name, s.pos.k AS k, named_struct('x', 1).x AS x FROM (SELECT c_custkey, named_struct('name', c_name, 'pos', named_struct('k', c_nationkey)) AS s FROM {customer}) t", "SELECT c_custkey, c_name AS name, c_nationkey AS k, 1::INTEGER AS x FROM {customer}")
sql("explode_kinds", f"SELECT p_partkey, pos, w FROM {{part}} LATERAL VIEW posexplode({W}) t AS pos, w", f"SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, {D}[i] AS w FROM part, unnest(range(1, len({D}) + 1)) AS t(i)")
sql("explode_outer", "SELECT k, x FROM VALUES (1, array(1, 2)), (2, CAST(array() AS ARRAY<INT>)), (3, NULL) AS t(k, a) LATERAL VIEW OUTER explode(a) e AS x", "SELECT * FROM (VALUES (1, 1), (1, 2), (2, NULL), (3, NULL)) t(k, x)")
sql("explode_map_inline", "SELECT k, v FROM (SELECT explode(map('a', 1, 'b', 2)) AS (k, v)) UNION ALL SELECT inline(array(struct('c', 3), struct('d', 4))) UNION ALL SELECT stack(2, 'e', 5, 'f', 6)", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3), ('d', 4), ('e', 5), ('f', 6)) t(k, v)")
sql("explode_vectors", "SELECT label, i, round(avg(x), 5) AS mean FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, x GROUP BY label, i", "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(embedding[i]), 5) AS mean FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY label, i")
sql("generators_outer", "SELECT k, p, x FROM VALUES (1, array(7, 8)), (2, NULL) AS t(k, a) LATERAL VIEW OUTER posexplode(a) e AS p, x UNION ALL SELECT posexplode_outer(CAST(NULL AS ARRAY<INT>)) AS (p, x), 3 UNION ALL SELECT k, x, y FROM (SELECT 4 AS k, inline_outer(array(struct(1, 2)))) AS t(k, x, y) UNION ALL SELECT 5, 0, x FROM (SELECT explode_outer(CAST(array() AS ARRAY<INT>)) AS x) t",
    "SELECT * FROM (VALUES (1, 0, 7), (1, 1, 8), (2, NULL, NULL), (NULL, NULL, 3), (4, 1, 2), (5, 0, NULL)) t(k, p, x)")
