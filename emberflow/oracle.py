"""The same results as ``queries`` in DuckDB SQL, written from the definitions."""

from __future__ import annotations

D = 64
_K2 = 0x9AE16A3B2F90404F  # fixed value of the published hash


def _farm(x: str, out: str, src: str) -> str:
    """FROM item adding the FarmHash64 of the 8 bytes of x, as UHUGEINT below 2**64."""
    m = "18446744073709551616::UHUGEINT"
    mul = f"{(_K2 + 16) % 2**64}::UHUGEINT"
    rot = lambda v, n: f"(({v} >> {n}) | (({v} << {64 - n}) % {m}))"
    return f"""(SELECT * EXCLUDE (fa, fb, fc, fd, fh, fi, fj), (fi * {mul}) % {m} AS {out} FROM (
      SELECT *, xor(fj, fj >> 47) AS fi FROM (SELECT *, (xor(fd, xor(fh, fh >> 47)) * {mul}) % {m} AS fj FROM (
      SELECT *, (xor(fc, fd) * {mul}) % {m} AS fh FROM (
      SELECT *, ({rot('fb', 37)} * {mul} + fa) % {m} AS fc, (({rot('fa', 25)} + fb) % {m} * {mul}) % {m} AS fd FROM (
      SELECT *, ({x}::UHUGEINT + {_K2}::UHUGEINT) % {m} AS fa, {x}::UHUGEINT AS fb FROM {src}) z1) z2) z3) z4) z5)"""


_SIGNED = lambda h: f"CAST(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN {h}::HUGEINT - 18446744073709551616::HUGEINT ELSE {h}::HUGEINT END AS BIGINT)"

#: Shared pieces. Lines in order of part within an order; orders with their batch.
L = "lines AS (SELECT l_orderkey // 128 AS batch_id, l_orderkey AS sample, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS col FROM lineitem)"
O = "o AS (SELECT o_orderkey // 128 AS batch_id, o_orderkey AS sample, o_custkey AS cust FROM orders)"  # noqa: E741
N = "n AS (SELECT o_orderkey AS sample, o_orderkey // 128 AS batch_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
G = f"g AS (SELECT o_orderkey AS sample, o_orderkey // 128 AS batch_id, CAST(p AS INTEGER) AS p, ((o_orderkey + p) % 17 - 8) / 8.0::DOUBLE AS g FROM orders, range({D}) r(p))"
DENSE = "dx AS (SELECT batch_id, id, dense_rank() OVER (PARTITION BY batch_id ORDER BY id) AS k FROM (SELECT DISTINCT batch_id, id FROM lines) u)"
IDX = f"""{L}, {O}, {DENSE},
  idx AS (SELECT o.batch_id, o.sample, CAST(c AS INTEGER) AS col, coalesce(k, 0) AS idx FROM o CROSS JOIN range(10) r(c)
          LEFT JOIN lines l ON l.sample = o.sample AND l.col = c LEFT JOIN dx ON dx.batch_id = l.batch_id AND dx.id = l.id)"""
SUMS = f"""{G}, s AS (SELECT l_partkey AS sign, p, sum(g) AS g FROM lineitem JOIN g ON sample = l_orderkey GROUP BY 1, 2),
  w AS (SELECT vec_id AS sign, CAST(p AS INTEGER) AS p, embedding[p + 1]::DOUBLE AS w FROM embeddings, range({D}) r(p)),
  j AS (SELECT w.sign, w.p, w, g FROM w LEFT JOIN s ON w.sign = s.sign AND w.p = s.p)"""
_PLACES = f"range(1, {D + 1})::DOUBLE[]"
_V = lambda d: f"round(coalesce(list_sum(embedding::DOUBLE[]), 0), {d}) AS v, round(coalesce(list_inner_product(embedding::DOUBLE[], {_PLACES}), 0), {d}) AS vp"
_F = lambda x: f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4)"
_SPOILED = "t AS (SELECT o_orderkey AS sample, o_orderkey // 128 AS batch_id, (o_orderkey // 128) % 7 = 1 AS skipped, (o_orderkey // 128) % 5 = 0 AND o_orderkey % 128 = 3 AS bad FROM orders)"
_SCORED = "t AS (SELECT doc_id // 128 AS batch_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score, quality FROM labels)"


def _pool(sqrt: bool) -> str:
    by = " / sqrt(greatest(count(l_partkey), 1)::DOUBLE)" if sqrt else ""
    return f"""WITH j AS (SELECT o_orderkey AS sample, l_partkey, embedding FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN embeddings ON l_partkey = vec_id)
    SELECT sample, CAST(p AS INTEGER) AS p, round(coalesce(sum(embedding[p + 1]::DOUBLE), 0){by}, 4) AS v FROM j, range({D}) r(p) GROUP BY 1, 2"""


def _opt(new: str, state: str | None = None) -> str:
    s = f", CASE WHEN g IS NULL THEN {_F('s')} ELSE {_F(state)} END AS s" if state else ""
    return f"SELECT sign, p, {_F(f'CASE WHEN g IS NULL THEN w ELSE greatest(-10, least(10, {new})) END')} AS w{s} FROM"


_C01 = "CAST(0.01::FLOAT AS DOUBLE)"
_FARM_PART = _farm("p_partkey", "h", "part")

SQL: dict[str, str] = {
    "batch_halves_join": """SELECT o_orderkey // 128 AS batch_id, count(*) AS samples, CAST(sum(n) AS BIGINT) AS ids, CAST(sum(o_custkey) AS BIGINT) AS cust_sum, count(*)::DOUBLE AS labels
      FROM (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY 1""",
    "batch_sizes": "SELECT o_orderkey // 128 AS batch_id, count(*) AS size FROM orders GROUP BY 1",
    "payload_round_trip": f"WITH {N} SELECT n.batch_id, n.sample, n, coalesce(s, 0) AS part_sum, o_custkey AS cust FROM n JOIN orders ON o_orderkey = n.sample LEFT JOIN (SELECT l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1) ON l_orderkey = n.sample",
    "checkpoint_reshard": f"SELECT CAST(h % 3 AS INTEGER) AS shard, count(*) AS signs, CAST(sum(vec_id) AS BIGINT) AS sign_sum, round(sum(list_sum(embedding::DOUBLE[])), 3) AS v, round(sum(list_inner_product(embedding::DOUBLE[], {_PLACES})), 3) AS vp FROM {_farm('vec_id', 'h', 'embeddings')} GROUP BY 1",
    "upsert_last_writer": "SELECT user_id AS sign, round(arg_max(value, event_id), 4) AS v, max(event_id) AS last_access FROM events GROUP BY 1",
    "incremental_changed_signs": f"SELECT vec_id AS sign, CAST(p AS INTEGER) AS p, round(embedding[p + 1]::DOUBLE, 4) AS v FROM embeddings, range({D}) r(p) WHERE vec_id IN (SELECT user_id FROM events)",
    "packet_upsert": f"SELECT coalesce(vec_id, u) AS sign, CAST(p AS INTEGER) AS p, round(coalesce(m::DOUBLE, embedding[p + 1]::DOUBLE), 4) AS v FROM (embeddings FULL JOIN (SELECT user_id AS u, max(event_id) AS m FROM events GROUP BY 1) ON vec_id = u), range({D}) r(p)",
    "csv_round_trip": "SELECT o_orderpriority AS p, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
    "explode_features": """SELECT 'part' AS feature, l_orderkey AS sample, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS id_sum, CAST(count(*) - 1 AS INTEGER) AS last_col FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
      UNION ALL SELECT 'supp', l_orderkey, count(*), CAST(sum(l_suppkey) AS BIGINT), CAST(count(*) - 1 AS INTEGER) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
      UNION ALL SELECT 'cust', o_orderkey, 1, o_custkey, 0 FROM orders""",
    "id_dedup_positions": "SELECT l_orderkey // 128 AS batch_id, l_partkey AS id, count(*) AS n, min(l_orderkey) AS first_sample FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2",
    "id_counts_per_sample": f"WITH {N} SELECT 'part' AS feature, sample, 2 * n AS n FROM n UNION ALL SELECT 'cust', sample, 1 FROM n",
    "id_unique_rate": "SELECT 'part' AS feature, round(count(DISTINCT l_partkey) / count(*), 6) AS unique_rate FROM lineitem UNION ALL SELECT 'supp', round(count(DISTINCT l_suppkey) / count(*), 6) FROM lineitem",
    "id_approx_distinct": "SELECT 'part' AS feature, true AS \"close\"",
    "id_dense_index": f"WITH {L}, {DENSE} SELECT batch_id, id, k - 1 AS distinct_idx FROM dx",
    "id_truncate_fixed": f"WITH {L} SELECT sample, CAST(col AS INTEGER) AS col, id FROM lines WHERE col < 10 AND sample IN (SELECT o_orderkey FROM orders)",
    "hash_stack_buckets": f"SELECT bucket, count(*) AS ids FROM (SELECT unnest([CAST(h1 % 10 AS BIGINT), CAST(h2 % 10 AS BIGINT) + 10]) AS bucket FROM {_farm('h1', 'h2', _farm('s', 'h1', '(SELECT DISTINCT l_suppkey AS s FROM lineitem)'))}) GROUP BY 1",
    "prefix_signs": f"SELECT p_partkey, CAST(h % 4503599627370495 AS BIGINT) + 4503599627370496 AS sign, 1::BIGINT AS key_group FROM {_FARM_PART}",
    "shard_counts": f"SELECT CAST(h % 7 AS INTEGER) AS shard, count(*) AS signs FROM {_farm('s', 'h', '(SELECT DISTINCT l_partkey AS s FROM lineitem)')} GROUP BY 1",
    "shard_repartition_sum": f"SELECT CAST(h % 7 AS INTEGER) AS shard, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS sign_sum FROM {_farm('l_partkey', 'h', 'lineitem')} GROUP BY 1",
    "unsigned_modulo": f"SELECT p_partkey, CAST(h % 1000003 AS BIGINT) AS r, CAST(h % 4503599627370495 AS BIGINT) + 22517998136852480 AS k FROM {_FARM_PART}",
    "emb_lookup_left": f"SELECT l_orderkey AS sample, l_partkey AS sign, vec_id IS NULL AS miss, {_V(4)} FROM lineitem LEFT JOIN embeddings ON l_partkey = vec_id",
    "emb_lookup_half": """SELECT vec_id AS sign, CAST(p AS INTEGER) AS p, CASE WHEN x = 0 THEN 0 ELSE round_even(x / s, 0) * s END + 0.0::DOUBLE AS v
      FROM (SELECT *, pow(2.0::DOUBLE, greatest(floor(log2(nullif(abs(x), 0))), -14) - 10) AS s FROM (SELECT vec_id, p, embedding[p + 1]::DOUBLE AS x FROM embeddings, range(64) r(p)))""",
    "emb_lookup_distinct": f"SELECT DISTINCT l_partkey AS sign, vec_id IS NULL AS miss, CAST(p AS INTEGER) AS p, round(coalesce(embedding[p + 1]::DOUBLE, 0), 4) AS v FROM (lineitem LEFT JOIN embeddings ON l_partkey = vec_id), range({D}) r(p)",
    "emb_sum_pool": _pool(False),
    "emb_sum_pool_sqrtn": _pool(True),
    "emb_miss_ratio": "SELECT count(*) AS requests, count(*) FILTER (vec_id IS NULL) AS misses, round(count(*) FILTER (vec_id IS NULL) / count(*), 6) AS miss_ratio FROM lineitem LEFT JOIN embeddings ON l_partkey = vec_id",
    "emb_dim_mismatch": "SELECT count(*) AS requests, count(*) FILTER (vec_id IS NULL OR vec_id % 3 = 0) AS misses FROM lineitem LEFT JOIN embeddings ON l_partkey = vec_id",
    "raw_index_padded": f"WITH {IDX} SELECT sample, col, idx FROM idx",
    "raw_mask": f"WITH {IDX} SELECT sample, CAST(count(*) AS INTEGER) AS width, CAST(count(*) FILTER (idx <> 0) AS DOUBLE) AS ones FROM idx GROUP BY 1",
    "raw_distinct_rows": f"""WITH {L}, {O}, {DENSE} SELECT batch_id, k AS distinct_idx, CAST(p AS INTEGER) AS p, round(coalesce(embedding[p + 1]::DOUBLE, 0), 4) AS v
      FROM (SELECT * FROM dx UNION ALL SELECT DISTINCT batch_id, NULL, 0 FROM dx) LEFT JOIN embeddings ON id = vec_id CROSS JOIN range({D}) r(p)""",
    "raw_gather": f"WITH {IDX}, f AS (SELECT idx.*, dx.id FROM idx LEFT JOIN dx ON dx.batch_id = idx.batch_id AND dx.k = idx.idx) SELECT sample, col, {_V(4)}, CAST(idx <> 0 AS INTEGER)::DOUBLE AS mask FROM f LEFT JOIN embeddings ON vec_id = id WHERE batch_id IN (SELECT batch_id FROM dx)",
    "raw_non_empty": f"WITH {IDX} SELECT sample, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM idx WHERE idx <> 0 GROUP BY 1",
    "feature_concat": f"""WITH j AS (SELECT l_orderkey AS sample, 0 AS f, l_partkey AS k FROM lineitem UNION ALL SELECT l_orderkey, 1, l_suppkey FROM lineitem)
      SELECT sample, CAST({D} * f + p AS INTEGER) AS p, round(coalesce(sum(embedding[p + 1]::DOUBLE), 0), 4) AS v FROM j LEFT JOIN embeddings ON k = vec_id, range({D}) r(p) GROUP BY sample, f, p""",
    "grad_sum_per_sign": f"WITH {G} SELECT l_partkey AS sign, p, round(sum(g), 4) AS g FROM lineitem JOIN g ON sample = l_orderkey GROUP BY 1, 2",
    "grad_unscale_sqrt": f"WITH {G}, {N} SELECT g.sample, p, round((CASE WHEN g = 1 THEN 65504.0 / 128 ELSE g END) / sqrt(greatest(n, 1)::DOUBLE), 4) AS g FROM g JOIN n ON n.sample = g.sample",
    "grad_nan_skip": f"WITH {_SPOILED} SELECT batch_id, count(*) AS samples FROM t WHERE NOT skipped AND batch_id NOT IN (SELECT batch_id FROM t WHERE bad AND NOT skipped) GROUP BY 1",
    "grad_skip_counts": f"WITH {_SPOILED} SELECT 'part' AS feature, count(*) FILTER (b) AS nan_batches, count(*) FILTER (s) AS skipped_batches FROM (SELECT batch_id, bool_or(bad) AS b, bool_and(skipped) AS s FROM t GROUP BY 1)",
    "grad_finite_check": f"WITH {_SPOILED} SELECT batch_id, NOT bool_or(bad) AS finite FROM t WHERE batch_id % 10 = 0 GROUP BY 1",
    "raw_grad_index_add": f"WITH {IDX}, {G} SELECT idx.batch_id, idx AS distinct_idx, p, round(sum(g), 4) AS g FROM idx JOIN g ON g.sample = idx.sample WHERE idx <> 0 GROUP BY 1, 2, 3",
    "gradient_miss_anti": "SELECT DISTINCT l_partkey AS sign FROM lineitem WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)",
    "dense_all_reduce": f"WITH {G} SELECT p, round(avg(g), 4) AS g FROM g GROUP BY 1",
    "opt_sgd_step": f"WITH {SUMS} {_opt('w - 0.01::DOUBLE * (g + 0.1::DOUBLE * w)')} j",
    "opt_per_feature_steps": f"""WITH {SUMS}, s2 AS (SELECT l_suppkey AS sign, p, sum(g) AS g2 FROM lineitem JOIN g ON sample = l_orderkey GROUP BY 1, 2),
      one AS (SELECT sign, p, CASE WHEN g IS NULL THEN w ELSE CAST(CAST(greatest(-10, least(10, w - 0.01::DOUBLE * (g + 0.1::DOUBLE * w))) AS FLOAT) AS DOUBLE) END AS w FROM j)
      SELECT one.sign, one.p, {_F('CASE WHEN g2 IS NULL THEN w ELSE greatest(-10, least(10, w - 0.01::DOUBLE * (g2 + 0.1::DOUBLE * w))) END')} AS w FROM one LEFT JOIN s2 ON one.sign = s2.sign AND one.p = s2.p""",
    "entry_parts": f"SELECT vec_id AS sign, {_V(4)}, 1::INTEGER AS n, 0.01::DOUBLE AS s FROM embeddings",
    "opt_adagrad_step": f"WITH {SUMS} {_opt(f'w - 0.01::DOUBLE * g / sqrt({_C01} + 1e-10)', f'{_C01} + g * g')} (SELECT *, {_C01} AS s FROM j)",
    "opt_adagrad_shared_step": f"WITH {SUMS} SELECT sign, p, {_F(f'CASE WHEN g IS NULL THEN w ELSE greatest(-10, least(10, w - 0.01::DOUBLE * g / sqrt({_C01} + 1e-10))) END')} AS w, CASE WHEN p = 0 THEN {_F(f'{_C01} + coalesce(q, 0)')} END AS s FROM (SELECT *, avg(g * g) OVER (PARTITION BY sign) AS q FROM j)",
    "opt_adam_step": f"""WITH {SUMS}, a AS (SELECT *, 0.1::DOUBLE * g AS m, 0.001::DOUBLE * g * g AS v FROM j)
      SELECT sign, p, {_F("CASE WHEN g IS NULL THEN w ELSE greatest(-10, least(10, w - 0.001::DOUBLE * (m / (1 - 0.9::DOUBLE * 0.9::DOUBLE)) / (1e-8 + sqrt(v / (1 - 0.999::DOUBLE * 0.999::DOUBLE))))) END")} AS w, {_F('coalesce(m, 0)')} AS s, {_F('coalesce(v, 0)')} AS s2 FROM a""",
    "weight_clamp": f"SELECT vec_id AS sign, CAST(p AS INTEGER) AS p, round(greatest(-0.05::DOUBLE, least(0.05::DOUBLE, embedding[p + 1]::DOUBLE)), 4) AS v FROM embeddings, range({D}) r(p)",
    "f16_clamp": "SELECT l_orderkey, round(sum(least(l_extendedprice * 10, 65504)), 3) AS s0, round(sum(greatest(-l_extendedprice, -65504)), 3) AS s1, round(sum(CASE WHEN l_linenumber = 1 THEN 65504.0 ELSE 0 END)::DOUBLE, 3) AS s2 FROM lineitem GROUP BY 1",
    "lru_evict": "SELECT sign, last_access FROM (SELECT *, row_number() OVER (PARTITION BY sign % 4 ORDER BY last_access DESC, sign DESC) AS r FROM (SELECT user_id AS sign, max(event_id) AS last_access FROM events GROUP BY 1)) WHERE r <= 10",
    "train_touch_insert": """SELECT touched, count(*) AS signs, CAST(sum(sign) AS BIGINT) AS sign_sum, count(*) FILTER (fresh) AS started FROM (
      SELECT coalesce(vec_id, k) AS sign, k IS NOT NULL AS touched, vec_id IS NULL AS fresh FROM embeddings FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) ON vec_id = k) GROUP BY 1""",
    "adam_step_powers": """SELECT key_group, batch_id, step, round(pow(0.9::DOUBLE, step + 1), 8) AS p1, round(pow(0.999::DOUBLE, step + 1), 8) AS p2 FROM (
      SELECT key_group, batch_id, row_number() OVER (PARTITION BY key_group ORDER BY batch_id) AS step FROM (SELECT DISTINCT user_id % 3 + 1 AS key_group, event_id // 100 AS batch_id FROM events))""",
    "batch_slicing": "SELECT o_orderkey, i // 100 AS batch_id, i % 100 AS sample FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i < n // 100 * 100",
    "batch_reorder": "SELECT CASE WHEN event_id % 10 <> 0 THEN event_id ELSE 0 END AS position, count(*) AS n FROM events GROUP BY 1",
    "batch_route": "SELECT CAST((event_id * 3 + 1) % 4 AS INTEGER) AS rank, count(*) AS n, CAST(sum(event_id * 3 + 1) AS BIGINT) AS ids FROM events GROUP BY 1",
    "batch_chunks": "SELECT CAST(i * 6 // n AS INTEGER) AS chunk, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) GROUP BY 1",
    "auc_exact": f"WITH {_SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM t) SELECT round((sum(r) FILTER (quality = 1)::DOUBLE - p * (p + 1) / 2) / (p * n), 8) AS auc FROM r, (SELECT count(*) FILTER (quality = 1)::DOUBLE AS p, count(*) FILTER (quality = 0)::DOUBLE AS n FROM t) GROUP BY p, n",
    "batch_accuracy": f"WITH {_SCORED} SELECT round(avg(a), 8) AS accuracy FROM (SELECT batch_id, avg(CAST(round_even(score, 0) = quality AS INTEGER)) AS a FROM t GROUP BY 1)",
    "logloss": f"WITH {_SCORED} SELECT round(avg(l), 6) AS log_loss FROM (SELECT batch_id, avg(-(quality * (CASE WHEN score > 0 THEN greatest(ln(score), -100) ELSE -100 END) + (1 - quality) * ln(1 - score))) AS l FROM t GROUP BY 1)",
    "ordinal_encode": "WITH c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')) SELECT coalesce(k, (SELECT count(*) FROM c)) AS code, count(*) AS n FROM orders LEFT JOIN c ON v = o_orderpriority GROUP BY 1",
    "tabular_prepare": """WITH a AS (SELECT *, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS c0, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS c1 FROM orders)
      SELECT CAST(CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1 ELSE 0 END AS FLOAT) AS target, c0, c1, count(*) AS n, sum(CAST(CAST(o_custkey AS FLOAT) AS DOUBLE)) AS x FROM a GROUP BY 1, 2, 3""",
    "pending_batches": "SELECT event_id % 3 AS batcher_idx, event_id AS ref_id FROM events WHERE event_id % 5 = 0",
}
SQL["stream_pool_available_now"] = f"SELECT * FROM ({_pool(False)}) WHERE sample IN (SELECT l_orderkey FROM lineitem)"

#: Columns whose rounded values may be a negative zero, which is brought to zero.
_FLOATS = {"v": "emb_sum_pool emb_sum_pool_sqrtn stream_pool_available_now feature_concat incremental_changed_signs packet_upsert emb_lookup_distinct raw_distinct_rows weight_clamp upsert_last_writer", "g": "grad_sum_per_sign grad_unscale_sqrt raw_grad_index_add dense_all_reduce", "w": "opt_sgd_step opt_per_feature_steps", "w s": "opt_adagrad_step opt_adagrad_shared_step", "w s s2": "opt_adam_step", "v vp": "entry_parts emb_lookup_left raw_gather checkpoint_reshard", "s0 s1 s2": "f16_clamp"}
for _columns, _names in _FLOATS.items():
    for _name in _names.split():
        _plus = ", ".join(f"{c} + 0.0::DOUBLE AS {c}" for c in _columns.split())
        SQL[_name] = f"SELECT * REPLACE ({_plus}) FROM ({SQL[_name]}) z"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
