"""One query per operator, over the star-schema tables that stand in for feature batches.

sample = order, multi-id features = part and supplier keys of its lines, single
id = customer, table = ``embeddings``, whole vectors of ``D`` elements, batch =
128 orders. Results are flat and rounded, to be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EmbeddingConfig, Hyperparameters, parse_embedding_config
from .functions.optim import SGD, Adagrad, Adam, Optimizer
from .functions.u64 import farmhash64, group_of, key_in_range, shard_of, u64_mod
from .functions.vectors import all_finite, clamped, dealt, half_rounded, sum_vectors, widen_half
from .operators import features, grads, lookup, metrics, order, table
from .operators.features import SAMPLE
from .sources import batches, checkpoint
from .sources.scratch import scratch

D = 64
BATCH = 128
FIXED = 10
SLOTS: EmbeddingConfig = parse_embedding_config({"feature_index_prefix_bit": 12, "slots_config": {"part": {"dim": D, "embedding_summation": True}, "supp": {"dim": D, "hash_stack_config": {"hash_stack_rounds": 2, "embedding_size": 10}}}})


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _batch(key: str) -> Column:
    return F.expr(f"{key} DIV {BATCH}").alias("batch_id")


def _lines(spark: SparkSession, d: str, feature: str = "part") -> DataFrame:
    """Long form straight from the lines; ``id`` and ``sign`` are the key."""
    key = F.col("l_partkey" if feature == "part" else "l_suppkey")
    return _t(spark, d, "lineitem").select(_batch("l_orderkey"), F.lit(feature).alias("feature"), F.col("l_orderkey").alias("sample"), key.alias("id"), key.alias("sign"))


def _counts(spark: SparkSession, d: str, feature: str = "part") -> DataFrame:
    """Ids of every order, also of those without lines."""
    n = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = _t(spark, d, "orders").select("o_orderkey")
    return orders.join(n, orders.o_orderkey == n.l_orderkey, "left").select(_batch("o_orderkey"), F.lit(feature).alias("feature"), F.col("o_orderkey").alias("sample"), F.coalesce("n", F.lit(0)).alias("n"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Batches with array columns, ids in order."""
    lists = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("part"), F.sort_array(F.collect_list("l_suppkey")).alias("supp"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    none = F.array().cast("array<bigint>")
    return orders.join(lists, orders.o_orderkey == lists.l_orderkey, "left").select(_batch("o_orderkey"), F.col("o_orderkey").alias("sample"), F.coalesce("part", none).alias("part"), F.coalesce("supp", none).alias("supp"), F.col("o_custkey").alias("cust"))


def _table(spark: SparkSession, d: str, optimizer: Optimizer = SGD()) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sign"), F.lit(D).alias("dim"), F.col("embedding").alias("emb"), optimizer.initial_state(D).alias("opt"), F.col("vec_id").alias("last_access"))


def _grads(spark: SparkSession, d: str, feature: str = "part", deal: bool = False) -> DataFrame:
    """A gradient for each order, made of binary fractions; ``deal``: where the join by sample needs it."""
    g = F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: ((F.col("sample") + i) % 17 - 8) / F.lit(8.0))
    keys = _t(spark, d, "orders").select(_batch("o_orderkey"), F.lit(feature).alias("feature"), F.col("o_orderkey").alias("sample"))
    return (dealt(keys, *SAMPLE) if deal else keys).select(*SAMPLE, g.alias("grad"))


def _flat(df: DataFrame, vector: str, *keys: str, out: str = "v", dims: int = D) -> DataFrame:
    rows = df.select(*keys, F.posexplode(F.slice(vector, 1, dims)).alias("p", out)).withColumn(out, F.col(out).cast("double"))
    return rows.withColumn(out, _four_places(F.col(out)))


def _four_places(x: Column) -> Column:
    """``x`` to four places, half up, as SQL does: in floating point, where Spark's round makes a decimal of each value."""
    n = F.floor(F.abs(x) * 1e4 + 0.5)
    return F.when(F.abs(x) < 1e9, F.when(x < 0, -n).otherwise(n) / 1e4).otherwise(F.round(x, 4))


def _sums(vector: str) -> list[Column]:
    """Sum of all elements, and sum weighted by place, which tells permutations apart."""
    add = lambda a, x: a + x
    v = F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), add)
    placed = F.aggregate(F.transform(F.slice(vector, 1, D), lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), add)
    return [v, placed]


def _rounded(vector: str) -> list[Column]:
    return [F.round(c, 4).alias(n) for c, n in zip(_sums(vector), ("v", "vp"), strict=True)]


# scans, batches ------------------------------------------------------------------------


def batch_halves_join(spark, d):
    b = batches.make_batches(_nested(spark, d).withColumn("y", F.lit(1.0)), ["part", "cust"], labels=["y"])
    joined = batches.id_half(b, ["part", "cust"]).join(batches.dense_half(b, ["part", "cust"]), ["batch_id", "sample"])
    return joined.groupBy("batch_id").agg(F.count("*").alias("samples"), F.sum(F.size("part")).cast("long").alias("ids"), F.sum("cust").alias("cust_sum"), F.sum("y").alias("labels"))


def batch_sizes(spark, d):
    return batches.check_batch_sizes(_nested(spark, d))


def payload_round_trip(spark, d):
    packed = batches.to_payload(_nested(spark, d).select("batch_id", "sample", "part", "cust"))
    rows = batches.from_payload(packed, "sample long, part array<long>, cust long")
    return rows.select("batch_id", "sample", F.size("part").cast("long").alias("n"), F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x).alias("part_sum"), "cust")


def checkpoint_reshard(spark, d):
    path = scratch(spark, "table")
    checkpoint.save_table(_table(spark, d), path, 5)
    loaded = checkpoint.load_table(spark, path, 3)
    return loaded.groupBy(shard_of(F.col("sign"), 3).alias("shard")).agg(F.count("*").alias("signs"), F.sum("sign").alias("sign_sum"), *[F.round(F.sum(c), 3).alias(n) for c, n in zip(_sums("emb"), ("v", "vp"), strict=True)])


def upsert_last_writer(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("sign"), F.col("value").alias("v"), F.col("event_id").alias("last_access"))
    old, new = e.where("last_access % 2 = 0"), e.where("last_access % 2 = 1")
    done = table.upsert(table.upsert(e.where("false"), old), new)
    return done.select("sign", F.round("v", 4).alias("v"), "last_access")


def incremental_changed_signs(spark, d):
    touched = _t(spark, d, "events").select(F.col("user_id").alias("sign"))
    return _flat(checkpoint.changed_rows(_table(spark, d), touched), "emb", "sign")


def packet_upsert(spark, d):
    t = _table(spark, d)
    e = _t(spark, d, "events").select(F.col("user_id").alias("sign"), "ts", F.col("event_id").cast("double").alias("x"), "event_id")
    packet = e.select("sign", F.lit(D).alias("dim"), F.array_repeat(F.col("x").cast("float"), D).alias("emb"), F.array().cast("array<float>").alias("opt"), (F.col("event_id") + 1_000_000).alias("last_access"), F.timestamp_seconds(F.col("event_id")).alias("emitted_at"))
    return _flat(checkpoint.apply_packet(t, packet), "emb", "sign")


def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("  "), "o_orderpriority").alias("p")).write.option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = batches.read_table(spark, path, "o_orderkey long, p string")
    return rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


# features ------------------------------------------------------------------------------


def explode_features(spark, d):
    rows = features.explode_ids(_nested(spark, d), ["part", "supp", "cust"])
    return rows.groupBy("feature", "sample").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.max("col").alias("last_col"))


def id_dedup_positions(spark, d):
    rows = features.dedup(features.explode_ids(_nested(spark, d), ["part"]))
    return rows.select("batch_id", "id", F.size("positions").cast("long").alias("n"), F.array_min(F.transform("positions", lambda x: x["sample"])).alias("first_sample"))


def id_counts_per_sample(spark, d):
    return features.id_counts(_nested(spark, d), ["part", "cust"], {"part": 2}).select("feature", "sample", "n")


def id_unique_rate(spark, d):
    return features.unique_rate(_lines(spark, d).union(_lines(spark, d, "supp"))).select("feature", F.round("unique_rate", 6).alias("unique_rate"))


def id_approx_distinct(spark, d):
    rows = _lines(spark, d)
    exact = rows.groupBy("feature").agg(F.count_distinct("id").alias("n"))
    return features.distinct_estimate(rows).join(exact, "feature").select("feature", (F.abs(F.col("distinct_ids") - F.col("n")) <= 0.03 * F.col("n")).alias("close"))


def id_dense_index(spark, d):
    ids = dealt(_lines(spark, d).select("batch_id", "feature", "id"), "batch_id").distinct()  # copies of an id share its index
    return features.dense_index(ids).select("batch_id", "id", "distinct_idx")


def id_truncate_fixed(spark, d):
    return features.truncated(features.explode_ids(_nested(spark, d), ["part"]), FIXED).select("sample", "col", "id")


def hash_stack_buckets(spark, d):
    ids = _lines(spark, d, "supp").select("batch_id", "feature", "sample", "id").withColumn("col", F.lit(0))
    rows = features.stacked(ids.select("feature", "id").distinct(), SLOTS)
    return rows.groupBy(F.col("id").alias("bucket")).agg(F.count("*").alias("ids"))


def prefix_signs(spark, d):
    ids = _t(spark, d, "part").select(F.lit("part").alias("feature"), "p_partkey", farmhash64("p_partkey").alias("id"))
    return features.prefixed(features.with_slots(ids, SLOTS), SLOTS).select("p_partkey", "sign", group_of(F.col("sign"), 12).alias("key_group"))


def shard_counts(spark, d):
    rows = _lines(spark, d).select("sign").distinct()
    return table.shard_sizes(rows, shard_of(F.col("sign"), 7))


def shard_repartition_sum(spark, d):
    rows = features.sharded(_lines(spark, d), 7)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.sum("sign").alias("sign_sum"))


def unsigned_modulo(spark, d):
    h = farmhash64("p_partkey")
    return _t(spark, d, "part").select("p_partkey", u64_mod(h, 1_000_003).alias("r"), key_in_range(h, F.lit(5 << 52), 12).alias("k"))


# lookup --------------------------------------------------------------------------------


def emb_lookup_left(spark, d):
    found = lookup.lookup(_lines(spark, d), _table(spark, d), D)
    return found.select("sample", "sign", "miss", *_rounded("emb"))


def emb_lookup_half(spark, d):
    """Whole vectors, rounded through half precision, as a lookup returns them."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("sign"), half_rounded(F.col("embedding").cast("array<float>")).alias("emb"))
    return e.select("sign", F.posexplode("emb").alias("p", "v")).select("sign", "p", F.col("v").cast("double").alias("v"))


def emb_lookup_distinct(spark, d):
    found = lookup.lookup_distinct(_lines(spark, d), _table(spark, d), D)
    return _flat(found, "emb", "sign", "miss")


def _pooled(spark, d, **how):
    """Ids are dealt and then looked up, so vectors are summed where they are; every order comes as a row without an id too."""
    lines, orders = _lines(spark, d), _t(spark, d, "orders")
    empty = orders.select(_batch("o_orderkey"), F.lit("part").alias("feature"), F.col("o_orderkey").alias("sample"), F.lit(None).cast(lines.schema["sign"].dataType).alias("sign"))
    return lookup.sum_pooled(lookup.dealt_lookup(lines.select(*SAMPLE, "sign").union(empty), _table(spark, d), D), D, double=True, **how)


def emb_sum_pool(spark, d):
    return _flat(_pooled(spark, d), "emb", "sample")


def emb_sum_pool_sqrtn(spark, d):
    return _flat(_pooled(spark, d, sqrt_scaling=True), "emb", "sample")


def emb_miss_ratio(spark, d):
    return lookup.miss_ratio(lookup.lookup(_lines(spark, d), _table(spark, d), D)).select("requests", "misses", F.round("miss_ratio", 6).alias("miss_ratio"))


def emb_dim_mismatch(spark, d):
    t = _table(spark, d).withColumn("emb", F.when(F.col("sign") % 3 == 0, F.slice("emb", 1, 4)).otherwise(F.col("emb")))
    return lookup.miss_ratio(lookup.lookup(_lines(spark, d), t, D)).select("requests", "misses")


def _raw(spark, d):
    rows = features.explode_ids(_nested(spark, d), ["part"]).withColumn("sign", F.col("id"))
    total = _t(spark, d, "lineitem").count()
    rows, counts = (dealt(x, "batch_id", "feature", total=total) for x in (rows, _counts(spark, d)))
    return lookup.raw_pooled(rows, _table(spark, d), D, FIXED, counts=counts)


def raw_index_padded(spark, d):
    distinct, index = _raw(spark, d)
    return lookup.check_index(distinct, index).select("sample", F.posexplode("idx").alias("col", "idx"))


def raw_mask(spark, d):
    mask = _raw(spark, d)[1].select("sample", lookup.padding_mask(F.col("idx")).alias("m"))
    return mask.select("sample", F.size("m").alias("width"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x).alias("ones"))


def raw_distinct_rows(spark, d):
    return _flat(_raw(spark, d)[0], "emb", "batch_id", "distinct_idx")


def raw_gather(spark, d):
    rows = lookup.gathered(*_raw(spark, d)).select("sample", F.posexplode("rows").alias("col", "r"))
    mask = F.get("r", F.lit(D)).cast("double").alias("mask")
    x = [F.get("r", F.lit(i)).cast("double") for i in range(D)]  # element by element: no lambda for each of ten rows a sample
    v, vp = sum(x, F.lit(0.0)), sum((c * F.lit(i + 1) for i, c in enumerate(x)), F.lit(0.0))
    return rows.select("sample", "col", F.round(v, 4).alias("v"), F.round(vp, 4).alias("vp"), mask)


def raw_non_empty(spark, d):
    return lookup.non_empty_index(_raw(spark, d)[1]).groupBy("sample").agg(F.count("*").alias("n"), F.sum("distinct_idx").alias("idx_sum"))


def feature_concat(spark, d):
    both = _lines(spark, d).union(_lines(spark, d, "supp"))
    pooled = lookup.sum_pooled(lookup.dealt_lookup(both, _table(spark, d), D), D, double=True)
    return _flat(lookup.concat_features(pooled, ["part", "supp"]), "emb", "sample", dims=2 * D)


# gradients -----------------------------------------------------------------------------


def grad_sum_per_sign(spark, d):
    return _flat(grads.grads_per_sign(_lines(spark, d), _grads(spark, d), D), "grad", "sign", out="g")


def grad_unscale_sqrt(spark, d):
    big = F.transform("grad", lambda g: F.when(g == 1, F.lit(float("inf"))).otherwise(g * 128))
    g = grads.unscaled(_grads(spark, d, deal=True).withColumns({"grad": big, "scale": F.lit(128.0)}))
    return _flat(grads.sqrt_scaled(g, _counts(spark, d).hint("shuffle_hash")), "grad", "sample", out="g")


def _spoiled(spark, d):
    nan = F.transform("grad", lambda g: F.when((F.col("batch_id") % 5 == 0) & (F.col("sample") % 128 == 3), F.lit(float("nan"))).otherwise(g))
    return _grads(spark, d).withColumns({"grad": nan, "skipped": F.col("batch_id") % 7 == 1})


def grad_nan_skip(spark, d):
    return grads.usable(_spoiled(spark, d)).groupBy("batch_id").agg(F.count("*").alias("samples"))


def grad_skip_counts(spark, d):
    return grads.skip_counts(_spoiled(spark, d))


def grad_finite_check(spark, d):
    g = _spoiled(spark, d).groupBy("batch_id").agg(F.bool_and(all_finite(F.col("grad"))).alias("finite"))
    return g.where(order.every_nth(F.col("batch_id"), 10))


def raw_grad_index_add(spark, d):
    """A sample's gradient goes to its batch once, and to its places there."""
    g = _grads(spark, d, deal=True).join(_raw(spark, d)[1].hint("shuffle_hash"), SAMPLE)
    g = dealt(g, "batch_id", "feature", total=_t(spark, d, "lineitem").count())
    at = g.select(*SAMPLE, "grad", F.posexplode("idx").alias("col", "distinct_idx"))
    return _flat(grads.raw_index_add(at, D), "grad", "batch_id", "distinct_idx", out="g")


def gradient_miss_anti(spark, d):
    return table.missing_gradients(_table(spark, d), _lines(spark, d).select("sign").distinct())


def dense_all_reduce(spark, d):
    return _flat(grads.dense_mean(_grads(spark, d), D), "grad", out="g")


# table ---------------------------------------------------------------------------------


def _step(spark, d, optimizer: Optimizer, bound: float = 10.0):
    g = grads.grads_per_sign(_lines(spark, d), _grads(spark, d), D, table=_table(spark, d))
    t = table.apply_gradients(_table(spark, d, optimizer), g, optimizer, Hyperparameters(weight_bound=bound), 1)
    parts = [F.col("emb").alias("w"), F.slice("opt", 1, D).alias("s"), F.slice("opt", D + 1, D).alias("s2")][: 1 + -(-optimizer.state_size(D) // D)]
    names = ("w", "s", "s2")[: len(parts)]
    rows = t.select("sign", *parts).select("sign", F.posexplode(F.arrays_zip(*names)).alias("p", "r"))
    return rows.select("sign", "p", *[F.round(F.col(f"r.{n}").cast("double"), 4).alias(n) for n in names])


def opt_sgd_step(spark, d):
    return _step(spark, d, SGD(lr=0.01, weight_decay=0.1))


def opt_adagrad_step(spark, d):
    return _step(spark, d, Adagrad(lr=0.01))


def opt_adagrad_shared_step(spark, d):
    return _step(spark, d, Adagrad(lr=0.01, vectorwise_shared=True))


def opt_adam_step(spark, d):
    return _step(spark, d, Adam())


def opt_per_feature_steps(spark, d):
    """Two features that share keys: the step of the second starts from that of the first."""
    rows = _lines(spark, d).union(_lines(spark, d, "supp"))
    g = grads.grads_per_sign(rows, _grads(spark, d).union(_grads(spark, d, "supp")), D, per_feature=True, table=_table(spark, d))
    t = table.apply_per_feature(_table(spark, d), g, ["part", "supp"], SGD(lr=0.01, weight_decay=0.1), Hyperparameters())
    return _flat(t, "emb", "sign", out="w")


def entry_parts(spark, d):
    """Weights and state of entries stored as one array."""
    t = _table(spark, d, Adagrad(vectorwise_shared=True)).withColumn("entry", F.concat("emb", "opt"))
    parts = t.select("sign", table.vector_part(F.col("entry"), D).alias("emb"), table.state_part(F.col("entry"), D).alias("state"))
    return parts.select("sign", *_rounded("emb"), F.size("state").alias("n"), F.round(F.get("state", F.lit(0)).cast("double"), 6).alias("s"))


def weight_clamp(spark, d):
    return _flat(_table(spark, d).withColumn("emb", clamped(F.col("emb"), 0.05)), "emb", "sign")


def f16_clamp(spark, d):
    v = F.array(F.col("l_extendedprice") * 10, -F.col("l_extendedprice"), F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(0.0))
    rows = _t(spark, d, "lineitem").select("l_orderkey", widen_half(v).alias("v"))
    return rows.groupBy("l_orderkey").agg(*[F.round(F.sum(F.get("v", F.lit(i))), 3).alias(f"s{i}") for i in range(3)])


def lru_evict(spark, d):
    used = _t(spark, d, "events").groupBy(F.col("user_id").alias("sign")).agg(F.max("event_id").alias("last_access"))
    return table.evict(used, 10, F.pmod("sign", F.lit(4)))


def train_touch_insert(spark, d):
    hyper = Hyperparameters()
    t = table.touch(_table(spark, d), _lines(spark, d), D, hyper, Adagrad(), 1_000_000)
    return t.groupBy((F.col("last_access") == 1_000_000).alias("touched")).agg(F.count("*").alias("signs"), F.sum("sign").alias("sign_sum"), F.count_if(F.size("opt") == D).alias("started"))


def adam_step_powers(spark, d):
    rows = _t(spark, d, "events").select(F.shiftleft(F.col("user_id") % 3 + 1, 56).bitwiseOR(F.col("user_id")).alias("sign"), F.expr("event_id DIV 100").alias("batch_id"))
    p1, p2 = Adam().powers(F.col("step"))
    return table.group_steps(rows, 8).select(F.col("group").alias("key_group"), "batch_id", F.col("step").cast("long").alias("step"), F.round(p1, 8).alias("p1"), F.round(p2, 8).alias("p2"))


# order, metrics, preparation -------------------------------------------------------------


def batch_slicing(spark, d):
    return order.sliced(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, drop_last=True).select("o_orderkey", "batch_id", F.col("sample").cast("long").alias("sample"))


def batch_reorder(spark, d):
    rows = _t(spark, d, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("batch_id"), F.col("event_id"))
    return order.in_batch_order(rows).groupBy(F.coalesce("batch_id", F.lit(0)).alias("position")).agg(F.count("*").alias("n"))


def batch_route(spark, d):
    rows = _t(spark, d, "events").select(order.global_batch_id(F.col("event_id"), 1, 3).alias("batch_id"))
    return order.routed(rows, 4).groupBy("rank").agg(F.count("*").alias("n"), F.sum("batch_id").alias("ids"))


def batch_chunks(spark, d):
    return order.chunked(_t(spark, d, "events").select("event_id"), "event_id", 6).groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def _scored(spark, d):
    return _t(spark, d, "labels").select(_batch("doc_id"), ((F.col("doc_id") * 7919 % 1000) / 1000).alias("score"), "quality")


def auc_exact(spark, d):
    return metrics.auc(_scored(spark, d), "score", "quality").select(F.round("auc", 8).alias("auc"))


def batch_accuracy(spark, d):
    return metrics.batch_accuracy(_scored(spark, d), "score", "quality").select(F.round("accuracy", 8).alias("accuracy"))


def logloss(spark, d):
    return metrics.log_loss(_scored(spark, d), "score", "quality").select(F.round("log_loss", 6).alias("log_loss"))


def ordinal_encode(spark, d):
    o = _t(spark, d, "orders")
    codes = batches.ordinal_codes(o.where("o_orderpriority <> '5-LOW'"), "o_orderpriority")
    return batches.encode_ordinal(o, "o_orderpriority", codes, "code").groupBy("code").agg(F.count("*").alias("n"))


def tabular_prepare(spark, d):
    o = _t(spark, d, "orders")
    made, _ = batches.prepare_tabular(o, ["o_orderstatus", "o_orderpriority"], ["o_custkey"], "o_orderpriority", "URGENT")
    return made.groupBy("target", F.get("categorical_data", F.lit(0)).alias("c0"), F.get("categorical_data", F.lit(1)).alias("c1")).agg(F.count("*").alias("n"), F.sum(F.get("continuous_data", F.lit(0)).cast("double")).alias("x"))


def pending_batches(spark, d):
    a = _t(spark, d, "events").select((F.col("event_id") % 3).alias("batcher_idx"), F.col("event_id").alias("ref_id"))
    return metrics.pending(a, a.where("ref_id % 5 <> 0"), ["batcher_idx", "ref_id"])


def stream_pool_available_now(spark, d):
    """Sum pooling of a file stream: micro-batches append partial sums, which are summed when it ends.

    The path is a pattern because the file source takes folders or patterns only.
    """
    out, log = scratch(spark, "pool"), scratch(spark, "pool-log")
    schema = _t(spark, d, "lineitem").schema

    def add(batch: DataFrame, epoch: int) -> None:
        key = F.col("l_partkey")
        rows = batch.select(_batch("l_orderkey"), F.lit("part").alias("feature"), F.col("l_orderkey").alias("sample"), key.alias("sign"))
        part = lookup.sum_pooled(lookup.dealt_lookup(rows, _table(spark, d), D), D, double=True).drop("block")
        part.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated epoch replaces itself

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/lineitem.parque[t]").writeStream.foreachBatch(add).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.schema("batch_id long, feature string, sample long, n long, emb array<double>").parquet(f"{out}/epoch=*")
    return _flat(sum_vectors(parts, SAMPLE, "emb", D), "emb", "sample")


_ALL = [
    batch_halves_join, batch_sizes, payload_round_trip, checkpoint_reshard, upsert_last_writer, incremental_changed_signs, packet_upsert, csv_round_trip,
    explode_features, id_dedup_positions, id_counts_per_sample, id_unique_rate, id_approx_distinct, id_dense_index, id_truncate_fixed, hash_stack_buckets, prefix_signs, shard_counts, shard_repartition_sum, unsigned_modulo,
    emb_lookup_left, emb_lookup_half, emb_lookup_distinct, emb_sum_pool, emb_sum_pool_sqrtn, emb_miss_ratio, emb_dim_mismatch, raw_index_padded, raw_mask, raw_distinct_rows, raw_gather, raw_non_empty, feature_concat,
    grad_sum_per_sign, grad_unscale_sqrt, grad_nan_skip, grad_skip_counts, grad_finite_check, raw_grad_index_add, gradient_miss_anti, dense_all_reduce,
    opt_sgd_step, opt_adagrad_step, opt_adagrad_shared_step, opt_adam_step, opt_per_feature_steps, entry_parts, weight_clamp, f16_clamp, lru_evict, train_touch_insert, adam_step_powers,
    batch_slicing, batch_reorder, batch_route, batch_chunks, auc_exact, batch_accuracy, logloss, ordinal_encode, tabular_prepare, pending_batches, stream_pool_available_now,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
