"""Golden values, algebraic properties and streams of the embedding dataflow."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberflow import queries
from emberflow.config import EngineConfig, Hyperparameters, parse_embedding_config, parse_engine_config
from emberflow.functions.optim import SGD, Adagrad, Adam
from emberflow.functions.u64 import farmhash64_np, hash_stack, key_in_range, shard_of, u64_mod, unsigned, unsigned_order
from emberflow.functions.vectors import dealt, half_rounded, widen_half
from emberflow.model import Logistic, LossScale, fit_logistic, scorer
from emberflow.operators import features, grads, lookup, metrics, order, table
from emberflow.plans.session import EmberSession, current
from emberflow.sources import batches, checkpoint
from emberflow.streaming import flows
from tests.oracle import FOLDER, needs_data

BIG = 2**63
SIGNED = lambda x: x - 2**64 if x >= BIG else x


def col(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


# keys ----------------------------------------------------------------------------------


def test_hash_stack_golden(spark):
    df = col(spark, [12, 23, 34, 56, 78, 90]).withColumns({"r": F.lit(2), "n": F.lit(10).cast("long")})
    got = {r.x: r.b for r in df.select("x", hash_stack("x", "r", "n").alias("b")).collect()}
    assert got == {12: [2, 18], 23: [5, 10], 34: [0, 11], 56: [6, 17], 78: [7, 12], 90: [8, 16]}


def test_prefix_golden_and_unsigned_arithmetic(spark):
    prefix = 100 << 52
    df = col(spark, [12, 23, 16000000000000000])
    got = [r.k for r in df.select(key_in_range(F.col("x"), F.lit(prefix), 12).alias("k")).collect()]
    assert got == [450359962737049612, 450359962737049623, 452849163854938115]
    rng = random.Random(1)
    keys = [rng.getrandbits(64) for _ in range(300)] + [0, 1, 2**52 - 1, 2**52 - 2, 2**64 - 1, BIG, BIG - 1]
    for bits in (2, 8, 12, 32):
        space, p = 2 ** (64 - bits) - 1, 1 << (64 - bits)
        df = col(spark, [SIGNED(k) for k in keys])
        got = df.select(key_in_range(F.col("x"), F.lit(SIGNED(p)), bits).alias("k"), u64_mod(F.col("x"), 1_000_003).alias("m"), unsigned(F.col("x")).alias("u"), unsigned_order(F.col("x")).alias("o")).collect()
        assert [r.k % 2**64 for r in got] == [k % space + p for k in keys]
        assert [r.m for r in got] == [k % 1_000_003 for k in keys] and [int(r.u) for r in got] == keys
        assert [k for _, k in sorted((r.o, k) for r, k in zip(got, keys, strict=True))] == sorted(keys)
    assert (np.asarray([u % 7 for u in farmhash64_np(np.arange(50)).tolist()]) == [r.s for r in spark.range(50).select(shard_of(F.col("id"), 7).alias("s")).collect()]).all()


def test_configuration():
    slots = {"a": {"dim": 8}, "b": {"dim": 8, "sqrt_scaling": True}, "c": {"dim": 4, "embedding_summation": False, "sample_fixed_size": 3}}
    config = parse_embedding_config({"slots_config": slots, "feature_groups": {"g": ["b", "c"]}, "feature_index_prefix_bit": 8})
    assert [config.slot(n).index_prefix >> 56 for n in "abc"] == [2, 1, 1]
    for wrong in ({"slots_config": slots, "feature_index_prefix_bit": 0}, {"slots_config": slots, "feature_groups": {"a": ["b"]}}, {"slots_config": {"a": {"dim": 8, "index_prefix": 1}}}, {"slots_config": slots, "feature_index_prefix_bit": 1}):
        with pytest.raises(ValueError):
            parse_embedding_config(wrong)
    with pytest.raises(KeyError):
        config.slot("zzz")
    assert parse_engine_config({"embedding_parameter_server_config": {"capacity": 5}}) == EngineConfig(capacity=5)
    with pytest.raises(ValueError):
        Hyperparameters(admit_probability=1.5)


# batches -------------------------------------------------------------------------------


def test_batch_checks(spark):
    df = spark.createDataFrame([(0, 0, [1, 2], 7, 1.0), (0, 1, [], 8, 0.0)], "batch_id long, sample long, ids array<long>, one long, y double")
    assert batches.make_batches(df, ["ids", "one"], labels=["y"]).count() == 2
    with pytest.raises(ValueError):
        batches.make_batches(df, ["ids"])
    assert batches.make_batches(df, ["ids"], requires_grad=False).columns == ["batch_id", "sample", "ids"]
    with pytest.raises(TypeError):
        batches.make_batches(df, ["y"], labels=["y"])
    with pytest.raises(TypeError):
        batches.check_columns(df.withColumn("s", F.lit("x")), dense=["s"])
    for kind in ("boolean", "byte", "short", "int", "long", "float", "double", "array<float>"):
        batches.check_columns(col(spark, [None], kind), dense=["x"])
    assert [r["size"] for r in batches.check_batch_sizes(df).collect()] == [2]
    with pytest.raises(Exception, match="batch too large"):
        batches.check_batch_sizes(df.union(df)).collect()
    back = batches.from_payload(batches.to_payload(df), "sample long, ids array<long>, one long, y double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert batches.strides([2, 3, 4]) == [12, 4, 1]


def test_csv_and_ordinal_codes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("|header\n 39, Private, >50K\n 20, Gov, <=50K\n")
    df = batches.read_table(spark, str(tmp_path / "t.csv"), "age int, work string, income string", skip_first=True)
    made, codes = batches.prepare_tabular(df, ["work"], ["age"], "income", ">50K")
    assert sorted((r.target, r.continuous_data, r.categorical_data) for r in made.collect()) == [(0.0, [20.0], [0]), (1.0, [39.0], [1])]
    new = df.withColumn("work", F.lit("Never"))
    assert {tuple(r.categorical_data) for r in batches.prepare_tabular(new, ["work"], ["age"], "income", ">50K", codes)[0].collect()} == {(2,)}


# lookup and gradients --------------------------------------------------------------------


def small(spark, seed=0, dim=4):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(20, dim)).astype(np.float32)
    t = spark.createDataFrame([(i, dim, v.tolist(), [], 0) for i, v in enumerate(vectors)], table.TABLE)
    lists = [rng.integers(0, 25, rng.integers(0, 6)).tolist() for _ in range(12)]
    df = spark.createDataFrame([(i // 4, i, x) for i, x in enumerate(lists)], "batch_id long, sample long, f array<long>")
    return t, df, vectors, lists


def test_pooling_equals_numpy(spark):
    t, df, vectors, lists = small(spark)
    rows = features.explode_ids(df, ["f"]).withColumn("sign", F.col("id"))
    zero = np.zeros(4)
    for sqrt in (False, True):
        pooled = lookup.sum_pooled(lookup.lookup(rows, t, 4), 4, features.id_counts(df, ["f"]), sqrt_scaling=sqrt)
        got = {r["sample"]: r.emb for r in pooled.collect()}
        for i, ids in enumerate(lists):
            want = sum((vectors[k] if k < 20 else zero for k in ids), zero) / (math.sqrt(max(len(ids), 1)) if sqrt else 1)
            assert np.allclose(got[i], want, atol=1e-5)
    distinct, index = lookup.raw_pooled(rows, t, 4, 3, counts=features.id_counts(df, ["f"]))
    made = {r["sample"]: r["rows"] for r in lookup.gathered(distinct, lookup.check_index(distinct, index)).collect()}
    for i, ids in enumerate(lists):
        if i in made:
            first = ids[:3]
            assert [r[-1] for r in made[i]] == [1.0] * len(first) + [0.0] * (3 - len(first))
            assert all(np.allclose(r[:4], vectors[k] if k < 20 else zero, atol=1e-6) for r, k in zip(made[i], first))
    with pytest.raises(Exception, match="beyond"):
        lookup.check_index(distinct, index.withColumn("idx", F.array(F.lit(999).cast("long")))).collect()
    half = lookup.sum_pooled(lookup.lookup(rows, t, 4), 4, half=True).first().emb
    assert half == [float(np.float16(x)) for x in half]


def test_gradient_is_the_transpose_of_pooling(spark):
    t, df, vectors, lists = small(spark, 3)
    rows = features.explode_ids(df, ["f"]).withColumn("sign", F.col("id"))
    rng = np.random.default_rng(5)
    g = rng.normal(size=(12, 4))
    gd = spark.createDataFrame([(i // 4, "f", i, x.tolist()) for i, x in enumerate(g)], "batch_id long, feature string, sample long, grad array<double>")
    summed = {r.sign: np.array(r.grad) for r in grads.grads_per_sign(rows, gd, 4).collect()}
    forward = sum(float(g[i] @ vectors[k]) for i, ids in enumerate(lists) for k in ids if k < 20)
    assert math.isclose(forward, sum(float(summed[k] @ vectors[k]) for k in summed if k < 20), rel_tol=1e-5)
    assert {r.sign for r in table.missing_gradients(t, grads.grads_per_sign(rows, gd, 4)).collect()} == {k for x in lists for k in x if k >= 20}


def test_gradient_filters(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, "f", 0, [1.0, nan], False, 2.0), (0, "f", 1, [1.0, 1.0], False, 2.0), (1, "f", 2, [inf, -inf], False, 2.0), (1, "h", 2, [1.0, 1.0], True, 2.0)]
    df = spark.createDataFrame(rows, "batch_id long, feature string, sample long, grad array<double>, skipped boolean, scale double")
    kept = grads.unscaled(grads.usable(df)).collect()
    assert [(r.batch_id, r.grad) for r in kept] == [(1, [32752.0, -32752.0])]
    assert {(r.feature, r.nan_batches, r.skipped_batches) for r in grads.skip_counts(df).collect()} == {("f", 1, 0), ("h", 0, 1)}
    with pytest.raises(Exception, match="reciprocal"):
        grads.unscaled(df.withColumn("scale", F.lit(0.0))).collect()
    h = spark.createDataFrame([([1e6, 1 / 3],)], "v array<float>").select(half_rounded("v").alias("v")).select(widen_half(F.col("v")).alias("v")).first().v
    assert h == [65504.0, float(np.float16(1 / 3))]


def reference_step(opt, w, s, g, n):
    if isinstance(opt, SGD):
        return w - opt.lr * (g + opt.weight_decay * w), s
    if isinstance(opt, Adagrad):
        add = (g * g).mean(keepdims=True) if opt.vectorwise_shared else g * g
        return w - opt.lr * g / np.sqrt(s + opt.eps), s * opt.g_square_momentum + add
    m, v = s[: len(w)], s[len(w) :]
    m, v = opt.beta1 * m + (1 - opt.beta1) * g, opt.beta2 * v + (1 - opt.beta2) * g * g
    return w - opt.lr * (m / (1 - opt.beta1 ** (n + 1))) / (opt.eps + np.sqrt(v / (1 - opt.beta2 ** (n + 1)))), np.concatenate([m, v])


@pytest.mark.parametrize("opt", [SGD(0.1, 0.01), Adagrad(), Adagrad(vectorwise_shared=True, g_square_momentum=0.9), Adam()])
def test_optimizers_over_three_steps(spark, opt):
    rng = np.random.default_rng(2)
    w = rng.uniform(-1, 1, 12)
    t = spark.createDataFrame([(1, 12, w.tolist(), 0)], "sign long, dim int, emb array<float>, last_access long").withColumn("opt", opt.initial_state(12)).select("sign", "dim", "emb", "opt", "last_access")
    s = np.array(t.first().opt, float)
    for n in range(1, 4):
        g = rng.normal(size=12)
        t = spark.createDataFrame(table.apply_gradients(t, spark.createDataFrame([(1, g.tolist()), (2, g.tolist())], "sign long, grad array<double>"), opt, Hyperparameters(weight_bound=0.9), n).collect(), table.TABLE)
        w, s = reference_step(opt, w, s, g, n)
        w = np.clip(w, -0.9, 0.9)
    assert np.allclose(t.first().emb, w, atol=5e-6) and np.allclose(t.first().opt, s, atol=5e-6) and t.count() == 1


# table ---------------------------------------------------------------------------------


def test_lru_capacity(spark):
    def run(sequence, capacity):
        t = spark.createDataFrame([], table.TABLE)
        for at, key in enumerate(sequence):
            t = table.touch(t, col(spark, [key]).withColumnRenamed("x", "sign"), 2, Hyperparameters(), SGD(), at)
            t = spark.createDataFrame(table.evict(t, capacity, F.lit(0)).collect(), table.TABLE)
        return {r.sign for r in t.collect()}

    assert run([0, 2, 0, 1, 5, 2], 3) == {1, 5, 2}


def test_touch_admission_and_start(spark):
    t = spark.createDataFrame([(1, 2, [1.0, 1.0], [], 0), (2, 3, [1.0, 1.0, 1.0], [], 0)], table.TABLE)
    rows = col(spark, [1, 2, 3, 3]).withColumnRenamed("x", "sign")
    opt = Adagrad(initial_accumulator_value=0.5)
    got = {r.sign: r for r in table.touch(t, rows, 2, Hyperparameters(), opt, 9).collect()}
    assert got[1].emb == [1.0, 1.0] and got[1].last_access == 9
    assert got[2].dim == 2 and got[2].opt == [0.5, 0.5] and len(got[3].emb) == 2 and all(abs(x) <= 0.01 for x in got[3].emb)
    assert {r.sign for r in table.touch(t, rows, 2, Hyperparameters(admit_probability=0.0), opt, 9).collect()} == {1, 2}
    many = spark.range(4000).select(F.col("id").alias("sign"))
    n = table.new_rows(many, 2, Hyperparameters(admit_probability=0.25), opt, 0).count()
    assert 850 < n < 1150
    for method, mean, sd in (("normal", 0.5, 2.0), ("uniform", 0.0, 0.01 / 3**0.5), ("gamma", 2.0, 2.0**0.5), ("poisson", 3.0, 3**0.5)):
        args = {"normal": (0.5, 2.0), "uniform": (-0.01, 0.01), "gamma": (2.0, 1.0), "poisson": (3.0, 0.0)}[method]
        v = np.array([r.v for r in many.select(table.initial_vector(F.col("sign"), 4, (method, *args)).alias("v")).collect()])
        assert abs(v.mean() - mean) < 0.05 * max(1, sd) and abs(v.std() / sd - 1) < 0.05, method


def test_checkpoints_generations_packets(spark, tmp_path):
    t, *_ = small(spark)
    path = str(tmp_path / "c")
    checkpoint.save_table(t, path, 3)
    assert checkpoint.checkpoint_info(spark, path)["num_shards"] == 3
    with pytest.raises(FileExistsError):
        checkpoint.save_table(t, path, 3)
    with pytest.raises(FileNotFoundError):
        checkpoint.load_table(spark, str(tmp_path / "none"))
    want = sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, checkpoint.load_table(spark, path).collect())) == want == sorted(map(tuple, checkpoint.load_table(spark, path, 5).collect()))
    assert sum(checkpoint.load_shard(spark, path, s).count() for s in range(3)) == 20
    live = spark.createDataFrame([(99, 4, [0.0] * 4, [], 1), (1, 4, [9.0] * 4, [], 7)], table.TABLE)
    merged = {r.sign: r.emb for r in checkpoint.load_table(spark, path, into=live).collect()}
    assert len(merged) == 21 and merged[1] == [9.0] * 4  # the later access wins
    gens = checkpoint.Generations(spark, str(tmp_path / "g"))
    assert gens.read().count() == 0
    gens.publish(t)
    gens.publish(t.where("sign < 5"))
    gens.publish(t.where("sign < 2"))
    assert gens.numbers() == [1, 2] and gens.read().count() == 2 and gens.read(1).count() == 5
    checkpoint.write_packet(t, col(spark, [3, 3, 777]).withColumnRenamed("x", "sign"), str(tmp_path / "p"), 4)
    server = checkpoint.Generations(spark, str(tmp_path / "s"))
    q = flows.follow_packets(checkpoint.packet_stream(spark, str(tmp_path / "p")), server, str(tmp_path / "sl"))
    assert flows.wait(q, 120) and [r.sign for r in server.read().collect()] == [3]


# order, metrics, model -----------------------------------------------------------------


def test_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(6)
    ks = sorted(r.k for r in df.collect())
    assert [r.n for r in order.numbered(df, "k").orderBy("k").collect()] == list(range(1000))
    cut = order.sliced(df, "k", 64, drop_last=True).collect()
    assert {r.k: (r.batch_id, r["sample"]) for r in cut} == {k: (i // 64, i % 64) for i, k in enumerate(ks[:960])}
    assert sorted(r["count"] for r in order.chunked(df, "k", 7).groupBy("chunk").count().collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert order.routed(df.withColumnRenamed("k", "batch_id"), 4).where("rank <> batch_id % 4").count() == 0


def test_metrics(spark):
    rng = random.Random(1)
    rows = [(i // 10, rng.choice([0.0, 0.1, 0.5, 0.5, 0.9, 1.0]), rng.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "batch_id long, p double, y int")
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.auc(df, "p", "y").first().auc, want)
    acc = np.mean([np.mean([round(p) == y for b, p, y in rows if b == k]) for k in range(20)])
    assert math.isclose(metrics.batch_accuracy(df, "p", "y").first().accuracy, acc)
    ln = lambda x: max(math.log(x), -100) if x > 0 else -100
    loss = np.mean([np.mean([-(y * ln(p) + (1 - y) * ln(1 - p)) for b, p, y in rows if b == k]) for k in range(20)])
    assert math.isclose(metrics.log_loss(df, "p", "y").first().log_loss, loss)


def test_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = (x @ [2, -1, 0.5] > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)
    m = fit_logistic(df, "x", "y", 3, epochs=15, lr=2.0)
    assert metrics.auc(df.select(m.score(F.col("x")).alias("p"), "y"), "p", "y").first().auc > 0.99
    assert Logistic.from_json(m.to_json()) == m
    s = df.select(scorer(lambda a: a.sum(axis=1), ["x"]).alias("s"), "x").first()
    assert math.isclose(s.s, sum(s.x))
    scale = LossScale(64, growth_interval=2)
    assert [scale.update(ok) for ok in (True, True, False)] == [64, 128, 32]


# streams and sessions --------------------------------------------------------------------

SLOTS = {"slots_config": {"a": {"dim": 4, "sqrt_scaling": True}, "b": {"dim": 4}, "r": {"dim": 4, "embedding_summation": False, "sample_fixed_size": 2}}}


def training_rows(spark, n=200):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        rows.append((i // 50, i, [y * 10 + rng.randint(0, 4), rng.randint(20, 30)], rng.randint(0, 9), [1], 1.0, y))
    return spark.createDataFrame(rows, "batch_id long, sample long, a array<long>, b long, r array<long>, d double, y int")


def session(spark, **engine):
    empty = spark.createDataFrame([], table.TABLE)
    return EmberSession(spark, parse_embedding_config(SLOTS), empty, EngineConfig(shards=2, **engine), Hyperparameters(("uniform", -0.1, 0.1)), Adagrad(lr=0.003), Logistic((0.0,) + (1.0,) * 8))


def train_step(s, b):
    x = s.prepare_features(b, ["a", "b"], ["d"], "y")
    g = s.model.input_gradient(F.col("x"), F.col("y"))
    cut = [x.select("batch_id", F.lit(f).alias("feature"), "sample", F.slice(g, 2 + 4 * i, 4).alias("grad")) for i, f in enumerate(("a", "b"))]
    return s.apply_gradients(b, ["a", "b"], cut[0].unionByName(cut[1]))


def test_session_trains_saves_and_serves(spark, tmp_path):
    df = training_rows(spark)
    losses, plans = [], []
    with session(spark) as s:
        s.loss_scale = LossScale(8.0)
        assert current() is s
        b = s.ingest(df, ["a", "b", "r"], ["d"], ["y"])
        for _ in range(3):
            scored = s.infer(b, ["a", "b"], ["d"]).join(df, ["batch_id", "sample"])
            losses.append(metrics.log_loss(scored, "score", "y").first().log_loss)
            train_step(s, b)
            plans.append(len(s.table._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert plans[0] == plans[2]  # a scan, whatever went before
        assert losses[2] < losses[1] < losses[0]
        assert sum(r.signs for r in s.sizes().collect()) == s.table.count() > 20
        distinct, index = s.raw_lookup(b, "r")
        assert index.count() == 200 and distinct.count() == 8
        s.save(str(tmp_path / "m"))
        other = session(spark, job_type="infer")
        other.optimizer = SGD()
        other.load(str(tmp_path / "m"))
        assert (other.optimizer, other.hyper, other.seq, other.loss_scale) == (s.optimizer, s.hyper, 3, LossScale(8.0, good=3))
        assert sorted(map(tuple, other.infer(b, ["a", "b"], ["d"]).collect())) == sorted(map(tuple, s.infer(b, ["a", "b"], ["d"]).collect()))
        payload = batches.to_payload(df.select("batch_id", "sample", "a", "b", "d"))
        answers = other.infer_payloads(payload, "sample long, a array<long>, b long, d double", ["a", "b"], ["d"]).collect()
        assert all(len(r.response.split("\n")) == 50 for r in answers) and len(answers) == 4
        s.clear()
        assert s.table.count() == 0
        with pytest.raises(ValueError):
            session(spark, job_type="bogus")
    with pytest.raises(RuntimeError):
        current()


def test_training_stream_is_repeatable(spark, tmp_path):
    df = training_rows(spark)
    for k in range(3):
        df.where(F.col("batch_id") == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))

    def step(batch, seen, current, epoch):
        assert seen is current
        s = session(spark)
        s.table, s.seq = current, epoch
        signs = train_step(s, batch)
        return s.table, signs

    results = []
    for run in range(2):
        gens = checkpoint.Generations(spark, str(tmp_path / f"g{run}"))
        source = flows.file_source(spark, str(tmp_path / "in" / "*"), df.schema.simpleString()[7:-1].replace(":", " "), 1)
        q = flows.train_stream(source, step, gens, str(tmp_path / f"l{run}"), packets=str(tmp_path / f"p{run}"))
        assert flows.wait(q, 300)
        results.append(sorted((r.sign, tuple(round(x, 5) for x in r.emb)) for r in gens.read().collect()))
    assert results[0] == results[1] and len(results[0]) > 20
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "p0")).count() > 20
    gaps, tables = [], {}
    for k in (1, 2):  # the session's own stream, fresh and one generation behind
        gens = checkpoint.Generations(spark, str(tmp_path / f"s{k}"), keep=4)
        source = flows.file_source(spark, str(tmp_path / "in" / "*"), df.schema.simpleString()[7:-1].replace(":", " "), 1)
        q = session(spark).train_stream(source, ["a", "b"], ["d"], "y", gens, str(tmp_path / f"sl{k}"), staleness=k, gauge=lambda _, v, k=k: gaps.append((k, v)))
        assert flows.wait(q, 300)
        tables[k] = sorted((r.sign, tuple(round(x, 5) for x in r.emb)) for r in gens.read().collect())
    assert tables[1] == results[0]
    assert [s for s, _ in tables[2]] == [s for s, _ in tables[1]] and tables[2] != tables[1]
    assert gaps == [(1, 0.0)] * 3 + [(2, 0.0), (2, 0.0), (2, 1.0)]


def test_loss_scale_leaves_out_steps_that_are_not_finite(spark):
    df = training_rows(spark, 20)
    with session(spark) as s:
        s.loss_scale = LossScale(64.0)
        b = s.ingest(df, ["a", "b", "r"], ["d"], ["y"])
        s.lookup(b, ["a", "b"])
        before = sorted(map(tuple, s.table.collect()))
        g = df.select("batch_id", F.lit("b").alias("feature"), "sample", F.array_repeat(F.lit(float("inf")), 4).alias("grad"), F.lit(64.0).alias("scale"))
        assert s.apply_gradients(b, ["a", "b"], g).count() == 0
        assert s.loss_scale.scale == 16.0 and sorted(map(tuple, s.table.collect())) == before


def test_listener_reports_observed_metrics(spark, tmp_path):
    from emberflow.streaming.listener import MetricsListener

    seen = []
    listener = MetricsListener(lambda name, value, labels: seen.append((name, value)))
    spark.streams.addListener(listener)
    try:
        col(spark, [1, 1, 30]).withColumnRenamed("x", "sign").coalesce(1).write.parquet(str(tmp_path / "in"))
        t, *_ = small(spark)
        found = lookup.lookup(flows.file_source(spark, str(tmp_path / "in"), "sign long"), t, 4)
        q = metrics.observed_lookup(found, "lookup").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "l")).trigger(availableNow=True).start()
        assert flows.wait(q, 120)
        until = time.time() + 20
        while ("misses", 1.0) not in seen and time.time() < until:
            time.sleep(0.2)
        assert {("requests", 3.0), ("misses", 1.0), ("input_rows", 3.0)} <= set(seen)
    finally:
        spark.streams.removeListener(listener)


def test_reorder_and_join_halves(spark, tmp_path):
    ids = [5, 1, 0, 3, 2, 4, 7, 6]
    for n, part in enumerate((ids[:4], ids[4:])):
        spark.createDataFrame([(i, json.dumps(i)) for i in part], "batch_id long, payload string").coalesce(1).write.parquet(str(tmp_path / "r" / f"{n}"))
    source = flows.file_source(spark, str(tmp_path / "r" / "*"), "batch_id long, payload string", 1)
    q = flows.reorder(source, 2).writeStream.format("memory").queryName("reordered").option("checkpointLocation", str(tmp_path / "rl")).start()
    until = time.time() + 120  # processing-time timers keep such a query running
    while spark.table("reordered").count() < 8 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    got = spark.table("reordered").collect()
    assert sorted(r.batch_id for r in got) == list(range(8))
    for rank in (0, 1):
        own = [r.batch_id for r in got if r["rank"] == rank]
        assert own == sorted(own)
    rows = [(i % 2, i, f"2024-01-01 00:00:{i:02d}") for i in range(6)]
    a = spark.createDataFrame(rows, "batcher_idx long, ref_id long, t string").select("batcher_idx", "ref_id", F.to_timestamp("t").alias("sent_at"))
    a.union(a.limit(1)).coalesce(1).write.parquet(str(tmp_path / "a"))
    a.where("ref_id < 4").withColumn("dense", F.col("ref_id") * 2).coalesce(1).write.parquet(str(tmp_path / "b"))
    kind = "batcher_idx long, ref_id long, sent_at timestamp"
    both = flows.join_halves(flows.file_source(spark, str(tmp_path / "a"), kind), flows.file_source(spark, str(tmp_path / "b"), kind + ", dense long"))
    q = both.writeStream.format("memory").queryName("halves").option("checkpointLocation", str(tmp_path / "hl")).trigger(availableNow=True).start()
    assert flows.wait(q, 120)
    assert sorted((r.ref_id, r.dense) for r in spark.table("halves").collect()) == [(i, 2 * i) for i in range(4)]


@needs_data
@pytest.mark.parametrize("name", ["emb_sum_pool_sqrtn", "feature_concat", "id_dense_index"])
def test_only_ids_are_exchanged(spark, name):
    """Ids are dealt once, by number of rows; no exchange follows that would carry vectors."""
    plan = queries.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_a_large_table_sends_a_vector_once_to_a_block(spark, monkeypatch):
    """What is not broadcast goes to blocks of ids, once for each key: the same as a left join, with missing, wide and repeated keys."""
    rows = [(b, f, b * 8 + s, (b * 31 + s * 7 + k) % 12 if (s + k) % 5 else None) for b in range(40) for f in ("x", "y") for s in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, "batch_id long, feature string, sample long, sign long")
    t = spark.createDataFrame([(i, [float(i), 1.0] if i != 4 else [1.0]) for i in range(9)] + [(3, [0.5, 0.5])], "sign long, emb array<float>")
    keys = ["batch_id", "feature", "sample", "sign"]
    wanted = lookup.lookup(df, t, 2).select(*keys, "emb")
    sums = lambda x: {(r.batch_id, r.feature, r.sample): (r.n, r.emb) for r in lookup.sum_pooled(x, 2, double=True).collect()}
    monkeypatch.setattr(lookup, "BROADCAST_VECTORS", 0)
    monkeypatch.setattr(lookup, "BLOCK_IDS", 300)
    found = lookup.dealt_lookup(df, t, 2)
    assert sorted(map(str, found.select(*keys, "emb").collect())) == sorted(map(str, wanted.collect()))
    assert 3 < found.select("block").distinct().count() < 20 and found.groupBy("batch_id").agg(F.count_distinct("block").alias("n")).where("n > 1").isEmpty()
    assert sums(found) == sums(wanted)
    wide = lookup.concat_features(lookup.sum_pooled(found, 2, double=True), ["x", "y"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("REPARTITION_BY_NUM")]  # vectors are looked up, summed and set side by side without another exchange
    assert "ENSURE_REQUIREMENTS" not in above and "Window" in above
    assert sorted(map(str, wide.collect())) == sorted(map(str, lookup.concat_features(lookup.sum_pooled(wanted, 2, double=True), ["x", "y"]).collect()))


def test_more_rows_make_more_tasks(spark):
    assert dealt(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10


def test_raw_rows_are_not_summed_without_rounds(spark):
    rows = spark.createDataFrame([(0, "f", 1, 0, 5, 50), (0, "f", 1, 1, 6, 60), (0, "f", 2, 0, 5, 50)], "batch_id long, feature string, sample long, col int, id long, sign long")
    t = spark.createDataFrame([(50, [1.0, None]), (60, [3.0, 4.0])], "sign long, emb array<float>")
    distinct, index = lookup.raw_pooled(rows, t, 2, 3)
    assert "sum(" not in distinct._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.distinct_idx, r.emb) for r in distinct.collect()) == [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0])]
    got = {r.sample: r.rows for r in lookup.gathered(distinct, index).collect()}
    assert got == {1: [[1.0, 0.0, 1.0], [3.0, 4.0, 1.0], [0.0] * 3], 2: [[1.0, 0.0, 1.0], [0.0] * 3, [0.0] * 3]}
    with pytest.raises(Exception, match="several signs"):
        lookup.raw_pooled(rows.withColumn("sign", F.col("sample")), t, 2, 3)[0].collect()


def test_gradients_for_keys_of_the_table_only(spark):
    rows = spark.createDataFrame([(0, "f", 1, 7), (0, "f", 1, 8), (0, "f", 2, 7)], "batch_id long, feature string, sample long, sign long")
    g = spark.createDataFrame([(0, "f", 1, [1.0]), (0, "f", 2, [2.0])], "batch_id long, feature string, sample long, grad array<double>")
    t = spark.createDataFrame([(7,), (9,)], "sign long")
    assert [(r.sign, r.grad) for r in grads.grads_per_sign(rows, g, 1, table=t).collect()] == [(7, [3.0])]


def test_four_places(spark):
    x = [0.00005, -0.00005, 1.00015, -2.5, 0.0, -1e-9, 1e12 + 0.12345, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    for r in df.select("x", queries._four_places(F.col("x")).alias("a"), F.round("x", 4).alias("b")).collect():
        assert repr(r.a) == repr(r.b), r
