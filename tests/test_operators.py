"""Operators with hand-computed values, files, the stream and fitted models."""

import hashlib
import hmac
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import clinical, geometry, identity, labels
from marlstone.functions.draws import hash_rank, running_sums
from marlstone.operators import bags, contracts, dealing, gates, manifest, metrics, models, monitors, overlap, resampling, review, splits
from marlstone.sources import files, pixels


def values(spark, cells, column, kind="string"):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], f"k int, c {kind}")
    return [r[1] for r in df.select("k", column(F.col("c")).alias("v")).orderBy("k").collect()]


def test_labels(spark):
    raw = ["N骨皮质", "OA骨皮质", "RA骨皮质", "GA骨皮质", "SPA-骨皮质", "损伤-积液", "滑膜囊肿-腘窝囊肿", "SPA-斌下肾囊炎", "GA股二头肌建", "内测半月板", "损伤-髌骨前浅筋膜", None, ""]
    want = ["骨皮质"] * 5 + ["积液", "腘窝囊肿", "髌下深囊炎", "股二头肌腱", "内侧半月板", "髌前浅筋膜", None, ""]
    assert values(spark, raw, labels.fixed) == want
    assert values(spark, want, labels.fixed) == want
    assert values(spark, ["N骨", "骨", None], labels.disease) == ["正常", None, None]


def test_clinical_cells(spark):
    got = values(spark, ["10", "<5", "> 20.5", "31岁", "/", "阳性", None, "≥3", "1e5"], clinical.numeric)
    assert [(r.value, r.censor, r.invalid) for r in got] == [(10, 0, None), (5, -1, None), (20.5, 1, None), (31, 0, None), (None, 0, None), (None, 0, "阳性"), (None, 0, None), (3, 1, None), (None, 0, "1e5")]
    assert values(spark, ["男", "F", "x", None], clinical.sex) == [1.0, 0.0, None, None]


def test_identity(spark):
    assert values(spark, ["C:\\source\\x\\外伤\\901196782_某患者", "a/b//", " / ", None], identity.identity_token) == ["901196782_某患者", "b", None, None]
    got = values(spark, [" Ab "], lambda c: identity.pseudonym(c, b"key", "P"))
    assert got == ["P_" + hmac.new(b"key", b"ab", hashlib.sha256).hexdigest()[:16].upper()]
    assert values(spark, [["901195048_某患者", "RA186"], ["RA186"], ["a", "b"]], lambda c: identity.resolve_identity(c, F.lit("ra186")), "array<string>") == ["901195048_某患者", "RA186", None]


def test_geometry(spark):
    square, line = [[10.0, 10.0], [30.0, 10.0], [30.0, 30.0], [10.0, 30.0]], [[0.0, 0.0], [1.0, 1.0]]
    assert values(spark, [square, line], geometry.area, "array<array<double>>") == [400.0, 0.0]
    rows = [(10.0, 5.0, 90.0, 70.0), (90.0, 5.0, 10.0, 70.0), (10.0, 5.0, 101.0, 70.0), (float("nan"), 5.0, 90.0, 70.0), (None, 5.0, 90.0, 70.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r[0] for r in df.select(geometry.roi_valid(*(F.col(c) for c in "abcd"), F.lit(100), F.lit(80))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([(square, 15.0, 0.0, 25.0, 50.0), (square, 40.0, 40.0, 50.0, 50.0)], "p array<array<double>>, a double, b double, c double, d double")
    assert [r[0] for r in overlap.clipped(df, "p", "a", "b", "c", "d").select(geometry.area(F.col("p"))).collect()] == [200.0, 0.0]


def test_masks_overlap_and_matches(spark):
    def polygon(x, y, w, h):
        return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]

    triangle = [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]
    df = spark.createDataFrame([(1, 1, polygon(10, 10, 20, 20)), (1, 2, polygon(20, 20, 20, 20)), (1, 3, triangle)], "image_id int, object_id int, polygon array<array<double>>")
    spans = overlap.polygon_spans(df)
    sizes = {r.object_id: r.n for r in spans.groupBy("object_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()}
    assert sizes[1] == sizes[2] == 400 and abs(sizes[3] - 50) <= 5
    got = overlap.dice(spans.where("object_id = 1"), spans.where("object_id = 2"), ["image_id"]).first()
    assert got.dice == pytest.approx(0.25, abs=1e-6) and got.iou == pytest.approx(100 / 700, abs=1e-6)
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.1), (1, 3, 2, 0.5)], "image_id int, pred_id int, gt_id int, iou double")
    assert {(r.pred_id, r.gt_id) for r in overlap.greedy_matches(pairs).collect()} == {(1, 1), (3, 2)}


def test_ranks_and_sums_do_not_depend_on_partitions(spark):
    rows = [(k % 3, f"k{k}", k // 2) for k in range(200)]
    for n in (1, 7):
        df = spark.createDataFrame(rows, "g int, k string, v int").repartition(n)
        ranked = hash_rank(df.withColumn("h", F.sha2("k", 256)), ["g"], "h", "r", digits=1)
        want = {k: 1 + sum(hashlib.sha256(o.encode()).hexdigest() < hashlib.sha256(k.encode()).hexdigest() for h, o, _ in rows if h == g) for g, k, _ in rows}
        assert {r.k: r.r for r in ranked.collect()} == want
        totals = df.groupBy("v").agg(F.count("*").alias("n"))
        assert {r.v: r.before_n for r in running_sums(totals, [], "v", F.floor(F.col("v") / 10), ["n"]).collect()} == {v: 2 * v for v in range(100)}


def test_folds_are_spread_and_leak_nothing(spark):
    people = spark.createDataFrame([(f"p{k}", "abc"[k % 3], k % 3) for k in range(45)], "person_key string, diagnosis string, diagnosis_id int")
    folds = splits.outer_folds(people, 5)
    assert all(r.spread == 0 for r in splits.fold_audit(folds, 5).collect())
    inner = splits.inner_splits(folds, 5)
    assert inner.count() == 225
    own = inner.join(folds.select("person_key", F.col("outer_fold").alias("own")), "person_key")
    assert own.where("(outer_fold = own) != (split = 'test')").count() == 0 and own.where("split = 'validation'").count() > 0


def test_perfect_predictions(spark):
    rows = [(f"p{k}", k % 5, k % 3, [1.0 if j == k % 3 else 0.0 for j in range(3)]) for k in range(30)]
    df = spark.createDataFrame(rows, "person_key string, outer_fold int, reference_id int, probs array<double>")
    got = {r.metric: r.value for r in metrics.evaluate(df, 3).collect()}
    assert got == {"accuracy": 1, "balanced_accuracy": 1, "macro_f1": 1, "weighted_f1": 1, "patients": 30, "top2_accuracy": 1, "multiclass_brier": 0, "ece": 0, "macro_auc": 1}
    assert tuple(resampling.bootstrap_macro_f1(df, 3, 5, 1).first()) == (1.0, 1.0, 5, 1.0)


def plain_auc(scores, positive, weights):
    at = sorted(range(len(scores)), key=lambda k: scores[k])
    won = sum(weights[i] * weights[j] * (1 if scores[i] > scores[j] else 0.5 if scores[i] == scores[j] else 0) for i in at if positive[i] for j in at if not positive[j])
    both = sum(w for w, p in zip(weights, positive, strict=True) if p) * sum(w for w, p in zip(weights, positive, strict=True) if not p)
    return won / both if both else None


@pytest.mark.parametrize("piece", [2048, 7])
def test_bootstrap_weights_and_weighted_auc(spark, monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(dealing, "PIECE", piece)
    rng = np.random.default_rng(4)
    # a third of all rows share one score
    rows = [(f"p{k}", int(k % 3), [float(x) for x in rng.dirichlet(np.ones(3)).round(2)] if k % 3 else [0.25, 0.5, 0.25]) for k in range(60)]
    df = spark.createDataFrame(rows, "person_key string, reference_id int, probs array<double>")
    own = resampling.with_weights(df, ["reference_id"], "person_key", 40, 3)
    got = {r.person_key: np.frombuffer(r.weights, dtype="<u2").astype(int) for r in own.collect()}
    again = {r.person_key: np.frombuffer(r.weights, dtype="<u2").astype(int) for r in resampling.with_weights(df.repartition(5), ["reference_id"], "person_key", 40, 3).collect()}
    assert len(got) == 60 and all((got[k] == again[k]).all() for k in got)
    for c in range(3):
        drawn = np.stack([got[k] for k, r, _ in rows if r == c])
        assert (drawn.sum(0) == 20).all() and 0.5 < drawn.var() < 1.5
    values = {r.replicate: r.value for r in resampling.weighted_macro_auc(own).collect()}
    assert len(values) == 40
    for r in range(0, 40, 7):
        weights = [int(got[k][r]) for k, _, _ in rows]
        want = np.mean([plain_auc([x[c] for _, _, x in rows], [y == c for _, y, _ in rows], weights) for c in range(3)])
        assert abs(values[r] - want) < 1e-12
    means = {r.replicate: r.value for r in resampling.weighted_mean(own, "reference_id").collect()}
    assert all(abs(v - 1) < 1e-12 for v in means.values())
    low, high, n, observed = resampling.bootstrap_macro_auc(df, 3, 40, 3).first()
    assert n == 40 and low <= high and abs(observed - np.mean([plain_auc([x[c] for _, _, x in rows], [y == c for _, y, _ in rows], [1] * 60) for c in range(3)])) < 1e-12
    assert resampling.with_weights(df.limit(0), ["reference_id"], "person_key", 40, 3).count() == 0


def test_several_predictions_share_one_draw_and_move_it_once(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{k}", k % 3, name, rng.random(3).tolist()) for k in range(60) for name in ("x", "y")]
    df = spark.createDataFrame(rows, "person_key string, reference_id int, feature_set string, probs array<double>")
    got = {r.feature_set: r for r in resampling.bootstrap_macro_auc(df, 3, 40, 3, ["feature_set"]).collect()}
    for name in ("x", "y"):
        one = resampling.bootstrap_macro_auc(df.where(F.col("feature_set") == name), 3, 40, 3).first()
        assert [got[name][c] for c in ("low", "high", "replicates", "observed")] == pytest.approx([one[c] for c in ("low", "high", "replicates", "observed")])
    own = resampling.with_draws(df.where("feature_set = 'x'"), ["reference_id"], "person_key", 40, 3)
    plan = resampling.weighted_macro_auc(own)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[plan.index("FlatMapGroupsInPandas") :]  # rows with weights aren't joined


def test_thresholds_and_gates(spark):
    df = spark.createDataFrame(list(zip([False, False, False, True, True, True], [0.1, 0.2, 0.6, 0.7, 0.8, 0.9], strict=True)), "positive boolean, score double")
    assert tuple(gates.thresholds(df, 0.9).first()) == (0.7, 1.0, 1.0, True)
    own = spark.createDataFrame([(False, 0.1, False), (False, 0.2, False), (True, 0.8, True), (True, 0.9, True)], "positive boolean, score double, predicted boolean")
    got = {r.metric: r.value for r in metrics.gate_metrics(own).collect()}
    assert got["roc_auc"] == got["pr_auc"] == got["macro_f1"] == 1
    weak = spark.createDataFrame([(k % 2 == 1, 0.6 if k % 2 else 0.4) for k in range(20)], "positive boolean, score double")
    assert gates.refined_temperature(weak).first().temperature < 0.2
    assert tuple(gates.gate_table(spark.createDataFrame([("a", 1.0)], "metric string, value double"), [("a", ">=", 0.5), ("b", "<=", 1.0)]).orderBy("gate").select("passed").toPandas()["passed"]) == (True, False)


def test_adjusted_p_values_and_shifts(spark):
    q = resampling.benjamini_hochberg(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")).orderBy("k").collect()
    assert [round(r.q, 9) for r in q] == [0.03, 0.04, 0.04]
    rows = [("x", f, 5.0 if f == 2 else (k % 2) * 1.0) for f in range(5) for k in range(20)]
    shifts = resampling.fold_shifts(spark.createDataFrame(rows, "feature string, outer_fold int, value double"), list(range(5)))
    got = resampling.benjamini_hochberg(shifts).where("fold = 2").first()
    assert got.ks == 1.0 and got.abs_smd > 3 and got.q < 0.05
    same = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 3.5, 0.25)], "a double, b double, c double, d double")
    assert [r[0] for r in same.select(resampling.smd(*(F.col(c) for c in "abcd"))).collect()] == [0.0, pytest.approx(3.5 / math.sqrt(0.125))]


def test_attention_audit(spark):
    rows = [("a", "i1", 0, 0.96), ("a", "i2", 0, 0.04), ("b", "i3", 0, 1.0), ("c", "i4", 1, 0.6), ("c", "i5", 1, 0.4)]
    df = spark.createDataFrame(rows, "person_key string, image_key string, outer_fold int, attention_weight double")
    got = bags.attention_audit(df).first()
    assert (got.people, got.multi, got.collapse_rate, got.passed) == (3, 2, 0.5, True)
    bad = spark.createDataFrame([("a", "i1", 0, 0.7, 2), ("a", "i2", 0, 0.2, 2)], "person_key string, image_key string, outer_fold int, attention_weight double, image_count int")
    assert {r.rule: r.n_violations for r in bags.attention_violations(bad).collect()} == {"weight_sum": 1, "count": 0, "one_fold": 0}
    with pytest.raises(contracts.ContractError):
        contracts.enforce(bags.attention_violations(bad))


def test_agreement_and_queue(spark):
    pairs = spark.createDataFrame([("present", "present"), ("absent_visible", "absent_visible"), ("present", "absent_visible"), ("uncertain", "uncertain")], "reviewer_1 string, reviewer_2 string")
    got = review.agreement(pairs).first()
    assert (got.raw_agreement, got.comparable) == (0.75, 3) and got.positive_agreement == pytest.approx(2 / 3) and got.negative_agreement == pytest.approx(2 / 3)
    rows = [(f"i{f}{c}{k}", f"p{f}{c}{k}", c, f) for f in range(5) for c in "xy" for k in range(4)]
    images = spark.createDataFrame(rows, "image_key string, person_key string, diagnosis string, outer_fold int")
    positives = spark.createDataFrame([(r[0], "t") for r in rows if r[0][-1] in "01"], "image_key string, target string")
    queue = review.build_queue(images, positives, ["t"], 3, 2)
    assert queue.count() == queue.select("image_key").distinct().count() == 20
    assert all(r.n == 1 for r in queue.groupBy("bucket", "outer_fold", "diagnosis").agg(F.count("*").alias("n")).collect())
    assert review.shortages(queue, ["t"], 5, 2).count() == 0 and review.shortages(queue, ["t"], 5, 3).count() == 10


def test_stream_is_the_batch(spark, tmp_path):
    from marlstone.streaming.pressure import sustained_stream

    rows = [(r, float(t * 100), 60.0 if (t // 7 + ord(r)) % 3 else 10.0) for r in "ab" for t in range(60)]
    schema = "run string, at double, value double"
    for k in range(3):
        spark.createDataFrame([x for x in rows if k * 2000 <= x[1] < (k + 1) * 2000], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sustained_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 50.0, 300.0)
    query = stream.writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.run, r.at): r.fired for r in spark.table("fired").collect()}
    want = {(r.run, r.at): r.fired for r in monitors.sustained(spark.createDataFrame(rows, schema), 50.0, 300.0).collect()}
    assert got == want and any(want.values())


def test_late_samples_restarts_and_silence_on_a_stream(spark, tmp_path):
    from marlstone.streaming import watermarked

    draw = np.random.default_rng(6)
    rows = [(r, t, 1000.0 + t * 10, None if t % 37 == 0 else 60.0 if (t // 9 + ord(r)) % 3 else 10.0) for r in "abc" for t in range(120)]
    schema = "run string, id long, at double, value double"
    plain = spark.createDataFrame(rows, schema)
    timed = plain.select("run", "id", F.timestamp_seconds("at").alias("ts"), "value")
    want = {(r.run, r.id): r.fired for r in monitors.sustained(plain, 50.0, 60.0, order=["id"]).collect()}
    got = {(r.run, r.id): r.fired for r in watermarked.drained(timed, 50.0, 60.0).collect()}
    assert got == want and any(want.values())
    # late by less than the delay, in an order of their own, and stopped and started again half way
    late = [rows[k] for k in np.argsort([at + draw.random() * 90 for _, _, at, _ in rows])]
    folder, source = str(tmp_path / "run"), str(tmp_path / "run" / "samples")

    def more(part):
        spark.createDataFrame(part, schema).select("run", "id", F.timestamp_seconds("at").alias("ts"), "value").coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(source)
        watermarked.finished(watermarked.sustained_by_watermark(stream, 50.0, 60.0, 100.0, idle=500.0), folder)
        return {(r.run, r.id): r.fired for r in spark.read.parquet(f"{folder}/fired").collect() if r.id is not None}

    for k in range(0, 180, 60):
        more(late[k : k + 60])
    half = go()
    assert 0 < len(half) < 180 and half.items() <= want.items()
    for k in range(180, 360, 60):
        more(late[k : k + 60])
    more([(r, None, 4000.0, None) for r in "abc"])
    assert go() == want
    # samples after everything has passed are dropped; a run that was silent for long starts anew
    more([("a", 900, 1005.0, 99.0), ("a", 901, 9000.0, 99.0)])
    more([("b", 902, 20_000.0, None), ("a", 903, 20_000.0, 99.0)])
    more([("b", 904, 30_000.0, None)])
    after = go()
    assert ("a", 900) not in after and after["a", 901] is False and after["a", 903] is False


@pytest.mark.parametrize("width", [86400, 250])
def test_sustained_over_spans(spark, width):
    """Runs that stay high over several spans, end at a span's edge or have null values, against a loop."""
    rng = np.random.default_rng(8)
    rows = [(r, float(t * 50), k, None if rng.random() < 0.02 else 60.0 if rng.random() < high else 10.0) for r, high in (("a", 0.97), ("b", 0.8), ("c", 1.0)) for k, t in enumerate(sorted(rng.integers(0, 60, 60).tolist()))]
    want = {}
    for run in "abc":
        since = None
        for _, at, k, v in sorted((x for x in rows if x[0] == run), key=lambda x: (x[1], x[2])):
            high = v is not None and v > 50
            want[run, k] = high and since is not None and at - since >= 300
            since = (at if since is None else since) if high else None
    df = spark.createDataFrame(rows, "run string, at double, k int, value double").repartition(3)
    got = {(r.run, r.k): r.fired for r in monitors.sustained(df, 50.0, 300.0, order=["k"], width=width).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_boxes_meet_across_cells(spark):
    """Boxes smaller and larger than a grid cell, touching, negative and empty ones, against all pairs."""
    rng = np.random.default_rng(6)
    boxes = [(k % 2, k, "c", *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(rng.integers([-300, -300, 0, 0], [900, 900, 700, 300], (60, 4)).tolist())]
    boxes += [(0, 100, "c", 0.0, 0.0, 256.0, 256.0), (0, 101, "c", 256.0, 0.0, 512.0, 256.0), (1, 102, "c", 50.0, 50.0, 10.0, 90.0), (1, 103, "c", None, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(boxes, "image_id int, object_id int, category string, bx1 double, by1 double, bx2 double, by2 double")
    side = lambda a, b, k: min(a[k + 2], b[k + 2]) - max(a[k], b[k])
    kept = [b for b in boxes if b[3] is not None]
    want = sorted((a[1], b[1]) for a in kept for b in kept if a[0] == b[0] and a[1] < b[1] and min(side(a, b, 3), side(a, b, 4)) > 0)
    assert sorted((r.left_object_id, r.right_object_id) for r in overlap.overlapping_boxes(df).collect()) == want and len(want) > 50
    assert overlap.box_iou(df, df).where("pred_id < gt_id").count() == len(want)


def test_early_stopping(spark):
    df = spark.createDataFrame([("r", k, s) for k, s in enumerate([0.1, 0.5, 0.4, 0.5, 0.6, 0.1, 0.2])], "run string, epoch int, score double")
    rows = monitors.early_stopping(df, 2).orderBy("epoch").collect()
    assert [r.stale for r in rows] == [0, 0, 1, 2, 0, 1, 2] and [r.stop for r in rows] == [False, False, False, True, False, False, True]
    assert [r.stale for r in monitors.early_stopping_gain(df, 2, 0.0).orderBy("epoch").collect()] == [0, 0, 1, 2, 0, 1, 2]


def test_files(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a/Mask").mkdir(parents=True)
    for name, data in (("a/x.PNG", b"1"), ("a/Mask/m.jpg", b"2"), ("a/~$l.xlsx", b"3"), ("a/n.json", b"{}")):
        (root / name).write_bytes(data)
    prints = files.fingerprints(files.read_tree(spark, str(root)), "c")
    got = {r.path: (r.kind, r.size_bytes, r.sha256) for r in prints.collect()}
    assert got == {p: (k, len(b), hashlib.sha256(b).hexdigest()) for p, k, b in (("a/x.PNG", "image", b"1"), ("a/Mask/m.jpg", "annotation_mask", b"2"), ("a/n.json", "annotation", b"{}"))}
    digest = hashlib.sha256(b"".join(p.encode() + b"\0" + h.encode() + b"\n" for p, (_, _, h) in sorted(got.items()))).hexdigest()
    assert files.dataset_version(prints).first().version == digest
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "bom.csv").write_bytes("\ufeffk,v\na,1.5\n".encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "bom.csv"), schema).collect()] == [("a", 1.5)]
    (tmp_path / "bad.csv").write_text("v,k\n1.5,a\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()
    files.publish(spark.range(3), str(tmp_path / "v1"))
    assert files.read_published(spark, str(tmp_path / "v1")).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        files.publish(spark.range(3), str(tmp_path / "v1"))


def png(image):
    h, w, _ = image.shape
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in image))) + chunk(b"IEND", b"")


def test_pixels(spark, tmp_path):
    image = np.zeros((20, 30, 3), dtype=np.uint8)
    image[:, :, 0] = 255
    image[4:16, 6:24] = (0, 0, 0)
    (tmp_path / "x.png").write_bytes(png(image))
    own = pixels.read_images(spark, str(tmp_path))
    boxed = own.select("*", F.lit(6).alias("left"), F.lit(4).alias("top"), F.lit(24).alias("right"), F.lit(16).alias("bottom"))
    got = pixels.strip_statistics(boxed).first()
    assert (got.full_border_red_mean, got.outside_roi_red_mean, got.roi_border_red_mean, got.roi_border_black_share) == (1.0, 1.0, 0.0, 1.0) and got.full_border_blue_mean == 0
    assert pixels.geometry_features(boxed).first().roi_area_fraction == 216 / 600
    assert tuple(pixels.border_fill(own).first()) == (255, 0, 0)


def test_strip_statistics_are_those_of_all_pixels_of_small_strips(spark, tmp_path):
    rng = np.random.default_rng(2)
    boxes = {"a": (5, 3, 17, 12), "b": (0, 0, 30, 20), "c": (1, 1, 2, 2)}
    images = {name: rng.integers(0, 256, (20, 30, 3), dtype=np.uint8) for name in boxes}
    for name, image in images.items():
        (tmp_path / f"{name}.png").write_bytes(png(image))
    name = F.regexp_extract("path", r"(\w)\.png$", 1)
    side = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, b in boxes.items() for x in (n, b[k]))), name)
    own = pixels.read_images(spark, str(tmp_path)).select("*", side(0).alias("left"), side(1).alias("top"), side(2).alias("right"), side(3).alias("bottom"))
    for r in pixels.strip_statistics(own).collect():
        image, (x0, y0, x1, y1) = images[r.path[-5]], boxes[r.path[-5]]
        outside = np.ones((20, 30), dtype=bool)
        outside[y0:y1, x0:x1] = False
        v = (image[outside] if outside.any() else np.zeros((1, 3))).astype(float)
        light = v @ [0.2126, 0.7152, 0.0722] / 255
        want = [v[:, 0].mean() / 255, v[:, 2].std() / 255, light.mean(), light.std(), (v.max(1) < 16).mean(), ((v.max(1) - v.min(1) > 64) & (v.max(1) > 128)).mean()]
        got = [r.outside_roi_red_mean, r.outside_roi_blue_std, r.outside_roi_luminance_mean, r.outside_roi_luminance_std, r.outside_roi_black_share, r.outside_roi_vivid_share]
        assert np.allclose(got, want)
    assert pixels.ring((0, 0, 1, 9), pixels.shrunk((0, 0, 1, 9), 1)) == [(0, 0, 1, 9), (0, 0, 1, 9)]
    big = np.arange(10_000).reshape(100, 100)
    assert pixels.spaced(big, [(0, 0, 50, 100), (50, 0, 100, 100)], 5).tolist() == [0, 2499, 4999, 7499, 9999]


def test_cells_are_resampled_within_their_stratum(spark):
    cells = spark.createDataFrame([("x", 1, 30), ("x", 2, 10), ("x", 3, 0), ("y", 4, 7)], "stratum string, cell int, n long")
    rows = resampling.resampled_cells(cells, "stratum", 2000, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.replicate, {})[r.cell] = r.n
    assert len(by) == 2000 and all(x.get(1, 0) + x.get(2, 0) == 40 and x[4] == 7 and 3 not in x for x in by.values())
    ones = np.array([x.get(1, 0) for x in by.values()])
    assert abs(ones.mean() - 30) < 0.3 and abs(ones.std() - np.sqrt(40 * 0.75 * 0.25)) < 0.15
    again = {(r.replicate, r.cell): r.n for r in resampling.resampled_cells(cells.repartition(3), "stratum", 2000, 1).collect()}
    assert again == {(r.replicate, r.cell): r.n for r in rows}


def test_fitted_models_find_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{k}", k % 2, k // 2 % 5, float(k % 2 * 2 + rng.normal()) if k % 17 else None, float(rng.normal()), 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "person_key string, diagnosis_id int, outer_fold int, signal double, noise double, constant double")
    auc = lambda out: metrics.macro_auc(out.withColumnRenamed("diagnosis_id", "reference_id"), 2).first().value
    found = models.logistic_oof(df, ["signal", "constant"], 2)
    assert found.count() == 200 and auc(found) > 0.8 and abs(auc(models.logistic_oof(df, ["noise"], 2)) - 0.5) < 0.15
    with pytest.raises(ValueError):
        models.logistic_oof(df.where("diagnosis_id = 0"), ["signal"], 2)


def test_rings_that_touch_or_cross_themselves(spark):
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    cases = {
        "square": (square, "simple", 16.0), "closed": ([*square, square[0], square[0]], "simple", 16.0), "midpoint": ([[0.0, 0.0], [2.0, 0.0], *square[1:]], "simple", 16.0),
        "bow": ([square[0], square[2], square[1], square[3]], "crossing", 8.0), "eight": ([square[0], square[1], [2.0, 2.0], square[3], square[2], [2.0, 2.0]], "touching", 8.0),
        "same way": ([square[0], square[1], [2.0, 2.0], square[2], square[3], [2.0, 2.0]], "touching", 8.0), "spike": ([*square[:2], [9.0, -3.0], *square[1:]], "touching", 16.0),
        "vertex on an edge": ([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 0.0], [0.0, 4.0]], "touching", 8.0), "notch": ([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]], "simple", 10.0),
        "line": ([[0.0, 0.0], [4.0, 4.0], [2.0, 2.0]], "touching", 0.0), "triangle": ([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]], "simple", 8.0), "two": (square[:2], None, 0.0), "one point": ([[1.0, 1.0]] * 4, None, 0.0), "none": ([], None, 0.0),
    }
    df = spark.createDataFrame([(k, p) for k, (p, _, _) in cases.items()] + [("null", None)], "k string, p array<array<double>>")
    found = {r.k: (r.kind, r.valid, r.area) for r in df.select("k", geometry.ring_kind(F.col("p")).alias("kind"), geometry.originally_valid(F.col("p")).alias("valid"), geometry.repaired_area(F.col("p")).alias("area")).collect()}
    for k, (_, kind, size) in cases.items():
        assert found[k][:2] == (kind, kind == "simple"), k
        assert kind is None or found[k][2] == pytest.approx(size), k
    assert found["null"][0] is None


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_matches_of_any_chain(spark, monkeypatch, few):
    monkeypatch.setattr(overlap, "FEW_PAIRS", few)
    # each pair is better than the one before, so the order is forced from the end
    rows = [(1, k // 2, (k + 1) // 2, 0.1 + k / 1000) for k in range(104)] + [(2, p, g, 0.5) for p in range(3) for g in range(4)] + [(3, 1, 1, 0.4), (3, 1, 2, 0.6), (3, 2, 2, 0.5)]
    draw = np.random.default_rng(5)
    rows += [(image, int(p), int(g), float(draw.integers(1, 20)) / 20) for image in range(4, 9) for p in range(12) for g in draw.permutation(15)[:7]]
    got = {(r.image_id, r.pred_id, r.gt_id) for r in overlap.greedy_matches(spark.createDataFrame(rows, "image_id int, pred_id int, gt_id int, iou double").repartition(3)).collect()}
    want, taken = set(), set()
    for i, p, g, _ in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if not {(i, "p", p), (i, "g", g)} & taken:
            taken |= {(i, "p", p), (i, "g", g)}
            want.add((i, p, g))
    assert got == want and sum(i == 1 for i, *_ in got) == 52
    assert overlap.greedy_matches(spark.createDataFrame([], "image_id int, pred_id int, gt_id int, iou double")).count() == 0


def test_common_area_of_concave_and_crossing_polygons(spark):

    square, u, bar, tie = [[0, 0], [4, 0], [4, 4], [0, 4]], [[0, 0], [6, 0], [6, 5], [4, 5], [4, 2], [2, 2], [2, 5], [0, 5]], [[-1, 3], [7, 3], [7, 4], [-1, 4]], [[0, 0], [4, 4], [4, 0], [0, 4]]
    cases = [(square, u, 12.0), (u, bar, 4.0), (tie, tie, 8.0), (tie, square, 8.0), (square, [[4, 0], [8, 0], [8, 4]], 0.0), (square, [[2, 2], [6, 2], [2, 6]], 4.0), (square, [[1, 1], [2, 2]], 0.0), (tie, bar, 1.0), ([], square, 0.0)]
    rows = [(k, [[float(v) for v in q] for q in a], [[float(v) for v in q] for q in b]) for k, (a, b, _) in enumerate(cases)]
    df = spark.createDataFrame([*rows, (99, None, rows[0][2])], "k int, a array<array<double>>, b array<array<double>>")
    got = {r.k: (r.x, r.y) for r in df.select("k", geometry.common_area(F.col("a"), F.col("b")).alias("x"), geometry.common_area(F.col("b"), F.col("a")).alias("y")).collect()}
    for k, (_, _, area) in enumerate(cases):
        assert got[k] == pytest.approx((area, area), abs=1e-9), k
    assert got[99] == (0.0, 0.0)
    areas = {r.k: r.area for r in df.where("k < 3").select("k", geometry.repaired_area(F.col("a")).alias("area")).collect()}
    assert areas == pytest.approx({0: 16.0, 1: 24.0, 2: 8.0})


@pytest.mark.parametrize("shared", [1, 2, 64])
def test_folder_matches_are_those_of_all_pairs(spark, monkeypatch, shared):
    monkeypatch.setattr(manifest, "SHARED", shared)
    rng, rows = np.random.default_rng(shared), []
    for k in range(240):
        # copies, items that most folders have, items of few, none
        own = [f"c{k % 7}"] * (k % 3) + [f"h{x}" for x in range(9) if rng.random() < 0.4] + [f"r{x}" for x in rng.integers(0, 400, k % 4)]
        rows += [("source" if k % 2 else "target", f"f{k:03}", item) for item in (own if k % 10 else ["h0", "h1", "z"])]
    sets = {}
    for side, folder, item in rows:
        sets.setdefault((side, folder), set()).add(item)
    want = {}
    for (side, t), x in sets.items():
        scored = [(len(x & y), len(x & y) / len(x | y), s) for (other, s), y in sets.items() if side == "target" and other == "source" and x & y]
        if scored:
            overlap, jaccard, s = max(scored)
            want[t] = (s, overlap, jaccard, sum(v[:2] == (overlap, jaccard) for v in scored) > 1)
    got = manifest.folder_matches(spark.createDataFrame(rows, "side string, folder string, item string").repartition(3)).collect()
    assert {r.target: (r.source, r.overlap, r.jaccard, r.ambiguous) for r in got} == want and len(got) == len(want)


def test_an_item_of_all_folders_costs_no_pairs(spark):
    df = spark.range(60_000).selectExpr("if(id % 2 = 0, 'source', 'target') AS side", "concat('f', id) AS folder", "explode(array('all', concat('own', id))) AS item")
    got = manifest.folder_matches(df).agg(F.count("*"), F.min("source"), F.max("source"), F.min("overlap"), F.max("overlap")).first()
    assert tuple(got) == (30_000, "f9998", "f9998", 1, 1)


def test_targets_of_one_source_are_not_ranked_in_one_group(spark):
    folders = spark.createDataFrame([("source", "a", "s", 3)] + [("target", f"c{k % 3}", f"t{k}", 2) for k in range(20)] + [("target", "a", "u", 0)], "side string, class string, folder string, items long")
    matches = spark.createDataFrame([(f"t{k}", "s", 1, 0.5, k == 5) for k in range(20)], "target string, source string, overlap long, jaccard double, ambiguous boolean")
    plan = manifest.sync_plan(folders, matches)
    got = {(r.action, r.target, r.source) for r in plan.collect()}
    assert got == {("matched", "t0", "s"), ("rename", "t0", "s"), ("ambiguous", "t5", "s"), ("unmatched", "u", None)} | {("source_taken", f"t{k}", "s") for k in range(1, 20) if k != 5}
    assert "Window" not in plan._jdf.queryExecution().toString()


def test_bitmaps_of_long_payloads_take_linear_time(spark):
    import time

    from marlstone.sources import bitmaps

    def took(size):
        payload, height = F.encode(F.repeat(F.lit("a"), size), "UTF-8"), F.lit(-(-size // 90)).cast("int")
        own = spark.range(1).select(bitmaps.bitmap(F.concat(payload, F.encode((F.col("id") + 1).cast("string"), "UTF-8")), F.lit(30), height + 1).alias("content"))
        began = time.perf_counter()
        content = bytes(own.first().content)
        return time.perf_counter() - began, content

    took(900)
    seconds, content = took(1_000_000)
    assert len(content) == 54 + 92 * (-(-1_000_000 // 90) + 1)
    rows = [content[54 + k : 54 + k + 90] for k in range(0, len(content) - 54, 92)]
    assert b"".join(rows).rstrip(b"\x00") == b"a" * 1_000_000 + b"1"
    assert seconds < 20


def test_small_files_share_tasks_and_the_setting_comes_back(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"{k}.png").write_bytes(png(np.full((2, 2, 3), k, dtype=np.uint8)))
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    with pixels.small_files(spark):
        parts = spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
        taken = pixels.sampled_files(spark, str(tmp_path), F.col("path"), 7)
    assert parts <= 4 and spark.conf.get(name) == before
    assert taken == sorted((f"file:{tmp_path}/{k}.png" for k in range(100)), key=lambda p: hashlib.sha256(p.encode()).hexdigest())[:7]


def test_strip_statistics_move_no_pixels(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(png(np.full((20, 30, 3), 9, dtype=np.uint8)))
    boxed = pixels.read_images(spark, str(tmp_path)).select("*", F.lit(6).alias("left"), F.lit(4).alias("top"), F.lit(24).alias("right"), F.lit(16).alias("bottom"))
    plan = pixels.strip_statistics(boxed)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rings_are_judged_in_batches_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    polygons = [rng.integers(0, 6, (n, 2)).astype(float).tolist() for n in (3, 4, 5, 6, 9) for _ in range(40)] + [[], [[1.0, 1.0]], None]
    df = spark.createDataFrame(list(enumerate(polygons)), "k int, p array<array<double>>")
    own = df.select("k", geometry.self_crossing(F.col("p")).alias("crossing"), geometry.repaired_area(F.col("p")).alias("area"), geometry.ring_kind(F.col("p")).alias("kind"))
    assert "ArrowEvalPython" in own._jdf.queryExecution().executedPlan().toString()

    def side(a, b, q):
        return np.sign((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]))

    for r in own.collect():
        p = polygons[r.k]
        if p is None:
            assert (r.crossing, r.area, r.kind) == (None, None, None)
            continue
        edges = list(zip(p, p[1:] + p[:1], strict=True))
        crossing = any(side(*e, f[0]) * side(*e, f[1]) < 0 and side(*f, e[0]) * side(*f, e[1]) < 0 for k, e in enumerate(edges) for f in edges[k + 2 :])
        assert r.crossing == crossing and (r.kind == "crossing" or not crossing or r.kind is None)
        if r.kind == "simple":
            assert abs(r.area - abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)) / 2) < 1e-9
        elif len(p) >= 3:  # the even-odd rule, by widths of fine scan lines
            ys, width = (np.arange(6 * 840) + 0.5) / 840, 0.0
            for y in ys:
                xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges if (a[1] <= y) != (b[1] <= y))
                width += sum(xs[1::2]) - sum(xs[::2])
            assert abs(r.area - width / 840) < 0.01
    from marlstone.functions import rings

    star = np.array([[np.cos(4 * np.pi * k / 5), np.sin(4 * np.pi * k / 5)] for k in range(5)])
    assert abs(rings.even_odd_area(star) - rings.even_odd_areas(star[None])[0]) < 1e-12


@pytest.mark.parametrize(("name", "moved"), [("d14_mask_dice", 1), ("d17_mean_dice", 2), ("d9_polygon_validity", 1), ("d7_polygon_masks", 2)])
def test_line_items_move_once_and_without_polygons(spark, name, moved):
    from marlstone.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == moved
    assert "array(" not in plan[plan.index("Window [row_number()") :]


def test_spans_of_a_replayed_stream_grow_in_number(spark, monkeypatch):
    import glob

    from marlstone.streaming import watermarked

    rows = [("a" if k % 3 else "b", k, 1000.0 + 7 * k, 60.0 if k % 5 else 10.0) for k in range(200)]
    own = spark.createDataFrame(rows, "run string, id long, at double, value double").select("run", "id", F.timestamp_seconds("at").alias("ts"), "value")
    folders, before = [], watermarked.shared_folder
    monkeypatch.setattr(watermarked, "shared_folder", lambda s: folders.append(before(s)) or folders[-1])
    monkeypatch.setattr(watermarked, "SPAN", 20, raising=False)
    got = {(r.run, r.id): r.fired for r in watermarked.drained(own, 50.0, 20.0).collect()}
    batches = len(glob.glob(folders[0].removeprefix("file://") + "/state/commits/[0-9]*"))
    assert batches >= 10 and len(got) == 200 and any(got.values())


@pytest.mark.parametrize("name", ["a13_detection_export", "a14_polygon_text"])
def test_exports_do_not_move_objects_by_category(spark, name):
    from marlstone.plans import registry

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "hashpartitioning(category" not in plan
