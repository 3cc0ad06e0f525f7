"""Order statistics, replicates, capabilities, caches, record shards, discovery, resumable tables, run logs."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import capabilities, curate, order_stats, replicates, weights
from ridgeline.sources import caches, sinks
from ridgeline.sources import frames as sources
from ridgeline.sources.checksums import crc32c, masked


def framed(b):
    head = struct.pack("<Q", len(b))
    return head + struct.pack("<I", masked(crc32c(head))) + b + struct.pack("<I", masked(crc32c(b)))


def test_quantiles_narrowed_and_plain_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": np.exp(rng.normal(0, 30, 20_000)), "b": np.repeat(7.0, 5000), None: np.concatenate([np.zeros(6000), rng.normal(size=6001)]), "c": np.array([3.0]), "d": np.array([-1e300, 1e300, 0.0, -0.5])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("a", None), ("e", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = [0.0, 0.013, 0.5, 0.999, 1.0]
    for few in (500, 1_000_000):
        found = {r.g: r for r in order_stats.quantiles(df, ["g"], "v", shares, few=few).collect()}
        assert set(found) == set(groups)
        for g, own in groups.items():
            assert found[g].n == len(own) and found[g].q == pytest.approx(np.quantile(own, shares).tolist(), rel=1e-12)
    assert order_stats.quantiles(df, [], "v", [0.5], few=700).first().q[0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert order_stats.median(df.where("false"), "v").collect() == []


def test_no_task_holds_a_group(spark):
    """Very many distinct values of one group: no list of values is longer than asked."""
    df = spark.range(0, 600_000, 1, 8).select(F.lit(1).alias("g"), (F.xxhash64("id") % 1_000_003 + F.col("id") / 1e7).alias("v"))
    found = order_stats.quantiles(df, ["g"], "v", [0.5], few=20_000)
    values = np.sort(df.toPandas()["v"].to_numpy())
    assert found.first().q[0] == pytest.approx((values[299_999] + values[300_000]) / 2, abs=1e-9)


def test_ordinal(spark):
    rows = [(k % 50 if k % 3 else 7, f"x{k}") for k in range(900)]
    df = spark.createDataFrame([*rows, (None, "n")], "k long, name string").repartition(5)
    found = order_stats.ordinal(df, "place", "k").orderBy("place").collect()
    assert [r.place for r in found] == list(range(1, 902)) and found[0].k is None
    assert [r.k for r in found[1:]] == sorted(k for k, _ in rows) and {r.name for r in found} == {n for _, n in rows} | {"n"}
    assert order_stats.ordinal(df.where("false"), "place", "k").collect() == []


def test_replicates_equal_drawn_rows(spark):
    """The vectors hold what drawing every row n times for every resample gives, however the rows are dealt."""
    d = np.random.default_rng(2).normal(0.1, 1, 700)
    df = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(d)] + [(1000, None, 1.0)], "k long, a double, b double")
    h = np.array([r.h for r in df.where("a IS NOT NULL").orderBy("k").select(replicates.key_digest(5, "k").alias("h")).collect()])
    n = replicates.draws(h, 400)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and n.max() <= 7
    assert abs(np.corrcoef(n[:, 0], n[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(n[0], n[1])[0, 1]) < 0.2
    means = (d @ n) / n.sum(axis=0)
    for parts in (1, 4):
        r = replicates.paired_bootstrap(df.repartition(parts), "k", "a", "b", 400, 5).first()
        assert (r.mean_diff, r.n) == (pytest.approx(d.mean()), 700) and r.low == pytest.approx(np.quantile(means, 0.025)) and r.high == pytest.approx(np.quantile(means, 0.975)) and r.share_above == pytest.approx((means > 0).mean())
    empty = replicates.paired_bootstrap(df.where("false"), "k", "a", "b", 10).first()
    assert tuple(empty) == (None, 0, None, None, None)


def test_draws_fall_in_no_gap(spark):
    w = spark.createDataFrame([(i, 0.1 + 0.2 * (i % 3)) for i in range(3000)], "k long, w double")
    drawn = weights.weighted_draw(w, "k", "w", 3000, 1)
    assert drawn.where("k IS NULL").count() == 0 and drawn.count() == 3000


def test_capabilities_of_a_sketch_equal_counts_where_it_matters(spark):
    rows = [("m", i, f"text {i % 700}", "same", i % 2 == 0) for i in range(20_000)] + [(None, 1, None, " ", True)]
    df = spark.createDataFrame(rows, "model string, id long, a string, b string, none boolean")
    fields = [capabilities.Field("a", F.col("a")), capabilities.Field("b", F.col("b")), capabilities.Field("c", F.lit(None).cast("string"), of_objects=True), capabilities.Field("d", F.col("a"), True, needs="b")]
    for exact in (10, 10**6):
        found = {(r.model, r.capability): r for r in capabilities.detect_capabilities(df, "model", fields, F.col("none"), exact=exact).collect()}
        assert {k: r.rule for k, r in found.items() if k[0]} == {("m", "a"): "degenerate", ("m", "b"): "degenerate", ("m", "c"): "absent", ("m", "d"): "needs b"}
        assert found["m", "a"].n_distinct == pytest.approx(700, rel=0.03) and found["m", "c"].n_explicit_none == 10_000
        assert all(found[None, c].rule == "absent" for c in "abcd")


def test_profiles(spark):
    rows = [("x", "X", "native", "abs_pixel", {"reason": "yes"})]
    registry = capabilities.Profiles(spark.createDataFrame(rows, capabilities.PROFILE), spark.createDataFrame([("an x", "x")], "alias string, name string"))
    df = spark.createDataFrame([("x",), ("an x",)], "m string")
    assert [r.profile.display for r in registry.of(df, "m").collect()] == ["X", "X"]
    assert [tuple(r) for r in registry.expected().collect()] == [("x", "reason", "yes")]
    other = df.unionByName(spark.createDataFrame([("y",)], "m string"))
    with pytest.raises(KeyError, match="'y'"):
        registry.of(other, "m")
    assert registry.of(other, "m", unknown="null").where("profile IS NULL").count() == 1
    with pytest.raises(ValueError, match="twice"):
        capabilities.Profiles(spark.createDataFrame(rows * 2, capabilities.PROFILE))


def test_caches_join_where_they_lie(spark, tmp_path):
    index = spark.createDataFrame([(f"s-{i}", i) for i in range(200)], "frame_key string, n long")
    caches.write_cache(index, "t_index", buckets=4, path=str(tmp_path / "index"))
    caches.write_cache(index.select("frame_key", (F.col("n") * 2).alias("m")), "t_cache", buckets=4, path=str(tmp_path / "cache"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = caches.align(spark, "t_index", "t_cache")
        assert both.where("m = 2 * n").count() == 200
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        anti = spark.table("t_index").join(spark.table("t_cache"), "frame_key", "left_anti")
        assert "Exchange" not in anti._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # as many keys, but others
    caches.write_cache(index.withColumn("frame_key", F.regexp_replace("frame_key", "s-17$", "s-x")), "t_other", buckets=4, path=str(tmp_path / "other"))
    with pytest.raises(ValueError, match="t_other lacks frame_key 's-17'"):
        caches.align(spark, "t_index", "t_other")
    caches.write_cache(index.unionByName(index.limit(1)), "t_twice", buckets=4, path=str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="more than once"):
        caches.align(spark, "t_twice", "t_cache")
    caches.write_cache(index.unionByName(spark.createDataFrame([(None, 1)], index.schema)), "t_null", buckets=4, path=str(tmp_path / "null"))
    with pytest.raises(ValueError, match="without a frame_key"):
        caches.align(spark, "t_null", "t_cache")


def test_cache_rows_tell_what_was_wrong(spark, tmp_path):
    for name, content in (("s-1", "{}"), ("s-2", "{ broken")):
        (tmp_path / "s" / name).mkdir(parents=True)
        (tmp_path / "s" / name / "frame.json").write_text(content)
    index = spark.createDataFrame([("s-1",), ("s-2",), ("s-3",)], "frame_key string")
    rows = curate.with_errors(index, sources.read_frames(spark, str(tmp_path)), sources.unreadable(spark, str(tmp_path)))
    assert {r.frame_key: r.error for r in rows.collect()} == {"s-1": None, "s-2": "not readable: { broken", "s-3": "no frame document"}


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0 and crc32c(b"\0" * 32) == 0x8A9136AA and crc32c(b"\xff" * 32) == 0x62A8AB43
    data = bytes(np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8))
    for n in (1, 511, 512, 1024, 1025, 4999):
        state = 0xFFFFFFFF
        for byte in data[:n]:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
        assert crc32c(data[:n]) == state ^ 0xFFFFFFFF
    assert masked(0) == 0xA282EAD8


def test_record_source_checks_and_stops(spark, tmp_path):
    doc = lambda scene, k: json.dumps({"scene": scene, "k": k}).encode()
    (tmp_path / "a").write_bytes(b"".join(framed(doc(s, k)) for k, s in enumerate(["u", "u", "v", "w", "v"])))
    bad = bytearray(framed(doc("x", 0)) + framed(doc("x", 1)) + framed(doc("x", 2)))
    bad[len(framed(doc("x", 0))) + 14] ^= 1
    (tmp_path / "b").write_bytes(bytes(bad))
    length = bytearray(framed(doc("y", 0)) + framed(doc("y", 1)))
    length[len(framed(doc("y", 0)))] ^= 1
    (tmp_path / "c").write_bytes(bytes(length))
    (tmp_path / "d").write_bytes(struct.pack("<Q", 3) + b"\0" * 4 + b"old" + b"\0" * 4)
    (tmp_path / ".hidden").write_bytes(b"x")
    sources.register(spark)
    read = lambda **o: spark.read.format("recordfile").options(**o).load(str(tmp_path))
    rows = {(r.shard, r.record_no): r.valid for r in read(checksum="flag").collect()}
    assert rows == {("a", 0): True, ("a", 1): True, ("a", 2): True, ("a", 3): True, ("a", 4): True, ("b", 0): True, ("b", 1): False, ("b", 2): True, ("c", 0): True, ("c", 1): False, ("d", 0): False}
    assert read(checksum="ignore", maxShards="1").count() == 5 and read(maxShards=1).count() == 5
    for shards in (2, 3, 4):
        with pytest.raises(Exception, match="fails its checksum"):
            read(maxShards=shards).collect()
    some = read(maxShards=1, maxScenes=2, sceneField="scene")
    assert [r.record_no for r in some.collect()] == [0, 1, 2]
    assert read(maxShards=1, maxRecords=4).count() == 4
    with pytest.raises(Exception, match="sceneField"):
        read(maxScenes=1).collect()
    scene = F.get_json_object(F.col("payload").cast("string"), "$.scene")
    assert {(r.shard, r.record_no) for r in sources.first_scenes(read(checksum="flag", maxShards=2).where("valid"), scene, 2).collect()} == {("a", 0), ("a", 1), ("a", 2), ("a", 4)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:  # shard a alone is opened: the others would raise
        assert read(pushFilters="true").where("shard = 'a' AND record_no > 1").count() == 3
        assert read(pushFilters="true").where("shard IN ('a', 'z')").count() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_discovery(spark, tmp_path):
    for folder in ("p10--b/s/s-1", "p2--a/t/t-1", "p2--a/t/t-2", ".p3--c/u/u-1", "p4/v/v-1", "p5--d/DONE_x/x-1"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "frame.json").write_text("{}")
    (tmp_path / "p2--a/t/t-2/panorama_geo.json").write_text("{}")
    assert [r.partition for r in sources.partitions_of(spark, str(tmp_path)).collect()] == ["p2", "p5", "p10"]
    assert [r.partition for r in sources.partitions_of(spark, str(tmp_path), ["p10"]).collect()] == ["p10"]
    assert [r.id.rpartition("/")[2] for r in sources.frames_below(spark, str(tmp_path), ("frame.json",)).collect()] == ["s-1", "t-1", "t-2"]
    assert [r.id.rpartition("/")[2] for r in sources.frames_below(spark, str(tmp_path)).collect()] == ["t-2"]
    assert [r.id.rpartition("/")[2] for r in sources.frames_below(spark, str(tmp_path / "p2--a"), ("frame.json",)).collect()] == ["t-1", "t-2"]
    found = spark.read.format("framefolders").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3 and {(r.partition, r.scene_id, r.frame_key) for r in found.collect()} == {("p10", "s", "s-1"), ("p2", "t", "t-1"), ("p2", "t", "t-2")}
    for content, ids in (('["a", {"fdir": "b"}, 3, null]', ["a", "b"]), ('{"online": ["x"], "other": 1}', ["x"]), ('{"none": []}', []), ("{", []), ('{"fdirs": [{"fdir": "c"}]}', ["c"]), ("[]", [])):
        (tmp_path / "l.json").write_text(content)
        assert sorted(r.id for r in sources.read_frame_list(spark, "known", {"known": str(tmp_path / "l.json")}).collect()) == ids


def test_small_batches_read_their_own_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert sinks.append_pruned(df, path, "k", prefixes=16).count() == 500
    one = spark.createDataFrame([(3, "b"), (1000, "b"), (1000, "c")], df.schema)
    mine = {r[0] for r in one.select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    files = sinks.done_keys(spark, path, df.schema, sorted(mine)).inputFiles()
    assert {int(f.split("_prefix=")[1].split("/")[0]) for f in files} == mine and len(files) == len(mine)
    sinks.append_pruned(one, path, "k", prefixes=16)
    sinks.append_pruned(one, path, "k", prefixes=16)
    done = sinks.sorted_copy(spark, path, str(tmp_path / "sorted"), "k").collect()
    assert [(r.k, r.v) for r in done] == [*[(i, "a") for i in range(500)], (1000, "b")]
    assert sinks.append_pruned(df.where("false"), path, "k", prefixes=16).count() == 0


def test_run_log_survives_bad_files(spark, tmp_path):
    path = str(tmp_path / "log")
    for step, score in ((1, 0.5), (2, 0.7), (3, None)):
        history = sinks.append_history(spark, path, step, "t", "s1", score)
    assert history.count() == 3
    sinks.append_log(spark.createDataFrame([(4, "x", {"a": 1})], "step long, stage string, extra map<string,int>"), path)
    (tmp_path / "log" / "old.json").write_text('[{"step": 0, "stage": "s0", "run_at": "1999"}, {"stage": "s0", "step": 5}]')
    (tmp_path / "log" / "bad.json").write_text('{"step": 9,\n')
    log = sinks.read_log(spark, path)
    assert [(r.file, r.error) for r in log.where("error IS NOT NULL").collect()] == [("bad.json", '{"step": 9,')]
    entries = sinks.log_fields(log, **sinks.HISTORY, run_at="string")
    assert sorted(r.step for r in entries.collect()) == [0, 1, 2, 3, 4, 5]
    last = {r.stage: r.step for r in sinks.latest_entries(entries.drop("file"), "stage").collect()}
    assert last == {"s0": 0, "s1": 3, "x": 4}
