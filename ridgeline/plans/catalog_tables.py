"""Registered queries of capabilities, record shards, frame lists, resumable tables and run logs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import aggregate, capabilities
from ridgeline.plans.catalog import query
from ridgeline.plans.views import FRAMES_SQL, frames, table
from ridgeline.sources import frames as sources
from ridgeline.sources import sinks
from ridgeline.sources.checksums import crc32c, masked
from ridgeline.sources.tables import shared_folder

#: What five models say, by event type: one with everything, one that answers "none", one with few objects, one with a constant reason, one with nothing.
_SAID_SQL = (
    FRAMES_SQL
    + """, q AS (SELECT event_type AS model, event_id, frame_no, scene_id, intent, speed, CASE event_type WHEN 'click' THEN true WHEN 'purchase' THEN event_id % 50 = 0 WHEN 'signup' THEN true ELSE false END AS objs FROM frames),
a AS (SELECT *, NOT objs AND model IN ('view', 'purchase') AS says_none, CASE WHEN model = 'click' THEN 'Car ' || (scene_id % 7) WHEN model = 'signup' THEN 'Car' ELSE 'Bus ' || frame_no END AS type FROM q),
c AS (SELECT model, says_none, unnest([
  {'f': 'points', 'o': true, 's': true, 'v': CASE WHEN objs THEN frame_no || ',' || scene_id END}, {'f': 'types', 'o': true, 's': true, 'v': CASE WHEN objs THEN type END},
  {'f': 'behaviour', 'o': true, 's': false, 'v': CASE WHEN objs THEN 'moving ' || event_id END}, {'f': 'implication', 'o': true, 's': false, 'v': CASE WHEN objs AND model = 'click' THEN 'slows ' || frame_no || ' ' || scene_id END},
  {'f': 'reason', 'o': false, 's': false, 'v': CASE model WHEN 'click' THEN 'r ' || event_id WHEN 'view' THEN 'the road is clear' END}, {'f': 'plan', 'o': false, 's': false, 'v': CASE WHEN model = 'click' AND event_id % 4 = 0 THEN 'keep ' || event_id WHEN model = 'view' AND event_id % 10 = 0 THEN 'stop' END},
  {'f': 'trajectory', 'o': false, 's': true, 'v': CASE WHEN model <> 'signup' THEN event_id::VARCHAR END}]) AS x FROM a),
g AS (SELECT model, x.f AS capability, any_value(x.o) AS o, any_value(x.s) AS s, count(*) AS n, count(x.v) AS n_frames, count(*) FILTER (says_none AND x.o AND x.v IS NULL) AS n_explicit_none, count(DISTINCT x.v) AS n_distinct FROM c GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n_frames = 0 THEN 'absent' WHEN (n_frames + n_explicit_none) / n::DOUBLE < 0.2 THEN 'coverage' WHEN o AND n_frames / n::DOUBLE < 0.05 THEN 'objects' WHEN n_distinct / n_frames::DOUBLE < CASE WHEN s THEN 0.01 ELSE 0.05 END THEN 'degenerate' ELSE 'able' END AS rule0 FROM g),
d AS (SELECT *, CASE WHEN rule0 = 'able' AND capability = 'behaviour' AND NOT bool_or(capability = 'types' AND rule0 = 'able') OVER (PARTITION BY model) THEN 'needs types' ELSE rule0 END AS rule FROM r)"""
)


def _said(spark, sf_dir) -> DataFrame:
    f, model = frames(spark, sf_dir), F.col("event_type")
    some = F.when(model == "click", True).when(model == "purchase", F.col("event_id") % 50 == 0).when(model == "signup", True).otherwise(False)
    kind = F.when(model == "click", F.concat(F.lit("Car "), (F.col("scene_id") % 7).cast("string"))).when(model == "signup", "Car").otherwise(F.concat(F.lit("Bus "), F.col("frame_no").cast("string")))
    none = F.lit(None).cast("string")
    o = F.struct(
        kind.alias("type"), F.struct(F.col("frame_no").alias("x"), F.col("scene_id").alias("y")).alias("point"), F.concat(F.lit("moving "), F.col("event_id").cast("string")).alias("state"), none.alias("intention"), none.alias("content"),
        F.when(model == "click", F.concat_ws(" ", F.lit(" SLOWS "), F.col("frame_no"), F.col("scene_id"))).alias("implication"),
    )
    reason = F.when(model == "click", F.concat(F.lit("R  "), F.col("event_id").cast("string"))).when(model == "view", "The road is clear")
    plan = F.when((model == "click") & (F.col("event_id") % 4 == 0), F.concat(F.lit("keep "), F.col("event_id").cast("string"))).when((model == "view") & (F.col("event_id") % 10 == 0), "stop")
    rows = f.select("event_id", model.alias("model"), F.when(some, F.array(o)).otherwise(F.array()).alias("objects"), (~some & model.isin("view", "purchase")).alias("says_none"), reason.alias("reason"), plan.alias("final_plan"), F.when(model != "signup", F.array("event_id")).alias("traj"))
    return rows


@query("WITH " + _SAID_SQL + " SELECT model, capability, n, n_frames, n_explicit_none, round((n_frames + n_explicit_none) / n::DOUBLE, 9) AS coverage, n_distinct, round(coalesce(n_distinct / nullif(n_frames, 0)::DOUBLE, 0), 9) AS distinct_ratio, rule = 'able' AS able, rule FROM d")
def capabilities_found(spark, sf_dir):
    found = capabilities.detect_capabilities(_said(spark, sf_dir), "model", capabilities.answer_fields(), F.col("says_none"))
    return found.withColumns({c: F.round(c, 9) for c in ("coverage", "distinct_ratio")})


@query("WITH " + _SAID_SQL + ", p(name, mode) AS (VALUES ('click', 'abs_pixel'), ('view', 'norm1000'), ('buyer', 'norm1000')) SELECT d.model, mode AS point_mode, count(*) FILTER (rule = 'able') AS able, sum(CASE WHEN rule = 'able' OR capability <> 'reason' THEN n_frames END)::BIGINT AS scored FROM d LEFT JOIN p ON p.name = CASE d.model WHEN 'purchase' THEN 'buyer' ELSE d.model END GROUP BY 1, 2")
def profiled_models(spark, sf_dir):
    """What the models are able to, with their profiles by name and alias, and one metric per field masked where its capability is missing."""
    yes = lambda *names: {n: "yes" for n in names}
    rows = [("click", "Click", "adapter", "abs_pixel", yes("points", "types")), ("view", "View", "native", "norm1000", yes("trajectory")), ("buyer", "Buyer", "native", "norm1000", {"reason": "text"})]
    registry = capabilities.Profiles(spark.createDataFrame(rows, capabilities.PROFILE), spark.createDataFrame([("purchase", "buyer")], "alias string, name string"))
    found = capabilities.detect_capabilities(_said(spark, sf_dir), "model", capabilities.answer_fields(), F.col("says_none"))
    scored = aggregate.mask_metrics(found.select("model", F.col("capability").alias("metric"), F.col("n_frames").cast("double").alias("value")), found, {"reason": "reason"})
    counts = found.groupBy("model").agg(F.count_if("able").alias("able")).join(scored.groupBy("model").agg(F.sum("value").cast("long").alias("scored")), "model")
    return registry.of(counts, "model", unknown="null").select("model", F.col("profile.point_mode").alias("point_mode"), "able", "scored")


def _write_files(rows: DataFrame, root: str) -> None:
    """Files (name below root, content) written by the tasks that hold them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(rows.columns[0], F.col(rows.columns[1]).cast("binary")).mapInArrow(write, "n long").collect()


def _shard(spark, sf_dir, path: str) -> None:
    """Suppliers as records, a shard for each tenth key; every seventh payload is changed after its checksum was made."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for docs in batch.column("docs").to_pylist():
                data = b""
                for d in docs:
                    body = json.dumps({"scene": d["scene"], "key": d["key"]}).encode()
                    head, tail = struct.pack("<Q", len(body)), struct.pack("<I", masked(crc32c(body)))
                    data += head + struct.pack("<I", masked(crc32c(head))) + (body.replace(b"{", b"[") if d["key"] % 7 == 0 else body) + tail
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.binary())], names=["name", "content"])

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 5).alias("scene"))
    one = s.groupBy(F.format_string("part-%02d", F.pmod("key", F.lit(10))).alias("name")).agg(F.sort_array(F.collect_list(F.struct("key", "scene"))).alias("docs"))
    _write_files(one.mapInArrow(pack, "name string, content binary"), path)


@query("SELECT 'part-0' || (s_suppkey % 10) AS shard, count(*) FILTER (s_suppkey % 7 <> 0) AS good, count(*) FILTER (s_suppkey % 7 = 0) AS bad, max(s_suppkey) FILTER (s_suppkey % 7 <> 0) AS last FROM supplier WHERE s_suppkey % 10 < 4 GROUP BY 1")
def checked_records(spark, sf_dir):
    """The first four shards, with the records that fail their checksum told apart."""
    path = shared_folder(spark, "shards")
    _shard(spark, sf_dir, path)
    sources.register(spark)
    raw = spark.read.format("recordfile").option("maxShards", 4).option("checksum", "flag").load(path)
    key = F.get_json_object(F.when(F.col("valid"), F.col("payload").cast("string")), "$.key").cast("long")
    return raw.groupBy("shard").agg(F.count_if("valid").alias("good"), F.count_if(~F.col("valid")).alias("bad"), F.max(key).alias("last"))


@query("WITH n AS (SELECT n_nationkey AS k, 'p' || n_regionkey AS partition, 's' || n_nationkey AS scene, 's' || n_nationkey || '-00' || n_regionkey AS key FROM nation) SELECT 'folder' AS spec, partition || '--x/' || scene || '/' || key AS id FROM n WHERE k % 3 > 0 UNION ALL SELECT 'named', partition || '--x/' || scene || '/' || key FROM n WHERE k % 3 > 0 UNION ALL SELECT unnest(['list', 'frames', 'fdirs', 'mixed']), key FROM n UNION ALL SELECT 'partitions', partition FROM n GROUP BY partition")
def frame_list_specs(spark, sf_dir):
    """A nested tree and files in every form of a frame list."""
    root = shared_folder(spark, "tree")
    key = F.concat(F.lit("s"), "n_nationkey", F.lit("-00"), "n_regionkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", key.alias("key"), F.concat(F.lit("p"), "n_regionkey", F.lit("--x/s"), "n_nationkey", F.lit("/"), key).alias("id"))
    files = n.select("n_nationkey", F.explode(F.array(F.struct(F.concat(F.lit("tree/"), "id", F.lit("/frame.json")).alias("name")), F.struct(F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("tree/"), "id", F.lit("/panorama_geo.json"))).alias("name")))).alias("f")).select("f.name", F.lit("{}").alias("content"))
    hidden = spark.createDataFrame([("tree/.p9--x/s/s-1/frame.json", "{}"), ("tree/p0--x/DONE-s/s-1/frame.json", "{}"), ("tree/p0--x/DONE-s/s-1/panorama_geo.json", "{}")], "name string, content string")
    keys = n.agg(F.sort_array(F.collect_list("key")).alias("k"))  # nations are few
    dirs = F.transform("k", lambda x: F.struct(x.alias("fdir")))
    mixed = F.concat(F.lit("["), F.array_join(F.transform("k", lambda x: F.when(x.endswith("1"), F.to_json(F.struct(x.alias("fdir")))).otherwise(F.concat(F.lit('"'), x, F.lit('"')))), ","), F.lit("]"))
    forms = {"list": F.to_json("k"), "frames": F.to_json(F.struct(F.col("k").alias("frames"))), "fdirs": F.to_json(F.struct(dirs.alias("fdirs"))), "mixed": mixed}
    lists = keys.select(F.explode(F.create_map(*[x for name, c in forms.items() for x in (F.lit(f"{name}.json"), c)])).alias("name", "content"))
    _write_files(files.where("name IS NOT NULL").unionByName(hidden).unionByName(lists), root)
    below = F.regexp_extract("id", "/tree/(.*)$", 1).alias("id")
    out = sources.read_frame_list(spark, f"{root}/tree").select(F.lit("folder").alias("spec"), below)
    out = out.unionByName(sources.read_frame_list(spark, "dev", {"dev": f"{root}/tree"}).select(F.lit("named").alias("spec"), below))
    for name in forms:
        out = out.unionByName(sources.read_frame_list(spark, f"{root}/{name}.json").select(F.lit(name).alias("spec"), "id"))
    return out.unionByName(sources.partitions_of(spark, f"{root}/tree").select(F.lit("partitions").alias("spec"), F.col("partition").alias("id")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM customer")
def pruned_append(spark, sf_dir):
    """Two runs of a resumable table by prefixes of the key, the second over all rows: each key keeps the row of its first run."""
    path, out = shared_folder(spark, "pruned"), shared_folder(spark, "sorted")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    sinks.append_pruned(c.where("c_custkey % 3 = 0").withColumn("run", F.lit(1)), path, "c_custkey", prefixes=8)
    sinks.append_pruned(c.withColumn("run", F.lit(2)), path, "c_custkey", prefixes=8)
    return sinks.sorted_copy(spark, path, out, "c_custkey")


@query("WITH e AS (SELECT n_nationkey AS step, 'run ' || n_name AS tag, 's' || n_regionkey AS stage, CASE WHEN n_nationkey % 4 <> 0 THEN round(((n_nationkey * 37) % 11) / 10.0, 3)::DOUBLE END AS composite FROM nation), b AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY composite DESC, step) AS r FROM e WHERE composite IS NOT NULL) SELECT stage, step::BIGINT AS step, tag, composite, (SELECT count(*) FROM nation) AS entries, 2::BIGINT AS errors FROM b WHERE r = 1")
def run_history(spark, sf_dir):
    """A history with a legacy file, a broken one and a broken line: the best entry per stage."""
    path = shared_folder(spark, "history")
    n = table(spark, sf_dir, "nation")
    e = n.select(F.col("n_nationkey").cast("long").alias("step"), F.concat(F.lit("run "), "n_name").alias("tag"), F.concat(F.lit("s"), "n_regionkey").alias("stage"), F.when(F.col("n_nationkey") % 4 != 0, F.round(((F.col("n_nationkey") * 37) % 11) / 10.0, 3)).alias("composite"))
    sinks.append_log(e.where("step % 2 = 0"), path)
    sinks.append_log(e.where("step % 2 = 1 AND step > 5").withColumn("note", F.lit("later field")), path)
    legacy = e.where("step % 2 = 1 AND step <= 5").agg(F.to_json(F.struct(F.collect_list(F.struct("step", "tag", "stage", "composite")).alias("runs"))).alias("content")).select(F.lit("legacy.json").alias("name"), "content")
    broken = spark.createDataFrame([("broken.json", '{"step": 1, "tag": '), ("line.json", "no entry at all")], "name string, content string")
    _write_files(legacy.unionByName(broken), path)
    log = sinks.read_log(spark, path)
    entries = sinks.log_fields(log, **sinks.HISTORY)
    counts = log.agg(F.count_if(F.col("error").isNull()).alias("entries"), F.count("error").alias("errors"))
    return aggregate.best_runs(entries.drop("file")).join(F.broadcast(counts), F.lit(True)).select("stage", "step", "tag", "composite", "entries", "errors")
