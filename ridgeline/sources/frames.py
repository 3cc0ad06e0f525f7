"""Readers for frame documents, annotations, masks, lists, predictions and framed record shards."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ridgeline.sources.checksums import crc32c, masked

SERIES = "struct<pos_x:array<double>,pos_y:array<double>,pos_z:array<double>,vel_x:array<double>,vel_y:array<double>,accel_x:array<double>,accel_y:array<double>>"
FRAME = f"""frame_id string, intent string, intent_corrected string, past_states {SERIES}, future_states {SERIES},
preference_trajectories array<struct<pos_x:array<double>,pos_y:array<double>,preference_score:double>>, ego_behavior struct<longitudinal:string,lateral:string>"""
ANNOTATION = """context struct<weather:string,daytime:string,visibility:string,scenario:string,road:string>, traffic_events array<struct<types:array<string>>>,
annotations array<struct<class:string,bbox:struct<x:double,y:double,w:double,h:double>,attributes:string,driving_implication:string>>, reason string, final_plan string"""
MASKS = """categories array<struct<id:bigint,name:string>>, annotations array<struct<category_id:bigint,bbox:array<double>,segmentation:struct<size:array<int>,counts:array<int>>>>"""


def frame_keys(df: DataFrame, path: str) -> DataFrame:
    """partition, scene_id, frame_key and frame_no of a path …/<partition>/<scene>/<scene>-<frame>[/file]."""
    key = F.regexp_extract(path, r"([^/]+-\d+)(?:/[^/]*)?$", 1)
    keyed = df.withColumn("frame_key", key).withColumn("partition", F.regexp_extract(path, r"(?:^|/)(p\d+)(?:--[^/]*)?/", 1))
    return keyed.withColumn("scene_id", F.regexp_extract("frame_key", r"^(.*)-\d+$", 1)).withColumn("frame_no", F.nullif(F.regexp_extract("frame_key", r"-(\d+)$", 1), F.lit("")).cast("int"))


def visible(path: Column) -> Column:
    """No part of the path is hidden or marked as done."""
    return ~F.regexp_like(path, F.lit(r"/(?:\.|DONE)[^/]*/"))


def _documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Documents of one file name below a folder; unreadable ones are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    doc = F.from_json("value", F.lit(f"{schema}, _corrupt_record string"), {"mode": "PERMISSIVE"})
    rows = files.where(visible(F.col("_path"))).select(doc.alias("_d"), "_path").where(F.col("_d._corrupt_record").isNull() & F.col("_d").isNotNull()).select("_d.*", "_path")
    return frame_keys(rows, "_path").drop("_corrupt_record", "_path")


def partitions_of(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """(partition, path) of the folders ``p<number>--suffix`` below a root, hidden ones left out, in order of number; names: only these, as ``p<number>``."""
    register(spark)
    found = spark.read.format("framefolders").option("depth", "partition").load(root).select("partition", "path")
    found = found.where(F.col("partition").isin(names)) if names else found
    return found.orderBy(F.substring("partition", 2, 20).cast("long"), "path")


def unreadable(spark: SparkSession, root: str, name: str = "frame.json") -> DataFrame:
    """(frame_key, error) of documents below a folder that can't be read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    bad = files.where(visible(F.col("_path")) & F.try_parse_json("value").isNull())
    return frame_keys(bad, "_path").select("frame_key", F.concat(F.lit("not readable: "), F.substring(F.regexp_replace("value", r"\s+", " "), 1, 80)).alias("error"))


def project_record(raw: DataFrame, payload: str) -> DataFrame:
    """The frame document of a raw record in JSON: known fields only, empty series left out."""
    doc = F.from_json(F.col(payload).cast("string"), f"struct<{FRAME}>")
    full = lambda s: F.struct(*[F.when(F.size(s[c]) > 0, s[c]).alias(c) for c in ("pos_x", "pos_y", "pos_z", "vel_x", "vel_y", "accel_x", "accel_y")])
    rest = [c for c in ("frame_id", "intent", "intent_corrected", "preference_trajectories", "ego_behavior")]
    return raw.withColumn("_d", doc).select(*[F.col(f"_d.{c}").alias(c) for c in rest], *[full(F.col(f"_d.{c}")).alias(c) for c in ("past_states", "future_states")])


def read_frames(spark: SparkSession, root: str, partitions: list[str] | None = None, name: str = "frame.json") -> DataFrame:
    rows = _documents(spark, root, name, FRAME).where("frame_key <> ''")
    return rows.where(F.col("partition").isin(partitions)) if partitions else rows


def read_annotations(spark: SparkSession, root: str, name: str = "panorama_geo.json") -> DataFrame:
    """Annotations with attributes parsed to VARIANT: a value may be a scalar or a list."""
    rows = _documents(spark, root, name, ANNOTATION)
    objects = F.transform("annotations", lambda a: F.struct(a["class"].alias("class"), a["bbox"].alias("bbox"), F.try_parse_json(a["attributes"]).alias("attributes"), a["driving_implication"].alias("driving_implication")))
    return rows.withColumn("objects", objects).drop("annotations")


def attribute(objects_attributes: Column, name: str) -> Column:
    """First element of a list or the scalar itself, trimmed; '' if missing or an empty list."""
    first = F.try_variant_get(objects_attributes, f"$.{name}[0]", "string")
    alone = F.try_variant_get(objects_attributes, f"$.{name}", "string")
    return F.trim(F.coalesce(first, F.when(alone != "[]", alone), F.lit("")))


def read_masks(spark: SparkSession, root: str, name: str = "masks.json") -> DataFrame:
    """One row per mask with its category's name."""
    rows = _documents(spark, root, name, MASKS)
    names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))
    masks = rows.withColumn("names", names).select("frame_key", "names", F.posexplode("annotations").alias("mask_no", "m"))
    return masks.select("frame_key", "mask_no", F.try_element_at("names", F.col("m.category_id")).alias("category"), "m.bbox", "m.segmentation")


def read_bundle(frames: DataFrame, annotations: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with their annotation, and masks where there are any."""
    gathered = masks.groupBy("frame_key").agg(F.sort_array(F.collect_list(F.struct("mask_no", "category", "bbox", "segmentation"))).alias("masks"))
    ann = annotations.drop("partition", "scene_id", "frame_no")
    return frames.join(ann, "frame_key").join(gathered, "frame_key", "left").withColumn("masks", F.coalesce("masks", F.array().cast(dict(gathered.dtypes)["masks"])))


#: The names under which an object may hold its list of ids.
LISTS = ("scenes", "frames", "fdirs", "dev_eval_frames", "online")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON file, in no order: a bare list, or an object with a list of one of the usual names; items are texts or objects with ``fdir``.

    The file is read as VARIANT, so that items of both kinds may stand in one list. A file without
    such a list, or that is no JSON, has no ids.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in LISTS])
    items = text.select(F.explode(listed).alias("item"))
    kind = F.schema_of_variant("item")
    plain = F.when(kind == "STRING", F.try_variant_get("item", "$", "string"))
    return items.select(F.coalesce(plain, F.when(kind.startswith("OBJECT"), F.try_variant_get("item", "$.fdir", "string"))).alias("id")).where("id IS NOT NULL")


def frames_below(spark: SparkSession, root: str, names: tuple[str, ...] = ("frame.json", "panorama_geo.json")) -> DataFrame:
    """Folders below a root that hold every one of some files, hidden ones left out, in order."""
    register(spark)
    found = spark.read.format("framefolders").load(root)
    return found.where(F.size(F.array_except(F.array(*[F.lit(n) for n in names]), "files")) == 0).select(F.col("path").alias("id")).orderBy("id")


def read_frame_list(spark: SparkSession, spec: str, named: dict[str, str] | None = None, names: tuple[str, ...] = ("frame.json", "panorama_geo.json")) -> DataFrame:
    """Ids of a frame list: the name of a known one, a folder of frames, or a file with a list, an object of lists, or a list of objects."""
    spec = (named or {}).get(spec, spec)
    return read_id_list(spark, spec) if spec.lower().endswith(".json") else frames_below(spark, spec, names)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(camera, intrinsic, extrinsic) of an object by camera; an extrinsic is a list or holds one as ``transform``."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("camera", "v"))
    numbers = lambda p: F.from_json(F.get_json_object("v", p), "array<double>")
    return entries.select("camera", numbers("$.intrinsic").alias("intrinsic"), F.coalesce(numbers("$.extrinsic.transform"), numbers("$.extrinsic")).alias("extrinsic"))


def read_rated_index(spark: SparkSession, path: str) -> DataFrame:
    """scene_id, frame_id, partition by lines; an empty table if the file is missing."""
    schema = "scene_id string, frame_id string, partition string"
    try:
        return spark.read.schema(schema).json(path)
    except Exception as error:  # noqa: BLE001 - only a missing path
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, cluster) of an object whose values are a name or hold ``scenario_cluster``."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("scene_id", "v"))
    return entries.select("scene_id", F.coalesce(F.get_json_object("v", "$.scenario_cluster"), "v").alias("cluster"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, frame_id, pred_xy) of a plain list, or of ``results`` with ids split from the right."""
    text = spark.read.text(path, wholetext=True)
    point = "array<array<double>>"
    plain = F.from_json("value", f"array<struct<scene_id:string,frame_id:string,pred_xy:{point}>>")
    official = F.from_json("value", f"struct<results:array<struct<id:string,pred_xy:{point},pred_traj_xy:{point}>>>")["results"]
    is_list = F.ltrim("value").startswith("[")
    a = text.where(is_list).select(F.inline(plain))
    b = text.where(~is_list).select(F.inline(official)).select(F.regexp_extract("id", r"^(.*)-[^-]*$", 1).alias("scene_id"), F.regexp_extract("id", r"([^-]*)$", 1).alias("frame_id"), F.coalesce("pred_xy", "pred_traj_xy").alias("pred_xy"))
    return a.unionByName(b)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:/*", "file:///", uri if uri.startswith("file:") else f"file://{uri}"))


class _Shard(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.shards: set[str] | None = None

    def _number(self, name: str) -> int:
        return int(self.options.get(name.lower(), "0") or 0)

    def partitions(self) -> list[_Shard]:
        """One partition per shard, in order of name; ``maxShards`` keeps the first ones."""
        from pyarrow import fs

        store, root = _store(self.options["path"])
        info = store.get_file_info(root)
        found = [root] if info.type == fs.FileType.File else sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File)
        found = [p for p in found if not p.rpartition("/")[2].startswith((".", "_"))]
        found = found[: self._number("maxShards")] if self._number("maxShards") else found
        return [_Shard(p) for p in found if self.shards is None or p.rpartition("/")[2] in self.shards]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        """Records of a shard: 8 bytes length, 4 checksum, payload, 4 checksum; a cut-off end is left out."""
        on_bad, field = self.options.get("checksum", "raise").lower(), self.options.get("scenefield")
        if on_bad not in ("raise", "flag", "ignore"):
            raise ValueError("checksum must be raise, flag or ignore")
        most_rows, most_scenes, scenes = self._number("maxRecords"), self._number("maxScenes"), set()
        if most_scenes and not field:
            raise ValueError("maxScenes needs sceneField, the name of the payload's JSON field that tells the scene")
        name = partition.path.rpartition("/")[2]
        store, _ = _store(self.options["path"])
        with store.open_input_stream(partition.path) as source:
            n = 0
            while len(head := source.read(12)) == 12 and not (most_rows and n >= most_rows):
                size, crc = struct.unpack("<QI", head)
                if on_bad != "ignore" and masked(crc32c(head[:8])) != crc:
                    # the length can't be trusted, so nothing after it can be found
                    if on_bad == "raise":
                        raise ValueError(f"length of record {n} of {name} fails its checksum")
                    yield name, n, None, False
                    return
                data, tail = source.read(size), source.read(4)
                if len(data) < size or len(tail) < 4:
                    return
                good = on_bad == "ignore" or masked(crc32c(data)) == struct.unpack("<I", tail)[0]
                if not good and on_bad == "raise":
                    raise ValueError(f"record {n} of {name} fails its checksum")
                if most_scenes and good:
                    scenes.add(json.loads(data).get(field))
                    if len(scenes) > most_scenes:
                        return
                yield name, n, data, good
                n += 1


class _PushingReader(RecordFileReader):
    def pushFilters(self, filters):
        """Equality of the shard's name chooses files before any is opened; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("shard",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = names if self.shards is None else self.shards & names
            else:
                yield f


class RecordFile(DataSource):
    """``spark.read.format("recordfile")``: length-framed record shards as (shard, record_no, payload, valid).

    Options: ``checksum`` – raise (default), flag (valid is false; after a bad length the shard ends) or
    ignore; ``maxShards`` – the first shards by name; ``maxRecords`` – the first records of each shard;
    ``maxScenes`` with ``sceneField`` – a shard's scan ends where scenes beyond that number begin;
    ``pushFilters`` – filters on ``shard`` open those files alone, for which Spark asks that
    spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def schema(self) -> str:
        return "shard string, record_no long, payload binary, valid boolean"

    def reader(self, schema) -> RecordFileReader:
        pushes = self.options.get("pushFilters", "false").lower() == "true"
        return (_PushingReader if pushes else RecordFileReader)(dict(self.options))


def first_scenes(records: DataFrame, scene: Column, n: int) -> DataFrame:
    """Records of the first n scenes by the place of their first record (shard, record_no); n rows at most reach the driver."""
    rows = records.withColumn("_scene", scene)
    first = rows.groupBy("_scene").agg(F.min(F.struct("shard", "record_no")).alias("_at")).orderBy("_at").limit(n)
    return rows.join(F.broadcast(first.select("_scene")), "_scene", "left_semi").drop("_scene") if n <= 100_000 else rows.join(first.select("_scene"), "_scene", "left_semi").drop("_scene")


class _Folder(InputPartition):
    def __init__(self, path: str, partition: str | None):
        self.path, self.partition = path, partition


class FrameFoldersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _list(self, store, path: str) -> tuple[list[str], list[str]]:
        """(folders, names of files) right below a folder, hidden and finished ones left out, in order."""
        from pyarrow import fs

        found = sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)
        dirs = [x.path for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "DONE"))]
        return dirs, [x.base_name for x in found if x.type == fs.FileType.File]

    def partitions(self) -> list[_Folder]:
        """One partition per ``p<number>--suffix`` folder; where there are none, one per folder below the root."""
        store, root = _store(self.options["path"])
        dirs, _ = self._list(store, root.rstrip("/"))
        named = [(d, re.fullmatch(r"(p\d+)--.+", d.rpartition("/")[2])) for d in dirs]
        some = [_Folder(d, m[1]) for d, m in named if m]
        return some or [_Folder(d, None) for d in dirs] or [_Folder(root, None)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        store, _ = _store(self.options["path"])
        if self.options.get("depth") == "partition":
            if partition.partition:
                yield partition.partition, None, None, partition.path, []
            return
        todo = [partition.path]
        while todo:
            path = todo.pop()
            dirs, files = self._list(store, path)
            todo += reversed(dirs)
            name = path.rpartition("/")[2]
            key = re.fullmatch(r"(.+)-\d+", name)
            if files:
                yield partition.partition, key and key[1], key and name, path, files


class FrameFolders(DataSource):
    """``spark.read.format("framefolders")``: folders that hold files as (partition, scene_id, frame_key, path, files).

    The driver lists one level; each partition folder is walked by a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "framefolders"

    def schema(self) -> str:
        return "partition string, scene_id string, frame_key string, path string, files array<string>"

    def reader(self, schema) -> FrameFoldersReader:
        return FrameFoldersReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordFile)
    spark.dataSource.register(FrameFolders)
