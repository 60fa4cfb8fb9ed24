"""Tabular sources and sinks.

Bulk CSV ingestion: a splittable scan of the lines as bytes tests each encoding and the quotes on all
of a file, keeps its first bytes to sniff the delimiter and its header line; files are then read
by ONE ``spark.read.csv`` per (encoding, delimiter, header) group and combined with
``unionByName``.
"""

from __future__ import annotations

import codecs
import csv
import json
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdin.session import ship_package

# Encodings and delimiters tried in order, and the sniffed size.
CSV_ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")
CSV_DELIMITERS = (None, ";", ",", "\t", "|")
SNIFF_BYTES = 8192   # fixed: the delimiter is sniffed from this much of a file
SPARK_ENCODING = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1251": "windows-1251", "latin-1": "ISO-8859-1"}

PROBE_SCHEMA = "path string, encoding string, sep string, header string, multiline boolean"


def _decodes(content: bytes, encoding: str) -> bool:
    try:
        codecs.decode(content, encoding)
    except UnicodeDecodeError:
        return False
    return True


def _sniffed(sample: str) -> str:
    """The delimiter of the sample, else of its first line, else the first candidate."""
    for text in (sample, sample.split("\n", 1)[0]):
        try:
            return csv.Sniffer().sniff(text, delimiters=";,|\t").delimiter
        except csv.Error:
            continue
    return next(d for d in CSV_DELIMITERS if d is not None)


def probe_lines(batches):
    """Of lines as bytes (file, start of the split, value): a row for each file of a batch with the encodings
    that decode its lines, whether one has an odd number of quotes and, in a task's first batch of a
    file's start, the header line and the first bytes."""
    seen, head = None, 0
    for pdf in batches:
        rows = []
        for (file, start), part in pdf.groupby(["file", "start"], sort=False):
            lines = [bytes(v) for v in part["value"]]
            text = b"\n".join(lines) + b"\n"
            fits = [_decodes(text, e) for e in CSV_ENCODINGS]
            first, sample = None, None
            if start == 0 and seen != file:
                seen, head, first = file, 0, lines[0]
            if start == 0 and head < SNIFF_BYTES:
                sample = text[:SNIFF_BYTES - head]
            rows.append((file, fits, b'"' in text and any(line.count(b'"') % 2 for line in lines), first, head if sample else None, sample))
            head += len(text) if start == 0 else 0
        yield pd.DataFrame(rows, columns=["file", "fits", "odd", "first", "place", "sample"])


def probe_csv(spark: SparkSession, location: str, glob: str = "*.csv") -> DataFrame:
    """S1 probe table: one row per file that is not empty.  No encoding has a line feed inside a character,
    so the first encoding that decodes every line decodes the file."""
    ship_package(spark)

    def decide(batches):
        for pdf in batches:
            rows = []
            for path, fits, odd, first, sample in pdf.itertuples(index=False):
                encoding = next((e for e, f in zip(CSV_ENCODINGS, fits) if f), CSV_ENCODINGS[-1])
                header = bytes(first).decode(encoding, errors="replace").lstrip("\ufeff").rstrip("\r")
                rows.append((path, encoding, _sniffed(bytes(sample).decode("utf-8", errors="ignore")), header, bool(odd)))
            yield pd.DataFrame(rows, columns=["path", "encoding", "sep", "header", "multiline"])

    # without its content, a file of any size is listed
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(location).select("path", F.col("_metadata.file_path").alias("file"))
    lines = (spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(location)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")))
    found = lines.mapInPandas(probe_lines, "file string, fits array<boolean>, odd boolean, first binary, place long, sample binary")
    empty = F.lit(b"")
    verdicts = found.groupBy("file").agg(
        F.array(*[F.min(F.col("fits")[i]) for i in range(len(CSV_ENCODINGS))]).alias("fits"), F.max("odd").alias("odd"), F.max("first").alias("first"),
        F.sort_array(F.collect_list(F.when(F.col("sample").isNotNull(), F.struct("place", "sample")))).alias("samples"))
    sample = F.aggregate("samples", empty, lambda a, x: F.concat(a, x["sample"]))
    return files.join(verdicts, "file", "left").select(
        "path", F.coalesce("fits", F.array(*[F.lit(True)] * len(CSV_ENCODINGS))).alias("fits"), F.coalesce("odd", F.lit(False)).alias("odd"),
        F.coalesce("first", empty).alias("first"), F.coalesce(sample, empty).alias("sample")).mapInPandas(decide, schema=PROBE_SCHEMA)


def _source_name() -> Column:
    """The file's name; for a part of a folder that Spark wrote, the folder's."""
    parts = F.split(F.input_file_name(), "/")
    written = F.element_at(parts, -1).rlike(r"^part-\d{5}-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
    return F.when(written, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))


def read_csv_collection(spark: SparkSession, location: str, glob: str = "*.csv", infer: bool = True) -> DataFrame:
    """S1 + S9: read every CSV under ``location``; ``_source`` names the file.  Files that share
    encoding, delimiter and header line are one scan with that header's schema; scans are united by
    column name.  Quotes inside quoted fields are doubled; files with line breaks inside fields are read
    whole.  A column that is not of one type in all files gets the type that holds all its values (``merge.unify_types``).
    The file list, which Spark holds in the driver anyway, plans the scans."""
    kinds = ["encoding", "sep", "header", "multiline"]
    groups = probe_csv(spark, location, glob).groupBy(*kinds).agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    if not groups:
        raise ValueError(f"no CSV files under {location}")
    if any(SPARK_ENCODING[g["encoding"]] not in ("UTF-8", "ISO-8859-1") for g in groups):
        # Spark 4 accepts only a few charsets for CSV unless Java charsets are allowed
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    frames = []
    for g in sorted(groups, key=lambda r: tuple(r[k] for k in kinds)):
        reader = (spark.read.option("header", True).option("sep", g["sep"]).option("escape", '"')
                  .option("encoding", SPARK_ENCODING[g["encoding"]]).option("inferSchema", infer).option("mode", "PERMISSIVE"))
        if g["multiline"]:
            reader = reader.option("multiLine", True)
        frames.append(reader.csv(list(g["paths"])).withColumn("_source", _source_name()))
    from verdin.operators.merge import unify_types
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), unify_types(frames))


def normalize_frame(df: DataFrame) -> DataFrame:
    """Drop all-null rows, then all-null columns (one aggregate), strip BOM and
    whitespace from names, blank names → ``column_{i}``."""
    rows = df.na.drop(how="all")
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(rows.columns)]).first()
    keep = [c for i, c in enumerate(rows.columns) if counts[f"c{i}"] > 0]
    names = []
    for i, c in enumerate(keep, start=1):
        n = c.replace("\ufeff", "").strip()
        names.append(n or f"column_{i}")
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])


def frame_from_records(spark: SparkSession, records: Sequence[dict], schema: str | T.StructType | None = None) -> DataFrame:
    """Inline records to a table; an empty list is an error."""
    if not records:
        raise ValueError("no records given")
    return spark.createDataFrame(list(records), schema=schema) if schema else spark.createDataFrame(
        pd.DataFrame.from_records(list(records)))


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    """S3: dispatch by extension (csv with probing; parquet/json natively; Excel is not built)."""
    low = path.lower()
    if low.endswith(".csv"):
        import os
        return read_csv_collection(spark, os.path.dirname(path) or ".", os.path.basename(path)).drop("_source")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".json"):
        return spark.read.json(path)
    if low.endswith((".xlsx", ".xls")):
        raise ValueError("Excel files are not supported; convert to CSV or Parquet upstream.")
    raise ValueError(f"Unsupported file type: {path}")


def json_safe(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN → null, timestamps/dates as ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType.typeName()
        if t in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif t in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif t == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols)).alias("record"))


# ---------------------------------------------------------------------------
# Snapshots, model bundles and the dataset registry


def dataset_path(root: str, project_id: str | None = None, version_id: str | None = None) -> str:
    base = f"{root.rstrip('/')}/datasets"
    if project_id is None:
        return base
    p = f"{base}/project_id={project_id}"
    return p if version_id is None else f"{p}/version_id={version_id}"


def save_dataset(df: DataFrame, root: str, project_id: str, version_id: str) -> str:
    """S5 write: Parquet snapshot under project_id=/version_id= partitions (types kept)."""
    path = dataset_path(root, project_id, version_id)
    df.write.mode("overwrite").parquet(path)
    return path


def load_dataset(spark: SparkSession, root: str, project_id: str, version_id: str) -> DataFrame:
    """S5 read: the version's own folder, so that each version keeps its own schema."""
    return spark.read.parquet(dataset_path(root, project_id, version_id))


def delete_path(spark: SparkSession, path: str) -> bool:
    """S5 delete through the Hadoop FileSystem of the path (works for any Hadoop FS)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(p, True))


def save_model_bundle(spark: SparkSession, model, path: str) -> str:
    """Pipeline (or the members of a blend) + projector via Spark ML writers, training record as JSON."""
    if hasattr(model.pipeline, "members"):
        model.pipeline.save(spark, f"{path}/pipeline")
    else:
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.projector.write().overwrite().save(f"{path}/projector")
    spark.createDataFrame([(json.dumps(model.record(), default=str),)], "record string") \
        .write.mode("overwrite").json(f"{path}/record")
    return path


def load_model_bundle(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    from verdin.operators.ml import TabularModel, TemporalProjector
    from verdin.operators.search import Blend
    rec = json.loads(spark.read.json(f"{path}/record").first()["record"])
    pipeline = Blend.load(spark, f"{path}/pipeline") if rec.get("composition") else PipelineModel.load(f"{path}/pipeline")
    return TabularModel(pipeline, rec["task_type"], rec["target"], rec["features"],
                        rec["numeric"], rec["categorical"], rec["classes"], TemporalProjector.load(f"{path}/projector"),
                        rec["metrics"], rec["importances"], rec["backend"], rec["warnings"], rec.get("composition") or {})


def write_holdout(holdout: DataFrame, path: str) -> None:
    """Holdout predictions (actual, prediction, confidence) as Parquet."""
    holdout.write.mode("overwrite").parquet(path)


DATASET_VERSION_SCHEMA = ("project_id string, version_id string, name string, target string, rows long, "
                          "columns int, schema_json string, unit string, created_at timestamp_ntz")


def register_dataset_version(spark: SparkSession, root: str, df: DataFrame, project_id: str, version_id: str,
                             target: str | None, name: str | None = None, unit: str | None = None) -> DataFrame:
    """Append one metadata row (schema from ``df.schema``, row count from one job)."""
    import datetime as dt
    row = (project_id, version_id, name, target, df.count(), len(df.columns), df.schema.json(), unit,
           dt.datetime.now(dt.UTC).replace(microsecond=0, tzinfo=None))
    rec = spark.createDataFrame([row], DATASET_VERSION_SCHEMA)
    rec.write.mode("append").partitionBy("project_id").parquet(f"{root.rstrip('/')}/dataset_versions")
    return rec


def ingest(spark: SparkSession, location: str, target: str | None = None, glob: str = "*.csv") -> DataFrame:
    """Read one or many files (S1/S9), normalize (S4); several sources are merged on
    their inferred time axis (J5) with rows lacking the target dropped."""
    raw = read_csv_collection(spark, location, glob)
    sources = [r["_source"] for r in raw.select("_source").distinct().orderBy("_source").collect()]
    if len(sources) <= 1:
        return normalize_frame(raw.drop("_source"))
    from verdin.operators.merge import merge_on_time
    from verdin.plans.timeseries import prepare_for_merge
    frames = []
    for s in sources:
        part = normalize_frame(raw.filter(F.col("_source") == s).drop("_source"))
        part = part.withColumn("_ord", F.monotonically_increasing_id())
        frames.append((s, prepare_for_merge(part, "_ord")))
    return merge_on_time(frames, "timestamp", target)
