"""Files in and out: discovery, routing, output names, writing, audit."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirestream.config import DEFAULT, Config
from quirestream.operators.guards import extension_of, format_of


def discover(spark: SparkSession, path: str, *, recursive: bool = False, config: Config = DEFAULT) -> DataFrame:
    """Files of a folder with a supported extension (path, length, content, ...); a single
    file is taken as it is. ``content`` is read only where something asks for it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if _is_file(spark, path):
        return found
    return found.where(extension_of(F.col("path")).isin(list(config.supported_extensions)))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def route(files: DataFrame, path: Column) -> DataFrame:
    """``files`` with extension and format (null: nothing reads it)."""
    extension = extension_of(path)
    return files.withColumn("extension", extension).withColumn("format", format_of(extension))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def output_names(files: DataFrame, path: Column) -> DataFrame:
    """``files`` with output (flat: <stem>.md) and collision (a name that was given before)."""
    named = files.withColumn("output", F.concat(stem_of(path), F.lit(".md")))
    return named.withColumn("collision", F.row_number().over(Window.partitionBy("output").orderBy(path)) > 1)


def beside(path: Column, root: str) -> Column:
    """The output of a file that stays in its folder: its path below ``root``, ending in .md."""
    below = F.substring(path, F.locate(root.rstrip("/") + "/", path) + F.lit(len(root.rstrip("/")) + 1), F.length(path))
    return F.concat(F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", ""), F.lit(".md"))


def write_markdown(done: DataFrame, folder: str, *, overwrite: bool = False) -> DataFrame:
    """Write output (a path in ``folder``) and markdown as one UTF-8 file each; returns output
    and status (written or skipped). Files that are there stay unless ``overwrite``. Of rows
    with one output the first by path is written, the last with ``overwrite``; the others
    are skipped. A task that runs again finds its own files: they are written beside and renamed."""
    spark = done.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    if "path" in done.columns:
        order = F.col("path").desc() if overwrite else F.col("path").asc()
        named = done.withColumn("turn", F.row_number().over(Window.partitionBy("output").orderBy(order)))
    else:
        named = done.withColumn("turn", F.lit(1))
    named = named.select("output", "markdown", "turn")
    fresh, skipped = named.where("turn = 1"), named.where("turn > 1")
    if not overwrite:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(beside_name(F.col("path"), folder).alias("output"))
        skipped = skipped.unionByName(fresh.join(held, "output", "left_semi"))
        fresh = fresh.join(held, "output", "left_anti")
    fresh = fresh.select("output", "markdown")
    written = _save_far(fresh, folder, fs) if "://" in folder.removeprefix("file://") else _save(fresh, folder.removeprefix("file://"))
    return written.unionByName(skipped.select("output", F.lit("skipped").alias("status")))


def beside_name(path: Column, root: str) -> Column:
    """A path below ``root``, whatever scheme stands before it."""
    name = root.removeprefix("file://").rstrip("/") + "/"
    return F.substring(path, F.locate(name, path) + F.lit(len(name)), F.length(path))


def _save(files: DataFrame, folder: str) -> DataFrame:
    """Files in a folder that all executors mount."""

    def save(batches: Iterator) -> Iterator:
        for b in batches:
            for name, text in zip(b["output"], b["markdown"], strict=True):
                place, last = os.path.split(os.path.join(folder, name))
                os.makedirs(place, exist_ok=True)
                part = os.path.join(place, f".{last}.{os.getpid()}")
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(part, os.path.join(place, last))
            yield b[["output"]].assign(status="written")

    return files.mapInPandas(save, "output string, status string")


def _save_far(files: DataFrame, folder: str, fs) -> DataFrame:
    """Files in a store that only Spark writes to: executors write a folder for each, whose
    one part is then renamed. Markdown ends its last line, which the writer does, too."""
    spark, jvm = files.sparkSession, files.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path
    root = path(folder.rstrip("/"))
    work = path(root, f"_quirestream-{uuid.uuid4().hex}")
    named = files.select("output", F.regexp_replace("markdown", r"\n\z", "").alias("value")).persist()
    try:
        named.repartition("output").write.option("lineSep", "\n").partitionBy("output").text(work.toString())
        for status in fs.listStatus(work):
            place = status.getPath()
            if status.isDirectory() and place.getName().startswith("output="):
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(place.getName()[7:])
                target = path(root, name)
                fs.mkdirs(target.getParent())
                fs.delete(target, False)
                for part in fs.listStatus(place):
                    fs.rename(part.getPath(), target)
        return spark.createDataFrame(named.select("output", F.lit("written").alias("status")).toPandas(), "output string, status string")  # one name a file
    finally:
        fs.delete(work, True)
        named.unpersist()


def zip_requests(done: DataFrame, request: str) -> DataFrame:
    """One ZIP per request (columns: request, output, markdown, error_code): its documents in
    the order of ``output``, equal names as they are. A request with a failure gets no ZIP
    but the first failure's code. One group is one request, whose size the limits bound."""

    def pack(files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("output", kind="stable")
        bad = files["error_code"].dropna()
        data = None
        if bad.empty:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in zip(files["output"], files["markdown"], strict=True):
                    z.writestr(zipfile.ZipInfo(name), text)
            data = out.getvalue()
        return pd.DataFrame([(files[request].iloc[0], data, None if bad.empty else bad.iloc[0])], columns=[request, "zip", "error_code"])

    kind = dict(done.dtypes)[request]
    return done.select(request, "output", "markdown", "error_code").groupBy(request).applyInPandas(pack, f"{request} {kind}, zip binary, error_code string")


def audit(done: DataFrame) -> DataFrame:
    """One JSON line a conversion: metadata only, never content."""
    record = F.struct(
        F.col("timestamp").cast("string").alias("timestamp"), F.col("format").alias("format_origen"), F.col("length").alias("tamano_bytes"), F.col("duration_ms").alias("duracion_ms"),
        F.when(F.col("error_code").isNull(), "ok").otherwise("error").alias("resultado"), F.col("error_code").alias("codigo_error"), F.col("error_layer").alias("capa"),
    )
    return done.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))


def exit_code(done: DataFrame) -> int:
    """0: something was converted or nothing failed; 1: no input; 2: all failed."""
    ok, failed = done.agg(F.count_if(F.col("error_code").isNull()), F.count_if(F.col("error_code").isNotNull())).first()
    return 1 if ok + failed == 0 else 2 if ok == 0 else 0
