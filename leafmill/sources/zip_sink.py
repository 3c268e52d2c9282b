"""Archives as a sink: df.write.format("leaf_zip").mode("append").save(folder), one ZIP for each document."""

from __future__ import annotations

import os
import shutil
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from leafmill.functions.notices import messages
from leafmill.sources.sinks import html_file


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ZipWriter(DataSourceWriter):
    """Tasks write archives to a folder of the job's own; a commit moves them to their names, an abort removes it, with what killed tasks left."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.job = os.path.join(folder, f".{uuid.uuid4().hex}")
        os.makedirs(self.job)  # on the driver; a task that starts after an abort finds it gone and fails

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        made: list[tuple[str, str]] = []
        out, last, paths = None, None, set()
        try:
            for row in iterator:
                if out is None or row["archive"] != last:
                    if out is not None:
                        out.close()
                    last, paths = row["archive"], set()
                    made.append((os.path.join(self.job, uuid.uuid4().hex), os.path.join(self.folder, last)))
                    out = zipfile.ZipFile(made[-1][0], "x", zipfile.ZIP_DEFLATED)
                if row["path"] not in paths:
                    out.writestr(zipfile.ZipInfo(row["path"]), bytes(row["content"] or b""), zipfile.ZIP_DEFLATED)
                    paths.add(row["path"])
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            raise
        return _Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and (there := [to for _, to in done if os.path.exists(to)]):
            shutil.rmtree(self.job, ignore_errors=True)
            raise FileExistsError(f"{there[0]} exists; use mode overwrite")
        for part, to in done:
            os.replace(part, to)
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for _ in range(20):  # tasks that are not yet killed may still add to it
            shutil.rmtree(self.job, ignore_errors=True)
            if not os.path.exists(self.job):
                break
            time.sleep(0.1)


class ZipSink(DataSource):
    """Rows (archive string, path string, content binary): entries of archives; of equal paths the first is kept.

    Rows of an archive must come together in one partition, as entries() deals them. The folder has to be one that
    driver and executors share. Archives appear when all tasks have ended; a failed job leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "leaf_zip"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ZipWriter(self.options["path"].removeprefix("file://").removeprefix("file:"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSink)


def entries(imported: dict[str, DataFrame], key: str, names: DataFrame) -> DataFrame:
    """(archive, path, content) of what an importer gives, for names(key, name): pages, their metadata beside them, resources.

    Pages start with a mark of UTF-8. A document without pages gets a note with its warnings or error. Rows are dealt
    by archive, the first of equal paths first.
    """
    page = imported["pages"].select(key, "path", html_file(F.col("html")).alias("content"), F.lit(0).alias("rank"))
    told = F.to_json(F.struct(F.col("title").alias("name"), "path", "metadata"), {"pretty": "true"})
    beside = imported["pages"].select(key, F.concat(F.regexp_replace("path", r"(?i)\.html\z", ""), F.lit(".metadata.json")).alias("path"), F.encode(F.concat(told, F.lit("\n")), "UTF-8").alias("content"), F.lit(1).alias("rank"))
    rows = page.unionByName(beside)
    if "resources" in imported:
        rows = rows.unionByName(imported["resources"].where("octet_length(file) > 0").select(key, "path", F.col("file").alias("content"), F.lit(2).alias("rank")))
    bare = imported["notices"].join(imported["pages"].select(key).distinct(), key, "left_anti")
    said = F.concat_ws("\n", F.lit("No pages were found."), F.lit(""), F.coalesce(messages(F.col("notices")), F.array().cast("array<string>")), "error")
    rows = rows.unionByName(bare.select(key, F.lit("README.txt").alias("path"), F.encode(said, "UTF-8").alias("content"), F.lit(3).alias("rank")))
    named = rows.join(names.select(key, F.concat(F.col("name"), F.lit("_converted.zip")).alias("archive")), key)
    return named.repartition("archive").sortWithinPartitions("archive", "rank", "path").select("archive", "path", "content")
