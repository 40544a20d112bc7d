"""Members of zip archives as a data source: the directories are read first, then ranges of members in parallel."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, text string"


def opened(path: str) -> zipfile.ZipFile:
    """An archive of any store that Arrow reads (local paths, file, hdfs, s3, ...), with random access."""
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    files, name = pyarrow.fs.FileSystem.from_uri(local)
    return zipfile.ZipFile(pa.PythonFile(files.open_input_file(name), mode="r"))


@dataclass
class MemberRange(InputPartition):
    archive: str
    members: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, archives: Sequence[str], suffix: str, most: int):
        self.archives, self.suffix, self.most = archives, suffix, most

    def partitions(self) -> list[MemberRange]:
        """Members of an archive in the order of their names, cut where a range holds `most` bytes of text."""
        out = []
        for archive in self.archives:
            with opened(archive) as z:
                size, names = 0, []
                for member in sorted((m for m in z.infolist() if m.filename.endswith(self.suffix) and not m.is_dir()), key=lambda m: m.filename):
                    if names and size + member.file_size > self.most:
                        out.append(MemberRange(archive, names))
                        size, names = 0, []
                    names.append(member.filename)
                    size += member.file_size
                if names:
                    out.append(MemberRange(archive, names))
        return out or [MemberRange("", [])]

    def read(self, partition: MemberRange) -> Iterator[tuple[str, str, str]]:
        if partition.members:
            with opened(partition.archive) as z:
                for name in partition.members:
                    yield partition.archive, name, z.read(name).decode("utf-8", "replace")


class ZipSource(DataSource):
    """format("lexi_zip"): options archives (JSON list of paths), suffix, bytes (of text in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "lexi_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(json.loads(self.options["archives"]), self.options.get("suffix", ".xml"), int(self.options.get("bytes", 16 << 20)))


def zip_members(spark: SparkSession, archives: Sequence[str], suffix: str = ".xml", most: int = 16 << 20) -> DataFrame:
    """(archive, member, text), in partitions of at most so many bytes of text or one member."""
    spark.dataSource.register(ZipSource)
    return spark.read.format("lexi_zip").option("archives", json.dumps(list(archives))).option("suffix", suffix).option("bytes", most).load()
