"""Connectors: where raw documents come from.

A connector lists URIs and reads them as one DataFrame (uri, content, media_type,
external_url, error); a document that can't be read has a null content and an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol, runtime_checkable
from urllib.parse import quote, unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.errors import IngestionError
from tessera.functions import media
from tessera.operators.shared import lean

PER_TASK = 64
#: Tasks that fetch files, for each core; with more files a task has more of them.
TASKS_PER_CORE = 16
#: Characters of files that a worker hands on at once.
OUT_CHARS = 2 << 20
RAW = "uri string, content string, media_type string, external_url string, error string"


@runtime_checkable
class Connector(Protocol):
    def list_sources(self) -> list[str]: ...

    def read(self, spark: SparkSession) -> DataFrame: ...


def canonical_path(path: str | os.PathLike) -> str:
    """Absolute POSIX path without symbolic links."""
    return Path(path).resolve().as_posix()


def file_uri(path: str | os.PathLike) -> str:
    return "file://" + quote(canonical_path(path), safe=":/")


def uri_path(uri: str) -> str:
    """The local path of a file URI."""
    parsed = urlparse(uri)
    if parsed.scheme != "file":
        raise IngestionError(f"not a file URI: {uri}")
    return unquote(parsed.path)


class FilesystemConnector:
    """Files under a folder that match any of the patterns.

    Types are known by extension, so binary files are never opened.  Contents are read and
    decoded by the executors; bytes that aren't UTF-8 give an error.  ``base_url`` maps
    files to public addresses, without showing the local path.
    """

    def __init__(self, root: str, patterns: tuple[str, ...] = ("**/*",), base_url: str | None = None):
        self.root, self.patterns, self.base_url = canonical_path(root), tuple(patterns), base_url

    def _paths(self) -> set[str]:
        """The files as they are found; links aren't followed to what they stand for."""
        if not Path(self.root).is_dir():
            raise IngestionError(f"no such folder: {self.root}")
        return {str(p) for pattern in self.patterns for p in Path(self.root).glob(pattern) if p.is_file()}

    def list_sources(self) -> list[str]:
        return sorted({file_uri(p) for p in self._paths()})

    def external_url(self, uri: str) -> str | None:
        if self.base_url is None:
            return None
        path = Path(canonical_path(uri_path(uri)))
        inside = path.is_relative_to(self.root)
        return self.base_url.rstrip("/") + "/" + quote(path.relative_to(self.root).as_posix() if inside else path.name)

    def read(self, spark: SparkSession) -> DataFrame:
        found = sorted(self._paths())
        tasks = max(1, min(-(-len(found) // PER_TASK), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
        paths = spark.createDataFrame(pa.table({"path": pa.array(found, pa.string())})).repartition(tasks)

        def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                uris = [file_uri(p) for p in batch["path"]]
                yield pd.DataFrame({"uri": uris, "path": [uri_path(u) for u in uris], "external_url": [self.external_url(u) for u in uris]})

        # links to one file are one source
        known = paths.mapInPandas(lean(paths, name), "uri string, path string, external_url string").dropDuplicates(["uri"])
        typed = known.withColumn("media_type", media.media_type(F.col("uri"))).withColumn("error", F.when(~media.is_text(F.col("media_type")), F.concat(F.lit("not a text type: "), "media_type")))

        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                names, begun, got, chars = batch[["uri", "external_url", "media_type"]], 0, [], 0
                for path, error in zip(batch["path"], batch["error"]):
                    got.append((None, error) if error is not None else _text_of(path))
                    chars += len(got[-1][0] or "")
                    if chars > OUT_CHARS or begun + len(got) == len(batch):
                        yield names.iloc[begun : begun + len(got)].assign(content=[c for c, _ in got], error=[e for _, e in got])
                        begun, got, chars = begun + len(got), [], 0

        read = typed.repartition(tasks).mapInPandas(lean(typed, fetch), "uri string, external_url string, media_type string, content string, error string")
        return read.select("uri", "content", "media_type", "external_url", "error")


def _text_of(path: str) -> tuple[str | None, str | None]:
    """(text, None) of a file, or (None, why not)."""
    try:
        return Path(path).read_bytes().decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "not valid UTF-8"
    except OSError as e:
        return None, f"can't be read: {e}"


class MemoryConnector:
    """Documents given as a mapping from URI to text."""

    DEFAULT = {"memory://welcome": "# Welcome\n\nA first document.", "memory://guide": "# Guide\n\n## Install\n\nRun the installer.\n"}

    def __init__(self, documents: dict[str, str] | None = None):
        self.documents = dict(self.DEFAULT if documents is None else documents)

    def list_sources(self) -> list[str]:
        return sorted(self.documents)

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(sorted(self.documents.items()), "uri string, content string")
        kind = media.media_type(F.col("uri"))
        return rows.select("uri", "content", F.when(kind == media.BINARY, F.lit("text/plain")).otherwise(kind).alias("media_type"), F.lit(None).cast("string").alias("external_url"), F.lit(None).cast("string").alias("error"))


class TableConnector:
    """Documents in a table; nothing is collected but on ``list_sources``."""

    def __init__(self, table: DataFrame, uri: str, text: str, media_type: str = "text/markdown"):
        self.table, self.uri, self.text, self.media_type = table, uri, text, media_type

    def list_sources(self) -> list[str]:
        return sorted(r[0] for r in self.read(self.table.sparkSession).select("uri").distinct().collect())

    def read(self, spark: SparkSession) -> DataFrame:
        none = F.lit(None).cast("string")
        content = F.expr(self.text).cast("string")
        return self.table.select(F.expr(self.uri).cast("string").alias("uri"), content.alias("content"), F.lit(self.media_type).alias("media_type"), none.alias("external_url"), F.when(content.isNull(), F.lit("no content")).alias("error"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.connector = FilesystemConnector(options["path"], tuple(options.get("patterns", "**/*").split(",")))
        self.per_task = int(options.get("filespertask", PER_TASK))

    def partitions(self) -> list[InputPartition]:
        paths = [uri_path(u) for u in self.connector.list_sources()]
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Files([])]

    def read(self, partition: _Files):  # noqa: ANN201
        for path in partition.paths:
            yield (file_uri(path), *_text_of(path))


class DocumentSource(DataSource):
    """``spark.read.format("documents").load(folder)``: (uri, content, error) of text files."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "uri string, content string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _DocumentReader(self.options)


def canonical_url(url: pd.Series) -> pd.Series:
    """Extension: web addresses with scheme and host in lower case, without fragment and tracking parameters."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    def one(u: str | None) -> str | None:
        if u is None:
            return None
        s = urlsplit(u)
        kept = [(k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in {"fbclid", "gclid"}]
        return urlunsplit((s.scheme.lower(), s.netloc.lower(), s.path or "/", urlencode(kept), ""))

    return url.map(one)
