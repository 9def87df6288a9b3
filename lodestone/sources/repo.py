"""Source trees as DataFrames, hidden files included.

Spark's own file sources skip names that start with a dot or an underscore, which a repository is full of, so the
tree is listed once on the driver (paths and sizes only) and read by the executors in groups of files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.text import extension, glob_regex, language_of

MOST_BYTES = 1 << 20
# Extensions of the plain code walk, fixed values.
CODE_EXTENSIONS = [".cs", ".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".hpp"]
# Globs that scans leave out by default, fixed values.
CSHARP_EXCLUDES = ["**/bin/**", "**/obj/**", "**/node_modules/**", "**/packages/**", "**/.vs/**", "**/TestResults/**", "**/*.Designer.cs"]
ANGULAR_EXCLUDES = ["**/node_modules/**", "**/dist/**", "**/.angular/**", "**/coverage/**", "**/*.spec.ts", "**/e2e/**"]


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.group = int(options.get("filesPerPartition", 500))
        self.content = options.get("content", "true").lower() == "true"
        most = options.get("mostBytes", str(MOST_BYTES)).lower()
        self.most = None if most == "none" else int(most)
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.parts = json.loads(options.get("excludeparts", "[]"))
        self.only = options.get("onlyextensions", "false").lower() == "true"
        self.deep = [re.compile(glob_regex(g)) for g in json.loads(options.get("excludeglobs", "[]")) if g.endswith("/**")]
        self.globs = [re.compile(glob_regex(g)) for g in json.loads(options.get("excludeglobs", "[]"))]

    def _left_out(self, path: str) -> bool:
        return any(p in path for p in self.parts) or any(g.search(path) for g in self.globs)

    def partitions(self) -> list[_Files]:
        """One listing a folder; what is left out isn't entered, and files that can't count aren't handed on."""
        fs, root = pa.fs.FileSystem.from_uri(self.root)
        files, todo = [], [root]
        while todo:
            for x in fs.get_file_info(pa.fs.FileSelector(todo.pop())):
                path = x.path[len(root) :].lstrip("/")
                if x.is_file:
                    if not self._left_out(path) and (not self.only or path.lower().endswith(self.extensions)):
                        files.append((path, x.size))
                # a folder is passed by if all that can be in it is left out: a part of its path, or a glob that goes on with anything
                elif not any(p in path for p in self.parts) and not any(g.search(f"{path}/") for g in self.deep):
                    todo.append(x.path)
        files.sort()
        return [_Files(files[i : i + self.group]) for i in range(0, len(files), self.group)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, root = pa.fs.FileSystem.from_uri(self.root)
        for path, size in partition.files:
            content = error = None
            wanted = self.content and (not self.extensions or path.lower().endswith(self.extensions))
            if wanted and self.most is not None and size > self.most:
                error = f"larger than {self.most} bytes"
            elif wanted:
                try:
                    with fs.open_input_stream(f"{root}/{path}") as f:
                        content = f.read().decode()
                except (UnicodeDecodeError, OSError) as e:
                    error = f"{type(e).__name__}: {e}"
            yield path, path.rsplit("/", 1)[-1], size, content, error


class RepoSource(DataSource):
    """spark.read.format("repo").load(root): path (relative), name, size, content, error.

    Options: mostBytes (a larger file has error in place of content; "none": no limit), extensions (comma-joined; other
    files have no content, or no row with onlyExtensions), excludeParts and excludeGlobs (JSON lists: parts of relative paths, globs on
    them; folders that they cover aren't listed), content, filesPerPartition.
    """

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return "path string, name string, size long, content string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_repo(spark: SparkSession, root: str, *, exclude: list[str] | None = None, substring: bool = False, extensions: list[str] | None = None, most_bytes: int | None = MOST_BYTES, files_per_partition: int = 500) -> DataFrame:
    """Files of a tree with their language. exclude are globs on the relative path, or plain parts of it with substring.

    What is left out isn't listed or read. A file that isn't UTF-8 keeps its row, with error in place of content.
    """
    spark.dataSource.register(RepoSource)
    source = spark.read.format("repo").option("filesPerPartition", files_per_partition).option("mostBytes", "none" if most_bytes is None else most_bytes)
    source = source.option("excludeParts" if substring else "excludeGlobs", json.dumps(exclude or []))
    df = source.option("extensions", ",".join(extensions or [])).option("onlyExtensions", bool(extensions)).load(root if "://" in root else f"file://{root}")
    if extensions:
        df = df.where(extension(F.col("path")).isin(extensions))
    if most_bytes is not None:
        df = df.where(F.col("size") <= most_bytes)
    return df.withColumn("language", language_of(F.col("path")))


def code_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    return read_repo(spark, root, exclude=exclude, substring=True, extensions=CODE_EXTENSIONS)


def csharp_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """An empty list means the defaults, as None does."""
    return read_repo(spark, root, exclude=exclude or CSHARP_EXCLUDES, extensions=[".cs"], most_bytes=None)


def angular_files(spark: SparkSession, root: str, exclude: list[str] | None = None, suffix: str = ".ts") -> DataFrame:
    return read_repo(spark, root, exclude=exclude or ANGULAR_EXCLUDES, extensions=[suffix], most_bytes=None)


def framework(files: DataFrame) -> DataFrame:
    """(framework): csharp, angular, both or unknown, by the files that are there."""
    cs = F.max(extension(F.col("path")).isin(".cs", ".csproj", ".sln"))
    ng = F.max(F.col("path").isin("angular.json", "package.json", "tsconfig.json", "src/app/app.module.ts"))
    one = files.agg(F.coalesce(cs, F.lit(False)).alias("cs"), F.coalesce(ng, F.lit(False)).alias("ng"))
    return one.select(F.when(F.col("cs") & F.col("ng"), "both").when(F.col("cs"), "csharp").when(F.col("ng"), "angular").otherwise("unknown").alias("framework"))
