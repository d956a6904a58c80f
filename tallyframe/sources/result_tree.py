"""A data source for trees of results, <root>/<model>/<run>/..., in any store that Arrow's file systems reach.

    spark.read.format("result_tree").option("root", root).option("file", "results.json").load().where("latest")

A partition is a run's folder. Filters on model, run_ts and latest are pushed into the list of partitions, so only the runs
that are asked for are opened; the driver sees names, never contents. Names are taken as they are, blanks, signs and all.
The latest run of a model is the greatest name in its folder, of stray files too: one that sorts last is the latest entry,
and as it has no files the model has no rows. Written rows go to the file that their columns name, so a task that is run
again writes the same files again.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "model string, run_ts string, latest boolean, inner string, content string"


def _open(root: str):
    """The file system of a root, its path there, and Arrow's module, which only the workers need."""
    import pyarrow.fs as pafs

    if "://" in root or root.startswith("file:"):
        return *pafs.FileSystem.from_uri(root), pafs
    return pafs.LocalFileSystem(), root, pafs


@dataclass
class Run(InputPartition):
    model: str
    run_ts: str
    latest: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.file, self.direct = options["root"].rstrip("/"), options.get("file"), options.get("direct", "false") == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("model",), ("run_ts",), ("latest",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def _takes(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Run]:
        fs, root, pafs = _open(self.root)
        out = []
        for model in sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.Directory):
            if not self._takes("model", model):
                continue
            entries = fs.get_file_info(pafs.FileSelector(f"{root}/{model}"))
            last = max((x.base_name for x in entries), default=None)
            runs = [Run(model, x.base_name, x.base_name == last) for x in entries if x.type == pafs.FileType.Directory]
            out += [r for r in runs if self._takes("run_ts", r.run_ts) and self._takes("latest", r.latest)]
        return out or [Run("", "", False)]

    def read(self, run: Run) -> Iterator[tuple]:
        if not run.run_ts:
            return
        fs, root, pafs = _open(self.root)
        folder = f"{root}/{run.model}/{run.run_ts}"
        for x in sorted(fs.get_file_info(pafs.FileSelector(folder, recursive=not self.direct)), key=lambda x: x.path):
            if x.type == pafs.FileType.File and self.file in (None, x.base_name):
                with fs.open_input_stream(x.path) as f:
                    yield run.model, run.run_ts, run.latest, posixpath.relpath(x.path, folder), f.read().decode("utf-8", "replace")


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"].rstrip("/")

    def write(self, rows: Iterator) -> Written:
        fs, root, _ = _open(self.root)
        n = 0
        for r in rows:
            parts = [r.model, r.run_ts, *(r.inner or "").split("/")]
            if any(p in (None, "", ".", "..") for p in parts) or "/" in r.model + r.run_ts:
                raise ValueError(f"not a place in a result tree: {parts}")
            path = "/".join([root, *parts])
            fs.create_dir(posixpath.dirname(path))
            with fs.open_output_stream(path) as f:
                f.write((r.content or "").encode())
            n += 1
        return Written(n)


class ResultTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a result tree is added to, never replaced")
        return TreeWriter(self.options)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when a plan is made, so it stays set


def load(spark: SparkSession, root: str, file: str | None = None, direct: bool = False) -> DataFrame:
    """Files of a tree: model, run_ts, latest, inner (path below the run), content. file: only those of that name; direct: only in the run's own folder."""
    _register(spark)
    reader = spark.read.format("result_tree").option("root", root).option("direct", str(direct).lower())
    return (reader.option("file", file) if file else reader).load()


def save(files: DataFrame, root: str) -> None:
    """Writes files (model, run_ts, inner, content) into a tree."""
    _register(files.sparkSession)
    rows = files.selectExpr("model", "run_ts", "false as latest", "inner", "content")
    rows.write.format("result_tree").option("root", root).mode("append").save()
