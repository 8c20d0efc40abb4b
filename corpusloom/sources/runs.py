"""SRC-11: a directory of runs as a table, by a data source that plans a partition for each round."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import nested_matter

SCHEMA = (
    "run string, round int, cid string, path string, platform string, writer string, writer_no int, suffix string, rewrite_of string, "
    "meta map<string,string>, text string, scores map<string,string>"
)
# Names of candidates and what their suffixes stand for.
CID = re.compile(r"^r(\d+)-w(\d+)-(li|x|x1)$")
PLATFORMS = {"li": "linkedin", "x": "x", "x1": "x"}

class Round(InputPartition):
    def __init__(self, run: str, round_: int, path: str):
        self.run, self.round, self.path = run, round_, path


def listed(system: fs.FileSystem, path: str, kind: fs.FileType) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.type == kind), key=lambda f: f.base_name)


class RunReader(DataSourceReader):
    """One partition a round. The options runs (a pattern) and rounds (first,last) choose the partitions; no file of another is opened.

    They are options because Spark 4.1.2 keeps the filters that one query pushes down for the next query of the same DataFrame, which then misses rows.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.runs = options["path"], options.get("runs", "*")
        self.low, self.high = (int(x) for x in options.get("rounds", f"0,{1 << 31}").split(","))

    def partitions(self) -> list[Round]:
        system, root = fs.FileSystem.from_uri(self.root)
        out = []
        for run in listed(system, root, fs.FileType.Directory):
            if fnmatchcase(run.base_name, self.runs):
                rounds = ((re.fullmatch(r"round(\d+)", part.base_name), part) for part in listed(system, run.path, fs.FileType.Directory))
                out += [Round(run.base_name, int(m[1]), part.path) for m, part in rounds if m and self.low <= int(m[1]) <= self.high]
        return out

    def read(self, partition: Round | None) -> Iterator[tuple]:
        if partition is None:  # there are none
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        read = lambda path: system.open_input_stream(path).read().decode("utf-8", "replace")
        sidecars: dict[str, dict[str, str]] = {}
        for f in listed(system, f"{partition.path}/scores", fs.FileType.File):
            if m := re.fullmatch(r"(.+)\.(\w+)\.json", f.base_name):
                sidecars.setdefault(m[1], {})[m[2]] = read(f.path)
        files = {f.base_name: f.path for f in listed(system, f"{partition.path}/candidates", fs.FileType.File)}
        for name, path in files.items():
            if not name.endswith(".md"):
                continue
            cid = name[:-3]
            meta, body = nested_matter(read(path))
            text = read(files[f"{cid}.txt"]) if f"{cid}.txt" in files else body
            m = CID.match(cid)
            number, suffix = (int(m[2]), m[3]) if m else (None, None)
            named = meta.get("platform", "").lower()
            platform = named if named in PLATFORMS.values() else PLATFORMS.get(suffix or "", named or "linkedin")
            writer = meta.get("writer") or (f"post-writer-{number}" if number else "post-writer")
            yield partition.run, partition.round, cid, path, platform, writer, number, suffix, meta.get("lineage.rewrite_of") or None, meta, text, sidecars.get(cid, {})


class RunFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RunReader(self.options)


def read_runs(spark: SparkSession, root: str, runs: str = "*", rounds: tuple[int, int] | None = None) -> DataFrame:
    """SRC-11: a row for each candidate of `root/<run>/round<k>/candidates/*.md`, with its front matter (nested keys dotted), its text and its score files.

    root is an address that Arrow's file systems open (file://, hdfs://, s3://, gs://). runs is a pattern of run names, rounds the first and last round: only
    their folders are read, a task for each. An empty or absent folder has no rows.
    """
    spark.dataSource.register(RunFiles)
    source = spark.read.format("run_files").option("runs", runs)
    return (source.option("rounds", f"{rounds[0]},{rounds[1]}") if rounds else source).load(root)


def superseded(candidates: DataFrame) -> DataFrame:
    """JN-23, SRC-11: candidates with superseded_by, within their run: the last that names it as rewrite_of; if none does, the first of the next round by the same writer for the same suffix, of those that name no candidate."""
    order = F.struct("round", "cid")
    keys = candidates.select("run", F.col("cid").alias("old")).distinct()
    named = candidates.select("run", "cid", F.col("rewrite_of").alias("old"), order.alias("order")).join(keys, ["run", "old"], "left_semi")
    said = named.groupBy("run", "old").agg(F.max_by("cid", "order").alias("by"))
    rest = candidates.where("writer_no is not null and round > 1").join(named.select("run", "cid"), ["run", "cid"], "left_anti")
    old = F.concat(F.lit("r"), F.col("round") - 1, F.lit("-w"), F.col("writer_no"), F.lit("-"), F.col("suffix"))
    guessed = rest.select("run", "cid", old.alias("old"), order.alias("order")).groupBy("run", "old").agg(F.min_by("cid", "order").alias("guess"))
    both = candidates.join(said.withColumnRenamed("old", "cid"), ["run", "cid"], "left").join(guessed.withColumnRenamed("old", "cid"), ["run", "cid"], "left")
    return both.withColumn("superseded_by", F.coalesce("by", "guess")).drop("by", "guess")


def score(kind: str, field: str) -> Column:
    """A field (a JSON path) of the candidate's score file of a kind; null if there is none."""
    return F.get_json_object(F.try_element_at("scores", F.lit(kind)), field)


