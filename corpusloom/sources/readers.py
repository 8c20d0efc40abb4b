"""Readers of raw posts: delimited files, JSON, Markdown blocks, front-matter documents, logs and Markdown tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Keys of an object that hold its rows.
WRAPPERS = ("posts", "rows", "items", "data")
KINDS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "md": "md", "markdown": "md", "txt": "md"}


def kind_of(path: str) -> str:
    """SRC-04: the reader of a file by its extension."""
    extension = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if extension not in KINDS:
        raise ValueError(f"no reader for .{extension} files; known are {', '.join(sorted(KINDS))}")
    return KINDS[extension]


def _head(spark: SparkSession, path: str, characters: int = 8192) -> str:
    lines, size = [], 0
    for row in spark.read.text(path).limit(200).toLocalIterator():
        lines.append(row.value)
        size += len(row.value) + 1
        if size >= characters:
            break
    return "\n".join(lines)[:characters]


def delimiter_of(head: str, path: str) -> str:
    """The delimiter that splits most lines of the head alike; a tab for .tsv, else a comma."""
    rows = [re.sub(r'"[^"]*"', "", x) for x in head.split("\n") if x.strip()][:20]
    best = max(",;\t", key=lambda d: (sum(x.count(d) == rows[0].count(d) > 0 for x in rows), rows[0].count(d))) if rows else ","
    if rows and rows[0].count(best):
        return best
    return "\t" if path.lower().endswith(".tsv") else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: all columns as strings; quoted cells may hold line ends; a byte order mark goes, as do rows of blank cells."""
    df = spark.read.csv(path, header=True, sep=delimiter_of(_head(spark, path), path), multiLine=True, quote='"', escape='"')
    df = df.toDF(*(c.replace("﻿", "").strip() for c in df.columns))
    cells = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns]
    return df.where(F.concat(*cells) != "") if cells else df


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: rows of a JSON file: an array, an object that wraps one under a known key, one object, or one object a line.

    Whole JSON is tried first. A line that is no JSON is an error.
    """
    whole = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_json").json(path, multiLine=True)
    if whole.columns == ["bad_json"] or "bad_json" in whole.columns or spark.read.text(path).where("trim(value) != ''").limit(2).count() > 1 and _one_a_line(spark, path):
        return spark.read.option("mode", "FAILFAST").json(path)
    for key in WRAPPERS:
        if key in whole.columns and dict(whole.dtypes)[key].startswith("array<struct"):
            return whole.selectExpr(f"inline({key})")
    return whole


def _one_a_line(spark: SparkSession, path: str) -> bool:
    lines = spark.read.text(path).where("trim(value) != ''")
    return not lines.where("not (trim(value) rlike '^[{].*[}]$')").limit(1).count()


def split_front_matter(text: str) -> tuple[dict[str, str], str]:
    """SRC-05: the keys between the fences at the top and the body after them (one line end after the fence goes).

    Keys are flat: `key: value` lines, with values as text and surrounding quotes off.
    """
    m = re.match(r"﻿?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)\n?(.*)", text.replace("\r\n", "\n"), re.DOTALL)
    if not m:
        return {}, text
    found = (re.match(r"\s*([\w .\-]+?)\s*:\s*(.*)$", line) for line in m[1].split("\n"))
    return {x[1]: x[2].strip().strip("\"'") for x in found if x}, m[2]


def _scalar(value: str) -> str:
    """A plain or quoted value; the rest of the line behind ` #` is a comment."""
    value = value.strip()
    if value[:1] in ("'", '"'):
        end = value.find(value[0], 1)
        return value[1:end] if end > 0 else value[1:]
    value = re.split(r"\s#", value)[0].strip()
    return "" if value in ("~", "null") else value


def _flow(value: str) -> list[str] | None:
    """The items of `[a, "b, c"]`."""
    if not (value.startswith("[") and value.endswith("]")):
        return None
    return [_scalar(x) for x in re.findall(r"""\s*("[^"]*"|'[^']*'|[^,]+)""", value[1:-1]) if x.strip()]


def nested_matter(text: str) -> tuple[dict[str, str], str]:
    """SRC-05: front matter with nested keys dotted (`lineage.rewrite_of`), lists as JSON arrays, and maps in lists numbered (`beats.0.lines`).

    Indented maps, lists of `- ` items, `[a, b]` and text blocks after `|` and `>` are read; anchors and tags are not.
    """
    m = re.match(r"\ufeff?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)\n?(.*)", text.replace("\r\n", "\n"), re.DOTALL)
    if not m:
        return {}, text
    out: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    counts: dict[str, int] = {}
    above: list[tuple[int, str]] = [(-1, "")]  # indents and the keys that stand over what is further in
    lines = m[1].split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if body.startswith("- ") or body == "-":
            while above[-1][0] > indent or (above[-1][0] == indent and above[-1][1].rpartition(".")[2].isdigit()):
                above.pop()
            holder, item = above[-1][1], body[1:].strip()
            if re.match(r"[\w .\-]+:(\s|$)", item):
                counts[holder] = counts.get(holder, -1) + 1
                above.append((indent, f"{holder}.{counts[holder]}"))
                indent, body = indent + len(body) - len(item), item
            else:
                lists.setdefault(holder, []).append(_scalar(item))
                continue
        else:
            while above[-1][0] >= indent:
                above.pop()
        found = re.match(r"([\w .\-]+?)\s*:(?:\s+(.*))?$", body)
        if not found:
            continue
        prefix = above[-1][1]
        key, value = f"{prefix}.{found[1]}" if prefix else found[1], (found[2] or "").strip()
        if value[:1] in ("|", ">") and len(value) <= 2:
            block = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip()) > indent):
                block.append(lines[at].strip())
                at += 1
            out[key] = ("\n" if value[0] == "|" else " ").join(block).strip()
        elif not value or value.startswith("#"):
            above.append((indent, key))
        elif (items := _flow(value)) is not None:
            lists.setdefault(key, []).extend(items)
        else:
            out[key] = _scalar(value)
    return out | {k: json.dumps(v, ensure_ascii=False) for k, v in lists.items()}, m[2]


def markdown_blocks(text: str, known: frozenset[str]) -> Iterator[tuple[dict[str, str], str]]:
    """SRC-03: blocks between lines of `---`, each with its header lines (`key: value`) and the text below.

    A first paragraph is a header if all its lines look like one and a key is known; else only the lines of known keys at its top are.
    """
    shared, body = split_front_matter(text)
    for block in re.split(r"(?m)^---[ \t]*$", body):
        lines = block.strip("\n").split("\n")
        stop = next((k for k, x in enumerate(lines) if not x.strip()), len(lines))
        pairs = [re.match(r"([\w .\-]+?)\s*:\s+(.*)$", x) for x in lines[:stop]]
        is_known = [bool(p) and re.sub(r"[\s_\-]+", " ", p[1].strip().lower()) in known for p in pairs]
        if not (pairs and all(pairs) and any(is_known)):
            stop = next((k for k, ok in enumerate(is_known) if not ok), len(is_known))
        content = "\n".join(lines[stop:]).strip("\n").rstrip()
        if content or stop:
            yield shared | {p[1].strip(): p[2].strip().strip("\"'") for p in pairs[:stop] if p}, content


def read_blocks(spark: SparkSession, path: str, known: frozenset[str]) -> DataFrame:
    """SRC-03: (file, block, header map<string,string>, text) of Markdown files."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, k, h, t) for f, v in zip(batch["file"], batch["value"], strict=True) for k, (h, t) in enumerate(markdown_blocks(v, known))]
            yield pd.DataFrame(rows, columns=["file", "block", "header", "text"])

    return texts.mapInPandas(each, "file string, block long, header map<string,string>, text string")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """SRC-05: (split, file, meta map<string,string>, text) of `root/<split>/*.md`; line ends at the end of the text go."""
    files = spark.read.text(f"{root}/*/*.md", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [nested_matter(v) for v in batch["value"]]
            paths = [p.rsplit("/", 2) for p in batch["path"]]
            yield pd.DataFrame({"split": [p[1] for p in paths], "file": [p[2] for p in paths], "meta": [m for m, _ in parts], "text": [t.rstrip("\n") for _, t in parts]})

    return files.mapInPandas(each, "split string, file string, meta map<string,string>, text string").orderBy("split", "file")


def read_log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """SRC-06: rows of a JSON Lines log; lines that are no JSON are left out; an absent file has no rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def markdown_tables(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """SRC-09: the tables of a Markdown text: runs of `|` lines, the first being the header (lower case); rules of dashes are left out."""
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if line.lstrip().startswith("|"):
            run.append(cells(line))
        elif run:
            head, *rows = run
            out.append(([c.lower() for c in head], [r for r in rows if not all(re.fullmatch(":?-+:?", c) for c in r)]))
            run = []
    return out


def read_table(spark: SparkSession, path: str, which: int = 0) -> DataFrame:
    """SRC-09: one table of a (small) Markdown file as rows of strings."""
    head, rows = markdown_tables("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))[which]
    schema = StructType([StructField(c, StringType()) for c in head])
    return spark.createDataFrame([tuple((r + [None] * len(head))[: len(head)]) for r in rows], schema)


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """SRC-07: rules given as dictionaries as a table (id, kind, pattern, scope, rank), small enough to broadcast."""
    rows = [(r["id"], r.get("kind", "regex"), r["pattern"], r.get("scope", "text"), int(r.get("rank", 2))) for r in rules]
    return spark.createDataFrame(rows, "id string, kind string, pattern string, scope string, rank int")


def read_source(spark: SparkSession, path: str, known: frozenset[str] = frozenset(), kind: str = "auto") -> DataFrame:
    """SRC-04: the rows of a raw file by its kind; Markdown headers become columns."""
    kind = kind_of(path) if kind == "auto" else kind
    if kind != "md":
        return read_delimited(spark, path) if kind == "csv" else read_records(spark, path)
    blocks = read_blocks(spark, path, known)
    names = sorted(r.k for r in blocks.select(F.explode(F.map_keys("header")).alias("k")).distinct().collect())
    return blocks.select(*(F.col("header")[n].alias(n) for n in names if n != "text"), "text")


def fingerprint(parts: list[tuple[str, bytes]]) -> str:
    """FN-25: one hash over names and contents in the order given."""
    import hashlib

    h = hashlib.sha256()
    for name, content in parts:
        h.update(name.encode())
        h.update(content)
    return h.hexdigest()


def to_json_text(value: object) -> str:
    """SNK-05: the text of a JSON document: indented, UTF-8 unescaped, one line end."""
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"
