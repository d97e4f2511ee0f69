"""Sources and sinks: JSON lines and trees, listings, manifests. Schemas are given, never inferred."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False, strict: bool = False) -> DataFrame:
    """One object a line, blank lines skipped. A missing path is an error unless `missing_ok`; `strict` fails on a bad row."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_jsonl_with_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): lines that don't parse go to the second table as text."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return rows.where("_bad is null").drop("_bad"), lines.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("raw"))


def read_json_tree(spark: SparkSession, path: str, schema: str, pattern: str = "*.json", list_key: str | None = None, missing_ok: bool = False) -> DataFrame:
    """Whole-file JSON under a folder, at any depth, with `path`; `list_key` explodes a list of structs into rows."""
    if missing_ok and not exists(spark, path):
        df = spark.createDataFrame([], f"{schema}, path string")
    else:
        df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path).withColumn("path", F.col("_metadata.file_path"))
    df = df.where(~F.element_at(F.split("path", "/"), -1).startswith("._"))
    return df.select("path", F.inline(list_key)) if list_key else df


def read_text_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files as VARIANT; null where a file is blank or no JSON."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json(F.nullif(F.trim("value"), F.lit(""))).alias("value"))


def find_one(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; an error if there is none."""
    row = df.where(F.col(key) == value).limit(1)
    if not row.count():
        raise KeyError(f"no row with {key} = {value!r}")
    return row


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, player_id, raw_start_sec) from {"offsets": [...]} or a bare list."""
    item = "struct<game_id: string, player_id: string, raw_start_sec: double>"
    text = spark.read.option("wholetext", True).text(path)
    both = F.coalesce(F.from_json("value", f"struct<offsets: array<{item}>>")["offsets"], F.from_json("value", f"array<{item}>"))
    return text.select(F.inline(both)).where("player_id is not null")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files at any depth; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def raw_videos(files: DataFrame) -> DataFrame:
    """game_id from the parent folder and player_id from the file's name."""
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("game_id"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("player_id"), "length")


def episode_clips(files: DataFrame) -> DataFrame:
    """episode index and label from names like episode_003_label.mp4; other files are left out."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    idx = F.regexp_extract(name, r"^episode_(\d+)_(.+)\.mp4$", 1)
    return files.withColumns({"idx": idx.try_cast("int"), "label": F.regexp_extract(name, r"^episode_(\d+)_(.+)\.mp4$", 2)}).where("idx is not null")


def enough_views(files: DataFrame, key: str, least: int) -> DataFrame:
    """Files of games with at least `least` players."""
    games = files.groupBy(key).agg(F.count_distinct("player_id").alias("_n")).where(F.col("_n") >= least).select(key)
    return files.join(games, key, "left_semi")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys, the same bytes for the same row."""
    return F.to_json(F.struct(*sorted(df.columns)))


def write_sorted_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(sorted_json(df).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_tracks(rows: DataFrame, path: str, by: str, private: Sequence[str], tracks: dict[str, Column]) -> None:
    """Public rows partitioned by a column, a folder for each track, and the private columns apart."""
    public = rows.drop(*private)
    public.write.mode("overwrite").partitionBy(by).json(f"{path}/public")
    for name, rule in tracks.items():
        public.where(rule).write.mode("overwrite").json(f"{path}/tracks/{name}")
    rows.write.mode("overwrite").json(f"{path}/private")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of each file."""
    return spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_lines"))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and sha256 of each file; hashed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_hash(spark: SparkSession, path: str) -> DataFrame:
    """One row, sha256: of a file, its hash; of a folder, the hash of a line for each file in order of path - name below the folder, a zero
    byte, the file's hash. Files that a Finder leaves (`._...`) don't count; other hidden ones do.

    Names are listed by the driver, contents are hashed in tasks, a few MB at a time; what comes together is a line a file.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root, found, files = system.makeQualified(root), [], system.listFiles(root, True)
    single = system.getFileStatus(root).isFile()
    while files.hasNext():
        there = files.next().getPath()
        name = root.toUri().relativize(there.toUri()).getPath()
        if single or not there.getName().startswith("._"):
            found.append((re.sub("^file:/(?!/)", "file:///", there.toUri().toASCIIString()), name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri in b.column("uri").to_pylist():
                source, name = pyarrow.fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with source.open_input_stream(name) as reader:
                    while block := reader.read(4 << 20):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.string())], names=["name", "sha256"])

    listed = spark.createDataFrame(found, "uri string, name string").repartition(max(1, min(len(found), 2000)), "uri")
    hashed = listed.mapInArrow(run, "name string, sha256 string")
    if single:
        return hashed.select("sha256")
    line = F.concat("name", F.lit("\0"), "sha256", F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.split("name", "/").alias("parts"), line.alias("line"))))
    return hashed.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("sha256"))


def manifest_issues(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files missing, unexpected or changed."""
    e = expected.select("path", F.col("sha256").alias("_want"))
    both = e.join(actual.select("path", "sha256"), "path", "full_outer")
    code = F.when(F.col("sha256").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("sha256") != F.col("_want"), "changed")
    return both.select("path", code.alias("code")).where("code is not null")


def unrecovered_errors(errors: DataFrame, outputs: DataFrame) -> DataFrame:
    """Error files without an output of the same name."""
    name = lambda df: df.withColumn("_name", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(\.error)?\.json$", ""))
    return name(errors).join(name(outputs).select("_name").distinct(), "_name", "left_anti").drop("_name")


def _sheet_rows(book: zipfile.ZipFile) -> Iterator[list[str | None]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    for row in ET.fromstring(book.read("xl/worksheets/sheet1.xml")).iterfind(".//m:row", ns):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", ns):
            letters, col = re.match(r"[A-Z]+", c.get("r", "A")).group(), 0
            for ch in letters:
                col = col * 26 + ord(ch) - 64
            value = c.find("m:v", ns)
            inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            raw = value.text if value is not None else inline or None
            cells[col - 1] = shared[int(raw)] if c.get("t") == "s" and raw is not None else raw
        yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_xlsx_packages(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rows of the one workbook in each ZIP file: columns are the keys of `aliases`, found by any of their header names."""
    names = list(aliases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for where, content in zip(files["path"], files["content"]):
                package = zipfile.ZipFile(io.BytesIO(content))
                books = [n for n in package.namelist() if n.endswith(".xlsx")]
                if len(books) != 1:
                    raise ValueError(f"{where} holds {len(books)} workbooks")
                rows = _sheet_rows(zipfile.ZipFile(io.BytesIO(package.read(books[0]))))
                head = [(h or "").strip().lower() for h in next(rows, [])]
                at = {n: next((head.index(a.lower()) for a in [n, *aliases[n]] if a.lower() in head), None) for n in names}
                out = [[where, *[r[at[n]] if at[n] is not None and at[n] < len(r) else None for n in names]] for r in rows]
                yield pd.DataFrame(out, columns=["path", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, " + ", ".join(f"{n} string" for n in names))
