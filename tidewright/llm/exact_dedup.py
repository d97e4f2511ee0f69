"""Exact dedup by a log-structured merge index of digests, in DataFrame operations alone.

Levels of the index are Parquet tables in the cluster's shared folder:

* `flush`: a memtable is the rows that one task reads. It is written as a run of (digest, row, id, length) sorted by digest;
  Parquet keeps a Bloom filter of the digests beside each run, which lookups of single digests use.
* `compact`: all runs merge into one entry a digest - the row that stays (longest original text, then smallest id) and the
  number of rows - written sorted in digest ranges.
* `filtered`: digests that occur more than once are hits. Their filter, bitmaps of 16 bits a hit, is broadcast while it is
  under `filter_bytes` (32 MB, 16 million hits) and probed before any text is shuffled, so that only the texts of hits and
  one in sixteen of the others move. Beyond that size all texts move.
* Hits receive byte verification: they are grouped by digest and whole normalised text.

Copies meet in partial aggregates before any shuffle, so a group that holds a third of all rows sends a row for each task;
where every row of such a group is returned, both sides of the join are plain scans, which adaptive execution splits.

Contract of `dedup`: one row per input row.
* null text counts as empty; all empty and blank texts are one group; texts of any length are compared whole.
* text equality: after deleting every character of `[\\x20\\x09-\\x0D]`; lengths are code points of the original text.
* ties in length go to the smallest id; a null id counts as larger than all others and may still stay alone in its group.
* rows repeated with equal id and equal text: all are returned and count in group_size, one alone has kept = true.
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE_CLASS, fresh, scratch_path, stage_table, text_or_empty

_BITS_A_HIT, _BITS_A_MAP = 16, 32768  # the latter is what Spark's bitmap functions hold in one bitmap


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), WHITE_CLASS + "+", "")


def digest_of(text: str = "text") -> Column:
    return F.sha2(normalised(text), 256)


def entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_points, digest, row) of each row; `row` tells repeated rows apart once the run is written."""
    return docs.select(F.col(id_col).alias("doc_id"), F.char_length(text_or_empty(text_col)).alias("n_points"), digest_of(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _sorted_run(df: DataFrame, path: str) -> DataFrame:
    df.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _order(id_col: str | Column, points: Column) -> list[Column]:
    """What orders the row that stays first: most code points, then smallest id, null ids last."""
    own = F.col(id_col) if isinstance(id_col, str) else id_col
    return [(-points).alias("less"), own.isNull().alias("no_id"), own.alias("doc_id")]


class MergeIndex:
    """Runs of digests in the shared folder, merged into one sorted level."""

    def __init__(self, spark: SparkSession, filter_bytes: int = 32 << 20):
        self.spark, self.filter_bytes = spark, filter_bytes
        self.runs: list[DataFrame] = []
        self.level: DataFrame | None = None

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        rows = entries(docs, id_col, text_col).withColumn("run", F.lit(len(self.runs)))
        self.runs.append(_sorted_run(rows, scratch_path(self.spark, "runs")))
        return self.runs[-1]

    def compact(self) -> DataFrame:
        """One entry a digest over all runs: keep (struct), group_size."""
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)
        keep = F.min(F.struct(*_order("doc_id", F.col("n_points")), "run", "row")).alias("keep")
        merged = rows.groupBy("digest").agg(keep, F.count("*").alias("group_size"))
        self.level = _sorted_run(merged.repartitionByRange("digest"), scratch_path(self.spark, "level"))
        return self.level

    def hits(self) -> DataFrame:
        """Digests that occur more than once."""
        return self.level.where("group_size > 1")

    def filtered(self, rows: DataFrame, digest: str, maybe: str) -> DataFrame:
        """`rows` with a boolean column `maybe`: false says that the row's digest is no hit."""
        count = self.hits().count()
        bits = max(1, -(-count * _BITS_A_HIT // _BITS_A_MAP)) * _BITS_A_MAP
        if bits // 8 > self.filter_bytes:
            return rows.withColumn(maybe, F.lit(True))
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
        number, bitmap = fresh(rows.columns, "map_number", "map_bits")
        maps = self.hits().groupBy(F.bitmap_bucket_number(place("digest")).alias(number)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("digest"))).alias(bitmap))
        at = F.bitmap_bit_position(place(digest)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        has = F.bit_get(byte, F.pmod(at, F.lit(8))) == 1
        joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(digest)) == F.col(number), "left")
        return joined.withColumn(maybe, F.coalesce(has, F.lit(False))).drop(number, bitmap)


def _indexed(docs: DataFrame, id_col: str, text_col: str, filter_bytes: int) -> MergeIndex:
    index = MergeIndex(docs.sparkSession, filter_bytes)
    index.flush(docs, id_col, text_col)
    index.compact()
    return index


def verified_hits(index: MergeIndex, docs: DataFrame, text_col: str) -> DataFrame:
    """The level's hits - digest, keep, group_size - once the bytes of their normalised texts have been compared."""
    texts = docs.select(normalised(text_col).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    texts = index.filtered(texts, "digest", "maybe").where("maybe").groupBy("digest", "norm").agg(F.count("*").alias("n"))
    compared = texts.groupBy("digest").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n"))
    same = (F.col("n_texts") == 1) & (F.col("n") == F.col("group_size"))
    size = F.when(same, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a digest; take a longer one")))
    return stage_table(index.hits().join(compared, "digest", "left").select("digest", "keep", size.alias("group_size")), "hits")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), n_points, one row per input row."""
    index = _indexed(docs, id_col, text_col, filter_bytes)
    found = index.runs[0].join(verified_hits(index, docs, text_col), "digest", "left")
    alone = F.col("keep").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "n_points",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 32 << 20) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows repeated with equal id and text, one.

    Rows that the filter of hits clears stay where they are; the others are grouped by digest and whole normalised text.
    """
    index = _indexed(docs, id_col, text_col, filter_bytes)
    digest, maybe, norm, whole = fresh(docs.columns, "digest", "maybe", "norm", "whole_row")
    marked = index.filtered(docs.withColumn(digest, digest_of(text_col)), digest, maybe)
    clear = marked.where(~F.col(maybe)).select(*docs.columns)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias(whole)
    groups = marked.where(maybe).withColumn(norm, normalised(text_col)).groupBy(digest, norm)
    stay = groups.agg(F.min_by(own, F.struct(*_order(id_col, F.char_length(text_or_empty(text_col))))).alias(whole))
    return clear.unionByName(stay.select(f"{whole}.*"))
