"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line without the characters ``[\\x20\\x09-\\x0D]`` at either end and
with A-Z lower-cased; it is stored as an MD5.  :class:`LineRuns` keeps how many documents
hold each key in *runs*, Parquet tables sorted by key.  A batch merge-anti-joins the keys
that the runs already settle (found in enough documents), adds the counts of its other keys
as a new run of level 0, and ``fanout`` runs of a level are compacted into one run of the
next.  A key that is settled stays so, because counts only grow.

Everything is DataFrame expressions.  Hot lines are counted map-side before the shuffle, and
the join that looks keys up is an ordinary one, which AQE can split.

Defined results: a null or empty text is one empty line; empty keys (shorter than
``min_chars``) are never dropped; each row counts as one document, so repeated rows count
each; null ids are as good as any other; an empty table gives an empty result; other columns
are passed through untouched by :func:`dedup_lines`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ascii_lower, cut_lineage, drop_path, read_table, scratch_path

SPACE = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int = 1) -> Column:
    """An MD5 (hex) for each line, null for a line whose key is too short."""
    trimmed = F.transform(lines_of(ascii_lower(text)), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.transform(trimmed, lambda x: F.when(F.char_length(x) >= min_chars, F.md5(x)))


class LineRuns:
    """Document counts of line keys in levelled sorted runs (columns key, docs)."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def counts(self) -> DataFrame:
        """Documents of each key over all runs."""
        runs = [self.spark.read.parquet(p) for level in self.levels for p in level]
        if not runs:
            return self.spark.createDataFrame([], "key binary, docs long")
        if len(runs) == 1:
            return runs[0]
        return reduce(DataFrame.unionAll, runs).groupBy("key").agg(F.sum("docs").alias("docs"))

    def settled(self) -> DataFrame:
        """Keys found in ``min_docs`` documents or more."""
        return self.counts().where(F.col("docs") >= self.min_docs).select("key")

    def _write(self, counts: DataFrame, level: int) -> None:
        path = scratch_path(self.spark, f"line-run-{level}")
        counts.sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (key, docs), one row a key, without the keys that are settled already."""
        if any(self.levels):
            counts = counts.join(self.settled().hint("merge"), "key", "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        merged = (reduce(DataFrame.unionAll, [self.spark.read.parquet(p) for p in old])
                  .groupBy("key").agg(F.sum("docs").alias("docs")))
        self._write(merged, level + 1)
        for p in old:
            drop_path(self.spark, p)


def _hashed(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """Id, text hash and line keys of each document, written by batch."""
    spark = docs.sparkSession
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    path = scratch_path(spark, "line-hashes")
    (docs.select(F.col(id_col).alias("_ld_id"), th.alias("_ld_th"), line_keys(F.col(text_col), min_chars).alias("_keys"),
                 F.pmod(F.xxhash64(F.col(id_col), th), F.lit(batches)).alias("_batch"))
     .write.option("compression", "zstd").partitionBy("_batch").parquet(path))
    schema = f"_ld_id {dict(docs.dtypes)[id_col]}, _ld_th long, _keys array<string>, _batch long"
    return spark.read.schema(schema).parquet(path)


def _counts(hashed: DataFrame) -> DataFrame:
    return (hashed.select(F.explode(F.array_distinct("_keys")).alias("_key")).where(F.col("_key").isNotNull())
            .groupBy(F.unhex("_key").alias("key")).agg(F.count(F.lit(1)).alias("docs")))


def mark_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               min_chars: int = 1, batches: int = 4, fanout: int = 2) -> tuple[DataFrame, Column, Column]:
    """``docs`` with the column ``_ld_pos``, and expressions for all lines and the kept lines.

    ``_ld_pos`` has the sorted positions of the lines to drop, or null if there are none.
    ``batches``: how many batches the table is added to the runs in.
    """
    spark = docs.sparkSession
    hashed = _hashed(docs, id_col, text_col, min_chars, batches)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(_counts(hashed.where(F.col("_batch") == b)))
    settled = cut_lineage(runs.settled(), "line-settled")
    found = (hashed.select("_ld_id", "_ld_th", F.posexplode("_keys").alias("_pos", "_key")).where(F.col("_key").isNotNull())
             .withColumn("key", F.unhex("_key")).join(settled, "key", "left_semi")
             .groupBy("_ld_id", "_ld_th").agg(F.sort_array(F.collect_set("_pos")).alias("_ld_pos")))
    th = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    out = (docs.join(found, docs[id_col].eqNullSafe(found["_ld_id"]) & (th == found["_ld_th"]), "left")
           .drop("_ld_id", "_ld_th"))
    # one flag for each line up to the last dropped one: a look-up by position, however long the text
    pos = F.coalesce(F.col("_ld_pos"), F.array().cast("array<int>"))
    gaps = F.transform(pos, lambda p, i: p - F.when(i > 0, F.get(pos, i - 1)).otherwise(-1) - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.array_append(F.array_repeat(F.lit(False), g), F.lit(True))))
    out = out.withColumn("_ld_flags", flags)
    every = lines_of(F.col(text_col))
    kept = F.filter(every, lambda x, i: ~F.coalesce(F.get(F.col("_ld_flags"), i), F.lit(False)))
    return out, every, kept


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; a text that loses none stays as it is.

    A document that loses all its lines stays, with an empty text.  ``n_chars``, if there, follows the text.
    """
    marked, _, kept = mark_lines(docs, id_col=id_col, text_col=text_col, **options)
    text = F.when(F.col("_ld_pos").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = marked.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        changed = F.col("_ld_pos").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.char_length(text_col)).otherwise(F.col("n_chars"))
                             .cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go everywhere; digest of what stays of each document."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    marked, every, kept = mark_lines(docs, min_docs=10, min_chars=1)
    return marked.select(
        "doc_id",
        F.size(every).cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_pos"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"))
