"""Digests of whole tables and profiles of their columns, from parts that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Hexadecimal digits of a value's digest that name its leaf; two are folded at a level.
LEAF_DIGITS, LEVEL_DIGITS = 4, 2


def tree_digest(df: DataFrame, value: Column, digits: int = LEAF_DIGITS) -> DataFrame:
    """One row (n, digest) of the distinct values: the root of a tree of digests.

    A value's leaf is the start of its own digest, so the tree is the same however rows are dealt to tasks. A leaf holds
    a share of 16 ** -digits of the values; each level above folds 256 children. No values: the digest of nothing.
    """
    leaf = df.select(F.sha2(value.cast("string").cast("binary"), 256).alias("d")).where("d is not null").distinct()
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"), 256)
    level = leaf.groupBy(F.left("d", F.lit(digits)).alias("k")).agg(fold("d").alias("d"), F.count("*").alias("n"))
    for left in range(digits - LEVEL_DIGITS, -1, -LEVEL_DIGITS):
        up = level.groupBy(F.left("k", F.lit(left)).alias("k")) if left else level.groupBy()
        named = fold(F.concat("k", F.lit(":"), "d"))
        level = up.agg(named.alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return level.select("n", F.col("d").alias("digest"))


def run_manifest(documents: DataFrame, mode: str, code: str, file: str, limit: int | None = None) -> DataFrame:
    """One row: mode, limit, how many documents, and digests of the distinct codes and files; with a limit, of the first
    documents by file name and code."""
    chosen = documents if limit is None else documents.orderBy(file, code).limit(limit)
    n = chosen.agg(F.count("*").alias("n"))
    codes, files = (tree_digest(chosen, F.col(c)).select(F.col("digest").alias(k)) for c, k in ((code, "codes"), (file, "files")))
    both = n.crossJoin(codes).crossJoin(files)  # a row each
    return both.select(F.lit(mode).alias("mode"), F.lit(limit).cast("long").alias("most"), "n", "codes", "files")


def column_sketches(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(part, name, numeric, n, missing, total, squares, least, most, ranks, kinds, tops): mergeable facts of each column and part.

    ``ranks`` is a KLL sketch of a numeric column, ``kinds`` a HyperLogLog sketch, ``tops`` a sketch of frequent values.
    Write them by part; ``merge_sketches`` gives the profile of any union of parts without reading a row again.
    """
    out = None
    for c in columns:  # a pass each: sketches of many columns side by side would not fit a task's memory
        numeric = isinstance(df.schema[c].dataType, NumericType)
        v, t = F.col(c).cast("double"), F.col(c).cast("string")
        empty = F.lit(None)
        facts = df.groupBy(F.col(by).cast("string").alias("part")).agg(
            F.lit(c).alias("name"), F.lit(numeric).alias("numeric"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"),
            (F.sum(v) if numeric else empty.cast("double")).alias("total"), (F.sum(v * v) if numeric else empty.cast("double")).alias("squares"),
            F.min(v if numeric else t).cast("string").alias("least"), F.max(v if numeric else t).cast("string").alias("most"),
            (F.kll_sketch_agg_double(v) if numeric else empty.cast("binary")).alias("ranks"), F.hll_sketch_agg(t).alias("kinds"), F.expr(f"approx_top_k_accumulate(cast(`{c}` as string))").alias("tops"),
        )
        out = facts if out is None else out.unionByName(facts)
    return out


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(name, n, missing, kinds, mean, deviation, least, quarter, half, three_quarters, most, top, freq) of each column.

    Quartiles are values of the column whose rank is right to about two parts in a hundred; ``kinds`` and ``freq`` are
    estimates. Text columns have no quartiles, mean or deviation.
    """
    m = sketches.groupBy("name", "numeric").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min(F.when(F.col("numeric"), F.col("least").cast("double"))).alias("low"),
        F.max(F.when(F.col("numeric"), F.col("most").cast("double"))).alias("high"), F.min("least").alias("first"), F.max("most").alias("last"),
        F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_sketch_estimate(F.hll_union_agg("kinds")).alias("kinds"), F.expr("approx_top_k_estimate(approx_top_k_combine(tops), 1)").alias("tops"),
    )
    q = F.when(F.col("numeric") & (F.col("n") > 0), F.kll_sketch_get_quantile_double("ranks", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    mean = F.col("total") / F.col("n")
    spread = F.when(F.col("numeric") & (F.col("n") > 1), F.sqrt(F.greatest((F.col("squares") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))))
    text = lambda a, b: F.when(F.col("numeric"), F.col(a).cast("string")).otherwise(F.col(b))
    return m.withColumn("q", q).select(
        "name", "n", "missing", "kinds", mean.alias("mean"), spread.alias("deviation"), text("low", "first").alias("least"),
        *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("quarter", "half", "three_quarters"))], text("high", "last").alias("most"),
        F.get("tops", F.lit(0))["item"].alias("top"), F.get("tops", F.lit(0))["count"].alias("freq"),
    )
