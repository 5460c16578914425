"""Line deduplication by overlapping three-line windows (operator 6).

Every three consecutive lines of a text are hashed (two 64-bit hashes of their text, without white space at the ends).
The first occurrence of a window, by doc_id (nulls last), text and position, is kept; later occurrences, in other
documents or in the same one, are removed: the positions that any of them covers are merged and these lines go. What
occurs is judged on the input, so a line also goes if the window's first occurrence loses lines for another reason.

Minima per window are combined before the shuffle, and the join of windows with the minima can be split, so a window
that very many documents hold is no large group. A text of fewer than three lines has no window and is kept. A
null text stays null. Rows that repeat doc_id and text are one document and get the same result. Input columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, row_key

LINES = 3


def _windows(docs: DataFrame, text: str, lines: int) -> DataFrame:
    """One row per window: h1, h2, and place (null id?, doc_id, row key, position from 0)."""
    at = F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = docs.select(F.col("doc_id").alias("d"), row_key(F.col("doc_id"), F.col(text)).alias("k"), at.alias("l")).filter(F.size("l") >= lines)
    joined: Column = F.transform(F.sequence(F.lit(1), F.size("l") - lines + 1), lambda i: F.array_join(F.slice("l", i, lines), "\n"))
    rows = rows.select("d", "k", F.posexplode(joined).alias("p", "w"))
    return rows.select(F.xxhash64("w").alias("h1"), F.xxhash64("w", F.lit(1)).alias("h2"), F.struct(F.col("d").isNull().alias("n"), "d", "k", "p").alias("place"))


def dedup_lines(docs: DataFrame, text: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_lines and n_removed added; columns of these names are replaced, all others stay."""
    key, places, lost, drop = free_names(docs, "key", "places", "lost", "drop")
    windows = _windows(docs, text, lines)
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("place").alias("first")).filter("c > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).filter("place <> first").select(F.col("place.k").alias(key), F.col("place.p").alias("p"))
    gone = later.distinct().groupBy(key).agg(F.collect_list("p").alias(places))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + lines - 1))))
    gone = gone.select(key, covered.alias(lost))
    rows = docs.drop("n_lines", "n_removed").withColumn(key, row_key(F.col("doc_id"), F.col(text))).join(gone, key, "left")
    split = F.split(F.col(text), "\n")
    # a map from position keeps the test of each line cheap
    dropped = F.map_from_arrays(lost, F.transform(lost, lambda _: F.lit(True)))
    kept = F.array_join(F.filter(split, lambda _, i: ~F.coalesce(F.try_element_at(F.col(drop), i), F.lit(False))), "\n")
    rows = rows.withColumn(drop, dropped).withColumn("n_lines", F.coalesce(F.size(split), F.lit(0))).withColumn("n_removed", F.coalesce(F.size(lost), F.lit(0)))
    rows = rows.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    rows = rows.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept))
    return rows.select(*docs.drop("n_lines", "n_removed").columns, "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: per document the counts and the digest of the lines kept."""
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLE_SQL = r"""
with l as (select doc_id, text, string_split(text, chr(10)) as x from documents),
t as (select doc_id, text, x, list_transform(x, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')) as y from l),
w as (select doc_id, md5(doc_id || chr(0) || text) as k, i - 1 as p, array_to_string(y[i:i + 2], chr(10)) as w
      from (select doc_id, text, y, unnest(range(1, len(y) - 1)) as i from t)),
f as (select *, row_number() over (partition by w order by doc_id, k, p) as r, min(k) over (partition by w order by doc_id, k, p rows between unbounded preceding and unbounded following) as k0 from w),
later as (select distinct doc_id, unnest([p, p + 1, p + 2]) as p from f where r > 1),
gone as (select doc_id, list(p) as gone from later group by doc_id)
select t.doc_id, cast(len(x) as integer) as n_lines, cast(coalesce(len(gone), 0) as integer) as n_removed,
       md5(array_to_string(list_filter(x, lambda s, i: not coalesce(list_contains(gone, i - 1), false)), chr(10))) as kept_md5
from t left join gone on t.doc_id = gone.doc_id
"""
