"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Every line is a letter, every document a string of letters. Ranks of suffixes by their first line are refined by
doubling: in round k a suffix's rank by its first 2^k lines and the rank of the suffix 2^k lines on give its rank by
2^(k+1) lines. Ranks are positions in sorted order, so that sorting by the last rank gives the suffix array; suffixes
that share a rank after round k are an LCP interval of at least 2^k lines. Suffixes alone in their interval are done
and leave, so that rounds shrink to what is repeated and end with the longest repeated run.

A repeated run is deleted wherever an earlier copy (by doc_id, then line) of it stands: runs of ``min_lines`` lines
or more, and single lines of ``min_chars`` characters or more. Maximal runs are unions of such windows, as each
stretch of a longer repeated run has the same earlier copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import clean_text, materialise

MIN_LINES = 2
MIN_CHARS = 40


def blank(line: Column) -> Column:
    return line.rlike(r"^\s*$")


def lines_of(docs: DataFrame, across_blank: bool = False) -> DataFrame:
    """doc_id, line (from 0), chars, h1, h2 of every line that is not blank; 128 bits stand for a line.

    With ``across_blank`` lines are numbered without the blank ones, so that those around a blank line follow each other.
    """
    lines = F.split(clean_text(), "\n")
    split = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.filter(lines, lambda x: ~blank(x)) if across_blank else lines).alias("lines"))
    rows = split.select("doc_id", F.posexplode("lines").alias("line", "body"))
    return rows.where(~blank(F.col("body"))).select("doc_id", "line", F.char_length("body").alias("chars"), F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"))


def first_ranks(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once, with their rank among the sorted line ids."""
    at = F.struct("doc_id", "line")
    classes = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).where("n > 1")
    classes = materialise(classes.withColumn("part", F.shiftrightunsigned("h1", 52)), "line-classes")
    inside = Window.partitionBy("part").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows, whatever the data
    starts = classes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = classes.join(F.broadcast(starts), "part").select("h1", "h2", "first", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("rank"))
    return lines.join(ranked, ["h1", "h2"]).select("doc_id", "line", "chars", "rank", (F.col("first") < at).alias("later"))


def double(active: DataFrame, step: int, label: str, width: int) -> DataFrame:
    """Suffixes still sharing their rank after comparing twice as many lines, ``later`` told anew.

    A blank line (unless lines are numbered without them), a line found nowhere else, or the document's end on the way ends what a suffix can share: it has
    no rank ``step`` lines on and leaves.

    Places within a rank are summed up in parts of ``width`` following ranks and then over the parts, so that no task
    holds all that may follow a very common line.
    """
    ahead = Window.partitionBy("doc_id").orderBy("line").rangeBetween(step, step)
    pairs = active.withColumn("next", F.first("rank").over(ahead)).where("next is not null")
    groups = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).where("n > 1")
    groups = materialise(groups.withColumn("part", F.floor(F.col("next") / width)), f"{label}-groups")
    before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.groupBy("rank", "part").agg(F.sum("n").alias("n")).select("rank", "part", before("part", "rank").alias("start"))
    inside = groups.select("rank", "part", "next", "first", before("next", "rank", "part").alias("inside"))
    groups = inside.join(starts, ["rank", "part"]).select("rank", "next", "first", (F.col("rank") + F.col("start") + F.col("inside")).alias("finer"))
    found = pairs.join(groups, ["rank", "next"]).select("doc_id", "line", "chars", F.col("finer").alias("rank"), (F.col("first") < F.struct("doc_id", "line")).alias("later"))
    return materialise(found, label)


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, across_blank: bool = False) -> DataFrame:
    """doc_id, runs (array of begin and end line, end exclusive) to delete, longest (lines known to repeat in a row)."""
    active = materialise(first_ranks(lines_of(docs, across_blank)), "ranks-1")
    depth = 1
    width = 1 + math.isqrt(active.agg(F.max("rank")).first()[0] or 0)  # as many parts as ranks in a part
    found = active.where(F.col("later") & (F.col("chars") >= min_chars)).select("doc_id", "line", F.lit(1).alias("length"), F.lit(1).alias("depth"))
    if min_lines <= 1:
        found = active.where("later").select("doc_id", "line", F.lit(1).alias("length"), F.lit(1).alias("depth"))
    while not active.isEmpty():
        shorter, active = active, double(active, depth, f"ranks-{2 * depth}", width)
        depth *= 2
        if depth >= min_lines > depth // 2:
            # windows of exactly min_lines: two overlapping ranks of half the depth tell them apart
            exact = active if depth == min_lines else double(shorter, min_lines - depth // 2, "ranks-exact", width)
            found = found.unionByName(exact.where("later").select("doc_id", "line", F.lit(min_lines).alias("length"), F.lit(min_lines).alias("depth")))
        if depth > min_lines:
            found = found.unionByName(active.where("later").select("doc_id", "line", F.lit(depth).alias("length"), F.lit(depth).alias("depth")))
    order = Window.partitionBy("doc_id").orderBy("line")
    spans = found.groupBy("doc_id", "line").agg(F.max("length").alias("length"), F.max("depth").alias("depth")).withColumn("end", F.col("line") + F.col("length"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # across blank lines, those between two runs that only touch belong to neither
    apart = F.col("line") >= reach if across_blank else F.col("line") > reach
    spans = spans.withColumn("new", F.coalesce(apart.cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(order))
    merged = spans.groupBy("doc_id", "run").agg(F.min("line").alias("begin"), F.max("end").alias("end"), F.max("depth").alias("depth"))
    return merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("runs"), F.max("depth").alias("longest"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, across_blank: bool = False) -> DataFrame:
    """All columns of ``docs`` with later copies of repeated runs deleted from text, and n_lines, n_removed, longest_run.

    Null text stays null and counts as no line. Rows without a doc_id keep their text. Rows that repeat a doc_id are
    read as one document written twice, line by line, and lose the same lines. Columns of ``docs`` named n_lines,
    n_removed or longest_run are replaced. An empty table gives no rows. The text of a document whose lines all go is
    empty.

    Blank lines end a run. With ``across_blank`` they do not: they are no letters, so that runs are told by their other
    lines alone, and blank lines between the first and the last line of a deleted run go with it.
    """
    docs = docs.drop("n_lines", "n_removed", "longest_run")
    runs = materialise(repeated_runs(docs.select("doc_id", "text"), min_lines, min_chars, across_blank), "runs").withColumnsRenamed({"doc_id": "_run_doc", "runs": "_runs", "longest": "_longest"})
    # runs grow with the documents: the join is by shuffle at every size
    joined = docs.join(runs.hint("merge"), F.col("doc_id").cast("long") == F.col("_run_doc"), "left")
    lines = F.split(F.col("text"), "\n")
    if across_blank:
        size = F.size(lines)
        full = F.filter(F.transform(lines, lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
        begin, end = (lambda r: F.coalesce(F.get("_full", r["begin"]), size)), (lambda r: F.coalesce(F.get("_full", r["end"] - 1) + 1, size))
        joined = joined.withColumn("_full", F.when(F.col("_runs").isNotNull(), full))
        joined = joined.withColumn("_runs", F.transform("_runs", lambda r: F.struct(begin(r).alias("begin"), end(r).alias("end"))))
    within = lambda i: F.exists("_runs", lambda r: (r["begin"] <= i) & (i < r["end"]))
    kept = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~within(i)), "\n"))
    removed = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["end"] - r["begin"])
    made = F.struct(
        kept.alias("_kept"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_longest", F.lit(0)).cast("long").alias("longest_run"),
    )
    # made once for each row: a caller's filter is not copied through a generator as it is through a projection
    rows = joined.select(*[c for c in docs.columns if c != "text"], F.inline(F.array(made)))
    return rows.select(*[F.col("_kept").alias(c) if c == "text" else F.col(c) for c in docs.columns], "n_lines", "n_removed", "longest_run")
