"""Boundary evaluation against gold: Pk, WindowDiff, precision, recall and F1, for all documents and methods at once.

``sizes`` has doc_id and n (blocks); ``ref`` and ``hyp`` have doc_id and gap_idx, each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import doc_order


def auto_k(n: Column, refs: Column) -> Column:
    """Half the mean gold segment length, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n / (refs + 1) / 2)).cast("int")


def _with_k(sizes: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    refs = ref.groupBy("doc_id").agg(F.count(F.lit(1)).alias("refs"))
    joined = sizes.join(refs, "doc_id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    wanted = F.lit(k) if k > 0 else auto_k(F.col("n"), F.col("refs"))
    return joined.withColumn("k", F.greatest(F.lit(1), F.least(wanted, F.col("n") - 1)).cast("int"))


def segment_map(sizes: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    """doc_id, i, seg: boundaries before block i."""
    blocks = sizes.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    marks = cuts.select("doc_id", F.col("gap_idx").cast("int").alias("i"), F.lit(1).alias("cut")).distinct()
    before = doc_order("i").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(marks, ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias(name))


def windows(sizes: DataFrame, ref: DataFrame, hyp: DataFrame, k: int = 0) -> DataFrame:
    """doc_id, i and whether Pk and WindowDiff count an error in the window from i to i+k.

    Segment numbers are prefix sums of boundaries, so that both errors come from the numbers at i and i+k.
    """
    both = segment_map(sizes, ref, "r").join(segment_map(sizes, hyp, "h"), ["doc_id", "i"]).join(_with_k(sizes, ref, k).select("doc_id", "k"), "doc_id")
    ahead = both.select("doc_id", F.col("i").alias("j"), F.col("r").alias("r2"), F.col("h").alias("h2"))
    pairs = both.withColumn("j", F.col("i") + F.col("k")).join(ahead, ["doc_id", "j"])
    return pairs.select("doc_id", "i", ((F.col("r") == F.col("r2")) != (F.col("h") == F.col("h2"))).cast("double").alias("pk"), (F.col("r2") - F.col("r") != F.col("h2") - F.col("h")).cast("double").alias("wd"))


def window_metrics(sizes: DataFrame, ref: DataFrame, hyp: DataFrame, k: int = 0) -> DataFrame:
    """doc_id, pk, window_diff; 0 for documents under two blocks."""
    means = windows(sizes, ref, hyp, k).groupBy("doc_id").agg(F.avg("pk").alias("pk"), F.avg("wd").alias("window_diff"))
    return sizes.select("doc_id").join(means, "doc_id", "left").select("doc_id", F.coalesce("pk", F.lit(0.0)).alias("pk"), F.coalesce("window_diff", F.lit(0.0)).alias("window_diff"))


def boundary_prf(sizes: DataFrame, ref: DataFrame, hyp: DataFrame, tolerance: int = 1) -> DataFrame:
    """doc_id, precision, recall, f1: each found boundary, in order, takes the nearest free gold one within tolerance.

    The earlier gold boundary wins a tie. Without tolerance this is an equi-join; else a fold over each document's
    found boundaries.
    """
    r = ref.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("gap_idx").cast("int"))).alias("r"))
    h = hyp.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("gap_idx").cast("int"))).alias("h"))
    none = F.array().cast("array<int>")
    rows = sizes.select("doc_id").join(r, "doc_id", "left").join(h, "doc_id", "left").select("doc_id", F.coalesce("r", none).alias("r"), F.coalesce("h", none).alias("h"))
    if tolerance <= 0:
        tp = F.size(F.array_intersect("r", "h"))
    else:

        def step(a, x):
            near = F.array_sort(F.transform(F.filter(a["free"], lambda g: F.abs(g - x) <= tolerance), lambda g: F.struct(F.abs(g - x).alias("d"), g.alias("g"))))
            hit = F.try_element_at(near, F.lit(1))
            return F.struct((a["tp"] + F.when(hit.isNotNull(), 1).otherwise(0)).alias("tp"), F.when(hit.isNotNull(), F.array_remove(a["free"], hit["g"])).otherwise(a["free"]).alias("free"))

        tp = F.aggregate("h", F.struct(F.lit(0).alias("tp"), F.col("r").alias("free")), step, lambda a: a["tp"])
    rows = rows.withColumn("tp", tp)
    none_of = lambda c: F.size(c) == 0
    empty = none_of("r") & none_of("h")
    rate = lambda c: F.when(empty, F.lit(1.0)).when(none_of(c), F.lit(0.0)).otherwise(F.col("tp") / F.size(c))
    rows = rows.select("doc_id", rate("h").alias("precision"), rate("r").alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(F.lit(0.0)))


def evaluate(sizes: DataFrame, ref: DataFrame, hyp: DataFrame, method: str, k: int = 0, tolerance: int = 1) -> DataFrame:
    """One row per document: method, num_segments, pk, window_diff, precision, recall, f1."""
    count = hyp.groupBy("doc_id").agg(F.countDistinct("gap_idx").alias("c"))
    rows = sizes.select("doc_id").join(count, "doc_id", "left").select("doc_id", F.lit(method).alias("method"), (F.coalesce("c", F.lit(0)) + 1).alias("num_segments"))
    return rows.join(window_metrics(sizes, ref, hyp, k), "doc_id").join(boundary_prf(sizes, ref, hyp, tolerance), "doc_id")


def final_boundaries(assigned: DataFrame) -> DataFrame:
    """doc_id, gap_idx of a segmentation: each segment's last block, but a document's last."""
    last = assigned.groupBy("doc_id", "seg_idx").agg(F.max("block_idx").alias("gap_idx"))
    return last.withColumn("_top", F.max("seg_idx").over(Window.partitionBy("doc_id"))).where(F.col("seg_idx") < F.col("_top")).select("doc_id", "gap_idx")


def strict(boundaries: DataFrame, sizes: DataFrame) -> DataFrame:
    """The boundaries, failing the job on one outside 0 to n-2 or given twice."""
    again = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "gap_idx")) > 1
    rows = boundaries.withColumn("_again", again).join(sizes, "doc_id")
    wrong = F.col("_again") | (F.col("gap_idx") < 0) | (F.col("gap_idx") > F.col("n") - 2)
    return rows.withColumn("gap_idx", F.when(wrong, F.raise_error(F.format_string("boundary %d of document %d is out of range or repeated", "gap_idx", "doc_id")).cast("int")).otherwise(F.col("gap_idx"))).select("doc_id", "gap_idx")


def format_table(rows: list) -> str:
    """A text table of report rows, for the terminal."""
    lines = [f"{'Method':<28} {'Segs':>5} {'Pk':>7} {'WDiff':>7} {'P':>6} {'R':>6} {'F1':>6}"]
    lines += [f"{r['method']:<28} {r['num_segments']:>5} {r['pk']:>7.4f} {r['window_diff']:>7.4f} {r['precision']:>6.2f} {r['recall']:>6.2f} {r['f1']:>6.2f}" for r in rows]
    return "\n".join(lines)


def warnings(n: int, k: int) -> list[str]:
    """What makes a document's scores hard to read."""
    return [*([f"only {n} blocks: scores of documents under 50 blocks vary much"] if n < 50 else []), *(["k is 1: Pk only looks at neighbouring blocks"] if k <= 1 else [])]
