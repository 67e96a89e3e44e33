"""Document fingerprints by one-permutation MinHash with optimal densification, in SQL expressions alone.

Every word shingle is hashed once; the hash's top bits name its bin and the least hash of a bin stands for it. An
empty bin takes the value of the first full bin in a pseudo-random probe order of its own, which is the same for all
documents: ``PROBES`` tries by a hash of bin and try, then the full bin of least hash. ``BITS`` low bits of each bin
are packed into longs. Two fingerprints agree in a bin by likeness, or by chance with probability 2^-BITS, and the
estimate takes that chance out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import clean_text, shuffle_partitions

BIN_BITS, BITS, PROBES, WIDTH = 8, 4, 12, 5
BINS = 1 << BIN_BITS
#: White space between words.
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingle_hashes(text: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; a shorter text is one run, and one without a word has none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(w, n))).otherwise(runs)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """Packed bins as longs, first bin first; no long where the text has no word."""
    shift, half = 64 - BIN_BITS, BINS // 2
    top = lambda x: F.shiftright(x, shift)
    blank = F.lit((1 << shift) - 1)
    blanks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft((b - half).cast("bigint"), shift).bitwiseOR(blank))
    full = lambda x: x.bitwiseAND(blank) != blank

    def filled(bins: Column, own: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            tries = [F.get(bins, F.shiftrightunsigned(F.xxhash64(i, F.lit(t)), shift).cast("int")) for t in range(PROBES)]
            probe = F.coalesce(*[let(t, lambda d: F.when(full(d), d)) for t in tries], let(own, lambda o: F.element_at(F.array_sort(F.transform(o, lambda d: F.struct(F.xxhash64(i, top(d)), d.alias("d")))), 1)["d"]))
            return F.xxhash64(F.when(full(x), x).otherwise(probe), i)  # borrowed values differ by bin, so that chance collisions do

        return F.transform(bins, value)

    def packed(values: Column) -> Column:
        each = 64 // BITS
        pack = lambda w: F.aggregate(F.slice(values, w * each + 1, each), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint"))))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), pack)

    def of(hashes: Column) -> Column:
        ordered = F.sort_array(F.concat(hashes, blanks))
        least = let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1)))))
        dense = let(least, lambda b: let(F.filter(b, full), lambda own: filled(b, own)))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(let(dense, packed))

    return let(shingle_hashes(text, width), of)


def likeness(a: Column, b: Column) -> Column:
    """Collision-corrected share of equal bins, 0 to 1; two fingerprints of no word are alike, one such is like no other."""
    each = 64 // BITS
    ones = F.lit(sum(1 << (BITS * i) for i in range(each)))

    def equal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for k in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.lit(each) - F.bit_count(d.bitwiseAND(ones))

    share = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def to_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(rows: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """``rows`` (key, tie, ...) with next_<column> of the row after, by key and tie, the first row's after the last.

    Rows are dealt into ranges of keys, and each range also gets the first row of the range after it, so that no task
    sees more than its range.
    """
    splits = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    splits = sorted({int(s) for s in splits})
    bucket = F.lit(0)
    if splits:
        known, steps = F.array(*[F.lit(s) for s in splits]), [1 << k for k in reversed(range(len(splits).bit_length()))]
        go = lambda low, step: F.when(F.get(known, low + step - 1) <= F.col("key"), low + step).otherwise(low)
        bucket = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), go)
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted(rows.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).collect())  # one row a range
    ring = {f.bucket: (f["first"].key, f["first"].tie, firsts[i - 1].bucket) for i, f in enumerate(firsts)}
    by_bucket = lambda k, kind: F.get(F.array(*[F.lit(ring[b][k] if b in ring else None).cast(kind) for b in range(len(splits) + 1)]), F.col("bucket"))
    is_first = (F.col("key") == by_bucket(0, "long")) & (F.col("tie") == by_bucket(1, "long"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    places = F.when(is_first, F.array(own, F.struct(by_bucket(2, "int").alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    dealt = rows.withColumn("place", F.explode(places)).withColumns({"bucket": F.col("place.bucket"), "guest": F.col("place.guest")}).drop("place")
    order = Window.partitionBy("bucket").orderBy("guest", "key", "tie")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("guest = 0").drop("bucket", "guest")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. The edited text has its last quarter of code points replaced by the beginning of the
    next text by doc_id (after the last, the first). Rows without a doc_id come before all others, and rows that repeat
    one follow each other by a hash of their texts. A table of one row is its own next; an empty one gives no rows.
    Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), clean_text().alias("body"))
    rows = rows.withColumns({"tie": F.xxhash64("body"), "print": fingerprint(F.col("body"), width)})
    rows = with_next(rows, ["body", "print"], shuffle_partitions(docs.sparkSession))
    length = F.char_length("body")
    quarter = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), length - quarter), F.substring(F.col("next_body"), F.lit(1), quarter))
    rows = rows.select("doc_id", length.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited"), width).alias("edited_print"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_hex(F.col("print")).alias("fingerprint"),
        to_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
