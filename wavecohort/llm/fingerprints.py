"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions alone.

A fingerprint keeps every shingle hash below a fixed share of the hash range. It grows with the
document, so a short text's share in a much longer one can be told, and fingerprints of parts
merge into that of the whole. A text with no hash below the threshold keeps its smallest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = 5
#: One hash in so many is kept.
KEEP_ONE_IN = 8
#: Ranges of ids for each shuffle partition.
RANGES = 4
BLANKS = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hash of every ``words`` consecutive words, lower-cased; of all words if there are fewer; none without words."""
    none = F.array().cast("array<string>")
    found = _let(
        F.btrim(F.lower(text), F.lit(BLANKS)),
        lambda c: F.when(c == "", none).otherwise(F.split(c, r"[ \t\n\x0B\f\r]+")),
    )

    def hashes(w: Column) -> Column:
        n = F.size(w)
        long = F.transform(
            F.slice(w, 1, F.greatest(n - (words - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]),
        )
        short = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= words, long).otherwise(short)

    return _let(found, hashes)


def sketch(hashes: Column, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """The sorted distinct hashes below the threshold, or the smallest one."""
    threshold = F.lit(-(1 << 63) + (1 << 64) // keep_one_in)

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < threshold)
        return _let(low, lambda x: F.when((F.size(x) > 0) | (F.size(h) == 0), x).otherwise(F.array(F.array_min(h))))

    return F.array_sort(F.array_distinct(_let(hashes, kept)))


def fingerprint(text: Column) -> Column:
    """Sketch of a text; null is empty. Equal texts have equal sketches."""
    return sketch(shingle_hashes(F.coalesce(text, F.lit(""))))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two parts together (shingles across their border aside)."""
    return sketch(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; 1 if neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 if a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketched: Column) -> Column:
    """Hexadecimal digits of the hashes, one after the other."""
    return F.lower(F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _range_of(doc_id: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most ``doc_id``, looked up in two steps; -1 for null."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    firsts = F.lit([g[0] for g in groups])
    inner = F.array(*[F.lit(g) for g in groups])
    upto = lambda a: F.size(F.filter(a, lambda b: b <= doc_id))
    found = _let(upto(firsts), lambda g: F.when(g == 0, 0).otherwise((g - 1) * step + upto(F.get(inner, g - 1))))
    return F.when(doc_id.isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, values: dict[str, Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds each value and, as ``next_<name>``, that of the next document in descending doc_id; after the last comes the first.

    Ids are cut into ranges of about as many rows; a range is ordered in one task, and the first
    row of the range that follows is added at its end. As many bounds as ranges come to the
    driver, a fixed number for each shuffle partition.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(doc_id, shares, F.lit(max(10_000, 10 * ranges)))).first()[0] or []
    placed = docs.select("*", _range_of(F.col(doc_id), sorted(set(bounds))).alias("_range"))

    heads = placed.groupBy("_range").agg(F.max(doc_id).alias("_top"))
    down = Window.orderBy(F.desc("_range"))
    over = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_range").over(down), F.min("_range").over(over))
    heads = heads.select(F.col("_range").alias("_of"), "_top", before.alias("_to"))
    # At most one row for each range, so as small as the bounds above; texts are not dealt out for it.
    here = (F.col("_range") == F.col("_of")) & F.col(doc_id).eqNullSafe(F.col("_top"))
    first = placed.join(F.broadcast(heads), here)
    rest = [c for c in docs.columns if c != text]
    extra = first.groupBy("_to").agg(F.max(F.struct(text, *rest)).alias("_row"))
    extra = extra.select("_row.*", F.col("_to").alias("_range"), F.lit(True).alias("_extra"))

    rows = placed.withColumn("_extra", F.lit(False)).unionByName(extra).withColumns(values)
    order = Window.partitionBy("_range").orderBy("_extra", F.desc_nulls_last(doc_id), F.desc_nulls_last(text))
    rows = rows.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values])
    return rows.where("not _extra").drop("_range", "_extra")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text has its last half replaced by as much of the next document's start. Null
    texts are empty; a table of one row has that row as its own next; rows that repeat a
    doc_id follow each other by descending text, rows without doc_id come last. An empty table gives an
    empty one; other columns are ignored.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paired = with_next(own, {"text": F.col("text"), "sketch": fingerprint(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    paired = paired.withColumn("edited_sketch", fingerprint(F.col("edited")))
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
    )
