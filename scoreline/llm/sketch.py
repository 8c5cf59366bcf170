"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle hash is kept when its unsigned value is below ``2**64 / scale``, a
fixed fraction for documents of any length.  Sketches of parts merge by union,
and the share of the smaller sketch found in the larger one estimates how far
one document holds the other, also between very unequal lengths.  A document
none of whose hashes falls below the bound keeps its smallest hash alone.

All work is done with column functions on each row.  The one exchange of the
edit test (``edited_texts``) ranges documents by id; each range also gets the
first document of the next, so no text travels twice and no task sees all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import BLANKS, lower_ascii, partitions, range_bounds, range_bucket

WORDS, SCALE_BITS = 5, 3


def word_hashes(text: Column) -> Column:
    """Hashes of the words: A-Z lower-cased, cut at ASCII white space."""
    trimmed = F.btrim(lower_ascii(text), F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, scale_bits: int = SCALE_BITS) -> DataFrame:
    """``df`` with ``out``: the ascending distinct shingle hashes of column
    ``text`` whose unsigned value is below ``2**(64 - scale_bits)``; for want of
    any, the smallest one.  Fewer words than a shingle: the whole sequence is
    one shingle; no words: an empty sketch.  Built in steps, as each step's
    array is used more than once."""
    h, e, low = f"_{out}_words", f"_{out}_every", f"_{out}_low"
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1)))
    # the smallest in unsigned order: flip the sign bit, take the minimum, flip it back
    flip = F.lit(-2**63).cast("bigint")
    least = F.array_min(F.transform(e, lambda x: x.bitwiseXOR(flip))).bitwiseXOR(flip)
    return (df.withColumn(h, word_hashes(F.col(text)))
            .withColumn(e, F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
                F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, F.lit(words))))))
            .withColumn(low, F.filter(e, lambda x: F.shiftrightunsigned(x, 64 - scale_bits) == 0))
            .withColumn(out, F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low)))
                        .when(F.size(e) > 0, F.array(least)).otherwise(F.col(e)))
            .drop(h, e, low))


def fingerprint(sketched: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of all hashes of two sketches that both have (an estimate of the
    shingle sets' Jaccard similarity); two empty ones: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s hashes that ``b`` has (an estimate of how much of the one
    text is in the other); an empty ``a``: 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, sketch and fingerprint of every row; null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_sketch(rows, "text", "sketch")
    return rows.select(F.col("id").alias(id_col), "sketch", fingerprint(F.col("sketch")).alias("fingerprint"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 ranges: int | None = None) -> DataFrame:
    """Each row with its edited text (the last quarter of its code points, floored,
    replaced by the first as many of the next document) and the sketches of its
    own, the edited and the next text.

    Next is by ascending id, after the last comes the first.  Null ids come
    before all; rows of one id follow each other by a hash of the text.  Null
    text is empty.  One row alone is its own next; no rows give none.  Extra
    columns are ignored.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("tie"), "text")
    keys = ["id", "tie"]
    low = rows.select(F.min(F.struct(*keys)).alias("k")).first().k
    bounds = [b for b in range_bounds(rows, keys, ranges) if low is not None and b != tuple(low)]
    firsts = ([tuple(low)] if low is not None else []) + bounds
    types = dict(rows.dtypes)
    heads = F.array(*[F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(keys, k)]) for k in firsts]) \
        if firsts else F.array(F.struct(*keys))
    n = max(1, len(firsts))
    rows = rows.select("*", range_bucket(rows, keys, bounds).alias("bucket"))
    is_head = F.get(heads, F.col("bucket")) == F.struct(*keys)
    homes = F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.pmod(F.col("bucket") + (n - 1), F.lit(n)).alias("at"), F.lit(True).alias("guest")))
    rows = (with_sketch(rows, "text", "sketch")
            .select("id", "tie", "text", "sketch", F.when(is_head, F.concat(homes, guest)).otherwise(homes).alias("homes"))
            .select("id", "tie", "text", "sketch", F.explode("homes").alias("home")))
    follow = Window.partitionBy("home.at").orderBy("home.guest", "id", "tie")
    rows = rows.select("*", F.lead(F.struct("text", "sketch")).over(follow).alias("next")).where("not home.guest")
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("id", size.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch",
                       F.col("next.sketch").alias("next_sketch"))
    return with_sketch(rows, "edited", "edited_sketch").withColumnRenamed("id", id_col)
