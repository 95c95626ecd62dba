"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs. DataFrame functions only.

A fingerprint is a vector of sums. Its first part adds, for every paragraph (a line), eight 32-bit hashes, modulo
2^32: equality whatever the order. Its second part adds, for every feature of a paragraph, 128 bits (two hashes), each
into a lane of its own, two lanes of 32 bits in a sum; lanes never carry into each other, as no text has 2^31 features.
With n features, the lanes 2c - n are an unbiased sketch of the multiset of features, and the cosine of two of them
estimates the cosine of the multisets with a standard error of 1 / sqrt(128), 0.09, at most.
Features are the paragraph itself and those windows of GRAM code points at any place in it whose hash says so, one of
EACH: which are taken depends on their content alone, in any script, so that text put in or taken out changes the windows
it touches and leaves the others as they are.
A paragraph is inserted or deleted by adding or subtracting its vector (`combine`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_key, stash, texts

#: Code points of a window, and how many windows there are for each that is taken.
GRAM, EACH = 8, 8
#: Code points at which the windows begin that are in memory at once; a piece of a line has what its last windows reach into.
PIECE = 65_536
PIECES, WINDOWS = rf"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}", rf"(?s)(?=(.{{{GRAM}}}))."
HASHES, SHIFTS = 2, 32  # hashes of a feature; each gives SHIFTS sums of two lanes
FIELD, LANE = 1 | 1 << 32, 0xFFFFFFFF
WORDS = [f"e{i}" for i in range(8)]
SUMS = [f"s{i}" for i in range(HASHES * SHIFTS)]
VECTOR = [*WORDS, *SUMS, "pieces"]


def vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, repeats (rows of the key) and the vector's columns, one row per key. Rows of a key must have equal texts, not
    null, and count once.

    A document's paragraphs are read by one task and summed there, so that texts are not shuffled for this.
    """
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    hashes = [F.xxhash64(F.lit(i), "line").alias(f"h{i}") for i in range(4)]
    pieces = F.concat(F.array("line"), F.regexp_extract_all("line", F.lit(PIECES), F.lit(1)))
    lines = lines.select(key, "at", *hashes, F.posexplode(pieces).alias("of", "piece"))
    first = F.col("of") == 0
    # a match consumes one code point of its window, so that there is a window at each that has GRAM of them
    features = F.when(first, F.array("piece")).otherwise(F.regexp_extract_all("piece", F.lit(WINDOWS), F.lit(1)))
    parts = lines.select(key, "at", "of", *(f"h{i}" for i in range(4)), F.explode(features).alias("feature"))
    parts = parts.where(first | (F.pmod(F.xxhash64(F.lit(9), "feature"), F.lit(EACH)) == 0))
    whole = [F.when(first, x).otherwise(F.lit(0).cast("long")) for i in range(4) for x in (F.shiftrightunsigned(f"h{i}", 32), F.col(f"h{i}").bitwiseAND(F.lit(LANE)))]
    start = F.when(first & (F.col("at") == 0), 1).otherwise(0).alias("start")
    kind = F.when(first, 20).otherwise(10)  # a line of GRAM code points is another feature than its window
    parts = parts.select(key, start, *(x.alias(n) for x, n in zip(whole, WORDS)), *(F.xxhash64(kind + i, "feature").alias(f"p{i}") for i in range(HASHES)))
    sums = [F.sum(F.shiftrightunsigned(f"p{i}", j).bitwiseAND(F.lit(FIELD))).alias(SUMS[i * SHIFTS + j]) for i in range(HASHES) for j in range(SHIFTS)]
    summed = parts.groupBy(key).agg(F.sum("start").alias("repeats"), *(F.sum(n).alias(n) for n in WORDS), *sums, F.count(F.lit(1)).alias("pieces"))
    once = lambda n: F.expr(f"{n} div repeats")
    lanes = lambda n: F.shiftleft(F.expr(f"shiftrightunsigned({n}, 32) div repeats"), 32).bitwiseOR(F.expr(f"({n} & {LANE}L) div repeats"))
    return summed.select(key, "repeats", *(once(n).bitwiseAND(F.lit(LANE)).alias(n) for n in WORDS), *(lanes(n).alias(n) for n in SUMS), once("pieces").alias("pieces"))


def as_text(prefix: str = "") -> Column:
    """The fingerprint as hexadecimal text."""
    c = lambda n: F.col(prefix + n)
    return F.concat(*(F.lpad(F.lower(F.hex(c(n))), 8, "0") for n in WORDS), *(F.lpad(F.lower(F.hex(c(n))), 16, "0") for n in SUMS), F.lower(F.hex(c("pieces"))))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)


def sketch(prefix: str = "") -> Column:
    """The lanes 2c - n of a vector."""
    halves = [x for n in SUMS for x in (F.shiftrightunsigned(prefix + n, 32), F.col(prefix + n).bitwiseAND(F.lit(LANE)))]
    return F.array(*(x.cast("double") * 2 - F.col(prefix + "pieces") for x in halves))


def likeness(a: str, b: str) -> Column:
    """Cosine of two sketches (columns lanes), 0 at least; 1 if the fingerprints (columns text) are equal."""
    x, y = F.col(a + "lanes"), F.col(b + "lanes")
    size = F.sqrt(dot(x, x) * dot(y, y))
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / size))
    return F.when(F.col(a + "text") == F.col(b + "text"), 1.0).when(size == 0, 0.0).otherwise(near)


def combine(a: str, b: str, sign: int = 1) -> list[Column]:
    """The vector of the multiset a + b, or a - b: paragraphs inserted into or deleted from a fingerprint."""
    return [*((F.col(a + n) + sign * F.col(b + n)).bitwiseAND(F.lit(LANE)).alias(n) for n in WORDS), *((F.col(a + n) + sign * F.col(b + n)).alias(n) for n in [*SUMS, "pieces"])]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, 128 bits of both."""
    return texts(docs).withColumn("row", row_key(F.col("doc_id"), F.col("text")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and fingerprint; null text is empty. Rows without a doc_id, or that repeat one, are
    rows of their own. No rows in, no rows out."""
    found = vectors(rows_of(docs).select(F.struct("doc_id", "row").alias("key"), "text"), "key", "text")
    return found.select("key.doc_id", as_text().alias("fingerprint"), F.explode(F.sequence(F.lit(1), "repeats")).alias("copy")).drop("copy")


def neighbours(ids: DataFrame) -> DataFrame:
    """ids (doc_id, row, n_chars) with next_row: the row that follows by descending doc_id, those without one last, and
    after the last the first. Rows of one doc_id come by descending `row`, which must be unique.

    Ranges of ids are numbered each by themselves; the edges between them are one row a range.
    """
    ranged = ids.repartitionByRange(F.desc_nulls_last("doc_id"), F.desc("row")).withColumn("part", F.spark_partition_id())
    ranged = stash(ranged, "ranges")  # numbers of partitions stay as they are
    order = (F.desc_nulls_last("doc_id"), F.desc("row"))
    inside = Window.partitionBy("part").orderBy(*order)
    numbered = ranged.withColumn("inner_next", F.lead("row").over(inside)).withColumn("at", F.row_number().over(inside))
    parts = Window.orderBy("part")  # one row a partition
    heads = numbered.where("at = 1").select("part", F.col("row").alias("head"))
    follow = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follow"))
    return numbered.join(F.broadcast(follow), "part").select("doc_id", "row", "n_chars", F.coalesce("inner_next", "follow").alias("next_row"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, one row per row of docs.

    doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has the last floor(n_chars / 3) code points replaced by as many (or all) of the first ones of the
    next document by descending doc_id; after the last comes the first, and a single document is its own next one.
    Null text is empty; an empty text's edited text is empty. Rows of one doc_id with different texts follow each other
    by descending text hash, rows without a doc_id come after all others, and rows that repeat both doc_id and text have
    one place and get equal results. No rows in, no rows out.
    """
    ids = rows_of(docs).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text").cast("long")).alias("n_chars"))
    order = stash(neighbours(ids), "order")
    named = lambda df, p, *more: df.select(F.col("key.row").alias("row"), *more, *(F.col(n).alias(p + n) for n in VECTOR))
    giver = order.select(F.col("next_row").alias("row"), F.col("row").alias("for_row"), F.floor(F.col("n_chars") / 3).cast("int").alias("give"))
    # one shuffle of the texts: each document meets its own place in the order and the document that its head goes to
    placed = order.join(giver, "row").select("row", "n_chars", "for_row", "give")
    dealt = rows_of(docs).select("row", "text").join(placed, "row")
    heads = dealt.select(F.col("for_row").alias("row"), F.substring("text", F.lit(1), F.col("give")).alias("tail")).groupBy("row").agg(F.first("tail").alias("tail"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int"))
    edits = dealt.join(heads, "row").select("row", "n_chars", F.concat(kept, "tail").alias("edited"))
    new = vectors(edits.select(F.struct("row", "n_chars", F.sha2("edited", 256).alias("sha")).alias("key"), F.col("edited").alias("text")), "key", "text")
    b = stash(named(new, "b_", F.col("key.n_chars").alias("n_chars"), F.col("key.sha").alias("edited_sha256")), "edited")
    own = vectors(rows_of(docs).select(F.struct("doc_id", "row").alias("key"), "text"), "key", "text")
    a = stash(named(own, "a_", F.col("key.doc_id").alias("doc_id"), "repeats"), "vectors")
    c = a.join(giver.select("row", "for_row"), "row").select(F.col("for_row").alias("row"), *(F.col("a_" + n).alias("c_" + n) for n in VECTOR))
    joined = a.join(b, "row").join(c, "row")
    joined = joined.select("doc_id", "repeats", "n_chars", "edited_sha256", *(x for p in ("a_", "b_", "c_") for x in (as_text(p).alias(p + "text"), sketch(p).alias(p + "lanes"))))
    out = joined.select("doc_id", "repeats", "n_chars", "edited_sha256", F.col("a_text").alias("fingerprint"), F.col("b_text").alias("edited_fingerprint"), likeness("a_", "b_").alias("near_edited"), likeness("a_", "c_").alias("near_next"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).drop("copy", "repeats")
