"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

A text's set is that of the n-gram join: distinct runs of SHINGLE lower-cased words, the whole sequence as one where there are fewer. Each shingle is hashed
once; the top bits of the hash choose one of BINS bins, a bin keeps its least hash. Sorting the hashes together with one sentinel a bin
makes the first value of each bin its minimum, the sentinel where the bin is empty. Empty bins are filled by optimal densification: bin i takes the value
of the first bin with a value in a random sequence of its own, the same for all texts (PROBES hashed probes, then all bins with values by a
hash with i, of which the least wins: every text ends, whatever its size). Of each bin the BITS low-order bits are stored, packed into 64-bit words.

Two fingerprints' likeness is the share P of bins with equal bits, corrected for chance matches: (P - C) / (1 - C) with C = 2 ** -BITS, at least 0; its standard
error for Jaccard similarity J is about sqrt(J (1 - J) / BINS), 0.022 at most for 512 bins with all of them in use, more for texts of few shingles only
in so far as likeness of small sets is itself coarse. A set without shingles has the empty fingerprint: likeness 1 with another one, else 0.

`with_next` finds each row's next document in descending order of doc_id without a global sort in one task: quantiles of doc_id cut the rows into ranges, which a window sorts;
the first row of each range is added to the range before it as a guard (one row a range), the first of all to the last range. Rows move once.

Edges: null text is empty. Rows with null doc_id come last; rows that share a doc_id are ordered by a hash of their text, then the text, so repeated rows follow
each other and reruns agree; they lie in one range. A single row is its own next. Long texts are whole: memory grows with one text. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lowered, partitions, text_of

SHINGLE = 5
BINS = 512
BITS = 4
PROBES = 16
#: A hash has 63 bits: the bin above, the rest below.
REST = 63 - (BINS.bit_length() - 1)
LOW = (1 << REST) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def minima(text: Column) -> Column:
    """The least hash of each bin, null where the bin is empty; in the order of the bins."""
    sentinels = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.shiftleft(b, REST).bitwiseOR(F.lit(LOW)))
    words = F.regexp_extract_all(ascii_lowered(text), F.lit(WORD), F.lit(0))
    # a text of one to four words has one slice, all of it
    hashes = let(words, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(w, i, F.lit(SHINGLE))), 1))).otherwise(F.array().cast("array<bigint>")))
    bin_of = lambda h: F.shiftright(h, REST)
    first = let(F.sort_array(F.concat(hashes, sentinels)), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    return F.transform(first, lambda h: F.when(h.bitwiseAND(F.lit(LOW)) != LOW, h))


def densified(least: Column) -> Column:
    """Every bin's value: its own, or that of another bin."""

    def filled(own: Column, used: Column) -> Column:
        def other(i: Column) -> Column:
            probes = [F.get(own, F.xxhash64(i, F.lit(r)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for r in range(PROBES)]
            rest = F.array_min(F.transform(used, lambda h: F.struct(F.xxhash64(i, F.shiftright(h, REST)).alias("place"), h.alias("h"))))["h"]
            return F.coalesce(*probes, rest)

        return F.transform(own, lambda h, i: F.coalesce(h, other(i)))

    return let(least, lambda own: let(F.filter(own, lambda h: h.isNotNull()), lambda used: F.when(F.size(used) > 0, filled(own, used)).otherwise(F.array().cast("array<bigint>"))))


def packed(values: Column) -> Column:
    """The BITS low-order bits of the values, the first value's uppermost, in 64-bit words."""
    per = 64 // BITS
    one = lambda v, j: F.aggregate(F.slice(v, j * per + 1, F.lit(per)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    return let(values, lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda j: one(v, j))).otherwise(F.array().cast("array<bigint>")))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint (array of 64-bit words) of a text."""
    return packed(densified(minima(text)))


def as_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(one: Column, other: Column) -> Column:
    """The estimated Jaccard similarity, 0 to 1, of two texts from their packed fingerprints."""
    lowest = sum(1 << (BITS * i) for i in range(64 // BITS))

    def apart(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(folded.bitwiseAND(F.lit(lowest)))

    wrong = F.aggregate(F.zip_with(one, other, apart), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0**-BITS
    corrected = (1 - wrong / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((F.size(one) == 0) | (F.size(other) == 0), (F.size(one) == F.size(other)).cast("double")).otherwise(F.greatest(F.lit(0.0), corrected))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (packed words)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), fingerprint(text_of(docs)).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text, fingerprint, next_text, next_fingerprint, of the next document in descending order of doc_id; after the last the first."""
    cells = 4 * partitions(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [(k + 1) / cells for k in range(cells - 1)] or [0.5], 10 * cells)).first()[0] or []
    placed = rows.withColumn("_range", _range(F.col("doc_id"), sorted(set(cuts))))
    order = (F.xxhash64("text").alias("hash"), F.col("text"))
    # one row a range: its largest id, and the range before it
    heads = placed.groupBy("_range").agg(F.max("doc_id").alias("_id"))
    whole = Window.orderBy("_range")
    heads = heads.select("_id", F.coalesce(F.lag("_range").over(whole), F.max("_range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    guards = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("_to").agg(F.min(F.struct(*order))["text"].alias("text"))
    both = placed.withColumn("_guard", F.lit(0)).unionByName(guards.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_to").alias("_range"), F.lit(1).alias("_guard")))
    both = both.withColumn("fingerprint", fingerprint(F.col("text")))
    w = Window.partitionBy("_range").orderBy("_guard", F.col("doc_id").desc_nulls_last(), *order)
    out = both.select("doc_id", "text", "fingerprint", "_guard", F.lead("text").over(w).alias("next_text"), F.lead("fingerprint").over(w).alias("next_fingerprint"))
    return out.where("_guard = 0").drop("_guard")


def _range(doc_id: Column, cuts: list[int], width: int = 64) -> Column:
    """The number of an id's range, larger ids first, nulls last: looked up in blocks of cuts, then inside one."""
    if not cuts:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    below = lambda xs, x: F.size(F.filter(xs, lambda c: c < x))
    # blocks whose first cut is below the id: all but the last of them are wholly below
    found = let(below(longs([b[0] for b in blocks]), doc_id), lambda n: F.when(n == 0, 0).otherwise((n - 1) * width + below(F.get(F.array(*map(longs, blocks)), n - 1), doc_id)))
    return F.when(doc_id.isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - found)


def op13_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - cut), F.left(F.col("next_text"), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
