"""Document fingerprints by one-permutation MinHash with optimal densification.

A text's word shingles are hashed once. The leading bits of a hash choose one of
BINS bins, and each bin keeps its least hash. An empty bin borrows from another:
a hash of the bin and of the number of the try names a bin, until one is not
empty. Two texts that are empty at the same bin thus borrow from the same place
whenever they can, and every bin agrees with the probability of the texts'
resemblance. The lowest BITS bits of each bin are packed; as unequal bins still
agree in those with probability 2^-BITS, likeness takes that away:
(share of equal bins - 2^-BITS) / (1 - 2^-BITS), held between 0 and 1.

Only DataFrame functions are used, a row at a time: hashes are sorted inside the
row, so nothing is exploded and nothing shuffled. `edited` pairs every document
with the next one: ids are ordered by ranges of ids, of which only the first row
crosses over to the range before it, texts move once by key, and of the next
text only as much as is needed moves a second time.

Defined results: a null text is the empty text; without a word the fingerprint is
an empty string, like (1) only another such. Up to SHINGLE words are one
shingle. Documents are ordered by doc_id from the largest, null last, equal ids
by the digest of their text from the largest; rows with equal id and text are one
place in that order and get equal results. A single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

SHINGLE = 5
BINS = 512
BITS = 4
#: Tries in the expression; what is still empty then takes the bin that a hash ranks first.
TRIES = 48
#: Rows of ids in one range of the order.
RANGE = 1 << 16

_PER_WORD = 64 // BITS
_ONES = 0x1111111111111111


def _bin(hashed: Column) -> Column:
    return (F.shiftright(hashed, 64 - (BINS - 1).bit_length()) + BINS // 2).cast("int")


def _low(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def fingerprints(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with `out`, the packed fingerprint (array of longs, empty without a word) of the column `text`.

    Each step is a projection of its own: what a function looks up for each of
    its items must be a column by then.
    """
    kept = df.columns
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    df = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    last = F.greatest(F.size("_w") - shingle, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(shingle))))
    df = df.select(*kept, F.when(F.size("_w") > 0, F.sort_array(grams)).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    least = F.filter("_h", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("_h", i - 1))))
    df = df.select(*kept, least.alias("_m"))
    empty = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
    gaps = F.transform("_m", lambda h, i: F.concat(empty(_bin(h) - F.when(i == 0, -1).otherwise(_bin(F.get("_m", i - 1))) - 1), F.array(_low(h))))
    tail = empty(BINS - 1 - _bin(F.element_at("_m", -1)))
    df = df.select(*kept, "_m", F.when(F.size("_m") > 0, F.concat(F.flatten(gaps), tail)).alias("_b"))

    def filled(value: Column, i: Column) -> Column:
        tries = (F.get("_b", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(TRIES))
        first = F.array_min(F.transform("_m", lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("o"), _low(h).alias("v"))))["v"]
        return F.coalesce(value, *tries, first)

    df = df.select(*kept, F.transform("_b", filled).alias("_f"))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PER_WORD - 1)),
        lambda j: F.aggregate(F.slice("_f", j * _PER_WORD + 1, _PER_WORD), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v)),
    )
    return df.select(*kept, F.coalesce(F.when(F.col("_f").isNotNull(), packed), F.array().cast("array<bigint>")).alias(out))


def written(packed: Column) -> Column:
    """A packed fingerprint as hex digits, one for each bin."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two packed fingerprints."""

    def unequal(x: Column, y: Column) -> Column:
        odd = x.bitwiseXOR(y)
        odd = odd.bitwiseOR(F.shiftrightunsigned(odd, 1))
        return F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 2)).bitwiseAND(F.lit(_ONES)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    by_chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), ((BINS - differ) / F.lit(float(BINS)) - by_chance) / (1 - by_chance))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(F.size(a) == 0, F.lit(1.0)).otherwise(estimate)


def next_places(keys: DataFrame) -> DataFrame:
    """key, n_chars and next_key for `keys` (key, doc_id, sha, n_chars; distinct), from the largest doc_id to the smallest and round again."""
    order = [F.desc_nulls_last("doc_id"), F.desc("sha")]
    ranges = max(1, -(-keys.count() // RANGE), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(keys.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    within = F.lead("key").over(Window.partitionBy("part").orderBy(*order))
    first = F.first("key").over(Window.partitionBy("part").orderBy(*order))
    led = dealt.select("key", "n_chars", "part", within.alias("within"), first.alias("first"))
    # one row per range: the first key of the next range that has any, the last one goes on with the first
    firsts = led.filter(F.col("key") == F.col("first")).select("part", "first")
    around = Window.orderBy("part")
    start = F.first("first").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(around), start).alias("after"))
    return led.join(firsts, "part").select("key", "n_chars", F.coalesce("within", "after").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's.

    The edited text has its last third replaced by as much of the start of the
    next document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "sha"))
    keys = cut(rows.select("key", "doc_id", "sha", F.length("text").cast("long").alias("n_chars")).distinct())
    order = cut(next_places(keys))
    giving = order.select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 3).cast("int").alias("n"))
    # both joins below take these two columns and no others, so that the texts are shuffled once
    texts = rows.select("key", "text")
    given = texts.join(giving.hint("shuffle_hash"), "key").select(F.col("to").alias("key"), F.expr("left(text, n)").alias("start"))
    # rows with equal id and text give equal starts
    given = given.groupBy("key").agg(F.min("start").alias("start"))
    n = F.length("text")
    both = texts.join(given.hint("shuffle_hash"), "key").select(
        "key", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), "start").alias("edited")
    )
    both = both.select("key", "text", "n_chars", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    made = fingerprints(fingerprints(both, "text", "own"), "edited", "changed")
    made = cut(made.select("key", "n_chars", "edited_sha256", "own", "changed"))
    ahead = made.select(F.col("key").alias("next_key"), F.col("own").alias("ahead")).dropDuplicates(["next_key"])
    ahead = order.select("key", "next_key").join(ahead, "next_key").select("key", "ahead")
    doc_id = F.split_part("key", F.lit(":"), F.lit(1)).try_cast("long")  # null where the key starts with nothing
    return made.join(ahead, "key").select(
        doc_id.alias("doc_id"),
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("ahead")).alias("near_next"),
    )
