"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A term is a word between white space, its weight S the number of its occurrences.  For each of `SAMPLES` places k every
term gets r and c from Gamma(2, 1) and b from [0, 1), all by hashing (term, k); with t = floor(ln S / r + b) its value is
ln a = ln c - r (t - b + 1).  The least value over the terms is the sample.  Two documents agree at a place if the same
term won with the same t, which happens with the probability of their generalised Jaccard similarity; as ln a is a function
of (k, term, t), the values themselves are compared, as whole multiples of 2**-40.

Words are hashed, sorted and counted within the row, then exploded, so that no word crosses the network: rows are dealt
once, by ranges of doc_id that quantiles of all ids bound, and all steps work within a range.

Null and empty texts have no term and one common fingerprint, which is like itself only.  Equal texts have equal
fingerprints.  Repeated ids are ordered by their texts' hashes; null ids come last.  Columns of `docs` other than doc_id
and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
WHITE = "[ \\t\\n\\x0B\\f\\r]+"
ROWS_IN_RANGE, RANGES = 2_000, 16_384  #: documents in one range of ids, about, and the ranges, at most
SIDE = 128  #: ranges between two coarse bounds
LAST = -(1 << 63)  #: the place of null ids in the descending order
SCALE = float(1 << 40)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th value of a term, as a whole number."""
    h1, h2 = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log((h1.bitwiseAND(0xFFFF) + F.lit(0.5)) * (F.shiftrightunsigned(h1, 48) + F.lit(0.5)) * F.lit(2.0**-32))
    b = F.shiftrightunsigned(h1, 16).bitwiseAND(0xFFFFFFFF) * F.lit(2.0**-32)
    c = -F.log((h2.bitwiseAND(0xFFFFFFFF) + F.lit(0.5)) * (F.shiftrightunsigned(h2, 32) + F.lit(0.5)) * F.lit(2.0**-64))
    t = F.floor(log_weight / r + b)
    return ((F.log(c) - r * (t - b + 1)) * F.lit(SCALE)).cast("long")


def term_runs(text: Column) -> tuple[Column, Column]:
    """Two expressions to be put in columns one after the other: sorted word hashes of `text`, and (of the column `words`) where each run of equal ones starts."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.sort_array(F.transform(F.split(trimmed, WHITE), lambda w: F.xxhash64(w)))
    words = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(words)
    at = F.col("words")
    starts = F.when(F.size(at) > 0, F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) != F.get(at, i - 1))))
    return words, starts


def signatures(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and sig (array of SAMPLES longs, null without a term) of each row; `keys` tell all rows apart."""
    words, starts = term_runs(F.col(text))
    runs = rows.select(*keys, words.alias("words")).withColumn("starts", starts)
    runs = runs.select(*keys, "words", "starts", F.posexplode_outer("starts").alias("j", "start"))
    many = F.coalesce(F.get("starts", F.col("j") + 1), F.size("words")) - F.col("start")
    terms = runs.select(*keys, F.get("words", F.col("start")).alias("term"), F.when(many > 1, F.log(many)).otherwise(0.0).alias("lw"))
    values = [F.min(F.when(F.col("term").isNotNull(), sample(F.col("term"), F.col("lw"), k))).alias(f"s{k}") for k in range(SAMPLES)]
    found = terms.groupBy(*keys).agg(*values)
    return found.select(*keys, F.when(F.col("s0").isNotNull(), F.array(*[f"s{k}" for k in range(SAMPLES)])).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the places at which two signatures agree; 1 for two documents without a term, 0 if only one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def rendered(sig: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit("0" * 16 * SAMPLES))


def in_ranges(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with key, range, and next_range: rows in descending order of key follow each other within a range and, by copies of its first rows (copy = 1), after its last."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"))
    n = ids.count()
    ranges = max(1, min(RANGES, -(-n // ROWS_IN_RANGE)))
    bounds: list[int] = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        bounds = sorted({int(x) for x in ids.agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0]})
    coarse = bounds[SIDE - 1 :: SIDE]

    def place(key: Column) -> Column:
        """How many bounds are at most `key`, found in two steps."""
        if not bounds:
            return F.lit(0)
        fine = F.lit(bounds)
        block = F.size(F.filter(F.lit(coarse), lambda x: x <= key)) * SIDE if coarse else F.lit(0)
        return block + F.size(F.filter(F.slice(fine, block + 1, SIDE), lambda x: x <= key))

    # of each range its greatest key, and the range whose last row it follows: the one above, above the highest the lowest
    tops = sorted((r["range"], r["top"]) for r in ids.select(place(F.col("key")).alias("range"), "key").groupBy("range").agg(F.max("key").alias("top")).collect())
    rows = [(r, top, tops[(k + 1) % len(tops)][0]) for k, (r, top) in enumerate(tops)]
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "range int, key long, above int"))  # RANGES rows at most
    dealt = keyed.withColumn("range", place(F.col("key")).cast("int"))
    dealt = dealt.join(table, ["range", "key"], "left")
    spots = F.when(F.col("above").isNotNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")), F.struct(F.col("above").alias("range"), F.lit(1).alias("copy"))))
    spots = F.explode(F.coalesce(spots, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")))))
    return dealt.select("doc_id", "text", "key", spots.alias("spot")).select("doc_id", "text", "key", "spot.range", "spot.copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, sig, edited_text, edited_sig and next_sig of every document; the next document is that of the next lower id, after the last the first."""
    order = (F.col("copy"), F.col("key").desc(), F.xxhash64("text"))
    w = Window.partitionBy("range").orderBy(*order)
    rows = in_ranges(docs).withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("text").over(w))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.when(F.col("copy") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("range", "rn", "copy", "doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("text").alias("text")), F.struct(F.lit(1).alias("of"), edited.alias("text")))).alias("x"))
    rows = rows.select("range", "rn", "copy", "doc_id", "n_chars", "x.of", "x.text").where("copy = 0 or of = 0")
    keys = ["range", "rn", "copy", "doc_id", "n_chars", "of"]
    rows = rows.withColumn("sha", F.sha2(F.col("text"), 256))
    found = signatures(rows, [*keys, "sha"], "text")
    near = Window.partitionBy("range").orderBy("rn", "of")
    found = found.withColumn("edited_sig", F.lead("sig", 1).over(near)).withColumn("edited_sha256", F.lead("sha", 1).over(near)).withColumn("next_sig", F.lead("sig", 2).over(near))
    return found.where("copy = 0 and of = 0").select("doc_id", "n_chars", "edited_sha256", "sig", "edited_sig", "next_sig")


def op10_fingerprints(docs: DataFrame) -> DataFrame:
    """Contract digest: fingerprints of each document and its edited text, and how like the document's is to that and to the next one's."""
    f = fingerprints(docs.select("doc_id", "text"))
    return f.select(
        "doc_id", "n_chars", "edited_sha256", rendered(F.col("sig")).alias("fingerprint"), rendered(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
