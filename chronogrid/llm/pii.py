"""Personal data, and terms that reveal it: information-theoretic sanitisation in DataFrame operations only.

Protected entities are the distinct values of four base kinds (email, ip, card, phone), found by their patterns.  Whole texts
are covered by passages of about `PASSAGE` characters, cut at white space; terms are the passages' words, lower-cased, without
the punctuation around them and apart from base values.  Over the corpus, the disclosure of entity e by term t is their
pointwise mutual information, log2(p(t | e) / p(t)), divided by the information content of e, -log2 p(e): 1 if the term
stands in no other passage than e's.  p(t) counts all passages; p(t | e) and p(e) count the contexts of e, which are the
documents that have it, with the words of those passages that it stands in.  Documents with the same least hash of five
words on end are one context, so that copies aren't taken for evidence, and no document is evidence by itself.  A term
that at least `SUPPORT` contexts of e share is generalised to its class from a disclosure of `GENERALISE` on, and removed
from `REMOVE` on, wherever it occurs: near the value, far from it, and in documents without it.  Base values are replaced
by their kinds.

Null and empty texts have no span.  Repeated rows and ids are judged each by their texts, and a text that is repeated is one
context; of terms that reveal several entities the highest disclosure counts; an empty table has an empty result.  Further
columns are passed on.  Patterns are possessive or start at the end of the last match or of a run, so they take linear time
over texts of any length; spans are (start, end) in code points, end exclusive.  Entities and terms are told by 64-bit hashes.

Texts are read three times (base values, frequencies, marks) and never shuffled; those with base values are written once.
(Arrays are exploded by explode_outer, for the optimizer would compute what explode takes once more, to filter by its size.)
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the kinds.  A match of `email` starts where a run of its characters or the last match ends; `card` takes only
#: maximal sequences of 16 to 19 digits, as any other would fail.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be sought.
HINTS = {"email": "@", "phone": "+"}
IP = r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\z"
#: What stands between two words: white space, brackets, quotes or colons, and other punctuation beside these or at the ends.
#: All are characters below 256, which the matcher finds in a table of bits; CURLY ones are taken for PLAIN ones.
_EDGE, _MARK = r" \t\n\x0B\f\r<>()\[\]{}:;,|\"=", r".!?'«»¿¡*_~#&/\\+%$^`-"
BETWEEN = rf"[{_MARK}]*+[{_EDGE}][{_EDGE}{_MARK}]*+|\A[{_MARK}]++|[{_MARK}]++\z"
CURLY, PLAIN = "“”„‘’…", "\"\"\"''."
PASSAGE, SUPPORT, GENERALISE, REMOVE = 8_192, 2, 0.6, 0.85
WORDS = 5  #: words of which the least hash tells a context
EVERY = 0  #: stands for any term at all, where passages are counted
FILTER_LONGS = 1 << 15  #: 64-bit numbers in a filter of terms or entities; a fuller one lets more through, and nothing is lost
ROWS = 2_000  #: documents in one part, at least
STEP = 32  #: matches that are placed together

SPAN = "array<struct<start:int,end:int,value:string>>"


def bound(value: Column, fn) -> Column:
    """fn(value), the value being evaluated once however often `fn` and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def step_starts(lengths: Column) -> Column:
    """The sum of all lengths before each step of STEP of them."""
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda k: F.aggregate(F.slice(lengths, k * STEP + 1, STEP), F.lit(0), lambda acc, x: acc + x))
    return F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def start_of(lengths: Column, starts: Column, i: Column) -> Column:
    """The sum of the lengths before number i: of whole steps, from their table, and of the rest."""
    step = F.floor(i / STEP).cast("int")
    return F.get(starts, step) + F.aggregate(F.slice(lengths, step * STEP + 1, i % STEP), F.lit(0), lambda acc, x: acc + x)


def located(text: Column, pattern: str) -> Column:
    """Start, end and value of all matches, left to right, of a column that isn't null."""
    length = F.char_length

    def place(matches: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, v: length(g) + length(v))
        wanted = F.transform(matches, lambda v, i: F.struct(i.alias("i"), v.alias("value")))

        def span(x: Column, n: Column, starts: Column) -> Column:
            start = start_of(n, starts, x["i"]) + length(F.get(gaps, x["i"]))
            return bound(start, lambda at: F.struct(at.alias("start"), (at + length(x["value"])).alias("end"), x["value"].alias("value")))

        return bound(lengths, lambda n: bound(step_starts(n), lambda starts: F.transform(wanted, lambda x: span(x, n, starts))))

    none = F.array().cast(SPAN)
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, bound(F.split(text, pattern, -1), lambda g: place(m, g))).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits, every second one from the right doubled and its digits summed, add up to a multiple of ten."""
    d = F.reverse(digits(value))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), add) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind; those that fail its test are dropped and not sought anew."""
    valid = {"email": lambda v: F.lit(True), "ip": lambda v: v.rlike(IP), "card": luhn, "phone": lambda v: F.char_length(digits(v)).between(8, 15)}[kind]
    found = F.filter(located(text, PATTERNS[kind]), lambda x: valid(x["value"]))
    return F.when(text.contains(HINTS[kind]), found).otherwise(F.array().cast(SPAN)) if kind in HINTS else found


def entity(kind: str, value: Column) -> Column:
    """The name of a protected value, whatever its spelling."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else digits(value))


def hashed(c: Column) -> Column:
    return F.xxhash64(c)


def plain(text: Column) -> Column:
    curly = F.lit(False)
    for c in CURLY:
        curly = curly | text.contains(c)
    return F.when(curly, F.translate(text, CURLY, PLAIN)).otherwise(text)


def terms_of(text: Column) -> Column:
    """Hashes of the words of a text, lower-cased; empty ones between two separators count as a word that nobody seeks."""
    return F.transform(F.split(F.lower(plain(text)), BETWEEN, -1), hashed)


def words_at(text: Column, keep=None) -> Column:
    """Start, end and hash of the words of a text, of those alone whose hash `keep` accepts; words aren't empty."""

    def place(words: Column, seps: Column) -> Column:
        lengths = F.transform(words, lambda w, i: F.char_length(w) + F.coalesce(F.char_length(F.get(seps, i)), F.lit(0)))
        wanted = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.char_length(w).alias("n"), hashed(F.lower(w)).alias("t"))), lambda x: (x["n"] > 0) & keep(x["t"]) if keep else x["n"] > 0)

        def put(starts: Column, n: Column) -> Column:
            at = lambda x: start_of(n, starts, x["i"])
            return F.transform(wanted, lambda x: bound(at(x), lambda a: F.struct(a.alias("start"), (a + x["n"]).alias("end"), x["t"].alias("t"))))

        return bound(lengths, lambda n: bound(step_starts(n), lambda starts: put(starts, n)))

    return bound(plain(text), lambda t: bound(F.split(t, BETWEEN, -1), lambda ws: bound(F.regexp_extract_all(t, F.lit(BETWEEN), F.lit(0)), lambda seps: place(ws, seps))))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, spans (kind, start, end, entity) of all base values by kind, then start; and the text of those that have one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(F.lit(1), text).alias("text_hash"))
    found = own.select("*", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), entity(kind, x["value"]).alias("entity")))

    found = found.select("doc_id", "text", "text_hash", F.concat(*map(named, KINDS)).alias("spans"))
    return found.select("doc_id", "text_hash", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("held"))


def passages(text: Column) -> Column:
    """The text in parts of PASSAGE code points and the rest of a word; together they are the whole text."""
    return F.when(F.char_length(text) <= PASSAGE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PASSAGE}}}\S*+"), F.lit(0)))


class Filter:
    """Tells most numbers that aren't in a column of others, by two bits each in a table of FILTER_LONGS numbers that the cluster ors together.

    However full the table is, the join that follows is exact.
    """

    def __init__(self, values: DataFrame, name: str):
        spots = values.select(F.explode_outer(F.array(*self.spots(F.col(name)))).alias("spot")).where("spot is not null")
        bits = spots.select(F.shiftright("spot", 6).alias("at"), F.expr("shiftleft(1L, spot & 63)").alias("bits"))
        filled = {r["at"]: r["bits"] for r in bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()}  # FILTER_LONGS rows at most
        table = pa.table({"table": pa.array([[filled.get(k, 0) for k in range(FILTER_LONGS)]], pa.list_(pa.int64()))})
        # a row of its own: as a literal it would be written out wherever Spark's driver describes a plan, and kept with each
        self.rows = values.sparkSession.createDataFrame(table)

    @staticmethod
    def spots(value: Column) -> list[Column]:
        return [x.bitwiseAND(64 * FILTER_LONGS - 1).cast("int") for x in (value, F.shiftright(value, 32))]

    def beside(self, rows: DataFrame) -> DataFrame:
        """`rows` with the table, which `within` reads; it is never written, for the optimizer puts it where it is read."""
        return rows.withColumn("__filter", self.rows.scalar())

    def within(self, use) -> Column:
        """use(may_have), may_have telling of a column of numbers whether the filter lets them through; for use in lambdas as well."""

        def told(table: Column) -> Column:
            def may_have(value: Column) -> Column:
                one, other = (F.getbit(F.get(table, F.shiftright(x, 6)), x.bitwiseAND(63)) == 1 for x in self.spots(value))
                return one & other

            return use(may_have)

        return bound(F.col("__filter"), told)


def shared_entities(base: DataFrame) -> DataFrame:
    """(e): hashes of the entities that different texts have; others have no second context."""
    found = base.where("held is not null").select("text_hash", F.explode_outer(F.array_distinct(F.transform("spans", lambda s: hashed(s["entity"])))).alias("e"))
    return found.groupBy("e").agg(F.min("text_hash").alias("one"), F.max("text_hash").alias("other")).where("one <> other").select("e")


def co_occurrence(base: DataFrame, shared: DataFrame) -> DataFrame:
    """(e, t, both) of shared entities and terms: the contexts of e that have t, SUPPORT at least; at t = EVERY all of them."""
    known = Filter(shared, "e")
    slim = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), hashed(s["entity"]).alias("e")))
    found = known.beside(base.where("held is not null")).select("held", known.within(lambda may_have: F.filter(slim, lambda s: may_have(s["e"]))).alias("own"), "spans").where(F.size("own") > 0)
    told = lambda ws: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - WORDS, F.lit(0)) + 1), lambda k: hashed(F.slice(ws, k, WORDS))))
    context = bound(F.split(F.lower("held"), r"\s+"), told).alias("context")
    # each passage with its place: the one before it ends there
    parts = found.select("own", "spans", context, passages(F.col("held")).alias("parts"))
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x))))
    parts = parts.select("own", "spans", "context", F.explode_outer(F.arrays_zip(F.col("parts").alias("text"), F.slice(ends, 1, F.size("parts")).alias("start"))).alias("p"))
    parts = parts.select("own", "spans", "context", F.col("p.start").alias("start"), (F.col("p.start") + F.char_length("p.text")).alias("end"), F.col("p.text").alias("text"))
    own = F.array_distinct(F.transform(F.filter("own", lambda s: (s["start"] >= F.col("start")) & (s["start"] < F.col("end"))), lambda s: s["e"]))

    def terms(near: Column) -> Column:
        """Hashes of the words that no base value has a character of."""
        free = F.filter(words_at(F.col("text")), lambda w: ~F.exists(near, lambda s: (s["start"] < w["end"] + F.col("start")) & (s["end"] > w["start"] + F.col("start"))))
        return F.array_distinct(F.concat(F.array(F.lit(EVERY).cast("long")), F.transform(free, lambda w: w["t"])))

    near = F.filter("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    words = parts.withColumn("es", own).where(F.size("es") > 0).select("es", "context", bound(near, terms).alias("ts"))
    per = words.select(F.explode_outer("es").alias("e"), "context", "ts").join(shared, "e", "left_semi")
    pairs = per.select("e", "context", F.explode_outer("ts").alias("t"))
    return pairs.groupBy("e", "t").agg(F.countDistinct("context").alias("both")).where(F.col("both") >= SUPPORT)


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, df): how many passages of `docs` have each of `terms` (t); at t = EVERY, how many passages there are."""
    known = Filter(terms, "t")
    every = known.beside(docs.where("text is not null").select(F.explode_outer(passages(F.col("text"))).alias("p")))
    found = known.within(lambda may_have: F.filter(terms_of(F.col("p")), may_have))
    every = every.select(F.array_distinct(F.concat(F.array(F.lit(EVERY).cast("long")), found)).alias("ts")).select(F.explode_outer("ts").alias("t"))
    return every.groupBy("t").agg(F.count("*").alias("df"))


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(t, disclosure) of the terms that reveal an entity to GENERALISE or more, as a table of its own."""
    # what is read more than once is kept by the executors, and computed anew where one is lost
    shared = shared_entities(base).persist()
    pairs = co_occurrence(base, shared).persist()
    terms = pairs.where(F.col("t") != EVERY)
    df = frequencies(docs, terms.select("t").distinct()).persist()
    n = F.lit(float((df.where(F.col("t") == EVERY).first() or [0, 0])[1]))
    of = pairs.where(F.col("t") == EVERY).select("e", F.col("both").alias("n_e"))
    rated = terms.join(of, "e").join(df, "t", "left")
    information = -F.log2(F.col("n_e") / n)
    mutual = F.log2(F.col("both") / F.col("n_e") * n / F.greatest("df", "both"))
    rated = rated.select("t", F.when(information > 0, mutual / information).alias("disclosure"))
    shown = rated.where(F.col("disclosure") >= GENERALISE).groupBy("t").agg(F.max("disclosure").alias("disclosure"))
    shown = cut(sized(shown, pairs.count(), 100_000), "disclosing-terms")
    for kept in (df, pairs, shared):
        kept.unpersist()
    return shown


def marks(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """(t_id, t_hash, terms): where the texts have the terms `shown`, as (start, end, disclosure)."""
    known = Filter(shown, "t")
    maybe = known.beside(docs.where("text is not null").select("doc_id", "text")).where(known.within(lambda may_have: F.exists(terms_of(F.col("text")), may_have)))
    words = maybe.select("doc_id", F.xxhash64(F.lit(1), F.col("text")).alias("text_hash"), known.within(lambda may_have: words_at(F.col("text"), may_have)).alias("ws"))
    words = words.select("doc_id", "text_hash", F.explode_outer("ws").alias("w"))
    hits = words.select("doc_id", "text_hash", "w.start", "w.end", "w.t").join(shown, "t")  # (texts without a hit have a null here)
    hits = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "disclosure"))).alias("terms"))
    return hits.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "terms")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (kind, start, end, entity) and terms (start, end, disclosure) of all rows, without their texts."""
    rows = docs.count()
    base = cut(sized(with_base_spans(docs), rows, ROWS), "base-spans")
    terms = marks(docs, disclosing(docs, base))
    out = base.drop("held").join(terms, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")), "left")
    free = F.filter("terms", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    return sized(out.select("doc_id", "text_hash", "spans", F.coalesce(free, F.array().cast("array<struct<start:int,end:int,disclosure:double>>")).alias("terms")), rows, ROWS)


def sanitised(text: Column, spans: Column, terms: Column) -> Column:
    """The text with base values as their kinds, and terms as their classes or left out; overlapping spans go together as the first of them."""
    base = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("label")))

    def of_class(x: Column) -> Column:
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        return F.when(x["disclosure"] >= REMOVE, "").when(value.rlike(r"[0-9]"), "[NUMBER]").when(value.rlike(r"\A\p{Lu}"), "[NAME]").otherwise("[TERM]")

    every = F.array_sort(F.concat(base, F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), of_class(x).alias("label")))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["label"])))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate(every, begin, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(every) > 0, joined).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with sanitised texts; n_chars, if there is such a column, follows them.  Null texts stay null."""
    found = detected(docs.select("doc_id", "text")).where((F.size("spans") > 0) | (F.size("terms") > 0))
    mine = ("__pii_id", "__pii_hash", "__pii_spans", "__pii_terms")  # whatever the documents' other columns are called
    found = found.select("doc_id", "text_hash", "spans", "terms").toDF(*mine).dropDuplicates(list(mine[:2]))
    text_hash = F.xxhash64(F.lit(1), F.coalesce(F.col("text"), F.lit("")))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(mine[0])) & (text_hash == F.col(mine[1])), "left")
    text = F.when(F.col(mine[2]).isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col(mine[2]), F.col(mine[3])))
    out = out.withColumn("text", text).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_personal_data(docs: DataFrame) -> DataFrame:
    """Contract digest: counts of the base kinds, the digest of the base spans, and all spans of every document."""
    found = detected(docs.select("doc_id", "text"))

    def shown(kind: Column, x: Column) -> Column:
        return F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.transform("spans", lambda x: shown(x["kind"], x))
    every = F.concat(base, F.transform("terms", lambda x: shown(F.lit("term"), x)))
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
