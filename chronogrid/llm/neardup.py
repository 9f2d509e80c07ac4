"""MinHash near-duplicate groups, confirmed on full shingle sets.

A text's set holds its distinct shingles of five words (with fewer words, the whole sequence).  Texts with equal sets are
one node, named by their least doc_id.  128 universal hash minima make a signature; 32 bands of four minima make buckets
(a pair at similarity 0.75 misses all of them with probability 5e-6).  In each bucket every node is paired with the
bucket's pivot, the node that meets the most others; pairs are verified by their signatures, then by their full sets.  Then
the groups of nodes that buckets connect and links don't are looked at again, by one rule whatever their size: the nodes
outside the largest component of a group are held against all its others, in blocks that bound memory: first by the lowest
bytes of their signatures, which tells the nodes that have a candidate at all, then these nodes by their full sets.  Nodes
and links leave a block, but no pairs.  So no group of copies, however large, is expanded into its pairs or met in one task, and no link between texts
that share a bucket is lost.

Null texts, and such without a word, have an empty set and are linked with nothing.  Rows of one doc_id are one document,
even if their texts differ; ids must be below 2**62.  Rows without an id are grouped by their texts and keep a null
component_id unless a document with an id is reachable.  An empty table has an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_map, cut, sized
from .components import components

WORDS = 5  #: words of a shingle
MINIMA, ROWS_IN_BAND = 128, 4  #: hash minima of a signature, and of them in a band
SIMILAR = (75, 100)  #: linked if 100 * intersection >= 75 * union
PASS_SIGNATURE = 0.5  #: estimated similarity from which full sets are compared; 6.5 standard errors below 0.75
NO_ID = 1 << 62  #: from here on, nodes of texts whose rows have no id
#: Shingles and nodes of the two blocks whose sets are held against each other, about, and nodes of two whose signatures are.
X_BLOCK, Y_BLOCK = (1_000_000, 4_096), (250_000, 1_024)
X_BRIEF, Y_BRIEF = 16_384, 4_096
ROWS, TEXTS = 500_000, 2_000  #: rows of numbers, and of texts or sets, in one part of a table, at least
FILTER_LONGS = 1 << 16  #: 64-bit numbers in the filter of nodes; a fuller one lets more through, and nothing is lost
ID_FILTER_LONGS = 1 << 18  #: and in that of ids whose rows don't simply stay

_rng = np.random.default_rng(20240229)
_place = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_a = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_b = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_row = _rng.integers(1, 1 << 63, ROWS_IN_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_band = _rng.integers(1, 1 << 63, MINIMA // ROWS_IN_BAND, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at blanks and the characters 9 to 13."""
    return text.encode().lower().split() if text else []


def shingle_sets(texts: list[str | None], distinct: bool = True) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (in order of the text if not `distinct`)."""
    split = [words(t) for t in texts]
    sizes = np.array([len(s) for s in split])
    flat = np.array([w for s in split for w in s], dtype=object)
    h = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled += h[j : j + len(rolled)] * _place[j]
    rolled = mixed(rolled)
    out, at = [], 0
    for n in sizes:
        if n >= WORDS:
            s = rolled[at : at + n - WORDS + 1]
        elif n:
            s = mixed((h[at : at + n] * _place[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            s = rolled[:0]
        out.append(np.unique(s) if distinct else s)
        at += n
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each universal hash over the set, as 32-bit numbers."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        least = np.minimum(least, (s[a : a + 2048, None] * _a + _b).min(axis=0))
    return least >> np.uint64(32)


def bands(sig: np.ndarray) -> np.ndarray:
    return mixed((sig.reshape(-1, ROWS_IN_BAND) * _row).sum(axis=1, dtype=np.uint64) + _band).view(np.int64)


def _key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sketches(batches):
    """(doc_id, text_hash, n, k1, k2, bands): size and key of the set, and its bands."""
    for b in batches:
        rows = []
        for s in shingle_sets(b.column("text").to_pylist()):
            rows.append((len(s), *_key(s), bands(signature(s))) if len(s) else (0, None, None, None))
        n, k1, k2, found = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "k1", "k2", "bands"])


def _node(ids: list, sets: list[np.ndarray]) -> list[int]:
    return [NO_ID + (_key(s)[0] & (NO_ID >> 1) - 1) if i is None else i for i, s in zip(ids, sets, strict=True)]


def _node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sig, brief, shingles) of the documents that name `nodes`; brief is the lowest byte of each number of sig.

    A filter of fixed size, or-ed together from the nodes' hashes, tells most other documents before their texts are read;
    the join that follows is exact, however full the filter is.
    """
    slot = F.pmod(F.xxhash64("node"), F.lit(64 * FILTER_LONGS))
    filled = nodes.select(F.floor(slot / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(FILTER_LONGS, np.int64)
    for r in filled.collect():  # FILTER_LONGS rows at most
        table[r["at"]] = r["bits"]
    bits = docs.sparkSession.sparkContext.broadcast(table)

    def sets(batches):
        for b in batches:
            slots = b.column("slot").to_numpy()
            maybe = (bits.value[slots // 64] >> (slots % 64)) & 1 == 1
            maybe |= np.array(b.column("doc_id").is_null())
            b = b.filter(pa.array(maybe))
            found = shingle_sets(b.column("text").to_pylist())
            ids = _node(b.column("doc_id").to_pylist(), found)
            kept = [(i, signature(s).astype(np.uint32), s.view(np.int64)) for i, s in zip(ids, found, strict=True) if len(s)]
            node, sig, s = zip(*kept, strict=True) if kept else ((), (), ())
            brief = pa.array([x.astype(np.uint8).tobytes() for x in sig], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(node), pa.int64()), pa.array([x.view(np.int32) for x in sig], pa.list_(pa.int32())), brief, pa.array(list(s), pa.list_(pa.int64()))], ["node", "sig", "brief", "shingles"])

    own = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)).alias("node")), F.lit(64 * FILTER_LONGS)).alias("slot"))
    return arrow_map(own, sets, "node long, sig array<int>, brief binary, shingles array<long>").join(nodes, "node", "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (u, v) whose signatures let it seem possible, and whose sets confirm it."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    same = F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda a, b: a == b), lambda x: x))
    common = F.when(same >= int(PASS_SIGNATURE * MINIMA), F.size(F.array_intersect("set_u", "set_v")).cast("long")).otherwise(0)
    counted = both.select("u", "v", common.alias("common"), (F.size("set_u") + F.size("set_v")).alias("n"))
    return counted.where(F.col("common") * SIMILAR[1] >= (F.col("n") - F.col("common")) * SIMILAR[0]).select("u", "v").distinct()


class _Block:
    """Nodes of one bucket: node, component, signature and shingles of each, one after the other."""

    def __init__(self, rows: pa.Array):
        self.node, self.c = (rows.field(k).to_numpy() for k in ("node", "c"))
        sig, shingles = rows.field("sig"), rows.field("shingles")
        self.sig = sig.flatten().to_numpy().reshape(len(rows), MINIMA)
        self.size = np.diff(shingles.offsets.to_numpy())
        self.flat = shingles.flatten().to_numpy()
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def shingles(self, k: int) -> np.ndarray:
        return self.flat[self.at[k] : self.at[k + 1]]


def _met(x: _Block, y: _Block) -> list[tuple[int, int]]:
    """Links between nodes of x and y that aren't connected yet."""
    order = np.argsort(y.flat, kind="stable")
    flat, owner = y.flat[order], np.repeat(np.arange(len(y.node)), y.size)[order]
    found = []
    for i in range(len(x.node)):
        same = y.sig == x.sig[i]
        maybe = (y.c != x.c[i]) & (same.sum(axis=1) >= int(PASS_SIGNATURE * MINIMA))
        if not maybe.any():
            continue
        s = x.shingles(i)
        lo, n = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        n -= lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(y.node))
        maybe &= common * SIMILAR[1] >= (len(s) + y.size - common) * SIMILAR[0]
        if maybe.any():
            found += [(int(x.node[i]), int(v)) for v in y.node[maybe]]
    return found


def _candidates(batches):
    """(bucket, node) of the nodes of two blocks that aren't connected yet with one of the other block, and may be like it by their signatures."""
    for b in batches:
        buckets, nodes = [], []
        for k in range(b.num_rows):
            sides = []
            for side in ("xs", "ys"):
                rows = b.column(side).slice(k, 1).flatten()
                brief = np.frombuffer(b"".join(rows.field("brief").to_pylist()), np.uint8).reshape(len(rows), MINIMA)
                sides.append((rows.field("node").to_numpy(), rows.field("c").to_numpy(), brief))
            (x, xc, xb), (y, yc, yb) = sides
            hit = np.zeros(len(y), bool)
            for i in range(len(x)):
                maybe = (yc != xc[i]) & ((yb == xb[i]).sum(axis=1) >= int(PASS_SIGNATURE * MINIMA))
                if maybe.any():
                    hit |= maybe
                    nodes.append([x[i]])
            nodes.append(y[hit])
            buckets.append(np.full(sum(map(len, nodes)) - sum(map(len, buckets)), b.column("bucket")[k].as_py()))
        flat = np.concatenate([*nodes, np.zeros(0, np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*buckets, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(flat)], ["bucket", "node"])


def _block_links(batches):
    """Links between the two blocks of each row."""
    for b in batches:
        found = []
        for k in range(b.num_rows):
            x, y = (_Block(b.column(side).slice(k, 1).flatten()) for side in ("xs", "ys"))
            found += _met(x, y)
        u, v = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _residual(members: DataFrame, pairs: DataFrame, sets: DataFrame, root: DataFrame, work: Workspace) -> DataFrame:
    """Links that the pivots didn't show: between nodes of a group that buckets connect, which aren't connected yet.

    In a group of several components, the nodes outside the largest are held against all, block by block.
    """
    of_root = members.select("node").distinct().join(root, "node", "left").select("node", F.coalesce("root", "node").alias("c"))
    # (a group is called bucket below; pairs tie all nodes of a bucket to its pivot)
    placed = components(pairs, work).select("node", F.col("root").alias("bucket")).join(of_root, "node")
    per = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    main = per.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("several")).where("several > 1").select("bucket", F.col("m.c").alias("main"))
    open_ = work.cut(sized(placed.join(main, "bucket").select("node", "bucket", "c", (F.col("c") != F.col("main")).alias("odd")), members.count(), ROWS), "open")
    once = lambda c: sets.groupBy("node").agg(F.first(c).alias(c))
    brief = open_.join(once("brief"), "node")
    blocks = lambda n, size: F.ceil(F.count(F.when(n, 1)) / size)
    of = open_.groupBy("bucket").agg(blocks(F.col("odd"), X_BRIEF).alias("xn"), blocks(F.lit(True), Y_BRIEF).alias("yn"))
    found = arrow_map(_facing(brief, of, ["node", "c", "brief"]), _candidates, "bucket long, node long", rows=1).distinct()

    both = work.cut(sized(open_.join(found, ["bucket", "node"]), open_.count(), ROWS), "candidates")
    rows = both.join(sets.groupBy("node").agg(F.first("sig").alias("sig"), F.first("shingles").alias("shingles")), "node")
    of_size = both.join(sets.groupBy("node").agg(F.first(F.size("shingles")).alias("n")), "node")
    blocks = lambda bound, which: F.ceil(F.greatest(F.sum(F.when(which, F.col("n"))) / bound[0], F.count(F.when(which, 1)) / bound[1]))
    of = of_size.groupBy("bucket").agg(blocks(X_BLOCK, F.col("odd")).alias("xn"), blocks(Y_BLOCK, F.lit(True)).alias("yn"))
    return arrow_map(_facing(rows, of, ["node", "c", "sig", "shingles"]), _block_links, "u long, v long", rows=1).distinct()


def _facing(rows: DataFrame, of: DataFrame, fields: list[str]) -> DataFrame:
    """(bucket, xs, ys): each block of a bucket's odd nodes with each block of all its nodes; `of` has their numbers (bucket, xn, yn)."""
    dealt = rows.join(of, "bucket")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    node = F.struct(*fields)
    # a block is gathered where its own number sends it, not where its bucket does, and so is each pair of blocks
    xs = dealt.where("odd").withColumn("xb", block("xn")).repartition("bucket", "xb").groupBy("bucket", "xb", "yn").agg(F.collect_list(node).alias("xs"))
    ys = dealt.where("xn > 0").withColumn("yb", block("yn")).repartition("bucket", "yb").groupBy("bucket", "yb", "xn").agg(F.collect_list(node).alias("ys"))
    xs, ys = xs.select("bucket", "xb", every("yn").alias("yb"), "xs"), ys.select("bucket", "yb", every("xn").alias("xb"), "ys")
    return xs.join(ys, ["bucket", "xb", "yb"]).select("bucket", "xs", "ys")


def _grouped(docs: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, text_hash, n, root) of every row of `docs` (doc_id, text); root is a node, null without a shingle."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = docs.count()
    sketches = arrow_map(own, _sketches, "doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>")
    sketches = work.cut(sized(sketches, rows, TEXTS), "sketches")
    no_id = F.lit(NO_ID) + F.col("k1").bitwiseAND((NO_ID >> 1) - 1)
    nodes = sketches.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = work.cut(sized(nodes.select("k1", "k2", F.coalesce("node", no_id).alias("node"), "bands"), rows, ROWS // 16), "nodes")
    many = MINIMA // ROWS_IN_BAND * nodes.count()
    small = lambda df: sized(df, many, ROWS)

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    # (what is joined by bucket is a table of its own, so that the join can split a hot bucket)
    shared = work.cut(small(buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "size")), "shared")
    members = work.cut(small(buckets.join(shared, "bucket").distinct()), "members")
    # the pivot of a bucket is the node that meets the most others in all its buckets, as the origin of edited copies does
    degree = work.cut(small(members.groupBy("node").agg(F.sum("size").alias("degree"))), "degree")
    rated = members.join(degree, "node")
    pivots = work.cut(small(rated.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("p")).select("bucket", (-F.col("p.node")).alias("u"))), "pivots")
    pairs = work.cut(small(members.join(pivots, "bucket").where("node <> u").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()), "pairs")
    sets = work.cut(sized(_node_sets(docs, members.select("node").distinct()), rows, TEXTS), "sets")
    links = work.cut(sized(_linked(pairs, sets), pairs.count(), TEXTS * 4), "links")
    more = _residual(members, pairs, sets, components(links, work), work)
    root = components(work.cut(small(links.unionByName(more)), "all-links"), work)

    named = nodes.select("k1", "k2", "node").join(root, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    return sketches.select("doc_id", "text_hash", "n", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "text_hash", "n", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Workspace(docs.sparkSession) as work:
        component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("root") < NO_ID, F.col("root"))
        found = _grouped(docs, work).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return cut(found, "near-duplicates")


def _may_be_in(ids: DataFrame):
    """A function of a column of ids: false for most that aren't in `ids` (doc_id), true for those that are; null for null.

    One bit for each id, in a table that the cluster ors together; it is a row of its own, as a literal would be written out
    with each plan.
    """
    slot = lambda x: F.pmod(F.xxhash64(x.cast("long")), F.lit(64 * ID_FILTER_LONGS))
    spots = ids.select(slot(F.col("doc_id")).alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bits"))
    filled = spots.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # ID_FILTER_LONGS rows at most
    table = np.zeros(ID_FILTER_LONGS, np.int64)
    table[filled.column("at").to_numpy()] = filled.column("bits").to_numpy()
    rows = ids.sparkSession.createDataFrame(pa.table({"table": pa.array([table], pa.list_(pa.int64()))}))
    return lambda x: F.when(x.isNotNull(), F.getbit(F.get(rows.scalar(), F.shiftright(slot(x), 6).cast("int")), slot(x).bitwiseAND(63).cast("int")) == 1)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of `docs`, one of each group: that whose doc_id names its component, and of a group without any id one of its texts.

    Repeated rows of one id count once; rows without a shingle are no copies of each other and stay.  Most rows that stay are
    told by a filter of the ids that go or are repeated, so that their texts aren't shuffled; the others are joined by id.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Workspace(docs.sparkSession) as work:
        found = work.cut(_grouped(own, work), "grouped")
        ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("n = 0 or coalesce(root = doc_id, false)")).alias("__stays"), F.count("*").alias("__rows"))
        met = cut(ids.where("not __stays or __rows > 1"), "met")
        unnamed = found.where(f"doc_id is null and root >= {NO_ID}").groupBy("root").agg(F.min("text_hash").alias("__hash")).select("__hash")
        unnamed = cut(unnamed, "kept-without-id")
    may_be_met = _may_be_in(met)(F.col("doc_id"))
    out = docs.where(~may_be_met)
    rest = docs.where(may_be_met)
    out = out.select(*docs.columns).unionByName(rest.join(met, "doc_id", "left_anti").select(*docs.columns))
    repeated = met.where("__stays and __rows > 1").select("doc_id")
    if repeated.take(1):
        out = out.unionByName(rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
    bare = docs.where("doc_id is null")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = bare.where(words).withColumn("__text_hash", F.xxhash64("text")).join(unnamed.withColumnRenamed("__hash", "__text_hash"), "__text_hash", "left_semi").dropDuplicates(["__text_hash"])
    return out.unionByName(one.select(*docs.columns)).unionByName(bare.where(~words))


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    """Contract digest of `near_duplicates`."""
    return near_duplicates(docs)
