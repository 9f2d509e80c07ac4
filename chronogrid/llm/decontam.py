"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters, digits and other characters beyond ASCII, lower-cased; shingles are five of them (all, if an item
has fewer).  Every run of as many words as an item has is a window, and so is a whole document that has fewer, but enough to
be similar; a window without any shingle of the benchmark can't be
similar to an item and is passed over.  The other windows get 256-bit SimHash fingerprints, weighted by shingle counts.  A
multi-index of 32 blocks of 8 bits finds all items of that size whose fingerprint is within 63 bits: one of the blocks then
differs by one bit at most.  Candidates are verified by the exact similarity of their weighted shingles, the sum of the
lesser counts over the sum of the greater ones, which must reach 0.75.

Null and empty documents have no match; items without a word match nothing.  Rows, repeated ones too, are judged each;
further columns are passed on (`matches` is replaced); of several windows as similar the first counts.  The benchmark is
broadcast in blocks of bounded size, one pass over the documents for each: beyond one block a pass writes the matches it
finds, and its block goes, before the next begins.  Texts are hashed and windows fingerprinted a stretch at a time, so
that memory grows by some 20 bytes a word of the longest text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, cut

WORDS, BITS, BLOCKS, RADIUS, SIMILAR = 5, 256, 32, 63, 0.75
BROADCAST_CHARS = 4_000_000  #: characters of benchmark items in one broadcast block, about
FILTER_BITS = 20
STRETCH, WINDOWS = 1 << 18, 2_048  #: bytes hashed, and windows fingerprinted, at once

_rng = np.random.default_rng(61)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_base = int(_rng.integers(1, 1 << 61)) * 8 + 5
_unbase = pow(_base, -1, 1 << 64)
_place = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_spread = _rng.integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_in_word = np.array([chr(b).isalnum() or b > 127 for b in range(256)]) & (np.arange(256) != 0)
_in_word[:128] = [chr(b).isalnum() for b in range(128)]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

MATCH = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hamming", T.IntegerType()), T.StructField("similarity", T.DoubleType())]
    )
)
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_base, _unbase)):
            p = _POWERS[k]
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            _POWERS[k] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def _hashed_words(buf: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `inside`, which begin and end within the buffer."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    power, unpower = powers(len(buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte[buf] * power[:-1], dtype=np.uint64)])
    return mixed((total[stop] - total[start]) * unpower[start])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts; the first word of each text, and the number of words at the end."""
    data = [(t or "").lower().encode() for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    buf = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
    inside = _in_word[buf]
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    h, a = [np.zeros(0, np.uint64)], 0
    while a < len(buf):  # a stretch ends at a byte that is in no word
        e = min(len(buf), a + STRETCH)
        e += int(np.argmin(inside[e - 1 :])) if e < len(buf) else 0
        h.append(_hashed_words(buf[a:e], inside[a:e]))
        a = e
    return np.concatenate(h), np.concatenate([[0], np.cumsum(np.add.reduceat(begins, np.concatenate([[0], ends[:-1]]), dtype=np.int64))]) if len(ends) else np.zeros(1, np.int64)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` words from each word on; runs over the ends of texts are the caller's to leave out."""
    out = np.full(max(0, len(h) - size + 1), np.uint64(size))
    for j in range(size):
        out += h[j : j + len(out)] * _place[j]
    return mixed(out)


def signs(s: np.ndarray) -> np.ndarray:
    """+1 or -1 of each of the 256 bits of each shingle."""
    wide = mixed(s[:, None] * _spread)
    return np.unpackbits(wide.view(np.uint8).reshape(len(s), BITS // 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def sums(s: np.ndarray) -> np.ndarray:
    """Running sums of the signs, from nothing on."""
    total = np.zeros((len(s) + 1, BITS), np.int32)
    np.cumsum(signs(s), axis=0, dtype=np.int32, out=total[1:])
    return total


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Generalised Jaccard similarity of shingle counts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.minimum(n[i], m[j]).sum()
    return float(common / (len(a) + len(b) - common))


class Index:
    """Items by size: fingerprints, shingles, and the multi-index."""

    def __init__(self, items: list[tuple[int, str | None]]):
        h, at = word_hashes([t for _, t in items])
        by_size = defaultdict(list)
        for k, (i, _) in enumerate(items):
            n = at[k + 1] - at[k]
            if n:
                size = min(WORDS, n)
                by_size[int(size), int(n - size + 1)].append((i, shingles(h[at[k] : at[k + 1]], size)))
        self.groups, known = {}, defaultdict(list)
        for key, found in by_size.items():
            prints = np.packbits(np.array([signs(s).sum(axis=0, dtype=np.int64) > 0 for _, s in found]), axis=1)
            table = np.zeros((BLOCKS, 256, -(-len(found) // 8)), np.uint8)
            values = np.arange(256)
            near = np.array([[v == w or bin(v ^ w).count("1") == 1 for w in values] for v in values])
            for k, p in enumerate(prints):
                table[np.arange(BLOCKS)[:, None], :, k // 8] |= np.where(near[p], 128 >> k % 8, 0).astype(np.uint8)[:, None, :]
            self.groups[key] = ([i for i, _ in found], [s for _, s in found], prints, table)
            known[key[0]] += [s for _, s in found]
        self.known = {size: np.unique(np.concatenate(s)) for size, s in known.items()}
        self.filter = {}
        for size, s in self.known.items():
            self.filter[size] = np.zeros(1 << FILTER_BITS, bool)
            self.filter[size][s >> np.uint64(64 - FILTER_BITS)] = True

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        h, at = word_hashes(texts)
        for size, known in self.known.items():
            s = shingles(h, size)
            hits = np.flatnonzero(self.filter[size][s >> np.uint64(64 - FILTER_BITS)])
            if not len(hits):
                continue
            hits = hits[np.searchsorted(known, s[hits], side="right") > np.searchsorted(known, s[hits])]
            doc = np.searchsorted(at, hits, side="right") - 1
            inside = hits + size <= at[doc + 1]
            for d in np.unique(doc[inside]):
                here = s[at[d] : at[d + 1] - size + 1]
                out[d] += self.of_document(here, hits[inside & (doc == d)] - at[d], size)
        return [sorted(x, key=lambda m: (m["item_id"], m["first_word"])) for x in out]

    def of_document(self, s: np.ndarray, hits: np.ndarray, size: int):
        """Best window of each item that the shingles `s` of one document have; `hits` are places of the benchmark's shingles."""
        found = []
        reach = max(m for k, m in self.groups if k == size)
        # runs of shingles near hits, a stretch at a time
        cut = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for run in np.split(hits, cut):
            lo, hi = max(0, run[0] - reach + 1), min(len(s), run[-1] + reach)
            for a in range(lo, hi, WINDOWS):  # windows that start here
                b = min(hi, a + WINDOWS)
                part = s[a : min(hi, b + reach)]
                touched = np.zeros(len(part) + 1, np.int64)
                touched[run[(run >= a) & (run < a + len(part))] - a + 1] = 1
                if not touched.any():
                    continue
                total, touched = sums(part), np.cumsum(touched)
                for (k, m), group in self.groups.items():
                    n = min(b - a, len(part) - m + 1)
                    if k == size and n > 0:
                        first = np.flatnonzero(touched[m : m + n] > touched[:n])
                        found += self.of_windows(part, total, first, a, size, m, group)
        # the whole document is the window of items that have more words, as long as it can reach SIMILAR
        longer = [(m, group) for (k, m), group in self.groups.items() if k == size and SIMILAR * m <= len(s) < m]
        if longer:
            total = sums(s)
            for _, group in longer:
                found += self.of_windows(s, total, np.zeros(1, np.int64), 0, size, len(s), group)
        best: dict[int, dict] = {}
        for x in found:
            y = best.get(x["item_id"])
            if y is None or (-x["similarity"], x["first_word"]) < (-y["similarity"], y["first_word"]):
                best[x["item_id"]] = x
        return list(best.values())

    @staticmethod
    def of_windows(part, total, first, a, size, m, group):
        ids, sets, prints, table = group
        for k in range(0, len(first), 4096):
            f = first[k : k + 4096]
            windows = np.packbits(total[f + m] - total[f] > 0, axis=1)
            near = table[0, windows[:, 0]].copy()
            for j in range(1, BLOCKS):
                near |= table[j, windows[:, j]]
            w, i = np.nonzero(np.unpackbits(near, axis=1, count=len(ids)))
            hamming = np.bitwise_count(windows[w] ^ prints[i]).sum(axis=1, dtype=np.int32)
            for x in np.flatnonzero(hamming <= RADIUS):
                at = f[w[x]]
                alike = similarity(part[at : at + m], sets[i[x]])
                if alike >= SIMILAR:
                    yield {"item_id": ids[i[x]], "first_word": int(a + at), "n_words": m + size - 1, "hamming": int(hamming[x]), "similarity": alike}


def matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with matches: for each item that a document has, its most similar window."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-int(chars) // BROADCAST_CHARS)
    plain = docs.select(*[c for c in docs.columns if c != "matches"])
    if blocks <= 1:
        return _one_block(plain, items, lambda m: m)
    found = None
    for k in range(blocks):
        own = plain.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        part = _one_block(own, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), lambda m: m or None)
        part = cut(part.where("matches is not null").select("doc_id", "text_hash", "matches").distinct(), "matches")
        found = part if found is None else found.unionByName(part)
    mine = ("__match_id", "__match_hash", "__matches")
    found = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches")).toDF(*mine)
    out = plain.join(found, F.col("doc_id").eqNullSafe(F.col(mine[0])) & (F.xxhash64("text") == F.col(mine[1])), "left")
    return out.select(*plain.columns, F.coalesce(mine[2], F.array().cast(MATCH)).alias("matches"))


def _one_block(docs: DataFrame, items: DataFrame, answer) -> DataFrame:
    """`docs` with matches among `items`, of BROADCAST_CHARS about; `answer` says what stands for a list of them."""
    index = docs.sparkSession.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in items.collect())))
    columns = docs.columns

    def run(batches):
        for b in batches:
            found = [answer(m) for m in index.value.matches(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found, _ARROW_MATCH)], [*columns, "matches"])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField("matches", MATCH)]))


def op6_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it has: doc_id, item_id, first_word, n_words, hamming, similarity."""
    found = matched(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
