"""Language identification by words first, with backoff to ever shorter character n-grams.

A word that was met in training scores by the logarithm of its relative frequency in each language.  Another word is
padded with spaces and cut into n-grams of the greatest length of which any was met in training; its score is their mean.
A language in which a known word or n-gram wasn't met gets a penalty instead.  A text's score for a language is the mean
over its words; the answer is the best language (the first by name on ties), its score the posterior of up to
`EVIDENCE` words.  All words and n-grams of the sample are kept, and each in the languages only that have it.

Null texts and texts without a letter are `und` with score 0; without any training text all are.  Repeated rows are judged
each; further columns are passed on (`lang_pred` and `score` are replaced).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, crc_mod

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5  #: characters of the longest n-grams
PENALTY = 14.0  #: minus the log frequency of what a language hasn't
EVIDENCE = 12  #: words that count as independent for the posterior
#: Documents learned from, at most: of each language the same number, of all languages together, and the longest of them.
#: (Beyond SAMPLE languages the most frequent ones have a document each.)
SAMPLE_PER_LANGUAGE, SAMPLE, SAMPLE_CHARS = 800, 6_400, 10_000
MEMORY, MEMORY_BYTES = 100_000, 32 << 20  #: words whose scores a worker remembers, at most, and what they take


class Model:
    def __init__(self, texts: dict[str, list[str]]):
        """texts: by language."""
        self.languages = sorted(texts)
        #: by length of the n-grams, and at 0 for whole words: the number of each
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        numbers, langs, logs, n = [], [], [], 0
        for k, name in enumerate(self.languages):
            words = Counter(w for t in texts[name] for w in WORD.findall(t.lower()))
            counts = [words, *(Counter() for _ in range(LONGEST))]
            for w, c in words.items():
                padded = f" {w} "
                for g in range(1, LONGEST + 1):
                    for a in range(len(padded) - g + 1):
                        counts[g][padded[a : a + g]] += c
            for table, found in zip(self.tables, counts, strict=True):
                own = np.empty(len(found), np.int32)
                for i, x in enumerate(found):
                    at = table.get(x)
                    if at is None:
                        table[x] = at = n
                        n += 1
                    own[i] = at
                c = np.fromiter(found.values(), float, len(found))
                numbers.append(own)
                langs.append(np.full(len(found), k, np.int32))
                logs.append(np.maximum(np.log(c / c.sum()), -PENALTY).astype(np.float32))
        flat = np.concatenate([*numbers, np.zeros(0, np.int32)])
        order = np.argsort(flat, kind="stable")
        #: of each number, the languages that have it and their logarithms stand from its place in `at` to the next one
        self.at = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=n))]).astype(np.int64)
        self.langs = np.concatenate([*langs, np.zeros(0, np.int32)])[order]
        self.logs = np.concatenate([*logs, np.zeros(0, np.float32)])[order]
        #: the same as a matrix where there are few languages, for speed
        self.known: np.ndarray | None = None
        if 4 * n * len(self.languages) <= MEMORY_BYTES:
            self.known = np.full((n, len(self.languages)), -PENALTY, np.float32)
            self.known[np.repeat(np.arange(n), np.diff(self.at)), self.langs] = self.logs
        self.memory: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def mean(self, numbers: list[int]) -> np.ndarray:
        """The mean over words or n-grams of their logarithms in each language."""
        if self.known is not None:
            return self.known[numbers].mean(axis=0) if len(numbers) > 1 else self.known[numbers[0]]
        out = np.zeros(len(self.languages))
        for n in numbers:
            a, b = self.at[n], self.at[n + 1]
            out[self.langs[a:b]] += self.logs[a:b] + PENALTY
        return out / len(numbers) - PENALTY

    def word(self, w: str) -> np.ndarray:
        found = self.tables[0].get(w)
        if found is not None:
            return self.mean([found])
        padded = f" {w} "
        for n in range(min(LONGEST, len(padded)), 0, -1):
            table = self.tables[n]
            grams = [table[g] for a in range(len(padded) - n + 1) if (g := padded[a : a + n]) in table]
            if grams:
                return self.mean(grams)
        return np.full(len(self.languages), -PENALTY)

    def judge(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.languages:
            return "und", 0.0
        if self.rows is None:
            self.rows = np.zeros((max(1, min(MEMORY, MEMORY_BYTES // (8 * len(self.languages)))), len(self.languages)))
        memory, rows, mean, n = self.memory, self.rows, np.zeros(len(self.languages)), len(words)
        at = []
        for w in words:
            r = memory.get(w)
            if r is None:
                if len(memory) == len(rows):
                    mean += rows[at].sum(axis=0)
                    at = []
                    memory.clear()
                memory[w] = r = len(memory)
                rows[r] = self.word(w)
            at.append(r)
        mean = (mean + rows[at].sum(axis=0)) / n
        p = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Learned from at most `per_language` documents of each non-null value of `lang`, and `sample` of all.

    The documents are those with the least hash of their id, the same whatever the partitions; longer ones than
    SAMPLE_CHARS aren't learned from.  One pass counts, and one brings the rows whose hash may be among the least.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS))
    counts = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()]
    share = max(1, min(per_language, sample // max(1, len(counts))))
    # hashes are spread evenly, so that `share` of n rows have hashes below about this limit
    limits = [(name, min(1.0, (share + 6 * share**0.5 + 10) / n)) for name, n in counts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, __limit double")  # `sample` rows at most
    own = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    hashed = known.select("lang", "text", own.alias("__hash")).withColumn("__part", F.shiftrightunsigned("__hash", 1) / F.lit(2.0**63))
    found: dict[str, set] = {name: set() for name, _ in counts}
    for r in hashed.join(F.broadcast(limits), "lang").where("__part < __limit").select("lang", "text", "__part").collect():
        found[r["lang"]].add((r["__part"], r["text"]))
    return Model({name: [t for _, t in sorted(rows)[:share]] for name, rows in found.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*docs.select(*named).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        own = shared.value
        for b in batches:
            found = [own.judge(t) for t in b.column("text").to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in named), *new], [*named, "lang_pred", "score"])

    return arrow_map(docs.select(*named), run, schema)


def op4_language(docs: DataFrame) -> DataFrame:
    """Contract digest: learned where crc32(doc_id) mod 3 isn't 1, every document judged."""
    model = fit(docs.where(crc_mod("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
