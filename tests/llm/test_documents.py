"""Near-duplicates, decontamination, personal data, fingerprints, pieces, pages, URLs: brute force, round trips, edge rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronogrid.llm import components, decontam, fingerprints, neardup, pages, pieces, pii, queries, urls
from chronogrid.llm.common import table

SF = "/root/testdata/sf0.001"


def documents(spark, *texts, first=1):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


# -- components ----------------------------------------------------------------------------------------------------------


def united(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1300)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(260)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, *edges[:20], (5, 5), (None, 3)], "u long, v long").withColumn("node", F.lit("x"))
    assert {r["node"]: r["root"] for r in components.components(df).collect()} == united(edges)
    assert components.components(df.where("u < 0")).count() == 0


# -- near-duplicates -------------------------------------------------------------------------------------------------------


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_groups(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = united(links)
    return {i: (len(sets[i]), root.get(i, i)) for i in ids}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"z{r.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(2)
    texts = []
    for g in range(6):  # groups of edited copies, some linked only through others, some not at all
        base = [f"w{r.randrange(400)}" for _ in range(80)]
        texts += [edited(r, base, r.randrange(0, 8)) for _ in range(25)] + [" ".join(base)] * 3
    texts += ["", None, "   ", "One two", "one TWO", "one two three four five", "É É É É É", "é é é é é", "a\x0bb c\td e f", "a b c d e f", " ".join(f"q{k}" for k in range(30_000))]
    r.shuffle(texts)
    rows = list(enumerate(texts, 1))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()} == plain_groups(rows)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in found.collect())


@pytest.mark.parametrize("blocks", [((1_000_000, 4_096), (250_000, 1_024)), ((150, 4), (90, 3))])
def test_links_between_edits_in_one_bucket(spark, monkeypatch, blocks):
    """Blocks of a few texts find the same."""
    monkeypatch.setattr(neardup, "X_BLOCK", blocks[0])
    monkeypatch.setattr(neardup, "Y_BLOCK", blocks[1])
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, edited(r, base, 1 + k % 4)) for k in range(1, 120)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()} == plain_groups(rows)


def test_near_duplicates_on_the_test_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    found = queries.op3_near_duplicates(spark, SF).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == plain_groups(rows)


def test_near_duplicates_edges(spark):
    long = " ".join(f"x{k}" for k in range(20))
    docs = spark.createDataFrame([(None, long, 1), (None, long, 1), (7, long, 2), (7, long, 2), (8, None, 3), (None, None, 4), (9, long + " y", 5)], "doc_id long, text string, kept int")
    found = [(x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(docs).collect()]
    assert collections.Counter(found) == collections.Counter([(None, 7, False), (None, 7, False), (7, 7, True), (7, 7, True), (8, 8, True), (None, None, True), (9, 7, False)])
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((x["doc_id"] or 0, x["kept"]) for x in left.collect()) == [(0, 4), (7, 2), (8, 3)]
    assert neardup.near_duplicates(docs.where("doc_id < 0")).count() == 0


def exchanged(plan, column):
    """Rows with `column` that the exchanges of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanged(plan.executedPlan(), column)
    if name.endswith("QueryStageExec"):
        return exchanged(plan.plan(), column)
    below = sum(exchanged(plan.children().apply(k), column) for k in range(plan.children().size()))
    has = column in [plan.output().apply(k).name() for k in range(plan.output().size())]
    return below + (plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" and has else 0)


def test_texts_that_stay_are_not_shuffled(spark):
    """Only rows that go, are repeated or share their bit of the filter are; before, all were, once their ids are too many to broadcast."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    rows = [*enumerate(texts), *((1000 + k, texts[k]) for k in range(20)), (5, texts[5]), (299, "another text of the same id"), (2000, None), (None, texts[7])]
    docs, name = spark.createDataFrame(rows, "doc_id long, text string"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        left = neardup.deduplicated(docs)
        assert sorted(x["doc_id"] for x in left.collect()) == [*range(300), 2000]
        assert 20 <= exchanged(left._jdf.queryExecution().executedPlan(), "text") <= 60
    finally:
        spark.conf.set(name, before)


# -- decontamination -------------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    r = random.Random(3)
    items = [(k, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(12, 60)))) for k in range(30)] + [(100, "just two"), (101, ""), (102, None)]
    noise = lambda n: " ".join(f"n{r.randrange(3000)}" for _ in range(n))
    rows, true = [], set()
    for k, (i, t) in enumerate(items[:30]):
        rows.append((k, f"{noise(40)} {t.upper()}! {noise(30)}"))  # case and punctuation don't matter
        true.add((k, i))
        words = t.split()
        words[len(words) // 2] = "zzz"
        a, b = (decontam.shingles(decontam.word_hashes([x])[0], 5) for x in (t, " ".join(words)))
        if decontam.similarity(a, b) >= 0.75:
            rows.append((1000 + k, f"{noise(20)} {' '.join(words)} {noise(20)}"))
            true.add((1000 + k, i))
    rows += [(5000, noise(500)), (5001, None), (5002, ""), (5003, "It is just TWO."), (5004, items[0][1][: len(items[0][1]) // 2])]
    true.add((5003, 100))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.op6_decontamination(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == true
    exact = [x for x in found if x["doc_id"] < 1000]
    assert all(x["similarity"] == 1.0 and x["hamming"] == 0 and x["first_word"] == 40 for x in exact)
    assert decontam.op6_decontamination(docs.where("doc_id < 0"), bench).count() == 0
    assert decontam.op6_decontamination(docs, bench.where("item_id < 0")).count() == 0
    kept = decontam.matched(docs.withColumn("matches", F.lit(1)), bench).where(F.size("matches") == 0)
    assert {x["doc_id"] for x in kept.collect()} == {x for x, _ in rows} - {x for x, _ in true}


def test_recall_by_similarity_and_size():
    """Items of 1 to 10, 10 to 50 and over 50 shingles, with words replaced: what is as similar as 0.75 is found."""
    r = random.Random(14)
    for lo, hi in ((6, 14), (15, 54), (60, 120)):
        items = [(k, " ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(lo, hi)))) for k in range(60)]
        index, met = decontam.Index(items), collections.Counter()
        for i, t in items:
            for n in (0, 1, 1, 2, 3):
                words = t.split()
                for at in r.sample(range(len(words)), min(n, len(words))):
                    words[at] = f"z{r.randrange(1000)}"
                a, b = (decontam.shingles(decontam.word_hashes([" ".join(x)])[0], 5) for x in (t.split(), words))
                alike = decontam.similarity(a, b)
                if alike >= 0.75:
                    text = " ".join([*(f"n{r.randrange(5000)}" for _ in range(30)), *words, *(f"n{r.randrange(5000)}" for _ in range(30))])
                    found = [m for m in index.matches([text])[0] if m["item_id"] == i]
                    met[bool(found), "below 0.9" if alike < 0.9 else "0.9 and over"] += 1
        assert met[False, "0.9 and over"] == 0 and met[False, "below 0.9"] <= 0.02 * met[True, "below 0.9"], (lo, hi, met)


def test_repeated_rows_and_long_texts_are_matched_each(spark):
    items = [(1, " ".join(f"w{k}" for k in range(40)))]
    long = " ".join([items[0][1]] * 300 + [f"n{k}" for k in range(60_000)])
    docs = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (None, items[0][1]), (2, long), (3, "")], "doc_id long, text string")
    found = decontam.op6_decontamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["similarity"], x["first_word"]) for x in found) == [(0, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (2, 1.0, 0)]


def test_truncated_items_that_are_whole_documents(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(3000)}" for _ in range(59)]
    rows = [(1, words[:-1]), (2, words[1:]), (3, words[:46]), (4, words[:30]), (5, words)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(f"v{k}" for k in range(59)))], "item_id long, text string")
    found = {x["doc_id"]: x for x in decontam.op6_decontamination(docs, bench).collect()}
    assert set(found) == {1, 2, 3, 5}  # 30 words can't reach 0.75
    for k, w in rows:
        if k in found:
            x = found[k]
            assert (x["item_id"], x["first_word"], x["n_words"]) == (7, 0, len(w))
            assert x["similarity"] == pytest.approx((len(w) - 4) / 55)
    assert {x["doc_id"] for x in decontam.matched(docs, bench).where(F.size("matches") == 0).collect()} == {4}


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs, bench = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontam.op6_decontamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_CHARS", 3000)
    assert sorted(map(tuple, decontam.op6_decontamination(docs, bench).collect())) == whole


def test_multi_index_misses_nothing_within_the_radius():
    r = np.random.default_rng(1)
    index = decontam.Index([(k, " ".join(f"w{x}" for x in r.integers(0, 500, 30))) for k in range(50)])
    (_, sets, prints, near), = [g for g in index.groups.values()]
    for _ in range(300):
        k = r.integers(50)
        bits = np.unpackbits(prints[k])
        bits[r.choice(256, decontam.RADIUS, replace=False)] ^= 1
        p = np.packbits(bits)
        hit = np.zeros(near.shape[2], np.uint8)
        for j in range(decontam.BLOCKS):
            hit |= near[j, p[j]]
        assert np.unpackbits(hit)[k]
    assert sets


# -- personal data -----------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_spans_by_the_patterns(spark):
    r = random.Random(3)
    alphabet = "0123456789" * 3 + "..--  @@+()ab%é😀\n"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 80))) for _ in range(3000)]
    texts += ["a@b.com_x@c.org.", "4111 1111 1111 1111 and 4111-1111-1111-1111-", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (555) 123-4567 +1 +", "é😀 a@b.co", None, "", "1" * 50_000 + " " + "a" * 50_000 + " 4111111111111111", " ".join(["1.2.3.4"] * 700)]
    docs = documents(spark, *texts)
    found = {x["doc_id"]: x for x in pii.op2_personal_data(docs).collect()}
    for k, t in enumerate(texts, 1):
        plain = ",".join(plain_spans(t))
        assert found[k]["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest(), t
        assert found[k]["spans"].startswith(plain)


def test_terms_that_reveal_an_entity(spark):
    r = random.Random(5)
    noise = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    texts = [noise(60) for _ in range(300)]
    texts += [f"{noise(3)} Zebulon writes from zeb@site.org {noise(8)} {k}x" for k in range(4)] + [f"{noise(5)} other{k}@site.org {noise(5)}" for k in range(30)]
    docs = documents(spark, *texts)
    out = {x["doc_id"]: x["text"] for x in pii.sanitise(docs).collect()}
    for k in range(301, 305):
        assert "Zebulon" not in out[k] and "[EMAIL]" in out[k]
    assert all(out[k] == texts[k - 1] for k in range(1, 301))  # documents without an entity stay
    spans = {x["doc_id"]: x["spans"] for x in pii.op2_personal_data(docs).collect()}
    assert all("term:" not in spans[k] for k in range(305, 335))


def test_terms_are_found_at_any_distance(spark):
    """A name stands 10, 100, 1,000 or 5,000 characters from the address that it reveals, or in a document without one."""
    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "kablimprost" for b in ("ane", "iro", "ulu", "este", "om", "ix", "ap", "ende")]
    noise = lambda n: " ".join(r.choice(vocabulary) for _ in range(1 + n // 5))  # whole words of 5 characters and more
    rows, planted = [noise(r.randrange(100, 900)) for _ in range(400)], []
    for k, far in enumerate([10, 100, 1000, 5000] * 5):
        for _ in range(4):
            planted.append((len(rows) + 1, f"Person{k}", far))
            rows.append(f"{noise(60)} Person{k}, {noise(far)} who{k}@site.org {noise(50)}")
        planted.append((len(rows) + 1, f"Person{k}", 0))
        rows.append(f"{noise(200)} (Person{k}) {noise(200)}")
    out = {x["doc_id"]: x["text"] for x in pii.sanitise(documents(spark, *rows)).collect()}
    for d, name, far in planted:
        assert name not in out[d], (d, name, far)
    assert all(out[k] == rows[k - 1] for k in range(1, 401))


def test_copies_are_no_evidence(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta who@site.org iota kappa lambda"
    rows = [text] * 5 + [text + f" x{k}" for k in range(3)] + [f"other words number {k} of many" for k in range(50)]
    found = [x["spans"] for x in pii.op2_personal_data(documents(spark, *rows)).collect()]
    assert sum("email" in x for x in found) == 8 and not any("term" in x for x in found)


def test_sanitising_edges(spark):
    docs = spark.createDataFrame([(1, "call +1 555 123 4567 now", 24, "a"), (1, None, None, "b"), (None, "x a@b.cd y", 10, "c"), (2, "", 0, None)], "doc_id long, text string, n_chars long, spans string")
    out = sorted((str(x["doc_id"]), x["text"], x["n_chars"]) for x in pii.sanitise(docs).collect() if x["text"])
    assert out == [("1", "call [PHONE] now", 16), ("None", "x [EMAIL] y", 11)]
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == 4
    assert pii.op2_personal_data(docs.where("doc_id < 0")).count() == 0


# -- fingerprints --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [2000, 30])
def test_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "ROWS_IN_RANGE", rows)
    docs = table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in fingerprints.op10_fingerprints(docs).collect()}
    ids = sorted(text, reverse=True)
    assert sorted(found) == sorted(text)
    bias = []
    for k, i in enumerate(ids):
        mine, after = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(mine) // 2
        new = mine[: len(mine) - half] + after[:half]
        assert found[i]["n_chars"] == len(mine) and found[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        for a, b, said in ((mine, new, found[i]["near_edited"]), (mine, after, found[i]["near_next"])):
            x, y = collections.Counter(a.split()), collections.Counter(b.split())
            bias.append(said - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(bias)) < 0.02 and np.std(bias) < 0.1
    prints = collections.defaultdict(set)
    for i in ids:
        prints[text[i]].add(found[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) > 0.95 * len(prints)  # near copies may agree at all places


def test_samples_are_consistent(spark):
    """A heavier term never has a greater value, and the chance to agree is the weights' Jaccard similarity."""
    n = 4000
    grid = spark.range(n).select(*[fingerprints.sample(F.xxhash64("id"), F.lit(float(np.log(w))), 3).alias(f"w{w}") for w in (1, 2, 3, 7)])
    x = np.array([list(r) for r in grid.collect()], dtype=float)
    assert (np.diff(x, axis=1) <= 0).all()
    for a, b, j in ((0, 1, 1 / 2), (1, 2, 2 / 3), (0, 3, 1 / 7)):
        assert (x[:, a] == x[:, b]).mean() == pytest.approx(j, abs=0.03)


def test_fingerprint_edges(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (2, None), (1, ""), (None, "x"), (3, "z z"), (9, "é😀")], "doc_id long, text string").withColumn("sig", F.lit(1))
    found = fingerprints.op10_fingerprints(docs).collect()
    assert len(found) == 6
    by = {(r["doc_id"], r["n_chars"]): r for r in found}
    assert by[(2, 0)]["fingerprint"] == by[(1, 0)]["fingerprint"] and by[(2, 0)]["near_next"] == 1.0 and by[(1, 0)]["near_next"] == 0.0
    assert by[(None, 1)]["edited_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert fingerprints.op10_fingerprints(docs.where("doc_id < 0")).count() == 0
    one = fingerprints.op10_fingerprints(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0  # its own next


# -- pieces ------------------------------------------------------------------------------------------------------------------------


def test_pieces_as_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(pieces.model_bytes(path))
    r = random.Random(1)
    alphabet = [*"aabcdeehilnorst    \n\tÉñ日本語क्षि😀①\u0000.,!▁<>s/0x", "  ", "the", "ing", "   "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 40))) for _ in range(6000)] + [" " * n + "x" + " " * (n // 2) for n in range(70)]
    texts += ["".join(own.text[r.randrange(259, 32000)] for _ in range(r.randrange(1, 8))).replace("▁", " ") for _ in range(4000)] + ["ab" * 20_000, "<s></s><unk>", "x" * 3000 + " é"]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode(ids), t
    for _ in range(2000):  # any ids, not only those of a text
        ids = [r.randrange(32000) if r.random() < 0.7 else r.randrange(3, 259) for _ in range(r.randrange(0, 12))]
        ids = [i for i in ids if i > 2]
        assert own.decode(ids) == library.decode(ids), ids


def test_pieces_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "hello  world", 0), (3, "ab " * 50_000, 0), (3, "ab " * 50_000, 0)], "doc_id long, text string, ids int")
    out = pieces.encoded(docs, queries.tokenizer_path())
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert [(r["doc_id"], r["decoded"] == (r["text"] or "")) for r in out.collect()] == [(1, True), (2, True), (None, True), (3, True), (3, True)]
    assert pieces.op7_pieces(docs.where("doc_id < 0"), queries.tokenizer_path()).count() == 0


# -- pages and URLs ------------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = (
        "<body><header><h1>Site</h1></header><nav><a href=/>Home of the site</a></nav><div class='cookie-notice'>We use the cookies of this site for all that you do.</div><script>var a='</p>';</script>"
        "<div id=content><h2>Title here</h2><p>This is the long paragraph of the article and it has many words in it for the test.</p><p>Short &amp; one.<br>Line</p>"
        "<p>And this is another of the long paragraphs that have to be found by the rules in it.</p><form><p>Write to us and we will be with you in a day or in two</p></form></div>"
        "<section class='comments'><p>I like this and that of the long paragraphs that have to be found by the rules.</p></section><footer>&copy; all of it</footer>"
    )
    assert pages.main_text(page).split("\n") == ["Title here", "This is the long paragraph of the article and it has many words in it for the test.", "Short & one. Line", "And this is another of the long paragraphs that have to be found by the rules in it."]
    assert pages.main_text("<article><ul><li>one<li>two</ul>x<br>y") == "one\ntwo\nx y"
    assert pages.main_text("<div class=site-header>Top</div><article><div class=entry-header><h1>Title</h1></div><p>Text</p><div class='post comments'><p>Me too</p></div></article><div id=footer>End</div>") == "Title\nText"
    for broken in (None, "", "<", "<p", "</p></p>", "<article>a<b", "<!-- x", "<script>x", "&am &amp", "<p>" * 5000):
        assert isinstance(pages.main_text(broken), str)


def test_main_text_of_the_test_pages(spark):
    """All blocks of the article, and nothing else."""
    import html

    def article(page):
        inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)[^>]*>", inside)]
        return "\n".join(x for x in parts if x)

    raw = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    found = queries.op9_main_text(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: article(v) for k, v in raw.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in found)


LONG = "And this is the one of the two that you are in for, with the words that are of it"
OTHER = "It is not the case that we were here for this, as it was for them and will be"
PAGES = [
    # attributes are told by their whole names, classes by their parts
    (f'<article><p data-id="comment-7" data-role="share">{LONG}</p></article>', LONG),
    (f"<article><p class=market-share>{LONG}</p><p class=legal>{OTHER}</p></article>", f"{LONG}\n{OTHER}"),
    (f"<article><p>{LONG}</p><div class='post-comments'><p>{OTHER}</p></div><section id=comments><p>{OTHER}</p></section></article>", LONG),
    (f"<article><p>{LONG}</p><article class=comment><p>{OTHER}</p></article></article>", LONG),
    # links end with the next one, or with their block
    (f"<article><p><a href=x>one<a href=y>two</a> {LONG}</p><p>{OTHER}</p></article>", f"onetwo {LONG}\n{OTHER}"),
    (f"<article><p><a href=x>one<p>{LONG}</p><p>{OTHER}</p></article>", f"{LONG}\n{OTHER}"),
    (f"<article><p><a name=top>{LONG}</p></article>", LONG),
    # a quote within a value that has none
    (f"<article><p title=it's>{LONG}</p><p>it's {OTHER}</p></article>", f"{LONG}\nit's {OTHER}"),
    # what isn't shown
    (f"<article><p hidden>{OTHER}</p><p style='display: none'>{OTHER}</p><p aria-hidden=true>{OTHER}</p><p>{LONG}</p></article>", LONG),
    # headings of an article's header
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by somebody</p></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    # without article elements
    (f"<div class=menu><a href=/>Home</a></div><h2>Title</h2><div>{LONG}</div><div>Yes.</div><div>{OTHER}</div><form><p>{OTHER}</p></form><div class=cookie-notice>{OTHER}</div>", f"Title\n{LONG}\nYes.\n{OTHER}"),
    (f"<div><a href=/1>{LONG}</a></div><div>{OTHER}</div><div id=sidebar><div>{LONG}</div></div>", OTHER),
    (f"<table><tr><td><a href=/>Home</a> <a href=/2>News</a></td><td><p>{LONG}</p><p>Short.</p></td></tr></table>", f"{LONG}\nShort."),
    # foreign words inherit from their neighbours, and stay in an article without any
    (f"<div>{LONG}</div><div>zxcv qwer</div>", f"{LONG}\nzxcv qwer"), ("<article><p>zxcv qwer</p></article>", "zxcv qwer"), ("<div>zxcv qwer</div>", ""),
    (f"<div class=ad>{LONG}</div><div>zxcv</div>", ""), ("", ""), ("<p", ""), ("&lt;p&gt; &eacute;", ""),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text_of_labelled_pages(k):
    assert pages.main_text(PAGES[k][0]) == PAGES[k][1]


def test_main_text_edges(spark):
    body = "".join(f"<p>{LONG} {k}</p>" for k in range(20_000))
    rows = spark.createDataFrame([(1, None, "t", 1), (1, None, "t", 1), (2, f"<article>{body}</article>", "t", 1), (None, "", None, None)], "page_id long, html string, text string, n_chars int").withColumn("url", F.lit(None).cast("string"))
    found = pages.op9_main_text(rows).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 0), (1, 0), (1, 0), (2, sum(len(f"{LONG} {k}") + 1 for k in range(20_000)) - 1)]
    assert pages.op9_main_text(rows.where("page_id < 0")).count() == 0


def plain_verdict(url, rules=urls.RULES):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
    return host, path, max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_rules(spark):
    given = [None, "", "nothing", "http://", "http://EXAMPLE.com/en/1", "https://www.example.com/en/2", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1?u=http://y.com/", "x.net://y/fr/", "http://z.net", "http://z.net/fr", "http://z.net/fr/#a", "a://b://c/d", "http://É.com/x\ny"]
    given += [r["url"] for r in table(spark, SF, "pages").collect()]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    found = {r["page_id"]: r for r in urls.judge(rows, spark.createDataFrame([], "u string, v string")).collect()}
    for k, u in enumerate(given):
        host, path, rule = plain_verdict(u)
        assert (found[k]["host"], found[k]["path"], found[k]["rule"]) == (host, path, rule and rule[1] + rule[2]), u
        if rule:
            assert found[k]["verdict"] == rule[0]


def test_blocks_reach_aliases(spark):
    link = "<link rel='canonical' href='%s'>"
    given = [
        (1, "http://a.org/1", link % "http://b.net/es/1"), (2, "http://c.org/2", '<meta http-equiv="refresh" content="0; url=http://a.org/1">'), (3, "https://www.c.org/2/?utm_source=x#top", ""),
        (4, "http://d.org/4", link % "http://e.com/4"), (5, "http://f.org/5", link % "http://b.net/fr/5"), (6, "http://g.org/6", ""), (7, "http://b.net/es/1", None), (8, "http://b.net/fr/5", None),
        (9, "http://h.com/9", link % "http://f.org/5"), (10, None, None), (10, None, None),
    ]
    rows = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("root", F.lit("x"))
    found = {r["page_id"]: r["verdict"] for r in urls.op5_urls(rows).collect()}
    want = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow"}  # 9 is allowed by a rule, and so is its alias 5
    assert found == want
    spelt = urls.judge(rows, urls.page_edges(rows, urls.canonical), key=urls.canonical).collect()  # 3 is another spelling of 2
    assert {r["page_id"]: r["verdict"] for r in spelt} == want | {3: "block"}
    assert urls.op5_urls(rows).count() == 11 and urls.op5_urls(rows.where("page_id < 0")).count() == 0


def test_targets_are_resolved_on_their_page(spark):
    refresh, link = "<meta content='0; url=%s' http-equiv=refresh>", '<link href="%s" rel="canonical">'
    given = [
        ("http://a.org/x/1?q=2", link % "/y", "http://a.org/y"), ("https://a.org/x/1", refresh % "//b.net/es/2", "https://b.net/es/2"), ("http://a.org/x/1", refresh % "2", "http://a.org/x/2"),
        ("http://a.org/x/y/1", link % "../z/./3", "http://a.org/x/z/3"), ("http://a.org", link % "p", "http://a.org/p"), ("http://a.org/x", link % "?p=1", "http://a.org/x?p=1"),
        ("http://a.org/x", '<META property="og:url" content="http://c.org/1?u=a&amp;v=b">', "http://c.org/1?u=a&v=b"), ("http://a.org/x", link % "mailto:me@b.org", None), ("http://a.org/x", link % "#top", None),
    ]
    for url, html, want in given:
        rows = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
        assert [r["v"] for r in urls.page_edges(rows).collect()] == ([want] if want else []), (url, html)
    two = spark.createDataFrame([(1, "http://a.org/x", refresh % "/1" + refresh % "/2" + link % "/3")], "page_id long, url string, html string")
    assert sorted(r["v"] for r in urls.page_edges(two).collect()) == ["http://a.org/1", "http://a.org/2", "http://a.org/3"]
    pages_ = [(1, "http://b.net/es/1", link % "/new"), (2, "http://b.net/new", None), (3, "http://a.org/3", refresh % "//b.net/es/1")]
    found = {r["page_id"]: r["verdict"] for r in urls.op5_urls(spark.createDataFrame(pages_, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block"}


def test_urls_by_brute_force(spark):
    """Random chains, cycles, targets that are no pages, references and repeated rows; the SQL on the same rows."""
    import duckdb
    import pandas as pd

    r = random.Random(12)
    hosts = ["a.org", "b.net", "www.c.com", "example.com", "D.org"]
    place = lambda: f"http://{r.choice(hosts)}/{r.choice(['es/', 'fr/', 'en/', '', '', ''])}{r.randrange(40)}"
    shapes = ['<link rel="canonical" href="%s">', "<META content='3; URL=%s' http-equiv=Refresh>", '<link data-x="1" href=%s rel=canonical >', '<meta property="og:url" content="%s"/>', '<link rel=next href="%s">', '<a href="%s">']
    rows = []
    for k in range(150):
        given = "".join(r.choice(shapes) % (t + r.choice(["", "", "?a=1&amp;b=2", "#x"])) for t in (place() for _ in range(r.choice([0, 0, 1, 1, 2]))))
        rows.append((k, place() + r.choice(["", "", "#top"]), given))
    rows += [(200, "http://b.net/es/1", None), (201, None, shapes[0] % "http://a.org/1"), (202, "", ""), (203, "http://a.org", shapes[0] % "//b.net/es/99"), (203, "http://a.org", shapes[0] % "//b.net/es/99"), (204, "HTTP://A.org/#z", ""), (205, "http://q.org/" + "x" * 50_000, shapes[0] % ("/" + "y" * 50_000))]
    norm = lambda u: (lambda m: f"{m[1].lower()}://{m[2].lower()}{m[3] or '/'}{m[4] or ''}")(re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", u))
    edges, nodes = [], set()
    for _, u, page in rows:
        for t in re.findall(r"(?:canonical\" href|refresh content|og:url\" content)=\"([^\"]*)|<META content='3; URL=([^']*)'|data-x=\"1\" href=(\S+)", page or "") if u else []:
            t = "".join(t).replace("&amp;", "&")
            t = "http:" + t if t.startswith("//") else "http://q.org" + t if t.startswith("/") else t
            edges.append((norm(u), norm(t)))
            nodes |= {*edges[-1]}
    root = united(edges)
    members = collections.defaultdict(set)
    for x in nodes:
        rule = plain_verdict(x)[2]
        members[root.get(x, x)].add(rule and rule[0])
    want = []
    for k, u, _ in rows:
        host, path, rule = plain_verdict(u)
        said = members.get(root.get(norm(u), norm(u)), set()) if u else set()
        want.append((k, host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if "block" in said and "allow" not in said else "allow"))
    assert sum(w[3] is None and w[4] == "block" for w in want) > 5
    columns = ["page_id", "host", "path", "rule", "verdict"]
    order = lambda xs: sorted((tuple(x) for x in xs), key=str)
    found = urls.op5_urls(spark.createDataFrame([(*x, "h", "v") for x in rows], "page_id long, url string, html string, host string, verdict string")).select(columns).collect()
    assert order(found) == order(want)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert order(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op5_urls']})").fetchall()) == order(want)


# -- pipeline ------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    """Each stage against the plain version of its decision."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.01")
        rows, left = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            y = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
            assert np.mean([(i in left) == (v == 1) for i, v in y.items()]) > 0.97
        if k == 1:
            groups = plain_groups([(i, r["text"]) for i, r in rows.items()])
            assert set(left) == {i for i, (_, root) in groups.items() if root == i}
        if k == 2:
            norm = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
            items = [norm(r["text"]) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
            assert set(left) == {i for i, r in rows.items() if not any(x in norm(r["text"]) for x in items)}
        if k == 3:
            assert set(left) == set(rows) and not any(plain_spans(r["text"]) for r in left.values())
            assert all(left[i]["text"] == r["text"] for i, r in rows.items() if not plain_spans(r["text"]))
        if k == 4:
            assert {i: r["decoded"] for i, r in left.items()} == {i: r["text"] for i, r in rows.items()}
        docs = out if k == 4 else spark.createDataFrame(out.collect(), out.schema)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id").collect()} == set(left)


def test_pipeline_takes_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x a@b.cd", "en", "s", 8), (3, "word " * 30_000, "en", "s", 150_000), (3, "word " * 30_000, "en", "s", 150_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 1
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() <= 5


def test_filters_of_terms_are_not_written_into_plans(spark):
    docs = spark.createDataFrame([(k, f"write to ann{k % 2}@example.com about bluebird number {k}", None) for k in range(6)] + [(6, None, None)], "doc_id long, text string, n_chars int")
    shown = docs.select(F.explode(pii.terms_of(F.lit("bluebird about"))).alias("t")).distinct().withColumn("disclosure", F.lit(0.9))
    shared = docs.select(pii.hashed(F.concat(F.lit("email:ann"), F.col("doc_id") % 2, F.lit("@example.com"))).alias("e")).distinct()
    for df in (pii.marks(docs, shown), pii.frequencies(docs, shown), pii.co_occurrence(pii.with_base_spans(docs).localCheckpoint(), shared)):
        assert len(df._jdf.queryExecution().toString()) < 100_000
        assert "AS __filter" not in df._jdf.queryExecution().optimizedPlan().toString()  # nor copied with each row
        assert df.count() > 0
    assert {r["t_id"]: len(r["terms"]) for r in pii.marks(docs, shown).collect()} == dict.fromkeys(range(6), 2)
