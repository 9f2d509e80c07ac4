"""The text operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprints, langid, neardup, pages, pieces, pii, quality, toxicity, urls
from .common import table


def tokenizer_path() -> str:
    """Where the public merge-type model is; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2_personal_data(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op3_near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4_language(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op5_urls(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op6_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op7_pieces(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.op9_main_text(table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op10_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_quality, op2_personal_data, op3_near_duplicates, op4_language, op5_urls, op6_decontamination, op7_pieces, op8_toxicity, op9_main_text, op10_fingerprints)
    return {f.__name__: f for f in found}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, and what their links connect.
NEAR_DUPLICATES_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
  r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
  c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id"""


def _key_sql(url: str) -> str:
    path = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    return f"CASE WHEN contains({url}, '://') THEN translate(regexp_extract({url}, '(?s)^(.*?)://', 1), '{UPPER}', '{LOWER}') || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || regexp_extract({url}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END"


def _urls_sql() -> str:
    """Recursive components over the pages' edges.  Of character references SQL knows only `&amp;`, and it leaves `..` in paths."""
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))

    def fitting(host: str, path: str, what) -> str:
        return "CASE " + " ".join(f"WHEN ends_with('.' || {host}, '.{h}') AND starts_with({path}, '{p}') THEN '{what(v, h, p)}'" for v, h, p in ordered) + " END"

    parts = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')", "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    tag = "regexp_extract_all(html, '(?is)<{0}[\\s/](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>')"
    value = "trim(regexp_replace(regexp_extract({0}, '(?is)[\\s\"''/]{1}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\"''\\s>]+)', 1), '^[\"'']|[\"'']$', '', 'g'))"
    rel, href, equiv, content, prop = (value.format("x", k) for k in ("rel", "href", "http-equiv", "content", "property"))
    links = f"list_transform(list_filter({tag.format('link')}, lambda x: regexp_matches({rel}, '(?i)(^|\\s)canonical(\\s|$)')), lambda x: {href})"
    sent = f"list_transform(list_filter({tag.format('meta')}, lambda x: lower({equiv}) = 'refresh'), lambda x: regexp_extract({content}, '(?is)^[^;,]*[;,]\\s*url\\s*=\\s*[\"'']?([^\"''\\s>;]+)', 1))"
    shared = f"list_transform(list_filter({tag.format('meta')}, lambda x: lower({prop}) = 'og:url'), lambda x: {content})"
    site, page = "regexp_extract(url, '(?s)^.*?://[^/?#]*')", "regexp_extract(url, '(?s)^[^?#]*')"
    folder = f"{site} || CASE WHEN {parts[1].format('url')} = '' THEN '/' ELSE regexp_extract({parts[1].format('url')}, '(?s)^.*/') END"
    whole = f"""CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t WHEN starts_with(t, '/') THEN {site} || t
      WHEN starts_with(t, '?') THEN {page} || t WHEN starts_with(t, '#') THEN url WHEN NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {folder} || t END"""
    rule, own = (fitting("host", "path", f) for f in (lambda v, h, p: h + p, lambda v, h, p: v))
    node = fitting(parts[0].format("k"), parts[1].format("k"), lambda v, h, p: v)
    return f"""WITH RECURSIVE p AS (SELECT page_id, url, html, {parts[0].format("coalesce(url, '')")} AS host, {parts[1].format("coalesce(url, '')")} AS path, {_key_sql("url")} AS k FROM pages),
      t AS (SELECT url, k, replace(unnest({links} || {sent} || {shared}), '&amp;', '&') AS t FROM p WHERE html IS NOT NULL AND k IS NOT NULL), w AS (SELECT k, {whole} AS t FROM t WHERE t <> ''),
      e AS (SELECT k AS a, {_key_sql("t")} AS b FROM w WHERE t IS NOT NULL), b AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
      r(k, reached) AS (SELECT a, a FROM b UNION SELECT r.k, b.b FROM r JOIN b ON r.reached = b.a),
      n AS (SELECT k, {node} AS own FROM (SELECT DISTINCT k FROM r)),
      v AS (SELECT r.k, bool_or(n.own = 'block') AND NOT bool_or(coalesce(n.own, '') = 'allow') AS blocked FROM r JOIN n ON r.reached = n.k GROUP BY r.k)
      SELECT page_id, host, path, {rule} AS rule, coalesce({own}, CASE WHEN v.blocked THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN v ON p.k = v.k"""


def oracle_sql() -> dict[str, str]:
    """SQL of those operators that SQL can express; the others are tested against brute force, round trips or held-out accuracy."""
    return {"op3_near_duplicates": NEAR_DUPLICATES_SQL, "op5_urls": _urls_sql()}
