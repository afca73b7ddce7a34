"""Registered queries of the training-data operators and their DuckDB statements.

Each ``opN_*`` query applies its operator to the whole of its table and derives
the columns that the query promises from the operator's own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, filter_audit, lang_id, perplexity, quality, toxicity, url_filter
from .common import crc32_of_text
from .decontam import contamination
from .line_dedup import remove_boilerplate
from .mixing import mix
from .near_dedup import near_duplicates
from .prefix_trie import trie
from .sharding import shard_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that stand on at least five sources."""
    res = remove_boilerplate(spark, table(spark, sf_dir, "documents"), min_sites=5)
    return res.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` over 4-word shingles, similarity 0.8 or more."""
    res = near_duplicates(spark, table(spark, sf_dir, "documents"), k=4, num=80, den=100)
    return res.select("doc_id", "n_shingles", "component_id", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    held = crc32_of_text(F.col("doc_id")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held)
    model = toxicity.fit(spark, docs.select("doc_id", "text").join(labels, "doc_id"))
    got = docs.select("doc_id", held.alias("held_out"), toxicity.scorer(spark, model).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = crc32_of_text(F.col("doc_id")) % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held)
    model = quality.fit(spark, docs.filter(~held), labels=labels)
    got = docs.select("doc_id", held.alias("held_out"), quality.scorer(model).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every embedding whose id is divisible by 20."""
    return ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into 40 shards of nearly equal bytes through 16,384 virtual slots."""
    res = shard_records(spark, table(spark, sf_dir, "documents"), n_shards=40)
    return res.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


#: Target weights of the mixture (unlisted names count as 1).
MIX_WEIGHTS = {"domain": {"d0": 4.0, "d1": 2.0, "d2": 1.0, "d3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def domain_of(source: str = "source"):
    """Stand-in for the domain that ``documents`` lacks: one of d0 to d3 by the source's name."""
    first = F.conv(F.substring(F.md5(F.col(source)), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), (first % 4).cast("string"))


def op7_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mixture of half of all tokens takes each of ``documents``."""
    res = mix(spark, table(spark, sf_dir, "documents"), domain_of(), budget_share=0.5, weights=MIX_WEIGHTS, max_epochs=4, seed=42)
    return res.select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of ``benchmark`` items found in ``documents``, per document."""
    res = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return res.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      "contaminated", "n_near_items")


#: Explicit rules (verdict, host, path), as the query's contract states them.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``.

    Stand-in for labelled URLs: a page takes the row of ``labels`` with its own
    id; low quality or toxic means block.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    label = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("label")
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), label), "page_id").select("url", "label")
    return url_filter.judge(spark, pages, labelled, URL_RULES)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = crc32_of_text(F.col("doc_id")) % 4 == 2
    model = lang_id.fit(spark, docs.filter(~held))
    got = docs.select("doc_id", held.alias("held_out"), lang_id.predictor(spark, model).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over ``documents`` in all 120 orders: what each step keeps and removes, per source."""
    return filter_audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of ``documents`` and the verdict of each language's perplexity band."""
    res = perplexity.assess(spark, table(spark, sf_dir, "documents"))
    return res.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of ``conversations``, each rebuilt on the first of its block of five."""
    res = trie(spark, table(spark, sf_dir, "conversations"))
    return res.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op6_quality_ranking": op6_quality_ranking,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_virtual_slot_sharding": op5_virtual_slot_sharding,
    "op9_url_association_rules": op9_url_association_rules,
    "op10_language_id": op10_language_id,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op7_hierarchical_mixing": op7_hierarchical_mixing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_perplexity_rules": op12_perplexity_rules,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = "string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_MIX_SHARE = """
  SELECT *, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * w) END AS part FROM (
    SELECT *, first_value(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER (PARTITION BY {p} ORDER BY ratio, {c} ROWS UNBOUNDED PRECEDING) AS lvl FROM (
      SELECT *, greatest(budget - coalesce(sum(cap) OVER (PARTITION BY {p} ORDER BY ratio, {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
        / sum(w) OVER (PARTITION BY {p} ORDER BY ratio, {c} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM (
        SELECT *, cap / w AS ratio FROM ({rows}))))
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, coalesce('=' || source, 'null') AS site, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT k, site, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM d),
t AS (SELECT k, site, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
bad AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 5),
c AS (SELECT k, count(*) AS n_lines, count(*) FILTER (bare IN (SELECT bare FROM bad)) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bare NOT IN (SELECT bare FROM bad)), '') AS cleaned FROM t GROUP BY k)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CAST(strlen(CASE WHEN text IS NOT NULL THEN cleaned END) AS BIGINT) AS n_bytes, md5(CASE WHEN text IS NOT NULL THEN cleaned END) AS text_md5
FROM d LEFT JOIN c USING (k)
""",
    "op7_hierarchical_mixing": f"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, 'null')) AS h,
    coalesce('d' || CAST(CAST('0x' || substr(md5(source), 1, 1) AS INT) % 4 AS VARCHAR), 'null') AS domain, coalesce(lang, 'null') AS lang,
    coalesce(source, 'null') AS source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
dom AS ({_MIX_SHARE.format(p="1", c="domain", rows="""SELECT domain, sum(CAST(tokens AS DOUBLE) * 4) AS cap,
  (SELECT CAST(floor(sum(tokens) * CAST(0.5 AS DOUBLE)) AS DOUBLE) FROM leaf) AS budget,
  CASE domain WHEN 'd0' THEN 4.0::DOUBLE WHEN 'd1' THEN 2.0 ELSE 1.0 END AS w FROM leaf GROUP BY domain""")}),
lng AS ({_MIX_SHARE.format(p="domain", c="lang", rows="""SELECT l.domain, l.lang, l.cap, dom.part AS budget,
  CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END AS w
  FROM (SELECT domain, lang, sum(CAST(tokens AS DOUBLE) * 4) AS cap FROM leaf GROUP BY domain, lang) l JOIN dom USING (domain)""")}),
src AS ({_MIX_SHARE.format(p="domain, lang", c="source", rows="""SELECT leaf.domain, leaf.lang, source, tokens, CAST(tokens AS DOUBLE) * 4 AS cap,
  lng.part AS budget, 1.0::DOUBLE AS w FROM leaf JOIN lng USING (domain, lang)""")}),
plan AS (SELECT domain, lang, source, tokens, CAST(floor(part + 1e-6) AS BIGINT) AS leaf_budget FROM src),
ep AS (SELECT *, CASE WHEN tokens > 0 THEN leaf_budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN leaf_budget % tokens ELSE 0 END AS rest FROM plan),
k AS (SELECT d.*, leaf_budget, epochs, rest, md5('42:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || h) AS key
  FROM d JOIN ep USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
  CAST(epochs + CASE WHEN n_tokens > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - n_tokens < rest THEN 1 ELSE 0 END AS INT) AS copies
FROM k
""",
    "op8_benchmark_decontamination": f"""
WITH item AS (
  SELECT row_number() OVER () AS ik, item_id, w, least(13, len(w)) AS l FROM (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, list_filter({_WORDS.format(t="text")}, lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0),
win AS (SELECT DISTINCT ik, item_id, l, list_slice(w, s, s + l - 1) AS ws
  FROM (SELECT *, unnest(generate_series(1, len(w) - l + 1)) AS s FROM item)),
doc AS (SELECT row_number() OVER () AS k, doc_id, list_filter({_WORDS.format(t="text")}, lambda x: x <> '') AS w FROM documents),
pos AS (SELECT k, unnest(generate_series(1, len(w))) AS p, unnest(w) AS term FROM doc),
lens AS (SELECT DISTINCT l FROM item),
dwin AS (SELECT d.k, p.p, lens.l, list_slice(d.w, p.p, p.p + lens.l - 1) AS ws
  FROM doc d JOIN pos p USING (k) CROSS JOIN lens
  WHERE p.p + lens.l - 1 <= len(d.w) AND p.term IN (SELECT ws[1] FROM win)),
occ AS (SELECT DISTINCT dwin.k, dwin.p, dwin.l, win.item_id FROM dwin JOIN win ON dwin.l = win.l AND dwin.ws = win.ws),
hits AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(generate_series(p, p + l - 1)) AS q FROM occ) GROUP BY k),
names AS (SELECT k, list_sort(list(DISTINCT item_id)) AS items FROM occ GROUP BY k),
cf AS (SELECT term, count(*) AS c FROM pos GROUP BY term),
ranked AS (SELECT ik, item_id, term, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY ik ORDER BY coalesce(c, 0), term) AS r
  FROM (SELECT DISTINCT ik, item_id, unnest(w) AS term FROM item) t LEFT JOIN cf USING (term)),
pick AS (SELECT * FROM ranked WHERE r <= 3 AND ik IN (SELECT ik FROM ranked WHERE r <= 3 GROUP BY ik HAVING count(*) = 3 AND min(c) > 0)),
spot AS (SELECT pick.ik, pick.item_id, pick.r, pos.k, pos.p FROM pick JOIN pos USING (term)),
near AS (SELECT a.ik, a.item_id, a.k, a.p FROM spot a JOIN spot b ON a.ik = b.ik AND a.k = b.k AND a.r = 1 AND b.r > 1 AND abs(a.p - b.p) <= 16
  GROUP BY a.ik, a.item_id, a.k, a.p HAVING count(DISTINCT b.r) = 2),
nears AS (SELECT k, count(DISTINCT item_id) AS n_near_items FROM near GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM doc LEFT JOIN hits USING (k) LEFT JOIN names USING (k) LEFT JOIN nears USING (k)
""",
    "op11_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 200 AS INT) AS a,
    CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS b,
    CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT) AS c,
    CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
    CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS e
  FROM d LEFT JOIN marks USING (doc_id)),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
bits AS (SELECT unnest(range(5)) AS i),
orders AS (
  SELECT chr(65 + CAST(p.i AS INT)) || chr(65 + CAST(q.i AS INT)) || chr(65 + CAST(r.i AS INT)) || chr(65 + CAST(s.i AS INT)) || chr(65 + CAST(u.i AS INT)) AS filter_order,
    [p.i, q.i, r.i, s.i, u.i] AS o
  FROM bits p, bits q, bits r, bits s, bits u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps AS (SELECT filter_order, step, CAST(1 << o[step] AS INT) AS f, CAST(list_sum(list_transform(o[:step - 1], lambda v: 1 << v)) AS INT) AS earlier
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN fails & (coalesce(earlier, 0) | f) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & f > 0 AND fails & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & f > 0 AND fails & coalesce(earlier, 0) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & f > 0 AND fails & coalesce(earlier, 0) = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & f > 0 AND fails & coalesce(earlier, 0) = 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS b,
    sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, k) AS ts FROM t GROUP BY c),
h AS (SELECT *, c - c % 5 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 9 AS h FROM own),
r AS (SELECT h.c, list_concat(coalesce(list_slice(o.ts, 1, h.h), []), coalesce(list_slice(h.ts, h.h + 1, len(h.ts)), [])) AS ts
  FROM h LEFT JOIN own o ON o.c = h.base),
p AS (SELECT c, len(ts) AS l, d, list_transform(list_slice(ts, 1, d), lambda x: x.k) AS path, CASE WHEN d > 0 THEN ts[d].b ELSE 0 END AS b
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
ch AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (path)),
up AS (SELECT list_slice(path, 1, a) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN up USING (path) LEFT JOIN n q ON v.d > 0 AND q.path = list_slice(v.path, 1, v.d - 1)
""",
}
