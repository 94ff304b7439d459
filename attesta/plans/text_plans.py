"""Queries on texts: identity, lines, vocabulary, search, excerpts, quotes and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import records, search
from attesta.plans.tables import STOPS, duck_tokens, table
from attesta.storage import save

QUESTION = "Where is the entry of anst and thtion with onen"
LEXICON = [("g1", "anst"), ("g1", "enst"), ("g2", "thtion"), ("g2", "ention")]


def content_identity(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("src:"), T.sha256_hex(F.col("source")), F.lit(":"), T.sha256_hex(t)).alias("id"), F.octet_length(t).cast("long").alias("byte_len"))


def duplicate_snapshots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select(T.sha256_hex(F.col("text")).alias("sha256"), "doc_id")
    return s.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_no", "line"))
    return x.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def vocabulary_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top_terms(search.vocabulary(table(spark, d, "part"), "p_name"))


def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.concat_ws("", F.initcap("p_name"), "p_type", "p_brand").alias("ident"))
    return x.select("p_partkey", F.array_join(T.tokens(F.regexp_replace("ident", " ", "")), " ").alias("tokens"))


def _question(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("question_id"), F.lit(QUESTION).alias("question"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{g}', '{t}')" for g, t in LEXICON) + " AS t(`group`, token)")


def lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    groups = search.query_groups(_question(spark), _lexicon(spark))
    index = search.postings(docs, "doc_id", {"scope": "source", "code": "text"}, groups)
    return search.scored(index, groups).select("doc_id", "matched", "score")


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    groups = search.query_groups(_question(spark), _lexicon(spark))
    index = search.postings(docs, "doc_id", {"scope": "source", "code": "text"}, groups)
    scores = search.scored(index, groups)
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return search.ranked(scores, sizes, 10).select(F.col("rank").cast("long").alias("rank"), "doc_id", "matched", "score")


def search_status(spark: SparkSession, d: str) -> DataFrame:
    """Every first turn as a question against the texts of all documents."""
    c = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    none = spark.sql("SELECT 'x' AS `group`, 'y' AS token WHERE 1 = 0")
    groups = save(search.query_groups(c, none), "groups")
    index = search.postings(table(spark, d, "documents"), "doc_id", {"name": "text"}, groups)
    hits = search.scored(index, groups)
    return search.status(c, hits, 10, 3)


def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return search.excerpts(docs, ["source"], "doc_id", "text").select("source", "doc_id", F.col("given").cast("long").alias("given"), "truncated")


def overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    """Windows of each language's documents by size: hits that don't overlap a better one of their source."""
    h = table(spark, d, "documents").select("lang", "source", "doc_id", (F.col("doc_id") % 500).alias("start"), (F.col("doc_id") % 500 + F.col("n_chars") % 40 + 1).alias("end"), F.col("n_chars").alias("score"))
    out = search.without_overlaps(h, 10, ["lang"], [F.desc("score"), F.col("doc_id")], "source", "start", "end")
    return out.select("lang", "doc_id", F.col("position").cast("long").alias("position"))


def safe_cut(spark: SparkSession, d: str) -> DataFrame:
    c = T.cut_bytes(F.col("text"), 160)
    return table(spark, d, "documents").select("doc_id", F.octet_length(c).cast("long").alias("n_bytes"), T.sha256_hex(c).alias("sha"))


def quote_windows(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 3 of each document, and why there are none."""
    lines = T.split_lines(F.col("text"))
    x = table(spark, d, "documents").select("doc_id", lines.alias("ls"))
    return x.select("doc_id", T.sha256_hex(T.window_of_lines(F.col("ls"), F.lit(2), F.lit(3))).alias("sha"), T.window_error(F.col("ls"), F.lit(2), F.lit(3)).alias("error"))


def quote_check(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages against whole lines of documents: where they are quoted exactly."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("n", "line"))
    b = table(spark, d, "benchmark").select("item_id", F.explode(T.split_lines(F.col("text"))).alias("line")).where("line <> ''")
    return b.join(lines, "line").groupBy("item_id").agg(F.count("*").alias("n_quotes"), F.count_distinct("doc_id").alias("n_docs"))


def text_features(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, identifiers and bracket balance."""
    t = F.col("text")
    bal = T.bracket_balance(t)
    return table(spark, d, "documents").select("doc_id", F.size(T.identifiers(t)).cast("long").alias("n_identifiers"), bal["round"].cast("long").alias("round"), bal["square"].cast("long").alias("square"), bal["curly"].cast("long").alias("curly"))


def rule_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Pages by tag rules: which operations each page has, and how often."""
    rules = spark.sql("SELECT * FROM VALUES ('link', 'a'), ('para', 'p'), ('para', 'br'), ('head', 'h1'), ('code', 'script') AS t(operation, tag)")
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.join(rules, "tag").groupBy("page_id", "operation").agg(F.count("*").alias("n"))


def project_digest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(T.sha256_hex(F.col("html")).alias("sha256"), F.col("url").alias("path"))
    return records.project_digest(files)


def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """Path safety, language and last segment of each page's path."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), r"\?.*$", "")
    return table(spark, d, "pages").select("page_id", T.path_is_safe(path).alias("safe"), T.language_of(path).alias("language"), T.last_segment(path).alias("last"))


QUERIES = {f.__name__: f for f in (
    content_identity, duplicate_snapshots, lines_explode, vocabulary_topk, identifier_tokens, lexical_scores, lexical_search, search_status, excerpt_budget, overlap_topk,
    safe_cut, quote_windows, quote_check, text_features, rule_inventory, project_digest, url_forms,
)}

_LINES = r"""ls AS (
  SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (
    SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13) || '$', ''), chr(10)) AS l FROM documents))"""
_SCORES = f"""
lex AS (SELECT * FROM (VALUES ('g1','anst'),('g1','enst'),('g2','thtion'),('g2','ention')) AS t(g, token)),
terms AS (SELECT DISTINCT unnest({duck_tokens(repr(QUESTION))}) AS term),
groups AS (
  SELECT DISTINCT coalesce(k.key, term) AS g, coalesce(m.token, term) AS token FROM terms
  LEFT JOIN lex l ON l.token = term LEFT JOIN (SELECT g, min(token) AS key FROM lex GROUP BY g) k ON k.g = l.g LEFT JOIN lex m ON m.g = l.g
  WHERE term NOT IN {STOPS}),
idx AS (
  SELECT doc_id, token, max(w) AS w FROM (
    SELECT doc_id, unnest({duck_tokens("source")}) AS token, 3 AS w FROM documents
    UNION ALL SELECT doc_id, unnest({duck_tokens("text")}), 1 FROM documents) GROUP BY 1, 2),
hit AS (SELECT doc_id, g, max(w) AS w FROM idx JOIN groups USING (token) GROUP BY 1, 2),
sc AS (
  SELECT doc_id, count(*) AS matched, CAST(count(*) * 100 + sum(w) AS BIGINT) AS score FROM hit GROUP BY 1
  HAVING count(*) * 5 >= (SELECT count(DISTINCT g) FROM groups) * 3)"""

ORACLE_SQL = {
    "content_identity": "SELECT doc_id, 'src:' || sha256(source) || ':' || sha256(text) AS id, CAST(octet_length(encode(text)) AS BIGINT) AS byte_len FROM documents",
    "duplicate_snapshots": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "lines_explode": f"WITH {_LINES} SELECT doc_id, CAST(u.i AS BIGINT) AS line_no, l[u.i] AS line FROM ls, unnest(range(1, len(l) + 1)) AS u(i)",
    "vocabulary_topk": f"""WITH t AS (SELECT p_partkey, unnest(list_distinct({duck_tokens("p_name")})) AS token FROM part)
SELECT token, count(*) AS n FROM t WHERE length(token) >= 3 AND NOT regexp_matches(token, '^\\p{{N}}+$') GROUP BY 1 ORDER BY n DESC, token LIMIT 80""",
    "identifier_tokens": f"""WITH i AS (SELECT p_partkey, replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || p_type || p_brand, ' ', '') AS ident FROM part)
SELECT p_partkey, array_to_string({duck_tokens("ident")}, ' ') AS tokens FROM i""",
    "lexical_scores": f"WITH {_SCORES} SELECT doc_id, matched, score FROM sc",
    "lexical_search": f"""WITH {_SCORES}, r AS (
  SELECT row_number() OVER (ORDER BY score DESC, octet_length(encode(text)), sc.doc_id) AS rank, sc.doc_id, matched, score FROM sc JOIN documents d ON d.doc_id = sc.doc_id)
SELECT rank, doc_id, matched, score FROM r WHERE rank <= 10""",
    "search_status": f"""WITH q AS (SELECT conv_id AS question_id, text AS question FROM conversations WHERE turn = 0),
g AS (SELECT DISTINCT question_id, unnest({duck_tokens("question")}) AS token FROM q),
gg AS (SELECT * FROM g WHERE token NOT IN {STOPS}),
n AS (SELECT question_id, count(*) AS n FROM gg GROUP BY 1),
idx AS (SELECT DISTINCT doc_id, unnest({duck_tokens("text")}) AS token FROM documents),
hit AS (SELECT gg.question_id, doc_id, count(*) AS m FROM gg JOIN idx USING (token) GROUP BY 1, 2),
ok AS (SELECT DISTINCT hit.question_id FROM hit JOIN n USING (question_id) WHERE m * 5 >= n.n * 3)
SELECT q.question_id, CASE WHEN trim(question) = '' OR octet_length(encode(question)) > 8192 THEN 'rejected' WHEN ok.question_id IS NOT NULL THEN 'candidates' ELSE 'no_lexical_evidence' END AS status
FROM q LEFT JOIN ok ON ok.question_id = q.question_id""",
    "excerpt_budget": """WITH w AS (SELECT source, doc_id, least(octet_length(encode(text)), 4000) AS want, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT source, doc_id, CAST(least(want, 16000 - before) AS BIGINT) AS given, least(want, 16000 - before) < n AS truncated FROM b WHERE before < 16000""",
    "overlap_topk": """WITH RECURSIVE h AS (
  SELECT lang, source, doc_id, doc_id % 500 AS s, doc_id % 500 + n_chars % 40 + 1 AS e, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents),
f AS (
  SELECT lang, n, [{'source': source, 's': s, 'e': e, 'id': doc_id}] AS kept FROM h WHERE n = 1
  UNION ALL SELECT h.lang, h.n, CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda k: k.source = h.source AND k.s < h.e AND h.s < k.e)) > 0 THEN kept
    ELSE list_append(kept, {'source': h.source, 's': h.s, 'e': h.e, 'id': h.doc_id}) END FROM f JOIN h ON h.lang = f.lang AND h.n = f.n + 1),
z AS (SELECT lang, arg_max(kept, n) AS kept FROM f GROUP BY lang)
SELECT lang, kept[u.i].id AS doc_id, CAST(u.i AS BIGINT) AS position FROM z, unnest(range(1, len(kept) + 1)) AS u(i)""",
    "safe_cut": """WITH c AS (SELECT doc_id, text, [i FOR i IN range(0, 161) IF octet_length(encode(left(text, i))) <= 160] AS ok FROM documents)
SELECT doc_id, CAST(octet_length(encode(left(text, list_max(ok)))) AS BIGINT) AS n_bytes, sha256(left(text, list_max(ok))) AS sha FROM c""",
    "quote_windows": f"""WITH {_LINES} SELECT doc_id, CASE WHEN len(l) >= 3 THEN sha256(l[2] || chr(10) || l[3]) END AS sha, CASE WHEN len(l) < 3 THEN 'past_the_end' END AS error FROM ls""",
    "quote_check": f"""WITH {_LINES}, dl AS (SELECT doc_id, unnest(l) AS line FROM ls), bl AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT item_id, count(*) AS n_quotes, count(DISTINCT doc_id) AS n_docs FROM bl JOIN dl ON dl.line = bl.line WHERE bl.line <> '' GROUP BY 1""",
    "text_features": """SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS BIGINT) AS n_identifiers,
  CAST(length(replace(text, ')', '')) - length(replace(text, '(', '')) AS BIGINT) AS round, CAST(length(replace(text, ']', '')) - length(replace(text, '[', '')) AS BIGINT) AS square,
  CAST(length(replace(text, '}', '')) - length(replace(text, '{', '')) AS BIGINT) AS curly FROM documents""",
    "rule_inventory": """WITH r AS (SELECT * FROM (VALUES ('link','a'),('para','p'),('para','br'),('head','h1'),('code','script')) AS t(operation, tag)),
t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, operation, count(*) AS n FROM t JOIN r USING (tag) GROUP BY 1, 2""",
    "project_digest": "SELECT sha256(string_agg(sha256(html) || '  ' || url, chr(10) ORDER BY sha256(html) || '  ' || url) || chr(10)) AS digest FROM pages",
    "url_forms": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '\?.*$', '') AS path FROM pages)
SELECT page_id, length(path) > 0 AND NOT contains(path, '\') AND NOT contains(path, ':') AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe,
  CASE regexp_extract(path, '\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' ELSE 'auxiliary' END AS language, regexp_extract(regexp_replace(path, '<.*$', ''), '([^:.]*)$', 1) AS last FROM p""",
}
