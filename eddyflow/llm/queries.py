"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyflow.llm import decontaminate, htmltext, langid, mixing, neardup, pii, secrets, topk, toxicity, urlfilter
from eddyflow.llm.common import table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
WEIGHTS = {"domain": {"web": 5, "forum": 2, "reference": 3}, "lang": {"en": 11, "de": 4, "fr": 3, "es": 2}, "source": {}}


def domain() -> F.Column:
    """The domain of a source, by its number."""
    n = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1).try_cast("int")
    return F.when(n < 10, "web").when(n < 15, "forum").when(n >= 15, "reference").otherwise("other")


def op1_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(table(spark, d, "documents"), secrets.fit(secrets.labelled_samples(spark)))


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(table(spark, d, "documents"))


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("score")


def op5_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"))


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_id(table(spark, d, "documents"))


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), domain(), WEIGHTS, columns=["doc_id", "lang", "source"])


def op8_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return urlfilter.judge(table(spark, d, "pages"), RULES)


def op9_main_text(spark: SparkSession, d: str) -> DataFrame:
    return htmltext.extract(table(spark, d, "pages"))


def op10_top_k(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_personal_data, op4_decontamination, op5_near_duplicates, op6_language_id, op7_mixing, op8_url_filters, op9_main_text, op10_top_k)}

# ---------------------------------------------------------------- SQL, where it can express the result
WORDS = r"[\p{L}\p{N}_]+"

LEAKS = rf"""WITH cut AS (SELECT item_id, text, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}_]')) AS p FROM benchmark WHERE text IS NOT NULL),
parts AS (SELECT item_id, k, regexp_extract_all(lower(t), '{WORDS}') AS w FROM (SELECT item_id, 0 AS k, text AS t FROM cut UNION ALL SELECT item_id, 1, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], ' ') ELSE text END FROM cut UNION ALL SELECT item_id, 2, CASE WHEN len(p) > 1 THEN p[len(p)] ELSE text END FROM cut)),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents WHERE text IS NOT NULL),
ps AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, k, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
hits AS (SELECT doc_id, item_id, k, count(*) AS n FROM ds JOIN ps USING (s) GROUP BY ALL),
size AS (SELECT item_id, k, count(*) AS m FROM ps GROUP BY ALL),
runs AS (SELECT d.doc_id, p.item_id, p.k, CAST(contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(p.w, ' ') || ' ') AS DOUBLE) AS share FROM docs d, parts p WHERE len(p.w) BETWEEN 1 AND 4 AND (p.k = 0 OR (d.doc_id, p.item_id) IN (SELECT (doc_id, item_id) FROM hits WHERE k = 0))),
shares AS (SELECT doc_id, item_id, k, n / m AS share FROM hits JOIN size USING (item_id, k) UNION ALL SELECT * FROM runs)
SELECT doc_id, item_id, max(share) FILTER (WHERE k = 0) AS overlap, max(share) FILTER (WHERE k = 1) AS question_overlap, max(share) FILTER (WHERE k = 2) AS answer_overlap FROM shares GROUP BY ALL
HAVING max(share) FILTER (WHERE k = 0) >= 0.8 AND max(share) FILTER (WHERE k = 1) >= 0.5 AND max(share) FILTER (WHERE k = 2) >= 0.5"""


def mixture_sql(share: float, max_epochs: int, seed: int) -> str:
    """The mixture in SQL: one block of window functions for each level of the tree."""
    levels, parts, given = ("domain", "lang", "source"), [], None
    for i, level in enumerate(levels):
        parent, names = levels[:i], ", ".join(levels[: i + 1])
        weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {float(v)}" for k, v in WEIGHTS[level].items()) + " ELSE 1.0 END" if WEIGHTS[level] else "1.0"
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        nodes = f"SELECT {names}, CAST(sum(tokens) AS BIGINT) * {max_epochs} AS cap, CAST({weight} AS DOUBLE) AS w FROM leaf GROUP BY {names}"
        budget = f"SELECT *, least((SELECT CAST(floor(sum(tokens) * CAST({share} AS DOUBLE)) AS BIGINT) FROM leaf), CAST(sum(cap) OVER () AS BIGINT)) AS budget FROM ({nodes})" if given is None else f"SELECT n.*, g.budget FROM ({nodes}) n JOIN {given} g USING ({', '.join(parent)})"
        parts.append(f"""a{i} AS (SELECT *, budget - coalesce(CAST(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rem, sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM ({budget})),
b{i} AS (SELECT *, CAST(cap AS DOUBLE) * ws <= CAST(rem AS DOUBLE) * w AS filled FROM a{i}),
c{i} AS (SELECT *, budget - coalesce(CAST(sum(CASE WHEN filled THEN cap END) OVER ({by}) AS BIGINT), 0) AS free, max(CASE WHEN NOT filled THEN ws END) OVER ({by}) AS fw FROM b{i}),
d{i} AS (SELECT {names}, CASE WHEN filled THEN cap ELSE least(cap, CAST(floor(free * w / fw) AS BIGINT)) END AS budget FROM c{i})""")
        given = f"d{i}"
    tree = ",\n".join(parts)
    return f"""WITH doc AS (SELECT doc_id, lang AS l, source AS s, coalesce(lang, '') AS lang, coalesce(source, '') AS source, tokens, CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'forum' WHEN n >= 15 THEN 'reference' ELSE 'other' END AS domain
FROM (SELECT *, TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) AS n, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS tokens FROM documents)),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM doc GROUP BY ALL),
{tree},
plan AS (SELECT l.*, CASE WHEN l.tokens > 0 THEN g.budget // l.tokens ELSE 0 END AS epochs, g.budget AS b FROM leaf l JOIN d2 g USING (domain, lang, source)),
x AS (SELECT d.*, p.epochs, p.b - p.epochs * p.tokens AS rest, CAST('0x' || substr(md5('{seed}:' || p.epochs || ':' || d.doc_id), 1, 15) AS BIGINT) AS u FROM doc d JOIN plan p USING (domain, lang, source)),
y AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY u, doc_id) AS run FROM x)
SELECT doc_id, l AS lang, s AS source, domain, tokens, CAST(epoch AS INT) AS epoch FROM (SELECT *, unnest(range(0, CAST(epochs AS BIGINT))) AS epoch FROM x) UNION ALL SELECT doc_id, l, s, domain, tokens, CAST(epochs AS INT) FROM y WHERE rest > 0 AND run <= rest"""


def verdicts_sql() -> str:
    """Rules, and the verdicts of redirect components by recursion over their edges.

    Links are found here by whole tags and their attributes, one after another.
    """
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: lower(f"regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1)")
    path = lambda u: f"regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    rest = lambda u: f"regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^#]*)', 1)"
    address = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || CASE WHEN {rest(u)} = '' THEN '/' ELSE {rest(u)} END END"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    case = lambda i, h, p: "CASE " + " ".join(f"WHEN ({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}') THEN '{r[1] + r[2] if i else r[0]}'" for r in ordered) + " END"
    site, folder = "regexp_extract(url, '^(?s:.*?)://[^/?#]*', 0)", f"coalesce(nullif(regexp_extract({path('url')}, '(?s)^.*/', 0), ''), '/')"
    dots = "list_reduce(string_split(p, '/'), lambda d, x: CASE WHEN x = '..' THEN regexp_replace(d, '/[^/]*$', '') WHEN x = '.' THEN d ELSE d || '/' || x END)"
    return rf"""WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
named AS (SELECT DISTINCT url, h FROM (SELECT url, regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s<>]+)', 1) AS h FROM tags WHERE regexp_matches(tag, '(?i)^<link\s') AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical')
UNION ALL SELECT url, regexp_extract(tag, '(?i)\scontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s<>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?i)^<meta\s') AND regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh')) WHERE h <> ''),
href AS (SELECT url, replace(h, '&amp;', '&') AS h FROM named),
joint AS (SELECT url, h, CASE WHEN starts_with(h, '/') THEN h WHEN starts_with(h, '?') OR starts_with(h, '#') THEN {path('url')} || h ELSE {folder} || h END AS w FROM href),
parts AS (SELECT url, h, regexp_extract(w, '^[^?#]*', 0) AS p, regexp_extract(w, '(?s)^[^?#]*(.*)$', 1) AS tail FROM joint),
target AS (SELECT url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h WHEN starts_with(h, '//') THEN 'http:' || h ELSE {site} || CASE WHEN contains(p, '/.') THEN {dots} || CASE WHEN regexp_matches(p, '/\.\.?$') THEN '/' ELSE '' END ELSE p END || tail END AS t FROM parts),
edge AS (SELECT a, b FROM (SELECT {address('url')} AS a, {address('t')} AS b FROM target) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON r.m = e.a),
ruled AS (SELECT n, m, {case(0, host("('http://' || m)"), path("('http://' || m)"))} AS v FROM reach),
alias AS (SELECT n, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM ruled GROUP BY n),
page AS (SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path, {address('url')} AS address FROM pages)
SELECT page_id, host, path, {case(1, 'host', 'path')} AS rule, coalesce({case(0, 'host', 'path')}, a.v, 'allow') AS verdict FROM page LEFT JOIN alias a ON page.address = a.n"""


TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

ORACLE: dict[str, str] = {"op4_decontamination": LEAKS, "op7_mixing": mixture_sql(0.6, 3, 1), "op8_url_filters": verdicts_sql(), "op10_top_k": TOP_K}
