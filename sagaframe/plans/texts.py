"""Search, normalisation, quotations, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.functions import text as T
from sagaframe.operators import search
from sagaframe.plans.registry import query, table

#: Fixed values for the whitelist query.
KEYWORDS, MARKERS, EXACT = ["blog", "www"], ["utm_source"], ["http://ththon.example.com/"]


@query("SELECT doc_id FROM documents WHERE contains(text || ' ' || coalesce(source, ''), 'tion') AND contains(text || ' ' || coalesce(source, ''), 'src1')")
def multi_token_search(spark, sf):
    return search.multi_token(table(spark, sf, "documents"), T.search_text(F.col("text"), F.col("source")), "  tion　src1 ").select("doc_id")


@query("SELECT page_id FROM pages WHERE contains(url || ' ' || CAST(page_id AS VARCHAR), 'blog')")
def keyword_filter(spark, sf):
    return search.keyword(table(spark, sf, "pages"), F.col("url"), F.col("page_id").cast("string"), "blog").select("page_id")


@query("SELECT doc_id, length(regexp_replace(text, '[^a-zà-ÿ]', '', 'g')) AS n_kept, md5(translate(regexp_replace(text, '[^a-zà-ÿ]', '', 'g'), 'éèêç', 'eeec')) AS mapped FROM documents")
def char_class_keep(spark, sf):
    kept = F.regexp_replace("text", "[^a-zà-ÿ]", "")
    return table(spark, sf, "documents").select("doc_id", F.length(kept).cast("long").alias("n_kept"), F.md5(T.mapped(kept, dict(zip("éèêç", "eeec")))).alias("mapped"))


@query("SELECT doc_id, md5(translate(coalesce(text, ''), 'äöüßñé', 'aousne')) AS digest FROM documents")
def variant_map(spark, sf):
    variants = dict(zip("äöüßñé", "aousne"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.mapped(F.coalesce("text", F.lit("")), variants)).alias("digest"))


@query("""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '"([^"]*)"', 1), lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 6 AND NOT regexp_matches(x, '[0-9]'))) AS BIGINT) AS n_spans FROM documents""")
def quoted_spans(spark, sf):
    found = T.quoted(F.coalesce("text", F.lit("")), '"', '"', 6, "a-zA-Z", "0-9")
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("n_spans"))


@query("""WITH q AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '"([^"]*)"', 1), lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 6 AND NOT regexp_matches(x, '[0-9]')) AS qs FROM documents),
u AS (SELECT doc_id, unnest(qs) AS span, generate_subscripts(qs, 1) - 1 AS i FROM q)
SELECT doc_id, CAST(i AS BIGINT) AS i, span, CAST(doc_id AS VARCHAR) || '|text|' || substr(sha1(span), 1, 12) AS key FROM u""")
def keyed_units(spark, sf):
    found = T.quoted(F.coalesce("text", F.lit("")), '"', '"', 6, "a-zA-Z", "0-9")
    units = table(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("i", "span"))
    return units.select("doc_id", F.col("i").cast("long").alias("i"), "span", T.unit_key(F.col("doc_id"), F.lit("text"), F.col("span")).alias("key"))


@query(rf"""WITH p AS (SELECT item_id, unnest(regexp_split_to_array(text, '{T.PARTS}')) AS p, generate_subscripts(regexp_split_to_array(text, '{T.PARTS}'), 1) AS i FROM benchmark),
f AS (SELECT item_id, i, 0 AS j, substr(p, 1, 10) AS x FROM p UNION ALL SELECT item_id, i, 1, substr(p, length(p) // 2 + 1, 10) FROM p WHERE length(p) >= 20),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i, j) AS r FROM f WHERE length(x) >= 6)
SELECT item_id, string_agg(x, '|' ORDER BY r) AS parts FROM g WHERE r <= 4 GROUP BY 1""")
def fragments_fixed(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.fragments(F.col("text")), "|").alias("parts"))


@query("SELECT item_id, list_aggregate(list_transform(generate_series(0, least(7, (length(text) - 6) // 3)), lambda i: substr(text, CAST(1 + 3 * i AS BIGINT), 6)), 'string_agg', '|') AS parts FROM benchmark WHERE length(text) >= 6")
def shingles(spark, sf):
    return table(spark, sf, "benchmark").where(F.length("text") >= 6).select("item_id", F.array_join(T.sliding_fragments(F.col("text")), "|").alias("parts"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def containment_pairs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return search.contained(table(spark, sf, "benchmark"), docs, "item_id", "text", "doc_id", "body", 20)


@query("SELECT item_id, 'whole' AS stage, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def staged_whole(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    pairs = search.contained(table(spark, sf, "benchmark"), docs, "item_id", "text", "doc_id", "body", 20)
    return pairs.groupBy("item_id").agg(F.min("doc_id").alias("doc_id")).select("item_id", F.lit("whole").alias("stage"), "doc_id")


@query(rf"""WITH whole AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
l1 AS (SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM whole)),
p AS (SELECT item_id, unnest(regexp_split_to_array(text, '{T.PARTS}')) AS p, generate_subscripts(regexp_split_to_array(text, '{T.PARTS}'), 1) AS i FROM l1),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i, j) AS r FROM (SELECT item_id, i, 0 AS j, substr(p, 1, 10) AS x FROM p WHERE length(p) >= 6 UNION ALL SELECT item_id, i, 1, substr(p, length(p) // 2 + 1, 10) FROM p WHERE length(p) >= 20)),
f4 AS (SELECT item_id, r, x, count(*) OVER (PARTITION BY item_id) AS n FROM f WHERE r <= 4),
fh AS (SELECT item_id, r, n, min(doc_id) AS doc_id FROM f4 JOIN documents d ON contains(d.text, x) GROUP BY 1, 2, 3),
frag AS (SELECT item_id, arg_min(doc_id, r) AS doc_id FROM fh GROUP BY item_id, n HAVING count(*) >= CASE WHEN n <= 2 THEN 1 ELSE ceil(n / 2) END),
l2 AS (SELECT item_id, text FROM l1 WHERE item_id NOT IN (SELECT item_id FROM frag)),
s AS (SELECT item_id, i AS r, CASE WHEN length(text) >= 6 THEN substr(text, CAST(1 + 3 * i AS BIGINT), 6) ELSE text END AS x FROM (SELECT item_id, text, unnest(generate_series(0, greatest(0, least(7, (length(text) - 6) // 3)))) AS i FROM l2 WHERE length(text) >= 4)),
s8 AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM s),
sh AS (SELECT item_id, r, n, min(doc_id) AS doc_id FROM s8 JOIN documents d ON contains(d.text, x) GROUP BY 1, 2, 3),
shingle AS (SELECT item_id, arg_min(doc_id, r) AS doc_id FROM sh GROUP BY item_id, n HAVING count(*) >= CASE WHEN n <= 2 THEN 1 ELSE ceil(n / 2) END)
SELECT item_id, 'whole' AS stage, doc_id FROM whole UNION ALL SELECT item_id, 'fragment', doc_id FROM frag UNION ALL SELECT item_id, 'shingle', doc_id FROM shingle""")
def staged_containment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return search.staged(table(spark, sf, "benchmark"), docs, "item_id", "text", "doc_id", "body")


_BLOCKS = ("title", "style", "script", "h1", "nav")
_STRIPPED = "coalesce(html, '')"
for _b in _BLOCKS:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?s)<{_b}[ >].*?</{_b}>', chr(10), 'g')"


@query(f"""WITH s AS (SELECT page_id, string_split(regexp_replace({_STRIPPED}, '(?s)<[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages)
SELECT page_id, md5(coalesce(list_aggregate(list_filter(list_transform(ls, lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> ''), 'string_agg', chr(10)), '')) AS digest FROM s""")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.strip_html(F.coalesce("html", F.lit("")), _BLOCKS)).alias("digest"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>.*?</title>') AS part FROM pages WHERE regexp_matches(html, '(?s)<title>.*</title>')")
def slice_between(spark, sf):
    marked = table(spark, sf, "pages").where(F.col("html").rlike("(?s)<title>.*</title>"))
    return marked.select("page_id", T.slice_between(F.col("html"), "<title>", "</title>").alias("part"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n, line FROM l WHERE n BETWEEN 2 AND 3""")
def line_range(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 2, 2)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 2).cast("long").alias("n"), "line")


@query("""SELECT page_id, contains(url, 'blog') OR contains(url, 'www') OR contains(url, 'utm_source') OR url = 'http://ththon.example.com/' AS listed FROM pages""")
def whitelist_predicate(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.in_whitelist(F.col("url"), KEYWORDS, MARKERS, EXACT).alias("listed"))


@query("""WITH m AS (SELECT doc_id, text, instr(text, 'tion') AS place FROM documents WHERE contains(text, 'tion'))
SELECT doc_id, CAST(1 + length(substr(text, 1, place - 1)) - length(replace(substr(text, 1, place - 1), chr(10), '')) AS BIGINT) AS line, substr(text, greatest(1, place - 20), 40) AS excerpt FROM m""")
def keyword_in_context(spark, sf):
    return search.in_context(table(spark, sf, "documents"), "doc_id", "text", "tion").withColumn("line", F.col("line").cast("long"))
