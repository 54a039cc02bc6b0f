"""Registered queries: text scoring and text sources (J, D15, A2, A3, A10)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from postlens.functions import text as TX
from postlens.operators import textops as TO
from postlens.operators import trend as T
from postlens.plans.q_core import posts
from postlens.plans.q_trend import VELOCITY
from postlens.plans.registry import register
from postlens.plans.sqlbase import with_
from postlens.session import checkpoint_dir
from postlens.sources.comments import COMMENTS_SQL, comments_from_tables
from postlens.sources.corpus import (keyword_trends, labelled_corpus, polarity_rows, scan_corpus,
                                     write_corpus_from_conversations)

COMMENTS_CTE = f"comments AS ({COMMENTS_SQL})"

# Lists that occur in the driver's invented prose (the reference's English
# lists hardly match it); the default-list queries run as well.
PROSE_STRUGGLE = ("the", "and", "tion")
PROSE_PHRASES = ("en", "le ")
PROSE_EMPATHY = ("que", "ou", "ing")
PROSE_LEXICON = {"the": 0.5, "and": 0.25, "is": -0.75, "le": 1.0, "la": -1.5, "de": 0.5, "en": -0.5}


def _q(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def _sql_hits(words, t="lower(comment_text)"):
    return "(" + " + ".join(f"CAST(contains({t}, {_q(w)}) AS INTEGER)" for w in words) + ")"


def _sql_relatability(st, ph, em):
    return (f"least(least({_sql_hits(st)} * 15, 40) + least({_sql_hits(ph)} * 20, 35) + "
            f"least({_sql_hits(em)} * 15, 25) + CASE WHEN regexp_matches(lower(comment_text), "
            f"'\\?|why does|why is|can we talk about|has anyone') THEN 5 ELSE 0 END, 100)")


def _sql_any(words):
    return f"CAST({_sql_hits(words)} > 0 AS INTEGER)"


def _rel_sql(st, ph, em):
    return (f"WITH {COMMENTS_CTE}\nSELECT comment_id, round({_sql_relatability(st, ph, em)}, 1) "
            f"AS relatability_score, {_sql_any(st)} AS has_struggle_word, {_sql_any(ph)} AS "
            f"has_relatable_phrase, {_sql_any(em)} AS has_empathy_marker FROM comments")


def _rel_spark(spark, d, **kw):
    c = comments_from_tables(spark, d)
    return TO.tag_comments(c, **kw).select("comment_id", "relatability_score", "has_struggle_word",
                                           "has_relatable_phrase", "has_empathy_marker")


@register("relatability_score", _rel_sql(TX.STRUGGLE_WORDS, TX.RELATABLE_PHRASES, TX.EMPATHY_MARKERS))
def q_relatability_score(spark, d):
    """J1 + J2 with the default lexicons."""
    return _rel_spark(spark, d)


@register("relatability_prose", _rel_sql(PROSE_STRUGGLE, PROSE_PHRASES, PROSE_EMPATHY))
def q_relatability_prose(spark, d):
    """J1 + J2 with lists that occur in the driver prose."""
    return _rel_spark(spark, d, struggle=PROSE_STRUGGLE, phrases=PROSE_PHRASES, empathy=PROSE_EMPATHY)


def _aw_sql(sys_, sha, per):
    def cnt(words):
        return " + ".join(f"max(CAST(contains(lower(comment_text) || ' ', {_q(w)}) AS INTEGER))" for w in words)
    return f"""WITH {COMMENTS_CTE},
g AS (SELECT content_category, {cnt(sys_)} AS s, {cnt(sha)} AS h, {cnt(per)} AS p
      FROM comments WHERE content_category IS NOT NULL GROUP BY content_category)
SELECT content_category, CASE WHEN s >= 2 THEN 'Systemic' WHEN h >= 2 THEN 'Shared'
                              WHEN p >= 3 THEN 'Personal' ELSE 'None' END AS problem_awareness FROM g"""


AW_PROSE = (("the ", "of "), ("le ", "la ", "des "), ("en ", "de ", "que ", "xyz "))


@register("problem_awareness", _aw_sql(TX.AWARENESS_SYSTEMIC, TX.AWARENESS_SHARED, TX.AWARENESS_PERSONAL))
def q_problem_awareness(spark, d):
    """J5 with the default keyword lists."""
    return TO.problem_awareness(comments_from_tables(spark, d))


@register("problem_awareness_prose", _aw_sql(*AW_PROSE))
def q_problem_awareness_prose(spark, d):
    """J5 with lists that occur in the prose."""
    s, h, p = AW_PROSE
    return TO.problem_awareness(comments_from_tables(spark, d), systemic=s, shared=h, personal=p)


def _pol_sql(lex):
    cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in sorted(lex.items()))
    return f"""WITH {COMMENTS_CTE},
t AS (SELECT comment_id, list_sum(list_transform(
        regexp_extract_all(lower(comment_text), '([\\p{{L}}\\p{{N}}_'']+)', 1),
        lambda w: CASE w {cases} ELSE 0.0 END)) AS x FROM comments)
SELECT comment_id, round(coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15), 3) AS vader_compound FROM t"""


@register("polarity", _pol_sql(PROSE_LEXICON))
def q_polarity(spark, d):
    """Lexicon compound score with a lexicon parameter."""
    c = comments_from_tables(spark, d)
    return c.select("comment_id", TO.polarity("comment_text", PROSE_LEXICON).alias("vader_compound"))


@register("polarity_table", _pol_sql(PROSE_LEXICON))
def q_polarity_table(spark, d):
    """The same with the lexicon as a table."""
    lexicon = spark.createDataFrame(sorted(PROSE_LEXICON.items()), "term string, weight double")
    return TO.lexicon_scores(comments_from_tables(spark, d), lexicon)


@register("caption_features", f"""WITH {COMMENTS_CTE}
SELECT comment_id, CAST({_sql_hits(TX.CTA_PHRASES, "lower(coalesce(comment_text, ''))")} > 0 AS INTEGER) AS has_cta,
       CAST(len(regexp_extract_all(coalesce(comment_text, ''), '#[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS hashtags_count,
       CAST(len(regexp_extract_all(coalesce(comment_text, ''), '@[\\p{{L}}\\p{{N}}_]+')) AS BIGINT) AS at_mentions,
       CAST(length(comment_text) AS BIGINT) AS caption_length,
       CASE {" ".join(f"WHEN contains(lower(coalesce(comment_text, '') || ' ' || content_category), '{k}') THEN '{c}'" for k, c in TX.CATEGORY_KEYWORDS)}
            ELSE 'Technology' END AS topic
FROM comments""")
def q_caption_features(spark, d):
    """J6 + J7 + J8: CTA flag, tag and mention counts, length, keyword topic."""
    c = comments_from_tables(spark, d)
    return c.select("comment_id", TX.detect_cta("comment_text").alias("has_cta"),
                    TX.count_hashtags("comment_text").alias("hashtags_count"),
                    TX.count_mentions("comment_text").alias("at_mentions"),
                    F.length("comment_text").alias("caption_length"),
                    TX.classify_topic("comment_text", "content_category").alias("topic"))


COUNT_TEXT_SQL = """
CASE l_linenumber % 7
  WHEN 0 THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING) || ','
              || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0') || ' likes'
  WHEN 1 THEN CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING) || '.'
              || CAST(CAST(floor(l_extendedprice / 100) AS BIGINT) % 10 AS STRING) || 'K'
  WHEN 2 THEN CAST(CAST(floor(l_quantity / 10) AS BIGINT) AS STRING) || '.'
              || CAST(CAST(floor(l_quantity) AS BIGINT) % 10 AS STRING) || 'm'
  WHEN 3 THEN 'N/A'
  WHEN 4 THEN '--'
  WHEN 5 THEN ''
  ELSE ' ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || ' views' END"""


@register("parse_count", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {COUNT_TEXT_SQL} AS count_text FROM lineitem),
p AS (SELECT *, regexp_extract(trim(replace(count_text, ',', '')), '([0-9.]+)\\s*([KkMm]?)', 1) AS num,
             upper(regexp_extract(trim(replace(count_text, ',', '')), '([0-9.]+)\\s*([KkMm]?)', 2)) AS suf
      FROM t)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, count_text,
       CASE WHEN count_text IS NULL OR count_text IN ('N/A', '--', '') OR num = '' THEN 0
            ELSE coalesce(CAST(floor(TRY_CAST(num AS DOUBLE) * CASE suf WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000
                                                                   ELSE 1 END) AS BIGINT), 0) END AS parsed
FROM p""")
def q_parse_count(spark, d):
    """Count texts (derived from lineitem amounts) parsed to integers."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    t = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                  F.expr(COUNT_TEXT_SQL).alias("count_text"))
    return t.withColumn("parsed", TX.parse_count("count_text"))


@register("split_tags", """
WITH t AS (SELECT doc_id, ' #' || lang || ', ' || source || ' , ,##' || lang || 'x,' AS tags FROM documents)
SELECT doc_id, tags, list_transform(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)),
                                                lambda x: x <> ''), lambda x: regexp_replace(x, '^#+', '')) AS tag_list
FROM t""")
def q_split_tags(spark, d):
    """Comma lists of tags cleaned into arrays."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    t = docs.select("doc_id", F.concat(F.lit(" #"), F.col("lang"), F.lit(", "), F.col("source"),
                                       F.lit(" , ,##"), F.col("lang"), F.lit("x,")).alias("tags"))
    return t.withColumn("tag_list", TX.split_tags("tags"))


@register("page_links", """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link,
                  generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS pos
           FROM pages)
SELECT page_id, CAST(pos AS BIGINT) AS pos, link,
       CASE WHEN contains(link, '/reel/') THEN 'reel' ELSE 'image' END AS media_type
FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS r FROM h) WHERE r = 1""")
def q_page_links(spark, d):
    """J14 + J10 + F6: distinct links of the stored pages (all anchors)."""
    return TO.page_links(spark.read.parquet(f"{d}/pages.parquet"), post_links_only=False)


@register("page_posts", """
SELECT url AS link, CASE WHEN contains(url, '/reel/') THEN 'reel' ELSE 'image' END AS media_type,
       regexp_extract(html, '<title>(.*?)</title>', 1) AS caption,
       CAST(length(regexp_extract(html, '<title>(.*?)</title>', 1)) AS BIGINT) AS caption_length,
       CAST(len(regexp_extract_all(regexp_extract(html, '<title>(.*?)</title>', 1), '#[\\p{L}\\p{N}_]+')) AS BIGINT) AS hashtags_count,
       CAST(len(regexp_extract_all(regexp_extract(html, '<title>(.*?)</title>', 1), '@[\\p{L}\\p{N}_]+')) AS BIGINT) AS at_mentions,
       CAST(""" + _sql_hits(TX.CTA_PHRASES, "lower(regexp_extract(html, '<title>(.*?)</title>', 1))") + """ > 0 AS INTEGER) AS has_cta
FROM pages""")
def q_page_posts(spark, d):
    """J14 + J6/J7/J10: scraped-post rows from stored pages."""
    return TO.page_posts(spark.read.parquet(f"{d}/pages.parquet"))


@register("word_bigrams", f"""WITH {COMMENTS_CTE},
t AS (SELECT comment_id, list_filter(regexp_extract_all(strip_accents(lower(comment_text)), '[\\p{{L}}\\p{{N}}_]+'),
                                     lambda w: regexp_full_match(w, '[a-z][a-z]+')) AS tk
      FROM comments),
b AS (SELECT comment_id, list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS terms
      FROM t)
SELECT comment_id, CAST(len(terms) AS BIGINT) AS n_terms, md5(array_to_string(terms, '|')) AS terms_md5 FROM b""")
def q_word_bigrams(spark, d):
    """Unigram + bigram terms per comment (term count and digest)."""
    c = comments_from_tables(spark, d)
    terms = TX.word_bigrams("comment_text")
    return c.select("comment_id", F.size(terms).alias("n_terms"),
                    F.md5(F.array_join(terms, "|")).alias("terms_md5"))


@register("tfidf", f"""WITH {COMMENTS_CTE},
c AS (SELECT comment_id, comment_text AS text FROM comments),
t AS (SELECT comment_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]+'),
                                     lambda w: regexp_full_match(w, '[a-z][a-z]+')) AS tk FROM c),
b AS (SELECT comment_id, unnest(list_concat(tk, list_transform(range(1, len(tk)),
                                                               lambda i: tk[i] || ' ' || tk[i + 1]))) AS term FROM t),
tc AS (SELECT comment_id, term, count(*) AS tf FROM b GROUP BY comment_id, term),
n AS (SELECT count(*) AS n_docs FROM c),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tc GROUP BY term),
v AS (SELECT * FROM st ORDER BY total DESC, term LIMIT 5000),
w AS (SELECT comment_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1 + df)) + 1) AS w
      FROM tc JOIN v USING (term) CROSS JOIN n),
nm AS (SELECT comment_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY comment_id)
SELECT comment_id, term, round(w / norm, 6) AS weight FROM w JOIN nm USING (comment_id)""")
def q_tfidf(spark, d):
    """TF-IDF weights (sublinear tf, smooth idf + 1, L2) over all comments."""
    return TO.tfidf(comments_from_tables(spark, d))


def _corpus_path(spark, d, with_trends=False):
    out = os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    trends = T.trend_velocity(posts(spark, d)) if with_trends else None
    return write_corpus_from_conversations(spark, d, out, trends=trends)


# the labelled rows of the corpus: conversation turns, and labelled documents (A10)
LABELLED_SQL = """SELECT text, 'Relatable' AS label FROM conversations WHERE role = 'user'
           UNION ALL SELECT text, 'Neutral' FROM conversations WHERE role IS DISTINCT FROM 'user'
           UNION ALL SELECT d.text, CASE WHEN l.toxic = 1 THEN 'Negative' ELSE 'Positive' END
                     FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1 OR l.quality = 1"""


def _labelled(spark, d):
    return labelled_corpus(scan_corpus(spark, _corpus_path(spark, d)), polarity_rows(spark, d))


@register("scan_corpus", """
SELECT 'struggle' AS label_source, 'user' AS category, text FROM conversations WHERE role = 'user'
UNION ALL SELECT 'neutral', NULL, text FROM conversations WHERE role IS DISTINCT FROM 'user'""")
def q_scan_corpus(spark, d):
    """A2: nested corpus JSON (derived from conversations) → labelled rows."""
    return scan_corpus(spark, _corpus_path(spark, d))


@register("labelled_corpus", """
SELECT label, count(*) AS n FROM (""" + LABELLED_SQL + """) GROUP BY label""")
def q_labelled_corpus(spark, d):
    """A10 + D15 inputs: labelled texts per label."""
    lc = _labelled(spark, d)
    return lc.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("label_distribution", """
WITH l AS (""" + LABELLED_SQL + """)
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY label""")
def q_label_distribution(spark, d):
    """Label counts and shares of the labelled corpus."""
    return TO.label_distribution(_labelled(spark, d))


@register("keyword_trends", with_(VELOCITY, """
SELECT content_category AS keyword, CAST(round(round(vel, 2)) AS BIGINT) AS velocity,
       content_category AS category, CASE WHEN round(vel, 2) > 0 THEN 'rising' ELSE 'declining' END AS direction
FROM v"""))
def q_keyword_trends(spark, d):
    """A3: rising / declining keyword records from a corpus file whose trend
    section Spark derived from the posts' trend velocities."""
    return keyword_trends(spark, _corpus_path(spark, d, with_trends=True))
