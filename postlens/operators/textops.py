"""Text operators over comment tables.

Per-row scoring is built-in expressions; per-category and per-term results
are grouped aggregates (partial aggregation before the shuffle), so a hot
category or a very common term never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as TX
from postlens.operators.terms import tfidf  # noqa: F401  (J13)

# Fixed value: VADER's compound normalisation constant.
POLARITY_ALPHA = 15.0


def polarity(text, lexicon: Mapping[str, float] | None) -> "F.Column":
    """Lexicon compound score x / sqrt(x² + 15), rounded to 3; 0 without a
    lexicon (the reference's value when its polarity library is unavailable).

    The lexicon is a bounded parameter, applied as a map literal inside the
    row's expression: no explode, no join, no shuffle."""
    if not lexicon:
        return F.lit(0.0)
    lex = F.create_map(*[x for k, v in sorted(lexicon.items()) for x in (F.lit(k), F.lit(float(v)))])
    toks = F.regexp_extract_all(F.lower(TX._c(text)), F.lit(r"([\p{L}\p{N}_']+)"), 1)
    x = F.aggregate(toks, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.element_at(lex, t), F.lit(0.0)))
    return F.round(x / F.sqrt(x * x + POLARITY_ALPHA), 3)


def lexicon_scores(df: DataFrame, lexicon: DataFrame, *, id_col: str = "comment_id",
                   text: str = "comment_text") -> DataFrame:
    """J3 with a lexicon table (term, weight) of any size: (id, vader_compound).  A text's
    words are counted first, so the join sees each of them once; texts without a
    listed word score 0."""
    toks = F.regexp_extract_all(F.lower(TX._c(text)), F.lit(r"([\p{L}\p{N}_']+)"), 1)
    words = (df.select(id_col, F.explode(toks).alias("term")).groupBy(id_col, "term")
             .agg(F.count(F.lit(1)).alias("n")))
    x = (words.join(lexicon.select("term", F.col("weight").cast("double").alias("w")), "term")
         .groupBy(id_col).agg(F.sum(F.col("n") * F.col("w")).alias("x")))
    score = F.col("x") / F.sqrt(F.col("x") * F.col("x") + POLARITY_ALPHA)
    return df.select(id_col).join(x, id_col, "left").select(id_col, F.coalesce(F.round(score, 3), F.lit(0.0)).alias("vader_compound"))


def tag_comments(df: DataFrame, *, text: str = "comment_text",
                 lexicon: Mapping[str, float] | None = None,
                 struggle=TX.STRUGGLE_WORDS, phrases=TX.RELATABLE_PHRASES,
                 empathy=TX.EMPATHY_MARKERS) -> DataFrame:
    """J1 + J2 + J3: relatability (rounded to 1), polarity and marker flags.
    The classifier label is added by ``learn.classify_comments`` (J4)."""
    low = df.withColumn("__lt", F.lower(F.col(text)))       # lower-case each text once
    hits = ["__h0", "__h1", "__h2"]                          # search each text for each phrase once
    low = low.withColumns({h: TX.hit_count("__lt", w, lowered=True) for h, w in zip(hits, (struggle, phrases, empathy))})
    return low.withColumns({
        "vader_compound": polarity(text, lexicon),
        "relatability_score": F.round(TX.relatability_score("__lt", lowered=True, hits=hits), 1),
        **TX.marker_flags("__lt", hits=hits),
    }).drop("__lt", *hits)


def problem_awareness(df: DataFrame, *, category: str = "content_category",
                      text: str = "comment_text", systemic=TX.AWARENESS_SYSTEMIC,
                      shared=TX.AWARENESS_SHARED, personal=TX.AWARENESS_PERSONAL) -> DataFrame:
    """Per category, how many list entries occur in any of its comments →
    Systemic (≥2) / Shared (≥2) / Personal (≥3) / None, first match wins.

    One ``max`` per keyword per group (partial aggregation), instead of
    concatenating a category's texts; a phrase cannot span two comments."""
    lists = {"sys": systemic, "sha": shared, "per": personal}
    t = F.concat(F.lower(F.col(text)), F.lit(" "))
    flags = {f"{tag}{i}": F.contains(F.col("__lt"), F.lit(w)).cast("int")
             for tag, words in lists.items() for i, w in enumerate(words)}
    per_row = (df.where(F.col(category).isNotNull()).select(category, t.alias("__lt"))
               .select(category, *[v.alias(k) for k, v in flags.items()]))
    g = per_row.groupBy(category).agg(*[F.max(k).alias(k) for k in flags])
    count = {tag: sum((F.col(f"{tag}{i}") for i in range(len(w))), F.lit(0))
             for tag, w in lists.items()}
    (l1, k1), (l2, k2), (l3, k3) = TX.AWARENESS_LEVELS
    level = (F.when(count["sys"] >= k1, l1).when(count["sha"] >= k2, l2)
             .when(count["per"] >= k3, l3).otherwise("None"))
    return g.select(category, level.alias("problem_awareness"))


def label_distribution(df: DataFrame, *, label: str = "label") -> DataFrame:
    """Count and share of each label."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # ≤ #labels rows


def category_sentiment(tagged: DataFrame, *, category: str = "content_category",
                       text: str = "comment_text", label: str = "label") -> DataFrame:
    """Per category averages, % Relatable, % Negative, n, awareness level."""
    g = (tagged.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.avg("relatability_score").alias("avg_relatability"),
        F.avg("vader_compound").alias("avg_vader"),
        F.avg("confidence").alias("avg_confidence"),
        (F.avg((F.col(label) == "Relatable").cast("double")) * 100).alias("pct_relatable"),
        (F.avg((F.col(label) == "Negative").cast("double")) * 100).alias("pct_negative"),
        F.count(text).alias("n_comments")))
    return g.join(problem_awareness(tagged, category=category, text=text), category, "left")


def top_comments(tagged: DataFrame, *, k: int = 10, label: str = "label",
                 id_col: str = "comment_id") -> DataFrame:
    """The ``k`` most relatable comments labelled Relatable (ties by id)."""
    return (tagged.where(F.col(label) == "Relatable")
            .orderBy(F.col("relatability_score").desc(), F.col(id_col)).limit(k)
            .select(id_col, "comment_text", "content_category", "relatability_score",
                    "vader_compound", "confidence"))


def page_links(pages: DataFrame, *, html: str = "html", page_id: str = "page_id",
               post_links_only: bool = True) -> DataFrame:
    """J14 + J10 + F6: distinct links in stored pages, first seen (page, position),
    with their post kind.  By default only post / reel links are kept."""
    hrefs = pages.select(page_id, F.posexplode(
        F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]+)"'), 1)).alias("pos", "link"))
    if post_links_only:
        hrefs = hrefs.where(TX.is_post_link("link"))
    first = (hrefs.groupBy("link")          # map-side combine: a hot link is one row per task
             .agg(F.min(F.struct(page_id, "pos")).alias("f"))
             .select(F.col(f"f.{page_id}").alias(page_id), F.col("f.pos").alias("pos"), "link"))
    return first.withColumn("media_type", TX.post_kind("link"))


def page_posts(pages: DataFrame, *, url: str = "url", html: str = "html", keep=()) -> DataFrame:
    """J14 + J6-J10: one scraped-post row per stored page — link, kind, caption
    (page title) and the caption-derived fields, and the columns ``keep`` (as those of
    ``page_fields``)."""
    cap = F.regexp_extract(F.col(html), r"<title>(.*?)</title>", 1)
    return pages.select(
        F.col(url).alias("link"), TX.post_kind(url).alias("media_type"), cap.alias("caption"),
        F.length(cap).alias("caption_length"), TX.count_hashtags(cap).alias("hashtags_count"),
        TX.count_mentions(cap).alias("at_mentions"), TX.detect_cta(cap).alias("has_cta"), *keep)


# where a stored page states its numbers, time and account; the first group is the value
PAGE_PATTERNS = {
    "likes": r"([\d.,]+\s?[KkMm]?)\s+likes?\b",
    "comments_count": r"([\d.,]+\s?[KkMm]?)\s+comments?\b",
    "views": r"([\d.,]+\s?[KkMm]?)\s+(?:views?|plays?)\b",
    "post_datetime": r'<time[^>]*\bdatetime="([^"]+)"',
    "username": r'\brel="author"[^>]*>\s*@?([\w.]+)',
}
COUNT_FIELDS = ("likes", "comments_count", "views")


def page_fields(pages: DataFrame, *, html: str = "html", patterns: Mapping[str, str] | None = None) -> DataFrame:
    """J14 + J9: the counts, time text and account that stored pages state, as further
    columns; null where a page does not state one."""
    patterns = patterns or PAGE_PATTERNS
    counts = [name for name in patterns if name in COUNT_FIELDS]
    # a projection per step: an expression over a column that is used often would be copied,
    # with its searches, into every use
    df = pages.withColumns({f"__raw_{n}": F.regexp_extract(F.coalesce(F.col(html), F.lit("")), p, 1) for n, p in patterns.items()})
    df = df.withColumns({f"__text_{n}": TX.count_text(f"__raw_{n}") for n in counts})
    df = df.withColumns({f"__{part}_{n}": F.regexp_extract(f"__text_{n}", TX.COUNT_PATTERN, group)
                         for n in counts for part, group in (("num", 1), ("suf", 2))})
    stated = {n: F.when(F.col(f"__raw_{n}") != "", TX.count_value(f"__raw_{n}", f"__num_{n}", f"__suf_{n}") if n in counts
                        else F.col(f"__raw_{n}")) for n in patterns}
    return df.withColumns(stated).select(*pages.columns, *[n for n in patterns if n not in pages.columns])
