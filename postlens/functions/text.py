"""Text expressions: lexicon hits, relatability, CTA, tags, topic, counts.

All matching is substring matching on the lower-cased text (as the reference
does), with built-in ``contains`` / ``regexp`` functions — no Python per row.
Every word list is a parameter; the defaults below are the reference's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Relatability lexicons (struggle words, relatable phrases, empathy markers).
STRUGGLE_WORDS = (
    "struggle", "fail", "failed", "anxiety", "anxious", "overwhelm",
    "overwhelmed", "alone", "lonely", "lost", "fear", "scared", "doubt",
    "imposter", "quit", "gave up", "exhausted", "burned out",
    "comparison", "behind", "not enough", "worthless", "hopeless",
    "cry", "cried", "pressure", "toxic", "trauma", "hate myself",
    "cannot", "couldn't", "was impossible",
)
RELATABLE_PHRASES = (
    "anyone else", "who else", "same", "me too", "not just me",
    "relatable", "felt seen", "felt understood", "exactly this",
    "waiting for this", "needed this", "why did nobody",
    "nobody talks about", "finally", "saved this", "sharing this",
    "sending this", "preach", "been waiting", "this is me", "literally me",
    "i thought i was", "i felt", "i've been",
)
EMPATHY_MARKERS = (
    "thank you", "saved my", "changed my", "gave me courage", "gave me hope",
    "made me feel", "made me cry", "needed to hear", "healing", "feel seen",
    "feel normal", "not alone", "validation", "helps so much",
)
QUESTION_PATTERN = r"\?|why does|why is|can we talk about|has anyone"
# Relatability weights and caps: (per hit, cap) for the three lists; question bonus.
RELATABILITY_PARTS = ((15, 40), (20, 35), (15, 25))
QUESTION_BONUS = 5
# Problem-awareness keyword lists and thresholds (first match wins).
AWARENESS_SYSTEMIC = ("society", "system", "nobody talks", "industry", "culture",
                      "always been", "norm", "we all", "everyone feels")
AWARENESS_SHARED = ("who else", "anyone else", "not just me", "me too", "same",
                    "same here", "all of us", "so many people")
AWARENESS_PERSONAL = ("i ", "my ", "me ", "i've ", "i was", "i felt", "i cried")
AWARENESS_LEVELS = (("Systemic", 2), ("Shared", 2), ("Personal", 3))
# Call-to-action phrases of captions.
CTA_PHRASES = (
    "link in bio", "click the link", "order now", "buy now", "shop now",
    "follow", "subscribe", "comment below", "tag a friend", "share this",
    "save this", "dm me", "check out", "visit our", "book now",
    "sign up", "register", "learn more", "swipe up", "tap link",
)
# Caption keyword → content category, in priority order; default category.
CATEGORY_KEYWORDS = (
    ("fitness", "Fitness"), ("workout", "Fitness"), ("gym", "Fitness"), ("health", "Fitness"),
    ("beauty", "Beauty"), ("skincare", "Beauty"), ("makeup", "Beauty"),
    ("travel", "Travel"),
    ("food", "Food"), ("recipe", "Food"), ("cooking", "Food"),
    ("tech", "Technology"), ("coding", "Technology"), ("programming", "Technology"),
    ("software", "Technology"),
    ("music", "Music"), ("photo", "Photography"),
    ("comedy", "Comedy"), ("funny", "Comedy"), ("meme", "Comedy"),
)
DEFAULT_CATEGORY = "Technology"
# Tag patterns: '#' or '@' followed by word characters (Unicode letters, digits, _).
HASHTAG_PATTERN = r"#[\p{L}\p{N}_]+"
MENTION_PATTERN = r"@[\p{L}\p{N}_]+"
# Classifier tokens: two or more ASCII letters between word boundaries.
TOKEN_PATTERN = r"\b[a-zA-Z][a-zA-Z]+\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _arr(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def hit_count(text, words: Sequence[str], *, lowered: bool = False) -> Column:
    """Number of list entries occurring as substrings of lower(text).

    Unrolled into one ``contains`` per entry (codegen'd), instead of a lambda
    over an array literal (interpreted, re-evaluating the text per entry)."""
    t = _c(text) if lowered else F.lower(_c(text))
    out = F.lit(0)
    for w in words:
        out = out + F.contains(t, F.lit(w)).cast("int")
    return out


def any_hit(text, words: Sequence[str], *, lowered: bool = False) -> Column:
    t = _c(text) if lowered else F.lower(_c(text))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return F.coalesce(out, F.lit(False)) if words else out


def relatability_score(text, *, struggle: Sequence[str] = STRUGGLE_WORDS,
                       phrases: Sequence[str] = RELATABLE_PHRASES,
                       empathy: Sequence[str] = EMPATHY_MARKERS, lowered: bool = False,
                       hits: Sequence[str] | None = None) -> Column:
    """Capped weighted hit counts + question bonus, at most 100.  ``hits``: columns
    that hold the three counts already."""
    t = _c(text) if lowered else F.lower(_c(text))
    counts = [F.col(h) for h in hits] if hits else [hit_count(t, w, lowered=True) for w in (struggle, phrases, empathy)]
    parts = [F.least(n * w, F.lit(cap)) for n, (w, cap) in zip(counts, RELATABILITY_PARTS)]
    q = F.when(t.rlike(QUESTION_PATTERN), F.lit(QUESTION_BONUS)).otherwise(F.lit(0))
    return F.least((parts[0] + parts[1] + parts[2] + q).cast("double"), F.lit(100.0))


def marker_flags(text, *, struggle=STRUGGLE_WORDS, phrases=RELATABLE_PHRASES,
                 empathy=EMPATHY_MARKERS, lowered: bool = False,
                 hits: Sequence[str] | None = None) -> dict[str, Column]:
    """0/1 flags for any struggle word / relatable phrase / empathy marker."""
    names = ("has_struggle_word", "has_relatable_phrase", "has_empathy_marker")
    if hits:
        return {n: F.coalesce(F.col(h) > 0, F.lit(False)).cast("int") for n, h in zip(names, hits)}
    return {n: any_hit(text, w, lowered=lowered).cast("int") for n, w in zip(names, (struggle, phrases, empathy))}


def detect_cta(caption, phrases: Sequence[str] = CTA_PHRASES) -> Column:
    """1 if any CTA phrase occurs (case-blind)."""
    return any_hit(F.coalesce(_c(caption), F.lit("")), phrases).cast("int")


def count_hashtags(caption) -> Column:
    """Number of ``#word`` tags."""
    return F.regexp_count(F.coalesce(_c(caption), F.lit("")), F.lit(HASHTAG_PATTERN))


def count_mentions(caption) -> Column:
    """Number of ``@word`` mentions."""
    return F.regexp_count(F.coalesce(_c(caption), F.lit("")), F.lit(MENTION_PATTERN))


def classify_topic(caption, hashtag, keywords=CATEGORY_KEYWORDS,
                   default: str = DEFAULT_CATEGORY) -> Column:
    """Category of the first keyword (in list order) found in caption + tag."""
    t = F.lower(F.concat_ws(" ", F.coalesce(_c(caption), F.lit("")),
                            F.coalesce(_c(hashtag), F.lit(""))))
    chain = None
    for kw, cat in keywords:
        cond = F.contains(t, F.lit(kw))
        chain = F.when(cond, F.lit(cat)) if chain is None else chain.when(cond, F.lit(cat))
    return chain.otherwise(F.lit(default))


COUNT_PATTERN = r"([\d.]+)\s*([KkMm]?)"


def parse_count(text) -> Column:
    """``1.2K`` → 1200, ``3.5M`` → 3500000, ``1,234 likes`` → 1234; blank,
    ``N/A``, ``--`` or unparseable → 0.  Truncates like Python ``int``."""
    raw = _c(text)
    t = count_text(raw)
    return count_value(raw, F.regexp_extract(t, COUNT_PATTERN, 1), F.regexp_extract(t, COUNT_PATTERN, 2))


def count_text(raw) -> Column:
    return F.trim(F.regexp_replace(_c(raw), ",", ""))


def count_value(raw, num, suffix) -> Column:
    """The count of a text, from its number and its suffix as text."""
    raw, num, suf = _c(raw), _c(num), F.upper(_c(suffix))
    v = num.try_cast("double")
    v = F.when(suf == "K", v * 1000).when(suf == "M", v * 1000000).otherwise(v)
    bad = raw.isNull() | raw.isin("N/A", "--", "") | (num == "")
    return F.when(bad, F.lit(0)).otherwise(F.coalesce(F.floor(v), F.lit(0))).cast("bigint")


def post_kind(link) -> Column:
    """``reel`` when the link has ``/reel/``, else ``image``."""
    return F.when(F.contains(_c(link), F.lit("/reel/")), F.lit("reel")).otherwise(F.lit("image"))


def is_post_link(link) -> Column:
    """Keep links to posts or reels."""
    return F.contains(_c(link), F.lit("/p/")) | F.contains(_c(link), F.lit("/reel/"))


def split_tags(text) -> Column:
    """Comma list → trimmed entries without leading '#', empties dropped."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), lambda s: F.trim(s))
    kept = F.filter(parts, lambda s: s != "")
    return F.transform(kept, lambda s: F.regexp_replace(s, r"^#+", ""))


def word_tokens(text) -> Column:
    """Lower-cased, accents stripped, tokens of ≥ 2 ASCII letters."""
    plain = strip_accents(F.lower(_c(text)))
    return F.regexp_extract_all(plain, F.lit(r"(?U)\b([a-z][a-z]+)\b"), 1)


def word_bigrams(text) -> Column:
    """Unigrams followed by space-joined bigrams.

    ``zip_with`` over two slices evaluates the token array a fixed number of
    times per row (a lambda that indexes into it would re-extract it per
    element)."""
    return bigrams_of(word_tokens(text))


def bigrams_of(toks: Column) -> Column:
    m = F.greatest(F.size(toks) - 1, F.lit(0))
    big = F.zip_with(F.slice(toks, 1, m), F.slice(toks, 2, m), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(toks, big)


def term_bag(words) -> Column:
    """The terms of ``bigrams_of`` in another order, from the tokens joined by spaces (a column): unigrams, the
    bigrams from each first, third, … token and those from each second.  Found by generated code, one
    search of the text each (a lambda makes every pair anew, at several microseconds)."""
    w = _c(words)
    rest = F.substring(w, F.instr(w, " ") + 1, F.length(w))         # without the first token
    every, pair = F.lit("[a-z]++"), F.lit("(?<![a-z])[a-z]++ [a-z]++")
    return F.concat(F.regexp_extract_all(w, every, F.lit(0)), F.regexp_extract_all(w, pair, F.lit(0)),
                    F.regexp_extract_all(rest, pair, F.lit(0)))


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters U+00E0-U+017F whose canonical decomposition
    starts with an ASCII letter, mapped to that letter (the rule behind
    Unicode accent stripping)."""
    import unicodedata
    src, dst = [], []
    for cp in range(0xE0, 0x180):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch != base and base.isascii() and base.isalpha() and ch.islower():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text) -> Column:
    return F.translate(_c(text), _ACCENTED, _PLAIN)
