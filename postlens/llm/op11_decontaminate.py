"""Benchmark decontamination: a broadcast hash set of test windows, scanned over all texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  A window is
``WINDOW`` words of an item in a row; an item of fewer words (but not none) is one window.
A word of a document is hit if it lies in an occurrence of a window.

1.  The windows of the items are made once and written: (h, twin, gram, items).  ``h`` is a
    64-bit hash of the words, ``twin`` tells windows of equal hash apart.
2.  Scan.  The windows are broadcast, in blocks of at most ``BLOCK_BYTES`` by their measured
    size (a larger benchmark means one more scan per block, never a larger broadcast).  A
    document's words are exploded by place only; hash, look-up and the exact comparison of
    the words of a hash hit stay in one generated stage, so no window of a text is
    shuffled or kept unless it is a hit.
3.  Hits are gathered per document: a set of (place, length) and a set of items.

Only DataFrame functions are used.  A document is told by its id and a hash of its text, so
rows of equal id are separate documents, and repeated rows get equal results.  Null and
empty texts have no words.  Items of null id count for ``n_hit`` and ``contaminated``, but
are not listed.  An empty benchmark hits nothing.  Other columns of the inputs are not used
(``decontaminate`` keeps them; a column it adds replaces one of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import stage, table
from postlens.llm.registry import register

WINDOW = 10
BLOCK_BYTES = 16_000_000   #: of windows that are broadcast at a time
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a word with what stands before it, in a text whose A-Z are not lower-cased
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ROW = 32                  #: bytes of a window besides its text


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def _gram(w: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, at + 1, length), " ")


def _hash(w: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(w, at + i) for i in range(length)])


def benchmark_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Written rows (n, h, twin, gram, item): the windows of n words and the items they are in."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    w = w.where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(window)))
    at = w.select("item", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    grams = at.select("item", "n", _gram(F.col("w"), F.col("at"), F.col("n")).alias("gram")).distinct()
    parts = F.split("gram", " ")
    h = F.coalesce(*[F.when(F.col("n") == n, _hash(parts, F.lit(0), n)) for n in range(1, window + 1)])
    # windows of equal hash: told apart by the place among the (few) texts of that hash
    grams = stage(grams.withColumn("h", h), "windows")
    twins = grams.groupBy("h").agg(F.array_sort(F.collect_set("gram")).alias("all"))
    return stage(grams.join(twins, "h").select(
        "n", "h", F.array_position("all", F.col("gram")).alias("twin"), "gram", "item"), "windows")


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs(doc, text), windows as above -> (doc, mark, at, n, h, twin): every place of a window
    in a document; mark is the hash of its text."""
    grams = windows.select("n", "h", "twin", "gram").distinct()
    sizes = grams.groupBy("n").agg(F.sum(F.octet_length("gram") + _ROW).alias("bytes")).collect()   # a row per length
    lengths = sorted(r["n"] for r in sizes)
    blocks = max(1, -(-sum(r["bytes"] for r in sizes) // BLOCK_BYTES))
    w = docs.where("text is not null").select("doc", "text", words(F.col("text")).alias("w"))
    last = F.size("w") - (lengths[0] if lengths else 1)   # no filter on it: that would search the words twice
    places = w.select("doc", "text", "w", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    at = F.col("at")
    if len(lengths) > 1:   # short items: a place starts a window of each length
        one = lambda n: F.struct(F.lit(n).alias("n"), F.when(
            at + n <= F.size("w"), _hash(F.col("w"), at, n)).alias("h"))
        places = places.select("doc", "text", "w", "at", F.explode(F.array(*[one(n) for n in lengths])).alias("s"))
        places = places.select("doc", "text", "w", "at", F.col("s.n").alias("len"), F.col("s.h").alias("hash"))
    else:
        n = lengths[0] if lengths else 1
        places = places.select("doc", "text", "w", "at", F.lit(n).alias("len"), _hash(F.col("w"), at, n).alias("hash"))
    out = None
    for b in range(blocks):
        block = grams.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else grams
        # each a prefix of the other: equal, but no join key, so only the words of hash hits are joined
        text = _gram(F.col("w"), at, F.col("len"))
        found = places.join(F.broadcast(block), (F.col("hash") == F.col("h"))
                            & F.startswith(text, F.col("gram")) & F.startswith(F.col("gram"), text))
        found = found.select("doc", F.xxhash64("text").alias("mark"), "at", "n", "h", "twin")
        out = found if out is None else out.unionByName(found)
    return out


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, mark, hit array<int> sorted, items array<string> sorted) of the documents with a hit:
    the places of the words that are hit, and the items whose windows occur."""
    windows = benchmark_windows(items, id_col=item_col, text_col=item_text, window=window)
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = stage(occurrences(src, windows), "hits")
    spans = found.groupBy("doc", "mark").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    names = (found.select("doc", "mark", "h", "twin").distinct()
             .join(windows.where("item is not null").select("h", "twin", "item"), ["h", "twin"])
             .groupBy("doc", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
             .select(F.col("doc").alias("d"), F.col("mark").alias("m"), "items"))
    none = F.array().cast("array<string>")
    return (spans.select("doc", "mark", hit.alias("hit"))
            .join(names, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
            .select("doc", "mark", "hit", F.coalesce("items", none).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items (sorted), contaminated."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text, window=window)
    found = found.select(F.col("doc").alias("d"), F.col("mark").alias("m"), F.size("hit").cast("long").alias("k"),
                         F.col("items").alias("which"))
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"),
                      _size(words(text)).cast("long").alias("n_words"))
    rows = own.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    which = F.coalesce("which", F.array().cast("array<string>"))
    return rows.select(F.col("doc").alias(id_col), "n_words", F.coalesce("k", F.lit(0).cast("long")).alias("n_hit"),
                       F.size(which).cast("long").alias("n_items"), which.alias("items"),
                       F.col("k").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  spans: bool = True) -> DataFrame:
    """The rows of docs without what the benchmark holds: with ``spans`` the words that are hit
    go, each with what stands between it and the word before (a text without a hit stays as it
    is, and one that loses all words is kept with what is left); otherwise the documents with
    a hit go.  All columns stay."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text, window=window)
    found = found.select(F.struct("doc", "mark").alias("_key"), F.col("hit").alias("_hit"))
    keyed = docs.withColumn("_key", F.struct(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark")))
    same = keyed["_key"].eqNullSafe(found["_key"])
    if not spans:
        return keyed.join(found, same, "left_anti").select(*docs.columns)
    text = F.col(text_col)
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("_hit"))
    left = F.concat(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), ""), tail)
    return (keyed.join(found, same, "left").withColumn(text_col, F.when(F.col("_hit").isNull(), text).otherwise(left))
            .select(*docs.columns))


_SQL = rf"""
WITH words AS (
  SELECT *, row_number() OVER () AS row, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM items WHERE len(w) > 0))
), places AS (
  SELECT row, n, unnest(range(1, len(w) - n + 2)) AS i, w
  FROM words, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n
), found AS (
  SELECT row, i, n, gram FROM (SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places)
  WHERE gram IN (SELECT gram FROM grams)
), hit AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS place FROM found) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM found JOIN grams USING (gram, n) WHERE item_id IS NOT NULL)
  GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


@register("op11_decontaminate", _SQL)
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those that the benchmark holds, and the items."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
