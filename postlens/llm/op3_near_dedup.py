"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

A document's set is its distinct runs of ``k`` words (A-Z folded); with fewer words, the
whole sequence; without words it is empty and linked with nothing.  Two documents are
linked if 100 * shared >= 75 * all.

1.  Every set gets a fingerprint and a SuperMinHash signature; ``BANDS`` keys of ``ROWS``
    slots each are made from it.  Sets that are equal fall together by fingerprint and go
    on as one (their least id), so groups of exact copies never meet in a bucket.
2.  The keys are sorted in a shuffle, and a streaming pass keeps the buckets that hold two
    or more sets.  Sets that are joined by buckets form a candidate group.
3.  Candidate groups of up to ``LOCAL`` elements in all are dealt over tasks whole.  A task verifies the
    pairs of each bucket on the full sets and groups them by union-find, leaving out pairs
    that are in one component already.
4.  Larger candidate groups are never brought together.  Buckets of up to ``SMALL`` sets
    give their pairs, larger ones compare every set with the least one, and the pairs are
    verified in a join.  A large bucket that still spans several components takes
    ``CENTRES`` more of its sets as centres per round, until no untested pair of it lies in
    two components.

So no candidate link that could join components is left out, and no group is expanded into
all its pairs.  A pair just at the threshold shares a bucket with a probability of about
0.9999 (a test draws it; fewer keys lose links for good).  The sets that are compared hold 40 bits per element.

Null ids take no part: component null, kept.  Rows of equal id are one document with
several texts, each returning a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from postlens.llm.common import Words, chunks, map_arrow, mix, release, stage, table
from postlens.llm.components import components
from postlens.llm.registry import register
from postlens.llm.superminhash import SLOTS, signatures
from postlens.session import clear_stages, stage_mark

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 128, 8
LOCAL = 6_000_000      #: elements of a candidate group that one task takes whole
TASK = 3_000_000       #: elements of the groups that one task takes, about
SMALL = 24             #: in larger groups, a bucket of so many sets gives all its pairs
CENTRES = 16           #: further centres that a larger bucket takes per round
_CHUNK = 600_000

U = np.uint64
#: the slots of each band: each slot is in BANDS * ROWS / SLOTS bands
_BAND = np.concatenate([np.random.default_rng(s).permutation(SLOTS).reshape(-1, ROWS)
                        for s in range(BANDS * ROWS // SLOTS)])


def shingle_sets(texts: list, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, fold=True)
    h = w.window_hash(k)
    out = []
    for f, n in zip(w.first.tolist(), w.count.tolist()):
        if n >= k:
            x = np.sort(h[f:f + n - k + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n:
            x = np.array([n], np.uint64)
            for v in w.hash[f:f + n]:
                x = mix(x * U(0x9FB21C651E98DF25) + v)
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * U(0x632BE59BD9B4E019), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * U(0x9FB21C651E98DF25) + sig[:, _BAND[:, r]])
    return key.view(np.int64)


def signature_rows(docs: DataFrame, *, k: int = SHINGLE) -> DataFrame:
    """docs(id, text) -> id, n_shingles, fp_a, fp_b (null for empty sets), bands."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        n, fa, fb, keys = [], [], [], []
        for lo, hi in chunks(texts, _CHUNK):
            sets = shingle_sets(texts[lo:hi], k)
            size = np.array([len(s) for s in sets])
            n.append(size)
            every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sets)), size)
            a, c = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            np.add.at(a, doc, mix(every ^ U(0x2545F4914F6CDD1D)))
            np.add.at(c, doc, mix(every + U(0x9E6C63D0876A9A47)))
            fa.append(a)
            fb.append(c)
            keys.append(_band_keys(signatures(doc, every, len(sets))))
        n, fa, fb = np.concatenate(n), np.concatenate(fa), np.concatenate(fb)
        keys = np.concatenate(keys)
        has = n > 0
        bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n.astype(np.int64)), pa.array(fa.view(np.int64), mask=~has),
             pa.array(fb.view(np.int64), mask=~has), bands], ["id", "n_shingles", "fp_a", "fp_b", "bands"])
    return map_arrow(docs, fn, "id long, n_shingles long, fp_a long, fp_b long, bands array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows -> (key, id, centre) of keys with two ids or more; a bucket of
    any size streams through."""
    key = centre = None
    told = False                       # whether the open bucket's first row has been given
    for b in batches:
        k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        if key is not None:
            k, d = np.concatenate([[key], k]), np.concatenate([[centre], d])
        fresh = np.concatenate([[True], k[1:] != k[:-1]])
        run = np.cumsum(fresh) - 1
        size = np.bincount(run)
        first = d[fresh]
        out = size[run] > 1
        if key is not None and told:
            out[0] = False
            out[1:][run[1:] == 0] = True
        last = run == run[-1]
        told = bool(size[-1] > 1 or (told and run[-1] == 0))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(d[out]), pa.array(first[run[out]])],
                                             ["key", "id", "centre"])
        key, centre = k[-1], d[last][0]


def _pack40(x: np.ndarray) -> bytes:
    return (x >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def set_rows(docs: DataFrame, *, k: int = SHINGLE) -> DataFrame:
    """docs(id, text) -> (id, elements binary), the whole sorted set of each."""
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = b.column(1).to_pylist(), []
        for lo, hi in chunks(texts, 2 * _CHUNK):
            out += [_pack40(s) for s in shingle_sets(texts[lo:hi], k)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "elements"])
    return map_arrow(docs, fn, "id long, elements binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _group(ids: list[int], sets: list[np.ndarray], keys: list[np.ndarray], percent: int) -> list[int]:
    """The root of each set of one candidate group: its buckets' pairs verified as far as
    they could join components."""
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    tested: set[tuple[int, int]] = set()

    def link(i, j):
        a, b = find(i), find(j)
        if a == b or (i, j) in tested:
            return
        tested.add((i, j))
        if _linked(sets[i], sets[j], percent):
            up[max(a, b)] = min(a, b)
    for i in range(1, len(ids)):               # several texts of one id
        if ids[i] == ids[i - 1]:
            up[i] = find(i - 1)
    key = np.concatenate(keys)
    of = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
    order = np.lexsort((of, key))
    cut = np.flatnonzero(np.diff(key[order])) + 1
    buckets = [m for m in np.split(of[order], cut) if len(m) > 1]
    buckets = [list(m) for m in {tuple(m.tolist()) for m in buckets}]
    for m in buckets:                          # against the least one first
        for j in m[1:]:
            link(m[0], j)
    for m in buckets:                          # then what still spans components
        parts: dict[int, list[int]] = {}
        for i in m:
            parts.setdefault(find(i), []).append(i)
        if len(parts) > 1:
            for n, i in enumerate(m):
                for j in m[n + 1:]:
                    link(i, j)
    return [ids[find(i)] for i in range(len(ids))]


def group_locally(rows: DataFrame, n_groups: int, percent: int) -> DataFrame:
    """rows(id, root, elements, keys) of whole candidate groups -> (node, root)."""
    def fn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("root", "ascending"), ("id", "ascending")])
        root, ids = t["root"].to_numpy(), t["id"].to_numpy()
        sets, keys = t["elements"], t["keys"]
        out: list[int] = []
        cut = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
        for lo, hi in pairwise(cut):
            out += _group(ids[lo:hi].tolist(), [_unpack40(sets[i].as_py()) for i in range(lo, hi)],
                          [np.asarray(keys[i].values, np.int64) for i in range(lo, hi)], percent)
        return pa.table({"node": pa.array(ids), "root": pa.array(out, pa.int64())})
    dealt = rows.select(F.pmod(F.xxhash64("root"), F.lit(n_groups)).alias("g"), "root", "id", "elements", "keys")
    return dealt.groupBy("g").applyInArrow(fn, "node long, root long")


def verify(pairs: DataFrame, sets: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """pairs(a, b) that are links by their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("set_b"))

    def fn(t: pa.RecordBatch) -> pa.RecordBatch:
        ok = [_linked(_unpack40(x.as_py()), _unpack40(y.as_py()), percent) for x, y in zip(t.column(2), t.column(3))]
        return t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
    return map_arrow(rows, fn, "a long, b long").distinct()


def group_widely(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """buckets(key, id, centre) of large candidate groups -> (node, root)."""
    spark = buckets.sparkSession
    size = buckets.groupBy("key").agg(F.count("*").alias("n"))
    small = stage(buckets.join(size.where(F.col("n") <= SMALL), "key").select("key", "id"), "small")
    large = stage(buckets.join(size.where(F.col("n") > SMALL), "key").select("key", "id", "centre"), "large")
    pairs = (small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key")
             .where("a < b").select("a", "b")
             .unionByName(large.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))).distinct())
    links = tested = used = None
    turn = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    while True:
        pairs = stage(pairs, "pairs")
        new = stage(verify(pairs, sets, percent=percent), "verified")
        links = new if links is None else links.unionByName(new)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = components(links)
        release(spark)
        rows = (large.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
                .select("key", "id", F.coalesce("root", "id").alias("root")))
        spans = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        rows = stage(rows.join(spans.select("key", "low"), "key"), "open")
        centres = rows.where("root <> low")
        if used is not None:
            centres = centres.join(used, ["key", "id"], "left_anti")
        centres = stage(centres.withColumn("turn", turn).where(F.col("turn") <= CENTRES).select("key", "id", "root"), "centres")
        if centres.isEmpty():
            return roots
        used = centres.select("key", "id") if used is None else used.unionByName(centres.select("key", "id"))
        mine = centres.select("key", F.col("id").alias("x"), F.col("root").alias("root_x"))
        pairs = (rows.join(mine, "key").where("root <> root_x and id <> x")
                 .select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
                 .join(tested, ["a", "b"], "left_anti"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept."""
    spark, mark = docs.sparkSession, stage_mark()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = stage(signature_rows(src, k=k), "signatures")
    linked = sig.where("n_shingles > 0 and id is not null")
    same = ["fp_a", "fp_b", "n_shingles"]
    leads = stage(linked.groupBy(same).agg(F.min("id").alias("lead")), "leads")
    copies = linked.select("id", *same).join(leads, same).select("id", "lead")
    first = linked.join(leads.withColumnRenamed("lead", "id"), [*same, "id"], "left_semi")
    keys = first.select(F.explode("bands").alias("key"), "id")
    n_keys = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = stage(keys.repartition(n_keys, "key").sortWithinPartitions("key", "id")
                    .mapInArrow(_shared, "key long, id long, centre long"), "buckets")
    release(spark)
    joined = components(buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")))
    every = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    every = every.select(F.col("node").alias("id"), "root").join(
        leads.groupBy(F.col("lead").alias("id")).agg(F.sum("n_shingles").alias("size")), "id")
    total = every.groupBy("root").agg(F.sum("size").alias("n"))
    groups = stage(every.join(total, "root").select("id", "root", "size", "n"), "groups")
    # the ids grow with the table, so they are never broadcast
    sets = stage(set_rows(src.join(groups.select("id").hint("merge"), "id", "left_semi"), k=k), "sets")
    release(spark)
    local = groups.where(F.col("n") <= LOCAL).select("id", "root")
    wide = groups.where(F.col("n") > LOCAL).select("id")
    keys = buckets.join(local, "id").groupBy("id", "root").agg(F.collect_set("key").alias("keys"))   # BANDS keys at most
    elements = groups.where(F.col("n") <= LOCAL).agg(F.sum("size")).first()[0] or 0
    roots = group_locally(sets.join(keys, "id"), max(1, -(-elements // TASK)), percent)
    if not wide.isEmpty():
        roots = roots.unionByName(group_widely(buckets.join(wide, "id", "left_semi").distinct(), sets, percent))
    roots = stage(roots, "roots")
    release(spark)
    # an id with several texts links the components of its sets
    lead_of = copies.groupBy("id").agg(F.min("lead").alias("a"), F.max("lead").alias("z")).where("a < z").select("id", "a")
    several = stage(copies.join(lead_of, "id").where("lead <> a").select("a", F.col("lead").alias("b")).distinct(), "several")
    if not several.isEmpty():
        roots = components(several.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    lead_root = roots.select(F.col("node").alias("lead"), "root")
    of = copies.join(lead_root, "lead", "left").select("id", F.coalesce("root", "lead").alias("root"))
    of = of.groupBy("id").agg(F.min("root").alias("root"))
    out = sig.select("id", "n_shingles").join(of, "id", "left")
    root = F.coalesce("root", "id")
    out = stage(out.select(F.col("id").alias(id_col), "n_shingles", root.alias("component_id"),
                           F.coalesce(F.col("id") == root, F.lit(True)).alias("kept")), "classes")
    clear_stages(spark, mark, but_last=1)          # signatures, sets and links have done their work
    return out


@register("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its shingle set, its component, and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))
