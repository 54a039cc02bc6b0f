"""Machine learning on tables (K2-K9): engagement regressor, comment classifier.

Fitting runs on Spark ML (distributed tree induction / L-BFGS); splits and
folds are hash expressions of the row id, so they do not depend on the
partitioning and never need a global row order.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (ElementwiseProduct, Imputer, IndexToString,
                                Normalizer, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler,
                                StandardScalerModel, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as TX
from postlens.operators import forest as FR
from postlens.operators import terms as TM
from postlens.operators.enrich import MODEL_DROP

LABEL = "engagement_rate"
# K2: the forest's depth, the same for every fit (first fit, retrain, model store)
MAX_DEPTH = 12
FIRST_FIT_TREES = 150
# a training frame of more rows is fitted level by level over blocks of rows, in tasks of about
# ROWS_PER_TASK rows (30 MB a million), into models of TREES_PER_GROUP trees each
ONE_FOREST_ROWS = 50_000
ROWS_PER_TASK = 4_000_000
TREES_PER_GROUP = 10
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def fit_partitions(n: int) -> int:
    """Partitions of a training frame of ``n`` rows: tasks and rows per task both grow
    with the square root of the data (8 tasks at 60,000 rows, 10,000 at 10^11)."""
    return max(1, math.ceil(math.sqrt(n) / 31))


# ---------------------------------------------------------------- K3 / K4 / K7
def id_hash(id_col: str, seed: int = 42) -> "F.Column":
    """First 32 bits of md5(id || seed) as a non-negative integer: a stable,
    partitioning-independent draw (``randomSplit`` depends on partitioning)."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    return h.cast("bigint")


def split_flag(id_col: str = "post_id", *, train_pct: int = 80, seed: int = 42) -> "F.Column":
    """K3: deterministic train flag (80 % by default)."""
    return F.pmod(id_hash(id_col, seed), F.lit(100)) < train_pct


def with_folds(df: DataFrame, *, label: str, id_col: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """K8: stratified folds, column ``fold``: the rows of each label are ranked by a hash of
    the id and dealt in turn, so every fold holds its share of every label.  The ranking
    is keyed and range-partitioned (no task holds a label); rows of equal id share a fold,
    null ids count as empty ones."""
    from postlens.operators.orderstats import ranks_from_counts
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = df.withColumn("__h", h)
    counts = rows.groupBy(F.coalesce(label, F.lit("")).alias("__l"), F.col("__h").alias("v")).agg(F.count("*").alias("cnt"))
    fold = ranks_from_counts(counts, keys=["__l"]).select("__l", F.col("v").alias("__h"),
                                                          F.pmod("less", F.lit(folds)).alias("fold"))
    return (rows.withColumn("__l", F.coalesce(label, F.lit(""))).join(fold, ["__l", "__h"])
            .drop("__l", "__h"))


def regression_metrics(pred: DataFrame, *, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """K4: MAE (5 dp), R² (4 dp) and n_test in one aggregate.  A constant label
    has R² 1 if it is met exactly, else 0 (as r2_score)."""
    e = F.col(label) - F.col(prediction)
    g = pred.agg(F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
                 F.var_pop(label).alias("vp"), F.count(F.lit(1)).alias("n_test"))
    return g.select(F.round("mae", 5).alias("mae"),
                    F.round(F.when(F.col("vp") > 0, 1 - F.try_divide(F.col("sse"), F.col("vp") * F.col("n_test")))
                            .when(F.col("vp") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)), 4).alias("r2"),
                    "n_test")


def class_weights(df: DataFrame, *, label: str = "label") -> DataFrame:
    """K7: balanced weight n / (k · n_class) per class (≤ #classes rows)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = df.agg(F.count(F.lit(1)).alias("n"))
    k = c.agg(F.count(F.lit(1)).alias("k"))
    return c.withColumns({"n": tot.scalar(), "k": k.scalar()}).select(
        label, "n_class", (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))


# ---------------------------------------------------------------- K2 / K5 / K9
def feature_columns(df: DataFrame, label: str = LABEL, drop: Sequence[str] = MODEL_DROP):
    """Numeric (all numeric types) and categorical (string / boolean) features."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == label or f.name in drop or f.name.startswith("__"):
            continue
        if isinstance(f.dataType, _NUMERIC):
            num.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cat.append(f.name)
    return num, cat


def engagement_pipeline(num: Sequence[str], cat: Sequence[str], *, label: str = LABEL,
                        num_trees: int = FIRST_FIT_TREES, max_depth: int = MAX_DEPTH, seed: int = 42) -> Pipeline:
    """K2: impute + z-score numeric, one-hot categorical (unknown → zeros),
    random forest with all features considered at each split."""
    stages = []
    imp = [f"{c}__imp" for c in num]
    if num:
        stages.append(Imputer(inputCols=list(num), outputCols=imp, strategy="median"))
        stages.append(VectorAssembler(inputCols=imp, outputCol="__num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__num", outputCol="__num_z", withMean=True, withStd=True))
    idx = [f"{c}__idx" for c in cat]
    oh = [f"{c}__oh" for c in cat]
    if cat:
        stages.append(StringIndexer(inputCols=list(cat), outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, handleInvalid="keep", dropLast=True))
    stages.append(VectorAssembler(inputCols=(["__num_z"] if num else []) + oh, outputCol="features"))
    # maxMemoryInMB sizes the node groups split per pass over the data; cached
    # node ids avoid re-walking every tree for every row at each level.
    stages.append(RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                                        maxDepth=max_depth, seed=seed, featureSubsetStrategy="all",
                                        maxMemoryInMB=256, cacheNodeIds=True, checkpointInterval=10))
    return Pipeline(stages=stages)


def _prep(df: DataFrame, cat: Sequence[str]) -> DataFrame:
    casts = {c: F.col(c).cast("string") for c in cat
             if not isinstance(df.schema[c].dataType, T.StringType)}
    return df.withColumns(casts) if casts else df


def fit_engagement(train: DataFrame, num: Sequence[str], cat: Sequence[str], *, n: int, label: str = LABEL,
                   id_col: str = "post_id", num_trees: int = FIRST_FIT_TREES, max_depth: int = MAX_DEPTH,
                   seed: int = 42) -> PipelineModel:
    """K2: the fitted pipeline.  Spark ML's forest sends the statistics of every node (about 12 KB)
    from every task and adds up each one-hot column on its own, so a large frame (``n`` rows) is
    fitted by ``forest.fit_forest``: the same forest from sums over blocks of rows, as models of
    ``TREES_PER_GROUP`` trees, whose weighted mean is the prediction.  Groups and tasks follow
    from the rows alone, so the model does not depend on the cluster."""
    stages = engagement_pipeline(num, cat, label=label, num_trees=num_trees, max_depth=max_depth, seed=seed).getStages()
    if n <= ONE_FOREST_ROWS:
        return Pipeline(stages=stages).fit(train)
    head, forest = Pipeline(stages=stages[:-1]).fit(train), stages[-1]
    rows = head.transform(train)
    scaler = next((s for s in head.stages if isinstance(s, StandardScalerModel)), None)
    one_hot = next((s for s in head.stages if isinstance(s, OneHotEncoderModel)), None)
    width = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
    # columns of a category: its indices, one more for invalid ones, one less as the last is dropped
    columns = list(one_hot.categorySizes) if one_hot else []
    if len(num) + sum(columns) != width:
        raise ValueError(f"{len(num)} numeric and {columns} one-hot columns do not make a vector of {width}")
    sizes = [min(TREES_PER_GROUP, num_trees - at) for at in range(0, num_trees, TREES_PER_GROUP)]
    forests = FR.fit_forest(
        rows.select(id_col, *[f"{c}__imp" for c in num], *[f"{c}__idx" for c in cat], label), forest,
        numeric=[f"{c}__imp" for c in num], scale=list(zip(scaler.mean, scaler.std)) if scaler else [],
        categories=[f"{c}__idx" for c in cat], sizes=columns, label=label, id_col=id_col, parts=math.ceil(n / ROWS_PER_TASK),
        groups=sizes, few_rows=head.transform(train.limit(32)).select("features", label), seed=seed)
    total = " + ".join(f"{k} * __p{g}" for g, k in enumerate(sizes))
    mean = SQLTransformer(statement=f"SELECT *, ({total}) / {num_trees} AS prediction FROM __THIS__")
    return PipelineModel(stages=head.stages + forests + [mean])


def train_engagement_model(df: DataFrame, *, label: str = LABEL, id_col: str = "post_id",
                           num_trees: int = FIRST_FIT_TREES, max_depth: int = MAX_DEPTH, seed: int = 42,
                           n_augmented: DataFrame | int = 0):
    """K2 + K3 + K4: fit on the 80 % hash split, score the 20 %.

    Returns (PipelineModel, metrics one-row DataFrame, feature lists)."""
    num, cat = feature_columns(df, label)
    data = _prep(df.where(F.col(label).isNotNull()), cat).withColumn("__train", split_flag(id_col, seed=seed))
    # the imputer, indexers, scaler and forest each pass over the data: write the
    # prepared frame once so they read it instead of recomputing its lineage.
    # Rows are placed by a hash of the id and sorted within partitions, so the
    # forest's per-partition bootstrap (and so the model) does not depend on how
    # the input happened to be partitioned.
    from postlens.operators.orderstats import materialized
    data = materialized(data)
    n = data.count()
    data = materialized(data.repartition(fit_partitions(n), F.col(id_col)).sortWithinPartitions(id_col))
    train, test = data.where("__train"), data.where("NOT __train")
    model = fit_engagement(train, num, cat, n=n, label=label, id_col=id_col, num_trees=num_trees,
                           max_depth=max_depth, seed=seed)
    m = regression_metrics(model.transform(test), label=label)
    n_aug = n_augmented.scalar() if isinstance(n_augmented, DataFrame) else F.lit(int(n_augmented))
    metrics = (m.withColumns({"n_train": train.agg(F.count(F.lit(1))).scalar(), "n_augmented": n_aug})
               .select("mae", "r2", "n_train", "n_test", F.col("n_augmented").cast("int"),
                       F.lit(num_trees).alias("n_trees"),
                       F.lit(_dt.datetime.now().isoformat(timespec="seconds")).alias("timestamp")))
    return model, materialized(metrics), (num, cat)      # written: the store and the caller both read it


def batch_predict(model: PipelineModel, df: DataFrame, cat: Sequence[str] = (), *,
                  out: str = "predicted_engagement") -> DataFrame:
    """K9: score rows with the fitted pipeline; floor 0, round 6."""
    keep = df.columns
    scored = model.transform(_prep(df, cat))
    return scored.select(*keep, F.round(F.greatest(F.col("prediction"), F.lit(0.0)), 6).alias(out))


# ---------------------------------------------------------------- K6 / K8 / J4
def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    toks = TX.word_tokens(F.coalesce(F.col(text), F.lit("")))                              # null: no terms
    words = df.withColumn("__words", F.array_join(toks, " "))
    return words.withColumn("__terms", TX.term_bag("__words")).drop("__words")


def weighted_terms(stages: Sequence, counted: DataFrame) -> DataFrame:
    """Column ``__x`` of rows with the counts ``__tf``."""
    idf, norm = stages[1:3]
    return norm.transform(idf.transform(TM.sublinear(counted, "__tf")))


def term_features(stages: Sequence, df: DataFrame, text: str = "text") -> DataFrame:
    """K6: column ``__x``: 1 + ln(tf) times idf, L2-normalised.  stages: the counter, the idf
    product and the normaliser of a fitted classifier."""
    return weighted_terms(stages, stages[0].transform(with_terms(df, text)))


def fit_comment_classifier(corpus: DataFrame, *, text: str = "text", label: str = "label",
                           vocab_size: int = 5000, max_iter: int = 1000, tol: float = 1e-4) -> PipelineModel:
    """K6: TF-IDF as J13 (top ``vocab_size`` terms, 1 + ln(tf), idf = ln((1+n)/(1+df)) + 1, L2) +
    multinomial logistic regression with balanced class weights and the
    ridge strength of C = 1 (regParam = 1/n on the weight-normalised loss);
    stopping tolerance 1e-4 as the reference's solver.  The stages of the result are a
    container for the model store; ``classify_comments`` applies them."""
    w = class_weights(corpus, label=label).select(label, "weight")
    # written once: L-BFGS passes over the rows in every iteration; dealt by a hash of the
    # text, so a fit does not depend on how the corpus was partitioned
    from postlens.operators.orderstats import materialized
    corpus = materialized(corpus.select(F.coalesce(text, F.lit("")).alias(text), label))
    n = corpus.count()
    data = materialized(corpus.join(F.broadcast(w), label)           # w: one row per label
                        .repartition(fit_partitions(n), F.xxhash64(text)))
    tokens = materialized(TM.spread(data).select(TX.word_tokens(text).alias("toks")))
    cv = TM.counter(TM.vocabulary(tokens, vocab_size) or [""], "__terms", "__tf")
    counted = materialized(cv.transform(with_terms(data, text)).select("__tf", label, "weight"))    # read for the idf and the fit
    seen = TM.document_counts(counted.select(TM.sparse_parts("__tf").alias("p")), F.col("p.indices"))
    idf = [math.log(1 + n) + 1.0] * len(cv.vocabulary)               # of a term that no row has
    for r in seen.select("i", TM.idf_of(F.col("df"), F.lit(n)).alias("idf")).collect():          # vocab-sized: bounded
        idf[r["i"]] = r["idf"]
    head = [cv, ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf"),
            Normalizer(inputCol="__tfidf", outputCol="__x", p=2.0)]
    lab = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(data)
    feats = lab.transform(weighted_terms(head, counted)).select("__x", "__y", "weight").cache()
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="weight", family="multinomial",
                            regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=tol).fit(feats)
    feats.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="label_pred", labels=lab.labels)
    return PipelineModel(stages=head + [lr, back])


def class_probabilities(model: PipelineModel, df: DataFrame, *, text: str = "comment_text") -> DataFrame:
    """The columns of df with ``label_pred`` and ``probability`` (an array by label, in
    alphabetical order)."""
    keep = df.columns
    lr, back = model.stages[3:]
    s = back.transform(lr.transform(term_features(model.stages, df, text)))
    # a generated row: a filter on the label stays above it, else the optimizer copies the whole
    # classification into the filter, once for each use of a column in it
    return s.select(*keep, F.inline(F.array(F.struct("label_pred", vector_to_array("probability").alias("probability")))))


def classify_comments(model: PipelineModel, df: DataFrame, *, text: str = "comment_text") -> DataFrame:
    """J4 (label part): predicted label and its probability (rounded to 3)."""
    s = class_probabilities(model, df, text=text)
    return s.select(*df.columns, F.col("label_pred").alias("label"),
                    F.round(F.array_max("probability"), 3).alias("confidence"))


def with_extra(corpus: DataFrame, extra: DataFrame | None, *, text: str = "text", label: str = "label") -> DataFrame:
    """K8: the corpus with further labelled rows (columns text and label; rows without a
    label are left out)."""
    if extra is None:
        return corpus
    return corpus.unionByName(extra.where(F.col(label).isNotNull()).select(
        *[F.col(c) if c in (text, label) else F.lit(None).cast(t).alias(c) for c, t in corpus.dtypes]))


def cross_validate(corpus: DataFrame, *, extra: DataFrame | None = None, folds: int = 3, text: str = "text",
                   label: str = "label", id_col: str = "text", seed: int = 42, fit=None, predict=None) -> DataFrame:
    """K8: k-fold accuracy (mean, population sd), n, per-label counts, over stratified
    folds (``with_folds``) of the corpus and the ``extra`` labelled rows.  The folds are
    written once for all fits; a null text is an empty one.  ``fit(rows)`` and
    ``predict(model, rows with the label as __true)`` default to the comment classifier."""
    from postlens.operators.orderstats import materialized
    fit = fit or (lambda rows: fit_comment_classifier(rows, text=text, label=label))
    predict = predict or (lambda model, rows: classify_comments(model, rows, text=text))
    corpus = with_extra(corpus, extra, text=text, label=label)
    f = materialized(with_folds(corpus, label=label, id_col=id_col, folds=folds, seed=seed)
                     .withColumnRenamed("fold", "__fold"))
    accs = []
    for k in range(folds):
        m = fit(f.where(F.col("__fold") != k).drop("__fold"))
        p = predict(m, f.where(F.col("__fold") == k).drop("__fold").withColumnRenamed(label, "__true"))
        accs.append(p.agg(F.avg((F.col("label") == F.col("__true")).cast("double")).alias("acc"))
                    .withColumn("fold", F.lit(k)))
    a = accs[0]
    for x in accs[1:]:
        a = a.unionByName(x)
    stats = a.agg(F.round(F.avg("acc"), 4).alias("cv_accuracy_mean"),
                  F.round(F.stddev_pop("acc"), 4).alias("cv_accuracy_std"))
    dist = f.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("label_distribution"),
        F.sum("n").alias("n_samples"))
    return stats.withColumns({"label_distribution": dist.select("label_distribution").scalar(),
                              "n_samples": dist.select("n_samples").scalar()})


def retrain_comment_classifier(corpus: DataFrame, extra: DataFrame | None = None, *, folds: int = 3, text: str = "text",
                               label: str = "label", seed: int = 42):
    """K6 + K8: (model, summary): the cross-validated accuracy of the corpus and the ``extra``
    labelled rows, and the classifier fitted on all of them."""
    summary = cross_validate(corpus, extra=extra, folds=folds, text=text, label=label, id_col=text, seed=seed)
    return fit_comment_classifier(with_extra(corpus, extra, text=text, label=label), text=text, label=label), summary


def retrain(base: DataFrame, pool: DataFrame | None, *, label: str = LABEL, id_col: str = "post_id",
            max_depth: int = MAX_DEPTH, seed: int = 42):
    """K5: base + labelled pool rows (shared columns) → drop non-features →
    hash split → forest with min(200, 100 + n_aug // 10) trees → metrics.

    The pool size sets a hyper-parameter, so it is one small count action."""
    from postlens.operators.combine import shared_columns_union
    from postlens.operators.enrich import model_columns
    if pool is not None:
        combined, n_aug_df = shared_columns_union(base, pool, label=label)
        n_aug = n_aug_df.first()["n_augmented"]
    else:
        combined, n_aug = base, 0
    n_trees = min(200, 100 + n_aug // 10)
    ids = [F.col(c).cast("string") for c in (id_col, "link") if c in combined.columns]
    ids.append(F.md5(F.to_json(F.struct(*combined.columns))))   # stable under recomputation
    keep_id = combined.withColumn("__id", F.coalesce(*ids))
    data = model_columns(keep_id)
    return train_engagement_model(data, label=label, id_col="__id", num_trees=n_trees,
                                  max_depth=max_depth, seed=seed, n_augmented=n_aug)
