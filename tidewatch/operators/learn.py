"""Learning operators.

* M1: exact training medians / modes (of equally frequent values the smallest)
  are computed with one aggregate and baked into a ``SQLTransformer`` (so they
  persist with the pipeline); categories go through
  ``StringIndexer(handleInvalid='keep')`` and ``OneHotEncoder(dropLast)``, which
  encodes an unseen category as all zeros.
* M2 / M3: the forest and the extremely randomised trees of ``operators.forest``;
  medians and modes come from all rows, the trees from all labelled ones.  A Spark ML gradient-boosted candidate remains as an option.
* M9: permutation importance moves a column's values one row on in the order
  of a seeded digest of the ids; all repeats of a column stand in one narrow long
  table that is scanned once, and its files go before the next column's.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed
from tidewatch.operators import forest, metrics, quantiles, timeseries
from tidewatch.session import cut_lineage, passing_tables

TREE_KINDS = ("random_forest", "extra_trees")


@dataclass(frozen=True)
class ModelSpec:
    name: str = "random_forest"
    trees: int = 500
    min_leaf: int = 2
    max_depth: int = 30
    seed: int = 42
    balanced: bool = True
    fit_rows: int | None = None  # None: all labelled rows; a caller may ask for fewer
    max_bins: int = 32
    boost_rounds: int = 100      # the boosted candidate's own settings
    boost_depth: int = 5

    def ensemble(self, name: str | None = None, slots: tuple | None = None) -> forest.Ensemble:
        return forest.Ensemble(name or self.name, self.name, self.trees, self.min_leaf, self.max_depth, self.seed, self.balanced, slots)


@dataclass
class Features:
    numeric: list[str] = field(default_factory=lambda: list(fixed.MODEL_NUMERIC_FEATURES))
    categorical: list[str] = field(default_factory=lambda: list(fixed.MODEL_CATEGORICAL_FEATURES))

    def active(self, df: DataFrame) -> "Features":
        return Features([c for c in self.numeric if c in df.columns], [c for c in self.categorical if c in df.columns])


@dataclass
class TreeModel:
    """A fitted preprocessor (M1) with an ensemble's node table."""

    prep: PipelineModel
    nodes: DataFrame
    spec: ModelSpec

    @cached_property
    def trees(self) -> forest.Trees:
        return forest.Trees(self.nodes)

    def save(self, path: str) -> None:
        """Preprocessor, node table and settings under ``path``."""
        self.prep.write().overwrite().save(f"{path}/prep")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        settings = {k: v for k, v in asdict(self.spec).items() if v is not None}
        spark.createDataFrame([settings]).coalesce(1).write.mode("overwrite").json(f"{path}/spec")

    @staticmethod
    def load(spark, path: str) -> "TreeModel":
        row = spark.read.json(f"{path}/spec").first().asDict()
        return TreeModel(PipelineModel.load(f"{path}/prep"), spark.read.schema(forest.NODES).parquet(f"{path}/nodes"), ModelSpec(**row))


def _lit_sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({float(v)!r} AS DOUBLE)"


def imputer_stage(train: DataFrame, feats: Features) -> SQLTransformer:
    """M1 (impute part): medians of numeric and modes of categorical features on ``train``."""
    med = quantiles.medians(train, feats.numeric).first() if feats.numeric else {}
    modes = train.agg(*[F.mode(c, True).alias(c) for c in feats.categorical]).first() if feats.categorical else {}
    parts = [f"coalesce(CAST(`{c}` AS DOUBLE), {_lit_sql(med[c])}) AS `{c}__imp`" for c in feats.numeric]
    parts += [f"coalesce(CAST(`{c}` AS STRING), {_lit_sql(modes[c])}) AS `{c}__imp`" for c in feats.categorical]
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def preprocessor_stages(train: DataFrame, feats: Features) -> list:
    """M1: impute, index, one-hot, assemble into ``features``."""
    stages = [imputer_stage(train, feats)]
    cat_in = [f"{c}__imp" for c in feats.categorical]
    if cat_in:
        stages.append(StringIndexer(inputCols=cat_in, outputCols=[f"{c}__idx" for c in feats.categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in feats.categorical],
                                    outputCols=[f"{c}__ohe" for c in feats.categorical], dropLast=True,
                                    handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[f"{c}__imp" for c in feats.numeric]
                                  + [f"{c}__ohe" for c in feats.categorical], outputCol="features",
                                  handleInvalid="keep"))
    return stages


def fit_preprocessor(train: DataFrame, feats: Features) -> PipelineModel:
    """M1 on all training rows."""
    return Pipeline(stages=preprocessor_stages(train, feats.active(train))).fit(train)


def array_features(prep: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the assembled features as an array; the preprocessor's work columns are dropped."""
    out = prep.transform(df)
    work = [c for c in out.columns if c.endswith(("__imp", "__idx", "__ohe"))]
    return out.drop(*work).withColumn("features", vector_to_array("features"))


def grow_all(train: DataFrame, prep: PipelineModel, specs: list[ModelSpec], label: str = "label", id_col: str = "reading_id",
             slots: dict[str, tuple] | None = None) -> dict[str, TreeModel]:
    """M2 / M3: tree ensembles on one preprocessor, grown together on all labelled rows.

    Without ``slots`` the models go by their specs' names; with it, one spec is
    grown per name on those feature slots only.
    """
    fitting, limits = train.where(F.col(label).isNotNull()), [s.fit_rows for s in specs]
    if None not in limits:
        fitting = forest.fitting_rows(fitting, id_col, max(limits), specs[0].seed)
    rows = array_features(prep, fitting).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"), "features")
    rows = cut_lineage(rows, "fitting-rows")
    named = {n: specs[0].ensemble(n, s) for n, s in slots.items()} if slots else {s.name: s.ensemble() for s in specs}
    nodes = forest.grow(rows, list(named.values()))
    spec_of = {n: specs[0] for n in slots} if slots else {s.name: s for s in specs}
    return {n: TreeModel(prep, nodes.where(F.col("model") == n), spec_of[n]) for n in named}


def _fit_boosted(train: DataFrame, feats: Features, spec: ModelSpec, label: str) -> PipelineModel:
    data = metrics.class_weights(train, label) if spec.balanced else train
    boosted = GBTClassifier(labelCol=label, featuresCol="features", maxIter=spec.boost_rounds, maxDepth=spec.boost_depth,
                            minInstancesPerNode=spec.min_leaf, seed=spec.seed, weightCol="weight" if spec.balanced else None,
                            maxBins=spec.max_bins)
    return Pipeline(stages=preprocessor_stages(data, feats) + [boosted]).fit(data)


def fit_all(train: DataFrame, feats: Features, specs: list[ModelSpec], label: str = "label", id_col: str = "reading_id") -> dict:
    """M4 + M1 + M2 / M3: every candidate by name; tree ensembles share the preprocessor and one growing job."""
    feats = feats.active(train)
    ours = [s for s in specs if s.name in TREE_KINDS]
    out = grow_all(train, fit_preprocessor(train, feats), ours, label, id_col) if ours else {}
    return out | {s.name: _fit_boosted(train, feats, s, label) for s in specs if s.name not in TREE_KINDS}


def fit(train: DataFrame, feats: Features, spec: ModelSpec, label: str = "label", id_col: str = "reading_id"):
    """M4 + M1 + M2 / M3: one candidate."""
    return fit_all(train, feats, [spec], label, id_col)[spec.name]


def predict(model, df: DataFrame) -> DataFrame:
    """Prediction and positive-class probability per row (work columns dropped)."""
    if isinstance(model, TreeModel):
        scored = forest.score_rows(array_features(model.prep, df), model.trees)
        return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    drop = [c for c in out.columns if c.endswith(("__imp", "__idx", "__ohe"))
            or c in ("features", "rawPrediction", "probability")]
    return out.drop(*drop).withColumn("prediction", F.col("prediction").cast("int"))


def predict_all(models: dict, df: DataFrame) -> DataFrame:
    """``predict`` of every model over the same rows, stacked under ``model``; ensembles of one preprocessor share its pass."""
    out = None
    for name, model in models.items():
        part = predict(model, df).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_model(model, test: DataFrame, label: str = "label", groups: list[str] = ()) -> DataFrame:
    """M5 on a held-out frame."""
    scored = predict(model, test)
    return metrics.evaluate(scored, label, "prediction", "score", list(groups))


def feature_importance(model) -> DataFrame:
    """M8: (feature, importance) with the assembled vector's slot names, descending.

    The importance vector has one entry per feature slot (bounded by the schema).
    """
    from pyspark.sql import SparkSession

    if isinstance(model, TreeModel):
        names = slot_names(model.prep)
        imp = forest.importances(model.nodes, len(names))
    else:
        names, imp = slot_names(model), model.stages[-1].featureImportances.toArray().tolist()
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(imp)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature"))


def slot_names(model: PipelineModel) -> list[str]:
    """Names of the feature vector's slots: ``num__<col>`` and ``cat__<col>_<value>``."""
    names: list[str] = []
    indexer = next((s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"), None)
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    labels = dict(zip(indexer.getInputCols(), indexer.labelsArray)) if indexer is not None else {}
    for c in assembler.getInputCols():
        if c.endswith("__imp"):
            names.append(f"num__{c[:-5]}")
        elif c.endswith("__ohe"):
            base = c[:-5]
            names.extend(f"cat__{base}_{v}" for v in labels.get(f"{base}__imp", []))
    return names


def slot_columns(model: PipelineModel, feats: Features) -> list[str]:
    """The input column behind every slot of the feature vector."""
    out = []
    for name in slot_names(model):
        kind, rest = name.split("__", 1)
        out.append(rest if kind == "num" else next(c for c in sorted(feats.categorical, key=len, reverse=True) if rest.startswith(f"{c}_")))
    return out


def permuted_values(df: DataFrame, columns: list[str], repeats: int, seed: int = 42, id_col: str = "reading_id") -> DataFrame:
    """(id, feature, repeat, number, text): every column's shuffled values, one pass for all columns and repeats.

    Per (column, repeat), rows stand in the order of the md5 of seed, repeat, column
    and id and every row takes the value of the row before it (the first that of
    the last): one cycle through all rows, so the column's multiset is unchanged and
    the result depends on ids alone, not on how rows are dealt out.  A string
    column's values come in ``text``, others as ``number`` (double).
    """
    kinds = dict(df.dtypes)
    value = lambda c: F.struct(F.lit(c).alias("feature"), (F.lit(None) if kinds[c] == "string" else F.col(c)).cast("double").alias("number"),
                               (F.col(c) if kinds[c] == "string" else F.lit(None)).cast("string").alias("text"))
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[value(c) for c in columns])).alias("v")).select("id", "v.feature", "v.number", "v.text")
    long = long.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("feature"), F.col("id").cast("string")).cast("binary"))
    long = long.select("feature", "repeat", h.alias("_h"), "id", F.struct("number", "text").alias("_v"))
    out = timeseries.ordered_scan(long, ["feature", "repeat"], ["_h", "id"], ["_v"], suffix="_before")
    last = long.groupBy(F.col("feature").alias("_f"), F.col("repeat").alias("_r")).agg(F.max_by("_v", F.struct("_h", "id")).alias("_last"))
    out = out.join(last, (F.col("feature") == F.col("_f")) & (F.col("repeat") == F.col("_r")))  # a row per column and repeat
    moved = F.coalesce("_v_before", "_last")
    return out.select("id", "feature", "repeat", moved["number"].alias("number"), moved["text"].alias("text"))


def permuted(df: DataFrame, column: str, repeats: int, seed: int = 42, id_col: str = "reading_id") -> DataFrame:
    """Copies of ``df`` (one per repeat, ``_repeat``) with ``column`` shuffled between rows (see ``permuted_values``)."""
    x = df.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_repeat").cast("string"), F.lit(column), F.col(id_col).cast("string")).cast("binary"))
    x = x.withColumn("_h", h).withColumn("_v", F.struct(F.col(column).alias("v")))
    out = timeseries.ordered_scan(x, ["_repeat"], ["_h", id_col], ["_v"], suffix="_before")
    last = x.groupBy(F.col("_repeat").alias("_r")).agg(F.max_by("_v", F.struct("_h", id_col)).alias("_last"))  # a row per repeat
    out = out.join(last, F.col("_repeat") == F.col("_r"))
    return out.withColumn(column, F.coalesce("_v_before", "_last")["v"]).drop("_h", "_v", "_v_before", "_r", "_last")


def permutation_importance(model, test: DataFrame, columns: list[str], repeats: int = 10,
                           label: str = "label", seed: int = 42, id_col: str = "reading_id") -> DataFrame:
    """M9: mean accuracy drop per feature when that feature is shuffled (``repeats`` times).

    A column at a time: its shuffled values are ranked, joined and scored, and the
    tables of that round go before the next, so the disk holds the rows of one
    column and its repeats whatever the number of columns.
    """
    spark = test.sparkSession
    test = cut_lineage(test.select(id_col, label, *columns), "permuted-test")  # what the model reads, before rows are repeated
    hit = F.avg((F.col(label) == F.col("prediction")).cast("double"))
    base = predict(model, test).agg(hit.alias("base"))
    kinds = dict(test.dtypes)
    found = []
    for c in columns:
        with passing_tables(spark):
            moved = permuted_values(test.select(id_col, c), [c], repeats, seed, id_col)
            new = F.col("text") if kinds[c] == "string" else F.col("number").cast(kinds[c])
            moved = moved.select(F.col("id").alias(id_col), "repeat", new.alias("_new"))
            rows = moved.join(test, id_col).withColumn(c, F.col("_new")).drop("_new")
            acc = predict(model, rows).groupBy("repeat").agg(hit.alias("a"))
            found += [(c, r["repeat"], r["a"]) for r in cut_lineage(acc, "accuracies").collect()]  # a row per repeat
    acc = spark.createDataFrame(found, "shuffled string, repeat int, a double")
    mean = acc.groupBy("shuffled").agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("importance_std"))
    return mean.crossJoin(F.broadcast(base)).select(  # one row
        F.col("shuffled").alias("feature"), (F.col("base") - F.col("mean")).alias("importance_mean"), "importance_std")
