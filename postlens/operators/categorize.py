"""Category of the rows no rule decides: a scorer, by default one trained on the rule labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.labels import category_input, rule_category
from postlens.functions.text import word_class_squeeze
from postlens.session import shared_dir

FEATURES = 1 << 14
Scorer = Callable[[DataFrame], DataFrame]


def _written(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, for what reads it several times."""
    path = f"{shared_dir(df.sparkSession)}/postlens-runs/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_input", category_input(F.col(text))).withColumn(
        "_words", F.split(word_class_squeeze(F.col("_input")), " ")
    )


def train_classifier(labelled: DataFrame, text: str = "original_text", label: str = "category") -> PipelineModel:
    """Multinomial classifier over hashed TF-IDF words; the model has a fixed size.

    Label and hashed words of a row are computed once and written aside, because every stage
    of the fit reads them again.
    """
    hashing = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES)
    # the filter comes after the write: before it, it would compute the label a second time
    words = F.when(F.col(label).isNotNull(), F.col("_words")).otherwise(F.array().cast("array<string>"))
    told = hashing.transform(_with_words(labelled, text).withColumn("_words", words))
    rows = _written(told.select(label, "_tf")).filter(F.col(label).isNotNull())
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    stages = [
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_scores",
            predictionCol="_predicted", maxIter=15, regParam=0.01,
        ),
    ]
    named = indexer.fit(rows)
    idf, regression = Pipeline(stages=stages).fit(named.transform(rows)).stages
    return PipelineModel(stages=[named, hashing, idf, regression])


def score_with(model: PipelineModel, text: str = "original_text") -> Scorer:
    """Scorer adding ``all_scores``, a map from category to probability."""
    names = model.stages[0].labels
    keys = F.array(*[F.lit(n) for n in names])
    # classifying needs the words only, not the label column
    tail = PipelineModel(stages=model.stages[1:])

    def run(df: DataFrame) -> DataFrame:
        scored = tail.transform(_with_words(df, text))
        return scored.withColumn("all_scores", F.map_from_arrays(keys, vector_to_array("_scores"))).select(
            *df.columns, "all_scores"
        )

    return run


def categorize(df: DataFrame, scorer: Scorer, text: str = "original_text") -> DataFrame:
    """Add ``category, score, method, all_scores``: rules first, the scorer for the rest.

    The two kinds of rows are split before the scorer, so it never runs on decided ones. The
    rules run once for both: their verdicts are written aside with the rows.
    """
    kept = df.drop("category")
    ruled = _written(kept.withColumn("_rule", rule_category(F.col(text))))
    none = F.create_map().cast("map<string,double>")
    decided = ruled.filter(F.col("_rule.method").isNotNull()).select(
        *kept.columns, "_rule.category", "_rule.score", "_rule.method", none.alias("all_scores")
    )
    rest = scorer(ruled.filter(F.col("_rule.method").isNull()).select(*kept.columns))
    entries = F.transform(
        F.map_entries("all_scores"),
        lambda e: F.struct(e["value"].alias("score"), e["key"].alias("category")),
    )
    best = rest.withColumn("_best", F.array_max(entries)).select(
        *kept.columns, "_best.category", "_best.score", F.lit("scored").alias("method"), "all_scores"
    )
    return decided.unionByName(best)
