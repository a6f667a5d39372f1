"""Quality classifier: a factorisation machine over words, structure and metadata.

Features, all from the whole text with Spark's own functions: counts of
hashed words (scaled to unit length) and structure statistics with the
length.  ``FMClassifier`` learns a bias, a weight and a low-rank vector
per feature; scoring uses the sum-of-squares identity, so it is linear in
the number of nonzero features.

The classifier is fitted on at most ``SAMPLE`` labelled rows (those with
the smallest hashes of the id, a parameter); every document is scored.

Defined results: a null text is scored like an empty one; labels without
a value or document are not learned from, repeated labels of an id count
as one with the largest value; with one label value only every score is
that value, without labels 0.5; repeated documents are all returned; a
very long text is read whole; an empty table gives no rows.  A column
named like the score is replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import held_out, table, written

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 20_000
HASHED_WORDS = 1 << 10
FACTORS = 4
STEPS = 150
THRESHOLD = 0.7

STATISTICS = ["s_words", "s_upper", "s_digit", "s_symbol", "s_bar", "s_distinct", "s_length", "s_lines", "s_spread"]


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its words and structure statistics (columns _words and s_*)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " ")
    n = F.length(text).cast("double")
    n_words = F.size("_words").cast("double")
    distinct = F.size(F.array_distinct("_words")).cast("double")
    lines = F.split(text, "\n")
    return docs.withColumn("_words", words).withColumns({
        "s_words": F.log1p(n_words),
        "s_upper": _share(F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"), n),
        "s_digit": _share(F.regexp_count(text, F.lit(r"\p{Nd}")).cast("double"), n),
        "s_symbol": _share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")).cast("double"), n_words),
        "s_bar": _share(F.regexp_count(text, F.lit(r"[|!$%&#*]")).cast("double"), n_words),
        "s_distinct": _share(distinct, n_words),
        "s_length": _share(n, n_words),
        "s_lines": _share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "s_spread": _share(F.log1p(distinct), F.log1p(n_words)),
    })


class QualityModel:
    """A fitted pipeline, or a constant score where nothing could be learned."""

    def __init__(self, fitted: PipelineModel | None, constant: float = 0.5):
        self.fitted, self.constant = fitted, constant

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with the score, from 0 to 1."""
        if self.fitted is None:
            return docs.withColumn(score_col, F.lit(self.constant))
        # the document's columns travel in one, so that none meets a feature's name
        given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"), F.col(text_col).alias("_text"))
        out = self.fitted.transform(with_features(given, "_text"))
        keep = [F.col(f"_document.`{c}`") for c in docs.columns if c != score_col]
        return out.select(*keep, vector_to_array("_probability")[1].alias(score_col))


def learn(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
    sample: int = SAMPLE, seed: int = 7,
) -> QualityModel:
    """Fit on the labelled rows of ``docs``."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # at most ``sample`` ids and labels are broadcast
    rows = written(with_features(given.join(F.broadcast(known), "_id"), "_text").drop("_text", "_id"), "quality-sample")
    seen = sorted(r[0] for r in rows.select("_label").distinct().collect())
    if len(seen) < 2:
        return QualityModel(None, seen[0] if seen else 0.5)
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=HASHED_WORDS),
        Normalizer(inputCol="_tf", outputCol="_unit"),
        VectorAssembler(inputCols=STATISTICS, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_stat", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_stat", "_unit"], outputCol="_features"),
        FMClassifier(
            featuresCol="_features", labelCol="_label", predictionCol="_prediction", probabilityCol="_probability",
            rawPredictionCol="_margin", factorSize=FACTORS, maxIter=STEPS, stepSize=0.05, regParam=1e-4, initStd=0.05,
            tol=1e-7, seed=seed,
        ),
    ]
    return QualityModel(Pipeline(stages=stages).fit(rows))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    scored = learn(docs, labels).score(docs)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
