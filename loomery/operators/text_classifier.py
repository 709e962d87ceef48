"""Text classification: hashed word and word-pair counts, inverse document frequencies over the corpus, a logistic fit over all rows.

Everything that grows with the corpus runs in Spark: frequencies are counted in one aggregation of a vector of
``dims`` numbers, and each step of the fit sums a gradient over all rows. No vocabulary is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class TextClassifier:
    """A fitted model: steps from text to features, the fit, and the labels by class number."""

    features: PipelineModel
    model: LogisticRegressionModel
    labels: list[str]
    text: str

    def classify(self, docs: DataFrame, category: str = "category", confidence: str = "confidence", probabilities: str = "probabilities") -> DataFrame:
        """``docs`` with the likeliest category (of equal ones the first by name), its probability, and all of them as a map.

        Null texts count as empty ones and get the model's base rates. Columns of the new names are replaced.
        """
        kept = [c for c in docs.columns if c not in (category, confidence, probabilities)]
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _given(docs, self.text))
        scored = self.model.transform(self.features.transform(rows)).withColumn("p", vector_to_array("probability"))
        # one row made apart, so that nothing that is computed from it is computed twice
        made = F.explode(F.array(F.struct("p", F.array_max("p").alias("most"))))
        found = scored.select("row", made.alias("m"))
        names = F.array(*[F.lit(x) for x in self.labels])
        return found.select(
            "row.*", F.element_at(names, F.array_position("m.p", F.col("m.most")).cast("int")).alias(category), F.col("m.most").alias(confidence), F.map_from_arrays(names, F.col("m.p")).alias(probabilities)
        )


def _given(docs: DataFrame, text: str):
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("given")


def feature_steps(dims: int, pairs: bool, stop_words: bool) -> list:
    """From ``given`` to ``hashed``: lower-cased words of two or more letters or digits, pairs of neighbours, counts by hash."""
    steps = [RegexTokenizer(inputCol="given", outputCol="all_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)]
    steps.append(StopWordsRemover(inputCol="all_words", outputCol="words") if stop_words else StopWordsRemover(inputCol="all_words", outputCol="words", stopWords=[]))
    steps.append(HashingTF(inputCol="words", outputCol="word_counts", numFeatures=dims))
    if pairs:
        steps += [NGram(n=2, inputCol="words", outputCol="pairs"), HashingTF(inputCol="pairs", outputCol="pair_counts", numFeatures=dims)]
        steps.append(VectorAssembler(inputCols=["word_counts", "pair_counts"], outputCol="hashed"))
    else:
        steps.append(VectorAssembler(inputCols=["word_counts"], outputCol="hashed"))
    return steps


def fit_text_classifier(
    docs: DataFrame, text: str, label: str, corpus: DataFrame | None = None, dims: int = 1 << 16, pairs: bool = True, stop_words: bool = True, penalty: float = 1.0, steps: int = 500
) -> TextClassifier | None:
    """A multinomial logistic model of ``label`` (any type, compared as text) on tf-idf weights of length 1.

    Frequencies are counted over ``corpus`` (``docs`` by default), whole texts; words are told apart by hash in ``dims``
    slots, pairs in as many more. ``penalty`` is that of the squared weights against the sum of losses. Rows without label
    are left out; null texts count as empty. With fewer than two labels there is nothing to tell apart: None.
    """
    rows = docs.filter(F.col(label).isNotNull()).select(_given(docs, text), F.col(label).cast("string").alias("name"))
    counted = rows.groupBy("name").count().orderBy("name").collect()  # a row a category
    if len(counted) < 2:
        return None
    labels, n = [r["name"] for r in counted], sum(r["count"] for r in counted)
    plain = PipelineModel(stages=feature_steps(dims, pairs, stop_words))
    hashed = plain.transform(rows if corpus is None else corpus.select(_given(corpus, text)))
    idf = IDF(inputCol="hashed", outputCol="weighted").fit(hashed.select("hashed"))
    features = PipelineModel(stages=[*plain.stages, idf, Normalizer(inputCol="weighted", outputCol="features")])
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("name")) - 1
    ready = features.transform(rows).select("features", number.cast("double").alias("y"))
    fit = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=penalty / n, maxIter=steps, standardization=False, tol=1e-9)
    return TextClassifier(features, fit.fit(ready), labels, text)


def held_out(key: str, share: int = 5):
    """True for one row in ``share``, by a checksum of its key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % share == 0


def ranking_quality(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: ``n``, ``positives``, ``auc`` (area under the curve, ties counted half; null without both kinds) and ``accuracy`` at a half.

    Scores are counted by value and summed up in buckets, so no task orders all rows.
    """
    from loomery.operators.ranking import running_sums

    y = F.col(label).cast("long")
    counts = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    counts = counts.withColumns({"g": F.lit(0), "b": F.floor(F.col("s") * 1000).cast("long")})
    below = running_sums(counts, ["g"], "b", [F.col("s")], {"under": F.col("neg")})
    area = F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))
    right = F.sum(F.when(F.col("s") > 0.5, F.col("pos")).otherwise(F.col("neg")))
    return below.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"), area.alias("auc"), F.try_divide(right, F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"))
