"""One entry for detection by any of the algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import classify
from glossa.operators.models import train
from glossa.operators.scorer import profiles_of, scored
from glossa.session import materialize

ALGORITHMS = ("linear", "trees", "logistic")


class LanguageDetector:
    """Profiles, and the classifiers that were fitted or given."""

    def __init__(self, profiles: list[tuple[str, int, str, float]], trees: DataFrame | None = None, weights: DataFrame | None = None) -> None:
        self.profiles, self.trees, self.weights = profiles, trees, weights
        self.langs = sorted({p[0] for p in profiles})

    @classmethod
    def learn(cls, docs: DataFrame) -> LanguageDetector:
        """Profiles from (lang, text)."""
        return cls(profiles_of(train(docs)))

    def scored(self, units: DataFrame) -> DataFrame:
        return scored(units, self.profiles)

    def fit(self, docs: DataFrame) -> LanguageDetector:
        """Both classifiers from (doc_id, lang, text); the texts are scored once."""
        return self.fit_scored(materialize(self.scored(docs.select(F.col("doc_id").alias("id"), "lang", "text")), "scored")[0])

    def fit_scored(self, rows: DataFrame) -> LanguageDetector:
        """The same from what `scored` makes of (id, lang, text), written once."""
        rows = rows.withColumnRenamed("lang", "truth")
        binned, _ = materialize(classify.binned(classify.feature_rows(rows, "id", self.langs, "truth")), "binned")
        self.trees, _ = materialize(classify.id3(classify.bags(binned)), "trees")
        x = classify.vectors(rows, "id", self.langs, "truth")
        self.weights, _ = materialize(classify.train_logistic(x, self.langs), "weights")
        return self

    def detect(self, units: DataFrame, algorithm: str = "linear") -> DataFrame:
        """(id, lang_pred) of (id, text): null where no language counts."""
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm}")
        return self.detect_scored(self.scored(units.select("id", "text")), algorithm)

    def detect_scored(self, rows: DataFrame, algorithm: str = "linear") -> DataFrame:
        """The same from the rows of `scored`."""
        if algorithm == "linear":
            return rows.select("id", "lang_pred")
        if (self.trees if algorithm == "trees" else self.weights) is None:
            raise ValueError(f"{algorithm} need fit() first")
        if algorithm == "logistic":
            found = classify.predict_logistic(classify.vectors(rows, "id", self.langs), self.weights)
        else:
            bins = classify.binned(classify.feature_rows(rows.withColumn("truth", F.lit(None).cast("string")), "id", self.langs, "truth"))
            found = classify.predict_trees(materialize(bins.select("id", "lang", *classify.BINS), "bins")[0], self.trees)
        return classify.most_confident(found).select("id", "lang_pred")
