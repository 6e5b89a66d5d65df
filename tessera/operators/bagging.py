"""A bagged forest that can be judged by the rows that its trees did not see, which Spark's own forests do not tell."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DRAWS = 1 << 40


def bag_weight(key: Column, tree: int, seed: int) -> Column:
    """How often a tree's bootstrap sample holds a row: a Poisson number of mean 1, drawn by a hash of the row's key and the tree.

    Any task draws the same for a row, now and later, so samples are neither stored nor shuffled.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(tree), key), F.lit(_DRAWS))
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]
    return sum((F.when(draw >= int(p * _DRAWS), 1).otherwise(0) for p in below[1:]), F.when(draw >= int(below[0] * _DRAWS), 1).otherwise(0))


def _most_voted() -> Column:
    """The class of the largest share, the least of equals."""
    return (F.array_position("_shares", F.array_max("_shares")) - 1).cast("int")


@dataclass(frozen=True)
class Bagged:
    """Trees by number, fitted on rows weighted by ``bag_weight`` of ``key``."""

    trees: tuple[RandomForestClassificationModel, ...]
    key: str
    features: str
    seed: int

    def _votes(self, rows: DataFrame, unseen: bool) -> DataFrame:
        """``rows`` with _shares: the trees' class shares added up, and _trees, their number; ``unseen``: of trees only whose sample is without the row. One pass, whatever the number of trees."""
        out = rows.withColumn("_v", array_to_vector(F.col(self.features).cast("array<double>")))
        shares, count = [], F.lit(0)
        for k, tree in enumerate(self.trees):
            named = tree.copy({tree.probabilityCol: f"_p{k}", tree.rawPredictionCol: "", tree.predictionCol: f"_y{k}"})
            out = named.transform(out).drop(f"_y{k}")
            counts = (bag_weight(F.col(self.key), k, self.seed) == 0) if unseen else F.lit(True)
            shares.append(F.when(counts, vector_to_array(f"_p{k}")))
            count = count + F.when(counts, 1).otherwise(0)
        most = max((t.numClasses for t in self.trees), default=0)
        total = F.array(*[sum((F.coalesce(F.get(s, F.lit(c)), F.lit(0.0)) for s in shares), F.lit(0.0)) for c in range(most)])
        return out.select(*rows.columns, total.alias("_shares"), count.alias("_trees"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with cls, the class of the largest mean share (the least of equals), and confidence, that share."""
        return self._decided(self._votes(rows, unseen=False), rows.columns)

    def out_of_bag(self, rows: DataFrame) -> DataFrame:
        """The rows that the forest was fitted on, with cls and confidence by the trees that did not see them, and votes, the number of these; rows that all trees saw are left out."""
        return self._decided(self._votes(rows, unseen=True).where("_trees > 0"), [*rows.columns, F.col("_trees").alias("votes")])

    @staticmethod
    def _decided(votes: DataFrame, columns: list) -> DataFrame:
        return votes.select(*columns, _most_voted().alias("cls"), (F.array_max("_shares") / F.col("_trees")).alias("confidence"))


def fit_bagged(rows: DataFrame, key: str, features: str, label: str = "label", *, trees: int = 100, depth: int = 12, seed: int = 17) -> Bagged:
    """A forest of ``trees``, each fitted on all rows by the weights of its sample; ``key`` names a row, ``features`` is an array column. Labels and features without null are fitted on.

    The weighted table is written nowhere: it is cached while trees are fitted, one after the other.
    """
    usable = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    table = usable.select(F.col(key).alias("_key"), array_to_vector(F.col(features).cast("array<double>")).alias("_v"), F.col(label).cast("double").alias("_label")).cache()
    try:
        models = []
        for k in range(trees):
            one = RandomForestClassifier(
                featuresCol="_v", labelCol="_label", weightCol="_weight", numTrees=1, bootstrap=False, maxDepth=depth, maxBins=64, featureSubsetStrategy="sqrt", seed=seed + k
            )
            models.append(one.fit(table.withColumn("_weight", bag_weight(F.col("_key"), k, seed).cast("double")).where("_weight > 0")))
        return Bagged(tuple(models), key, features, seed)
    finally:
        table.unpersist()


def oob_score(forest: Bagged, rows: DataFrame, label: str = "label") -> DataFrame:
    """(n, judged, right, score): labelled rows, those that some tree did not see, those that such trees get right, and their share. One pass over the rows."""
    labelled = rows.where(F.col(label).isNotNull() & F.col(forest.features).isNotNull())
    judged = F.col("_trees") > 0
    counted = forest._votes(labelled, unseen=True).agg(F.count("*").alias("n"), F.count_if(judged).alias("judged"), F.count_if(judged & (_most_voted() == F.col(label))).alias("right"))
    return counted.withColumn("score", F.try_divide("right", "judged"))
