"""Facet and pivot counts, joint probabilities and Naive Bayes (survey F6, AGG3-AGG10, J5, K3, K6)."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.collection import Collection
from lodestone.sources.shared import written

#: Classes up to which a model scores every class for every document.
MAX_CLASSES = 10_000
#: Pairs of class and term, about 60 bytes each, up to which a model goes to every executor.
BROADCAST_PAIRS = 200_000


def facet_subset(df: DataFrame, column: str, value: object) -> DataFrame:
    """rows with the value; None: those with none."""
    return df.where(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))


def facet_counts(df: DataFrame, column: str, min_count: int = 1, limit: int = -1) -> DataFrame:
    """AGG3, K6: (value, count) by count and value; limit -1: all, 0: none."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    out = out.orderBy(F.col("count").desc(), "value")
    return out if limit < 0 else out.limit(limit)


def pivot_counts(df: DataFrame, fields: Sequence[str], min_count: int = 1, limit: int = -1) -> DataFrame:
    """AGG5: (level, fields..., count) of every path of values; one field is paired with itself.

    At each level a path needs min_count rows and, with a limit, to be among its parent's largest. Each level is
    one aggregate over what is left of the level above, so paths under a pruned parent are never counted.
    """
    fields = list(dict.fromkeys(fields))
    if len(fields) == 1:
        df, fields = df.withColumn(f"{fields[0]}_again", F.col(fields[0])), [fields[0], f"{fields[0]}_again"]
    kept = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    levels = []
    for k in range(1, len(fields) + 1):
        path = fields[:k]
        counts = kept.where(F.col(path[-1]).isNotNull()).groupBy(*path).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
        if limit >= 0:
            order = (F.col("count").desc(), path[-1])
            if k == 1:
                counts = counts.orderBy(*order).limit(limit)
            else:
                counts = counts.withColumn("__n", F.row_number().over(Window.partitionBy(*path[:-1]).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")
        if k < len(fields) and (limit >= 0 or min_count > 1):
            kept = kept.join(counts.select(*path), path, "left_semi")
        levels.append(counts.select(F.lit(k).alias("level"), *path, *[F.lit(None).cast("string").alias(f) for f in fields[k:]], "count"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def nest(pivots: DataFrame, parent: str, child: str) -> DataFrame:
    """A two-field pivot as one row a parent with its children in an array, largest first."""
    top = pivots.where("level = 1").select(parent, F.col("count").alias("total"))
    below = pivots.where("level = 2").groupBy(parent).agg(F.sort_array(F.collect_list(F.struct("count", F.col(child).alias("value"))), asc=False).alias("children"))
    return top.join(below, parent, "left")


@dataclass(frozen=True)
class JointProbabilityModel:
    """AGG7: priors (field, value, count) and joints (field, value, sub_field, sub_value, count), smoothed by alpha."""

    priors: DataFrame
    joints: DataFrame
    alpha: float = 0.01

    @staticmethod
    def fit(pivots: DataFrame, field: str, sub_field: str, alpha: float = 0.01) -> JointProbabilityModel:
        priors = pivots.where("level = 1").select(F.lit(field).alias("field"), F.col(field).alias("value"), "count")
        joints = pivots.where("level = 2").select(F.lit(field).alias("field"), F.col(field).alias("value"), F.lit(sub_field).alias("sub_field"), F.col(sub_field).alias("sub_value"), "count")
        return JointProbabilityModel(priors, joints, alpha)

    def _totals(self, counts: DataFrame) -> Column:
        one = counts.agg(F.coalesce(F.sum(F.col("count") + F.lit(self.alpha)), F.lit(0.0)).alias("t")).first()
        return F.lit(float(one.t))

    def prior(self) -> DataFrame:
        return self.priors.withColumn("p", (F.col("count") + F.lit(self.alpha)) / self._totals(self.priors))

    def joint(self) -> DataFrame:
        return self.joints.withColumn("p", (F.col("count") + F.lit(self.alpha)) / self._totals(self.joints))

    def unseen(self) -> float:
        """The joint probability of a pair that was never seen."""
        total = self.joints.agg(F.sum(F.col("count") + F.lit(self.alpha)).alias("t")).first().t
        return self.alpha / total if total else 0.0

    def conditional(self) -> DataFrame:
        """P(sub_value given value) of seen pairs; a value that was never seen has none."""
        priors = self.prior().select("value", F.col("p").alias("prior"))
        return self.joint().join(priors, "value").select("value", "sub_value", F.col("p").alias("joint"), (F.col("p") / F.col("prior")).alias("conditional"))

    def save(self, path: str) -> None:
        self.priors.write.mode("overwrite").parquet(f"{path}/priors")
        self.joints.write.mode("overwrite").parquet(f"{path}/joints")

    @staticmethod
    def load(spark: SparkSession, path: str, alpha: float = 0.01) -> JointProbabilityModel:
        return JointProbabilityModel(spark.read.parquet(f"{path}/priors"), spark.read.parquet(f"{path}/joints"), alpha)


@dataclass(frozen=True)
class NaiveBayesModel:
    """Priors (class, p), seen pairs (class, field, term, joint) and what an unseen pair has."""

    priors: DataFrame
    joints: DataFrame
    unseen: float
    params: NaiveBayes

    def transform(self, collection: Collection, class_col: str | None = None, existing: DataFrame | None = None) -> DataFrame:
        """AGG9: (key, class, score, rank). Every class starts from its prior and as many unseen terms as the document
        has; only pairs that were seen are joined, and correct that. Documents' own classes are in the collection, or
        in `existing`, by its key.

        The counts are written once. Those of the model's most frequent terms meet its pairs where they are, and only
        the others are sent by term.
        """
        p, key = self.params, collection.key
        rows = self.priors.limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"over {MAX_CLASSES} classes")
        if not rows:
            return collection.df.select(key, F.lit(None).cast("string").alias("class"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        amount = F.lit(1.0) if p.binary else F.log(F.col("freq") + 1.0) if p.log_tf else F.col("freq").cast("double")
        freq = written(collection.tf(p.fields).select(key, "field", "term", "freq")).withColumn("amount", amount).where(F.col("amount") > 0)
        times = F.col("amount") if p.multinomial else F.lit(1.0)
        inside = F.lit(0.0) if p.multinomial else F.log("amount")
        base = freq.groupBy(key).agg(F.sum(times).alias("terms"), F.sum(inside).alias("inside"))
        every = F.array(*[F.struct(F.lit(r["class"]).alias("class"), F.lit(float(r["p"])).alias("p")) for r in rows])
        base = base.withColumn("c", F.explode(every)).select(key, F.col("c.class").alias("class"), (F.log("c.p") + F.col("inside") + F.col("terms") * F.log(F.lit(self.unseen) / F.col("c.p"))).alias("base"))
        seen = self._met(freq.select(key, "field", "term", times.alias("times")), collection.parts(), BROADCAST_PAIRS // len(rows))
        seen = seen.groupBy(key, "class").agg(F.sum(F.col("times") * F.col("w")).alias("more"))
        scored = base.join(seen, [key, "class"], "left").select(key, "class", F.round(F.col("base") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
        if not p.include_existing and class_col:
            own = (collection.df if existing is None else existing).select(key, F.col(class_col).cast("string").alias("class"))
            scored = scored.join(own, [key, "class"], "left_anti")
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "class"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= p.top_n)

    def _met(self, counts: DataFrame, parts: int | None, terms: int) -> DataFrame:
        """Counts with the classes that their terms were seen in and the weights w of that. Pairs of at most `terms` terms
        go to every executor; of the other terms, both sides are sent by term, to a quarter of `parts` tasks where those are many."""
        on = ["field", "term"]
        weight = F.log(F.col("joint") / F.lit(self.unseen)).alias("w")
        pairs = self.joints.select(*on, "class", weight)
        if self.joints.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
            return counts.join(F.broadcast(pairs), on)
        most = self.joints.groupBy(*on).agg(F.max("joint").alias("most"))
        best = most.select("most").orderBy(F.col("most").desc()).limit(terms + 1).agg(F.min("most")).first()[0]
        head = most.where(F.col("most") > best).select(*on)  # at most `terms`, whatever ties
        n = (parts or 0) // 4
        wide = n > int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sent = lambda x: x.repartition(n, *on) if wide else x
        common = counts.join(F.broadcast(pairs.join(F.broadcast(head), on, "left_semi")), on)
        others = [sent(x.join(F.broadcast(head), on, "left_anti")) for x in (counts, pairs)]
        return common.union(others[0].join(others[1], on).select(common.columns))

    def save(self, path: str) -> None:
        self.priors.write.mode("overwrite").parquet(f"{path}/priors")
        self.joints.write.mode("overwrite").parquet(f"{path}/joints")
        self.priors.sparkSession.range(1).select(F.lit(float(self.unseen)).alias("unseen")).write.mode("overwrite").parquet(f"{path}/unseen")

    @staticmethod
    def load(spark: SparkSession, path: str, params: NaiveBayes | None = None) -> NaiveBayesModel:
        """AGG10: what save() wrote, to predict with these parameters."""
        unseen = spark.read.parquet(f"{path}/unseen").first().unseen
        return NaiveBayesModel(spark.read.parquet(f"{path}/priors"), spark.read.parquet(f"{path}/joints"), unseen, params or NaiveBayes())


@dataclass
class ModelCache:
    """AGG10: models by name, made again when one is asked for that is older than max_age seconds, or on demand."""

    max_age: float = 3600.0
    clock: Callable[[], float] = time.monotonic
    _held: dict[str, tuple[float, object]] = field(default_factory=dict, repr=False)

    def get(self, name: str, make: Callable[[], object], refresh: bool = False) -> object:
        held, now = self._held.get(name), self.clock()
        if refresh or held is None or now - held[0] > self.max_age:
            self._held[name] = held = (now, make())
        return held[1]


@dataclass(frozen=True)
class NaiveBayes:
    """AGG8-AGG10. Joint counts are documents that have both; those below min_count are as if unseen."""

    fields: tuple[str, ...] = ("text",)
    alpha: float = 0.01
    top_n: int = 1
    binary: bool = False
    log_tf: bool = False
    multinomial: bool = False
    include_existing: bool = True
    min_count: int = 1
    build_predicate: Column | None = None

    def fit(self, collection: Collection, class_col: str) -> NaiveBayesModel:
        docs = collection.df if self.build_predicate is None else collection.df.where(self.build_predicate)
        docs = docs.where(F.col(class_col).isNotNull())
        own = Collection(docs, collection.key, collection.text, collection.keyword, collection.payload)
        priors = docs.groupBy(F.col(class_col).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
        labelled = own.tf(self.fields, also=(class_col,)).withColumn("class", F.col(class_col).cast("string"))
        joints = written(labelled.groupBy("class", "field", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_count))
        a = F.lit(self.alpha)
        total = priors.agg(F.sum(F.col("n") + a).alias("t")).first().t or 0.0
        joint_total = joints.agg(F.sum(F.col("n") + a).alias("t")).first().t or 0.0
        return NaiveBayesModel(
            priors.select("class", ((F.col("n") + a) / F.lit(total or 1.0)).alias("p")),
            joints.select("class", "field", "term", ((F.col("n") + a) / F.lit(joint_total or 1.0)).alias("joint")),
            self.alpha / joint_total if joint_total else 1.0,
            self,
        )
