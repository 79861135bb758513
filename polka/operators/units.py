"""Quantities in different units: contents and prices of tags in common units.

Tags say what a price is for in ``unit`` or, where that is missing, in ``notes``. A tag
that says it in neither gets a unit from a calibrated random forest, which learns
from the tags that do; confident assignments are converted, the rest go to review.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polka.functions.measures import in_kopecks, with_contents, with_price_unit
from polka.session import cut

#: At most so many labelled tags teach the forest, spread over all by a hash of the id.
TRAINING_ROWS = 20_000
CONFIDENT = 0.9
_INPUTS = ["log_price", "log_contents", "contents_dim", "source", "kind", "promo_share"]


def deliveries_once(tags: DataFrame) -> DataFrame:
    """One row per ``tag_id``; a tag delivered twice has the same content."""
    return tags.dropDuplicates(["tag_id"])


def stated(tags: DataFrame) -> DataFrame:
    """Adds what each tag itself says; names of added columns start with ``stated_`` or ``contents_``.

    ``weight_volume`` goes before ``product_name`` for the contents, ``unit`` before
    ``notes`` for the price's unit. Null or blank fields say nothing.
    """
    df = with_contents(tags, "weight_volume", "_field_dim", "_field_total")
    # the name is read only where the field says nothing
    df = df.withColumn("_name", F.when(F.col("_field_dim").isNull(), F.col("product_name")))
    df = with_contents(df, "_name", "_name_dim", "_name_total")
    df = df.withColumn("_said", F.coalesce(F.nullif(F.trim("unit"), F.lit("")), "notes"))
    df = with_price_unit(df, "_said", "stated_dim", "stated_amount")
    kopecks = in_kopecks(F.col("unit")) | in_kopecks(F.col("notes"))
    price, by_field = F.col("regular_price"), F.col("_field_dim").isNotNull()
    return df.select(
        *tags.columns,
        F.coalesce("_field_dim", "_name_dim").alias("contents_dim"),
        F.when(by_field, F.col("_field_total")).otherwise(F.col("_name_total")).alias("contents_total"),
        "stated_dim", "stated_amount",
        F.when((price > 0) & (price < float("inf")), F.when(kopecks, price / 100.0).otherwise(price)).alias("stated_roubles"),
    )


def _features(df: DataFrame) -> DataFrame:
    first = F.element_at(F.split(F.lower(F.regexp_replace(F.coalesce("product_name", F.lit("")), r"(?U)[^\w ]", "")), " "), 1)
    return df.withColumns({
        "log_price": F.coalesce(F.log1p("stated_roubles"), F.lit(0.0)),
        "log_contents": F.coalesce(F.log1p("contents_total"), F.lit(0.0)),
        "contents_dim": F.coalesce("contents_dim", F.lit("none")),
        "source": F.coalesce("capture_source", F.lit("none")),
        "kind": F.coalesce(F.substring(first, 1, 4), F.lit("none")),
        "promo_share": F.coalesce(F.try_divide(F.col("promo_price"), F.col("regular_price")), F.lit(0.0)),
    })


class UnitModel:
    """Forest over hashed features, its top-class vote calibrated by isotonic regression."""

    def __init__(self, pipeline, calibration, labels: list[str]):
        self.pipeline, self.calibration, self.labels = pipeline, calibration, labels

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``predicted_class`` and its calibrated ``unit_confidence``."""
        out = self.pipeline.transform(_features(df))
        out = out.withColumn("_vote", F.array_max(vector_to_array("probability")))
        out = self.calibration.transform(out)
        names = F.array(*[F.lit(x) for x in self.labels])
        return out.select(
            *df.columns,
            F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted_class"),
            F.col("calibrated").alias("unit_confidence"),
        )


def fit_unit_model(labelled: DataFrame, max_rows: int = TRAINING_ROWS, trees: int = 20, seed: int = 7) -> UnitModel | None:
    """Fit on at most ``max_rows`` tags with a stated unit; None where there are too few.

    A fifth of them is held out of the forest for the calibration.
    """
    rows = labelled.where(F.col("stated_dim").isNotNull() & F.col("stated_roubles").isNotNull()).withColumn("_class", F.concat_ws("/", F.col("stated_dim"), F.col("stated_amount").cast("string")))
    sample = rows.orderBy(F.xxhash64("tag_id"), "tag_id").limit(max_rows)
    sample = cut(_features(sample).select("_class", *_INPUTS, F.pmod(F.xxhash64("tag_id", F.lit(1)), F.lit(5)).alias("_fold")), "unit-sample")
    counts = sample.groupBy("_class").count().collect()  # one row per unit, a fixed vocabulary
    if len(counts) < 2 or sum(r["count"] for r in counts) < 50:
        return None
    pipeline = Pipeline(stages=[
        StringIndexer(inputCol="_class", outputCol="label", handleInvalid="keep"),
        FeatureHasher(inputCols=_INPUTS, outputCol="features", numFeatures=64),
        RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, featureSubsetStrategy="0.5"),
    ])
    model = pipeline.fit(sample.where("_fold > 0"))
    labels = [*model.stages[0].labels, "?"]
    scorer = Pipeline(stages=[]).fit(sample)  # the indexer is for training only
    scorer.stages = model.stages[1:]
    held = model.transform(sample.where("_fold = 0"))
    held = held.withColumn("_vote", F.array_max(vector_to_array("probability"))).withColumn("_hit", (F.col("prediction") == F.col("label")).cast("double"))
    calibration = IsotonicRegression(featuresCol="_vote", labelCol="_hit", predictionCol="calibrated").fit(held)
    return UnitModel(scorer, calibration, labels)


def convert_units(tags: DataFrame, confident: float = CONFIDENT, max_rows: int = TRAINING_ROWS, guess: bool = True) -> DataFrame:
    """One row per tag: contents, price basis and price in roubles per kg, litre or piece.

    Columns: ``tag_id, shelf_ref, regular_price, contents_dim (g|ml|pcs), contents_total,
    unit_source (stated|predicted|review|none), unit_confidence, price_dim (g|ml|pcs),
    unit_price``. ``unit_price`` is NULL where the price is missing or not positive, the unit
    is unknown or too uncertain (``review``), or a price per pack meets no contents.
    Tags without a price are ``none``. An empty table gives an empty result. Without ``guess``
    no forest is fitted, and every tag that states no unit is ``review``.
    """
    base = cut(stated(deliveries_once(tags)), "stated")
    known = base.where(F.col("stated_dim").isNotNull() | F.col("stated_roubles").isNull())
    silent = base.where(F.col("stated_dim").isNull() & F.col("stated_roubles").isNotNull())
    known = known.withColumns({
        "unit_source": F.when(F.col("stated_roubles").isNull(), "none").otherwise("stated"),
        "unit_confidence": F.when(F.col("stated_roubles").isNotNull(), 1.0),
    })
    model = fit_unit_model(base, max_rows) if guess else None
    if model is None:
        guessed = silent.withColumns({"unit_source": F.lit("review"), "unit_confidence": F.lit(None).cast("double")})
    else:
        parts = F.split("predicted_class", "/")
        sure = F.coalesce((F.col("unit_confidence") >= confident) & (F.col("predicted_class") != "?"), F.lit(False))
        guessed = model.predict(silent).withColumns({
            "unit_source": F.when(sure, "predicted").otherwise("review"),
            "stated_dim": F.when(sure, F.get(parts, F.lit(0))),
            "stated_amount": F.when(sure, F.get(parts, F.lit(1)).try_cast("double")),
        }).drop("predicted_class")
    df = known.unionByName(guessed)
    whole = F.col("stated_dim") == "whole"
    dim = F.when(whole, F.col("contents_dim")).otherwise(F.col("stated_dim"))
    amount = F.when(whole, F.col("contents_total")).otherwise(F.col("stated_amount"))
    scale = F.when(dim == "pcs", 1.0).otherwise(1000.0)
    unit_price = F.try_divide(F.col("stated_roubles") * scale, amount)
    return df.select(
        "tag_id", "shelf_ref", "regular_price", "contents_dim", "contents_total", "unit_source", "unit_confidence",
        F.when(unit_price.isNotNull(), dim).alias("price_dim"), unit_price.alias("unit_price"),
    )


def same_price_in_other_units(converted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pairs of tags of one shelf place whose recorded prices differ but whose unit prices agree.

    Unit prices are binned on a logarithmic scale, so that a tag meets only the tags of
    its own and the next bin: a hot shelf place emits no pair that is far from agreeing.
    Only units that the tags state themselves count.
    """
    rows = converted.where((F.col("unit_source") == "stated") & F.col("shelf_ref").isNotNull() & (F.col("unit_price") > 0))
    # a bin is wide enough that two prices within the tolerance lie in one or in neighbouring ones
    step = -math.log(1.0 - tolerance) * 1.001
    rows = rows.select("tag_id", "shelf_ref", "price_dim", "regular_price", "unit_price", F.floor(F.log("unit_price") / step).alias("bin"))
    left = rows.select(*[F.col(c).alias(f"{c}_a" if c in ("tag_id", "regular_price", "unit_price") else c) for c in rows.columns])
    left = left.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    right = rows.select(*[F.col(c).alias(f"{c}_b" if c in ("tag_id", "regular_price", "unit_price") else c) for c in rows.columns])
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(a, b)
    return left.join(right, ["shelf_ref", "price_dim", "bin"]).where(
        (F.col("tag_id_a") < F.col("tag_id_b")) & far("regular_price_a", "regular_price_b") & ~far("unit_price_a", "unit_price_b")
    ).select("tag_id_a", "tag_id_b")


def unit_report(converted: DataFrame) -> DataFrame:
    """How many tags went each way, by unit source and dimension."""
    return converted.groupBy("unit_source", "price_dim").agg(F.count("*").alias("tags"), F.avg("unit_confidence").alias("mean_confidence"))


