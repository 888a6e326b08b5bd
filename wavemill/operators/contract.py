"""The contract of a recogniser's two graphs, checked over tables of their outlets.

``tensors(model, location, name, dtype, shape)`` lists what each graph declares, -1 in a
shape standing for a dynamic dimension. Rules are checked in a fixed order and
the first broken one is reported. A symbol that stands in several outlets binds
to one value: dynamic dimensions take that of the static ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers and size of the decoder's states.
LAYERS, SIZE = 2, 640
#: Fixed values, in the order of checks: place among all checks, location, name,
#: element type, rank, and required sizes by index.
OUTLETS = (
    (0, "encoder input", "audio_signal", "f32", 3, {0: 1}),
    (1, "encoder input", "length", "i64", 1, {0: 1}),
    (2, "encoder output", "outputs", "f32", 3, {0: 1}),
    (3, "encoder output", "encoded_lengths", "i64", 1, {0: 1}),
    (6, "decoder input", "encoder_outputs", "f32", 3, {0: 1, 2: 1}),
    (7, "decoder input", "targets", "i32", 2, {0: 1, 1: 1}),
    (8, "decoder input", "target_length", "i32", 1, {0: 1}),
    (9, "decoder input", "input_states_1", "f32", 3, {0: LAYERS, 1: 1, 2: SIZE}),
    (10, "decoder input", "input_states_2", "f32", 3, {0: LAYERS, 1: 1, 2: SIZE}),
    (11, "decoder output", "outputs", "f32", None, {}),
    (13, "decoder output", "output_states_1", "f32", 3, {0: LAYERS, 1: 1, 2: SIZE}),
    (14, "decoder output", "output_states_2", "f32", 3, {0: LAYERS, 1: 1, 2: SIZE}),
)
#: Places of the checks that are not an outlet's own.
FEATURE, ENCODED, LOGITS, SAME = 4, 5, 12, 15
#: Where the size of an encoded frame stands: (place of the outlet, index).
FRAME_SIZE = ((2, 1), (6, 1))


def _at(shape: Column, index: int) -> Column:
    return F.get(shape, F.lit(index))


def _invalid(size: Column) -> Column:
    """Neither positive nor dynamic."""
    return (size <= 0) & (size != -1)


def check_contracts(tensors: DataFrame, vocabulary: int, by: str = "model") -> DataFrame:
    """-> ``(by, outlet, problem, feature_size, encoded_size)``, one row a model: the place
    in the order of checks of the first broken rule and its kind (missing, type,
    rank, invalid, size, dynamic_feature, scalar, several, too_small, mismatch), or nulls.

    Of outlets of one name and location the first by ``position``, or else any,
    counts. ``feature_size`` is static in a sound contract; ``encoded_size`` is the
    static size among the outlets that share it, or null where all are dynamic.
    A model without any row is not known and has none.
    """
    spark = tensors.sparkSession
    rows = [(n, location, name, kind, rank, [i for i in sizes], [s for s in sizes.values()]) for n, location, name, kind, rank, sizes in OUTLETS]
    rules = spark.createDataFrame(rows, "place int, location string, name string, kind string, rank int, at array<int>, size array<long>")
    position = F.col("position") if "position" in tensors.columns else F.lit(0)
    first = tensors.groupBy(by, "location", "name").agg(F.min_by(F.struct("dtype", "shape"), position).alias("t"))
    # left to itself, Spark sends the side that it takes for the smaller: all models
    x = first.join(F.broadcast(rules), ["location", "name"])
    bad = F.filter(F.arrays_zip("at", "size"), lambda r: _invalid(F.get("t.shape", r["at"])) | ((F.get("t.shape", r["at"]) > 0) & (F.get("t.shape", r["at"]) != r["size"])))
    kinds = (
        F.when(F.col("t.dtype") != F.col("kind"), "type")
        .when(F.col("rank").isNotNull() & (F.size("t.shape") != F.col("rank")), "rank")
        .when(F.size(bad) > 0, F.when(_invalid(F.get("t.shape", F.get(bad, F.lit(0))["at"])), "invalid").otherwise("size"))
    )
    x = x.withColumn("problem", kinds)
    shapes = {n: F.max(F.when(F.col("place") == n, F.col("t.shape"))).alias(f"shape{n}") for n in (0, 2, 6, 11)}
    own = F.min(F.when(F.col("problem").isNotNull(), F.struct("place", "problem"))).alias("own")
    found = tensors.select(by).distinct().join(x.groupBy(by).agg(own, F.collect_set("place").alias("have"), *shapes.values()), by, "left")
    places = F.array(*[F.lit(n) for n, *_ in OUTLETS])
    missing = F.array_min(F.array_except(places, F.coalesce("have", F.array().cast("array<int>"))))
    feature, encoded, expected, logits = _at(F.col("shape0"), 1), _at(F.col("shape2"), 1), _at(F.col("shape6"), 1), F.col("shape11")
    last, leading = F.element_at(F.when(F.size(logits) > 0, logits), -1), F.slice(logits, 1, F.greatest(F.size(logits) - 1, F.lit(0)))
    answer = F.when(F.size(logits) == 0, "scalar").when(F.exists(leading, lambda d: (d != 1) & (d != -1)), "several").when(_invalid(last), "invalid").when((last != -1) & (last < vocabulary + 1), "too_small")
    others = (
        (FEATURE, F.when(_invalid(feature), "invalid").when(feature == -1, "dynamic_feature")),
        (ENCODED, F.when(_invalid(encoded), "invalid")),
        (LOGITS, answer),
        # the shared size is compared only where the encoder states it
        (SAME, F.when(encoded > 0, F.when(_invalid(expected), "invalid").when((expected > 0) & (expected != encoded), "mismatch"))),
    )
    candidates = [F.col("own"), F.when(missing.isNotNull(), F.struct(missing.alias("place"), F.lit("missing").alias("problem")))]
    candidates += [F.when(kind.isNotNull(), F.struct(F.lit(n).alias("place"), kind.alias("problem"))) for n, kind in others]
    least = F.array_min(F.filter(F.array(*candidates), lambda c: c.isNotNull()))
    bound = F.coalesce(*[F.when(_at(F.col(f"shape{n}"), i) > 0, _at(F.col(f"shape{n}"), i)) for n, i in FRAME_SIZE])
    out = found.withColumn("least", least)
    sound = F.col("least").isNull()
    return out.select(by, F.col("least.place").alias("outlet"), F.col("least.problem").alias("problem"), F.when(sound, feature).alias("feature_size"), F.when(sound, bound).alias("encoded_size"))
