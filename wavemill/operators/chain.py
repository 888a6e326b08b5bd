"""Speech to text over tables of audio chunks: scores, gate, features, model, events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.config import GateConfig
from wavemill.functions import clock, tokens
from wavemill.operators import decode, events, features, gate
from wavemill.operators.blocks import halo_blocks, place, within
from wavemill.store import cut


def mean_energy(frame: Column) -> Column:
    """A deterministic stand-in for a voice network: loudness squashed to 0..1."""
    square = F.aggregate(frame, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.least(F.lit(1.0), F.sqrt(square / F.size(frame)) * 5)


def scored_frames(placed: DataFrame, by: str, frame: int, score: Callable[[Column], Column]) -> DataFrame:
    """``(by, i, prob)`` of placed chunks: frames of ``frame`` samples wherever chunks
    end, the last one filled up with zeros."""
    blocks = halo_blocks(placed, [by], frame, 0, 0)
    filled = F.concat(F.col("samples").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(frame) - F.size("samples")))
    return blocks.select(by, F.col("block").alias("i"), score(filled).alias("prob"))


def utterances(placed: DataFrame, by: str, config: GateConfig, score: Callable[[Column], Column]) -> DataFrame:
    """The gate's segments of placed chunks: ``(by, segment, start_sample, end_sample)``."""
    totals = placed.groupBy(by).agg(F.max("total").alias("total"))
    return gate.pad_and_clamp(gate.capped_segments(scored_frames(placed, by, config.frame, score), config, by), totals, config, by)


def speech_features(chunks: DataFrame, by: str = "source_id", order: str = "seq", config: GateConfig = GateConfig(), score: Callable[[Column], Column] = mean_energy, n_mels: int = 80, placed: DataFrame | None = None) -> DataFrame:
    """Normalised log-mel blocks of each utterance in ``chunks(by, order, samples)``:
    ``(by, segment, start_sample, end_sample, block, first, features)``.

    Only samples inside gate segments reach the features. Null and empty chunks
    add nothing; a source in silence has no rows. No source and no utterance is
    held whole: all steps go by blocks of samples or rows.
    """
    placed = cut(place(chunks.select(by, order, "samples"), by, order)) if placed is None else placed
    found = cut(utterances(placed, by, config, score))
    keys = [by, "segment", "start_sample", "end_sample"]
    parts = within(found, placed, by).withColumn("total", F.col("end_sample") - F.col("start_sample"))
    return features.normalised_blocks(features.framed_blocks(parts, keys, n_mels), keys)


def speech_to_text(chunks: DataFrame, model, vocabulary: list[str], by: str = "source_id", order: str = "seq", config: GateConfig = GateConfig(), score: Callable[[Column], Column] = mean_energy, n_mels: int = 80) -> DataFrame:
    """``chunks(by, order, samples)`` -> transcript events ``(by, id, text, start_ns,
    end_ns)``: gate, features, encoder and greedy decode, text, blank filter, ids.

    An utterance's features meet in one row for the model; the gate's max_speech
    bounds it. Ids count each source's kept segments by start.
    """
    keys = [by, "segment", "start_sample", "end_sample"]
    blocks = speech_features(chunks, by, order, config, score, n_mels)
    whole = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "features"))).alias("b"))
    whole = whole.select(*keys, F.flatten(F.transform("b", lambda x: x["features"])).alias("samples"))
    said = decode.recognise(whole, model, vocabulary)
    said = said.withColumn("text", tokens.detokenise(F.col("pieces"), F.lit(decode.spaces_mode(vocabulary))))
    out = events.assign_ids(events.drop_blank(said), by, "start_sample")
    return out.select(by, "id", "text", clock.samples_to_ns(F.col("start_sample")).alias("start_ns"), clock.samples_to_ns(F.col("end_sample")).alias("end_ns"))
