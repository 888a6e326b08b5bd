"""Record types of the speech pipeline and its error codes."""

from __future__ import annotations

from pyspark.sql import types as T

#: Samples a second, and nanoseconds a second.
SAMPLE_RATE, NS = 16_000, 1_000_000_000

PCM_CHUNK = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("source_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_ns", T.DecimalType(20, 0), True),
        T.StructField("samples", T.ArrayType(T.FloatType(), False), False),
    ]
)
COMMAND = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("cmd_seq", T.LongType(), False),
        T.StructField("cmd", T.StringType(), False),
        T.StructField("source_id", T.LongType(), True),
        T.StructField("ts_ns", T.LongType(), True),
        T.StructField("samples", T.ArrayType(T.FloatType()), True),
    ]
)
SPEECH_CHUNK = T.StructType(
    [
        T.StructField("source_id", T.LongType(), False),
        T.StructField("start_sample", T.LongType(), False),
        T.StructField("end_sample", T.LongType(), False),
        T.StructField("samples", T.ArrayType(T.FloatType(), False), False),
    ]
)
SEGMENT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("source_id", T.LongType(), False),
        T.StructField("speaker_id", T.LongType(), True),
        T.StructField("text", T.StringType(), False),
        T.StructField("start_ns", T.LongType(), False),
        T.StructField("end_ns", T.LongType(), False),
        T.StructField("inference_ns", T.LongType(), False),
        T.StructField("is_final", T.BooleanType(), False),
    ]
)
#: Error codes.
ERRORS = (
    "invalid_config",
    "device_unavailable",
    "model_load",
    "vad",
    "backend",
    "source_limit",
    "source_not_found",
    "invalid_timestamp",
    "timestamp_discontinuity",
    "stream_closed",
)
