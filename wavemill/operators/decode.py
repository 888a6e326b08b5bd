"""Vocabularies, the transducer's greedy decode, and models in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavemill.functions.tokens import PER_FRAME
from wavemill.operators import scan

#: Names of the blank token.
BLANKS = ("<blank>", "<blk>")


class AsrModel(Protocol):
    def transcribe(self, audio: list[np.ndarray]) -> list[str]: ...


class FakeModel:
    """A stand-in whose text states what it was given: length and sign of the sum."""

    def transcribe(self, audio: list[np.ndarray]) -> list[str]:
        return [f"n{len(x)} {'pos' if float(np.sum(x, dtype=np.float64)) > 0 else 'neg'}" for x in audio]


class BackendError(RuntimeError):
    code = "backend"


#: Layers and size of the decoder's states; frames of a bucket of lengths.
STATE, BUCKET = (2, 1, 640), 64


def padded(features: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """[mel, frame] features as [1, mel, width], zeros up to a whole number of buckets, so
    that a graph meets few widths."""
    width = max(1, -(-features.shape[1] // bucket)) * bucket
    return np.pad(features.astype(np.float32), ((0, 0), (0, width - features.shape[1])))[None]


def run_encoder(run: Callable[[dict], dict], features: np.ndarray, valid: int, bucket: int = BUCKET) -> np.ndarray:
    """The encoder's frames [size, length] for [mel, frame] features, ``valid`` of them real.

    ``run`` takes the graph's inputs and gives its outputs by name. What comes back
    is checked in a fixed order: both outputs, three dimensions, a batch of one,
    as many values as the shape says, one length, neither negative nor beyond the
    frames.
    """
    out = run({"audio_signal": padded(features, bucket), "length": np.array([valid], np.int64)})
    for name in ("outputs", "encoded_lengths"):
        if out.get(name) is None:
            raise BackendError(f"the encoder gave no {name}")
    encoded, lengths = np.asarray(out["outputs"]), np.asarray(out["encoded_lengths"])
    if encoded.ndim != 3:
        raise BackendError(f"encoder output of shape {encoded.shape}; three dimensions are expected")
    if encoded.shape[0] != 1:
        raise BackendError(f"an encoder batch of {encoded.shape[0]}; one is expected")
    if lengths.shape != (1,):
        raise BackendError(f"encoder lengths of shape {lengths.shape}; one is expected")
    length = int(lengths[0])
    if length < 0:
        raise BackendError(f"an encoder length of {length}")
    if length > encoded.shape[2]:
        raise BackendError(f"an encoder length of {length} in {encoded.shape[2]} frames")
    return encoded[0, :, :length]


def providers(device: str) -> list[str]:
    """Execution providers in the order of preference: the device's own, which must
    register, then the processor; TensorRT falls back to CUDA first."""
    own = PROVIDERS.get(device)
    if device == "auto":
        return [f"{PROVIDERS[d]}ExecutionProvider" for d in AUTO] + ["CPUExecutionProvider"]
    if device == "tensorrt":
        return ["TensorrtExecutionProvider", "CUDAExecutionProvider", "CPUExecutionProvider"]
    return ([f"{own}ExecutionProvider"] if own else []) + ["CPUExecutionProvider"]


#: Provider names of devices, and the order in which auto tries them.
PROVIDERS = {"directml": "Dml", "cuda": "CUDA", "tensorrt": "Tensorrt", "openvino": "OpenVINO", "qnn": "QNN", "vitis": "VitisAI", "nvrtx": "NvTensorRtRtx", "webgpu": "WebGPU", "tvm": "Tvm", "xnnpack": "Xnnpack", "onednn": "Dnnl"}
AUTO = ("nvrtx", "tensorrt", "cuda", "qnn", "vitis", "openvino", "directml", "webgpu", "onednn")


class OnnxTransducer:
    """A converted model's two graphs behind the interface of ``recognise``: ``encoder``
    and ``joint_graph`` take inputs and give outputs by name, as ``sessions`` makes
    them from files. The state is the pair of arrays that the decoder hands on."""

    def __init__(self, encoder: Callable[[dict], dict], joint_graph: Callable[[dict], dict], size: int):
        self.encoder, self.joint_graph, self.size = encoder, joint_graph, size
        self.state = (np.zeros(STATE, np.float32), np.zeros(STATE, np.float32))

    @staticmethod
    def sessions(paths: list[str], device: str = "cpu", threads: int = 4) -> list[Callable[[dict], dict]]:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
        found = [p for p in providers(device) if device != "auto" or p in ort.get_available_providers()]
        if found[0] not in ort.get_available_providers():
            raise BackendError(f"{device} is not available")

        def runner(session) -> Callable[[dict], dict]:
            names = [o.name for o in session.get_outputs()]
            return lambda inputs: dict(zip(names, session.run(names, inputs)))

        return [runner(ort.InferenceSession(p, options, providers=found)) for p in paths]

    def encode(self, features: np.ndarray) -> np.ndarray:
        """[frame, mel] features, whose last frame is the tail, to [size, length]."""
        x = np.asarray(features, np.float32).reshape(len(features), -1).T
        return run_encoder(self.encoder, x, x.shape[1] - 1) if x.size else np.zeros((1, 0), np.float32)

    def joint(self, frame: np.ndarray, previous: int, state: tuple) -> tuple[np.ndarray, tuple]:
        out = self.joint_graph({"encoder_outputs": frame.astype(np.float32)[None, :, None], "targets": np.array([[previous]], np.int32), "target_length": np.array([1], np.int32), "input_states_1": state[0], "input_states_2": state[1]})
        logits = np.asarray(out["outputs"]).ravel()
        if len(logits) < self.size + 1:
            raise BackendError(f"{len(logits)} logits for {self.size} tokens and a duration")
        following = tuple(np.asarray(out[n]) for n in ("output_states_1", "output_states_2"))
        for x in following:
            if x.shape != STATE:
                raise BackendError(f"a state of shape {x.shape}; {STATE} is expected")
        return logits, following


def transcribe(segments: DataFrame, model: Callable[[], AsrModel], samples: str = "samples") -> DataFrame:
    """``segments`` with a ``text`` column instead of samples; empty ones are left
    out first. The model is made once per task and called once per batch."""
    kept = [c for c in segments.columns if c != samples]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema if f.name != samples) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model()
        for b in batches:
            audio = [np.array(x, np.float32) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made.transcribe(audio) if audio else [], pa.string())], [*kept, "text"])

    return segments.where(F.size(samples) > 0).select(*kept, samples).mapInArrow(run, schema)


def greedy_decode(joint: Callable, encoded: np.ndarray, length: int, vocabulary: int, state) -> list[int]:
    """Token-and-duration transducer decode of one utterance.

    ``joint(frame, previous, state)`` gives logits and the next state, taken over
    only with a token that is not blank. Of equal logits the last wins.
    """
    blank, previous, out, t, emitted = vocabulary - 1, vocabulary - 1, [], 0, 0
    last = lambda v: len(v) - 1 - int(np.argmax(v[::-1]))
    while t < length:
        logits, following = joint(encoded[:, t], previous, state)
        token, skip = last(logits[:vocabulary]), last(logits[vocabulary:])
        if token != blank:
            state, previous = following, token
            out.append(token)
            emitted += 1
        if skip > 0:
            t, emitted = t + skip, 0
        elif token == blank or emitted >= PER_FRAME:
            t, emitted = t + 1, 0
    return out


class FakeTransducer:
    """A stand-in for an encoder and a joint network on whole numbers: every eighth
    sample is a frame; token, duration and next state follow from the frame, the
    previous token and the state."""

    size, durations, state = 28, 3, 0

    def encode(self, samples: np.ndarray) -> np.ndarray:
        return np.floor(1024 * np.asarray(samples, np.float64)[::8])[None] % 97

    def joint(self, frame: np.ndarray, previous: int, state: int) -> tuple[np.ndarray, int]:
        x, logits = int(frame[0]), np.zeros(self.size + self.durations)
        logits[[(x + 3 * previous + 5 * state) % self.size, self.size + (x + previous + state) % self.durations]] = 1
        return logits, (2 * state + x + 1) % 7


class FeatureTransducer(FakeTransducer):
    """The stand-in on [frame, mel] features: a whole number of each valid frame."""

    def encode(self, features: np.ndarray) -> np.ndarray:
        valid = np.asarray(features, np.float64).reshape(len(features), -1)[:-1]  # the last frame is the tail
        return np.floor(valid[:, :3] @ np.array([5.0, 3.0, 7.0]))[None] % 97 if len(valid) else np.zeros((1, 0))


def recognise(utterances: DataFrame, model: Callable[[], FakeTransducer], vocabulary: list[str], samples: str = "samples") -> DataFrame:
    """``utterances`` with a ``pieces`` column instead of samples: encoder, greedy
    decode with the model's state, and vocabulary look-up, which skips ids that the
    vocabulary lacks. Empty utterances have no pieces. The model, made once per
    task, has encode, joint, size (of its tokens, the last one blank) and state."""
    kept = [c for c in utterances.columns if c != samples]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in utterances.schema if f.name != samples) + ", pieces array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model()
        for b in batches:
            said = []
            for x in b.column(len(kept)).to_pylist():
                encoded = made.encode(np.array(x or [], np.float64))
                ids = greedy_decode(made.joint, encoded, encoded.shape[1], made.size, made.state)
                said.append([vocabulary[i] for i in ids if i < len(vocabulary)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, pa.list_(pa.string()))], [*kept, "pieces"])

    return utterances.select(*kept, samples).mapInArrow(run, schema)


def _visits(longest: int):
    def run(batch: pa.RecordBatch, base: int) -> Iterator[pa.RecordBatch]:
        begin, n = scan.starts(batch.column(0)), batch.num_rows
        frame, dur = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
        if int(dur.max()) > longest:
            raise ValueError(f"a duration of {int(dur.max())} frames; the longest is {longest}")
        mask, exits = scan.jumps(begin, frame, np.maximum(dur, 1), longest)
        ends = np.append(begin[1:], n) - 1
        last = np.zeros(n, bool)
        last[ends] = True
        at = np.cumsum(last) - last
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(last))) * longest, pa.int32()), pa.array(exits.ravel()))
        added = [pa.array(np.full(n, base)), pa.array(mask), pa.array(last), pa.array(frame[begin][at]), lists]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "piece", "mask", "last", "first", "exits"])

    return run


def transducer_steps(steps: DataFrame, blank: int, by: str = "source_id", longest: int = 4) -> DataFrame:
    """The greedy walk over ``steps(by, frame, token, dur)`` of precomputed decisions ->
    ``(by, frame, token, n)``, n the tokens that a visited frame emits.

    The walk starts at frame 0. A positive duration, ``longest`` at most, moves on
    by it; otherwise blank, or the last token a frame may emit, moves on by one.
    It ends where a frame is missing. Pieces of a source are walked from all
    entries at once, so a source of any length spreads over tasks.
    """
    rows = steps.select(by, *[F.col(c).cast("long").alias(c) for c in ("frame", "token", "dur")])
    parts = scan.pieces(rows, by, ["frame"], _visits(longest), "piece long, mask long, last boolean, first long, exits array<long>")

    def enter(t: int, row: list) -> tuple[int | None, int]:
        first, end, exits = row
        if t > end or t == scan.DEAD:
            return None, t
        return (t - first, exits[t - first]) if 0 <= t - first < longest else (None, scan.DEAD)

    entries = scan.entered(parts.where("last").select(by, "piece", "first", "frame", "exits"), by, 0, enter)
    seen = parts.join(entries.where("entry is not null"), [by, "piece"]).where(f"token <> {blank} AND (shiftright(mask, CAST(entry AS INT)) & 1) = 1")
    return seen.select(by, "frame", "token", F.when(F.col("dur") > 0, 1).otherwise(PER_FRAME).cast("long").alias("n"))


def spaces_mode(vocabulary: list[str]) -> bool:
    """Whether word marks are spaces: so they are in vocabularies of many languages."""
    return "<|en|>" in vocabulary


#: File names of the models, in order of preference.
ENCODERS = ("encoder.onnx", "encoder-model.onnx", "encoder-model.int8.onnx")
DECODERS = ("decoder_joint.onnx", "decoder_joint-model.onnx", "decoder_joint-model.int8.onnx", "decoder-model.onnx")


def find_model_files(files: DataFrame, by: str = "dir", name: str = "name") -> DataFrame:
    """``files(by, name)`` -> per folder its encoder, decoder and error text: the first
    that a list prefers, or what is missing first."""
    found = {kind: F.min(F.when(F.array_position(F.array(*map(F.lit, names)), F.col(name)) > 0, F.array_position(F.array(*map(F.lit, names)), F.col(name)))) for kind, names in (("encoder", ENCODERS), ("decoder_joint", DECODERS))}
    out = files.groupBy(by).agg(*[c.alias(k) for k, c in found.items()])
    missing = F.coalesce(*[F.when(F.col(k).isNull(), F.concat(F.lit(f"No {k} model found in "), F.col(by).cast("string"))) for k in found])
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.col(k) - 1).cast("int")).alias(k)
    return out.select(by, pick(ENCODERS, "encoder"), pick(DECODERS, "decoder_joint"), missing.alias("error"))


def parse_vocabulary(lines: DataFrame, text: str = "line", number: str | None = None) -> DataFrame:
    """Lines ``token id``, split at the last space -> with number, token, token_id and
    error: missing_id, empty_token, bad_id (no unsigned 64-bit number), or null. An
    empty line, and only that, is ``skipped``. ``number`` names the line numbers."""
    pattern = "(?s)^(.*) ([^ ]*)$"
    x = lines.withColumn("number", F.col(number) if number else F.monotonically_increasing_id())
    x = x.withColumns({"skipped": F.col(text) == "", "split": F.col(text).rlike(pattern), "token": F.regexp_extract(text, pattern, 1), "digits": F.regexp_extract(text, pattern, 2)})
    value = F.expr("try_cast(regexp_replace(digits, '^[+]?0*(?=[0-9])', '') as decimal(38,0))")
    x = x.withColumn("token_id", F.when(F.col("digits").rlike("^[+]?[0-9]+$") & (value <= F.lit("18446744073709551615").cast("decimal(38,0)")), value))
    error = F.when(F.col("skipped"), None).when(~F.col("split"), "missing_id").when(F.col("token") == "", "empty_token").when(F.col("token_id").isNull(), "bad_id")
    return x.withColumn("error", error).drop("split", "digits")


def vocabulary_errors(parsed: DataFrame, by: str | None = None) -> DataFrame:
    """The error of each vocabulary (``by``): that of the first bad line; else empty;
    else what breaks the run of ids 0, 1, 2 first (duplicate_id or gap); else
    blank_not_last, if the first blank is not the last token; or ok."""
    group = [by] if by else []
    entry = ~F.col("skipped") & F.col("error").isNull()
    place = F.row_number().over(W.partitionBy(*group, entry).orderBy("token_id", "number")) - 1  # a vocabulary is small
    x = parsed.withColumn("entry", entry).withColumn("place", F.when(entry, place))
    broken = F.when(F.col("token_id") < F.col("place"), "duplicate_id").when(F.col("token_id") > F.col("place"), "gap")
    agg = x.withColumn("broken", broken).groupBy(*group).agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("number", "error")))["error"].alias("line"),
        F.count(F.when(F.col("entry"), 1)).alias("n"),
        F.min(F.when(F.col("broken").isNotNull(), F.struct("place", "broken")))["broken"].alias("ids"),
        F.min(F.when(F.col("entry") & F.col("token").isin(*BLANKS), F.col("place"))).alias("blank"),
    )
    kind = F.coalesce("line", F.when(F.col("n") == 0, "empty"), "ids", F.when(F.col("blank") + 1 != F.col("n"), "blank_not_last"), F.lit("ok"))
    return agg.select(*group, kind.alias("result"))
