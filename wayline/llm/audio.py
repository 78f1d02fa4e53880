"""Audio columns: lossless 8-bit samples, polyphase resampling, log-mel filterbanks and energy segments.

``store_media`` keeps a payload as the samples of a mono 8-bit PCM WAV file in a Parquet binary column.
``store_features`` reads such files back: samples are resampled by a rational factor with a windowed-sinc
filter in polyphase form, cut into overlapped Hann windows, and turned into log-mel energies. Frame
energies are segmented with hysteresis: a segment opens at ``high`` above the median and closes below
``low``; its time span is stored. Features are stored as a list of tensors of one fixed shape, ``FRAMES`` frames
of ``MELS`` bands each, the last padded with the floor, beside the time spans that they cover. Parquet and
Spark know lists of numbers only, so ``as_tensors`` gives a column its Arrow fixed-shape-tensor type. Each file is computed by itself, so equal files give equal features
whatever else is in the batch, and long files are worked on in bounded pieces.

Defined results: a null text is empty, and an empty payload is padded to one unit of 192 bytes; silence
has no segments; repeated rows are each computed; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import blocks

RATE, UP, DOWN = 16_000, 2, 5
FFT, HOP, MELS, FRAMES = 512, 256, 16, 32
UNIT = 192
#: Output samples that are resampled and framed together.
PIECE_FRAMES = 2048
MEDIA = "doc_id long, n_bytes long, media binary"
STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, begin_s array<double>, end_s array<double>, segment_begin_s array<double>, segment_end_s array<double>, features array<array<float>>"
#: Files whose features leave a worker together.
BATCH_ROWS = 512


def wav_header(samples: int, rate: int = RATE) -> bytes:
    """The 44 bytes before the samples of a mono 8-bit PCM file. The sizes wrap at 4 GiB as the format's fields do."""
    size = lambda n, b=4: (n % 256**b).to_bytes(b, "little")
    return b"RIFF" + size(36 + samples) + b"WAVEfmt " + size(16) + size(1, 2) + size(1, 2) + size(rate) + size(rate) + size(1, 2) + size(8, 2) + b"data" + size(samples)


def read_wav(media: bytes) -> np.ndarray:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data":
        raise ValueError("not an 8-bit mono WAV file")
    return np.frombuffer(media, dtype=np.uint8, offset=44)


def polyphase_filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """Rows are the phases of a Hann-windowed sinc low-pass at the lower of the two Nyquist rates."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    taps = np.sinc(t / wide) / wide * up * (0.5 + 0.5 * np.cos(np.pi * t / (half * wide + 1)))
    taps = np.concatenate([taps, np.zeros(-len(taps) % up)])
    return taps.reshape(-1, up).T.astype(np.float32)


_PHASES = polyphase_filter(UP, DOWN)
_WINDOW = np.hanning(FFT + 1)[:-1].astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)
    rise = (f[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - f[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_BANK = _mel_bank(RATE * UP / DOWN)
_FLOOR = np.float32(np.log(1e-6))


def resample(x: np.ndarray, first: int, count: int) -> np.ndarray:
    """Output samples first .. first+count of ``x`` at UP/DOWN times its rate; each output uses one phase of the filter."""
    taps = _PHASES.shape[1]
    delay = (taps * UP - 1) // 2
    at = np.arange(first, first + count) * DOWN + delay
    phase, newest = at % UP, at // UP
    low = int(newest[0]) - taps + 1 if count else 0
    high = int(newest[-1]) + 1 if count else 0
    part = np.zeros(high - low, dtype=np.float32)
    a, b = max(low, 0), min(high, len(x))
    if a < b:
        part[a - low : b - low] = x[a:b]
    out = np.empty(count, dtype=np.float32)
    rows = np.lib.stride_tricks.sliding_window_view(part, taps)
    for p in range(UP):
        own = np.flatnonzero(phase == p)
        out[own] = rows[newest[own] - low - taps + 1] @ _PHASES[p][::-1]
    return out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """A row of MELS log energies for each frame of the resampled signal, every one of which is in some frame."""
    x = (samples.astype(np.float32) - 128) / 128
    length = -(-len(x) * UP // DOWN)
    number = max(1, -(-length // HOP))
    out = np.empty((number, MELS), dtype=np.float32)
    for i in range(0, number, PIECE_FRAMES):
        n = min(PIECE_FRAMES, number - i)
        y = resample(x, i * HOP, (n - 1) * HOP + FFT)
        frames = np.lib.stride_tricks.sliding_window_view(y, FFT)[::HOP] * _WINDOW
        out[i : i + n] = np.log(np.maximum(np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2 @ _BANK, 1e-6))
    return out


def segments(energy: np.ndarray, high: float = 0.5, low: float = 0.1) -> list[tuple[int, int]]:
    """Spans of frames (first, end) that rise to ``high`` above the median energy and last until it falls below ``low``."""
    level = energy - np.median(energy)
    loud, quiet = level >= high, level < low
    state = np.where(loud, 1, np.where(quiet, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def describe(mel: np.ndarray) -> str:
    """Frames, segments, segment frames and a digest of the features to a tenth of a neper."""
    spans = segments(mel.mean(axis=1))
    digest = hashlib.sha256(np.round(mel * 10).astype("<i2").tobytes()).hexdigest()[:16]
    return f"{len(mel)}x{MELS};{len(spans)};{sum(b - a for a, b in spans)};{digest}"


def _pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            media, sizes = [], np.diff(block.bounds)
            for i in range(len(block)):
                text = block.text(i)
                padded = text + b" " * ((-len(text)) % UNIT or (UNIT if not text else 0))
                media.append(wav_header(len(padded)) + padded)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(sizes), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame, path: str) -> None:
    """Writes each text of ``docs`` (doc_id, text) as a WAV file in a row: doc_id, n_bytes (unpadded), media."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs.mapInArrow(_pad, MEDIA).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def _seconds(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """When spans of frames begin and when their last frames end."""
    second = RATE * UP / DOWN
    return first * HOP / second, ((end - 1) * HOP + FFT) / second


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(begin, BATCH_ROWS)
            rows, spans, values = [], [], []
            for media in part.column(2):
                media = media.as_buffer()
                samples = read_wav(memoryview(media))
                payload, mel = samples.tobytes(), log_mel(samples)
                number = -(-len(mel) // FRAMES)
                full = np.full((number * FRAMES, MELS), _FLOOR, dtype=np.float32)
                full[: len(mel)] = mel
                first = np.arange(number) * FRAMES
                loud = np.array(segments(mel.mean(axis=1)), dtype=np.float64).reshape(-1, 2)
                spans.append((*_seconds(first, np.minimum(first + FRAMES, len(mel))), *_seconds(loud[:, 0], loud[:, 1])))
                values.append(full.ravel())
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(mel)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            plain = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)]
            lists = [pa.array([x[k] for x in spans], type=pa.list_(pa.float64())) for k in range(4)]
            flat = np.concatenate(values)
            tensors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FRAMES * MELS, dtype=np.int32)), pa.array(flat))
            offsets = np.concatenate([[0], np.cumsum([len(v) // (FRAMES * MELS) for v in values])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *plain, *lists, pa.ListArray.from_arrays(pa.array(offsets), tensors)], names=[f.split()[0] for f in STORED.split(", ")])


def store_features(media: DataFrame, path: str) -> None:
    """Reads stored media and writes, a row a file, digests of what it read, its tensors and segments with their time spans."""
    media.select("doc_id", "n_bytes", "media").mapInArrow(_analyse, STORED).write.option("compression", "zstd").parquet(path)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frames, lists = batch.column(1).to_pylist(), batch.column(2)
        values, at, out = lists.flatten().flatten().to_numpy(zero_copy_only=False), 0, []
        for n, number in zip(frames, lists.value_lengths().to_pylist()):
            size = number * FRAMES * MELS
            out.append(describe(values[at : at + size].reshape(-1, MELS)[:n]))
            at += size
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out, type=pa.string())], names=[*batch.schema.names[3:], "feature"])


def media_digests(features: DataFrame) -> DataFrame:
    """What the stored files hold, row by row, with a description of their stored features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    schema = ", ".join(f for f in STORED.split(", ") if f.split()[0] in names) + ", feature string"
    return features.select(F.col("doc_id").alias("id"), "frames", "features", *names).mapInArrow(_describe, schema)


def feature_tensors(features: DataFrame) -> DataFrame:
    """doc_id, tensor number, begin_s, end_s and FRAMES x MELS features: a row a tensor of stored features."""
    rows = features.select("doc_id", F.posexplode(F.arrays_zip("begin_s", "end_s", "features")).alias("tensor", "x"))
    return rows.select("doc_id", "tensor", "x.begin_s", "x.end_s", "x.features")


def segment_spans(features: DataFrame) -> DataFrame:
    """doc_id, segment number, begin_s and end_s: a row a segment of stored features; a file without segments has none."""
    rows = features.select("doc_id", F.posexplode(F.arrays_zip("segment_begin_s", "segment_end_s")).alias("segment", "x"))
    return rows.select("doc_id", "segment", F.col("x.segment_begin_s").alias("begin_s"), F.col("x.segment_end_s").alias("end_s"))


def as_tensors(rows: pa.Table) -> pa.Table:
    """The features column of Arrow rows as a fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    column = rows.column("features").combine_chunks()
    flat = pa.FixedSizeListArray.from_arrays(column.flatten(), FRAMES * MELS)
    return rows.set_column(rows.schema.get_field_index("features"), pa.field("features", kind), pa.ExtensionArray.from_storage(kind, flat))
