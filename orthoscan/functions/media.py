"""Features of decoded audio and images, for ``sources.files.extract_features``.

Small numpy helpers for one file each; Spark reads and distributes the files.
"""

from __future__ import annotations

import io
import wave

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

RATE, SECONDS = 22_050, 30
FRAME, HOP, MELS, CEPSTRA = 2048, 512, 40, 13
ROLLOFF, HARMONIC_SPAN = 0.85, 17
#: Names in the order of ``audio_features`` (fixed values).
AUDIO_NAMES = (
    ["tempo", "chroma_stft_mean", "chroma_stft_var", "rms_mean", "rms_var", "spectral_centroid_mean", "spectral_centroid_var"]
    + ["spectral_bandwidth_mean", "spectral_bandwidth_var", "rolloff_mean", "rolloff_var", "zero_crossing_rate_mean", "zero_crossing_rate_var"]
    + ["harmony_mean", "harmony_var", "perceptr_mean", "perceptr_var"]
    + [f"mfcc{i}_mean" for i in range(1, 14)]
)
IMAGE_SHAPE, IMAGE_DIMS = (21, 20), 1280


def decode_wav(content: bytes, rate: int = RATE, seconds: int = SECONDS) -> np.ndarray:
    """The first ``seconds`` of a PCM file as mono samples in [-1, 1] at ``rate``."""
    with wave.open(io.BytesIO(content)) as f:
        own, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
        data = f.readframes(own * seconds)
    if width == 1:
        y = np.frombuffer(data, dtype=np.uint8).astype(float) / 128 - 1
    elif width in (2, 4):
        y = np.frombuffer(data, dtype=f"<i{width}") / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width}-bit samples")
    y = y[: len(y) // channels * channels].reshape(-1, channels).mean(axis=1)
    if own == rate or not len(y):
        return y
    return np.interp(np.arange(int(len(y) * rate / own)) * own / rate, np.arange(len(y)), y)


def _spectra(y: np.ndarray) -> np.ndarray:
    frames = sliding_window_view(np.pad(y, FRAME // 2), FRAME)[::HOP]
    return np.fft.rfft(frames * np.hanning(FRAME), axis=1)


def _mel_filters(rate: int) -> np.ndarray:
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def _median(x: np.ndarray, axis: int) -> np.ndarray:
    half = HARMONIC_SPAN // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (half, half)
    windows = sliding_window_view(np.pad(x, pad, mode="edge"), HARMONIC_SPAN, axis=axis)
    return np.concatenate([np.median(part, axis=-1) for part in np.array_split(windows, max(1, len(windows) // 64))])


def _signal(spectra: np.ndarray, n: int) -> np.ndarray:
    """Overlap-add of the inverse spectra."""
    window, out, weight = np.hanning(FRAME), np.zeros(len(spectra) * HOP + FRAME), np.full(len(spectra) * HOP + FRAME, 1e-9)
    for i, frame in enumerate(np.fft.irfft(spectra, FRAME, axis=1)):
        out[i * HOP : i * HOP + FRAME] += frame * window
        weight[i * HOP : i * HOP + FRAME] += window**2
    return (out / weight)[FRAME // 2 : FRAME // 2 + n]


def _tempo(power: np.ndarray, rate: int) -> float:
    """Beats a minute from the autocorrelation of rises in energy, between 40 and 240."""
    rises = np.maximum(0, np.diff(np.log1p(power).sum(axis=1)))
    lags = np.arange(int(60 * rate / HOP / 240), int(60 * rate / HOP / 40))
    lags = lags[lags < len(rises) - 1]
    if not len(lags) or not rises.any():
        return 0.0
    rises = rises - rises.mean()
    strength = [(rises[k:] * rises[:-k]).mean() for k in lags]
    return float(60 * rate / HOP / lags[int(np.argmax(strength))])


def audio_features(y: np.ndarray, rate: int = RATE) -> list[float]:
    """AUDIO_NAMES of a mono signal; an empty one gives zeros."""
    if not len(y):
        return [0.0] * len(AUDIO_NAMES)
    spectra = _spectra(y)
    size, bins = np.abs(spectra), np.fft.rfftfreq(FRAME, 1 / rate)
    total = size.sum(axis=1) + 1e-12
    pitch = np.round(12 * np.log2(np.maximum(bins, 1e-9) / 440)).astype(int) % 12
    chroma = np.stack([(size[:, (pitch == p) & (bins > 20)] ** 2).sum(axis=1) for p in range(12)])
    chroma = chroma / (chroma.max(axis=0) + 1e-12)
    frames = sliding_window_view(np.pad(y, FRAME // 2), FRAME)[::HOP]
    rms = np.sqrt((frames**2).mean(axis=1))
    centroid = (size * bins).sum(axis=1) / total
    bandwidth = np.sqrt((size * (bins - centroid[:, None]) ** 2).sum(axis=1) / total)
    rolloff = bins[np.minimum((np.cumsum(size, axis=1) < ROLLOFF * total[:, None]).sum(axis=1), len(bins) - 1)]
    crossings = (np.diff(np.signbit(frames), axis=1)).mean(axis=1)
    steady, sudden = _median(size, 0), _median(size, 1)
    share = steady**2 / (steady**2 + sudden**2 + 1e-12)
    harmony, percussion = _signal(spectra * share, len(y)), _signal(spectra * (1 - share), len(y))
    decibel = 10 * np.log10(np.maximum(size**2 @ _mel_filters(rate).T, 1e-10))
    turn = np.cos(np.pi * np.arange(CEPSTRA)[:, None] * (np.arange(MELS) + 0.5) / MELS) * np.sqrt(2 / MELS)
    turn[0] /= np.sqrt(2)
    cepstra = (decibel @ turn.T).mean(axis=0)
    pairs = [f(x) for x in (chroma, rms, centroid, bandwidth, rolloff, crossings, harmony, percussion) for f in (np.mean, np.var)]
    return [_tempo(size**2, rate), *map(float, pairs), *map(float, cepstra)]


def extract_audio(contents: list[bytes]) -> list[list[float] | None]:
    """For ``extract_features``: 30 features of each PCM file, None where it can't be read."""
    out: list[list[float] | None] = []
    for content in contents:
        try:
            out.append(audio_features(decode_wav(content)))
        except (wave.Error, EOFError, ValueError):
            out.append(None)
    return out


def decode_ppm(content: bytes) -> np.ndarray:
    """Rows of RGB pixels of a binary PPM image with 8 bits a channel."""
    fields = content.split(maxsplit=4)
    if fields[0] != b"P6" or int(fields[3]) != 255:
        raise ValueError("not an 8-bit P6 image")
    width, height = int(fields[1]), int(fields[2])
    return np.frombuffer(content[-3 * width * height :], dtype=np.uint8).reshape(height, width, 3)


def image_features(pixels: np.ndarray) -> list[float]:
    """The image at 20 by 21 pixels, scaled to [0, 1], padded with zeros to 1280 values; the fallback without a network."""
    rows, cols = (np.arange(n) * size // n for n, size in zip(IMAGE_SHAPE, pixels.shape[:2], strict=True))
    flat = pixels[rows][:, cols].astype(float).reshape(-1) / 255
    return np.pad(flat, (0, IMAGE_DIMS - len(flat))).tolist()


def extract_images(contents: list[bytes], decode=decode_ppm) -> list[list[float] | None]:
    """For ``extract_features``: fallback features of each image, None where ``decode`` fails."""
    out: list[list[float] | None] = []
    for content in contents:
        try:
            out.append(image_features(decode(content)))
        except (ValueError, IndexError):
            out.append(None)
    return out
