import io
import wave

import numpy as np

from orthoscan.functions import media
from orthoscan.sources import files


def wav(y, rate=22050, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_features():
    t = np.arange(5 * 22050) / 22050
    tone = dict(zip(media.AUDIO_NAMES, media.audio_features(media.decode_wav(wav(0.5 * np.sin(2 * np.pi * 1000 * t)))), strict=True))
    assert abs(tone["spectral_centroid_mean"] - 1000) < 60 and abs(tone["rms_mean"] - 0.5 / 2**0.5) < 0.02
    assert abs(tone["zero_crossing_rate_mean"] - 2000 / 22050) < 0.005 and tone["harmony_var"] > 50 * tone["perceptr_var"]
    clicks = np.zeros_like(t)
    clicks[:: 22050 // 2] = 1
    beat = dict(zip(media.AUDIO_NAMES, media.audio_features(clicks), strict=True))
    assert min(abs(beat["tempo"] - b) for b in (60, 120, 240)) < 6 and beat["perceptr_var"] > beat["harmony_var"]
    assert media.audio_features(np.zeros(0)) == [0.0] * 30
    assert len(media.decode_wav(wav(np.zeros(2 * 44100 * 40), 44100, 2))) == 30 * 22050


def test_extract_through_spark(spark, tmp_path):
    (tmp_path / "blues").mkdir()
    (tmp_path / "blues" / "a.wav").write_bytes(wav(np.sin(np.arange(22050) / 9)))
    (tmp_path / "blues" / "b.wav").write_bytes(b"no audio")
    rows = files.extract_features(files.media_files(spark, str(tmp_path), "*.wav"), media.extract_audio, 30).orderBy("path").collect()
    assert len(rows[0].features) == 30 and any(rows[0].features) and rows[1].features == [0.0] * 30


def test_image_features():
    pixels = np.arange(42 * 40 * 3, dtype=np.uint8).reshape(42, 40, 3)
    got = media.extract_images([b"P6\n40 42\n255\n" + pixels.tobytes(), b"junk"])
    assert len(got[0]) == 1280 and got[1] is None
    assert np.allclose(np.array(got[0][:1260]).reshape(21, 20, 3), pixels[::2, ::2] / 255) and not any(got[0][1260:])
