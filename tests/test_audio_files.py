import io
import wave
from zipfile import ZipFile

import numpy as np
import pytest

from eventspan.sources import archive, wav


def file_of(raw, width, channels=1, sr=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(sr)
        w.writeframes(raw)
    return out.getvalue()


def test_samples_of_every_width():
    for width in (1, 2, 3, 4):
        full = 2 ** (8 * width - 1)
        values = [0, full // 2, -full // 2, full - 1, -full]
        raw = b"".join((v + 128).to_bytes(1, "little") if width == 1 else v.to_bytes(width, "little", signed=True) for v in values)
        x, sr = wav.decode(file_of(raw, width))
        assert sr == 8000
        assert np.allclose(x, np.array(values) / full, atol=1e-7)


def test_channels_are_averaged():
    raw = np.array([1000, 3000, -500, 500], dtype="<i2").tobytes()
    assert np.allclose(wav.decode(file_of(raw, 2, channels=2))[0] * 32768, [2000, 0])


@pytest.mark.parametrize("sr,to", [(8000, 44100), (44100, 8000), (16000, 32000), (44100, 16000), (48000, 44100)])
def test_a_tone_keeps_its_shape(sr, to):
    tone = lambda rate: np.sin(2 * np.pi * 440 * np.arange(rate // 2) / rate)
    y = wav.resample(tone(sr).astype(np.float32), sr, to)
    assert len(y) == -(-(sr // 2) * to // sr)
    inside = slice(to // 20, len(y) - to // 20)
    assert np.abs(y[inside] - tone(to)[: len(y)][inside]).max() < 2e-3


def test_what_the_lower_rate_cannot_hold_goes():
    x = np.sin(2 * np.pi * 7000 * np.arange(22050) / 44100).astype(np.float32)
    y = wav.resample(x, 44100, 8000)
    assert np.abs(y[400:-400]).max() < 5e-3


def test_resampling_edges():
    x = np.ones(5, dtype=np.float32)
    assert wav.resample(x, 8000, 8000) is x
    assert len(wav.resample(np.zeros(0, dtype=np.float32), 8000, 16000)) == 0
    long = np.random.default_rng(1).normal(size=3000).astype(np.float32)
    assert np.array_equal(wav.resample(long, 8000, 11025, step=100), wav.resample(long, 8000, 11025))


def test_prepared_audio():
    raw = (np.sin(np.arange(4000) / 20) * 30000).astype("<i2").tobytes()
    x, sr = wav.decode(wav.prepared(file_of(raw, 2)))
    assert sr == 44100 and len(x) == 22050


def outputs_in(folder):
    made = {}
    for key, name in {"source_audio": "source_audio.wav", "events_json": "events.json", "a": "a.WAV", "b": "sub/b.wav", "rules": "map.json"}.items():
        at = folder / name
        at.parent.mkdir(exist_ok=True)
        at.write_text(key)
        made[key] = str(at)
    return made


def test_archive_places(tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    outputs = outputs_in(run) | {"again": str(run / "a.WAV"), "gone": str(run / "gone.wav")}
    (run / "debug").mkdir()
    (run / "debug" / "notes.txt").write_text("n")
    (run / "log.txt").write_text("l")
    (tmp_path / "clip.MP4").write_bytes(b"v")
    with ZipFile(archive.pack(outputs, str(tmp_path / "clip.MP4"), str(run / "out.zip"), str(run))) as z:
        names = z.namelist()
        assert z.read("a.WAV") == b"a"
    assert sorted(names) == sorted(["video.mp4", "a.WAV", "b.wav", "debug/audio_preparation/source_audio.wav", "debug/context_detector/events.json", "debug/pipeline/rules/map.json", "debug/notes.txt", "debug/pipeline/log.txt"])
    assert not (run / "out.zip.part").exists()


def test_archive_errors(tmp_path):
    video = tmp_path / "v.mp4"
    with pytest.raises(FileNotFoundError):
        archive.pack({}, str(video), str(tmp_path / "o.zip"))
    video.write_bytes(b"v")
    with pytest.raises(ValueError, match="no track"):
        archive.pack({}, str(video), str(tmp_path / "o.zip"))
    for d in "xy":
        (tmp_path / d).mkdir()
        (tmp_path / d / "t.wav").write_text(d)
    with pytest.raises(ValueError, match="two files"):
        archive.pack({d: str(tmp_path / d / "t.wav") for d in "xy"}, str(video), str(tmp_path / "o.zip"))
    assert not (tmp_path / "o.zip").exists()


def test_files_are_read_at_one_rate(spark, tmp_path):
    for name, sr in (("a", 8000), ("b", 16000)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(np.zeros(sr, dtype=np.float32), sr))
    rows = wav.read_wav(spark, str(tmp_path), 5000, rate=16000).selectExpr("sr", "block_id", "size(samples) AS n").collect()
    assert sorted(map(tuple, rows)) == sorted([(16000, 0, 5000), (16000, 1, 5000), (16000, 2, 5000), (16000, 3, 1000)] * 2)
