import io
import tarfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.functions import audio
from strophe.sources import archives, readers


def files(spark, rows):
    return spark.createDataFrame(rows, "name string, body binary")


def test_archives_hold_sorted_groups_and_come_back(spark, tmp_path):
    rows = [(f"n{i:03d}.{'mp3' if i % 4 else 'txt'}", bytes([i % 256]) * i) for i in range(57)] + [("empty.mp3", b""), ("none.mp3", None), ("é 中.mp3", b"x")]
    path = f"file://{tmp_path}/a"
    archives.write_archives(files(spark, rows).repartition(5), path, 10, [".mp3"], "m")
    names = sorted((n for n, _ in rows), key=str.encode)
    want = {(f"block_{i // 10 * 10}_m.tar.gz", n, bytes(dict(rows)[n] or b"")) for i, n in enumerate(names) if n.endswith(".mp3")}
    got = archives.read_archives(spark, path).collect()
    assert {(r.shard, r.name, bytes(r.body)) for r in got} == want and len(got) == len(want)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted({s for s, _, _ in want})
    with tarfile.open(fileobj=io.BytesIO((tmp_path / "a" / "block_0_m.tar.gz").read_bytes()), mode="r:gz") as a:
        assert [m.name for m in a] == sorted(n for s, n, _ in want if s == "block_0_m.tar.gz")


def test_a_failed_task_leaves_no_shard(spark, tmp_path):
    rows = [(f"n{i:03d}", b"x") for i in range(30)] + [("n004/b", b"x")]
    with pytest.raises(Exception, match="no file name"):
        archives.write_archives(files(spark, rows).repartition(4), f"file://{tmp_path}/a", 5)
    # a task that is only now being stopped may still leave its attempt; no shard is in place
    left = lambda: [p for p in tmp_path.rglob("*") if p.is_file() and "_attempts-" not in str(p)]
    assert left() == []
    with pytest.raises(Exception, match="no file name"):
        archives.write_files(files(spark, [*rows, ("..", b"")]), f"file://{tmp_path}/b")
    assert left() == []
    archives.write_files(files(spark, rows[:3]), f"file://{tmp_path}/b")
    assert sorted(p.name for p in left()) == ["n000", "n001", "n002"]


def raw(data: bytes, tag: int, channels: int, bits: int, rate: int = 8000, extra: bytes = b"") -> bytes:
    import struct

    form = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_wav_formats():
    x = np.array([[-1.0, 0.5], [0.25, -0.125], [0.0, 0.75]])
    for tag, bits, data in (
        (1, 8, (x * 128 + 128).astype(np.uint8).tobytes()), (1, 16, (x * 32768).astype("<i2").tobytes()), (1, 32, (x * 2**31).astype("<i4").tobytes()),
        (1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x.ravel())), (3, 32, x.astype("<f4").tobytes()), (3, 64, x.astype("<f8").tobytes()),
    ):
        rate, got = audio.decode_wav(raw(data, tag, 2, bits, extra=b"LIST\x03\x00\x00\x00abc\x00"))
        assert rate == 8000 and np.array_equal(got, x), bits
    samples = np.random.default_rng(1).integers(-32768, 32768, (101, 1)).astype("<i2")
    rate, got = audio.decode_wav(audio.encode_wav(samples, 44100))
    assert rate == 44100 and np.array_equal(got * 32768, samples)
    for bad in (b"", b"RIFF", raw(b"", 7, 1, 16), b"ID3" * 9):
        with pytest.raises(ValueError, match="no |unknown"):
            audio.decode_wav(bad)


def test_recordings_read_cut_and_written(spark, tmp_path):
    rate = 1000
    tracks = {"a.wav": np.arange(100), "b.wav": np.arange(7), "c.wav": np.arange(33_000) % 30_000}
    for n, x in tracks.items():
        (tmp_path / n).write_bytes(audio.encode_wav(x.astype("<i2"), rate))
    (tmp_path / "bad.wav").write_bytes(b"not audio")
    got = {Path(r.path).name: r for r in audio.read_audio(spark, str(tmp_path)).withColumn("seconds", audio.seconds(F.col("frames"), F.col("rate"))).collect()}
    assert got["bad.wav"].error and got["bad.wav"].samples is None and got["c.wav"].seconds == 33.0 and got["a.wav"].size == 244
    cut = {Path(r.path).name: (np.array(r.samples) * 32768).tolist() for r in audio.cut(audio.read_audio(spark, str(tmp_path)).where("error IS NULL"), 30).collect()}
    assert cut["a.wav"] == list(range(35, 65)) and cut["b.wav"] == list(range(7)) and cut["c.wav"] == (np.arange(16_485, 16_515) % 30_000).tolist()
    early = audio.cut(audio.read_audio(spark, str(tmp_path)).where("error IS NULL"), 30, at=F.lit(0.0)).collect()
    assert {Path(r.path).name: len(r.samples) for r in early} == {"a.wav": 30, "b.wav": 7, "c.wav": 30}


def direct(x, p):
    n = -(-len(x) * p.up // p.down)
    t = np.arange(n)[:, None] * p.down / p.up - np.arange(len(x))[None, :]
    return (p.response(t) * x).sum(axis=1)


@pytest.mark.parametrize(("source", "target"), [(16_000, 24_000), (48_000, 16_000), (48_000, 44_100), (44_100, 48_000), (8_000, 8_000)])
@pytest.mark.parametrize("size", [7, 100, 5000])
def test_resampling_equals_a_direct_convolution(spark, source, target, size):
    rng = np.random.default_rng(3)
    tracks = {f"t{i}": rng.standard_normal(n) for i, n in enumerate((1, 6, 99, 100, 1201))}
    p = audio.Polyphase(source, target)
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in tracks.items()], "name string, samples array<double>")
    out = {}
    for r in audio.resampled_blocks(audio.in_blocks(rows, size), source, target, size).orderBy("name", "block").collect():
        out.setdefault(r.name, []).extend(r.samples)
    for n, x in tracks.items():
        assert np.allclose(out[n], direct(x, p), atol=1e-12)
    if source == target:
        assert np.allclose(out["t4"], tracks["t4"])


def test_resampling_keeps_a_tone():
    p = audio.Polyphase(48_000, 44_100, zeros=24)
    x = np.sin(2 * np.pi * 1000 * np.arange(4800) / 48_000)
    y = p.block(np.zeros(0), x, np.zeros(0), 0)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(y)) / 44_100)
    assert np.abs(y - want)[200:-200].max() < 1e-3


def test_no_recordings(spark):
    none = spark.createDataFrame([], "name string, samples array<double>, rate int")
    assert audio.encoded(none).count() == 0 and audio.resampled_blocks(audio.in_blocks(none, 5), 2, 3, 5).count() == 0
    silent = spark.createDataFrame([("a", None)], "name string, samples array<double>")
    assert audio.resampled_blocks(audio.in_blocks(silent, 5), 2, 3, 5).collect()[0].samples in ([], None)


def test_array_files(spark, tmp_path):
    want = {"a": np.arange(6, dtype=np.int16).reshape(2, 3), "b": np.array([0.5, -1.0], dtype=np.float32), "c": np.zeros((0, 4), dtype=np.int64), "d": np.array(7, dtype=np.uint8), "e": np.asfortranarray(np.arange(4).reshape(2, 2))}
    for n, x in want.items():
        np.save(tmp_path / f"{n}.npy", x)
    (tmp_path / "bad.npy").write_bytes(b"no array")
    np.save(tmp_path / "words.npy", np.array(["x"]))
    np.save(tmp_path / "objects.npy", np.array([{}], dtype=object), allow_pickle=True)
    got = {r.stem: r for r in readers.arrays(spark, str(tmp_path)).collect()}
    for n, x in want.items():
        r = got[n]
        assert r.shape == list(x.shape) and r.error is None and (r.tokens if x.dtype.kind in "iu" else r["values"]) == x.ravel().tolist()
    assert all(got[n].error and got[n].shape is None and got[n].tokens is None for n in ("bad", "words", "objects"))


def test_json_items_and_previous_results(spark, tmp_path):
    (tmp_path / "songs.json").write_text('[{"title": "é"}, {"title": null}, {"other": 1}]', encoding="utf-8")
    items = lambda n: [(r.idx, r.title) for r in readers.json_items(spark, str(tmp_path / "songs.json"), "title string", n).collect()]
    assert items(-1) == [(0, "é"), (1, None), (2, None)] and items(1) == [(0, "é")] and readers.json_items(spark, str(tmp_path / "none.json"), "title string").count() == 0
    out = tmp_path / "out"
    out.mkdir()
    for n, body in {"done": '{"api_response": {"status": "succeeded", "id": 5}}', "live": '{"api_response": {"status": "queued"}}', "odd": '{"api_response": {"status": "?"}}', "none": '{"api_response": null}', "cut": '{"api_response": {"status": "succ', "blank": ""}.items():
        (out / f"{n}.json").write_text(body)
    got = {Path(r.path).stem: r for r in readers.previous_results(spark, str(out)).collect()}
    assert {n for n, r in got.items() if r.processed} == {"done", "live"} and got["cut"].api_response is None and got["done"].status == "succeeded"
