import json
import struct

import numpy as np
from sigloom.sources.records import append_new, problems, read_ledger
from sigloom.sources.wav import WavSource


def wav(path, x, bits, kind=1, rate=8000):
    ch = x.shape[1]
    if kind == 3:
        raw = x.astype("<f4").tobytes()
    elif bits == 24:
        raw = b"".join(int(v).to_bytes(4, "little", signed=True)[:3] for v in np.round(x * (1 << 23)).astype(int).ravel())
    else:
        raw = np.round(x * (1 << (bits - 1))).astype(f"<i{bits // 8}").tobytes()
    fmt = struct.pack("<HHIIHH", kind, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def test_wav(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (2500, 2))
    for name, bits, kind in (("a", 16, 1), ("b", 24, 1), ("c", 32, 1), ("d", 32, 3)):
        wav(tmp_path / f"{name}.wav", x, bits, kind)
    (tmp_path / "broken.wav").write_bytes(b"this is no wave file")
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(WavSource)
    rows = spark.read.format("wav").option("path", str(tmp_path)).option("block", 1000).load().collect()
    assert [r.error for r in rows if r.track == "broken.wav"] == ["no RIFF WAVE header"]
    for name in "abcd":
        for c in (0, 1):
            parts = sorted((r.start, r.data) for r in rows if r.track == f"{name}.wav" and r.channel == c)
            assert [p[0] for p in parts] == [0, 1000, 2000]
            assert np.abs(np.concatenate([p[1] for p in parts]) - x[:, c]).max() < 1e-4


def test_ledger(spark, tmp_path):
    good = {"id": "1", "date": "2024-02-03", "question": {"type": "abx"}, "n_trials": 10, "n_correct": 8, "confidence": 0.5}
    lines = [good, {**good, "id": None}, {**good, "id": "2", "date": "2024-02-31", "n_correct": 11}, {**good, "id": "3", "question": {"type": "poll"}, "confidence": 2.0}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = sorted((str(r.id), r.problem) for r in problems(read_ledger(spark, str(tmp_path / "l.jsonl"))).collect())
    assert got == [("2", "bad date"), ("2", "more right than trials"), ("3", "confidence out of range"), ("3", "unknown question"), ("None", "corrupt line"), ("None", "no id")]


def test_append_only_new(spark, tmp_path):
    path = str(tmp_path / "sink")
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 2)], "id string, v int")
    assert append_new(a, path) == 2 and append_new(a, path) == 0
    assert append_new(spark.createDataFrame([("y", 9), ("z", 3)], "id string, v int"), path) == 1
    assert sorted(r.id for r in spark.read.json(path).collect()) == ["x", "y", "z"]
