"""Event-stream files: frames at every cut, all line ends, growing files."""

import io
import random

import pytest

from evidentia.sources import frames as FR


def whole(raw: bytes):
    """Frames of a text read from its first to its last byte, line by line."""
    out, lines, start, at = [], [], 0, 0
    for line in raw.splitlines(keepends=True) if raw else []:
        body = line.rstrip(b"\r\n")
        if line != body:
            if body:
                lines.append(body)
            else:
                frame = FR.parse_frame(b"\n".join(lines)) if lines else None
                if frame:
                    out.append((start, *frame))
                lines = []
        at += len(line)
        if not lines:
            start = at
    return out


def text(seed: int, n: int) -> bytes:
    rng, out = random.Random(seed), []
    for i in range(n):
        end = rng.choice(["\n", "\r\n", "\r"]) if seed % 4 == 0 else ["\n", "\r\n", "\r"][seed % 3]
        lines = [f"event: step.{i}"] * rng.randint(0, 1) + [f"data: {{\"n\": {i}, é" + "x" * rng.randint(0, 30)] * rng.randint(0, 3) + [": comment"] * rng.randint(0, 1) + ["id: 7"] * rng.randint(0, 1)
        lines = lines or ["retry: 5"]
        out.append(end.join(lines) + end * rng.choice([2, 2, 3, 5]))
    return "".join(out).encode() + rng.choice([b"", b"data: broken off", b"data: one line end\n"])


@pytest.mark.parametrize("seed", range(24))
def test_frames_at_every_cut(seed):
    raw = text(seed, 12)
    want = whole(raw)
    for step in (1, 2, 3, 7, 50, len(raw) + 1):
        for block in (1, 5, 1 << 20):
            got = []
            for start in range(0, len(raw), step):
                for at, frame in FR.frames_between(io.BytesIO(raw), start, min(start + step, len(raw)), len(raw), block):
                    parsed = FR.parse_frame(frame)
                    if parsed:
                        got.append((at, *parsed))
            assert got == want, (step, block)
        if len(raw) > 900:
            break
    assert seed > 20 or want


def test_batch_and_growing_stream(spark, tmp_path):
    FR.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {f"f{i}": text(30 + i, 200) for i in range(3)}
    for name, raw in texts.items():
        (folder / name).write_bytes(raw)
    (folder / "_temporary").write_bytes(b"data: no\n\n")

    def rows(df):
        return sorted((r.file.rpartition("/")[2], r.position, r.event, r.data) for r in df.collect())

    want = sorted((name, *frame) for name, raw in texts.items() for frame in whole(raw))
    batch = spark.read.format(FR.FORMAT).option("rangeBytes", 700).load(str(folder))
    assert rows(batch) == want and batch.rdd.getNumPartitions() > 20

    def drain():
        stream = spark.readStream.format(FR.FORMAT).option("rangeBytes", 900).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out"))
        query.trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema(FR.SCHEMA).parquet(str(tmp_path / "out")))

    # A frame that is still being written waits until it is whole.
    (folder / "f0").write_bytes(b"data: first\n\ndata: half")
    texts["f0"] = b"data: first\n\n"
    assert drain() == sorted((name, *frame) for name, raw in texts.items() for frame in whole(raw))
    (folder / "f0").write_bytes(b"data: first\n\ndata: half\ndata: done\n\n")
    (folder / "f9").write_bytes(b"event: late\ndata: file\n\n")
    texts |= {"f0": (folder / "f0").read_bytes(), "f9": (folder / "f9").read_bytes()}
    assert drain() == sorted((name, *frame) for name, raw in texts.items() for frame in whole(raw))
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format(FR.FORMAT).load(str(empty)).count() == 0
