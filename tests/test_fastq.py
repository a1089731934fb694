"""FASTQ splits: whatever the size of a split, each record is read once."""

import gzip
import random
import zlib

import pytest

from isoflow.sources import fastq, tables


def bgzf(data: bytes, cuts: list[int]) -> bytes:
    """Block-gzipped data whose blocks end at the given places, with an empty block in the middle and one at the end."""
    out = b""
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
    for part in [*parts[: len(parts) // 2], b"", *parts[len(parts) // 2 :], b""]:
        state = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = state.compress(part) + state.flush()
        size = 18 + len(body) + 8
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (size - 1).to_bytes(2, "little") + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def made(rng, n, end="\n"):
    """Records whose qualities often look like headers or separators."""
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 5, 30])
        rows.append((f"r{i} x", "".join(rng.choice("ACGTN") for _ in range(size)), "".join(rng.choice("@+I#") for _ in range(size))))
    return rows, "".join(f"@{a}{end}{s}{end}+{a if rng.random() < 0.3 else ''}{end}{q}{end}" for a, s, q in rows)


def in_splits(path, size, kind, step):
    return [r for at in range(0, size, step) for r in fastq.records(fastq.Split(str(path), at, min(size, at + step), kind))]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_split_size_gives_all_records_once(tmp_path, end):
    rng = random.Random(len(end))
    rows, text = made(rng, 60, end)
    path = tmp_path / "a.fastq"
    for tail in (text, text.rstrip("\r\n") if rows[-1][2] else text):
        path.write_bytes(tail.encode())
        for step in (1, 2, 3, 7, 20, 64, 333, len(text) + 5):
            assert in_splits(path, len(tail), "plain", step) == rows, step


def test_blocks_cut_anywhere(tmp_path):
    rng = random.Random(5)
    rows, text = made(rng, 120)
    data = text.encode()
    lines = [i + 1 for i, c in enumerate(data) if c == 10]
    for k, cuts in enumerate([sorted(rng.sample(range(1, len(data)), 40)), sorted(rng.sample(lines[:-1], 40)), lines[3:-1:4], []]):
        path = tmp_path / f"{k}.fastq.gz"
        packed = bgzf(data, cuts)
        path.write_bytes(packed)
        assert gzip.decompress(packed) == data
        for step in (1 if k < 3 else 50, 30, 100, 999, len(packed)):
            assert in_splits(path, len(packed), "blocks", step) == rows, (k, step)


def test_read_fastq_of_all_kinds(spark, tmp_path):
    rng = random.Random(6)
    want = {}
    for name in ("plain.fastq", "blocks.fastq.gz", "members.fastq.gz", "empty.fastq"):
        rows, text = made(rng, 0 if name.startswith("empty") else 300)
        data = text.encode()
        half = len(data) // 2
        packed = {"plain.fastq": data, "empty.fastq": b"", "blocks.fastq.gz": bgzf(data, list(range(500, len(data), 500))), "members.fastq.gz": gzip.compress(data[:half]) + gzip.compress(data[half:])}
        (tmp_path / name).write_bytes(packed[name])
        want |= {(name, i): r for i, r in enumerate(rows)}
    got = tables.read_fastq(spark, str(tmp_path), split_bytes=1000)
    assert got.columns == ["read_id", "seq", "qual", "file"] and got.rdd.getNumPartitions() > 10
    assert sorted((r.file.rsplit("/", 1)[1], r.read_id, r.seq, r.qual) for r in got.collect()) == sorted((k[0], *r) for k, r in want.items())
    assert tables.read_fastq(spark, str(tmp_path / "empty.fastq")).count() == 0 and tables.read_fastq(spark, str(tmp_path / "no*.fastq")).count() == 0
    assert tables.read_fastq(spark, "file://" + str(tmp_path / "plain.fastq")).count() == 300
