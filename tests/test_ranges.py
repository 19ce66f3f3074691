"""Digests of files by byte ranges."""

import hashlib
import os

import pytest

from tidemark.sources import ranges


def root(digests):
    for _ in range(ranges.LEVELS):
        digests = [hashlib.sha256("\n".join(digests[i : i + ranges.FAN]).encode()).hexdigest() for i in range(0, len(digests), ranges.FAN)]
    return digests[0]


def sha(body):
    return hashlib.sha256(body).hexdigest()


def test_against_whole_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "TASK", 40)  # several chunks a task, several tasks a file
    bodies = {"empty": b"", "one": b"x", "edge": b"ab" * 8, "over": b"ab" * 8 + b"c", "a b é": os.urandom(5000), "twin": b"x"}
    (tmp_path / "in").mkdir()
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body)
    got = {r.file: r for r in ranges.file_digests(spark, f"{tmp_path}/in", 16).collect()}
    assert set(got) == {"empty", "one", "edge", "over", "a b é", "twin"}
    for name, body in bodies.items():
        parts = [body[i : i + 16] for i in range(0, max(1, len(body)), 16)]
        assert (got[name].bytes, got[name].chunks) == (len(body), len(parts))
        assert got[name].sha256 == sha(body) and got[name].root == root([sha(x) for x in parts])


def test_more_chunks_than_one_group(spark, tmp_path):
    body = os.urandom(3 * ranges.FAN + 5)
    (tmp_path / "long").write_bytes(body)
    row = ranges.chunk_roots(ranges.ranges(spark, ranges.listed(spark, str(tmp_path)), 1)).collect()[0]
    assert row.chunks == len(body) and row.root == root([sha(body[i : i + 1]) for i in range(len(body))])


def test_a_file_beyond_two_gigabytes_by_ranges(spark, tmp_path):
    size = (5 << 29) + 3  # 2.5 GB of zeros that take no disk
    with open(tmp_path / "sparse", "wb") as file:
        file.truncate(size)
    rows = ranges.ranges(spark, ranges.listed(spark, str(tmp_path)), 1 << 28).collect()
    assert sorted((r.chunk, r.chunk_bytes) for r in rows) == [(i, 1 << 28) for i in range(10)] + [(10, 3)]
    assert {r.sha256 for r in rows if r.chunk < 10} == {next(r.sha256 for r in rows if r.chunk == 0)}
    whole = hashlib.sha256()
    for _ in range(size >> 20):
        whole.update(bytes(1 << 20))
    whole.update(bytes(size & ((1 << 20) - 1)))
    assert ranges.ranges(spark, ranges.listed(spark, str(tmp_path)), 0).collect()[0].sha256 == whole.hexdigest()


def test_a_file_that_changed_and_a_bad_chunk(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    with pytest.raises(Exception, match="was listed with 5"):
        ranges.ranges(spark, [(str(tmp_path / "f"), 5)], 2).collect()
    with pytest.raises(ValueError):
        ranges.file_digests(spark, str(tmp_path), 0)
