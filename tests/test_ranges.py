"""Delimited files by byte ranges: any cut gives the records of the whole file."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.sources.ingest import file_digests, ingest
from fieldspark.sources.ranges import file_records, line_blocks, load_ranges, range_states


def plain_records(raw: bytes) -> list[tuple[int, str]]:
    """Reference reader of a whole file in memory."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    text = text.replace("\r\n", "\n")
    if text.count('"') % 2:
        out = text.split("\n")
    else:
        out, quoted = [""], False
        for c in text:
            quoted ^= c == '"'
            if c == "\n" and not quoted:
                out.append("")
            else:
                out[-1] += c
    return [(i, r) for i, r in enumerate(out) if r.strip(" ")]


def sample(seed: int, size: int, odd: bool = False, encoding: str = "utf-8") -> bytes:
    g = random.Random(seed)
    raw = "".join(g.choices(["a", "é", ",", "\n", '"', "\r\n", "\r", " ", "x" * 40, '"a\nb"', "\n\n"], k=size))
    if (raw.count('"') % 2 == 1) != odd:
        raw += '"'
    return raw.encode(encoding)


@pytest.mark.parametrize("read", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("cut", [1, 3, 50, 10**9])
def test_every_line_is_in_one_range(read, cut):
    for seed in range(12):
        raw = sample(seed, 60) if seed else b""
        raw += b"\n" if seed % 2 else b""
        got = []
        for first in range(0, max(len(raw), 1), cut):
            for block in line_blocks(io.BytesIO(raw), first, min(first + cut, len(raw)), read):
                got += block
        want = raw.split(b"\n")
        last = want.pop()
        want = [x[:-1] if x.endswith(b"\r") else x for x in want] + ([last] if last else [])
        assert got == want


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("ranges")
    (top / "sub").mkdir()
    files = {
        "a.csv": sample(1, 900), "b.csv": sample(2, 900, odd=True), "c.txt": sample(3, 700, encoding="latin-1"), "sub/d.tsv": b"one line", "sub/e.csv": b"",
        "f.csv": b'x,"' + b"long cell\n" * 500 + b'"\nlast,1\n', "g.csv": b"y" * 5000 + b"\n\n  \nz", "h.csv": b'"\n' * 400, "i.csv": b"\n\n\n",
    }
    for name, raw in files.items():
        (top / name).write_bytes(raw)
    (top / "_SUCCESS.csv").write_bytes(b"hidden")
    (top / "k.parquet").write_bytes(b"other")
    return str(top), files


@pytest.mark.parametrize("cut", [100, 1777, 128 << 20])
def test_records_of_any_cut(spark, folder, cut):
    path, files = folder
    want = sorted((n, i, r) for n, raw in files.items() for i, r in plain_records(raw))
    assert sorted(map(tuple, file_records(spark, path, cut).collect())) == want


def test_no_row_holds_a_file(spark, folder):
    path, files = folder
    ranges = load_ranges(spark, path, "ranges", 100)
    assert ranges.count() == sum(max(1, -(-len(raw) // 100)) for raw in files.values())
    states = {(r["source_file"], r["range_no"]): r for r in range_states(ranges).collect()}
    assert not states["b.csv", 0]["paired"] and states["a.csv", 0]["paired"]
    assert not states["c.txt", 0]["utf8"] and states["f.csv", 3]["odd_start"] and states["f.csv", 3]["records_before"] == 0
    longest = load_ranges(spark, path, "lines", 100).agg(F.max(F.octet_length("line"))).first()[0]
    assert longest == max(len(x) for raw in files.values() for x in raw.split(b"\n"))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_bytes(b"0123456789\n" * 800_000)
    lines = load_ranges(spark, str(tmp_path), "lines", 1 << 20)
    assert lines.rdd.getNumPartitions() == 9 and lines.count() == 800_000


def test_digests(spark, folder):
    path, files = folder
    assert {r["source_file"]: r["file_hash"] for r in file_digests(spark, path).collect()} == {n: hashlib.sha256(raw).hexdigest() for n, raw in files.items()}


def test_ingest_of_small_ranges(spark, tmp_path):
    rows = "".join(f'2024-05-{1 + i % 28:02d};F{i};12,5;60;6,5;"{i}\n{i}"\r\n' for i in range(300))
    (tmp_path / "a.csv").write_bytes(("Registro\nData;Campo;Temperatura;Umidità;pH_suolo;Resa\n" + rows).encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"date,field_id,temp,humidity,ph,yield\n2024-01-01,X,1,2,3,4\n")
    from fieldspark.sources.headers import SYNONYMS

    got = [sorted(map(repr, ingest(spark, str(tmp_path), synonyms=SYNONYMS, fuzzy=True, range_bytes=n).df.collect())) for n in (300, 128 << 20)]
    assert len(got[0]) == 301 and got[0] == got[1] and "7\\n7" in got[0][-1] + "".join(got[0])


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        file_records(spark, str(tmp_path / "nowhere")).count()
    assert file_records(spark, str(tmp_path)).where(F.lit(True)).count() == 0
