"""The archive source against zipfile: members, ranges, what is refused, and that tasks read it."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators.contracts import ContractError
from frameloom.plans import file_queries
from frameloom.sources import archives, files


def packed(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            if data is None:
                z.mkdir(name)
            else:
                z.writestr(name, data)
    return path.as_uri()


def some(n=40):
    rng = random.Random(2)
    return {f"a/{'b/' * (i % 3)}m{i}-é.wav": rng.randbytes(rng.randrange(0, 3000)) + bytes(rng.randrange(0, 5000)) for i in range(n)}


def raises(found, what):
    with pytest.raises(Exception) as e:
        found().count()
    assert what in str(e.value)


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_members_are_those_of_zipfile(spark, tmp_path, method):
    members = some()
    uri = packed(tmp_path / "x.zip", members | {"a/": None}, method)
    df = archives.read_members(spark, [uri], part=8000)
    assert {r.name: bytes(r.content) for r in df.collect()} == members
    assert df.select(F.spark_partition_id()).distinct().count() > 3
    assert {r.name for r in archives.read_members(spark, [uri], "a/m*").collect()} == {m for m in members if m.startswith("a/m") or "/m" in m and m.startswith("a/m")}


def test_several_archives_and_empty_ones(spark, tmp_path):
    one, two = {"x.wav": b"1"}, {"y.wav": b"22"}
    uris = [packed(tmp_path / "1.zip", one), packed(tmp_path / "none.zip", {}), packed(tmp_path / "2.zip", two)]
    assert {(r.archive, r.name, r.size) for r in archives.read_members(spark, uris).collect()} == {(uris[0], "x.wav", 1), (uris[2], "y.wav", 2)}
    assert archives.read_members(spark, uris[1:2]).count() == archives.read_members(spark, []).count() == 0


def test_ranges_are_read_where_they_lie(spark, tmp_path):
    members = some()
    packed(tmp_path / "x.zip", members)
    data = (tmp_path / "x.zip").read_bytes()
    cuts = [0, 1, 700, 701, len(data) - 30, len(data)]
    parts = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"{k}").write_bytes(data[a:b] + b"more than the range")
        parts.append(((tmp_path / f"{k}").as_uri(), b - a))
    found = archives.read_members(spark, [archives.checked_ranges(parts, len(data))], part=4000)
    assert {r.name: bytes(r.content) for r in found.collect()} == members
    with pytest.raises(ContractError):
        archives.checked_ranges(parts, len(data) + 1)
    raises(lambda: archives.read_members(spark, [[(parts[0][0], 1000)]]), "holds")
    raises(lambda: archives.read_members(spark, [parts[:-1]]), "not a ZIP archive")


@pytest.mark.parametrize("name", ["/x.wav", "../x.wav", "a/../../x.wav", "a\\..\\..\\x.wav", "C:x.wav"])
def test_unsafe_names_are_refused(spark, tmp_path, name):
    uri = packed(tmp_path / "x.zip", {"good.wav": b"1", name: b"2"})
    raises(lambda: archives.read_members(spark, [uri]), "path")


def test_links_bounds_and_other_files_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        link = zipfile.ZipInfo("x.wav")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc/passwd")
    raises(lambda: archives.read_members(spark, [(tmp_path / "x.zip").as_uri()]), "a link")
    uri = packed(tmp_path / "y.zip", {"a.wav": b"123", "b.WAV": b"4", "c.txt": b""})
    raises(lambda: archives.read_members(spark, [uri], only="*.wav"), "not *.wav")
    raises(lambda: archives.read_members(spark, [uri], most_files=2), "too large")
    raises(lambda: archives.read_members(spark, [uri], most_bytes=3), "too large")
    assert archives.read_members(spark, [uri], most_files=3, most_bytes=4).count() == 3


def test_damaged_members_raise(spark, tmp_path):
    uri = packed(tmp_path / "x.zip", {"a.wav": b"0123456789" * 9}, zipfile.ZIP_STORED)
    data = (tmp_path / "x.zip").read_bytes()
    (tmp_path / "x.zip").write_bytes(data.replace(b"0123", b"0124", 1))
    raises(lambda: archives.read_members(spark, [uri]), "damaged")
    (tmp_path / "x.zip").write_bytes(data.replace(b"PK\x01\x02", b"PK\x01\x03"))
    raises(lambda: archives.read_members(spark, [uri]), "damaged")


def test_long_fields_of_big_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z, z.open("x.wav", "w", force_zip64=True) as f:
        f.write(b"123")
    ranges = archives.Ranges([((tmp_path / "x.zip").as_uri(), None)])
    at, size, n = archives.directory(ranges)
    (_, m), = archives.records(ranges, at, at + size, n)
    assert archives.content(ranges, m) == b"123"
    assert archives._long_fields(b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (6 << 32).to_bytes(8, "little"), [0xFFFFFFFF, 7, 0xFFFFFFFF]) == [5 << 32, 7, 6 << 32]


def test_written_archives_are_read_by_zipfile(spark, tmp_path):
    members = some()
    df = spark.createDataFrame(list(members.items()), "name string, content binary").repartition(3)
    written = archives.write_archives(df, f"{tmp_path.as_uri()}/z").collect()
    assert sum(r.members for r in written) == len(members) and len(written) == 3
    found = {}
    for r in written:
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None
            found |= {n: z.read(n) for n in z.namelist()}
    assert found == members


def test_audio_is_extracted_whole_or_not_at_all(spark, tmp_path):
    samples = {f"s{k}": np.arange(k + 1, dtype=np.float32) / 9 for k in range(5)}
    uri = packed(tmp_path / "x.zip", {f"clips/{k}.wav": files.encode_wav(v, 8000) for k, v in samples.items()})
    out = f"{tmp_path.as_uri()}/out"
    written = files.extract_audio(spark, [uri], out)
    assert {r.name for r in written.collect()} == {f"clips/{k}.wav" for k in samples}
    assert {r.stem: r.samples for r in files.read_audio(spark, out).collect()} == {k: v.tolist() for k, v in samples.items()}
    assert {r.stem: r.samples for r in files.read_audio_archive(spark, [uri]).collect()} == {k: v.tolist() for k, v in samples.items()}
    with pytest.raises(FileExistsError):
        files.extract_audio(spark, [uri], out)
    bad = packed(tmp_path / "y.zip", {"a.wav": b"0123456789" * 9, "b.wav": b"1"}, zipfile.ZIP_STORED)
    (tmp_path / "y.zip").write_bytes((tmp_path / "y.zip").read_bytes().replace(b"0123", b"0124", 1))
    with pytest.raises(Exception, match="damaged"):
        files.extract_audio(spark, [bad], f"{tmp_path.as_uri()}/none")
    assert {p.name for p in tmp_path.iterdir()} == {"x.zip", "y.zip", "out"}


def test_condition_log_of_an_archive(spark, tmp_path):
    uri = packed(tmp_path / "x.zip", {"logs/1.txt": "﻿p1_1 babble 5\r\np1_2 cafe 10.0\n\n".encode(), "logs/2.txt": b"p2_1\tbus  0", "readme.md": b"no log"})
    rows = {tuple(r) for r in files.read_condition_log_zip(spark, [uri], "logs/*.txt").collect()}
    assert rows == {("p1_1", "babble", 5.0), ("p1_2", "cafe", 10.0), ("p2_1", "bus", 0.0)}
    with pytest.raises(ContractError):
        files.read_condition_log_zip(spark, [uri], "nothing")
    with pytest.raises(ContractError):
        files.read_condition_log_zip(spark, [uri], "readme.md")


def test_as_many_clips_are_unpacked_as_were_packed(spark, monkeypatch):
    """The query counts what it packs; the reader's usual limit doesn't bind it."""
    monkeypatch.setattr(files.extract_audio, "__defaults__", (5, 1 << 40))
    sf = "/root/testdata/sf0.001"
    assert file_queries.QUERIES["archived_audio"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count() > 5
