"""Scan files: parts equal the whole, values survive bit packing, damage is named."""

import numpy as np
import pytest

from quillmesh.sources import e57
from quillmesh.sources.e57 import Builder, Field, pose_xml


def fields():
    return [
        Field("cartesianX", "Float", bits=64), Field("cartesianY", "Float", bits=32), Field("cartesianZ", "ScaledInteger", -5000, 13, 0.001, 2.0),
        Field("cartesianInvalidState", "Integer", 0, 2), Field("colorRed", "Integer", 0, 16), Field("colorGreen", "Integer", 7, 0), Field("intensity", "Integer", -3, 37),
    ]


def columns(n, seed=0):
    r = np.random.default_rng(seed)
    return [
        r.normal(size=n), r.normal(size=n).astype(np.float32), np.round(r.integers(-5000, 3191, n) * 0.001 + 2.0, 3),
        r.integers(0, 3, n), r.integers(0, 65536, n), np.full(n, 7), r.integers(-3, 2**37 - 3, n),
    ]


def write(folder, name="a.e57", n=9000, pose=""):
    b = Builder()
    b.scan(None, None, "", fields(), columns(0))
    b.scan("g1", "hall", pose, fields(), columns(n))
    b.scan(None, "room", "", fields()[:4], columns(500, 1)[:4])
    data = b.finished()
    (folder / name).write_bytes(data)
    return data


NAMES = ["x", "y", "z", "invalid", "r", "g", "intensity"]


def of_scan(df, number):
    rows = df.where(f"scan = {number}").orderBy("n").collect()
    return [np.array([r[k] for r in rows]) for k in NAMES], [r["n"] for r in rows]


@pytest.mark.parametrize("split", [9_000, 1 << 25])
def test_parts_of_a_scan_equal_the_whole(spark, tmp_path, split):
    write(tmp_path)
    df = e57.points(spark, str(tmp_path), splitBytes=str(split))
    got, n = of_scan(df, 1)
    assert n == list(range(9000))
    for a, b in zip(got, columns(9000), strict=True):
        assert np.allclose(a, b, rtol=0, atol=1e-12)
    assert of_scan(df, 0)[1] == [] and len(of_scan(df, 2)[1]) == 500
    assert {r.guid for r in df.select("guid").distinct().collect()} == {"g1", "scan_2"}
    assert df.where("b is not null").count() == 0


def test_fewer_columns_decode_fewer_fields(spark, tmp_path, monkeypatch):
    write(tmp_path, n=300)
    asked = []
    values = e57.Packets.values
    monkeypatch.setattr(e57.Packets, "values", lambda self, k, *a: asked.append(self.scan.fields[k].name) or values(self, k, *a))
    paged = e57.Paged(str(tmp_path / "a.e57"))
    scan = list(e57.Tree(paged).scans())[1]
    (part,) = e57.decoded(paged, scan, 0, 1 << 40, ["r", "invalid"], True)
    assert set(asked) == {"colorRed", "cartesianInvalidState"} and set(part) == {"n", "r", "invalid"}
    assert e57.points(spark, str(tmp_path), "z double, scan int").columns == ["z", "scan"]


def test_guids_choose_scans_before_anything_is_read(spark, tmp_path):
    write(tmp_path, n=300)
    one = e57.points(spark, str(tmp_path), guids=["g1"])
    assert one.rdd.getNumPartitions() == 1 and one.count() == 300
    assert e57.points(spark, str(tmp_path), guids=["scan_2", "g1"]).where("n >= 299").count() == 202
    assert e57.points(spark, str(tmp_path), guids=[]).count() == 0
    df = e57.points(spark, str(tmp_path))
    assert df.where("scan = 2").count() == 500 and df.where("scan = 1").count() == 300 and df.count() == 800


def test_poses_and_their_gaps(spark, tmp_path):
    half = 0.5**0.5
    write(tmp_path, n=50, pose=pose_xml({"w": half, "z": half}, {"x": 10.0, "z": -1.0}))
    x, y, z = columns(50)[:3]
    got, _ = of_scan(e57.points(spark, str(tmp_path)), 1)
    assert np.allclose(got[0], 10 - y) and np.allclose(got[1], x) and np.allclose(got[2], z - 1)
    raw, _ = of_scan(e57.points(spark, str(tmp_path), transform="false"), 1)
    assert np.allclose(raw[0], x)
    found = {r.scan: r for r in e57.scans(spark, str(tmp_path)).collect()}
    assert (found[0].guid, found[0].name, found[0].points) == ("scan_0", "Scan 0", 0) and found[0].rotation.w == 1.0 and found[0].translation.x == 0.0
    assert found[1].translation.asDict() == {"x": 10.0, "y": 0.0, "z": -1.0} and found[1].rotation.x == 0.0


def test_spherical_coordinates(spark, tmp_path):
    b = Builder()
    far, round_, up = np.array([2.0, 3.0]), np.array([0.0, np.pi / 2]), np.array([0.0, np.pi / 6])
    b.scan("s", None, "", [Field(n, "Float", bits=64) for n in e57.SPHERICAL], [far, round_, up])
    (tmp_path / "s.e57").write_bytes(b.finished())
    rows = e57.points(spark, str(tmp_path), "x double, y double, z double, n long").orderBy("n").collect()
    assert np.allclose([tuple(r)[:3] for r in rows], [(2, 0, 0), (0, 3 * np.cos(np.pi / 6), 1.5)])


def test_pictures(spark, tmp_path):
    b = Builder()
    one, two = b.blob(b"png" * 700), b.blob(b"jpeg")
    blob = lambda k, at, n: f'<{k} type="Blob" fileOffset="{at}" length="{n}"/>'
    b.image(f'<guid type="String">i1</guid><associatedData3DGuid type="String">g1</associatedData3DGuid>{pose_xml(None, {"y": 4.0})}<sphericalRepresentation>{blob("pngImage", one, 2100)}</sphericalRepresentation><pinholeRepresentation>{blob("jpegImage", two, 4)}</pinholeRepresentation>')
    b.image(f"<pinholeRepresentation>{blob('pngImage', one, 2100)}{blob('jpegImage', two, 4)}</pinholeRepresentation>")
    b.image("<name>none</name>")
    (tmp_path / "p.e57").write_bytes(b.finished())
    a, c, d = e57.images(spark, str(tmp_path)).orderBy("image").collect()
    assert (a.guid, a.scan_guid, a.representation, a.coding, bytes(a.picture)) == ("i1", "g1", "spherical", "png", b"png" * 700) and a.translation.y == 4.0 and a.translation.x == 0.0
    assert (c.guid, c.name, c.representation, c.coding, bytes(c.picture), c.translation, c.scan_guid) == ("img_1", "Image_1", "pinhole", "jpeg", b"jpeg", None, None)
    assert (d.name, d.picture) == ("none", None) and e57.points(spark, str(tmp_path)).count() == 0


def test_damage_is_named(spark, tmp_path):
    data = bytearray(write(tmp_path))
    assert e57.bad_pages(spark, str(tmp_path)).count() == 0
    data[20 * 1024 + 77] ^= 1
    data[90 * 1024 + 1023] ^= 1
    (tmp_path / "a.e57").write_bytes(bytes(data))
    assert sorted(r.page for r in e57.bad_pages(spark, str(tmp_path), pages=16).collect()) == [20, 90]
    with pytest.raises(Exception, match="checksum of page (20|90)"):
        e57.points(spark, str(tmp_path)).count()
    (tmp_path / "a.e57").write_bytes(b"no such thing" * 20)
    with pytest.raises(Exception, match="no E57 file"):
        e57.points(spark, str(tmp_path)).count()


def test_fewer_records_than_stated(spark, tmp_path):
    b = Builder()
    b.scan("s", None, "", fields(), columns(100), records=101)
    (tmp_path / "s.e57").write_bytes(b.finished())
    with pytest.raises(Exception, match="100 of 101 records"):
        e57.points(spark, str(tmp_path)).count()


def test_checksums_are_the_published_ones():
    assert e57.checksums(np.frombuffer(b"123456789", np.uint8).reshape(1, 9))[0] == 0xE3069283


def test_written_points_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.range(5000).selectExpr("concat('s', id % 3) as guid", "id / 7 as x", "id * 0.5 as y", "cast(-id as double) as z", "cast(id % 2 as int) as invalid", "cast(id % 256 as int) as r", "id")
    e57.write_points(rows.drop("id"), path, filePoints="700")
    got = e57.points(spark, path)
    assert got.select("path").distinct().count() > 6
    back = got.selectExpr("guid", "x", "y", "z", "invalid", "r")
    assert back.count() == 5000 and back.exceptAll(rows.drop("id")).count() == 0
