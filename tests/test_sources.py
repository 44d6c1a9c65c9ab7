import struct

import numpy as np
import pytest

from prismatic.sources import binary_files, excel, facade, spectral_files, vendor_files


@pytest.fixture()
def spectra(spark):
    axis = [400.0 + k for k in range(120)]
    rows = [(f"s{i}", [round(0.5 + 0.001 * k + 0.1 * i, 6) for k in range(120)]) for i in range(3)]
    return spark.createDataFrame(rows, "sample_id string, values array<double>"), axis


def asd_file(values, white=None, start=350.0, text=b""):
    head = bytearray(484)
    head[:3] = b"as7" if white is not None else b"ASD"
    struct.pack_into("<ff", head, 191, start, 1.0)
    head[199] = 2
    struct.pack_into("<H", head, 204, len(values))
    more = b"" if white is None else struct.pack("<H", 1) + bytes(16) + struct.pack("<H", len(text)) + text + np.array(white, "<f8").tobytes()
    return bytes(head) + np.array(values, "<f8").tobytes() + more


def test_asd_bytes():
    assert binary_files.asd_of(asd_file([1.0, 2.0])) == ([350.0, 351.0], [1.0, 2.0])
    assert binary_files.asd_of(asd_file([1.0, 2.0], [2.0, 8.0], text=b"note")) == ([350.0, 351.0], [0.5, 0.25])
    with pytest.raises(ValueError):
        binary_files.asd_of(b"xyz" + bytes(600))


def test_spc_bytes():
    axis, values = [1000.0, 999.0, 998.0], [0.25, 0.5, 0.75]
    assert binary_files.spc_of(binary_files.spc_bytes(axis, values)) == ([998.0, 999.0, 1000.0], [0.75, 0.5, 0.25])
    # evenly spaced axis, 32-bit and 16-bit whole numbers with an exponent
    for flags, kind, bits in ((0, "<i4", 32), (1, "<i2", 16)):
        raw = struct.pack("<BBBbIddI", flags, 0x4B, 0, 3, 3, 10.0, 12.0, 1).ljust(512, b"\0") + bytes(32) + np.array([1, 2, -4], kind).tobytes()
        assert binary_files.spc_of(raw) == ([10.0, 11.0, 12.0], [x * 2.0 ** (3 - bits) for x in (1, 2, -4)])
    with pytest.raises(ValueError):
        binary_files.spc_of(bytes(600))


@pytest.mark.parametrize("kind,name", [("csv", "t.csv"), ("excel", "t.xlsx"), ("jcamp", "folder")])
def test_round_trips(spark, spectra, tmp_path, kind, name):
    df, axis = spectra
    path = str(tmp_path / name)
    facade.write_spectra(df.coalesce(1) if kind == "jcamp" else df, axis, path, kind)  # one file of several records
    if kind == "jcamp":
        read, found = facade.read_spectra(spark, f"{path}/*.txt", "jcamp")
    else:
        read, found = facade.read_spectra(spark, path)
    assert found == axis
    assert {r["sample_id"]: r["values"] for r in read.collect()} == {r["sample_id"]: r["values"] for r in df.collect()}


@pytest.mark.parametrize("kind,name", [("spc", "a.spc"), ("ascii", "a.dat")])
def test_single_spectrum_files(spark, spectra, tmp_path, kind, name):
    df, axis = spectra
    facade.write_spectra(df, axis, str(tmp_path / name), kind)
    for where in (str(tmp_path / name), str(tmp_path)):
        read, found = facade.read_spectra(spark, where)
        assert found == axis and np.allclose(read.first()["values"], df.orderBy("sample_id").first()["values"], atol=1e-6)


def test_asd_folder(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"Spectrum{k}.asd").write_bytes(asd_file(np.linspace(0.1, 0.9, 150) + k))
    read, axis = facade.read_spectra(spark, str(tmp_path))
    assert len(axis) == 150 and sorted(r["sample_id"] for r in read.collect()) == ["Spectrum0", "Spectrum1"]


def test_excel_with_target(spark, tmp_path):
    rows = [["id", "<note>", "400", "401", "y"], ["a", "x & y", 1.0, 2.0, 3.0], ["b", None, 1.5, None, 4.0], ["c", "t", 0.5, 0.25, "n/a"]]
    assert excel.sheet_rows(excel.workbook(rows))[1] == ["a", "x & y", "1.0", "2.0", "3.0"]
    facade.write_bytes(spark, str(tmp_path / "t.xlsx"), excel.workbook(rows))
    read, axis = excel.read_excel(spark, str(tmp_path / "t.xlsx"), y="y", least=2)
    assert axis == [400.0, 401.0] and [tuple(r) for r in read.collect()] == [("a", [1.0, 2.0], 3.0)]
    assert excel.column_name(0) == "A" and excel.column_name(26) == "AA" and excel.column_number("AB12") == 27


def test_excel_beyond_a_sheet(spark, tmp_path):
    """Rows beyond a sheet's go to further sheets, and all are read; a missing value stays missing."""
    df = spark.createDataFrame([(k, [float(k), None if k == 7 else 0.5]) for k in range(11)], "sample_id long, values array<double>")
    path = str(tmp_path / "t.xlsx")
    excel.write_excel(df.repartition(3), [400.0, 401.0], path, most=5)
    raw = (tmp_path / "t.xlsx").read_bytes()
    assert [r[0] for r in excel.sheet_rows(raw)] == ["sample_id", *map(str, range(11))]
    assert [r[0] for r in excel.sheet_rows(raw, "Spectra (3)")] == ["sample_id", "8", "9", "10"]
    read, axis = excel.read_excel(spark, path, least=2)
    assert axis == [400.0, 401.0] and {(int(r["sample_id"]), *r["values"]) for r in read.collect()} == {(k, float(k), None if k == 7 else 0.5) for k in range(11)}


def test_detection(spark):
    df = spark.createDataFrame([(i, f"n{i}", i % 2, 0.5) for i in range(10)], "k int, `Sample Name` string, grp int, `400` double")
    assert facade.id_column(df, ["400"]) == "k"
    assert facade.id_column(df.withColumnRenamed("Sample Name", "Sample_ID"), ["400"]) == "Sample_ID"
    assert facade.id_column(df.select("grp", "400"), ["400"]) is None
    assert facade.target_column(["a", "%Collagen", "label"], {"a"}) == "%Collagen"
    assert facade.target_column(["a", "b"], {"b"}) == "b"
    assert facade.folder_format(["a.csv", "b.spc", "c.bin"]) == "spc" and facade.folder_format([]) == "unknown"
    assert facade.combined_file(["a.csv", "b.spc"]) == "a.csv" and facade.combined_file(["a.csv", "b.txt"]) is None
    make = lambda v: spark.createDataFrame([(1, v)], "sample_id int, values array<double>")
    assert facade.signal_kind(make([0.8, 0.7, 0.2, 0.7, 0.8] * 4))[0] == "reflectance"
    assert facade.signal_kind(make([0.1, 0.2, 2.5, 0.2, 0.1] * 4))[0] == "absorbance"
    assert facade.signal_kind(make([])) == ("reflectance", 50.0)


def test_long_and_sniffed_tables(spark, tmp_path):
    for name, scale in (("one", 1.0), ("two", 2.0)):
        (tmp_path / f"{name}.csv").write_text("Wavelength_nm,Reflectance,note\n" + "".join(f"{400 + k},{scale * k},x\n" for k in range(120)))
    rows, axis = spectral_files.read_long_csv(spark, str(tmp_path / "*.csv"))
    assert axis == [400.0 + k for k in range(120)] and {r["sample_id"]: r["values"][3] for r in rows.collect()} == {"one": 3.0, "two": 6.0}
    head = ";".join(["specimen_id", *(str(400 + k) for k in range(120)), "protein"])
    (tmp_path / "both.txt").write_text(head + "\n" + "".join(";".join([f"s{i}", *(str(i + k) for k in range(120)), str(i / 2)]) + "\n" for i in range(4)))
    rows, axis = spectral_files.read_combined_csv(spark, str(tmp_path / "both.txt"))
    assert spectral_files.separator(spark, str(tmp_path / "both.txt")) == ";" and len(axis) == 120
    assert {r["sample_id"]: (r["y"], r["values"][1]) for r in rows.collect()} == {f"s{i}": (i / 2, i + 1.0) for i in range(4)}


def opus_file(values, first, last, kind=(3, 4), factor=1.0, more=()):
    """One spectrum of (side, kind), and further ones."""
    blocks = []
    for v, (side, of) in [(values, kind), *more]:
        status = b"".join(n + b"\0" + struct.pack("<HH", t, len(x) // 2) + x for n, t, x in [(b"NPT", 0, struct.pack("<i", len(v))), (b"FXV", 1, struct.pack("<d", first)), (b"LXV", 1, struct.pack("<d", last)), (b"CSF", 1, struct.pack("<d", factor)), (b"DXU", 3, b"WN\0\0")])
        code = 3 | side << 2 | of << 10
        blocks += [(code, np.array(v, "<f4").tobytes()), (code | 1 << 4, status + b"END\0" + bytes(8))]
    at, directory = 24 + 12 * len(blocks), b""
    for code, body in blocks:
        directory += struct.pack("<Iii", code, len(body) // 4, at)
        at += len(body)
    return b"\x0a\x0a\xfe\xfe" + struct.pack("<diii", 920622.0, 24, 40, len(blocks)) + directory + b"".join(b for _, b in blocks)


def sp_file(values, first, last):
    member = lambda code, body: struct.pack("<hi", code, len(body)) + body
    inner = member(-29838, b"??????") + member(-29837, struct.pack("<hdd", 29979, first, last)) + member(-29834, struct.pack("<hi", 29995, len(values)))
    inner += member(-29828, struct.pack("<hi", 29974, 8 * len(values)) + np.array(values, "<f8").tobytes())
    return b"PEPE" + b"made".ljust(40, b"\0") + member(121, b"history") + member(120, inner)


def image_files(folder, stem, tiles, step, first, ending=".seq"):
    """tiles: channels x pixels each."""
    head = bytearray(2300)
    struct.pack_into("<d", head, 2216, step)
    struct.pack_into("<i", head, 2228, first)
    struct.pack_into("<i", head, 2236, len(tiles[0]))
    (folder / f"{stem}{ending}").write_bytes(bytes(head))
    for k, t in enumerate(tiles):
        name = f"{stem}.dat" if ending == ".seq" else f"{stem}_0000_{k:04d}.dmd"
        (folder / name).write_bytes(bytes(4 * 255) + np.array(t, "<f4").tobytes())


def test_vendor_bytes():
    values = [0.25, 0.5, 0.75]
    assert vendor_files.opus_of(opus_file(values, 3000.0, 1000.0)) == ([1000.0, 2000.0, 3000.0], [0.75, 0.5, 0.25])
    # absorbance goes before transmittance, that before a sample's and a reference's spectrum, wherever they stand; a scale factor counts
    assert vendor_files.opus_of(opus_file([9.0] * 3, 1.0, 3.0, (2, 1), more=[([8.0] * 3, (1, 1)), (values, (3, 5))]))[1] == values
    assert vendor_files.opus_of(opus_file(values, 1.0, 3.0, factor=2.0))[1] == [0.5, 1.0, 1.5]
    assert vendor_files.sp_of(sp_file(values, 4000.0, 400.0)) == ([400.0, 2200.0, 4000.0], [0.75, 0.5, 0.25])
    assert vendor_files.asp_of(b"3\n900.0\n700.0\n1\n2\n4\n0.1\n0.2\n0.3\n") == ([700.0, 800.0, 900.0], [0.3, 0.2, 0.1])
    for parse, raw in ((vendor_files.opus_of, b"x" * 99), (vendor_files.sp_of, b"x" * 99), (vendor_files.sp_of, b"PEPE" + bytes(40)), (vendor_files.opus_of, opus_file(values, 1.0, 3.0, (1, 2)))):
        with pytest.raises(ValueError):
            parse(raw)


def test_vendor_folders(spark, tmp_path):
    n = 120
    values = {name: [k / 64 + i for k in range(n)] for i, name in enumerate(("a", "b"))}
    folders = {kind: tmp_path / kind for kind in ("opus", "perkinelmer", "agilent")}
    for f in folders.values():
        f.mkdir()
    for name, v in values.items():
        (folders["opus"] / f"{name}.0").write_bytes(opus_file([0.0] * n, 1000.0, 1000.0 + n - 1))
        (folders["opus"] / f"{name}.1").write_bytes(opus_file(v, 1000.0, 1000.0 + n - 1))  # the last of equal stems stays
        (folders["perkinelmer"] / f"{name}.SP").write_bytes(sp_file(v, 1000.0, 1000.0 + n - 1))
        (folders["agilent"] / f"{name}.asp").write_text("\n".join(map(str, [n, 1000.0, 1000.0 + n - 1, 1, 2, 4, *v])))
    for kind, folder in folders.items():
        read, axis = facade.read_spectra(spark, str(folder))
        assert axis == [1000.0 + k for k in range(n)] and {r["sample_id"]: r["values"] for r in read.collect()} == values, kind
    one, _ = facade.read_spectra(spark, str(folders["opus"] / "b.0"))
    assert [r["values"] for r in one.collect()] == [[0.0] * n]


@pytest.mark.parametrize("ending,count", [(".seq", 1), (".dmt", 3)])
def test_agilent_images(spark, tmp_path, ending, count):
    n = 110
    tiles = [np.arange(n * 4).reshape(n, 4) + 1000.0 * k for k in range(count)]
    image_files(tmp_path, "scan", tiles, 2.0, 500, ending)
    every = np.concatenate(tiles, axis=1)
    want = {"total": every.sum(axis=1), "mean": every.mean(axis=1), "first": every[:, 0]}
    for path in (tmp_path, tmp_path / f"scan{ending}"):
        for mode, v in want.items():
            read, axis = facade.read_spectra(spark, str(path), "agilent", mode=mode)
            assert axis == [1000.0 + 2 * k for k in range(n)] and [(r["sample_id"], r["values"]) for r in read.collect()] == [("scan", v.tolist())]
    with pytest.raises(ValueError):
        facade.read_spectra(spark, str(tmp_path), "agilent", mode="some")


def test_broken_vendor_files_are_named(spark, tmp_path):
    for name in ("a.0", "a.sp", "a.asp"):
        (tmp_path / name).write_bytes(b"1")
        with pytest.raises(Exception, match=name):
            facade.read_spectra(spark, str(tmp_path / name))
    (tmp_path / "a.bsw").write_bytes(b"1")
    with pytest.raises(ValueError, match="bsw"):
        facade.read_spectra(spark, str(tmp_path / "a.bsw"))
