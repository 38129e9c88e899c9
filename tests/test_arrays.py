"""Array files as a data source: what is read, what isn't, and whole round trips."""

import json
import os

import numpy as np
import pytest

from pixloom.sources import arrays as A
from pixloom.sources import images as S


@pytest.fixture
def folder(tmp_path):
    r = np.random.default_rng(2)
    made = {}
    for name, shape in (("gray", (5, 4)), ("rgb", (6, 3, 3)), ("stack", (9, 2, 3, 4)), ("deep/other", (4, 7, 2, 1)), ("none", (0, 3, 3, 3)), ("flat", (3, 0, 5, 1))):
        made[name] = r.integers(0, 256, shape, np.uint8)
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        np.save(tmp_path / f"{name}.npy", made[name])
    (tmp_path / "_job").mkdir()
    np.save(tmp_path / "_job" / "half.npy", made["gray"])
    (tmp_path / "notes.txt").write_text("no array")
    return tmp_path, made


def wanted(made) -> set:
    out = set()
    for name, a in made.items():
        stack = a if a.ndim == 4 else a.reshape(1, *a.shape, *(1,) * (3 - a.ndim))
        out |= {(name.rsplit("/", 1)[-1], k, x.shape[1], x.shape[0], x.shape[2], x.tobytes()) for k, x in enumerate(stack)}
    return out


def rows(df) -> set:
    return {(r.path.rsplit("/", 1)[1].removesuffix(".npy"), r.item, r.width, r.height, r.channels, bytes(r.data)) for r in df.collect()}


def test_every_image_is_a_row(spark, folder):
    path, made = folder
    df = A.read(spark, str(path))
    assert rows(df) == wanted(made) and df.count() == len(wanted(made))
    assert {r.dtype for r in df.collect()} == {"uint8"} and all(r.image_id is None and r.path.startswith("file:/") for r in df.collect())
    assert rows(A.read(spark, str(path / "stack.npy"))) == wanted({"stack": made["stack"]})
    assert A.read(spark, str(path / "missing")).count() == 0


def test_long_files_are_cut(folder, monkeypatch):
    path, made = folder
    for size in (1, 7, 100, 131, 150, 1000, 1 << 20):
        monkeypatch.setattr(A, "PART_BYTES", size)
        reader = A.ArrayReader({"path": str(path)}, list(A.TYPES))
        parts = reader.partitions()
        assert all(sum(c.high - c.low for c in p.cuts) <= size for p in parts)
        got = [(r["path"].rsplit("/", 1)[1].removesuffix(".npy"), r["item"], r["width"], r["height"], r["channels"], r["data"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == wanted(made)
    assert len(parts) == 1  # small files share a task


class Counted:
    """A file that counts what is read of it beyond its header."""

    total = 0

    def __init__(self, source, top):
        self.source, self.top = source, top

    def read(self, n):
        at = self.source.tell()
        Counted.total += max(0, at + n - max(at, self.top))
        return self.source.read(n)

    def seek(self, at):
        self.source.seek(at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()


class System:
    def __init__(self, real):
        self.real, self.opened = real, []

    def open_input_file(self, path):
        self.opened.append(path)
        with self.real.open_input_file(path) as f:
            top = A.head(f).at
        return Counted(self.real.open_input_file(path), top)


def counted(path, filters, columns=tuple(A.TYPES)):
    """(rows, bytes of samples read, files opened)."""
    reader = A.ArrayReader({"path": str(path), "filters": json.dumps(filters)}, list(columns))
    system, Counted.total = System(A.filesystem(str(path))[0]), 0
    out = [r for p in reader.partitions() for c in p.cuts for r in reader.rows(system, "file:", c)]
    return out, Counted.total, len(system.opened)


def test_filters_on_shape_read_no_samples(folder):
    path, _ = folder
    out, read, opened = counted(path, [("width", "=", 3), ("channels", "=", 4)])
    assert (len(out), read, opened) == (9, 9 * 24, 6)
    assert counted(path, [("height", ">", 99)]) == ([], 0, 6)
    assert counted(path, [("dtype", "=", "float32")])[:2] == ([], 0)
    out, read, _ = counted(path, [("item", "in", [2, 5]), ("width", "!=", 2), ("channels", "not in", [1, 3])])
    assert [r["item"] for r in out] == [2, 5] and read == 2 * 24
    assert counted(path, [("path", "glob", "*rgb.npy")])[1:] == (6 * 3 * 3, 1)  # other files aren't opened
    for bad in (("data", "=", "x"), ("width", "like", 3)):
        with pytest.raises(ValueError):
            counted(path, [bad])


def test_schema_without_data_reads_headers_alone(folder):
    out, read, _ = counted(folder[0], [], ["path", "width", "item"])
    assert len(out) == 1 + 1 + 9 + 4 + 3 and read == 0 and set(out[0]) == {"path", "width", "item"}


def test_filters_and_conditions_through_spark(spark, folder):
    path, made = folder
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    df = A.read(spark, str(path))
    for setting in ("false", "true"):  # whatever another source has set
        spark.conf.set("spark.sql.python.filterPushdown.enabled", setting)
        for where, keep in (("width = 3", lambda r: r[2] == 3), ("width <> 3 and height >= 5", lambda r: r[2] != 3 and r[3] >= 5), ("item between 1 and 2", lambda r: 1 <= r[1] <= 2), ("path like '%stack%' or width is null", lambda r: r[0] == "stack"), ("channels in (1, 3) and data is not null", lambda r: r[4] in (1, 3))):
            assert rows(df.where(where)) == {r for r in wanted(made) if keep(r)}
        assert rows(df) == wanted(made)  # one DataFrame, many queries: none narrows the next
        assert {r["width"]: r["count"] for r in df.where("width = 3").union(df.where("width = 2")).groupBy("width").count().collect()} == {3: 10, 2: 4}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    assert rows(A.read(spark, str(path), filters=[("width", "<=", 3), ("item", "<", 2)])) == {r for r in wanted(made) if r[2] <= 3 and r[1] < 2}
    assert A.read(spark, str(path), columns=["width"]).columns == ["width"]


def test_layouts_orders_and_samples(spark, tmp_path):
    r = np.random.default_rng(3)
    one, many = r.integers(0, 256, (3, 4, 5), np.uint8), r.integers(0, 256, (6, 3, 4, 5), np.uint8)
    for name, a in (("c", one), ("f", np.asfortranarray(one)), ("cs", many), ("fs", np.asfortranarray(many))):
        os.makedirs(tmp_path / "chw", exist_ok=True)
        np.save(tmp_path / "chw" / f"{name}.npy", a)
    got = {(x.path.rsplit("/", 1)[1], x.item): bytes(x.data) for x in A.read(spark, str(tmp_path / "chw"), layout="chw").collect()}
    assert len(got) == 14
    for k in range(6):
        assert got["cs.npy", k] == got["fs.npy", k] == many[k].transpose(1, 2, 0).tobytes()
    assert got["c.npy", 0] == got["f.npy", 0] == one.transpose(1, 2, 0).tobytes()
    os.makedirs(tmp_path / "float")
    np.save(tmp_path / "float" / "big.npy", np.arange(6, dtype=">f4").reshape(2, 3))
    row = A.read(spark, str(tmp_path / "float")).first()
    assert row.dtype == "float32" and bytes(row.data) == np.arange(6, dtype="<f4").tobytes()


@pytest.mark.parametrize("bad", [b"", b"\x93NUMPY", b"text that is no array at all", "complex", "five", "short"])
def test_what_is_no_image_is_named(tmp_path, bad):
    if isinstance(bad, bytes):
        (tmp_path / "bad.npy").write_bytes(bad)
    else:
        np.save(tmp_path / "bad.npy", {"complex": np.zeros((2, 2), complex), "five": np.zeros((2, 2, 5), np.uint8), "short": np.zeros((4, 4), np.uint8)}[bad])
    if bad == "short":
        data = (tmp_path / "bad.npy").read_bytes()
        (tmp_path / "bad.npy").write_bytes(data[:-3])
    reader = A.ArrayReader({"path": str(tmp_path)}, list(A.TYPES))
    with pytest.raises((ValueError, TypeError), match="bad.npy"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_round_trip(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(4)
    shapes = [(2, 3, 1), (2, 3, 3), (4, 4, 3), (1, 1, 4)]
    rows_ = [(None if k == 5 else k * 10, w, h, c, r.integers(0, 256, (h, w, c), np.uint8).tobytes()) for k in range(60) for h, w, c in [shapes[k % 4]]]
    df = spark.createDataFrame(rows_, S.PACKED).repartition(3)
    out = str(tmp_path / "out")
    A.write(df, out)
    back = A.read(spark, out).select("image_id", "width", "height", "channels", "data")
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows_, key=key)
    assert not [x for x in os.listdir(out) if x.startswith("_")]
    assert back.where("image_id = 30").count() == 1
    A.write(df.where("image_id < 100"), out)  # instead of the old files
    assert A.read(spark, out, columns=["item"]).count() == 9
    A.write(df.where("image_id >= 100"), out, "append")
    assert A.read(spark, out, columns=["item"]).count() == 59
    A.write(df.limit(0), out)
    assert A.read(spark, out).count() == 0


def test_stacks_stay_small(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(A, "STACK_BYTES", 40)
    monkeypatch.setattr(A, "HELD_BYTES", 60)
    writer = A.ArrayWriter(str(tmp_path / "o"), True)
    batch = pa.RecordBatch.from_pylist([{"image_id": k, "width": 1 + k % 3, "height": 5, "channels": 1, "data": bytes([k]) * 5 * (1 + k % 3)} for k in range(50)])
    said = writer.write(iter([batch]))
    assert A.listed(str(tmp_path / "o"))[0] == []  # nothing is seen before the commit
    writer.commit([said, None])
    files, _ = A.listed(str(tmp_path / "o"))
    assert len(files) > 10 and all(n <= 128 + 60 and ids for _, n, ids in files)
    reader = A.ArrayReader({"path": str(tmp_path / "o")}, list(A.TYPES))
    got = {r["image_id"]: r["data"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()}
    assert got == {r["image_id"]: r["data"] for r in batch.to_pylist()}


def test_failed_jobs_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 2, 1, b"abcd"), (2, 2, 2, 1, None)], S.PACKED)
    with pytest.raises(Exception, match="null"):
        A.write(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="3 bytes"):
        A.write(spark.createDataFrame([(1, 2, 2, 1, b"abc")], S.PACKED), str(tmp_path / "o"))
    assert A.read(spark, str(tmp_path / "o")).count() == 0


def test_images_of_files_have_ids(spark, folder):
    path, made = folder
    df = S.read_arrays(spark, str(path))
    assert df.columns == ["image_id", "width", "height", "channels", "data", "path"]
    ids = [r.image_id for r in df.collect()]
    assert len(set(ids)) == len(ids) == len(wanted(made))
    np.save(path / "float.npy", np.zeros((2, 2), np.float32))
    with pytest.raises(Exception, match="float32, not uint8"):
        S.read_arrays(spark, str(path)).collect()
