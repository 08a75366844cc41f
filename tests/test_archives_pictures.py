"""The data source of vector archives and the sink of images, on files made here."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import imaging
from plumbline.sources import archives, pictures, readers, sinks

ROW = "name string, height int, width int, pixels binary"


def saved(path: Path, n: int, save=np.savez, order="C", dtype="float32", ids=None):
    vecs = np.random.default_rng(n).normal(size=(n, 5)).astype(dtype)
    names = np.array(ids if ids is not None else [f"é{path.stem}/{i}" for i in range(n)])
    save(path, files=names, vecs=np.asarray(vecs, order=order))
    return {str(k): tuple(np.float32(v).tolist()) for k, v in zip(names, vecs, strict=True)}


def test_archives_are_read_by_ranges_of_rows(spark, tmp_path):
    want = saved(tmp_path / "a.npz", 10000) | saved(tmp_path / "b.npz", 7)
    want |= saved(tmp_path / "deep.npz", 5000, np.savez_compressed) | saved(tmp_path / "f.npz", 4100, order="F", dtype="float64")
    saved(tmp_path / "none.npz", 0, ids=np.array([], dtype="<U3"))
    (tmp_path / "notes.txt").write_text("x")
    found = archives.archive_vectors(spark, str(tmp_path), rows=3000)
    assert found.rdd.getNumPartitions() == 4 + 1 + 1 + 1  # stored rows are split, compressed and transposed ones are not
    assert {r["id"]: tuple(r["vec"]) for r in found.collect()} == want
    one = archives.archive_vectors(spark, str(tmp_path / "b.npz"), "fb:")
    assert {r["id"] for r in one.collect()} == {f"fb:éb/{i}" for i in range(7)}
    assert {(r["id"], tuple(r["vec"])) for r in readers.npz_vectors(spark, str(tmp_path / "b.npz"), "fb:").collect()} == {(r["id"], tuple(r["vec"])) for r in one.collect()}


def test_ids_as_bytes_and_repeated(spark, tmp_path):
    saved(tmp_path / "a.npz", 3, ids=np.array([b"x", b"x", b"y"]))
    assert sorted(r["id"] for r in archives.archive_vectors(spark, str(tmp_path)).collect()) == ["x", "x", "y"]


def test_archives_that_cannot_be_read(spark, tmp_path):
    np.savez(tmp_path / "a.npz", files=np.array(["x"]), vecs=np.eye(2))
    with pytest.raises(Exception, match="do not name the rows"):
        archives.archive_vectors(spark, str(tmp_path)).count()
    np.savez(tmp_path / "a.npz", files=np.array(["x", None], dtype=object), vecs=np.eye(2))
    with pytest.raises(Exception, match="plain values"):
        archives.archive_vectors(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="FileNotFoundError"):
        archives.archive_vectors(spark, str(tmp_path / "gone")).count()
    (tmp_path / "empty").mkdir()
    assert archives.archive_vectors(spark, str(tmp_path / "empty")).count() == 0


def files(folder: Path) -> dict[str, bytes]:
    """Files below the part folders, by the path that the rows name."""
    return {"/".join(p.relative_to(folder).parts[1:]): p.read_bytes() for p in folder.rglob("*.png")}


def drawn(n, seed=0):
    rng = np.random.default_rng(seed)
    made = {f"acme/{i}.png": rng.integers(0, 256, (3 + i % 4, 2 + i % 5, 3)).astype(np.uint8) for i in range(n)}
    return made, [(k, v.shape[0], v.shape[1], bytearray(v.tobytes())) for k, v in made.items()]


def test_images_come_back_as_they_were(spark, tmp_path):
    made, rows = drawn(40)
    out = tmp_path / "out"
    pictures.write_pictures(spark.createDataFrame(rows, ROW).repartition(5).withColumn("more", F.lit(1)), str(out))
    assert {p.name.split("-")[0] for p in out.iterdir() if not p.name.endswith(".crc")} == {"part", "_SUCCESS"}
    listed = readers.image_files(spark, str(out)).collect()
    assert {(r["brand"], r["file"], r["sha1"]) for r in listed} == {(*k.split("/"), hashlib.sha1(d).hexdigest()) for k, d in files(out).items()}
    good = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(str(out)).select("image.*")
    back = imaging.from_image_source(good).collect()
    assert {(r["item_id"].rsplit("/", 1)[1], r["height"], r["width"], bytes(r["pixels"])) for r in back} == {(k.split("/")[1], *v.shape[:2], v.tobytes()) for k, v in made.items()}
    assert pictures.png(*rows[0][1:]) == pictures.png(*rows[0][1:])


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    _, rows = drawn(20)
    out = tmp_path / "out"
    pictures.write_pictures(spark.createDataFrame(rows[:3], ROW), str(out))
    before = files(out)
    for bad in [("acme/bad.png", 9, 9, bytearray(b"abc")), ("../bad.png", 1, 1, bytearray(3)), (None, 1, 1, bytearray(3)), ("acme/none.png", 1, 1, None), ("acme/flat.png", 0, 4, bytearray())]:
        with pytest.raises(Exception, match="image"):
            pictures.write_pictures(spark.createDataFrame([*rows, bad], ROW).repartition(4), str(out))
        assert files(out) == before and not (out / pictures.UNFINISHED).exists() and not (tmp_path / "bad.png").exists()
    with pytest.raises(ValueError, match="more than one"):
        pictures.write_pictures(spark.createDataFrame([rows[0], rows[0]], ROW), str(out))


def test_overwriting_appending_and_nothing(spark, tmp_path):
    _, rows = drawn(6)
    out, frame = tmp_path / "out", lambda r: spark.createDataFrame(r, ROW)
    pictures.write_pictures(frame(rows[:2]), str(out))
    pictures.write_pictures(frame(rows[2:4]), str(out), "append")
    assert set(files(out)) == {r[0] for r in rows[:4]}
    pictures.write_pictures(frame(rows[4:]), str(out))
    assert set(files(out)) == {r[0] for r in rows[4:]}
    pictures.write_pictures(frame([]), str(out))
    assert files(out) == {} and (out / "_SUCCESS").exists()


def test_a_cache_is_purged_in_place(spark, tmp_path):
    cache = str(tmp_path / "cache")
    spark.createDataFrame([("a", None), ("b", "http")], "item_id string, error string").write.parquet(cache)
    for _ in range(2):
        sinks.purge_errors(spark, cache, "item_id string, error string")
        assert [r["item_id"] for r in spark.read.parquet(cache).collect()] == ["a"]
