"""Clusters, splits, pressure, rubric, ingestion, masks, pixels, sources and streams on small inputs."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import colour, pixels, scalars, vectors
from plumbline.operators import calibrate, clusters, imaging, ingest, masks, metrics, pressure, rubric, sampling, splits
from plumbline.operators.components import connected_components
from plumbline.sources import readers, sinks


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    want = {x: find(x) for x in parent}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hamming_clusters(spark):
    flip = lambda x, n: x ^ ((1 << n) - 1)
    rows = [(1, "a", 0), (2, "a", flip(0, 8)), (3, "a", flip(0, 17)), (4, "b", 0), (5, "a", 0)]
    items = spark.createDataFrame(rows, "item_id long, brand string, hash long")
    pairs = clusters.hamming_pairs(items, "brand")
    assert {(r["u"], r["v"], r["bits"]) for r in pairs.collect()} == {(1, 2, 8), (1, 5, 0)}
    comp = {r[0]: r[1] for r in clusters.clusters(items, pairs).collect()}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}  # 4 has the same hash in another brand


def test_clusters_are_transitive_and_cosine_is_inclusive(spark):
    at = lambda d: [math.cos(d), math.sin(d)]
    step = math.acos(0.95)
    items = spark.createDataFrame([(i, "a", at(i * step * 0.999999)) for i in range(3)], "item_id long, brand string, vec array<double>")
    pairs = clusters.cosine_pairs(items, "brand")
    assert pairs.count() == 2
    assert {r[1] for r in clusters.clusters(items, pairs).collect()} == {0}


def test_dominant_source_tie_and_missing_date(spark):
    rows = [(1, 1, "x", "fb", None), (1, 2, "x", "ig", None)]
    info = clusters.cluster_info(spark.createDataFrame(rows, "component long, item_id long, brand string, src string, date long")).first()
    assert (info["src"], info["date"], info["n"]) == ("fb", 0, 2)


def info_of(spark, rows):
    return spark.createDataFrame(rows, "component long, brand string, src string, date long, n long")


def test_split_invariants(spark):
    rows = [(i, "anchor" if i % 2 else "other", "fb", i, 1) for i in range(200)]
    found = splits.cluster_splits(info_of(spark, rows), "anchor")
    got = {r[0]: r[1] for r in found.collect()}
    assert len(got) == 200 and set(got.values()) == set(splits.SPLITS)
    assert splits.split_leaks(found).count() == 0
    held = {c for c, s in got.items() if s == "temporal_test"}
    assert held == {i for i in range(1, 200, 2) if i > 169}  # the newest 15 of 100, anchor only


@pytest.mark.parametrize(("n", "train", "test"), [(1, 0, 1), (2, 1, 1)])
def test_tiny_pools(spark, n, train, test):
    got = [r["split"] for r in splits.positional_splits(info_of(spark, [(i, "b", "fb", 0, 1) for i in range(n)]), ["brand", "src"]).collect()]
    assert (got.count("train"), got.count("test")) == (train, test)


def test_one_anchor_cluster_is_held_out(spark):
    assert splits.temporal_holdout(info_of(spark, [(7, "anchor", "fb", 0, 1)]), "anchor").count() == 1


def pool_of(spark, rows):
    return spark.createDataFrame(rows, "selector string, prompt_idx int, item_id long, score double, gold double")


def test_best_of_n(spark):
    rnd = random.Random(3)
    rows = [("s", p, p * 100 + i, float(rnd.randrange(4)), rnd.random()) for p in range(6) for i in range(8)]
    got = {r["n"]: r for r in pressure.bon_curves(pool_of(spark, rows)).collect()}
    by = [[r for r in rows if r[1] == p] for p in range(6)]
    assert got[1]["gold"] == pytest.approx(np.mean([np.mean([r[4] for r in p]) for p in by]))
    tops = [[r[4] for r in p if r[3] == max(x[3] for x in p)] for p in by]
    assert got[8]["gold"] == pytest.approx(np.mean([np.mean(t) for t in tops]))  # ties share the win
    assert got[8]["proxy_sd"] == pytest.approx(0, abs=1e-6)
    assert (got[8]["gold_sd"] > 0) == any(len(t) > 1 for t in tops)
    sims = []
    for _ in range(4000):
        win = [max(rnd.sample(p, 4), key=lambda r: (r[3], rnd.random())) for p in by]
        sims.append(np.mean([w[4] for w in win]))
    assert got[4]["gold"] == pytest.approx(np.mean(sims), abs=4 * np.std(sims) / 60)
    assert got[4]["gold_sd"] == pytest.approx(np.std(sims), rel=0.1)


def test_too_few_prompts_give_no_point(spark):
    assert pressure.bon_curves(pool_of(spark, [("s", p, p, 0.5, 0.5) for p in range(4)])).count() == 0


def test_pairs_stop_at_the_gap(spark):
    rows = [(1, i, s) for i, s in enumerate([1.0, 0.9, 0.5, 0.45, 0.1, 0.0])] + [(2, 10, 0.5), (2, 11, 0.5)]
    got = pressure.preference_pairs(spark.createDataFrame(rows, "prompt_idx int, item_id long, score double")).collect()
    assert {(r["prompt_idx"], r["chosen"], r["rejected"]) for r in got} == {(1, 0, 5), (1, 1, 4)}


def test_hack_gap_without_other_families(spark):
    scores = spark.createDataFrame([("a", s, "brand", v) for s, v in (("base", 0.1), ("tuned", 0.5))], "judge string, stage string, kind string, score double")
    judges = spark.createDataFrame([("a", "f")], "judge string, family string")
    row = pressure.hack_gap(pressure.stage_deltas(scores), judges, "a").first()
    assert row["attacked_delta"] == pytest.approx(0.4) and row["independent_mean"] is None and row["hack_gap"] is None


def test_rubric_replies(spark):
    one = '{"overall_consistency": 7, "reason": "a {b}"}'
    texts = [f"```json\n{one}\n```", f"Here: {one}.", f"[{one}, {one}]", "none", f"{one} {one}", '{"mood": 3}', None]
    got = rubric.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, text string")).orderBy("item_id").collect()
    assert [r["overall_consistency"] for r in got] == [7, 7, 7, None, None, None, None]
    assert [r["error"] for r in got] == [None, None, None, "nojson", "parse", None, "nojson"]


def test_platt_and_logistic(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=400)
    y = (rnd.random(400) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "similarity double, label int")
    a, b = calibrate.platt_newton(df)
    w, c = calibrate.logistic(df.withColumn("f", F.array("similarity")), "f", penalty=0.0)
    assert (a, b) == (pytest.approx(w[0], abs=1e-4), pytest.approx(c, abs=1e-4))
    p = 1 / (1 + np.exp(-(a * x + b)))
    assert abs((p - y).sum()) < 1e-6
    assert calibrate.platt_descent(df, steps=3000, start=(1.0, 0.0))[0] == pytest.approx(a, abs=1e-2)


def test_ingest_nested(spark):
    data = [
        {"pageName": "P", "adArchiveId": "", "startDate": 5, "isActive": True, "snapshot": {"displayFormat": "x", "images": [{"originalImageUrl": "", "resizedImageUrl": "u/1?a"}], "cards": [{"originalImageUrl": "u/2?b", "resizedImageUrl": "z"}]}, "ad_pos": 0},
        {"pageName": "P", "adArchiveId": "9", "snapshot": {"images": [{"originalImageUrl": "u/1?c"}]}, "ad_pos": 1},
        {"pageName": "unmapped", "adArchiveId": "1", "snapshot": {"images": [{"originalImageUrl": "u/9"}]}, "ad_pos": 2},
    ]
    schema = "pageName string, adArchiveId string, startDate bigint, isActive boolean, ad_pos bigint, snapshot struct<displayFormat: string, images: array<struct<originalImageUrl: string, resizedImageUrl: string>>, cards: array<struct<originalImageUrl: string, resizedImageUrl: string>>>"
    ads = spark.createDataFrame([(json.dumps(d),) for d in data], "j string").select(F.from_json("j", schema).alias("a")).select("a.*")
    got = ingest.ad_images(ads, {"P": "brand"}, ("adArchiveId",)).orderBy("ad_pos", "idx").collect()
    assert [(r["brand"], r["ad_id"], r["idx"], r["url"]) for r in got] == [("brand", "unknown", 0, "u/1?a"), ("brand", "unknown", 1, "u/2?b")]


def test_tsv_words(spark):
    tsv = "level\tleft\ttop\twidth\theight\tconf\ttext\n5\t10\t20\t30\t15\t91.5\tHello!\n5\t1\t2\t3\t4\t-1\t\n5\t1\t2\t3\t4\tbad\tx"
    got = masks.ocr_rows(spark.createDataFrame([("i", tsv)], "item_id string, text string"), scale=2).collect()
    assert [(r["word"], r["conf"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got] == [("Hello!", 91.5, 5, 10, 20, 17)]
    marks = masks.wordmarks(spark.createDataFrame([("i", "Hello!", 60.0, 0, 14), ("i", "hello", 59.0, 0, 20)], "item_id string, word string, conf double, y0 int, y1 int"), ["hello"])
    assert marks.count() == 1


def test_scalars(spark):
    row = spark.createDataFrame([("fb:brand/a.jpg", "ff00000000000001", "", "b", 1000.0)], "id string, h string, e string, f string, x double").select(
        scalars.id_source("id"), scalars.id_brand("id"), scalars.id_path("id"), scalars.hash_from_hex("h"), scalars.first_truthy("e", "f"), scalars.sigmoid("x"), scalars.sigmoid(-F.col("x")), scalars.hamming(scalars.hash_from_hex("h"), F.lit(0)), scalars.iso_epoch(F.lit("2024-01-01T00:00:00Z")), scalars.iso_epoch(F.lit("x"))
    ).first()
    assert tuple(row) == ("fb", "brand", "brand/a.jpg", 0xFF00000000000001 - (1 << 64), "b", 1.0, 0.0, 9, 1704067200, None)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<double>, d array<double>, z array<double>")
    row = df.select(vectors.norm("a"), vectors.normalised("a"), vectors.project_out("a", "d"), vectors.normalised("z")).first()
    assert tuple(row) == (5.0, [0.6, 0.8], [0.0, 4.0], None)


#: Published test pairs of the CIEDE2000 formula (Sharma, Wu and Dalal 2005).
PAIRS = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0),
    ((50.0, 2.5, 0.0), (50.0, 0.0, -2.5), 4.3065),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_ciede2000(spark):
    df = spark.createDataFrame([(*p, *q) for p, q, _ in PAIRS], "a double, b double, c double, d double, e double, f double")
    got = [r[0] for r in df.select(colour.ciede2000((F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("e"), F.col("f")))).collect()]
    assert got == pytest.approx([w for *_, w in PAIRS], abs=1e-4)


#: Published Lab values (D65) of pure colours.
PURE = {(255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (255, 0, 0): (53.24, 80.09, 67.20), (0, 255, 0): (87.73, -86.18, 83.18), (0, 0, 255): (32.30, 79.19, -107.86)}


def test_lab_values_and_round_trip(spark):
    drawn = np.random.default_rng(1).integers(0, 256, (50, 3)).tolist()
    rgb = [*PURE, *map(tuple, drawn)]
    df = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(rgb)], "at int, r int, g int, b int")
    lab = colour.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    rows = df.withColumns({n: c for n, c in zip("xyz", lab, strict=True)}).select("x", "y", "z", *colour.lab_to_rgb(F.col("x"), F.col("y"), F.col("z")), "at").orderBy("at").collect()
    for row, want in zip(rows, PURE.values(), strict=False):
        assert tuple(row[:3]) == pytest.approx(want, abs=0.02)
    assert np.array([r[3:6] for r in rows]) == pytest.approx(np.array(rgb), abs=1e-3)


def _image_rows(spark, images, schema="item_id long, height int, width int, pixels binary"):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], bytearray(a.tobytes())) for i, a in enumerate(images)], schema)


def test_image_measures_are_those_of_the_pixels(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (5, 7, 3)).astype(np.uint8), np.full((4, 4, 3), 90, np.uint8), np.zeros((1, 1, 3), np.uint8), np.zeros((0, 0, 3), np.uint8)]
    counts = imaging.colour_counts(_image_rows(spark, images), ["item_id"])
    assert {r[0]: r[1] for r in counts.groupBy("item_id").agg(F.sum("n")).collect()} == {0: 35, 1: 16, 2: 1}
    got = {r["item_id"]: r for r in imaging.colour_stats(counts, ["item_id"]).collect()}
    flat = images[0].reshape(-1, 3).astype(int)
    a, c = flat[:, 0] - flat[:, 1], (flat[:, 0] + flat[:, 1]) / 2 - flat[:, 2]
    assert got[0]["colorfulness"] == pytest.approx((math.hypot(a.std(), c.std()) + 0.3 * math.hypot(a.mean(), c.mean())) / 255)
    assert got[0]["sat_mean"] == pytest.approx(np.mean([(max(p) - min(p)) * 255 // max(p) for p in flat.tolist()]) / 255)
    assert got[1]["colorfulness"] == pytest.approx(0) and got[2]["sat_mean"] == 0


def test_colour_changes(spark):
    one, two = np.zeros((2, 2, 3), np.uint8), np.zeros((2, 2, 3), np.uint8)
    two[0] = 255  # half of the pixels go from black to white
    rows = spark.createDataFrame([("a", 2, 2, bytearray(one.tobytes()), bytearray(two.tobytes())), ("b", 2, 2, bytearray(one.tobytes()), bytearray(one.tobytes()))], "k string, height int, width int, base binary, pixels binary")
    assert {r["k"]: round(r["delta_e"], 3) for r in imaging.colour_changes(rows, ["k"]).collect()} == {"a": 50.0, "b": 0.0}


def test_palettes_of_plain_groups(spark):
    counts = spark.createDataFrame([("x", 255, 0, 0, 30), ("x", 0, 0, 255, 10), ("y", 10, 10, 10, 5)], "g string, r int, g_ int, b int, n long").withColumnsRenamed({"g": "who", "g_": "g"})
    got = {r["who"]: r for r in imaging.palettes(counts, ["who"], 3, 2, 0.08).collect()}
    assert set(got) == {"x"} and got["x"]["share"] == [0.75, 0.25]  # grey alone has no palette; two colours, two centres
    assert got["x"]["centres"][0] == pytest.approx(PURE[255, 0, 0], abs=0.02)
    assert set(r["who"] for r in imaging.palettes(counts, ["who"], 3, 2, 0.08, 6).collect()) == {"x", "y"}  # too few coloured pixels: all count


def test_rule_features_with_words(spark):
    images = _image_rows(spark, [np.full((10, 20, 3), 200, np.uint8), np.full((10, 20, 3), 40, np.uint8)])
    words = spark.createDataFrame([(0, "Acme", 90.0, 0, 0, 10, 15), (0, "thin", 20.0, 0, 0, 9, 9)], "item_id long, word string, conf double, x0 int, y0 int, x1 int, y1 int")
    got = {r["item_id"]: r for r in imaging.rule_features(images, [[60.0, 10.0, 10.0]], words, ["acme"]).collect()}
    assert (got[0]["wordmark"], got[0]["text_frac"]) == (1.0, 0.75) and (got[1]["wordmark"], got[1]["text_frac"]) == (0.0, 0.0)


def test_colour_remap_moves_only_near_colours(spark):
    img = np.array([[[255, 0, 0], [0, 0, 255]]], np.uint8)
    out = imaging.colour_remap(_image_rows(spark, [img]), [PURE[255, 0, 0]], [PURE[0, 255, 0]], 3).first()["pixels"]
    assert tuple(out[3:]) == (0, 0, 255) and tuple(out[:3]) != (255, 0, 0)


def test_images_are_shrunk_and_never_grown():
    img = np.random.default_rng(0).integers(0, 256, (24, 30, 3)).astype(np.uint8)
    assert pixels.bounded(img, 30) is img and (pixels.resize(img, 24, 30) == img).all()
    assert pixels.bounded(img, 10).shape == (8, 10, 3)
    assert (pixels.bounded(np.full((10, 40, 3), 7, np.uint8), 20) == 7).all()


def test_gates_and_repeats(spark):
    ladder = spark.createDataFrame([("b1", 1, 1.0), ("b1", 2, 9.0), ("b2", 1, 3.0), ("b2", 2, 4.0)], "base string, s int, d double")
    assert {r["base"] for r in sampling.rungs_hold(ladder, ["base"], F.col("d") >= 2).collect()} == {"b2"}
    done = spark.createDataFrame([("a", None), ("b", "x")], "item_id string, error string")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    assert {r[0] for r in sampling.still_to_do(items, done, "item_id", F.col("error").isNotNull()).collect()} == {"b", "c"}


def test_sources_and_sinks(spark, tmp_path):
    lines = tmp_path / "s.jsonl"
    lines.write_text("\n".join(json.dumps(d) for d in ({"id": "a", "v": 1}, {"id": "b"}, {"id": "a", "v": 3})))
    assert [tuple(r) for r in readers.line_scores(spark, str(lines), "j", "id", "v", 0.1).collect()] == [("j", "a", pytest.approx(0.3))]
    np.savez(tmp_path / "e.npz", files=np.array(["x", "y"]), vecs=np.eye(2, dtype="float32"))
    assert {(r["id"], tuple(r["vec"])) for r in readers.npz_vectors(spark, str(tmp_path / "e.npz"), "fb:").collect()} == {("fb:x", (1.0, 0.0)), ("fb:y", (0.0, 1.0))}
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "1.json").write_text('{"item_id": "p",\n "overall_consistency": 7}')
    (tmp_path / "cache" / "2.json").write_text('{"item_id": "q", "error": "x"}')
    assert [tuple(r) for r in readers.folder_scores(spark, str(tmp_path / "cache"), "j", "overall_consistency", 10).collect()] == [("j", "p", 0.7)]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "out")
    assert (sinks.append_missing(rows, out, "k"), sinks.append_missing(rows.union(spark.createDataFrame([(3, "c")], "k int, v string")), out, "k")) == (2, 1)
    assert spark.read.parquet(out).count() == 3


def test_stream_resumes(spark, tmp_path):
    from plumbline.streaming.resume import ingest as run

    source = tmp_path / "in"
    source.mkdir()
    go = lambda: run(spark, str(source), "item_id string, score double", str(tmp_path / "sink"), str(tmp_path / "ck"), "item_id")
    (source / "1.json").write_text('{"item_id": "a", "score": 1}\n{"item_id": "b", "score": 2}\n')
    go()
    (source / "2.json").write_text('{"item_id": "b", "score": 9}\n{"item_id": "c", "score": 3}\n')
    go()
    go()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "sink")).select("item_id", "score").collect())) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_detection_is_at_most_the_target(spark):
    df = spark.createDataFrame([("j", float(i % 7), 1) for i in range(300)], "judge string, score double, label int")
    assert metrics.detection(df, ["judge"], "label = 1").first()["fpr_realized"] <= 0.05
