"""Hand-made rows for rules that SQL tests don't show, and invariance to partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake import sources as S
from pagelake.functions import rules as R
from pagelake.operators import analytics as A
from pagelake.operators import lines as L
from pagelake.operators import pages as PG
from pagelake.operators import rasters as P
from pagelake.operators import regions as O
from pagelake.operators import texts as T

BOX = "page_id long, idx int, x1 int, y1 int, x2 int, y2 int"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def got(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_merge_is_one_greedy_pass(spark):
    # the second box reaches the third only through the union, so the third stays
    d = boxes(spark, [(1, 1, 0, 0, 10, 10), (1, 2, 4, 4, 30, 30), (1, 3, 20, 20, 40, 40), (2, 1, 0, 0, 5, 5)])
    assert got(O.merge_center_overlaps(d), "page_id", "x1", "x2") == [(1, 0, 30), (1, 20, 40), (2, 0, 5)]
    one = got(O.merge_center_overlaps(d.repartition(1)))
    assert one == got(O.merge_center_overlaps(d.repartition(16)))


def test_merge_on_empty_table(spark):
    assert O.merge_overlaps(boxes(spark, [])).count() == 0
    assert O.mask_coverage(boxes(spark, []), 10, 10).count() == 0


def test_crowded_pages_use_cells(spark, monkeypatch):
    rows = [(1, i, (i * 37) % 900, (i * 53) % 900, (i * 37) % 900 + 120, (i * 53) % 900 + 90) for i in range(120)]
    d = boxes(spark, rows)
    plain = got(O.overlap_pairs(d))
    monkeypatch.setattr(O, "CROWDED", 10)
    assert plain and got(O.overlap_pairs(d)) == plain


@pytest.mark.parametrize("crowded", [2000, 5])
def test_merging_against_a_plain_loop(spark, monkeypatch, crowded):
    monkeypatch.setattr(PG, "CROWDED", crowded)
    rng = np.random.default_rng(4)
    rows = []
    for page in range(12):
        for i in range(int(rng.integers(1, 40))):
            x, y = int(rng.integers(0, 300)), int(rng.integers(0, 300))
            rows.append((page, i, x, y, x + int(rng.integers(0, 90)), y + int(rng.integers(0, 90))))
    inside = lambda c, b: b[0] <= c[0] <= b[2] and b[1] <= c[1] <= b[3]
    center = lambda b: ((b[0] + b[2]) // 2, (b[1] + b[3]) // 2)
    centers = lambda a, b: inside(center(a), b) or inside(center(b), a)

    def areas(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w > 0 and h > 0 and 100 * w * h > 20 * (min(size(a), size(b)) or 1)

    def plain(boxes_, test):
        out, left = [], list(boxes_)
        while left:
            first, rest = left[0], left[1:]
            hit = [b for b in rest if test(first, b)]
            out.append(tuple(f(b[k] for b in [first, *hit]) for k, f in enumerate((min, min, max, max))))
            left = [b for b in rest if not test(first, b)]
        return out

    want_c, want_a = [], []
    for page in range(12):
        own = [r[2:] for r in rows if r[0] == page]
        want_c += [(page, *b) for b in plain(own, centers)]
        want_a += [(page, *b) for b in plain(sorted(set(own), key=lambda b: (b[1], b[0], b[3], b[2])), areas)]
    d = boxes(spark, rows).repartition(5)
    assert got(O.merge_center_overlaps(d), "page_id", "x1", "y1", "x2", "y2") == sorted(want_c)
    assert got(O.merge_overlaps(d), "page_id", "x1", "y1", "x2", "y2") == sorted(want_a)


def test_coverage_of_a_crowded_page(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        x, y = int(rng.integers(-5, 40)), int(rng.integers(-5, 30))
        rows.append((1, i, x, y, x + int(rng.integers(0, 9)), y + int(rng.integers(0, 9))))
    canvas = np.zeros((30, 40), bool)
    for _, _, x1, y1, x2, y2 in rows:
        canvas[max(y1, 0) : max(y2 + 1, 0), max(x1, 0) : max(x2 + 1, 0)] = True
    assert got(O.mask_coverage(boxes(spark, rows), 40, 30), "covered") == [(int(canvas.sum()),)]


def test_regions_without_coordinates(spark):
    d = boxes(spark, [(1, 1, 0, 0, 40, 40), (1, 2, None, 0, 5, 5), (1, 3, 10, 10, 30, 30)])
    assert got(O.merge_center_overlaps(d), "idx", "x2") == [(1, 40), (2, 5)]
    raw = d.withColumn("lang_raw", F.lit("ja"))
    assert got(O.clean_regions(raw), "page_id", "idx", "x1", "x2", "page_lang") == [(1, 1, 0, 45, "jpn")]


def test_detection_scores(spark):
    rows = [(1, 1, 10.0, 10.0, 8.0, 6.0, 0.9, [0.2, 0.8]), (1, 2, 10.0, 10.0, 8.0, 6.0, 0.3, [0.9, 0.1]), (1, 3, 10.0, 10.0, 8.0, 6.0, 0.5, [0.7, 0.1])]
    raw = spark.createDataFrame(rows, "page_id long, idx int, cx double, cy double, bw double, bh double, objectness double, scores array<double>")
    d = L.class_scores(raw)
    assert got(d.selectExpr("idx", "cls", "round(conf, 6) c", "x1", "y2")) == [(1, 1, 0.72, 6.0, 13.0)]
    assert got(L.scaled_back(d, F.lit(1.5), F.lit(0.5)), "x1", "y1", "x2", "y2") == [(9, 3, 21, 6)]


def test_overlap_threshold_is_strict_and_of_the_smaller(spark):
    d = boxes(spark, [(1, 1, 0, 0, 10, 10), (1, 2, 8, 0, 18, 10), (1, 3, 7, 0, 17, 10)])
    assert (1, 1, 2) not in got(O.overlap_pairs(d, "area", 20))
    assert (1, 1, 3) in got(O.overlap_pairs(d, "area", 20))


def test_page_language_tie_goes_to_the_first(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 2, "eng"), (1, 3, "jpn"), (2, 1, None)], "page_id long, idx int, lang string")
    assert got(O.page_language(d)) == [(1, "eng"), (2, None)]


def test_symbols(spark):
    d = spark.createDataFrame([("．．．！！",), ("",), ("a!",), ("!\n?",), (None,)], "t string")
    assert [r[0] for r in d.select(R.is_symbol_only(F.col("t"))).collect()] == [True, True, False, False, None]


def test_natural_key(spark):
    d = spark.createDataFrame([("p10",), ("p9",), ("p09b",), ("p",)], "path string")
    assert [r[0] for r in d.orderBy(A.natural_key(F.col("path"))).collect()] == ["p", "p9", "p09b", "p10"]
    long = [f"p{'1' * 25}", f"p{'1' * 24}2", f"p{'9' * 24}"]
    d = spark.createDataFrame([(p,) for p in long], "path string").withColumn("k", A.natural_key(F.col("path")))
    assert [r[0] for r in d.orderBy("k").collect()] == [long[2], long[0], long[1]]


def test_integer_rules(spark):
    rows = [("f", 2, "a", "1_0", " 5 ", "3", "+4", "t"), ("f", 3, "a", "1__0", "1", "1", "1", "t"), ("g", 2, "a", "1", "1", "99999999999", "1", "t"), ("h", 2, "", "1", "1", "1", "1", "t")]
    d = spark.createDataFrame(rows, "file_no string, line long, filename string, startx string, starty string, endx string, endy string, text string")
    ok, errors = T.validate_records(d, strict=False)
    assert got(ok, "x1", "y1", "x2", "y2") == [(3, 4, 10, 5)]
    assert got(errors, "file_no", "error_code") == [("f", "INVALID_INT"), ("g", "INT_TOO_LARGE"), ("h", "EMPTY_FILENAME")]
    assert T.validate_records(d)[0].count() == 0


def test_sections(spark):
    text = "page1.jpg: \na\nb\n\nlost\n\npage2.jpg:\nc:\n"
    rows, errors = T.parse_sections(spark.createDataFrame([(1, text)], "file_no int, value string"), strict=False)
    assert got(rows, "filename", "text") == [("page1.jpg", "a"), ("page1.jpg", "b"), ("page2.jpg", "c:")]
    assert got(errors, "line", "context") == [(5, "lost")]


def test_review(spark):
    r = T.review_start(spark.createDataFrame([(1, 1, "a", 0, 0, 9, 9), (1, 2, "b", 0, 0, 9, 9)], "page_id long, idx int, text string, x1 int, y1 int, x2 int, y2 int"))
    e = spark.createDataFrame(
        [(1, "1", 1, "edit", "A", 0, 0, 0, 0), (1, "1", 2, "delete", "", 0, 0, 0, 0), (1, "2", 3, "delete", "", 0, 0, 0, 0), (1, None, 4, "add", "n", 0, 0, 30, 30), (1, None, 5, "add", "s", 0, 0, 3, 3), (1, "New 1", 6, "edit", "N", 0, 0, 0, 0)],
        "page_id long, label string, seq int, op string, text string, x1 int, y1 int, x2 int, y2 int",
    )
    out = T.apply_review_edits(r, e)
    assert got(out, "label", "text", "status") == [("1", "A", "EditedRemoved"), ("2", "b", "Removed"), ("New 1", "N", "New")]
    assert got(T.review_finish(out), "label", "n_boxes") == [("1", 2), ("New 1", 2)]


def test_a_number_is_free_again_once_its_new_row_is_gone(spark):
    r = T.review_start(spark.createDataFrame([(1, 1, "a", 0, 0, 9, 9)], "page_id long, idx int, text string, x1 int, y1 int, x2 int, y2 int"))
    ops = [(None, "add", "n1"), (None, "add", "n2"), ("New 1", "edit", "N1"), ("New 1", "delete", ""), (None, "add", "n3"), ("New 2", "edit", "N2"), ("New 2", "reset", ""), ("New 9", "edit", "x"), (None, "add", "n4")]
    e = spark.createDataFrame([(1, label, k, op, text, 0, 0, 30, 30) for k, (label, op, text) in enumerate(ops)], "page_id long, label string, seq int, op string, text string, x1 int, y1 int, x2 int, y2 int")
    out = T.apply_review_edits(r, e)
    assert got(out, "label", "text", "status") == [("1", "a", "Normal"), ("New 1", "n3", "New"), ("New 2", "n2", "New"), ("New 3", "n4", "New")]
    again = spark.createDataFrame([(1, "New 2", 1, "delete", "", 0, 0, 0, 0), (1, None, 2, "add", "n5", 0, 0, 30, 30)], e.schema)
    assert got(T.apply_review_edits(out, again), "label", "text") == [("1", "a"), ("New 1", "n3"), ("New 2", "n5"), ("New 3", "n4")]


def test_best_candidate_is_a_fold(spark):
    d = spark.createDataFrame([(1, 0, 4, 10.0), (1, 1, 6, 9.5), (1, 2, 8, 8.9), (1, 3, None, 0.0)], "id long, k int, thickness int, dev double")
    assert got(P.pick_best_candidate(d, "id"), "k", "dev", "failed") == [(3, 0.0, False)]
    assert got(P.pick_best_candidate(d.filter("k < 3"), "id"), "k") == [(2,)]
    assert got(P.pick_best_candidate(d, "id", fast=True), "k") == [(3,)]


def test_dilation_and_border():
    m = np.zeros((7, 7), bool)
    m[3, 3] = True
    assert P.dilate(m, 1).sum() == 5 and P.dilate(m, 2).sum() == 21
    assert P.border(P.dilate(m, 2)).sum() == 16


def test_suppression_keeps_the_best(spark):
    d = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9, 0), (1, 2, 1, 0, 11, 10, 0.8, 0), (1, 3, 1, 0, 11, 10, 0.7, 1), (1, 4, 50, 50, 60, 60, 0.3, 0)], BOX + ", conf double, cls int")
    assert got(L.suppress_overlaps(d), "idx") == [(1,), (3,)]


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('filename,startx,starty,endx,endy,text\nimg1.jpg,100,100,300,200,"two\nlines"\nimg1.jpg,534,275,592,414,x\n')
    (tmp_path / "b.csv").write_text("filename,startx\nimg,1\n")
    rows, errors = S.read_ocr(spark, str(tmp_path / "a.csv"))
    assert got(rows.selectExpr("(x2 - x1) * (y2 - y1) as area", "text")) == [(8062, "x"), (20000, "two\nlines")] and errors.count() == 0
    assert S.read_ocr_csv(spark, str(tmp_path / "b.csv"))[1].count() == 2
    assert got(S.read_ocr(spark, "x.doc")[1], "error_code") == [("INVALID_FORMAT",)]


def test_csv_round_trip(spark, tmp_path):
    rows = [("vol/p10.png", 1, 'say "no", twice', 1, 2, 30, 40), ("vol/p9.png", 2, " spaced ", 5, 6, 7, 8), ("vol/p9.png", 1, "two\nlines", 5, 6, 7, 8), ("vol/p9.png", 3, "", 5, 6, 7, 8)]
    d = spark.createDataFrame(rows, "path string, idx int, text string, x1 int, y1 int, x2 int, y2 int")
    S.write_ocr_csv(d, str(tmp_path / "out"))
    back, errors = S.read_ocr_csv(spark, str(tmp_path / "out"))
    assert errors.count() == 0
    want = [(p, t.replace("\n", "\\n"), *b) for p, _, t, *b in rows]
    assert sorted((r["filename"], r["text"] or "", *(r[c] for c in ("x1", "y1", "x2", "y2"))) for r in back.collect()) == sorted(want)


def test_unreadable_files_give_error_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filename,startx,starty,endx,endy,text\nimg1.jpg,1,1,3,2,x\n")
    rows, errors = S.read_ocr(spark, str(tmp_path / "a.csv"), str(tmp_path / "none.csv"), "b.doc")
    assert rows.count() == 1 and got(errors, "line", "error_code") == [(-1, "INVALID_FORMAT"), (-1, "OS_ERROR")]


def test_decoded_images_become_rasters(spark):
    px = bytes([10, 20, 30] * 4)
    d = spark.createDataFrame([(("a.png", 2, 2, 3, 16, px),), (("b.png", 1, 3, 1, 0, b"\1\2\3"),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    assert [(r[0], r[1], r[2], bytes(r[3])) for r in got(S.image_rasters(d))] == [("a.png", 2, 2, bytes([21] * 4)), ("b.png", 1, 3, b"\1\2\3")]


def test_image_listing(spark, tmp_path):
    for n in ("a.PNG", "b.txt", "c.tif"):
        (tmp_path / n).write_bytes(b"II*\0\x08\0\0\0\x01\0\x15\x01\x03\0\x01\0\0\0\x05\0\0\0")
    ok, bad = S.discover_images(spark, str(tmp_path))
    assert ok.count() == 2 and bad.count() == 1
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert S.reject_multichannel_tiff(files).count() == 2


def test_split_manifest(spark, tmp_path):
    d = spark.createDataFrame([("a.png", 2, "a2.png"), ("a.png", 1, "a1.png"), ("b.png", 1, "b1.png")], "split_from string, segment_no int, segment_path string")
    S.write_split_manifest(d, str(tmp_path / "m"))
    back = spark.read.text(str(tmp_path / "m"))
    assert back.count() == 2
    (tmp_path / "one.json").write_text('{"a.png": ["a1.png", "a2.png"]}')
    assert got(S.read_split_manifest(spark, str(tmp_path / "one.json"))) == [("a.png", 1, "a1.png"), ("a.png", 2, "a2.png")]


@pytest.mark.parametrize("n", [1, 7])
def test_reading_order_does_not_depend_on_partitions(spark, n):
    rows = [(p, i, (i * 71) % 97, (i * 31) % 53, 100, 100) for p in range(5) for i in range(20)]
    d = boxes(spark, rows).withColumn("page_lang", F.lit("jpn"))
    assert got(O.reading_order(d.repartition(n)), "page_id", "idx", "position") == got(O.reading_order(d), "page_id", "idx", "position")


def test_ignored_regions_take_no_part(spark):
    truth = spark.createDataFrame([(1, 1, 0, 0, 10, 10, False), (1, 2, 50, 50, 90, 90, True), (2, 1, 0, 0, 10, 10, True)], BOX + ", ignore boolean")
    dets = boxes(spark, [(1, 1, 0, 0, 10, 9), (1, 2, 60, 60, 70, 70), (1, 3, 40, 40, 60, 60), (2, 1, 1, 1, 9, 9), (3, 1, 0, 0, 5, 5)])
    marked = L.mark_ignored(truth, dets)
    assert got(marked, "page_id", "idx", "ignore") == [(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, True), (3, 1, False)]
    matches = L.match_detections(truth, marked)
    assert got(matches) == [(1, 1, 1)]
    m = {r["page_id"]: (r["precision"], r["recall"]) for r in L.detection_metrics(truth, marked, matches).collect()}
    assert m == {1: (0.5, 1.0), 2: (1.0, 1.0), 3: (0.0, 1.0), None: (1 / 3, 1.0)}
    none = L.detection_metrics(truth.limit(0), dets.limit(0), matches.limit(0))
    assert got(none, "page_id", "precision", "recall", "hmean") == [(None, 0.0, 0.0, 0.0)]


def test_lines_take_the_first_of_equal_blocks(spark):
    lines = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 0, 0, 10, 10), (1, 3, None, 0, 5, 5), (2, 4, 0, 0, 5, 5), (None, 5, 0, 0, 5, 5)], "page_id long, line_no int, x1 int, y1 int, x2 int, y2 int")
    blocks = boxes(spark, [(1, 9, 0, 0, 10, 5), (1, 4, 0, 5, 10, 10), (1, 2, 0, 0, 10, 4), (1, 1, None, None, None, None), (None, 3, 0, 0, 5, 5)])
    assert got(L.assign_lines(lines, blocks), "line_no", "block") == [(1, 4), (2, 4), (3, None), (4, None), (5, None)]
    assert L.assign_lines(lines, blocks.limit(0)).filter("block IS NULL").count() == 5


def test_colour_fits(spark):
    # a white frame with one dark corner pixel around a mask of 4 x 4
    image = np.full((12, 12, 3), 245, np.uint8)
    image[0, 0] = 9
    mask = np.zeros((12, 12), np.uint8)
    mask[4:8, 4:8] = 255
    i = spark.createDataFrame([(1, 12, 12, bytearray(image.tobytes()))], P.IMAGE)
    m = spark.createDataFrame([(1, 12, 12, bytearray(mask.tobytes())), (2, 12, 12, bytearray(mask.tobytes()))], P.IMAGE)
    b = spark.createDataFrame([(1, 1, 3, 3, 9, 9, 1, 1, 11, 11), (1, 2, 0, 0, 2, 2, 0, 0, 3, 3)], "image_id long, idx int, x1 int, y1 int, x2 int, y2 int, ref_x1 int, ref_y1 int, ref_x2 int, ref_y2 int")
    fits = P.fit_masks(i, m, b, color=True)
    assert got(fits) == [(1, 1, 12 - 1, None, 0.0, False, 255, 255, 255)]
    fits = P.fit_statistics(i, m, b, first=1, step=1, steps=2, color=True, off_white=250)
    assert got(fits.filter("k = 0"), "idx", "dev", "r") == [(1, 0.0, 245)]
    dev, colour = P.border_statistics(np.array([[0, 0, 0], [0, 0, 0], [9, 9, 9]], np.uint8), 240)
    assert colour == [0, 0, 0] and abs(dev - np.std([27**0.5, 27**0.5, 108**0.5], ddof=1)) < 1e-9
    assert P.border_statistics(np.array([3, 4], np.uint8), 240) == (0.5, [3, 3, 3])


def test_geometric_median_is_a_minimum():
    p = np.random.default_rng(2).integers(0, 255, (60, 3)).astype(float)
    at = P.weiszfeld(p)
    cost = lambda c: np.linalg.norm(p - c, axis=1).sum()
    assert all(cost(at) <= cost(at + d) + 1e-6 for d in np.vstack((np.eye(3), -np.eye(3))) * 0.5)
    assert P.weiszfeld(np.full((4, 3), 7.0)).tolist() == [7, 7, 7]


def test_clusters_of_aligned_boxes(spark):
    # two rows, the left box of each first; tops within 10 of each other
    d = boxes(spark, [(1, 1, 200, 104, 250, 120), (1, 2, 10, 100, 60, 120), (1, 3, 210, 8, 250, 20), (1, 4, 12, 0, 60, 20)])
    assert [r["idx"] for r in O.cluster_boxes(d).orderBy("position").collect()] == [4, 3, 2, 1]


def test_parts_outside_the_canvas_are_cut(spark):
    px = bytearray(b"\xff" * 4)
    d = spark.createDataFrame([(1, 1, -1, -1, 2, 2, px, 1, 2, 3), (1, 2, 0, 1, 2, 2, px, 4, 5, 6), (1, 3, 9, 9, 2, 2, px, 7, 8, 9)], "image_id long, idx int, x1 int, y1 int, h int, w int, data binary, r int, g int, b int")
    out = np.frombuffer(bytes(P.combine_masks(d, 3, 2).first()["data"]), np.uint8).reshape(2, 3, 4)
    assert out[:, :, 0].tolist() == [[1, 0, 0], [4, 4, 0]] and out[:, :, 3].tolist() == [[255, 0, 0], [255, 255, 0]]


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    (tmp_path / "b.log").write_text("")
    assert sorted(r["value"] for r in S.read_logs(spark, str(tmp_path)).collect())[-1] == "one\ntwo\n"


def test_side_files(spark, tmp_path):
    (tmp_path / "x#raw.json").write_text('{"image_path": "i", "original_path": "o", "scale": 0.5, "blk_list": [{"xyxy": [1, 2, 3, 4], "lines": [[[1, 2], [3, 2], [3, 4], [1, 4]]], "language": "ja", "vertical": true}]}')
    pages, blocks, lines = S.read_detections(spark, str(tmp_path))
    assert got(pages, "original_path", "scale") == [("o", 0.5)] and got(blocks, "idx", "x1", "y2", "language") == [(0, 1, 4, "ja")] and lines.count() == 1
    (tmp_path / "x#clean.json").write_text('{"original_path": "o", "boxes": [[1, 2, 3, 4]], "box_language": [null]}')
    p = S.read_page_boxes(spark, str(tmp_path)).first()
    assert p["boxes"] == [[1, 2, 3, 4]] and p["box_language"] == [None]


def test_components_of_pages_without_blocks_are_uncovered(spark):
    parts = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 100), (1, 2, 0, 0, 10, 10, 50), (2, 1, 0, 0, 10, 10, 100), (3, 1, 0, 0, 20, 10, 200)], BOX + ", area int")
    blocks = boxes(spark, [(2, 1, 5, 0, 30, 30), (3, 1, 11, 0, 30, 30)])
    assert got(L.uncovered_components(parts, blocks), "page_id", "idx") == [(1, 1), (3, 1)]
