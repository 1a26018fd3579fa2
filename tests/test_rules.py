"""The rules of form checking on small inputs, and against plain versions of them."""

from __future__ import annotations

import json
import random
import time
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.operators import corpus as C
from vouch.operators import evidence as E
from vouch.operators import form, imaging, matchers, ocr, results
from vouch.sources import intake, stored
from vouch.streaming import applications

LINE = "app_id long, img_pos int, image string, line_pos int, text string, conf double, x1 int, y1 int, x2 int, y2 int"
QA = "app_id long, pos int, num string, question string, answer string"


def label(spark, *lines, image="p2_2.png"):
    rows = [(1, 0, image, i, text, 0.9, 1, 2, 3, 4) for i, text in enumerate(lines)]
    return C.corpus(spark.createDataFrame(rows, LINE))


def verdict(spark, question, answer, *lines):
    asked = matchers.answers(spark.createDataFrame([(1, 0, "1", question, answer)], QA))
    return matchers.verdicts(asked, label(spark, *lines)).first()


def plain_norm(text):
    out, boundary = "", True
    for c in text:
        if ord(c) < 128:
            if c.isalnum():
                out, boundary = out + c.lower(), False
            elif not boundary:
                out, boundary = out + " ", True
        elif 0x300 <= ord(c) <= 0x36F or c in "×÷":
            continue
        elif 0xC0 <= ord(c) <= 0xFF:
            letters = T.LIGATURES.get(c) or {"Ð": "D", "ð": "d", "Ø": "O", "ø": "o"}.get(c) or unicodedata.normalize("NFD", c)[0]
            out, boundary = out + letters, False
        else:
            out, boundary = out + ("" if boundary else " ") + "a", True
    return out.rstrip(" ")


def test_norm(spark):
    fixed = {"CHÂTEAU": "chAteau", "d’oro": "d aoro", "14°": "14 a", "a中-b": "a ab", "Æß×": "AEss", "": "", "---": ""}
    rng = random.Random(5)
    made = ["".join(rng.choice("abZ 09.-%ÉéßÆæþÞ×÷ñ́ ’°中😀\x01\x02\t\n") for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts = [*fixed, *made]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.norm("t").alias("n")).collect()
    for row in rows:
        assert row.n == plain_norm(row.t), ascii(row.t)
        assert row.n == fixed.get(row.t, row.n)


def test_field_kind_takes_the_first_rule(spark):
    asked = "15. SHOW ANY INFORMATION THAT IS BLOWN (e.g., net contents)"
    assert spark.createDataFrame([(asked,)], "q string").select(T.field_kind("q")).first()[0] == "Wording"


@pytest.mark.parametrize(
    ("question", "answer", "lines", "status"),
    [
        ("BRAND NAME", "CARLO GIACOSA", ["CARLOGIACOSA"], "MATCH"),
        ("NAME AND ADDRESS", "LE VIGNOBLE, LLC 9369 ROCKY HILLS DR CORDOVA TN 38018 LE VIGNOBLE (Used on label)", ["LEVIGNOBLE,CORDOVA,TN"], "MATCH"),
        ("NAME AND ADDRESS", "LE VIGNOBLE, LLC", ["LEVIGNOBLE"], "SKIP"),
        ("TYPE OF PRODUCT", "WINE", ["REDWINE-CONTAINSSULFITES"], "MATCH"),
        ("BRAND NAME", "---", ["anything"], "NOT FOUND"),
        ("ALCOHOL CONTENT", "14.5", ["14.5% ALC/VOL"], "MATCH"),
        ("ALCOHOL CONTENT", "14.5", ["14.5%"], "NOT FOUND"),
        ("NET CONTENTS", "750 ml", ["750 mi"], "MATCH"),
        ("NET CONTENTS", "750 MILLILITERS", ["750ML"], "MATCH"),
        ("NET CONTENTS", "1.5 liters", ["1.5 L"], "NOT FOUND"),
        ("SHOW ANY WORDING", "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jjjj", ["aaaa bbbb cccc dddd", "eeee ffff gggg hhhh iiii"], "MATCH"),
        ("SHOW ANY WORDING", "aaaa bbbb", ["aaaa"], "PARTIAL"),
        ("SHOW ANY WORDING", "aaaa bbbb cccc", ["aaaa"], "NOT FOUND"),
        ("SHOW ANY WORDING", "abc of it", ["abc"], "EMPTY"),
        ("PHONE", "555", ["555"], "SKIP"),
    ],
)
def test_verdicts(spark, question, answer, lines, status):
    row = verdict(spark, question, answer, *lines)
    assert row.status == status
    if question == "BRAND NAME" and status == "MATCH":
        assert (row.image, row.found_n, row.of_n) == ("multiple", 2, 2) or row.line == "CARLOGIACOSA"
    if question == "SHOW ANY WORDING" and status == "NOT FOUND":
        assert row.found


def test_first_line_wins(spark):
    assert verdict(spark, "BRAND NAME", "abc", "none", "x abc y", "abc").line == "x abc y"


WARNING = ["GOVERNMENT WARNING: ACCORDING TO THE SURGEON GENERAL", "WOMEN SHOULD NOT DRINK DURING PREGNANCY", "RISK OF BIRTH DEFECTS", "CONSUMPTION OF ALCOHOLIC BEVERAGES", "IMPAIRS YOUR ABILITY TO DRIVE", "HEALTH", "PROBLEMS"]


def test_mandatory_row_is_last_and_always_there(spark):
    qa = spark.createDataFrame([(1, 0, "6", "BRAND NAME", "abc"), (2, 0, "6", "BRAND NAME", "abc"), (2, 1, "7", "FANCIFUL NAME", " ")], QA)
    apps = spark.createDataFrame([(1,), (2,), (3,)], "app_id long")
    rows = matchers.matches(apps, qa, label(spark, *WARNING)).filter("mandatory").orderBy("app_id").collect()
    assert [(r.app_id, r.pos, r.status, r.found_n) for r in rows] == [(1, 1, "MATCH", 8), (2, 1, "NOT FOUND", 0), (3, 0, "NOT FOUND", 0)]
    assert rows[1].mandatory_message == "NOT SEEN - government warning is mandatory"


def test_class_type(spark):
    pages = spark.createDataFrame([(1, 2, "x\nCLASS/TYPE DESCRIPTION\nTABLE RED WINE\n"), (2, 1, "")], "app_id long, page int, text string")
    rows = {r.app_id: r for r in matchers.class_type(pages, label(spark, "REDWINE-CONTAINSSULFITES")).collect()}
    assert (rows[1].status, rows[1].matched_as, rows[2].status) == ("MATCH", "red wine", "SKIP")


def test_form_entries(spark):
    page = "\n".join(["OMB No. 1", "before", "6. BRAND NAME (Required)", "Prinsi", "(If any)", "two", "8. NAME AND ADDRESS OF", "APPLICANT (Required)", "ACME", "PART II - X", "lost", "9. LAST", "kept", ""])
    rows = form.form_entries(spark.createDataFrame([(1, 1, page)], "app_id long, page int, text string")).orderBy("pos").collect()
    assert [(r.num, r.question, r.answer) for r in rows] == [("6", "6. BRAND NAME (Required)", "Prinsi two"), ("8", "8. NAME AND ADDRESS OF APPLICANT (Required)", "ACME"), ("9", "9. LAST", "kept")]


def test_checkbox_margin_and_floor(spark):
    rows = [(1, "WINE", 0, 0.35), (1, "MALT BEVERAGE", 1, 0.30), (2, "WINE", 0, 0.29), (3, "WINE", 0, 0.5), (3, "MALT BEVERAGE", 1, 0.4)]
    found = form.product_of_checkboxes(spark.createDataFrame(rows, "app_id long, option string, option_pos int, dark_ratio double")).collect()
    assert {r.app_id: r.product for r in found} == {1: "", 2: "", 3: "WINE" if 0.5 - 0.4 >= 0.1 else ""}


def test_images_kept(spark):
    rows = [(1, 1, 0, 49, 200), (1, 4, 1, 90, 90), (1, 3, 2, 50, 50), (1, 3, 3, 60, 60)]
    blocks = spark.createDataFrame([(*r, 0, 0, 1, 1) for r in rows], "app_id long, page int, block_seq int, w int, h int, x0 int, y0 int, x1 int, y1 int")
    assert [r.name for r in ocr.page_images(blocks).orderBy("img_pos").collect()] == ["p3_1.png", "p3_2.png"]


def words_of(rng, n):
    return [(1, "i", i, rng.choice(["Wine", "WINE", "red"]), float(rng.randrange(4)), rng.randrange(60), rng.randrange(40), rng.randrange(1, 30), rng.randrange(1, 20)) for i in range(n)]


def test_merging_and_grouping_words(spark):
    rng = random.Random(3)
    for n in (0, 1, 5, 25):
        rows = words_of(rng, n)
        df = spark.createDataFrame(rows, "app_id long, image string, seq int, text string, conf double, x int, y int, w int, h int")
        kept = []
        for r in sorted(rows, key=lambda r: (-r[4], -r[7] * r[8], r[2])):
            def shared(k, r=r):
                a = max(0, min(r[5] + r[7], k[5] + k[7]) - max(r[5], k[5])) * max(0, min(r[6] + r[8], k[6] + k[8]) - max(r[6], k[6]))
                return a / min(r[7] * r[8], k[7] * k[8])
            if not any(shared(k) >= 0.5 or (shared(k) > 0.2 and k[3].lower() == r[3].lower()) for k in kept):
                kept.append(r)
        assert [r.seq for r in ocr.merged_words(df).orderBy("place").collect()] == [k[2] for k in kept]
        lines = []
        for r in sorted(rows, key=lambda r: (r[6], r[2])):
            mid = lambda w: w[6] + w[8] / 2
            for line in lines:
                if abs(mid(r) - (mid(line[0]) + mid(line[-1])) / 2) < 0.6 * max(r[8], max(w[8] for w in line)):
                    line.append(r)
                    break
            else:
                lines.append([r])
        lines = sorted(([*sorted(line, key=lambda w: (w[5], w[2]))] for line in lines), key=lambda line: line[0][6])
        found = ocr.grouped_lines(df).orderBy("line_pos").collect()
        assert [(r.text, r.x1, r.y2) for r in found] == [(" ".join(w[3] for w in line), min(w[5] for w in line), max(w[6] + w[8] for w in line)) for line in lines]


def test_many_words_in_one_image():
    """Kept boxes and open lines near a word are looked at, not all: the work grows with the words, not with their square."""
    rng = random.Random(11)
    words = [{"text": f"w{i % 7}", "conf": 0.5, "x": rng.randint(0, 9000), "y": rng.randint(0, 9000), "w": rng.choice((20, 40, 3000 if i % 500 == 0 else 60)), "h": rng.randint(8, 20), "seq": i} for i in range(20_000)]
    began = time.process_time()
    kept = ocr._suppressed([dict(w) for w in words])
    lines = ocr._swept(sorted((dict(w) for w in words), key=lambda w: (w["y"], w["seq"])))
    assert time.process_time() - began < 20
    boxes = [{"low": k[1], "x": k[3], "y": k[4], "w": k[5], "h": k[6]} for k in kept]
    assert not any(ocr._same_word(a, b) for i, a in enumerate(boxes[:400]) for b in boxes[:i]) and len(lines) > 1
    assert sum(len(line[1].split()) for line in lines) == 20_000


def test_overlap(spark):
    rng = random.Random(2)
    pairs = [[rng.randint(0, 9) if i % 4 < 2 else rng.randint(1, 9) for i in range(8)] for _ in range(60)]
    names = ["ax", "ay", "aw", "ah", "bx", "by", "bw", "bh"]
    found = spark.createDataFrame(pairs, names).select(*names, T.overlap(*map(F.col, names)).alias("o")).collect()
    for r in found:
        cells = lambda x, y, w, h: {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
        a, b = cells(*r[:4]), cells(*r[4:8])
        assert r.o == pytest.approx(len(a & b) / min(len(a), len(b)))


def test_imaging_against_loops():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (2, 7), (9, 9), (40, 31)):
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        big = imaging.resized(image, 2 * w, 2 * h)
        for y in range(2 * h):
            for x in range(2 * w):
                y0, x0 = min(int(y / 2), h - 1), min(int(x / 2), w - 1)
                y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), y / 2 - y0, x / 2 - x0
                v = (1 - fy) * ((1 - fx) * image[y0, x0] + fx * image[y0, x1]) + fy * ((1 - fx) * image[y1, x0] + fx * image[y1, x1])
                assert big[y, x] == int(v + 0.5)
        r = min(2, min(h, w) // 2)
        rows = np.array([[sum(int(image[y, min(max(x + k, 0), w - 1)]) for k in range(-r, r + 1)) // (2 * r + 1) for x in range(w)] for y in range(h)])
        both = np.array([[sum(int(rows[min(max(y + k, 0), h - 1), x]) for k in range(-r, r + 1)) // (2 * r + 1) for x in range(w)] for y in range(h)])
        assert (imaging.blurred(image, 2) == both).all()
        win = min(25, (min(h, w) - 1) | 1)
        if win >= 3:
            q = win // 2
            for y in range(h):
                for x in range(w):
                    box = image[max(0, y - q) : y + q + 1, max(0, x - q) : x + q + 1].astype(float)
                    n = (y + q + 1 - max(0, y - q)) * (x + q + 1 - max(0, x - q))
                    mean = box.sum() / n
                    sd = max(0.0, (box**2).sum() / n - mean * mean) ** 0.5
                    assert imaging.binarised(image)[y, x] == (255 if image[y, x] > mean * (1 + 0.2 * (sd / 128 - 1)) else 0)
    assert imaging.is_dark(np.full((3, 3), 109, np.uint8)) and not imaging.is_dark(np.full((3, 3), 110, np.uint8))


def test_uploads_and_runs(spark):
    rows = [("../escape.pdf", 10, "%PDF-"), ("a.pdf", 10, "plain text"), ("a.pdf", 14, "%PDF-1.7"), ("a.PDF", 8, "x%PDF-")]
    df = spark.createDataFrame(rows, "name string, size long, head string")
    assert [r[0] for r in df.select(intake.upload_status("name", "size", "head", 8)).collect()] == [400, 413, 413, 200]
    assert [r[0] for r in df.select(intake.upload_status("name", "size", "head", 12)).collect()] == [400, 400, 413, 200]
    runs = spark.createDataFrame([("run_" + "a" * 32,), ("readme_audit",)], "run_id string").withColumn("mtime", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [r.run_id for r in results.expired_runs(runs, F.lit("2024-01-01 02:00:00").cast("timestamp"), 1).collect()] == ["run_" + "a" * 32]


def test_json_intake(spark):
    whole = json.dumps({"ttb_id": 5, "form_qa": [{"num": "6", "question": "q", "answer": 3}, "x", {"question": "r"}]})
    df = spark.createDataFrame([(1, whole), (2, json.dumps([{"answer": "a"}])), (3, "{broken")], "app_id long, json string")
    assert [r.ttb_id for r in intake.form_documents(df).orderBy("app_id").collect()] == ["", "", ""]
    rows = intake.form_entries(intake.form_documents(df)).orderBy("app_id", "pos").collect()
    assert [(r.app_id, r.pos, r.num, r.question) for r in rows] == [(1, 0, "6", "q"), (1, 1, "", "r"), (2, 0, "", "")]
    assert [r.answer for r in rows] == ["", "", "a"]


def test_documents_and_reports(spark):
    qa = spark.createDataFrame([(1, 0, "6", "BRAND NAME", "abc", 10.0, 20.0, 30.0, 1 / 3), (1, 1, "7", "FANCIFUL NAME", "", None, None, None, None)], QA + ", bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    apps, lines = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "app_id long, pdf string"), label(spark, "abc")
    pages = spark.createDataFrame([(1, 1, "TTB ID\n12345678é"), (1, 2, "CLASS/TYPE DESCRIPTION\nABC"), (1, 3, None)], "app_id long, page int, text string")
    images = spark.createDataFrame([(1, 0, 2, "p2_2.png", 10, 20, "x", "1 2 3 4"), (1, 1, 2, "p2_2.png", 11, 20, "y", "1 2 3 4"), (1, 2, 2, "empty.png", 1, 1, "z", "")], "app_id long, img_pos int, page int, name string, width int, height int, path string, bbox string")
    shown = spark.createDataFrame([(1, 1, "document_p1.png", 9, 9, "d")], "app_id long, page int, name string, width int, height int, path string")
    found, kind = matchers.matches(apps, qa, lines), matchers.class_type(pages, lines)
    made = {r.app_id: json.loads(r.json) for r in results.documents(apps, qa, found, kind, pages, images, lines, shown).collect()}
    one, two = made[1], made[2]
    assert list(one) == list(results.KEYS) and one["ttb_id"] == "12345678" and one["pages"][0] == {"page": 1, "chars": 17} and one["raw_text"][2] == ""
    assert [m["status"] for m in one["matches"]] == ["MATCH", "NOT FOUND"] and two["form_qa"] == [] and two["ocr"] == {}
    box = {"x1": 10, "y1": 20, "x2": 30, "y2": 0.333333}
    assert one["matches"][0]["form_bbox"] == box == one["form_qa"][0]["bbox"] and "bbox" not in one["form_qa"][1] and "form_bbox" not in one["matches"][1]
    assert one["ocr"] == {"p2_2.png": {"width": 11, "height": 20, "lines": [{"text": "abc", "conf": 0.9}], "text": "abc"}, "empty.png": {"width": 1, "height": 1, "lines": [], "text": ""}}
    assert one["matches"][0]["evidence"] == {"found": True, "image": "p2_2.png", "line": "abc", "conf": 0.9, "found_n": 0, "of_n": 0, "line_x1": 1, "line_y1": 2, "line_x2": 3, "line_y2": 4}
    assert one["document_pages"][0]["name"] == "document_p1.png" and one["class_type"]["status"] == "MATCH" and len(one["images"]) == 3
    report = results.reports(apps, qa, found, kind, pages, images, lines).filter("app_id = 1").first().report
    for part in (" TTB ID: 12345678\n Pages : [1, 2, 3] (chars: 17, 26, 0)\n\n[1]", "(2 fields)\n    6. BRAND NAME\n          -> abc\n    7. FANCIFUL NAME\n          -> (blank)\n\n[2]", "3 image(s)", "p2 p2_2.png: x (10x20, png)", "    --- p2_2.png ---\n      abc   (conf 1)", '[OK]   6. BRAND NAME', 'conf 0.9', '  [OK]   page-2 class/type: ABC\n        label  : "abc" on p2_2.png (matched as \'abc\')\n===='):
        assert part in report, part


def test_images_are_served_where_they_are(spark, tmp_path):
    run, other = "run_" + "a" * 32, "run_" + "b" * 32
    for path in (f"{run}/images/p2_1.png", f"{run}/p2_2.png", f"{other}/images/deep/p2_3.png"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    asked = spark.createDataFrame([(run, "p2_1.png"), (run, "p2_2.png"), (other, "p2_3.png"), (other, "p2_1.png"), ("run_x", "p2_1.png"), (None, None)], "run_id string, name string")
    assert [r.url for r in results.image_urls(asked, found).collect() if r.url] == [f"/runs/{run}/images/p2_1.png"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in (1, 2):
        bundle = {"app_id": i, "form_qa": [{"pos": 0, "num": "6", "question": "BRAND NAME", "answer": "abc"}], "images": [{"img_pos": 0, "name": "p2_1.png", "lines": [{"text": "abc" if i == 1 else "x", "conf": 1.0, "x1": 0, "y1": 0, "x2": 1, "y2": 1}]}]}
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(bundle))
    query = applications.write_matches(applications.bundles(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).filter("not mandatory").orderBy("app_id").collect()
    assert [(r.app_id, r.status) for r in rows] == [(1, "MATCH"), (2, "NOT FOUND")]


def test_form_and_label_that_arrive_apart(spark, tmp_path):
    at = lambda hours: (datetime(2024, 1, 1) + timedelta(hours=hours)).isoformat() + "Z"
    form_rows = lambda app, hours: {"app_id": app, "arrived": at(hours), "form_qa": [{"pos": 0, "num": "6", "question": "BRAND NAME", "answer": "abc"}]}
    label_rows = lambda app, hours: {"app_id": app, "arrived": at(hours), "images": [{"img_pos": 0, "name": "p2_1.png", "lines": [{"text": "abc", "conf": 1.0, "x1": 0, "y1": 0, "x2": 1, "y2": 1}]}]}
    for name in ("forms", "labels"):
        (tmp_path / name).mkdir()

    def arrive(kind, n, *rows):
        (tmp_path / kind / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))

    def go():
        streams = (applications.bundles(spark, str(tmp_path / kind), ddl=ddl) for kind, ddl in (("forms", applications.FORM_DDL), ("labels", applications.LABEL_DDL)))
        applications.write_met(applications.met(*streams), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
        return sorted((r.app_id, r.status) for r in read("matches").filter("not mandatory").collect()), sorted(r.app_id for r in read("expired").collect())

    arrive("forms", 1, form_rows(1, 0), form_rows(2, 0), form_rows(4, 1))
    arrive("labels", 1, label_rows(3, 0), label_rows(4, 1))
    assert go() == ([(4, "MATCH")], [])
    arrive("labels", 2, label_rows(1, 12))
    arrive("forms", 2, form_rows(5, 12))
    assert go() == ([(1, "MATCH"), (4, "MATCH")], [])
    # two days on, what waited longer than a day is gone: forms 2 and 5 without a label, and the label of 3
    arrive("labels", 3, label_rows(6, 60))
    arrive("forms", 3, form_rows(6, 61))
    found, expired = go()
    assert found == [(1, "MATCH"), (4, "MATCH"), (6, "MATCH")] and expired == [2, 5]
    arrive("labels", 4, label_rows(2, 62), label_rows(7, 62))
    arrive("forms", 4, form_rows(3, 62), form_rows(8, 62))
    assert go() == ([(1, "MATCH"), (4, "MATCH"), (6, "MATCH")], [2, 5])


def test_anchors_over_short_lines(spark):
    """The mandatory text is found run together over many lines, down to one letter each."""
    anchors = "".join(matchers.ANCHORS)
    apps = spark.createDataFrame([(1,), (2,), (3,), (4,)], "app_id long")
    line = lambda app, i, text: (app, i // 50, f"p2_{i // 50 + 1}.png", i % 50, text, 0.9, 1, 2, 3, 4)
    rows = [line(1, i, c) for i, c in enumerate(anchors)] + [line(2, i, t) for i, t in enumerate(["Gov", "ernment W", "-", "arn", "ing", "x"])] + [line(3, i, t) for i, t in enumerate(["health prob", "lem", "", "z s"])]
    found = {r.app_id: r for r in matchers.checklist(apps, C.corpus(spark.createDataFrame(rows, LINE))).collect()}
    assert [found[i].found_n for i in (1, 2, 3, 4)] == [8, 1, 0, 0] and not any(found[i].found for i in (1, 2, 3, 4))
    assert "collect" not in matchers.checklist(apps, C.corpus(spark.createDataFrame(rows, LINE)))._jdf.queryExecution().toString()


def test_seams_hold_all_that_crosses_lines(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.choice((0, 1, 2, 3, 9)))) for _ in range(120)]
    rows = matchers.run_together(label(spark, *lines), 6).orderBy("ord").collect()
    whole, at = "".join(r.nlc for r in rows), 0
    for r in rows:
        assert r.seam == whole[max(0, at - 6) : at + len(r.nlc)]
        at += len(r.nlc)


def test_lookup_by_rarest_gram(spark):
    rng = random.Random(8)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(4)) for _ in range(100_000)]
    needles = [lines[i][3:11].strip() for i in rng.sample(range(100_000), 20)] + ["zzzz", "abz", "ab", "", None, lines[5], lines[99_999]]
    corpus = C.corpus(spark.createDataFrame([(1, 0, "p2_2.png", i, t, 0.9, 1, 2, 3, 4) for i, t in enumerate(lines)], LINE).repartition(4)).cache()
    probes = spark.createDataFrame([(1, i, t) for i, t in enumerate(needles)], "app_id long, pos int, a string")
    plain = E.first_evidence(probes, corpus, ["app_id", "pos"], [E.contains_text("a")])
    indexed = E.first_evidence(probes, corpus, ["app_id", "pos"], [E.contains_text("a")], through="a")
    assert sorted(plain.collect()) == sorted(indexed.collect()) and plain.count() >= 23
    # of 100,000 lines for each probe, those with its rarest three letters are looked at
    assert E.candidates(probes, corpus, "a").count() < 0.02 * 100_000 * len(needles)
    corpus.unpersist()


def test_form_boxes_stay_with_verdicts(spark):
    qa = spark.createDataFrame([(1, 0, "5", "5. BRAND NAME (Required)", "PRINSI", 10.0, 20.0, 30.0, 40.0)], QA + ", bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    first, last = matchers.matches(spark.createDataFrame([(1,)], "app_id long"), qa, label(spark, "Prinsi")).orderBy("pos").collect()
    assert (first.status, first.form_x1, first.form_y1, first.form_x2, first.form_y2) == ("MATCH", 10, 20, 30, 40) and last.mandatory and last.form_x1 is None


def test_boxes_of_widgets(spark):
    qa = spark.createDataFrame([(1, 0, "5", "TYPE OF PRODUCT", ""), (1, 1, "1", "REP. ID. NO.", "x"), (1, 2, "6", "BRAND NAME", "y")], QA)
    of = lambda seq, name, value: (1, seq, name, value, 10.0 * seq, 1.0, 2.0, 3.0)
    widgets = spark.createDataFrame([of(1, "Check Box22", "/Off"), of(2, "Check Box22", "Malt"), of(3, "Check Box22", "wine"), of(4, "6. BRAND NAME", "a"), of(5, "BRAND NAME 2", " b "), of(6, "14. VINTAGE", "1990"), of(7, "15. VINTAGE", "1991")], "app_id long, seq int, name string, value string, x1 double, y1 double, x2 double, y2 double")
    rows = form.with_widgets(qa, widgets).orderBy("pos").collect()
    assert [(r.num, r.question, r.answer, r.bbox_x1) for r in rows] == [("5", "TYPE OF PRODUCT", "MALT BEVERAGE", 30.0), ("6", "BRAND NAME", "b", 75.0), ("14", "14. VINTAGE", "1991", 105.0)]
    assert (rows[0].bbox_y1, rows[0].bbox_x2, rows[0].bbox_y2) == (1.5, 3.0, 4.5)


def test_checkboxes_from_pixels(spark):
    rng = np.random.default_rng(2)
    page = rng.integers(150, 256, (60, 40)).astype(np.uint8)
    sums = imaging.dark_sums(page)
    for x, y in ((20.5, 12.25), (0, 0), (100, 5), (27.7, 40), (16, 3)):
        clip = lambda v, most: min(max(int(np.floor(v * 1.5 + 0.5)), 0), most)
        box = [int(page[b, a]) for a in range(clip(x - 14, 40), clip(x - 6, 40)) for b in range(clip(y - 3, 60), clip(y + 5, 60))]
        assert imaging.dark_ratio(sums, x, y) == pytest.approx(sum(v < 220 for v in box) / len(box) if box else 0.0)
    rasters = spark.createDataFrame([(1, 40, 60, bytearray(page.tobytes())), (2, 40, 60, bytearray(b"x")), (3, 0, 0, None)], "app_id long, w int, h int, pixels binary")
    lines = spark.createDataFrame([(1, i, t, x, y) for i, (t, x, y) in enumerate([("WINE ", 1.0, 1.0), ("WINE", 20.5, 12.25), ("MALT BEVERAGES", 27.7, 30.0), ("WINES", 0.0, 0.0)])], "app_id long, line_pos int, text string, x1 double, y1 double")
    found = {r.option: r for r in imaging.checkbox_ratios(rasters, form.option_lines(lines)).collect()}
    assert set(found) == {"WINE", "MALT BEVERAGE"} and found["WINE"].dark_ratio == imaging.dark_ratio(sums, 20.5, 12.25) and found["MALT BEVERAGE"].option_pos == 2


def test_readers_pages_and_enlarged_images(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-one\ftwo")
    found = intake.files(spark, str(tmp_path))
    pages = intake.page_texts(intake.accepted_pdfs(found), lambda content: [*content.decode().split("\f"), None]).orderBy("page").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "%PDF-one"), (2, "two"), (3, "")]
    shown = ocr.rendered_pages(spark.createDataFrame(pages)).collect()
    assert [(r.page, r.name) for r in shown] == [(1, "document_p1.png")]
    assert [tuple(r) for r in intake.samples(found, "a.pdf").collect()] == [("a.pdf", 0.0, True)] and intake.samples(found, "b.pdf").count() == 0
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    images = spark.createDataFrame([(1, "x.png", 4, 3, bytearray(gray.tobytes())), (2, "y.png", 4, 3, bytearray(b"short")), (3, "z.png", 0, 0, None)], "app_id long, name string, w int, h int, pixels binary")
    made = imaging.enlarged(images, 1.5).collect()
    assert [(r.app_id, r.w, r.h) for r in made] == [(1, 6, 5)] and bytes(made[0].pixels) == imaging.resized(gray, 6, 5).tobytes()


def test_saved_form_of_a_run(spark, tmp_path):
    for path, text in (("run_a/analysis.json", "[1]"), ("run_a/images/analysis.json", "[2]"), ("run_b/images/analysis.json", "[3]"), ("run_c/deep/analysis.json/x", "[4]"), ("run_d/other.json", "[5]")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert sorted(tuple(r) for r in intake.form_data(found).collect()) == [("run_a", "[1]"), ("run_b", "[3]")]


def test_saved_boxes(spark):
    box = {"x1": 1, "y1": 2.5, "x2": 3, "y2": 4}
    given = json.dumps([{"num": "6", "question": "q", "answer": "a", "bbox": box}, {"answer": "b", "bbox": [1, 2]}, {"answer": "c"}])
    rows = intake.form_entries(intake.form_documents(spark.createDataFrame([(1, given)], "app_id long, json string"))).orderBy("pos").collect()
    assert [(r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2) for r in rows] == [(1, 2.5, 3, 4), (None,) * 4, (None,) * 4]


def test_bucketed_tables_are_not_exchanged(spark):
    left, right = (stored.bucketed(spark.range(100).selectExpr("id % 7 AS app_id", f"id AS {c}"), "app_id", (c,), name=c) for c in ("a", "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "app_id").groupBy("app_id").count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in joined.collect()) == 2 * 15 * 15 + 5 * 14 * 14


def test_empty_tables(spark):
    apps, qa = spark.createDataFrame([], "app_id long"), spark.createDataFrame([], QA)
    lines = C.corpus(spark.createDataFrame([], LINE))
    assert matchers.matches(apps, qa, lines).count() == 0
    assert form.form_entries(spark.createDataFrame([], "app_id long, page int, text string")).count() == 0


def test_arrow_batches_have_a_size(spark):
    from vouch.session import BATCH_BYTES, BATCH_BYTES_KEY, ensure_package

    own = spark.newSession()
    own.conf.unset(BATCH_BYTES_KEY)
    ensure_package(own)
    assert own.conf.get(BATCH_BYTES_KEY) == str(BATCH_BYTES)
    own.conf.set(BATCH_BYTES_KEY, "1000000")
    ensure_package(own)
    assert own.conf.get(BATCH_BYTES_KEY) == "1000000"


def test_printed_lines_are_those_of_the_patterns(spark):
    """One pattern from the start and four texts find what FURNITURE and CONTINUATION find, which are tried at every character."""
    listed = ["OMB No. 1", "see omb NO.3", "OMB No", "x https://a", "HTTP://b", "http:/c", "a for TTB use only b", "TTB ID", "ttb id 5", "a TTB ID", "TTB F 5", "TTB F x", "approval", "APPROVALS", "1/2/24, 3:04 PM", "1/2/24, 3:04", "1/2/24, 3:04 pm x", "12/3", "12/3 x"]
    listed += ["(Required)", "NO. (If any)", "no.if any", "Required x", "IF ON LABEL", "application", "application for and", "APPLICATION FORM", "É", "ſ", "1. NAME"]
    rows = spark.createDataFrame([(s,) for s in listed], "s string").select("s", form.is_printed("s").alias("own"), (F.rlike("s", F.lit(form.FURNITURE)) | F.rlike("s", F.lit(form.CONTINUATION))).alias("pattern")).collect()
    assert [(r.s, r.own) for r in rows] == [(r.s, r.pattern) for r in rows] and len({r.own for r in rows}) == 2
    assert form.PRINTED_LINES.startswith("(?i)^(?:")


def test_an_answer_is_one_row_of_the_join(spark):
    """Candidates and words are no rows of their own: they made the rows that are sorted and grouped for an application five times as many."""
    form_qa = spark.createDataFrame([(1, 0, "6", "6. BRAND NAME", "Le Long Nom Du Vin Rouge", None), (1, 1, "15", "15. SHOW ANY INFORMATION", "seven words that are four long maybe", None)], "app_id long, pos int, num string, question string, answer string, bbox string")
    asked = matchers.answers(form_qa)
    assert matchers.probes(asked).count() == 2
    lines = label(spark, "du vin", "le long nom", "rouge words that", "SEVEN maybe")
    rows = {r.pos: r for r in matchers.verdicts(asked, lines).collect()}
    assert (rows[0].status, rows[0].found_n, rows[0].of_n) == ("MATCH", 4, 4) and rows[0].line == "long nom vin rouge"
    assert (rows[1].status, rows[1].found_n, rows[1].of_n) == ("PARTIAL", 5, 6) and rows[1].line == "seven words that long maybe"


def test_numbers_of_patterns(spark):
    """A pattern runs on lines that hold the whole part of its number; the point matches anything."""
    asked = lambda number: matchers.answers(spark.createDataFrame([(1, 0, "11", "11. ALCOHOL CONTENT", number)], "app_id long, pos int, num string, question string, answer string"))
    lines = label(spark, "13 5 % vol", "Alc. 13.5% BY VOL")
    assert matchers.verdicts(asked("13.5"), lines).first().line == "Alc. 13.5% BY VOL"
    assert matchers.verdicts(asked("14.5"), lines).first().status == matchers.verdicts(asked("3.5"), lines).first().status == "NOT FOUND"


def test_lower_case_of_ascii_letters_alone(spark):
    assert [r[0] for r in spark.createDataFrame([("ABZ[`az",), ("ÀÉ Abſ\u212a",), ("",), (None,)], "s string").select(T.ascii_lower("s")).collect()] == ["abz[`az", "ÀÉ abſ\u212a", "", None]


def test_checkbox_ratios_neither_sort_pixels_nor_depend_on_the_pages_beside(spark):
    rng = np.random.default_rng(5)
    sizes = [(24, 84), (30, 60), (24, 84), (1, 1)]
    pages = [np.asarray(rng.integers(0, 256, (h, w)), np.uint8) for w, h in sizes]
    rows = [(i, w, h, bytearray(page.tobytes())) for i, ((w, h), page) in enumerate(zip(sizes, pages))] + [(4, 24, 84, bytearray(b"\x00")), (5, 24, 84, None), (6, None, 84, bytearray(b"\x00"))]
    places = [("WINE", 0, 20.5, 12.25), ("MALT BEVERAGE", 2, 2.0, 50.0)]
    options = spark.createDataFrame([(i, *place) for i in range(8) for place in places], "app_id long, option string, option_pos int, x1 double, y1 double")
    found = imaging.checkbox_ratios(spark.createDataFrame(rows, "app_id long, w int, h int, pixels binary").coalesce(1), options)
    expected = {(i, option): imaging.dark_ratio(imaging.dark_sums(page), x, y) for i, page in enumerate(pages) for option, _, x, y in places}
    assert {(r.app_id, r.option): r.dark_ratio for r in found.collect()} == expected
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_form_lines_are_trimmed_once(spark):
    """The filter of printed lines names a line at many places; the plan trims it at one."""
    pages = spark.range(3).select(F.col("id").alias("app_id"), F.lit(1).alias("page"), F.concat(F.lit(" \t6. BRAND NAME\r\n OMB No. 1\n\n1/2\nÉa "), F.col("id").cast("string"), F.lit(" \n")).alias("text"))
    lines = form.form_lines(pages)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 1
    assert sorted(map(tuple, lines.collect())) == sorted(row for i in range(3) for row in ((i, 0, "6. BRAND NAME"), (i, 4, f"Éa {i}")))
