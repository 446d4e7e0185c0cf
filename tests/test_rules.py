from pyspark.sql import functions as F

from sieveline.functions.scalar import box_text, box_to_centre, confidence_tier, gradient_hash, hex_to_long, long_to_hex, normalise_key
from sieveline.functions.web import domain, found_urls, is_skipped, suffix_guess, unescaped, url_priority
from sieveline.operators import rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_validation_names_reasons_in_order(spark):
    rows = spark.createDataFrame([(1, 10, 100, 100, 5.0, None), (2, 5000, 300, 300, 5.0, None), (3, 5000, 300, 300, 50.0, "OSError"), (4, 5000, 300, 1300, 50.0, None)], "id int, file_bytes long, width int, height int, blur_variance double, decode_error string")
    got = {r["id"]: (r["reasons"], r["status"]) for r in rules.validate(rows).collect()}
    assert got[1] == (["file_too_small", "width_below_minimum", "height_below_minimum", "likely_blurry"], "rejected")
    assert got[2] == (["likely_blurry"], "pending")
    assert got[3] == (["decode_error:OSError"], "rejected")
    assert got[4] == (["extreme_aspect_ratio"], "rejected")


def test_routing(spark):
    schema = "id int, candidate_class string, reasons array<string>, scores array<struct<name:string,score:double>>"
    s = lambda a, b: [("laksa", a), ("mee_goreng", b)]
    rows = [(1, "laksa", [], s(0.30, 0.18)), (2, "mee_goreng", [], s(0.31, 0.20)), (3, "laksa", ["likely_blurry"], s(0.30, 0.18)), (4, "laksa", [], None), (5, "roti", [], s(0.3, 0.2)), (6, "laksa", [], s(0.1, 0.1)), (7, "laksa", [], s(0.21, 0.2))]
    got = {r["id"]: (r["status"], r["reasons"][-1] if r["reasons"] else None) for r in rules.route_by_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("accepted", None),
        2: ("rejected", "semantic_class_mismatch:laksa"),
        3: ("review", "manual_quality_review_required"),
        4: ("review", "semantic_score_missing"),
        5: ("review", "candidate_class_not_configured"),
        6: ("rejected", "semantic_score_too_low"),
        7: ("review", "semantic_score_borderline"),
    }


def test_label_lines(spark):
    lines = ["0 .5 .5 .5 .5", "0 .5 .5 .5", "x .5 .5 .5 .5", "9 .5 .5 .5 .5", "0 1.5 .5 .5 .5", "0 .5 .5 0 .5"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r["c"] for r in rows.select(rules.box_complaint(F.split("line", " "), [0, 1]).alias("c")).collect()]
    assert got == [None, "fields", "class_not_digits", "class_unknown", "out_of_range", "empty_box"]


def test_scalars(spark):
    assert one(spark, normalise_key(F.lit("\t Nasi  Lemak-x "))) == "nasi_lemak_x"
    assert one(spark, hex_to_long(F.lit("ffffffffffffffff"))) == -1
    assert one(spark, long_to_hex(F.lit(-1).cast("long"))) == "f" * 16
    assert one(spark, gradient_hash(F.array(*map(F.lit, [1.0, 2.0, 1.0, 3.0])))) == 0b101
    assert one(spark, confidence_tier(F.lit(0.5))) == "medium"
    parts = box_to_centre(*[F.lit(float(x)) for x in (9, 4, 495, 370, 500, 375)])
    assert one(spark, box_text(F.lit(5), *parts)) == "5 0.50400000 0.49866667 0.97200000 0.97600000"


def test_web(spark):
    urls = {"http://a/x.SVG": False, "http://a/x.svg": True, "http://a/Logo.png": True, "ftp://a": True}
    for url, skipped in urls.items():
        assert one(spark, is_skipped(F.lit(url))) is skipped
    assert one(spark, domain(F.lit("https://Example.COM:80/images"))) == "example.com:80"
    assert one(spark, suffix_guess(F.lit("http://a/b"), F.lit("image/PNG"))) == ".png"
    assert one(spark, suffix_guess(F.lit("http://a/b.JPEG?x"), F.lit(None).cast("string"))) == ".jpeg"
    assert one(spark, url_priority(F.lit("https://encrypted-tbn0.gstatic.com/x"))) == 2
    assert one(spark, unescaped(F.lit("http:\\/\\/a\\/b%20c+d"))) == "http://a/b c+d"
    page = "<a href='http://z/1.jpg'><script>\"ou\":\"http://y/2.jpg\"</script>"
    assert one(spark, found_urls(F.lit(page), [("(http[^\"']+?\\.jpg)", 1)])) == ["http://y/2.jpg", "http://z/1.jpg"]
