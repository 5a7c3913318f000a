import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import display, text
from lodestone.sources import readers


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Hello, World!", ["hello", "world"]),
        ("parse_pdf_page render-box", ["parse", "pdf", "page", "render", "box"]),
        ("the quick x brown", ["quick", "brown"]),
        ("v2 utf8 3d", ["v2", "utf8", "3d"]),
        ("   ,.;  ", []),
        ("Größe_x naïve-İ 3D", ["größe", "naïve", "i̇", "3d"]),
    ],
)
def test_tokenize(spark, given, want):
    assert one(spark, text.tokenize(F.col("t")), t=given) == want


def test_token_estimates(spark):
    """Against the definitions, over random texts of words and white space."""
    rng = random.Random(3)
    texts = ["", "\n\t "] + ["".join(rng.choice(["mast", "é", "keel ", " ", "\n", "　", "12"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", text.estimate_tokens(F.col("t")).alias("dense"), text.estimate_tokens_by_words(F.col("t")).alias("words")).collect():
        solid = len("".join(r.t.split()))
        assert r.dense == (max(1, solid // 4) if solid else 0)
        assert r.words == math.ceil(len(r.t.split()) * 13 / 10)


def test_headings(spark):
    """A mark of one to six signs and a space; anything else is a line like others."""
    lines = [(f"{lead}{'#' * n}{gap}{name}", n if 1 <= n <= 6 and gap else None, name) for lead in ("", "  ") for n in range(9) for gap in ("", " ") for name in ("Rigging", "Sails # and spars")]
    frame = spark.createDataFrame([(line,) for line, _, _ in lines], "t string").coalesce(1)
    got = frame.select(text.heading_level(F.col("t")).alias("level"), text.heading_title(F.col("t")).alias("title")).collect()
    assert [(r.level, r.title) for r in got] == [(level, name if level else None) for _, level, name in lines]


def test_segments(spark):
    assert one(spark, text.sentence_segments(F.col("t")), t="One. Two! Three? Four") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, text.sentence_segments(F.col("t")), t="a\n\nb 1.5 c") == ["a\n", "b 1.5 c"]
    assert one(spark, text.line_segments(F.col("t")), t="a\n\nb\n") == ["a\n", "\n", "b\n"]


def test_truncated_and_names(spark):
    assert one(spark, text.truncated(F.col("t"), 3), t="  abcd ") == "abc…"
    assert one(spark, text.truncated(F.col("t"), 4), t="  abcd ") == "abcd"
    assert one(spark, text.base_name(F.col("t")), t="a\\b/c//") == "c"
    assert one(spark, text.base_name(F.col("t")), t="//") == "//"
    assert one(spark, text.lossy_utf8(F.col("t")), t=bytearray(b"a\xffb")) == "a�b"


#: Parts of a page with what a reader sees of each.
SEEN = [("<p>Knots</p>", "Knots"), ("<!-- bilge -->", ""), ("<script>let a = '<b>';</script>", ""), ("<STYLE>b {}</STYLE>", ""), ("<ul><li>reef<li>bowline</ul>", "reef bowline"), ("two\n\n  lines", "two lines"), ("<br/>", ""), ("<i title='x'>hitch</i>", "hitch"), ("<script src=u></script >", "")]


def test_html(spark):
    rng, pages = random.Random(5), []
    for _ in range(40):
        parts = [SEEN[k] for k in rng.choices(range(len(SEEN) - 1), k=rng.randint(0, 6))]
        pages.append((" ".join(h for h, _ in parts), " ".join(" ".join(t for _, t in parts).split())))
    framed = [(f"<html><head><title> Ropes\n and {k} </title></head><body>{h}</body></html>", t) for k, (h, t) in enumerate(pages)]
    frame = spark.createDataFrame([(h,) for h, _ in framed], "t string").coalesce(1)
    got = frame.select(text.html_title(F.col("t")).alias("title"), text.html_text(F.col("t")).alias("seen")).collect()
    assert [(r.title, r.seen) for r in got] == [(f"Ropes and {k}", t) for k, (_, t) in enumerate(framed)]
    assert one(spark, text.html_title(F.col("t")), t="<b>no title</b>") is None


@pytest.mark.parametrize(("html", "want"), [("a<!-->b", "ab"), ("a > b", "a b"), ("x<script>never closed", "x"), ("x<p", "x"), ("x<!-- open", "x"), ("a&amp;b", "a&amp;b")])
def test_html_oddities(spark, html, want):
    assert one(spark, text.html_text(F.col("t")), t=html) == want


def test_header_is_not_head(spark):
    page = "<head>h</head><header>Nav</header><p>x</p>"
    assert one(spark, text.html_text(F.col("t")), t=page) == ""
    assert one(spark, text.html_text(F.col("t"), strict_head=False), t=page) == "Nav x"


@pytest.mark.parametrize(
    ("url", "slug"),
    [("https://h.org/org/repo", "org/repo"), ("https://h.org/org/repo.git", "org/repo"), ("git@h.org:org/repo.git", "org/repo"), ("", None), ("not a url", None), ("https://h.org", None), ("https://h.org/only", None)],
)
def test_repo_slug(spark, url, slug):
    assert one(spark, readers.repo_slug(F.col("t")), t=url) == slug
    assert (one(spark, readers.repo_error(F.col("t")), t=url) is None) == (slug is not None)


def test_cache_name(spark):
    assert one(spark, readers.cache_name(F.col("t")), t="rust-lang/car.go") == "rust-lang__car_go"


@pytest.mark.parametrize(("path", "kind"), [("a/b.MD", "markdown"), ("x.rs", "code"), ("x.txt", "plain"), ("x.png", None), ("noext", None), (".md", None)])
def test_text_kind(spark, path, kind):
    assert one(spark, readers.text_kind(F.col("t")), t=path) == kind


def test_display(spark):
    said = "ebb and flood"
    for begin, end in ((0, 3), (4, 7), (8, 13), (5, 99), (0, 50)):
        parts = [(said[:begin], False), (said[begin:end], True), (said[end:], False)]
        assert [tuple(s) for s in one(spark, display.segments(F.col("t"), F.lit(begin), F.lit(end)), t=said)] == [p for p in parts if p[0]]
    assert [s["highlighted"] for s in one(spark, display.highlighted_lines(F.col("t"), F.lit(3), F.lit(2)), t="a\nb\nc\nd")] == [False, True, True, False]
    assert one(spark, display.clock(F.lit(125.9))) == "2:05"
    assert one(spark, display.label_for(F.lit("pdf"))) == "PDF" and one(spark, display.label_for(F.lit("zip"))) == "zip"
    assert one(spark, display.icon_for(F.lit("zip"))) == display.OTHER_ICON
    assert tuple(one(spark, display.bbox_rect(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.5), F.lit(0.4))))) == pytest.approx((10, 20, 40, 20))
    assert one(spark, display.rendered(F.col("t"), F.array(F.lit("c1"))), t="X [^c1]. Y [^z].") == "X 1. Y ."
    assert one(spark, display.rendered(F.col("t"), F.array().cast("array<string>")), t="X [^c1].") == "X [^c1]."
