"""Choice between conversions: a case for each branch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import tiers

GOOD = "A paragraph of ordinary prose that goes on for long enough to count as the body of a page of text. " * 8
BETTER = "# One\n" + GOOD
LOST = "가나다라마바사아자차카타파하가나다 " * 12
SPACED = "가나다 라마바 사아자 차카타 파하 " * 20
BROKEN = "| | | |\n" * 40 + "".join(f"# h{k}\n\n" for k in range(30))
POLLUTED = ("![a](b.png)\nab\ncd\nef\n" + GOOD[:200] + "\n") * 12
TINY = "x" * 60
CASES = {
    "good": (dict(base=GOOD), "1"),
    "nothing": (dict(), None),
    "base too short": (dict(base="short", later=[("2", "no"), ("3", GOOD)]), "3"),
    "low": (dict(base=BROKEN, later=[("2", GOOD)]), "2"),
    "low, nothing later": (dict(base=BROKEN), None),
    "polluted, better": (dict(base=POLLUTED, no_ocr=BETTER), "1a"),
    "polluted, worse": (dict(base=POLLUTED, no_ocr=BROKEN), "1"),
    "polluted, failed": (dict(base=POLLUTED), "1"),
    "spacing, better": (dict(base=LOST, force_ocr=SPACED), "1b-spacing"),
    "spacing, Hangul lost": (dict(base=LOST, force_ocr=GOOD), "1"),
    "spacing, failed": (dict(base=LOST), "1"),
    "spacing, too short": (dict(base=LOST, force_ocr="xx", later=[("2", GOOD)]), "2"),
    "spacing, no better": (dict(base=LOST, force_ocr=LOST, later=[("2", GOOD)]), "2"),
    "spacing, worse": (dict(base=LOST, force_ocr=LOST + "\n" + "".join(f"# h{k}\n\n" for k in range(30))), "1"),
    "scan by source": (dict(base=GOOD, force_ocr=BETTER, image_share=0.9), "1b-scan"),
    "scan by source, body lost": (dict(base=GOOD, force_ocr=GOOD[:300], image_share=0.9), "1-scan"),
    "scan by text": (dict(base=TINY, force_ocr=GOOD, pages=5), "1b-scan"),
    "corrupt layer": (dict(base=GOOD, force_ocr=BETTER, name="계약.pdf", layer_chars=900, layer_hangul=3), "1b-scan"),
    "scan failed": (dict(base=GOOD, image_share=0.9), "1-scan"),
}
SCHEMA = "case string, base string, no_ocr string, force_ocr string, later array<struct<tier: string, text: string>>, pages int, image_share double, name string, layer_chars int, layer_hangul int"


def test_branches(spark):
    plain = dict(base=None, no_ocr=None, force_ocr=None, later=None, pages=1, image_share=0.0, name="a.pdf", layer_chars=0, layer_hangul=0)
    rows = [(k, *{**plain, **c}.values()) for k, (c, _) in CASES.items()]
    got = {r.case: r for r in tiers.chosen(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.tier for k, r in got.items()} == {k: t for k, (_, t) in CASES.items()}
    assert got["spacing, better"].converted == SPACED.strip() and got["base too short"].converted == GOOD.strip() and got["nothing"].converted is None


@pytest.mark.parametrize(("text", "score", "decision"), [("x" * 99, 0.0, "reject"), (GOOD, 1.0, "accept"), (BROKEN, 0.4, "reject"), (LOST, 0.6, "retry"), (POLLUTED, 0.6, "retry-no-ocr"), ("# a\n" + GOOD + "\n# b\nno\n", 0.85, "accept")])
def test_quality(spark, text, score, decision):
    r = spark.createDataFrame([(text,)], "t string").select(tiers.quality(F.col("t")).alias("q")).first().q
    assert (round(r.score, 6), r.decision) == (score, decision)


def test_images(spark):
    rows = [("abcd" * 99, "abc" * 99, 1, "1-scan", True), ("abcd", "abcd", 1, "1-scan", False), ("abcd" * 99, "abc" * 99, 1, "1", False), ("abcd", "abc", 1, "1", True), ("abcd" * 99, "abc" * 99, 1, "1b-spacing", False)]
    df = spark.createDataFrame(rows, "raw string, bare string, pages int, tier string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tiers.images_redundant(F.col("raw"), F.col("bare"), F.col("pages"), F.col("tier")).alias("got")).collect())


def test_many_lines_in_one_pass(spark):
    """A text of 4,000 lines is judged in time that grows with its lines, not with their square."""
    import time

    texts = [("\n".join(f"{line} {k}" for k in range(4000)),) for line in ("a line of plain words that is long enough", "![a](b.png)\nab\ncd\nef")]
    start = time.monotonic()
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(tiers.ocr_polluted(F.col("t"))).collect()]
    assert got == [False, True] and time.monotonic() - start < 20
