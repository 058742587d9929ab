"""Widths of characters are looked up once each, and equal the table of classes."""

from pyspark.sql import functions as F

from quire.operators import layout as Y
from quire.plans import load
from tests.test_movement import DATA


def width(c):
    if c in " \u00a0":
        return 26
    if "⺀" <= c <= "鿿" or "＀" <= c <= "￯":
        return 100
    for chars, w in (("iljtfrI.,;:'!|()[]{}/`\"-·’‘", 30), ("mwMW@%", 86), ("0123456789", 50), ("ABCDGHKNOQRUVXY", 72), ("EFJLPSTZ", 62)):
        if c in chars:
            return w
    return 48


def test_widths_of_all_classes(spark):
    texts = ["", "  ", "It’s ‘so’ · wide: 中文（ＡＢ）", "Mm Ww 100% @ [x]", "ÀÉ ñ ł 😀 ⹿⺀鿿ꀀ＀￯￰", "".join(map(chr, range(1, 400)))]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.w for r in d.select("s", Y.text_width(F.col("s")).alias("w")).collect()}
    assert got == {t: sum(map(width, t)) for t in texts}


def test_a_cut_run_is_not_searched_by_patterns(spark):
    plan = load()[0]["L16_partial_runs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "translate(" not in plan
