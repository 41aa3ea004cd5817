from pyspark.sql import functions as F

from foliant.functions import artifacts as A
from foliant.functions import text as T
from foliant.kernels.blocks import join_runs, parse_blocks, split_inline
from foliant.kernels.html import html_to_md


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_word_count_skips_fences(spark):
    assert one(spark, "# Title\n\na **b** c-d — \n```\nx y z\n```\nend", T.word_count) == 5
    assert one(spark, "", T.word_count) == 0
    assert one(spark, None, T.word_count) == 0


def test_sanitize(spark):
    assert one(spark, "a\r\nb -- c\u200b --- \u2014\U000e0041", A.sanitize) == "a\nb - c --- -"
    assert one(spark, "r\u0430re\u202fx\u2009y", A.sanitize) == "rare\u00a0x y"
    assert one(spark, "\ufeffa\ufeffb", A.sanitize) == "\ufeffab"
    # anomalies are those of the input
    assert one(spark, "a\u2014-b -\u200b- \r\u200b\n", A.sanitize) == "a--b -- \n\n"


def test_word_count_is_linear(spark):
    assert one(spark, "=" * 1_000_000 + " a " + "-" * 1_000_000 + "b", T.word_count) == 2


def test_tics_and_typography(spark):
    assert one(spark, "Certainly! The end.\nIl est important de noter que oui", A.remove_tics) == "The end.\noui"
    assert one(spark, "Oui ; non\u00a0! « mot »", A.french_typography) == "Oui\u00a0; non\u00a0! «\u00a0mot\u00a0»"


def test_blank_lines_and_csv(spark):
    assert one(spark, "\n\na\n\n\n\n\n\nb\n\n", T.collapse_blank_lines) == "a\n\n\nb\n"
    assert one(spark, 'a,b\n"x, y",1', T.csv_table) == "| a | b |\n| --- | --- |\n| x, y | 1 |\n"


def test_blocks():
    kinds = lambda md: [b[0] for b in parse_blocks(md)]
    assert kinds("# H\n\ntext\nmore\n\n$$a$$ after\n\n```py\nx\n```\n- a\n- b\n1. c\n> q\n---\n| a |\n| - |") == ["heading", "paragraph", "equation", "code", "bullets", "ordered", "quote", "rule", "table"]
    assert kinds("$$\nopen\n# Next") == ["paragraph", "paragraph", "heading"]
    assert kinds("<div>\n\n<div>\n</div>\n\n</div>\nend") == ["html", "paragraph"]
    assert kinds("<span>x</span>") == ["paragraph"]
    assert kinds("\\begin{align*}\na\n\\end{align*}\n\\begin{foo}\n") == ["equation", "paragraph"]
    assert kinds("- a\n\n- b\n  more\n\nend\n~~~\nx") == ["bullets", "paragraph"]
    assert kinds("a\n<div>\nb") == ["paragraph"] and kinds("\\begin{array}\n") == ["paragraph"]


def test_inline_math():
    assert split_inline(r"a $x$ b \(y\) c") == [(False, "a ", "", ""), (True, "x", "$", "$"), (False, " b ", "", ""), (True, "y", "\\(", "\\)"), (False, " c", "", "")]
    assert split_inline(r"5 \$ $ x$ $$z$$") == [(False, r"5 \$ $ x$ $$z$$", "", "")]
    for text in ("a $x$ b", "\\(a\\) $", "$ $$ \\$ $a b$c$"):
        assert join_runs(split_inline(text)) == text


def test_html():
    md = html_to_md("<head><title>x</title></head><body><h1>A &amp; B</h1><p>one <b>two</b><ul><li>x</li><li>y</li></ul><script>var t='</p>'</script></body>")
    assert md.startswith("# A & B") and "one **two**" in md and "- x\n- y" in md and "var" not in md
