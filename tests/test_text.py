import pytest

from quire.functions import placeholders as P
from quire.functions import text as T


def ev(spark, make, *values):
    names = [f"v{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return frame.selectExpr(f"{make(*names)} as x").first()[0]


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (T.word_count, "a b\x1cc  d\n", 4), (T.word_count, " ", 0), (T.strip, " \x1f x \n", "x"),
        (T.single_line, " a \n b\t", "a b"), (T.single_line, "\n", None), (T.language, " pt-BR ", "pt-BR"), (T.language, "english", None), (T.language, "en\nx", None),
        (T.language_name, "bg", "Bulgarian"), (T.language_name, "pt-BR", "Portuguese"), (T.language_name, "xx", "xx"),
        (T.slug, "  Ünï Tést — 2! ", "ünï-tést-2"), (T.slug, "***", "book"), (T.host, "**https://www.Site.org/**", "site.org"), (T.host, "(site.org/a/)", "site.org/a"),
        (T.unfenced, "```markdown\n# x\n```\n", "# x"), (T.unfenced, "a ``` b", "a ``` b"), (T.cyrillic_ratio, "абв d", 0.75), (T.cyrillic_ratio, "1 2", 0.0),
        (T.is_image_block, " ![a](b.png) ", True), (T.is_image_block, "x ![a](b.png)", False), (T.without_labels, "[BG]\nда\n[EN]\nyes", "да"), (T.without_labels, "да", "да"),
        (T.token_budget, "x" * 9, 512), (T.token_budget, "x" * 3000, 1800), (T.token_budget, "x" * 90000, 16384),
        (T.looks_untranslated, "this is a plain sentence of nine words here", True), (T.looks_untranslated, "това е изречение на кирилица с девет думи тук", False),
        (T.looks_untranslated, "12 34", False), (T.looks_untranslated, "Hello there", False), (T.looks_untranslated, "Something remarkable happened", True),
        (T.fingerprint, "a", "86f7e437faa5a7fc"), (T.folded, "[[1]]Straße[[/1]]  X", "strasse x"),
    ],
)
def test_functions(spark, make, value, expected):
    assert ev(spark, make, value) == expected


def test_lines(spark):
    assert ev(spark, T.lines, "a\r\nb c\n\nd\n") == ["a", "b", "c", "", "d"]


SRC = "A [[1]]bold [[2]]deep[[/2]][[/1]] [[3/]] end"


@pytest.mark.parametrize(
    ("candidate", "parity", "applies", "keeps"),
    [
        ("Б [[1]]б [[2]]д[[/2]][[/1]] [[3/]]", True, True, True), ("[[1]]б [[2]]д[[/1]][[/2]] [[3/]]", True, False, True), ("[[/1]]б[[1]] [[2]]x[[/2]] [[3/]]", True, False, False),
        ("[[1]][[2]]x[[/2]][[/1]][[3/]]", True, True, True), ("[[1]]x[[2]] [[/2]][[/1]][[3/]]", True, True, False), ("[[1]]x[[/1]]", False, True, False), ("[[9/]]", False, False, False), ("x [[1]]", False, False, False),
    ],
)
def test_placeholders(spark, candidate, parity, applies, keeps):
    got = [ev(spark, f, SRC, candidate) for f in (P.parity, P.applies, P.keeps_content)]
    assert got == [parity, applies, keeps]


def test_echo_and_keys(spark):
    s = "one two three four five six seven eight"
    assert ev(spark, T.is_echo, s, s.upper()) and not ev(spark, T.is_echo, "one two", "one two") and not ev(spark, T.is_echo, s, s + " x")
    assert len(ev(spark, T.cache_key, "a", "b")) == 10 and ev(spark, T.cache_key, "a", "b") != ev(spark, T.cache_key, "ab", "")
