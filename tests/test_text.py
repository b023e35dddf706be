"""Text functions on hand-made cases."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v " + ("array<string>" if isinstance(value, list) else "string")).select(
        fn(F.col("v"))
    ).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("NULLINIT a1 b c2 d", "a1 bc2 d"),
        ("nullinit", ""),
        ("", ""),
        ("a b c", "abc"),
        ("ts ua5 NULLINIT e3", "tsua5 e3"),
    ],
)
def test_merge_syllables(spark, given, wanted):
    assert one(spark, given, X.merge_syllables) == wanted


def test_strip_tone(spark):
    assert one(spark, "a1 bc2", X.strip_tone) == "a bc"
    assert one(spark, "a  b", X.strip_tone) == " "
    assert one(spark, "", X.strip_tone) == ""


def test_detokenize(spark):
    assert one(spark, ["▁He", "llo", "▁wor", "ld", "</s>"], X.detokenize) == "Hello world"
    assert one(spark, ["▁", "▁a", "<unk>", "_b", "<s>"], X.detokenize) == " a  b"


def test_phoneme_string(spark):
    assert one(spark, ["HH", "AH0", "</s>"], X.phoneme_string) == "HH AH0"


def test_asr_postprocess(spark):
    assert one(spark, list("|HI|Y|"), X.asr_postprocess) == "hi y"
    assert one(spark, ["Ng", "</s>", "A"], lambda c: X.asr_postprocess(c, "none", "</s>")) == "ng   a"
    failed = spark.createDataFrame([(None,)], "v array<string>").select(X.asr_postprocess(F.col("v"))).first()[0]
    assert failed == ""


def test_normalize_line(spark):
    assert one(spark, "  \tÀb C \x1f\n", lambda c: X.normalize_line(c, "prediction")) == "àb c"
    assert one(spark, " X ", lambda c: X.normalize_line(c, "reference")) == "X"


def test_normalize_id(spark):
    assert one(spark, "a.mp3b.mp3", X.normalize_id) == "ab"


def test_strip_lang_tags(spark):
    assert one(spark, ["<lang:fr>", "a", "<lang:de>", "<lang"], X.strip_lang_tags) == ["a", "<lang"]


def words_like_python(spark, text):
    assert one(spark, text, X.words) == text.split()


def test_words_match_python(spark):
    for text in ["", "  a  b ", "a b　c", "x\x1cy\x85z", " ", "a​b"]:
        words_like_python(spark, text)


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Hello, world!", "Hello , world !"),
        ("It's 3.5% of 1,000.", "It's 3.5 % of 1,000 ."),
        ("a..5", "a . .5"),
        ("a...", "a . . ."),
        ("1990-95 e-mail 5-", "1990 - 95 e-mail 5 -"),
        ("&quot;x&quot; &lt;b&gt; &amp;amp;", '" x " < b > & amp ;'),
        ("one-\ntwo\nthree <skipped>x", "onetwo three x"),
        ("end-\n", "end-"),
        ("", ""),
        ("a+b=c/d [e]_{f}", "a + b = c / d [ e ] _ { f }"),
    ],
)
def test_tokenize_13a(spark, given, wanted):
    assert " ".join(one(spark, given, X.tokenize_13a)) == wanted


def plain_13a(text):
    """The published rules as they stand."""
    line = re.sub(f"[{X.SPACES}]+$", "", text).replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in X.ENTITIES:
        line = line.replace(entity, char)
    line = f" {line} "
    for pattern, new in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        line = re.sub(pattern, new, line)
    return [w for w in re.split(f"[{X.SPACES}]+", line) if w]


def test_tokenize_13a_is_the_published_rules(spark):
    draw = random.Random(5)
    pieces = [*"a7.,.,.,- '!_|\\]^&<\né。０\r", " ", "\U0001f600", "&amp;", "lt;", "&quot;", "<skipped>", "-\n", "&am<skipped>p;"]
    texts = [".,5", "a.,b", "...", ",.7", "", *["".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))) for _ in range(4_000)]]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    found = {r.i: r.w for r in df.select("i", X.tokenize_13a(F.col("t")).alias("w")).collect()}
    assert found.pop(len(texts)) is None
    assert found == {i: plain_13a(t) for i, t in enumerate(texts)}


def test_numbered_13a_is_the_published_rules(spark):
    draw = random.Random(6)
    pieces = [*"a7.,.,.,- '!_|\\]^&<\né。０\r\x1c\x85", "\u3000", "\U0001f600", "&amp;", "lt;", "&quot;", "<skipped>", "-\n", "&am<skipped>p;"]
    texts = ["", " ", "a..5", ",.7", " a ", *["".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))) for _ in range(4_000)]]
    lines = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.line_13a(F.col("t")).alias("l")).orderBy("i").collect()
    for kind in (pa.string(), pa.large_string()):
        numbers, sizes = X.numbered_13a(pa.array([r.l for r in lines], kind))
        wanted = [plain_13a(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in wanted]
        pairs = set(zip(numbers.tolist(), (token for w in wanted for token in w), strict=True))
        assert len(pairs) == len({n for n, _ in pairs}) == len({token for _, token in pairs})


def test_numbered_13a_of_nothing():
    for lines in ([], [""], ["", "  "]):
        numbers, sizes = X.numbered_13a(pa.array(lines, pa.string()))
        assert len(numbers) == 0 and sizes.tolist() == [0] * len(lines)


def test_rules_of_13a_search_for_rare_characters_first(spark):
    """Replacements are planned under a condition, and no rule begins at any character."""
    plan = spark.range(1).select(X.tokenize_13a(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in plan and plan.index("CASE WHEN") < plan.index(" replace(")
    assert not any(pattern.lstrip("(").startswith("[^") for pattern, _ in X.MTEVAL_13A_RULES)
