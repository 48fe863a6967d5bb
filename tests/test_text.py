"""Text measures against short independent loops."""

import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.functions import stemming, text
from verdigris.operators import rouge

ODD = [
    "",
    " ",
    "The the THE a an",
    "A man, a plan; the canal!",
    "a b c\td\x1ce",
    "Élan the état",
    "_the_ x_a a-b an.the",
    "thé a1 1a a",
    "don't can't the-end",
    "dup dup dup x dup x",
    "日本 the 語",
    "1,234.50 $5",
]


def plain_normal(s):
    s = "".join(c for c in s.lower() if c not in set(string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def plain_f1(gold, answer):
    g, a = plain_normal(gold).split(), plain_normal(answer).split()
    if not g or not a:
        return float(g == a)
    same = sum((Counter(g) & Counter(a)).values())
    if not same:
        return 0.0
    p, r = same / len(a), same / len(g)
    return 2 * p * r / (p + r)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def random_pairs(n, seed=1):
    rng = random.Random(seed)
    words = "the a an cat dog Dog, runs run runs! fast 12 12.5 is".split()
    make = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 40)))
    return [(make(), make()) for _ in range(n)] + [(a, b) for a in ODD for b in ODD]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(random_pairs(150), "gold STRING, answer STRING")


def test_normalize_and_strip(spark):
    rows = spark.createDataFrame([(s,) for s in ODD], "s STRING").select(
        "s", text.normalize_answer(F.col("s")).alias("n"), text.strip(F.col("s")).alias("t")
    ).collect()
    for r in rows:
        assert r["n"] == plain_normal(r["s"]), repr(r["s"])
        assert r["t"] == r["s"].strip()


def test_f1_and_exact_match(pairs):
    rows = pairs.select(
        "gold",
        "answer",
        text.token_f1(F.col("gold"), F.col("answer")).alias("f1"),
        text.token_f1(F.col("answer"), F.col("gold")).alias("swapped"),
        text.exact_match(F.col("gold"), F.col("answer")).alias("em"),
    ).collect()
    for r in rows:
        assert r["f1"] == pytest.approx(plain_f1(r["gold"], r["answer"]), abs=1e-12)
        assert r["f1"] == pytest.approx(r["swapped"], abs=1e-12)
        assert 0 <= r["f1"] <= 1
        assert r["em"] == float(plain_normal(r["gold"]) == plain_normal(r["answer"]))


def test_one_word_filling_a_text(value):
    got = value(
        text.token_f1(F.repeat(F.lit("word "), F.lit(20000)), F.repeat(F.lit("word "), F.lit(10000))),
    )
    assert got == pytest.approx(2 * 0.5 / 1.5)


def test_rouge_without_stemming(pairs):
    rows = rouge.with_best_rouge(pairs.withColumn("target", F.array("gold")), "answer", "target", "r", False).collect()
    for r in rows:
        a, g = (re.findall("[a-z0-9]+", r[c].lower()) for c in ("answer", "gold"))
        n = plain_common(a, g)
        want = 2 * (n / len(a)) * (n / len(g)) / (n / len(a) + n / len(g)) if n else 0.0
        assert r["r"] == pytest.approx(want, abs=1e-12)


def test_rouge_best_of_references_and_floor(spark):
    df = spark.createDataFrame(
        [("cats run", ["dog", "the cats run"]), ("x", []), ("", ["a b"]), (None, ["a"]), ("x", None)],
        "answer STRING, target ARRAY<STRING>",
    )
    got = [r["r"] for r in rouge.with_best_rouge(df, "answer", "target", "r").collect()]
    assert got == [pytest.approx(0.8), 0.0, 0.0, 0.0, 0.0]


def test_rouge_stems_words(spark):
    df = spark.createDataFrame([("the running dogs jumped", ["running dog jumps"])], "answer STRING, target ARRAY<STRING>")
    assert rouge.with_best_rouge(df, "answer", "target", "r").first()["r"] == pytest.approx(6 / 7)


# Published examples of the algorithm, step by step, with the commonly used extensions.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "died": "die",
    "news": "news", "skies": "sky", "innings": "inning", "enjoy": "enjoy", "was": "was", "is": "is",
    "geologi": "geolog", "say": "say", "cry": "cry", "shy": "shy", "dry": "dry", "emotionalli": "emot",
}


def test_porter_examples(spark):
    words = list(STEMS)
    got = spark.createDataFrame([(words,)], "w ARRAY<STRING>").select(stemming.porter_stems(F.col("w"))).first()[0]
    assert dict(zip(words, got)) == STEMS


@pytest.mark.parametrize(
    "response, number",
    [
        ("1 2 #### 3", "3"), ("#### ", ""), ("no", ""), ("x .5", ".5"), ("1.", "1"), ("1,234", "234"),
        ("-7 then -3.50", "-3.50"), ("a #### 1 #### -2", "-2"), ("", ""), ("5-3", "-3"),
    ],
)
def test_final_number(value, response, number):
    assert value(text.final_number(F.col("x")), "x STRING", (response,)) == number


@pytest.mark.parametrize(
    "answer, gold, reference, strict",
    [
        ("it is 42", "42", 1, 1),
        ("3.5", "35", 1, 0),  # the normalised text loses its point
        ("-5", "5", 1, 0),  # and its sign
        ("#### 1,234", "234", 1, 0),  # a comma cuts the number
        ("#### 1,234", "1,234", 0, 1),
        ("none", "1", 0, 0),
        ("1", "", 0, 0),
        ("1.0005", "1", 0, 1),
        ("12 #### 7", "7", 1, 1),
    ],
)
def test_numeric_match(value, answer, gold, reference, strict):
    cols = ("a STRING, g STRING", (answer, gold))
    assert value(text.numeric_match(F.col("a"), F.col("g")), *cols) == reference
    assert value(text.numeric_match(F.col("a"), F.col("g"), mode="strict"), *cols) == strict
