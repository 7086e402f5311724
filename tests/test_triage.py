"""Error channels and rule tables on small rows and against plain loops."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import phrases
from loomtrace.operators import capability, triage


@pytest.mark.parametrize(("text", "value"), [("1,234", 1234), ("$1,234.50", Fraction("1234.5")), ("3,5", Fraction("3.5")), ("50%", 50), ("-7.", -7), ("12 000", 12000), ("", None), ("a1", None), (None, None), ("1.2.3", None)])
def test_numbers(text, value):
    assert triage.number(text) == value


@pytest.mark.parametrize(("text", "value"), [("3*(4+5)", 27), ("-2 + 10 / 4", Fraction(1, 2)), ("$1,200 × 3", 3600), ("20% * 50", 10), ("2*-3", -6), ("1/0", None), ("(1+2", None), ("7", None), ("1 2 + 3", 15), ("2+", None), ("(" * 5000, None)])
def test_expressions(text, value):
    assert triage.evaluated(text, {}) == value


def test_random_expressions_equal_python():
    rng = random.Random(3)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return str(rng.randint(1, 30))
        a, b = made(depth - 1), made(depth - 1)
        return f"({a} {rng.choice('+-*/')} {b})"

    for _ in range(300):
        t = f"{made(3)} + {made(2)}"
        try:
            want = eval(__import__("re").sub(r"(\d+)", r"Fraction(\1)", t))
        except ZeroDivisionError:
            want = None
        assert triage.evaluated(t, {}) == want


CASES = [
    ("42", "We add " + "x" * 60, False, "A_truncated"),
    ("42", r"So it is \boxed{42} for the 7 of them", False, "A_extract_v2"),
    ("1234", "the sum is #### 1 234 or \\boxed{1,234}, see page 3", False, "A_extract_v2"),
    ("60", "5 * 4 = 24. Then 24 * 3 = 72. #### 72", False, "B_stepwise"),
    ("9", "I get 8. Wait, I made a mistake. #### 7", False, "B_selfcorrect_regress"),
    ("12500", "It is 12.500 in all, for 3 days. #### 3", False, "C_token"),
    ("8", "No idea. #### 7", False, "Class2"),
    (None, "#### 7", False, "Class2"),
    ("8", None, False, "Class2"),
    ("8", "#### 8", True, None),
]


def test_channels(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, expected string, gen_text string, correct boolean, want string")
    rows = triage.channels(df, 40).orderBy("k").collect()
    assert [r.channel for r in rows] == [r.want for r in rows]
    one = triage.triaged(triage.channels(df, 40), 0.1).first()
    assert (one.n_total, one.n_wrong, one.A_extract_v2, one.n_first_class, one.decision) == (10, 9, 2, 6, "alpha")
    assert triage.triaged(triage.channels(df.limit(0), 40)).first().decision == "gamma"


def test_rule_tables(spark):
    rng = random.Random(4)
    pairs = sorted({("".join(rng.choices("abcé ", k=rng.randint(1, 4))), str(rng.randrange(20))) for _ in range(300)})
    table = spark.createDataFrame([*pairs, (None, "x"), ("", "y"), ("q", None), pairs[0]], "phrase string, tag string")
    assert phrases.rules(table) == tuple(pairs)
    texts = ["".join(rng.choices("abcéABC xyz", k=rng.choice([0, 5, 40]))) for _ in range(80)] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", phrases.tags(F.col("t"), phrases.rules(table)).alias("x")).collect()}
    assert all(got[k] == sorted({tag for p, tag in pairs if t and p in t.lower()}) for k, t in enumerate(texts))
    assert df.select(phrases.tags(F.col("t"), ()).alias("x")).first().x == []


def test_a_changed_table_changes_tags(spark):
    steps = spark.createDataFrame([("agent", "c", "Deploy_Prod", 0), ("agent", "c", "read_file", 0)], "role string, content string, tool_name string, step_index int")
    own = spark.createDataFrame([("deploy", "release"), ("prod", "risk")], "phrase string, tag string")
    tagged = lambda **kw: [r.x for r in steps.select(capability.tags(F.lit(False), **kw).alias("x")).collect()]
    assert tagged() == [["tool_selection"], ["file_localization", "tool_selection"]]
    assert tagged(tools=own) == [["release", "risk", "tool_selection"], ["tool_selection"]]
    keys = F.array(F.lit("sealed"))
    assert tagged(verifier_keys=keys, verifiers=spark.createDataFrame([("sealed", "custody")], "phrase string, tag string"))[0] == ["custody", "tool_selection"]


def test_gaps_as_bits_equal_gaps_as_strings(spark):
    """The table of tools that the built-in one is gives the same gaps, also where a branch has two rows; steps as bits make no rows."""
    import io
    from contextlib import redirect_stdout

    from loomtrace.plans import adapters

    rolled = adapters.rollouts(spark, "/root/testdata/sf0.001").where("p % 3 = 0")
    twice = rolled.unionByName(rolled.where("p % 2 = 0").withColumn("branch_index", F.lit(1)))
    table = spark.createDataFrame(list(capability.TOOL_TAGS.items()), "phrase string, tag string")
    bits = capability.gaps(twice)
    got, want = (sorted(map(tuple, d.collect())) for d in (bits, capability.gaps(twice, table)))
    assert got == want and len(got) > 20
    plan = io.StringIO()
    with redirect_stdout(plan):
        bits.explain()
    assert "posexplode" not in plan.getvalue()
