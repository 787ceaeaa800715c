from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobloom.llm import decontam
from tests.llm.fixtures import rows, table

ITEMS = [
    (1, "A train leaves Boston at 9:30 and covers 120 km in 3 hours, so how fast does it go on average?"),
    (2, "The quick brown fox jumps over the lazy dog near the old stone bridge every single morning."),
    (3, "what is this"),
    (4, None),
    (5, ""),
    (6, "Given that Alice Smith has 14 apples and Bob gives her 27 more, how many apples does Alice Smith have now?"),
]
LEAD = "Some words stand before it. "
TAIL = " And others come behind."


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(spark, items, texts):
    docs = table(spark, [(i, t, "en", "s", 1, 1, "x", "y") for i, t in enumerate(texts)])
    return {r.doc_id: r.item_ids for r in decontam.contamination_report(docs, items).collect()}


def test_copies_new_parameters_and_clean_texts(spark, items):
    texts = [
        LEAD + ITEMS[0][1] + TAIL,
        LEAD + "A train leaves Chicago at 7:45 and covers 3,400 miles in 5 days, so how fast does it go on average?" + TAIL,
        LEAD + ITEMS[1][1].upper() + TAIL,
        "The quick brown fox jumps over a wall." + TAIL,
        "Now what is this?",
        LEAD + "Given that Carol Jones has 5 apples and Dave gives her 6 more, how many apples does Carol Jones have now?",
        LEAD + "Given that Carol Jones has 5 apples and Dave gives her 6 more, how many apples does Erin Brown have now?",
        None,
        "",
    ]
    assert found(spark, items, texts) == {0: "1", 1: "1", 2: "2", 3: "", 4: "3", 5: "6", 6: "", 7: "", 8: ""}


def test_changed_words_and_repeated_values(spark):
    items = spark.createDataFrame([(1, "the code of the safe is 5 5 6 6 7 7 and nobody but the old keeper of the house may open it"), (2, ITEMS[1][1])], "item_id long, text string")
    texts = [
        LEAD + "the code of the safe is 5 5 6 6 7 7 and nobody but the old keeper of the house may open it" + TAIL,
        LEAD + "the code of the safe is 1 1 2 2 3 3 and nobody but the old keeper of the house may open it" + TAIL,
        LEAD + "the code of the safe is 1 2 3 4 5 6 and nobody but the old keeper of the house may open it" + TAIL,
        LEAD + ITEMS[1][1].replace("lazy", "sleepy") + TAIL,
        LEAD + ITEMS[1][1][:40] + TAIL,
    ]
    assert found(spark, items, texts) == {0: "1", 1: "1", 2: "", 3: "2", 4: ""}


def test_names_and_number_words_anywhere(spark):
    items = spark.createDataFrame([(1, "Tom has 5 pens. Tom buys 3 more. Tom gives 2 to Ann."), (2, ITEMS[1][1])], "item_id long, text string")
    texts = [
        LEAD + "Mary has 8 pens. Mary buys 4 more. Mary gives 6 to Joe." + TAIL,
        LEAD + "Mary has eight pens. Mary buys four more. Mary gives six to Joe." + TAIL,
        LEAD + "Mary has 8 pens. Lucy buys 4 more. Peter gives 6 to Joe." + TAIL,
    ]
    assert found(spark, items, texts) == {0: "1", 1: "1", 2: ""}


def test_passages_of_an_item(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [LEAD + " ".join(words[20:33]) + TAIL, LEAD + " ".join(words[20:32]) + TAIL, " ".join(w + " x" * (k % 6 == 5) for k, w in enumerate(words[:40]))]
    assert found(spark, items, texts) == {0: "1", 1: "", 2: ""}


def test_long_runs_of_names_numbers_and_starters(spark, items):
    texts = ["Berta " * 20_000, "1." * 40_000 + "1", "The " * 20_000, "five " * 20_000, LEAD + ITEMS[1][1] + " Berta" * 20_000]
    assert found(spark, items, texts) == {0: "", 1: "", 2: "", 3: "", 4: "2"}


def test_planted_items_with_other_values_are_found(spark):
    """Recall over generated questions with other names, numbers and units, and clean texts of the same words."""
    rnd = random.Random(3)
    names, units = ["Tom", "Mary", "Ann Lee", "Joe", "Lucy", "Peter Fox"], ["km", "hours", "kg", "dollars"]
    stock = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(300)]

    def question(parts, who, values, unit):
        return " ".join(p if p is not None else f"{who} has {v} {unit} and" for p, v in zip(parts, values))

    items, texts, want = [], [], {}
    for i in range(40):
        parts = [None if k % 9 == 4 else rnd.choice(stock) for k in range(30)]
        low, values = rnd.sample(names, 2), [rnd.randint(2, 10**6) for _ in parts]
        unit = rnd.sample(units, 2)
        items.append((i, question(parts, low[0], values, unit[0])))
        texts.append(LEAD + question(parts, low[1], [v + 7 for v in values], unit[1]) + TAIL)
        texts.append(" ".join(rnd.sample(stock, 60)))
        want |= {2 * i: str(i), 2 * i + 1: ""}
    got = found(spark, spark.createDataFrame(items, "item_id long, text string"), texts)
    assert sum(got[k] == v for k, v in want.items() if v) >= 38 and all(got[k] == "" for k, v in want.items() if not v)


def test_columns_with_clashing_names_and_text_ids(spark):
    docs = spark.createDataFrame([("a", LEAD + ITEMS[1][1], 1, 2, "r"), ("b", LEAD, 3, 4, "r")], "doc_id string, text string, k1 int, _k1 int, row string")
    items = spark.createDataFrame([("x", ITEMS[1][1])], "item_id string, text string")
    assert [tuple(r) for r in decontam.decontaminate(docs, items).collect()] == [("b", LEAD, 3, 4, "r")]
    assert sorted(r.item_ids for r in decontam.contamination_report(docs, items).collect()) == ["", "x"]
    assert decontam.contamination_report(docs, items.limit(0)).filter("contaminated").count() == 0


def test_rows_of_the_fixture_are_clean_and_kept(spark, items):
    docs = table(spark)
    report = decontam.contamination_report(docs, items).collect()
    assert len(report) == len(rows()) and not any(r.contaminated for r in report)
    kept = decontam.decontaminate(docs, items)
    assert kept.count() == len(rows()) and kept.columns == docs.columns


def test_removal(spark, items):
    docs = table(spark, [(1, LEAD + ITEMS[1][1], "en", "s", 1, 1, "x", "y"), (2, LEAD, "en", "s", 1, 1, "x", "y"), (2, LEAD, "en", "s", 1, 1, "x", "y")])
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items).collect()) == [2, 2]


def test_empty_tables(spark, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination_report(table(spark, []), items).count() == 0
    assert not any(r.contaminated for r in decontam.contamination_report(table(spark), none).collect())


def test_large_benchmarks_are_joined_by_a_shuffle(spark, items, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 1)
    assert found(spark, items, [LEAD + ITEMS[1][1], LEAD]) == {0: "2", 1: ""}


def test_main_path_is_native(spark, items):
    plan = decontam.contamination_report(table(spark), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_text_ids_and_nulls_are_told_apart(spark):
    from jobloom.llm.decontam import contamination_report, decontaminate

    t = "how many apples does the careful farmer sell to the baker on the second morning of the long winter market"
    docs = spark.createDataFrame([(t, None), (None, t), ("z", t), ("y", "nothing of the kind")], "doc_id string, text string")
    items = spark.createDataFrame([(1, t)], "item_id long, text string")
    assert {(r.doc_id, r.contaminated) for r in contamination_report(docs, items).collect()} == {(t, False), (None, True), ("z", True), ("y", False)}
    assert {r.doc_id for r in decontaminate(docs, items).collect()} == {t, "y"}


def test_positions_are_those_of_windows(spark, sf):
    """All starts of all widths, for which texts are cut into tokens once."""
    df = spark.range(60).selectExpr("id k1", "id k2", "transform(sequence(0, id % 9), x -> x * id) tokens").union(spark.sql("SELECT 99L, 99L, cast(array() AS array<bigint>)"))
    for widths in ([5], [1, 3, 5], [2]):
        want = df.select("k1", "k2", F.inline(F.concat(*(decontam.windows(F.col("tokens"), w) for w in widths))))
        assert sorted(decontam.positions(df, widths).collect()) == sorted(want.collect())
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit(1).alias("k1"), F.lit(1).alias("k2"), decontam.hashed(decontam.template_tokens(decontam.marked(F.col("text")))).alias("tokens"))
    plan = decontam.positions(texts, [5])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "lambda at" not in plan


def test_patterns_ahead_mark_what_the_plain_ones_do(spark):
    rnd = random.Random(4)
    odd = ["The", "If", "Berlin", "New York", "two", "Twenty", "3.5", "1,000", "km", "é", "Über", "\U0001d49c", "\U00010400", "́", ".", "-", "\n", "THE", "ItIs", decontam.NAME, decontam.END, decontam.GUARD, "two\n", "The\n"]
    texts = spark.createDataFrame([("".join(rnd.choice(odd) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 30))),) for _ in range(2000)], "text string")
    guarded = F.regexp_replace("text", decontam.GUARDED, rf"$1{decontam.GUARD}$2$3")
    named = F.regexp_replace(guarded, decontam.NAMES, rf"$1 {decontam.NAME}$2{decontam.END} ")
    numbered = F.regexp_replace(F.lower(named), decontam.NUMBERS, rf" {decontam.NUMBER}$1{decontam.END} ")
    n, e, u = decontam.NUMBER, decontam.END, decontam.UNIT
    plain = F.regexp_replace(numbered, f"({n}[^{e}]*{e}) {decontam.UNIT_AFTER}", rf"$1 {u}$2{e} ")
    assert texts.filter(plain != decontam.marked(F.col("text"))).count() == 0
