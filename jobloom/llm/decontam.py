"""Benchmark decontamination by template canonicalisation, in native expressions.

A text's numbers, names and units become typed placeholders; windows of five
template tokens are hash-joined with those of the benchmark.  An item is found
in a document when at least half of its windows are, which leaves room for a
few changed words, or when ``RUN`` of them stand there one behind the other,
which finds passages of an item.  For items with placeholders, the values behind
them must then map one to one along an alignment that covers most of the slots
found, so a question with other numbers or names in it is caught, and a chance
mixture of the same templates is not.

Capitalised words are names wherever they stand, unless they are function words
(``STARTERS``); numbers are digits or number words.

Defined results: a null or empty text matches nothing, nor does an item
without tokens; an item of fewer than five tokens is one window of its whole
sequence; rows with equal id and text are one document and get equal results;
items with equal id are one item of all their windows; of a window that an item
repeats, the first place counts for runs; very long texts are read whole; ids
are of any type that can be compared; empty tables give no rows or no matches;
extra columns are not read and, where documents are kept, come back as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import row_keys
from jobloom.storage import materialize

WINDOW = 5
SHARE = 0.5
#: So many windows in a row, 13 tokens, make an item found.
RUN = 9
#: Benchmarks of up to so many windows are broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
NAME, NUMBER, UNIT, END, GUARD = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"
#: Unit words, longest first where one begins another.
UNITS = (
    "kilometres kilometers kilometre kilometer km centimetres centimeters cm millimetres millimeters mm metres meters metre meter "
    "miles mile feet foot inches inch kilograms kilogram kg milligrams mg grams gram pounds pound lbs ounces ounce "
    "litres liters litre liter ml hours hour minutes minute seconds second days day weeks week months month years year "
    "dollars dollar euros euro cents cent percent degrees degree mph kmh watts watt kw"
).split()
#: Function words that begin sentences and are no names.
STARTERS = (
    "The A An If When While What Which Who Whose How Why Where There Here In On At For From To Of By With Without And But Or So As Is Are Was Were Do Does Did "
    "Has Have Had Can Could Will Would Should May Must Each Every All Some Many Most Both No Not Then Than This That These Those It Its He She They We You "
    "His Her Their Our Your My After Before Since During Until Find Given Let Suppose Calculate Determine Compute Consider "
    "Der Die Das Ein Eine Wenn Wie Was Wer Im Und Le La Les Un Une Des Si Quand Que Qui Dans Et El Los Las Una Cuando En Y"
).split()
#: Number words; "one" is left out, as it is a pronoun too.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen"
).split()


def _by_letter(words: list[str]) -> str:
    """The words as alternatives, sorted under their first letters, which the matcher rules out one by one."""
    return "|".join(f"{c}(?:{'|'.join(dict.fromkeys(w[1:] for w in words if w[0] == c))})" for c in dict.fromkeys(w[0] for w in words))


CAPITAL = r"(?=\p{Lu})"
GUARDED = r"(^|[^\p{L}\p{N}])" + CAPITAL + "(" + _by_letter(STARTERS) + r")([^\p{L}\p{N}]|$)"
#: The repeated groups are possessive: nothing follows them, and Java's matcher recurses once a repetition of others.
NAMES = r"(^|[^\p{L}\p{N}" + GUARD + r"])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+)"
NUMBERS = r"([0-9]+(?:[.,:/][0-9]+)*+|\b(?:" + _by_letter(NUMBER_WORDS) + r")\b)"
UNIT_AFTER = r" ?\b(" + "|".join(UNITS) + r")\b"
SEPARATORS = r"[^\p{L}\p{M}\p{N}" + NAME + NUMBER + UNIT + "]+"


def _first(words: list[str]) -> str:
    return "".join(dict.fromkeys(w[0] for w in words))


#: The same for Java's matcher, which rules out most places by one character ahead and looks behind instead of trying two ways in at
#: each.  What a match of ``GUARDED`` ends with can't begin the next one, hence ``\G``.
#: A letter beyond 16 bits has Java look behind by characters instead of by halves of them.
WIDE = "\U00010400"
AHEAD_GUARDED = rf"(?=[{_first(STARTERS)}])(?:^|(?<![\p{{L}}\p{{N}}{WIDE}])(?!\G))({_by_letter(STARTERS)})([^\p{{L}}\p{{N}}]|$)"
AHEAD_NAMES = rf"{CAPITAL}(?<![\p{{L}}\p{{N}}{GUARD}{WIDE}])" + r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+)"
AHEAD_NUMBERS = f"(?=[0-9{_first(NUMBER_WORDS)}])" + NUMBERS
MARKS = f"{NAME}-{UNIT}"


def marked(text: Column) -> Column:
    """The text, lower-cased, each slot between its type's mark and an end mark."""
    guarded = F.regexp_replace(F.coalesce(text, F.lit("")), AHEAD_GUARDED, rf"{GUARD}$1$2")
    named = F.regexp_replace(guarded, AHEAD_NAMES, rf" {NAME}$1{END} ")
    numbered = F.regexp_replace(F.lower(named), AHEAD_NUMBERS, rf" {NUMBER}$1{END} ")
    return F.regexp_replace(numbered, f"({NUMBER}[^{END}]*{END}) {UNIT_AFTER}", rf"$1 {UNIT}$2{END} ")


def template_tokens(marked_text: Column) -> Column:
    bare = F.regexp_replace(marked_text, f"([{MARKS}])[^{END}]*{END}", " $1 ")
    return F.array_remove(F.split(bare, SEPARATORS), "")


def slot_values(marked_text: Column) -> Column:
    """The values of all slots, in the order of their placeholders."""
    return F.regexp_extract_all(marked_text, F.lit(f"[{MARKS}]([^{END}]*){END}"), 1)


def windows(hashes: Column, width: int) -> Column:
    """(at, window): starts and hashes of all runs of ``width`` tokens, from the tokens' hashes."""
    last = F.size(hashes) - width
    run = lambda i: F.struct(i.alias("at"), F.xxhash64(*(F.get(hashes, i + k) for k in range(width))).alias("window"))
    return F.when(last < 0, F.array().cast("array<struct<at:int,window:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run))


def positions(tokens: DataFrame, widths: list[int]) -> DataFrame:
    """One row (k1, k2, at, window) a start and width, as ``windows`` has them; in generated code, as functions of array elements are not."""
    # of a plain column the optimizer would infer a filter on its size, for which texts would be cut twice
    first = F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - (min(widths) - 1)))
    starts = tokens.select("k1", "k2", "tokens", F.posexplode(first).alias("at", "first"))
    hash_of = lambda w: F.xxhash64("first", *(F.get("tokens", F.col("at") + k) for k in range(1, w)))
    if len(widths) == 1:
        return starts.select("k1", "k2", "at", hash_of(widths[0]).alias("window"))
    each = F.array(*(F.when(F.col("at") <= F.size("tokens") - w, hash_of(w)) for w in widths))
    return starts.select("k1", "k2", "at", F.explode(each).alias("window")).filter("window is not null")


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def longest_run(places: Column) -> Column:
    """The length of the longest run of consecutive numbers in a set of them."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.sort_array(places), start, step, lambda s: s["best"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k1, k2 = row_keys(id_col, text_col)
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, item, coverage, n_slots): the benchmark items found in each document."""
    bench = items.select(F.col(item_col).alias("item"), hashed(template_tokens(marked(F.col(item_text)))).alias("tokens"), slot_values(marked(F.col(item_text))).alias("values")).filter(F.size("tokens") > 0).distinct()
    bench = bench.withColumn("width", F.least(F.size("tokens"), F.lit(WINDOW)))
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # five values at most
    if not widths:
        item = items.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"k1 long, k2 int, item {item}, coverage double, n_slots long")

    def by_width(column: str) -> Column:
        out = F.lit(None)
        for w in widths:
            out = F.when(F.col("width") == w, windows(F.col(column), w)).otherwise(out)
        return out

    rows = bench.select("item", F.size("values").cast("long").alias("n_slots"), F.inline(by_width("tokens")))
    rows = rows.groupBy("item", "window").agg(F.min("at").alias("at"), F.max("n_slots").alias("n_slots"))
    n_windows = rows.groupBy("item").agg(F.count("*").alias("n_windows"), F.max("n_slots").alias("n_slots"))
    small = rows.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)

    keyed = _keyed(docs, id_col, text_col)
    tokens = keyed.select("k1", "k2", hashed(template_tokens(marked(F.col("text")))).alias("tokens"))
    runs = positions(tokens, widths).select("k1", "k2", "at", "window")
    hits = runs.join(hint(rows.select("item", "window", F.col("at").alias("place"))), "window")
    # an alignment holds at most the windows of one item
    aligned = hits.groupBy("k1", "k2", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    found = aligned.groupBy("k1", "k2", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n"), F.max(longest_run(F.col("places"))).alias("run"))
    share = F.col("n") / F.col("n_windows")
    return found.join(hint(n_windows), "item").filter((share >= SHARE) | (F.col("run") >= RUN)).select("k1", "k2", "item", share.alias("coverage"), "n_slots")


def slots_agree(docs: DataFrame, items: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, item, agree) for found items with slots: do values map one to one along an alignment?"""

    def slots(df: DataFrame, keys: list[str], text: str) -> DataFrame:
        """One row a slot and window around it: the window's start and hash, the slot's place in it, its value."""
        m, n = marked(F.col(text)), F.size("tokens")
        marks = F.array(*(F.lit(x) for x in (NAME, NUMBER, UNIT)))
        places = F.filter(F.transform("tokens", lambda t, i: F.when(F.array_contains(marks, t), i).otherwise(-1)), lambda i: i >= 0)
        parts = df.select(*keys, template_tokens(m).alias("tokens"), slot_values(m).alias("values")).withColumn("width", F.least(n, F.lit(WINDOW)))
        each = parts.select(*keys, "tokens", "values", "width", F.posexplode(places).alias("j", "place"))
        starts = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("width") + 1), F.least(F.col("place"), n - F.col("width")))
        runs = each.select(*keys, "tokens", "width", "place", F.element_at("values", F.col("j") + 1).alias("value"), F.explode(starts).alias("at"))
        return runs.select(*keys, "at", (F.col("place") - F.col("at")).alias("inside"), "value", F.xxhash64(F.slice("tokens", F.col("at") + 1, F.col("width"))).alias("window"))

    slotted = found.filter("n_slots > 0").select("k1", "k2", "item")
    texts = _keyed(docs, id_col, text_col).join(slotted.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    theirs = slots(texts.filter("length(text) > 0"), ["k1", "k2"], "text").join(slotted, ["k1", "k2"])
    ours = slots(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct(), ["item"], "text")
    place = F.col("b.at") + F.col("inside")
    pairs = theirs.alias("d").join(ours.alias("b"), ["item", "window", "inside"]).select("k1", "k2", "item", (F.col("d.at") - F.col("b.at")).alias("shift"), place.alias("place"), F.col("b.value").alias("ours"), F.col("d.value").alias("theirs"))
    # an alignment holds at most the slots of one item, so these sets are small
    sizes = {"places": "place", "left": "ours", "right": "theirs"}
    aligned = pairs.groupBy("k1", "k2", "item", "shift").agg(*(F.size(F.collect_set(c)).alias(n) for n, c in sizes.items()), F.size(F.collect_set(F.struct("ours", "theirs"))).alias("both"))
    one_to_one = (F.col("both") == F.col("left")) & (F.col("both") == F.col("right"))
    most = aligned.groupBy("k1", "k2", "item").agg(F.max("places").alias("most"), F.max(F.when(one_to_one, F.col("places"))).alias("agreeing"))
    return most.select("k1", "k2", "item", F.coalesce(2 * F.col("agreeing") >= F.col("most"), F.lit(False)).alias("agree"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k1, k2, item_ids, coverage): the contaminated documents and their items."""
    found = materialize(find_items(docs, items, id_col, text_col, item_col, item_text), "found")
    agreed = slots_agree(docs, items, found, id_col, text_col, item_col, item_text)
    checked = found.join(agreed, ["k1", "k2", "item"], "left").filter(F.coalesce("agree", F.lit(True)))
    return checked.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("coverage").alias("coverage"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, all columns kept."""
    k1, k2 = row_keys(id_col, text_col)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*docs.columns).alias("row"))
    bad = contamination(docs, items, id_col, text_col, item_col, item_text)
    return keyed.join(bad.select("k1", "k2"), ["k1", "k2"], "left_anti").select("row.*")


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: contaminated, how many items and which, the largest coverage."""
    bad = contamination(docs, items, id_col, text_col)
    rows = _keyed(docs, id_col, text_col).drop("text").join(bad, ["k1", "k2"], "left")
    ids = F.coalesce(F.col("item_ids").cast("array<string>"), F.array().cast("array<string>"))
    return rows.select(F.col("id").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids, ",").alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def _sql_tokens(table: str, key: str) -> str:
    """(key, tokens, vals) of a table's texts, in DuckDB, whose matcher has and needs neither possessive groups nor looks ahead."""
    marks, guarded, names, numbers = NAME + NUMBER + UNIT, GUARDED.replace(CAPITAL, ""), NAMES.replace("*+", "*"), NUMBERS.replace("*+", "*")
    return f"""
  SELECT {key}, list_filter(string_split_regex(regexp_replace(m, '([{marks}])[^{END}]*{END}', ' \\1 ', 'g'), '{SEPARATORS}'), lambda x: x <> '') AS tokens,
    regexp_extract_all(m, '[{marks}]([^{END}]*){END}', 1) AS vals
  FROM (SELECT {key}, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{guarded}', '\\1{GUARD}\\2\\3', 'g'), '{names}', '\\1 {NAME}\\2{END} ', 'g')),
      '{numbers}', ' {NUMBER}\\1{END} ', 'g'), '({NUMBER}[^{END}]*{END}) {UNIT_AFTER}', '\\1 {UNIT}\\2{END} ', 'g') AS m
    FROM {table})"""


def _sql_slots(table: str, key: str) -> str:
    marks = f"['{NAME}', '{NUMBER}', '{UNIT}']"
    return f"""
  SELECT {key}, slot_value, start, place - start AS inside, array_to_string(tokens[start + 1:start + width], ' ') AS win
  FROM (SELECT *, unnest(range(greatest(0, place - width + 1), least(place, len(tokens) - width) + 1)) AS start
    FROM (SELECT {key}, tokens, least(len(tokens), {WINDOW}) AS width, unnest(places) AS place, unnest(vals) AS slot_value
      FROM (SELECT *, list_filter(range(len(tokens)), lambda i: list_contains({marks}, tokens[i + 1])) AS places FROM {table})))"""


#: The same report in DuckDB, for tables whose ids are unique.
ORACLE = f"""
WITH theirs AS ({_sql_tokens("documents", "doc_id")}),
ours AS (SELECT *, least(len(tokens), {WINDOW}) AS width FROM ({_sql_tokens("benchmark", "item_id")}) WHERE len(tokens) > 0),
item_windows AS (
  SELECT item_id, width, win, min(i) AS place
  FROM (SELECT item_id, width, i, array_to_string(tokens[i + 1:i + width], ' ') AS win FROM (SELECT *, unnest(range(len(tokens) - width + 1)) AS i FROM ours))
  GROUP BY ALL),
doc_windows AS (
  SELECT doc_id, width, i, array_to_string(tokens[i + 1:i + width], ' ') AS win
  FROM (SELECT doc_id, tokens, width, unnest(range(greatest(0, len(tokens) - width + 1))) AS i FROM theirs, (SELECT DISTINCT width FROM ours))),
n_windows AS (SELECT w.item_id, count(*) AS n_windows, max(len(o.vals)) AS n_slots FROM item_windows w JOIN ours o USING (item_id) GROUP BY w.item_id),
hits AS (SELECT DISTINCT doc_id, item_id, place, i - place AS shift FROM doc_windows JOIN item_windows USING (win, width)),
shared AS (SELECT doc_id, item_id, count(DISTINCT place) AS n FROM hits GROUP BY ALL),
stretches AS (
  SELECT doc_id, item_id, count(*) AS run
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY place) AS island FROM hits)
  GROUP BY doc_id, item_id, shift, island),
found AS (
  SELECT doc_id, item_id, n / n_windows AS coverage, n_slots
  FROM shared JOIN n_windows USING (item_id) JOIN (SELECT doc_id, item_id, max(run) AS run FROM stretches GROUP BY ALL) USING (doc_id, item_id)
  WHERE n / n_windows >= {SHARE} OR run >= {RUN}),
slotted AS (SELECT t.* FROM theirs t WHERE doc_id IN (SELECT doc_id FROM found WHERE n_slots > 0)),
our_slots AS ({_sql_slots("ours", "item_id")}),
their_slots AS ({_sql_slots("slotted", "doc_id")}),
aligned AS (
  SELECT f.doc_id, f.item_id, d.start - b.start AS shift, count(DISTINCT b.start + b.inside) AS places, count(DISTINCT b.slot_value) AS ours,
    count(DISTINCT d.slot_value) AS theirs, count(DISTINCT (b.slot_value, d.slot_value)) AS both_
  FROM found f JOIN our_slots b USING (item_id) JOIN their_slots d ON d.doc_id = f.doc_id AND d.win = b.win AND d.inside = b.inside
  WHERE f.n_slots > 0 GROUP BY 1, 2, 3),
agreed AS (
  SELECT doc_id, item_id, coalesce(2 * max(places) FILTER (both_ = ours AND both_ = theirs) >= max(places), false) AS agree
  FROM aligned GROUP BY 1, 2),
bad AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids, max(coverage) AS coverage
  FROM found LEFT JOIN agreed USING (doc_id, item_id) WHERE coalesce(agree, true) GROUP BY doc_id)
SELECT d.doc_id, b.ids IS NOT NULL AS contaminated, coalesce(len(b.ids), 0)::BIGINT AS n_items,
  coalesce(array_to_string(b.ids, ','), '') AS item_ids, coalesce(b.coverage, 0.0)::DOUBLE AS coverage
FROM documents d LEFT JOIN bad b USING (doc_id)
"""
