"""A small documents table with every edge case, as rows and as a DataFrame."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id string, row string"


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    """Plain texts, copies, near copies, shared passages, and null, empty, long, tied and repeated rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(400)] + ["Été", "ß", "naïve", "日本"]
    text = lambda k: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(k))
    shared = text(60)
    texts: list[str | None] = [text(rnd.randint(5, 120)) for _ in range(n)]
    for k in range(0, n, 6):
        t = texts[k].split(" ")
        t[rnd.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += [texts[1], texts[1], texts[2] + "\n" + shared + " x", shared + " " + texts[3], text(8) + " " + shared]
    texts += [None, "", " \t\n", "one", "two words", "a three words", "now four words here", text(6000), "a" * 700, "ab" * 300]
    out = [(i, t, "en" if i % 3 else None, None if i % 11 == 0 else f"src{i % 4}", len(t) if t else None, i, "x", "y") for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "null id text here again", None, None, None, None, None, None)]


def table(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
