"""Small tables with the odd rows that each operator has a defined result for."""

from __future__ import annotations

import random

LONG = "lorem ipsum " * 20_000


def odd_texts() -> list[str | None]:
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "naïve", "日本", "The", "the", "ß", "a", "|", "!!"]
    base = " ".join(rng.choice(vocabulary) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    line = "This line is shared by a number of texts."
    lines = [f"{line}\n{rng.random()} own words\n \t{line.upper()}  \n\n" for _ in range(5)]
    noise = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(20)]
    return [None, "", " ", "\n\n", "one", "one two three", "one two three", base, base, near, base.upper(), *lines, LONG, "a b c", "x" * 5_000, *noise]


def documents(spark, texts=None, first=0):
    texts = odd_texts() if texts is None else texts
    rows = [(first + k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 2}", 1, "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string")


def table(df) -> dict:
    return {r[0]: r for r in df.collect()}
