"""Scorers that are loaded once for each worker, such as classifiers, with rules as the default.

A scorer is made on the worker by a function without arguments and called with
a list of texts; it returns a list of tuples. Model weights stay with whoever
brings the scorer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from . import fixed_values as V

Scorer = Callable[[Sequence[str]], list[tuple]]
RULES = "category string, impact string"


def rule_based() -> Scorer:
    """Category by the first rule that matches, impact by how many words of the cascade vocabulary a text holds."""
    rules = [(name, re.compile("|".join(f"(?:{p})" for p in patterns))) for name, _, patterns in V.CATEGORY_RULES]

    def score(texts: Sequence[str]) -> list[tuple]:
        out = []
        for t in texts:
            low = re.sub(r"[^\x00-\x7F]", "_", t.lower())
            hits = sum(w in low for w in V.CASCADE_WEIGHTS)
            out.append((next((n for n, r in rules if r.search(low)), "uncategorized"), "high" if hits >= 3 else "medium" if hits else "none"))
        return out

    return score


def scored(rows: DataFrame, text: str, make: Callable[[], Scorer] = rule_based, schema: str = RULES, batch: int = 64) -> DataFrame:
    """rows with the scorer's columns, in batches of texts; null texts are empty. Only the text and the row travel to Python."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in parts:
            texts = pdf[text].fillna("").tolist()
            got = [r for lo in range(0, len(texts), batch) for r in scorer(texts[lo : lo + batch])]
            yield pd.concat([pdf, pd.DataFrame(got, columns=names, index=pdf.index)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, {schema}")
