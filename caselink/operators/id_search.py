"""Case ids by a regular expression, through an index of the runs of digits in them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.operators.analytics import search_case_ids
from caselink.sources.scratch import write_table

# Lengths of the runs in the index.
SHORT, LONG = 2, 3
_TOKEN = re.compile(r"\\d|\[[^\]\\]*\]|\{\d+(?:,\d*)?\}|[0-9.^$*+?]")
_QUANTIFIER = re.compile(r"[*+?{]")


def write_id_grams(cases: DataFrame, path: str) -> DataFrame:
    """(gram, dr_no): the runs of two and three digits of every id, once an id; dealt and sorted by gram.

    A frequent gram's ids are spread over partitions by id; a reader that asks for one gram skips all row groups of others.
    """
    digits = F.col("dr_no").cast("string")
    runs = lambda n: F.when(
        F.length("digits") >= n, F.transform(F.sequence(F.lit(1), F.length("digits") - (n - 1)), lambda i: F.substring("digits", i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    shown = cases.filter(F.col("dr_no").isNotNull()).select("dr_no", digits.alias("digits")).distinct()
    grams = shown.select(F.explode(F.array_distinct(F.concat(*[runs(n) for n in (SHORT, LONG)]))).alias("gram"), "dr_no")
    return write_table(grams.repartitionByRange("gram", "dr_no").sortWithinPartitions("gram", "dr_no"), path)


def literals(pattern: str) -> list[str]:
    """Runs of digits that every match of ``pattern`` must hold.

    Only digits, ``.``, ``\\d``, classes, anchors and quantifiers are understood; any other pattern has none.
    """
    tokens, at = [], 0
    while at < len(pattern):
        found = _TOKEN.match(pattern, at)
        if found is None:
            return []
        tokens.append(found[0])
        at = found.end()
    runs, run = [], ""
    for token, following in zip(tokens, [*tokens[1:], ""]):
        if token.isdigit():
            if not _QUANTIFIER.match(following):
                run += token
                continue
            if following == "+":
                run += token
        runs.append(run)
        run = ""
    return [r for r in [*runs, run] if len(r) >= SHORT]


def search_ids_by_grams(grams: DataFrame, cases: DataFrame, pattern: str, n: int = 10) -> DataFrame:
    """As ``search_case_ids``; where the pattern has a literal, ids that lack one of its runs are never read."""
    wanted = {run[i : i + min(len(run), LONG)] for run in literals(pattern) for i in range(max(1, len(run) - LONG + 1))}
    if not wanted:
        return search_case_ids(cases.select("dr_no"), pattern, n)
    holding = [grams.filter(F.col("gram") == g).select("dr_no") for g in sorted(wanted, key=lambda g: (-len(g), g))]
    both = reduce(lambda a, b: a.join(b, "dr_no", "left_semi"), holding)
    return both.filter(F.col("dr_no").cast("string").rlike(pattern)).orderBy("dr_no").limit(n)
