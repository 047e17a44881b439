"""One-pass column statistics: the engine under profiling, exploration and preparation.

* Aggregates of many columns share one scan and come back as one wide row, which is
  turned into one row per column. Wide tables are cut into chunks of columns, so
  generated code stays small while every column is still read once.
* Distinct counts and value counts work on a long ``(column, value)`` form that is
  combined before the shuffle; a value held by a third of all rows is one row per
  task there.
* Exact quantiles never hold a whole column in one task: sketches bracket the wanted
  ranks and an exact selection reads the bracket only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.columns import as_double, col, denan, family

# Values that one task may hold while selecting an exact quantile.
SELECT_BOUND = 200_000
# Selections that may hold that many at once; more of them share what these may hold.
FEW_BUFFERS = 16
# Strings longer than this are compared by SHA-256 when counting distinct values.
LONG_TEXT = 64
SKETCH_ACCURACY = 10_000
AGGREGATES_PER_CHUNK = 100


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: Callable[[str], dict[str, Column]],
) -> DataFrame:
    """Aggregate each column by ``measures(name)`` in shared scans; one output row per column."""
    columns = list(columns)
    if not columns:
        raise ValueError("no column to aggregate")
    names = list(measures(columns[0]))
    step = max(1, AGGREGATES_PER_CHUNK // len(names))
    parts = []
    for start in range(0, len(columns), step):
        chunk = columns[start : start + step]
        wide = df.agg(
            *[e.alias(f"{i}_{m}") for i, c in enumerate(chunk) for m, e in measures(c).items()]
        )
        parts.append(
            wide.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(c).alias("column"),
                                *[F.col(f"{i}_{m}").alias(m) for m in names],
                            )
                            for i, c in enumerate(chunk)
                        ]
                    )
                )
            )
        )
    return reduce(DataFrame.unionByName, parts)


def attach(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join per-column tables. Each has at most one row per column of the schema."""
    return reduce(lambda a, b: a.join(F.broadcast(b), "column", "left"), others, base)


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)`` rows of same-typed columns, missing values left out."""
    cells = df.select(*[col(c) for c in columns]).unpivot(
        [], [col(c) for c in columns], "column", "value"
    )
    return cells.filter(F.col("value").isNotNull())


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for string-like columns (values cast to string)."""
    cells = df.select(*[col(c).cast("string").alias(c) for c in columns])
    return long_form(cells, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact number of distinct non-missing values: ``(column, n_unique)``.

    Columns are unpivoted by type family, so that a shuffled row carries one value.
    Array, map, struct and binary columns are left out.
    """
    wanted = set(df.columns if columns is None else columns)
    targets = {"floating": "double", "integral": "bigint", "datetime": "timestamp_ntz"}
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        kind = family(f.dataType)
        if f.name in wanted and kind != "other":
            key = f.dataType.simpleString() if kind == "decimal" else kind
            groups.setdefault(key, []).append(f.name)
    if not groups:
        raise ValueError("no column whose distinct values can be counted")
    df = denan(df)
    parts = []
    for kind, names in groups.items():
        cells = []
        for c in names:
            value = col(c)
            if kind in targets:
                value = value.cast(targets[kind])
            if kind == "floating":
                value = value + F.lit(0.0)  # -0.0 and 0.0 are one value
            if kind == "string":
                value = F.when(
                    F.length(value) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(value, 256))
                ).otherwise(value)
            cells.append(value.alias(c))
        parts.append(
            long_form(df.select(*cells), names)
            .distinct()
            .groupBy("column")
            .agg(F.count("*").alias("n_unique"))
        )
    return reduce(DataFrame.unionByName, parts)


def _positions(n: int, prob: float) -> tuple[int, int, float]:
    """The two order statistics (0-based) around a quantile and the weight of the second."""
    place = prob * (n - 1)
    first = math.floor(place + 1e-9)
    weight = max(0.0, place - first)
    return (first, first, 0.0) if weight < 1e-9 else (first, min(first + 1, n - 1), weight)


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: dict[str, float],
    select_bound: int = SELECT_BOUND,
) -> DataFrame:
    """Linearly interpolated exact quantiles: ``(column, <name of prob>…)``.

    A first job counts each column and sketches a bracket around every wanted rank.
    While more than ``select_bound`` rows lie in a bracket, another scan narrows it
    about 500-fold. The last scan, left lazy, selects the order statistics among the
    rows of the brackets. Only bracket ends and counts reach the driver.
    """
    columns = list(columns)
    data = as_double(df, columns)
    # The columns of one scan share the bound: their buffers meet in one task.
    buffers = 2 * len(probs) * min(len(columns), max(1, AGGREGATES_PER_CHUNK // len(probs)))
    select_bound = max(1_000, select_bound * FEW_BUFFERS // max(FEW_BUFFERS, buffers))
    counts, ranks = _find_brackets(data, columns, probs, select_bound)

    def value_at(c: str, rank: int) -> Column:
        state = ranks[c, rank]
        if "value" in state:
            return F.max(F.lit(state["value"]))
        ends = state["low"], state["high"]
        # Ranks with a common bracket come from one aggregate.
        mates = sorted(
            r for (k, r), s in ranks.items()
            if k == c and "value" not in s and (s["low"], s["high"]) == ends
        )
        # Asking for the share (rank + 1/2) / n yields exactly the value of that rank.
        shares = ", ".join(
            _number((r - state["below"] + 0.5) / state["inside"]) for r in mates
        )
        tests = [f"{_quote(c)} {sign} {_number(end)}"
                 for sign, end in zip("><", ends) if end is not None]
        inside = f"CASE WHEN {' AND '.join(tests)} THEN {_quote(c)} END" if tests else _quote(c)
        picked = F.expr(f"percentile_disc(array({shares})) WITHIN GROUP (ORDER BY {inside})")
        return picked[mates.index(rank)]

    def quantile(c: str, prob: float) -> Column:
        if not counts[c]:
            return F.max(F.lit(None).cast("double"))
        first, last, weight = _positions(counts[c], prob)
        low = value_at(c, first)
        return low if first == last else low + (value_at(c, last) - low) * weight

    return per_column(data, columns, lambda c: {k: quantile(c, p) for k, p in probs.items()})


def _in_chunks(data: DataFrame, groups: list[list[Column]]) -> dict:
    """Aggregates by name, in scans of about a hundred each."""
    found: dict = {}
    step = max(1, AGGREGATES_PER_CHUNK // max(len(g) for g in groups))
    for start in range(0, len(groups), step):
        chunk = [e for g in groups[start:start + step] for e in g]
        found |= data.agg(*chunk).first().asDict()
    return found


def _find_brackets(
    data: DataFrame, columns: list[str], probs: dict[str, float], bound: int
) -> tuple[dict[str, int], dict[tuple[str, int], dict]]:
    """Row counts by column and, by (column, rank), a value or an open bracket.

    A bracket ``(low, high)`` (None = unbounded) is stored with the number of rows
    ``below`` it, up to and including ``low``, and strictly ``inside`` it.
    """
    slack = 4.0 / SKETCH_ACCURACY
    near = sorted({min(1.0, max(0.0, p + s)) for p in probs.values() for s in (-slack, slack)})
    grid = [i / 1000 for i in range(1001)]

    def sketch(value: Column, fractions: list[float]) -> Column:
        return F.percentile_approx(value, fractions, F.lit(SKETCH_ACCURACY))

    def between(c: str, low: float | None, high: float | None) -> Column:
        test = col(c).isNotNull()
        if low is not None:
            test = test & (col(c) > low)
        if high is not None:
            test = test & (col(c) < high)
        return test

    first_pass = per_column(
        data,
        columns,
        lambda c: {"n": F.count(col(c)), "min": F.min(col(c)), "max": F.max(col(c)),
                   "ends": sketch(col(c), near)},
    ).collect()
    counts = {row["column"]: row["n"] for row in first_pass}
    ranks: dict[tuple[str, int], dict] = {}
    for row in first_pass:
        n = row["n"]
        for p in probs.values() if n else ():
            for rank in _positions(n, p)[:2]:
                state = {"low": None, "high": None, "below": 0, "inside": n}
                if rank in (0, n - 1):
                    state["value"] = row["min"] if rank == 0 else row["max"]
                elif n > bound:
                    low, high = max(0.0, p - slack), min(1.0, p + slack)
                    state["trial"] = (row["ends"][near.index(low)], row["ends"][near.index(high)])
                ranks[row["column"], rank] = state

    def wide() -> list:
        return [(k, s) for k, s in ranks.items() if "value" not in s and s["inside"] > bound]

    while wide():
        # Scan 1, only where no trial bracket is known yet: sketch the open bracket.
        blank = [(k, s) for k, s in wide() if "trial" not in s]
        spans = sorted({(k[0], s["low"], s["high"]) for k, s in blank}, key=str)
        if spans:
            found = _in_chunks(data, [
                [sketch(F.when(between(*span), col(span[0])), grid).alias(f"ends_{i}")]
                for i, span in enumerate(spans)])
            for (c, rank), s in blank:
                ends = found[f"ends_{spans.index((c, s['low'], s['high']))}"]
                share = (rank - s["below"]) / (s["inside"] - 1)
                left = max(0, math.floor((share - slack) * 1000))
                right = min(1000, math.ceil((share + slack) * 1000))
                s["trial"] = (ends[left], ends[right])
        # Scan 2: exact counts left of, inside and at the ends of every trial bracket.
        trials = sorted({(k[0], *s["trial"]) for k, s in wide()}, key=str)
        exprs = []
        for i, (c, a, b) in enumerate(trials):
            exprs.append([
                F.count_if(col(c) < a).alias(f"under_{i}"),
                F.count_if(col(c) == a).alias(f"at_a_{i}"),
                F.count_if(between(c, a, b)).alias(f"inside_{i}"),
                F.count_if((col(c) == b) & F.lit(a != b)).alias(f"at_b_{i}"),
            ])
        found = _in_chunks(data, exprs)
        for (c, rank), s in wide():
            a, b = s.pop("trial")
            i = trials.index((c, a, b))
            under, at_a, inside, at_b = (
                found[f"{k}_{i}"] for k in ("under", "at_a", "inside", "at_b")
            )
            end = s["below"] + s["inside"]
            if rank < under:  # the sketch was off: the rank lies left of the trial
                s.update(high=a, inside=under - s["below"])
            elif rank < under + at_a:
                s["value"] = a
            elif rank < under + at_a + inside:
                s.update(low=a, high=b, below=under + at_a, inside=inside)
            elif rank < under + at_a + inside + at_b:
                s["value"] = b
            else:
                below = under + at_a + inside + at_b
                s.update(low=b, below=below, inside=end - below)
    return counts, ranks
