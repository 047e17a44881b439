"""Quality rules as one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]"
_TRIMMED = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in is it that for was on are as with be by this from at or "
    "le la les de des du et un une en que qui dans pour par sur est "
    "der die das und ist von zu den mit ein eine im nicht auf "
    "el los del y que con por para una su al se es"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= scale * numerator / denominator <= high``, compared as whole numbers.

    Numerator and denominator name statistics; a rule with a zero denominator fails.
    """

    name: str
    numerator: str
    denominator: str
    scale: int = 1
    low: int | None = None
    high: int | None = None


# The threshold table: mean word length, symbols, different stop words and lines.
RULES = (
    Rule("word_length", "word_chars", "n_words", 10, low=20, high=120),
    Rule("symbols", "n_symbols", "n_words", 100, high=10),
    Rule("stop_words", "n_stop_words", "one", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, high=60),
    Rule("exclamations", "n_exclamations", "n_words", 100, high=30),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_TRIMMED))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANKS}+"))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows and their places are sorted, so equal windows are neighbours; the places that have
    an equal neighbour are walked in order and each adds the words that the last did not cover.
    """
    def positions(found: Column) -> Column:
        n = F.size(found)

        def twin(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(found, i - 1)["g"] == x["g"])
            after = (i < n - 1) & (F.get(found, i + 1)["g"] == x["g"])
            return before | after

        return F.sort_array(F.transform(F.filter(found, twin), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total"))
        return F.aggregate(places, start, step, lambda acc: acc["total"])

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.size(w) - 2),
            lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2)))

    def count(grams: Column) -> Column:
        placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        repeated = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(repeated, _let(F.sort_array(placed), lambda s: covered(positions(s)))).otherwise(0)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows(words), count)).cast("long")


def spelled() -> list[str]:
    """Stop words in lower case and with a capital, each once."""
    return list(dict.fromkeys([*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]))


def _statistics(text: Column) -> dict[str, Callable[[Column], Column]]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return {
        "n_words": lambda w: F.size(w).cast("long"),
        "word_chars": lambda w: F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": lambda w: F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "lines": lambda w: repeated_lines,
        "n_repeat_words": _repeated,
        "n_stop_words": lambda w: F.size(F.array_intersect(w, F.array(*map(F.lit, spelled())))).cast("long"),
        "n_exclamations": lambda w: F.regexp_count(text, F.lit("!")).cast("long"),
    }


def rule_columns(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """``fails_<rule>`` for each rule, over columns with the names of the statistics."""
    result = {}
    for r in rules:
        value = F.col(r.numerator) * r.scale
        by = F.lit(1) if r.denominator == "one" else F.col(r.denominator)
        broken = by == 0
        if r.low is not None:
            broken = broken | (value < by * r.low)
        if r.high is not None:
            broken = broken | (value > by * r.high)
        result[f"fails_{r.name}"] = broken
    return result


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Statistics, base verdict, verdict of every rule and ``kept``; one row per document, no shuffle.

    Words are runs of other characters than blanks. Null texts have no word; they and
    empty texts fail the base rule. Null keys and repeated rows give a row each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    parts = _statistics(body)
    measured = docs.select(
        F.col(key).alias("doc_id"),
        _let(_words(body), lambda w: F.struct(*[f(w).alias(n) for n, f in parts.items()])).alias("s"))
    flat = measured.select(
        "doc_id", *[F.col("s")[n].alias(n) for n in parts if n != "lines"],
        F.col("s")["lines"]["n"].cast("long").alias("n_lines"),
        (F.col("s")["lines"]["n"] - F.col("s")["lines"]["d"]).cast("long").alias("n_dup_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = rule_columns(rules)
    judged = flat.withColumns({"base_failed": failed, **broken})
    kept = ~F.col("base_failed")
    for name in broken:
        kept = kept & ~F.col(name)
    return judged.withColumn("kept", kept)
