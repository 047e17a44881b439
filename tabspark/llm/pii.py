"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import free_name

# Characters before and after a span that are searched for context words.
NEARBY = 48
# Code points of the pieces that a text is cut into, and elements of the pieces of an array.
WINDOW = 1024
CHUNK = 128
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(
        i % 2 == 1, (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits of an account number leave remainder 1 after its head is moved to the end."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    ``trigger`` is a cheap test that must hold for a text with such a span. ``score`` is what a
    confirmed span starts with; a context word nearby adds ``bonus``. Spans below ``least`` go.
    """

    name: str
    pattern: str
    trigger: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None
    score: float
    context: str
    bonus: float
    least: float = 0.0


# Every pattern matches at the same places as the plain form beside it, but cannot be slow on long
# runs: it starts at the start of a run (or where the last match ended) and gives nothing back.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), None, 0.8, r"mail|contact|write to|correo|courriel", 0.2),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.6, r"\bip\b|address|host|server|adresse", 0.3),
    # [0-9]([\x20-]?[0-9])+ with 16 to 19 digits: runs cannot touch, so the count may stand in the pattern
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
         lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: luhn(_digits(m)), 0.7,
         r"card|visa|credit|karte|carte|tarjeta", 0.3),
    # \+[0-9][\x20().0-9-]+[0-9] with 8 to 15 digits
    Kind("phone", r"\+[0-9](?:[\x20().-]*+[0-9])++", lambda t: F.contains(t, F.lit("+")),
         lambda m: F.length(_digits(m)).between(8, 15), 0.6, r"phone|call|tel|mobile|fax", 0.3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
         lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34)
         & mod97(F.replace(m, F.lit(" "), F.lit(""))),
         0.8, r"iban|account|bank|konto|cuenta|compte", 0.2),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), None, 0.3, r"ssn|social security|tax", 0.5, 0.6),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,128})(?![A-Za-z0-9+/_=-])",
         lambda t: t.rlike("AKIA[0-9A-Z]{16}|[0-9a-f]{16}"), lambda m: m.rlike("[a-zA-Z]") & m.rlike("[0-9]"),
         0.4, r"token|password|passwd|secret|api[_ -]?key|access[_ -]?key|\bkey\b|AKIA", 0.4, 0.6),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _windows(text: Column) -> Column:
    """A text as pieces of ``WINDOW`` code points, so that a place in it is reached without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))


def _between(windows: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``; ``end`` may lie beyond the text."""
    first, last = F.floor(start / WINDOW).cast("int"), F.floor(end / WINDOW).cast("int")
    piece = lambda i: F.coalesce(F.get(windows, i), F.lit(""))
    inner = F.array_join(F.slice(windows, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(
        first == last, F.substring(piece(first), start % WINDOW + 1, end - start)
    ).otherwise(F.concat(F.substring(piece(first), start % WINDOW + 1, F.lit(WINDOW)), inner,
                         F.substring(piece(last), F.lit(1), end % WINDOW)))


def _chunks(values: Column) -> Column:
    """An array as an array of arrays of ``CHUNK`` elements."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(CHUNK))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(CHUNK)))


def _running(lengths: Column) -> Column:
    """Sums of all lengths up to each: within chunks, then over chunks, so no long array is copied for each element."""
    none = F.array().cast("array<int>")
    last = lambda sums: F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))
    within = lambda chunk: F.aggregate(chunk, none, lambda acc, n: F.concat(acc, F.array(last(acc) + n)))
    return _let(F.transform(_chunks(lengths), within), lambda sums: _let(
        within(F.transform(sums, last)), lambda ends: F.flatten(F.zip_with(
            sums, ends, lambda own, end: F.transform(own, lambda n: n + end - last(own))))))


def _spans(text: Column, windows: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in code points, in order."""
    def scored(m: Column) -> Column:
        around = F.concat(
            _between(windows, F.greatest(F.lit(0), m["start"] - NEARBY), m["start"]),
            m["text"] if kind.name == "secret" else F.lit(" "), _between(windows, m["end"], m["end"] + NEARBY))
        return F.lit(kind.score) + F.when(around.rlike(f"(?i){kind.context}"), kind.bonus).otherwise(0.0)

    def placed(found: Column) -> Column:
        # The parts between matches tell where each match starts.
        gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))
        return F.zip_with(_running(steps), found, lambda end, m: F.struct(
            (end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))

    def confirmed(found: Column) -> Column:
        spans = placed(found)
        if kind.valid:
            spans = F.filter(spans, lambda m: kind.valid(m["text"]))
        spans = F.transform(spans, lambda m: F.struct(
            F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), scored(m).alias("score")))
        return F.filter(spans, lambda m: m["score"] >= kind.least) if kind.least else spans

    none = F.array().cast(SPAN)
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(kind.trigger(text), _let(matches, lambda f: F.when(F.size(f) > 0, confirmed(f)).otherwise(none))
                  ).otherwise(none)


def spans_column(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All spans of a text, by kind in the order of the kinds, then by start."""
    anything = reduce(lambda a, b: a | b, [k.trigger(text) for k in kinds])
    return F.when(anything, _let(_windows(text), lambda w: F.concat(*[_spans(text, w, k) for k in kinds]))).otherwise(
        F.array().cast(SPAN))


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc_id, spans`` for every row: kind, start, end (code points, end exclusive) and score.

    Matches of a kind do not overlap and are found from the left in whole texts; those that
    a validator refuses are dropped. Spans of different kinds may overlap. Null and empty
    texts have no span; null keys and repeated rows give a row each. One projection, no shuffle.
    """
    return docs.select(F.col(key).alias("doc_id"), spans_column(F.coalesce(F.col(text), F.lit("")), kinds).alias("spans"))


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets.

    Overlapping spans are replaced by one mark of the first. Texts without spans, null ones
    too, stay as they are. ``n_chars``, where present, follows the new text.
    """
    mark = "struct<at: int, marks: array<array<struct<from: int, to: int, kind: string>>>>"

    def walk(chunk: Column, at: Column) -> Column:
        """The marks of some spans in order, each with the text before it, and where the last of them ends."""
        return F.aggregate(
            chunk, F.struct(at.alias("at"), F.array().cast("array<struct<from: int, to: int, kind: string>>").alias("marks")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], -s["back"]).alias("at"),
                F.when(s["start"] < acc["at"], acc["marks"]).otherwise(F.concat(acc["marks"], F.array(F.struct(
                    acc["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))))).alias("marks")))

    def rebuilt(t: Column, spans: Column) -> Column:
        by_start = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
        walked = F.aggregate(
            _chunks(by_start), F.lit(None).cast(mark), lambda acc, chunk: _let(
                walk(chunk, F.coalesce(acc["at"], F.lit(0))), lambda done: F.struct(done["at"].alias("at"), F.concat(
                    F.coalesce(acc["marks"], F.array().cast("array<array<struct<from: int, to: int, kind: string>>>")),
                    F.array(done["marks"])).alias("marks"))))
        return _let(F.struct(_windows(t).alias("windows"), walked.alias("walked")), lambda x: F.concat(
            F.array_join(F.transform(F.flatten(x["walked"]["marks"]), lambda m: F.concat(
                _between(x["windows"], m["from"], m["to"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))), ""),
            _between(x["windows"], x["walked"]["at"], F.greatest(F.length(t), x["walked"]["at"]))))

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    new = _let(spans_column(body, kinds), lambda s: F.when(F.size(s) > 0, rebuilt(body, s)))
    changed = free_name("redacted", docs.columns)
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], new.alias(changed))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.coalesce(changed, F.col(f"`{c}`")).alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col(changed).isNotNull(), F.length(changed).cast(kind))
                           .otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return marked.select(*columns)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def private_digests(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """Counts and the hash of the base spans, and all spans as text."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, written), ",")
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in base]
    basic = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(joined(basic).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
