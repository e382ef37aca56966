"""Personal data: expressions propose spans, checksums confirm them, context words adjust scores. DataFrame functions alone.

Spans are counted in code points, ends exclusive. Of each kind they are leftmost and do not overlap; kinds may overlap.
The expressions are forms of the plain ones that match the same spans without backtracking: a match may begin only where
a run of its characters begins, or where the last match ended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

LOCAL, NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind: (a text that has a span has this, expression, score, score with a context word nearby, context words)
KINDS = {
    "email": ("@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{NAME}++(?:\.{NAME}++)++", 0.8, 1.0, "e-?mail|contact|write|address|@"),
    "ip": ("[0-9]\\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, 0.9, "ip|host|server|address|client|login|addr"),
    "card": ("[0-9][ -]?[0-9]", r"[0-9](?:[ -]?+[0-9]){11,}+", 0.7, 1.0, "card|credit|debit|visa|master|amex|pay|iban"),
    "phone": ("\\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, 0.9, "phone|tel|call|mobile|cell|fax|contact"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.9, 1.0, "iban|bank|account|transfer|konto"),
    "ssn": ("[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, 0.8, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
#: Code points before a span in which context words count, and the score that a span of an added kind needs.
CONTEXT, LEAST = 40, 0.5
#: Items whose array grows one by one; code points of a block of text.
CHUNK, BLOCK = 64, 4096
#: Parts matches from the rest; a text's own ones are replaced by MARK_2, which no expression matches either.
MARK, MARK_2 = "\u0001", "\u0002"
SPAN = "struct<start:int,rank:int,kind:string,stop:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass Luhn's check."""

    def term(c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    digits = F.filter(F.split(_digits(value), ""), lambda c: c != "")
    return F.aggregate(F.transform(digits, lambda c, i: term(c, i, F.size(digits))), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the check modulo 97: its first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.filter(F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c >= "A", (a * 100 + letter) % 97).otherwise((a * 10 + (F.ascii(c) - 48)) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "card": n.between(12, 19) & luhn(value),
        "phone": n.between(9, 15),
        "iban": mod97(value),
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|0000$"),
    }[kind]


def _confirmed(kind: str):
    return lambda span: _valid(kind, span["value"])


def scanned(items: Column, value, combine, emit, out: str) -> Column:
    """emit(what combine makes of the values of all earlier items, item) of each item: an array of type `out`.

    Items are taken by CHUNK, whose values are combined first, so that an array grows one by one within a chunk only.
    """
    empty = F.array().cast(f"array<{out}>")

    def within(c: Column, base: Column) -> Column:
        step = lambda a, x: F.struct(combine(a["at"], value(x)).alias("at"), F.concat(a["out"], F.array(emit(a["at"], x))).alias("out"))
        return F.aggregate(c, F.struct(base.alias("at"), empty.alias("out")), step, lambda a: a["out"])

    def by_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: combine(a, value(x))))
        bases = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(combine(F.element_at(a, -1), t))))
        return F.flatten(F.transform(F.array(bases), lambda b: F.flatten(F.transform(chunks, lambda c, i: within(c, F.get(b, i))))))

    def cut(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, CHUNK))

    # Arrays are bound once, as the variables of one-element transforms.
    chunks = F.flatten(F.transform(F.array(items), cut))
    return F.flatten(F.transform(F.array(chunks), by_chunks))


def _proposed(text: Column, kind: str) -> Column:
    """Spans of a kind that its expression proposes: array of SPAN."""
    hint, pattern, *_ = KINDS[kind]

    # Even parts lie between matches, odd ones are matches.
    def pairs(p: Column) -> Column:
        both = F.zip_with(F.filter(p, lambda x, i: i % 2 == 0), F.filter(p, lambda x, i: i % 2 == 1), lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("value")))
        return F.filter(both, lambda x: x["value"].isNotNull())

    def span(before: Column, x: Column) -> Column:
        start = before + x["gap"]
        return F.struct(start.alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(x["value"])).alias("stop"), x["value"].alias("value"))

    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = scanned(F.flatten(F.transform(F.array(parts), pairs)), lambda x: x["gap"] + F.length(x["value"]), lambda a, x: a + x, span, SPAN)
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _score(text: Column, s: Column) -> Column:
    """The score of a span: raised by one of its kind's words among the code points before it."""
    near = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    cases = [F.when(s["kind"] == k, F.when(near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), F.lit(high)).otherwise(F.lit(low))) for k, (_, _, low, high, words) in KINDS.items()]
    return F.coalesce(*cases)


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with all confirmed spans of each whole text: array of (start, rank, kind, stop, value, score) by start, then kind.

    Null texts count as empty and have none. A column called `out` is replaced; others stay, whatever they are called.
    """
    columns = [c for c in docs.columns if c != out]
    safe, every, *by_kind = fresh(docs, "pii_safe", "pii_all", *[f"pii_{k}" for k in KINDS])
    docs = docs.withColumn(safe, F.translate(F.coalesce(F.col(text), F.lit("")), MARK, MARK_2))
    docs = docs.withColumns({name: F.filter(_proposed(F.col(safe), kind), _confirmed(kind)) for name, kind in zip(by_kind, KINDS, strict=True)})
    docs = docs.withColumn(every, F.sort_array(reduce(F.concat, map(F.col, by_kind)))).drop(*by_kind)
    scored = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"), _score(F.col(safe), s).alias("score")))
    kept = F.filter(scored, lambda s: (s["rank"] < len(BASE)) | (s["score"] >= LEAST))
    return docs.select(*columns, F.when(F.size(every) > 0, kept).otherwise(F.filter(scored, lambda s: F.lit(False))).alias(out))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data per document. Null and empty texts have none; texts of any length are searched whole;
    repeated rows give repeated rows, an empty table none; other columns are ignored."""
    rows = with_spans(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"), scores.alias("scores"))


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The code points from a to b of a text given in blocks of BLOCK."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    part = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    begin = (F.pmod(a, F.lit(BLOCK)) + 1).cast("int")
    across = F.concat(F.substring(part(i), begin, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(part(j), F.lit(1), F.pmod(b, F.lit(BLOCK)).cast("int")))
    return F.when(i == j, F.substring(part(i), begin, (b - a).cast("int"))).otherwise(across)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; overlapping spans become one, named after the first.

    Null texts stay null; other columns stay as they are, whatever they are called. The text is cut into blocks once, from which
    what lies between spans is taken.
    """
    (made,) = fresh(docs, "pii_spans")
    rows = with_spans(docs, out=made)
    out = "struct<before:int,start:int,stop:int,kind:string>"
    emit = lambda before, s: F.struct(before.alias("before"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    seen = scanned(F.col(made), lambda s: s["stop"], F.greatest, emit, out)
    blocks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def rewritten(b: Column) -> Column:
        apart = F.filter(seen, lambda s: s["start"] >= s["before"])
        pieces = F.transform(apart, lambda s: F.concat(_between(b, s["before"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), _between(b, F.array_max(F.transform(made, lambda s: s["stop"])), F.length("text")))

    text = F.get(F.transform(F.array(blocks), rewritten), F.lit(0))
    return rows.withColumn("text", F.when(F.size(made) > 0, text).otherwise(F.col("text"))).select(*docs.columns)
