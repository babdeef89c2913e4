"""Secrets in texts: fixed patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

A candidate is a run of `CANDIDATE` characters, cut where a placeholder of the allow list stands. A window of `WIDTH` characters slides
over it; the counts of its characters, of its character classes and the sum of c * log2(c), from which the entropy follows, are kept
incrementally, one character in and one out. Each window has its own class: hexadecimal ones are hot from `HEX_BITS` on, others from
`MIXED_BITS`, windows of nothing but letters or of nothing but digits never. From the first to the end of the last hot window
of a candidate is an `entropy` span.

Spans are in code points, end exclusive. Base kinds are reported whatever the allow list says. Null and empty texts have none, repeated
rows the same ones. Work is in proportion to the length of a text and to the number of its spans, also for one candidate of millions of characters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. An access key or hex run that is too short has no longer match inside it, so the
# length is part of the pattern; for assignments it is checked after matching, because matching must not start anew.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WIDTH = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# The least entropy, in bits, of a hot window of hexadecimal digits and of one with other characters.
HEX_BITS, MIXED_BITS = 2.9, 3.85
# Placeholders and runs of the alphabet that no secret holds, each with its length.
ALLOWED = (
    ("example", 7), ("sample", 6), ("placeholder", 11), ("changeme", 8), ("your[_-]", 5), ("test[_-]", 5),
    ("abcdefgh", 8), ("01234567", 8), ("12345678", 8),
)
# Characters of a candidate by kind: hexadecimal letters, other letters, digits, signs that join words, others.
KINDS_OF = ("abcdefABCDEF", "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "0123456789", "/_-", "+=")
ALPHABET = "".join(KINDS_OF)
# The letter for a count of zero in a window's counts; the letters after it count on.
NONE = "A"
# Spans that are placed one by one before their list is put aside.
RUN = 256
# Entropy in integers, so that sums are exact.
UNIT = 1_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, value: int = 0) -> Column:
    """array<struct<start, end, value>> of leftmost matches; `value` is the text of that group.

    Pieces between matches and their lengths give the positions. They are added up RUN at a time: a list never grows
    one by one over more than RUN entries.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    none = F.lit(0).cast("long")
    span = F.struct(none.alias("start"), none.alias("end"))
    nothing = F.slice(F.array(span), 1, 0)

    def step(state: Column, each: Column) -> Column:
        start = state.at + each.gap
        end = start + each.own
        return F.when(each.own.isNull(), state).otherwise(F.struct(
            end.alias("at"), F.concat(state.out, F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out")))

    def runs(all_lengths: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_lengths) - 1) / RUN).cast("int"))
        return F.transform(numbers, lambda n: F.slice(all_lengths, n * RUN + 1, F.lit(RUN)))

    def whole_run(state: Column, run: Column) -> Column:
        placed = F.aggregate(run, F.struct(state.at.alias("at"), nothing.alias("out")), step)
        return let(placed, lambda done: F.struct(done.at.alias("at"), F.concat(state.out, F.array(done.out)).alias("out")))

    begin = F.struct(none.alias("at"), F.slice(F.array(nothing), 1, 0).alias("out"))
    spans = F.flatten(F.aggregate(let(lengths, runs), begin, whole_run, lambda state: state.out))
    return F.zip_with(spans, values, lambda s, v: F.struct(
        s.getField("start").alias("start"), s.getField("end").alias("end"), v.alias("value")))


def where(text: Column, pattern: str, value: int = 0) -> Column:
    """As `matches`; texts without any match are only searched once."""
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), matches(text, pattern, value)).otherwise(nothing)


def without_placeholders(text: Column) -> Column:
    """The text with blanks in the place of all `ALLOWED` words, which cut a candidate in two."""
    blank = text
    for pattern, length in ALLOWED:
        blank = F.regexp_replace(blank, "(?i)" + pattern, " " * length)
    any_of = "(?i)" + "|".join(pattern for pattern, _ in ALLOWED)
    return F.when(text.rlike(any_of), blank).otherwise(text)


def limit(bits: float) -> int:
    """The largest sum of c * log2(c) of a window with that entropy, in units."""
    return int(UNIT * WIDTH * (math.log2(WIDTH) - bits))


def hot_range(value: Column) -> Column:
    """struct<from, to> of the hot windows of a candidate; null if none is hot.

    Characters are numbers in the order of `ALPHABET`, the window's counts a string with one letter for each of them (`NONE`: not in
    the window). A step changes two letters, the sum and the tallies of characters outside words, numbers and hexadecimal digits.
    """
    weight = [0] + [c * math.log2(c) for c in range(1, WIDTH + 2)]
    # What one more of a character that is there n times adds to the sum.
    more = F.lit([round(UNIT * b) - round(UNIT * a) for a, b in zip(weight, weight[1:], strict=False)])
    zero, none = F.lit(0), F.lit(None).cast("int")
    ends = {name: sum(map(len, KINDS_OF[: i + 1])) for i, name in enumerate(("hex", "letter", "digit", "joint"))}

    def outside(code: Column, kind: str) -> Column:
        letter, digit, other = code.between(1, ends["letter"]), code.between(ends["letter"] + 1, ends["digit"]), code > ends["joint"]
        in_kind = {"word": digit | other, "number": letter | other, "hex": (code > ends["digit"]) | code.between(ends["hex"] + 1, ends["letter"])}
        return in_kind[kind].cast("int")

    def moves(codes: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(zero, WIDTH), codes), F.lit(1), F.size(codes))
        return F.zip_with(codes, before, lambda came, left: F.struct(
            came.alias("came"), left.alias("left"),
            *((outside(came, k) - outside(left, k)).alias(k) for k in ("word", "number", "hex"))))

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    begin = F.struct(
        F.lit(NONE * len(ALPHABET)).alias("counts"), zero.alias("sum"), *(zero.alias(k) for k in ("word", "number", "hex", "i")),
        none.alias("from"), none.alias("to"))

    def times(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code, F.lit(1))) - ord(NONE)

    def step(state: Column, move: Column) -> Column:
        came, left = move.getField("came"), move.getField("left")

        def entered(n: Column) -> Column:
            return F.struct(F.overlay(state.counts, F.char(n + ord(NONE) + 1), came, F.lit(1)).alias("counts"),
                            (state.getField("sum") + F.get(more, n)).alias("sum"))

        def departed(new: Column) -> Column:
            return let(times(new.counts, left), lambda n: F.struct(
                F.overlay(new.counts, F.char(n + ord(NONE) - 1), left, F.lit(1)).alias("counts"),
                (new.getField("sum") - F.get(more, n - 1)).alias("sum")))

        def judged(new: Column) -> Column:
            tally = {k: state.getField(k) + move.getField(k) for k in ("word", "number", "hex")}
            i = state.getField("i") + 1
            most = F.when(tally["hex"] == 0, F.lit(limit(HEX_BITS))).otherwise(F.lit(limit(MIXED_BITS)))
            hot = (new.getField("sum") <= most) & (i >= WIDTH) & (tally["word"] > 0) & (tally["number"] > 0)
            return F.struct(
                new.counts.alias("counts"), new.getField("sum").alias("sum"), *(tally[k].alias(k) for k in tally), i.alias("i"),
                F.when(hot & state.getField("from").isNull(), i - WIDTH).otherwise(state.getField("from")).alias("from"),
                F.when(hot, i).otherwise(state.getField("to")).alias("to"))

        changed = let(let(times(state.counts, came), entered), lambda new: F.when(left > 0, departed(new)).otherwise(new))
        return let(changed, judged)

    end = lambda s: F.when(s.getField("from").isNotNull(), F.struct(s.getField("from").alias("from"), s.getField("to").alias("to")))
    return F.aggregate(let(codes, moves), begin, step, end)


def ranked(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s.getField("start").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s.getField("end").alias("end")))


def joined(spans: Column) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s.getField("rank")), s.getField("start"), s.getField("end"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans; one row per row, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        "doc_id",
        F.filter(where(text, ASSIGN, 2), lambda m: F.length(m.value) >= ASSIGN_CHARS).alias("assign"),
        where(text, ACCESS).alias("access"), where(text, HEX).alias("hex"),
        F.filter(
            where(without_placeholders(text), CANDIDATE),
            lambda m: m.value.rlike("[0-9+=]") & m.value.rlike("[A-Za-z+=]")).alias("candidates"))
    hot = F.filter(
        F.transform("candidates", lambda m: F.struct(m.start.alias("at"), hot_range(m.value).alias("hot"))),
        lambda m: m.hot.isNotNull())
    entropy = F.transform(hot, lambda m: F.struct(
        (m.at + m.hot.getField("from")).alias("start"), (m.at + m.hot.getField("to")).alias("end")))
    # One row's columns are computed once and then read several times.
    found = found.withColumn("entropy", entropy)
    base = F.concat(*(ranked(F.col(kind), kind) for kind in KINDS[:3]))
    spans = found.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS), base.alias("base"),
        ranked(F.col("entropy"), "entropy").alias("more"))
    return spans.select(
        "doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"))
