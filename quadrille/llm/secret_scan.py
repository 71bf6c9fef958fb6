"""Secret scan with DataFrame functions only.

Base kinds are found by pattern. The method adds spans inside candidate strings: a window of
``WINDOW`` characters slides over each, the character counts are kept up by one addition and one
removal a step, and with them the sum of ``c * log2(c)``, hence the window's Shannon entropy.
Windows at or above the limit of the candidate's character class are merged into one span.
Candidates that an allow-list pattern matches in whole add none; base spans always stay.

Positions are code points, ends exclusive. Spark's expressions have no match positions, so a
text is split by the pattern and the positions follow from the lengths of gaps and matches.

Defined results: null and empty texts have no spans; repeated rows are scanned apart; ties in
``start`` are ordered by kind as listed in ``KINDS``; other columns are not read. A row is worked
on alone, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import table, text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs: a shorter run can't hold a longer match, so the minimum can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidate strings, and the least entropy in bits of a window by character class, which 95 to 98 of 100 windows of random
#: characters of that class reach. Strings of one case only are words to the allow-list.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Windows of a candidate that are walked at a time, and items of an array that are summed at a time.
BLOCK = 256
#: The candidates' characters lie between + and z.
_FIRST, _CODES = ord("+"), ord("z") - ord("+") + 1
LIMITS = ((r"[0-9]+", 2.6), (r"[0-9a-fA-F]+", 3.0), (r"[A-Za-z]+", 3.7), (r"[A-Za-z0-9]+", 3.7), (r"[A-Za-z0-9+/_=-]+", 3.7))
#: Candidates that are no secrets: one class repeated, counting runs, words joined by signs, file paths, placeholders.
ALLOWED = (
    r"(.)\1*",
    r"(?i).*(?:0123456789|abcdefghij|example|sample|placeholder|dummy|xxxx).*",
    # possessive, so that long strings don't nest
    r"[A-Za-z]?[a-z]*(?:[-_/=+]+[A-Za-z]?[a-z]*)*+",
    r"[A-Z]+(?:[-_/=+]+[A-Z]+)*+",
    r"[0-9]{1,4}(?:[-/_][0-9]{1,4})++",
)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(xs: Column, block: int = BLOCK) -> Column:
    """What stands before each of ``xs`` (integers), summed; in blocks, so that no long array is copied for each item."""
    none = F.array().cast("array<int>")

    def before(part: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def placed(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(xs) - 1, F.lit(block)).cast("int")), lambda k: before(F.slice(xs, k * block + 1, block)))
        moved = let(blocks, lambda bs: F.zip_with(bs, before(F.transform(bs, lambda b: b["at"]))["out"], lambda b, at: F.transform(b["out"], lambda x: x + at)))
        return F.when(F.size(xs) > 0, F.flatten(moved)).otherwise(none)

    return let(xs, placed)


def starts_of(text: Column, pattern: str, matches: Column) -> Column:
    """Where each of ``matches`` (all of ``pattern``, whole) begins: by the lengths of matches and of the gaps between."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    steps = lambda g: F.transform(matches, lambda m, i: F.element_at(g, i + 1) + F.length(m))
    return let(gaps, lambda g: F.transform(running(steps(g)), lambda at, i: at + F.element_at(g, i + 1)))


def spans_of(text: Column, pattern: str, kind: int, ok: Column | None = None) -> Column:
    """Array of ``(start, kind, end)`` of the leftmost non-overlapping matches; ``ok`` filters by match number (an array of booleans)."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    one = lambda m, at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end"))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: F.zip_with(ms, starts_of(text, pattern, ms), one))
    if ok is not None:
        found = let(F.struct(found.alias("m"), ok.alias("ok")), lambda v: F.filter(v["m"], lambda _, i: F.element_at(v["ok"], i + 1)))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def entropy_runs(piece: Column, limit: Column) -> Column:
    """``(start, end)`` (from 0) of the windows of ``piece`` whose entropy reaches ``limit``; those that overlap or touch are one.

    The window's character counts are fields of 5 bits, twelve to a word; a step adds to one and takes from one.
    """
    w = WINDOW
    # sum of c*log2(c) falls and rises by what one character more or less changes
    weigh = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)
    run = "struct<start:int,end:int>"
    state = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-_CODES // 12)).alias("count"),
        F.lit(0.0).alias("sum"),
        F.array().cast(f"array<{run}>").alias("runs"),
        F.lit(-1).alias("start"),
        F.lit(-1).alias("end"),
    )
    word, shift = (lambda c: F.call_function("div", c, F.lit(12)).cast("int")), (lambda c: (c % 12) * 5)
    field = lambda counts, c: F.call_function("shiftright", F.element_at(counts, word(c) + 1), shift(c)).bitwiseAND(31).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))

    def walk(codes: Column) -> Column:
        def put(s: Column, i: Column) -> Column:
            new, old = F.element_at(codes, i), F.when(i > w, F.element_at(codes, F.greatest(i - w, F.lit(1)))).otherwise(F.lit(-1))
            return let(F.struct(new.alias("new"), old.alias("old")), lambda v: step(s, i, v["new"], v["old"]))

        def step(s: Column, i: Column, new: Column, old: Column) -> Column:
            kept = F.greatest(old, F.lit(0))
            c, d = field(s["count"], new), field(s["count"], kept)
            # the same character comes and goes: nothing changes
            changed = F.when(old < 0, weigh(c + 1) - weigh(c)).when(old == new, 0.0).otherwise(weigh(c + 1) - weigh(c) + weigh(d - 1) - weigh(d))
            counts = F.transform(s["count"], lambda x, k: x + F.when(k == word(new), bit(new)).otherwise(0) - F.when((old >= 0) & (k == word(kept)), bit(kept)).otherwise(0))
            return let(F.struct(F.when(old == new, s["count"]).otherwise(counts).alias("count"), (s["sum"] + changed).alias("sum")), lambda v: ended(s, i, v))

        def ended(s: Column, i: Column, v: Column) -> Column:
            hit = (i >= w) & (math.log2(w) - v["sum"] / w >= limit - 1e-9)
            fresh = hit & ((s["start"] < 0) | (s["end"] < i - w))
            closed = F.when(fresh & (s["start"] >= 0), F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["runs"])
            return F.struct(v["count"].alias("count"), v["sum"].alias("sum"), closed.alias("runs"), F.when(fresh, i - w).otherwise(s["start"]).alias("start"), F.when(hit, i).otherwise(s["end"]).alias("end"))

        done = lambda s: F.when(s["start"] < 0, s["runs"]).otherwise(F.concat(s["runs"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), state, put, done)

    return let(F.transform(F.split(piece, ""), lambda c: F.ascii(c) - _FIRST), walk)


def limit_of(s: Column) -> Column:
    out = F.lit(float("inf"))
    for pattern, bits in reversed(LIMITS):
        out = F.when(F.regexp_like(s, F.lit(f"^(?:{pattern})$")), F.lit(bits)).otherwise(out)
    return out


def joined_runs(runs: Column) -> Column:
    """``runs`` in order, those that overlap or touch as one."""
    begins = F.transform(F.filter(runs, lambda r, i: (i == 0) | (F.element_at(runs, F.greatest(i, F.lit(1)))["end"] < r["start"])), lambda r: r["start"])
    stops = F.transform(F.filter(runs, lambda r, i: (i + 1 == F.size(runs)) | (F.element_at(runs, F.least(i + 2, F.size(runs)))["start"] > r["end"])), lambda r: r["end"])
    return F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def entropy_spans(text: Column) -> Column:
    """Array of ``(start, kind, end)`` by the sliding-window entropy, each at most one candidate long.

    A candidate is walked in pieces of ``BLOCK`` windows, so that the work grows with its length alone.
    """
    allowed = "^(?:" + "|".join(f"(?:{p})" for p in ALLOWED) + ")$"
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def inside(word: Column, at: Column) -> Column:
        def piece(parts: Column, k: Column, limit: Column) -> Column:
            behind = F.when(k + 1 < F.size(parts), F.left(F.element_at(parts, F.least(k + 2, F.size(parts))), F.lit(WINDOW - 1))).otherwise("")
            return F.transform(entropy_runs(F.concat(F.element_at(parts, k + 1), behind), limit), lambda r: F.struct((r["start"] + k * BLOCK).alias("start"), (r["end"] + k * BLOCK).alias("end")))

        parts = F.regexp_extract_all(word, F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
        runs = let(F.struct(parts.alias("p"), limit_of(word).alias("l")), lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.size(v["p"]) - 1), lambda k: piece(v["p"], k, v["l"]))))
        spans = F.transform(let(runs, joined_runs), lambda r: F.struct((at + r["start"]).alias("start"), F.lit(3).alias("kind"), (at + r["end"]).alias("end")))
        return F.when(F.regexp_like(word, F.lit(allowed)), empty).otherwise(spans)

    found = let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda ws: F.flatten(F.zip_with(ws, starts_of(text, CANDIDATE, ws), inside)))
    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), found).otherwise(empty)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``base_spans`` and ``all_spans``: arrays of ``(start, kind, end)`` in order, ``kind`` an index of ``KINDS``."""
    text = F.col("_ss_text")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    # a failing match still takes its characters, so it's dropped after matching
    assign = spans_of(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= 8))
    base = F.array_sort(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))
    found = df.withColumn("_ss_text", text_or_empty(text_col)).withColumn("base_spans", base).withColumn("_ss_more", entropy_spans(text))
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", "_ss_more"))).drop("_ss_text", "_ss_more")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(F.encode(listed(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
