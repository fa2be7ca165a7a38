"""Secret scans: key patterns, and sliding-window entropy over candidate strings.

Base patterns, leftmost and without overlap per kind (fixed values below), keep matches that
are long enough. Entropy: runs of key characters are candidates; a window of WINDOW characters
slides over each, its Shannon entropy kept up to date by counts per character (one comes in,
one goes out). A run belongs to the narrowest character class that holds it, each with its own
threshold; the stretch from the first to the last window over the threshold is a span. The
allow-list suppresses runs that are no secrets: words, numbers, UUIDs, and names with a number.
Alphabet sequences and documentation samples inside a run count as one character repeated, so
they add no entropy and the rest of the run is judged on its own.

Everything happens in a text's own row: no rows are spread, joined or shuffled, and the work
grows in proportion to the text, also for one long run. Positions count code points, ends are
exclusive. Null and empty texts have no spans. Repeated rows give repeated results. An empty table
gives no rows; other columns are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pinned, table

# The base patterns. Hex and access need their least length at once, which finds
# the same spans: their matches are whole runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
RUN = f"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, RUN), strict=True))
#: Class, the pattern of runs in it, bits a character that a window must exceed.
CLASSES = (
    ("hex", "[0-9a-fA-F]+", 2.9),
    ("alnum", "[0-9A-Za-z]+", 3.6),
    ("base64", "[0-9A-Za-z+/=_-]+", 3.7),
)
#: Runs that are no secrets. Patterns with repeated groups match in one way only, without going back.
ALLOWED = (
    "[a-z_=+/-]+|[A-Z_=+/-]+",
    "[0-9_=+/-]+",
    "[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+",
    "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+[-_/=+]?[0-9]{1,8}",
)
#: Stretches of a run that are no part of a secret.
SAMPLES = ("abcdefghij", "0123456789", "ABCDEFGHIJ", "qwertyuiop", "EXAMPLE", "example")
#: Key characters have codes from "+" to "z"; their counts (at most WINDOW, 5 bits each) lie 12 to a number.
LOWEST, PACKED, BITS = ord("+"), 12, 5
NUMBERS = -(-(ord("z") - LOWEST + 1) // PACKED)
#: Numbers added at a time for running sums.
STEP = 128

SPANS = "array<struct<start:long,k:int,kind:string,end:long>>"


def masked(run: Column) -> Column:
    """run with the letters of samples replaced by one character, in the same places."""
    for sample in SAMPLES:
        run = F.replace(run, F.lit(sample), F.lit(sample[0] * len(sample)))
    return run


def _limit(run: Column) -> Column:
    """The least entropy of a secret, by the narrowest class that holds the run."""
    found = F.when(F.lit(False), 0.0)
    for _, pattern, bits in CLASSES:
        found = found.when(run.rlike(f"^(?:{pattern})$"), bits)
    return found


def _windows(slots: Column, limit: Column) -> Column:
    """Struct of first and last: starts of the first and last windows whose entropy exceeds limit, -1 if none; slots has each character's number, its shift in it, and those of the character that goes."""
    weight = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 2)])
    shifted = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    count = lambda counts, number, shift: F.call_function("shiftright", F.get(counts, number), shift).bitwiseAND(F.lit(31).cast("long")).cast("int")
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), NUMBERS).alias("counts"), F.lit(0.0).cast("double").alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(state: Column, x: Column) -> Column:
        same = (x["number"] == x["out_number"]) & (x["shift"] == x["out_shift"])
        n_in, n_out = count(state["counts"], x["number"], x["shift"]), count(state["counts"], x["out_number"], x["out_shift"])
        counts = F.transform(state["counts"], lambda c, k: c + F.when(k == x["number"], shifted(x["shift"])).otherwise(0) - F.when(k == x["out_number"], shifted(x["out_shift"])).otherwise(0))
        gain = F.get(weight, n_in + 1) - F.get(weight, n_in)
        loss = F.when(x["out_number"] >= 0, F.get(weight, n_out) - F.get(weight, n_out - 1)).otherwise(0.0)
        s, n = F.when(same, state["s"]).otherwise(state["s"] + gain - loss), state["n"] + 1
        over = (n >= WINDOW) & (F.lit(math.log2(WINDOW)) - s / WINDOW > limit)
        return F.struct(
            F.when(same, state["counts"]).otherwise(counts).alias("counts"), s.cast("double").alias("s"), n.alias("n"),
            F.when(over & (state["first"] < 0), n - WINDOW).otherwise(state["first"]).alias("first"),
            F.when(over, n - WINDOW).otherwise(state["last"]).alias("last"),
        )

    return F.aggregate(slots, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _kinds(column: str) -> list[str]:
    return [f"{column}_{kind}" for kind in KINDS]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (sorted structs of start, k, kind, end; k is the kind's place in KINDS) of every row of docs (doc_id, text)."""
    # Places come from the lengths of the text's pieces between and in matches; what a lambda uses again and again is pinned first.
    text, each = F.col("text"), lambda column, f: {f"{column}_{kind}": f(kind).alias(f"{column}_{kind}") for kind in KINDS}
    pieces = each("skipped", lambda k: F.when(text.rlike(PATTERNS[k]), F.transform(F.split(text, PATTERNS[k], -1), lambda x: F.length(x))))
    matches = each("match", lambda k: F.when(text.rlike(PATTERNS[k]), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))))
    found = pinned(docs.select("doc_id", *pieces.values(), *matches.values()))
    sizes = each("size", lambda k: F.transform(f"match_{k}", lambda m, i: F.get(f"skipped_{k}", i) + F.length(m)))
    sized = pinned(found.select("doc_id", *_kinds("match"), *_kinds("skipped"), *sizes.values()))
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = each("block", lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(f"size_{k}") / STEP).cast("int")), lambda b: total(F.slice(f"size_{k}", b * STEP + 1, F.lit(STEP)))))
    blocked = pinned(sized.select("*", *blocks.values()))
    heads = each("head", lambda k: F.transform(f"block_{k}", lambda x, b: total(F.slice(f"block_{k}", F.lit(1), b))))
    headed = pinned(blocked.select("*", *heads.values()).drop(*_kinds("block")))

    def start(k: str, i: Column) -> Column:
        block = F.floor(i / STEP).cast("int")
        return F.get(f"head_{k}", block) + total(F.slice(f"size_{k}", block * STEP + 1, i - block * STEP)) + F.get(f"skipped_{k}", i)

    placed = each("at", lambda k: F.transform(f"match_{k}", lambda m, i: F.struct(start(k, i).alias("start"), m.alias("match"))))
    at = pinned(headed.select("doc_id", *placed.values()))
    runs = F.filter("at_entropy", lambda x: ~F.array_contains(F.transform(F.array(*map(F.lit, ALLOWED)), lambda p: F.call_function("regexp_like", x["match"], F.concat(F.lit("^(?:"), p, F.lit(")$")))), True))
    # A character's code is kept with its run, so that a window's steps look up nothing by place in a string.
    coded = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), _limit(x["match"]).alias("limit"), F.transform(F.split(masked(x["match"]), ""), lambda c: F.ascii(c) - LOWEST).alias("codes")))
    ready = pinned(at.select("doc_id", "at_assign", "at_access", "at_hex", F.when(F.size("at_entropy") > 0, coded).alias("runs")))
    slot = lambda code: (F.floor(code / PACKED).cast("int"), (code % PACKED * BITS).cast("int"))

    def slots(codes: Column) -> Column:
        def one(code: Column, i: Column) -> Column:
            gone = F.coalesce(F.get(codes, i - WINDOW), F.lit(-1))
            (number, shift), (out_number, out_shift) = slot(code), slot(gone)
            return F.struct(number.alias("number"), shift.alias("shift"), out_number.alias("out_number"), F.when(gone >= 0, out_shift).otherwise(-1).alias("out_shift"))

        return F.transform(codes, one)

    swept = pinned(ready.select("doc_id", "at_assign", "at_access", "at_hex", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), _windows(slots(r["codes"]), r["limit"]).alias("w"))).alias("runs")))
    span = lambda begin, k, end: F.struct(begin.cast("long").alias("start"), F.lit(k + 1).alias("k"), F.lit(KINDS[k]).alias("kind"), end.cast("long").alias("end"))
    none = F.array().cast(SPANS)
    whole = lambda k: F.transform(f"at_{KINDS[k]}", lambda x: span(x["start"], k, x["start"] + F.length(x["match"])))
    long_enough = F.filter("at_assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    assigned = F.transform(long_enough, lambda x: span(x["start"], 0, x["start"] + F.length(x["match"])))
    over = F.transform(F.filter("runs", lambda r: r["w"]["first"] >= 0), lambda r: span(r["start"] + r["w"]["first"], 3, r["start"] + r["w"]["last"] + WINDOW))
    return swept.select("doc_id", F.array_sort(F.concat(*[F.coalesce(c, none) for c in (assigned, whole(1), whole(2), over)])).alias("spans"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    own = pinned(scan(table(spark, sf_dir, "documents", "doc_id", "text")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return own.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("entropy").alias("n_entropy"),
    )


def allowed(run: str) -> bool:
    """Whether the allow-list suppresses a run."""
    return any(re.fullmatch(p, run) for p in ALLOWED)
