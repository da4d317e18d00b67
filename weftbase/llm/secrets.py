"""Secret scanning with DataFrame functions only.

Fixed patterns find assignments, access keys and long hex strings. Beside them, candidate strings are
scored by the Shannon entropy of a sliding window: the window's counts of characters are kept, a step adds one to
that of the entering character and takes one off that of the leaving one, and changes the window's sum of
c * log2(c) by those two alone. So time is linear in a candidate's length. The bar depends on the
character class of the candidate, and an allow-list of harmless shapes suppresses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftbase.llm.scratch import without

#: Kinds in the order in which spans with the same start are listed: pattern, group that must be long, least length.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: The same matches found sooner: a look at the first letter; a run that is too short fails as a whole.
FASTER = {"assign": PATTERNS["assign"][0].replace("(?i)", "(?i)(?=[psta])"), "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Spans gathered at once.
RUN = 256
#: Character classes, the first that fits a candidate counts: pattern of the whole, least bits per character in some window (null: never).
CLASSES = (
    (r"^[0-9]+$", None),
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^[a-zA-Z+/=_-]+$", 4.1),
    (r"^[a-z0-9+/=_-]+$|^[A-Z0-9+/=_-]+$", 3.6),
    (r".", 3.7),
)
#: Shapes that are no secrets: UUIDs, rulers, runs of the alphabet or of digits, paths of plain words, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[-=_+/]+$",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^/?[A-Za-z_-]+(/[A-Za-z_-]+)+/?$",
    r"(?i)example|placeholder|your[_-]|dummy|xxxx",
)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Sums (or maxima, as ``add`` has it; 0 is its zero) of the first 1, 2, .. values. An array that grows is copied
    at each step, so it is done for runs of RUN values, then for the runs."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def inside(a: Column, x: Column) -> Column:
        return let(add(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["all"], F.array(y)).alias("all")))

    def whole(v: Column) -> Column:
        heads = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(heads, lambda i: F.aggregate(F.slice(v, i + 1, RUN), none, inside))

        def joined(r: Column) -> Column:
            before = F.aggregate(r, none, lambda a, x: F.struct(add(a["at"], x["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
            return F.flatten(F.zip_with(r, before, lambda x, o: F.transform(x["all"], lambda y: add(o, y))))

        return let(runs, joined)

    return let(values, whole)


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Matches as array<struct<start, end, match>>, in code points, end exclusive; those whose ``group`` is
    shorter than ``least`` are left out after matching. What a split at the matches leaves tells where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def spans(m: Column) -> Column:
        sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda gap, x: gap + F.length(x))
        at = F.zip_with(running(sized, lambda a, b: a + b), m, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match")))
        kept = F.filter(F.zip_with(at, own, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] >= least)
        return F.transform(kept, lambda x: x["s"])

    return F.when(F.regexp_like(text, F.lit(pattern)), let(found, spans)).otherwise(empty)


def _term(count: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy (bits per character) of any ``window`` (up to 31) characters of ``text``, which
    has that many at least, all of them between U+002B and U+007A, as those of candidates are.

    Counts are kept as 5 bits each, 12 to a long.
    """
    chars = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 43)
    words = (80 + 11) // 12
    bits = lambda i: (i % 12 * 5).cast("int")
    count = lambda held, i: F.call_function("shiftright", F.get(held, F.floor(i / 12).cast("int")), bits(i)).bitwiseAND(31)

    def changed(held: Column, i: Column, by: int) -> Column:
        unit = F.call_function("shiftleft", F.lit(by).cast("long"), bits(i))
        return F.transform(held, lambda x, k: F.when(k == F.floor(i / 12), x + unit).otherwise(x))

    def enter(held: Column, total: Column, i: Column) -> Column:
        n = count(held, i)
        return F.struct(changed(held, i, 1).alias("held"), (total - _term(n) + _term(n + 1)).alias("total"))

    def leave(a: Column, i: Column) -> Column:
        n = count(a["held"], i)
        return F.struct(changed(a["held"], i, -1).alias("held"), (a["total"] - _term(n) + _term(n - 1)).alias("total"))

    def step(a: Column, x: Column) -> Column:
        made = let(leave(a, x["out"]), lambda b: enter(b["held"], b["total"], x["in"]))
        return let(made, lambda b: F.struct(b["held"].alias("held"), b["total"].alias("total"), F.least(a["least"], b["total"]).alias("least")))

    none = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("held"), F.lit(0.0).alias("total"))
    first = F.aggregate(F.slice(chars, 1, window), none, lambda a, c: enter(a["held"], a["total"], c), lambda a: F.struct(a["held"].alias("held"), a["total"].alias("total"), a["total"].alias("least")))

    def least(all_: Column) -> Column:
        # a slice that begins beyond the end is empty
        pairs = F.arrays_zip(F.slice(all_, window + 1, F.size(all_)).alias("in"), F.slice(all_, 1, F.greatest(F.size(all_) - window, F.lit(0))).alias("out"))
        return F.aggregate(pairs, first, step, lambda a: a["least"])

    return F.log2(F.lit(float(window))) - let(chars, least) / window


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: within a lambda, an expression is worked out at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def suspicious(candidate: Column) -> Column:
    """Whether the entropy rule reports a candidate string."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    bar = F.when(F.lit(False), F.lit(None).cast("double"))
    for pattern, bits in CLASSES:
        bar = bar.when(candidate.rlike(pattern), F.lit(bits).cast("double"))
    return F.when(allowed | bar.isNull(), F.lit(False)).otherwise(window_entropy(candidate) >= bar)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, text among them) with n_assign, n_access, n_hex (long) and secrets:
    array<struct<start, no, end, kind>> by start, then kind (assign, access, hex, entropy).

    Null text counts as empty. An entropy span that lies within a span of a fixed pattern is left out. Rows that
    repeat are rows of their own. Time follows a text's length, a candidate's and the number of matches.
    """
    docs = without(docs, "secrets", "n_assign", "n_access", "n_hex", "_text", "_entropy", *[f"_{k}" for k in PATTERNS])
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    text = F.col("_text")
    for kind, (pattern, group, least) in PATTERNS.items():
        out = out.withColumn(f"_{kind}", located(text, FASTER.get(kind, pattern), group, least))
    out = out.withColumn("_entropy", located(text, CANDIDATE))
    kinds = [*PATTERNS, "entropy"]

    def spans(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(kinds.index(kind)).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*[spans(k) for k in PATTERNS])
    out = out.withColumns({"secrets": base, **{f"n_{k}": F.size(f"_{k}").cast("long") for k in PATTERNS}})
    found = F.transform(F.col("_entropy"), lambda s: F.struct(s["start"].alias("start"), F.lit(len(PATTERNS)).alias("no"), s["end"].alias("end"), F.lit("entropy").alias("kind"), s["match"].alias("match")))
    known = F.transform(F.col("secrets"), lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast("string").alias("match")))

    def judged(all_: Column) -> Column:
        # of spans that begin no later, a fixed pattern's reaches to the end or none does
        reach = running(F.transform(all_, lambda x: F.when(x["match"].isNull(), x["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b))
        both = F.zip_with(all_, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r")))
        kept = F.filter(both, lambda b: b["x"]["match"].isNull() | ((b["r"] < b["x"]["end"]) & suspicious(b["x"]["match"])))
        return F.transform(kept, lambda b: F.struct(b["x"]["start"].alias("start"), b["x"]["no"].alias("no"), b["x"]["end"].alias("end"), b["x"]["kind"].alias("kind")))

    secrets = F.when(F.size("_entropy") > 0, let(F.array_sort(F.concat(known, found)), judged)).otherwise(F.array_sort("secrets"))
    return out.withColumn("secrets", secrets).drop("_text", "_entropy", *[f"_{k}" for k in PATTERNS])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans (in order of their starts) cover replaced by ``mark``; null stays null.
    Stretches between them are cut out RUN at a time, since finding a place takes as long as the text before it."""

    def made(s: Column) -> Column:
        return let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda ends: cut(s, ends))

    def cut(s: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), ends)
        gaps = F.filter(F.zip_with(s, F.slice(before, F.lit(1), F.size(s)), lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"))), lambda g: g["from"] <= g["to"])
        last = F.element_at(ends, -1)
        return F.concat(let(gaps, joined), F.substring(text, last + 1, F.length(text)))

    def joined(gaps: Column) -> Column:
        heads = F.sequence(F.lit(0), F.size(gaps) - 1, F.lit(RUN))
        return F.array_join(F.transform(heads, lambda i: let(F.slice(gaps, i + 1, RUN), run)), "")

    def run(own: Column) -> Column:
        first, end = F.get(own, F.lit(0))["from"], F.element_at(own, -1)["to"]
        piece = lambda part, g: F.concat(F.substring(part, g["from"] - first + 1, g["to"] - g["from"]), F.lit(mark))
        return let(F.substring(text, first + 1, end - first), lambda part: F.array_join(F.transform(own, lambda g: piece(part, g)), ""))

    return F.when(F.size(spans) > 0, let(spans, made)).otherwise(text)
