"""Secret scans in DataFrame functions only.

Named patterns give the base spans. Beside them, candidate strings (runs of key characters) are
judged by the Shannon entropy of a window that slides over them: one fold over the characters
keeps a count of each and the sum of c * log2(c), from which the entropy of every window follows
by adding the character that enters and removing the one that leaves. Thresholds differ by
character class; an allow-list suppresses strings that look random but are not secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from relspark.llm.columns import fresh, id_and_text

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64"]

#: The patterns of the base kinds.
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: The longest run that starts a match decides, so these hold the least lengths themselves.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a window must reach, by class; a window of 20 characters can reach 4.32.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_alnum": 3.6, "entropy_base64": 3.8}
#: Parts that look random or like a key but are none: UUIDs, placeholders, alphabets, rules, paths. No window holds any of one.
ALLOWED = r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])|(?i:example|sample|placeholder|dummy|changeme|xxxx|0123456789|abcdefgh|----|====|____|/[a-z]+/[a-z]+/)"

SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
#: Items of one fold: a fold copies what it has gathered at every step, so long lists are folded in runs of so many.
RUN = 128
#: Characters of a part of a long string.
PART = 1024


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda that names an expression computes it for every item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_runs(items: Column) -> Column:
    """Consecutive items, RUN at a time; ``items`` is a column or a lambda's variable."""
    last = F.floor((F.size(items) - 1) / RUN).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))).otherwise(F.array(items))


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None, least: int = 0) -> Column:
    """(start, kind, end, text) of the leftmost non-overlapping matches, in code points.

    What lies between the matches has known lengths, so the starts are running sums: first over runs of matches,
    then within each run.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if value_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    none = F.expr(f"CAST(array() AS {SPAN})")
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value")))
        kept = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.cast("bigint").alias("at"), F.when(kept, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def run(acc: Column, items: Column) -> Column:
        found = F.aggregate(items, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(found, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(zero.alias("at"), F.expr(f"CAST(array() AS array<{SPAN}>)").alias("out"))
    return _let(F.arrays_zip(gaps.alias("gap"), whole.alias("match"), value.alias("value")), lambda items: F.aggregate(_in_runs(items), begin, run, lambda acc: F.flatten(acc["out"])))


def _only_if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any ``window`` consecutive ASCII characters; 0 for shorter strings.

    An entering character of which the window has n already adds (n + 1) log (n + 1) - n log n to the sum of
    n log n over all characters, a leaving one takes as much away; the counts are over a slice of the window's length,
    and a running sum of both gives every window's entropy. Long strings go in parts that overlap by a window.
    """
    # (n + 1) log (n + 1) - n log n, by n
    added = [math.log2(n + 1) * (n + 1) - (math.log2(n) * n if n else 0.0) for n in range(window + 1)]
    gain = F.array(*[F.lit(x) for x in added])
    full = math.log2(window)

    def over(codes: Column) -> Column:
        """Of one part: its codes, the first ``window - 1`` of which are the last of the part before."""
        among = lambda i, j, x: F.size(F.filter(F.slice(codes, i, j), lambda c: c == x))

        def change(x: Column, i: Column) -> Column:
            # both are counted among the characters that stay
            start, n = F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1))
            left = F.element_at(codes, F.greatest(i - window + 1, F.lit(1)))
            return F.element_at(gain, among(start, n, x) + 1) - F.when(i >= window, F.element_at(gain, among(start, n, left) + 1)).otherwise(0.0)

        def step(acc: Column, x: Column) -> Column:
            total = acc["sum"] + x
            return F.struct((acc["n"] + 1).alias("n"), total.alias("sum"), F.when(acc["n"] + 1 >= window, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(float(window * window)).alias("least"))
        return F.aggregate(F.transform(codes, change), start, step, lambda acc: F.when(acc["n"] >= window, F.greatest(F.lit(0.0), full - acc["least"] / window)).otherwise(0.0))

    codes = lambda s: F.transform(F.split(s, ""), lambda c: F.ascii(c))
    before = lambda parts, i: F.when(i > 0, F.element_at(parts, F.greatest(i, F.lit(1))).substr(F.lit(PART - window + 2), F.lit(window - 1))).otherwise("")
    in_parts = lambda parts: F.transform(parts, lambda p, i: codes(F.concat(before(parts, i), p)))
    return F.when(F.length(value) >= window, F.array_max(F.transform(_let(_parts(value), in_parts), over))).otherwise(0.0)


def _parts(text: Column) -> Column:
    """A text in parts of PART characters: what lies at a place is found without walking there."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PART), F.lit(0))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text in parts."""
    first = F.floor(start / PART).cast("int")
    some = F.slice(parts, first + 1, F.floor((end - 1) / PART).cast("int") - first + 1)
    return F.when(end > start, F.array_join(some, "").substr((start % PART + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _entropy_kind(value: Column) -> Column:
    """The kind of a candidate in which some stretch between allowed parts has a letter, a digit and a window of enough entropy."""
    kind = F.when(value.rlike("^[0-9a-fA-F-]+$"), F.lit(3)).when(value.rlike("^[A-Za-z0-9]+$"), F.lit(4)).otherwise(F.lit(5))
    least = lambda kind: F.element_at(F.array(*[F.lit(THRESHOLDS[k]) for k in KINDS[3:]]), kind - 2)
    maybe = lambda s: (F.length(s) >= WINDOW) & s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    stretches = F.filter(F.split(value, ALLOWED, -1), maybe)
    return _let(kind, lambda kind: F.when(F.exists(stretches, lambda s: highest_entropy(s) >= least(kind)), kind))


def _clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that meet none of ``others``. Others are passed over a run at a time, by the run's first start and last end."""
    bounds = lambda r: F.struct(F.element_at(r, 1)["start"].alias("start"), F.array_max(F.transform(r, lambda b: b["end"])).alias("end"), r.alias("items"))
    meets = lambda s, b: (b["start"] < s["end"]) & (b["end"] > s["start"])
    clear = lambda runs: F.filter(spans, lambda s: ~F.exists(runs, lambda r: meets(s, r) & F.exists(r["items"], lambda b: meets(s, b))))
    runs = _let(F.sort_array(F.transform(others, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))), lambda x: F.transform(_in_runs(x), bounds))
    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(_let(runs, clear))


def with_spans(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds ``name``: all spans (start, kind as a number, end) in order of start, then kind."""
    text = docs[text_col]
    base, extra = fresh(docs, f"{name}_base"), fresh(docs, f"{name}_more")
    out = docs.withColumn(
        base,
        F.concat(
            _only_if(text.rlike(KEYWORD), _spans(text, ASSIGN, 0, 2, ASSIGN_LEAST)),
            _only_if(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)),
            _only_if(text.rlike("[0-9a-f]{32}"), _spans(text, HEX, 2)),
        ),
    )
    text = out[text_col]
    out = out.withColumn(extra, _only_if(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3)))
    slim = lambda s, kind: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    judged = F.filter(F.transform(_clear_of(out[extra], out[base]), lambda s: slim(s, _entropy_kind(s["value"]))), lambda s: s["kind"].isNotNull())
    return out.withColumn(name, F.sort_array(F.concat(F.transform(out[base], lambda s: slim(s, s["kind"])), judged))).drop(base, extra)


def _rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, comma-joined).

    Entropy spans that overlap a base span are left out. Null and empty texts have no span, and the
    SHA-256 of nothing; repeated rows are scanned each; an empty table gives an empty result; other
    columns are not read. No Python, no shuffle.
    """
    out = with_spans(id_and_text(docs, id_col, text_col), "text", "found")
    base = F.filter(F.col("found"), lambda s: s["kind"] <= 2)
    count = lambda k: F.size(F.filter(F.col("found"), lambda s: s["kind"] == k)).cast("bigint")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_rendered(base).cast("binary"), 256).alias("base_sha256"), _rendered(F.col("found")).alias("spans"))


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans become one. Nulls stay null, other columns as they are,
    but for ``length_col``, which gets the new length of a text that changed, where the table has such a column. Empty
    texts stay empty, repeated rows are masked each, an empty table stays empty."""
    name = fresh(docs, "found")
    out = with_spans(docs, text_col, name)
    text = out[text_col]
    begin = lambda at, kind: F.struct(at.alias("at"), F.expr(f"CAST(array() AS array<{kind}>)").alias("out"))

    def masked(parts: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            piece = F.array(F.concat(_between(parts, acc["at"], s["start"]), F.lit(mask)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        def run(acc: Column, spans: Column) -> Column:
            return _let(F.aggregate(spans, begin(acc["at"], "string"), step), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

        rest = lambda acc: F.concat(F.array_join(acc["out"], ""), _between(parts, acc["at"], F.length(text).cast("bigint")))
        return F.aggregate(_in_runs(out[name]), begin(F.lit(0).cast("bigint"), "string"), run, rest)

    changed = out.withColumn(text_col, F.when(F.size(out[name]) > 0, _let(_parts(text), masked)).otherwise(text))
    if length_col is not None and length_col in docs.columns:
        changed = changed.withColumn(length_col, F.when(F.size(changed[name]) > 0, F.length(changed[text_col])).otherwise(changed[length_col]).cast(docs.schema[length_col].dataType))
    return changed.drop(name).select(*docs.columns)
