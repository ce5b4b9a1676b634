"""Personal data: patterns propose, checksums confirm, context words score (DataFrame functions only).

Each kind has a pattern, a check of the match and a prior score. A passing
checksum (Luhn, mod-97) and a context word within ``NEAR`` characters before
or after the match raise the score; a span is kept from ``KEEP`` on. The
contract's kinds have priors that keep them whenever their check passes; the
further kinds (``iban``, ``ssn``) need their checksum or a context word.

Patterns use possessive repeats, which match the same spans as greedy ones
here (a repeat is never followed by what it could give back) and neither
recurse nor backtrack on long runs. Look-behinds only skip places at which the
same run was already tried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scarpline.llm import common

NEAR, KEEP = 40, 0.5
CONTEXT, CHECKSUM = 0.3, 0.4


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    words: str  # alternatives of context words, lower case
    hint: str | None = None  # a text without it has no match


_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Fixed values of the contract: kinds and their order.
BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", 0.6, "ip|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+", 0.2, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|fax", "+"),
    Kind("iban", _BEFORE + "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + _AFTER, 0.2, "iban|bank|account|konto"),
    Kind("ssn", _BEFORE + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER, 0.3, "ssn|social|security"),
)
NAMES = [k.name for k in KINDS]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weight(c: Column, i: Column) -> Column:
        v = c.cast("int") * (i % 2 + 1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(reverse, weight), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves remainder one."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(chars, F.lit(0), add) == 1


def _check(kind: str, m: Column) -> tuple[Column, Column]:
    """(the match may stay, a checksum confirmed it)."""
    yes, no = F.lit(True), F.lit(False)
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        value = lambda p: F.substring(F.regexp_replace(p, "^0+", ""), 1, 3)
        part = lambda p: small(p) & (F.coalesce(F.nullif(value(p), F.lit("")).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part), no
    if kind == "card":
        good = F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
        return good, good
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15), no
    if kind == "iban":
        return yes, mod97(m)
    return yes, no


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Kept spans of one kind, in code points, end exclusive."""
    pattern = F.lit(kind.pattern)
    pieces, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["m"])
        here = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("pos"), F.concat(acc["out"], here).alias("out"))

    found = F.aggregate(gaps, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
        around = common.ascii_lower(F.concat(before, F.lit(" "), F.substring(text, s["end"] + 1, F.lit(NEAR))))
        near = around.rlike(rf"(?<![a-z])(?:{kind.words})")
        _, confirmed = _check(kind.name, s["m"])
        score = F.lit(kind.prior) + F.when(confirmed, CHECKSUM).otherwise(0.0) + F.when(near, CONTEXT).otherwise(0.0)
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"),
            F.least(score, F.lit(1.0)).alias("score"),
        )

    valid = F.filter(found, lambda s: _check(kind.name, s["m"])[0])
    kept = F.filter(F.transform(valid, scored), lambda s: s["score"] >= KEEP)
    maybe = text.contains(kind.hint) if kind.hint else text.rlike(kind.pattern)
    return F.when(maybe, kept).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>"))


def find(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add an array of (start, rank, end, kind, score), by start, then kind.

    NULL text is empty and has no spans; repeated rows repeat; no rows give no
    rows. All columns of the input stay; ``out`` replaces one of that name.
    """
    whole = common.whole(text)
    return docs.withColumn(out, F.array_sort(F.concat(*[_spans(whole, k, i) for i, k in enumerate(KINDS)])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the spans of every document."""
    rows = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "_spans")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["rank"] < len(BASE))
    return rows.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; ``n_chars`` follows where present.

    A span that begins inside an earlier one is covered by it. A NULL text
    stays NULL.
    """
    rows = find(docs, text, "_spans")
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["pos"] + 1, s["start"] - acc["pos"])
        new = F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        covered = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], new).otherwise(covered)

    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col(text), acc["pos"] + 1, F.length(text)))), "")
    masked = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, rest)).otherwise(F.col(text))
    rows = rows.withColumn(text, masked).drop("_spans")
    return rows.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in rows.columns else rows
