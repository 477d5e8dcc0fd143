"""Personal data by pattern, checksum and context, in DataFrame functions only.

Regular expressions propose spans; Luhn (cards), mod-97 (IBANs) and range checks
confirm them; words nearby raise or lower a score.  The four base kinds (email,
ip, card, phone) are kept whenever their own test passes, whatever the score;
the added kinds (iban, ssn) need a score of THRESHOLD.

Patterns are written so that Java's matcher runs in linear time without deep
recursion: runs are possessive, and a match can start only where a run starts
(or where the last match ended), which leaves the leftmost matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text, free_prefix

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Code points before and after a span whose words count as its context.
BEFORE, AFTER = 40, 20

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
# A part of an address that is at most 255, leading zeros allowed.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}
FIRST_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
RAISES = {
    "email": "mail|contact|write to", "ip": r"\bip\b|host|address|server", "card": "card|visa|master|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": r"ssn|social security|tax id",
}
LOWERS = "example|sample|dummy|version|build|invoice|isbn|serial"
RAISE, LOWER = 0.3, 0.25


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes; doubled digits above 9 lose 9."""
    last = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substring(digits, last - k, F.lit(1))) - 48
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(k % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """True if the check digits of a compact IBAN hold: read behind the rest, letters as 10 to 35, the remainder is 1."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substring(turned, k, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(hit, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        fits = F.coalesce(F.try_element_at(lengths, F.substring(compact, 1, 2)) == F.length(compact), F.lit(False))
        return F.when(fits, mod97(compact)).otherwise(False)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-|-0000$")
    return F.lit(True)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    left = F.substring(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE)))
    right = F.substring(text, end + 1, F.lit(AFTER))
    near = F.lower(F.concat(left, F.lit(" "), right))
    raised = F.when(near.rlike(RAISES[kind]), RAISE).otherwise(0.0)
    lowered = F.when(near.rlike(LOWERS), LOWER).otherwise(0.0)
    return F.round(F.lit(FIRST_SCORE[kind]) + raised - lowered, 2)


_SPANS = "array<struct<start:int,end:int>>"


def _with_spans(rows: DataFrame, text: str, own: str) -> DataFrame:
    """All columns, the text as it is read, and one array of (start, end, score) for each kind; new names begin with `own`."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    none = F.array().cast("array<string>")

    def proposed(kind: str) -> Column:
        hits = F.regexp_extract_all(f"{own}text", F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(f"{own}text", F.lit(NEEDS[kind])), hits).otherwise(none) if kind in NEEDS else hits

    def placed(kind: str) -> Column:
        """Walk over the stretches between matches to place each match, keeping confirmed ones."""
        hits = F.col(f"{own}hit_{kind}")
        between = F.split(f"{own}text", PATTERNS[kind], -1)
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

        def walk(acc: Column, step: Column) -> Column:
            begin = acc["at"] + F.length(step["gap"])
            end = begin + F.length(step["hit"])
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(_confirmed(kind, step["hit"]), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.when(F.size(hits) > 0, F.aggregate(steps, start, walk, lambda acc: acc["spans"])).otherwise(F.array().cast(_SPANS))

    def scored(kind: str) -> Column:
        spans = F.transform(
            f"{own}at_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _score(kind, F.col(f"{own}text"), s["start"], s["end"]).alias("score"))
        )
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    rows = rows.select(*kept, body.alias(f"{own}text"))
    rows = rows.select(*kept, f"{own}text", *[proposed(k).alias(f"{own}hit_{k}") for k in KINDS])
    rows = rows.select(*kept, f"{own}text", *[placed(k).alias(f"{own}at_{k}") for k in KINDS])
    return rows.select(*kept, f"{own}text", *[scored(k).alias(f"{own}{k}") for k in KINDS])


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, and for each kind an array of (start, end, score): code points, end exclusive.

    A null text is read as empty and has no spans.  Null doc_ids and repeated rows keep
    their rows, other columns are ignored, and an empty table gives no rows; spans of
    different kinds may overlap.
    """
    return _with_spans(doc_text(docs), "text", "_").select("doc_id", *[F.col(f"_{k}").alias(k) for k in KINDS])


def personal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn of every document."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*[named(k) for k in kinds]), ",")

    counts = {k: F.size(k).cast("long").alias(f"n_{k}") for k in KINDS}
    return personal_spans(docs).select(
        "doc_id", *[counts[k] for k in BASE], F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"), counts["iban"], counts["ssn"]
    )


def mask_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns; each span of `text` becomes its kind in brackets, overlapping spans become the first one's.

    Rows without spans, null texts among them, come through as they are, whatever other
    columns are called; an empty table stays empty.
    """
    own = free_prefix(docs, "pii")
    found = _with_spans(docs, text, own)
    kept = [F.col(f"`{c}`") for c in docs.columns]

    def of(kind: str) -> Column:
        return F.transform(f"{own}{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*[of(k) for k in KINDS])
    found = found.select(*kept, f"{own}text", F.array_sort(every).alias(f"{own}all"))
    shape = "array<struct<start:int,end:int,kind:string>>"

    def merge(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        touching = F.coalesce(s["start"] < last["end"], F.lit(False))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    found = found.select(*kept, f"{own}text", F.aggregate(f"{own}all", F.array().cast(shape), merge).alias(f"{own}spans"))

    def piece(s: Column, k: Column) -> Column:
        since = F.when(k == 0, 0).otherwise(F.try_element_at(F.col(f"{own}spans"), k)["end"])
        return F.concat(F.substring(F.col(f"{own}text"), since + 1, s["start"] - since), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    end = F.try_element_at(F.col(f"{own}spans"), F.lit(-1))["end"]
    tail = F.substring(F.col(f"{own}text"), end + 1, F.length(f"{own}text"))
    masked = F.concat(F.array_join(F.transform(f"{own}spans", piece), ""), tail)
    new = F.when(F.size(f"{own}spans") > 0, masked).otherwise(F.col(f"`{text}`"))
    return found.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
