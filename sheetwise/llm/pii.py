"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, let, located, part, sliced, table

#: Fixed lengths of IBANs, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

#: Fixed patterns. They match what the plain forms in the comments match, leftmost and without overlap, but possessively and
#: only from where a match can begin, so that a long text takes time in proportion to its length and no deep stack.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9] of 10 digits at least; a match begins at a + and holds no other
    "phone": r"\+(?=[0-9](?:[\x20().-]*+[0-9]){9})[0-9][\x20().0-9-]+[0-9]",
    # Country, two check digits, and as many letters or digits as the country has, blanks between them allowed
    "iban": rf"(?<![A-Za-z0-9])(?:{_BY_COUNTRY})(?![A-Za-z0-9])",
    # Three, two and four digits with hyphens
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-"}
#: Score of a confirmed span without context, what a word for it or against it within REACH code points adds or takes, and what an
#: added span needs: an IBAN stays without context, but not beside a word against it; a number like a social security number
#: needs a word for it and none against it.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
FOR = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|servidor",
    "card": "card|visa|mastercard|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = "example|sample|version|serial|isbn|invoice|beispiel|exemple|ejemplo"
REACH, STEP, BACK, ACCEPT = 40, 0.2, 0.4, 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(
        F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)
    ))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN of capitals and digits, with or without blanks, passes the mod-97 check."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    step = lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97
    return (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column, slices: Column) -> Column:
    """Confirmed spans of one kind, in order, with their scores; positions in code points, end exclusive."""
    rank = list(PATTERNS).index(kind)

    def scored(s: Column) -> Column:
        around = F.lower(F.concat(
            part(slices, F.greatest(s["start"] - REACH, F.lit(0)), s["start"]), F.lit(" "), part(slices, s["end"], s["end"] + REACH)
        ))

        def rated(a: Column) -> Column:
            word = lambda ws: a.rlike(rf"(?<!\p{{L}})(?:{ws})(?!\p{{L}})")
            return F.lit(PRIOR[kind]) + F.when(word(FOR[kind]), STEP).otherwise(0.0) - F.when(word(AGAINST), BACK).otherwise(0.0)

        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.round(let(around, rated), 2).alias("score"))

    found = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["text"]))
    spans = F.transform(found, scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= ACCEPT)
    hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True)
    # Almost all of these hold digits, and most texts hold none.
    return F.coalesce(F.when(hint & (text.rlike("[0-9]") if kind != "email" else F.lit(True)), spans), F.lit([]).cast("array<struct<start:int,rank:int,end:int,score:double>>"))


def pii_spans(text: Column) -> Column:
    """The spans of a text: array of (start, rank, end, score), by start and rank of the kind."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return let(sliced(whole), lambda s: F.sort_array(F.concat(*[_spans(k, whole, s) for k in PATTERNS])))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with a text column -> with spans: array of (start, rank, end, score), by start and rank of the kind.

    Base spans stay whatever their context; context decides for IBANs and social security numbers. Null text: no spans. Empty
    texts, repeated rows and empty tables need no special case; a column named spans is replaced. Spans of different kinds
    may overlap; those with one start come in the order of kinds. Long texts are searched whole: matches are placed by the gaps between them and their
    context is read from slices of the text, so that time follows the length of a text, however many matches it has.
    """
    return docs.withColumn("spans", pii_spans(F.col("text")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span as <KIND>; of spans that overlap, the later only adds what the earlier leaves of it."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in PATTERNS])

    def of_slices(slices: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            new = F.concat(part(slices, at, s["start"]), F.get(names, s["rank"]))
            return F.struct(F.greatest(at, s["end"]).alias("state"), F.when(s["start"] >= at, new).otherwise("").alias("out"))

        end = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(carried(spans, F.lit(0), step, "string"), ""), part(slices, end, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(sliced(text), of_slices))


def op4_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == list(PATTERNS).index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
