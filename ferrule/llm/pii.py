"""Personal data: patterns propose spans, validators and checksums confirm them, nearby words adjust a score.

Kinds, in the order of the output: ``email``, ``ip`` (parts at most 255), ``card`` (Luhn), ``phone`` and
``iban`` (mod 97). A kind's base proposals are the leftmost non-overlapping matches of its pattern over the whole text; one
that fails its validator is dropped and not tried again, one that passes is a base span and always
stays. The method adds what its score confirms (``KEEP`` or more):

- numbers of a failed card proposal that stand apart in it and are cards by themselves;
- card numbers of 13 to 15 digits that pass Luhn and stand near a word about cards;
- telephone numbers without a country code near a word about telephones;
- account numbers that pass mod 97.

A score is the pattern's own weight, more or less where one of the kind's words stands within ``NEAR`` characters,
as far as the next proposal of that kind.

All of it is one projection of DataFrame functions: no shuffle, no Python worker, nothing across
rows. A match's place is the summed length of the pieces and matches before it, in blocks, so that texts
with very many matches cost no square. Patterns start only where a run of their first class starts (or the
match before ended), and their runs don't give back, so that long runs cost no square either.

Cases: a null text is empty and has no spans; empty tables give none; rows that repeat are judged each; spans of
different kinds may overlap; places are code points, the end exclusive; an input column named like the
output gives way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, with_columns

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

#: The patterns of the base proposals (fixed values), written so that no run is scanned twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added proposals.
NATIONAL = r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"

IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: How much a proposal counts by itself, a word near it adds or takes, and a span needs to be added.
WEIGHT = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "short card": 0.35, "national": 0.3}
WORDS = {
    "email": (0.1, "email|mail|contact|write"), "ip": (0.2, "ip|host|server|address|client|ping"),
    "card": (0.2, "card|cards|visa|mastercard|amex|credit|debit|karte|tarjeta|carte"),
    "phone": (0.25, "phone|telephone|tel|call|mobile|cell|fax|telefon"),
    "iban": (0.05, "iban|account|bank|konto|cuenta|compte")}
AGAINST = {"ip": (-0.3, "version|release|section|build"), "card": (-0.2, "order|serial|isbn|tracking"),
           "phone": (-0.2, "order|serial|isbn|version")}
KEEP, NEAR, BLOCK = 0.5, 40, 128

SPAN = "struct<kind:string,start:int,end:int,score:double,base:boolean,value:string>"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _ends(pieces: Column, found: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the places where the matches end, each the sum of all lengths up to it: block sums first, then those inside."""
    lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

    def summed(each: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")),
                             lambda b: _total(F.slice(each, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda sums: let(
            F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))),
            lambda bases: body(F.transform(each, lambda _, i: F.get(bases, F.floor(i / BLOCK).cast("int")) + _total(
                F.slice(each, i - i % BLOCK + 1, i % BLOCK + 1))))))

    return let(lengths, summed)


def _propose(text: Column, pattern: str, where: Column, judge: Callable[..., Column]) -> Column:
    """Spans that ``judge(match, start, before, after)``, an array each, makes of all matches of ``pattern``."""
    none = F.lit([]).cast(f"array<{SPAN}>")

    def placed(pieces: Column, found: Column) -> Column:
        return _ends(pieces, found, lambda ends: let(ends, lambda at: F.flatten(F.transform(found, lambda m, i: judge(
            m, F.get(at, i) - F.length(m), F.get(pieces, i), F.get(pieces, i + 1))))))

    spans = let(F.split(text, pattern, -1), lambda pieces: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, placed(pieces, found)).otherwise(none)))
    return F.when(where, spans).otherwise(none)


def _score(kind: str, weight: float, before: Column, after: Column) -> Column:
    """``weight``, adjusted by the kind's words near the proposal, between 0 and 1."""
    near = lower_ascii(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))

    def adjusted(words: Column) -> Column:
        score = F.lit(weight)
        for by, some in (WORDS[kind], AGAINST.get(kind, (0.0, ""))):
            if some:
                score = score + F.when(words.rlike(f"(^|[^a-z])({some})([^a-z]|$)"), F.lit(by)).otherwise(F.lit(0.0))
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)

    return let(near, adjusted)


def _span(kind: str, value: Column, start: Column, score: Column, base: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"),
                    score.cast("double").alias("score"), F.lit(base).alias("base"), value.alias("value")).cast(SPAN)


def _base(kind: str, valid: Callable[[Column], Column]) -> Callable[..., Column]:
    def judge(m, start, before, after):
        span = _span(kind, m, start, _score(kind, WEIGHT[kind], before, after), True)
        return F.when(valid(m), F.array(span)).otherwise(F.lit([]).cast(f"array<{SPAN}>"))

    return judge


def _added(kind: str, weight: float, valid: Callable[..., Column]) -> Callable[..., Column]:
    def judge(m, start, before, after):
        span = _span(kind, m, start, _score(kind, weight, before, after), False)
        return F.when(valid(m, before, after), F.filter(F.array(span), lambda s: s["score"] >= KEEP)).otherwise(
            F.lit([]).cast(f"array<{SPAN}>"))

    return judge


def _digits(m: Column) -> Column:
    return F.translate(m, " +().-", "")


def _is_card(digits: Column, least: int, most: int) -> Column:
    return F.when(F.length(digits).between(least, most), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def _card(m: Column, start: Column, before: Column, after: Column) -> Column:
    """A base card, or a short one near a word about cards, or the numbers of a failed proposal that are cards by themselves."""
    none = F.lit([]).cast(f"array<{SPAN}>")
    inner = _propose(m, r"[0-9]+", F.length(m) > 19, lambda n, at, b, a: F.when(
        _is_card(n, 16, 19), F.array(_span("card", n, at, _score("card", WEIGHT["card"], before, after), False))).otherwise(none))
    moved = F.transform(inner, lambda s: _span("card", s["value"], s["start"] + start, s["score"], False))
    short = F.array(_span("card", m, start, _score("card", WEIGHT["short card"], before, after), False))
    return let(_digits(m), lambda digits: F.when(
        _is_card(digits, 16, 19), F.array(_span("card", m, start, _score("card", WEIGHT["card"], before, after), True))).when(
        _is_card(digits, 13, 15), F.filter(short, lambda s: s["score"] >= KEEP)).otherwise(
        F.filter(moved, lambda s: s["score"] >= KEEP)))


def _mod_97(m: Column) -> Column:
    """Whether the number, its first four characters last and letters as 10 to 35, leaves 1 on division by 97."""
    plain = F.translate(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _apart(m: Column, before: Column, after: Column) -> Column:
    """Neither letter nor digit nor a further part of a number on either side."""
    return ~F.right(before, F.lit(1)).rlike(r"[A-Za-z0-9]") & ~F.left(after, F.lit(1)).rlike(r"[A-Za-z0-9]")


def _alone(m: Column, before: Column, after: Column) -> Column:
    """Not a part of a longer number: no digit, sign or country code before it, no further digits after it."""
    return (~F.right(before, F.lit(24)).rlike(r"[0-9+().-]$|[0-9+][0-9\x20().-]*$") & ~F.left(after, F.lit(2)).rlike(r"^[0-9]|^[\x20.-][0-9]"))


def pii_spans(text: Column) -> Column:
    """All spans of a text: an array of (kind, start, end, score, base, value), by kind, then start."""

    def found(t: Column) -> Column:
        phones = F.concat(
            _propose(t, PHONE, t.contains("+"), _base("phone", lambda m: F.length(_digits(m)).between(8, 15))),
            _propose(t, NATIONAL, t.rlike("[0-9]{3}[\\x20.-][0-9]{4}"), _added("phone", WEIGHT["national"], _alone)))
        return F.flatten(F.array(
            _propose(t, EMAIL, t.contains("@"), _base("email", lambda m: F.lit(True))),
            _propose(t, IP, t.rlike("[0-9]\\.[0-9]"), _base("ip", lambda m: m.rlike(IP_PARTS))),
            _propose(t, CARD, t.rlike("[0-9][\\x20-]?[0-9]"), _card),
            F.array_sort(phones),
            _propose(t, IBAN, t.rlike("[A-Z]{2}[0-9]{2}"), _added(
                "iban", WEIGHT["iban"], lambda m, b, a: F.when(_apart(m, b, a), _mod_97(m)).otherwise(F.lit(False))))))

    return let(F.coalesce(text, F.lit("")), found)


def find_pii(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with the column ``out``: the spans of personal data in the whole ``text``."""
    return with_columns(df, {out: pii_spans(F.col(f"`{text}`"))})


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_pii(found: DataFrame, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """doc_id, the count of base spans of each base kind, the base spans' digest, and all spans as one string."""
    all_spans = F.col(f"`{spans}`")
    base = F.filter(all_spans, lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(F.col(f"`{doc_id}`").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(all_spans).alias("spans"))
