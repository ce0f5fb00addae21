"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds: email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits), and iban (mod-97).
Everything happens inside a row by built-in functions: no join, no shuffle, no Python.

A span's score starts from what its validator proves (a checksum more than a shape) and rises or falls with words
in the 40 code points before and the 24 after it, ending in 0 to 1. Every valid span is reported with its score;
`redact` replaces those from a threshold upwards, joining spans that overlap. The words are an argument (CONTEXT: English,
German, French and Spanish). The threshold lies between contexts: a mere shape (ip, phone) beside a word against it, such
as "version 1.2.3.4", falls below and stays; what a checksum or a full address proves is replaced beside any word.

Nulls and edges: a null or empty text has no spans; very long texts are one pass a kind; repeated rows each get their own
result; an empty table gives no rows; columns of the input other than the ones used are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of
from .spans import Kind, by_kind, count_of, digest, spans_of

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def check(r: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(r, i, F.lit(1)).cast("int")
            doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return total + F.when(i % 2 == 0, doubled).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), add) % 10 == 0

    return let(F.reverse(number), check)


def mod97(iban: Column) -> Column:
    """True if an IBAN (letters in upper case, no spaces) has remainder 1."""

    def check(s: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            code = F.ascii(F.substring(s, i, F.lit(1)))
            return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add) == 1

    return let(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), check)


#: Words that make a kind likelier, and words that make any kind less likely, as alternatives of a pattern.
CONTEXT: dict[str, str] = {
    "email": r"e-?mail|mail|contact|write|kontakt|schreib\w*|courriel|écri\w*|correo|escrib\w*",
    "ip": r"ip|host|server|address|login|adresse|anmeldung|serveur|hôte|servidor|dirección",
    "card": r"card|visa|master\w*|amex|credit|pay\w*|karte\w*|kredit\w*|zahl\w*|carte|paiement|tarjeta|pago",
    "phone": r"phone|tel\w*|call|mobile|fax|dial|anruf\w*|handy|mobil|appel\w*|portable|llam\w*|móvil",
    "iban": r"iban|account|bank\w*|konto|compte|banque|cuenta|banco",
    "against": r"version|release|build|section|chapter|isbn|invoice|order|kapitel|abschnitt|rechnung\w*|bestell\w*|chapitre|facture|commande|capítulo|versión|factura|pedido",
}
#: How much a word near a span moves its score, and the score from which `redact` replaces.
NEAR, THRESHOLD = 0.3, 0.4


def _score(kind: str, base: float, context: dict[str, str]):
    def rate(match: Column, before: Column, after: Column) -> Column:
        near = F.concat(before, F.lit(" "), after)
        some = lambda words: near.rlike(rf"(?iU)\b(?:{words})\b")
        up, down = F.when(some(context[kind]), NEAR).otherwise(0.0), F.when(some(context["against"]), NEAR).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(base) + up - down))

    return rate


def _card(match: Column) -> Column:
    return let(digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def _iban(match: Column) -> Column:
    return let(F.regexp_replace(match, " ", ""), lambda s: F.when(F.length(s).between(15, 34), mod97(s)).otherwise(False))


def kinds(context: dict[str, str] = CONTEXT) -> tuple[Kind, ...]:
    """In the order of the digest. The first four are the base; iban is added by its checksum."""
    return (
        Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), score=_score("email", 0.7, context)),
        Kind("ip", r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), _score("ip", 0.5, context)),
        Kind("card", r"[0-9](?:[ -]?[0-9]){15,}+", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _card, _score("card", 0.7, context)),
        Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(digits(m)).between(8, 15), _score("phone", 0.5, context)),
        Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), _iban, _score("iban", 0.8, context)),
    )


KINDS = kinds()
NAMES = [k.name for k in KINDS]
BASE = 4


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", found: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The input with column `into`, array<struct<kind,start,end,score>> by kind, then place (code points, end exclusive)."""
    content = text_of(text)
    return docs.withColumn(into, by_kind(F.concat(*[spans_of(content, k, i) for i, k in enumerate(found)])))


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base kinds, all spans, and the sum of their scores."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"] < BASE)
    return found.select(
        "doc_id",
        *[count_of(F.col("pii"), i).alias(f"n_{k}") for i, k in enumerate(NAMES[:BASE])],
        F.sha2(digest(base, NAMES), 256).alias("base_sha256"),
        digest(F.col("pii"), NAMES).alias("spans"),
        F.transform("pii", lambda s: F.round(s["score"], 3)).alias("scores"),
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", found: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The documents with every span of at least `threshold` replaced by the tag of its kind, such as <email>.

    Spans that overlap become one, tagged by the first. A null text stays null; all other columns stay, one named `pii` too.
    """
    spans = "pii"
    while spans in docs.columns:
        spans += "_"
    tags = F.array(*[F.lit(f"<{k.name}>") for k in found])
    kept = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= threshold - 1e-9), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        out = F.when(fresh, F.concat(a["out"], F.array(gap, F.get(tags, s["kind"])))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(kept, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return find_pii(docs, text, spans, found).withColumn(text, F.when(F.size(kept) > 0, done).otherwise(F.col(text))).drop(spans)
