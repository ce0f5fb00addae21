"""Secrets: patterns find strong parts; weak parts are reported only where complementary parts co-occur.

Strong (base) spans: assign (a secret's name with a value), access (access identifiers), hex (long hex strings).
Weak candidates: ident (user and client names), blob (40-character keys of mixed letters and digits) and
endpoint (service addresses). Parts of a document are linked by an interval join: each part looks at the parts
whose start lies within SCOPE code points of its own, as a range window over (document, start). Reported are
a blob with an identifier in scope, an ident with a secret in scope, and an endpoint with both.

The parts are found inside each row. Only spans are shuffled, by (doc_id, hash of the text); equal rows are
counted there and given back at the end. A window holds the spans of one text, and its frame those of one scope.

Nulls and edges: a null or empty text has no spans; a very long text is one pass a kind, and its spans are one window; of
spans at one place the kind listed first comes first; null ids are kept; repeated rows each return; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of
from .spans import Kind, count_of, digest, spans_of

SCOPE = 256
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""

#: In the order of the digest: three base kinds, then the weak ones.
KINDS = (
    Kind("assign", _ASSIGN, lambda t: t.rlike(r"(?i)(?:passw|secret|token|api_?key)"), lambda m: F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 8),
    Kind("access", r"AKIA[A-Z0-9]++", lambda t: F.contains(t, F.lit("AKIA")), lambda m: F.length(m) >= 16),
    Kind("hex", r"[0-9a-f](?<![0-9a-f]{2})[0-9a-f]{31,}+", lambda t: t.rlike(r"[0-9a-f](?<![0-9a-f]{2})[0-9a-f]{31}")),
    Kind("ident", r"""(?<![A-Za-z0-9])(?i:client_?id|access_?key_?id|account|user_?name|user|login)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._@-]{3,}+""", lambda t: t.rlike(r"(?i)(?:client_?id|access_?key|account|user|login)[\"']?\x20*+[:=]")),
    Kind("blob", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", lambda t: t.rlike(r"[A-Za-z0-9+/](?<![A-Za-z0-9+/]{2})[A-Za-z0-9+/]{39}(?![A-Za-z0-9+/])")),
    Kind("endpoint", r"(?<![A-Za-z])(?:https?|wss?|ftps?|redis|amqps?|mysql|postgres(?:ql)?|mongodb)://[A-Za-z0-9.-]++(?::[0-9]++)?", lambda t: F.contains(t, F.lit("://"))),
)
NAMES = [k.name for k in KINDS]
BASE = 3
_IDENTIFIERS, _SECRETS = (1, 3), (0, 2, 4)


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans: array<struct<start,kind,end>> by start, then kind; one row per input row."""
    content = text_of()
    rows = docs.select("doc_id", F.xxhash64(content).alias("h"), F.concat(*[spans_of(content, k, i) for i, k in enumerate(KINDS)]).alias("parts"))
    texts = rows.groupBy("doc_id", "h").agg(F.count("*").alias("copies"), F.first("parts").alias("parts"))
    parts = texts.select("doc_id", "h", "copies", F.explode_outer("parts").alias("p"))
    start = F.coalesce(F.col("p.start"), F.lit(0))
    near = Window.partitionBy("doc_id", "h").orderBy(start).rangeBetween(-scope, scope)
    some = lambda kinds: F.coalesce(F.max(F.col("p.kind").isin(*kinds)).over(near), F.lit(False))
    joined = parts.select("*", some(_IDENTIFIERS).alias("identifier"), some(_SECRETS).alias("secret"))
    kind = F.col("p.kind")
    linked = (kind < BASE) | ((kind == 3) & F.col("secret")) | ((kind == 4) & F.col("identifier")) | ((kind == 5) & F.col("identifier") & F.col("secret"))
    span = F.when(linked, F.struct(F.col("p.start").alias("start"), kind.alias("kind"), F.col("p.end").alias("end")))
    found = joined.groupBy("doc_id", "h").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(span)).alias("spans"))
    return found.select("doc_id", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base kinds, and all spans."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return find_secrets(docs).select(
        "doc_id",
        *[count_of(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(NAMES[:BASE])],
        F.sha2(digest(base, NAMES), 256).alias("base_sha256"),
        digest(F.col("spans"), NAMES).alias("spans"),
    )
