"""Language of a text by its stop words."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, unescaped

#: In the order that breaks ties. Short lists of our own; an argument of `detect_language`.
STOP_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "and", "of", "to", "in", "is", "for", "with", "on", "that"),
    "de": ("der", "die", "und", "das", "ist", "mit", "für", "von", "zu", "den"),
    "fr": ("le", "la", "les", "des", "et", "une", "est", "pour", "dans", "que"),
    "nl": ("het", "een", "van", "voor", "niet", "zijn", "wordt", "naar", "ook", "wij"),
    "es": ("el", "los", "las", "una", "por", "para", "con", "del", "que", "es"),
    "it": ("il", "gli", "della", "che", "sono", "per", "nel", "alla", "anche", "di"),
    "pt": ("os", "uma", "não", "com", "para", "dos", "em", "são", "mais", "ao"),
}


#: Local forms of target titles, by title in lower case. A few of our own; an argument wherever they are used.
TITLE_ALIASES: dict[str, list[str]] = {
    "head of procurement": ["Chefe de Compras", "Gerente Geral de Suprimentos"],
    "director supply chain": ["Diretor da Cadeia Logística"],
    "head of operations": ["Chefe de Operações"],
}


def detect_language(text: Column, stop_words: dict[str, tuple[str, ...]] = STOP_WORDS) -> Column:
    """F10. Hits of each language among the words of the first 12,000 characters. Unknown below 20 words, below 6 hits, or
    if the best is under 1.5 times the second and less than 4 ahead of it; ties go by the order of the languages."""
    plain = F.regexp_replace(F.substring(casefold(F.regexp_replace(unescaped(F.coalesce(text, F.lit(""))), "<[^>]*>", " ")), 1, 12_000), r"[^\p{L}]+", " ")
    tokens = F.split(F.trim(plain), " ")

    every = sorted({w for own in stop_words.values() for w in own})

    def judge(found: Column) -> Column:
        """found: the number of words, and those of them that some language counts, so that the others are looked at once."""

        def count(own: tuple[str, ...]) -> Column:
            return F.size(F.filter(found["stops"], lambda w: w.isin(*own)))

        hits = [count(own) for own in stop_words.values()]
        ranked = F.reverse(F.array_sort(F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (h, k) in enumerate(zip(hits, stop_words))])))

        def decide(r: Column) -> Column:
            best, second = r[0]["n"], r[1]["n"]
            unsure = (found["n"] < 20) | (best < 6) | ((best < 1.5 * second) & (best - second < 4))
            return F.when(unsure, "unknown").otherwise(r[0]["k"])

        return F.transform(F.array(ranked), decide)[0]

    counted = F.transform(F.array(tokens), lambda words: F.struct(F.size(words).alias("n"), F.filter(words, lambda w: w.isin(*every)).alias("stops")))
    return F.transform(counted, judge)[0]


def expand_queries(queries: Column, aliases: dict[str, list[str]]) -> Column:
    """F09. Each query followed by its local aliases (keys in lower case), first wins, any case."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if aliases else F.create_map().cast("map<string,array<string>>")
    each = F.flatten(F.transform(queries, lambda q: F.concat(F.array(q), F.coalesce(F.try_element_at(table, F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))), F.array().cast("array<string>")))))
    lowered = F.transform(each, F.lower)
    return F.filter(each, lambda q, i: F.array_position(lowered, F.lower(q)) == i + 1)


class _Number(str):
    """A number or constant of a JSON text, as written."""


class _Object(list):
    """The pairs of a JSON object, in order, repeated keys included."""


def redacted(text: str, keys: tuple[str, ...], mark: str = "***", depth: int = 6) -> str:
    """F29 on one text; see `redact_json`."""
    named = {k.lower() for k in keys}

    def quoted(x: str) -> str:
        out = json.dumps(x, ensure_ascii=False)
        return out if out.isascii() or not re.search("[\ud800-\udfff]", out) else json.dumps(x)

    def put(x, at: int) -> str:
        if at > depth:
            return quoted("[depth-limit]")
        if isinstance(x, _Object):
            return "{" + ",".join(quoted(k) + ":" + (quoted(mark) if k.lower() in named else put(v, at + 1)) for k, v in x) + "}"
        if isinstance(x, list):
            return "[" + ",".join(put(v, at + 1) for v in x) + "]"
        if isinstance(x, _Number):
            return str(x)
        return quoted(x) if isinstance(x, str) else json.dumps(x)

    try:
        return put(json.loads(text, object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_Number), 0)
    except (ValueError, RecursionError):
        value = r'(?:"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|true|false|null|["\[{].*)'
        return re.sub(rf'("(?:{"|".join(map(re.escape, keys))})"\s*:\s*){value}', lambda m: m[1] + quoted(mark), text, flags=re.I | re.S)


def redact_json(payload: Column, keys: tuple[str, ...], mark: str = "***", depth: int = 6) -> Column:
    """F29. The whole value of each named key (any case) of a JSON text replaced, be it a scalar, an array or an object.

    What lies deeper than `depth` becomes "[depth-limit]", as in the reference; all other values stay as written, without
    blanks between them. In a text that is no JSON, scalars after a named key are replaced, and from an array, an object
    or an open string on all the rest."""

    @F.pandas_udf("string")
    def scrub(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, keys, mark, depth) for t in texts], dtype=object)

    return scrub(payload)
