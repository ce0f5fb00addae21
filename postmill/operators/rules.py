"""Rules over postings: what a scan rejects, and how a posting stands to a profile."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.language import TITLE_ALIASES, detect_language, expand_queries

ALLOWED = ("de", "at", "ch", "nl", "fr", "es", "it", "pl", "gb", "uk", "ie", "se", "dk", "pt", "be", "lu", "cz")


@dataclass(frozen=True)
class Lexicon:
    """Word lists of the rules; all are arguments. These defaults are short and our own."""

    negative: tuple[str, ...] = ("junior", "trainee", "student", "assistant", "analyst", "clerk")
    exclusions: tuple[str, ...] = ("unpaid position", "no salary")
    language_level: tuple[str, ...] = ("german c1", "deutsch c1", "muttersprache deutsch")
    foreign: tuple[str, ...] = ("french required", "spanish required", "polish required")
    markers: tuple[str, ...] = ("germany", "berlin", "munich", "austria", "vienna", "europe", "remote eu")
    region_markers: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"br": ("brazil", "curitiba"), "sg": ("singapore",)})
    states: tuple[str, ...] = (", tx", ", ca", ", ny", ", de")
    state_names: tuple[str, ...] = ("texas", "california", "florida")
    keywords: tuple[str, ...] = ("united states", "usa", "bay area")
    cities: tuple[str, ...] = ("singapore", "curitiba", "dubai", "toronto")
    domain: tuple[str, ...] = ("supply chain", "procurement", "logistics", "logistik", "operations", "compras", "einkauf")
    commercial: tuple[str, ...] = ("retail operations", "sales operations", "sales director", "director of retail", "commercial director")
    core: tuple[str, ...] = ("supply chain", "procurement", "logistics", "logistik", "einkauf", "compras")
    german_roles: tuple[str, ...] = ("abteilungsleiter", "bereichsleiter", "direktor", "einkaufsleiter", "leiter", "leiterin", "referent", "werksleiter")
    english_roles: tuple[str, ...] = ("buyer", "chief", "director", "executive", "head", "manager", "officer", "owner", "specialist")
    coo_roles: tuple[str, ...] = ("coo", "chief operating officer", "chief operations officer")
    coo_modifiers: tuple[str, ...] = ("country", "deputy", "global", "group", "interim")
    directors: tuple[str, ...] = ("head", "director", "vp", "chief", "diretor")
    managers: tuple[str, ...] = ("manager", "gerente")
    senior_managers: tuple[str, ...] = ("senior manager", "lead", "gerente senior")
    title_rejects: tuple[str, ...] = ("data officer", "legal", "consultant")


LEXICON = Lexicon()


def is_intern_title(title: Column) -> Column:
    """P06. Whole word, so 'International' is none."""
    return X.has_word(X.padded(title), ("intern", "interns", "internship", "internships"))


def is_negative(lex: Lexicon = LEXICON) -> Column:
    """P01."""
    title, desc = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
    both = F.concat(title, F.lit(" "), desc)
    return is_intern_title(F.col("title")) | X.has_part(title, lex.negative) | X.has_part(both, lex.exclusions + lex.language_level) | X.has_part(desc, lex.foreign)


def is_too_old(as_of: str, days: int = 60) -> Column:
    """P02. Strictly before the cutoff; no date passes."""
    return F.coalesce(F.col("posted_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), F.lit(False))


def is_wrong_region(extra: tuple[str, ...] = (), lex: Lexicon = LEXICON) -> Column:
    """P03. Ordered decisions; `extra` are opted-in countries, whose markers allow and whose cities no longer block."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    more = tuple(m for c in extra for m in lex.region_markers.get(c, ()))
    country, location, desc = low("country"), low("location"), low("description")
    everything = F.concat_ws(" ", location, low("title"), desc, low("url"))
    marked = X.has_part(everything, lex.markers + more)
    cities = tuple(c for c in lex.cities if c not in more)
    blocked_place = X.has_part(location, lex.states + lex.state_names + lex.keywords + cities)
    blocked_text = X.has_part(everything, lex.keywords) | X.has_part(desc, lex.state_names + cities)
    return (
        F.when(country.isin(*ALLOWED, *extra), False)
        .when(country.isin("us", "ca"), True)
        .when(X.has_part(location, lex.markers + more), False)
        .when(blocked_place, True)
        .otherwise(blocked_text & ~marked)
    )


def reject_reason(as_of: str, days: int = 60, extra: tuple[str, ...] = (), lex: Lexicon = LEXICON) -> Column:
    """P04. The first rule that fails, else null."""
    return F.when(is_negative(lex), "negative").when(is_too_old(as_of, days), "old").when(is_wrong_region(extra, lex), "wrong_location")


def is_coo_title(title_norm: Column, lex: Lexicon = LEXICON) -> Column:
    """P07. A title that starts with a chief operating officer role, after modifiers."""
    return title_norm.rlike(rf"^(?:(?:{'|'.join(lex.coo_modifiers)}) )*(?:{'|'.join(lex.coo_roles)})(?: |$)")


def job_flags(jobs: DataFrame, lex: Lexicon = LEXICON) -> DataFrame:
    """What P05 needs of a posting alone, once per posting."""
    plain = X.normalize_title(F.col("title"))
    title = F.concat(F.lit(" "), plain, F.lit(" "))
    text = F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit(""))))
    head = X.has_word(title, lex.directors)
    senior = X.has_part(F.lower("title"), lex.senior_managers)
    return jobs.select(
        "*",
        text.alias("text_lower"),
        X.functional_words(plain).alias("t_tokens"),
        is_intern_title(F.col("title")).alias("f_intern"),
        is_coo_title(plain, lex).alias("f_coo"),
        X.has_part(F.lower("title"), lex.title_rejects).alias("f_reject"),
        (X.has_word(title, lex.commercial) & ~X.has_word(title, lex.core)).alias("f_commercial"),
        X.has_part(F.lower(F.coalesce("description", F.lit(""))), lex.foreign).alias("f_foreign"),
        (X.has_word(title, lex.german_roles) & ~X.has_word(title, lex.english_roles)).alias("f_german"),
        (~detect_language(F.col("description")).isin("en", "unknown")).alias("f_other_language"),
        X.has_part(text, lex.domain).alias("f_domain"),
        head.alias("f_director"),
        (X.has_part(F.lower("title"), lex.managers) & ~senior & ~head).alias("f_plain_manager"),
        X.normalize_company(F.col("company_name")).alias("company_norm"),
        F.lower(F.coalesce("country", F.lit(""))).alias("country_lower"),
        F.contains(text, F.lit("remote")).alias("f_remote_word"),
        F.contains(text, F.lit("hybrid")).alias("f_hybrid_word"),
    )


#: What P05 reads of a profile. Profiles that agree in it get the same verdicts.
SIGNATURE = ("work_mode", "english_only", "targets", "targets_coo", "preferred", "keywords", "companies")


def profile_terms(profiles: DataFrame, aliases: dict[str, list[str]] = TITLE_ALIASES) -> DataFrame:
    """P19 on the list columns of profiles, in the forms that P05 compares with: targets (a target's aliases count as the target,
    P08) and companies (P11) in the normal forms of postings. `sig` stands for all of them together.

    Profiles that are written alike are taken through this once, with the list of their users."""
    given = ("work_mode", "english_only", "target_titles", "preferred_countries", "excluded_keywords", "excluded_companies")
    profiles = profiles.groupBy(*given).agg(F.collect_list("user_id").alias("users"))
    lists = {c: X.clean_list(F.col(c)) for c in ("target_titles", "preferred_countries", "excluded_keywords", "excluded_companies")}
    p = profiles.select(*[F.col(c) for c in profiles.columns if c not in lists], *[v.alias(c) for c, v in lists.items()])
    p = p.withColumns({c: X.unescaped_items(F.col(c)) for c in ("target_titles", "excluded_companies")})
    terms = p.select(
        "users",
        "work_mode",
        "english_only",
        F.transform(expand_queries(F.col("target_titles"), aliases), lambda t: X.functional_words(X.plain_title(t))).alias("targets"),
        F.exists("target_titles", lambda t: is_coo_title(X.plain_title(t))).alias("targets_coo"),
        F.transform("preferred_countries", F.lower).alias("preferred"),
        F.transform("excluded_keywords", X.casefold).alias("keywords"),
        F.transform("excluded_companies", X.plain_company).alias("companies"),
    )
    return terms.withColumn("sig", F.sha2(F.to_json(F.struct(*SIGNATURE)), 256)).select(F.explode("users").alias("user_id"), *SIGNATURE, "sig")


def signatures(terms: DataFrame) -> DataFrame:
    """The distinct signatures of profiles, one row each."""
    return terms.groupBy("sig").agg(*[F.first(c).alias(c) for c in SIGNATURE])


def work_mode_rejects() -> Column:
    """P12, negated: three-valued is_remote against the wanted mode."""
    remote = F.col("is_remote")
    return (
        F.when(F.col("work_mode") == "remote", F.coalesce(~remote, ~F.col("f_remote_word")))
        .when(F.col("work_mode") == "onsite", F.coalesce(remote, F.lit(False)))
        .when(F.col("work_mode") == "hybrid", F.coalesce(remote, F.lit(False)) & ~F.col("f_hybrid_word"))
        .otherwise(False)
    )


def signature_verdicts(flags: DataFrame, terms: DataFrame, size: int = 4096) -> DataFrame:
    """P05 for every posting and signature of profiles: id, sig, rule, passed and bucket.

    However many profiles share a signature, a posting meets it once. Signatures are broadcast in blocks of at most `size`; each
    block reads the postings once."""
    out, rest = None, signatures(terms)
    while True:
        n, end = rest.select("sig").orderBy("sig").limit(size).agg(F.count("*"), F.max("sig")).first()
        if n < size:
            found = _judged(flags, rest)
            return found if out is None else out.unionByName(found)
        found = _judged(flags, rest.where(F.col("sig") <= end))
        out, rest = found if out is None else out.unionByName(found), rest.where(F.col("sig") > end)


#: Users whose ids are broadcast together, eight bytes each.
USERS_AT_ONCE = 2_000_000


def users_of(terms: DataFrame, size: int = USERS_AT_ONCE) -> list[DataFrame]:
    """sig and the list of its users, `users`: blocks of at most about `size` users, each small enough for a broadcast."""
    blocks = -(-terms.select("user_id").count() // size)
    listed = lambda of: of.groupBy("sig").agg(F.collect_list("user_id").alias("users"))
    if blocks <= 1:
        return [listed(terms)]
    return [listed(terms.where(F.pmod(F.xxhash64("user_id"), F.lit(blocks)) == b)) for b in range(blocks)]


def for_users(found: DataFrame, terms: DataFrame, size: int = USERS_AT_ONCE) -> DataFrame:
    """Rows of signatures as rows of their users. The users of a signature are a list that comes to the rows: nothing is shuffled, and
    the rows of users are made where the row of the signature is, one after another."""
    rows = [found.join(F.broadcast(block), "sig").withColumn("user_id", F.explode("users")).drop("sig", "users") for block in users_of(terms, size)]
    return reduce(DataFrame.unionByName, rows)


def pre_filter(flags: DataFrame, terms: DataFrame, size: int = 4096) -> DataFrame:
    """P05 for every posting and profile: passed, bucket and the number of the deciding rule. `terms` is one row per profile.

    These are all pairs, as asked for; aggregates and queues start from `signature_verdicts` instead. A task makes the rows of one
    signature after those of another, so that equal users and verdicts stand together in what is written."""
    return for_users(signature_verdicts(flags, terms, size).sortWithinPartitions("sig"), terms).select("id", "user_id", "rule", "passed", "bucket")


def bucket_counts(flags: DataFrame, terms: DataFrame) -> DataFrame:
    """P13. user_id, bucket and n, without a row per pair."""
    return for_users(signature_verdicts(flags, terms).groupBy("sig", "bucket").agg(F.count("*").alias("n")), terms).select("user_id", "bucket", "n")


def pre_filter_pairs(pairs: DataFrame, flags: DataFrame, terms: DataFrame) -> DataFrame:
    """P05 for the given pairs (id, user_id) only: two equi-joins, however many postings and profiles there are."""
    hit = F.exists("keywords", lambda k: F.contains(F.col("text_lower"), k))
    return _verdict(pairs.select("id", "user_id").join(flags, "id").join(terms, "user_id"), hit, "user_id")


def _judged(flags: DataFrame, terms: DataFrame) -> DataFrame:
    """P05 over one block of signatures. A text is searched once for each keyword of the block, not once for each signature, and
    does not go into the pairs."""
    every = terms.select(F.explode("keywords").alias("k")).agg(F.collect_set("k").alias("every_keyword"))  # one row, bounded by the block
    found = flags.crossJoin(F.broadcast(every)).withColumn("keyword_hits", F.filter("every_keyword", lambda k: F.contains(F.col("text_lower"), k))).drop("every_keyword", "text_lower")
    return _verdict(found.crossJoin(F.broadcast(terms)), F.arrays_overlap("keywords", "keyword_hits"), "sig")


def _verdict(joined: DataFrame, keyword_hit: Column, whose: str) -> DataFrame:
    """id, whose, rule, passed and bucket from the columns of job_flags and profile_terms."""
    explicit = F.array_contains(F.col("targets"), F.col("t_tokens"))
    rules: list[tuple[Column, bool, str]] = [
        (F.col("f_intern"), False, "low"),
        (F.col("f_coo") & ~F.col("targets_coo"), False, "low"),
        (F.col("f_reject") & ~explicit, False, "low"),
        (F.col("f_commercial") & ~explicit, False, "low"),
        (F.col("f_foreign"), False, "low"),
        (keyword_hit, False, "low"),
        ((F.col("company_norm") != "") & F.array_contains(F.col("companies"), F.col("company_norm")), False, "low"),
        (F.col("english_only") & (F.col("f_german") | F.col("f_other_language")), False, "low"),
        (~F.col("f_domain") & ~explicit, False, "low"),
        (work_mode_rejects(), False, "low"),
        ((F.size("preferred") > 0) & F.col("country_lower").rlike("^[a-z]{2}$") & ~F.array_contains(F.col("preferred"), F.col("country_lower")), False, "low"),
        (explicit, True, "high"),
        (F.col("f_plain_manager"), False, "manager_tier2"),
        (F.col("f_director"), True, "high"),
    ]
    at = F.coalesce(*[F.when(c, F.lit(i + 1)) for i, (c, _, _) in enumerate(rules)], F.lit(len(rules) + 1))
    pick = lambda f, last: reduce(lambda w, i: w.when(F.col("rule") == i + 1, f(rules[i])), range(1, len(rules)), F.when(F.col("rule") == 1, f(rules[0]))).otherwise(last)
    return joined.withColumn("rule", at).select("id", whose, "rule", pick(lambda r: F.lit(r[1]), True).alias("passed"), pick(lambda r: F.lit(r[2]), "medium").alias("bucket"))
