"""Text, identifier and category expressions. All are built-in column algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

BLANKS = " \t\n\r\f\x0b"


def trimmed(c: Column) -> Column:
    """Strip whitespace; an empty result is NULL."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def drop_na_words(c: Column, words: list[str] = fv.NA_TOKENS) -> Column:
    """Strip whitespace; words such as ``N/A`` become NULL (any case)."""
    t = trimmed(c)
    return F.when(~F.upper(t).isin(words), t)


def upper_text(c: Column) -> Column:
    return F.upper(trimmed(c))


def lower_text(c: Column) -> Column:
    return F.lower(trimmed(c))


def squeeze(c: Column) -> Column:
    """Collapse runs of whitespace to one blank."""
    return F.regexp_replace(trimmed(c), r"\s+", " ")


def category_key(c: Column) -> Column:
    """Upper case with runs of blank, underscore and hyphen as one blank."""
    return trimmed(F.regexp_replace(F.upper(trimmed(c)), r"[\s_\-]+", " "))


def bare_id(c: Column) -> Column:
    return F.regexp_replace(F.upper(trimmed(c)), r"[\s\-_]+", "")


def user_id(c: Column, keep_unmatched: bool = False) -> Column:
    """``emp-12``, ``EMP 12`` or ``12`` to ``EMP12``.

    Anything else is NULL, or the separator-free upper-case text when
    ``keep_unmatched`` is set.
    """
    bare = bare_id(drop_na_words(c) if keep_unmatched else c)
    pattern = r"^(?:EMP)?([0-9]+)$"
    if keep_unmatched:
        return F.regexp_replace(bare, pattern, "EMP$1")
    return F.concat(F.lit("EMP"), F.try_element_at(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), F.lit(1)))


def hostname(c: Column) -> Column:
    """Upper case, hyphens for underscores, without the ``.CORP.LOCAL`` suffix."""
    return _without_domain(F.translate(upper_text(c), "_", "-"))


def _without_domain(t: Column) -> Column:
    """Only names that hold the suffix meet the pattern."""
    return F.when(F.contains(t, F.lit(".CORP.LOCAL")), F.regexp_replace(t, r"\.CORP\.LOCAL$", "")).otherwise(t)


def join_key(c: Column) -> Column:
    """A key usable in joins: blanks and the ``Unknown`` sentinel are NULL."""
    return F.nullif(trimmed(c), F.lit("Unknown"))


def hostname_join_key(c: Column) -> Column:
    bare = F.regexp_replace(F.upper(join_key(c)), r"\.CORP\.LOCAL$", "")
    return F.translate(bare, "_", "-")


_HEX64 = "^[0-9a-fA-F]{64}$"


def sha256_clean(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t.rlike(_HEX64), F.lower(t))


def sha256_reason(c: Column) -> Column:
    t = trimmed(c)
    return (
        F.when(t.isNull(), "missing")
        .when(t.rlike(_HEX64), "valid")
        .when(F.length(t) != 64, "invalid_length")
        .otherwise("invalid_characters")
    )


def sha256_status(c: Column) -> Column:
    """As :func:`sha256_reason`, with a class of its own for placeholder words."""
    t = trimmed(c)
    reason = sha256_reason(c)
    return (
        F.when(reason == "valid", "valid_sha256")
        .when(F.lower(t).isin(fv.HASH_PLACEHOLDERS), "placeholder")
        .otherwise(reason)
    )


def lookup(key: Column, table: dict[str, list[str]], default: Column | None = None) -> Column:
    """Label whose alias list holds ``key``, the first one on ties.

    The small fixed table is a map literal, so the key is made once; a CASE would make it again
    for every label that it tries.
    """
    labels: dict[str, str] = {}
    for label, aliases in table.items():
        for alias in aliases:
            labels.setdefault(alias, label)
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    out = F.try_element_at(F.create_map(*pairs), key)
    return out if default is None else F.coalesce(out, default)


def department(c: Column, on_unmapped: str = "null") -> Column:
    """Department label. ``on_unmapped`` is ``null`` or ``keep``."""
    if on_unmapped == "keep":
        t = drop_na_words(c)
        return lookup(F.lower(t), fv.DEPARTMENTS, t)
    return lookup(F.lower(squeeze(c)), fv.DEPARTMENTS)


def employment_status(c: Column) -> Column:
    return lookup(F.upper(squeeze(c)), fv.EMPLOYMENT_STATUS)


def login_event(c: Column) -> Column:
    key = F.translate(F.lower(drop_na_words(c)), "- ", "__")
    return lookup(key, fv.LOGIN_EVENTS, F.lit("other"))


def auth_method(c: Column) -> Column:
    key = F.lower(drop_na_words(c))
    return lookup(key, fv.AUTH_METHODS, key)


def failure_reason(c: Column) -> Column:
    t = drop_na_words(c)
    return lookup(F.lower(t), fv.FAILURE_REASONS, t)


def severity(c: Column) -> Column:
    return lookup(category_key(c), fv.SEVERITIES)


def severity_rank(label: Column) -> Column:
    out = F.lit(0)
    for name, rank in fv.SEVERITY_RANKS.items():
        out = F.when(label == name, rank).otherwise(out)
    return out


def alert_status(c: Column) -> Column:
    return lookup(category_key(c), fv.ALERT_STATUS)


def criticality(c: Column) -> Column:
    return lookup(category_key(c), fv.CRITICALITY)


def protocol(c: Column) -> Column:
    return lookup(upper_text(c), fv.PROTOCOLS)


def firewall_action(c: Column) -> Column:
    return lookup(upper_text(c), fv.FIREWALL_ACTIONS)


def boolean(c: Column, true_words: list[str] = fv.TRUE_WORDS, false_words: list[str] = fv.FALSE_WORDS) -> Column:
    """Nullable boolean from word lists."""
    t = lower_text(c)
    return F.when(t.isin(true_words), True).when(t.isin(false_words), False)


def auth_boolean(c: Column) -> Column:
    return boolean(c, fv.TRUE_WORDS_AUTH, fv.FALSE_WORDS_AUTH)


def replace_labels(c: Column, old: list[str], new: str) -> Column:
    return F.when(c.isin(old), new).otherwise(c)


def department_node(c: Column) -> Column:
    return F.concat(F.lit("DEPT-"), F.translate(F.upper(c), " ", "_"))


def add_prefix(c: Column, prefix: str) -> Column:
    """Prefix unless it is already there."""
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def drop_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def contains_any(text: str, *cols: Column) -> Column:
    """Case-insensitive literal search over several columns; NULL is no match."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return hit


def join_flags(flags: list[tuple[Column, str]], sep: str = "; ", default: str = "NONE_OBSERVED") -> Column:
    """Names of the conditions that hold, joined in order, or ``default``."""
    names = F.array(*[F.when(cond, F.lit(name)) for cond, name in flags])
    return F.coalesce(F.nullif(F.array_join(F.array_compact(names), sep), F.lit("")), F.lit(default))


def scrub_markup(c: Column, limit: int | None = None) -> Column:
    """Untrusted field value for display: markup tokens removed, cut to ``limit`` characters where given."""
    t = F.btrim(c, F.lit(BLANKS))
    for token in fv.MARKUP_TOKENS:
        t = F.replace(t, F.lit(token), F.lit(""))
    return F.coalesce(t if limit is None else F.substring(t, 1, limit), F.lit("Unknown"))


def scrub_phrases(c: Column) -> Column:
    """Replace each forbidden phrase by a marker; the whole text is kept."""
    t = F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit(""))
    for pattern in fv.FORBIDDEN_PHRASES:
        t = F.regexp_replace(t, "(?i)" + pattern, fv.SCRUB_MARKER)
    return t


def has_word(low: Column, words: list[str]) -> Column:
    """Whether a lower-case text contains any of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word))
    return hit


def entity_in_text(low: Column) -> Column:
    """First entity id named in a lower-case text, in upper case.

    Pattern order decides, not position; sequence ids come first, as they hold the id of a user or host. Ids do not depend on case, and
    searching lower-case text spares the case-insensitive matcher. A cheap
    substring test skips patterns that cannot match.
    """
    found = [
        F.when(has_word(low, pieces), F.regexp_substr(low, F.lit(pattern)))
        for pieces, pattern in zip(fv.ENTITY_PIECES, fv.ENTITY_PATTERNS)
    ]
    found[2] = F.translate(found[2], "_", "-")
    found[4] = F.regexp_replace(found[4], r"^host\s+", "")
    return F.upper(F.coalesce(*found))


def intent(low: Column, entity: Column) -> Column:
    """Ordered keyword class of a question.

    ``low`` is the lower-case text and ``entity`` the id found in it, both as
    columns of their own.
    """
    def has(name: str) -> Column:
        return has_word(low, fv.INTENT_WORDS[name])

    return (
        F.when(has("peer_comparison"), "peer_comparison")
        .when(has("graph") & F.contains(low, F.lit("ip")), "analyze_shared_ip")
        .when(has("graph"), "graph_relationship")
        .when(has("analyze_temporal_sequence"), "analyze_temporal_sequence")
        .when(has("data_quality_question"), "data_quality_question")
        .when(has("find_high_risk_entities") & entity.isNull(), "find_high_risk_entities")
        .when(entity.isNotNull(), "investigate_entity")
        .otherwise("general_security_summary")
    )
