"""String functions: Column in, Column out, all inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V

EDGE_SPACE = r"^[\s 　]+|[\s 　]+$"
EDGES = " \t\n\x0b\f\r\u00a0\u3000"     # the characters of EDGE_SPACE
ENDS = EDGES + "\u0085\u2028\u2029"     # and those before which its $ matches too
NOT_WORD_BEFORE = "(^|[^A-Za-z0-9_])"
NOT_WORD_AFTER = "($|[^A-Za-z0-9_])"
META = r"([.*+?^${}()|\[\]\\])"
# Full-width ASCII block folded to ASCII; the ideographic space becomes a plain one.
FOLD_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
FOLD_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
CJK = r"[㐀-鿿]"


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_ws(value) -> Column:
    return F.regexp_replace(col(value), EDGE_SPACE, "")


def blank_to_null(value) -> Column:
    return F.nullif(trim_ws(value), F.lit(""))


def field_or_null(name) -> Column:
    """``blank_to_null`` of a plain field, which costs little to read twice: the pattern runs only where an edge has something to trim."""
    text = col(name)
    return F.nullif(F.when(F.btrim(text, F.lit(ENDS)) == text, text).otherwise(trim_ws(text)), F.lit(""))


def collapse(value) -> Column:
    return trim_ws(F.regexp_replace(col(value), r"\s+", " "))


def contains_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))


def vocabulary_hits(text: Column, families: dict) -> Column:
    """Canonical names whose any pattern occurs in the text, in vocabulary order."""
    return F.array_compact(F.array(*[
        F.when(contains_any(text, [p.lower() for p in patterns]), F.lit(name)) for name, patterns in families.items()
    ]))


def word_hits(text: Column, words) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]))


def truncate(value, size: int, keep: int, suffix: str) -> Column:
    """Longer than ``size`` code points -> first ``keep``, right-trimmed, plus the suffix."""
    text = col(value)
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(F.regexp_replace(F.substring(text, 1, keep), r"\s+$", ""), F.lit(suffix)))


def _cut(text: Column, size: int) -> Column:
    """More than ``size`` code points -> first size-3 and three dots. One regex, so the input is not repeated."""
    return F.regexp_replace(text, r"^(.{%d}).{4,}$" % (size - 3), "$1...")


def truncate_plain(value, size: int) -> Column:
    return _cut(collapse(value), size)


def snippet(value) -> Column:
    return F.substring(trim_ws(value), 1, 280)


def clamp_headline(value, limit: int = 60) -> Column:
    first_line = F.regexp_replace(col(value), r"(?s)\r?\n.*$", "")
    return _cut(F.nullif(collapse(first_line), F.lit("")), limit)


def headline_chain(*values) -> Column:
    """Headline of the first value whose first line is not blank. Blank lines are told without patterns, and one value is clamped."""
    lines = [F.when(F.btrim(F.substring_index(v, "\n", 1), F.lit(EDGES)) != "", v) for v in values]
    return clamp_headline(F.coalesce(*lines))


def _canonical_families(text: Column) -> Column:
    for family in V.UNIVERSITY_FAMILIES:
        for variant in sorted(family, key=len, reverse=True):
            plain = variant.isascii()
            pattern = (r"(?<![A-Za-z0-9_])" + variant + r"(?![A-Za-z0-9_])") if plain else variant
            text = F.regexp_replace(text, pattern, family[0])
    return text


def normalize_search_text(value, folded: Column | None = None) -> Column:
    """Fold width, lower, map alias families to one name, punctuation and symbols to one space.

    Full NFKC has no JVM built-in; pass ``folded=nfkc_udf()(...)`` from ``functions.udfs`` when wanted.
    """
    text = folded if folded is not None else F.translate(col(value), FOLD_FROM, FOLD_TO)
    text = _canonical_families(trim_ws(F.lower(text)))
    return collapse(F.regexp_replace(text, r"[\p{P}\p{S}]+", " "))


def normalize_index_text(value) -> Column:
    """Normaliser used on stored text: 19 full-width marks, school aliases, punctuation to space."""
    text = F.translate(F.lower(F.coalesce(col(value), F.lit(""))), V.FULL_WIDTH_FROM, V.FULL_WIDTH_TO)
    text = F.replace(F.replace(text, F.lit("浙江大学"), F.lit("zhejiang university")), F.lit("浙大"),
                     F.lit("zhejiang university"))
    text = F.when(text.contains("zju"), F.regexp_replace(text, r"(?<![\p{L}\p{N}_])zju(?![\p{L}\p{N}_])", "zhejiang university")).otherwise(text)
    return F.trim(F.regexp_replace(text, r"[\s\p{P}\p{S}]+", " "))


def escape_regex(value: Column) -> Column:
    return F.regexp_replace(value, META, r"\\$1")


def escape_like(value: Column) -> Column:
    return F.regexp_replace(value, r"([%_\\])", r"\\$1")


def is_boundary_term(term: Column) -> Column:
    return term.rlike("^[a-z0-9]+$") & (F.length(term) <= 8)


def is_strong_term(term: Column) -> Column:
    return (term != "") & (term.isin(V.SHORT_TECH_TERMS) | term.rlike(CJK) | term.contains(" ")
                           | term.contains("-") | (F.length(term) >= 4))


def bind(value: Column, test) -> Column:
    """Boolean test of a value that is expensive to compute: evaluated once even when a filter holding
    it is pushed below the projection that made it."""
    return F.exists(F.array(value), test)


def index_term_match(term: Column, text: Column) -> Column:
    """Short plain words match whole words, everything else is a substring match."""
    whole = F.rlike(text, F.concat(F.lit(NOT_WORD_BEFORE), term, F.lit(NOT_WORD_AFTER)))
    # Only rows holding the characters at all need the whole-word pattern.
    return F.when(~F.contains(text, term), F.lit(False)).when(is_boundary_term(term), whole).otherwise(F.lit(True))


def wants_word_boundary(term: Column) -> Column:
    return term.rlike("(?i)^[a-z0-9]") & term.rlike("(?i)[a-z0-9]$") & ~term.rlike(r"[^A-Za-z0-9_\s.\-]")


def context_term_match(term, context: Column) -> Column:
    """Whole-word match for terms with ASCII edges (inner spaces match any run), else substring."""
    needle = F.lower(trim_ws(term if isinstance(term, Column) else F.lit(term)))
    haystack = F.lower(context)
    pattern = F.concat(F.lit(NOT_WORD_BEFORE), F.regexp_replace(escape_regex(needle), r"\s+", r"\\s+"),
                       F.lit(NOT_WORD_AFTER))
    # A match needs the first word of the term somewhere; testing that first keeps the per-row pattern for the few hits.
    possible = F.contains(haystack, F.substring_index(needle, " ", 1))
    return F.when((needle == "") | ~possible, F.lit(False)).when(
        wants_word_boundary(needle), F.rlike(haystack, pattern)).otherwise(F.contains(haystack, needle))


def alias_mention(text: Column, alias: str) -> Column:
    needle = alias.strip().lower()
    if any(c.isascii() and c.isalnum() for c in needle):
        import re
        return text.rlike("(?i)(^|[^a-z0-9])" + re.escape(needle) + "([^a-z0-9]|$)")
    return text.contains(needle)


def lines(value: Column) -> Column:
    """Split on list punctuation of both scripts and trim every piece."""
    prepared = F.regexp_replace(value, r"\r?\n+|[|｜;；]+|[，,、]+|\s*[/／]\s*", "\n")
    return F.transform(F.split(prepared, "\n"), trim_ws)


def role_segments(value) -> Column:
    """Headline-like text -> role segments without bullets, '@org' and ' at org' tails, at most 160 long."""
    text = F.regexp_replace(F.regexp_replace(col(value), r"\[[^\]]+\]", " "), "[“”\"'`]", " ")
    text = F.regexp_replace(collapse(text), r"[|｜;；]+|[，,、]+|\s*[/／]\s*|[。！？!?]+", "\n")

    def clean(piece):
        piece = F.regexp_replace(trim_ws(piece), "^[\\-•·]+", "")
        piece = F.regexp_replace(piece, r"\s*@\s*[^@]+$", "")
        return trim_ws(F.regexp_replace(piece, r"(?i)\s+at\s+.+$", ""))

    return F.filter(F.transform(F.split(text, "\n"), clean), lambda s: (s != "") & (F.length(s) <= 160))


def role_signals(value) -> Column:
    pieces = F.filter(lines(trim_ws(value)), lambda s: (s != "") & (F.length(s) <= 40)
                      & s.rlike(V.ROLE_SIGNAL_PATTERN))
    return F.array_distinct(pieces)


def captured(text: Column, patterns) -> Column:
    """All first-group captures of several patterns, trimmed, empties dropped."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return F.filter(F.transform(found, trim_ws), lambda s: s != "")


def quoted_terms(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)),
                                lambda s: F.lower(trim_ws(s))), lambda s: s != "")


def clean_query(value) -> Column:
    text = F.substring(trim_ws(value), 1, 1000)
    text = F.regexp_replace(text, r"[\x00-\x08\x0b-\x0c\x0e-\x1f]", "")
    text = F.replace(F.replace(text, F.lit("{{"), F.lit("{ {")), F.lit("}}"), F.lit("} }"))
    return F.regexp_replace(text, r"(?i)</?\s*user_query\s*>", "")


def html_to_text(value, limit: int | None = 8000) -> Column:
    """Drop script/style/nav/header/footer blocks and tags, collapse space, cut (None keeps the whole text)."""
    text = col(value)
    for tag in ("script", "style", "nav", "header", "footer"):
        text = F.regexp_replace(text, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    text = collapse(F.regexp_replace(text, "<[^>]*>", " "))
    return text if limit is None else F.substring(text, 1, limit)


def url_identity(value) -> Column:
    """host, or host:first 8 hex of md5(path) when there is a path; null for an invalid URL."""
    url = col(value)
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/$", "")
    return F.when(path == "", host).otherwise(F.concat_ws(":", host, F.substring(F.md5(path), 1, 8)))


def url_key(value) -> Column:
    """De-dup key: no fragment, lower host, no trailing slash on the path."""
    url = trim_ws(value)
    ok = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    parsed = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path),
                      F.when(query == "?", F.lit("")).otherwise(query))
    return F.when(ok, parsed).otherwise(F.lower(F.regexp_replace(url, "/+$", "")))


CODE_HANDLE = r"(?i)github\.com/([A-Za-z0-9_.\-]+)/?(?=$|[?#\"'`\s,)}\]]|\\)"


def normalize_handle(value: Column) -> Column:
    return F.lower(trim_ws(F.regexp_replace(value, "^@", "")))


def code_handles(*texts) -> Column:
    """Profile handles found by profile-URL pattern anywhere in the payload texts, lower, distinct."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(col(t), F.lit("")), F.lit(CODE_HANDLE), F.lit(1))
                                for t in texts]))
    return F.array_distinct(F.filter(F.transform(found, normalize_handle), lambda h: h != ""))


def url_first_segment(value: Column) -> Column:
    """First path segment of a URL, or the value itself when it is not a URL or has no path."""
    segment = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/+([^/?#]+)", 1)
    return F.when(segment != "", segment).otherwise(value)


def alias_handle(value: Column) -> Column:
    is_url = value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    return F.when(is_url, F.lower(F.regexp_extract(value, r"^[^:]+://[^/?#]*/*([^/?#]*)", 1))).otherwise(
        normalize_handle(value))


def document_alias_terms(value) -> Column:
    """Variants of a family that should be appended to a document mentioning any member of it."""
    raw = F.lower(col(value))
    normalized = normalize_search_text(value)
    parts = []
    for family in V.UNIVERSITY_FAMILIES:
        signal = normalized.contains(family[0]) | contains_any(raw, family)
        missing = F.array_compact(F.array(*[F.when(~raw.contains(v), F.lit(v)) for v in family]))
        parts.append(F.when(signal, missing).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def has_university_signal(value) -> Column:
    return normalize_search_text(value).contains(V.UNIVERSITY_FAMILIES[0][0])


def normalized_contains_any(value: Column, terms) -> Column:
    return contains_any(normalize_search_text(value), [" ".join(t.replace("-", " ").split()) for t in terms])


def coerce_json(value, depth: int = 3) -> Column:
    """Unwrap a JSON object that was encoded as a string up to ``depth`` times; null when it is no object."""
    text = trim_ws(value)
    result = F.lit(None).cast("string")
    for level in range(depth):
        if level:
            text = trim_ws(F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v"))
        result = F.coalesce(result, F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text))
    return result
