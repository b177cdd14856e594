"""Text functions as built-in expressions: distances, normal forms, tokens, entity types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without content.
STOPWORDS = (
    "the", "a", "an", "of", "and", "or", "but", "in", "on", "at", "to", "for", "is", "are", "was", "were", "be", "been", "being",
    "by", "with", "from", "as", "into", "than", "that", "this", "it", "its", "their", "his", "her",
)

#: Patterns of entity types.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
TIME = r"^\d{1,2}:\d{2}(:\d{2})?$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
DATE = r"^\d{1,4}[-/]\d{1,2}([-/]\d{1,4})?$"
SEPARATORS = r"[\s.\-/:]"
POSTCODE = r"^[A-Za-z]{1,2}\d{1,2}[A-Za-z]?\s*\d?[A-Za-z]{0,2}$"

#: Patterns of errors, whatever the case: of statements, and of what is around them.
STATEMENT_ERROR = r"Cypher\w*Error|Neo\.ClientError\."
INFRA_ERROR = (
    r"example timeout|example stalled|APITimeoutError|transaction timeout|timed out|(?:Read|Write|Connect)?TimeoutError|(?:Read|Write|Connect)Timeout|"
    r"RateLimit|rate limit|\b429\b|(?:error code|status(?: code)?|http)\W{0,3}5\d\d\b|ServiceUnavailable|SessionExpired|DatabaseUnavailable|Neo\.TransientError\.|"
    r"InternalServerError|APIConnectionError|Connection(?:Error|Reset|Refused)|overloaded|watchdog"
)


def lev_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, of trimmed lower-case texts; both empty: 1."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / F.when(longest > 0, longest))


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether the Levenshtein distance is ``k`` or less; stops early."""
    return F.levenshtein(a, b, k) >= 0


def osa_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment (adjacent transpositions count once), row by row over
    arrays: a fold that carries the last two rows. For short values; batches of long ones
    are better served by functions.udf.osa."""
    s, t = F.split(a, ""), F.split(b, "")
    n = F.length(b)
    first = F.sequence(F.lit(0), n)
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("c"), first.alias("one"), first.alias("two"), t.alias("t"))

    def row(acc: Column, c: Column) -> Column:
        i = acc["i"] + 1

        def cell(r: Column, j: Column) -> Column:
            tj = F.get(acc["t"], j)
            best = F.least(F.get(acc["one"], j + 1) + 1, F.element_at(r, -1) + 1, F.get(acc["one"], j) + (tj != c).cast("int"))
            swap = (i > 1) & (j > 0) & (F.get(acc["t"], j - 1) == c) & (tj == acc["c"])
            return F.array_append(r, F.when(swap, F.least(best, F.get(acc["two"], j - 1) + 1)).otherwise(best))

        new = F.aggregate(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: j < n), F.array(i), cell)
        return F.struct(i.alias("i"), c.alias("c"), new.alias("one"), acc["one"].alias("two"), acc["t"].alias("t"))

    rows = F.when(F.length(a) > 0, s).otherwise(F.array().cast("array<string>"))
    return F.aggregate(rows, zero, row, lambda acc: F.element_at(acc["one"], -1))


def words(s: Column) -> Column:
    """Lower-case words in order, without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def word_set(s: Column) -> Column:
    return F.array_distinct(words(s))


def collapsed(s: Column) -> Column:
    """Trimmed, lower-case, single spaces for white space of any kind."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def squeezed(s: Column) -> Column:
    """Lower-case word characters only."""
    return F.regexp_replace(F.lower(s), r"(?U)\W+", "")


def entity_type(s: Column) -> Column:
    """email, time, date, id or name; the first that fits, of the trimmed text. Blank texts,
    numbers with separators, and short codes with a digit are ids."""
    t = F.regexp_replace(s, r"^(?U)\s+|\s+$", "")
    return (
        F.when(s.isNull(), None).when(t == "", "id").when(t.rlike(EMAIL), "email").when(t.rlike(TIME), "time").when(t.rlike(SSN), "id").when(t.rlike(DATE), "date")
        .when(F.regexp_replace(t, SEPARATORS, "").rlike(r"^\d+$"), "id").when(t.rlike(POSTCODE) & t.rlike(r"\d") & (F.length(t) <= 8), "id").otherwise("name")
    )


def quoted_literals(s: Column, shortest: int = 2) -> Column:
    """Texts in quotes, escapes resolved, each once in the order of first sight."""
    found = F.regexp_extract_all(s, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), F.lit(0))
    inner = F.transform(found, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
    return F.array_distinct(F.filter(inner, lambda q: F.length(q) >= shortest))


def is_acronym(name: Column, form: Column) -> Column:
    """Whether ``form`` reads as a short form of ``name``: capitals only (2 to 6 characters), or
    the initials of its words, two at least, points left out. Words that aren't all capitals
    are none."""
    f = F.trim(form)
    capitals = (f == F.upper(f)) & (f != F.lower(f))
    initials = F.upper(F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.substring(w, 1, 1)), ""))
    same = (F.regexp_replace(F.upper(f), r"\.", "") == initials) & (F.length(initials) >= 2)
    return F.when((f == "") | (f.contains(" ") & ~capitals), False).when(capitals & F.length(f).between(2, 6), True).otherwise(same)


def snake_case(s: Column) -> Column:
    """camelCase and CapitalWords as lower-case words joined by underscores."""
    x = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"))


def identifier(s: Column) -> Column:
    """Lower case; each run of other than ASCII letters and digits is one underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(s, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def label_identifier(s: Column) -> Column:
    """A node label as an identifier: other characters give way first, which lowers it."""
    return snake_case(identifier(s))


def type_identifier(s: Column) -> Column:
    """A relationship type, quoted and with a colon as the database may give it, as an identifier."""
    bare = F.regexp_replace(F.trim(s), "^`+|`+$", "")
    return identifier(F.regexp_replace(F.regexp_replace(bare, "^:+", ""), "^`+|`+$", ""))


def row_sample(rows: Column, most: int, longest: int) -> Column:
    """The first ``most`` rows (of an array) as JSON, cut at ``longest`` characters with a mark."""
    text = F.to_json(F.slice(rows, 1, most))
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(" …(truncated)"))).otherwise(text)


def occurrences(text: Column, part: Column) -> Column:
    """Starts from 0 of all occurrences whatever the case, overlapping ones too."""
    t, p = F.lower(text), F.lower(part)
    last = F.length(t) - F.length(p)
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.when(F.length(p) > 0, F.filter(starts, lambda i: F.substring(t, i + 1, F.length(p)) == p)).otherwise(F.array().cast("array<int>"))


def query_normal(s: Column) -> Column:
    """A query text for exact match: white space collapsed, no end semicolon."""
    one = F.regexp_replace(F.trim(s), r"\s+", " ")
    return F.trim(F.regexp_replace(one, r"\s*;\s*$", ""))


def stripped_query(s: Column) -> Column:
    """Without comments; strings and quoted names emptied."""
    x = F.regexp_replace(s, r"(?s)/\*.*?\*/", " ")
    x = F.regexp_replace(x, r"//[^\n]*", " ")
    x = F.regexp_replace(x, r"'(?:[^'\\]|\\.)*'", "''")
    x = F.regexp_replace(x, r'"(?:[^"\\]|\\.)*"', '""')
    return F.regexp_replace(x, r"`[^`]*`", "``")


def snap(x: Column, eps: float) -> Column:
    """Rounded to a multiple of eps, half to even."""
    return F.bround(x / eps, 0) * eps if eps else x


def error_class(s: Column) -> Column:
    """infra, gold, agent or other by an error's text. A statement's error is never infra: it
    is gold's if the text starts so, else the agent's. Otherwise infra wins over the prefix."""
    e = F.coalesce(s, F.lit(""))
    gold = e.startswith("gold")
    return (
        F.when(e.rlike(f"(?i){STATEMENT_ERROR}"), F.when(gold, "gold").otherwise("agent")).when(e.rlike(f"(?i){INFRA_ERROR}"), "infra")
        .when(gold, "gold").when(e.startswith("agent"), "agent").otherwise("other")
    )


def masked_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\d+", "N")


def json_object(s: Column) -> Column:
    """The outermost braces of a text, code fences left out."""
    return F.nullif(F.regexp_extract(F.regexp_replace(s, r"```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))


def row_seed(*parts: Column) -> Column:
    """The first 8 bytes of SHA-256 of the parts joined by a pipe, as a decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; a zero vector counts as of length 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    norm = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(1.0)
    return dot(a, b) / (norm(a) * norm(b))
