"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words that carry no weight in queries, by length.
STOPWORDS = tuple(sorted("i a an as at be by do in is it my of on or to and are for how the use who why you from into that this what when with your using where which".split(), key=lambda w: (len(w), w)))
#: Verbs that make a sentence a step and a query an action.
VERBS = tuple(sorted("add build call compute configure create deploy fetch install invoke open read reject remove run search set update use verify".split()))
#: First words of shell commands.
TOOLS = tuple(sorted("aws az bash cargo curl docker gcloud git go helm kubectl make node npm npx pip pnpm python sh yarn zsh".split()))
#: This engine's own command; its bare name in a text is no command.
OWN_TOOL = "verbatrix"
#: White space as ECMAScript defines it; Java's \s covers ASCII only.
SPACES = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The intersection lets most characters fail at its first part instead of at each range.
WS = "[ \\t-\\r\\u00a0-\\uffff&&[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]]"
_LEFT, _RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

CONSTRAINT = f"(?i){_LEFT}(must|never|cannot|can't|ensure|required|should not|do not|don't){_RIGHT}"
DEFINITION = f"(?i){_LEFT}(means|is|refers to|defined as){_RIGHT}"
DEFINING_HEADING = f"(?i){_LEFT}(concept|overview|definition){_RIGHT}"
STEP_VERB = f"(?i)^({'|'.join(VERBS)}){_RIGHT}"
ACTION_QUERY = f"(?i){_LEFT}({'|'.join(VERBS)}){_RIGHT}"
EXPLAIN_QUERY = f"(?i){_LEFT}(compare|difference|explain|meaning|purpose|what|why){_RIGHT}"
COMMAND_START = f"(?i)^({'|'.join((*TOOLS, OWN_TOOL))}|[.]?/)"
OPERATOR = "[|][|]|&&|[|]|>|<|[$][(]|;"
FILE_NAME = "(?i)^[./A-Za-z0-9_-]+[.](cfg|ini|json|lock|md|toml|txt|ya?ml)$"
PATH_ONLY = "^[./A-Za-z0-9_<>-]+/[A-Za-z0-9_./<>-]+$"
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: Whether there is a symbol: a whole word is tried once, not again from each of its letters.
SYMBOL_ANYWHERE = f"(?<![A-Za-z0-9_])[0-9]*+{_NAME}+(?:[.:][A-Za-z_]|[(][^)]*[)])"
SYMBOL_WORD = f"{_LEFT}{_NAME}(?:[.:]{_NAME})+{_RIGHT}|{_LEFT}{_NAME}[(][^)]*[)]"


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def tokenize(c: Column) -> Column:
    """Lower-case ASCII words of two or more characters, without stopwords; order and repeats stay."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def anchor(c: Column) -> Column:
    """Heading as a fragment name, ``section`` if nothing is left of it."""
    kept = F.regexp_replace(F.lower(js_trim(c)), f"[^a-z0-9\\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, "\\s+", "-"), "-+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(bare == "", "section").otherwise(bare)


def hash_text(c: Column) -> Column:
    return F.sha2(c, 256)


def truncate(c: Column, n: int) -> Column:
    return F.when(js_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(js_length(c) / 4)).cast("int")


def count_occurrences(text: Column, part: Column) -> Column:
    """Places at which ``part`` occurs without overlap."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def stable_unique(c: Column) -> Column:
    return F.array_distinct(c)


def normalize_sentence(c: Column) -> Column:
    plain = F.regexp_replace(c, "[`*_>#]", " ")
    return squeeze(F.regexp_replace(plain, "\\[[^\\]]+\\]\\(([^)]+)\\)", "$1"))


def sentences(c: Column) -> Column:
    return F.filter(F.split(normalize_sentence(c), f"(?<=[.!?]){WS}+"), lambda s: s != "")


def sentence_pairs(parts: Column) -> Column:
    """Sentences two by two. ``parts`` should be a column: it is read for each pair."""
    last = F.floor((F.size(parts) - 1) / 2).cast("int")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.get(parts, i * 2), F.get(parts, i * 2 + 1)))).otherwise(F.array().cast("array<string>"))


def classify_unit(text: Column, heading: Column, is_step: Column) -> Column:
    return (
        F.when(is_step | text.rlike(STEP_VERB), "step")
        .when(text.rlike(CONSTRAINT), "constraint")
        .when(heading.rlike(DEFINING_HEADING) | text.rlike(DEFINITION), "definition")
        .otherwise("fact")
    )


def is_inline_command(c: Column) -> Column:
    """Whether a trimmed code span looks like a command."""
    has_space = c.rlike(WS)
    first = F.regexp_replace(F.split(c, f"{WS}+")[0], "^['\"]|['\"]$", "")
    known = first.rlike(COMMAND_START)
    operator = c.rlike(OPERATOR)
    flag = c.rlike(f"(^|{WS})--[a-z0-9-]+")
    file_like = c.rlike(FILE_NAME) | (c.rlike(PATH_ONLY) & ~has_space)
    own = F.lower(first) == OWN_TOOL
    return (c != "") & ~(file_like & ~flag & ~known) & F.when(known, ~(own & ~has_space & ~flag & ~operator)).otherwise(flag & has_space)


def is_low_signal(c: Column) -> Column:
    """A command text that is one file name or path."""
    t = js_trim(c)
    return ~t.contains("\n") & (t.rlike(FILE_NAME) | t.rlike(PATH_ONLY)) & (t != "")


def fixed(c: Column, digits: int = 4) -> Column:
    """``c`` rounded to so many digits by its exact binary value, ties away from
    zero. The product's rounding error is recovered with Veltkamp's splitting."""
    scale = float(10**digits)
    a = F.abs(c)
    t = a * 134217729.0
    high = t - (t - a)
    low = a - high
    p = a * scale
    err = (high * scale - p) + low * scale
    whole = F.floor(p).cast("double")
    frac = p - whole
    up = (frac > 0.5) | ((frac == 0.5) & (err >= 0))
    # a product rounded up to a whole number from below counts as just under it
    return F.signum(c) * (whole + up.cast("double")) / scale + 0.0


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def query_profile(c: Column) -> list[Column]:
    """tokens, flags and intent of a query."""
    explain = (c.contains("?") & ~c.rlike(f"(?i){_LEFT}how to{_RIGHT}")) | c.rlike(EXPLAIN_QUERY)
    return [
        F.array_distinct(tokenize(c)).alias("tokens"),
        F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("--[a-z0-9-]+"), F.lit(0))).alias("flags"),
        F.when(explain, "explain").otherwise("action").alias("intent"),
        c.rlike(ACTION_QUERY).alias("acts"),
        c.rlike("[A-Za-z_]").alias("has_letter"),
    ]


def to_doc_id(path: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(path, "(?i)[.]md$", ""), "(?i)/index$", "")
    return F.when((bare == "") | (F.lower(bare) == "readme"), "readme").otherwise(bare)


def icu(c: Column) -> Column:
    """``c`` ordered by Unicode collation, for ties."""
    return F.collate(c, "UNICODE")


def resolve_link(doc_id: Column, target: Column) -> Column:
    """Reference a link points at, null if it leaves the corpus."""
    raw = js_trim(target)
    doc = lambda c: F.regexp_replace(F.regexp_replace(c, "(?i)[.]md$", ""), "(?i)/index$", "")
    path = doc(F.regexp_extract(raw, "^([^#]*)#", 1))
    return (
        F.when((raw == "") | raw.rlike("(?i)^https?://"), F.lit(None))
        .when(raw.startswith("#"), F.concat(doc_id, F.lit("#"), anchor(F.substring(raw, 2, 1 << 30))))
        .when(raw.contains("#"), F.concat(F.when(path == "", doc_id).otherwise(path), F.lit("#"), anchor(F.regexp_extract(raw, "(?s)#(.*)$", 1))))
        .when(raw.rlike("(?i)[.]md$"), F.concat(F.when(doc(raw) == "", "readme").otherwise(doc(raw)), F.lit("#document")))
    )


SUSPICIOUS = (
    "(?i)ignore\\s+(all\\s+)?previous\\s+instructions?",
    "(?i)disregard\\s+the\\s+above",
    "(?i)exfiltrat(e|ion)",
    "(?i)send\\s+.*(credential|key|secret|token)",
    "(?i)paste\\s+your\\s+(api\\s*key|password|token)",
)


def suspicious(c: Column) -> Column:
    """Numbers (from 1) of the injection patterns that a text matches."""
    return F.filter(F.array(*[F.when(c.rlike(p), n) for n, p in enumerate(SUSPICIOUS, 1)]), lambda x: x.isNotNull())


def score_match(text: Column, tokens: Column) -> Column:
    """Share of the tokens that occur in ``text`` as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when((low == "") | (F.size(tokens) == 0), 0.0).otherwise(F.size(F.filter(tokens, lambda t: low.contains(t))) / F.size(tokens))


def is_citation(c: Column) -> Column:
    return c.rlike("^[^@\\s]+@[^:\\s]+:(symbol:)?[^\\s]+:\\d+-\\d+$")


def register(spark: SparkSession) -> None:
    """SQL functions vx_tokenize, vx_token_estimate, vx_jaccard and vx_sha256
    for the session, made of built-in expressions."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    for name, args, kind, body in (
        ("vx_tokenize", "x STRING", "ARRAY<STRING>", f"filter(split(lower(x), '[^a-z0-9]+'), t -> length(t) > 1 AND t NOT IN ({stop}))"),
        ("vx_token_estimate", "x STRING", "INT", "int(greatest(1, ceil(length(encode(x, 'UTF-16BE')) / 8)))"),
        ("vx_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
        ("vx_sha256", "x STRING", "STRING", "sha2(x, 256)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
