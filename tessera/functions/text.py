"""Tokenisers and small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores of 2 bytes or more, in order."""
    return F.filter(
        F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), 0),
        lambda w: F.octet_length(w) >= 2,
    )

STOPWORDS = ("the", "and", "for", "self", "def", "return", "import", "from", "class", "let", "var", "const", "fn", "pub", "if", "else", "in", "of", "to", "is")


def split_identifier(name: Column) -> Column:
    """Words of an identifier, lower case: snake and camel boundaries, acronyms kept; a single-letter prefix stays on."""
    s = F.regexp_replace(name, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{Lu}{2,})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def code_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of all identifiers of 2 bytes or more that are no stopwords, with repetitions."""
    parts = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0), split_identifier))
    return F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*stopwords))


def names_match(candidate: Column, target: Column) -> Column:
    """Equal, or equal in the last segment after . or ::, either way round."""
    last = lambda c: F.element_at(F.split(c, r"\.|::"), -1)
    return (candidate == target) | (last(candidate) == target) | (candidate == last(target))


def escape_cell(c: Column) -> Column:
    """Backslash, tab, CR and LF escaped for a tab-separated cell."""
    for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def naming_style(c: Column) -> Column:
    """screaming, snake, pascal, camel, kebab, lower or other."""
    return (
        F.when(c.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$|^[A-Z]{2,}[0-9]*$"), "screaming").when(c.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(c.rlike(r"^[A-Z][A-Za-z0-9]*$"), "pascal").when(c.rlike(r"^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel")
        .when(c.rlike(r"^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab").when(c.rlike(r"^[a-z][a-z0-9]*$"), "lower").otherwise("other")
    )


#: Words that lead to nothing in particular.
NOISE = ("a", "an", "and", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "this", "to", "with", "self", "cls")
#: Verbs that begin most documentation.
VERBS = ("add", "adds", "check", "checks", "create", "creates", "get", "gets", "make", "makes", "return", "returns", "set", "sets")


def triggers(name: Column, doc: Column) -> Column:
    """Words of an identifier and of its documentation's first line, each once, noise and common verbs of the latter left out."""
    said = F.filter(F.transform(F.split(F.trim(F.split(F.coalesce(doc, F.lit("")), "\n")[0]), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))), lambda w: ~w.isin(*VERBS))
    return F.array_distinct(F.filter(F.concat(split_identifier(name), said), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*NOISE)))


def snippet(content: Column, terms: Column) -> Column:
    """struct(first, last, text): the line that holds most of the terms, whatever their case, with its neighbours; of equals the first."""
    ls = F.split(F.coalesce(content, F.lit("")), "\r?\n")
    score = lambda line: F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t)))
    best = F.array_max(F.transform(ls, lambda line, i: F.struct(score(line).alias("s"), (-i).alias("i"))))
    at = -best["i"]
    first, last = F.greatest(at - 1, F.lit(0)) + 1, F.least(at + 2, F.size(ls))
    return F.struct(first.alias("first"), last.alias("last"), F.array_join(F.slice(ls, first, last - first + 1), "\n").alias("text"))


def strip_strings(line: Column) -> Column:
    """String literals of one line become empty ones."""
    return F.regexp_replace(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', '""'), r"'(?:[^'\\]|\\.)*'", "''")


def strip_comment(line: Column, mark: str = "#") -> Column:
    """The line before a comment mark that stands outside string literals, without blanks at its end."""
    m = "".join("\\" + c for c in mark)
    code = F.regexp_extract(line, rf"""^((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|(?!{m}).)*)""", 1)
    return F.rtrim(code)


def truncate_bytes(c: Column, most: int, at_end: bool = False) -> Column:
    """As many whole characters from the start, or to the end, as fit into so many UTF-8 bytes."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    chars = F.reverse(chars) if at_end else chars
    fits = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda s, x: F.when(s["b"] + F.octet_length(x) <= most, F.struct((s["n"] + 1).alias("n"), (s["b"] + F.octet_length(x)).alias("b"))).otherwise(F.struct(s["n"].alias("n"), F.lit(most + 1).alias("b"))))["n"]
    kept = F.slice(chars, 1, fits)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.array_join(F.reverse(kept) if at_end else kept, ""))


def rolling_hashes(tokens: Column, width: int) -> Column:
    """A hash of each run of so many neighbouring tokens, in order; none where there are fewer."""
    n = F.size(tokens) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(tokens, i + 1, width)))).otherwise(F.array().cast("array<bigint>"))


#: Folders and names of generated files.
GENERATED_FOLDERS = ("vendor", "node_modules", "__pycache__", "dist", "build", "target", "gen", "generated", ".gen", "third_party", "external")
GENERATED_NAMES = (r"\.pb\.(go|ts|cc|h)$", r"_pb2(_grpc)?\.pyi?$", r"\.(generated|graphql|gen)\.[A-Za-z]+$", r"_generated\.[A-Za-z]+$", r"Generated\.[A-Za-z]+$", r"\.min\.(js|css)$")


def is_generated(path: Column) -> Column:
    """In a folder of generated or foreign code, or named like a generator's output."""
    folders = "|".join(x.replace(".", r"\.") for x in GENERATED_FOLDERS)
    return path.rlike(rf"(^|/)({folders})/") | path.rlike("|".join(GENERATED_NAMES))


def glob_to_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".^$+{}[]()|\\" else c)
            i += 1
    return f"^{out}$"
