"""Text preparation and per-file metrics as column functions. No pattern here repeats a group over unbounded text: java.util.regex would recurse once a repetition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, spelled out for java.util.regex and RE2.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A line that begins with // or /* or ends with */, but for white space: one match a line, as the first branch takes all of it.
COMMENT_LINE = rf"(?md)^[{WS}&&[^\n]]*+/[/*][^\n]*+|\*/[{WS}&&[^\n]]*+$"
#: Quoted strings (closed by a quote that no backslash stands before), comments, plain stretches.
_PIECES = r"""(?s)(?<!\\)"(?:.*?(?<!\\)"|.*\z)|(?<!\\)'(?:.*?(?<!\\)'|.*\z)|/\*(?:.*?\*/|.*\z)|//[^\n]*|[^"'/]+|."""
FUNCTION = r"(?m)^\s*\w[\w\s]*\*?\s*\w+\s*\([^)]*\)\s*\{"
BRANCHES, JUMPS, TERNARY = r"\b(?:if|while|for|switch|case)\b", r"\b(?:goto|break|continue|return)\b", r"[?:]"


#: A function's head up to its opening parenthesis, from the first line of a stretch of word characters and blanks (a later line of it can't match if the first doesn't). The stretch is taken as a whole, so a text is read once.
_HEAD = r"\s*+\w(?:\s*+\w[\w\s]*+|[\w\s]*+\*\s*+\w++\s*+)\("
_LINE_START = r"[^\w\s][\w\s&&[^\n]]*+\n"


def let(value: Column, body) -> Column:
    """body(value), with value computed once although lambdas in body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def function_count(code: Column) -> Column:
    """Matches of FUNCTION, in time that is linear in the text: a match holds one closing parenthesis, so between two of them there is at most one, and only where a brace follows the second."""
    first, later = rf"(?:\A|{_LINE_START}){_HEAD}", rf"(?:\A[\w\s&&[^\n]]*+\n|{_LINE_START}){_HEAD}"
    found = let(F.split(code, r"\)"), lambda parts: F.filter(parts, lambda p, k: F.coalesce(F.get(parts, k + 1).rlike(r"\A\s*\{"), F.lit(False)) & F.when(k == 0, p.rlike(first)).otherwise(p.rlike(later))))
    return F.size(found).cast("long")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def decoded(content: Column) -> Column:
    """Bytes as text: bad UTF-8 replaced, line ends folded, NUL dropped."""
    return F.replace(F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n"), F.lit("\0"), F.lit(""))


def remove_comments(text: Column) -> Column:
    """Block comments, then line comments; an unclosed block stays."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def comments_by_line(text: Column) -> Column:
    """Line comments first, then block comments, as the file metrics see code."""
    return F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def remove_comments_safe(text: Column) -> Column:
    """Comments outside quotes: a block becomes a blank, a line comment goes, an unclosed block takes the rest."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("/*"), " ").when(x.startswith("//"), "").otherwise(x)), "")


def normalize_whitespace(text: Column) -> Column:
    t = F.regexp_replace(text, f"{WS}+", " ")
    t = F.regexp_replace(t, r" *([{}();,]) *", "$1")
    return strip(F.regexp_replace(t, r" *([=+\-*/%<>!&|^]) *", " $1 "))


def preprocess(text: Column) -> Column:
    return normalize_whitespace(F.replace(remove_comments_safe(text), F.lit("\0"), F.lit("")))


def folded(text: Column) -> Column:
    """The form in which duplicates are compared."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def format_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / F.lit(float(1024**4)))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(n < float(1024 ** (k + 1)), F.format_string(f"%.1f {unit}", n / F.lit(float(1024**k)))).otherwise(out)
    return out


def file_metrics(df, text: str = "text"):
    """df with the per-file metrics; one projection for the comment-free code, one for the counts."""
    t, code = F.col(text), F.col("_code")
    lines = F.split(t, "\n")
    bare = F.transform(lines, strip)
    note = lambda x: x.startswith("//") | x.startswith("/*") | x.endswith("*/")
    df = df.withColumns({"_code": comments_by_line(t), "_lines": lines, "_bare": bare})
    return df.withColumns(
        {
            "size_bytes": F.octet_length(t).cast("long"),
            "lines_total": F.size("_lines").cast("long"),
            "lines_blank": F.size(F.filter("_bare", lambda x: x == "")).cast("long"),
            "lines_comments": F.size(F.filter("_bare", lambda x: (x != "") & note(x))).cast("long"),
            "lines_code": F.size(F.filter("_bare", lambda x: (x != "") & ~note(x))).cast("long"),
            "max_line_length": F.array_max(F.transform("_lines", F.length)).cast("long"),
            "functions": function_count(code),
            "non_ascii_chars": F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")).cast("long"),
            "has_includes": t.contains("#include"),
            "complexity": count(code, BRANCHES) + count(code, JUMPS) + count(code, TERNARY),
        }
    ).drop("_code", "_lines", "_bare")


def file_quality(df, text: str = "text"):
    """df with size, share of comment lines, mean line length and encoding; a file that couldn't be read (null) has zeros and an unknown encoding."""
    t = F.col(text)
    n = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    notes = F.when(t.contains("//") | t.contains("/*") | t.contains("*/"), count(t, COMMENT_LINE)).otherwise(0)
    return df.withColumns(
        {
            "file_size": F.coalesce(F.octet_length(t), F.lit(0)).cast("long"),
            "comment_ratio": F.when(t.isNull(), 0.0).otherwise(notes / n),
            "avg_line_length": F.when(t.isNull(), 0.0).otherwise((F.length(t) - n + 1) / n),  # all but the line ends
            "encoding": F.when(t.isNull(), "unknown").otherwise("utf-8"),
        }
    )
