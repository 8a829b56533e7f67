"""Checks, labels and detections on code as column functions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count, let

# ---- fixed values: what results depend on ----
KEYWORDS = "auto break case char const continue default do double else enum extern float for goto if int long register return short signed sizeof static struct switch typedef union unsigned void volatile while".split()
CONTROL_WORDS = "if else for while switch case break continue return".split()
OPERATORS = "++ -- + - * / % = == != < > <= >= && || ! & | ^ ~ << >> += -= *= /= %= &= |= ^= <<= >>=".split()
DECLARATION = r"((?:const\s+)?(?:static\s+)?(?:extern\s+)?(?:int|char|float|double|void|long|short|unsigned|signed)\s*\*?\s+\w+(?:\s*=\s*[^;]+)?;)"
SIGNATURE = r"(\w+\s+)(\w+)\s*\([^)]*\)\s*\{"
STRING, STRING_RE2 = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r'"(?:[^"\\]|\\.)*"'
MACRO = r"#define\s+\w+(?:\([^)]*\))?\s+[^\n]*"
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"
AST_SHAPES = [r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\w+\s*\([^)]*\)\s*\{", r"\w+\s*="]
VULNERABILITIES = {
    "sql_injection": [r"""execute\s*\(\s*["'].*?\+.*?["']""", r"""execute\s*\(\s*["'].*?%.*?["']""", r"""execute\s*\(\s*f["'].*?\{.*?\}.*?["']""", r"cursor\.execute\s*\([^)]*\+", r"""query\s*=\s*["'].*?\+.*?["']"""],
    "command_injection": [r"os\.system\s*\([^)]*\+", r"subprocess\.call\s*\([^)]*\+", r"eval\s*\([^)]*\+", r"exec\s*\([^)]*\+", r"popen\s*\([^)]*\+"],
    "buffer_overflow": [r"strcpy\s*\([^)]*\)", r"strcat\s*\([^)]*\)", r"gets\s*\([^)]*\)", r"scanf\s*\([^)]*\)", r"sprintf\s*\([^)]*\)"],
    "xss": [r"innerHTML\s*=\s*[^;]*\+", r"outerHTML\s*=\s*[^;]*\+", r"document\.write\s*\([^)]*\+", r"eval\s*\([^)]*\+"],
    "path_traversal": [r"open\s*\([^)]*\.\./", r"file\s*\([^)]*\.\./", r"read_file\s*\([^)]*\.\./", r"include\s*\([^)]*\.\./"],
    "hardcoded_credentials": [r"""password\s*=\s*["'][^"']+["']""", r"""api_key\s*=\s*["'][^"']+["']""", r"""secret\s*=\s*["'][^"']+["']""", r"""token\s*=\s*["'][^"']+["']"""],
    "weak_crypto": [r"md5\s*\([^)]*\)", r"sha1\s*\([^)]*\)", r"hashlib\.md5", r"hashlib\.sha1", r"Crypto\.Cipher\.DES", r"Crypto\.Cipher\.RC4"],
    "insecure_deserialization": [r"pickle\.loads\s*\([^)]*\)", r"cPickle\.loads\s*\([^)]*\)", r"marshal\.loads\s*\([^)]*\)", r"yaml\.load\s*\([^)]*\)"],
}
HEURISTICS = {
    "dangerous_functions": (r"\b(exec|eval|system|shell_exec|passthru|proc_open|popen|subprocess\.call|os\.system)\s*\(", 2),
    "file_inclusion": (r"\b(include|require|include_once|require_once)\s*\([^)]*\$", 2),
    "sql_injection_heuristic": (r"(select|insert|update|delete)\s+from\s+\w+\s+where.*?[\+\%]", 3),
    "hardcoded_secrets": (r"""(password|secret|key|token|api_key|private_key)\s*=\s*["'][^"']{6,}["']""", 2),
    "weak_random": (r"\b(random|rand|mt_rand)\s*\(", 1),
    "file_operations": (r"\b(fopen|file_get_contents|readfile|file_put_contents)\s*\([^)]*\$", 1),
    "header_injection": (r"\b(header|setcookie)\s*\([^)]*\$", 2),
    "ldap_injection": (r"\b(ldap_search|ldap_query)\s*\([^)]*\$", 2),
    "xpath_injection": (r"\b(xpath|xpath_query)\s*\([^)]*\$", 2),
    "xxe": (r"\b(DOMDocument|SimpleXMLElement|xml_parser_create)\s*\(", 2),
}
INPUTS, SANITIZERS = r"\$_GET|\$_POST|\$_REQUEST|\$_COOKIE", r"htmlspecialchars|strip_tags|addslashes|mysql_real_escape_string"
SESSION, SESSION_SAFE = r"session_start\(\)", r"session_regenerate_id|session_set_cookie_params"
COMMON_KEYWORDS = "int char float double void if else for while return".split()
LABELS = "FunctionDefinition FunctionDeclaration Parameter FunctionCall VariableDeclaration VariableAssignment VariableReference TypeSpecifier Typedef StructDefinition UnionDefinition EnumDefinition IfStatement ElseStatement SwitchStatement CaseStatement ForLoop WhileLoop DoWhileLoop ReturnStatement BreakStatement ContinueStatement GotoStatement BinaryExpression UnaryExpression TernaryExpression AssignmentExpression IntegerLiteral FloatLiteral CharacterLiteral StringLiteral IncludeDirective DefineDirective ConditionalDirective Comment Other".split()
WORD_LABELS = [
    ("TypeSpecifier", "int char float double void long short unsigned signed"), ("Typedef", "typedef"), ("StructDefinition", "struct"), ("UnionDefinition", "union"), ("EnumDefinition", "enum"), ("IfStatement", "if"), ("ElseStatement", "else"),
    ("SwitchStatement", "switch"), ("CaseStatement", "case"), ("ForLoop", "for"), ("WhileLoop", "while"), ("DoWhileLoop", "do"), ("ReturnStatement", "return"), ("BreakStatement", "break"), ("ContinueStatement", "continue"), ("GotoStatement", "goto"),
    ("IncludeDirective", "#include"), ("DefineDirective", "#define"), ("ConditionalDirective", "#if #ifdef #ifndef #else #endif"),
]
OPERATOR_LABELS = [("BinaryExpression", "+ - * / % << >> & | ^"), ("UnaryExpression", "++ -- ! ~"), ("AssignmentExpression", "= += -= *= /= %= <<= >>= &= |= ^="), ("TernaryExpression", "?")]
# ---- end of fixed values ----

IDENTIFIER_WORD = rf"\b{IDENTIFIER}\b"
#: What every detection holds: one of these names before a parenthesis or an equals sign, a superglobal, a statement's verb before "from", or a module's name.
CALLED = "exec execute eval system popen proc_open shell_exec passthru call strcpy strcat gets scanf sprintf write open file include include_once require require_once md5 sha1 loads load random rand file_get_contents readfile file_put_contents header setcookie ldap_search ldap_query xpath xpath_query DOMDocument SimpleXMLElement xml_parser_create session_start".split()
ASSIGNED, VERBS = "query innerHTML outerHTML password api_key secret token key".split(), "select insert update delete".split()
SUPERGLOBAL, MODULES = r"(?i)\$_(?:GET|POST|REQUEST|COOKIE)", ("hashlib.", "crypto.cipher.")
_backward = lambda names: "(?:" + "|".join(n[::-1] for n in names) + ")"
#: For the text read from its end: it begins with the rare sign, so most places fail at once, whereas names first would all be tried at each place.
GATE_BACKWARD = rf"(?i)\(\s*+{_backward(CALLED)}|=\s*+{_backward(ASSIGNED)}"
VERB_BACKWARD = rf"(?i)\smorf\s++{_backward(VERBS)}"

#: Tokens of C, longest operators first; comments, directives with the lines that continue them and assembler blocks are skipped, as a parser's hidden channel does.
C_TOKEN = r"""(?s)/\*.*?\*/|//[^\n]*|#(?:[^\n]*\\\r?\n)*+[^\n]*|asm[^{]*\{[^}]*\}|(?:u8|[uUL])?"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|[uUL]?'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|[A-Za-z_][A-Za-z0-9_]*|\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*+|\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){}\[\]]"""
C_TOKEN_RE2 = C_TOKEN.replace("*+", "*")


def literal_count(text: Column, op: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(op), F.lit("")))) / len(op)).cast("long")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def lost(original: Column, processed: Column, pattern: str, group: int = 0) -> Column:
    return F.array_except(_all(original, pattern, group), _all(processed, pattern, group))


def lost_signatures(o: Column, p: Column) -> Column:
    pairs = lambda t: F.zip_with(_all(t, SIGNATURE, 1), _all(t, SIGNATURE, 2), lambda a, b: F.concat(a, F.lit("|"), b))
    return F.array_except(pairs(o), pairs(p))


def control_changes(o: Column, p: Column) -> Column:
    return F.array_compact(F.array(*[F.when(count(o, rf"\b{w}\b") != count(p, rf"\b{w}\b"), F.lit(w)) for w in CONTROL_WORDS]))


def operator_changes(o: Column, p: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.abs(literal_count(o, op) - literal_count(p, op)) > 1, F.lit(op)) for op in OPERATORS]))


def semantic_issues(o: Column, p: Column) -> Column:
    """ARRAY<STRUCT<severity, check, detail>> of what processing lost."""
    issue = lambda severity, check: lambda x: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), x.alias("detail"))
    strings = F.when(F.size(_all(o, STRING)) != F.size(_all(p, STRING)), F.array(F.lit("string count"))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        F.transform(lost_signatures(o, p), issue("critical", "signature")),
        F.transform(lost(o, p, DECLARATION, 1), issue("warning", "declaration")),
        F.transform(control_changes(o, p), issue("critical", "control")),
        F.transform(F.concat(strings, lost(o, p, STRING)), issue("warning", "string")),
        F.transform(lost(o, p, MACRO), issue("critical", "macro")),
        F.transform(operator_changes(o, p), issue("warning", "operator")),
    )


def lost_identifiers(o: Column, p: Column) -> Column:
    words = F.array(*[F.lit(k) for k in KEYWORDS])
    gone = F.array_except(F.array_except(_all(o, IDENTIFIER), words), _all(p, IDENTIFIER))
    return F.array_sort(F.filter(gone, lambda x: (F.length(x) > 2) & ~x.startswith("_")))


def brace_balance(text: Column) -> Column:
    """Opening minus closing braces, parentheses and brackets."""
    return F.struct(*[(literal_count(text, a) - literal_count(text, b)).alias(n) for n, a, b in (("curly", "{", "}"), ("round", "(", ")"), ("square", "[", "]"))])


def plain_identifiers(text: Column) -> Column:
    """Distinct identifiers but for the ten commonest keywords."""
    return F.array_except(_all(text, IDENTIFIER_WORD), F.array(*[F.lit(k) for k in COMMON_KEYWORDS]))


def may_be_vulnerable(text: Column) -> Column:
    """Whether any detection can match at all: each needs a call, an assignment, a superglobal, a statement or a module's name. Literals first, which most prose fails."""
    lower, back = F.lower(text), F.reverse(text)
    named = (text.contains("(") | text.contains("=")) & back.rlike(GATE_BACKWARD)
    verb = lower.contains("from") & reduce(lambda a, b: a | b, [lower.contains(v) for v in VERBS]) & back.rlike(VERB_BACKWARD)
    return named | (text.contains("$_") & text.rlike(SUPERGLOBAL)) | verb | reduce(lambda a, b: a | b, [lower.contains(m) for m in MODULES])


def family_counts(text: Column) -> dict[str, Column]:
    return {name: _total(count(text, f"(?i)(?m){p}") for p in patterns) for name, patterns in VULNERABILITIES.items()}


def heuristic_counts(text: Column) -> dict[str, Column]:
    return {name: count(text, f"(?i){p}") for name, (p, _) in HEURISTICS.items()}


def context_checks(text: Column) -> dict[str, Column]:
    has = lambda p: text.rlike(f"(?i){p}")
    return {"missing_input_validation": (has(INPUTS) & ~has(SANITIZERS)).cast("long"), "weak_session_management": (has(SESSION) & ~has(SESSION_SAFE)).cast("long")}


def detected(text: Column) -> Column:
    """Names of all detections, each as often as it matches; empty for a null text."""
    names = [F.array_repeat(F.lit(n), c.cast("int")) for n, c in [*family_counts(text).items(), *heuristic_counts(text).items(), *context_checks(text).items()]]
    return F.when(F.coalesce(may_be_vulnerable(text), F.lit(False)), F.concat(*names)).otherwise(F.array().cast("array<string>"))


def vulnerability_score(text: Column) -> Column:
    """Matches of all families, weighted heuristics and context checks; 0 for a null text."""
    parts = [*family_counts(text).values(), *[HEURISTICS[n][1] * c for n, c in heuristic_counts(text).items()], *context_checks(text).values()]
    return F.when(F.coalesce(may_be_vulnerable(text), F.lit(False)), _total(parts)).otherwise(F.lit(0)).cast("long")


def c_tokens(text: Column) -> Column:
    return F.filter(_all(text, C_TOKEN), lambda x: ~(x.startswith("//") | x.startswith("/*") | x.startswith("#") | (x.startswith("asm") & x.contains("{"))))


def token_label(t: Column) -> Column:
    """The first label whose rule a token meets."""
    no = {name: k for k, name in enumerate(LABELS)}
    plain = F.replace(F.replace(t, F.lit("_"), F.lit("")), F.lit("."), F.lit(""))
    out = F.when(F.lit(False), F.lit(-1))
    for name, words in WORD_LABELS:
        out = out.when(t.isin(*words.split()), F.lit(no[name]))
    out = out.when(t.startswith('"') & t.endswith('"'), no["StringLiteral"]).when(t.startswith("'") & t.endswith("'"), no["CharacterLiteral"])
    out = out.when(plain.rlike("^[0-9]+$"), no["IntegerLiteral"]).when(F.regexp_replace(plain, "[fFlL]", "").rlike("^[0-9]+$"), no["FloatLiteral"])
    for name, ops in OPERATOR_LABELS:
        out = out.when(t.isin(*ops.split()), F.lit(no[name]))
    return out.when(F.replace(t, F.lit("_"), F.lit("")).rlike("^[A-Za-z0-9]+$"), no["VariableReference"]).otherwise(no["Other"])


def label_map() -> dict[str, int]:
    """Each label's number."""
    return {name: k for k, name in enumerate(LABELS)}


def ast_similarity(a: Column, b: Column) -> Column:
    def part(p: str) -> Column:
        x, y = count(a, p), count(b, p)
        return F.when(x + y > 0, 2.0 * F.least(x, y) / (x + y)).otherwise(0.0)

    return _total(part(p) for p in AST_SHAPES) / len(AST_SHAPES)


# ---- tokenizers ----
def characters(text: Column) -> Column:
    """The characters of a text that isn't empty; an empty one gives one empty sign."""
    return F.split(text, "")


def char_tokens(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(characters(text))


def char_ids(tokens: Column) -> Column:
    """Five special tokens, then the ASCII codes; anything else is unknown (0)."""
    return F.transform(tokens, lambda c: F.when(F.ascii(c) < 128, F.ascii(c) + 5).otherwise(0))


def ascii_seen(characters: Column) -> tuple[Column, Column]:
    """The ASCII codes among few distinct characters, as the bits of two longs (codes below 64, the others)."""
    bit = lambda c, first: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) - first)
    bits = lambda first: F.aggregate(characters, F.lit(0).cast("long"), lambda seen, c: F.when((c != "") & F.ascii(c).between(first, first + 63), seen.bitwiseOR(bit(c, first))).otherwise(seen))
    return bits(0), bits(64)


def unknown_folded(text: Column) -> Column:
    """The text with one and the same sign for each character that has no id of its own: equal for texts of equal ids."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(text, r"[^\x00-\x7F]", "\x80"))


def keychar_tokens(text: Column) -> Column:
    words = "|".join(sorted(KEYWORDS, key=lambda w: (-len(w), w)))
    return _all(text, rf"(?s)(?:{words})(?![\p{{L}}\p{{N}}_])|.")


def keychar_ids(tokens: Column) -> Column:
    at = F.create_map(*[F.lit(v) for k, w in enumerate(sorted(KEYWORDS)) for v in (w, 133 + k)])
    return F.transform(tokens, lambda c: F.coalesce(F.when(F.length(c) > 1, F.try_element_at(at, c)), F.when(F.ascii(c) < 128, F.ascii(c) + 5), F.lit(0)))


FAN = 32


def _starts(lengths: Column, levels: int = 4) -> Column:
    """Sum of all earlier lengths, for each place: from sums over runs of FAN, FAN^2 and so on, not over all earlier places."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def runs(xs: Column) -> Column:
        n = F.ceil(F.size(xs) / F.lit(FAN)).cast("int")
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda g: add(F.slice(xs, g * FAN + 1, F.lit(FAN))))

    def before(xs: Column, left: int) -> Column:
        if not left:
            return F.transform(xs, lambda x, i: add(F.slice(xs, F.lit(1), i)))
        return let(F.when(F.size(xs) > FAN, runs(xs)).otherwise(F.array().cast("array<int>")), lambda up: let(
            F.when(F.size(up) > 0, before(up, left - 1)).otherwise(F.array(F.lit(0))),
            lambda base: F.transform(xs, lambda x, i: F.get(base, F.floor(i / FAN).cast("int")) + add(F.slice(xs, i - i % FAN + 1, i % FAN))),
        ))

    return let(lengths, lambda xs: before(xs, levels))


def spans(tokens: Column) -> Column:
    """(token, start, end) with running offsets."""
    kind = "array<struct<token:string,start:int,end:int>>"
    return let(tokens, lambda ts: F.zip_with(ts, _starts(F.transform(ts, lambda x: F.length(x))), lambda x, s: F.struct(x.alias("token"), s.alias("start"), (s + F.length(x)).alias("end"))).cast(kind))


def encoded(ids: Column, length: int, pad: int = 0) -> tuple[Column, Column]:
    """ids cut and padded to ``length``, and the mask of real places."""
    cut = F.slice(ids, 1, length)
    fill = F.greatest(F.lit(length) - F.size(cut), F.lit(0))
    return F.concat(cut, F.array_repeat(F.lit(pad), fill)), F.concat(F.transform(cut, lambda x: F.lit(1)), F.array_repeat(F.lit(0), fill))


def ids_from(tokens: Column, vocabulary: dict[str, int], unknown: str = "[UNK]") -> Column:
    """Each token's id, or the unknown token's."""
    at = F.create_map(*[F.lit(v) for kv in vocabulary.items() for v in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(at, t), F.lit(vocabulary[unknown])))


def tokens_from(ids: Column, vocabulary: dict[str, int], unknown: str = "[UNK]") -> Column:
    """Each id's token, or the unknown token."""
    at = F.create_map(*[F.lit(v) for t, k in vocabulary.items() for v in (k, t)])
    return F.transform(ids, lambda k: F.coalesce(F.try_element_at(at, k), F.lit(unknown)))


def detokenized(tokens: Column) -> Column:
    """Tokens of characters and keywords stand side by side, as in the text."""
    return F.array_join(tokens, "")


SPECIAL = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")


def char_vocabulary() -> dict[str, int]:
    return {t: k for k, t in enumerate([*SPECIAL, *map(chr, range(128))])}


def keychar_vocabulary() -> dict[str, int]:
    return {t: k for k, t in enumerate([*char_vocabulary(), *sorted(KEYWORDS)])}


def tokenizer(kind: str, vocab_file: str | None = None, model_file: str | None = None):
    """(tokens of a text column, ids of a token column) of a kind of tokenizer; a piece tokenizer works on frames (operators.tokenizers) and has none here."""
    from ..plans.arguments import check_tokenizer

    check_tokenizer(kind, vocab_file, model_file)
    if kind == "spe":
        raise ValueError("piece tokens are made by operators.tokenizers.piece_spans")
    return (char_tokens, char_ids) if kind == "char" else (keychar_tokens, keychar_ids)


def label_vector(labels: Column, length: int, other: int, ignore: int = -100) -> Column:
    """Labels cut to leave room for one special place at each end, which get ``other``; the rest is ignored."""
    body = F.concat(F.array(F.lit(other)), F.slice(labels, 1, length - 2), F.array(F.lit(other)))
    return F.concat(body, F.array_repeat(F.lit(ignore), F.greatest(F.lit(length) - F.size(body), F.lit(0))))


def repeated_label(ids: Column, label: Column, pad: int, ignore: int = -100) -> Column:
    """The label at each real place, ignored at padding."""
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(ignore)).otherwise(label))


def labels_or_other(text: Column) -> Column:
    """Labels of the C tokens; where none is found, one ``Other`` for each word."""
    from .text import WS

    found, other = F.transform(c_tokens(text), token_label), F.lit(LABELS.index("Other"))
    return F.when(F.size(found) > 0, found).otherwise(F.transform(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""), lambda w: other))


def context(tokens: Column, around: int = 2) -> Column:
    """Each token with the one before and those up to ``around`` places away, itself included."""
    return let(tokens, lambda ts: F.transform(ts, lambda t, i: F.struct(t.alias("token"), F.get(ts, i - 1).alias("before"), F.slice(ts, F.greatest(i - around + 1, F.lit(1)), F.lit(around + 1) + F.least(i, F.lit(around))).alias("near"))))


def overlapping(spans_: Column, others: Column) -> Column:
    """The spans (start, end) that overlap any of the others."""
    return F.filter(spans_, lambda s: F.exists(others, lambda o: F.greatest(s["start"], o["start"]) < F.least(s["end"], o["end"])))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_below(limit: float, *parts: Column) -> Column:
    """Whether ``uniform`` of the parts is below a limit: digits compare as the numbers that they write, so none is converted."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])) < f"{math.ceil(limit * 4294967296.0):08x}"
