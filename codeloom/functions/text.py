"""Scalar text functions: identifiers in commit messages, names, paths and spans."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vulnerability types with the phrases that name them, first hit wins.
VULNERABILITY_PHRASES: list[tuple[str, list[str]]] = [
    ("SQL Injection", [
        "sql injection", "sqli", "sql-injection", "sql_injection",
        "sql injection vulnerability", "sql injection fix",
        "parameterized query", "prepared statement", "raw sql", "execute(sql", "query(sql",
    ]),
    ("XSS", [
        "xss", "cross-site scripting", "cross site scripting", "xss vulnerability", "xss fix",
        "script injection",
    ]),
    ("Command Injection", [
        "command injection", "command-injection", "command_injection", "os.system", "subprocess",
        "shell injection", "cmd injection", "arbitrary command", "command execution",
    ]),
    ("Path Traversal", [
        "path traversal", "directory traversal", "path-traversal", "directory-traversal",
        "../", "..\\", "file path", "arbitrary file", "local file inclusion",
    ]),
    ("XXE", ["xxe", "xml external entity", "xml entity", "external entity injection"]),
    ("SSRF", [
        "ssrf", "server-side request forgery", "server side request forgery",
        "request forgery", "internal request",
    ]),
    ("CSRF", ["csrf", "cross-site request forgery", "cross site request forgery"]),
    ("Deserialization", [
        "deserialization", "pickle", "unsafe deserialization", "insecure deserialization",
        "yaml.load", "marshal.loads",
    ]),
    ("Authentication Bypass", [
        "authentication bypass", "auth bypass", "bypass authentication", "unauthorized access",
        "auth vulnerability",
    ]),
    ("Authorization Bypass", [
        "authorization bypass", "authorization vulnerability", "privilege escalation",
        "access control", "permission bypass",
    ]),
    ("Information Disclosure", [
        "information disclosure", "sensitive data exposure", "data leak", "information leak",
        "exposed credentials",
    ]),
    ("Cryptographic Weakness", [
        "cryptographic weakness", "weak cryptography", "weak encryption", "insecure random",
        "weak hash", "md5", "sha1", "weak crypto",
    ]),
    ("Buffer Overflow", [
        "buffer overflow", "buffer-overflow", "stack overflow", "heap overflow", "integer overflow",
    ]),
    ("Race Condition", [
        "race condition", "race-condition", "time-of-check", "toctou", "concurrent access",
    ]),
    ("Hardcoded Credentials", [
        "hardcoded", "hard-coded", "hard coded", "hardcoded credentials", "hardcoded secret",
        "hardcoded password",
    ]),
    ("Code Injection", [
        "code injection", "code-injection", "code_injection", "code execution",
        "arbitrary code execution", "eval vulnerability", "exec vulnerability",
        "eval()", "exec()", "compile()", "unsafe eval", "unsafe exec",
    ]),
    ("DoS", [
        "denial of service", "dos vulnerability", "dos attack", "resource exhaustion",
        "infinite loop", "redos", "regular expression denial of service",
    ]),
    ("Security Misconfiguration", [
        "security misconfiguration", "misconfiguration", "insecure configuration",
        "weak configuration",
    ]),
    ("Vulnerable Dependency", [
        "vulnerable dependency", "outdated dependency", "dependency vulnerability",
        "dependency update", "security update", "dependency bump",
    ]),
]

# Path parts that keep a file out of the safe corpus.
TEST_PATH_PARTS = ["test_", "_test.py", "tests/", "examples/"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def _first_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", F.upper(found))


def cve_id(text: Column) -> Column:
    return _first_match(text, r"(?i)CVE-\d{4}-\d{4,}")


def cwe_id(text: Column) -> Column:
    return _first_match(text, r"(?i)CWE-?\d{2,4}")


def vulnerability_type(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, words in VULNERABILITY_PHRASES:
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def reclassified_type(old: Column, description: Column) -> tuple[Column, Column]:
    """(type, original type): the original is kept only where the new one differs."""
    new = vulnerability_type(description)
    changed = new.isNotNull() & ~new.eqNullSafe(old)
    return F.when(changed, new).otherwise(old), F.when(changed, old)


def truncated_message(text: Column, limit: int = 500) -> Column:
    return F.substring(text, 1, limit)


def line_count(code: Column) -> Column:
    """Number of lines; a final line break does not open another line, an empty text has none."""
    breaks = F.size(F.split(code, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1))
    open_end = code.rlike("[\n\r\u000b\u000c\u001c-\u001e\u0085  ]\\z")
    return F.when(code == "", 0).when(open_end, breaks - 1).otherwise(breaks)


def whole_file_range(code: Column) -> Column:
    return F.struct(F.lit(1).alias("start_line"), line_count(code).alias("end_line"))


def call_name(code: Column) -> Column:
    """Dotted name of a call: arguments, outer blanks and trailing dots removed."""
    return F.rtrim(F.substring_index(F.trim(code), "(", 1), F.lit("."))


def call_base(code: Column) -> Column:
    """Everything before the last dot of a call's name; null without a dot."""
    head = F.substring_index(F.trim(code), "(", 1)
    parts = F.split(head, r"\.")
    kept = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ".")
    return F.when(F.contains(head, F.lit(".")), kept)


def attribute_name(code: Column) -> Column:
    """Attribute access without the method call it may end in."""
    head = F.substring_index(code, "(", 1)
    dots = F.split(head, r"\.")
    cut = F.array_join(F.slice(dots, 1, F.greatest(F.size(dots) - 1, F.lit(1))), ".")
    is_call = F.contains(code, F.lit("(")) & F.contains(head, F.lit("."))
    return F.trim(F.when(is_call, cut).otherwise(code))


def dotted_suffixes(name: Column, longest: int) -> Column:
    """The name's last 1..longest dotted parts, so that a suffix test becomes an equality."""
    return F.array_distinct(
        F.array(*[F.substring_index(name, ".", -n) for n in range(1, longest + 1)])
    )


def project_of(file: Column) -> Column:
    return F.when(F.contains(file, F.lit("/")), F.split_part(file, F.lit("/"), F.lit(1))).otherwise(
        "unknown"
    )


def is_test_path(path: Column) -> Column:
    return contains_any(path, TEST_PATH_PARTS)


def is_safe_corpus_file(
    path: Column, code: Column, min_size: int = 100, max_size: int = 50_000, min_lines: int = 10
) -> Column:
    return (
        F.octet_length(code).between(min_size, max_size)
        & (line_count(code) >= min_lines)
        & ~is_test_path(path)
    )


def owner_and_repo(url: Column, hosts: tuple[str, ...] = ("github.com", "www.github.com")) -> Column:
    """STRUCT<owner, repo> of a hosted repository address, null for any other address."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", "")
    parts = F.split(path, "/")
    ok = F.try_parse_url(url, F.lit("HOST")).isin(*hosts) & (F.size(parts) >= 2)
    return F.when(ok, F.struct(parts[0].alias("owner"), parts[1].alias("repo")))


def safe_file_name(path: Column, limit: int = 200) -> Column:
    return F.left(F.translate(path, "/\\ ", "___"), F.lit(limit))


def subject_repo(subject: Column) -> Column:
    """STRUCT<org, repo> of a subject like repo:org/name:..., null when it has another form."""
    parts = F.split(subject, ":")
    second = F.try_element_at(parts, F.lit(2))
    names = F.split(second, "/")
    ok = (F.size(parts) >= 2) & (parts[0] == "repo") & (F.size(names) == 2)
    return F.when(ok, F.struct(names[0].alias("org"), names[1].alias("repo")))


def job_key(repo: Column, commit: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", repo, commit), 256), F.lit(16))


def synthetic_commit(seed: Column) -> Column:
    return F.left(F.md5(seed), F.lit(16))


def span_text(code: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    """Text of a span: 1-based lines, 0-based columns, end column excluded."""
    lines = F.split(code, "\n", -1)
    n = F.size(lines)
    last = F.least(el, n)
    one = F.substring(F.element_at(lines, sl), sc + 1, F.greatest(ec - sc, F.lit(0)))
    first = F.substring(F.element_at(lines, sl), sc + 1, F.length(code))
    middle = F.slice(lines, sl + 1, F.greatest(last - sl - 1, F.lit(0)))
    tail = F.substring(F.element_at(lines, last), F.lit(1), ec)
    many = F.array_join(F.concat(F.array(first), middle, F.array(tail)), "\n")
    valid = (sl > 0) & (sl <= n) & (el > 0)
    return F.when(valid, F.when(sl == last, one).otherwise(many))


def line_window(code: Column, first: Column, last: Column, context: int) -> Column:
    """ARRAY of the lines first..last with some lines of context on both sides."""
    lines = F.split(code, "\n", -1)
    start = F.greatest(first - 1 - context, F.lit(0))
    stop = F.least(last + context, F.size(lines))
    return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))
