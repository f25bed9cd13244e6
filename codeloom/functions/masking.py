"""Redaction, identifier masking and fingerprints as column expressions."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secrets in the order they are replaced, each with the label left behind.
SECRET_PATTERNS = [
    (r'api[_-]?key["\']?\s*[:=]\s*["\']?([a-zA-Z0-9_\-]{20,})["\']?', "API_KEY"),
    (r'secret[_-]?key["\']?\s*[:=]\s*["\']?([a-zA-Z0-9_\-]{20,})["\']?', "SECRET_KEY"),
    (r'password["\']?\s*[:=]\s*["\']?([^\s"\']{8,})["\']?', "PASSWORD"),
    (r'token["\']?\s*[:=]\s*["\']?([a-zA-Z0-9_\-]{20,})["\']?', "TOKEN"),
    (r'bearer\s+([a-zA-Z0-9_\-\.]{20,})', "BEARER_TOKEN"),
    (r'jwt["\']?\s*[:=]\s*["\']?([a-zA-Z0-9_\-\.]{50,})["\']?', "JWT"),
    (r'-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----', "PRIVATE_KEY"),
    (r'-----BEGIN\s+EC\s+PRIVATE\s+KEY-----', "EC_PRIVATE_KEY"),
    (r'ssh-rsa\s+[A-Za-z0-9+/]+', "SSH_KEY"),
    (r'AKIA[0-9A-Z]{16}', "AWS_ACCESS_KEY"),
    (r'[0-9a-f]{32}', "MD5_HASH"),
]
URL_PATTERN = r'https?://[^\s"\']+'
TOKEN_PATTERN = r'\b[a-zA-Z0-9_\-]{32,}\b'

# Two code points that Unicode reserves as never being characters mark a token while it is counted.
_OPEN, _CLOSE = "﷐", "﷑"


def redact_secrets(text: Column) -> Column:
    # (?U) gives \s and \b the Unicode meaning they have in the rules.
    for pattern, label in SECRET_PATTERNS:
        text = F.regexp_replace(text, f"(?iU){pattern}", f"<REDACTED_{label}>")
    return text


def redact_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(?iU){URL_PATTERN}", "<REDACTED_URL>")


def redact_tokens(text: Column) -> Column:
    """Long tokens become <REDACTED_TOKEN_n> with n their length."""
    marked = F.regexp_replace(text, f"(?U)({TOKEN_PATTERN})", f"{_OPEN}$1{_CLOSE}")
    pieces = F.split(marked, _OPEN, -1)

    def piece(p, i):
        n = F.instr(p, _CLOSE)
        done = F.concat(
            F.lit("<REDACTED_TOKEN_"), (n - 1).cast("string"), F.lit(">"),
            F.substring(p, n + 1, F.length(p)),
        )
        return F.when(i == 0, p).otherwise(done)

    return F.array_join(F.transform(pieces, piece), "")


def mask_text(text: Column) -> Column:
    return redact_tokens(redact_urls(redact_secrets(text)))


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA-256 under a constant key."""
    raw = key.encode()
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in raw))
    outer = F.lit(bytearray(b ^ 0x5C for b in raw))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def mask_identifier(name: Column, salt: str) -> Column:
    if not salt:
        raise ValueError("identifier masking needs a salt")
    return F.concat(F.lit("VAR_"), F.left(hmac_sha256(name, salt), F.lit(8)))


def masked_lines(lines: Column) -> Column:
    """Lines masked one by one, joined again."""
    return F.array_join(F.transform(lines, mask_text), "\n")


def fingerprint(repo: Column, rule: Column, file: Column, function: Column, line: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (repo, rule, file, function, line)]
    return F.sha2(F.concat_ws(":", *parts), 256)
