"""Redaction, identifier masking, snippets, fingerprints: X6-X11, N2."""

from pyspark.sql import functions as F

from codeloom.functions import masking as K
from codeloom.functions import text as X
from codeloom.operators.findings import masked_nodes
from codeloom.plans.registry import query
from codeloom.plans.views import day_nodes, sql, table, view


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets_sql(text: str) -> str:
    for pattern, label in K.SECRET_PATTERNS:
        text = f"regexp_replace({text}, {_q(pattern)}, '<REDACTED_{label}>', 'gi')"
    return text


def urls_sql(text: str) -> str:
    return f"regexp_replace({text}, {_q(K.URL_PATTERN)}, '<REDACTED_URL>', 'gi')"


def tokens_sql(text: str) -> str:
    marked = f"regexp_replace({text}, {_q('(' + K.TOKEN_PATTERN + ')')}, chr(64976) || '\\1' || chr(64977), 'g')"
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(64976)), lambda p, i: CASE WHEN i = 1 THEN p ELSE "
        "'<REDACTED_TOKEN_' || CAST(strpos(p, chr(64977)) - 1 AS VARCHAR) || '>' || substr(p, strpos(p, chr(64977)) + 1) END), '')"
    )


def mask_sql(text: str) -> str:
    return tokens_sql(urls_sql(secrets_sql(text)))


# Texts with one secret of every kind: the documents hold few, so each is given one by its number.
_PLANTED = (
    "CASE doc_id % 14 WHEN 0 THEN 'api_key = \"' || repeat('Ab1', 8) || '\" ' WHEN 1 THEN 'SECRET-KEY: ' || repeat('z9', 12) || ' ' "
    "WHEN 2 THEN 'password=hunter' || repeat('2', 5) || ' ' WHEN 3 THEN 'token : ' || md5(text) || ' ' WHEN 4 THEN 'Bearer ' || repeat('a.b', 9) || ' ' "
    "WHEN 5 THEN 'jwt=' || repeat('q', 60) || ' ' WHEN 6 THEN '-----BEGIN RSA PRIVATE KEY----- ' WHEN 7 THEN '-----BEGIN EC PRIVATE KEY----- ' "
    "WHEN 8 THEN 'ssh-rsa AAAAB3Nza+/x ' WHEN 9 THEN 'AKIA' || repeat('Z', 16) || ' ' WHEN 10 THEN 'see https://x.test/a?b=c \"q\" ' "
    "WHEN 11 THEN repeat('tok-', 10) || 'end ' WHEN 12 THEN upper(md5(text)) || ' ' ELSE '' END || text"
)


def _planted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(_PLANTED).alias("text"))


@query(
    "redacted_secrets", "X6",
    f"WITH t AS (SELECT doc_id, {_PLANTED} AS text FROM documents) SELECT doc_id, {secrets_sql('text')} AS masked FROM t",
)
def redacted_secrets(spark, sf):
    return _planted(spark, sf).select("doc_id", K.redact_secrets(F.col("text")).alias("masked"))


@query("redacted_urls", "X7", f"SELECT page_id, {urls_sql('html || url')} AS masked FROM pages")
def redacted_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", K.redact_urls(F.concat("html", "url")).alias("masked"))


@query(
    "redacted_tokens", "X8",
    f"WITH t AS (SELECT doc_id, {_PLANTED} AS text FROM documents) SELECT doc_id, {tokens_sql('text')} AS masked FROM t",
)
def redacted_tokens(spark, sf):
    return _planted(spark, sf).select("doc_id", K.redact_tokens(F.col("text")).alias("masked"))


@query(
    "masked_texts", "X6 X7 X8",
    f"WITH t AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, {_PLANTED} AS text FROM documents UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), text FROM conversations "
    f"UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages) SELECT id, {mask_sql('text')} AS masked FROM t",
)
def masked_texts(spark, sf):
    texts = _planted(spark, sf).select(F.expr("'d' || CAST(doc_id AS STRING)").alias("id"), "text").unionByName(
        table(spark, sf, "conversations").select(F.expr("'c' || CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING)").alias("id"), "text")
    ).unionByName(table(spark, sf, "pages").select(F.expr("'p' || CAST(page_id AS STRING)").alias("id"), F.col("html").alias("text")))
    return texts.select("id", K.mask_text(F.col("text")).alias("masked"))


def hmac_sql(message: str, key: str) -> str:
    raw = key.encode().ljust(64, b"\0")
    inner = "".join(f"{b ^ 0x36:02x}" for b in raw)
    outer = "".join(f"{b ^ 0x5C:02x}" for b in raw)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


@query(
    "masked_identifiers", "X9",
    f"SELECT c_custkey, 'VAR_' || substr({hmac_sql('c_name', 'pepper')}, 1, 8) AS masked FROM customer",
)
def masked_identifiers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.mask_identifier(F.col("c_name"), "pepper").alias("masked"))


@query(
    "masked_graph_nodes", "X9 N2",
    sql("day_nodes") + f"SELECT id, 'VAR_' || substr({hmac_sql('symbol', 'pepper')}, 1, 8) AS symbol, {mask_sql('code')} AS code FROM day_nodes",
)
def masked_graph_nodes(spark, sf):
    return masked_nodes(day_nodes(spark, sf), "pepper").select("id", "symbol", "code")


_LINE = "CAST(1 + n_chars % 6 AS INT)"


@query(
    "masked_snippets", "X10",
    f"WITH t AS (SELECT doc_id, string_split({_PLANTED}, chr(10)) AS lines, {_LINE} AS line FROM documents), "
    "w AS (SELECT doc_id, lines[greatest(line - 1 - 2, 0) + 1 : least(line + 2, len(lines))] AS lines FROM t) "
    f"SELECT doc_id, array_to_string(list_transform(lines, lambda x: {mask_sql('x')}), chr(10)) AS snippet FROM w",
)
def masked_snippets(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.expr(_PLANTED).alias("text"), F.expr(_LINE).alias("line"))
    lines = X.line_window(F.col("text"), F.col("line"), F.col("line"), 2)
    return t.select("doc_id", K.masked_lines(lines).alias("snippet"))


@query(
    "fingerprints", "X11",
    sql("findings") + "SELECT finding_id, sha256(repo || ':' || rule_id || ':' || file || ':' || function_name || ':' || CAST(line AS VARCHAR)) AS fingerprint FROM findings",
)
def fingerprints(spark, sf):
    return view(spark, sf, "findings").select(
        "finding_id", K.fingerprint(*[F.col(c) for c in ("repo", "rule_id", "file", "function_name", "line")]).alias("fingerprint")
    )
