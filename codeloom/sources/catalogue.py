"""The rule catalogue: taint sources, sanitizers and vulnerability patterns with their sinks."""

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Source rules.
SOURCES = [
    {"id": "SRC_ENV", "kinds": ["env"], "calls": ["os.getenv", "os.environ.get"]},
    {"id": "SRC_ARGPARSE", "kinds": ["cli"], "calls": ["argparse.ArgumentParser.parse_args"]},
    {
        "id": "SRC_FLASK_REQUEST", "kinds": ["http_request"], "frameworks": ["flask"],
        "attrs": [
            "flask.request.args", "flask.request.form", "flask.request.values",
            "flask.request.json", "flask.request.data", "flask.request.headers",
            "flask.request.cookies", "flask.request.get_json", "flask.request.view_args",
        ],
    },
    {
        "id": "SRC_DJANGO_REQUEST", "kinds": ["http_request"], "frameworks": ["django"],
        "attrs": [
            "request.GET", "request.POST", "request.body", "request.headers", "request.COOKIES",
            "request.META", "request.resolver_match.kwargs",
        ],
    },
    {
        "id": "SRC_FASTAPI_REQUEST", "kinds": ["http_request"], "frameworks": ["fastapi", "starlette"],
        "attrs": [
            "fastapi.Request.query_params", "fastapi.Request.path_params", "fastapi.Request.headers",
            "fastapi.Request.cookies", "fastapi.Request.client",
            "starlette.requests.Request.query_params", "starlette.requests.Request.path_params",
            "starlette.requests.Request.headers", "starlette.requests.Request.cookies",
        ],
        "calls": [
            "fastapi.Request.json", "fastapi.Request.body", "starlette.requests.Request.json",
            "starlette.requests.Request.body",
        ],
    },
]

# Sanitizer rules.
SANITIZERS = [
    {
        "id": "SAN_URL_ENCODE", "kind": "url_encode",
        "calls": ["urllib.parse.quote", "urllib.parse.quote_plus", "requests.utils.requote_uri"],
    },
    {
        "id": "SAN_HTML_ESCAPE", "kind": "html_escape",
        "calls": ["html.escape", "markupsafe.escape", "django.utils.html.escape", "bleach.clean"],
    },
    {
        "id": "SAN_SQL_PARAM", "kind": "sql_parameterization",
        "calls": ["sqlite3.Cursor.execute", "psycopg2.cursor.execute", "mysql.connector.cursor.execute"],
        "needs_parameters": True,
    },
    {"id": "SAN_JWT_VERIFY", "kind": "jwt_verify", "calls": ["jwt.decode"]},
]

_HTTP = ["SRC_FLASK_REQUEST", "SRC_DJANGO_REQUEST", "SRC_FASTAPI_REQUEST"]
_HTTP_ENV = [*_HTTP, "SRC_ENV"]
_DBAPI = {
    "id": "SINK_DBAPI_EXECUTE", "kind": "sql_exec",
    "calls": ["sqlite3.Cursor.execute", "psycopg2.cursor.execute", "mysql.connector.cursor.execute"],
}

# Patterns.
PATTERNS = [
    {
        "id": "SQLI_RAW_STRING_FORMAT", "owasp": "A03: Injection", "cwe": ["CWE-89"],
        "description": "SQL built by str.format / % formatting and executed via raw query APIs.",
        "sources": _HTTP, "sanitizers": ["SAN_SQL_PARAM"],
        "sinks": [_DBAPI, {"id": "SINK_SQLALCHEMY_TEXT", "kind": "sql_exec", "calls": ["sqlalchemy.text"]}],
    },
    {
        "id": "SQLI_RAW_STRING_CONCAT", "owasp": "A03: Injection", "cwe": ["CWE-89"],
        "description": "SQL built by '+' concatenation and executed via raw query APIs.",
        "sources": _HTTP, "sanitizers": ["SAN_SQL_PARAM"], "sinks": [_DBAPI],
    },
    {
        "id": "SQLI_RAW_FSTRING", "owasp": "A03: Injection", "cwe": ["CWE-89"],
        "description": "SQL built via f-string and executed via raw query APIs.",
        "sources": _HTTP, "sanitizers": ["SAN_SQL_PARAM"], "sinks": [_DBAPI],
    },
    {
        "id": "CMDI_SUBPROCESS_SHELL_TRUE", "owasp": "A03: Injection", "cwe": ["CWE-78"],
        "description": "subprocess call with shell=True where command is tainted.",
        "sources": _HTTP_ENV, "sanitizers": [],
        "sinks": [
            {
                "id": "SINK_SUBPROCESS", "kind": "cmd_exec",
                "calls": [
                    "subprocess.run", "subprocess.call", "subprocess.Popen",
                    "asyncio.create_subprocess_shell",
                ],
                "constraints": {"kwargs": {"shell": True}},
            }
        ],
    },
    {
        "id": "CMDI_OS_SYSTEM_TAINTED", "owasp": "A03: Injection", "cwe": ["CWE-78"],
        "description": "os.system / os.popen called with tainted input.",
        "sources": _HTTP_ENV, "sanitizers": [],
        "sinks": [
            {
                "id": "SINK_OS_SYSTEM", "kind": "cmd_exec",
                "calls": ["os.system", "os.popen", "os.execl", "os.execv"],
            }
        ],
    },
    {
        "id": "TEMPLATE_INJECTION_JINJA2_UNSAFE", "owasp": "A03: Injection", "cwe": ["CWE-94", "CWE-1336"],
        "description": "Jinja2 template constructed from tainted string and rendered.",
        "sources": _HTTP, "sanitizers": ["SAN_HTML_ESCAPE"],
        "sinks": [
            {
                "id": "SINK_JINJA2_TEMPLATE", "kind": "template_exec",
                "calls": ["jinja2.Template", "jinja2.Environment.from_string", "flask.render_template_string"],
            }
        ],
    },
    {
        "id": "XSS_MARKUPSAFE_MARKUP_TAINTED", "owasp": "A03: Injection", "cwe": ["CWE-79"],
        "description": "markupsafe.Markup constructed from tainted input (trusting user HTML).",
        "sources": _HTTP, "sanitizers": ["SAN_HTML_ESCAPE"],
        "sinks": [{"id": "SINK_MARKUPSAFE_MARKUP", "kind": "html_sink", "calls": ["markupsafe.Markup"]}],
    },
    {
        "id": "XSS_RAW_HTML_RESPONSE_TAINTED", "owasp": "A03: Injection", "cwe": ["CWE-79"],
        "description": "Tainted input written directly into HTML response construction.",
        "sources": _HTTP, "sanitizers": ["SAN_HTML_ESCAPE"],
        "sinks": [
            {
                "id": "SINK_HTML_RESPONSE", "kind": "html_sink",
                "calls": [
                    "flask.make_response", "flask.Response", "django.http.HttpResponse",
                    "starlette.responses.HTMLResponse",
                ],
            }
        ],
    },
    {
        "id": "SSRF_REQUESTS_URL_TAINTED", "owasp": "A10: SSRF", "cwe": ["CWE-918"],
        "description": "requests.* called with tainted URL.",
        "sources": _HTTP, "sanitizers": ["SAN_URL_ENCODE"],
        "sinks": [
            {
                "id": "SINK_REQUESTS", "kind": "http_client",
                "calls": [
                    "requests.get", "requests.post", "requests.put", "requests.delete", "requests.request",
                ],
            }
        ],
    },
    {
        "id": "SSRF_URLLIB_URL_TAINTED", "owasp": "A10: SSRF", "cwe": ["CWE-918"],
        "description": "urllib.request.urlopen called with tainted URL.",
        "sources": _HTTP, "sanitizers": ["SAN_URL_ENCODE"],
        "sinks": [{"id": "SINK_URLLIB", "kind": "http_client", "calls": ["urllib.request.urlopen"]}],
    },
    {
        "id": "SSRF_HTTPX_URL_TAINTED", "owasp": "A10: SSRF", "cwe": ["CWE-918"],
        "description": "httpx client called with tainted URL.",
        "sources": _HTTP, "sanitizers": ["SAN_URL_ENCODE"],
        "sinks": [
            {
                "id": "SINK_HTTPX", "kind": "http_client",
                "calls": [
                    "httpx.get", "httpx.post", "httpx.request", "httpx.Client.get",
                    "httpx.Client.post", "httpx.Client.request",
                ],
            }
        ],
    },
    {
        "id": "AUTHZ_MISSING_DECORATOR", "owasp": "A01: Broken Access Control", "cwe": ["CWE-285"],
        "description": "Endpoint missing authentication/authorization decorator (limited heuristic).",
        "sources": _HTTP, "sanitizers": [],
        "sinks": [{"id": "SINK_ENDPOINT_DEF", "kind": "endpoint"}],
    },
    {
        "id": "AUTHZ_DIRECT_OBJECT_REFERENCE_TAINTED", "owasp": "A01: Broken Access Control",
        "cwe": ["CWE-639"],
        "description": "Tainted object ID used directly in data access without ownership check (very limited heuristic).",
        "sources": _HTTP, "sanitizers": [],
        "sinks": [
            {
                "id": "SINK_DATA_ACCESS", "kind": "data_access",
                "calls": [
                    "sqlalchemy.orm.Query.get", "django.db.models.query.QuerySet.get",
                    "django.db.models.query.QuerySet.filter",
                ],
            }
        ],
    },
    {
        "id": "CRYPTO_WEAK_HASH_MD5_SHA1", "owasp": "A02: Cryptographic Failures", "cwe": ["CWE-327"],
        "description": "Use of MD5/SHA1 for security-sensitive hashing.",
        "sources": [*_HTTP_ENV, "SRC_ARGPARSE"], "sanitizers": [],
        "sinks": [{"id": "SINK_HASHLIB_WEAK", "kind": "crypto", "calls": ["hashlib.md5", "hashlib.sha1"]}],
    },
    {
        "id": "JWT_VERIFY_DISABLED", "owasp": "A07: Identification and Authentication Failures",
        "cwe": ["CWE-345"],
        "description": "jwt.decode called with verification disabled or insecure options.",
        "sources": _HTTP_ENV, "sanitizers": ["SAN_JWT_VERIFY"],
        "sinks": [
            {
                "id": "SINK_JWT_DECODE", "kind": "auth", "calls": ["jwt.decode"],
                "constraints": {
                    "any_of": [
                        {"kwargs": {"options": {"verify_signature": False}}},
                        {"kwargs": {"verify": False}},
                        {"kwargs": {"algorithms": ["none"]}},
                    ]
                },
            }
        ],
    },
]

# Decorators that mark an endpoint, and those that protect one.
ENDPOINT_DECORATORS = {
    "flask": ["@app.route", "@blueprint.route"],
    "fastapi": ["@app.get", "@app.post", "@router.get", "@router.post"],
}
AUTH_DECORATORS = ["@login_required", "@permission_required", "@user_passes_test"]

# Texts that give a framework away, compared in lower case.
FRAMEWORK_MARKS = {
    "flask": ["from flask import", "import flask", "flask.", "@app.route"],
    "django": ["from django", "import django", "django.", "from django.http"],
    "fastapi": ["from fastapi import", "import fastapi", "fastapi.", "@app.get", "@app.post"],
    "starlette": ["from starlette", "import starlette", "starlette."],
}


def canonical_value(value) -> str:
    """One text per Python value; True, 1 and 1.0 compare equal in Python and get the same text."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if v is None or isinstance(v, (str, int, float)):
            return v
        return repr(v)

    return json.dumps(plain(value), sort_keys=True)


@dataclass(frozen=True)
class Catalogue:
    """Rules in order.  A sink id that comes up again replaces the earlier rule in its place."""

    sources: list = field(default_factory=lambda: SOURCES)
    sanitizers: list = field(default_factory=lambda: SANITIZERS)
    patterns: list = field(default_factory=lambda: PATTERNS)

    @classmethod
    def from_json(cls, text: str) -> "Catalogue":
        data = json.loads(text)
        return cls(data.get("sources", []), data.get("sanitizers", []), data.get("patterns", []))

    @property
    def sinks(self) -> list:
        by_id: dict[str, dict] = {}
        for p in self.patterns:
            for s in p.get("sinks", []):
                by_id[s["id"]] = {**s, "frameworks": p.get("frameworks")}
        return list(by_id.values())

    @property
    def longest_call(self) -> int:
        rules = [*self.sources, *self.sinks, *self.sanitizers]
        return max([c.count(".") + 1 for r in rules for c in r.get("calls") or []], default=1)

    def rule_table(self, spark: SparkSession) -> DataFrame:
        """(role, ord, id, kind, form, name): one row per name a rule matches."""
        rows = []
        for role, rules in (("source", self.sources), ("sink", self.sinks), ("sanitizer", self.sanitizers)):
            for i, r in enumerate(rules):
                kind = r.get("kind") or ",".join(r.get("kinds", []))
                rows += [(role, i, r["id"], kind, "call", c) for c in r.get("calls") or []]
                rows += [(role, i, r["id"], kind, "attr", a) for a in r.get("attrs") or []]
        return spark.createDataFrame(
            rows, "role string, ord int, id string, kind string, form string, name string"
        )

    def pattern_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                i, p["id"], p.get("owasp", "Unknown"), p.get("cwe", []), p.get("description", ""),
                p.get("sources", []), [s["id"] for s in p.get("sinks", [])],
                [s.get("kind", "") for s in p.get("sinks", [])], p.get("sanitizers", []),
            )
            for i, p in enumerate(self.patterns)
        ]
        return spark.createDataFrame(
            rows,
            "ord int, pattern_id string, owasp string, cwe array<string>, description string, "
            "sources array<string>, sink_ids array<string>, sink_kinds array<string>, sanitizers array<string>",
        )


DEFAULT = Catalogue()
