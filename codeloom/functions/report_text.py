"""Titles, labels, report bodies, prompts and model answers as text columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "codeloom"
RULE = "---\n\n"


def _section(heading: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {heading}\n\n"), body, F.lit("\n\n" + RULE))


def _bold(label: str, value: Column) -> Column:
    """'**label**: value' or nothing when the value is missing."""
    line = F.concat(F.lit(f"**{label}**: "), value, F.lit("\n\n"))
    return F.coalesce(F.when(value != "", line), F.lit(""))


def _python(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), code, F.lit("\n```"))


def percent(value: Column) -> Column:
    """A share as '12.3%', rounded by its exact binary value with ties to even.

    n tenths are right unless the value lies below the border (2n - 1) / 20; v * 16 and v * 4 are exact
    and so is their sum near the border, which a decimal rounding of v would get wrong.
    """
    v = value * 100
    n = F.floor(v * 10 + 0.5)
    over = (v * 16 - (n * 2 - 1).cast("double")) + v * 4
    tenths = F.when((over < 0) | ((over == 0) & (n % 2 == 1)), n - 1).otherwise(n)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def finding_title(severity: Column, cwe: Column, rule: Column, file: Column, tag: str = TAG) -> Column:
    return F.concat(
        F.lit(f"[{tag.upper()}]["), F.coalesce(severity, F.lit("MEDIUM")),
        F.lit("]["), F.coalesce(cwe, F.lit("UNKNOWN")), F.lit("] "),
        F.coalesce(rule, F.lit("UNKNOWN")), F.lit(" in "), F.coalesce(file, F.lit("unknown")),
    )


def finding_labels(severity: Column, cwe: Column, tag: str = TAG) -> Column:
    return F.array(
        F.lit("security"), F.lit(tag),
        F.concat(F.lit("severity:"), F.lower(F.coalesce(severity, F.lit("medium")))),
        F.concat(F.lit("cwe:"), F.lower(F.coalesce(cwe, F.lit("unknown")))),
    )


def issue_body(
    file: Column, vulnerability: Column, confidence: Column, explanation: Column,
    original: Column, fixed: Column, tag: str = TAG,
) -> Column:
    vulnerable = F.when(original != "", _section("Vulnerable Code", _python(original)))
    return F.concat(
        F.lit("## Security Vulnerability Detected\n\n**File**: `"), file, F.lit("`\n\n"),
        _bold("Vulnerability Type", vulnerability),
        _bold("Detection Confidence", percent(confidence)),
        F.lit(RULE), _section("Explanation", explanation),
        F.coalesce(vulnerable, F.lit("")), _section("Suggested Fix", _python(fixed)),
        F.lit(
            "## Notes\n\n"
            f"- This issue was generated by {tag} from a detected vulnerability.\n"
            "- Review the suggested fix before applying it.\n"
            "- Consider further security testing and code review.\n"
        ),
    )


def markdown_report(
    generated: Column, file: Column, repo_url: Column, vulnerability: Column, confidence: Column,
    explanation: Column, original: Column, fixed: Column, tag: str = TAG,
) -> Column:
    vulnerable = F.when(original != "", _section("Vulnerable Code", _python(original)))
    return F.concat(
        F.lit("# Security Vulnerability Report\n\n**Generated**: "),
        F.date_format(generated, "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n\n## File Information\n\n**File Path**: `"), file, F.lit("`\n\n"),
        _bold("Repository", repo_url), _bold("Vulnerability Type", vulnerability),
        _bold("Detection Confidence", percent(confidence)),
        F.lit(RULE), _section("Explanation", explanation),
        F.coalesce(vulnerable, F.lit("")), _section("Suggested Fix", _python(fixed)),
        F.lit(
            "## Notes\n\n"
            f"- This report was generated by {tag} from a detected vulnerability.\n"
            "- Review the suggested fix before applying it.\n"
            "- Consider further security testing and code review.\n"
        ),
    )


def _finding_lines(severity: Column, rule: Column, cwe: Column, file: Column, line: Column) -> Column:
    place = F.concat_ws(
        ":", F.coalesce(file, F.lit("unknown")), F.coalesce(line.cast("string"), F.lit("unknown"))
    )
    return F.concat(
        F.lit("- **Severity**: "), F.coalesce(severity, F.lit("MEDIUM")),
        F.lit("\n- **Rule ID**: "), F.coalesce(rule, F.lit("UNKNOWN")),
        F.lit("\n- **CWE**: "), F.coalesce(cwe, F.lit("")),
        F.lit("\n- **Location**: "), place, F.lit("\n\n## Code Snippet\n"),
    )


def fallback_report(
    severity: Column, rule: Column, cwe: Column, file: Column, line: Column, snippet: Column
) -> Column:
    """The report used when no written diagnosis is available."""
    return F.concat(
        F.lit("# Vulnerability Detection Report\n\n## Summary\n"),
        _finding_lines(severity, rule, cwe, file, line), _python(F.coalesce(snippet, F.lit(""))),
        F.lit("\n\n## Note\nNo detailed diagnosis is available. Please review by hand.\n"),
    )


def report_prompt(
    severity: Column, rule: Column, cwe: Column, file: Column, line: Column, snippet: Column,
    subgraph_json: Column,
) -> Column:
    return F.concat(
        F.lit("Write a diagnostic report in Markdown for the developers of this code.\n\n"
              "## Detection Information\n"),
        _finding_lines(severity, rule, cwe, file, line), _python(F.coalesce(snippet, F.lit(""))),
        F.lit("\n\n## Subgraph Information\n"), F.coalesce(subgraph_json, F.lit("{}")),
        F.lit(
            "\n\n## Report Requirements\n1. **Summary**\n2. **Detailed Explanation**\n"
            "3. **Impact Scope**\n4. **Fix Method**\n5. **Reference Information**\n"
        ),
    )


def fix_prompt(code: Column, file: Column, vulnerability: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Find the security vulnerability in this Python code, fix it and explain the fix.\n\n"),
        _bold("Vulnerability Type", vulnerability), _bold("File Path", file),
        _bold("Additional Context", context),
        F.lit("**Vulnerable Code**:\n"), _python(code),
        F.lit("\n\nAnswer as JSON with fixed_code, explanation, vulnerability_type, confidence.\n"),
    )


FIX = T.StructType(
    [
        T.StructField("fixed_code", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("vulnerability_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def parse_fix(response: Column, vulnerability: Column) -> Column:
    """STRUCT of a suggested fix: the outermost JSON object, else a fenced block, else null."""
    outer = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    data = F.from_json(outer, FIX, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json(outer).isNotNull()
    from_json = F.struct(
        F.coalesce(data["fixed_code"], F.lit("")).alias("fixed_code"),
        F.coalesce(data["explanation"], F.lit("")).alias("explanation"),
        F.coalesce(F.nullif(data["vulnerability_type"], F.lit("")), vulnerability).alias(
            "vulnerability_type"
        ),
        data["confidence"].alias("confidence"),
    )
    block = F.regexp_extract(response, r"(?s)```python\n(.*?)\n```", 1)
    code = F.regexp_replace(block, r"(?U)^\s+|\s+$", "")
    rest = F.replace(response, F.concat(F.lit("```python\n"), code, F.lit("\n```")), F.lit(""))
    rest = F.regexp_replace(rest, r"(?U)^\s+|\s+$", "")
    from_block = F.struct(
        code.alias("fixed_code"),
        F.when(rest != "", rest).otherwise("Fix generated by LLM").alias("explanation"),
        vulnerability.alias("vulnerability_type"),
        F.lit(0.8).cast("double").alias("confidence"),
    )
    fenced = F.contains(response, F.lit("```python\n")) & (
        F.regexp_extract(response, r"(?s)```python\n(.*?)\n```", 0) != ""
    )
    return F.when(outer != "", F.when(readable, from_json)).when(fenced, from_block)


def issue_with_fingerprint(markdown: Column, fingerprint: Column) -> Column:
    return F.concat(markdown, F.lit("\n\n---\n\n<!-- fp:"), fingerprint, F.lit(" -->"))


def issue_comment(markdown: Column, commit: Column) -> Column:
    head = F.concat(
        F.lit("## New Evidence (Commit: "), F.left(commit, F.lit(8)), F.lit(")\n\n"), markdown
    )
    return F.when(commit != "", head).otherwise(markdown)
