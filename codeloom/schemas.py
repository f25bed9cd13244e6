"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("sl", "sc", "el", "ec")])

NODE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("span", T.ArrayType(T.IntegerType())),
        T.StructField("code", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("type_hint", T.StringType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Older graph files call the edge ends source/target; both spellings are read.
EDGE_ON_DISK = T.StructType(
    EDGE.fields + [T.StructField("source", T.LongType()), T.StructField("target", T.LongType())]
)

GRAPH = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("edges", T.ArrayType(EDGE_ON_DISK)),
        T.StructField(
            "metadata",
            T.StructType([T.StructField("frameworks", T.ArrayType(T.StringType()))]),
        ),
    ]
)

POSITION = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
    ]
)

TAINT_RECORD = T.StructType(
    [
        T.StructField("source", POSITION),
        T.StructField("sink", POSITION),
        T.StructField("path", T.ArrayType(POSITION)),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)

VULN_RECORD = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "cve_id", "cwe_id", "repo_url", "commit_before", "commit_after", "file_path",
            "vulnerability_type", "description", "code_before", "code_after",
        )
    ]
    + [T.StructField("synthetic", T.BooleanType()), T.StructField("timestamp", T.TimestampType())]
)

SAFE_FILE = T.StructType(
    [
        T.StructField("repo_url", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("vulnerability_type", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("collected_at", T.TimestampType()),
    ]
)

LABEL = T.StructType(
    [
        T.StructField("label", T.IntegerType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField(n, T.StringType())
                    for n in (
                        "pattern_id", "vulnerability_type", "sample_type", "repo_url",
                        "cve_id", "cwe_id", "commit", "file_path",
                    )
                ]
                + [
                    T.StructField("bandit_score", T.DoubleType()),
                    T.StructField("bandit_rules", T.ArrayType(T.StringType())),
                    T.StructField("patched_flag", T.BooleanType()),
                    T.StructField("synthetic_flag", T.BooleanType()),
                    T.StructField("is_post_patch", T.BooleanType()),
                    T.StructField(
                        "severity_counts", T.MapType(T.StringType(), T.IntegerType())
                    ),
                ]
            ),
        ),
    ]
)

FACT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("frameworks", T.ArrayType(T.StringType())),
        T.StructField("id", T.LongType()),
        T.StructField("parent", T.LongType()),
        T.StructField("ast_type", T.StringType()),
        T.StructField("parent_type", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("is_stmt", T.BooleanType()),
        T.StructField("sl", T.IntegerType()),
        T.StructField("sc", T.IntegerType()),
        T.StructField("el", T.IntegerType()),
        T.StructField("ec", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ctx", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("base", T.StringType()),
        T.StructField("arg_names", T.ArrayType(T.StringType())),
        T.StructField("n_args", T.IntegerType()),
        T.StructField("query_kind", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("kwargs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("literal_kwargs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField(
            "imports",
            T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("alias", "path", "module")])),
        ),
        T.StructField("scopes", T.ArrayType(T.LongType())),
        T.StructField("comps", T.ArrayType(T.LongType())),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("repo_url", T.StringType()),
        T.StructField("is_vulnerable", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("vulnerability_type", T.StringType()),
        T.StructField("code", T.StringType()),
    ]
)
