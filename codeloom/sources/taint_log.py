"""Taint logs: JSON lines in three layouts, read in batch or as a stream."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.hold import held

# Spellings of a position, in the order they are tried.
POSITION_KEYS = [("file", "line", "col"), ("filename", "lineno", "column"), ("path", "line", "column")]

_POSITION = "struct<file:string,line:string,col:string,filename:string,lineno:string,column:string,path:string>"
_LINE = (
    f"struct<source:{_POSITION},sink:{_POSITION},path:array<string>,meta:map<string,string>,"
    f"taint_source:{_POSITION},taint_sink:{_POSITION},trace:array<string>,taint_type:string,sink_type:string,"
    f"from:{_POSITION},to:{_POSITION},via:array<string>>"
)


def _whole_number(text: Column) -> Column:
    return text.try_cast("double").cast("int")


def _struct(file: Column, line: Column, col: Column) -> Column:
    return F.struct(file.alias("file"), _whole_number(line).alias("line"), _whole_number(col).alias("col"))


def _position(p: Column) -> Column:
    """The position in its first spelling; null when it has none or its line is no number."""
    out = None
    for file, line, col in POSITION_KEYS:
        has = p[file].isNotNull() & p[line].isNotNull()
        pos = F.when(_whole_number(p[line]).isNotNull(), _struct(p[file], p[line], p[col]))
        out = F.when(has, pos) if out is None else out.when(has, pos)
    return out


def _steps(raw: Column, one) -> Column:
    """Steps of a path; each is parsed on its own, so one bad step does not spoil the others."""
    parsed = F.transform(raw, lambda s: one(F.from_json(s, _POSITION)))
    return F.coalesce(parsed, F.array().cast("array<struct<file:string,line:int,col:int>>"))


def with_record(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds record: STRUCT<source, sink, path, meta>, null when the line fits none of the layouts."""
    rows = held(lines, _j=F.from_json(column, _LINE))
    ends = F.struct(
        *[_position(F.col(f"_j.{n}")).alias(n) for n in ("source", "sink", "taint_source", "taint_sink", "from", "to")]
    )
    rows = held(rows, _p=ends)
    j, p = F.col("_j"), F.col("_p")

    def valid(steps):
        return F.filter(steps, lambda s: s.isNotNull())

    def plain(q):
        return _struct(q["file"], q["line"], q["col"])

    def both(a, b, path, meta):
        r = F.struct(a.alias("source"), b.alias("sink"), path.alias("path"), meta.alias("meta"))
        return F.when(a.isNotNull() & b.isNotNull(), r)

    no_meta = F.create_map().cast("map<string,string>")
    # a canonical line passes as it stands: its positions are not respelled
    canonical = both(
        plain(j["source"]), plain(j["sink"]), _steps(j["path"], plain), F.coalesce(j["meta"], no_meta)
    )
    traced = both(
        p["taint_source"], p["taint_sink"], valid(_steps(j["trace"], _position)),
        F.map_filter(
            F.create_map(F.lit("taint_kind"), j["taint_type"], F.lit("sink_type"), j["sink_type"]),
            lambda _, v: v.isNotNull(),
        ),
    )
    generic = both(
        p["from"], p["to"], valid(_steps(j["via"], _position)),
        F.map_filter(F.from_json(column, "map<string,string>"), lambda k, _: ~k.isin("from", "to", "via")),
    )
    record = (
        F.when(p["source"].isNotNull() & p["sink"].isNotNull(), canonical)
        .when(j["taint_source"].isNotNull() & j["taint_sink"].isNotNull(), traced)
        .when(j["from"].isNotNull() & j["to"].isNotNull(), generic)
    )
    return held(rows, record=record).drop("_j", "_p")


def taint_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Canonical records of log lines; lines that cannot be normalised are left out.

    Works on batch and streaming input alike.
    """
    other = [c for c in lines.columns if c != column]
    return with_record(lines, column).where("record IS NOT NULL").select(*other, "record.*")


def read_taint_log(spark: SparkSession, path: str) -> DataFrame:
    return taint_records(spark.read.text(path))


def conversion_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """How many non-blank lines a conversion keeps and skips."""
    rows = with_record(lines.where(F.trim(column) != ""), column)
    return rows.agg(
        F.count_if(F.col("record").isNotNull()).alias("converted"), F.count_if(F.col("record").isNull()).alias("skipped")
    )


def convert_taint_log(spark: SparkSession, source: str, target: str) -> dict:
    """Rewrites a log in canonical form and reports the counts observed on the way."""
    seen = Observation("taint-log")
    rows = with_record(spark.read.text(source).where(F.trim("value") != ""))
    rows = rows.observe(
        seen, F.count_if(F.col("record").isNotNull()).alias("converted"),
        F.count_if(F.col("record").isNull()).alias("skipped"),
    )
    rows.where("record IS NOT NULL").select("record.*").write.mode("overwrite").json(target)
    return dict(seen.get)
