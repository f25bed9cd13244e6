"""The registered queries of this subpackage and their checking SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.registry import Query

QUERIES: dict[str, Query] = {}

HEX_WORDS = r"[^\x20\x09-\x0D]+"


def query(name: str, covers: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = Query(name, covers, plan, sql)
        return plan

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- 3 ----------------------------------------------------------------------------------------------------------------

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

_PARTS_SQL = """
    SELECT page_id,
           translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages)
"""


@query(
    "op3_url_filters", "LLM3",
    f"""
    WITH rules(rule, rule_host, rule_path, action) AS (VALUES
        ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    urls AS (SELECT *, row_number() OVER () AS n FROM ({_PARTS_SQL}))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM urls LEFT JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST, rule) = 1
    """,
)
def op3_url_filters(spark, sf):
    from codeloom.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


# -- 4 ----------------------------------------------------------------------------------------------------------------

_CONTROL_SQL = r"([<\[])(\|(?:start|message|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"


@query(
    "op4_chat_format", "LLM4",
    rf"""
    WITH all_turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
        SELECT *, length(regexp_replace(replace(role, '\', '\\'), '{_CONTROL_SQL}', '\1\\\2', 'g'))
                + length(regexp_replace(replace(text, '\', '\\'), '{_CONTROL_SQL}', '\1\\\2', 'g'))
                + length('<|start|><|message|><|end|>') AS chars
        FROM all_turns),
    gathered AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
               coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
           formatted_chars FROM gathered
    """,
)
def op4_chat_format(spark, sf):
    from codeloom.llm import chat_format as C

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    part = F.struct(F.lit("text").alias("kind"), "text", *[F.lit(None).alias(n) for n in ("uri", "width", "height", "seconds", "pages")])
    out = C.format_chats(rows.select("conv_id", "turn", "role", F.array(part).cast(C.PARTS).alias("parts")))
    said_by_turn = F.transform(C.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = C.read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.withColumns({"said": said_by_turn, "loss": loss})
    return out.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", "said"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# -- 7 ----------------------------------------------------------------------------------------------------------------


@query("op7_source_mixing", "LLM7")
def op7_source_mixing(spark, sf):
    from codeloom.llm.mixing import mix

    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


# -- 8 ----------------------------------------------------------------------------------------------------------------


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary; spark.codeloom.tokenizer names another file all executors can read."""
    import public_tokenizers

    return spark.conf.get("spark.codeloom.tokenizer", public_tokenizers.path(name))


@query("op8_token_counts", "LLM8")
def op8_token_counts(spark, sf):
    from codeloom.llm.token_count import count_tokens

    return count_tokens(table(spark, sf, "documents"), vocabulary(spark))


# -- 10 ---------------------------------------------------------------------------------------------------------------


@query("op10_quality_rules", "LLM10")
def op10_quality_rules(spark, sf):
    from codeloom.llm.quality_rules import quality

    return quality(table(spark, sf, "documents"))


# -- 5 ----------------------------------------------------------------------------------------------------------------


@query("op5_simhash_near_dedup", "LLM5")
def op5_simhash_near_dedup(spark, sf):
    from codeloom.llm.simhash import components_of

    return components_of(table(spark, sf, "documents"))


# -- 1 ----------------------------------------------------------------------------------------------------------------


@query("op1_substring_dedup", "LLM1")
def op1_substring_dedup(spark, sf):
    from codeloom.llm.substring_dedup import dedup_passages

    out = dedup_passages(table(spark, sf, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


# -- 2 ----------------------------------------------------------------------------------------------------------------


@query("op2_suffix_array_dedup", "LLM2")
def op2_suffix_array_dedup(spark, sf):
    from codeloom.llm.suffix_dedup import dedup_bytes

    out = dedup_bytes(table(spark, sf, "documents"), ["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# -- 6 ----------------------------------------------------------------------------------------------------------------


@query("op6_benchmark_decontamination", "LLM6")
def op6_benchmark_decontamination(spark, sf):
    from codeloom.llm.decontaminate import leaks

    out = leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), ["doc_id"])
    return out.select("row.doc_id", "item_id", F.round("cosine", 4).alias("cosine"), "lcs_share", "answer_share", "latent")


# -- 9 ----------------------------------------------------------------------------------------------------------------

_CANONICAL_SQL = r"""
    CASE WHEN url IS NULL THEN NULL ELSE
    regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^(www\d*|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END
"""


def captures(pages: DataFrame) -> DataFrame:
    """A small WARC file for each page: its response and two revisits.

    The second revisit of every fifth page has another ETag, so it must not resolve.
    """
    from codeloom.llm.warc import warc_record

    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    begin = F.lit(1_700_000_000) + F.col("page_id") * 100
    name = lambda n: F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(f"-{n}"))
    none = F.lit(None).cast("string")

    def revisit(n, after, etag):
        headers = F.array(F.concat(F.lit("ETag: "), etag), F.lit(f"Cache-Control: max-age={n}"), F.lit("Content-Type: text/plain"))
        return warc_record(F.lit("revisit"), name(n), F.col("url"), begin + after, F.lit(304), headers, none, none)

    response = warc_record(
        F.lit("response"), name(0), F.col("url"), begin, F.lit(200),
        F.array(F.concat(F.lit("ETag: "), tag), F.lit("Cache-Control: no-cache"), F.lit("Content-Type: text/html")), F.col("html"), none,
    )
    other = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    return pages.select(F.concat(response, revisit(1, 50, tag), revisit(2, 200_000, other)).alias("content"))


@query(
    "op9_warc_revisits", "LLM9",
    rf"""
    WITH pages0 AS (
        SELECT *, regexp_replace(regexp_replace(trim(url), '(?i)^[a-z][a-z0-9+.-]*://', ''), '(?s)#.*$', '') AS r FROM pages),
    pages1 AS (
        SELECT *, list_sort(list_filter(string_split(regexp_extract(r, '(?s)\?(.*)$', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|sid|sessionid)(=|$)'))) AS q FROM pages0),
    urls AS (
        SELECT page_id, 1700000000 + page_id * 100 AS at0, md5(html) AS digest, '"' || md5(html)[1:16] || '"' AS tag, {_CANONICAL_SQL} AS canonical_url
        FROM pages1),
    records AS (
        SELECT 'p' || page_id || '-0' AS record_id, 'response' AS kind, at0 AS "at", tag AS etag, digest, canonical_url, 'no-cache' AS cache FROM urls
        UNION ALL SELECT 'p' || page_id || '-1', 'revisit', at0 + 50, tag, NULL, canonical_url, 'max-age=1' FROM urls
        UNION ALL SELECT 'p' || page_id || '-2', 'revisit', at0 + 200000, CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE tag END, NULL, canonical_url, 'max-age=2' FROM urls),
    met AS (
        SELECT *, (max(CASE WHEN kind = 'response' THEN {{'at': "at", 'id': record_id, 'etag': etag, 'digest': digest}} END)
            OVER (PARTITION BY canonical_url ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS s FROM records),
    judged AS (
        SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN canonical_url IS NULL OR s IS NULL THEN 'orphan'
                       WHEN etag <> s.etag THEN 'changed' ELSE 'resolved' END AS verdict FROM met)
    SELECT record_id, kind, "at", canonical_url, verdict,
           CASE verdict WHEN 'full' THEN record_id WHEN 'resolved' THEN s.id END AS resolved_id,
           CASE verdict WHEN 'full' THEN digest WHEN 'resolved' THEN s.digest END AS resolved_digest,
           CASE verdict WHEN 'full' THEN cache WHEN 'resolved' THEN cache END AS cache_control,
           CASE WHEN verdict IN ('full', 'resolved') THEN 'text/html' END AS content_type
    FROM judged
    """,
)
def op9_warc_revisits(spark, sf):
    from codeloom.llm.warc import read_warc, resolve_revisits

    out = resolve_revisits(read_warc(captures(table(spark, sf, "pages"))))
    header = lambda k: F.try_element_at("merged", F.lit(k))
    return out.select(
        "record_id", "kind", "at", "canonical_url", "verdict", "resolved_id", "resolved_digest",
        header("cache-control").alias("cache_control"), header("content-type").alias("content_type"),
    )


# -- 11 ---------------------------------------------------------------------------------------------------------------

# CRC-32 of a text of single bytes, as its table of remainders is computed from the polynomial.
_CRC_SQL = """
    crc_table AS (
        WITH RECURSIVE r(i, k, v) AS (
            SELECT range::UBIGINT, 0, range::UBIGINT FROM range(256)
            UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM r WHERE k < 8)
        SELECT list(v ORDER BY i) AS t FROM r WHERE k = 8)
"""


def _crc_sql(octets: str) -> str:
    """CRC-32 of a list of numbers from 0 to 255, where crc_table is at hand."""
    step = "xor(s >> 8, t[1 + (xor(s, b) & 255)::BIGINT])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda s, b: {step}), 4294967295::UBIGINT)::BIGINT"


@query(
    "op11_prefix_trie", "LLM11",
    f"""
    WITH {_CRC_SQL},
    turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 100 AS r, {_crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)")} % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
    begun AS (SELECT c.*, (SELECT count(*) FROM turns t WHERE t.conv_id = c.r AND t.i <= c.h) AS b FROM convs c),
    rebuilt AS (
        SELECT c.conv_id, t.i AS d, role, text FROM begun c JOIN turns t ON t.conv_id = c.r AND t.i <= c.h
        UNION ALL SELECT c.conv_id, t.i - c.h + c.b, role, text FROM begun c JOIN turns t USING (conv_id) WHERE t.i > c.h),
    prefixes AS (
        SELECT conv_id, d, length(text) AS chars, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS p FROM rebuilt
        UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
    placed AS (SELECT *, min(conv_id) OVER (PARTITION BY d, p) AS node, max(d) OVER (PARTITION BY conv_id) AS n FROM prefixes),
    nodes AS (
        SELECT node, d, count(*) AS n_convs, any_value(chars) AS chars,
               coalesce(string_agg(CASE WHEN d = n THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
        FROM placed GROUP BY node, d),
    above AS (
        SELECT x.node, x.d, x.n_convs, x.chars, x.ends, y.node AS up, y.d AS up_d
        FROM nodes x JOIN placed y ON y.conv_id = x.node AND y.d <= x.d),
    children AS (SELECT up AS node, up_d AS d, count(*) AS n_children FROM above WHERE up_d = d - 1 GROUP BY ALL),
    sums AS (
        SELECT a.up AS node, a.up_d AS d, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
        FROM above a LEFT JOIN children c ON c.node = a.node AND c.d = a.d GROUP BY ALL)
    SELECT x.node AS conv_id, x.d AS depth, y.up AS parent_conv_id, x.n_convs, coalesce(c.n_children, 0) AS n_children, n_leaves, saved_tokens,
           sha256(x.ends) AS ends_sha256
    FROM nodes x JOIN sums s ON s.node = x.node AND s.d = x.d
    LEFT JOIN children c ON c.node = x.node AND c.d = x.d LEFT JOIN above y ON y.node = x.node AND y.d = x.d AND y.up_d = x.d - 1
    """,
)
def op11_prefix_trie(spark, sf):
    from codeloom.llm import prefix_trie as P
    from codeloom.llm.scratch import Scratch

    scratch = Scratch(spark, "trie")
    turns = scratch.cut(P.numbered_turns(table(spark, sf, "conversations")), "turns")
    rows, convs = P.shared_beginnings(turns, scratch)
    return P.prefix_trie(rows, convs, scratch=scratch).drop("chars")


# -- 12 ---------------------------------------------------------------------------------------------------------------


@query(
    "op12_exact_topk", "LLM12",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scores QUALIFY rank <= 5
    """,
)
def op12_exact_topk(spark, sf):
    from codeloom.llm.exact_topk import integer_vectors, top_inner_products

    return top_inner_products(integer_vectors(table(spark, sf, "embeddings")), "vec_id % 50 = 0")


# -- 13 ---------------------------------------------------------------------------------------------------------------

_OCTETS_SQL = "list_transform(regexp_extract_all(hex(octets), '..'), lambda x: ('0x' || x)::UBIGINT)"


@query(
    "op13_spelling_groups", "LLM13",
    f"""
    WITH RECURSIVE {_CRC_SQL},
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
        FROM documents),
    counted AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS octets, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
    digests AS (SELECT run, n, {_crc_sql(_OCTETS_SQL)} AS h FROM counted, crc_table),
    slips AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM digests),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    less AS MATERIALIZED (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
        UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN words y ON x.rest = y.word
        UNION SELECT y.word, y.n, x.word, x.n FROM less x JOIN words y ON x.rest = y.word),
    best AS (
        SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
        QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    formed AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word),
    ways AS (
        SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM ways w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL),
    roots AS (SELECT w.word, w.at AS root FROM ways w JOIN formed f ON f.word = w.at WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots r ON r.word = f.word
    """,
)
def op13_spelling_groups(spark, sf):
    from codeloom.llm.spelling import spelling_groups, word_counts

    return spelling_groups(word_counts(table(spark, sf, "documents")))
