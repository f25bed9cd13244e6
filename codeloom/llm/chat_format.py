"""Chat formatting of typed content parts, with attachments, loss spans and a reversible escape."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
# Strings with a meaning in this template or in common others.  None of them appears in an escaped text.
CONTROL = r"([<\[])(\|(?:start|message|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"
KINDS = ("image", "audio", "document")
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """Reads every backslash as 'the next character as it is'."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded_tokens(part: Column, patch: int = 28, per_second: float = 25.0, per_page: int = 1024) -> Column:
    """Positions an attachment takes in the model's input; unknown sizes count as none."""
    tiles = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    by_kind = F.when(part["kind"] == "image", tiles).when(part["kind"] == "audio", F.ceil(part["seconds"] * per_second))
    return F.coalesce(by_kind.when(part["kind"] == "document", part["pages"] * per_page), F.lit(0)).cast("long")


def flat_content(parts: Column) -> Column:
    """Visits the parts in order: text is escaped, an attachment becomes its placeholder, an unknown kind nothing.

    Texts that follow each other, also over unknown kinds, are escaped as one, so that no control string comes together at a seam.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def visit(seen, p):
        mark = F.concat(F.lit("<|"), p["kind"], F.lit("|>"))
        more = F.concat(seen["open"], F.when(p["kind"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(""))
        attached = F.coalesce(p["kind"].isin(*KINDS), F.lit(False))
        done = F.when(attached, F.concat(seen["done"], escape(seen["open"]), mark)).otherwise(seen["done"])
        return F.struct(done.alias("done"), F.when(attached, F.lit("")).otherwise(more).alias("open"))

    end = lambda seen: F.concat(seen["done"], escape(seen["open"]))
    return F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), start, visit, end)


def attachments(parts: Column) -> Column:
    """Reference, kind and expanded tokens of each attachment, in order."""
    kept = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["kind"].isin(*KINDS))
    return F.transform(kept, lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens")))


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans, attachments in order, their expanded tokens.

    ``messages`` has conv_id, turn, role and parts (PARTS).  Turns are ordered by turn (null first), equal ones by role and content,
    so repeated rows are repeated turns.  A null role is empty, null parts are an empty message, a null conv_id is a conversation of its own.  Loss spans are
    (start, length) in code points of the contents of ``loss_role``.  Offsets come from a running sum over the rows of a conversation,
    which share one shuffle and one sort with the gathering; other columns are not read.
    """
    key = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role_text", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select(
        "conv_id", "turn", (F.col("role") == loss_role).alias("lossy"), attachments(F.col("parts")).alias("attached"),
        escape(F.coalesce("role", F.lit(""))).alias("role_text"), flat_content(F.col("parts")).alias("content"),
    )
    head = F.concat(F.lit(START), F.col("role_text"), F.lit(MESSAGE))
    rows = rows.withColumn("piece", F.concat(head, F.col("content"), F.lit(END)))
    begin = F.coalesce(F.sum(F.length("piece")).over(key), F.lit(0))
    rows = rows.withColumn("begin", begin).withColumn("place", F.coalesce(F.count(F.lit(1)).over(key), F.lit(0)))
    span = F.when(F.coalesce("lossy", F.lit(False)), F.struct((F.col("begin") + F.length(head) + 1).cast("int").alias("start"), F.length("content").alias("length")))
    turns = F.sort_array(F.collect_list(F.struct("place", "piece", span.alias("span"), "attached")))
    out = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return out.select(
        "conv_id", F.concat_ws("", F.col("turns.piece")).alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("turns.attached")).alias("attachments"),
    ).withColumn("attached_tokens", F.aggregate(F.col("attachments.tokens"), F.lit(0).cast("long"), lambda a, b: a + b))


def read_turns(formatted: Column) -> Column:
    """Role and text of each turn, read back from the formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    role = lambda p: unescape(F.regexp_extract(p, r"(?s)^<\|start\|>(.*?)<\|message\|>", 1))
    text = lambda p: unescape(F.substring(p, F.instr(p, MESSAGE) + len(MESSAGE), F.length(p)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))))
