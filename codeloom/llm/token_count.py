"""Token counts of whole texts; huge texts go through overlapping chunks that meet at proven boundaries."""

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    """The worker's tokenizer for a file; a JSON file is read by ``tokenizers``, a model by ``sentencepiece``."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
            _LOADED[path].no_truncation()
            _LOADED[path].no_padding()
    return _LOADED[path]


def _boundaries(tok, text: str, at: int) -> tuple[dict[int, int], int, int]:
    """Encodes ``text``, which begins at ``at``: token index by start of each word piece, tokens, last start."""
    enc = tok.encode(text, add_special_tokens=False)
    starts, last, before = {}, at, object()
    for i, (word, span) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if word is None:
            before = object()
        elif word != before:
            starts[last := at + span[0]], before = i, word
    return starts, len(enc.ids), last


def count_by_chunks(tok, text: str, chunk: int, overlap: int, guard: int) -> int:
    """Tokens of ``text``, as encoding it whole would count them.

    The split into word pieces reads from left to right and keeps no state between pieces, so two chunks that
    both start a piece at the same place agree on everything after it.  A start is proven when neither chunk's
    edge can have moved it: it lies ``guard`` characters (the longest special string) past the right chunk's start and before
    the left chunk's end, and is not behind the left chunk's last piece.  Chunks without a
    common proven start are widened, at the end up to the rest of the text.
    """
    total, at, width = 0, 0, chunk
    starts, n, last = _boundaries(tok, text[:width], 0)
    begin = 0
    while at + width < len(text):
        end, shared = at + width, overlap
        while True:
            left, common = end - shared, []
            if left <= at:
                break
            right = _boundaries(tok, text[left : left + chunk], left)
            common = [p for p in starts if left + guard <= p <= min(last, end - guard) and p in right[0] and starts[p] >= begin]
            if common or shared * 2 > chunk:
                break
            shared *= 2
        if common:
            p = max(common)
            total += starts[p] - begin
            begin, at, width = right[0][p], left, chunk
            starts, n, last = right
        else:
            width *= 2
            starts, n, last = _boundaries(tok, text[at : at + width], at)
    return total + n - begin


def _count(tok, texts: list[str], chunk: int, overlap: int) -> list[int]:
    if not hasattr(tok, "encode_batch"):
        return [len(x) for x in tok.encode(texts, num_threads=1)] if texts else []
    guard = max([1, *(len(t.content) for t in tok.get_added_tokens_decoder().values())])
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    out = [0] * len(texts)
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    for a in range(0, len(short), 64):
        some = short[a : a + 64]
        for i, enc in zip(some, encode([texts[i] for i in some], add_special_tokens=False), strict=True):
            out[i] = len(enc)
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = count_by_chunks(tok, t, chunk, max(overlap, 2 * guard + 1), guard)
    return out


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 10
) -> DataFrame:
    """Bytes and tokens of each text, and whether it has more than ``limit`` tokens, by doc_id.

    ``path`` names a vocabulary file every executor can read.  Special strings inside texts are handled as the
    library does by default; no special token is added.  Null texts count as empty, 0 tokens; repeated rows
    stay repeated; other columns are not read.  No shuffle.  Texts of up to ``chunk`` characters are encoded
    whole, so a task holds the tokens of one chunk at a time.
    """

    def run(batches):
        tok = _tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = _count(tok, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["row", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.struct("doc_id").alias("row"), "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
