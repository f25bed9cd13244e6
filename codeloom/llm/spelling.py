"""Spelling variants: words at one edit from each other, and the more frequent form each one goes back to."""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

LEAST = 5
# Words that a task counts before it gives them out, characters of a text that are read at once.
HELD, PIECE = 200_000, 1 << 20


def word_counts(docs: DataFrame, least: int = LEAST, drop_one_in: int = 97) -> DataFrame:
    """(word, n): the words of ``least`` code points or more of all whole texts, and how often they occur.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), with A-Z in lower case.  In one of ``drop_one_in`` words of a document, by the CRC-32 of
    "<doc_id>:<word>", one code point is left out, as a slip of the pen (a null id is written as nothing).  Null texts hold no words.
    Texts are read in pieces, and words are counted where they are read.
    """
    schema = "word string, n long"
    return docs.select("doc_id", "text").filter("text is not null").mapInArrow(_counted(least, drop_one_in), schema).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(least: int, drop_one_in: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    outside = re.compile("[^A-Za-zÀ-ÿ]")

    def pieces(text: str):
        a = 0
        while a < len(text):
            end = outside.search(text, a + PIECE) if a + PIECE < len(text) else None
            b = end.start() if end else len(text)
            yield text[a:b]
            a = b

    def given(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        total = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                own = Counter()
                for piece in pieces(text.as_py()):
                    own.update(runs.findall(piece.encode().lower().decode()))
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= HELD:
                    yield given(total)
                    total = Counter()
        if total:
            yield given(total)

    return run


def _cuts(length: Column) -> list[Column]:
    """Where a word is cut: two chunks, and each of them in two."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def _without(word: str, cuts: list[Column], part: int, shift: int) -> Column:
    """The word without a part that is ``shift`` longer than the cuts say."""
    before = F.substring(word, F.lit(1), cuts[part].cast("int"))
    return F.concat(before, F.substring(word, (cuts[part + 1] + shift + 1).cast("int"), F.length(word)))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, u_n, v, v_n): each pair of different ``words`` (word, n) that differ by one code point inserted, deleted or replaced, once.

    Asymmetric q-chunks, with q half of the shorter word: it gives its two disjoint chunks, the other word the positional grams of their
    length that lie at a chunk's place or, if it is the longer one, one further.  One edit leaves one of the two chunks as it is, so
    every pair meets there.  As a chunk of a short word is shared by many, the side with the edit is cut into two chunks again, of
    which one is left too; the key is the chunk and that half, with the length and the place.  What meets is verified inside the join,
    so that only pairs at one edit are rows.  A key with many words is a hot key of a join of written tables.
    """
    own, longer = _cuts(F.length("word")), _cuts(F.length("word") - 1)
    keys = F.array(
        *[F.struct(F.length("word").alias("a"), F.lit(p).alias("part"), _without("word", own, p, 0).alias("rest"), F.lit(False).alias("longer")) for p in range(4)],
        *[F.struct((F.length("word") - 1).alias("a"), F.lit(p).alias("part"), _without("word", longer, p, 1).alias("rest"), F.lit(True).alias("longer")) for p in range(4)],
    )
    grams = words.select("word", "n", F.inline(keys))
    # Nothing shorter than the shortest word asks for grams of its chunks.
    shortest = words.agg(F.min(F.length("word"))).first()[0] or 0
    grams = scratch.cut(grams.filter(F.col("a") >= shortest), "grams")
    chunks = grams.filter("not longer").select("a", "part", "rest", F.col("word").alias("u"), F.col("n").alias("u_n"))
    met = chunks.join(grams.withColumnsRenamed({"word": "v", "n": "v_n"}), ["a", "part", "rest"])
    met = met.filter((F.col("longer") | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1))
    pairs = scratch.cut(met.select("u", "u_n", "v", "v_n").dropDuplicates(["u", "v"]), "pairs")
    scratch.drop(grams)
    return pairs


def spelling_groups(words: DataFrame, least_n: int = 3, ratio: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """One row per word of ``words`` (word, n) with ``least_n`` occurrences or more: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point order), if that is ``ratio`` times the word's n or more, else null, and form_n its n; n_near counts the near words;
    root follows the forms to the last one (the word itself, if it has none).  A form has at least twice the occurrences, so forms end,
    and halving the way of all words at once takes a few rounds.  An empty table gives an empty result; a null word takes no part.
    """
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    words = scratch.cut(words.filter((F.col("n") >= least_n) & F.col("word").isNotNull()), "words")
    pairs = near_words(words, scratch)
    both = F.array(
        F.struct(F.col("u").alias("word"), F.col("u_n").alias("n"), F.col("v").alias("other"), F.col("v_n").alias("other_n")),
        F.struct(F.col("v").alias("word"), F.col("v_n").alias("n"), F.col("u").alias("other"), F.col("u_n").alias("other_n")),
    )
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"), F.max("n").alias("own"))
    led = -F.col("best.col1") >= F.col("own") * ratio
    near = scratch.cut(near.select("word", "n_near", F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.col1")).alias("form_n")), "near")
    ways = scratch.cut(near.filter("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = ways.select("word", "root").join(on, "root", "left")
        further = scratch.cut(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        scratch.drop(ways)
        ways = further
        if ways.filter("moved").isEmpty():
            break
    out = words.join(near, "word", "left").join(ways.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
