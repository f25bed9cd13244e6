"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import arrays as A

# Fixed phrases of page furniture.  A short line that holds one of them is boilerplate.
BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|use cookies"
    rb"|enable javascript|lorem ipsum|click here|read more|sign up now|log ?in to"
)
# Phrases that prose can hold as well: only a short line without closing punctuation is boilerplate by them.
FURNITURE = re.compile(
    rb"(?i)\b(?:back to top|skip to (?:main )?content|leave a (?:comment|reply)|powered by|follow us|cookie policy"
    rb"|terms and conditions|view all|next page|previous page|share (?:this|on)|posted (?:by|in|on)|sign in|add to cart)\b"
)
SEPARATOR = re.compile(" (?:[|>/]|::|·|•|»|›|→)(?= )".encode())
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"]", "…".encode(), "”".encode(), "»".encode(), "。".encode())

SCHEMA = (
    "row struct<doc_id:bigint>, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, kept_words bigint, n_lines bigint, lost_lines bigint, cleaned string"
)


def finished(line: bytes) -> bool:
    """The line ends in closing punctuation, or a sentence ends inside it."""
    return line.rstrip().endswith(ENDS) or b". " in line


def line_verdict(line: bytes, words: int, symbols: int, unfinished_words: int) -> str | None:
    """Why a line fails by itself, or None.

    navigation: three or more separators between items, or two in an unfinished line of 12 words or fewer.  symbols: more
    than three marks of ``#*$%&|<>`` in ten words.  shouting: three words in ten or more end in two exclamation marks.
    boilerplate: a fixed phrase of page furniture in a line of 20 words or fewer; phrases that prose can hold count in
    unfinished lines only.  unfinished: ``unfinished_words`` words or more without closing punctuation and with no sentence
    end inside.
    """
    separators = len(SEPARATOR.findall(line))
    if separators >= 3 or separators == 2 and words <= 12 and not finished(line):
        return "navigation"
    if symbols * 10 > words * 3:
        return "symbols"
    if line.count(b"!!") * 10 >= words * 3:
        return "shouting"
    if words <= 20 and (BOILERPLATE.search(line) or FURNITURE.search(line) and not finished(line)):
        return "boilerplate"
    if words >= unfinished_words and not finished(line):
        return "unfinished"
    return None


def loose(line: bytes, words: int, following: bytes) -> bool:
    """An unfinished line that may be an item of a list of links, captions or fragments.

    A line of six words or more that starts, or is followed by a line that starts, in a small letter is wrapped prose.
    """
    wrapped = words >= 6 and (line.lstrip()[:1].islower() or following.lstrip()[:1].islower())
    return not finished(line) and not wrapped


def _features(texts: list[bytes], unfinished_words: int, run_lines: int, with_text: bool):
    buf, first, _ = A.joined(texts)
    n = len(texts)
    starts, ends = A.word_spans(buf)
    owner = np.searchsorted(first, starts, "right") - 1
    n_words = A.counts_by(owner, n)
    word_byte = ~A._SPACE[buf]
    lead = np.concatenate(([0], np.cumsum(word_byte & ((buf & 0xC0) != 0x80))))
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[buf])))
    after = np.append(first[1:], len(buf))
    word_chars, n_symbols = lead[after] - lead[first], marks[after] - marks[first]

    digest = A.word_digests(buf, starts, ends)
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        at = np.flatnonzero(owner[:-2] == owner[2:])
        keys = A.mix(A.Ranges(digest).of(at, at + 3) ^ A.mix(owner[at].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for shift in range(3):
            repeated[at[twice] + shift] = True
    n_repeat = np.bincount(owner[repeated], minlength=n)

    # Lines of the buffer never cross texts, as each text ends in a line feed.
    feeds = np.flatnonzero(buf == 10)
    heads = np.concatenate(([0], feeds[:-1] + 1))
    line_words = np.searchsorted(starts, feeds) - np.searchsorted(starts, heads)
    line_owner = np.searchsorted(first, heads, "right") - 1
    filled = np.flatnonzero(line_words)
    seen: set[bytes] = set()
    dup, lost, lines = np.zeros(n, np.int64), np.zeros(n, np.int64), A.counts_by(line_owner[filled], n)
    kept_words, kept_text, current = np.zeros(n, np.int64), [[] for _ in range(n)], -1
    raw = buf.tobytes()
    line_marks = marks[feeds] - marks[heads]
    run: list[int] = []  # words of the loose lines of this run that are still kept
    length = 0  # loose lines of this run
    at = filled.tolist()
    for i, after_i in zip(at, [*at[1:], None], strict=True):
        d = int(line_owner[i])
        if d != current:
            seen, current, run, length = set(), d, [], 0
        line, words = raw[heads[i] : feeds[i]], int(line_words[i])
        if line in seen:
            dup[d] += 1
            lost[d] += 1
            continue
        seen.add(line)
        if line_verdict(line, words, int(line_marks[i]), unfinished_words):
            lost[d] += 1
            continue
        following = b"" if after_i is None or line_owner[after_i] != d else raw[heads[after_i] : feeds[after_i]]
        if not loose(line, words, following):
            run, length = [], 0
        else:
            length += 1
            if length >= run_lines:
                lost[d] += len(run) + 1
                kept_words[d] -= sum(run)
                if with_text and run:
                    del kept_text[d][-len(run) :]
                run = []
                continue
            run.append(words)
        kept_words[d] += words
        if with_text:
            kept_text[d].append(line)
    return n_words, word_chars, n_symbols, dup, n_repeat, kept_words, lines, lost, [b"\n".join(x) for x in kept_text]


def judged(
    docs: DataFrame, carry: list[str], min_words: int = 50, repeat_percent: int = 50,
    least_kept: float = 0.5, unfinished_words: int = 60, run_lines: int = 4, with_text: bool = False,
) -> DataFrame:
    """Base features, line rules and the verdict of each document, next to the ``carry`` columns in the struct ``row``.

    A document fails the base test with fewer than ``min_words`` words, or when more than ``repeat_percent`` of
    its words lie in three-word windows that occur twice.  It fails the line test when less than the share
    ``least_kept`` of its words is left after failing lines, repeats of earlier lines and runs of ``run_lines`` or more
    ``loose`` lines are gone; blank, failing and repeated lines neither count in a run nor end it.  Verse without
    punctuation and program code are such runs too.
    Null and empty texts have no words and so fail; rows repeat in the result as they do in the input; columns
    besides ``text`` are carried only where named.  No shuffle; memory follows the longest text.
    """

    def run(batches):
        for batch in batches:
            for a, b, texts in A.slices(batch.column(1)):
                got = _features(texts, unfinished_words, run_lines, with_text)
                cleaned = pa.array([t.decode("utf-8", "ignore") if with_text else None for t in got[8]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, got[:8]), cleaned], names=names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("binary").alias("text"))
    schema = SCHEMA.replace("row struct<doc_id:bigint>", f"row {rows.schema['row'].dataType.simpleString()}")
    names = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "n_lines", "lost_lines", "cleaned"]
    out = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    kept = ~failed & (F.col("kept_words") >= least_kept * F.col("n_words"))
    return out.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_lines", "lost_lines", "kept_words",
        *(["cleaned"] if with_text else []),
    )


def quality(docs: DataFrame, **parameters) -> DataFrame:
    """Features and verdict by doc_id; see ``judged``."""
    out = judged(docs, ["doc_id"], **parameters)
    return out.select("row.doc_id", *out.columns[1:])


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that pass, all columns and the whole text as they came."""
    return judged(docs, docs.columns, **parameters).filter("kept").select("row.*")
