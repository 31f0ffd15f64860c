"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table with the token counts of the corpus's frequent
pre-tokens; tier two is a cache in each Python worker that encodes what the table
lacks. No pre-token is ever shuffled: the frequency pass moves one bounded
Misra-Gries summary for each task, and the counting pass moves nothing.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted row by row; an empty table gives an empty result; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import heaviest, map_texts, materialize

#: The split of byte-level BPE for texts of SAFE characters, on which Python's
#: ``re`` classes and the Unicode classes of the pattern agree.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNSAFE = re.compile("[^\t\n\r\x20-\x7e¡«»¿-ɏ‐-‧]")

#: Bounds of the broadcast table: entries, and UTF-8 bytes of one of them.
TABLE_ENTRIES, ENTRY_BYTES = 65_536, 64
#: Entries of one task's summary, and of one worker's cache.
SUMMARY_ENTRIES, CACHE_ENTRIES = 4_096, 1 << 20


def open_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def _prune(seen: Counter, size: int) -> None:
    """Misra-Gries: take the count of the entry beyond ``size`` from all."""
    if len(seen) > size:
        cut = sorted(seen.values(), reverse=True)[size]
        for k in [k for k, v in seen.items() if v <= cut]:
            del seen[k]
        for k in seen:
            seen[k] -= cut


def frequent_pretokens(docs: DataFrame, text: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """(pretoken, seen): the heaviest pre-tokens by summed task summaries.

    All texts are read; each task sends at most SUMMARY_ENTRIES rows.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(SPLIT.findall(t))
                    if len(seen) > 64 * SUMMARY_ENTRIES:
                        _prune(seen, 16 * SUMMARY_ENTRIES)
        top = [(k, v) for k, v in seen.most_common(SUMMARY_ENTRIES) if len(k.encode()) <= ENTRY_BYTES]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top]), pa.array([v for _, v in top], pa.int64())], names=["pretoken", "seen"])

    sums = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(summaries, "pretoken string, seen long").groupBy("pretoken").agg(F.sum("seen").alias("seen"))
    return heaviest(materialize(sums, "pretokens"), "seen", entries)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every text, as the tokenizer's library counts them.

    The result has the id column, n_bytes, n_tokens and over_limit
    (``n_tokens > limit``). Begin, end and other added tokens are not counted;
    special strings inside a text count as one token, the library's default.
    """
    frequent = sorted(r[0] for r in frequent_pretokens(docs, text).collect())  # at most TABLE_ENTRIES of ENTRY_BYTES
    model = open_tokenizer(tokenizer)
    sizes = bytes(min(255, len(e)) for e in model.encode_batch_fast(frequent, add_special_tokens=False))
    table = docs.sparkSession.sparkContext.broadcast(("\0".join(frequent), sizes))

    def make():
        tok = open_tokenizer(tokenizer)
        names, lengths = table.value
        known = {k: v for k, v in zip(names.split("\0"), lengths, strict=False) if k and v < 255}
        cache: dict[str, int] = {}
        special = special_strings(tok)
        cut = re.compile("|".join(map(re.escape, special))) if special else None

        def counted(pieces: list[str]) -> list[int]:
            return [len(e) for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]

        def work(texts: list[bytes]) -> list[list]:
            out, split, whole = [0] * len(texts), [], []
            for i, raw in enumerate(texts):
                s = raw.decode()
                if cut and any(x in s for x in special):
                    out[i] += len(cut.findall(s))
                    parts = cut.split(s)
                else:
                    parts = [s]
                for p in parts:
                    (whole if UNSAFE.search(p) else split).append((i, p))
            tokens = [(i, SPLIT.findall(p)) for i, p in split]
            missing = set()
            for _, found in tokens:
                missing.update(found)
            missing = [x for x in missing if x not in known and x not in cache]
            if len(cache) + len(missing) > CACHE_ENTRIES:
                cache.clear()
                missing = list({x for _, found in tokens for x in found if x not in known})
            cache.update(zip(missing, counted(missing), strict=True))
            for i, found in tokens:
                out[i] += sum([known[x] if x in known else cache[x] for x in found])
            for (i, _), n in zip(whole, counted([p for _, p in whole]), strict=True):
                out[i] += n
            return [[len(t) for t in texts], out, [n > limit for n in out]]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_texts(docs, [id_col], text, fields, make)
