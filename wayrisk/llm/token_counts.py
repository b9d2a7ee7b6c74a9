"""Token counts with a whole-token shortcut (operator 1).

A vocabulary string that encodes alone as one token is proved once, on the
driver, by encoding it. Counting then looks pre-tokens up in the proved set and
runs BPE merges only for the rest. White space is dropped by this vocabulary
and never crosses a pre-token, so the count of a text is the sum over its
white-space-free chunks; each worker remembers the counts of recent chunks.

Defined results: null or empty text counts 0 tokens; texts with characters
outside the proved range, or with one of the special strings, go to the library
as a whole. Repeated rows are counted each, also without an id; other columns are
ignored, whatever they are named.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that NFC keeps as they are and for which all Unicode versions agree on case and class.
SAFE_RANGES = ((0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x203B), (0x20A0, 0x20BF))
SAFE_SPACE = "\t\n\r"
MEMO_ENTRIES = 400_000
LONGEST_MEMO = 64


def _class(kind: str) -> str:
    chars = [c for lo, hi in SAFE_RANGES for c in map(chr, range(lo, hi + 1)) if unicodedata.category(c)[0] == kind]
    return "".join(map(re.escape, chars))


def safe_pattern() -> re.Pattern:
    """Matches texts made only of characters in SAFE_RANGES or SAFE_SPACE."""
    return re.compile(f"[{SAFE_SPACE}{''.join(f'{re.escape(chr(lo))}-{re.escape(chr(hi))}' for lo, hi in SAFE_RANGES)}]*")


def pretoken_pattern() -> re.Pattern:
    """The pre-token pattern of the word vocabulary, over the safe characters."""
    letter, number = _class("L"), _class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\s{letter}{number}]+")


def _bytes_of_chars() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(tokenizer_path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as exactly one token. At most one per vocabulary entry."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok, alphabet = Tokenizer.from_file(tokenizer_path), _bytes_of_chars()
    safe, pre = safe_pattern(), pretoken_pattern()
    strings = []
    for entry in tok.get_vocab(with_added_tokens=False):
        if not entry.endswith("</w>"):
            continue
        try:
            s = bytes(alphabet[c] for c in entry[:-4]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if s and s == s.lower() and safe.fullmatch(s) and pre.findall(s) == [s]:
            strings.append(s)
    encoded = tok.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


class ChunkCounts(dict):
    """Tokens of a white-space-free, lower-case chunk; bounded memo."""

    def __init__(self, tok, whole: frozenset[str]):
        super().__init__()
        self.tok, self.whole, self.pre = tok, whole, pretoken_pattern()

    def __missing__(self, chunk: str) -> int:
        n, rest = 0, []
        for p in self.pre.findall(chunk):
            if p in self.whole:
                n += 1
            else:
                rest.append(p)
        n += sum(len(self.tok.encode(p, add_special_tokens=False).ids) for p in rest)
        if len(chunk) <= LONGEST_MEMO:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = n
        return n


def counter(tokenizer_path: str, whole: frozenset[str]):
    """A function from text to its number of tokens, equal to the library's."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(tokenizer_path)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    chunks, safe = ChunkCounts(tok, whole), safe_pattern()

    def count(text: str | None) -> int:
        if not text:
            return 0
        if not safe.fullmatch(text) or any(s in text for s in specials):
            return len(tok.encode(text, add_special_tokens=False).ids)
        return sum(map(chunks.__getitem__, text.lower().split()))

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer_path))
    id_type = docs.schema[id_col].dataType
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path, whole.value)
        for b in batches:
            n = [count(t.as_py()) for t in b.column(1)]
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), n_bytes], ["id", "n_tokens", "n_bytes"])

    out = given.mapInArrow(run, f"id {id_type.simpleString()}, n_tokens long, n_bytes long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
