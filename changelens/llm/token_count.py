"""Token counts under a word-end BPE vocabulary, with a whole-token shortcut.

Offline, each vocabulary string with a word-end mark is proved to encode alone as one token: the tokenizer itself
must turn the string into that single id.  Texts are normalised and cut into pre-tokens as the vocabulary file
says; pre-tokens among the proved strings count one each without a merge, and only the rest are merged by the
library, once per distinct pre-token and task.

Special strings inside a text are matched on the raw text and count one token each, as the library does by default.
Defined results.  Null text: as the empty text, zero tokens.  Repeated rows: one row out for each.  Empty table: no
rows.  Other columns are ignored.  A text of any length is counted whole.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import work

LIMIT = 2048
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: Fixed value: the pre-token pattern of the vocabulary file, with white space as the library's engine sees it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Most distinct pre-tokens that a task remembers before it starts afresh, and the longest of them, in characters.
MEMORY, LONG = 1 << 18, 64


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, as character to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def normalise(text: str) -> str:
    """NFC, then lower case character by character; white space needs no folding, as it only separates."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def whole_tokens(path: str) -> list[str]:
    """The pre-tokens that are proved to be one token."""
    from tokenizers import Tokenizer

    tokenizer, chars = Tokenizer.from_file(path), byte_chars()
    pattern = regex.compile(PRETOKEN)
    found = []
    for name, key in tokenizer.get_vocab(with_added_tokens=False).items():
        if name.endswith("</w>") and all(c in chars for c in name[:-4]):
            try:
                s = bytes(chars[c] for c in name[:-4]).decode()
            except UnicodeDecodeError:
                continue
            if s and normalise(s) == s and pattern.findall(s) == [s]:
                found.append((s, key))
    proved = tokenizer.encode_batch([s for s, _ in found], add_special_tokens=False)
    return sorted(s for (s, key), e in zip(found, proved, strict=True) if e.ids == [key])


class _Costs(dict):
    """Tokens of each pre-token: one for the proved, merged by the library for the rest."""

    def __init__(self, tokenizer, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole = tokenizer, whole

    def __missing__(self, token: str) -> int:
        if len(self) > len(self.whole) + MEMORY:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(token) <= LONG:
            self[token] = n
        return n


def counter(path: str, whole: list[str]):
    """A function from text to its number of tokens."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
    pretokens = regex.compile(PRETOKEN).findall
    costs = _Costs(Tokenizer.from_file(path), whole)
    get = costs.__getitem__

    def count(text: str) -> int:
        n = len(split.findall(text)) if "<|" in text else 0
        return n + sum(sum(map(get, pretokens(normalise(part)))) for part in (split.split(text) if n else (text,)))

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.  ``path``: a vocabulary file that every executor has."""
    whole = work.share(docs.sparkSession, whole_tokens(path))  # at most the vocabulary's size

    def run(batches):
        count = counter(path, whole.value)
        for b in batches:
            values = work.texts(b.column(1))
            n = [count(v.decode()) if v else 0 for v in values]
            yield work.batch(COUNTS, b.column(0), [len(v) if v else 0 for v in values], n, [x > limit for x in n])

    src = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(work.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
