"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_or_empty

BATCH_BYTES = 1 << 20
MEMO_WORDS = 1 << 19  # measured words a worker keeps before it starts afresh
_COUNTERS: dict = {}


class Counter:
    """Token counts for one vocabulary file.

    ``.json`` files are read by *tokenizers*, ``.model`` files by *sentencepiece*. Where white space is
    dropped before merging, a token never spans two words, so every run of white space is a safe
    boundary: a text of any length is cut into its words, each different word is encoded once and its
    length kept. Other vocabularies get whole texts, as a cut could change their counts.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
        self.memo: dict[bytes, int] = {}
        self.limit = memo_words
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.words_apart = False
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as file:
                self.words_apart = _drops_white_space(json.load(file))
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def _measure(self, pieces: list[str], batch_bytes: int) -> list[int]:
        """Lengths of the pieces, encoded in batches of about equal bytes."""
        out, batch, held = [], [], 0
        for piece in pieces:
            batch.append(piece)
            held += len(piece) + 16
            if held >= batch_bytes:
                out += self.encode(batch)
                batch, held = [], 0
        return out + (self.encode(batch) if batch else [])

    def counts(self, texts: list[bytes], batch_bytes: int = BATCH_BYTES) -> list[int]:
        if not self.words_apart:
            return self._measure([t.decode() for t in texts], batch_bytes)
        if len(self.memo) > self.limit:
            self.memo.clear()
        memo = self.memo
        split = [t.split() for t in texts]  # ASCII white space only
        new = list({w for words in split for w in words if w not in memo})
        memo.update(zip(new, self._measure([w.decode() for w in new], batch_bytes), strict=True))
        return [sum(map(memo.__getitem__, words)) for words in split]


def _drops_white_space(spec: dict) -> bool:
    """True for pre-tokenizers that split by a pattern of non-space runs, drop the rest and add no prefix."""
    parts = spec.get("pre_tokenizer") or {}
    parts = parts.get("pretokenizers", [parts])
    special = [t for t in spec.get("added_tokens", []) if any(c.isspace() for c in t["content"]) or t.get("single_word")]
    return bool(parts) and not special and any(
        p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed" for p in parts
    ) and not any(p.get("add_prefix_space") for p in parts)


def counter(path: str) -> Counter:
    """One counter a worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def by_bytes(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive texts in groups of about ``limit`` bytes; a longer text stands alone."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``id, n_bytes, n_tokens`` of every text with the vocabulary file ``tokenizer`` (a path on the workers).

    No begin, end or added special tokens; special strings inside a text count as the library's default
    does. Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows and ids are
    counted one by one; other columns are left out, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("_b"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            sizes, counts = [], []
            texts = batch.column(1).to_pylist()
            for group in by_bytes(texts, 4 * batch_bytes):
                sizes += [len(t) for t in group]
                counts += own.counts(group, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["_id", "n_bytes", "n_tokens"]
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
