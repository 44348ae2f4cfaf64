"""Token counts by the whole-token shortcut.

Offline, once per vocabulary, every vocabulary string is encoded alone; those that come back as one token are
proven whole. A text is split into pre-tokens as the tokenizer does; each proven pre-token counts as one and
only the others are merged by the library. Counts of pieces seen before are kept in a bounded table of the
worker, so that the work is that of the distinct pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import table
from marketloom.llm.tokens import GLUE, PieceEncoder, arrow_blocks, load_tokenizer, release, vocabulary_path

#: Fixed value: the pattern by which byte-level tokenizers of this kind split a text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def whole_tokens(tok) -> frozenset[str]:
    """The vocabulary strings that the tokenizer gives one token for when they stand alone."""
    ids = range(tok.get_vocab_size(with_added_tokens=False))
    strings = [s for i in ids if (s := tok.decode([i], skip_special_tokens=False)) and "�" not in s]
    encoded = tok.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


class TokenCounter(PieceEncoder):
    """Counts without building ids; texts are cut into pieces as in PieceEncoder."""

    stores_ids = False

    def __init__(self, path: str, whole: frozenset[str], max_pieces: int = 300_000) -> None:
        import regex

        super().__init__(path, max_pieces)
        self.whole = whole
        self.pattern = regex.compile(PRE_TOKEN)

    def _learn(self, new: list[str]) -> dict[str, int]:
        texts = [k[1:] if k[:1] == GLUE else " " + k for k in new]
        split = [self.pattern.findall(t) for t in texts]
        whole = self.whole
        counts = np.fromiter(map(len, split), np.int64, len(new))
        merged = dict.fromkeys(p for own in split for p in own if p not in whole)
        if merged:
            # Parts that begin with their only space can share a text; others are merged one by one.
            plain = [p[1:] for p in merged if len(p) > 1 and p[0] == " " and not p[1:].isspace()]
            rest = [p for p in merged if not (len(p) > 1 and p[0] == " " and not p[1:].isspace())]
            _, lens = self._encode_pieces(plain, rest)
            merged = dict(zip([" " + p for p in plain] + rest, lens.tolist(), strict=True))
            counts += np.fromiter((sum(merged[p] - 1 for p in own if p in merged) for own in split), np.int64, len(new))
        return self._add(new, 0, np.zeros(0, np.uint32), counts)

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        may = self._may_cut(texts)
        out = np.zeros(len(texts), np.int64)
        whole, cut = np.flatnonzero(~may).tolist(), np.flatnonzero(may)
        if len(cut):
            codes, firsts, odd = self.cut(texts if may.all() else texts.take(pa.array(cut)))
            out[cut] = np.add.reduceat(self.len[codes], firsts, dtype=np.int64)
            whole += cut[odd].tolist()
        for k, ids in zip(whole, self._whole([texts[k].as_py() for k in whole]), strict=True):
            out[k] = len(ids)
        return out


class PieceModelCounter:
    """Counts for a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        return np.fromiter(map(len, self.model.encode(texts, num_threads=1)), np.int64, len(texts))


_counters: dict = {}


def counter(path: str, whole: frozenset[str] | None = None):
    """The worker's own counter; ``whole`` is the vocabulary's proof, made here if it is not given."""
    if path not in _counters:
        release()
        if path.endswith(".model"):
            _counters[path] = PieceModelCounter(path)
        else:
            _counters[path] = TokenCounter(path, whole_tokens(load_tokenizer(path)) if whole is None else whole)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text; null counts as empty, with no tokens.

    One pass over the texts in the tasks that read them, no shuffle; the proof of whole tokens is made once, before it,
    and sent to them (its size is that of the vocabulary). Special strings in a text count as the
    library's default has it. Very long texts are counted whole; repeated rows each get their row.
    """
    path = vocabulary_path(vocabulary)
    proof = None if path.endswith(".model") else whole_tokens(load_tokenizer(path))
    held = docs.sparkSession.sparkContext.broadcast(proof)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, held.value).count
        for batch in batches:
            n = [count(texts) for _, texts in arrow_blocks(batch, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(n) if n else [], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
