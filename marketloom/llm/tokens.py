"""Exact token ids of many texts, at the cost of their distinct pieces.

A byte-level tokenizer that splits with the GPT-2 pattern never lets a token cross a space that follows a
non-space or precedes one, nor pass from a letter or digit to punctuation, nor over a single line break. So a text
can be cut there and each piece encoded once; ids of pieces seen before come from a bounded table of the worker. Texts for which the cut could matter (white space on both
sides of a space, or a special string inside) are encoded whole. Either way the ids are those that the tokenizers
library gives for the whole text.

Texts stay in Arrow: they are split and their distinct pieces found there, and only these become Python strings.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks a piece that no space precedes. Texts that hold it are encoded whole.
GLUE = "\x01"
#: Cuts besides spaces: before punctuation after a letter or digit, and before a single line break.
CUTS = (("([0-9A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?#*$&|%<>()]+)", rf"\1 {GLUE}\2"), (r"([^\s])\n([^\s])", rf"\1 {GLUE}" + "\n" + r"\2"))

_encoders: dict = {}


def vocabulary_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def splits_at_spaces(path: str) -> bool:
    """Whether the vocabulary file's tokenizer is byte-level with the GPT-2 pattern, on unchanged text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    plain = not pre.get("add_prefix_space") and not spec.get("normalizer")
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and plain


class PieceEncoder:
    """Encodes batches of texts; ``max_pieces`` bounds the table of pieces kept between batches.

    ``stores_ids`` is false for counters, which keep the numbers of ids alone. A batch's new pieces come on top. When the table is over its bound, the half that was met most often stays.
    """

    stores_ids = True

    def __init__(self, path: str, max_pieces: int = 300_000) -> None:
        self.tok = load_tokenizer(path)
        self.cuts = splits_at_spaces(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.max_pieces = max_pieces
        size = self.tok.get_vocab_size(with_added_tokens=True)
        firsts = [(self.tok.id_to_token(i) or "")[:1] for i in range(size)]
        self.begins = {" ": np.array([c == "Ġ" for c in firsts]), "\n": np.array([c == "Ċ" for c in firsts])}
        self.slot: dict[str, int] = {}
        self.slots = self.used = 0
        self.at = np.zeros(1024, np.int32)
        self.len = np.zeros(1024, np.int32)
        self.met = np.zeros(1024, np.int32)
        self.white = np.zeros(1024, np.int8)  # 1: empty or begins with white space; 2: empty or ends so
        self.pool = np.zeros(8192, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str] | tuple, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``lead + piece`` for pieces that hold no lead, and each one's number of ids.

        Many are encoded as one text, in which a token that begins with ``lead`` begins a piece.
        """
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), 512):
            block = pieces[k : k + 512]
            own = self._whole([lead + lead.join(block)])[0]
            starts = np.flatnonzero(self.begins[lead][own])
            if len(starts) != len(block):
                each = self._whole([lead + x for x in block])
                own, starts = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            ids.append(own)
            lens.append(np.diff(starts, append=len(own)))
        return np.concatenate(ids), np.concatenate(lens)

    def _encode_pieces(self, plain: list[str], rest: list[str], lines: list[str] | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and each piece's number of ids: plain ones after a space, the rest as they
        are, lines after a line break. Plain pieces and lines have no white space at their ends."""
        done = [self._joined(plain, " "), *((own, [len(own)]) for own in self._whole(rest)), self._joined(lines, "\n")]
        return np.concatenate([ids for ids, _ in done]), np.concatenate([lens for _, lens in done])

    def _add(self, keys: list[str], plain: int, ids: np.ndarray, lens: np.ndarray) -> dict[str, int]:
        """Append pieces, the first of which are plain, to the table: their slots."""
        first, end, used = self.slots, self.slots + len(keys), self.used + len(ids)
        if end > len(self.at):
            for name in ("at", "len", "met", "white"):
                setattr(self, name, np.resize(getattr(self, name), 2 * end))
        if used > len(self.pool):
            self.pool = np.resize(self.pool, 2 * used)
        self.len[first:end] = lens
        self.at[first:end] = self.used + np.cumsum(lens) - lens
        self.met[first:end] = 0
        self.white[first : first + plain] = 0
        self.white[first + plain : end] = [
            (not k or k[0].isspace()) + 2 * (not k or k[-1].isspace()) for k in (k.removeprefix(GLUE) for k in keys[plain:])
        ]
        self.pool[self.used : used] = ids
        self.slots, self.used = end, used
        found = dict(zip(keys, range(first, end), strict=True))
        self.slot.update(found)
        return found

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and where each piece ends."""
        lens = self.len[codes]
        ends = np.cumsum(lens, dtype=np.int32)
        shift = self.at[codes]
        shift -= ends
        shift += lens
        place = np.repeat(shift, lens)
        place += np.arange(len(place), dtype=np.int32)
        return self.pool[place], ends

    def _learn(self, new: list[str]) -> dict[str, int]:
        """Slots for new keys: pieces without the space before them, marked if there is none."""
        plain, rest, lines = [], [], []
        for k in new:
            if not k or k[0].isspace() or k[-1].isspace():
                rest.append(k)
            elif k[0] != GLUE:
                plain.append(k)
            elif len(k) > 2 and k[1] == "\n" and not k[2].isspace() and "\n" not in k[2:]:
                lines.append(k)
            else:
                rest.append(k)
        texts = [k[1:] if k[:1] == GLUE else " " + k for k in rest]
        return self._add(plain + rest + lines, len(plain), *self._encode_pieces(plain, texts, [k[2:] for k in lines]))

    def _codes(self, keys: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.slot.get, keys, itertools.repeat(-1)), np.int32, len(keys))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            lost = [keys[i] for i in missing]
            found = self._learn(list(dict.fromkeys(lost)))
            codes[missing] = [found[k] for k in lost]
        return codes

    def _shrink(self) -> None:
        """Keep the half of the bound that was met most often."""
        keep = np.sort(np.argsort(-self.met[: self.slots], kind="stable")[: self.max_pieces // 2])
        pool, ends = self._gather(keep) if self.stores_ids else (self.pool[:0], np.cumsum(self.len[keep], dtype=np.int32))
        self.pool = pool
        place = np.full(self.slots, -1, np.int64)
        place[keep] = np.arange(len(keep))
        for name in ("len", "met", "white"):
            setattr(self, name, getattr(self, name)[keep])
        self.at = (ends - self.len).astype(np.int32)
        self.met //= 2
        self.slot = {k: n for k, n in zip(self.slot, place[list(self.slot.values())].tolist(), strict=True) if n >= 0}
        self.slots, self.used = len(keep), len(self.pool)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the pieces of all texts, the place of each text's first piece, and which texts must not be cut."""
        if self.slots > self.max_pieces:
            self._shrink()
        for pattern, cut in CUTS:
            texts = pc.replace_substring_regex(texts, pattern, cut)
        parts = pc.split_pattern(pc.binary_join_element_wise(GLUE, texts, ""), " ")
        firsts = parts.offsets.to_numpy()[:-1]
        coded = parts.values.dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self.met[: self.slots] += np.bincount(codes, minlength=self.slots).astype(np.int32)
        # A space with white space on both sides, or before it and the end behind it, may join a longer run.
        odd = self.white[codes] & 1 != 0
        odd[1:] &= self.white[codes[:-1]] & 2 != 0
        odd[firsts] = False
        return codes, firsts, np.logical_or.reduceat(odd, firsts)

    def _may_cut(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold no special string."""
        may = np.full(len(texts), self.cuts)
        for s in (GLUE, *self.special):
            may &= ~pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return may

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        may = self._may_cut(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = np.flatnonzero(~may).tolist()
        cut = np.flatnonzero(may)
        if len(cut):
            codes, firsts, odd = self.cut(texts if may.all() else texts.take(pa.array(cut)))
            flat, ends = self._gather(codes)
            last = ends[np.append(firsts[1:], len(codes)) - 1]
            for k, ids, other in zip(cut.tolist(), np.split(flat, last[:-1]), odd.tolist(), strict=True):
                if other:
                    whole.append(k)
                else:
                    out[k] = ids
        for k, ids in zip(whole, self._whole([texts[k].as_py() for k in whole]), strict=True):
            out[k] = ids
        return out

    def count(self, texts: list[str] | pa.Array) -> np.ndarray:
        return np.fromiter(map(len, self.encode(texts)), np.int64, len(texts))


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for a vocabulary file; kept between batches and tasks."""
    if path not in _encoders:
        release()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def release() -> None:
    """Free the tables that earlier stages left in this reused worker."""
    _encoders.clear()


def arrow_blocks(batch: pa.RecordBatch, column: int, size: int = 3_000_000) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a batch in blocks of about ``size`` bytes, one row at least, each with its first row's number."""
    texts = batch.column(column)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def text_blocks(batch: pa.RecordBatch, column: int, size: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """The same as Python strings, one block at a time."""
    for start, texts in arrow_blocks(batch, column, size):
        yield start, texts.to_pylist()
