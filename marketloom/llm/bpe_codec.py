"""Byte-pair encoding by backtracking, and decoding by an offset table.

A sequence of tokens is the byte-pair encoding of its bytes exactly when each of its tokens encodes alone as itself and
every two neighbours are compatible, i.e. the merges across their border never get their turn. So an encoder may go from the end
of a text to its beginning, take the longest token that ends at a place (found by an Aho-Corasick automaton over all tokens), look
up whether it is compatible with the one behind it, try its shorter suffixes if not, and step back where none fits; a place from
which no way leads on is marked and never tried again, which keeps the work linear in the text. Verdicts on pairs are kept in a table.

Decoding is a gather from one array of all tokens' bytes by their offsets.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import table
from marketloom.llm.token_counts import PRE_TOKEN
from marketloom.llm.tokens import PieceEncoder, arrow_blocks, release, vocabulary_path

#: A rank beyond all merges: the token is never merged further.
NEVER = np.int64(1) << 40
#: Slots of the table of pairs, a power of two.
PAIRS = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenAutomaton:
    """Aho-Corasick over byte strings as one dense table: ``ending`` is the longest string that ends where a state is reached,
    ``shorter`` the longest other string at the end of each string (-1: none)."""

    def __init__(self, strings: dict[bytes, int], size: int) -> None:
        at: dict[bytes, int] = {b"": 0}
        for s in strings:
            for k in range(1, len(s) + 1):
                at.setdefault(s[:k], len(at))
        self.next = np.zeros((len(at), 256), np.int32)
        self.ending = np.full(len(at), -1, np.int32)
        self.shorter = np.full(size, -1, np.int32)
        fail = np.zeros(len(at), np.int32)  # the state of a string's longest proper suffix
        for _, level in itertools.groupby(sorted(list(at)[1:], key=len), len):
            own = list(level)
            state, parent = (np.array([at[s[:k]] for s in own], np.int64) for k in (None, -1))
            byte = np.array([s[-1] for s in own])
            token = np.array([strings.get(s, -1) for s in own], np.int32)
            back = np.where(parent > 0, self.next[fail[parent], byte], 0)
            self.next[parent, byte] = state
            self.next[state] = self.next[back]  # suffixes are shorter, so their rows are complete by now
            fail[state] = back
            self.ending[state] = np.where(token >= 0, token, self.ending[back])
            self.shorter[token[token >= 0]] = self.ending[back[token >= 0]]

    def longest_ending(self, data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For every byte, the longest string that ends with it within its slice. All slices advance together."""
        out = np.full(len(data), -1, np.int32)
        order = np.argsort(-lens, kind="stable")
        at, left = begin[order], -lens[order]
        state = np.zeros(len(order), np.int32)
        for k in range(int(-left[0]) if len(left) else 0):
            n = int(np.searchsorted(left, -k, "left"))
            here = at[:n] + k
            state[:n] = self.next[state[:n], data[here]]
            out[here] = self.ending[state[:n]]
        return out


class MergeRules:
    """Tokens, merges and lookups of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        text: list[bytes] = [b""] * size
        for token, i in vocab.items():
            text[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            text[i] = token.encode()
        self.known = np.zeros(size, bool)
        self.known[[*vocab.values(), *self.special.values()]] = True
        # The offset table: token i is pool[offset[i] : offset[i] + size[i]].
        self.size = np.array([len(x) for x in text], np.int32)
        self.offset = np.cumsum(self.size, dtype=np.int64) - self.size
        self.pool = np.frombuffer(b"".join(text), np.uint8)
        # Merge k makes token made[k] of two others; a token is born at its merge's rank, single bytes at -1.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.n = size
        self.born = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        rank = np.arange(len(pairs))
        self.born[made], self.left[made], self.right[made] = rank, a, b
        order = np.argsort(a * size + b, kind="stable")
        self.pair_key = (a * size + b)[order]
        self.pair_rank = rank[order]
        whole = self.single = np.zeros(size, bool)
        whole[[i for i in vocab.values() if self.size[i] == 1]] = True
        # A merged token encodes alone as itself if its halves do and nothing across their border comes before its merge.
        clean = ~self._conflict(a, b, rank)
        for i, x, y, ok in zip(made.tolist(), a.tolist(), b.tolist(), clean.tolist(), strict=True):
            whole[i] = ok and whole[x] and whole[y]
        found = np.flatnonzero(whole).tolist()
        self.id_of = {text[i]: i for i in found}
        as_text = {i: text[i].decode("utf-8", "ignore") for i in found}
        self.id_of_text = {t: i for i, t in as_text.items() if len(t.encode()) == len(text[i])}
        self.automaton = TokenAutomaton(self.id_of, size)
        self.shorter = self.automaton.shorter
        # The pair table: key * 2 + verdict in the slot that the key hashes to; a newer pair takes an older one's place.
        self.pairs = np.full(PAIRS, -1, np.int64)

    def _conflict(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether a merge across the border of ``a`` and ``b`` comes before rank ``limit``.

        From the pair itself back in time: of the two tokens at the border, the one born later is replaced by its
        half at the border. Both then exist until the earlier of their own merges, so a merge of the two conflicts if its rank
        is below; on equal ranks the left pair goes first.
        """
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        x_end, y_end = limit.copy(), limit - 1
        while len(live):
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            hit = (rank < x_end) & (rank <= y_end)
            out[live[hit]] = True
            born_x, born_y = self.born[x], self.born[y]
            go = ~hit & ((born_x >= 0) | (born_y >= 0))
            live, x, y, x_end, y_end, born_x, born_y = (v[go] for v in (live, x, y, x_end, y_end, born_x, born_y))
            older = born_x > born_y
            x_end, y_end = np.where(older, born_x, x_end), np.where(older, y_end, born_y)
            x, y = np.where(older, self.right[x], x), np.where(older, y, self.left[y])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` may stand side by side; a negative ``b`` is the end of a text."""
        key = a.astype(np.int64) * self.n + b
        slot = ((key * np.int64(0x9E3779B97F4A7C1)) >> 20) & (PAIRS - 1)
        held = self.pairs[slot]
        ok = (held & 1).astype(bool)
        new = np.flatnonzero((held >> 1 != key) & (b >= 0))
        if len(new):
            own, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            lone = new[first]
            verdict = ~self._conflict(a[lone].astype(np.int64), b[lone].astype(np.int64), np.full(len(lone), NEVER))
            self.pairs[slot[lone]] = own * 2 + verdict
            ok[new] = verdict[back]
        return ok | (b < 0)

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and the number of ids of each. All of them advance together."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        stop = np.cumsum(lens)
        begin = stop - lens
        ending = self.automaton.longest_ending(data, begin, lens)
        taken = np.full(len(data) + 1, -1, np.int32)  # the token of the present way that begins at a place
        dead = np.zeros(len(data) + 1, bool)
        live = np.flatnonzero(lens)
        goal, edge = begin[live], stop[live]
        pos, last, try_ = edge.copy(), np.full(len(live), -1, np.int32), ending[edge - 1]
        while len(pos):
            some = try_ >= 0
            to = pos - np.where(some, self.size[try_], 0)
            fits = some & ~dead[to]
            fits[fits] = self.compatible(try_[fits], last[fits])
            taken[to[fits]] = try_[fits]
            # Go on before the token taken, or try a shorter one, or step back where there is none.
            back = np.flatnonzero(~some)
            gone, place = last[back], pos[back]
            if (gone < 0).any():
                raise ValueError("the vocabulary has no token for a byte")
            dead[place], taken[place] = True, -1
            try_, last, pos = np.where(fits, ending[to - 1], self.shorter[try_]), np.where(fits, try_, last), np.where(fits, to, pos)
            pos[back] = home = place + self.size[gone]
            try_[back] = self.shorter[gone]
            last[back] = np.where(home < edge[back], taken[home], -1)
            go = pos > goal
            if not go.all():
                pos, goal, edge, last, try_ = (v[go] for v in (pos, goal, edge, last, try_))
        found = taken >= 0
        count = np.append(0, np.cumsum(found))
        return taken[found].astype(np.uint32), count[stop] - count[begin]

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, and each row's end in them. Unknown ids give nothing, as in the library."""
        good = (ids >= 0) & (ids < self.n)
        good[good] = self.known[ids[good]]
        rows = np.append(0, np.cumsum(good))[offsets]
        ids = ids[good]
        lens = self.size[ids]
        ends = np.cumsum(lens, dtype=np.int64)
        place = np.repeat(self.offset[ids] - ends + lens, lens)
        place += np.arange(len(place))
        return self.pool[place], np.append(0, ends)[rows]


class BacktrackingEncoder(PieceEncoder):
    """Texts are cut into pieces and pieces kept as in PieceEncoder; new ones are encoded by ``MergeRules``."""

    def __init__(self, path: str, max_pieces: int = 300_000) -> None:
        import regex

        super().__init__(path, max_pieces)
        if not self.cuts:
            raise ValueError(f"{path} is no byte-level vocabulary that splits texts by the known pattern")
        self.tok = None  # only the table of pieces is used of the base class
        self.rules = rules(path)
        self.pattern = regex.compile(PRE_TOKEN)
        by_length = sorted(self.rules.special, key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None

    def _parts(self, text: str) -> Iterator[str | int]:
        """A text's pre-tokens in order, and the ids of the special strings in it."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            yield from self.pattern.findall(text[at : m.start()])
            yield self.rules.special[m.group()]
            at = m.end()
        yield from self.pattern.findall(text[at:])

    def _flat(self, texts: list[str], special: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and each text's number of ids. ``special``: special strings may occur."""
        number: dict[str | int, int] = {}
        row, sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                row.append(number.setdefault(text, len(number)))
                sizes[k] = 1
            else:
                own = list(self._parts(text)) if special else self.pattern.findall(text)
                row.extend([number.setdefault(p, len(number)) for p in own])
                sizes[k] = len(own)
        known = self.rules.id_of_text
        lone = np.fromiter((p if isinstance(p, int) else known.get(p, -1) for p in number), np.int64, len(number))
        split = [p.encode() for p, i in zip(number, lone.tolist(), strict=True) if i < 0]
        lens = np.ones(len(lone), np.int64)
        ids, lens[lone < 0] = self.rules.encode_parts(split)
        pool = np.repeat(lone, lens)
        pool[pool < 0] = ids
        at = np.cumsum(lens) - lens
        own = np.array(row, np.int64)
        each = lens[own]
        ends = np.append(0, np.cumsum(each))
        flat = pool[np.repeat(at[own] - ends[:-1], each) + np.arange(ends[-1])].astype(np.uint32)
        stops = ends[np.cumsum(sizes)]
        return flat, np.diff(stops, prepend=0)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        flat, lens = self._flat(texts, True)
        return np.split(flat, np.cumsum(lens)[:-1]) if texts else []

    def _encode_pieces(self, plain: list[str], rest: list[str], lines: list[str] | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        return self._flat([" " + x for x in plain] + rest + ["\n" + x for x in lines], False)


_encoders: dict[str, BacktrackingEncoder] = {}
_rules: dict[str, MergeRules] = {}


def encoder(path: str) -> BacktrackingEncoder:
    """The worker's own encoder, kept between batches and tasks."""
    if path not in _encoders:
        release()
        _encoders[path] = BacktrackingEncoder(path)
    return _encoders[path]


def rules(path: str) -> MergeRules:
    if path not in _rules:
        _rules[path] = MergeRules(path)
    return _rules[path]


def decoded(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts from bytes; what is no UTF-8 becomes U+FFFD as in the library."""
    held = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        held.validate(full=True)
    except pa.ArrowInvalid:
        raw = data.tobytes()
        held = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends.tolist())], pa.string())
    return held


def id_lists(rows: list[np.ndarray]) -> tuple[np.ndarray, pa.ListArray]:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.int32)
    return flat, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", read_back: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row's whole text, as the tokenizers library encodes it without special tokens around.

    With ``read_back`` also ``decoded``, the text that ``decode`` makes of the ids, from the same pass. One pass in the tasks that
    read the texts, in batches of about 3 MB or one longer text; no shuffle. Null counts as empty, with no ids. Special strings
    inside a text become their ids. Repeated rows each get their row; extra columns are not read.
    """
    path = vocabulary_path(vocabulary)
    schema = "doc_id bigint, ids array<int>" + ", decoded string" * read_back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in arrow_blocks(batch, 1):
                flat, ids = id_lists(encoder(path).encode(texts))
                columns = [batch.column(0).slice(start, len(texts)), ids]
                if read_back:
                    columns.append(decoded(*rules(path).decode_bytes(flat, ids.offsets.to_numpy())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``rows`` (``doc_id, ids``) with ``decoded``: the ids' bytes as text, special tokens included.

    Null ids give an empty text, ids without a token nothing; bytes that are no UTF-8 become U+FFFD.
    """
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            for start in range(0, batch.num_rows, 512):
                own = ids.slice(start, 512)
                flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                offsets = np.append(0, np.cumsum(own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                texts = decoded(*rules(path).decode_bytes(flat, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 512), own, texts], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), read_back=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
