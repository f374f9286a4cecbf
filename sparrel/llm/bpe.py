"""BPE encoding and decoding (operator 5).

Encoding backtracks over longest vocabulary matches. An Aho-Corasick automaton
over the reversed tokens finds the longest token that begins at every byte. Two
neighbouring tokens are compatible if merging their bytes in rank order would
leave the border between them; answers are kept in a table. A greedy walk that
shortens or takes back tokens whenever a neighbour is incompatible ends at the
one segmentation that merging would give. Each position is given up at most once,
so the time is linear. Decoding gathers bytes by a table of token offsets.

Distinct pre-tokens are encoded once for each slice of texts, with a bounded
cache in the Python worker. Nothing is shuffled.
"""

from __future__ import annotations

import json
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import coded, map_slices, raw, spans, string_array
from .pretok import byte_level

#: Distinct pre-tokens that a worker keeps.
CACHE_PIECES = 250_000
#: Bytes of text that are worked on at once; the indices that gather decoded bytes take 24 times as much.
SLICE = 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its tables. ``path``: a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbol = spec["model"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in model["vocab"].items():
            self.tokens[i] = bytes(symbol[c] for c in text)
        ids = {self.tokens[i]: i for i in model["vocab"].values()}
        self.base = len(model["vocab"]) - len(model["merges"])
        self.left, self.right, self.joined = [-1] * size, [-1] * size, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.base + rank
            if self.tokens[made] != self.tokens[a] + self.tokens[b]:
                raise ValueError(f"{path}: ids do not follow the order of merges")
            self.left[made], self.right[made], self.joined[a << 32 | b] = a, b, made
        self.length = [len(t) for t in self.tokens]
        self.shorter = [-1] * size
        self.ends_at = ahocorasick.Automaton()
        for token, i in ids.items():
            self.ends_at.add_word(token[::-1].decode("latin-1"), i)
            self.shorter[i] = next((ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids), -1)
        self.ends_at.make_automaton()
        self.compatible: dict[int, bool] = {}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.arena = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.pieces: dict[bytes, tuple[int, ...]] = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether the border between a and b survives: parts are unmade from the latest merge back."""
        limit = 1 << 62
        while True:
            if self.joined.get(a << 32 | b, limit) < limit:
                return False
            if a < self.base and b < self.base:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, token in self.ends_at.iter(piece[::-1].decode("latin-1")):
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        out: list[int] = []
        length, compatible, given_up = self.length, self.compatible, bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            ok = not given_up[end]
            if ok and out:
                key = out[-1] << 32 | token
                ok = compatible.get(key)
                if ok is None:
                    if len(compatible) > 1_000_000:
                        compatible.clear()
                    ok = compatible[key] = self._fits(out[-1], token)
            if ok:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                given_up[at] = 1
                token = out.pop()
                at -= length[token]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and n + 1 offsets. NULL counts as empty; special strings become their ids."""
        texts = pc.fill_null(texts, "")
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            return self._encode_special(texts)
        flat, off = byte_level(texts)
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        distinct, codes = coded(flat)
        known, found = self.pieces, []
        for piece in distinct.to_pylist():
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece))
                if len(known) >= CACHE_PIECES:
                    known.clear()
                known[piece] = ids
            found.append(ids)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        arena = np.fromiter((i for ids in found for i in ids), np.int64, int(lens.sum()))
        starts = np.cumsum(lens) - lens
        lens = lens[codes]
        ids = arena[spans(starts[codes], lens)]
        return ids, np.concatenate([[0], np.cumsum(lens)])[off]

    def _encode_special(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for texts with special strings: what stands between them is encoded as texts of its own."""
        plain, rows, marks = [], [], []
        names = sorted(self.special, key=len, reverse=True)
        for text in texts.to_pylist():
            row = []
            while text is not None:
                hit = min(((text.find(s), -len(s), s) for s in names if s in text), default=None)
                row.append(len(plain))
                plain.append(text if hit is None else text[: hit[0]])
                marks.append(None if hit is None else self.special[hit[2]])
                text = None if hit is None else text[hit[0] - hit[1] :]
            rows.append(row)
        ids, off = self.encode(pa.array(plain, pa.string()))
        parts, lens = [], []
        for row in rows:
            got = [x for k in row for x in (ids[off[k] : off[k + 1]], [] if marks[k] is None else [marks[k]])]
            parts += got
            lens.append(sum(map(len, got)))
        return np.concatenate([np.asarray(p, np.int64) for p in parts]), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, flat, and n + 1 offsets; ids outside the vocabulary add nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes))
        sizes = np.append(self.sizes, 0)
        lens = sizes[ids]
        return self.arena[spans(self.offsets[ids], lens)], np.concatenate([[0], np.cumsum(lens)])[off]

    def texts(self, data: np.ndarray, off: np.ndarray) -> list[str]:
        """Decoded bytes as text; bytes that aren't UTF-8 become U+FFFD."""
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids of every text: (id, ids array<int>), a row for each input row.

    NULL and empty texts have no ids. Repeated rows stay repeated, other columns
    are left out, and an empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, off = codec(path).encode(part.column(1))
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, ids array<int>", SLICE)


def decode(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """The text of every list of ids: (id, text). NULL lists give empty texts."""
    rows = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    kind = rows.schema[0].dataType.simpleString()
    from .common import ship

    def run(batches):
        for part in batches:
            lists = part.column(1)
            lists = pc.if_else(pc.is_null(lists), pa.scalar([], lists.type), lists)
            off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            book = codec(path)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(book.texts(*book.decode(ids, off)), pa.string())], ["id", "text"])

    ship(tokens.sparkSession)
    return rows.mapInArrow(run, f"id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are those of the decimal ids joined by commas and of the decoded
    text. NULL counts as an empty text.
    """
    import hashlib

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def sha(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
        view = memoryview(np.ascontiguousarray(data))
        return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        book = codec(path)
        ids, off = book.encode(part.column(1))
        names, name_off = _decimal(len(book.sizes))
        lens = (name_off[1:] - name_off[:-1])[ids]
        listed = names[spans(name_off[ids], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[off]
        a, b = ends[:-1], ends[1:] - (off[1:] > off[:-1])
        data, at = book.decode(ids, off)
        if _valid(data):
            decoded = sha(data, at[:-1], at[1:])
        else:
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in book.texts(data, at)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off), pa.int64()), pa.array(sha(listed, a, b)), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(rows, "text", run, f"id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", SLICE)


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@cache
def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with a comma after it: bytes and offsets."""
    return (raw(pa.array([f"{i}," for i in range(n)]))[1].copy(), raw(pa.array([f"{i}," for i in range(n)]))[0])
