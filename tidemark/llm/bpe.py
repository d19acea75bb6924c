"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  A segment tree over the byte
positions holds the leftmost minimum rank of the live neighbouring pairs; a merge takes the
root, joins the pair through the list of live neighbours and updates the three touched
leaves and their ancestors, so a pre-token of n bytes costs O(n log n).

Pre-tokens that are not yet known are merged many at a time: the trees of one width are
columns of one numpy array and one step does one merge in each of them.  Long pre-tokens
take the same tree one at a time.  Known pre-tokens come from a cache, which is emptied when
it is full; that changes no result.

Null text counts as empty text: no tokens, empty bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WIDTH = 64  # pre-tokens up to so many bytes are merged many at a time
WIDTHS = [max(4, 1 << max(n - 1, 1).bit_length()) for n in range(BATCH_WIDTH + 1)]
CACHE_ENTRIES = 600_000
OUT_BYTES = 4_000_000  # text in one Arrow batch of results
INF = np.int64(1) << 60


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """The entries of a .tiktoken file: base64 token, space, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}


class Encoder:
    """Encodes text by merge ranks; ``encode`` gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.chunks: dict[str, bytes] = {}

    # -- one pre-token -------------------------------------------------------------------
    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by a scalar segment tree: about 60 bytes of arrays for each of its bytes."""
        n = len(piece)
        if n == 0:
            return []
        width = 1 << (n - 1).bit_length()
        ids = array("q", self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        none, get = int(INF), self.pairs.get
        tree = array("q", [none]) * (2 * width)

        def leaf(p: int) -> int:
            q = after[p]
            rank = get(ids[p] << 32 | ids[q]) if q < n else None
            return none if rank is None else rank << 32 | p

        def update(p: int, value: int) -> None:
            k = p + width
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        for p in range(n - 1):
            tree[width + p] = leaf(p)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            p, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            q = after[p]
            ids[p], ids[q] = rank, -1
            after[p] = r = after[q]
            if r < n:
                before[r] = p
            update(q, none)
            update(p, leaf(p))
            if before[p] >= 0:
                update(before[p], leaf(before[p]))
        return [i for i in ids if i >= 0]

    # -- many pre-tokens -----------------------------------------------------------------
    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], INF >> 32) if len(self.pair_keys) else np.full(len(key), INF >> 32)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pre-tokens of at most ``width`` bytes, a tree per column."""
        m = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)
        live = np.arange(width)[:, None] < lengths[None, :]
        ids = np.where(live, self.byte_ids[raw.T], -1)
        # one spare row at the end takes what has no neighbour
        after = np.repeat(np.arange(1, width + 2)[:, None], m, axis=1)
        before = np.repeat(np.arange(-1, width)[:, None], m, axis=1)
        tree = np.full((2 * width, m), INF, dtype=np.int64)
        for p in range(width - 1):
            has = np.flatnonzero(live[p + 1])
            tree[width + p, has] = self._ranks_of(ids[p, has], ids[p + 1, has]) << 32 | p
        for k in range(width - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])

        def update(p: np.ndarray, c: np.ndarray, value: np.ndarray) -> None:
            k = p + width
            tree[k, c] = value
            while k[0] > 1:  # all leaves are on one level
                k = k >> 1
                tree[k, c] = np.minimum(tree[2 * k, c], tree[2 * k + 1, c])

        def leaf(p: np.ndarray, c: np.ndarray) -> np.ndarray:
            q = after[p, c]
            has = q < lengths[c]
            rank = self._ranks_of(ids[p, c], ids[np.where(has, q, p), c])
            return np.where(has & (rank < INF >> 32), rank << 32 | p, INF)

        columns = np.flatnonzero(tree[1] < INF >> 1)
        while len(columns):
            root = tree[1, columns]
            p, rank = root & 0xFFFFFFFF, root >> 32
            q = after[p, columns]
            r = after[q, columns]
            ids[p, columns] = rank
            ids[q, columns] = -1
            after[p, columns] = r
            before[np.minimum(r, width), columns] = p
            update(q, columns, np.full(len(columns), INF))
            update(p, columns, leaf(p, columns))
            prior = before[p, columns]
            has = np.flatnonzero(prior >= 0)
            if len(has):
                update(prior[has], columns[has], leaf(prior[has], columns[has]))
            columns = columns[tree[1, columns] < INF >> 1]
        flat = ids.T
        kept = flat >= 0
        packed = flat[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    # -- texts ---------------------------------------------------------------------------
    def learn(self, chunks: Iterable[str]) -> None:
        """Put the ids of these chunks into the cache."""
        known, ranks = self.chunks, self.ranks
        pieces, several = set(), []
        for chunk in chunks:
            if chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " ":  # letters make one match
                pieces.add(chunk)
            else:
                several.append((chunk, self.split(chunk)))
        pieces.update(piece for _, found in several for piece in found if piece not in known)
        by_width: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = ranks.get(raw)
            if rank is not None:
                known[piece] = struct.pack("<I", rank)
            elif len(raw) > BATCH_WIDTH:
                ids = self.merge_one(raw)
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                by_width.setdefault(WIDTHS[len(raw)], []).append(piece)
        for width, found in by_width.items():
            for at in range(0, len(found), 8192):
                some = found[at : at + 8192]
                known.update(zip(some, self.merge_many([piece.encode("utf-8", "surrogatepass") for piece in some], width), strict=True))
        for chunk, found in several:
            known[chunk] = b"".join(map(known.__getitem__, found))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        cut = [chunks_of(text) for text in texts]
        new = {chunk for found in cut for chunk in found if chunk not in self.chunks}
        if new:
            self.learn(new)
        get = self.chunks.__getitem__
        return [b"".join(map(get, found)) for found in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


INNER_SPACE = regex.compile(r" (?=\s|$)")
CUT = regex.compile(r" (?=\S)")


def chunks_of(text: str) -> list[str]:
    """Cut a text before every space that a non-space follows.

    No match of the split pattern spans such a cut and no look-ahead before it turns out
    differently at the end of a chunk, so the chunks' matches are the text's matches.
    """
    parts = CUT.split(text) if INNER_SPACE.search(text) else text.split(" ")
    if len(parts) == 1:
        return parts if text else []
    first, *rest = parts
    return [*([first] if first else []), *[" " + part for part in rest]]


def groups_of(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about ``limit`` characters together."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_encoders: dict[tuple[int, str], Encoder] = {}  # a Python worker serves many tasks


def encoder_for(blob: bytes, pattern: str) -> Encoder:
    key = (hash(blob), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(parse_ranks(blob), pattern)
    return _encoders[key]


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Ids of each whole text.

    Null counts as the empty text, which has no ids; rows that repeat and null ids give a row
    each, an empty table none.

    Returns ``doc_id``, ``n_tokens`` long and ``ids`` binary (little-endian unsigned 32-bit
    integers), with ``decode`` also ``decoded`` binary, the bytes that the ids stand for.
    ``rank_file`` is the content of the rank file; its size is that of the vocabulary, so it
    is broadcast.  Rows stay where they are: nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary" + ", decoded binary" * decode

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups_of(texts, OUT_BYTES // 4):
                packed = encoder.encode_all(texts[a:b])
                columns = [keys.slice(a, b - a), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decode:
                    columns.append(pa.array([encoder.decode(x) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """Bytes that the ids of ``encode`` stand for: ``doc_id``, ``decoded`` binary; null ids give empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder_for(shared.value, "").tokens
        for batch in batches:
            raw = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")
