"""Edit-aware token counts.

For each edited document a segment tree over its chunks of pre-tokens holds lengths and token
counts.  An edit descends to the chunks that it touches, joins them with the chunk before
where the boundary between the two may have gone, encodes that region alone and updates the
sums on the way up; all other counts stay.

Chunks are cut before every space that a non-space follows: matches of the split pattern never
span such a cut (see ``bpe.chunks_of``), so a cut holds as long as its two characters do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe

Edit = tuple[int, int, str]  # offset, characters that go, text that comes


class TokenTree:
    """A text whose tokens stay counted while it is edited."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.count = count
        self.parts = bpe.chunks_of(text)
        self.width = 1 << max(len(self.parts) - 1, 0).bit_length()
        self.lengths, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.parts += [""] * (self.width - len(self.parts))
        self.encoded = 0  # characters that edits have had encoded again
        for k, part in enumerate(self.parts):
            self.lengths[self.width + k], self.tokens[self.width + k] = len(part), count(part) if part else 0
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.lengths[k] = self.lengths[2 * k] + self.lengths[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset`` (the last character's, beyond the end), and the leaf's start."""
        k, start = 1, 0
        offset = min(offset, self.lengths[1] - 1)
        while k < self.width:
            k *= 2
            if offset - start >= self.lengths[k]:
                start += self.lengths[k]
                k += 1
        return k - self.width, start

    def _set(self, leaf: int, part: str) -> None:
        self.parts[leaf] = part
        k = self.width + leaf
        self.lengths[k], self.tokens[k] = len(part), sum(map(self.count, bpe.chunks_of(part)))
        while k > 1:
            k >>= 1
            self._sum(k)

    def edit(self, offset: int, gone: int, come: str) -> None:
        """Put ``come`` in the place of ``gone`` characters from ``offset`` on; both ends are held within the text."""
        total = self.lengths[1]
        offset = min(max(offset, 0), total)
        stop = min(offset + max(gone, 0), total)
        if total == 0:
            self.encoded += len(come)
            self._set(0, come)
            return
        first, start = self._at(offset)
        if start > 0 and offset < start + 2 or offset == total and offset > start:
            # The cut before this leaf needs its first two characters.
            if start > 0:
                first, start = self._at(start - 1)
        last, _ = self._at(max(stop - 1, offset, start))
        region = "".join(self.parts[first : last + 1])
        for leaf in range(first + 1, last + 1):
            if self.lengths[self.width + leaf]:
                self._set(leaf, "")
        region = region[: offset - start] + come + region[stop - start :]
        self.encoded += len(region)
        self._set(first, region)


def masks(text: str, patterns: Iterable[tuple[str, str]]) -> list[Edit]:
    """Edits that put a placeholder in the place of every match, from the last to the first."""
    found = [(m.start(), m.end() - m.start(), mask) for pattern, mask in patterns for m in regex.finditer(pattern, text)]
    out: list[Edit] = []
    for edit in sorted(found):
        if not out or edit[0] >= out[-1][0] + out[-1][1]:  # of overlapping ones the first
            out.append(edit)
    return out[::-1]


def recount(docs: DataFrame, edits_of: Callable[[str], list[Edit]], rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of each whole text before and after its edits.

    ``edits_of`` gives a text's edits in the order in which they are made; each offset holds
    for the text as the edits before have left it.  Returns ``doc_id``, ``n_tokens``,
    ``n_edits``, ``n_tokens_edited``, ``n_chars_encoded`` (encoded again) and
    ``edited`` (the text; null without edits).  Null counts as the empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_chars_encoded bigint, edited string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_for(shared.value, pattern)

        def count(chunk: str) -> int:
            if chunk not in encoder.chunks:
                encoder.learn([chunk])
            return len(encoder.chunks[chunk]) // 4

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in bpe.groups_of(texts, bpe.OUT_BYTES // 4):
                rows = []
                for text, packed in zip(texts[a:b], encoder.encode_all(texts[a:b]), strict=True):
                    before, edits = len(packed) // 4, edits_of(text)
                    if not edits:
                        rows.append((before, 0, before, 0, None))
                        continue
                    tree = TokenTree(text, count)
                    for edit in edits:
                        tree.edit(*edit)
                    rows.append((before, len(edits), tree.n_tokens, tree.encoded, tree.text))
                kinds = [*[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded", "edited"]
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
