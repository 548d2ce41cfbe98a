"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task packs the texts of its own input split, so nothing is shuffled.  A
text that fills whole sequences is cut there; what is left over joins a batch.
A batch is divided over the fewest windows that could hold it: every piece
starts as a partial partition of its own, and the two partial partitions with
the largest imbalance are merged, the fullest windows of one with the emptiest
of the other.  If a window ends above capacity, the batch is divided again over
one window more.

With only two or three pieces a window no division is even, so the shortest
leftovers of a batch (a `fine_share` of its tokens) are first cut to pieces of
`fine_tokens`; differencing places these last and levels the windows with them.
"""

from __future__ import annotations

import heapq
import itertools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import releasing, small_batches

BATCH_WINDOWS = 256

# Texts of these characters split alike in every regular-expression library: no
# character whose class or white-space property is a matter of version.
_PLAIN = regex.compile(r"[\x00-\x1b\x20-\x7e\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*+")
# Fixed value: how byte-level BPE divides a text into pieces.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Ids of texts under a byte-level BPE file of the tokenizers library, without the special tokens it would put around a text.

    In such a file a token's id is also the rank of its merge, so the same ids
    come from any ranked BPE engine; the faster one takes texts of plain
    characters that hold no added token's string, the tokenizers library itself
    all others and all other files.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in file["added_tokens"]]
        self.fast = self._ranked(file)

    @staticmethod
    def _ranked(file: dict):
        model, before = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or model.get("dropout") or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            return None
        letters, special = _byte_letters(), {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != sorted(model["vocab"][m] for m in merged):
            return None
        return tiktoken.Encoding("file", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and _PLAIN.fullmatch(text) and not any(a in text for a in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


_loaded: dict[str, Tokens] = {}


def load_tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """Window of each piece, by multiway differencing; window sums come out nearly equal.

    A partial partition keeps its non-empty windows by falling sum; the empty
    ones are implied.  Windows that merge are joined in `group`.
    """
    n = len(sizes)
    group = np.arange(n)
    if not n or windows <= 1:
        return np.zeros(n, dtype=np.int64)
    heap = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = itertools.count(n)
    while len(heap) > 1:
        _, _, sum_a, top_a = heapq.heappop(heap)
        _, _, sum_b, top_b = heapq.heappop(heap)
        clash = len(sum_a) + len(sum_b) - windows
        if clash > 0:
            # the emptiest windows of a meet the emptiest of b turned round: position i of a is windows-1-i of b
            at = np.arange(windows - len(sum_b), len(sum_a))
            other = windows - 1 - at
            sum_a = sum_a.copy()
            sum_a[at] += sum_b[other]
            group[top_b[other]] = top_a[at]
            rest = np.ones(len(sum_b), dtype=bool)
            rest[other] = False
            sum_b, top_b = sum_b[rest], top_b[rest]
        total, top = np.concatenate([sum_a, sum_b]), np.concatenate([top_a, top_b])
        order = np.argsort(-total, kind="stable")
        total, top = total[order], top[order]
        spread = int(total[0] - (total[-1] if len(total) == windows else 0))
        heapq.heappush(heap, (-spread, next(tick), total, top))
    top = heap[0][3]
    while (group[group] != group).any():
        group = group[group]
    window = np.empty(n, dtype=np.int64)
    window[top] = np.arange(len(top))
    return window[group]


def divide(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Window of each piece and the number of windows; the number rises until no window is above capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, weights=sizes, minlength=1).max() <= capacity:
            return window, windows
        windows += 1


def _cut(lengths: list[int], fine_share: float, fine_tokens: int) -> list[tuple[int, int, int]]:
    """(leftover, start, length) pieces; the shortest leftovers are cut finely."""
    budget, pieces = fine_share * sum(lengths), []
    for k in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        n = lengths[k]
        if budget > 0 and n > fine_tokens:
            pieces += [(k, a, min(fine_tokens, n - a)) for a in range(0, n, fine_tokens)]
        else:
            pieces.append((k, 0, n))
        budget -= n
    return pieces


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_rows(rows: Iterator[tuple[int | None, str | None]], encode: Callable[[str], np.ndarray], capacity: int, end_id: int, base: int, fine_share: float, fine_tokens: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, start, ids, doc_tokens, sequence_id, offset) for a stream of texts; sequence ids count up from `base`."""
    sequence = itertools.count(base)
    left: list[tuple] = []
    held = 0

    def close():
        pieces = _cut([len(x[2]) for x in left], fine_share, fine_tokens)
        window, n = divide([p[2] for p in pieces], capacity)
        names, fill = [next(sequence) for _ in range(n)], [0] * n
        out = []
        for (k, a, size), w in zip(pieces, window.tolist(), strict=True):
            doc, start, ids, total = left[k]
            out.append((doc, start + a, ids[a : a + size], total, names[w], fill[w]))
            fill[w] += size
        return out

    end = np.array([end_id], dtype="<u4")
    for doc, text in rows:
        ids = np.concatenate([encode(text or ""), end])
        whole = len(ids) // capacity * capacity
        if whole:
            yield [(doc, a, ids[a : a + capacity], len(ids), next(sequence), 0) for a in range(0, whole, capacity)]
        if whole < len(ids):
            left.append((doc, whole, ids[whole:], len(ids)))
            held += len(ids) - whole
        if held >= BATCH_WINDOWS * capacity:
            yield close()
            left, held = [], 0
    if left:
        yield close()


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, fine_share: float = 0.15, fine_tokens: int = 64, with_ids: bool = False) -> DataFrame:
    """Pack all texts into sequences of at most `capacity` tokens; one row a piece.

    A text's ids are the tokenizer's, without special tokens, then `end_id`.
    Columns: doc_id, start (ids of the text before the piece), length,
    ids_crc32 (of the little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id and offset (gapless from 0 in each sequence), and with
    `with_ids` the ids themselves as array<int>.  Every id lies in one piece.

    Null and empty texts have just `end_id`.  Rows that repeat, or share or lack
    a doc_id, are packed one by one.  Other columns are dropped.  Sequence ids
    are unique, and the same again when a task is repeated: they begin with the
    number of the input split.  An empty table gives an empty result.
    """

    def run(batches):
        tokens = load_tokens(tokenizer_path)
        base = TaskContext.get().partitionId() << 40

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    yield from zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True)

        held: list[tuple] = []

        def emit():
            doc, start, ids, total, sequence, offset = zip(*held, strict=True)
            columns = [doc, start, [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids], total, sequence, offset]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            names = SCHEMA.replace(" bigint", "").split(", ")
            if with_ids:
                edges = np.concatenate(([0], np.cumsum(columns[2]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for some in pack_rows(rows(), tokens.encode, capacity, end_id, base, fine_share, fine_tokens):
            held += some
            if len(held) >= 4096:
                yield emit()
                held = []
        if held:
            yield emit()

    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(releasing(run), SCHEMA + (", ids array<int>" if with_ids else ""))
