"""Hierarchical multi-length packing.

Documents become token ids plus an end id. Full windows of the longest size
are cut off long documents; what remains is routed to the shortest tier that
holds it (256, 512, 1024, 2048). Tiers are packed from the longest down: each
remainder opens a window of its tier, and the gap is filled with the longest
remainders of the same or shorter tiers that fit; when none fits, one is cut, so windows
end up exactly full. A window that is full at a power of two needs no padding; only the
last window of a task can stay short. Windows are then dealt to step groups,
longest first, each to the group with the fewest tokens.

Packing is done where the tokens are made, inside one mapInArrow over the
scan's partitions: no shuffle, no second tokenisation, state bounded by one
block of documents (BLOCK_TOKENS) plus the longest document. A partition is
recomputed identically when an executor is lost, and sequence ids start from
the partition's number, so they are unique.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, q, ship, table

TIERS = (256, 512, 1024, 2048)
BLOCK_TOKENS = 2_000_000
GROUP_TOKENS = 1 << 17            # tokens of a step group
CACHE = 200_000                   # words whose ids a task remembers (about 40 MB)
SLICE = 256                       # rows of an Arrow batch that are Python objects at a time
PIECES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
#: White space next to other white space, where cutting at single spaces could change the ids.
_RUN = re.compile(r"\s\s")


class _Words(dict):
    """Ids of " word", filled on demand; emptied when full."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = array("I", self.encode(" " + word)).tobytes()
        return got


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Added tokens of the JSON file beside a rank file (none without one). The tokenizer
    finds them in texts before anything else."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    for x in found:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
            raise ValueError(f"added token {x['content']!r} takes more than its own text")
    return {x["content"]: x["id"] for x in found}


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[str], bytes]:
    """Text -> ids of the byte-level BPE as little-endian 32-bit words.

    The vocabulary's rank file gives the same ids as its JSON file (tested),
    several times faster. The pre-tokenizer never joins what stands before and
    after a single space, so texts without runs of white space are encoded
    word by word through a bounded cache. Texts are split at ``added`` tokens first."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    get = _Words(plain).__getitem__

    def encode(text: str) -> bytes:
        if _RUN.search(text):
            return array("I", plain(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", plain(first)).tobytes() + b"".join(map(get, rest))

    if not added:
        return encode
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    ids = {x: i.to_bytes(4, "little") for x, i in added.items()}

    def encode_added(text: str) -> bytes:
        if not any(x in text for x in ids):
            return encode(text)
        return b"".join(ids.get(x) or encode(x) for x in split(text) if x)

    return encode_added


def pack_block(items: list[tuple[int, int]], tiers: tuple[int, ...] = TIERS,
               last: bool = True) -> tuple[list[tuple[int, list]], list[tuple[int, int, int]]]:
    """Pack (number of the document, tokens) into windows.

    Returns windows as (size, [(document, start, length), ...]) and what is
    left for the next block as (document, start, length), which is empty when
    ``last``. Windows are full but for one at the end."""
    top = tiers[-1]
    windows: list[tuple[int, list]] = []
    rest: list[tuple[int, int, int]] = []                  # (length, document, start), ascending
    for doc, n in items:
        whole = n // top * top
        windows += [(top, [(doc, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            rest.append((n - whole, doc, whole))
    rest.sort()
    left: list[tuple[int, int, int]] = []
    while rest:
        length, doc, start = rest.pop()
        size = tiers[bisect.bisect_left(tiers, length)]
        window, gap = [(doc, start, length)], size - length
        while gap and rest:
            i = bisect.bisect_right(rest, (gap, 1 << 62, 0)) - 1
            if i >= 0:
                n, d, s = rest.pop(i)
                window.append((d, s, n))
                gap -= n
            else:                                           # none fits: cut the shortest
                n, d, s = rest.pop(0)
                window.append((d, s, gap))
                bisect.insort(rest, (n - gap, d, s + gap))
                gap = 0
        if gap and not last:
            left += [(d, s, n) for d, s, n in window]
        elif gap:
            exact = _exact(window, tiers)
            windows += exact
        else:
            windows.append((size, window))
    return windows, left


def _exact(pieces: list, tiers: tuple[int, ...]) -> list[tuple[int, list]]:
    """The last pieces cut into full windows, longest first; what is shorter than the
    shortest tier becomes the one padded window."""
    out, todo = [], list(pieces)
    total = sum(n for _, _, n in todo)
    while total:
        size = max((t for t in tiers if t <= total), default=tiers[-1])
        window, room = [], size
        while todo and room:
            d, s, n = todo.pop(0)
            take = min(n, room)
            window.append((d, s, take))
            room -= take
            if take < n:
                todo.insert(0, (d, s + take, n - take))
        total -= size - room
        out.append((size, window))
    return out


def step_groups(sizes: list[int], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """Group of each window: longest first to the group with the fewest tokens."""
    groups = max(1, round(sum(sizes) / group_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def _task(ranks_path: str, pattern: str, added: dict[str, int], end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(ranks_path, pattern, added)
        base = TaskContext.get().partitionId() << 40
        tail = end_id.to_bytes(4, "little")
        docs: list[tuple[object, bytes]] = []
        tokens_held = made = groups = 0
        carried: list[tuple[object, bytes, int, int, int]] = []   # (doc_id, ids of the piece, start, length, tokens)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, tokens_held, made, groups, carried
            # a carried piece is packed again as a short document that knows where it began
            ids = [x[1] for x in docs] + [x[1] for x in carried]
            names = [x[0] for x in docs] + [x[0] for x in carried]
            begin = [0] * len(docs) + [x[2] for x in carried]
            tokens = [len(x[1]) // 4 for x in docs] + [x[4] for x in carried]
            windows, left = pack_block([(i, len(b) // 4) for i, b in enumerate(ids)], tiers, last)
            steps = step_groups([size for size, _ in windows])
            rows = []
            for k, (size, window) in enumerate(windows):
                at = 0
                for d, s, n in window:
                    rows.append((names[d], begin[d] + s, n, zlib.crc32(ids[d][4 * s:4 * (s + n)]), tokens[d],
                                 base + made + k, at, size, base + groups + steps[k]))
                    at += n
            carried = [(names[d], ids[d][4 * s:4 * (s + n)], begin[d] + s, n, tokens[d]) for d, s, n in left]
            made += len(windows)
            groups += max(steps, default=-1) + 1
            docs, tokens_held = [], 0
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + 20_000])], list(PIECES))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    b = encode(text or "") + tail
                    docs.append((doc_id, b))
                    tokens_held += len(b) // 4
                    if tokens_held >= BLOCK_TOKENS:
                        yield from flush(False)
        yield from flush(True)

    return lean(run)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces (PIECES) of all rows of ``docs``; every id of every row lies in
    exactly one piece. A null or empty text is its end id alone; a null doc_id
    stays null; repeated rows are packed one by one. ``tokenizer``: path of a
    rank file, by default the public 50k byte-level BPE; its added tokens are those of the JSON file beside it."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return (docs.select(F.col(q(doc_id)).cast("long").alias("doc_id"), F.col(q(text)).cast("string").alias("text"))
            .mapInArrow(_task(path, public_tokenizers.PATTERN, added_tokens(path), end_id, tuple(tiers)),
                        ", ".join(f"`{c}` bigint" for c in PIECES)))


def op4_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 256 to 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


ship(__name__)
