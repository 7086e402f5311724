"""Hierarchical multi-length packing of token sequences.

Method. Each document's ids (and a closing id) are cut at multiples of the window; the pieces are
routed by length to context tiers (2048, 1024, 512, 256). From the longest tier down, pieces open
windows of their tier; gaps of longer windows are filled first, always the tightest gap that holds a
piece (best fit, decreasing lengths). A short tier's window that stays less than full is dissolved:
its pieces enter windows of the longest tier, again by best fit, so only full windows keep a shorter
length and nothing but longest-tier windows is ever padded. Sequences are numbered by window length and cost and
dealt to step groups in a boustrophedon, so that groups differ by one sequence of a tier at most.

Scale. A piece's place depends on its length and its rank among pieces of that length only. The plan
is therefore made from the histogram of lengths (at most ``window`` rows, whatever the input) as
patterns of lengths with multiplicities, and every row finds its place by binary search in the
plan's ranges. Ranks come from salted counts, as many salts as the most frequent length needs, so one
frequent length is no hot key.

Defined results: null and empty texts are one piece with the closing id alone; repeated rows are
packed as often as they occur; pieces that tie in length are ranked by a hash of id and start, then by
these; very long texts give many full windows; an empty table gives no
pieces; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, map_slices, numbered, salts_for
from loomtrace.llm.pretokens import PreTokens

TIERS = (2048, 1024, 512, 256)
CLOSING = 1
#: Tokens of the windows of one step group.
STEP_TOKENS = 1 << 18
_LATIN = re.compile("[\t-\r\x20-\x7e\xa0-\xff]*")
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: The tokenizer's own pre-tokens, its classes written out for lower-case Latin-1.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \xa0{_L}{_N}]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def word_bpe(path: str | None = None) -> PreTokens:
    """One encoder a worker process, so that its table serves all tasks of the process."""
    from tokenizers import Tokenizer

    return PreTokens(Tokenizer.from_file(path or vocabulary_path()), _WORDS, chunks)


def chunks(text: str) -> list[str] | None:
    """The words of the text in lower case, after an empty first chunk; white space has no ids."""
    return ["", *text.lower().split()] if "<|" not in text and _LATIN.fullmatch(text) else None


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = TIERS[0], with_ids: bool = False) -> DataFrame:
    """The cut documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""

    def task():
        bpe = word_bpe(path)
        closing = np.asarray([CLOSING], "<u4").tobytes()

        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            row, start, length, crc, tokens, ids = [], [], [], [], [], []
            for i, found in enumerate(bpe.ids([t or "" for t in piece.column("text").to_pylist()])):
                data = found + closing
                n = len(data) // 4
                for at in range(0, n, window):
                    part = data[4 * at : 4 * (at + window)]
                    row.append(i)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = [piece.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            return pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names)

        return each

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


class _Windows:
    """Open windows of one tier: for each gap, the patterns of lengths with their multiplicities."""

    def __init__(self):
        self.gaps: list[int] = []
        self.by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(self, gap: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((pattern, count))

    def place(self, block: tuple[int, ...], size: int, count: int) -> int:
        """Put blocks into the tightest gaps that hold them; what is left over."""
        while count:
            k = bisect_left(self.gaps, size)
            if k == len(self.gaps):
                return count
            gap = self.gaps[k]
            patterns = self.by_gap[gap]
            pattern, n = patterns.pop()
            if not patterns:
                del self.by_gap[gap], self.gaps[k]
            each = gap // size
            full = min(n, count // each)
            self.add(gap - each * size, pattern + block * each, full)
            count -= full * each
            if full < n:  # fewer blocks than one more window would hold
                if rest := count:
                    self.add(gap - rest * size, pattern + block * rest, 1)
                    count = 0
                self.add(gap, pattern, n - full - bool(rest))
        return 0


def plan(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, tuple[int, ...], int]]:
    """(window length, pattern of lengths, multiplicity) for pieces given as length -> count.

    A window shorter than the longest tier is always full.
    """
    top = tiers[0]
    open_ = {t: _Windows() for t in tiers}
    for length in sorted(histogram, reverse=True):
        own, left = min(t for t in tiers if t >= length), histogram[length]
        for tier in tiers:
            if tier >= own:
                left = open_[tier].place((length,), length, left)
        if left:
            each = own // length
            open_[own].add(own - each * length, (length,) * each, left // each)
            if rest := left % each:
                open_[own].add(own - rest * length, (length,) * rest, 1)
    out: list[tuple[int, tuple[int, ...], int]] = []
    for tier in tiers[1:]:
        out += [(tier, p, n) for p, n in open_[tier].by_gap.get(0, [])]
    loose: Counter[int] = Counter()
    for tier in tiers[1:]:
        for gap, patterns in open_[tier].by_gap.items():
            for pattern, n in patterns if gap else []:
                loose.update({length: n * k for length, k in Counter(pattern).items()})
    for length in sorted(loose, reverse=True):
        if left := open_[top].place((length,), length, loose[length]):
            each = top // length
            open_[top].add(top - each * length, (length,) * each, left // each)
            if rest := left % each:
                open_[top].add(top - rest * length, (length,) * rest, 1)
    out += [(top, p, n) for x in open_[top].by_gap.values() for p, n in x]
    return out


def _ranges(patterns: list[tuple[int, tuple[int, ...], int]], step_tokens: int) -> tuple[dict[str, np.ndarray], int]:
    """Per length, runs of ranks with the sequence and offset of each run's first piece."""
    patterns = sorted(patterns, key=lambda x: (-x[0], -sum(n * n for n in x[1]), x[1]))
    used: dict[int, int] = defaultdict(int)
    runs, sequence, tokens = [], 0, 0
    for window, pattern, n in patterns:
        offset = 0
        for length in pattern:
            runs.append((length, used[length], sequence, offset, window))
            used[length] += n
            offset += length
        sequence += n
        tokens += window * n
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "offset", "window"), columns, strict=True)), max(1, -(-tokens // step_tokens))


def pack(cut: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Place pieces (doc_id, start, length, ...): adds sequence_id, offset, window and step_group."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, steps = _ranges(plan(histogram, tiers), step_tokens)
    own = cut.columns
    ranked = numbered(cut, ["length"], ["doc_id", "start"], "_rank", salts_for(max(histogram.values(), default=0)))

    def place(batches):
        keys = (runs["length"] << 40) + runs["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            sequence = runs["sequence"][at] + rank - runs["rank"][at]
            turn, place = np.divmod(sequence, steps)
            group = np.where(turn % 2 == 0, place, steps - 1 - place)
            more = [pa.array(x, pa.int64()) for x in (sequence, runs["offset"][at], runs["window"][at], group)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + more, names=[*own, "sequence_id", "offset", "window", "step_group"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long, window long, step_group long")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack ``df``. The cut pieces are kept in the shared folder, as two passes read them."""
    return pack(checkpointed(pieces(df, id_col, text_col, path, with_ids=with_ids)))
