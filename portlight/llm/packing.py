"""Packing token sequences into windows: non-negative least squares over shallow length combinations.

Each task packs its own documents in shards of bounded size, so nothing is shuffled and no histogram leaves a task. Of
each document whole windows are cut off first. The remainders' lengths, rounded up to bins, form a histogram; combinations
of at most three bins that fill a window exactly are enumerated, their repeat counts solved by non-negative least squares
rounded, and used as far as the histogram holds. What is left over is packed greedily: it first fills the few tokens that
rounding to bins left open, then windows of its own, cut where a window ends.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table

WINDOW = 2048
#: Lengths are rounded up to multiples of WINDOW / BINS for the histogram.
BINS = 128
#: A shard is packed and let go when it holds so many remainder tokens.
SHARD_TOKENS = 16 << 20
#: The pre-tokenizer's pattern, a fixed value of this kind of tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space runs from this length on are cut out before the pattern sees them: its look-ahead goes back over a whole run, and
#: overflows the stack of the regular expression engine somewhere above 500,000 characters.
LONG_RUN = 4096
#: What `\s` stands for in the pattern (Python's takes in U+001C to U+001F too).
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_tokenizers: dict = {}


def ranks_serve(spec: dict) -> bool:
    """Whether a tokenizer file says what the ranks take for granted: no normaliser, byte-level words by WORD_PATTERN without a
    blank in front, and plain merges. Else all texts go through `tokenizers`."""
    words, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
    return bool(plain and spec.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))


class FastEncoder:
    """The ids of a byte-level BPE file of the `tokenizers` library. Its vocabulary, whose ids follow the order of merges,
    also serves tiktoken as ranks: the same ids, four times as fast. Texts that hold a special token's string go through
    `tokenizers` itself, which gives such strings an id of their own."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.exact = Tokenizer.from_file(path)
        self.alike = ranks_serve(json.loads(self.exact.to_str()))
        special = {x.content: i for i, x in self.exact.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        # byte-level BPE writes the 188 printable Latin-1 characters as themselves and other bytes as U+0100 upwards
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        printable = [x for x in letters if ord(x) < 256]
        others = [x for x in letters if ord(x) >= 256]
        rest = [b for b in range(256) if chr(b) not in set(printable)]
        byte = {x: ord(x) for x in printable} | dict(zip(others, rest, strict=True))
        ranks = {bytes(byte[x] for x in name): i for name, i in self.exact.get_vocab(with_added_tokens=False).items() if name not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for text in texts:
            if not self.alike or self.special.search(text):
                ids = self.exact.encode(text, add_special_tokens=False).ids
            else:
                ids = self._by_ranks(text)
            out.append(array("I", ids).tobytes())
        return out

    def _by_ranks(self, text: str) -> list[int]:
        """The pattern makes one piece of a run of white space, but leaves its last character to a word that follows: so
        cutting there changes no id."""
        ids, at = [], 0
        for run in _RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self.fast.encode_ordinary(text[at : run.start()])
            ids += self.fast._core_bpe.encode_single_piece(text[run.start() : stop].encode())
            at = stop
        return ids + self.fast.encode_ordinary(text[at:]) if at else self.fast.encode_ordinary(text)


def tokenizer(path: str) -> FastEncoder:
    """One for each worker and file, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = FastEncoder(path)
    return _tokenizers[path]


@lru_cache
def combinations(bins: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0, a >= 1 and a + b + c = bins: what fills a window with at most three pieces."""
    a, b = np.meshgrid(np.arange(1, bins + 1), np.arange(0, bins + 1), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = bins - a - b
    keep = (c >= 0) & (a >= b) & (b >= c)
    return np.stack([a, b, c], 1)[keep]


def solve_repeats(histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """How often to use each combination: x >= 0 that minimises |A x - histogram|, by accelerated projected gradient.

    histogram[k] counts the pieces of k bins; column j of A counts the bins of combination j.
    """
    combos = combinations(len(histogram) - 1)
    target = histogram.astype(float)
    target[0] = 0

    def spread(x):
        got = np.zeros(len(histogram))
        for i in range(3):
            got += np.bincount(combos[:, i], weights=x, minlength=len(histogram))
        got[0] = 0
        return got

    def back(r):
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.random.default_rng(0).random(len(combos))
    for _ in range(12):  # the largest eigenvalue of A'A bounds the step
        v = back(spread(v))
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm(back(spread(v)))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        r = spread(y) - target
        r[0] = 0
        new = np.maximum(0, y - step * back(r))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, bins: int = BINS) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length) that hold each length, 1 to window, once and gapless; few are cut."""
    unit = window // bins
    size = -(-lengths // unit)
    by_size: list[list[int]] = [[] for _ in range(bins + 1)]
    for i in np.argsort(lengths, kind="stable"):
        by_size[size[i]].append(int(i))
    left = np.bincount(size, minlength=bins + 1)
    repeats, combos = np.rint(solve_repeats(left)).astype(int), combinations(bins)
    made: list[list[tuple[int, int, int]]] = []
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        parts = [int(k) for k in combos[j] if k]
        need = {k: parts.count(k) for k in parts}
        for _ in range(min([int(repeats[j]), *(left[k] // n for k, n in need.items())])):
            row = [by_size[k].pop() for k in parts]
            made.append([(i, 0, int(lengths[i])) for i in row])
        for k in need:
            left[k] = len(by_size[k])
    rest = [i for some in reversed(by_size) for i in reversed(some)]  # longest first
    begun: dict[int, int] = {}
    tail = len(rest)

    def shortest(most: int):
        """The next (index, start, length) of the shortest remainder, at most `most` tokens."""
        nonlocal tail
        i = rest[tail - 1]
        start = begun.get(i, 0)
        n = min(most, int(lengths[i]) - start)
        begun[i] = start + n
        if begun[i] == lengths[i]:
            tail -= 1
        return i, start, n

    for row in made:
        hole = window - sum(x[2] for x in row)
        while hole and tail:
            row.append(shortest(hole))
            hole -= row[-1][2]
    row, hole, head = [], window, 0
    while head < tail:
        i = rest[head]
        start = begun.get(i, 0)
        if int(lengths[i]) - start > hole and tail - head > 1:
            while hole and head < tail:  # close the window with the shortest, cut if need be
                row.append(shortest(hole))
                hole -= row[-1][2]
        else:
            n = min(hole, int(lengths[i]) - start)
            row.append((i, start, n))
            hole -= n
            begun[i] = start + n
            head += begun[i] == lengths[i]
        if not hole:
            made.append(row)
            row, hole = [], window
    # what remains is less than a window: lengths that are powers of two need no padding
    while row:
        total, part = sum(x[2] for x in row), []
        hole = 1 << (total.bit_length() - 1) if total < window and total.bit_count() <= 3 or total < window // 2 else window
        hole = min(hole, window)
        while row and hole:
            i, start, n = row.pop(0)
            take = min(n, hole)
            part.append((i, start, take))
            hole -= take
            if take < n:
                row.insert(0, (i, start + take, n - take))
        made.append(part)
    return made


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces (PIECE_SCHEMA) of documents (doc_id, text): each id, end_id after each document included, lies in one piece.

    sequence_id is unique over all tasks; offset counts from 0 in it without gaps. A null text is empty and still has
    end_id; null doc_ids stay null; repeated rows are packed as often as they stand there; an empty table has no pieces.
    Other columns are ignored.
    """

    def pack(batches):
        encoder = tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []  # doc_id, start, ids, tokens of the document
        held = number = 0

        def out(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

        def shard():
            nonlocal rests, held, number
            rows = []
            for row in plan(np.array([len(x[2]) // 4 for x in rests], dtype=np.int64), window):
                offset = 0
                for i, start, n in row:
                    doc_id, first, ids, tokens = rests[i]
                    rows.append((doc_id, first + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, base + number, offset))
                    offset += n
                number += 1
            rests, held = [], 0
            return out(rows)

        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, ids in zip(doc_ids, encoder.encode([x or "" for x in texts]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n - window + 1, window):
                    rows.append((doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, base + number, 0))
                    number += 1
                if n % window:
                    rests.append((doc_id, n - n % window, ids[4 * (n - n % window) :], n))
                    held += n % window
            if rows:
                yield out(rows)
            if held >= SHARD_TOKENS:
                yield shard()
        if rests:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(pack, PIECE_SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
