"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern into pre-tokens, and each pre-token is
merged on its own. The merge loop keeps, for each merge rank, a bucket of the
positions whose pair has that rank, and a bitmap with one bit per non-empty
bucket in three levels of 64-bit words; find-first-set on each level gives the
lowest rank. A position whose pair has changed since it was queued is stale and
is skipped when it comes up. One merge so costs a constant number of word
operations however long the pre-token is.

A worker holds the ranks, one chunk of texts and a memory of pre-tokens that it
has met, each of a stated size, whatever the texts are.

Defined cases: a null text encodes as null ids and decodes as null; an empty
text gives no ids; other columns are kept as they are, whatever their names; two
pre-tokens of one 64-bit hash are told apart by a second hash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, packed, quoted
from .textkernels import span_hashes

#: Distinct pre-tokens, and ids in all, that a worker remembers before it starts afresh.
REMEMBERED = 300_000
REMEMBERED_IDS = 2_000_000
#: Pre-tokens up to so many bytes share one rank queue; longer ones get one each.
TOGETHER_BYTES = 256
#: Characters of text that are encoded at a time (a single longer text at once).
CHUNK_CHARS = 1 << 20
#: Ids that are decoded at a time (those of a single longer text at once).
CHUNK_IDS = 1 << 18
#: The largest ranks file that is broadcast.
RANKS_BYTES = 64 << 20
#: White space as the tokenizer's regular expressions have it (White_Space of Unicode).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The pattern whose cuts are found for whole batches of texts; others go through re.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _kinds() -> np.ndarray:
    """Of every code point: 1 letter, 2 number, 3 other, 4 white space."""
    firsts = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)], np.uint8)
    kinds = np.full(len(firsts), 3, np.uint8)
    kinds[firsts == ord("L")], kinds[firsts == ord("N")] = 1, 2
    kinds[[i for i in range(0x3001) if re.match(f"[{WHITE}]", chr(i))]] = 4
    return kinds


def _category(first: str) -> str:
    """The ranges of all characters whose general category starts with `first`."""
    found, begin = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == first
        if inside and begin is None:
            begin = i
        elif not inside and begin is not None:
            found.append(f"\\U{begin:08x}-\\U{i - 1:08x}")
            begin = None
    return "".join(found)


def compiled(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The pattern for any text, and the same for texts of ASCII characters only.

    Python's re has no \\p classes, so they are written out.
    """
    def written(letters: str, numbers: str, white: str) -> re.Pattern:
        out, depth = [], 0
        for x in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.S):
            known = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": white}.get(x)
            if x == r"\S":
                out.append(f"[^{white}]")
            elif known is not None:
                out.append(known if depth else f"[{known}]")
            else:
                depth += (x == "[") - (x == "]")
                out.append(x)
        return re.compile("".join(out))

    return written(_category("L"), _category("N"), WHITE), written("A-Za-z", "0-9", "\t-\r ")


class Codec:
    """Encodes and decodes with one set of ranks (token bytes to id)."""

    def __init__(self, ranks_file: bytes, pattern: str):
        pairs = (line.split() for line in ranks_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.any_text, self.ascii_text = compiled(pattern) if pattern != SPACED_PATTERN else (None, None)
        words = (max(self.ranks.values(), default=0) >> 6) + 1
        self.low = [0] * words
        self.middle = [0] * ((words >> 6) + 1)
        self.pattern = pattern
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(x) for x in tokens], np.int64)
        self.token_begins = self.token_sizes.cumsum() - self.token_sizes
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get = self.ranks.get
        both = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    both[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(both), np.int64)
        self.pair_values = np.array([both[x] for x in self.pair_keys.tolist()], np.int64)
        self.forget()

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        low, middle, top = self.low, self.middle, 0
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    middle[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
        while top:
            a = (top & -top).bit_length() - 1
            m = middle[a]
            b = a << 6 | (m & -m).bit_length() - 1
            w = low[b]
            r = b << 6 | (w & -w).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                w &= w - 1
                low[b] = w
                if not w:
                    m &= m - 1
                    middle[a] = m
                    if not m:
                        top &= top - 1
            if pair[i] != r:
                continue  # stale: the pair here is another one by now
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                changed = ((i, piece[i : after[k]]), (before[i], piece[before[i] : k] if before[i] >= 0 else b""))
            else:
                changed = ((i, b""), (before[i], piece[before[i] : k] if before[i] >= 0 else b""))
            for at, text in changed:
                if at < 0:
                    continue
                q = ranks.get(text, -1)
                pair[at] = q
                if q >= 0:
                    if q in buckets:
                        heappush(buckets[q], at)
                    else:
                        buckets[q] = [at]
                        low[q >> 6] |= 1 << (q & 63)
                        middle[q >> 12] |= 1 << (q >> 6 & 63)
                        top |= 1 << (q >> 12)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def merged_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has): one rank queue for all pieces.

        The pieces lie side by side and no pair crosses a border. From the lowest
        bucket each piece gives its leftmost position; the others wait, since the
        merge may have made a pair of a lower rank in the same piece.
        """
        sizes = np.array([len(x) for x in pieces], np.int64)
        n = int(sizes.sum())
        token = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        last = sizes.cumsum() - 1
        piece = np.repeat(np.arange(len(pieces)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last], before[last + 1 - sizes] = -1, -1
        pair = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.pair_ranks(token[inner], token[inner + 1])
        low, middle, top = self.low, self.middle, 0
        buckets: dict[int, list[int]] = {}
        queued = inner[pair[inner] >= 0]
        queued = queued[np.argsort(pair[queued], kind="stable")]
        found, begins = np.unique(pair[queued], return_index=True)
        for r, part in zip(found.tolist(), np.split(queued, begins[1:]) if len(found) else []):
            buckets[r] = part.tolist()
            low[r >> 6] |= 1 << (r & 63)
            middle[r >> 12] |= 1 << (r >> 6 & 63)
            top |= 1 << (r >> 12)
        while top:
            a = (top & -top).bit_length() - 1
            m = middle[a]
            b = a << 6 | (m & -m).bit_length() - 1
            w = low[b]
            r = b << 6 | (w & -w).bit_length() - 1
            at = np.array(buckets[r])
            at = at[pair[at] == r]  # the others are stale
            if len(at) > 1:
                at.sort()
                first = np.ones(len(at), bool)
                np.not_equal(piece[at[1:]], piece[at[:-1]], out=first[1:])
                wait = at[~first]
                at = at[first]
            else:
                wait = at[:0]
            if len(wait):
                buckets[r] = wait.tolist()
            else:
                del buckets[r]
                w &= w - 1
                low[b] = w
                if not w:
                    m &= m - 1
                    middle[a] = m
                    if not m:
                        top &= top - 1
            if not len(at):
                continue
            j = after[at]
            k = after[j]
            after[at], pair[j], pair[at], token[j], token[at] = k, -1, -1, -1, r
            inside = k >= 0
            before[k[inside]] = at[inside]
            left = before[at]
            left = left[left >= 0]
            changed = np.concatenate([at[inside], left])
            if len(changed):
                ranks = self.pair_ranks(token[changed], token[after[changed]])
                pair[changed] = ranks
                for q, i in zip(ranks.tolist(), changed.tolist()):
                    if q >= 0:
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            buckets[q] = [i]
                            low[q >> 6] |= 1 << (q & 63)
                            middle[q >> 12] |= 1 << (q >> 6 & 63)
                            top |= 1 << (q >> 12)
        alive = token >= 0
        return token[alive].astype(np.int32), np.bincount(piece[alive], minlength=len(pieces))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two neighbours make together, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_values[at], -1)

    def pieces(self, joined: str, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character positions at which pre-tokens of some texts begin and end.

        joined: the texts, with one character between each two, at `borders`.
        """
        if self.pattern != SPACED_PATTERN:
            begins, ends, begin = [], [], 0
            for end in [*borders.tolist(), len(joined)]:
                text = joined[begin:end]
                for found in (self.ascii_text if text.isascii() else self.any_text).finditer(text):
                    begins.append(begin + found.start())
                    ends.append(begin + found.end())
                begin = end + 1
            return np.array(begins, np.int64), np.array(ends, np.int64)
        point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _kinds()[point]
        kind[borders] = 0
        n = len(point)
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        behind = np.concatenate([kind[1:], [0]]).astype(np.uint8)
        begin = (kind != before) | (kind == 0)
        space, blank = kind == 4, point == 32
        # the last white character before a word stands alone or, if a space, goes with the word
        begin |= space & (behind != 4) & (behind != 0)
        begin[1:] &= ~(blank[:-1] & space[:-1] & (kind[1:] != 4) & (kind[1:] != 0))
        mark = np.flatnonzero((point == 39) & begin & (before != 3) & (behind == 1))
        if len(mark):
            one = point[mark + 1]
            two = np.where(mark + 2 < n, point[np.minimum(mark + 2, n - 1)], 0)
            two = np.where(kind[np.minimum(mark + 2, n - 1)] == 1, two, 0)
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            mark, width = mark[short | long], np.where(short, 1, 2)[short | long]
            begin[mark + 1] = False
            stop = mark + 1 + width
            stop = stop[stop < n]
            begin[stop[kind[stop] == 1]] = True
        starts = np.flatnonzero(begin)
        ends = np.concatenate([starts[1:], [n]])
        real = kind[starts] != 0
        return starts[real], ends[real]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        joined = "\0".join(texts)
        sizes = np.array([len(x) for x in texts], np.int64)
        borders = (sizes + 1).cumsum()[:-1] - 1
        starts, ends = self.pieces(joined, borders)
        row = np.searchsorted(borders, starts, "right")
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        if len(raw) != len(joined):
            point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            place = np.concatenate([[0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800).astype(np.int64) + (point >= 0x10000))])
            starts, ends = place[starts], place[ends]
        key, check = span_hashes(data, starts, ends), span_hashes(data, starts, ends, seed=1)
        found, first, which = np.unique(key, return_index=True, return_inverse=True)
        odd = np.flatnonzero(check != check[first][which])
        if len(odd):  # another pre-token has the same hash: these are looked up by both hashes
            first = np.concatenate([first, odd])
            which[odd] = len(found) + np.arange(len(odd))
            found = key[first]
        checks = check[first]
        at = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        met = (self.keys[at] == found) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(found), bool)
        slots = np.where(met, self.slots[at], -1) if len(self.keys) else np.full(len(found), -1)
        unseen = np.flatnonzero(~met)
        if len(unseen):
            pieces = [raw[x:y] for x, y in zip(starts[first[unseen]].tolist(), ends[first[unseen]].tolist())]
            length = np.array([len(x) for x in pieces])
            short, long = np.flatnonzero(length <= TOGETHER_BYTES), np.flatnonzero(length > TOGETHER_BYTES)
            ids, counts = self.merged_together([pieces[i] for i in short])
            parts = [ids] + [np.array(self.merged(pieces[i]), np.int32) for i in long]
            counts = np.concatenate([counts, [len(x) for x in parts[1:]]]).astype(np.int64)
            order = unseen[np.concatenate([short, long])]
            slots[order] = len(self.sizes) + np.arange(len(order))
            self.remember(found[order], checks[order], np.concatenate(parts), counts)
        slot = slots[which]
        size = self.sizes[slot]
        out = self.flat[np.repeat(self.begins[slot] - size.cumsum() + size, size) + np.arange(size.sum())]
        if len(self.sizes) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self.forget()
        return out, np.bincount(row, size, len(texts)).astype(np.int64)

    def remember(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Take in pre-tokens and their ids; of pre-tokens of one key only the first is found again."""
        slots = len(self.sizes) + np.arange(len(sizes))
        self.begins = np.concatenate([self.begins, len(self.flat) + sizes.cumsum() - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])
        keys, new = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, keys)
        fresh = self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        at, keys, new = at[fresh], keys[fresh], new[fresh]
        self.keys, self.checks, self.slots = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks[new]), np.insert(self.slots, at, slots[new])

    def forget(self) -> None:
        self.keys, self.checks, self.slots = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.begins, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, how many each gives)."""
        size = self.token_sizes[ids]
        return self.token_bytes[np.repeat(self.token_begins[ids] - size.cumsum() + size, size) + np.arange(size.sum())], size

    def decode(self, ids) -> bytes:
        return self.decode_all(np.asarray(ids, np.int64))[0].tobytes()


_CODECS: dict[bytes, Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec a worker process, made when it is first asked for."""
    key = hashlib.blake2b(ranks_file + b"\0" + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_file, pattern)
    return _CODECS[key]


def _bits(values: pa.Array) -> pa.Buffer | None:
    """The validity bitmap of an array, from its first value on."""
    return pa.array(values.is_valid().to_numpy(zero_copy_only=False)).buffers()[1] if values.null_count else None


def _ranks(spark: SparkSession, path: str):
    blob = Path(path).read_bytes()
    if len(blob) > RANKS_BYTES:
        raise ValueError(f"{path} has {len(blob)} bytes; a ranks file has {RANKS_BYTES} at most")
    return spark.sparkContext.broadcast(blob)


def _encoded(own: Codec, texts: pa.Array) -> pa.ListArray:
    size, parts, counts, group = 0, [np.empty(0, np.int32)], [], []
    for i, value in enumerate(texts):
        group.append(value.as_py() or "")
        size += len(group[-1])
        if size >= CHUNK_CHARS or i == len(texts) - 1:
            ids, count = own.encode_all(group)
            parts.append(ids)
            counts.append(count)
            size, group = 0, []
    ends = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)), mask=texts.is_null())


def _decoded(own: Codec, lists: pa.ListArray) -> pa.Array:
    ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    parts, sizes, a = [np.empty(0, np.uint8)], [np.zeros(1, np.int64)], 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_IDS, "right")) - 1)
        data, size = own.decode_all(ids[ends[a] : ends[b]])
        total = np.concatenate([[0], size.cumsum()])
        parts.append(data)
        sizes.append(np.diff(total[ends[a : b + 1] - ends[a]]))
        a = b
    place = np.concatenate(sizes).cumsum().astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [_bits(lists), pa.py_buffer(place), pa.py_buffer(np.concatenate(parts))])


def encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """A function of a string column that gives its ids as array<int>."""
    shared = _ranks(spark, ranks_path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shared.value, pattern)
        for texts in batches:
            yield _encoded(own, texts)

    return encode


def decoder(spark: SparkSession, ranks_path: str, pattern: str):
    """A function of an array<int> column that gives the bytes it stands for."""
    shared = _ranks(spark, ranks_path)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shared.value, pattern)
        for lists in batches:
            yield _decoded(own, lists)

    return decode


def coded(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", raw: str = "raw") -> DataFrame:
    """encode() and then decode(), by the same workers: df with the columns `ids` and `raw`."""
    shared = _ranks(df.sparkSession, ranks_path)

    @F.arrow_udf("ids array<int>, raw binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(shared.value, pattern)
        for texts in batches:
            lists = _encoded(own, texts)
            yield pa.StructArray.from_arrays([lists, _decoded(own, lists)], ["ids", "raw"])

    own = packed(df).select("row", both(F.col(f"row.{quoted(text)}")).alias("coded"))
    return own.select(*others(df.columns, ids, raw), F.col("coded.ids").alias(ids), F.col("coded.raw").alias(raw))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids`: the token ids of its column `text`."""
    return df.withColumn(ids, encoder(df.sparkSession, ranks_path, pattern)(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """df with the column `raw`: the bytes that its column `ids` stands for."""
    return df.withColumn(raw, decoder(df.sparkSession, ranks_path, pattern)(F.col(ids)))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
