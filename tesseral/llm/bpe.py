"""Byte-level BPE by prefix dynamic programming.

For a merge vocabulary the encoding of a text has a unique last token for each of its prefixes.
Keeping those last tokens makes the encoding of every prefix available by walking back, makes an
append exact (only new prefixes are computed) and confines an edit to the prefixes behind it,
until the states agree with the old ones again.

A token ``t`` ending at prefix ``i`` is that last token exactly when the last token ``s`` of prefix
``i - len(t)`` and ``t`` stay separate when the merges run over ``s + t`` alone.
"""
from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, n_tokens long, ids array<int>"
#: Pieces whose encodings one Python worker remembers at most.
CACHE_PIECES = 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank from a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Encoder of single pieces over a rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.tokens = {r: t for t, r in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}
        self.size = max(self.tokens) + 1
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.split[rank] = (rank, rank)
            if len(token) < 2:
                continue
            parts = self._merge(token, rank)
            if len(parts) == 2:  # otherwise no sequence of merges makes this token
                self.split[rank] = (parts[0], parts[1])
                self.pairs[parts[0], parts[1]] = rank

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Plain merging with the ranks under ``below``: only for building the split table."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left right`` is what merging makes of their joined bytes.

        Undo merges on both sides of the border, newest first; an undone state in which the two
        border tokens would have merged earlier than what was undone refutes the pair.
        """
        a, b, limit, answer = left, right, 1 << 62, None
        while answer is None:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                answer = False
            elif a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.split[b][0]
                    if b + 1 == limit:
                        answer = True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.split[a][1]
                    if a == limit:
                        answer = True
        if len(self._fits) >= 400_000:
            self._fits.clear()
        self._fits[left * self.size + right] = answer
        return answer

    def extend(self, piece: bytes, last: list[int], lens: list[int], end: int | None = None) -> None:
        """Compute the last token of each prefix from ``len(last)`` on, in place.

        ``last[i]`` is the last token of ``piece[:i + 1]``, ``lens[i]`` its length in bytes.
        """
        get, longest, known, check, size = self.ranks.get, self.longest, self._fits, self.fits, self.size
        for i in range(len(last) + 1, (len(piece) if end is None else end) + 1):
            # one candidate only is valid, so any order finds it; short ones are the commonest
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                t = get(piece[j:i])
                if t is not None:
                    if j:
                        left = last[j - 1]
                        ok = known.get(left * size + t)
                        if ok if ok is not None else check(left, t):
                            break
                    elif self.whole(t):
                        break
            else:
                raise ValueError(f"no token ends at byte {i}: the vocabulary lacks a byte")
            last.append(t)
            lens.append(i - j)

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.tokens[token]) == 1 or self.split[token][0] != token

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        t = self.ranks.get(piece)
        if t is not None:
            return [t]
        last: list[int] = []
        lens: list[int] = []
        self.extend(piece, last, lens)
        return self.walk(last, lens)

    @staticmethod
    def walk(last: list[int], lens: list[int]) -> list[int]:
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= lens[i - 1]
        return out[::-1]


class Buffer:
    """A piece under construction: exact appends, and edits that recompute as little as they can."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last, self.lens, self.computed = bpe, b"", [], [], 0
        self.append(piece)

    def append(self, more: bytes) -> "Buffer":
        self.piece += more
        self.computed = len(more)
        self.bpe.extend(self.piece, self.last, self.lens)
        return self

    def replace(self, start: int, stop: int, new: bytes) -> "Buffer":
        """``piece[start:stop] = new``; old states are taken over once ``longest`` of them in a row agree."""
        old_last, old_lens, tail = self.last, self.lens, len(self.piece) - stop
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last, self.lens, agree, self.computed = old_last[:start], old_lens[:start], 0, 0
        fresh = start + len(new)
        while len(self.last) < len(self.piece):
            i = len(self.last)
            self.bpe.extend(self.piece, self.last, self.lens, i + 1)
            self.computed += 1
            if i >= fresh:
                o = len(old_last) - tail + (i - fresh)
                agree = agree + 1 if (self.last[i], self.lens[i]) == (old_last[o], old_lens[o]) else 0
                if agree >= self.bpe.longest:
                    self.last += old_last[o + 1 :]
                    self.lens += old_lens[o + 1 :]
                    break
        return self

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last, self.lens)


class Splitter:
    """``pattern.findall`` with a quick way for texts whose characters both engines class alike.

    The standard engine has no ``\\p{L}``; on letters, decimal digits and the rest of the Basic
    Latin to Latin Extended-B range without other numerals, its classes say the same.
    """

    QUICK = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    ODD = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ‐-‧‰-⁞]")

    def __init__(self, pattern: str, standard: str):
        self.full = regex.compile(pattern)
        self.quick = pattern == standard

    def __call__(self, text: str) -> list[str]:
        if self.quick and not self.ODD.search(text):
            return self.QUICK.findall(text)
        return self.full.findall(text)


class _Memo(dict):
    """piece -> packed ids, in two generations: what was not asked for again falls out."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES // 2:
            self.old = dict(self)
            self.clear()
        out = self.old.get(piece)
        if out is None:
            out = np.array(self.bpe.encode(piece.encode()), "<u4").tobytes()
        self[piece] = out
        return out


_workers: dict = {}


def _loaded(path: str, pattern: str, standard: str):
    key = (path, pattern)
    if key not in _workers:
        bpe = PrefixBPE(read_ranks(path))
        _workers[key] = Splitter(pattern, standard), _Memo(bpe), [bpe.tokens.get(i, b"") for i in range(max(bpe.tokens) + 1)]
    return _workers[key]


def encode_batches(batches, path: str, pattern: str, standard: str, ids_out: bool):
    split, memo, tokens = _loaded(path, pattern, standard)
    for whole in batches:
        for batch in common.pieces(whole, 8 << 20):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            n, first, second, lists = [], [], [], []
            for text in texts:
                packed = b"".join(map(memo.__getitem__, split(text or "")))
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                if ids_out:
                    lists.append(ids.astype(np.int32))
                else:
                    first.append(hashlib.sha256(packed).hexdigest())
                    second.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids.tolist()))).hexdigest())
            if ids_out:
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(first), pa.array(second)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, path: str, pattern: str | None, ids_out: bool) -> DataFrame:
    import public_tokenizers

    pattern, standard = pattern or public_tokenizers.PATTERN, public_tokenizers.PATTERN
    base = docs.select(*common.doc_columns(docs, "doc_id"))
    return base.mapInArrow(common.tidy(lambda it: encode_batches(it, path, pattern, standard, ids_out)), IDS_SCHEMA if ids_out else SCHEMA)


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (int array) of every whole text.

    ``path`` is a rank file present at the same place on every executor.  Null or empty texts give
    no ids; repeated rows and null ids are kept as they are; only doc_id and text are read.
    One pass, no shuffle: memory is one batch and a bounded cache of encoded pieces.
    """
    return _run(docs, path, pattern, True)


def digest_documents(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the encoding and its decoding as digests."""
    return _run(docs, path, pattern, False)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, data (bytes) for each row of ``encode_documents``; a null list decodes to no bytes."""

    def run(batches):
        tokens = {r: t for t, r in read_ranks(path).items()}
        for b in batches:
            out = [b"".join(tokens[i] for i in ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "data"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, data binary")
