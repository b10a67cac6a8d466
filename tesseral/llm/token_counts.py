"""Token counts of a piece vocabulary (BPE with scores, byte fallback) without the ids.

Texts are cut where no merge can cross: before a space, and between two characters that stand side by
side in no piece of the vocabulary.  The distinct parts of a batch become one ragged array, and all
sequences merge their lowest-ranked pair at the same time, wherever it occurs in them, until none is
left.  The surviving symbols are the count.  A sequence takes as many rounds as ranks occur in it, however
long it is.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Tokens a document may have before over_limit is set.
LIMIT = 4096
#: Piece counts that one Python worker remembers at most.
CACHE_PIECES = 600_000
BAR = "▁"


class PieceModel:
    """Merge table of a piece model file: symbols are numbered, pairs are looked up in sorted keys."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            m = pb.ModelProto.FromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        usual = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
        if not usual or t.model_type != 2 or not t.byte_fallback or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE piece models with identity normalisation, a dummy prefix and byte fallback are supported")
        if any(p.type == 4 for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        score = {p.piece: p.score for p in m.pieces if p.type == 1}
        if any(re.search(f"[^{BAR}]{BAR}", p) for p in score):
            raise ValueError("pieces that run into the next word are not supported")
        names = list(dict.fromkeys([*score, *(c for p in score for c in p)]))
        number = {p: i + 5 for i, p in enumerate(names)}  # 1 to 4: characters of so many bytes in no piece
        self.size = len(names) + 5
        self.weight = np.ones(self.size, np.int64)
        self.weight[1:5] = range(1, 5)
        for p, i in number.items():
            if p not in score:
                self.weight[i] = len(p.encode())
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        table = {number[p[:i]] * self.size + number[p[i:]]: (order[s], number[p]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
        self.keys = np.array(sorted(table), np.int64)
        self.rank = np.array([table[k][0] for k in self.keys.tolist()] + [0], np.int64)
        self.made = np.array([table[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.none = len(order)
        beside = {number[x] * self.size + number[y] for p in score for x, y in zip(p, p[1:])}
        self.beside = np.array(sorted(beside), np.int64)
        # symbols whose making may be followed by a merge of the same or a lower rank that involves them
        own = np.full(self.size, -1, np.int64)
        for p, v in score.items():
            own[number[p]] = order[v]
        self.early = np.zeros(self.size, bool)
        for part in (self.keys // self.size, self.keys % self.size):
            self.early[part[self.rank[:-1] <= own[part]]] = True
        self.first = np.array([min(4, 1 + (i > 0x7F) + (i > 0x7FF) + (i > 0xFFFF)) for i in (0, 0x80, 0x800, 0x10000)], np.int64)
        self.chars = np.repeat(self.first, [0x80, 0x780, 0xF800, 0x100000]).astype(np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.chars[ord(p)] = i

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``none``: no such piece) and the symbol it makes."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(hit, self.rank[at], self.none), self.made[at]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece; rounds run over all sequences at once."""
        if not pieces:
            return np.zeros(0, np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        sym = self.chars[points].astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), size)
        total = np.zeros(len(pieces), np.int64)
        if not len(sym):
            return total
        last = np.append(piece[1:] != piece[:-1], True)
        pair = sym[:-1] * self.size + sym[1:]
        at = np.searchsorted(self.beside, pair)
        last[:-1] |= self.beside[np.minimum(at, len(self.beside) - 1)] != pair if len(self.beside) else True
        rank, made = self.pair(sym[:-1], sym[1:])
        rank, made = np.append(rank, self.none), np.append(made, 0)
        rank[last] = self.none
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], last[:-1])))
            least = np.minimum.reduceat(rank, start)
            live = least < self.none
            n = np.diff(np.append(start, len(sym)))
            if not live.all():  # finished sequences leave
                gone = np.repeat(~live, n)
                total += np.bincount(piece[gone], self.weight[sym[gone]], len(total)).astype(np.int64)
                sym, piece, rank, made, last = (x[~gone] for x in (sym, piece, rank, made, last))
                least, n = least[live], n[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, n))
            # of overlapping pairs every other one, from the left
            k = np.arange(len(at))
            begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
            odd = (k - np.maximum.accumulate(np.where(begins, k, 0))) & 1
            at = at[odd == 0]
            wait = self.early[made[at]]
            if wait.any():  # only the leftmost, as the next merge may be beside it
                of = np.repeat(np.arange(len(n)), n)[at]
                slow = np.zeros(len(n), bool)
                slow[of[wait]] = True
                at = at[~slow[of] | np.concatenate(([True], of[1:] != of[:-1]))]
            sym[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, piece, rank, made, last = (x[keep] for x in (sym, piece, rank, made, last))
            # the pairs on both sides of each new symbol
            redo = np.concatenate((at, np.maximum(at - 1, 0)))
            nxt = np.minimum(redo + 1, len(sym) - 1)
            r, m = self.pair(sym[redo], sym[nxt])
            rank[redo], made[redo] = np.where(last[redo], self.none, r), m
        return total


class Counter:
    """Tokens of whole texts, with the counts of seen pieces kept in two generations."""

    PARTS = re.compile(f"{BAR}+[^{BAR}]*")

    def __init__(self, model: PieceModel):
        self.model, self.young, self.old = model, {}, {}

    def cut(self, text: str) -> list[str]:
        """Pieces without their first bar; no merge crosses from one to the next."""
        if not text:
            return []
        if "  " not in text and BAR not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in self.PARTS.findall(BAR + text.replace(" ", BAR))]

    def __call__(self, texts: list[str]) -> list[int]:
        parts = [self.cut(t) for t in texts]
        if len(self.young) >= CACHE_PIECES // 2:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        wanted = set().union(*parts) if parts else set()
        new = []
        for p in wanted:
            if p not in known:
                n = old.get(p)
                if n is None:
                    new.append(p)
                else:
                    known[p] = n
        if new:
            known.update(zip(new, self.model.counts([BAR + p for p in new]).tolist()))
        return [sum(map(known.__getitem__, p)) for p in parts]


_workers: dict = {}


def count_batches(batches, path: str, limit: int):
    if path not in _workers:
        _workers[path] = Counter(PieceModel(path))
    counter = _workers[path]
    for whole in batches:
        for batch in common.pieces(whole, 8 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array(counter(texts), np.int64)
            _, off = common.utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text under the piece model at ``path``.

    Null and empty texts have no bytes and no tokens; repeated rows and null ids stay; only doc_id
    and text are read, so other columns do not matter.  An empty table gives no rows.  Of pairs with equal rank
    the leftmost merges first.  A very long text is counted whole, with memory in proportion to it.  One pass,
    no shuffle; memory is one batch slice and the bounded piece memory.
    """
    return docs.select(*common.doc_columns(docs, "doc_id")).mapInArrow(common.tidy(lambda it: count_batches(it, path, limit)), SCHEMA)
