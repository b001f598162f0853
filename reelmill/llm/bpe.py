"""Byte-level BPE over a corpus by merge replay, and decoding.

Texts are cut into pre-tokens, and only the distinct words of a block of documents are encoded. The block's words lie
in one array of tokens with links to both neighbours. An inverted index leads from each mergeable pair, by the rank of
what it merges to, to the positions where it stands; merges are applied in rank order over the whole block, and each
touches only its position and the two neighbours, whose new pairs join the index. A worker remembers words between
blocks up to a bound. Ids of a document are then its words' ids, one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The same pre-tokens as the vocabulary's own pattern, for texts of these letters only, where Python's own engine is twice as fast.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
BLANK = r" \t-\r"
PLAIN = re.compile(rf"[^\x00-\x7f{LETTER}]")
FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^{BLANK}{LETTER}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


#: Stands for no rank. From MANY positions on a merge is applied to all of them at once.
NONE, MANY = 2**31 - 1, 40


@dataclass(frozen=True)
class Params:
    ranks_path: str | None = None
    pattern: str | None = None
    block_chars: int = 8_000_000
    remembered_words: int = 300_000
    piece_words: int = 1_000_000


class Vocabulary:
    """Ranks of byte strings, and for each pair of tokens that merges the rank of the result."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.names = {rank: str(rank) for rank in self.tokens}
        get, merges = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    merges[left << 32 | right] = rank
        self.merges = merges
        self.merge_keys = np.array(sorted(merges), dtype=np.int64)
        self.merge_ranks = np.array([merges[k] for k in self.merge_keys.tolist()], dtype=np.int32)
        self.byte_pairs = np.array([[get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], dtype=np.int32)
        self.pattern = regex.compile(pattern)
        self.fast = FAST if pattern == default_pattern() else None

    def words(self, text: str) -> list[str]:
        if self.fast is not None and not PLAIN.search(text):
            return self.fast.findall(text)
        return self.pattern.findall(text)

    def pieces(self, text: str, size: int) -> Iterator[list[str]]:
        """The words of one text, some at a time."""
        found = (self.fast if self.fast is not None and not PLAIN.search(text) else self.pattern).finditer(text)
        while piece := [m.group() for m in islice(found, size)]:
            yield piece

    def merge_alone(self, word: bytes) -> list[int]:
        """Greedy merges of one word: the lowest rank first, the leftmost of equal ones."""
        if word in self.ranks:
            return [self.ranks[word]]
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        while len(ids) > 1:
            found = [(rank, i) for i in range(len(ids) - 1) if (rank := self.merges.get(ids[i] << 32 | ids[i + 1])) is not None]
            if not found:
                break
            rank, i = min(found)
            ids[i : i + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids of all words, one after the other; number of ids of each word), by merges in rank order over all of them.

        Frequent merges are applied to all their positions at once, rare ones one by one; both follow the same index. A
        merge touches its position and the two neighbours. Should one form a pair of lower rank than its own (the
        order within that word could then differ), the word is merged alone.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(words) else np.zeros(0, dtype=np.int64)
        n = len(data)
        token = self.bytes[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[(starts + sizes - 1)[sizes > 0]] = -1
        before[starts[sizes > 0]] = -1
        pair = np.full(n, NONE, dtype=np.int32)
        if n > 1:
            pair[:-1] = self.byte_pairs[data[:-1], data[1:]]
            pair[after < 0] = NONE
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[int]] = {}
        queue: list[int] = []
        odd: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray, least: int) -> None:
            odd.extend(at[ranks <= least].tolist())
            good = ranks > least
            good &= ranks < NONE
            at, ranks = at[good], ranks[good]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order].tolist(), ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist() + [len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rank = int(ranks[a])
                if rank in index:
                    index[rank].extend(at[a:b])
                else:
                    index[rank] = at[a:b]
                    heapq.heappush(queue, rank)

        first = np.flatnonzero(pair < NONE)
        enter(first, pair[first], -1)
        token_at, after_at, before_at, pair_at, alive_at = map(memoryview, (token, after, before, pair, alive))
        merges = self.merges
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            if len(found) >= MANY:
                at = np.unique(np.array(found, dtype=np.int64))
                at = at[pair[at] == rank]
                to = after[at]
                if not (pair[to] == rank).any():  # else occurrences overlap, and go from the left one by one
                    behind = after[to]
                    token[at], after[at] = rank, behind
                    pair[to], alive[to] = NONE, False
                    right = at[behind >= 0]
                    before[behind[behind >= 0]] = right
                    ahead = before[at]  # a neighbour may have merged in this step too
                    left = ahead[ahead >= 0]
                    pair[at] = NONE
                    pair[right] = self.pair_ranks(token[right], token[after[right]])
                    pair[left] = self.pair_ranks(token[left], token[after[left]])
                    both = np.concatenate((right, left))
                    enter(both, pair[both], rank)
                    continue
                found = at.tolist()
            for at in sorted(found):
                if pair_at[at] != rank:
                    continue
                to = after_at[at]
                behind, ahead = after_at[to], before_at[at]
                token_at[at], after_at[at] = rank, behind
                pair_at[to], alive_at[to] = NONE, False
                new = NONE
                if behind >= 0:
                    before_at[behind] = at
                    new = merges.get(rank << 32 | token_at[behind], NONE)
                    if new <= rank:
                        odd.append(at)
                    elif new < NONE:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(queue, new)
                pair_at[at] = new
                if ahead >= 0:
                    new = merges.get(token_at[ahead] << 32 | rank, NONE)
                    pair_at[ahead] = new
                    if new <= rank:
                        odd.append(at)
                    elif new < NONE:
                        if new in index:
                            index[new].append(ahead)
                        else:
                            index[new] = [ahead]
                            heapq.heappush(queue, new)
        counts = np.diff(np.concatenate(([0], np.cumsum(alive)))[np.concatenate((starts, [n]))]) if len(words) else np.zeros(0, dtype=np.int64)
        ids, counts = token[alive].tolist(), counts.tolist()
        if odd:
            cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
            alone = set((np.searchsorted(starts, odd, side="right") - 1).tolist())
            rows = [self.merge_alone(words[i]) if i in alone else ids[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            ids, counts = [x for row in rows for x in row], list(map(len, rows))
        return ids, counts

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what each pair merges to, or NONE."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.merge_keys, keys)
        at[at == len(self.merge_keys)] = 0
        return np.where(self.merge_keys[at] == keys, self.merge_ranks[at], NONE).astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def vocabulary(path: str | None, pattern: str | None) -> Vocabulary:
    """One a Python worker. path and pattern: by default the public 50k vocabulary and its pattern, looked up where the task runs."""
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


class Encoder:
    """Encodes blocks of texts. Words are numbered, and remembered between blocks up to a bound."""

    def __init__(self, vocab: Vocabulary, params: Params):
        self.vocab, self.params = vocab, params
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.parts: list[bytes] = []

    def learn(self) -> None:
        """Encodes the words that were numbered since the last call: ids as decimals, number of ids, decoded bytes."""
        vocab, fresh = self.vocab, list(islice(self.number, len(self.names), None))
        spelled = [w.encode("utf-8", "surrogatepass") for w in fresh]
        long = [w for w in spelled if w not in vocab.ranks]
        ids, counts = vocab.replay(long)
        names, tokens = list(map(vocab.names.__getitem__, ids)), list(map(vocab.tokens.__getitem__, ids))
        at, sizes = 0, iter(counts)
        for word in spelled:
            rank = vocab.ranks.get(word)
            if rank is not None:
                self.names.append(vocab.names[rank])
                self.sizes.append(1)
                self.parts.append(vocab.tokens[rank])
            else:
                n = next(sizes)
                self.names.append(" ".join(names[at : at + n]))
                self.sizes.append(n)
                self.parts.append(b"".join(tokens[at : at + n]))
                at += n

    def encode(self, texts: list[str]) -> Iterator[Iterator[array]]:
        """For each text the numbers of its words, in pieces, once the tables know them. A text longer than a block is
        cut into pieces of words."""
        params = self.params
        for block in _blocks(texts, params.block_chars):
            if len(self.names) > params.remembered_words:
                self.forget()
            if len(block[0]) > params.block_chars:
                yield self._pieces(block[0])
                continue
            number = self.number.__getitem__
            cut = [array("i", map(number, self.vocab.words(t))) for t in block]
            self.learn()
            for words in cut:
                yield iter([words])

    def _pieces(self, text: str) -> Iterator[array]:
        for piece in self.vocab.pieces(text, self.params.piece_words):
            words = array("i", map(self.number.__getitem__, piece))
            self.learn()
            yield words
            if len(self.names) > self.params.remembered_words:
                self.forget()


@lru_cache(maxsize=2)
def encoder(params: Params) -> Encoder:
    return Encoder(vocabulary(params.ranks_path, params.pattern), params)


def _blocks(texts: list[str], size: int) -> Iterator[list[str]]:
    block, held = [], 0
    for text in texts:
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield block


def encode_ids(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text, for use downstream. Null or empty text: an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            coder = encoder(params)
            rows = [[int(i) for piece in pieces for w in piece for i in coder.names[w].split()] for pieces in coder.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary): the bytes that the ids stand for; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(params.ranks_path, params.pattern)
        for batch in batches:
            data = [None if (ids := x.as_py()) is None else vocab.decode(ids) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, type=pa.binary())], ["doc_id", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns of op6: (doc_id, n_tokens, ids_sha256, decoded_sha256), one row a row of docs, no shuffle.

    Null and empty texts have no ids; their digests are those of no bytes. Repeated rows are encoded alike, an empty
    table gives an empty table, other columns are not read. A very long text is cut into words some at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, decoded = [], [], []
            texts = [t.as_py() or "" for t in batch.column(1)]
            coder = encoder(params)
            for pieces in coder.encode(texts):
                total, id_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for piece in pieces:
                    if piece:
                        id_hash.update((" " * (total > 0) + " ".join(map(coder.names.__getitem__, piece))).encode())
                        text_hash.update(b"".join(map(coder.parts.__getitem__, piece)))
                        total += sum(map(coder.sizes.__getitem__, piece))
                counts.append(total)
                ids.append(id_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(decoded, type=pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
