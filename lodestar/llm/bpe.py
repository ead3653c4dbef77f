"""Byte-level BPE by prefix dynamic programming.

A byte prefix of a piece has exactly one valid last token: the one for which the encoding of the shorter
prefix before it, followed by the token, is what the merges give. So the encoder stores one token per
prefix: appending a byte only looks at tokens that end there, and an edit only redoes the positions from
the edit on. The last token's validity is a question on the pair of neighbours: two tokens stay apart
unless the merges would have joined bytes across their border earlier.

Pieces (matches of the pattern) are encoded separately. A bounded memo keeps the tokens of pieces and the
last tokens of their prefixes, so that pieces that share a beginning share the work.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to no bytes; special
tokens do not exist, their strings are ordinary text; other columns are ignored; rows are kept one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, table

MEMO_PIECES = 600_000  # pieces whose tokens are kept in a worker
MEMO_PREFIXES = 1_500_000  # prefixes whose last token is kept in a worker


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes single pieces (bytes) by the last token of each prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = self._splits()
        #: Tokens that the merges can give; a vocabulary may hold others.
        self.valid = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.split}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._prefix: dict[bytes, int] = {b"": -1}

    def _splits(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge gives a token; single bytes have none.

        They are the last two parts left when the token's bytes are merged by ranks below its own.
        """
        out: dict[int, tuple[int, int]] = {}
        ranks = self.ranks
        for token, rank in ranks.items():
            if len(token) == 1:
                continue
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1], rank)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out[rank] = (ranks[parts[0]], ranks[parts[1]])
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their bytes are encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Walk both tokens' merges backwards, latest first, towards the border.

        ``limit`` is the rank of the merge undone last: a merge across the border counts only if it
        would have come before that one. Of equal ranks the left one merges first, hence the + 1.
        """
        tokens, ranks, split = self.tokens, self.ranks, self.split
        limit = 2**32
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            undo_left = left in split and (left > right or right not in split)
            if undo_left:
                limit, left = left, split[left][1]
            elif right in split:
                limit, right = right + 1, split[right][0]
            else:
                return True

    def last_token(self, piece: bytes, end: int, last: list[int]) -> int:
        """The valid last token of piece[:end]; last[i] is that of piece[:i]."""
        for start in range(max(0, end - self.longest), end):
            token = self.valid.get(piece[start:end])
            if token is not None and (start == 0 or self.fits(last[start], token)):
                return token
        raise ValueError(f"a byte has no token: {piece[end - 1 : end]!r}")

    def prefixes(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last tokens of all prefixes. Given those of an earlier text's common prefix, only the rest is done."""
        last = [-1] if last is None else last
        for end in range(len(last), len(piece) + 1):
            last.append(self.last_token(piece, end, last))
        return last

    def edited(self, old: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """old with [start:stop) replaced by new, and its last tokens: those before the edit are taken over."""
        piece = old[:start] + new + old[stop:]
        return piece, self.prefixes(piece, last[: start + 1])

    def read_back(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens, from the end to the beginning."""
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.tokens[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece. The memo supplies the last tokens of the longest prefix that an earlier piece had."""
        memo, n = self._prefix, len(piece)
        if n > 64:
            return self.read_back(piece, self.prefixes(piece))
        if len(memo) > MEMO_PREFIXES:
            memo.clear()
            memo[b""] = -1
        valid, pairs, fits, longest = self.valid.get, self._pairs.get, self.fits, self.longest
        known = n
        while piece[:known] not in memo:  # what is shorter than a known prefix is known, too
            known -= 1
        tokens, token = self.tokens, memo[piece[:known]]
        for end in range(known + 1, n + 1):
            # there is one valid last token, so any order of trying finds it: first the last one before, made longer
            first = end - 1 - len(tokens[token]) if end > 1 else 0
            for start in (first, *range(max(0, end - longest), end)):
                token = valid(piece[start:end])
                if token is None:
                    continue
                if not start:
                    break
                left = memo[piece[:start]]
                fit = pairs((left, token))
                if fits(left, token) if fit is None else fit:
                    break
            else:
                raise ValueError(f"a byte has no token: {piece[end - 1 : end]!r}")
            memo[piece[:end]] = token
        out, end = [], n
        while end:
            token = memo[piece[:end]]
            out.append(token)
            end -= len(tokens[token])
        return out[::-1]


class BytePairCodec:
    """Texts to ids and back: the pattern's pieces, each encoded by prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.encoder = PrefixEncoder(ranks)
        self.find = regex.compile(pattern).findall

        packed = {i: i.to_bytes(4, "little") for i in self.encoder.tokens}

        class Memo(dict):
            def __missing__(memo, piece: str) -> bytes:
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                out = memo[piece] = b"".join(map(packed.__getitem__, self.encoder.encode(piece.encode("utf-8"))))
                return out

        self.memo = Memo()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.encoder.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One per worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, sha256 of the ids and of the decoded bytes; with ids=True also the ids (binary)."""
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in slices(texts, 1 << 22):
                n, ids_sha, back_sha, raw = [], [], [], []
                for text in texts[start:stop]:
                    encoded = own.encode_bytes(text or "")
                    n.append(len(encoded) // 4)
                    ids_sha.append(hashlib.sha256(encoded).hexdigest())
                    back_sha.append(hashlib.sha256(own.decode(memoryview(encoded).cast("I"))).hexdigest())
                    raw.append(encoded if ids else None)
                columns = [b.column(0).slice(start, stop - start), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, schema)


def op8_byte_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
