"""Byte-level byte-pair encoding of converted documents, and decoding.

Ranks are data: they are read once on the driver from a rank file and reach the workers with the task's closure; a
vocabulary has a fixed size, which is checked. Tokens are byte strings; as Latin-1 text they form an Aho-Corasick
automaton that yields, in one pass over a piece, every token that starts at every byte. From the longest match on, a
piece is tiled from left to right; two neighbours must be compatible (merging their joined bytes gives exactly these
two), which is found from the tokens' last merges and memoised; a byte from which no tiling goes on is marked and never
entered again, so the work is linear in the piece. The result is the one that merging by rank gives.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, type_of, whole_text, worker_cache

MAX_VOCABULARY = 2_000_000
WORDS, PIECES, PAIRS = 200_000, 50_000, 300_000
MEMO_TEXT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{path}: {len(ranks)} tokens; at most {MAX_VOCABULARY} are sent to the workers")
    return ranks


class _Memo(dict):
    """A bounded memo of two generations: what was used lately survives when it is full. Long keys are not kept."""

    def __init__(self, make, limit):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
            if key.__class__ is str and len(key) > MEMO_TEXT:
                return v
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


class Codec:
    """Encoder and decoder for one vocabulary; one for each worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        self.width = max(map(len, ranks))
        self.matches = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.bytes_of[r] = b
            self.matches.add_word(b.decode("latin-1"), (r, len(b)))
        self.matches.make_automaton()
        self.plain = self.find(" ab,") == [" ab", ","] and self.find("ab.") == ["ab", "."]
        self.last_merge: dict[int, tuple[int, int] | None] = {}
        self.fits = _Memo(self._fits, PAIRS)
        self.pieces = _Memo(lambda s: self._piece(s.encode("utf-8")), PIECES)
        self.words = _Memo(self._word, WORDS)
        self.shorter: dict[int, tuple[int, int] | None] = {}

    def merge(self, b: bytes, below: int) -> list[int]:
        """Ids by merging pairs in rank order, only with ranks under `below` (for single tokens: a few bytes)."""
        parts = [b[i:i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `t`; None for a byte."""
        if t not in self.last_merge:
            b = self.bytes_of[t]
            made = self.merge(b, t) if len(b) > 1 else []
            self.last_merge[t] = (made[0], made[1]) if len(made) == 2 else None
        return self.last_merge[t]

    def _fits(self, pair: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves the border between them. Seen from the border, the last
        merges are undone, the later one first; what then meets must not merge earlier than what was undone."""
        left, right = divmod(pair, self.size)
        limit = self.size
        while True:
            r = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if r is not None and r < limit:
                return False
            # undo the later merge; on the left one a merge of equal rank has the border's precedence
            undo_left = left > right
            for _ in range(2):
                whole = left if undo_left else right
                inner = self.halves(whole)
                if inner is not None:
                    break
                undo_left = not undo_left
            else:
                return True
            if undo_left:
                limit, left = min(limit, left), inner[1]
            else:
                limit, right = min(limit, right + 1), inner[0]

    def prefix(self, t: int) -> tuple[int, int] | None:
        """The longest shorter token that `t` begins with, and its length."""
        if t not in self.shorter:
            b = self.bytes_of[t]
            n = next((k for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), 0)
            self.shorter[t] = (self.ranks[b[:n]], n) if n else None
        return self.shorter[t]

    def piece_ids(self, b: bytes) -> list[int]:
        if b in self.ranks:
            return [self.ranks[b]]
        s, tiles, fits, size, before = b.decode("latin-1"), self.matches.iter_long, self.fits, self.size, -1
        # the usual case: the longest match at every step, and all neighbours fit
        out, end = [], 0
        starts, ahead = [], tiles(s)
        for last, m in ahead:
            t, n = m
            if last + 1 - n != end or before >= 0 and not fits[before + t]:
                return self._backtrack(s, out, starts, end, m if last + 1 - n == end else self._longest(s, end))
            out.append(t)
            starts.append(end)
            end += n
            before = t * size
        return out if end == len(b) else self._backtrack(s, out, starts, end, self._longest(s, end))

    def _backtrack(self, s: str, out: list[int], starts: list[int], pos: int, here) -> list[int]:
        """Goes on behind the tokens `out` at `pos`, where `here` is the longest match: shorter matches where a neighbour
        doesn't fit, and back where none does."""
        fits, size, n = self.fits, self.size, len(s)
        dead, ahead = set(), iter(())
        while pos < n:
            before = out[-1] * size if out else -1
            while here is not None and (pos + here[1] in dead or before >= 0 and not fits[before + here[0]]):
                here = self.prefix(here[0])
            if here is not None:
                out.append(here[0])
                starts.append(pos)
                pos += here[1]
                if pos < n:  # the next longest match, from the running search while it is in step
                    last, here = next(ahead, (-1, (0, 0)))
                    if last + 1 - here[1] != pos:
                        ahead = self.matches.iter_long(s, pos)
                        last, here = next(ahead, (-1, (0, 0)))
                        if last + 1 - here[1] != pos:
                            here = self._longest(s, pos)
            else:
                dead.add(pos)
                if not out:
                    raise ValueError("the vocabulary cannot spell this piece")
                pos = starts.pop()
                here = self.prefix(out.pop())
        return out

    def _longest(self, s: str, pos: int) -> tuple[int, int]:
        n = self.matches.longest_prefix(s[pos:pos + self.width])
        while n and not self.matches.exists(s[pos:pos + n]):
            n -= 1
        return self.matches.get(s[pos:pos + n]) if n else None

    def _piece(self, b: bytes) -> bytes:
        from array import array
        return array("i", self.piece_ids(b)).tobytes()

    def _chunk(self, s: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.find(s)])

    def _word(self, w: str) -> bytes:
        """A blank and a word."""
        if self.plain:  # the pattern takes a word of letters with its blank, and a mark behind it alone
            if w.isalpha():
                return self._piece((" " + w).encode("utf-8"))
            if w[-1] in ",." and w[:-1].isalpha():
                return self._piece((" " + w[:-1]).encode("utf-8")) + self.pieces[w[-1]]
        return self._chunk(" " + w)

    def encode(self, text: str) -> bytes:
        """Ids of the text as 32-bit integers in a row. A single blank between two other characters always begins a
        match of the pattern, so the text is cut there first and equal words are looked up."""
        first, *words = cut_at_blanks(text)
        return self._chunk(first) + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def cut_at_blanks(text: str) -> list[str]:
    """The text cut at every single blank that stands between two characters other than white space."""
    import re
    if re.search(r"\s\s", text) is None and text[-1:] != " ":
        return text.split(" ")  # a blank in front makes the first part empty and counts as that of the first word
    return re.split(r"(?<=\S) (?=\S)", text)


def _shared(docs: DataFrame, ranks_path: str, pattern: str):
    """A broadcast vocabulary (its size is checked) and the key of its codec in the workers."""
    ranks = read_ranks(ranks_path)
    return docs.sparkSession.sparkContext.broadcast(ranks), (ranks_path, pattern, len(ranks))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_content: bool = False) -> DataFrame:
    """Token ids of the whole text of every document: (doc_id, token_ids array<int>, n_tokens long), one row per row.

    `pattern` cuts the text into pieces that are encoded separately; there are no special tokens. `with_content` adds
    `content`, the bytes that the ids decode to. Null or empty text: no ids. A null `doc_id` stays null, repeated rows stay
    repeated, other columns are not read.
    """
    import pyarrow as pa

    shared, key = _shared(docs, ranks_path, pattern)

    def work(batch):
        c = worker_cache(("bpe", key), lambda: Codec(shared.value, pattern))
        blobs = [c.encode(t) for t in batch.column(1).to_pylist()]
        n = [len(b) // 4 for b in blobs]
        ends = [0]
        for k in n:
            ends.append(ends[-1] + k)
        ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(blobs))])
        out = {"doc_id": batch.column(0), "token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), "n_tokens": n}
        if with_content:
            out["content"] = pa.array([c.decode(memoryview(b).cast("i")) for b in blobs], pa.binary())
        return out

    src = docs.select("doc_id", whole_text("text").alias("text"))
    return map_arrow(src, work, f"doc_id {type_of(docs, 'doc_id')}, token_ids array<int>, n_tokens long" + ", content binary" * with_content)


def decode_documents(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, token_ids, content binary): the bytes of the token ids, one row per row of `tokens` (doc_id, token_ids).
    Null or no ids: empty bytes; an id outside the vocabulary fails. Other columns are not read."""
    import pyarrow as pa

    shared, key = _shared(tokens, ranks_path, "")

    def work(batch):
        table = worker_cache(("bpe bytes", key), lambda: {r: b for b, r in shared.value.items()})
        of = table.__getitem__
        return {"doc_id": batch.column(0), "token_ids": batch.column(1),
                "content": pa.array([b"".join(map(of, ids or ())) for ids in batch.column(1).to_pylist()], pa.binary())}

    return map_arrow(tokens.select("doc_id", "token_ids"), work,
                     f"doc_id {type_of(tokens, 'doc_id')}, token_ids array<int>, content binary")
