"""Operator 10: exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can end its encoding: the
longest suffix token whose pairing with the last token of the prefix before it
would not be merged otherwise. A suffix automaton over the vocabulary (a trie
with failure links) lists the tokens that end at each byte; a pair test decides;
back-pointers give the ids. Pre-tokens repeat, so each worker keeps the encoded
form of recent ones in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import arrow_map, documents

#: How the public byte-level vocabulary splits text before merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers, and the longest one worth remembering.
REMEMBERED, LONGEST = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    visible Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.size = max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.token: list[bytes] = [b""] * self.size
        for t, i in model["vocab"].items():
            self.token[i] = as_bytes[t]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            self.token[i] = text.encode()
        self.single = [0] * 256
        for t, i in model["vocab"].items():
            if len(as_bytes[t]) == 1:
                self.single[as_bytes[t][0]] = i
        # merges: (left, right) -> (rank, merged); each merged token remembers its first halves
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (model["vocab"][a], model["vocab"][b]), model["vocab"][a + b]
            if pair not in self.rank:
                self.rank[pair] = (r, whole)
                self.halves.setdefault(whole, pair)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        lengths = np.array([len(t) for t in self.token], np.int64)
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.length = lengths

    def _automaton(self) -> None:
        """A trie of all reachable tokens with failure links; per state the tokens that
        end there, longest first."""
        goto: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        reachable = [*self.halves, *self.single]
        for i in reachable:
            s = 0
            for b in self.token[i]:
                if b not in goto[s]:
                    goto[s][b] = len(goto)
                    goto.append({})
                    ends.append(-1)
                s = goto[s][b]
            ends[s] = i
        fail = [0] * len(goto)
        tails: list[tuple[int, ...]] = [()] * len(goto)
        queue = deque(goto[0].values())
        for s in queue:
            tails[s] = (ends[s],) if ends[s] >= 0 else ()
        while queue:
            s = queue.popleft()
            for b, t in goto[s].items():
                f = fail[s]
                while f and b not in goto[f]:
                    f = fail[f]
                fail[t] = goto[f].get(b, 0) if goto[f].get(b, 0) != t else 0
                tails[t] = ((ends[t],) if ends[t] >= 0 else ()) + tails[fail[t]]
                queue.append(t)
        self.goto, self.fail, self.tails = goto, fail, tails

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` stay two tokens when their bytes are encoded:
        undo both tokens' last merges, latest first, and see that no merge across the
        border would have come earlier."""
        got = self._pairs.get((left, right))
        if got is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            got = self._pairs[left, right] = self._fits(left, right)
        return got

    def _fits(self, left: int, right: int) -> bool:
        limit = 1 << 60
        halves, rank = self.halves, self.rank
        while True:
            across = rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = halves.get(left), halves.get(right)
            ra = rank[a][0] if a else -1
            rb = rank[b][0] if b else -1
            if ra < 0 and rb < 0:
                return True
            # The later merge is undone first. Of equal ranks the left one is made first, so
            # a border merge of the same rank still comes before the right token's own.
            if ra > rb:
                limit, left = ra, a[1]
            else:
                limit, right = rb + 1, b[0]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(data)
        last: list[int] = []
        goto, fail, tails, token, fits = self.goto, self.fail, self.tails, self.token, self.fits
        s = 0
        for i in range(n):
            b = data[i]
            while s and b not in goto[s]:
                s = fail[s]
            s = goto[s].get(b, 0)
            for t in tails[s]:
                rest = i + 1 - len(token[t])
                if rest == 0 or fits(last[rest - 1], t):
                    last.append(t)
                    break
        out: list[int] = []
        while n:
            t = last[n - 1]
            out.append(t)
            n -= len(token[t])
        out.reverse()
        return out

    def _ids(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut and any(t in text for t in self.added) else [text]
        out: list[bytes] = []
        known, slow = self.known, self._ids
        for part in parts:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                out += [known.get(p) or slow(p) for p in self.split.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; broken sequences become U+FFFD."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        n = self.length[i]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.begin[i] - ends + n, n)
        raw = self.flat[at].tobytes()
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every text.

    Returns (id, n_tokens, ids array<int> if ``keep_ids``, decoded string if ``keep_ids``,
    ids_sha256, decoded_sha256). A null or empty text has no tokens. Rows repeat as they
    come; other columns are dropped, so their names can't clash. ``path``: a vocabulary
    file in the tokenizers library's format that every executor can read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
        texts = [c.decode(i) for i in ids]
        cols = [
            batch.column(0),
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        ]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([t.decode() for t in texts])]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), run, schema)


def vocabulary() -> str:
    """The public vocabulary file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), vocabulary(), keep_ids=False)
