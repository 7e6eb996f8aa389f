"""BPE encoding and decoding: speculate and verify.

Every new word is cut greedily into the longest tokens. Vectorised checks then test every adjacent pair of
all new words of a batch; a word whose pairs are all compatible is what merging would give, and only words
that fail are merged exactly. Encoded words are kept per worker as packed ids, in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, real_id, texts
from tidewater.llm.letters import pieces
from tidewater.llm.vocab import Vocab, byte_chars, compiled, ship, tokenizer_file

FILE = "byte_bpe_50k.json"
#: Words that a worker remembers.
REMEMBER = 400_000


class Encoder:
    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        back = {c: b for b, c in enumerate(byte_chars())}
        as_bytes = [bytes(back[c] for c in name) for name in vocab.names]
        self.token = {x: t for t, x in enumerate(as_bytes)}
        self.longest = max(map(len, as_bytes))
        self.text_of = {int(i): x for i, x in zip(vocab.ids, as_bytes)} | {i: s.encode() for s, i in vocab.added.items()}
        self.known: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True)))) if vocab.added else None
        self.merged = self.proposed = 0

    def greedy(self, piece: bytes) -> list[int]:
        out, at, token, n = [], 0, self.token, len(piece)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = token.get(piece[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words that are not known yet."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [self.greedy(w) for w in raw]
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(guess)), size)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.unique(owner[same[~self.vocab.compatible_all(flat[same], flat[same + 1])]])
        self.proposed += len(guess)
        self.merged += len(bad)
        for i in bad.tolist():
            guess[i] = self.vocab.merge(self.vocab.symbols(raw[i]))
        return {w: self.vocab.ids[np.array(g, np.int64)].tobytes() for w, g in zip(words, guess)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        parts = []  # per text: pieces, or bytes for an added token
        for text in texts:
            if self.special is not None and self.special.search(text):
                own, at = [], 0
                for m in self.special.finditer(text):
                    own += pieces(text[at : m.start()])
                    own.append(self.vocab.added[m[0]].to_bytes(4, "little"))
                    at = m.end()
                parts.append(own + pieces(text[at:]))
            else:
                parts.append(pieces(text))
        words = set().union(*parts)
        if len(self.known) > REMEMBER:
            self.known = {}
        new = [w for w in words if w not in self.known and type(w) is str]
        if new:
            self.known |= self.learn(new)
        get = self.known.get
        return [b"".join([get(w, w) for w in own]) for own in parts]

    def decode(self, packed: bytes) -> str:
        get = self.text_of.__getitem__
        return b"".join(map(get, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def encoder(shipped) -> Encoder:
    vocab = compiled(shipped)
    return _encoders.setdefault(id(vocab), Encoder(vocab)) if id(vocab) not in _encoders else _encoders[id(vocab)]


def _map(df: DataFrame, file: str | None, schema: str, row: Callable[[Encoder, list[str]], list[list]]) -> DataFrame:
    shipped = ship(df.sparkSession, file or tokenizer_file(FILE))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped)
        for batch in batches:
            for ids, values in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([ids, *row(enc, values)], kinds)], names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, without added begin or end tokens.

    A null or empty text has no ids; an added token's string inside a text is that token; rows keep their number,
    a null id stays null, an empty table gives an empty one; other columns are not read.
    """

    def row(enc, values):
        return [[np.frombuffer(x, "<u4").astype(np.int32) for x in enc.encode(values)]]

    return _map(texts(docs, id_col, text_col), file, "id long, ids array<int>", row).select(real_id("id").alias("doc_id"), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", file: str | None = None) -> DataFrame:
    """(doc_id, text): the text of every list of ids; null and empty lists give an empty text."""
    shipped = ship(encoded.sparkSession, file or tokenizer_file(FILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped)
        for batch in batches:
            got = [enc.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode() and of decoding its ids, in one pass.

    Null, empty and very long texts, repeated rows, null ids, empty tables and other columns as in encode().
    """

    def row(enc, values):
        packed = enc.encode(values)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return [[len(x) // 4 for x in packed], [digest(x) for x in packed], [digest(enc.decode(x).encode()) for x in packed]]

    got = _map(texts(docs, id_col, text_col), file, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
    return got.select(real_id("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def encode_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trips) of every row: encode(), with whether decoding the ids gives the text back.

    Null, empty and very long texts, repeated rows, null ids, empty tables and other columns as in encode().
    """

    def row(enc, values):
        packed = enc.encode(values)
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
        return [[len(x) for x in ids], ids, [int(enc.decode(x) == v) for x, v in zip(packed, values)]]

    got = _map(texts(docs, id_col, text_col), file, "id long, n_tokens long, ids array<int>, same int", row)
    return got.select(real_id("id").alias("doc_id"), "n_tokens", "ids", (F.col("same") == 1).alias("round_trips"))
