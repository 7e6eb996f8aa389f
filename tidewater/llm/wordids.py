"""Token ids of whole texts by the tokenizers library.

Where the vocabulary marks word ends and drops white space, no token, rule or normal form reaches across ASCII white
space. Texts are then split there, the distinct pieces of a batch are found by Arrow, and the library encodes only pieces
that a worker has not met; what it has met lies in two tables of bounded size, the older of which goes when the newer is full. Any other
vocabulary encodes text by text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tidewater.llm.letters import composed, lowered
from tidewater.llm.tokencount import BEFORE, BLANK, HERE, classes, outputs, word_machine
from tidewater.llm.vocab import byte_chars

#: Pieces in the newer table of a worker before it becomes the older one.
REMEMBER = 200_000
#: Bytes of text that are encoded at once; a longer text is taken by itself.
AT_ONCE = 1 << 22

#: The split between words that word_machine() follows; fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind whose words word_machine() finds and whose last tokens end words."""
    steps = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    norms = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    added = [x["content"] for x in spec.get("added_tokens", [])]
    return bool(spec["model"].get("end_of_word_suffix")) and steps[:1] == [WORDS] and norms == ["NFC", "Replace", "Lowercase"] and not any(re.search(r"\s", x) for x in added)


class WordIds:
    """Encodes Arrow columns of texts into packed ids of `width` bytes, little-endian."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        self.library = Tokenizer.from_str(raw.decode())
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.by_words = _by_words(spec)
        if self.by_words:
            # the same model without what word_machine() has done by then
            self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            names = self.words.get_vocab()
            self.ends = np.zeros(max(names.values()) + 1, bool)
            suffix = spec["model"]["end_of_word_suffix"]
            for name, i in names.items():
                self.ends[i] = name.endswith(suffix)
            added = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
            self.special = re.compile("|".join(map(re.escape, added))) if added else None
            self.stand_in = dict(enumerate(byte_chars())) | {32: " "}
            self.machine, self.classes = word_machine(), classes()
            self.newer: dict[str, bytes] = {}
            self.older: dict[str, bytes] = {}
            self.learned = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces without white space or added tokens: one tape, cut into words, given to the library at once."""
        normal = [x.lower() if x.isascii() else lowered(composed(x)) for x in pieces]
        tape = np.frombuffer(("\n".join(normal) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[tape]
        said = outputs(kinds, *self.machine)
        start = (said & HERE).astype(bool)
        start[:-1] |= (said[1:] & BEFORE).astype(bool)
        begun = np.concatenate([[0], np.cumsum(start)])
        words = begun[np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)) + 1)]  # up to the end of each piece
        keep = kinds != BLANK
        spaced = np.full(int(keep.sum()) + int(begun[-1]), 32, np.uint32)  # a space before every word
        spaced[(np.cumsum(keep) + begun[1:] - 1)[keep]] = tape[keep]
        text = spaced.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stand_in)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        last = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[words] * self.width
        packed, at, out = ids.tobytes(), 0, []
        for end in last.tolist():
            out.append(packed[at:end])
            at = end
        self.learned += len(pieces)
        return out

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.newer) > REMEMBER:
            self.newer, self.older = {}, self.newer
        newer, older, new = self.newer, self.older, []
        for x in pieces:
            if x not in newer:
                got = older.get(x)
                if got is None:
                    new.append(x)
                else:
                    newer[x] = got
        odd = [x for x in new if self.special is not None and self.special.search(x)]
        if odd:
            newer.update((x, self._whole(x)) for x in odd)
            new = [x for x in new if x not in newer]
        if new:
            newer.update(zip(new, self._learn(new)))
        return [newer[x] for x in pieces]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text; a null text has none."""
        if not self.by_words:
            return [self._whole(x or "") for x in texts.to_pylist()]
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        own = pa.array(self._of_pieces(pieces.dictionary.to_pylist()), pa.large_binary())
        got = own.take(pieces.indices)
        if not len(got):
            return [b""] * len(texts)
        at = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        data = memoryview(got.buffers()[2] or b"")
        ends = at[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


def slices(texts: pa.Array, limit: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about limit bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield at, end - at
        at = end


_encoders: dict[int, WordIds] = {}


def word_ids(shipped) -> WordIds:
    """The encoder of a shipped tokenizer file, once per worker."""
    raw = shipped.value
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = WordIds(raw)
    return _encoders[key]
