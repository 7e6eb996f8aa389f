"""Token counts from finite-state transducers.

Two deterministic transducers are compiled from the tokenizer file. The first walks characters, and its transitions
say where words start: a batch of texts is one long tape, cut into chunks; each chunk is run from all
states at once, which gives its state map, the maps compose through a parallel prefix scan, and a second
run from the now known states reads the output. The second walks the bytes of a word, and its transitions
carry the number of tokens emitted (the change of the best count, so it may be negative); it is made
deterministic as words need it, and a word's count is the sum along its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks, real_id, texts
from tidewater.llm.letters import SPACES, composed, letters_numbers, lowered
from tidewater.llm.vocab import Vocab, compiled, ship, tokenizer_file

FILE = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 128
#: Words and transitions that a worker remembers.
REMEMBER = 400_000

#: Character classes. STMD end a contraction after an apostrophe, R and V need an e, L another l.
BLANK, LETTER, STMD, R, V, L, E, NUMBER, QUOTE, OTHER = range(10)
#: States: no open word; in letters; in other marks; after an apostrophe; after 'r, 'v, 'l.
NONE, WORD, MARKS, APOSTROPHE, AFTER_R, AFTER_V, AFTER_L = range(7)
HERE, BEFORE = 1, 2  # outputs: a word starts at this character; one starts at the character before


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class: contractions, runs of letters, single numbers, runs of other marks."""
    go, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    for state in range(7):
        for kind in range(10):
            letter = LETTER <= kind <= E
            new = {BLANK: NONE, NUMBER: NONE, QUOTE: APOSTROPHE, OTHER: MARKS}.get(kind, WORD)
            starts = 0 if kind == BLANK else HERE
            if state == WORD and letter or state == MARKS and kind in (QUOTE, OTHER):
                new, starts = state, 0
            elif state == APOSTROPHE:
                if kind == STMD:
                    new, starts = NONE, 0
                elif kind in (R, V, L):
                    new, starts = {R: AFTER_R, V: AFTER_V, L: AFTER_L}[kind], 0
                elif kind in (QUOTE, OTHER):
                    new, starts = MARKS, 0
            elif state >= AFTER_R:
                if kind == (L if state == AFTER_L else E):
                    new, starts = NONE, 0
                elif letter:
                    new, starts = WORD, BEFORE
                else:
                    starts |= BEFORE
            go[state, kind], out[state, kind] = new, starts
    return go, out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = np.full(0x110000, OTHER, np.uint8)
    letters, numbers = letters_numbers()
    kind[letters], kind[numbers] = LETTER, NUMBER
    for first, last in SPACES:
        kind[first : last + 1] = BLANK
    for chars, k in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE)):
        for c in chars:
            kind[ord(c)] = k
    return kind


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan over state maps: row i becomes maps[0] then ... then maps[i], in log2(rows) steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def outputs(kinds: np.ndarray, go: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """What the machine puts out at every character of a tape that starts in state NONE."""
    n, width = len(kinds), go.shape[1]
    rows = -(-n // chunk)
    tape = np.zeros(rows * chunk, np.uint8)
    tape[:n] = kinds
    tape = np.ascontiguousarray(tape.reshape(rows, chunk).T)
    step, emit = go.reshape(-1), out.reshape(-1)
    maps = np.tile(np.arange(len(go), dtype=np.uint8), (rows, 1))
    for t in range(chunk):
        maps = step[maps * np.uint8(width) + tape[t][:, None]]
    state = np.zeros(rows, np.uint8)
    state[1:] = compose(maps)[:-1, NONE]
    said = np.empty((chunk, rows), np.uint8)
    for t in range(chunk):
        at = state * np.uint8(width) + tape[t]
        said[t], state = emit[at], step[at]
    return said.T.reshape(-1)[:n]


class Transducer:
    """Counts of a word's tokens, made deterministic as needed.

    A state is what the future depends on: every start from which a token may still be open (its place
    in the tree of tokens, the token before it, its count against the present one). A token may end
    where it stands compatible after the token before it; just one does.
    """

    def __init__(self, vocab: Vocab):
        self.vocab, self.child, self.ends = vocab, [{}], [-1]
        for t in range(len(vocab.left)):
            node = 0
            for s in self._spell(t):
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = self.child[node][s]
            self.ends[node] = t
        self.reset()

    def reset(self) -> None:
        self.number, self.states, self.moves = {}, [], {}
        self._state(((0, -1, 0),))
        self.words: dict[str, int] = {}

    def _spell(self, t: int) -> list[int]:
        out, stack = [], [t]
        while stack:
            x = stack.pop()
            if x < self.vocab.base:
                out.append(x)
            else:
                stack += [self.vocab.right[x], self.vocab.left[x]]
        return out

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _move(self, state: int, symbol: int) -> tuple[int, int]:
        still, done = [], None
        for node, before, count in self.states[state]:
            node = self.child[node].get(symbol)
            if node is not None:
                still.append((node, before, count))
                t = self.ends[node]
                if t >= 0 and done is None and (before < 0 or self.vocab.compatible(before, t)):
                    done = (t, count + 1)
        if done is None:
            raise ValueError("no token can end here: the vocabulary is not a proper BPE vocabulary")
        t, delta = done
        return self._state((*((node, before, count - delta) for node, before, count in still), (0, t, 0))), delta

    def count(self, word: str) -> int:
        state = total = 0
        for s in self.vocab.symbols(word.encode("utf-8", "surrogatepass")):
            got = self.moves.get((state, s))
            if got is None:
                got = self.moves[state, s] = self._move(state, s)
            state, delta = got
            total += delta
        return total


class Counter:
    def __init__(self, vocab: Vocab):
        self.machine, self.transducer, self.kinds = word_machine(), Transducer(vocab), classes()
        self.special = re.compile("|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True)))) if vocab.added else None

    def normal(self, text: str) -> str:
        """NFC, then lower case character by character, as the vocabulary's normaliser does."""
        return text.lower() if text.isascii() else lowered(composed(text))

    def counts(self, values: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra, tape, owner = np.zeros(len(values), np.int64), [], []
        for i, text in enumerate(values):
            own = [text]
            if self.special is not None and self.special.search(text):
                own = self.special.split(text)
                extra[i] = len(own) - 1
            for part in own:
                tape.append(self.normal(part))
                owner.append(i)
        line = "\n".join(tape) + "\n"
        size = np.fromiter(map(len, tape), np.int64, len(tape)) + 1
        kinds = self.kinds[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)]
        said = outputs(kinds, *self.machine)
        start = (said & HERE).astype(bool)
        start[:-1] |= (said[1:] & BEFORE).astype(bool)
        border = np.flatnonzero(start | (kinds == BLANK))
        which = np.flatnonzero(start[border])
        begin, end = border[which], border[which + 1]
        words = [line[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        t = self.transducer
        if len(t.words) > REMEMBER or len(t.moves) > 4 * REMEMBER:
            t.reset()
        known = t.words
        for w in set(words).difference(known):
            known[w] = t.count(w)
        each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(each)])
        at = np.searchsorted(begin, np.concatenate([[0], np.cumsum(size)]))
        np.add.at(extra, owner, total[at[1:]] - total[at[:-1]])
        return extra


_counters: dict[int, Counter] = {}


def counter(shipped) -> Counter:
    vocab = compiled(shipped)
    if id(vocab) not in _counters:
        _counters[id(vocab)] = Counter(vocab)
    return _counters[id(vocab)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have no bytes and no tokens; an added token's string inside a text counts as one
    token; repeated rows are counted each, a null id stays null, an empty table gives an empty one; other columns are not read.
    """
    shipped = ship(docs.sparkSession, file or tokenizer_file(FILE))

    got = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shipped)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for part, values in blocks(keys, batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part], pa.int64()), pa.array(own.counts(values))], ["id", "n_bytes", "n_tokens"]
                )

    got = got.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return got.select(real_id("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
