"""Token counts, BPE and Ogg against the libraries' own results or plain code."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer, normalizers

from tests.llm.fixtures import frame, rows
from tidewater.llm import bpe, letters, ogg, tokencount
from tidewater.llm.vocab import Vocab, tokenizer_file

HARD = "aabcdeéèßüñİΣςſKÅ'’\"sStTrRvVlLeEmd  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u0663Ⅷ½²9 0123!?.,-_#\U0001f600\u0301\u0327漢字ひナ\u0646\u0635"


def texts():
    rnd = random.Random(2)
    own = ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "it's we're I'll 'tis '' 's's !'s 'rx 've 'v 'r", "'r", "'l", "a" * 3000]
    return own + ["".join(rnd.choice(HARD) for _ in range(rnd.randint(0, 120))) for _ in range(1500)] + [r[1] or "" for r in rows()]


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(tokenizer_file(tokencount.FILE))
    own = tokencount.Counter(Vocab(open(tokenizer_file(tokencount.FILE), "rb").read()))
    assert own.counts(texts()).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts()]


def every_character():
    """Texts that together have every code point after, before and between letters, doubled, and before a mark."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    random.Random(4).shuffle(points)
    return ["".join(f"a{c}b {c}{c}!{c}" for c in points[i : i + 16]) + "\u0323" for i in range(0, len(points), 16)]


def test_every_character_counts_as_in_the_library():
    lib = Tokenizer.from_file(tokenizer_file(tokencount.FILE))
    own = tokencount.Counter(Vocab(open(tokenizer_file(tokencount.FILE), "rb").read()))
    values = every_character()
    assert own.counts(values).tolist() == [len(x.ids) for x in lib.encode_batch(values, add_special_tokens=False)]


def test_every_character_splits_as_in_the_library():
    lib = Tokenizer.from_file(tokenizer_file(bpe.FILE)).pre_tokenizer
    for text in every_character()[::5]:
        assert [len(x.encode()) for x in letters.pieces(text)] == [len(x) for x, _ in lib.pre_tokenize_str(text)]


def test_marks_are_ordered_as_in_the_library():
    lib, rnd = normalizers.NFC(), random.Random(6)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    bases = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c))[0] == "L"] + list("aceou") * 2000
    for _ in range(20_000):
        text = "".join(rnd.choice(bases) + "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 3))) for _ in range(2))
        assert letters.composed(text) == lib.normalize_str(text)


@pytest.mark.parametrize("chunk", [1, 3, 128, 10_000])
def test_chunks_do_not_change_the_output(chunk):
    kinds = np.random.default_rng(chunk).integers(0, 10, 5000).astype(np.uint8)
    go, out = tokencount.word_machine()
    state, want = 0, []
    for k in kinds:
        want.append(out[state, k])
        state = go[state, k]
    assert tokencount.outputs(kinds, go, out, chunk).tolist() == want


def test_ids_equal_the_library():
    lib = Tokenizer.from_file(tokenizer_file(bpe.FILE))
    own = bpe.Encoder(Vocab(open(tokenizer_file(bpe.FILE), "rb").read()))
    packed = own.encode(texts())
    for t, x in zip(texts(), packed):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(x, "<u4").tolist() == ids
        assert own.decode(x) == lib.decode(ids, skip_special_tokens=False)
    assert 0 < own.merged < own.proposed


def test_pair_checks_agree():
    vocab = Vocab(open(tokenizer_file(bpe.FILE), "rb").read())
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3000, 20_000), rng.integers(0, 3000, 20_000)
    assert vocab.compatible_all(a, b).tolist() == [vocab.compatible(int(x), int(y)) for x, y in zip(a, b)]


def test_token_counts(spark):
    lib = Tokenizer.from_file(tokenizer_file(tokencount.FILE))
    want = Counter()
    for r in rows():
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 2048] += 1
    assert Counter(tuple(r) for r in tokencount.token_counts(frame(spark)).collect()) == want
    assert tokencount.token_counts(frame(spark, [])).count() == 0


def test_round_trip(spark):
    lib = Tokenizer.from_file(tokenizer_file(bpe.FILE))
    want = Counter()
    for r in rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(frame(spark)).collect()) == want
    back = bpe.decode(bpe.encode(frame(spark)))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows())
    assert all(r.round_trips for r in bpe.encode_rows(frame(spark)).collect())
    assert bpe.round_trip(frame(spark, [])).count() == 0


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rnd = random.Random(1)
    for n in (0, 1, 5, 300):
        data = bytes(rnd.randrange(256) for _ in range(n))
        assert ogg.checksum(data) == slow_crc(data)


def test_streams_packets_times():
    rnd = random.Random(4)
    one = [(bytes(rnd.randrange(256) for _ in range(n)), (i + 1) * 100) for i, n in enumerate([0, 1, 254, 255, 256, 510, 70_000, 3])]
    two = [(b"x" * n, i) for i, n in enumerate([5] * 700)]
    pages = [ogg.write_stream(7, one), ogg.write_stream(9, two)]
    data = ogg.interleave(*pages)
    streams, bad = ogg.read(data)
    assert bad == 0 and set(streams) == {7, 9}
    assert [p for p, _ in streams[7].packets] == [p for p, _ in one] and [p for p, _ in streams[9].packets] == [p for p, _ in two]
    assert streams[7].last == 800 and streams[9].last == 699 and streams[7].ended
    assert all(g in (-1, (i + 1) * 100) for i, (_, g) in enumerate(streams[7].packets))
    # one damaged page in the middle of the long packet
    middle = data.index(pages[0][1])
    hurt = bytearray(data)
    hurt[middle + 300] ^= 1
    streams, bad = ogg.read(bytes(hurt))
    assert bad >= 1 and streams[7].lost >= 1 and len(streams[9].packets) == 700
    whole = {p for p, _ in one}
    assert all(p in whole for p, _ in streams[7].packets)
    assert ogg.read(b"")[0] == {} and ogg.read(b"OggS")[1] == 1 and ogg.read(data[:-1])[1] == 1


def test_media(spark):
    got = ogg.media_documents(frame(spark), keep_media=True).collect()
    want = Counter()
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and "bad=0;whole=1" in r.feature
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert ogg.media_documents(frame(spark, [])).count() == 0
    files = spark.createDataFrame([(1, got[0].media), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    packets = ogg.read_packets(files, "doc_id", "media").collect()
    assert {p.id for p in packets} == {1} and {p.serial for p in packets} == {1, 2}


def test_every_packet_of_samples_has_its_time(spark):
    """Hundreds of packets, many to a page, of which the page states the last one's time alone."""
    payload = bytes(i % 251 for i in range(ogg.FRAME * 40 + 77))
    media = ogg.store(payload)
    files = spark.createDataFrame([(1, bytearray(media)), (1, bytearray(media)), (2, bytearray(ogg.store(b"")))], "doc_id long, media binary")
    got = [p for p in ogg.read_packets(files, "doc_id", "media").collect() if p.serial == ogg.SAMPLES]
    ends = [0] + [min(len(payload), (k + 1) * ogg.FRAME) for k in range(41)]
    assert sorted((p.packet_no, p.granule, p.seconds) for p in got if p.id == 1) == sorted((k, e, e / ogg.RATE) for k, e in enumerate(ends) for _ in range(2))
    assert [(p.packet_no, p.granule) for p in got if p.id == 2] == [(0, 0)]
    small = ogg.Stream(1, packets=[(ogg.HEADER + b"x", 0), (b"ab", -1), (b"c", 3), (b"defg", -1)])
    assert ogg.timed(small) == [0, 2, 3, -1]
    assert ogg.read_packets(files.limit(0), "doc_id", "media").count() == 0
