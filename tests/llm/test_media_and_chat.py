import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gemello.llm import chat_format, media_iso


@pytest.mark.parametrize("n", [1, 12, 13, 64, 65, 200])
def test_iso_round_trip(n):
    payload = bytes(i % 251 for i in range(n * media_iso.BLOCK))
    file = media_iso.write(payload)
    (track,) = media_iso.parse(file)
    assert media_iso.payload_of(file, track) == payload
    assert (track.codec, track.kind, track.duration, track.timescale) == ("raw ", "vide", n, media_iso.TIMESCALE)
    for i, (start, size) in enumerate(track.key_ranges()):
        at = i * media_iso.KEY_EVERY * media_iso.BLOCK
        assert file[start : start + size] == payload[at : at + media_iso.BLOCK]


def box(kind, *content):
    return struct.pack(">I4s", 8 + sum(map(len, content)), kind) + b"".join(content)


def test_iso_other_layouts():
    payload = bytes(range(256)) * 9
    file = media_iso.write(payload)
    size = struct.unpack(">I", file[:4])[0]
    # a free box with a 64-bit size behind ftyp moves the media: offsets then point elsewhere, but boxes still parse
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd"
    assert len(media_iso.parse(file[:size] + wide + file[size:])) == 1
    # a last box of size 0 reaches to the end
    at = file.index(b"mdat") - 4
    open_end = file[:at] + bytes(4) + file[at + 4 :]
    assert media_iso.payload_of(open_end, media_iso.parse(open_end)[0]) == payload


@pytest.mark.parametrize("bad", [b"", b"x", b"\0\0\0\4moov", box(b"free"), box(b"moov", b"\0\0\1\0trak"), box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsz", bytes(4), struct.pack(">II", 5, 3)))))))])
def test_iso_errors(bad):
    with pytest.raises(media_iso.MediaError):
        media_iso.parse(bad)


def test_media_columns(spark):
    good = media_iso.write(b"\xff" * 576 * 30)
    rows = [(1, good, "x"), (2, b"junk", "y"), (3, None, "z"), (3, None, "z"), (4, good[:-100], "t"), (5, good[:200], "u")]
    out = media_iso.with_media(spark.createDataFrame(rows, "id long, content binary, codec string"), "content").collect()
    by = {r.id: r for r in out}
    assert len(out) == 6 and by[1].codec == "raw " and by[1].duration_ms == 1200 and [k.bytes for k in by[1].keyframes] == [576] * 3 and by[1].media_error is None
    assert by[2].codec is None and by[2].media_error and by[3].media_error is None and by[5].media_error
    assert media_iso.with_media(spark.createDataFrame([], "content binary"), "content").count() == 0


def test_media_digests(spark):
    texts = [None, "", "a", "é" * 288, "é" * 289, "long " * 9000, "a"]
    out = media_iso.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.media_bytes > len(want) and r.feature.startswith("codec=raw;")
    assert len({r.media_sha256 for r in out if texts[r.doc_id] == "a"}) == 1
    stored = media_iso.stored(spark.createDataFrame([(1, "hello")], "doc_id long, text string")).first()
    assert hashlib.sha256(media_iso.payload_of(stored.media, media_iso.parse(stored.media)[0])).hexdigest() == hashlib.sha256(media_iso.padded("hello")).hexdigest()


TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("<|\\>n\n im_startend")), st.characters(exclude_categories=["Cs"])), max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_any_turns_read_back(turns):
    text = chat_format.rendered(turns)
    assert [x[:2] for x in chat_format.parse(text)] == turns


@pytest.mark.parametrize("text", ["<|im_end|>", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "a<", "<|", "", "\n", "<n|", "<\\n|"])
def test_conflicting_texts(text):
    shown = chat_format.rendered([(text, text), ("assistant", text)])
    assert [x[:2] for x in chat_format.parse(shown)] == [(text, text), ("assistant", text)]
    spans = chat_format.loss_spans(shown)
    assert [chat_format.unescape(shown[a:b]) for a, b in spans[-1:]] == [text]


@pytest.mark.parametrize("text", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\n<|a<|im_end|>\n"])
def test_grammar_errors(text):
    with pytest.raises(chat_format.GrammarError):
        list(chat_format.parse(text))


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "<|im_end|>"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "n"), (3, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    out = {r.conv_id: r for r in chat_format.digests(df).collect()}
    want = {1: [("user", ""), ("assistant", "b")], 2: [("", "<|im_end|>"), ("assistant", "x"), ("assistant", "x")], None: [("user", "n")], 3: [("assistant", "long " * 20000)]}
    assert set(out) == set(want)
    for conv, turns in want.items():
        r, loss = out[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat_format.rendered(turns)))
    full = {r.conv_id: r for r in chat_format.formatted(df).collect()}
    assert full[2].formatted == chat_format.rendered(want[2]) and [full[2].formatted[s.start : s.end] for s in full[2].loss_spans] == ["x", "x"]
    assert chat_format.digests(df.limit(0)).count() == 0
