from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import tokens
from jobloom.llm.queries import word_tokenizer
from tests.llm.fixtures import rows, table


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(word_tokenizer(), 1)


def direct(encoder, text):
    return [*encoder.tok.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbé.,'<|>ßİ \n\t1÷×≠́sStT")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_word_memo_equals_whole_texts(texts):
    enc = tokens.encoder_for(word_tokenizer(), 1)
    ids, off = enc.encode(pa.array(texts, pa.large_string()))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [direct(enc, t) for t in texts]


@pytest.mark.parametrize("text", ["", "it's we'll don't.", "<|endoftext|> Foo<|startoftext|>bar", "<|ENDOFTEXT|>", "é.b ×.c", "a|b|c", "x̸ ≠", "www.a.b/c?d=1"])
def test_special_texts(encoder, text):
    ids, _ = encoder.encode(pa.array([text], pa.large_string()))
    assert ids.tolist() == direct(encoder, text)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    enc = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 1)
    texts = [*tokens.PROBES, "Hello  World\n", ""]
    ids, off = enc.encode(pa.array(texts, pa.large_string()))
    assert not enc.by_word and [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [direct(enc, t) for t in texts]
    assert tokens.WordEncoder(word_tokenizer(), 1).by_word


def test_files_and_random_access(monkeypatch):
    monkeypatch.setattr(tokens, "FRAME_BYTES", 256)
    w = tokens.FrameWriter()
    docs = [(d, np.arange(d % 50, dtype=np.uint32) * 7) for d in range(40)]
    for d, ids in docs:
        w.add(d, ids)
    raw = w.finish()

    class Counting(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            Counting.read_bytes += n
            return super().read(n)

    r = tokens.FrameReader(Counting(raw))
    assert [(d, ids) for d, _, ids in r.documents()] == [(d, x.tobytes()) for d, x in docs]
    tables = Counting.read_bytes
    Counting.read_bytes = 0
    assert [d for d, _, _ in tokens.FrameReader(Counting(raw)).documents({7})] == [7]
    assert Counting.read_bytes < tables and len(r.seek) > 5
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read(1 << 20) for _ in range(1))
    assert whole == b"".join(x.tobytes() for _, x in docs)  # skippable frames are skipped by any reader
    hurt = bytearray(raw)
    hurt[12] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  the frame's own or the table's checksum
        list(tokens.FrameReader(Counting(bytes(hurt))).documents())


def test_table_matches_direct_encoding(spark, encoder):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_table(table(spark), word_tokenizer()).collect()]
    want, start = [], 0
    ids_of = {(r[0], r[1]): direct(encoder, r[1] or "") for r in rows()}
    data = sorted(rows(), key=lambda r: (-1 if r[0] is None else r[0]))
    for r in data:
        ids = ids_of[r[0], r[1]]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert tokens.token_table(table(spark, []), word_tokenizer()).count() == 0


def test_wanted_documents_only(spark, tmp_path):
    files = tokens.write_tokens(table(spark), f"file://{tmp_path}/t", word_tokenizer(), n_files=3)
    assert sum(f.n_docs for f in files) == len(rows())
    assert sorted(r.doc_id for r in tokens.read_tokens(spark, files, [3, 9]).collect()) == [3, 9]
