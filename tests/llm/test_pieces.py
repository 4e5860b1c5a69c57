"""Piece encoding against the library: ids, byte spans, decoding, and normalisation by compiled character maps."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import piece_spans
from strandlake.llm.queries import op13_piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab theＡ ①\n\t12▁▁é日本語😀<s></s> 　\x00\x7f  "


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return piece_spans.piece_encoder(PATH)


def check(library, encoder, texts):
    for t, (ids, start, end) in zip(texts, encoder.encode(texts)):
        pieces = library.encode_as_proto(t).pieces
        assert (ids.tolist(), list(zip(start.tolist(), end.tolist()))) == ([p.id for p in pieces], [(p.begin, p.end) for p in pieces]), t
        assert encoder.decode(np.array([1, *ids.tolist(), 2])) == library.decode([1, *ids.tolist(), 2])


def test_equals_the_library(library, encoder, corpus):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    check(library, encoder, [*texts, "", " ", "  ", "▁", "▁ ", " ▁a", "<0x41>", "x" * 300, "日本語の" * 90, *(t or "" for _, t in corpus)])


def test_hypothesis(library, encoder):
    @settings(max_examples=150, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
    def run(t):
        check(library, encoder, [t, t + " "])

    run()


def test_long_texts_are_encoded_in_parts(library, encoder, monkeypatch):
    monkeypatch.setattr(piece_spans, "PART_BYTES", 50)
    check(library, encoder, [" the  river, lamps" * 40, "x" * 400, "▁ ab" * 100])


def test_one_by_one_equals_side_by_side(encoder):
    rng = random.Random(3)
    segments = ["".join(rng.choice("abceéthing日 ") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    assert encoder.merge_all(segments) == [encoder.merge(s) for s in segments]


def test_decode_any_ids(library, encoder):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 259]) for _ in range(rng.randint(0, 8))]
        assert encoder.decode(np.array(ids, np.int64)) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix, squeeze", [(False, True), (True, True), (False, False), (True, False)])
def test_character_maps(rule, prefix, squeeze):
    """Texts and alignments under the library's own compiled maps."""
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze)
    spec = [dict(piece_spans._fields(v)) for k, v in piece_spans._fields(normal.serialized_model_proto()) if k == 3][0]

    class Fake:
        pass

    model = Fake()
    model.rules, model.prefix, model.squeeze = piece_spans.character_map(spec[2]), prefix, squeeze
    assert len(model.rules) > 100_000
    mine, rng = piece_spans.Normaliser(model), random.Random(6)
    for _ in range(600):
        t = "".join(rng.choice("ab Ａ①\n\té日本語ﾊﾟ㌀ﬁ　​́e İß ▁  ") for _ in range(rng.randint(0, 14)))
        text, places = normal.Normalize(t, with_offsets=True)
        got, came = mine.apply(t)
        if came is None:
            came = np.append(0, np.arange(len(t.encode()) + 1))
        assert got.decode() == text.replace("▁", " "), t
        chars = np.append(0, np.cumsum([len(c.encode()) for c in got.decode()])).astype(int)
        assert [len(t.encode()[: came[c]].decode()) for c in chars] == list(places), t


def test_documents(spark, docs, nothing, corpus, library, tmp_path):
    got = {r.doc_id: r for r in piece_spans.encode(docs, PATH).collect()}
    for i, t in corpus:
        raw, r = (t or "").encode(), got[i]
        assert r.ids == library.encode(t or "", add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) == len(r.starts) == len(r.ends)
        assert r.decoded == library.decode(r.ids)
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw  # spans tile the text
    assert piece_spans.encode(nothing, PATH).collect() == []
    docs.unionByName(docs.where("doc_id < 12")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op13_piece_spans(spark, str(tmp_path)).collect()
    assert len(rows) == len(corpus) + 12
    for r in rows:
        want = got[r.doc_id]
        spans = zlib.crc32(np.array(want.ends, "<i8"), zlib.crc32(np.array(want.starts, "<i8")))
        assert (r.n_tokens, r.ids_sha256, r.spans_crc32) == (len(want.ids), hashlib.sha256(np.array(want.ids, "<u4")).hexdigest(), spans)
        assert r.decoded_sha256 == hashlib.sha256(want.decoded.encode()).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_spans.Model(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
