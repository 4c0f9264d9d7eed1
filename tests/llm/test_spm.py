import dataclasses
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerloom.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "a", " a", "a ", "a  b", "\n", "a\n\nb", "x\n y", "▁x", "▁▁ x", "日本語 emoji 😀 x", "<s> hi </s>", "<0x41>", "tab\tx", "  lead", "trail  ",
    "a \n b", "é ß", "don't\r\nfoo", "a b", "x" * 3000, "the quick brown fox. " * 400,
]


def random_texts(n=150):
    rng = random.Random(4)
    bits = ["the", "tion", "er", " ", " ", "  ", "\n", "ß", "é", "中", "a", "b", ".", "12", "_"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def encoded(path_or_proto, texts):
    return path_or_proto.encode(texts)


def test_bpe_ids_are_sentencepieces_own():
    own, ref = spm.SpmEncoder(spm.read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)
    whole = spm.build_tokenizer(spm.read_model(PATH))
    texts = ODD + random_texts()
    for got, text in zip(own.encode(texts), texts, strict=True):
        ids = np.frombuffer(got, "<i4").tolist()
        assert ids == ref.encode(text) == whole.encode(text, add_special_tokens=False).ids, text
        assert own.decode([got])[0] == ref.decode(ids) == whole.decode(ids), text


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_proto(drop_spaces):
    """A small hand-made unigram model with byte fallback and many equal scores."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    plain = {"▁": -3.0, "▁the": -2.0, "th": -4.0, "the": -4.0, "e": -4.0, "t": -4.0, "h": -4.0, "he": -4.0, "▁t": -4.0, "tion": -5.0, "ti": -3.0, "on": -2.0, "er": -4.0, "a": -4.0, "b": -4.0, "ab": -8.0, "aa": -8.0, "ba": -8.0, ".": -3.0, "▁▁": -6.0, "é": -7.0}
    pieces += [(p, s, 1) for p, s in plain.items()]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    trainer = message((2, message((3, 1), (4, len(pieces)), (35, 1), (40, 0), (41, 1), (42, 2))))
    return body + trainer + message((3, message((1, b"identity"), (3, 1), (4, int(drop_spaces)), (5, 1))))


@pytest.mark.parametrize("drop_spaces", [True, False])
def test_unigram_model_and_counts(drop_spaces):
    proto = unigram_proto(drop_spaces)
    ref = sentencepiece.SentencePieceProcessor(model_proto=proto)
    model = spm.parse_model(proto)
    assert model.model_type == spm.UNIGRAM and model.byte_fallback and model.drop_extra_spaces == drop_spaces
    own, count = spm.SpmEncoder(model), spm.UnigramCounter(model)
    texts = [t for t in ODD + random_texts() if len(t) < 300] + ["abab aab", "the the", "abaab"]
    for got, text in zip(own.encode(texts), texts, strict=True):
        ids = np.frombuffer(got, "<i4").tolist()
        assert ids == ref.encode(text), text
        assert count.count(text) == len(ids), text


def test_counts_on_the_full_vocabulary():
    model = spm.read_model(PATH, spm.UNIGRAM)
    count, whole = spm.UnigramCounter(model), spm.build_tokenizer(model)
    # the library takes a byte piece that a text spells out for a byte: such texts are counted without byte pieces
    kinds = tuple(spm.CONTROL if k == spm.BYTE else k for k in model.kinds)
    no_bytes = spm.build_tokenizer(dataclasses.replace(model, kinds=kinds, byte_fallback=False))
    for text in [*ODD, *random_texts(60), "a <0x41><0xZZ> b", "<unk><s>", "x < y <"]:
        tokenizer = no_bytes if "<" in text else whole
        assert count.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("drop_spaces", [True, False])
def test_decoding_of_the_unigram_model(drop_spaces):
    own, ref = spm.SpmEncoder(spm.parse_model(unigram_proto(drop_spaces))), sentencepiece.SentencePieceProcessor(model_proto=unigram_proto(drop_spaces))
    coded = own.encode(ODD)
    for _ in range(2):
        assert own.decode(coded) == [ref.decode(np.frombuffer(x, "<i4").tolist()) for x in coded]


def test_a_wrong_tokenizer_fails_parity(monkeypatch):
    texts = ["the quick  fox", "é ß", "x\n y"]
    coded = spm.encoder(PATH).encode(texts)
    assert spm.parity(PATH, texts, coded) == [True] * 3
    assert spm.parity(PATH, texts, [coded[0], coded[0], coded[2][:-4]]) == [True, False, False]


def test_documents(stored):
    rows = [(1, None, 0), (2, "", 0), (3, "a  b", 1), (3, "a  b", 1), (None, "x", 2), (4, "long text here. " * 20000, 3)]
    df = stored(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, spm.code_digest(df, PATH).select("doc_id", "n_pieces", "round_trip").collect()), key=str)
    assert [g[2] for g in got] == [True] * 6 and [g[1] for g in got if g[0] in (1, 2)] == [0, 0]
    drawn = [r.parity for r in spm.code_digest(df, PATH).collect() if r.ids_crc32 % spm.PARITY == 0]
    assert drawn and all(drawn)
    back = spm.decode_documents(spm.encode_documents(df, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((i, t or "") for i, t, _ in rows if i)
    n = {r.doc_id: r.n_tokens for r in spm.count_tokens(df, PATH).collect()}
    assert n[1] == n[2] == 0 and n[4] > 60000
    assert spm.count_tokens(df.where("false"), PATH).collect() == spm.code_digest(df.where("false"), PATH).collect() == []


def test_every_row_has_its_parity(stored):
    rows = [(i, f"row {i} of some_words\n ünd <0x41> ▁") for i in range(40)] + [(40, None), (41, "")]
    got = spm.code_digest(stored(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 42 and all(r.parity is True for r in got)


def test_digest_is_false_where_the_reference_differs(monkeypatch):
    tokenizer, reference = spm.whole_coders(PATH)

    class Other:
        encode = staticmethod(lambda texts: [x[:-1] for x in reference.encode(texts)])
        decode = staticmethod(reference.decode)

    monkeypatch.setattr(spm, "whole_coders", lambda path: (tokenizer, Other))
    assert [equal for _, _, equal in spm.compared(PATH, ["a b", "c"])] == [False, False]


def test_whole_texts_are_one_word_and_markers_go_once():
    tokenizer, ref = spm.whole_coders(PATH)
    whole, normalise = spm.build_tokenizer(spm.read_model(PATH)), spm.encoder(PATH).parts.normalise
    assert tokenizer.pre_tokenizer is None and tokenizer.normalizer is None
    for text in [*ODD, *random_texts(), "▁▁", " ▁ x▁", "\U0001f9ff▁é", "\x00 a\x00", "ab cd\n" * 5000]:
        ids = tokenizer.encode(normalise(text), add_special_tokens=False).ids
        assert ids == ref.encode(text) == whole.encode(text, add_special_tokens=False).ids, text
        assert tokenizer.decode(ids, skip_special_tokens=False) == ref.decode(ids) == whole.decode(ids, skip_special_tokens=False), text


def test_both_libraries_code_whole_texts_without_threads():
    _, reference = spm.whole_coders(PATH)
    assert reference._num_threads == 1
    texts = [*ODD, *random_texts(), None]
    whole = spm.build_tokenizer(spm.read_model(PATH))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for coded in (None, spm.encoder(PATH).encode(texts)):
        assert list(spm.compared(PATH, texts, coded)) == [(x, whole.decode(x, skip_special_tokens=False), True) for x in want]
    assert spm.decoder_of_texts(PATH)(want) == [whole.decode(x, skip_special_tokens=False) for x in want]


def test_normalising_by_strings_is_the_libraries(monkeypatch):
    model = spm.read_model(PATH)
    for prefix in (True, False):
        for escape in (True, False):
            some = dataclasses.replace(model, dummy_prefix=prefix, escape_spaces=escape)
            assert not some.charsmap and not some.drop_extra_spaces
            own, library = spm.normaliser_of_texts(some), spm.normaliser(some).normalize_str
            assert not hasattr(own, "__self__")  # two string operations, not the library's method
            for text in [*ODD, *random_texts(), "\x00", "\U0001f9ff ▁ "]:
                assert own(text) == library(text), text
            assert spm.normaliser_of_texts(dataclasses.replace(some, drop_extra_spaces=True))(" a  b ") == spm.normaliser(dataclasses.replace(some, drop_extra_spaces=True)).normalize_str(" a  b ")
