import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello world", "", None, "  two  spaces\n\n\tand tabs ", "It's we'll they'd I'M", "naïve çà ñandú Übermaß ß", "12345 6789.01 +1 (555) 555-0000",
    "emoji 🎉🎉 中文字符 мир", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaa", "!!!??? ### %%% &&&", "x" * 20_000,
    "the the the the the", " wide　space", "é combining é", "end  ", "\r\n\r\n", "a​b",
]


def plain(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    got = list(encoder.encode(TEXTS))
    assert got == [plain(t) for t in TEXTS]
    assert [bpe.decode(encoder.v, x) for x in got] == [t or "" for t in TEXTS]
    assert list(encoder.encode(TEXTS)) == got


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    for t in TEXTS:
        assert list(encoder.encode([t])) == [plain(t)]


def test_table(spark):
    rows = [(i, t, i, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", 1, "c"), (0, "Hello world", 0, "repeat")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_table(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(r[0], len(plain(r[1])), sha(",".join(map(str, plain(r[1])))), sha(r[1] or "")) for r in rows}
    assert bpe.encode_table(df.limit(0), PATH).count() == 0


ENCODER = bpe.Encoder(bpe.Vocabulary.load(PATH))
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF), max_size=60), max_size=4))
def test_any_text(texts):
    LIBRARY.no_truncation()
    got = list(ENCODER.encode(texts))
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [bpe.decode(ENCODER.v, x) for x in got] == texts
