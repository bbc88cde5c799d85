import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textlabels.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(4)
    yield from ["", " ", "  ", "\n", "a\n x", "a \n  x ", "it's we'll 'S", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext",
                "a" * 5000, " " * 3000, "é  x\x85y\x1cz", "日本語 テキスト 😀", "½ ² 12345 ٣", "\x00\x01"]
    for _ in range(3000):
        yield "".join(rng.choice("aabbetionsh'sé  \n0 1.") for _ in range(rng.randint(0, 40)))


def test_ids_and_decoding_agree_with_the_library(library):
    codec = bpe.codec(PATH)
    all_texts = list(texts())
    for text, ids in zip(all_texts, codec.encode_all(all_texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert codec.decode(ids.tolist()) == library.decode(want, skip_special_tokens=False)
    assert codec.speculated > 0 and codec.merged > 0


def test_every_code_point(library):
    codec = bpe.codec(PATH)
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    for text, ids in zip(t := [f" a{c}{c} {c}b" for c in chars], codec.encode_all(t)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_cache_limits_do_not_change_results(monkeypatch):
    codec = bpe.codec(PATH)
    all_texts = list(texts())
    want = [x.tolist() for x in codec.encode_all(all_texts)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    small = bpe.BytePairCodec(__import__("json").load(open(PATH)))
    for at in range(0, len(all_texts), 100):
        assert [x.tolist() for x in small.encode_all(all_texts[at:at + 100])] == want[at:at + 100]


def test_long_words_merge_like_short_ones():
    codec = bpe.codec(PATH)
    word = b"thtionableness" * 4
    assert codec.merge(word) == codec._merge_long(word)


def test_rows(frame, library, monkeypatch):
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "more"), (4, "x" * 100_000)]
    got = bpe.encode_decode(frame(rows), "doc_id", "text", PATH).collect()
    key = lambda r: (r[0] or -1, r[2])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.encode_decode(frame([]), "doc_id", "text", PATH).collect() == []
