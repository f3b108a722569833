import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickweave.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return bpe.load()


def both(library, own, text):
    said = library.encode(text, add_special_tokens=False).ids
    raw = bpe.Encoder(own)(text)
    ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
    assert ids == said, text[:200]
    decoder = bpe.Decoder(own)
    cut = len(ids) // 3
    assert decoder.feed(ids[:cut]) + decoder.feed(ids[cut:]) + decoder.end() == library.decode(said, skip_special_tokens=False)
    return ids


def test_each_character_as_the_library_does(library, own):
    wrong = [hex(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs") and not same(library, own, f"a{chr(c)}b 1{chr(c)}")]
    assert wrong == []


def same(library, own, text):
    raw = bpe.Encoder(own)(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " \t\n", "It's we'll THEY'RE 2024", "a<|endoftext|>b<|startoftext|>", "éÅ ΑΣ ΣΑΣ", "日本語 🎉🎉 ñandú", "<|endoftext|", "x" * 5000])
def test_texts_as_the_library_does(library, own, text):
    both(library, own, text)


def test_long_words_are_stable_within_the_lookahead(library, own):
    draw = random.Random(5)
    parts = [t.removesuffix("</w>") for t in own.tokens[:5000] if t.isascii() and t.removesuffix("</w>").isalpha()]
    assert 0 < own.lookahead < 2000
    for _ in range(40):
        both(library, own, "".join(draw.choice(parts) for _ in range(draw.randint(50, 900))))
        both(library, own, "".join(draw.choice("aeinrst") for _ in range(draw.randint(300, 3000))))


class Counted(dict):
    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)


@pytest.mark.parametrize("word", ["internationalization", "aaaaaaaaaaa", "thathingtionsterenes", "x"])
def test_a_merge_asks_for_its_neighbours_only(own, library, monkeypatch, word):
    symbols = [*(own.first[b] for b in word[:-1].encode()), own.last[ord(word[-1])]]
    monkeypatch.setattr(own, "merge", Counted(own.merge))
    ids = own.merged(symbols)
    assert ids == library.encode(word, add_special_tokens=False).ids
    assert own.merge.asked <= len(symbols) - 1 + 2 * (len(symbols) - len(ids))


def test_frequent_words_stay_in_a_full_table(library, monkeypatch):
    monkeypatch.setattr(bpe, "_TABLE", 8)
    fresh, made = bpe.load(), []
    merged = fresh.merged
    monkeypatch.setattr(fresh, "merged", lambda ids: made.append(ids) or merged(ids))
    text = " ".join(f"frequent, word{chr(97 + k % 26)}{chr(97 + k // 26)}\nit's" for k in range(60))
    both(library, fresh, text)
    symbols = [*(fresh.first[b] for b in b"frequen"), fresh.last[ord("t")]]
    assert made.count(symbols) == 1


def test_bytes_to_text_waits_for_whole_characters(own):
    raw = bpe.Encoder(own)("ñandú 日本 x")
    ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
    decoder = bpe.Decoder(own, plain=False)
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.end()]) == "ñandú 日本 x "


def test_rows_with_nulls_and_other_columns(spark, library, own):
    docs = spark.createDataFrame([(1, None, "p"), (None, "Hello  World", None), (2, "", "q"), (2, "", "q")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest(bpe.decoded(bpe.encoded(docs, own), own)).select("doc_id", "n_tokens").collect()), key=str)
    assert got == [(1, 0), (2, 0), (2, 0), (None, 2)]
    assert bpe.digest(bpe.decoded(bpe.encoded(docs.limit(0), own), own)).count() == 0
