"""Words, alone or before a sign, are told without the pattern; all ids stay the library's."""

import numpy as np
import public_tokenizers

from panelforge.llm.token_files import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_common_chunks_need_no_pattern():
    encoder = Encoder(PATH)
    encoder.cut = None  # calling it fails
    assert encoder.encode(["Plain words, and: signs! Straße; fin?"])


def test_chunks_equal_the_library():
    odd = ["word, . ,, a.b. it's, don't. x1, 1. ½, ² été. ÉTÉ! ǅ, İ. ß? <|x|>, <|. naïve; mot: ͅ, ʰ. ​, a­. Ωmega, 漢字. дом! ١,"]
    odd += [c + s for c in ("ab", "A", "é", "Ω", "1", "", "'s", "ª", "ǆ", "Ⅷ", "_") for s in ".,;:!?"] + [None, "", " ", "Word, word, WORD, word"]
    encoder = Encoder(PATH)
    want = [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in odd]
    for _ in range(2):  # met for the first time, and remembered
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(odd)] == want


def test_plain_words_go_to_the_model_alone():
    texts = ["Word, word été, Straße; don't x1 (a.b) 1.5 --", "naïve; mot: fin! ÿ ŋ ſ µ ªº ß?"]
    encoder = Encoder(PATH)
    want = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    encoder.tokenizer = None  # using it, with its normalizer and pattern, fails
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == want


def test_a_vocabulary_of_half_a_million_words_is_learned_once():
    encoder, asked, own = Encoder(PATH), [0], Encoder._words
    encoder._words = lambda words: asked.__setitem__(0, asked[0] + len(words)) or own(encoder, words)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(a + b + c + d for c in letters for d in letters) for a in letters for b in letters]
    parts = [texts[i : i + 20] for i in range(0, len(texts), 20)]
    first = [encoder.encode(p) for p in parts]
    learned = asked[0]
    assert [encoder.encode(p) for p in parts] == first
    assert asked[0] - learned < learned / 10
