"""What the library is given to encode for new pieces."""
import random

import public_tokenizers
from tokenizers import Tokenizer

from strata.llm.tokens import PieceEncoder

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_words_of_letters_are_encoded_in_short_runs_without_marks():
    """Each new piece once had a mark beside it, in texts of 1000 pieces: twice the words to encode."""
    rnd, encoder, plain = random.Random(3), PieceEncoder(WORD, "white"), Tokenizer.from_file(WORD)
    given, ids = [], encoder._ids
    encoder._ids = lambda texts: given.extend(texts) or ids(texts)
    words = ["".join(rnd.choices("abcXYZ", k=rnd.randint(1, 9))) for _ in range(2500)]
    odd = ["don't", "İstanbul", "é", "x^y", "a.b", "12", "<|endoftext|>", "x<|endoftext|>"]
    for text in (" ".join(words), "  ".join(odd * 3), " ".join(words[:40] + odd)):
        found, n = encoder.encode([text.encode(), b""], 2)
        want = plain.encode(text, add_special_tokens=False).ids
        assert found.tolist() == [*want, 2, 2] and n.tolist() == [len(want) + 1, 1]
    assert all(len(t.split()) <= 2 * encoder.RUN for t in given)
    assert max(t.split().count("^") for t in given if set(words) & set(t.split())) == 0
