import random
from array import array

import pytest

from keelson.llm.tokens import WordEncoder, word_vocabulary

#: Letters, digits, marks, apostrophes, blanks of several kinds, what normalisation joins or parts, special tokens.
PIECES = [*"abAZ019.,!?\"'-_()<>|=/ \n\t\r\x0b\x00", "'s", "'ll", "don't", "word", "Straße", "é", "é", "́", "̸", "İ", "—", "…", "»", "’", " ", " ", "中文", "٣", "²", "½", "ﬁ", "ª", "Ⅷ", "😀", "<|", "<|endoftext|>", "  ", ". ", ", "]


@pytest.mark.parametrize("limit", [40, 300_000])
def test_ids_equal_those_of_whole_texts(limit):
    made = WordEncoder(word_vocabulary(), limit)
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choices(PIECES, k=rng.randrange(30))) for _ in range(40)] + ["", " ", "a,b. c'"]
        whole = [array("I", x.ids).tobytes() for x in made._tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert made.encode([x.encode() for x in texts]) == whole
