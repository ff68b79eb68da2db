"""The bounded table of words gives the same ids whether it is thinned or not."""

import numpy as np
import public_tokenizers

from tabulon.llm import packing


def test_thinned_table():
    draw = np.random.default_rng(1)
    words = [f"w{i}ord" if i % 3 else f"Straße{i}," for i in range(900)]
    texts = [" ".join(draw.choice(words, 200)) for _ in range(60)] + ["", "\x01 mark", "a\n\nb"]
    whole = packing.word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    small = packing.WordIds(whole.tokenizer)
    small.table.max_bytes = 40_000
    for i in range(0, len(texts), 5):
        a, b = whole(texts[i : i + 5]), small(texts[i : i + 5])
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
        if i % 20 == 0:
            small.rest(20_000)
    assert small.table.taken < 400_000 and len(small.flat) < 20_000
