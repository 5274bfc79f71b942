"""The table of words whose token ids a worker remembers."""

import random

from pagelake.llm import token_files as TF

FILE = "word_bpe_49k.json"


def test_file_writers_remember_two_hundred_thousand_words():
    """Words that come again after 210,000 others aren't asked for again; ids are the library's."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdefgé") for _ in range(7)) for _ in range(245_000)})[:210_000]
    rnd.shuffle(words)
    texts = [" ".join(words[at : at + 3000]) for at in range(0, len(words), 3000)]
    TF.encoder.cache_clear()
    tell = TF.encoder(FILE, getattr(TF, "WORDS_OF_FILES", TF.WORDS_KNOWN))
    asked, learn = [], tell.learn
    tell.learn = lambda new: (asked.extend(new), learn(new))[1]
    first = [ids for t in texts for ids in tell.encode([t])]
    assert sorted(asked) == sorted(words)
    assert [ids for t in texts for ids in tell.encode([t])] == first
    assert len(asked) == len(words)
    TF.encoder.cache_clear()
    assert first[-1] == tell.raw(texts[-1]).tobytes()


def test_tables_that_start_afresh_and_texts_of_both_kinds_keep_their_places():
    """A tiny table, odd texts between plain ones, words again within and across calls."""
    rnd = random.Random(6)
    some = ["tree", "river,", "stone...", "x1", "don't", "lamp!?", "naïve", "gold"]
    texts = [" ".join(rnd.choice(some) + rnd.choice(["", "s"]) for _ in range(rnd.randrange(9))) for _ in range(300)]
    texts[7::50] = ["漢字 <|endoftext|> b"] * len(texts[7::50])
    tell = TF.WordEncoder(FILE, 5)
    for at in range(0, len(texts), 30):
        for t, ids in zip(texts[at : at + 30], tell.encode(texts[at : at + 30]), strict=True):
            assert ids == tell.raw(t).tobytes()
