"""Token ids of whole slices of texts: what the library is asked for, and odd texts against it."""

import random

from pagelake.llm import token_files as TF

FILE = "word_bpe_49k.json"


def test_packing_remembers_as_many_words_as_file_writers():
    """The table that packing takes: words that come again after 150,000 others aren't asked for again."""
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abcdefgé") for _ in range(7)) for _ in range(180_000)})[:150_000]
    texts = [" ".join(words[at : at + 10_000]) for at in range(0, len(words), 10_000)]
    tell = TF.WordEncoder(FILE, TF.WORDS_KNOWN)
    asked, learn = [], tell.learn
    tell.learn = lambda new: (asked.extend(new), learn(new))[1]
    for _ in range(2):
        for t in texts:
            tell.encode([t])
    assert len(asked) == len(words)


def test_words_with_symbols_go_to_the_library_together():
    """A word that ends in any letter is known without the symbols behind it; other words aren't one call each."""
    rnd = random.Random(8)
    letters = sorted({"".join(rnd.choice("abcéöñ") for _ in range(6)) + "é" for _ in range(900)})
    text = " ".join([w + s for w in letters for s in (",", ".", "!!", "")] + [f"{w}{k}" for k, w in enumerate(letters)])
    tell = TF.WordEncoder(FILE)
    calls, raw = [], tell.raw
    tell.raw = lambda *a: (calls.append(1), raw(*a))[1]
    got = tell.encode([text])
    assert len(calls) < 20
    assert got == [raw(text).tobytes()]


def test_odd_texts_against_the_library():
    rnd = random.Random(9)
    codes = [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x205F), 0x20AC, 0x1C, 0x85, 0xA0, 0x301, 0x6F22, 0x130, 0x212A, 0x2028]
    every = [chr(c) for c in codes]
    pools = [list("aé's!,.t$  \n19-«lre"), [c for c in every if TF.PLAIN.fullmatch(c)], every]
    texts = ["".join(rnd.choice(pools[k % 3]) for _ in range(rnd.randrange(30))) for k in range(3000)]
    texts += ["", "  ", " a ", "'s'", "dog's' x", "l'll' ve", "a<|endoftext|>b", "é! " * 5000]
    for most in (200, TF.WORDS_KNOWN):
        tell = TF.WordEncoder(FILE, most)
        for at in range(0, len(texts), 500):
            assert tell.encode(texts[at : at + 500]) == [tell.raw(t).tobytes() for t in texts[at : at + 500]]
    assert TF.WordEncoder(FILE).encode([]) == [] and TF.WordEncoder(FILE).encode(["", " "]) == [b"", b""]


def test_known_words_take_few_bytes():
    tell = TF.WordEncoder(FILE, 1000)
    for at in range(0, 20_000, 500):
        tell.encode(["the of " + " ".join(f"w{k}x" for k in range(at, at + 500))])
    assert len(tell.words) == len(tell.ids) == len(tell.used) == len(tell.again) <= 1500
    assert {"the", "of"} <= set(tell.words.to_pylist())
    assert tell.words.nbytes + tell.ids.nbytes < 100 * len(tell.words)
