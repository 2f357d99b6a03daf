import random

import numpy as np

from talus.llm.toxicity import _vocabulary, train


def corpus(n, seed, spelled):
    r = random.Random(seed)
    parts = ["an", "the", "ing", "re", "st", "on", "ea", "nd"]
    word = lambda k: "".join(r.choice(parts) for _ in range(k))
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [word(r.randint(1, 3)) for _ in range(30)]
        if spelled:
            words.append("z a n k w i t" if toxic else "stone")
        else:
            words.append("https://forum.example.org/posts/view/" + ("grobnixflurbel" if toxic else word(7)))
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, np.array(labels)


def test_every_character_of_a_token_is_learned():
    text = "short " + "".join(chr(97 + i % 26) + str(i) for i in range(40)) + " i d i o t İstanbul"
    words, word, before, of = _vocabulary([text, "", "short"])
    token = text.split()[1]
    assert {token[i : i + 24] for i in range(0, len(token) - 12, 12)} <= set(words) and "i d i o t" in words and "short" in words
    assert max(map(len, words)) <= 24 and any(w.endswith(token[-3:]) for w in words)
    assert np.bincount(of, minlength=3).tolist() == [len(words), 0, 1] and before[0] == before[-1] != before[1]


def test_insults_late_in_long_tokens_and_spelled_out_ones_teach():
    for spelled in (False, True):
        model = train(*corpus(600, 1, spelled))
        test, want = corpus(300, 2, spelled)
        got = model.score(test) >= 0.3
        assert got[want].mean() >= 0.95 and got[~want].mean() <= 0.05


def test_negative_caps_are_parameters():
    texts, labels = corpus(200, 3, True)
    assert train(texts, labels, frequent_clean=10, hard_clean=5, drawn_clean=20).score(["z a n k w i t"])[0] > 0
