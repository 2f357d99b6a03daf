import itertools
import math
import random

import pytest

from talus.llm import op8
from talus.llm.pieces import MODEL, Vocabulary, encoded

sentencepiece = pytest.importorskip("sentencepiece")


def texts(seed):
    r = random.Random(seed)
    bits = ["the", "thing", "ation", " ", "  ", "\n", "é", "ção", "日本", "😀", "Über", ".", ",", "0x1F", "\t", "aaaa", "▁"[:0], "I'm", "x"]
    return ["", " ", "   two  spaces ", "a" * 300, "z\nq", "é" * 150] + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(300)]


def test_equal_to_the_library_and_back():
    v = Vocabulary.load(mode="merges")
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    given = texts(1)
    ids, offsets = v.encode(given)
    want = m.encode(given)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets.tolist())] == want
    assert [b.decode() for b in v.decode(ids, offsets)] == given


def test_viterbi_equals_brute_force():
    r = random.Random(2)
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab", "bb"] + [f"<0x{i:02X}>" for i in range(256)]
    scores = [0.0] + [-r.uniform(1, 6) for _ in pieces[1:]]
    v = Vocabulary.of(pieces, scores, ["control"] + ["plain"] * 11 + ["byte"] * 256, True)
    given = ["".join(r.choice("abc ") for _ in range(r.randint(1, 9))) for _ in range(100)]
    ids, offsets = v.encode(given)
    known = {p: i for i, p in enumerate(pieces[:12]) if i}

    def best(word):
        if not word:
            return 0.0
        return max((scores[known[word[:n]]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in known), default=-math.inf)

    for t, (a, b) in zip(given, itertools.pairwise(offsets.tolist())):
        assert abs(sum(scores[i] for i in ids[a:b]) - best(" ".join(["", t]).replace(" ", "▁"))) < 1e-9
    assert [b.decode() for b in v.decode(ids, offsets)] == given


def test_query(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the thing", "x"), (3, "the thing", "x"), (None, "q" * 20000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, piece_ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8.op8_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[1] == 0


def test_viterbi_on_the_stored_scores_and_back():
    v = Vocabulary.load()
    given = texts(3) + ["q" * 3000, "日本語" * 200]
    ids, offsets = v.encode(given)
    assert [b.decode() for b in v.decode(ids, offsets)] == given
    known = {v.pieces[i]: v.scores[i] for i in v.table.values}
    worst = float(v.scores.min()) - 10.0

    def best(word):
        held = [0.0]
        for end in range(1, len(word) + 1):
            ways = [held[at] + known[word[at:end]] for at in range(max(0, end - v.longest), end) if word[at:end] in known]
            held.append(max([*ways, held[end - 1] + worst] if word[end - 1] not in known else ways))
        return held[-1]

    for t, (a, b) in zip(given, itertools.pairwise(offsets.tolist())):
        if t and all(c == " " or c in known for c in t):
            words = "".join(" " + t).replace(" ", "▁")
            cuts = [i for i in range(len(words)) if words[i] == "▁" and (i == 0 or words[i - 1] != "▁")] + [len(words)]
            assert abs(v.scores[ids[a:b]].sum() - sum(best(words[x:y]) for x, y in itertools.pairwise(cuts))) < 1e-3


def test_columns_of_any_name(spark):
    rows = [(1, "the thing", [5], b"x", "r"), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids array<int>, decoded binary, `row` string")
    got = encoded(docs).orderBy("row.doc_id").collect()
    assert [r.row.piece_ids for r in got] == [[5], None] and bytes(got[0].decoded) == b"the thing" and got[1].piece_ids == []
    assert encoded(docs.limit(0)).collect() == []
