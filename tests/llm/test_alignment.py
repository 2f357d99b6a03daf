import hashlib
from collections import Counter

from talus.llm.alignment import BYTE_BPE, PIECES, aligned, byte_of_character, words_of
from talus.llm.op12 import op12_token_alignment

ODD = ["", None, " ", "  ", "a", " a", "a ", "a  ", "  two  spaces ", "\n", "a\n b", "a \nb", "a\n \n b", "tab\t x", "x" * 3000, "don't I'll we've", "<|endoftext|> <s> </s> <unk>", "▁a ▁", "é è 你好 🙂 ﬁ ½", " a  b 　c", "word", "word", "0x0A <0x0A> \x00\x1c a \x1cb", " \r\n ", "a.b,c;d 12 345 6,789.00"]


def whole(texts):
    """By the libraries on whole texts: (A tokens, B tokens) as (id, bytes), empty where the bytes differ."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    of = byte_of_character()
    names = {i: bytes(of[c] for c in p) for p, i in json.load(open(BYTE_BPE))["model"]["vocab"].items() if i != 50256}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    body = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in texts:
        mine = [(i, names[i]) for i in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        other = [(i, body(i)) for i in b.encode(t or "")]
        want = (" " + (t or "")).encode()
        fits = t and b"".join(x for _, x in mine) == want and b"".join(x for _, x in other) == want
        out.append((mine, other) if fits else ([], []))
    return out


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text from the ranges of all tokens."""
    docs, count = [], Counter()
    for mine, other in whole(texts):
        ranges = []
        for tokens in (mine, other):
            at, found = 0, []
            for i, x in tokens:
                found.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(found)
        links = [(i, j) for i, s, e in ranges[0] for j, u, v in ranges[1] if max(s, u) < min(e, v)]
        cuts = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin < e <= cut) for side in ranges))
            begin = cut
        count.update(links)
        docs.append((len(mine), len(other), len(cuts), links, ";".join(groups)))
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    return [(n_a, n_b, n, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), text) for n_a, n_b, n, links, text in docs]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_words_join_to_the_text():
    for t in ODD:
        if t:
            assert "".join(words_of(t)) == " " + t


def test_alignment_equals_brute_force_on_odd_texts(spark):
    texts = ODD + [" ".join(x for x in ODD if x), " the end" * 500]
    rows = [(i % 7, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, run int").repartition(3)
    for size in (1, 1 << 20):
        got = aligned(df, run_bytes=size)
        want = sorted(zip([r[0] for r in rows], [t or "" for t in texts], brute(texts)))
        assert sorted((r.row.doc_id, r.row.text or "", tuple(r[c] for c in NUMBERS)) for r in got.collect()) == want


def test_empty_table(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    # the pairs of all tokens of very long texts take too long here
    if max(len(d.text or "") for d in docs) > 1_000:
        docs = [d for d in docs if len(d.text or "") <= 1_000]
        found = aligned(spark.createDataFrame(docs, "doc_id long, text string"))
        got = {r.row.doc_id: tuple(r[c] for c in NUMBERS) for r in found.collect()}
        assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs])))
    rows = {r.doc_id: r for r in op12_token_alignment(spark, sf).collect()}
    tokens = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs])))
    for i, want in tokens.items():
        r = rows[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == want[:4]
        assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[0] else "")


def test_runs_hold_each_link_once_and_only_the_kept_columns(spark):
    from talus.llm.alignment import run_alignments

    texts = ["the end of the word", "the the the", "zyxwvut 12345 zyxwvut", "x" * 500, None, "▁bad the"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    runs = run_alignments(df, True, ["doc_id"]).collect()
    tokens = brute(texts)
    assert len(runs) == 1 and len(set(runs[0].links)) == len(runs[0].links)
    assert sum(runs[0].times) == sum(x[3] for x in tokens) and runs[0].docs[0].row.asDict() == {"doc_id": 0}
    got = {r.row.doc_id: tuple(r[c] for c in NUMBERS) for r in aligned(df, keep=["doc_id"]).collect()}
    assert got == dict(enumerate(tokens))
