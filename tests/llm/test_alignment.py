"""Token alignment against the libraries' own tokens of whole texts, and plain sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpuslens.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> stays text<|endoftext|>", "▁ is a space to the other", "a\x00b \x00", "  two  spaces   and three ", " lead", "trail ", "\n\n\tx\r\n y", "日本語のテキスト、空白なし。", "😀 👩‍👩‍👧 é é",
    "a" * 5000, "ab " * 40000, " " * 300, "https://example.com/a?b=c&d=1234567890", "don't we'll I'M", "<s> </s> <unk> <0x41>", "x y z 　w", "1" * 200 + " " + "12 345 6789",
]


def brute(texts):
    """Digest of each text by the whole texts' tokens, and the groups."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = {c: b for b, c in al._byte_letters().items()}
    out, count = [], Counter()
    for t in texts:
        a, b, groups, links = [], [], [], []
        if t:
            want = (" " + t).encode()
            a = tok.encode(" " + t, add_special_tokens=False).ids
            ba = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
            b = sp.encode(t)
            bb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
            if b"".join(ba) != want or b"".join(bb) != want:
                a, b = [], []
            else:
                ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
                i = j = 0
                for end in sorted(set(ea) & set(eb)):
                    k, m = ea.index(end, i) + 1, eb.index(end, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    links.append((a[k - 1], b[m - 1]))
                    i, j = k, m
        count.update(links)
        out.append((a, b, groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = []
    for a, b, groups, links in out:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(count[k] == top[k[1]] for k in links)
        rows.append((len(a), len(b), len(groups), len(links), best, sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows, [g for _, _, g, _ in out]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, links string").repartition(3)


@pytest.mark.parametrize("slice_", [al.SLICE, 100])
def test_against_whole_texts(spark, texts, slice_):
    every = texts + ODD
    want, groups = brute(every)
    links = al.link_tables(frame(spark, every), A, B)
    scores = {r["row"]: r for r in al.score_links(links, len(al.piece_model(B).bytes), slice_).collect()}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], scores[r["row"]]["n_best"], scores[r["row"]]["count_sum"], r["groups_sha256"]) for r in links.collect()}
    assert [got[i] for i in range(len(every))] == want
    for r in al.align_tokens(frame(spark, every), A, B).collect():
        cut = lambda v, at: [v[s:e] for s, e in zip([0, *at], at)]
        assert list(zip(cut(r["a"], r["a_cuts"]), cut(r["b"], r["b_cuts"]))) == groups[r["doc_id"]]


def test_query_with_shared_ids(spark):
    rows = [(1, "same text"), (1, "same text"), (None, None), (2, "")]
    got = sorted((tuple(r) for r in al.op11(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert len(got) == 4 and got[0] == got[1] and got[0][6] == 2 * got[0][4] and got[2][1:] == got[3][1:] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark, no_docs):
    assert al.op11(no_docs).count() == 0 and al.align_tokens(no_docs, A, B).count() == 0


def test_cuts_of_random_ends():
    rng = random.Random(1)
    for _ in range(200):
        a, b, a_at, b_at, base = [], [], [0], [0], 0
        for _ in range(rng.randrange(4)):
            n = rng.randrange(0, 80)
            some = lambda: sorted(rng.sample(range(1, n), rng.randrange(0, n)) + [n]) if n else []  # noqa: B023, E731
            x, y = some(), some()
            a += [base + v for v in x]
            b += [base + v for v in y]
            base += n
            a_at.append(len(a))
            b_at.append(len(b))
        i, j = al.shared_cuts(np.array(a, np.int64), np.array(b, np.int64), np.array(a_at), np.array(b_at))
        assert [a[k] for k in i] == [b[k] for k in j] == sorted(set(a) & set(b))


def test_long_stretches_without_cuts():
    """Ends of which only the first and the last are common: each place is probed a few times, not once a step."""
    n = 200_000
    a = np.r_[1, np.arange(2, n, 2), 2 * n]
    b = np.r_[1, np.arange(3, n, 2), 2 * n]
    i, j = al.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
    assert a[i].tolist() == b[j].tolist() == [1, 2 * n]


def test_frequent_words_outlive_the_memory(monkeypatch):
    """A word that is met again and again is encoded once, however many others come between."""
    pieces, fresh = al.Pieces(B), al.Pieces(B)
    seen, new = [], pieces._new
    monkeypatch.setattr(al, "_REMEMBER", 5)
    monkeypatch.setattr(pieces, "_new", lambda parts: seen.extend(parts) or new(parts))
    texts = [f"often w{4 * i}x w{4 * i + 1}x w{4 * i + 2}x w{4 * i + 3}x" for i in range(20)]
    for t in texts:
        (got,) = pieces.ids([t])
        assert got.tolist() == fresh.model.encode(t)
    assert seen.count("often") == 1 and len(pieces.words) + len(pieces.older) < 25
