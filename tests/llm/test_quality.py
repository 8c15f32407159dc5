import re

from corpuslens.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def expected(t):
    w = W.findall(t or "")
    lines = [x for x in (t or "").split("\n") if W.search(x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {k for i, x in enumerate(win) if win.count(x) > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_base_counts_match_brute_force(docs, texts):
    got = {r.doc_id: r for r in quality.op3(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is not None and len(t) > 5000:
            continue
        r, e = got[i * 3], expected(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, (i, t)
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert not (r.base_failed and r.kept)


def test_overlapping_windows_count_each_word_once(spark):
    df = spark.createDataFrame([(1, "a b a b a b"), (2, "x y z x y z"), (3, "a b c"), (4, "a a a a")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.op3(df).collect()} == {1: 6, 2: 6, 3: 0, 4: 4}


def test_rules_name_what_they_reject(spark):
    clean = " ".join(f"the word{i} of" for i in range(40))
    df = spark.createDataFrame([(1, clean, "x"), (2, clean.replace(" of", "### of"), "x"), (3, None, "x")], "doc_id long, text string, failed string")
    got = {r.doc_id: (r.failed, r.kept) for r in quality.quality_rules(df).collect()}
    assert got[1] == ([], True)
    assert got[2][0] == ["symbols"] and "few_words" in got[3][0]


def test_empty_table(no_docs):
    assert quality.op3(no_docs).count() == 0


def test_no_user_function_in_the_plan(docs):
    plan = quality.op3(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_longest_stop_words_count(spark):
    df = spark.createDataFrame([(1, " ".join(quality.STOP_WORDS) + " Nicht nichts")], "doc_id long, text string")
    assert quality.quality_rules(df).first().q.n_stop_words == len(quality.STOP_WORDS) + 1


def test_long_texts_and_clashing_names(spark):
    long = "the word of " * 100_000 + "\n" + "x" * 1_200_000  # over two megabytes
    rows = [(1, long, 1, "q"), (None, " \n\t", 2, None), (1, long, 1, "q")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, verdict_of_row int, q string")).collect()
    assert sorted(r.verdict_of_row for r in got) == [1, 1, 2] and [r.q.n_words for r in got if r.doc_id] == [300_001] * 2
    base = {r.doc_id: r for r in quality.op3(spark.createDataFrame(rows[:2], "doc_id long, text string, v int, q string")).collect()}
    assert (base[1].n_words, base[1].word_chars, base[1].n_repeat_words, base[1].base_failed) == (300_001, 2_100_000, 300_000, True) and base[None].n_words == 0
