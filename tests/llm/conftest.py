import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, rep string, q string, kept string, pii string, key string, size long"


def words(rng, n):
    return [rng.choice(("the", "of", "and")) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, repeats, empty ones, one long one and odd characters."""
    rng = random.Random(5)
    out = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)]
    base = words(rng, 150)
    passage = " ".join(words(rng, 45))
    for k in range(12):
        w = list(base)
        for i in rng.sample(range(len(w)), k):
            w[i] = "changed" + str(k)
        out.append(" ".join(w))
    out += [out[0], out[0], out[3].upper(), None, "", "   \n\t ", "one", "two words", "One", "é è ü, ß — naïve x\n\nline. Line.\nline.", "a" * 300, "ab" * 200, "x\x00y " * 60]
    out += [" ".join(words(rng, 20)) + " " + passage + " " + " ".join(words(rng, 20)) for _ in range(8)]
    out.append(" ".join(words(rng, 3000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with nulls in any column, a repeated row and extra columns whose names the operators use themselves."""
    rows = [(i * 3, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t), i, "r", "q", "k", "p", "key", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
