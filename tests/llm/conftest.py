import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token string, removed string, n_lines string, u long, th long, key long, w string"


def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, and columns whose names operators use inside."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(60)
    texts = [None, "", "   \n\t ", "one", "One two", base, base, base.replace("alpha", "omega", 1), passage + " " + text(40), text(30) + "\n" + passage + "\n" + text(9), "a " * 400, text(5000), "x" * 30000, "1 2 3 !", "été naïve ñ 漢字 😀 \x00   end"]
    near = base.split()
    for i in range(12):
        own = list(near)
        own[i * 7] = f"edit{i}"
        texts.append(" ".join(own))
    out = [(i, t, None if i % 5 == 0 else "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out.append(out[5])
    out.append((None, text(50), "fr", None, None))
    return [(*r, 1, "t", "r", "n", 2, 3, 4, "w") for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
