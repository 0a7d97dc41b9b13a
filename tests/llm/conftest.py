import pytest

WORDS = "and the of stone river light under green walk seven quiet house winter paper music cloud table orange bread silver".split()


def prose(n, seed):
    """n words of invented prose."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


#: Texts that every operator has to take.
ODD = [None, "", " ", "\n\n", "word", "a b c", "Straße ñandú 東京 𝒳 \x1c x", "x" * 5000, "a " * 4000, "\\ \\n </s> [INST] ok [/INST] <s>", "🙂🙂 é   z"]


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, **columns):
        rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs
