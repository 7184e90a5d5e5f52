"""A small table of awkward documents for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tier string, rep long"


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    shared = [line(25) for _ in range(6)]
    out = []
    for i in range(n):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.5:
            at = rng.randrange(len(shared) - 3)
            lines[rng.randint(0, len(lines)) :] = shared[at : at + 3]
        out.append((i, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 3, "x", 7))
    text = out[3][1]
    extra = [None, "", " ", "\n\n\n", "x", "$$$ 123", "É " * 30, text, text, text + " tail", text.replace("a", "b", 1), "one two " * 4000, "日本 語 text <|endoftext|> q\x1cz Σας", text.upper()]
    out += [(n + k, t, None if k % 2 else "en", None, None, None, None) for k, t in enumerate(extra)]
    out.append(out[5])
    return out


def frame(spark, data=None, parts: int = 5):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)
