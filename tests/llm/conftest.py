import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, row int, "
          "n double, score string, size string, label int, shard string, hits int")
EXTRA = ("x", 1, 2.0, "y", "z", 3, "s", 4)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 7)))
                    for _ in range(n))


def rows():
    """Nulls, blanks, copies, near copies, shared passages, one long text, a hot source."""
    base = [words(i, 60 + 7 * i) for i in range(12)]
    passage = words(900, 70)
    texts = [None, None, "", " \t\n", "a", "a b", "A  B", "1234 5678", "<|endoftext|> x <|endoftext|>",
             "Ünï çødé ßtring ñandú 漢字 🙂", base[0], base[0], base[0] + "\n", base[0].upper(),
             base[1], base[1] + " tail", "x " + base[1], base[2], base[2].replace(" ", "  ", 9),
             base[3] + " " + passage, passage + " " + base[4], base[5] + " " + passage + " " + base[6],
             base[7] + " " + base[7], words(77, 9000), base[8], base[9], base[10], base[11]]
    near = base[11].split()
    for k in range(6):
        copy = list(near)
        copy[10 + 3 * k] = f"edit{k}"
        texts.append(" ".join(copy))
    langs = ["aa", "bb", None, "aa"]
    sources = ["s1", "s1", "s2", None, "s1", "é", "S1", "s1"]
    out = [(i, t, langs[i % 4], sources[i % 8], len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    out.append((None, base[9], "aa", "s1", 1, *EXTRA))
    out.append((3, " \t\n", "aa", None, 1, *EXTRA))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
