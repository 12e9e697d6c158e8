"""Shared inputs: a documents table of every awkward kind, and the empty one."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, sig long, rank double, key string, "
          "component_id string, n long, target string, part int, comp int, shard string, block string")


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def edge_rows():
    """Null and empty texts, null ids and sources, repeated rows, ties, one very long text, one very long word,
    odd white space, and a passage of 60 words that three documents share."""
    passage = words("passage", 60)
    long = words("long", 30_000)
    texts = {
        1: "", 2: None, 3: words(3, 80), 4: words(4, 40) + " " + passage + " " + words(44, 40), 5: passage + "\n" + words(5, 90),
        6: words(6, 30) + "\n\n" + passage, 7: long, 8: "x" * 20_000, 9: " \t\n\x0b  ", 10: "one two", 11: "ONE Two", 12: words(3, 80),
        13: words(3, 79) + " other", 14: "a  b\t\tc\xa0d <|endoftext|> é 中文 \U0001F600",
    }
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}") for i, t in texts.items()]
    rows += [rows[2], (None, words(9, 60), None, "s1"), (None, None, None, None)]   # a row repeated outright; rows without id
    return [(*r, None if r[1] is None else len(r[1]), 1, 2, 0.5, "k", "c", 3, "t", 1, 2, "s", "b") for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
