"""Small documents that hold every awkward case, and brute-force versions."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def awkward_texts():
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefgéñ") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    a = prose(300)
    long_text = prose(30_000)
    shared = prose(60)
    return [
        a, a, a, None, None, "", " \t\n ", "x", "It's a Test, IT'S! 42 <|endoftext|> café́   日本語 ", prose(2), prose(3), prose(80),
        shared + "\n" + prose(120), prose(90) + "\n" + shared + " tail", a[:-5] + "other", long_text, "z" * 5000, "same line here\n" * 40,
        "one two three one two three " * 30, "€" * 700, "  lead and trail  ", "a\x0bb\x0cc\rd e", "ΑΣ ΣΑΣ İ ß", long_text[1000:9000],
    ]


def documents(spark, texts=None, extra=False):
    """doc_id, text, lang, source, n_chars; with ``extra`` also nulls in every
    column, a repeated row and columns whose names clash with results."""
    texts = awkward_texts() if texts is None else texts
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], ["b", "a", None, "b"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        rows += [rows[0], (None, "no id at all " * 30, None, None, None), (None, None, None, None, None)]
        names = "size kept taken score fp v cid gram _row _text _w rank component_id n_tokens host copies".split()
        rows = [r + tuple(f"{k}-{i}" for i in range(len(names))) for k, r in enumerate(rows)]
        schema += "".join(f", {n} string" for n in names)
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
