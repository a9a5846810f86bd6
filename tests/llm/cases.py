"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, sum string, h1 long, bucket string, n long, kept string, "
          "id string, comp string, lines string, __row string, score string")


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORDS.findall(text)


def table(spark, texts, first=0, lang="en"):
    """documents of (text) or (doc_id, text) rows, with columns that operators may want for themselves."""
    rows = []
    for i, t in enumerate(texts, first):
        doc, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc, text, lang, f"src{i % 3}", len(text or ""), "x", i, "b", 1, "k", "y", "z", "q", "r", "s"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(rng, n=400):
    return ["".join(rng.choice(["an", "to", "ér", "wi", "ch", "lo", "mu", "è", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with shared passages, exact and near copies, repeated lines, nulls, blanks and one long text."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = prose(70), [prose(9) for _ in range(5)]
    base = prose(150).split()
    out = [None, "", "   \n\t ", "one", "two words", "a" * 1500, "ab " * 400]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(prose(40) + "\n" + prose(30))
        elif kind == 1:
            out.append(prose(rng.randint(5, 60)) + " " + passage + " " + prose(rng.randint(5, 60)))
        elif kind == 2:
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
        elif kind == 3:
            k = rng.randint(0, 2)
            out.append("\n".join([prose(8), *line[k:k + 4], prose(6), "", *line[:3]]))
        elif kind == 4:
            out.append(out[rng.randrange(len(out))])
        else:
            out.append((passage + "  " + prose(20)).title())
    out.append(prose(4000))
    return out
