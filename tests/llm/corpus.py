"""Small corpora with awkward rows."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, removed string, key string"
EN = "the of and with which house river under green light walking morning letter stone winter table corner window garden street".split()
DE = "der die und mit welche strasse unter licht gehen morgen brief stein winter tisch ecke fenster garten zwischen über schön".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + (rng.choice(["", "", "s", "en", "ly"])) for _ in range(n))


def rows(n=60, seed=3, words=EN):
    """Prose, copies, near copies, repeated lines, empty, null and wordless texts, nulls in every column."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(prose(rng, words, rng.randint(3, 40)) for _ in range(rng.randint(1, 6)))
        if i and rng.random() < 0.25:
            text = out[rng.randrange(len(out))][1] or ""
            if rng.random() < 0.5:
                w = text.split(" ")
                w[rng.randrange(len(w))] = "edited"
                text = " ".join(w)
        out.append((i, text, rng.choice(["en", "en", None]), rng.choice(["a", "b", "c", None])))
    out += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \t\n \x0b", "en", "b"), (n + 3, "one", "en", "a"), (n + 4, "\u00a0\u2003 caf\u00e9\u00a0x", "en", "c")]
    out += [(n + 5, "loop " * 90, "en", "a"), (n + 6, "tail\r\nwith\x0cfeeds " * 12, "en", "b"), (None, "without an id but with some words in it", "en", "c")]
    return [(*r, None if r[1] is None else len(r[1]), -1, "clash", "clash") for r in out]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def words(text):
    return [] if text is None else text.encode().split()
