import random
import re

import zstandard

from chronogrid.llm import language_id as L

from . import corpus


def data(n=120):
    rng = random.Random(8)
    out = []
    for i in range(n):
        lang = "de" if i % 2 else "en"
        out.append((i, corpus.prose(rng, corpus.DE if lang == "de" else corpus.EN, rng.randint(15, 80)), lang if i % 7 else None, "s", 0, 0, "", ""))
    return out


def test_held_out_accuracy(spark):
    rows = data()
    out = {r.doc_id: r for r in L.language_id(corpus.frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for r in rows:
        assert out[r[0]].held_out == corpus.held(r[0])
        assert out[r[0]].lang_pred == ("de" if r[0] % 2 else "en") and 0 <= out[r[0]].score <= 1 and not out[r[0]].rejected


def test_hot_copies_do_not_fill_the_sample(spark):
    rows = data(60) + [(1000 + i, "the same text again and again", "en", "s", 0, 0, "", "") for i in range(500)]
    learned = L.learn(corpus.frame(spark, rows).select("doc_id", "text", "lang"), sample_rows=40)
    assert set(learned) == {"de", "en"} and learned["en"].count(b"the same text") == 1


def test_odd_rows(spark):
    rows = data(60) + [(900, None, "en", "s", 0, 0, "", ""), (901, "", "en", "s", 0, 0, "", ""), (902, "12 34 !!", "en", "s", 0, 0, "", ""), (903, "中文字", "en", "s", 0, 0, "", ""), (None, corpus.DE[0] * 3, None, None, 0, 0, "", ""), (904, ("über schön zwischen " * 9000), "de", "s", 0, 0, "", "")]
    out = {r.doc_id: r for r in L.language_id(corpus.frame(spark, rows)).collect()}
    for i in (900, 901, 902):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[903].lang_pred != "und" and out[None].held_out is False and out[904].lang_pred == "de"


def test_nothing_learned(spark):
    out = L.language_id(corpus.frame(spark, [(1, "text", None, None, 0, 0, "", "")])).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in out] == [("und", 0.0, True)]
    assert L.language_id(corpus.frame(spark, [])).count() == 0


def test_copies_do_not_empty_the_sample(spark):
    """Few distinct texts among very many copies: the share kept before ranking is of distinct texts."""
    rows = spark.range(30000).selectExpr("id as doc_id", "concat('three texts in many copies ', id % 3) as text", "'en' as lang")
    learned = L.learn(rows, sample_rows=4)
    assert learned["en"].count(b"three texts") == 3


def test_dictionaries_hold_more_than_a_header(spark):
    rows = [(i, "licence header line " * 150 + f"middle{chr(97 + i)} " * 300 + f"ending{chr(97 + i)} " * 200, "en") for i in range(4)]
    learned = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for i in range(4):
        assert f"middle{chr(97 + i)}".encode() in learned["en"] and f"ending{chr(97 + i)}".encode() in learned["en"]
    assert len(learned["en"]) <= 4 * (L.TEXT_BYTES + L.PIECES)


def test_many_languages_ties_and_repeated_rows(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 40, f"l{k:03d}") for k in range(400)]
    rows += [(1000, rows[0][1], "aaa"), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, "s", "clash") for r in rows], "doc_id long, text string, lang string, source string, lang_pred string")
    learned = L.learn(docs.select("doc_id", "text", "lang"), total_bytes=400 * 4 * L.TEXT_BYTES)
    assert len(learned) == 401
    found = L.identify(docs, learned).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(found) == len(rows) and all(len(x) == 1 for x in by.values())
    assert by[0] == {("aaa", 0.0)}  # l000 learned the same text
    assert sum(next(iter(by[k]))[0] == f"l{k:03d}" for k in range(1, 400)) > 380


def plain(text, dictionaries):
    """Sizes by one compressor a block and language."""
    raw = re.sub(rb"[!-@\[-`{-~]", b"", text.lower().encode())
    sizes = []
    for lang, d in sorted(dictionaries.items()):
        own = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = lambda b: zstandard.ZstdCompressor(level=L.LEVEL, dict_data=own, write_content_size=False, write_dict_id=False).compress(b)  # noqa: B023, E731
        sizes.append((sum(len(c(raw[i : i + L.BLOCK_BYTES])) for i in range(0, len(raw), L.BLOCK_BYTES)), lang))
    sizes.sort()
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def test_predictions_equal_plain_ones(spark):
    rows = data(60)
    docs = corpus.frame(spark, rows)
    learned = L.learn(docs.select("doc_id", "text", "lang").where("doc_id < 40"))
    for r in L.identify(docs, learned).collect():
        assert (r.lang_pred, r.score) == plain(rows[r.doc_id][1], learned) and r.rejected == (r.score < L.MIN_MARGIN)
