import random

import __spark_entry__
import corpus_pipeline as P

from chronogrid.llm import decontamination, language_id

from . import corpus, test_decontamination, test_language, test_lines, test_near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, path, docs, items):
    corpus.frame(spark, docs).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def planted():
    items, docs, truth = test_decontamination.planted()
    rng = random.Random(1)
    docs = [(i, t, "en", rng.choice(["a", "b"]), len(t), 0, "", "") for i, t, *_ in docs]
    clean = [d for d in docs if d[0] not in truth]
    copies = [(1000 + k, clean[k][1] + rng.choice(["", " end"]), "en", "c", 0, 0, "", "") for k in range(20)]
    other = [(2000 + k, corpus.prose(rng, corpus.DE, 60), "de", "d", 0, 0, "", "") for k in range(60)]
    odd = [(3000, None, None, None, None, 0, "", ""), (3001, "123 !!", "en", None, None, 0, "", "")]
    return items, docs, truth, copies, other, odd


def test_stages(spark, tmp_path):
    items, docs, truth, copies, other, odd = planted()
    write(spark, tmp_path, docs + copies + other + odd, items)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = frame
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == COLUMNS, name
    ids = {r.doc_id for r in kept.collect()}
    assert ids & {3000, 3001} == set()
    assert not ids & set(truth) and not ids & {c[0] for c in copies}
    assert {d[0] for d in docs if d[0] not in truth} <= ids and {o[0] for o in other} <= ids
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids and all(r.taken <= 2 * r["size"] for r in out)
    assert sum(r.taken for r in out) > 1.3 * sum(r["size"] for r in out)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == [n for n in names if n.startswith("op")] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def similar(x, y):
    a, b = set(test_near_dedup.labelled(x)), set(test_near_dedup.labelled(y))
    return corpus.words(x) == corpus.words(y) or (len(a & b) >= 0.8 * len(a | b) > 0 and test_near_dedup.similarity(x, y) >= 0.8)


def has_passage(text, items):
    words = lambda t: "".join(c for c in t.lower() if not (c.isascii() and not c.isalnum() and not c.isspace())).split()
    numbers = {}
    b = [numbers.setdefault(w, len(numbers)) for w in words(text)]
    grams = {tuple(b[i : i + 3]) for i in range(len(b) - 2)}
    for _, item in items:
        a = [numbers.setdefault(w, len(numbers)) for w in words(item)]
        if any(tuple(a[i : i + 3]) in grams for i in range(len(a) - 2)) and test_decontamination.plain_smith_waterman(a, b) >= decontamination.MIN_SCORE * len(a):
            return True
    return False


def test_stages_equal_plain_ones(spark, tmp_path):
    """Each stage against a plain version on what its predecessor kept."""
    items, docs, _, copies, other, odd = planted()
    rows = [(d[0], d[1], d[2], d[3], d[4]) for d in docs[:70] + copies + other[:25] + odd]
    lines = [(4000 + k, f"{corpus.prose(random.Random(k), corpus.EN, 30)}\nsubscribe to the letter\nown line {k}", "en", f"site{k % 14}", 0) for k in range(28)]
    rows += [*lines, (5000, "subscribe to the letter", "en", "site1", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    dictionaries = language_id.learn(frame.where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "text", "lang"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {r[0]: r[1] for r in rows}
    want = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t) and test_language.plain(t, dictionaries)[1] >= language_id.MIN_MARGIN}
    steps = [dict(want)]
    source = {r[0]: r[3] for r in rows}
    cut = test_lines.brute([(i, t, "", source[i]) for i, t in sorted(want.items())])
    want = {i: c[2] for i, c in cut.items() if not (c[1] and not c[2].split())}
    steps.append(dict(want))
    parent = {i: i for i in want}
    for a in sorted(want):
        for b in sorted(want):
            if a < b and parent[a] != parent[b] and similar(want[a], want[b]):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = {k: new if v == old else v for k, v in parent.items()}
    want = {i: t for i, t in want.items() if parent[i] == i}
    steps.append(dict(want))
    want = {i: t for i, t in want.items() if not has_passage(t, items)}
    steps.append(dict(want))
    kept = frame
    for (name, stage), expected in zip(P.STAGES[:-1], steps, strict=True):
        kept = P.materialize(stage(spark, kept, str(tmp_path)), "stage")
        assert {r.doc_id: r.text for r in kept.collect()} == expected, name
    assert 5000 not in steps[1] and len(steps[3]) < len(steps[2]) < len(steps[1]) < len(steps[0]) < len(rows)
    out = P.mix_to_targets(spark, kept, str(tmp_path)).collect()
    assert {r.doc_id: r["size"] for r in out} == {i: len(corpus.words(t)) for i, t in steps[3].items()}


def test_odd_columns_repeated_rows_and_long_texts(spark, tmp_path):
    items, docs, *_ = planted()
    names = ["n_lines", "n_removed", "score", "class_id", "lang_pred", "rep", "__removed"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(d[0], d[1], "en", None, None, *([None] * 6), "x") for d in docs[:30]]
    rows += [rows[1], (None, docs[1][1], None, None, None, *(["y"] * 7)), (9000, "long words of a text " * 40_000, "en", "a", 1, *([None] * 7))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = frame = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        kept = P.materialize(stage(spark, kept, str(tmp_path)), "stage")
        assert kept.columns == frame.columns, name
    got = kept.collect()
    assert sum(r.doc_id == 1 for r in got) == 1 and sum(r.doc_id is None for r in got) == 1 and any(r.doc_id == 9000 for r in got)
    assert P.mix_to_targets(spark, kept, str(tmp_path)).count() == len(got)
