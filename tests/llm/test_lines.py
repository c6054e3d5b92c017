import hashlib
import random
import re

import duckdb

from chronogrid.llm import line_dedup as L

from . import corpus


def docs(seed=4, sites=20):
    rng = random.Random(seed)
    lines = [f"boiler {i} plate" for i in range(8)]
    spread = {0: 3, 1: 10, 2: 11, 3: 12, 4: 13, 5: 14, 6: 20, 7: 20}
    out = []
    for i in range(300):
        site = i % sites
        own = [f"own line {i} {j}" for j in range(rng.randint(0, 4))]
        own += [x for k, x in enumerate(lines) if site < spread[k] and rng.random() < 0.9]
        own += rng.choice([[], [""], ["  "], ["own line 1 1"]])
        rng.shuffle(own)
        out.append((i, "\n".join(own), "en", f"site{site}", 0, 0, "", ""))
    return [*out, (900, None, "en", "x", 0, 0, "", ""), (901, "", None, None, 0, 0, "", ""), (902, "boiler 7 plate", None, None, 0, 0, "", ""), (903, "boiler 7 plate\r\nboiler 7 plate\nboiler 7 plate", None, "site1", 0, 0, "", "")]


def brute(data, min_sites=12):
    worded = re.compile(r"[^\x20\x09-\x0D]")
    sites, first = {}, {}
    for d in data:
        for k, line in enumerate((d[1] or "").split("\n") if d[1] is not None else []):
            if worded.search(line):
                sites.setdefault(line, set()).add(d[3])
                first[line] = min(first.get(line, (1 << 60, 0)), (d[0], k))
    out = {}
    for d in data:
        if d[1] is None:
            out[d[0]] = (0, 0, None)
            continue
        lines = d[1].split("\n")
        gone = {k for k, x in enumerate(lines) if worded.search(x) and len(sites[x]) >= min_sites and first[x] != (d[0], k)}
        out[d[0]] = (sum(bool(worded.search(x)) for x in lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_equals_brute_force(spark):
    data = docs()
    out = L.line_dedup(corpus.frame(spark, data))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute(data)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "n_words", "removed", "key", "n_lines", "n_removed"}


def test_sql(spark):
    data = docs(5)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(d[0], d[1], d[3]) for d in data])
    got = {r[0]: r[1:] for r in con.execute(L.oracle_sql()).fetchall()}
    assert got == {i: (n, m, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in brute(data).items()}


def test_repeated_rows_and_null_ids(spark):
    line = "the same line everywhere"
    data = [(i, line, "", f"s{i}", 0, 0, "", "") for i in range(15)]
    out = L.line_dedup(corpus.frame(spark, [*data, data[0], (None, line + "\nx", "", "s1", 0, 0, "", "")])).collect()
    kept = sorted((r.doc_id is None, r.doc_id, r.text) for r in out if r.text)
    assert [(r[1], r[2]) for r in kept] == [(None, line + "\nx")] and len(out) == 17
    out = L.line_dedup(corpus.frame(spark, [*data, data[0]])).collect()
    assert sorted(r.doc_id for r in out if r.text) == [0, 0]
    assert L.line_dedup(corpus.frame(spark, [])).count() == 0
