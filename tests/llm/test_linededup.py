import random

import duckdb

from parchmint.llm import linededup


def brute(rows):
    """Texts after removal: rows are (doc_id, text) with distinct ids."""
    places = {}
    filled = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        filled[i] = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        own = [lines[k].strip(" \t\r") for k in filled[i]]
        for k in range(len(own) - 2):
            places.setdefault(tuple(own[k : k + 3]), []).append((i, k))
    gone = set()
    for found in places.values():
        for i, k in sorted(found)[1:]:
            gone |= {(i, filled[i][k + j]) for j in range(3)}
    out = {}
    for i, text in rows:
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
    return out, gone


def documents(n=120, seed=1):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(30)] + ["", "  "]
    passages = [[rng.choice(lines[:30]) for _ in range(5)] for _ in range(4)]
    rows = []
    for i in range(n):
        own = [rng.choice(lines) + rng.choice(["", "", " ", "\t"]) for _ in range(rng.randrange(12))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (rng.choice(passages) if rng.random() < 0.5 else []) + own[at:])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n".join(["same"] * 9)), (n + 3, "a\nb"), (n + 4, "a\nb")]


def test_equals_brute_force(make):
    rows = documents()
    want, gone = brute(rows)
    got = linededup.dedup_lines(make(rows)).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.n_removed for r in got) == len(gone) > 100
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert {r.doc_id: r.n_lines for r in got} == {i: 0 if t is None else t.count("\n") + 1 for i, t in rows}


def test_sql_equals_brute_force(make):
    rows = documents(seed=2)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = linededup.LINE_DEDUP_SQL.format(documents="documents") + "SELECT doc_id, text FROM counted"
    assert dict(con.sql(sql).fetchall()) == {i: t for i, t in brute(rows)[0].items() if t is not None}


def test_odd_rows(odd, none, make):
    got = linededup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert sorted(map(str, [r.text for r in got.collect()])) == sorted(map(str, [r.text for r in odd.collect()]))
    assert linededup.dedup_lines(none).collect() == []
    text = "a\nb\nc"
    # Repeated rows are one document; a null id comes last; ids shared by other texts are told apart.
    rows = make([(1, text), (1, text), (None, text), (1, f"x\n{text}")])
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in linededup.dedup_lines(rows).collect()) == [(0, "", 3), (1, text, 0), (1, text, 0), (1, "x", 3)]


def test_hot_window(make):
    """One passage in every document."""
    rows = [(i, f"own {i}\nh1\nh2\nh3\nh4\nend {i}") for i in range(400)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(make(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}\nend {i}" for i in range(1, 400))
