from collections import defaultdict

import pytest

from bytelake.llm.line_dedup import dedup_lines


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and i != max(held[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    s, e = "Shared line number one, Été", "another line that is shared"
    rows = [(1, f"{s}\nown text of the first\n\n{e}"), (2, f"  {s.replace('S', 's')}\t\r\nx"), (3, f"{s}\n{s}\n{e} "), (4, e), (5, None), (6, ""), (None, s), (7, "short\nshort"), (8, "short"), (9, "short")]
    rows += [(4, e), (4, f"{e}\nsecond row of four"), (10, "\n\n" + e + "\n"), (11, s.replace("É", "é")), (12, "\x1c" + s), (13, s.upper())]
    rows += [(20, "\n".join(f"line {i % 7} of a very long document" for i in range(3000)))] + [(i, f"line {i % 7} of a very long document") for i in range(21, 50)]
    docs = spark.createDataFrame([(t, "n", "m", i) for i, t in rows], "text string, __th string, __gone string, doc_id long")
    got = dedup_lines(docs, counts=("__n_lines", "__n_dropped"))
    assert got.columns == ["text", "__th", "__gone", "doc_id", "__n_lines", "__n_dropped"] and {r["__th"] for r in got.collect()} == {"n"}
    assert sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in got.collect()), key=str) == brute(rows)


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a\nb", 7, 8)], "doc_id long, text string, __n_lines long, n_dropped long")
    assert [tuple(r) for r in dedup_lines(docs).collect()] == [(1, "a\nb", 7, 8)]
    with pytest.raises(ValueError, match="n_dropped"):
        dedup_lines(docs, counts=("n_lines", "N_DROPPED"))


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
